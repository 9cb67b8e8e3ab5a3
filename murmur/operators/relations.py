"""J1, J2, J9, A1, A12, P11 and the post enrichment."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Observation, functions as F

from murmur.functions.numeric import engagement
from murmur.functions.text import link_id_from_permalink, normalise_link_id, relevance, topic
from murmur.operators.clean import dedup


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """One row per key, deterministically (the first in file order, without an ordinal the smallest remaining
    row), collapsed map-side: a recomputation after an executor loss picks the same row."""
    return dedup(df, [key])


def ensure_link_id(comments: DataFrame, parity: bool = False) -> DataFrame:
    """derive ``link_id`` from ``permalink`` when absent, then strip ``t3_``."""
    if "link_id" in comments.columns:
        raw = F.col("link_id")
        if "permalink" in comments.columns:
            raw = F.coalesce(raw, link_id_from_permalink(F.col("permalink")))
    else:
        raw = link_id_from_permalink(F.col("permalink"))
    return comments.withColumn("link_id", normalise_link_id(raw, parity))


#: A link id is hot from one in so many comments on; the sketch tracks more values than can be hot.
HOT_SHARE, TRACKED = 500, 8192


def hot_links(links: DataFrame, column: str = "link_id", share: int = HOT_SHARE) -> list[str]:
    """The values that hold one in ``share`` of all rows or more (so ``share`` of them at most), by a mergeable
    frequent-items sketch in one aggregation; its counts are off by a few in ``TRACKED`` of the rows."""
    got = links.agg(F.count(column).alias("n"), F.expr(f"approx_top_k({column}, {share}, {TRACKED})").alias("top")).first()
    return sorted(x["item"] for x in got["top"] or [] if x["item"] is not None and x["count"] * share >= got["n"])


def relation_of_skewed(posts: DataFrame, comments: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """:func:`relation` (default mode) for links that hold much of all comments, whatever the session's settings. Comments
    without a link have no parent and meet no join; the posts of hot links, ``share`` rows at most, are broadcast to
    their comments where these lie; what is left is shuffled and has no key of one in ``share`` rows."""
    c = ensure_link_id(comments)
    p = unique_by(posts, "id")
    hot = hot_links(c.select("link_id"), share=share)
    is_hot = lambda name: F.col(name).isin(hot) if hot else F.lit(False)
    some = c.where(F.col("link_id").isNotNull())
    nobody = p.where(F.lit(False))
    return functools.reduce(DataFrame.unionByName, (
        _linked(some.where(~is_hot("link_id")), p),
        _linked(some.where(is_hot("link_id")), F.broadcast(p.where(is_hot("id")))),
        _linked(c.where(F.col("link_id").isNull()), F.broadcast(nobody))))


def _linked(c: DataFrame, p: DataFrame) -> DataFrame:
    overlap = set(c.columns) & set(p.columns)
    c2 = c.select(*[F.col(x).alias(f"{x}_comment" if x in overlap else x) for x in c.columns])
    p2 = p.select(*[F.col(x).alias(f"{x}_post" if x in overlap else x) for x in p.columns])
    left = "link_id_comment" if "link_id" in overlap else "link_id"
    rel = c2.join(p2, c2[left] == p2["id_post"], "left")
    return rel.withColumn("has_parent_post", F.col("id_post").isNotNull())


def relation(posts: DataFrame, comments: DataFrame, parity: bool = False, salt: int | None = None) -> DataFrame:
    """J1 + P11: every comment with its parent post (LEFT), overlapping names suffixed
    ``_comment`` / ``_post``; ``has_parent_post``.

    Default mode joins against posts unique by ``id`` (no fan-out) and tests the parent
    key; parity mode keeps duplicate post ids and tests the title, like the original.
    A post with very many comments is a hot key on the comment side only: AQE's skew-join
    split handles it (the post side is one row per key)."""
    c = ensure_link_id(comments, parity)
    p = posts if parity else unique_by(posts, "id")
    overlap = (set(c.columns) & set(p.columns))
    c2 = c.select(*[F.col(x).alias(f"{x}_comment" if x in overlap else x) for x in c.columns])
    p2 = p.select(*[F.col(x).alias(f"{x}_post" if x in overlap else x) for x in p.columns])
    left_key = "link_id_comment" if "link_id" in overlap else "link_id"
    right_key = "id_post" if "id" in overlap else "id"
    if salt:
        # explicit salting for a hot post (when AQE's skew split is off or not triggered):
        # each comment gets a deterministic salt in [0, salt), each post is copied once per
        # salt value, and the join runs on (key, salt) — a hot key becomes `salt` tasks.
        ckey = "id_comment" if "id" in overlap else "id"
        c2 = c2.withColumn("_salt", F.pmod(F.xxhash64(F.col(ckey)), F.lit(salt)))
        p2 = p2.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        rel = c2.join(p2, (c2[left_key] == p2[right_key]) & (c2["_salt"] == p2["_salt"]), "left") \
            .drop(c2["_salt"]).drop(p2["_salt"])
    else:
        # one row per id: the posts are the hash side and the comments need no sort. Repeated ids may all be one, so they are sorted
        rel = c2.join(p2 if parity else p2.hint("shuffle_hash"), c2[left_key] == p2[right_key], "left")
    flag = F.col("title").isNotNull() if parity else F.col(right_key).isNotNull()
    return rel.withColumn("has_parent_post", flag)


def comment_counts(comments: DataFrame, parity_relation: DataFrame | None = None) -> DataFrame:
    """A1: ``(link_id, comment_count)``. Partial aggregation collapses a hot post map-side.
    Pass the parity relation to count relation rows (duplicate posts double them)."""
    src = parity_relation if parity_relation is not None else ensure_link_id(comments)
    key = "link_id_comment" if "link_id_comment" in src.columns else "link_id"
    return src.groupBy(F.col(key).alias("link_id")).agg(F.count(F.lit(1)).alias("comment_count"))


def posts_with_counts(posts: DataFrame, counts: DataFrame) -> DataFrame:
    """J2 + P9: LEFT join counts on ``id = link_id`` and fill 0 (keeps post multiplicity)."""
    out = posts.join(counts, posts["id"] == counts["link_id"], "left").drop(counts["link_id"])
    return out.withColumn("comment_count", F.coalesce(F.col("comment_count"), F.lit(0)).cast("long"))


def orphans(posts: DataFrame, comments: DataFrame, parity: bool = False) -> DataFrame:
    """Comments with no parent post (anti join on the normalised key)."""
    c = ensure_link_id(comments, parity)
    ids = posts.select(F.col("id").alias("_pid")).distinct()
    return c.join(ids.hint("shuffle_hash"), c["link_id"] == F.col("_pid"), "left_anti")


def enrich_posts(posts: DataFrame, keywords=None, topics=None, topic_default=None,
                 parity: bool = False) -> DataFrame:
    """F7, F8, F9 on titles: relevance, topic and engagement (needs ``comment_count``)."""
    return (posts
            .withColumn("relevance", relevance("title", keywords))
            .withColumn("topic", topic("title", topics, topic_default, parity))
            .withColumn("engagement", engagement("comment_count", "score")))


def with_counters(df: DataFrame, name: str, flag: str | None = None) -> tuple[DataFrame, Observation]:
    """Row (and flagged-row) counts gathered by ``observe`` during the next action,
    without an extra job."""
    obs = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    if flag:
        metrics.append(F.count_if(~F.col(flag)).alias(f"not_{flag}"))
    return df.observe(obs, *metrics), obs


# column forms re-exported for callers that group by them
relevance_col = relevance
topic_col = topic
