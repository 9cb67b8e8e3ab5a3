"""URL filters: explicit rules first, then a tree of path templates for each host, judged by labelled pages.

A path's segments become shapes (digits are ``{n}``, very long segments ``*``). From the root down, a child of a node
keeps its name only if it holds enough of the node's pages; all others share the wildcard, so a node has
``1 / MIN_SHARE`` named children at most. Siblings are then ordered by their share of bad labelled pages and each is
pooled with the cluster before it if neither that share nor the share of paths that end there differs
significantly; a pooled branch goes on as one node. A path's nodes make its template. A template is rejected if its share of
bad labelled pages, smoothed towards its host's and that towards the whole table's, reaches ``REJECT``.

All counts are sums over equal (host, path shape) first; joins back send groups of one in a thousand rows or more by broadcast
(at most a thousand rows), the rest by shuffle, so neither a hot host nor a hot path is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_size, pinned, table

#: verdict, host, path; the order does not matter: the longest rule that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Segments that the tree tells apart (all further ones are ``**``), characters of a named segment, pages and share of
#: its node's pages that a named child needs.
DEPTH, LONGEST, MIN_PAGES, MIN_SHARE = 6, 64, 5, 0.02
#: Squared normal quantile of the test for a difference; weight of the wider rate in smoothing; least smoothed bad share to reject.
Z2, WEIGHT, REJECT = 4.0, 4.0, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = ("n", "good", "bad")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
    or the end; both empty without ``://`` and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _ordered(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(((v, h.lower(), p) for v, h, p in rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host (itself or a domain above it) and path, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(_ordered(rules)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """The path's non-empty segments, variable ones generalised, joined by ``/``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    named = F.transform(F.slice(segments, 1, DEPTH), lambda s: F.when(F.length(s) > LONGEST, "*").otherwise(F.regexp_replace(F.translate(s, "|*{", "___"), "[0-9]+", "{n}")))
    return F.array_join(F.when(F.size(segments) > DEPTH, F.concat(named, F.array(F.lit("**")))).otherwise(named), "/")


def _similar(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Whether shares a of na and b of nb do not differ significantly (two proportions, pooled variance)."""
    a, na, b, nb = (c.cast("double") for c in (a, na, b, nb))
    gap = a * nb - b * na
    return gap * gap * (na + nb) <= F.lit(Z2) * (a + b) * (na + nb - a - b) * na * nb


def _clusters(siblings: Column) -> Column:
    """Siblings in order, each pooled with the cluster before it if they are similar."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = _similar(last["bad"], last["good"] + last["bad"], s["bad"], s["good"] + s["bad"]) & _similar(last["ends"], last["n"], s["ends"], s["n"])
        pooled = F.struct(*((last[c] + s[c]).alias(c) for c in (*COUNTS, "ends")), F.array_append(last["members"], s["g"]).alias("members"))
        single = F.struct(*(s[c].alias(c) for c in (*COUNTS, "ends")), F.array(s["g"]).alias("members"))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(pooled))).otherwise(F.array_append(acc, single))

    none = F.array().cast("array<struct<n: bigint, good: bigint, bad: bigint, ends: bigint, members: array<string>>>")
    return F.aggregate(siblings, none, step)


def _level(state: DataFrame) -> DataFrame:
    """One level down: ``host, shape, rest, node, n, good, bad`` with the next shape of ``rest`` moved into ``node``."""
    open_ = state.where(F.size("rest") > 0).withColumn("child", F.get("rest", F.lit(0)))
    ends = F.when(F.size("rest") == 1, F.col("n")).otherwise(0)
    kids = pinned(open_.groupBy("host", "node", "child").agg(*(F.sum(c).alias(c) for c in COUNTS), F.sum(ends).alias("ends"), F.count("*").alias("shapes")), "url-kids")
    nodes = kids.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.count("*").alias("kids"))
    named = (F.col("n") >= MIN_PAGES) & (F.col("n") >= F.col("pages") * MIN_SHARE)
    kids = join_by_size(kids, nodes, ["host", "node"], "kids", kids.count()).withColumn("g", F.when(named, F.col("child")).otherwise("*"))
    kids = kids.groupBy("host", "node", "g").agg(*(F.sum(c).alias(c) for c in (*COUNTS, "ends", "shapes")))
    rate = (F.col("bad") + 1) / (F.col("good") + F.col("bad") + 2)
    siblings = F.array_sort(F.collect_list(F.struct(rate.alias("rate"), "g", *COUNTS, "ends")))
    label = lambda c: F.when(F.size(c["members"]) == 1, F.get(c["members"], F.lit(0))).otherwise(F.concat(F.lit("("), F.array_join(F.array_sort(c["members"]), "|"), F.lit(")")))
    labels = F.flatten(F.transform(_clusters(siblings), lambda c: F.transform(c["members"], lambda g: F.struct(g.alias("g"), label(c).alias("label")))))
    nodes = kids.groupBy("host", "node").agg(labels.alias("labels"), F.sum("shapes").alias("shapes"))
    # one row a node, named children and wildcard in one short array
    down = join_by_size(open_, nodes, ["host", "node"], "shapes", open_.count())
    of = lambda name: F.get(F.filter("labels", lambda x: x["g"] == name), F.lit(0))["label"]
    down = down.withColumn("node", F.concat("node", F.lit("/"), F.coalesce(of(F.col("child")), of(F.lit("*"))))).withColumn("rest", F.expr("slice(rest, 2, size(rest))"))
    return pinned(down.select(*state.columns).unionByName(state.where(F.size("rest") == 0)), "url-level")


def templates(shapes: DataFrame) -> DataFrame:
    """``host, shape, template, t_good, t_bad, purity`` for rows ``host, shape, n, good, bad`` (one for each host and shape):
    its place in the host's tree, the labelled pages of that template and its smoothed share of bad ones."""
    state = shapes.select("host", "shape", F.filter(F.split("shape", "/"), lambda s: s != "").alias("rest"), F.lit("").alias("node"), *COUNTS)
    state = pinned(state, "url-shapes")
    for _ in range(state.agg(F.max(F.size("rest"))).first()[0] or 0):  # DEPTH + 1 at most
        state = _level(state)
    per = pinned(state.groupBy("host", "node").agg(F.sum("good").alias("t_good"), F.sum("bad").alias("t_bad"), F.count("*").alias("shapes")), "url-templates")
    hosts = per.groupBy("host").agg(F.sum("t_good").alias("h_good"), F.sum("t_bad").alias("h_bad"), F.count("*").alias("nodes"))
    good, bad = (x or 0 for x in per.agg(F.sum("t_good"), F.sum("t_bad")).first())
    wide = F.lit((bad + 1) / (good + bad + 2))
    host = (F.col("h_bad") + WEIGHT * wide) / (F.col("h_good") + F.col("h_bad") + WEIGHT)
    purity = (F.col("t_bad") + WEIGHT * host) / (F.col("t_good") + F.col("t_bad") + WEIGHT)
    judged = join_by_size(per, hosts, ["host"], "nodes", per.count()).withColumn("purity", purity).drop("h_good", "h_bad")
    out = join_by_size(state, judged, ["host", "node"], "shapes", state.count())
    return out.select("host", "shape", F.col("node").alias("template"), "t_good", "t_bad", "purity")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page row: ``page_id, host, path, rule, template, t_good, t_bad, verdict``.

    ``labels`` is ``id, bad`` (boolean), each row a label of the pages with that id; null ids and null ``bad`` label nothing.
    Null urls and such without ``://`` have host and path empty and are judged as one host; repeated pages count as often as they
    stand; an unlabelled table allows whatever no rule blocks. Empty tables give no rows.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pinned(rows.select("*", rule.alias("rule"), verdict.alias("ruled"), shape(F.col("path")).alias("shape")), "url-pages")
    total = rows.count()
    marks = labels.where("id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("id").alias("page_id")).agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    marks = rows.groupBy("page_id").agg(F.count("*").alias("pages")).join(marks, "page_id")
    marked = join_by_size(rows.select("page_id", "host", "shape"), marks, ["page_id"], "pages", total)
    zero = F.lit(0).cast("long")
    counts = rows.select("host", "shape", F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("bad")).unionByName(
        marked.select("host", "shape", zero.alias("n"), "good", "bad"))
    shapes = pinned(counts.groupBy("host", "shape").agg(*(F.sum(c).alias(c) for c in COUNTS)), "url-counts")
    found = pinned(templates(shapes).join(shapes.select("host", "shape", "n"), ["host", "shape"]), "url-judged")
    out = join_by_size(rows, found, ["host", "shape"], "n", total)
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", "template", "t_good", "t_bad", F.coalesce("ruled", own).alias("verdict"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url; the label of a page is that of the document with its number (bad: toxic or of low quality)."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), bad.alias("bad")))


def _case_sql(value) -> str:
    when = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in _ordered(RULES))
    return f"CASE {when} END"


def _similar_sql(a: str, na: str, b: str, nb: str) -> str:
    a, na, b, nb = (f"CAST({x} AS DOUBLE)" for x in (a, na, b, nb))
    gap = f"({a} * {nb} - {b} * {na})"
    return f"{gap} * {gap} * ({na} + {nb}) <= {Z2}::DOUBLE * ({a} + {b}) * ({na} + {nb} - {a} - {b}) * {na} * {nb}"


def _level_sql(d: int) -> str:
    same = f"({_similar_sql('m.bad', 'm.good + m.bad', 's.bad', 's.good + s.bad')}) AND ({_similar_sql('m.ends', 'm.n', 's.ends', 's.n')})"
    pool = ", ".join(f"s.{c} + CASE WHEN {same} THEN m.{c} ELSE 0 END" for c in (*COUNTS, "ends"))
    return f"""
  kids{d} AS MATERIALIZED (
    SELECT host, node, rest[1] AS child, CAST(sum(n) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good, CAST(sum(bad) AS BIGINT) AS bad,
      CAST(sum(CASE WHEN len(rest) = 1 THEN n ELSE 0 END) AS BIGINT) AS ends FROM state{d} WHERE len(rest) > 0 GROUP BY host, node, rest[1]),
  named{d} AS MATERIALIZED (
    SELECT *, CASE WHEN n >= {MIN_PAGES} AND n >= sum(n) OVER (PARTITION BY host, node) * CAST({MIN_SHARE} AS DOUBLE) THEN child ELSE '*' END AS g FROM kids{d}),
  pooled{d} AS (
    SELECT host, node, g, CAST(sum(n) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good, CAST(sum(bad) AS BIGINT) AS bad,
      CAST(sum(ends) AS BIGINT) AS ends FROM named{d} GROUP BY host, node, g),
  sib{d} AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY host, node ORDER BY CAST(bad + 1 AS DOUBLE) / (good + bad + 2), g) AS rk FROM pooled{d}),
  run{d}(host, node, g, rk, cluster, n, good, bad, ends) AS (
    SELECT host, node, g, rk, 1, n, good, bad, ends FROM sib{d} WHERE rk = 1
    UNION ALL
    SELECT s.host, s.node, s.g, s.rk, m.cluster + CASE WHEN {same} THEN 0 ELSE 1 END, {pool}
    FROM run{d} m JOIN sib{d} s ON s.host = m.host AND s.node = m.node AND s.rk = m.rk + 1),
  label{d} AS (
    SELECT host, node, cluster, CASE WHEN count(*) = 1 THEN any_value(g) ELSE '(' || string_agg(g, '|' ORDER BY g) || ')' END AS label
    FROM run{d} GROUP BY host, node, cluster),
  state{d + 1} AS MATERIALIZED (
    SELECT s.host, s.shape, s.rest[2:] AS rest, s.node || '/' || l.label AS node, s.n, s.good, s.bad
    FROM state{d} s JOIN named{d} k ON k.host = s.host AND k.node = s.node AND k.child = s.rest[1]
      JOIN run{d} r ON r.host = s.host AND r.node = s.node AND r.g = k.g
      JOIN label{d} l ON l.host = s.host AND l.node = s.node AND l.cluster = r.cluster
    UNION ALL SELECT * FROM state{d} WHERE len(rest) = 0)"""


ORACLE = f"""
WITH RECURSIVE cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
  parted AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
  segs AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM parted),
  shaped AS MATERIALIZED (
    SELECT page_id, host, path, {_case_sql(lambda v, h, p: h + p)} AS rule, {_case_sql(lambda v, h, p: v)} AS ruled,
      array_to_string(list_transform(segments[:{DEPTH}], lambda s: CASE WHEN length(s) > {LONGEST} THEN '*'
        ELSE regexp_replace(translate(s, '|*{{', '___'), '[0-9]+', '{{n}}', 'g') END) || CASE WHEN len(segments) > {DEPTH} THEN ['**'] ELSE [] END, '/') AS shape
    FROM segs),
  marks AS (SELECT doc_id, count_if(NOT (toxic = 1 OR quality = 0)) AS good, count_if(toxic = 1 OR quality = 0) AS bad FROM labels GROUP BY doc_id),
  state0 AS MATERIALIZED (
    SELECT host, shape, list_filter(string_split(shape, '/'), lambda s: s <> '') AS rest, '' AS node, count(*) AS n,
      CAST(coalesce(sum(good), 0) AS BIGINT) AS good, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad
    FROM shaped LEFT JOIN marks ON doc_id = page_id GROUP BY host, shape),
  {','.join(_level_sql(d) for d in range(DEPTH + 1))},
  per AS (SELECT host, node, CAST(sum(good) AS BIGINT) AS t_good, CAST(sum(bad) AS BIGINT) AS t_bad FROM state{DEPTH + 1} GROUP BY host, node),
  wide AS (SELECT CAST(sum(t_bad) + 1 AS DOUBLE) / (sum(t_good) + sum(t_bad) + 2) AS rate FROM per),
  hosts AS (SELECT host, (sum(t_bad) + {WEIGHT}::DOUBLE * any_value(rate)) / (sum(t_good) + sum(t_bad) + {WEIGHT}::DOUBLE) AS rate FROM per, wide GROUP BY host),
  judged AS (SELECT host, node, t_good, t_bad, (t_bad + {WEIGHT}::DOUBLE * rate) / (t_good + t_bad + {WEIGHT}::DOUBLE) AS purity FROM per JOIN hosts USING (host))
SELECT page_id, host, path, rule, node AS template, t_good, t_bad, coalesce(ruled, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM shaped JOIN (SELECT host, shape, node FROM state{DEPTH + 1}) USING (host, shape) JOIN judged USING (host, node)
"""
