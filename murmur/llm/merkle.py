"""Merkle manifest of a dataset: only every few levels are stored, proofs recompute the rest.

Rows become leaves, ordered within their part (source) by key; ``FANOUT`` consecutive nodes become their hash, level
by level, up to the part's subroot, and the subroots likewise give the root. A stored table holds the nodes of one level in
aligned blocks of ``FANOUT ** STRIDE``; the levels between two stored ones are never written. A proof takes a block,
regenerates its missing interior nodes from the stored ones, emits each node's siblings and forgets the nodes again, so
the manifest takes little over one digest a row while a proof costs the hashes of one block a stored level.

Nothing is gathered whole: positions come from range partitions and one offset for each partition and part, a block is
the largest group there is (81 nodes), whatever share of all rows one part holds, and all stored tables are
Parquet in the manifest's folder, so a lost executor recomputes blocks from them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, scratch, table

FANOUT = 3
#: Levels from one stored table to the next: blocks of 81 nodes.
STRIDE = 4
BLOCK = FANOUT**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value; integers decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def _joined_hash(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _interior(nodes: Column, n: Column) -> Column:
    """The levels of one block, from its stored nodes upwards; ``n`` nodes stand on the stored level of the whole
    part. Where one node is left in the part, the levels above repeat it."""

    def up(levels: Column, width: Column) -> Column:
        last = F.element_at(levels, -1)
        starts = F.sequence(F.lit(1), F.size(last), F.lit(FANOUT))
        runs = F.transform(starts, lambda i: _joined_hash(F.slice(last, i, FANOUT)))
        return F.concat(levels, F.array(F.when(n > width, runs).otherwise(last)))

    widths = F.array(*(F.lit(FANOUT**s).cast("long") for s in range(STRIDE)))
    return F.aggregate(widths, F.array(nodes), up)


def _steps(levels: Column, n: Column, i: Column) -> Column:
    """From node ``i`` of a block up to the block's top: place in the run and siblings, left to right."""
    steps = []
    for s in range(STRIDE):
        here = F.floor(i / F.lit(FANOUT**s)).cast("int")
        at = here % FANOUT
        level = F.get(levels, F.lit(s))
        siblings = F.concat(F.slice(level, here - at + 1, at), F.slice(level, here + 2, F.lit(FANOUT - 1) - at))
        steps.append(F.when(n > FANOUT**s, F.struct(at.alias("at"), siblings.alias("siblings"))))
    return F.array_compact(F.array(*steps))


def _placed(rows: DataFrame, order: Sequence[str], path: str) -> DataFrame:
    """Adds ``at``, the position of a row within its ``part``, and ``n``, the rows of the part. The rows are range
    partitioned and sorted; a partition's share of a part is one row of the offset table, so a part that holds
    most rows is spread over the tasks here and in the join."""
    order = [F.col("part"), *(F.col(c).asc_nulls_first() for c in order)]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()).write.parquet(path)
    # the id is the partition's number above 33 bits of row number
    rows = rows.sparkSession.read.parquet(path).withColumn("task", F.shiftright("m", 33))
    shares = rows.groupBy("part", "task").agg(F.min("m").alias("first"), F.count("*").alias("rows"))
    w = Window.partitionBy("part")
    before = F.coalesce(F.sum("rows").over(w.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = shares.select("part", "task", (before - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("n"))
    return rows.join(shares, ["part", "task"]).withColumn("at", F.col("m") + F.col("shift")).drop("task", "m", "shift")


@dataclass
class Tree:
    """Stored levels, lowest first: ``part, n, block, kids``; ``tops`` are the parts' roots as ``part, node``."""

    levels: list[DataFrame]
    tops: DataFrame


def _load(spark: SparkSession, path: str) -> Tree:
    """The tree whose tables lie in ``path``: as many levels as the largest part has."""
    levels = [spark.read.parquet(f"{path}/level-0")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while (most := -(-most // BLOCK)) > 1:
        levels.append(spark.read.parquet(f"{path}/level-{len(levels)}"))
    tops = levels[0].where("false").select("part", F.lit("").alias("node"))
    for level in levels:
        tops = tops.unionByName(level.where(F.col("n") <= BLOCK).select("part", F.element_at(F.element_at(_interior(F.col("kids.node"), F.col("n")), -1), 1).alias("node")))
    return Tree(levels, tops)


def _build(rows: DataFrame, order: Sequence[str], path: str) -> Tree:
    """Store a tree over ``rows`` (``part, node`` and others, which the lowest level keeps) in ``path``."""
    others = [c for c in rows.columns if c not in ("part", "node")]
    nodes = _placed(rows, order, f"{path}/placed")
    level, most = 0, None
    while most is None or most > 1:
        kids = F.array_sort(F.collect_list(F.struct("at", "node", *(others if level == 0 else []))))
        blocks = nodes.groupBy("part", "n", F.expr(f"at div {BLOCK}").alias("block")).agg(kids.alias("kids"))
        blocks.write.parquet(f"{path}/level-{level}")
        blocks = rows.sparkSession.read.parquet(f"{path}/level-{level}")
        if most is None:
            most = blocks.agg(F.max("n")).first()[0] or 0
        top = F.element_at(F.element_at(_interior(F.col("kids.node"), F.col("n")), -1), 1)
        # the next level's n apart: a lambda would take it for this level's
        nodes = blocks.where(F.col("n") > BLOCK).select("part", "n", F.col("block").alias("at"), top.alias("node"))
        nodes = nodes.withColumn("n", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}"))
        level, most = level + 1, -(-most // BLOCK)
    return _load(rows.sparkSession, path)


def _proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """Every row of the lowest level with its ``proof``: from the top of its part down, each stored level's
    blocks meet the proof of their own top. ``above`` is ``part, proof`` of the parts' roots, and what else is to be handed down."""
    handed = [c for c in above.columns if c not in ("part", "proof")]
    ends = above.select("part", F.lit(0).cast("long").alias("block"), "proof", *handed)
    known, out = None, None
    for number, level in reversed(list(enumerate(tree.levels))):
        tops = ends.join(level.where(F.col("n") <= BLOCK).select("part"), "part", "left_semi")
        known = tops if known is None else known.unionByName(tops)
        kids, n = F.col("kids"), F.col("n")
        each = let(_interior(F.col("kids.node"), n), lambda lv: F.transform(kids, lambda k, i: F.struct(k.alias("kid"), _steps(lv, n, i).alias("steps"))))
        out = level.withColumn("each", each).drop("kids").join(known, ["part", "block"]).select("part", "n", F.explode("each").alias("e"), "proof", *handed)
        out = out.select("part", "n", F.col("e.kid").alias("kid"), F.concat("e.steps", "proof").alias("proof"), *handed)
        known = out.select("part", F.col("kid.at").alias("block"), "proof", *handed) if number else None
    return out.select("part", "n", "kid.*", "proof", *handed)


NO_STEPS = "array<struct<at: int, siblings: array<string>>>"


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", source: str = "source", path: str | None = None,
             carry: dict[str, Column] | None = None) -> str:
    """Build and store the manifest of ``docs``; returns its folder (by default a new one in the shared folder).

    A leaf is the hash of the row's ``fields``. Within a source leaves ascend by ``key``, null keys first, equal keys by
    leaf; null is a source of its own and comes first. Repeated rows are leaves of their own. ``carry`` names columns
    that are kept beside the leaves. An empty table has a manifest without leaves and root.
    """
    path = path or f"{scratch(docs.sparkSession)}/llm-manifest-{uuid.uuid4().hex}"
    part = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))
    carried = [v.alias(c) for c, v in (carry or {}).items()]
    rows = docs.select(part.alias("part"), leaf_hash([F.col(f) for f in fields]).alias("node"), F.col(key).alias("key"), *carried)
    # hashed once and stored: range partitioning reads its input twice
    rows.withColumn("nr", F.monotonically_increasing_id()).write.parquet(f"{path}/leaves")
    tree = _build(docs.sparkSession.read.parquet(f"{path}/leaves"), ["key", "node", "nr"], f"{path}/parts")
    _build(tree.tops.select(F.lit("").alias("part"), "node", F.col("part").alias("name")), ["name"], f"{path}/root")
    return path


def root(spark: SparkSession, path: str) -> str | None:
    """The root of a stored manifest; none for an empty table."""
    top = _load(spark, f"{path}/root").tops.first()
    return top["node"] if top else None


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """One row per leaf of the manifest in ``path``: ``key``, the carried columns, ``leaf``, ``at`` (position in its source),
    ``subroot``, ``root`` and ``proof``, the steps from leaf to root as ``at`` (place in its run) and ``siblings`` (the run's others)."""
    parts, upper = _load(spark, f"{path}/parts"), _load(spark, f"{path}/root")
    top = upper.tops.select("part", F.array().cast(NO_STEPS).alias("proof"), F.col("node").alias("root"))
    heads = _proofs(upper, top).select(F.col("name").alias("part"), "proof", F.col("node").alias("subroot"), "root")
    out = _proofs(parts, heads)
    others = [c for c in out.columns if c not in ("part", "n", "at", "node", "nr", "proof", "subroot", "root")]
    return out.select(*others, F.col("node").alias("leaf"), "at", "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def fold(node: Column, step: Column) -> Column:
        left = F.slice(step["siblings"], F.lit(1), step["at"])
        right = F.slice(step["siblings"], step["at"] + 1, F.lit(FANOUT))
        return _joined_hash(F.concat(left, F.array(node), right))

    return F.aggregate(proof, leaf, fold)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and the root that it leads to after every second document (by checksum of its id)
    has lost its newlines."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_hash([F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]))
    rows = proofs(spark, manifest(docs, carry={"tampered": tampered}))
    found = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    siblings = _joined_hash(F.flatten(F.transform("proof", lambda s: s["siblings"])))
    out = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", siblings.alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, start: str) -> str:
    """Recursive levels of the trees in ``start`` (part, pos, node), with the number of nodes on each."""
    return f"""
  {name}(part, lv, pos, node, n) AS (
    SELECT part, 0, pos, node, count(*) OVER (PARTITION BY part) FROM {start}
    UNION ALL
    SELECT part, lv + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3
    FROM {name} WHERE n > 1 GROUP BY part, lv, pos // 3)"""


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if f == "text" else f) for f in FIELDS) + ")"


#: Bits of the checksum are shifted out one by one: a byte comes in, then eight marks (-1) stand for eight shifts.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(strlen(d)),
      lambda i: [ascii(d[i + 1])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""

ORACLE = f"""
WITH RECURSIVE digests AS (
  SELECT row_number() OVER () AS id, doc_id, CAST(doc_id AS VARCHAR) AS d, coalesce('s' || source, '') AS part, {_leaf_sql("text")} AS leaf,
    {_leaf_sql("replace(text, chr(10), '')")} AS cut FROM documents),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, leaf AS node FROM digests),
  {_levels_sql("trees", "leaves")},
  subroots AS (SELECT part, node, row_number() OVER (ORDER BY part) - 1 AS pos FROM trees WHERE n = 1),
  heads AS (SELECT '' AS part, pos, node FROM subroots),
  {_levels_sql("upper", "heads")},
  place AS (
    SELECT l.*, s.pos AS place, s.node AS subroot, CASE WHEN {_CRC_SQL} % 2 = 0 THEN cut ELSE leaf END AS shown
    FROM leaves l JOIN subroots s USING (part)),
  lower_steps AS (
    SELECT p.id, t.lv, p.pos // CAST(pow(3, t.lv) AS BIGINT) % 3 AS me, list(t.node ORDER BY t.pos) AS run
    FROM place p JOIN trees t ON t.part = p.part AND t.n > 1 AND t.pos // 3 = p.pos // CAST(pow(3, t.lv + 1) AS BIGINT) GROUP BY ALL),
  upper_steps AS (
    SELECT p.id, 1000 + t.lv AS lv, p.place // CAST(pow(3, t.lv) AS BIGINT) % 3 AS me, list(t.node ORDER BY t.pos) AS run
    FROM place p JOIN upper t ON t.n > 1 AND t.pos // 3 = p.place // CAST(pow(3, t.lv + 1) AS BIGINT) GROUP BY ALL),
  steps AS (
    SELECT id, lv, run[:me] AS lefts, run[me + 2:] AS rights FROM (SELECT * FROM lower_steps UNION ALL SELECT * FROM upper_steps)),
  paths AS (
    SELECT id, sha256(string_agg(array_to_string(lefts || rights, ''), '' ORDER BY lv)) AS proof_sha256,
      list({{'l': array_to_string(lefts, ''), 'r': array_to_string(rights, '')}} ORDER BY lv) AS steps
    FROM steps GROUP BY id),
  walk(id, node, steps) AS (
    SELECT p.id, p.shown, s.steps FROM place p JOIN paths s USING (id)
    UNION ALL
    SELECT id, sha256(steps[1].l || node || steps[1].r), steps[2:] FROM walk WHERE len(steps) > 0),
  folded AS (SELECT id, node FROM walk WHERE len(steps) = 0)
SELECT doc_id, leaf, subroot, (SELECT node FROM upper WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  coalesce(f.node, shown) AS folded_root, coalesce(f.node, shown) = (SELECT node FROM upper WHERE n = 1) AS verified
FROM place LEFT JOIN paths USING (id) LEFT JOIN folded f USING (id)
"""
