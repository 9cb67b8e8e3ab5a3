"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

DataFrame functions only. A pattern's matches and the pieces between them (``split``) give the spans: a start
is the sum of the lengths before it, in code points; matches that fail their check are not kept, and those that stand are
collected in blocks, so the work grows with the text and its matches, not with their square. The patterns are written so that Java's matcher neither recurses
nor starts inside a run it has rejected: possessive loops, and a look behind for a run's first character
(``\\G`` lets an e-mail address begin right where the match before it ended).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

LOCAL = "[A-Za-z0-9._%+-]"
#: kind: pattern, words that speak for it. The first four are the contract's base kinds.
KINDS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "ip|host|server|address"),
    "card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", "card|visa|credit|payment|expir"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "tel|phone|call|fax|mobile"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}", "iban|bank|account|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "ssn|social security"),
}
BASE = ("email", "ip", "card", "phone")
OCTET = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
ONE = "struct<start: bigint, end: bigint, value: string>"
SPAN = f"array<{ONE}>"


#: Items walked in one go, and characters of a piece of text.
MANY, STRETCH = 256, 1024


def collected(items: Column, kind: str, step) -> Column:
    """What ``step`` yields over ``items``, in order, as an array of ``kind``. ``step(at, item)`` gives the next ``at`` (a number,
    0 at first), whether there is an element, and the element. An aggregate's state is copied at each step, so results are
    not carried through all items: blocks of ``MANY`` are walked for the number alone, then each for its elements."""
    blocks = F.transform(F.sequence(F.lit(1), F.size(items), F.lit(MANY)), lambda i: F.slice(items, i, MANY))

    def number(block: Column, at: Column) -> Column:
        return F.aggregate(block, at, lambda a, x: step(a, x)[0])

    def elements(block: Column, at: Column) -> Column:
        def merge(acc: Column, x: Column) -> Column:
            now, some, element = step(acc["at"], x)
            return F.struct(now.alias("at"), F.when(some, F.array_append(acc["out"], element)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), merge, lambda acc: acc["out"])

    def walk(parts: Column) -> Column:
        ats = F.aggregate(parts, F.array(F.lit(0).cast("bigint")), lambda acc, part: F.array_append(acc, number(part, F.element_at(acc, -1))))
        return let(ats, lambda known: F.flatten(F.transform(parts, lambda part, i: elements(part, F.get(known, i)))))

    return F.when(F.size(items) > 0, let(blocks, walk)).otherwise(F.array().cast(f"array<{kind}>"))


def matches(text: Column, pattern: str, stands=lambda value: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches that ``stands`` confirms: structs of start, end (code points, end exclusive) and value."""
    judged = lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x).alias("n"), F.when(stands(x), x).alias("value"))
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), judged)

    def step(at: Column, x: Column):
        start = at + x["gap"]
        end = start + x["n"]
        return end, x["value"].isNotNull(), F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))

    walk = let(F.filter(both, lambda x: x["n"].isNotNull()), lambda items: collected(items, ONE, step))
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast(SPAN))  # most texts end at the first look


def stretches(text: Column) -> Column:
    """The text in pieces of ``STRETCH`` characters: a place in it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` (exclusive, from 0; beyond the end: what there is) of a text in ``stretches``."""
    first, last = F.floor(start / STRETCH).cast("int"), F.floor(end / STRETCH).cast("int")
    joined = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(end > start, F.substr(joined, (start - first * STRETCH + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes Luhn's check."""
    turned = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: let(
        F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number (capitals and digits, spaces allowed) leaves 1 modulo 97, its first four characters last."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    code = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.ascii(F.substring(moved, i, F.lit(1))))
    return F.aggregate(code, F.lit(0), lambda a, c: F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97) == 1


def ibans(pieces: Column, heads: Column) -> Column:
    """Spans of the account numbers that begin at ``heads`` (country and check digits, from ``matches``) in a text in
    ``stretches``: of each head's run of capitals and digits with single spaces, the longest prefix of 15 to 34 characters that ends
    with a piece and leaves 1 modulo 97. Of overlapping ones the first."""
    def longest(x: Column) -> Column:
        seen = between(pieces, x["start"], x["start"] + 68)  # 34 characters, 33 spaces and what follows
        return let(seen, lambda s: let(F.regexp_extract(s, r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", 0), lambda run: F.aggregate(
            F.when(run != "", F.sequence(F.lit(15), F.length(run))).otherwise(F.array().cast("array<int>")),
            F.lit(""),
            lambda best, n: let(F.substr(run, F.lit(1), n), lambda p: F.when(
                (F.substr(p, n, F.lit(1)) != " ") & ~F.substr(s, n + 1, F.lit(1)).rlike("[A-Za-z0-9]") & _confirmed("iban", p), p).otherwise(best)),
        )))

    def step(at: Column, x: Column):
        free = x["start"] >= at
        return F.when(free, x["end"]).otherwise(at), free, x

    found = F.transform(heads, lambda x: let(longest(x), lambda v: F.struct(x["start"].alias("start"), (x["start"] + F.length(v)).alias("end"), v.alias("value"))))
    return let(F.filter(found, lambda x: x["value"] != ""), lambda items: collected(items, ONE, step))


def _confirmed(kind: str, x: Column) -> Column:
    """Whether a match stands: the checksum or the bounds of its kind."""
    n = F.length(_digits(x))
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike(OCTET))
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(x))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34) & mod97(x)
    return F.lit(True)


#: Scores: a base match, one with a checksum, one with neither; what a context word adds; how far it may stand off.
SCORES = {"email": 0.8, "ip": 0.7, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT, NEAR = 0.2, 40


def findings(text: Column, threshold: float = 0.5) -> Column:
    """Array of ``kind, start, end, score`` by kind as listed, then start: all base spans that pass their bounds and checks,
    and those of the added kinds (``iban``, ``ssn``) whose score reaches ``threshold``. An ``ssn`` needs a context word."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*(_of_kind(kind, text, threshold) for kind in KINDS))


def _of_kind(kind: str, text: Column, threshold: float) -> Column:
    pattern, context = KINDS[kind]

    def scored(pieces: Column, x: Column) -> Column:
        start, end = x["start"], x["end"]
        before = between(pieces, F.greatest(start - NEAR, F.lit(0).cast("bigint")), start)
        near = F.concat_ws(" ", before, between(pieces, end, end + NEAR)).rlike(rf"(?i)(?<![a-z])(?:{context})")
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near, CONTEXT).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.round(score, 3).alias("score"))

    def judged(spans: Column) -> Column:
        none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint, score: double>>")
        placed = let(stretches(text), lambda pieces: let(ibans(pieces, spans) if kind == "iban" else spans, lambda got: F.transform(got, lambda x: scored(pieces, x))))
        return F.when(F.size(spans) > 0, placed).otherwise(none)

    kept = let(matches(text, pattern, (lambda v: F.lit(True)) if kind == "iban" else lambda v: _confirmed(kind, v)), judged)
    return kept if kind in BASE else F.filter(kept, lambda x: x["score"] >= threshold)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (of overlapping ones the first) replaced by its kind in brackets; null stays null."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    last = F.struct(F.length(text).cast("bigint").alias("start"), F.length(text).cast("bigint").alias("end"), F.lit(None).cast("string").alias("kind"))

    def build(pieces: Column) -> Column:
        def step(at: Column, x: Column):
            free = x["start"] >= at
            piece = F.concat(between(pieces, at, x["start"]), F.coalesce(F.concat(F.lit("["), x["kind"], F.lit("]")), F.lit("")))
            return F.when(free, x["end"]).otherwise(at), free, piece

        return F.array_join(let(F.array_append(ordered, last), lambda items: collected(items, "string", step)), "")

    return F.when(F.size(spans) > 0, let(stretches(text), build)).otherwise(text)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document row: ``doc_id, findings, redacted``; no shuffle. A null text has no findings and stays null;
    null ids, repeated ids and repeated rows keep their rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"), findings(F.col(text), threshold).alias("findings"))
    return rows.select("doc_id", "findings", redact(F.col("_t"), F.col("findings")).alias("redacted"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents")).select("doc_id", "findings")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("findings", lambda x: x["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), scores)
