"""S1-S7 scans and K1-K3 sinks over raw files.

All scans read by header name and cast to explicit types (no inference). Text CSVs whose fields contain newlines need
``multiLine``; such files do not split, so :func:`ingest` parses them once, counts what it cannot read,
and every later job reads the splittable Parquet copy.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from murmur.session import shared_scratch_path

# pandas reads all of these as missing; Spark CSV knows one nullValue, so normalise after.
NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "<NA>", "#N/A", "-NaN", "-nan"]

POSTS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("created_utc", T.DoubleType()),
    T.StructField("score", T.LongType()),
])
COMMENTS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("created_utc", T.DoubleType()),
    T.StructField("score", T.LongType()),
    T.StructField("link_id", T.StringType()),
    T.StructField("permalink", T.StringType()),
])
BAR_COLUMNS = ["Date", "Close", "High", "Low", "Open", "Volume"]


#: Where a row stands in its input: files by path, then the block of the file, then the row within it.
ORDINAL = ["ord_file", "ord_block", "ord_row"]
CORRUPT = "_corrupt_record"


def with_ordinal(scan: DataFrame) -> DataFrame:
    """A file scan with the three columns of ``ORDINAL``. Ordering by them is file order: rows of one block are read by one
    task in order, so their ids ascend whatever else the task reads. Take it from the scan itself, before any shuffle."""
    return scan.withColumns({"ord_file": F.col("_metadata.file_path"), "ord_block": F.col("_metadata.file_block_start"),
                             "ord_row": F.monotonically_increasing_id()})


def _reader(spark: SparkSession):
    return (spark.read.option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the header, as strings, and the raw text of rows that do not fit it. Files of one
    folder must share a header: one that differs is an error, not a column mix-up."""
    header = _reader(spark).csv(path).schema
    if not header.fields:
        return _reader(spark).csv(path)
    schema = T.StructType([*header.fields, T.StructField(CORRUPT, T.StringType())])
    return _reader(spark).schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", False).csv(path)


def _by_name(columns: list[str], name: str) -> Column | None:
    """The column of a header, whatever its place, case and padding; the first of equal ones."""
    at = {c.strip().lower(): c for c in reversed(columns)}
    return F.col("`" + at[name.lower()].replace("`", "``") + "`") if name.lower() in at else None


def _cast(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.LongType):  # whole numbers are also written as 5.0
        return c.try_cast("double").try_cast(kind)
    if isinstance(kind, T.DoubleType):  # NaN is a value in Spark: NULL drops and compares as a missing one
        return F.nanvl(c.try_cast(kind), F.lit(None).cast(kind))
    return c.try_cast(kind)


def typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` found by header name, in any order and among others; a missing one is NULL,
    and so is a value that its type cannot hold. The ordinal stays."""
    columns = [(f, _by_name(raw.columns, f.name)) for f in schema.fields]
    cast = [(F.lit(None).cast(f.dataType) if c is None else _cast(c, f.dataType)).alias(f.name) for f, c in columns]
    return raw.select(*cast, *(c for c in ORDINAL if c in raw.columns))


def normalise_nulls(df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Map every pandas null spelling in string columns to NULL (one projection)."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    cols = [c for c in (columns or df.columns) if c in strings and c not in exclude]
    named = {c: F.col("`" + c.replace("`", "``") + "`") for c in df.columns}
    return df.select(*[
        F.when(F.trim(named[c]).isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(named[c]).alias(c)
        if c in cols else named[c] for c in df.columns])


@dataclass
class Ingested:
    """A landed CSV: ``rows`` typed and in file order by their ordinal, ``rejects`` (the quarantine: ordinal, ``reasons`` and the
    ``record`` as read), ``counts`` seen while landing: ``rows``, ``malformed``, and ``bad_<column>`` (a value that its type cannot hold)
    and ``missing_<column>`` (of a required one)."""

    rows: DataFrame
    rejects: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def _flaws(columns: list[str], schema: T.StructType, required: tuple[str, ...]) -> dict[str, Column]:
    """What can be wrong with a raw row, by name."""
    found = [(f, _by_name([c for c in columns if c not in (CORRUPT, *ORDINAL)], f.name)) for f in schema.fields]
    malformed = F.col(CORRUPT).isNotNull()
    bad = {f"bad_{f.name}": ~malformed & c.isNotNull() & _cast(c, f.dataType).isNull() for f, c in found if c is not None and not isinstance(f.dataType, T.StringType)}
    missing = {f"missing_{f.name}": ~malformed & (F.lit(True) if c is None else c.isNull()) for f, c in found if f.name in required}
    return {"malformed": malformed} | bad | missing


def ingest(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = (), landing: str | None = None) -> Ingested:
    """S1-S4 at scale. The CSV is parsed once, into Parquet in ``landing`` (by default a new folder in the shared scratch): all
    later reads split and prune. A row that does not fit the header, or lacks a readable required value, is not in ``rows``;
    any other unreadable value is NULL there. Either way the row is in the quarantine with its reasons, so nothing
    disappears uncounted: ``rows`` + rejects that are left out = rows of the files."""
    landing = landing or shared_scratch_path(spark, "landing")
    raw = normalise_nulls(with_ordinal(_csv(spark, path)), exclude=(CORRUPT, *ORDINAL))
    if CORRUPT not in raw.columns:
        raw = raw.withColumn(CORRUPT, F.lit(None).cast("string"))
    seen = Observation(f"landing-{uuid.uuid4().hex}")
    counts = [F.count_if(c).alias(n) for n, c in _flaws(raw.columns, schema, required).items()]
    raw.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.mode("overwrite").parquet(landing)
    return landed(spark, landing, schema, required, seen.get)


def landed(spark: SparkSession, landing: str, schema: T.StructType, required: tuple[str, ...] = (), counts: dict[str, int] | None = None) -> Ingested:
    """What :func:`ingest` put into ``landing``, without parsing anything again."""
    raw = spark.read.parquet(landing)
    flaws = _flaws(raw.columns, schema, required)
    others = [c for c in raw.columns if c not in (CORRUPT, *ORDINAL)]
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in others))))
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flaws.items())))
    rejects = raw.select(*ORDINAL, reasons.alias("reasons"), record.alias("record")).where(F.size("reasons") > 0)
    out = [c for n, c in flaws.items() if n == "malformed" or n.partition("_")[2] in required]
    return Ingested(typed(raw.where(~reduce(lambda a, b: a | b, out)), schema), rejects, dict(counts or {}))


def header_of(spark: SparkSession, path: str) -> list[str]:
    return _reader(spark).csv(path).columns


def comments_schema(header: list[str]) -> T.StructType:
    """The columns of comments with those link columns that a file has."""
    names = {c.strip().lower() for c in header}
    return T.StructType([f for f in COMMENTS_SCHEMA.fields if f.name not in ("link_id", "permalink") or f.name in names])


def read_social(spark: SparkSession, posts_path: str, comments_path: str, landing: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S1. Posts and comments with fixed schemas and their ordinals; the comment link column may be
    ``link_id`` or ``permalink`` (one that the file lacks is left out)."""
    at = (lambda name: f"{landing}/{name}") if landing else (lambda name: None)
    posts = ingest(spark, posts_path, POSTS_SCHEMA, landing=at("posts"))
    comments = ingest(spark, comments_path, comments_schema(header_of(spark, comments_path)), landing=at("comments"))
    return posts.rows, comments.rows


BARS_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()),
                            *(T.StructField(c.lower(), T.DoubleType()) for c in BAR_COLUMNS[1:])])
BAR_VALUES = tuple(c.lower() for c in BAR_COLUMNS)


def coerce_bars(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """S2. Raw string bars -> typed bars; bad numbers, bad dates and the extra ticker header
    row become NULL via ``try_cast`` and the row is dropped (P2-P4)."""
    return named_bars(typed(raw, BARS_SCHEMA), symbol).na.drop("any", subset=list(BAR_VALUES))


def ingest_bars(spark: SparkSession, path: str, fallback_path: str | None = None, symbol: str | None = None,
                landing: str | None = None) -> Ingested:
    """S2+S3. Bars with all values readable, the others in the quarantine; when the file is empty, lacks ``Date`` or has no
    non-null date, the pruned fallback table (S5: symbol and the bar columns) is read in its place."""
    got = ingest(spark, path, BARS_SCHEMA, BAR_VALUES, landing)
    # a date that is there and unreadable is bad, not missing
    if fallback_path and got.counts["missing_date"] + got.counts["malformed"] == got.counts["rows"]:
        got = ingest(spark, fallback_path, BARS_SCHEMA, BAR_VALUES, landing)
    return Ingested(named_bars(got.rows, symbol), got.rejects, got.counts)


def named_bars(rows: DataFrame, symbol: str | None) -> DataFrame:
    """Bars of a file that names no symbol get ``symbol``."""
    return rows.withColumn("symbol", F.coalesce("symbol", F.lit(symbol))).select(*BARS_SCHEMA.names)


def read_bars(spark: SparkSession, path: str, fallback_path: str | None = None,
              symbol: str | None = None, landing: str | None = None) -> DataFrame:
    """The rows of :func:`ingest_bars`."""
    return ingest_bars(spark, path, fallback_path, symbol, landing).rows


def has_rows(df: DataFrame, n: int = 2) -> bool:
    """S4 ingest guard: the cached table holds at least ``n`` data rows (bounded action)."""
    return df.limit(n).count() >= n


def load_text(df: DataFrame, text_column: str, drop_missing: bool = True) -> DataFrame:
    """S7. ``(date, text)`` from a social table: date from epoch seconds, text as string."""
    out = df.select("created_utc", text_column)
    if drop_missing:
        out = out.na.drop("any")
    return out.select(F.to_date(F.timestamp_seconds("created_utc")).alias("date"),
                      F.col(text_column).cast("string").alias("text"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """K1/K2/K3. Overwrite through Spark's commit protocol (atomic per job); never write
    to the path being read."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", "\"").csv(path)  # quotes doubled, as the readers expect
    else:
        w.format(fmt).save(path)


# Small files beside the tables (markers, manifests), through the file system that the path names.


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file; None where there is none."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Write a small file beside its place and rename it there, so no reader sees half of it. Without ``replace``
    a file that is there stays, and the answer is False."""
    fs, at = _file_system(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_part-{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if replace and fs.exists(at):
        fs.delete(at, False)
    # the rename is what decides between two writers: of one target only one succeeds
    done = not fs.exists(at) and fs.rename(part, at)
    if not done:
        fs.delete(part, False)
    return done


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none where there is no folder."""
    fs, at = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def schema_of(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def fingerprint(spark: SparkSession, paths: list[str], *others) -> str:
    """A digest of the files behind ``paths`` (globs; name, length and time of change of every file) and of ``others``."""
    seen = []
    for path in paths:
        fs, at = _file_system(spark, path)
        for found in fs.globStatus(at) or []:
            listing = fs.listFiles(found.getPath(), True) if found.isDirectory() else None
            status = [found] if listing is None else []
            while listing is not None and listing.hasNext():
                status.append(listing.next())
            seen += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in status]
    return hashlib.sha256(json.dumps([sorted(seen), [repr(o) for o in others]]).encode()).hexdigest()
