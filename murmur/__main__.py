"""Run the whole flow (C1) and write every artifact.

    python -m murmur --posts posts.csv --comments comments.csv --bars bars.csv \
        [--bars-fallback merged.csv] [--symbol TSLA] [--lexicon lexicon.tsv] --out DIR
    python -m murmur --demo-sf /root/testdata/sf0.001 --out DIR      # shared test tables

Artifacts are written with Spark's commit protocol, one folder each, every shared result once. The same command again
goes on where an earlier run ended: artifacts of the same inputs and options are kept.
"""

from __future__ import annotations

import argparse
import functools
import json
import os

from pyspark.sql import DataFrame, functions as F, types as T

from murmur.config import RunOptions
from murmur.operators import lexicon as lex
from murmur.plans import pipelines
from murmur.plans.artifacts import ArtifactGraph, Step
from murmur.session import build_session
from murmur.sources import files, tables


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="murmur")
    ap.add_argument("--posts")
    ap.add_argument("--comments")
    ap.add_argument("--bars")
    ap.add_argument("--bars-fallback")
    ap.add_argument("--symbol", default="TICKER")
    ap.add_argument("--lexicon", help="term<TAB>valence file; default: the demonstration lexicon")
    ap.add_argument("--demo-sf", help="use the shared test tables in this folder as inputs")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--parity", action="store_true", help="reproduce the original's quirks")
    ap.add_argument("--no-models", action="store_true")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    spark = build_session(args.master)
    sources = [args.demo_sf] if args.demo_sf else [p for p in (args.posts, args.comments, args.bars, args.bars_fallback, args.lexicon) if p]
    options = RunOptions(parity=args.parity)
    stamp = files.fingerprint(spark, sources, options, args.symbol)
    store = args.out if args.format == "parquet" else os.path.join(args.out, "_tables")
    if args.demo_sf:
        li = tables.load(spark, args.demo_sf, "lineitem")
        posts = tables.posts_from_orders(tables.load(spark, args.demo_sf, "orders"))
        comments = tables.comments_from_lineitem(li, tables.load(spark, args.demo_sf, "part"))
        bars = tables.bars_from_lineitem(li)
        landed = []
    else:
        posts, comments, bars, landed = _landed(spark, args, stamp, store)
    lexicon = lex.read_lexicon(spark, args.lexicon) if args.lexicon else lex.lexicon_frame(spark)
    inputs = pipelines.Inputs(posts=posts, comments=comments, bars=bars, lexicon=lexicon, options=options)
    graph = pipelines.graph(inputs, run_models=not args.no_models)
    out = ArtifactGraph([*landed, *graph.steps.values()]).materialise(
        spark, store, stamp, report=lambda name, written: print(f"{'wrote' if written else 'kept'} {name}"))
    if args.format != "parquet":
        for name, df in out.items():
            files.write_table(_flat(df), os.path.join(args.out, name), fmt=args.format)
    spark.stop()


def _landed(spark, args, stamp: str, store: str):
    """The CSVs parsed once into the store, and their quarantine and counts as steps; a run that goes on reads what an
    earlier one landed."""
    marker, at = f"{store}/_markers/landing.json", f"{store}/_landing"
    comments = files.comments_schema(files.header_of(spark, args.comments))
    held = json.loads(files.read_text(spark, marker) or "{}")
    if held.get("stamp") != stamp:
        files.delete(spark, marker)
        counts = {"posts": files.ingest(spark, args.posts, files.POSTS_SCHEMA, landing=f"{at}/posts").counts,
                  "comments": files.ingest(spark, args.comments, comments, landing=f"{at}/comments").counts,
                  "bars": files.ingest_bars(spark, args.bars, args.bars_fallback, landing=f"{at}/bars").counts}
        held = {"stamp": stamp, "counts": counts}
        files.write_text(spark, marker, json.dumps(held))
    got = {"posts": files.landed(spark, f"{at}/posts", files.POSTS_SCHEMA), "comments": files.landed(spark, f"{at}/comments", comments),
           "bars": files.landed(spark, f"{at}/bars", files.BARS_SCHEMA, files.BAR_VALUES)}
    counts = [(n, k, v) for n, c in held["counts"].items() for k, v in c.items()]
    rejects = functools.reduce(DataFrame.unionByName, (g.rejects.withColumn("source", F.lit(n)) for n, g in got.items()))
    steps = [Step("ingest_counts", lambda: spark.createDataFrame(counts, "source string, reason string, rows long")), Step("quarantine", lambda: rejects)]
    return got["posts"].rows, got["comments"].rows, files.named_bars(got["bars"].rows, args.symbol), steps


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as JSON text: CSV has none."""
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields))


if __name__ == "__main__":
    main()
