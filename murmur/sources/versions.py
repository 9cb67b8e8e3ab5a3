"""K3: a table whose content changes by one rename.

Data lie in folders that are never written again once a version names them. A version is a small manifest file,
numbered, that lists its folders and schema; it is written beside its place and renamed there, and of two writers of
one number one is refused and takes the next. A reader follows one manifest, so it sees one version whole: the
old one until the rename, the new one after it, never a mixture, whatever is being written or has been left behind by a
run that died.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from murmur.sources import files


def _manifests(root: str) -> str:
    return f"{root}/_versions"


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in files.names_in(spark, _manifests(root)) if n.endswith(".json") and n[:-5].isdigit()]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """What a version (default: the newest) consists of; None where there is none."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        return None
    number = max(known) if version is None else version
    return json.loads(files.read_text(spark, f"{_manifests(root)}/{number:010d}.json")) | {"version": number}


def publish(spark: SparkSession, root: str, folders: list[str], schema: T.StructType, **notes) -> int:
    """Make ``folders`` (below ``root``) the content of the table; returns the number of the version. Folders and notes that are those of
    the newest version already give no new one."""
    text = {"folders": folders, "schema": schema.json(), **notes}
    while True:
        now = manifest(spark, root)
        if now and {k: now.get(k) for k in text} == text:
            return now["version"]
        number = now["version"] + 1 if now else 1
        if files.write_text(spark, f"{_manifests(root)}/{number:010d}.json", json.dumps(text), replace=False):
            return number


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    found = manifest(spark, root, version)
    if found is None:
        raise ValueError(f"{root} has no version" + (f" {version}" if version is not None else ""))
    schema = files.schema_of(found["schema"])
    if not found["folders"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{root}/{f}" for f in found["folders"]))


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Forget all but the newest ``keep`` versions and delete the folders that only they name; returns their numbers. For a time when
    no reader is still on one of them."""
    known = versions(spark, root)
    old, kept = known[:-keep], known[-keep:]
    held = {f for v in kept for f in manifest(spark, root, v)["folders"]}
    for v in old:
        gone = set(manifest(spark, root, v)["folders"]) - held
        files.delete(spark, f"{_manifests(root)}/{v:010d}.json")
        for folder in gone:
            files.delete(spark, f"{root}/{folder}")
    return old
