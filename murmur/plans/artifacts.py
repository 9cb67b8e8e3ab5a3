"""C1's artifact graph: each shared result is written once, in dependency order, and a run that died goes on.

A :class:`Step` names one result and builds it from the steps that its parameters name. ``lazy`` composes the plans
without running anything. ``materialise`` writes every step as Parquet and hands the stored table to the steps that need it, so
a source is parsed and a text scored once however many artifacts use it. A marker beside the tables says
which inputs and which writes of its dependencies a step was built from; a later run with the same stamp takes over every
step whose marker still holds and writes only the others. A step without a marker (killed while it was written) is
written anew, and so is all that depends on it.
"""

from __future__ import annotations

import inspect
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from murmur.sources import files


@dataclass(frozen=True)
class Step:
    """``build``'s parameters are the names of the steps it needs. A step that is not ``stored`` is a cheap view of others."""

    name: str
    build: Callable[..., DataFrame]
    stored: bool = True

    @property
    def needs(self) -> list[str]:
        return list(inspect.signature(self.build).parameters)


class ArtifactGraph:
    def __init__(self, steps: Iterable[Step]):
        self.steps = {s.name: s for s in steps}

    def order(self, targets: Iterable[str] | None = None) -> list[Step]:
        """The targets (default: all) and all they need, each after what it needs."""
        out: dict[str, Step] = {}
        path: list[str] = []

        def visit(name: str) -> None:
            if name in out:
                return
            if name in path:
                raise ValueError(f"steps need each other: {' -> '.join([*path, name])}")
            if name not in self.steps:
                raise ValueError(f"no step {name}" + (f", needed by {path[-1]}" if path else ""))
            path.append(name)
            for need in self.steps[name].needs:
                visit(need)
            path.pop()
            out[name] = self.steps[name]

        for name in targets if targets is not None else self.steps:
            visit(name)
        return list(out.values())

    def lazy(self, targets: Iterable[str] | None = None) -> dict[str, DataFrame]:
        frames: dict[str, DataFrame] = {}
        for step in self.order(targets):
            frames[step.name] = step.build(**{n: frames[n] for n in step.needs})
        return frames

    def materialise(self, spark: SparkSession, out: str, stamp: str, targets: Iterable[str] | None = None,
                    report: Callable[[str, bool], None] = lambda name, written: None) -> dict[str, DataFrame]:
        """Store the steps under ``out`` (one folder each, markers in ``_markers``) and return the stored tables.
        ``stamp`` says what the sources and options are; ``report`` is told each step and whether it was written."""
        frames: dict[str, DataFrame] = {}
        writes: dict[str, object] = {}
        for step in self.order(targets):
            needs = {n: frames[n] for n in step.needs}
            if not step.stored:
                frames[step.name] = step.build(**needs)
                writes[step.name] = [writes[n] for n in step.needs]
                continue
            path, marker = f"{out}/{step.name}", f"{out}/_markers/{step.name}.json"
            held = json.loads(files.read_text(spark, marker) or "{}")
            wanted = {"stamp": stamp, "needs": [writes[n] for n in step.needs]}
            fresh = {k: held.get(k) for k in wanted} != wanted
            if fresh:
                files.delete(spark, marker)
                built = step.build(**needs)
                files.write_table(built, path)
                held = wanted | {"write": uuid.uuid4().hex, "schema": built.schema.json()}
                files.write_text(spark, marker, json.dumps(held))
            writes[step.name] = held["write"]
            frames[step.name] = spark.read.schema(files.schema_of(held["schema"])).parquet(path)
            report(step.name, fresh)
        return frames
