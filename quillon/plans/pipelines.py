"""Declared pipelines: sources, transforms, windows, joins, filters, aggregations and sinks as one plan.

A spec is a list of steps (name, kind, inputs, options); it is checked for
cycles and unknown inputs, ordered, and built into DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import compiled
from ..operators import windows
from ..operators.graphs import levels


@dataclass
class Step:
    name: str
    kind: str
    inputs: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)


def ordered(steps: list[Step]) -> list[Step]:
    """Steps after all their inputs; ValueError on a cycle or an unknown input."""
    by = {s.name: s for s in steps}
    if len(by) < len(steps):
        raise ValueError("two steps have one name")
    if unknown := {i for s in steps for i in s.inputs} - set(by):
        raise ValueError(f"no step {sorted(unknown)}")
    return [by[n] for level in levels({s.name: s.inputs for s in steps}) for n in level]


def built(steps: list[Step], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A DataFrame for each step, batch or streaming like its sources."""
    out: dict[str, DataFrame] = {}
    for s in ordered(steps):
        ins, o = [out[i] for i in s.inputs], s.options
        if s.kind == "source":
            out[s.name] = tables[o["table"]]
        elif s.kind == "transform":
            out[s.name] = ins[0].withColumns({n: compiled(e, "template") for n, e in o["columns"].items()})
        elif s.kind == "filter":
            out[s.name] = ins[0].filter(compiled(o["where"], "template"))
        elif s.kind == "join":
            out[s.name] = ins[0].join(ins[1], o["on"], o.get("how", "inner"))
        elif s.kind == "window":
            aggs = {n: windows.aggregate(f, c) for n, (f, c) in o["aggregates"].items()}
            make = {"tumbling": windows.tumbling, "session": windows.session}.get(o["type"])
            out[s.name] = make(ins[0], o["size"], o["keys"], aggs, o.get("ts", "ts")) if make else windows.sliding(ins[0], o["size"], o["slide"], o["keys"], aggs, o.get("ts", "ts"))
        elif s.kind == "aggregate":
            out[s.name] = ins[0].groupBy(*o["keys"]).agg(*[windows.aggregate(f, c).alias(n) for n, (f, c) in o["aggregates"].items()])
        elif s.kind == "sink":
            out[s.name] = ins[0].select(*o.get("columns", ["*"])) if not o.get("rename") else ins[0].select(*[F.col(a).alias(b) for a, b in o["rename"].items()])
        else:
            raise ValueError(f"no kind {s.kind!r}")
    return out
