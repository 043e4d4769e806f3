"""User functions: decorators that register Column functions, pandas UDFs and grouped aggregates, by kind and version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import register
from .scalars import variant

KINDS = ("column", "transform", "aggregate", "filter")


@dataclass
class Entry:
    name: str
    kind: str
    build: Callable
    version: int
    inputs: list[str] = field(default_factory=list)


class Registry:
    def __init__(self):
        self.entries: dict[str, list[Entry]] = {}

    def add(self, name: str, kind: str, build: Callable, inputs: list[str] | None = None) -> Entry:
        if kind not in KINDS:
            raise ValueError(f"no kind {kind!r}")
        versions = self.entries.setdefault(name, [])
        versions.append(Entry(name, kind, build, len(versions) + 1, inputs or []))
        return versions[-1]

    def get(self, name: str, version: int | None = None) -> Entry:
        return self.entries[name][-1 if version is None else version - 1]

    def routed(self, name: str, key: Column, shares: dict[int, float]) -> Column:
        """The function's versions by shares of the keys, each key always by the same one."""
        chosen = variant(key, name, [(str(v), s) for v, s in shares.items()])
        call = lambda v: self.get(name, v).build(*[F.col(c) for c in self.get(name, v).inputs])
        out = None
        for v in shares:
            out = F.when(chosen == str(v), call(v)) if out is None else out.when(chosen == str(v), call(v))
        return out

    def on_demand(self, *inputs: str) -> Callable:
        """Decorator of a Column function; it can be used in expressions as well."""

        def wrap(f: Callable[..., Column]) -> Callable[..., Column]:
            self.add(f.__name__, "column", f, list(inputs))
            register(f.__name__, f)
            return f

        return wrap

    def transform(self, returns: str, *inputs: str) -> Callable:
        """Decorator of a function of pandas Series, run in Arrow batches."""

        def wrap(f: Callable) -> Callable:
            udf = F.pandas_udf(f, returns)
            self.add(f.__name__, "transform", udf, list(inputs))
            return f

        return wrap

    def aggregate(self, returns: str, *inputs: str) -> Callable:
        """Decorator of a function of a group's pandas Series to one value."""

        def wrap(f: Callable) -> Callable:
            self.add(f.__name__, "aggregate", F.pandas_udf(f, returns), list(inputs))
            return f

        return wrap

    def applied(self, df: DataFrame, *names: str) -> DataFrame:
        """df with a column for each named function of one row."""
        out = {}
        for n in names:
            e = self.get(n)
            if e.kind == "aggregate":
                raise ValueError(f"{n} is an aggregate")
            out[n] = e.build(*[F.col(c) for c in e.inputs])
        return df.withColumns(out)

    def aggregated(self, df: DataFrame, keys: list[str], *names: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[self.get(n).build(*[F.col(c) for c in self.get(n).inputs]).alias(n) for n in names])
