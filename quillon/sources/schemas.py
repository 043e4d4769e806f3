"""Feature groups: declared types, validation and schema evolution."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import violations

#: Feature types and Spark's.
TYPES = {"int64": "bigint", "float64": "double", "string": "string", "bool": "boolean", "bytes": "binary", "vector": "array<float>", "timestamp": "timestamp"}
#: Spark types that read as a feature type besides its own.
READ_AS = {"int": "int64", "smallint": "int64", "tinyint": "int64", "float": "float64", "date": "timestamp", "timestamp_ntz": "timestamp", "array<double>": "vector"}
WIDER = {("int64", "float64"), ("int64", "string"), ("float64", "string"), ("bool", "string")}


@dataclass
class Group:
    name: str
    entity_type: str
    features: dict[str, str]
    ttl_seconds: int | None = None
    rules: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        self.features = {n: t.lower() for n, t in self.features.items()}
        if unknown := {t for t in self.features.values()} - set(TYPES):
            raise ValueError(f"no types {sorted(unknown)}")

    def conformed(self, df: DataFrame) -> DataFrame:
        """entity, ts and the declared features with their types; missing ones null."""
        cast = lambda n, t: (F.col(n).try_cast(TYPES[t]) if t not in ("bytes", "vector") else F.col(n).cast(TYPES[t])) if n in df.columns else F.lit(None).cast(TYPES[t])
        return df.select("entity", "ts", *[cast(n, t).alias(n) for n, t in self.features.items()])

    def reasons(self) -> Column:
        """Names of the rules that a row breaks."""
        return violations(self.rules)


def feature_type(spark_type: str) -> str:
    """The feature type of a Spark type."""
    for name, own in TYPES.items():
        if spark_type == own:
            return name
    if spark_type.startswith("decimal"):
        return "float64"
    return READ_AS[spark_type]


def inferred(df: DataFrame, name: str, entity_type: str) -> Group:
    return Group(name, entity_type, {c: feature_type(t) for c, t in df.dtypes if c not in ("entity", "ts")})


def incompatible(old: Group, new: Group, mode: str) -> list[str]:
    """What forbids going from old to new: mode none checks nothing; backward lets new readers read old rows, forward old readers new rows, full both."""
    out = []
    if mode in ("backward", "full"):
        out += [f"{n}: {old.features[n]} to {t}" for n, t in new.features.items() if n in old.features and old.features[n] != t and (old.features[n], t) not in WIDER]
    if mode in ("forward", "full"):
        out += [f"{n}: removed" for n in old.features if n not in new.features]
        out += [f"{n}: {t} read as {old.features[n]}" for n, t in new.features.items() if n in old.features and old.features[n] != t and (t, old.features[n]) not in WIDER]
    return out
