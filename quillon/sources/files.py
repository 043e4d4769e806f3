"""File and object sources and sinks: CSV, JSON, JSON lines, Parquet, ORC, binary; feature imports and partitioned exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups

FORMATS = ("csv", "json", "jsonl", "parquet", "orc")


def sniffed(c: Column) -> Column:
    """A text cell as struct<int64, float64, bool, vector, text>: the first type that it reads as, the others null."""
    t = F.trim(c)
    i, f = t.try_cast("long"), t.try_cast("double")
    b = F.when(F.lower(t).isin("true", "false"), F.lower(t) == "true")
    v = F.when(t.rlike(r"^\[.*\]$"), F.from_json(t, "array<float>"))
    rest = i.isNull() & f.isNull() & b.isNull() & v.isNull()
    return F.struct(i.alias("int64"), F.when(i.isNull(), f).alias("float64"), b.alias("bool"), v.alias("vector"), F.when(rest, c).alias("text"))


def read(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    """Rows of files; without a schema CSV columns are text and JSON is inferred."""
    if fmt not in FORMATS:
        raise ValueError(f"no format {fmt!r}")
    r = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        return r.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if fmt == "json":
        return r.option("multiLine", True).json(path)
    return r.json(path) if fmt == "jsonl" else r.format(fmt).load(path)


def features_of(rows: DataFrame, entity: str, ts: str | None, at: Column) -> DataFrame:
    """A wide import as a history (entity, feature, value as text, ts): all other columns are features; rows without an instant get at."""
    names = [c for c in rows.columns if c not in (entity, ts)]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").cast("string").alias("value")) for n in names]))
    when = F.coalesce(F.col(ts).try_cast("timestamp"), at) if ts else at
    out = rows.select(F.col(entity).cast("string").alias("entity"), when.alias("ts"), pairs.alias("p"))
    return out.select("entity", "p.feature", "p.value", "ts").filter("value is not null")


def rejected(rows: DataFrame, entity: str) -> DataFrame:
    """Rows whose entity key breaks the rules: empty, above 512 bytes, control characters, or ../ inside."""
    k = F.col(entity).cast("string")
    bad = k.isNull() | (k == "") | (F.octet_length(k) > 512) | k.rlike(r"[\x00-\x1f\x7f]") | k.contains("../")
    return rows.filter(bad)


def write(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"no format {fmt!r}")
    w = df.write.mode(mode)
    w = w.partitionBy(*partition_by) if partition_by else w
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt in ("json", "jsonl"):
        w.json(path)
    else:
        w.format(fmt).save(path)


def export_partitioned(history: DataFrame, path: str, entity_type: str, mode: str = "append") -> None:
    """Parquet in entity_type= and date= folders, sorted inside so that row groups can be skipped."""
    rows = history.withColumn("entity_type", F.lit(entity_type)).withColumn("date", F.to_date("ts"))
    # one writer a date and a slice of its entities: neither many small files nor one task for a date
    spread = rows.repartition("date", F.pmod(F.xxhash64("entity"), F.lit(8))).sortWithinPartitions("date", "entity", "ts")
    write(spread, path, "parquet", mode, ["entity_type", "date"])


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of two histories with the newer value of each entity and feature."""
    return lookups.latest(existing.unionByName(incoming))


def blobs(spark: SparkSession, path: str, start: int | None = None, length: int | None = None) -> DataFrame:
    """path, content and length of objects; with start and length that range of their bytes."""
    out = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    if start is not None:
        out = out.withColumn("content", F.substring("content", start + 1, length if length is not None else 2**31 - 1))
    return out


def warehouse_query(table: str, entity: str, ts: str, columns: list[str], limit: int | None = None, quote: str = '"') -> str:
    """SELECT of an import, with quoted identifiers; it takes no conditions, so none can be smuggled in."""
    q = lambda n: quote + n.replace(quote, 2 * quote) + quote
    sql = f"SELECT {', '.join(map(q, [entity, ts, *columns]))} FROM {'.'.join(map(q, table.split('.')))}"
    return sql if limit is None else f"{sql} LIMIT {int(limit)}"


def warehouse(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a query over JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def warehouse_write(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
