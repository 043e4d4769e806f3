"""Rounding and number formats at halves, where binary and decimal rounding part."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import quillon.queries  # noqa: F401
from quillon.functions import scalars
from quillon.registry import ORACLES, QUERIES


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


def test_rounded_is_the_round_of_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    cents = rng.integers(100, 10_000_000, 20_000) / 100
    values = [*(cents / 32).tolist(), *(-cents / 32).tolist(), *(rng.normal(0, 1, 2000) * 10.0 ** rng.integers(-12, 20, 2000)).tolist(), 0.49999999999999994e-6, 1e305, math.inf, -math.inf, math.nan, None]
    pq.write_table(pa.table({"i": range(len(values)), "v": pa.array(values, pa.float64())}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = [tuple(r) for r in df.orderBy("i").select(*[scalars.rounded(F.col("v"), d) for d in (0, 4, 6)]).collect()]
    want = duckdb.sql(f"select round(v, 0), round(v, 4), round(v, 6) from '{tmp_path}/v.parquet' order by i").fetchall()
    assert [(v, g, w) for v, g, w in zip(values, got, want, strict=True) if not all(map(same, g, w))] == []


def test_operators_at_halves_and_odd_values(spark, tmp_path):
    """68704.73 / 32 has a 5 in its seventh digit; modulo and negation are not rounded."""
    quantity, price, tax = [32.0, 32.0, 1.123456789, 0.0, None, 5.0], [68704.73, 66375.93, 10.0, 5.0, 1.0, 2.0], [0.07, 0.0, 0.03, 0.0, 0.01, None]
    n = len(tax)
    pq.write_table(pa.table({"l_orderkey": range(n), "l_linenumber": [1] * n, "l_quantity": quantity, "l_extendedprice": price, "l_tax": tax}), tmp_path / "lineitem.parquet")
    got = [tuple(r) for r in QUERIES["op_F10_operators"](spark, str(tmp_path)).orderBy("l_orderkey").collect()]
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = con.execute(ORACLES["op_F10_operators"] + " ORDER BY 1").fetchall()
    assert got == want and got[0][4] == 2147.022812


def test_snapshot_at_halves(spark, tmp_path):
    """Shares of 128 rows have a 5 in their seventh digit; least and greatest values are not rounded."""
    lo = 0.123456789
    counts = [53, 31, 17, 11, 7, 4, 2, 1, 1, 1]
    values = [lo + i + 0.5 * (j > 0) for i, n in enumerate(counts) for j in range(n)]
    values[-1] = lo + 10
    assert len(values) == 128
    pq.write_table(pa.table({"value": values}), tmp_path / "events.parquet")
    row = QUERIES["op_M33_snapshot"](spark, str(tmp_path)).first()
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    cur = con.execute(ORACLES["op_M33_snapshot"])
    want = dict(zip([d[0] for d in cur.description], cur.fetchone(), strict=True))
    assert row.asDict() == want
    assert row["histogram"].endswith("0.007812 0.007812 0.007812") and row["min"] == lo
