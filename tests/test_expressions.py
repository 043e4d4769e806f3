import math

import pytest

from quillon.functions import expressions as E


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(10.0, 3.0, 0.0, "Straße", [1.0, 2.0], {"k": 5.0}, None)], "x double, y double, z double, s string, a array<double>, m map<string,double>, n double")


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("2 + 3 * 4", 14),
        ("(2 + 3) * 4", 20),
        ("10 % 3", 1),
        ("x / y", 10 / 3),
        ("-x", -10),
        ("x / z", math.inf),
        ("-x / z", -math.inf),
        ("x > 5 && y < 1 ? 1 : 2", 2),
        ("x > 5 || y < 1 && z > 1", True),
        ("!(x > 5)", False),
        ("len(s)", 7),
        ("substr(s, 1, 3)", "tra"),
        ("a[1]", 2),
        ("a[9]", None),
        ("m[\"k\"]", 5),
        ("coalesce(n, x)", 10),
        ("avg(x, n, y)", 6.5),
        ("avg(n)", 0),
        ("count(x, n)", 1),
        ("min(x, n, y)", 3),
        ("round(0 - 2.5)", -3),
        ("int(0 - 2.7)", -2),
        ("float('no')", 0),
        ("bool('yes')", 1),
        ("zscore(x, 5, 0)", 0),
        ("normalize(x, 3, 3)", 0.5),
        ("clip(x, 0, 4)", 4),
        ("concat(s, '-', 'a')", "Straße-a"),
        ("if(x, 1, 2)", 1),
    ],
)
def test_values(row, text, value):
    got = row.select(E.compiled(text).alias("v")).first().v
    assert got == value if not isinstance(value, float) or math.isinf(value) else got == pytest.approx(value)


def test_softmax(row):
    got = row.select(E.compiled("softmax(1, 2, 3)").alias("v")).first().v
    assert sum(got) == pytest.approx(1) and got[2] == pytest.approx(0.66524096)


@pytest.mark.parametrize("text", ["1 +", "nope(1)", "(1", "1 2", "pow(1)", "a ? 1", "#"])
def test_errors(spark, text):
    with pytest.raises(E.ExpressionError):
        E.compiled(text)


def test_dialects(row):
    assert row.select(E.compiled("x / z", "template").alias("v")).first().v is None
    assert row.select(E.compiled("coalesce($z, $x)", "pushdown").alias("v")).first().v == 10
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        row.select(E.compiled("x / z", "compute").alias("v")).first()


def test_custom(row):
    E.register("twice", lambda c: c * 2)
    assert row.select(E.compiled("twice(x)").alias("v")).first().v == 20
