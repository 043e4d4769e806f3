"""Statistics for drift, quality and experiments, as DataFrame operations.

Every comparison takes two DataFrames with one column named by the argument
(reference and current) and returns one row. Sums run over grouped counts, so
nothing larger than the distinct values is sorted, and histograms stay small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def _place(value: Column, bounds: list[float]) -> Column:
    """The number of bounds that are at most the value, by halving."""

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < bounds[mid], half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(bounds))


def _running(counts: DataFrame, *names: str) -> DataFrame:
    """counts (v and numbers) with each number's running sum over v (cum_) and total (all_).

    Sums run in ranges of values between approximate quantiles, so that the
    ranges are even whatever the values' spread; each starts from the totals of
    those before it, and no task sorts everything.
    """
    bounds = sorted(set(counts.select(F.col("v").cast("double")).approxQuantile("v", [k / RANGES for k in range(1, RANGES)], 1 / (4 * RANGES))))
    parts = counts.withColumn("p", _place(F.col("v").cast("double"), bounds))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("p").agg(*[F.sum(n).alias(n) for n in names])
    offsets = F.broadcast(sums.select("p", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before_{n}") for n in names], *[F.sum(n).over(Window.partitionBy()).alias(f"all_{n}") for n in names]))  # a row for each range
    w = Window.partitionBy("p").orderBy("v")
    steps = parts.select("p", "v", *names, *[F.sum(n).over(w).alias(f"in_{n}") for n in names]).join(offsets, "p")
    return steps.select("v", *names, *[(F.col(f"before_{n}") + F.col(f"in_{n}")).alias(f"cum_{n}") for n in names], *[f"all_{n}" for n in names])


def ks(reference: DataFrame, current: DataFrame, field: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic: greatest distance of the empirical distributions; equal values step together."""
    tagged = reference.select(F.col(field).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(current.select(F.col(field).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = tagged.filter("v is not null").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = lambda n: F.try_divide(F.col(f"cum_{n}"), F.col(f"all_{n}"))
    return _running(counts, "a", "b").agg(F.max(F.abs(share("a") - share("b"))).alias("ks"))


def quantiles(df: DataFrame, field: str, shares: dict[str, float]) -> DataFrame:
    """One row with the exact percentiles of these names, interpolated between neighbours; null without values."""
    counts = df.select(F.col(field).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    steps = _running(counts, "n")
    at = {name: (F.col("all_n") - 1) * share for name, share in shares.items()}
    value = lambda place: F.max(F.when((F.col("cum_n") > place) & (F.col("cum_n") - F.col("n") <= place), F.col("v")))
    got = steps.agg(*[c.alias(f"{name}_{side}") for name, x in at.items() for side, c in (("lo", value(F.floor(x))), ("hi", value(F.ceil(x))), ("part", F.max(x - F.floor(x))))])
    return got.select(*[(F.col(f"{n}_lo") * (1 - F.col(f"{n}_part")) + F.col(f"{n}_hi") * F.col(f"{n}_part")).alias(n) for n in shares])


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of the statistic."""
    e = F.sqrt(n * m / (n + m))
    x = (e + 0.12 + 0.11 / e) * d
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def _bins(reference: DataFrame, current: DataFrame, field: str, bins: int) -> DataFrame:
    """bin, r and c (counts of both sides) over equal-width bins of their joint range, empty ones included."""
    both = reference.select(F.col(field).alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(current.select(F.col(field).alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c"))).filter("v is not null")
    bounds = F.broadcast(both.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # one row
    bin_ = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1))
    counts = both.crossJoin(bounds).groupBy(bin_.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    spine = reference.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"))


def psi(reference: DataFrame, current: DataFrame, field: str, bins: int = 10, epsilon: float = 1e-4) -> DataFrame:
    """Population stability index over equal-width bins; epsilon is added to each share."""
    t = _bins(reference, current, field, bins)
    e, a = F.col("r") / F.sum("r").over(Window.partitionBy()) + epsilon, F.col("c") / F.sum("c").over(Window.partitionBy()) + epsilon
    return t.select(((a - e) * F.ln(a / e)).alias("t")).agg(F.sum("t").alias("psi"))


def psi_smoothed(reference: DataFrame, current: DataFrame, field: str, bins: int = 20, add: float = 0.5) -> DataFrame:
    """The same with counts raised by a constant."""
    t = _bins(reference, current, field, bins)
    e = (F.col("r") + add) / (F.sum("r").over(Window.partitionBy()) + add * bins)
    a = (F.col("c") + add) / (F.sum("c").over(Window.partitionBy()) + add * bins)
    return t.select(((a - e) * F.ln(a / e)).alias("t")).agg(F.sum("t").alias("psi"))


def _categories(reference: DataFrame, current: DataFrame, field: str) -> DataFrame:
    r, c = (df.groupBy(F.col(field).alias("k")).agg(F.count("*").alias(n)) for df, n in ((reference, "r"), (current, "c")))
    return r.join(c, "k", "full").select("k", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"))


def psi_categorical(reference: DataFrame, current: DataFrame, field: str, epsilon: float = 1e-4) -> DataFrame:
    """Stability index over categories; epsilon is added to each count."""
    t = _categories(reference, current, field)
    e, a = (F.col("r") + epsilon) / F.sum("r").over(Window.partitionBy()), (F.col("c") + epsilon) / F.sum("c").over(Window.partitionBy())
    return t.select(((a - e) * F.ln(a / e)).alias("t")).agg(F.sum("t").alias("psi"))


def divergences(reference: DataFrame, current: DataFrame, field: str, bins: int = 10, floor: float = 1e-10) -> DataFrame:
    """kl (Kullback-Leibler of reference from current) and js (Jensen-Shannon), natural logarithms, shares floored."""
    t = _bins(reference, current, field, bins)
    p, q = F.greatest(F.col("r") / F.sum("r").over(Window.partitionBy()), F.lit(floor)), F.greatest(F.col("c") / F.sum("c").over(Window.partitionBy()), F.lit(floor))
    t = t.select(p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda a, b: F.col(a) * F.ln(F.col(a) / F.col(b))
    return t.agg(F.sum(term("p", "q")).alias("kl"), (F.sum(term("p", "m")) / 2 + F.sum(term("q", "m")) / 2).alias("js"))


#: Thresholds of the tests that a suite runs.
THRESHOLDS = {"ks": 0.05, "psi": 0.2, "chi_squared": 0.05, "jensen_shannon": 0.1}


def suite(reference: DataFrame, current: DataFrame, field: str, thresholds: dict[str, float] = THRESHOLDS, bins: int = 10) -> DataFrame:
    """test, statistic, threshold, passed of every test named in thresholds, on one pass over shared bins; an empty side has statistics of 0."""
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(Window.partitionBy()))
    t = _bins(reference, current, field, bins).select(share("r").alias("r"), share("c").alias("c"))
    a, e = F.greatest("c", F.lit(1e-4)), F.greatest("r", F.lit(1e-4))
    p, q = F.greatest("c", F.lit(1e-10)), F.greatest("r", F.lit(1e-10))
    m = (p + q) / 2
    psi_, chi, js = (a - e) * F.ln(a / e), F.pow(F.col("c") - e, 2) / e, (p * F.ln(p / m) + q * F.ln(q / m)) / 2
    both = F.col("r").isNotNull() & F.col("c").isNotNull()
    found = t.agg(*[F.sum(F.when(both, x)).alias(n) for n, x in (("psi", psi_), ("chi_squared", chi), ("jensen_shannon", js))]).crossJoin(ks(reference, current, field))
    tests = F.explode(F.array(*[F.struct(F.lit(n).alias("test"), F.coalesce(F.col(n), F.lit(0.0)).alias("statistic"), F.lit(float(x)).alias("threshold")) for n, x in thresholds.items()]))
    return found.select(tests.alias("t")).select("t.*", (F.col("t.statistic") <= F.col("t.threshold")).alias("passed"))


def snapshot(df: DataFrame, field: str, bins: int = 10) -> DataFrame:
    """One row: count, mean, variance, skewness, kurtosis (excess), min, max, p50, p90, p95, p99 and histogram (shares of equal-width bins); without values count 0 and nulls."""
    values = df.filter(F.col(field).isNotNull())
    flat = lambda c: F.when(F.var_pop(field) > 0, c).otherwise(0.0)
    out = values.agg(F.count(field).alias("count"), F.avg(field).alias("mean"), F.var_pop(field).alias("variance"), flat(F.skewness(field)).alias("skewness"), flat(F.kurtosis(field)).alias("kurtosis"), F.min(field).alias("min"), F.max(field).alias("max"))
    hist = _bins(values, values.limit(0), field, bins).select("bin", F.try_divide(F.col("r"), F.sum("r").over(Window.partitionBy())).alias("share"))
    hist = hist.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "share"))), lambda x: x["share"]).alias("histogram"))  # bins values
    return out.crossJoin(quantiles(values, field, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})).crossJoin(hist)


def chi_squared(reference: DataFrame, current: DataFrame, field: str, floor: float = 1e-4) -> DataFrame:
    """Statistic of the current categories against the reference's, scaled to the same total."""
    t = _categories(reference, current, field)
    expected = F.greatest(F.col("r") * F.sum("c").over(Window.partitionBy()) / F.sum("r").over(Window.partitionBy()), F.lit(floor))
    return t.select((F.pow(F.col("c") - expected, 2) / expected).alias("t")).agg(F.sum("t").alias("chi2"))


def drift(reference: DataFrame, current: DataFrame, field: str, ks_threshold: float = 0.1, shift: float = 3.0) -> DataFrame:
    """ks, mean_shift (in standard deviations of the reference) and verdict: distribution, mean or none."""
    stats = reference.agg(F.avg(field).alias("mr"), F.stddev_pop(field).alias("sr")).crossJoin(current.agg(F.avg(field).alias("mc")))
    out = ks(reference, current, field).crossJoin(stats).withColumn("mean_shift", F.try_divide(F.abs(F.col("mc") - F.col("mr")), F.col("sr")))
    verdict = F.when(F.col("ks") > ks_threshold, "distribution").when(F.col("mean_shift") > shift, "mean").otherwise("none")
    return out.select("ks", "mean_shift", verdict.alias("verdict"))


def nearest_rank(df: DataFrame, keys: list[str], field: str, share: float) -> DataFrame:
    """keys and value: the one at index int(n * share) of each key's sorted values, the last if beyond; keys without values get no row.

    Rows are ranked by a sort that spills, not held in an array.
    """
    w = Window.partitionBy(*keys)
    ranked = df.filter(F.col(field).isNotNull()).select(*keys, F.col(field).alias("value"), F.row_number().over(w.orderBy(field)).alias("_at"), F.count(field).over(w).alias("_n"))
    return ranked.filter(F.col("_at") == F.least(F.floor(F.col("_n") * share) + 1, "_n")).select(*keys, "value")


def rolling_anomalies(df: DataFrame, key: str, order: list[str], field: str, n: int, learn: int, sigmas: float = 3.0) -> DataFrame:
    """df with anomaly: a z-score over the n rows before (zscore) or outside the interquartile fence (iqr), after a learning period."""
    past = Window.partitionBy(key).orderBy(*order).rowsBetween(-n, -1)
    seen = F.count(field).over(past)
    m, s = F.avg(field).over(past), F.stddev_pop(field).over(past)
    q1, q3 = (F.percentile(field, F.lit(p)).over(past) for p in (0.25, 0.75))
    z = (s > 0) & (F.abs(F.col(field) - m) > sigmas * s)
    fence = (F.col(field) < q1 - 1.5 * (q3 - q1)) | (F.col(field) > q3 + 1.5 * (q3 - q1))
    return df.withColumn("anomaly", F.when(seen < learn, "learning").when(z, "zscore").when(fence, "iqr").otherwise("normal"))


def profile(df: DataFrame, field: str) -> DataFrame:
    """One row: n, missing, distinct share, mean, deviation, skewness, excess kurtosis, class of the distribution."""
    out = df.agg(F.count("*").alias("n"), F.count_if(F.col(field).isNull()).alias("missing"), F.count_distinct(field).alias("uniq"), F.avg(field).alias("mean"), F.stddev_pop(field).alias("sd"), F.skewness(field).alias("skew"), F.kurtosis(field).alias("kurt"))
    kind = F.when(F.abs("skew") < 0.5, F.when(F.col("kurt") < -1, "uniform").otherwise("symmetric")).when(F.col("skew") > 0, "right_skewed").otherwise("left_skewed")
    return out.withColumn("uniqueness", F.col("uniq") / F.col("n")).withColumn("shape", kind).drop("uniq")


def experiment(df: DataFrame, variant: str, field: str, control: str) -> DataFrame:
    """Each variant's n, mean, deviation (sample), lift over control in %, z and the 95 % interval of the difference."""
    g = df.groupBy(variant).agg(F.count(field).alias("n"), F.avg(field).alias("mean"), F.stddev_samp(field).alias("sd"))
    c = F.broadcast(g.filter(F.col(variant) == control).select(F.col("n").alias("cn"), F.col("mean").alias("cm"), F.col("sd").alias("cs")))
    se = F.sqrt(F.col("sd") * F.col("sd") / F.col("n") + F.col("cs") * F.col("cs") / F.col("cn"))
    d = F.col("mean") - F.col("cm")
    out = g.filter(F.col(variant) != control).crossJoin(c)
    return out.select(variant, "n", "mean", "sd", (100 * d / F.col("cm")).alias("lift"), (d / se).alias("z"), (d - 1.96 * se).alias("lo"), (d + 1.96 * se).alias("hi"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by a published rational approximation of erf, within 1.5e-7."""
    a = F.abs(x) / (2**0.5)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-a * a)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def laplace(scale: float, seed: int) -> Column:
    """Laplace noise for each row."""
    u = F.rand(seed) - 0.5
    return -scale * F.signum(u) * F.ln(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def private_count(df: DataFrame, epsilon: float, seed: int) -> DataFrame:
    """Count with Laplace noise for one person's row."""
    return df.agg(F.count("*").alias("n")).select((F.col("n") + laplace(1 / epsilon, seed)).alias("n"))


def private_sum(df: DataFrame, field: str, low: float, high: float, epsilon: float, seed: int) -> DataFrame:
    """Sum of clipped values with Laplace noise."""
    clipped = F.least(F.greatest(F.col(field), F.lit(low)), F.lit(high))
    return df.agg(F.sum(clipped).alias("s")).select((F.col("s") + laplace(max(abs(low), abs(high)) / epsilon, seed)).alias("s"))


def gaussian_scale(sensitivity: float, epsilon: float, delta: float) -> float:
    """Deviation of the Gaussian noise that keeps (epsilon, delta)."""
    import math

    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def private_mean(df: DataFrame, field: str, low: float, high: float, epsilon: float, seed: int, delta: float | None = None) -> DataFrame:
    """Mean of clipped values: half of epsilon for the noisy sum, half for the noisy count; Gaussian noise where delta is given."""
    clipped = F.least(F.greatest(F.col(field), F.lit(low)), F.lit(high))
    reach, half = max(abs(low), abs(high)), epsilon / 2
    noise = (lambda s, k: gaussian_scale(s, half, delta / 2) * F.randn(seed + k)) if delta else (lambda s, k: laplace(s / half, seed + k))
    out = df.agg(F.sum(clipped).alias("s"), F.count(field).alias("n")).select((F.col("s") + noise(reach, 0)).alias("s"), F.greatest(F.col("n") + noise(1.0, 1), F.lit(1.0)).alias("n"))
    return out.select(F.least(F.greatest(F.col("s") / F.col("n"), F.lit(low)), F.lit(high)).alias("mean"))


def private_extreme(df: DataFrame, field: str, low: float, high: float, epsilon: float, seed: int, largest: bool = True) -> DataFrame:
    """Greatest or least clipped value with Laplace noise for the whole range, clipped again."""
    clipped = F.least(F.greatest(F.col(field), F.lit(low)), F.lit(high))
    out = df.agg((F.max if largest else F.min)(clipped).alias("v"))
    return out.select(F.least(F.greatest(F.col("v") + laplace((high - low) / epsilon, seed), F.lit(low)), F.lit(high)).alias("value"))


def budgeted(requests: DataFrame, who: str, order: list[str], epsilon: str, total: float) -> DataFrame:
    """requests with spent (the epsilons asked for so far, which add up) and allowed: whether they keep within the total."""
    spent = F.sum(epsilon).over(Window.partitionBy(who).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("spent", F.round(spent, 9)).withColumn("allowed", F.col("spent") <= total)


def randomized_response(truth: Column, epsilon: float, seed: int) -> Column:
    """The true answer with probability e**epsilon / (1 + e**epsilon), else the other."""
    import math

    keep = math.exp(epsilon) / (1 + math.exp(epsilon))
    return F.when(F.rand(seed) < keep, truth).otherwise(~truth)


def isolation_scores(df: DataFrame, field: str, id_col: str, trees: int = 50, sample: int = 256, seed: int = 1) -> DataFrame:
    """df with score: 1-D isolation forest, 2 ** (-mean depth / c(sample)). The forest is a bounded sample's, drawn by a hash of the rows' ids, so that it follows the distribution; scoring runs over all rows in Arrow batches."""
    picked = df.filter(F.col(field).isNotNull()).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col, field).limit(sample * 4).select(F.col(field).cast("double")).toPandas()[field].to_numpy()
    rng = np.random.default_rng(seed)

    def grow(values: np.ndarray, depth: int, most: int):
        if depth >= most or len(values) <= 1 or values.min() == values.max():
            return (depth + average_depth(len(values)),)
        cut = rng.uniform(values.min(), values.max())
        return (cut, grow(values[values < cut], depth + 1, most), grow(values[values >= cut], depth + 1, most))

    def average_depth(n: int) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    n = min(sample, len(picked))
    forest = [grow(rng.choice(picked, n, replace=False), 0, int(np.ceil(np.log2(max(n, 2))))) for _ in range(trees)] if n else []
    norm = average_depth(n) or 1.0

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = v.to_numpy()
        total = np.zeros(len(x))
        for tree in forest:
            stack = [(tree, np.arange(len(x)))]
            while stack:
                node, at = stack.pop()
                if len(node) == 1:
                    total[at] += node[0]
                else:
                    low = x[at] < node[0]
                    stack += [(node[1], at[low]), (node[2], at[~low])]
        return pd.Series(2.0 ** (-total / max(len(forest), 1) / norm))

    return df.withColumn("score", score(F.col(field).cast("double")))
