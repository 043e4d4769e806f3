"""Scores of recommended items: by similar users, by content, by popularity and by use together.

Users with the same items are one class, so similarities are of classes and a
user's score comes from its class's sums without its own share: nothing has a
row for each pair of users. Current items are a request's list, bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of (collaborative, content, popularity, context) by strategy.
STRATEGIES = {
    "balanced": (0.35, 0.30, 0.20, 0.15),
    "collaborative": (0.7, 0.2, 0.05, 0.05),
    "content": (0.1, 0.7, 0.1, 0.1),
    "popularity": (0.1, 0.1, 0.7, 0.1),
    "context": (0.1, 0.2, 0.1, 0.6),
}


def strength(views: Column, favourite: Column, used: Column) -> Column:
    """How much a user's dealings with an item count, 1 at most."""
    return F.least(0.1 * views + F.when(favourite, 0.5).otherwise(0.0) + F.when(used, 0.3).otherwise(0.0), F.lit(1.0))


def collaborative(marks: DataFrame, threshold: float = 0.3, at_least: int = 5) -> DataFrame:
    """user, item, score: mean strength of the item with the users whose items are similar (Jaccard), weighted by similarity.

    marks has one row for each user and item: user, item, views, strength.
    Users with fewer than at_least views neither get nor give scores; items
    that no similar user has get no row. Null users or items are left out.
    """
    marks = marks.filter("user is not null and item is not null").select("user", "item", "views", "strength")
    sets = marks.groupBy("user").agg(F.array_sort(F.collect_set("item")).alias("_set"), F.sum("views").alias("_v")).filter(F.col("_v") >= at_least).select("user", "_set")
    marks = marks.join(sets, "user")
    classes = sets.select("_set").distinct()
    mine, theirs = (classes.select(F.col("_set").alias(n), F.explode("_set").alias("item")) for n in ("_mine", "_theirs"))
    met = mine.join(theirs, "item").groupBy("_mine", "_theirs").agg(F.count("*").alias("_c"))
    similar = met.select("_mine", "_theirs", (F.col("_c") / (F.size("_mine") + F.size("_theirs") - F.col("_c"))).alias("_sim")).filter(F.col("_sim") >= threshold)
    sums = marks.groupBy(F.col("_set").alias("_theirs"), "item").agg(F.sum("strength").alias("_s"), F.count("*").alias("_n"))
    totals = similar.join(sums, "_theirs").groupBy(F.col("_mine").alias("_set"), "item").agg(F.sum(F.col("_sim") * F.col("_s")).alias("_num"), F.sum(F.col("_sim") * F.col("_n")).alias("_den"))
    own = marks.select("user", "item", F.col("strength").alias("_own"))
    out = sets.join(totals, "_set").join(own, ["user", "item"], "left")
    num, den = F.col("_num") - F.coalesce("_own", F.lit(0.0)), F.col("_den") - F.when(F.col("_own").isNull(), 0.0).otherwise(1.0)
    # similarities are at least the threshold, so a smaller rest is rounding
    return out.filter(den > threshold / 2).select("user", "item", (num / den).alias("score"))


def content(items: DataFrame, current: DataFrame, id_col: str, weights: dict[str, float], tags: str, tag_weight: float = 0.2) -> DataFrame:
    """items' id and score: greatest similarity to an item of current, a request's short list (broadcast) of the same columns.

    Each column of weights adds its weight where both are equal and neither
    null nor empty; tags (an array) add the share of common ones, in any case
    of letters. The same item has 1; with an empty list every score is 0.5.
    """
    cols = [id_col, *weights, tags]
    pairs = items.select(*cols).crossJoin(F.broadcast(current.select(*[F.col(c).alias(f"_c_{c}") for c in cols])))
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + F.when((F.col(c) == F.col(f"_c_{c}")) & (F.col(c).cast("string") != ""), w).otherwise(0.0)
    lower = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)
    a, b = lower(tags), lower(f"_c_{tags}")
    common = F.size(F.filter(a, lambda t: F.array_contains(b, t)))
    score = score + tag_weight * F.coalesce(F.try_divide(common, F.greatest(F.size(a), F.size(b))), F.lit(0.0))
    same = F.when(F.col(id_col) == F.col(f"_c_{id_col}"), 1.0).otherwise(score / (sum(weights.values()) + tag_weight))
    best = pairs.groupBy(id_col).agg(F.max(same).alias("_s"))
    return items.select(id_col).distinct().join(best, id_col, "left").select(id_col, F.least(F.coalesce("_s", F.lit(0.5)), F.lit(1.0)).alias("score"))


def popularity(events: DataFrame, item: str, ts: str, used: Column, now: Column, decay_days: int = 30) -> DataFrame:
    """item and score of views, uses and views that fade by days, 1 at most."""
    days = (F.unix_micros(now) - F.unix_micros(ts)) / 86400e6
    fading = F.sum(F.when(days < decay_days, F.exp(-days / decay_days)).otherwise(0.0))
    score = 0.3 * F.log10(F.count("*") + 1) / 6 + 0.4 * F.log10(F.count_if(used) + 1) / 4 + 0.3 * fading / 10
    return events.groupBy(F.col(item).alias("item")).agg(F.least(score, F.lit(1.0)).alias("score"))


def co_usage(usage: DataFrame, current: DataFrame, model: str, item: str) -> DataFrame:
    """item and score: of the models that use an item of current (a request's short list), the share that uses this one."""
    usage = usage.select(model, item).distinct()
    using = usage.join(F.broadcast(current.select(item)), item, "left_semi").select(model).distinct()
    total = F.broadcast(using.agg(F.count("*").alias("_total")))  # one row
    counts = usage.join(using, model, "left_semi").groupBy(item).agg(F.count("*").alias("_n"))
    return counts.crossJoin(total).select(item, (F.col("_n") / F.col("_total")).alias("score"))


def final_score(strategy: str, collaborative: Column, content: Column, popularity: Column, context: Column, quality: Column) -> Column:
    """The four scores by the strategy's weights, and a tenth of the quality."""
    return sum((w * s for w, s in zip(STRATEGIES[strategy], (collaborative, content, popularity, context))), 0.1 * quality)
