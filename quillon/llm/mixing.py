"""Mixing sources to target weights, in DataFrame functions only.

Each source's words are laid end to end in a fixed order and packed into blocks
of a fixed number of words. A source's target is its weight's share of the
mix, at most twice its size. The mix is written in output shards of SHARD_SLOTS
slots: each slot of a shard draws its source by the targets' shares, so the
counts of the sources in a shard are multinomial. A source takes no more slots
than its target needs; what the draws have left over of the targets goes to the
last shards, which so correct the mix to the targets. A source's slots are
numbered through all shards, sent through its pseudorandom permutation of block
indices, one permutation for each pass over the source, and joined with the
blocks by index. The slot that would pass the target takes only the start of its
block, so each source gives its target to the word, whatever has been drawn; the
draw decides in which shard each block stands.

Positions inside a source come from two levels of running sums over about
sqrt(n) buckets of documents each, and of a source's slots before a shard from
runs of RUN shards, so no task holds a whole source. Only the sources' table (one
row for each source) is ranked in one task.

Defined results: a null or empty text has size 0 and gives nothing; null is a
source of its own, last in order; rows with equal ids are separate documents;
an empty table gives an empty result. Columns other than id, text and source
are not read. The same rows and seed give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, packed, unpacked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK = 256
SHARD_SLOTS = 4096
ROUNDS = 24
SEED = 20240117
#: Shards whose running sums are taken together.
RUN = 1024
#: Places of the draw that are looked up together.
CELL = 256


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """_id, _source, size (words of the whole text) and _h, a hash of the text that orders equal ids."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_h"))


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: _source, _src (its number), source_size, target.

    The fixed point of resharing: with caps of twice the size, sources in
    order of cap by weight are capped as long as the level that the rest of
    the mix gives them is above their cap.
    """
    cap, all_rows = F.col("_cap"), Window.partitionBy(F.lit(0))
    by_source = all_rows.orderBy(F.col("_source").asc_nulls_last())
    by_cap = all_rows.orderBy(F.col("_cap") / F.col("_weight"), "_src")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("_src") - 1) % len(WEIGHTS) + 1).cast("int"))
    out = sized.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumn("_src", F.row_number().over(by_source)).withColumn("_weight", weight)
    out = out.withColumn("_cap", F.col("source_size") * MOST_PASSES).withColumn("_total", F.sum("source_size").over(all_rows) * F.lit(SHARE))
    left = F.col("_total") - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum("_weight").over(all_rows) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    out = out.withColumn("_level", left / weights).withColumn("_capped", cap <= F.col("_level") * F.col("_weight")).withColumn("_order", F.row_number().over(by_cap))
    level = F.min(F.when(~F.col("_capped"), F.struct("_order", "_level"))).over(all_rows).getField("_level")
    return out.withColumn("target", F.when(F.col("_capped"), cap.cast("double")).otherwise(level * F.col("_weight"))).select("_source", "_src", "source_size", "target")


def _key(at: Column, src: Column, run: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), F.lit("round"), src, run, at), n)


def permuted(x: Column, src: Column, run: Column, n: Column, inverse: bool = False) -> Column:
    """Where a permutation of 0 .. n-1, drawn for src and run, sends x: swap-or-not rounds, each its own inverse."""

    def swap(y: Column, at: Column) -> Column:
        # one struct holds the partner, so that it is written once in each round
        partner = F.transform(F.array(F.pmod(_key(at, src, run, n) + n - y, n)), lambda z: F.when(F.xxhash64(F.lit(SEED), src, run, at, F.greatest(y, z)) % 2 == 0, z).otherwise(y))
        return F.element_at(partner, 1)

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(F.reverse(rounds) if inverse else rounds, x.cast("long"), swap)


def drawn(needs: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, _src, _slot for needs (_src, _n slots): the sources that each shard's slots draw, and the rest of the needs in the last shards."""
    spark = needs.sparkSession
    # a few small rows become many: their number is spread over a set number of tasks, as their size tells Spark nothing
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = needs.agg(F.sum("_n")).first()[0] or 0
    n_shards = max(total // shard_slots, 1)
    ahead = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_src")) - F.col("_n")
    # a slot draws a place among all that is needed, and the source that stands there; both meet in cells of CELL places
    bounds = needs.select("_src", ahead.alias("_low"), (ahead + F.col("_n")).alias("_high"))
    cells = bounds.select("*", F.explode(F.sequence(F.expr(f"_low div {CELL * CELL}"), F.expr(f"(_high - 1) div {CELL * CELL}"))).alias("_run")).repartition(spread, "_src", "_run")
    begin, end = F.greatest(F.expr(f"_low div {CELL}"), F.col("_run") * CELL), F.least(F.expr(f"(_high - 1) div {CELL}"), (F.col("_run") + 1) * CELL - 1)
    cells = cells.select("_src", "_low", "_high", F.explode(F.sequence(begin, end)).alias("_cell"))
    draws = spark.range(0, min(n_shards * shard_slots, total), 1, spread).select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED), F.lit("slot"), "id"), F.lit(max(total, 1))).alias("_place"))
    one = draws.withColumn("_cell", F.expr(f"_place div {CELL}")).join(cells.hint("merge"), "_cell").filter("_low <= _place and _place < _high")
    counts = checkpointed(one.groupBy("_src", "shard").agg(F.count("*").alias("_m")))
    # a source's slots before each shard: of earlier runs of shards, and of its own run
    counts = counts.withColumn("_run", F.expr(f"shard div {RUN}"))
    runs = counts.groupBy("_src", "_run").agg(F.sum("_m").alias("_sum"))
    earlier = runs.withColumn("_base", F.sum("_sum").over(Window.partitionBy("_src").orderBy("_run")) - F.col("_sum")).drop("_sum")
    within = F.sum("_m").over(Window.partitionBy("_src", "_run").orderBy("shard")) - F.col("_m")
    counts = counts.withColumn("_first", within).join(earlier, ["_src", "_run"]).withColumn("_first", F.col("_first") + F.col("_base"))
    taken = counts.join(needs, "_src").filter("_first < _n").select("_src", "shard", "_first", F.least(F.col("_first") + F.col("_m"), "_n").alias("_end"))
    # what is left of each source, in runs of a shard's length, after the drawn shards
    zero = F.lit(0).cast("long")
    left = needs.join(runs.groupBy("_src").agg(F.sum("_sum").alias("_drawn")), "_src", "left").withColumn("_drawn", F.coalesce("_drawn", zero)).filter("_drawn < _n").withColumn("_rest", F.col("_n") - F.col("_drawn"))
    left = left.withColumn("_from", F.sum("_rest").over(Window.partitionBy(F.lit(0)).orderBy("_src")) - F.col("_rest"))
    left = left.select("*", F.explode(F.sequence(F.expr(f"_from div {shard_slots}"), F.expr(f"(_from + _rest - 1) div {shard_slots}"))).alias("_s"))
    begin, end = F.greatest(F.col("_s") * shard_slots - F.col("_from"), zero), F.least((F.col("_s") + 1) * shard_slots - F.col("_from"), F.col("_rest"))
    left = left.select("_src", (F.col("_s") + n_shards).alias("shard"), (F.col("_drawn") + begin).alias("_first"), (F.col("_drawn") + end).alias("_end"))
    return taken.unionByName(left).repartition(spread, "_src", "shard").select("_src", "shard", F.explode(F.sequence(F.col("_first"), F.col("_end") - 1)).alias("_slot"))


def slots(goals: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix in blocks: shard, _src, _slot, _pass, _block, _take (words taken from the block's start)."""
    n, size, run = F.col("_blocks"), F.col("source_size"), F.col("_pass")
    goal = F.round("target").cast("long")
    # no divisor can be 0, even where Spark tests an expression before the filter
    g = goals.filter(F.col("source_size") > 0).withColumn("_goal", goal).withColumn("source_size", F.greatest("source_size", F.lit(1))).withColumn("_blocks", F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)))
    g = g.withColumn("_tail", size - (n - 1) * block).withColumn("_full", F.expr("_goal div source_size")).withColumn("_rest", F.expr("_goal % source_size"))
    g = g.withColumn("_tail_at", permuted(n - 1, F.col("_src"), F.col("_full"), n, inverse=True))
    short = F.ceil(F.col("_rest") / block)
    g = g.withColumn("_last", F.when(short <= F.col("_tail_at"), short).otherwise(F.when(F.col("_rest") > 0, 1 + F.ceil(F.greatest(F.col("_rest") - F.col("_tail"), F.lit(0)) / block)).otherwise(0)))
    g = g.withColumn("_n", (F.col("_full") * n + F.col("_last")).cast("long"))
    out = drawn(g.filter(F.col("_n") > 0).select("_src", "_n"), shard_slots)
    out = out.join(g.drop("_source"), "_src").withColumn("_pass", F.expr("_slot div _blocks")).withColumn("_at", F.expr("_slot % _blocks"))
    before = F.when(F.col("_at") <= F.col("_tail_at"), F.col("_at") * block).otherwise((F.col("_at") - 1) * block + F.col("_tail"))
    take = F.when(run < F.col("_full"), F.lit(block)).otherwise(F.least(F.lit(block), F.greatest(F.col("_rest") - before, F.lit(0))))
    return out.withColumn("_block", permuted(F.col("_at"), F.col("_src"), run, n)).withColumn("_take", take.cast("long")).select("shard", "_src", "_slot", "_pass", "_block", "_take")


def pieces(sized: DataFrame, goals: DataFrame, n_docs: int, block: int = BLOCK) -> DataFrame:
    """sized (of documents with words) with _src, _start (the document's first word in its source) and a row for each of its blocks: _block, _lo, _hi (inside the block)."""
    buckets = max(1, round(n_docs**0.5))
    rows = sized.withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(buckets)))
    numbers = goals.select(F.col("_source").alias("_s"), "_src", "source_size", "target")
    rows = rows.join(numbers, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    sums = rows.groupBy("_src", "_bucket").agg(F.sum("size").alias("_sum"))
    base = sums.withColumn("_base", F.sum("_sum").over(Window.partitionBy("_src").orderBy("_bucket")) - F.col("_sum")).drop("_sum")
    inner = Window.partitionBy("_src", "_bucket").orderBy(F.col("_id").asc_nulls_last(), "size", "_h").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_within", F.sum("size").over(inner) - F.col("size")).join(base, ["_src", "_bucket"])
    rows = rows.withColumn("_start", F.col("_base") + F.col("_within")).drop("_base", "_within", "_bucket")
    rows = rows.withColumn("_block", F.explode(F.sequence(F.expr(f"_start div {block}"), F.expr(f"(_start + size - 1) div {block}"))))
    return rows.withColumn("_lo", F.greatest(F.col("_start") - F.col("_block") * block, F.lit(0))).withColumn("_hi", F.least(F.col("_start") + F.col("size") - F.col("_block") * block, F.lit(block)))


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """sizes() and targets() of docs, checkpointed: words are counted once."""
    sized = checkpointed(sizes(docs, id_col, text_col, source_col))
    return sized, checkpointed(targets(sized))


def mixed(sized: DataFrame, goals: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as pieces of documents: sized columns, _src, _start, source_size, target, _block, _lo, _hi, and for each slot shard, _slot, _pass, _words (taken from the piece's start).

    A piece that no slot takes has one row with 0 words and nulls; documents without words have none.
    """
    some = sized.filter(F.col("size") > 0)
    # slots have no size bound, and Spark would take them to be as small as what they are made from
    out = pieces(some, goals, some.count(), block).join(slots(goals, block, shard_slots).hint("merge"), ["_src", "_block"], "left")
    return out.withColumn("_words", F.greatest(F.least(F.col("_hi"), F.coalesce("_take", F.lit(0))) - F.col("_lo"), F.lit(0)))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per document: id, size, source_size, target (of its source), taken (words, repeats counted), shards (those its words stand in, in order)."""
    sized, goals = prepared(docs, id_col, text_col, source_col)
    some = mixed(sized, goals, block, shard_slots).groupBy("_src", "_start", "_id", "size", "source_size", "target").agg(F.sum("_words").alias("taken"), F.sort_array(F.collect_set(F.when(F.col("_words") > 0, F.col("shard")))).alias("shards"))
    of_source = goals.select(F.col("_source").alias("_s"), "source_size", "target")
    none = sized.filter(F.col("size") == 0).join(of_source, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("taken", F.lit(0).cast("long")).withColumn("shards", F.array().cast("array<bigint>"))
    cols = [F.col("_id").alias(id_col), "size", "source_size", "target", "taken", "shards"]
    return some.select(cols).unionByName(none.select(cols))


def remixed(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, shard_col: str | None = None) -> DataFrame:
    """docs after mixing, in their own columns (doc_id, text, lang, source, n_chars and others): a row for each pass that takes words of a document, with the words taken.

    With shard_col there is a row for each pass and shard instead, and the
    shard in that column first, to be written by.

    A pass that takes a document whole leaves its text as it is; else the runs
    of words that it takes are cut out of the text with the blanks and line
    feeds between their words.
    """
    runs = mixed(*prepared(docs), block, shard_slots).filter(F.col("_words") > 0)
    runs = runs.withColumn("_from", F.col("_block") * block + F.col("_lo") - F.col("_start"))
    by = ["_pass", "shard"] if shard_col else ["_pass"]
    runs = runs.groupBy("_id", "_h", "_src", "_start", "size", *by).agg(F.array_sort(F.collect_list(F.struct("_from", "_words"))).alias("_runs"), F.sum("_words").alias("_sum"))
    # rows with equal id and text are numbered on both sides, to be joined one to one
    same = Window.partitionBy("_id", "_h")
    runs = runs.withColumn("_nth", F.dense_rank().over(same.orderBy("_src", "_start")))
    runs = runs.select(F.col("_id").alias("_rid"), F.col("_h").alias("_rh"), F.col("_nth").alias("_rn"), "_runs", "_sum", F.col("size").alias("_size"), *(["shard"] if shard_col else []))
    rows = packed(docs).withColumn("_nth", F.row_number().over(same.orderBy(F.col("_row").getField("source").asc_nulls_last())))
    out = rows.join(runs, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_h") == F.col("_rh")) & (F.col("_nth") == F.col("_rn")))
    whole = F.col("_row").getField("text")
    # each word with what stands before it, so that runs are parts of the text as it is
    words = F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.concat_ws("", F.flatten(F.transform("_runs", lambda r: F.slice(words, (r["_from"] + 1).cast("int"), r["_words"].cast("int")))))
    cut = F.when(F.col("_runs").getItem(0).getField("_from") == 0, cut).otherwise(F.regexp_replace(cut, r"^[\x20\x09-\x0D]+", ""))
    text = F.when(F.col("_sum") == F.col("_size"), whole).otherwise(cut)
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    if shard_col:
        out = out.withColumn("_row", F.col("_row").withField(shard_col, F.col("shard")))
        return unpacked(out, [shard_col, *(c for c in docs.columns if c != shard_col)], **changed)
    return unpacked(out, docs.columns, **changed)
