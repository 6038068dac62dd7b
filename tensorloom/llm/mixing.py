"""Mixing sources to target weights with exact word budgets.

Targets: sources share the words of the whole input by weight; no target goes
above ``max_epochs`` times its source's size and the excess is shared again by
weight among the others (water filling, solved in one pass over the sources in
the order in which they would reach their cap).

Cut: every document gets a hash-random key; the leading hex digits of the key
are a range within its source, so ranges are a range partition of each source.
Words are summed per (source, range) map-side, prefix sums over the ranges give
each range's start, and only the one range per source in which the budget ends
is sorted. So no task holds a source, however large it is. A budget above the
source's size takes whole epochs first and cuts the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed, small, word_count

#: Weights by the rank of the source, repeating.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Leading hex digits of the key that name a range: 16 ** 4 ranges a source.
DIGITS = 4
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, source_size)`` plus weight, target (double) and budget (whole words).

    One row per source goes through the windows, never one per document. A
    source is saturated if, with all sources that saturate before it at their
    cap, the share by weight of what is left would lift it above its own cap.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("rank", rank)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Order by cap / weight, compared as doubles, ties by rank.
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    known = (
        ranked.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("left_size", F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("left_size") * F.col("weight") >= F.col("cap") * F.col("left_weight"))
    )
    known = known.withColumn("full_cap", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)))
    known = known.withColumn("full_weight", F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), F.lit(0)))
    top = (F.col("all_size") - F.col("full_cap")) * F.col("weight")
    bottom = F.greatest(F.col("all_weight") - F.col("full_weight"), F.lit(1))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(top.cast("double") / bottom.cast("double"))
    budget = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("((all_size - full_cap) * weight) div greatest(all_weight - full_weight, 1)"))
    return known.select("source", "source_size", target.alias("target"), budget.alias("budget"))


def _rows(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """``(doc_id, source, h, key, range, ..)``: a row's name in the mix; rows without a doc_id go by their text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *more)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"))))
    return rows.withColumn("h", F.xxhash64("text")).withColumn("key", key).withColumn("range", F.substring("key", 1, DIGITS))


def _planned(rows: DataFrame, ranges: DataFrame, weights: tuple[int, ...], max_epochs: int, size: Column) -> DataFrame:
    """``rows`` with size, source_size, target and taken, from the words of their ranges. ``size`` is the rows' word count.

    Ranges before a source's cut are taken whole and those behind it not at all, by a join on the range; only
    rows of the one range with the cut are sorted. So every row gets its own share, whatever rows it is equal to.
    """
    goals = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(up_to), F.lit(0)))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    goals = goals.withColumn("rest", F.when(F.col("source_size") > 0, F.expr("budget % source_size")).otherwise(F.lit(0)))
    state = F.when(F.col("start") + F.col("range_size") <= F.col("rest"), "in").when(F.col("start") >= F.col("rest"), "out").otherwise("cut")
    ranges = ranges.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), "range_size", "start")
    ranges = ranges.join(goals, F.col("r_source").eqNullSafe(F.col("source")))
    ranges = checkpointed(ranges.select("r_source", "r_range", "start", "source_size", "target", "epochs", "rest", state.alias("state")))
    at = F.col("range").eqNullSafe(F.col("r_range")) & F.col("source").eqNullSafe(F.col("r_source"))
    placed = rows.join(small(ranges, F.coalesce(F.octet_length("r_source"), F.lit(0)) + 64), at)
    whole = placed.where("state <> 'cut'").withColumn("size", size).withColumn("last", F.when(F.col("state") == "in", F.col("size")).otherwise(F.lit(0)))
    within = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    cut = placed.where("state = 'cut'").withColumn("size", size).withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - begins)))
    return whole.unionByName(cut).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("last")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``.

    size is the row's word count (null and empty texts: 0, taken 0). Null sources
    form one source, the last. The order within a source is by the MD5 of seed
    and doc_id (a null doc_id: the MD5 of the text), then doc_id, size and the text's hash, so reruns agree. Rows equal in all of these (repeated
    rows) share the cut in the order in which they come; their counts are
    the same in any order. Exactly one document a source is cut inside, so a
    source's taken words are its whole-word budget. A source whose words are all
    zero has target 0. An empty table gives an empty result. Other columns are ignored.
    """
    rows = _rows(docs, seed, id_col, text_col, source_col)
    rows = checkpointed(rows.select("doc_id", "source", "h", "key", "range", word_count(F.col("text")).alias("size")))
    ranges = checkpointed(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    return _planned(rows, ranges, weights, max_epochs, F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents of the mix, one row for each time that a document is taken.

    Returns the columns of ``docs``. A document that the mix takes r times whole
    has r equal rows; the one in which a source's budget ends has its last row
    cut to the words that remain, from its first word on, one space between them. Documents without words are not taken. n_chars, where there
    is such a column, is set to the length of the text of the row. Rows are taken one by one, so rows that repeat
    a doc_id, or have none, keep a source's budget exact too.
    """
    rows = _rows(docs, seed, "doc_id", "text", "source", F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"))
    size = word_count(F.col("text"))
    ranges = checkpointed(rows.groupBy("source", "range").agg(F.sum(size).alias("range_size")))
    plan = _planned(rows, ranges, weights, max_epochs, size).where("taken > 0").select("row", "text", "size", "taken")
    plan = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), " "))
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return plan.select(*[own[n].alias(n) if n in own else F.col("row").getField(n).alias(n) for n in docs.columns])
