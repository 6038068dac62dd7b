"""Histograms, entropy, quantised frequency tables and ideal code sizes.

Everything starts from symbol counts ``(keys..., sym, cnt)``, which Spark sums
map-side: what is shuffled is at most 256 rows a key and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the frequencies of a table add up to this.
SCALE = 1 << 15


def histogram(symbols: DataFrame, *keys: str) -> DataFrame:
    """Counts of the column ``sym`` by key."""
    return symbols.groupBy(*keys, F.col("sym").cast("int").alias("sym")).agg(F.count("*").alias("cnt"))


def byte_histogram(df: DataFrame, key: str, data: str) -> DataFrame:
    """``(key, sym, cnt)`` of the bytes of a string or binary column.

    Arrow batches are counted in place, so a byte never becomes a record. Null
    data has no bytes; a null key is a key.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for part in parts:
            column = part.column(1)
            for name, blob in zip(part.column(0).to_pylist(), column):
                if blob.is_valid:
                    counts = np.bincount(np.frombuffer(blob.as_buffer(), np.uint8), minlength=256)
                    totals[name] = totals[name] + counts if name in totals else counts
            if len(totals) > 4096:
                yield batch(totals)
                totals = {}
        if totals:
            yield batch(totals)

    def batch(totals: dict) -> pa.RecordBatch:
        names, syms, cnts = [], [], []
        for name, counts in totals.items():
            for sym in np.flatnonzero(counts).tolist():
                names.append(name)
                syms.append(sym)
                cnts.append(int(counts[sym]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(syms, pa.int32()), pa.array(cnts, pa.int64())], names=[key, "sym", "cnt"])

    rows = df.select(F.col(key).cast("string").alias(key), F.col(data).cast("binary").alias("data"))
    counted = rows.mapInArrow(run, f"`{key}` string, sym int, cnt long")
    return counted.groupBy(key, "sym").agg(F.sum("cnt").alias("cnt"))


def entropy(counts: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Shannon entropy in bits a symbol, with the number of symbols."""
    total = F.sum("cnt")
    # H = log2(N) - sum(c log2 c) / N needs one pass and no second shuffle.
    value = F.log2(total.cast("double")) - F.sum(F.col("cnt") * F.log2(F.col("cnt").cast("double"))) / total
    return counts.groupBy(*keys).agg(total.alias("n_symbols"), F.round(F.greatest(value, F.lit(0.0)), digits).alias("entropy"))


def frequency_table(counts: DataFrame, *keys: str, scale: int = SCALE) -> DataFrame:
    """``(keys..., sym, cnt, freq)``: counts scaled to add up to ``scale`` exactly.

    Present symbols get floor(cnt * scale / total), 1 at least. What is missing
    goes, 1 each, to the highest counts; what is too much is taken, 1 each, in
    rounds from the highest frequencies that are above 1. Ties go to the smaller symbol. The
    k-th decrement of a symbol belongs to round k, so rounds are ranks, not a loop.
    """
    by = Window.partitionBy(*keys)
    floor = F.greatest(F.expr(f"(cnt * {scale}) div sum(cnt) over (partition by {', '.join(keys)})"), F.lit(1))
    table = counts.where("cnt > 0").withColumn("base", floor)
    table = table.withColumn("gap", F.lit(scale) - F.sum("base").over(by))
    table = table.withColumn("place", F.row_number().over(by.orderBy(F.col("cnt").desc(), "sym")))
    table = table.withColumn("high", F.row_number().over(by.orderBy(F.col("base").desc(), "sym")))
    # At most 255 symbols are raised to 1, so at most as many decrements are listed for each.
    steps = table.where((F.col("gap") < 0) & (F.col("base") > 1)).withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("base") - 1, -F.col("gap")))))
    steps = steps.withColumn("order", F.row_number().over(by.orderBy("round", "high"))).where(F.col("order") <= -F.col("gap"))
    taken = steps.groupBy(*keys, "sym").agg(F.count("*").alias("taken"))
    table = table.join(taken, [*keys, "sym"], "left")
    up = F.when(F.col("place") <= F.col("gap"), 1).otherwise(0)
    return table.select(*keys, "sym", "cnt", (F.col("base") + up - F.coalesce("taken", F.lit(0))).cast("long").alias("freq"))


def slots(table: DataFrame, *keys: str) -> DataFrame:
    """The frequency table with the slot range ``[start, stop)`` of each symbol."""
    before = Window.partitionBy(*keys).orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("freq").over(before), F.lit(0)).cast("long")
    return table.withColumn("start", start).withColumn("stop", F.col("start") + F.col("freq"))


def slot_map(table: DataFrame, *keys: str) -> DataFrame:
    """``(keys..., slot, sym)``: the symbol of each of the ``SCALE`` slots."""
    ranged = slots(table, *keys).where("freq > 0")
    return ranged.select(*keys, "sym", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("slot"))


def model_cost(table: DataFrame, *keys: str, scale: int = SCALE, digits: int = 3) -> DataFrame:
    """Bytes that an ideal static coder with the table needs."""
    bits = F.sum(F.col("cnt") * (F.log2(F.lit(float(scale))) - F.log2(F.col("freq").cast("double"))))
    return table.groupBy(*keys).agg(F.sum("cnt").alias("raw_bytes"), F.round(bits / 8, digits).alias("cost_bytes"))


def top_symbols(counts: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k highest counts of each key with their rank; ties to the smaller symbol."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("cnt").desc(), "sym"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)
