"""Delta frames between neighbouring layers, their inverse and their statistics.

Windows run on row blocks: a record is one row of a layer, its neighbour is the
same row of the layer before it in the group, and the difference is taken
inside the arrays. Two modes: ``arith`` subtracts in fp32 (tolerance), ``bits``
takes the exclusive or of the raw codes and is exactly invertible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions import bits

MODES = ("arith", "bits")


def encode(rows: DataFrame, mode: str = "bits") -> DataFrame:
    """``(layer_idx, group_id, row_idx, is_iframe, data)`` from ``(layer_idx, group_id, row_idx, vals)``.

    The first layer of a group, and one whose shape differs from its
    predecessor's, is an I-frame and stored whole; others hold the difference
    to the *original* predecessor. ``data`` is array<int> of codes in mode
    bits and array<float> in mode arith.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    shaped = _shaped(rows)
    data = bits.codes("vals") if mode == "bits" else F.col("vals")
    shaped = shaped.withColumn("data", data)
    before = Window.partitionBy("group_id", "row_idx").orderBy("layer_idx")
    last, last_layer = F.lag("data").over(before), F.lag("layer_idx").over(before)
    step = (lambda a, b: a.bitwiseXOR(b)) if mode == "bits" else (lambda a, b: (a - b).cast("float"))
    framed = shaped.withColumn("last", last).withColumn("last_layer", last_layer)
    whole = F.col("prev_layer").isNull() | (F.col("prev_rows") != F.col("n_rows")) | (F.col("prev_cols") != F.col("n_cols"))
    # Equal shapes have equal rows, so the row before is the predecessor's.
    framed = framed.withColumn("is_iframe", whole | F.col("last").isNull() | (F.col("last_layer") != F.col("prev_layer")))
    out = F.when(F.col("is_iframe"), F.col("data")).otherwise(F.zip_with("data", "last", step))
    return framed.select("layer_idx", "group_id", "row_idx", "is_iframe", out.alias("data"))


def _shaped(rows: DataFrame) -> DataFrame:
    """Rows with their layer's shape and that of the layer before it in its group; one record a layer is windowed."""
    shapes = rows.groupBy("group_id", "layer_idx").agg(F.count("*").alias("n_rows"), F.max(F.size("vals")).alias("n_cols"))
    order = Window.partitionBy("group_id").orderBy("layer_idx")
    for name, column in (("prev_layer", "layer_idx"), ("prev_rows", "n_rows"), ("prev_cols", "n_cols")):
        shapes = shapes.withColumn(name, F.lag(column).over(order))
    return rows.join(shapes, ["group_id", "layer_idx"])


def decode(frames: DataFrame, mode: str = "bits") -> DataFrame:
    """``(layer_idx, group_id, row_idx, vals)``: the running sum that starts anew at every I-frame.

    A segment is an I-frame and the layers that build on it; groups are short,
    so a row's segment folds in order inside one record.
    """
    order = Window.partitionBy("group_id", "row_idx").orderBy("layer_idx")
    marked = frames.withColumn("segment", F.sum(F.col("is_iframe").cast("int")).over(order))
    folded = marked.groupBy("group_id", "row_idx", "segment").agg(F.sort_array(F.collect_list(F.struct("layer_idx", "data"))).alias("chain"))
    kind = "int" if mode == "bits" else "float"
    step = (lambda a, b: a.bitwiseXOR(b)) if mode == "bits" else (lambda a, b: (a + b).cast("float"))
    empty = F.struct(F.lit(None).cast(f"array<{kind}>").alias("now"), F.array().cast(f"array<struct<layer_idx:int,vals:array<{kind}>>>").alias("out"))

    def grow(acc: Column, frame: Column) -> Column:
        now = F.when(acc["now"].isNull(), frame["data"]).otherwise(F.zip_with(acc["now"], frame["data"], step))
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(F.struct(frame["layer_idx"].alias("layer_idx"), now.alias("vals")))).alias("out"))

    rows = folded.select("group_id", "row_idx", F.explode(F.aggregate("chain", empty, grow, lambda acc: acc["out"])).alias("f"))
    vals = bits.from_codes(F.col("f.vals")) if mode == "bits" else F.col("f.vals")
    return rows.select(F.col("f.layer_idx").alias("layer_idx"), "group_id", "row_idx", vals.alias("vals"))


def statistics(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """One record: I- and P-frames, sum of absolute deltas over that of values, expected gain."""
    size = lambda name: F.aggregate(name, F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double")))
    both = frames.join(rows.select("layer_idx", "row_idx", size("vals").alias("whole")), ["layer_idx", "row_idx"])
    layers = both.groupBy("layer_idx").agg(F.max("is_iframe").alias("i"), F.sum(size("data")).alias("delta"), F.sum("whole").alias("whole"))
    p = ~F.col("i")
    ratio = F.coalesce(F.sum(F.when(p, F.col("delta"))), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(F.when(p, F.col("whole"))), F.lit(0.0)), F.lit(1e-30))
    out = layers.agg(F.count_if("i").alias("n_iframes"), F.count_if(p).alias("n_pframes"), ratio.alias("ratio"))
    return out.select("n_iframes", "n_pframes", F.round("ratio", 6).alias("delta_ratio"), F.round(1 / F.greatest("ratio", F.lit(0.01)), 6).alias("expected_gain"))
