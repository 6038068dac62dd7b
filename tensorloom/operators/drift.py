"""Drift between neighbouring layers, groups of layers, and the indexes over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the drift distance and of the groups.
BINS = 32
EPS = 1e-8
THRESHOLD = 0.35
MAX_GROUP, MIN_GROUP = 8, 2


def distances(values: DataFrame, mode: str = "reference", bins: int = BINS) -> DataFrame:
    """``(layer_idx, distance)`` of each layer to the one before it, from ``(layer_idx, v)``.

    Both layers are counted into equal bins over their joint range (the last
    bin is closed). reference: 1 - min(sum of the lesser densities / range, 1),
    which depends on the scale of the values; normalised: 1 - overlap.
    Layers are ordered by layer_idx; the first has no distance. Nulls and values
    that are not finite are left out of the histograms.

    Cells are counted where they lie: each goes to its two pairs by a join with
    the table of ranges (one record a layer), and what is shuffled are bin counts.
    """
    sound = values.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    layers = sound.groupBy("layer_idx").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    order = Window.orderBy("layer_idx")  # one record a layer
    pairs = layers.select("layer_idx", F.lag("layer_idx").over(order).alias("prev"), *[F.lag(c).over(order).alias(f"p_{c}") for c in ("low", "high", "n")], "low", "high", "n").where("prev is not null")
    lo = F.least("low", "p_low").cast("double")
    hi = (F.greatest("high", "p_high").cast("double") + F.lit(EPS).cast("float").cast("double")).cast("float").cast("double")
    pairs = pairs.select("layer_idx", "prev", "n", "p_n", lo.alias("lo"), hi.alias("hi"))
    sides = pairs.select(F.col("layer_idx").alias("pair"), F.explode(F.array(F.struct(F.col("layer_idx").alias("layer"), F.lit(0).alias("side")), F.struct(F.col("prev").alias("layer"), F.lit(1).alias("side")))).alias("s"), "lo", "hi")
    sides = sides.select("pair", "s.layer", "s.side", "lo", "hi")
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.floor((F.col("v").cast("double") - F.col("lo")) / width * bins)).otherwise(F.lit(0))
    counts = sound.join(sides, sound["layer_idx"] == sides["layer"]).groupBy("pair", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
    counts = counts.agg(F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1"))
    joined = counts.join(pairs, counts["pair"] == pairs["layer_idx"])
    shared = F.sum(F.least(F.col("c0") / F.col("n"), F.col("c1") / F.col("p_n")))
    overlap = joined.groupBy("pair", "lo", "hi").agg(shared.alias("overlap"))
    value = F.col("overlap") if mode == "normalised" else F.col("overlap") * bins / F.greatest(width, F.lit(1e-300)) / (width + EPS)
    return overlap.select(F.col("pair").alias("layer_idx"), (1 - F.least(value, F.lit(1.0))).alias("distance"))


def segments(layers: DataFrame, threshold: float = THRESHOLD, max_size: int = MAX_GROUP, min_size: int = MIN_GROUP) -> DataFrame:
    """``(layer_idx, group_id, pos_in_group)`` from ``(layer_idx, distance)``, one record a layer.

    A group ends where the distance passes the threshold or it is full; a last
    group below ``min_size`` joins the one before it.
    """
    order = Window.orderBy("layer_idx")
    broken = (F.col("distance").isNull() | (F.col("distance") > threshold)).cast("int")
    # The first layer opens a run even where a distance is given for it.
    broken = F.when(F.row_number().over(order) == 1, 1).otherwise(broken)
    runs = layers.withColumn("brk", broken).withColumn("run", F.sum("brk").over(order))
    within = F.row_number().over(Window.partitionBy("run").orderBy("layer_idx")) - 1
    cut = runs.withColumn("sub", F.floor(within / max_size))
    grouped = cut.withColumn("g", F.dense_rank().over(Window.orderBy("run", "sub")) - 1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grouped = grouped.withColumn("last", F.max("g").over(everything)).withColumn("size", F.count("*").over(Window.partitionBy("g")))
    tail = (F.col("g") == F.col("last")) & (F.col("g") > 0) & (F.col("size") < min_size)
    grouped = grouped.withColumn("group_id", (F.col("g") - tail.cast("int")).cast("int"))
    pos = F.row_number().over(Window.partitionBy("group_id").orderBy("layer_idx")) - 1
    return grouped.select("layer_idx", "group_id", pos.cast("int").alias("pos_in_group"))


def seek_table(blocks: DataFrame) -> DataFrame:
    """``(layer_idx, group_id, seek_offset, block_len)`` from ``(layer_idx, group_id, block_len)``: running offsets."""
    before = Window.orderBy("layer_idx").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("layer_idx", "group_id", F.coalesce(F.sum("block_len").over(before), F.lit(0)).cast("long").alias("seek_offset"), F.col("block_len").cast("long").alias("block_len"))


def lengths(seek: DataFrame, end) -> DataFrame:
    """Block lengths back from offsets: the next offset less the own one; the last runs to ``end``."""
    following = F.lead("seek_offset").over(Window.orderBy("layer_idx"))
    return seek.withColumn("block_len", (F.coalesce(following, F.lit(end)) - F.col("seek_offset")).cast("long"))


def group_index(seek: DataFrame) -> DataFrame:
    """One record a group: its first layer, followers, offset and bytes."""
    return seek.groupBy("group_id").agg(F.min("layer_idx").alias("first_layer"), (F.count("*") - 1).alias("n_followers"), F.min_by("seek_offset", "layer_idx").alias("group_offset"), F.sum("block_len").alias("group_bytes"))
