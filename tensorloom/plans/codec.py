"""Whole encode and decode as plans over tables: factor, group, delta, split, code, and back.

``encode`` gives an :class:`Encoded` set of tables; ``decode`` inverts it.
Barriers are only those that the semantics have: all tensors of a row dimension
for a dictionary, one record a layer for the groups. Everything else is per
row block or per tensor.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions import bits, codecs, streams
from tensorloom.operators import delta, drift, factor
from tensorloom.operators import tensors as T
from tensorloom.plans.lineage import checkpointed


@dataclass(frozen=True)
class Options:
    """Parameters of an encode; the flags of the passes are plain booleans."""

    num_atoms: int = 64
    atom_rank: int = 128
    drift_threshold: float = drift.THRESHOLD
    max_group: int = drift.MAX_GROUP
    min_group: int = drift.MIN_GROUP
    dictionary: bool = True
    deltas: bool = True
    backend: str = "lzma"
    delta_mode: str = "bits"
    drift_mode: str = "reference"


@dataclass(frozen=True)
class Encoded:
    tensors: DataFrame
    dictionaries: DataFrame
    modes: DataFrame
    blocks: DataFrame
    options: Options


_BLOCK = "layer_idx int, group_id int, is_iframe boolean, part string, n_rows int, n_cols int, layout string, stream string, codec string, raw_len long, blob binary"


def encode(tensors: DataFrame, rows: DataFrame, options: Options = Options()) -> Encoded:  # noqa: B008
    """Code all tensors. ``rows`` is scanned once per pass; the costly results are checkpointed."""
    spark = rows.sparkSession
    if options.backend not in codecs.BACKENDS:
        raise ValueError(f"unknown backend {options.backend!r}; known: {', '.join(codecs.BACKENDS)}")
    if options.dictionary:
        dictionaries = checkpointed(factor.fit(rows, tensors, options.num_atoms, options.atom_rank))
        # The kernels are the costly part and three plans read their result.
        factored = checkpointed(factor.project(rows, tensors, dictionaries))
    else:
        dictionaries = spark.createDataFrame([], "m int, atom_idx int, vec array<float>")
        zero = rows.select("layer_idx").distinct().select("layer_idx", F.lit("C").alias("part"), F.lit(0).alias("row_idx"), F.array(F.lit(0.0).cast("float")).alias("vals"), F.lit("passthrough").alias("mode"))
        factored = rows.select("layer_idx", F.lit("R").alias("part"), "row_idx", "vals", F.lit("passthrough").alias("mode")).unionByName(zero)
    # A half tensor that is coded as it is keeps two bytes a value; coefficients and residuals are fp32.
    half = (F.col("dtype") == "float16") & (F.col("mode") == "passthrough")
    laid = factored.join(tensors.select((F.col("layer_idx") + F.lit(0)).alias("layer_idx"), "dtype"), "layer_idx").withColumn("layout", F.when(half, "fp16").otherwise("fp32"))
    groups = group(factored, options)
    frames = _frames(laid, groups, options, _any_half(tensors))
    modes = factored.select("layer_idx", "mode").distinct()
    return Encoded(tensors, dictionaries, modes, checkpointed(_code(frames, options)), options)


def group(factored: DataFrame, options: Options) -> DataFrame:
    """``(layer_idx, group_id, pos_in_group)``: by drift of C alone, as passthrough layers have equal C."""
    if not options.deltas:
        layers = factored.select("layer_idx").distinct().withColumn("distance", F.lit(float("inf")))
        return drift.segments(layers, options.drift_threshold, 1, 1)
    values = factored.where("part = 'C'").select("layer_idx", F.explode("vals").alias("v"))
    found = drift.distances(values, options.drift_mode)
    layers = factored.select("layer_idx").distinct().join(found, "layer_idx", "left")
    # Only the first layer and layers without a sound value lack a distance; segments() opens the first anyway.
    layers = layers.withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))
    return drift.segments(layers, options.drift_threshold, options.max_group, options.min_group)


def _any_half(tensors: DataFrame) -> bool:
    """Whether any tensor is half; one record a tensor is looked at."""
    return not tensors.where(F.col("dtype") == "float16").isEmpty()


def _frames(factored: DataFrame, groups: DataFrame, options: Options, any_half: bool) -> DataFrame:
    """Delta frames of both parts. A layer is a P-frame only if both parts can be: shapes and layouts of C and R must match.

    In mode bits a half layer's codes are half codes, carried as the fp32 values of these codes. In mode arith half layers are
    I-frames, as a difference of halves is no half.
    """
    placed = factored.join(groups, "layer_idx")
    narrow = F.col("layout") == "fp16"
    if any_half and options.delta_mode == "bits":
        placed = placed.withColumn("vals", F.when(narrow, bits.from_codes(bits.half_codes("vals"))).otherwise(F.col("vals")))
    shapes = placed.groupBy("group_id", "layer_idx", "part", "layout").agg(F.count("*").alias("n"), F.max(F.size("vals")).alias("w"))
    shapes = shapes.groupBy("group_id", "layer_idx").agg(F.sort_array(F.collect_list(F.struct("part", "n", "w", "layout"))).alias("shape"), F.min("layout").alias("least"))
    # The shape's hash joins the group's name, so layers of other shapes open a segment of their own.
    order = Window.partitionBy("group_id").orderBy("layer_idx")
    alone = F.lit(options.delta_mode == "arith") & (F.col("least") == "fp16")
    changed = ((F.col("shape") != F.lag("shape").over(order)) | alone).cast("int")
    spans = shapes.withColumn("span", F.sum(F.coalesce(changed, F.lit(0))).over(order)).select("layer_idx", "span")
    placed = placed.join(spans, "layer_idx")
    key = F.concat_ws(":", "group_id", "span", "part", "layout")
    coded = delta.encode(placed.select("layer_idx", key.alias("group_id"), "row_idx", "vals"), options.delta_mode)
    parts = F.split("group_id", ":")
    return coded.select("layer_idx", parts[0].cast("int").alias("group_id"), parts[2].alias("part"), parts[3].alias("layout"), "row_idx", "is_iframe", "data")


def _code(frames: DataFrame, options: Options) -> DataFrame:
    by = codecs.BACKENDS[options.backend]
    raw_bits = options.delta_mode == "bits"

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        flat, layout = np.stack(pdf["data"].to_numpy()), pdf.layout.iloc[0]
        if layout == "fp16":
            array = flat.astype(np.uint16).view(np.float16) if raw_bits else flat.astype(np.float16)
        else:
            array = flat.astype(np.int32).view(np.float32) if raw_bits else flat.astype(np.float32)
        found = streams.split(array)
        out = [(key[0], int(pdf.group_id.iloc[0]), bool(pdf.is_iframe.iloc[0]), key[1], array.shape[0], array.shape[1], layout, s, by[s], len(found[s]), codecs.codec(by[s])[0](found[s])) for s in ("sign", "exp", "mant")]
        return pd.DataFrame(out, columns=["layer_idx", "group_id", "is_iframe", "part", "n_rows", "n_cols", "layout", "stream", "codec", "raw_len", "blob"])

    return frames.groupBy("layer_idx", "part").applyInPandas(kernel, _BLOCK)


def decoded_frames(blocks: DataFrame, options: Options) -> DataFrame:
    """``(layer_idx, group_id, part, layout, row_idx, is_iframe, data)`` back from the blocks."""
    raw_bits = options.delta_mode == "bits"
    kind = "int" if raw_bits else "float"

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = {s: codecs.codec(c)[1](b) for s, c, b in zip(pdf.stream, pdf.codec, pdf.blob)}
        layout = pdf.layout.iloc[0]
        array = streams.merge(found | {"layout": layout, "shape": (int(pdf.n_rows.iloc[0]), int(pdf.n_cols.iloc[0]))})
        if raw_bits:
            data = array.view(np.uint16).astype(np.int32) if layout == "fp16" else array.view(np.int32)
        else:
            data = array.astype(np.float32)
        return pd.DataFrame({"layer_idx": key[0], "group_id": pdf.group_id.iloc[0], "part": key[1], "layout": layout, "row_idx": range(len(data)), "is_iframe": pdf.is_iframe.iloc[0], "data": list(data)})

    return blocks.groupBy("layer_idx", "part").applyInPandas(kernel, f"layer_idx int, group_id int, part string, layout string, row_idx int, is_iframe boolean, data array<{kind}>")


def factored_rows(encoded: Encoded) -> DataFrame:
    """``(layer_idx, group_id, part, row_idx, vals)``: coefficients and residuals, deltas undone."""
    frames = decoded_frames(encoded.blocks, encoded.options)
    keyed = frames.select("layer_idx", F.concat_ws(":", "group_id", "part", "layout").alias("group_id"), "row_idx", "is_iframe", "data")
    rows = delta.decode(keyed, encoded.options.delta_mode)
    parts = F.split("group_id", ":")
    vals = F.col("vals")
    if encoded.options.delta_mode == "bits" and _any_half(encoded.tensors):
        vals = F.when(parts[2] == "fp16", bits.from_half_codes(bits.codes("vals"))).otherwise(vals)
    return rows.select("layer_idx", parts[0].cast("int").alias("group_id"), parts[1].alias("part"), "row_idx", vals.alias("vals"))


def decode(encoded: Encoded) -> DataFrame:
    """``tensor_rows`` of all tensors."""
    factored = factored_rows(encoded).drop("group_id").join(encoded.modes, "layer_idx")
    if not encoded.options.dictionary:
        return factored.where("part = 'R'").select("layer_idx", "row_idx", "vals")
    return factor.reconstruct(factored, encoded.tensors, encoded.dictionaries)


def statistics(encoded: Encoded) -> DataFrame:
    """One record of the encode's passes.

    original_bytes, coded_bytes and compression_ratio; dictionary_bytes, coefficient_residual_bytes (what the factors take
    before deltas and coding), n_eligible and dictionary_used (tensors that may, and do, take a dictionary); n_iframes and
    n_pframes; delta_ratio (the sum of absolute deltas of coefficients over that of coefficients) and expected_gain.
    """
    one = lambda df: df.withColumn("one", F.lit(1))
    sizes = encoded.blocks.agg(F.sum(F.length("blob")).alias("coded_bytes"), F.countDistinct(F.when(F.col("is_iframe"), F.col("layer_idx"))).alias("n_iframes"), F.countDistinct(F.when(~F.col("is_iframe"), F.col("layer_idx"))).alias("n_pframes"))
    cells = F.col("n_rows").cast("long") * F.col("n_cols") * F.when(F.col("layout") == "fp16", 2).otherwise(4)
    factors = encoded.blocks.where("stream = 'exp'").agg(F.coalesce(F.sum(cells), F.lit(0)).alias("coefficient_residual_bytes"))
    width = F.when(F.col("dtype") == "float16", 2).when(F.col("dtype") == "float64", 8).otherwise(4)
    before = encoded.tensors.agg(F.sum(F.col("n_elem") * width).alias("original_bytes"))
    used = encoded.modes.agg(F.count_if(F.col("mode") == "dict").alias("dictionary_used"), F.count("*").alias("n_layers"))
    atoms = encoded.dictionaries.groupBy("m").agg(F.count("*").alias("atoms"))
    packed = atoms.agg(F.coalesce(F.sum(4 * F.col("m").cast("long") * F.col("atoms")), F.lit(0)).alias("dictionary_bytes"))
    fits = encoded.tensors.join(atoms, F.col("row_dim") == F.col("m"), "left").agg(F.count_if(T.encode_eligible(F.col("dtype"), F.col("row_dim"), F.col("col_dim"), F.col("atoms"))).alias("n_eligible"))
    # Sums of a layer's rows, frames in the groups that the encode made.
    whole = encoded.blocks.where("part = 'C'").groupBy("layer_idx").agg(F.max("is_iframe").alias("whole"))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double")))
    rows = factored_rows(encoded).where("part = 'C'")
    before_it = F.lag("vals").over(Window.partitionBy("group_id", "row_idx").orderBy("layer_idx"))
    moved = F.when(~F.col("whole") & F.col("last").isNotNull(), size(F.zip_with("vals", "last", lambda a, b: a - b)))
    gains = rows.withColumn("last", before_it).join(whole, "layer_idx").agg(F.coalesce(F.sum(size("vals")), F.lit(0.0)).alias("all"), F.coalesce(F.sum(moved), F.lit(0.0)).alias("moved"))
    ratio = F.col("moved") / (F.col("all") + 1e-8)
    gains = gains.select(F.round(ratio, 6).alias("delta_ratio"), F.round(1 / F.greatest(ratio, F.lit(0.01)), 6).alias("expected_gain"))
    joined = one(sizes)
    for part in (factors, before, used, packed, fits, gains):  # one record each
        joined = joined.join(one(part), "one")
    return joined.drop("one").withColumn("compression_ratio", F.col("original_bytes") / F.greatest("coded_bytes", F.lit(1)))


def with_options(options: Options, **changes) -> Options:
    return replace(options, **changes)
