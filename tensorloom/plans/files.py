"""Container files straight from an encode, and named arrays back: the single-machine calls on top of the plans."""

from __future__ import annotations

import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators import tensors as T
from tensorloom.plans import codec
from tensorloom.plans.lineage import checkpointed
from tensorloom.sources import container


def _blocks(encoded: codec.Encoded) -> DataFrame:
    """``(layer_idx, group_id, is_iframe, block)``: each layer's coded streams packed as they are."""
    shapes = encoded.tensors.select("layer_idx", "shape")

    def pack(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"layer_idx": [], "group_id": [], "is_iframe": [], "block": []})
        coded = {(p, s): b for p, s, b in zip(left["part"], left["stream"], left["blob"])}
        size = {p: (int(r), int(c)) for p, r, c in zip(left["part"], left["n_rows"], left["n_cols"])}
        whole = bool(left["is_iframe"].iloc[0])
        block = container.join_block(whole, left["layout"].iloc[0], size["R"], size["C"], tuple(right["shape"].iloc[0]), coded)
        return pd.DataFrame({"layer_idx": [key[0]], "group_id": [left["group_id"].iloc[0]], "is_iframe": [whole], "block": [block]})

    other = shapes.select((F.col("layer_idx") + F.lit(0)).alias("layer_idx"), "shape")
    return encoded.blocks.groupBy("layer_idx").cogroup(other.groupBy("layer_idx")).applyInPandas(pack, "layer_idx int, group_id int, is_iframe boolean, block binary")


def write(encoded: codec.Encoded, path: str, metadata: dict | None = None) -> dict:
    """Write one container; returns its sizes. Blocks pass through the driver one at a time, in layer order.

    The container holds arithmetic deltas, so the encode must be in that mode.
    """
    if encoded.options.delta_mode != "arith":
        raise ValueError("a container holds arithmetic deltas: encode with delta_mode='arith'")
    packed = checkpointed(_blocks(encoded))
    meta = encoded.tensors.orderBy("layer_idx").collect()  # one record a tensor, which the file's own index holds too
    index = packed.select("layer_idx", "group_id", F.length("block").alias("size")).orderBy("layer_idx").collect()
    groups: dict[int, list[int]] = {}
    for r in index:
        groups.setdefault(r.group_id, []).append(r.layer_idx)
    dictionaries: dict[int, list] = {}
    for r in encoded.dictionaries.orderBy("m", "atom_idx").collect():  # bounded: one matrix a row dimension
        dictionaries.setdefault(r.m, []).append(r.vec)
    ordered = packed.select("layer_idx", "block").repartitionByRange("layer_idx").sortWithinPartitions("layer_idx")
    blocks = (bytes(r.block) for r in ordered.toLocalIterator())
    size = container.assemble(
        path, [t.tensor_name for t in meta], [list(t["shape"]) for t in meta], [t.dtype for t in meta], [groups[g] for g in sorted(groups)], blocks, [r["size"] for r in index],
        {m: np.array(v, np.float32).T for m, v in dictionaries.items()}, encoded.options.backend, container.FLAG_SPLIT | container.FLAG_CODED | (container.FLAG_DELTA if encoded.options.deltas else 0), metadata,
    )
    width = {"float16": 2, "float64": 8}
    original = sum(t.n_elem * width.get(t.dtype, 4) for t in meta)
    coded = sum(r["size"] for r in index)
    return {"original_bytes": original, "coded_bytes": coded, "file_bytes": size, "compression_ratio": original / max(coded, 1), "final_ratio": original / max(size, 1)}


def encode(spark: SparkSession, state: dict[str, np.ndarray], path: str, options: codec.Options | None = None, metadata: dict | None = None, half: bool = False) -> dict:
    """Named arrays to a container file; returns the statistics of the encode."""
    began = time.perf_counter()
    tensors, rows = T.from_arrays(spark, state, half)
    options = codec.with_options(options or codec.Options(), delta_mode="arith")
    encoded = codec.encode(tensors, rows, options)
    stats = write(encoded, path, metadata)
    passes = codec.statistics(encoded).first().asDict()
    return passes | stats | {"seconds": time.perf_counter() - began}


def decode(path: str, verify: bool = False) -> dict[str, np.ndarray]:
    """All arrays of a container by name, in the dtype that it records (half stays half, all else is float32)."""
    file = container.Container(path, verify)
    return {file.names[i]: array for group in file.meta["groups"] for i, _, array in file.layers(group)}


def stream(path: str):
    """(name, array) in layer order, one group's predecessor in memory at a time."""
    file = container.Container(path)
    for layer in range(file.header.num_layers):
        for _, _, array in file.layers([layer]):
            yield file.names[layer], array


def dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """``(m, atom_idx, vec)`` of a container, without reading a block."""
    found = container.Container(path).dictionaries()
    return spark.createDataFrame([(int(m), i, [float(x) for x in d[:, i]]) for m, d in found.items() for i in range(d.shape[1])], "m int, atom_idx int, vec array<float>")


def header(spark: SparkSession, path: str) -> DataFrame:
    """The header as one record."""
    h = container.Container(path).header
    return spark.createDataFrame([(h.version, h.num_layers, h.num_atoms, h.flags, h.group_count, h.layers_offset, h.seek_offset, h.checksum, os.path.getsize(path))], "version int, num_layers int, num_atoms int, flags int, group_count int, layers_offset long, seek_offset long, checksum long, file_bytes long")
