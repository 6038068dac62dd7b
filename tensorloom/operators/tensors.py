"""Tensors as tables: sources, the 2-D view, order of names, eligibility."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom import schemas
from tensorloom.functions import bits

#: Fixed values of the eligibility gates.
MIN_DIM, MIN_CELLS = 4, 1000


def from_arrays(spark: SparkSession, state: dict[str, np.ndarray], half: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(tensors, tensor_rows)`` of named arrays, in code-point order of the names.

    Any rank is taken: a scalar is one row of one value, an empty tensor has no
    rows. uint16 arrays carry bf16 codes. ``half`` narrows float32 to float16.
    """
    meta, rows = [], []
    for index, name in enumerate(sorted(state)):
        array = np.asarray(state[name])
        dtype = str(array.dtype)
        if half and dtype == "float32":
            with np.errstate(over="ignore"):
                array, dtype = array.astype(np.float16), "float16"
        shape = list(array.shape)
        flat = (array.astype(np.uint32) << 16).view(np.float32) if dtype == "uint16" else array.astype(np.float32)
        m = shape[0] if shape else 1
        n = flat.size // m if m else 0
        meta.append((name, index, dtype, shape, m, n, flat.size))
        rows += [(index, r, [float(x) for x in row]) for r, row in enumerate(flat.reshape(m, n))] if flat.size else []
    return spark.createDataFrame(meta, schemas.TENSORS), spark.createDataFrame(rows, schemas.TENSOR_ROWS)


def rows_of(df: DataFrame, vector: str, layer: Column, row: Column) -> DataFrame:
    """``tensor_rows`` from a table with one vector per record."""
    return df.select(layer.cast("int").alias("layer_idx"), row.cast("int").alias("row_idx"), F.col(vector).cast("array<float>").alias("vals"))


def cells(rows: DataFrame, *keys: str) -> DataFrame:
    """One record per cell with its raw code: for statistics that count codes."""
    keys = keys or ("layer_idx", "row_idx")
    return rows.select(*keys, bits.codes("vals").alias("raw")).select(*keys, F.posexplode("raw").alias("c", "raw"))


def register(names: DataFrame, column: str) -> DataFrame:
    """``(name, id)``: dense ids of the distinct names in code-point order.

    Names are ranked within the ranges of a range partition and each range is
    shifted by the distinct names before it, so no task holds all names.
    """
    distinct = names.select(F.col(column).alias("name")).where(F.col(column).isNotNull()).distinct()
    ranged = distinct.repartitionByRange("name").sortWithinPartitions("name").withColumn("range", F.spark_partition_id())
    own = F.row_number().over(Window.partitionBy("range").orderBy("name"))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("name").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("range", before.alias("before"))
    return ranged.withColumn("own", own).join(sizes, "range").select("name", (F.col("before") + F.col("own") - 1).cast("long").alias("id"))


def fit_eligible(dtype: Column, shape: Column, row_dim: Column, col_dim: Column, nonzero: Column) -> Column:
    """Whether a tensor takes part in fitting a dictionary."""
    two = (F.size(shape) >= 2) & (F.element_at(shape, 1) >= 2) & (F.element_at(shape, 2) >= 2)
    return bits.is_float(dtype) & two & (F.least(row_dim, col_dim) >= MIN_DIM) & (row_dim.cast("long") * col_dim >= MIN_CELLS) & nonzero


def encode_eligible(dtype: Column, row_dim: Column, col_dim: Column, atoms: Column) -> Column:
    """Whether a tensor is projected on its dictionary of ``atoms`` columns (null: none)."""
    return F.coalesce(bits.is_float(dtype) & (F.least(row_dim, col_dim) >= MIN_DIM) & (row_dim.cast("long") * col_dim >= MIN_CELLS) & (atoms < row_dim), F.lit(False))
