"""The native store: partitioned Parquet, which adds the pruning that the single file lacks.

``blocks`` is partitioned by group, so a lookup of one layer reads its group's
folder only, and a query that needs one stream reads one column chunk's rows.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.plans import codec


def save(encoded: codec.Encoded, path: str, mode: str = "errorifexists") -> None:
    """Write all tables of an encode below ``path``, a folder that all executors share."""
    encoded.blocks.repartition("group_id").write.mode(mode).partitionBy("group_id").parquet(f"{path}/blocks")
    encoded.tensors.write.mode(mode).parquet(f"{path}/tensors")
    encoded.dictionaries.write.mode(mode).parquet(f"{path}/dictionaries")
    encoded.modes.write.mode(mode).parquet(f"{path}/modes")
    spark = encoded.blocks.sparkSession
    spark.createDataFrame([(json.dumps(asdict(encoded.options)),)], "options string").write.mode(mode).parquet(f"{path}/options")


def load(spark: SparkSession, path: str) -> codec.Encoded:
    options = codec.Options(**json.loads(spark.read.parquet(f"{path}/options").first().options))
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("tensors", "dictionaries", "modes", "blocks")}
    return codec.Encoded(**tables, options=options)


def layer(encoded: codec.Encoded, tensor_name: str) -> DataFrame:
    """``tensor_rows`` of one tensor: its group's blocks up to it are read, others are pruned."""
    spark = encoded.blocks.sparkSession
    index = encoded.tensors.where(F.col("tensor_name") == tensor_name).select("layer_idx").first()
    if index is None:
        return spark.createDataFrame([], "layer_idx int, row_idx int, vals array<float>")
    at = index.layer_idx
    place = encoded.blocks.where(F.col("layer_idx") == at).select("group_id").first()
    needed = encoded.blocks.where((F.col("group_id") == place.group_id) & (F.col("layer_idx") <= at))
    part = codec.Encoded(encoded.tensors.where(F.col("layer_idx") <= at), encoded.dictionaries, encoded.modes, needed, encoded.options)
    return codec.decode(part).where(F.col("layer_idx") == at)
