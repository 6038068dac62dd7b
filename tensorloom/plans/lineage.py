"""Cutting lineage so that results are computed once and survive lost executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder.

    The cluster's own setting is used; only on a single machine without one (tests) is a temporary folder chosen.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Without it a local master gets a temporary folder; a cluster is refused."""
    context = spark.sparkContext
    if shared := context.getConf().get("spark.checkpoint.dir", None):
        return shared
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tensorloom-")
