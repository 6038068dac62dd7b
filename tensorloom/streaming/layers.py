"""Stateful streaming decode: delta frames in, whole layers out, one predecessor a group as state.

Frames of a group may arrive out of order: those that wait for a predecessor are
kept until it comes. A group's state is cleared with its last layer, so state
is bounded by the groups that are open. A group whose last frame never comes stays
open: what waits in it is not given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME = "group_id long, pos int, size int, layer_idx long, is_iframe boolean, data array<bigint>"
LAYER = "layer_idx long, group_id long, data array<bigint>"


def decode(frames: DataFrame) -> DataFrame:
    """``(layer_idx, group_id, data)`` of a stream (or batch) of integer delta frames.

    pos counts a group's layers from 0 and size is their number. An I-frame's
    values replace the state; a P-frame's are added to it.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, last, waiting = state.get if state.exists else (0, [], [])
        last, held = np.asarray(last, np.int64), {row[0]: row for row in (tuple(w) for w in waiting)}
        size, out = None, []
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                held[row.pos] = (row.pos, row.layer_idx, bool(row.is_iframe), np.asarray(row.data, np.int64))
                size = row.size
        while following in held:
            _, layer, whole, data = held.pop(following)
            data = np.asarray(data, np.int64)
            last = data if whole or not len(last) else last + data
            out.append((layer, key[0], last))
            following += 1
        if size is not None and following >= size:
            state.remove()
        else:
            state.update((following, last.tolist(), [(*held[k][:3], np.asarray(held[k][3]).tolist()) for k in sorted(held)]))
        if out:
            yield pd.DataFrame(out, columns=["layer_idx", "group_id", "data"])

    kept = "next int, last array<bigint>, waiting array<struct<pos:int,layer_idx:bigint,is_iframe:boolean,data:array<bigint>>>"
    return frames.groupBy("group_id").applyInPandasWithState(step, LAYER, kept, "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Decode all frames in the Parquet folder ``path`` into ``out`` and stop; restarts go on from the checkpoint."""
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 4).parquet(path)
    query = decode(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def ordered(layers: DataFrame) -> Iterator:
    """The layers in order, one at a time, with one partition in the driver's memory at most."""
    yield from layers.repartitionByRange("layer_idx").sortWithinPartitions("layer_idx").toLocalIterator()


def frames_of(rows: DataFrame, value: str, group, size: int) -> DataFrame:
    """Integer delta frames of ``(layer_idx, data)`` rows, ``size`` layers a group."""
    from pyspark.sql import Window

    order = Window.partitionBy("group_id").orderBy("layer_idx")
    placed = rows.withColumn("group_id", group.cast("long")).withColumn("layer_idx", F.col("layer_idx").cast("long"))
    last = F.lag(value).over(order)
    first = last.isNull()
    data = F.when(first, F.col(value)).otherwise(F.zip_with(F.col(value), last, lambda a, b: a - b))
    pos = (F.row_number().over(order) - 1).cast("int")
    total = F.count("*").over(Window.partitionBy("group_id")).cast("int")
    return placed.select("group_id", pos.alias("pos"), total.alias("size"), "layer_idx", first.alias("is_iframe"), data.alias("data"))
