"""Connected components over an edge table, by repeated randomised contraction.

Every round each node points at the neighbour (or itself) of smallest rank
under a hash that changes with the round, and the edges are rewritten onto the
targets. Contracted edges vanish, so a round shrinks the graph by a constant
factor in expectation, long chains included, and a hub disappears together
with its edges. Once no more than ``DIRECT`` edges are left, a few megabytes, one task joins
their nodes by union-find. The rounds' maps are composed from the last one backwards.
Minima are aggregated map-side and joins are plain equi-joins, which AQE can
split at a hub; nothing is gathered on the driver but one row count a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed

#: Edges that one task takes.
DIRECT = 1 << 18


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over all edges (a, b): each node with the least node that it reaches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for part in parts:
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "to"])


def components(edges: DataFrame, max_rounds: int = 60, direct: int = DIRECT) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``: equal roots, same component.

    Nodes are longs. Self loops and rows with a null end are no links. Repeated
    and reversed edges count once. A node without links is not listed. The root
    is some node of the component, not a particular one.
    """
    live = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    live = checkpointed(_clean(live))
    maps: list[DataFrame] = []
    while (left_over := live.count()) > direct:
        if len(maps) >= max_rounds:
            raise RuntimeError(f"components: edges are left after {max_rounds} rounds")
        salt = F.lit(len(maps))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("a", salt).alias("h"), F.col("a").alias("id"))
        # Cut off, so that both sides of the joins below are shuffled for them alone and AQE may split a hub.
        target = checkpointed(least.select(F.col("a").alias("node"), F.least(own, F.col("m"))["id"].alias("to")))
        maps.append(target)
        left = target.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = target.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        live = checkpointed(_clean(live.join(left, "a").join(right, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))))
    if left_over:
        maps.append(live.repartition(1).mapInArrow(_joined, "node long, to long"))
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = maps[-1].select("node", F.col("to").alias("root"))
    for target in reversed(maps[:-1]):
        later = labels.select(F.col("node").alias("to"), "root")
        labels = target.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return labels


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
