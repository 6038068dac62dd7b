"""Exact top-k search by the three-phase uniform threshold algorithm (TPUT; Cao and Wang, 2004).

The score is an integer inner product, the sum over ``slices`` of the vector of
partial products. A node is one slice of one task's candidates: it ranks them by its
partial products alone. Candidates stay where they lie; queries travel to them in
broadcasts of bounded size, and two map-only passes over the candidates serve a block of queries:

1. Every node makes its local score list; the totals of the listed candidates are gathered, and
   the k-th best of them is a lower bound ``tau`` of the k-th best score.
2. ``tau / slices``, rounded up, goes out with the queries as the safe cutoff: a vector with total >= tau
   has a slice that reaches it (all below would add up to less than tau), so
   collecting the entries at or above the cutoff loses nothing.
3. An entry whose unsent slices, each below the cutoff, cannot lift it to tau goes; the rest
   are resolved exactly from the vectors, in place, and a task sends its best of them.

Equal vectors are one candidate with its k + 1 smallest ids, which is all that a
top k can need of them. So no task, broadcast or key holds more than a bounded number of
rows per query, whatever the table's size or its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed, pick

SLICES = 2
#: Bytes of query vectors that one broadcast carries, about.
QUERY_BYTES = 32 << 20
#: Queries and candidates that meet in one matrix product.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 2048
#: Length of a local list, in multiples of k + 1: longer lists raise the cutoff, and fewer entries reach it.
LISTS = 4
SCALE = 256
#: No bound is known: every entry is collected.
LOWEST = -(2**63)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as longs; null where the vector is null or holds a null or non-finite component.

    A finite component that no long can hold stops the query with an error: nothing is dropped or wrapped.
    """
    scaled = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: F.abs(x.cast("double") * scale) < 2.0**63
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    values = F.transform(vector, lambda x: F.when(fits(x), scaled(x)).otherwise(F.raise_error(F.lit("a component is too large: its multiple does not fit a long")).cast("long")))
    return F.when(vector.isNotNull() & F.forall(vector, finite), values)


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can pass 2^53, in longs where none can pass 2^63, else in Python's integers (an array of objects)."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    largest = int(max(-int(q.min()), int(q.max()))) * int(max(-int(c.min()), int(c.max()))) * q.shape[1]
    if largest < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if largest < 2**63:
        return q @ c.T
    return q.astype(object) @ c.astype(object).T


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and len(scores) and not -(2**63) <= min(scores) <= max(scores) < 2**63:
        raise ArithmeticError("the score of a result does not fit a long")
    return scores.astype(np.int64)


class Asked:
    """The queries of one broadcast: arrays by dimension, and the bound of each query (None: not known)."""

    def __init__(self, rows: pa.Table):
        self.of_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        cells = rows.column("v").combine_chunks()
        lengths = cells.value_lengths().to_numpy(zero_copy_only=False)
        ids, tau = rows.column("qid").to_numpy(), rows.column("tau").to_numpy()
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            self.of_dim[dim] = ids[at], matrix(cells.take(pa.array(at)), dim), tau[at]


def matrix(cells: pa.ListArray, dim: int) -> np.ndarray:
    return cells.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), dim)


def _best(query: np.ndarray, score: np.ndarray, *ids: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """The ``keep`` rows of each query with the highest scores, ties to the smaller first id."""
    rank = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
    order = np.lexsort((ids[0], -rank, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    order = order[place < keep]
    return query[order], score[order], *(x[order] for x in ids)


def _pass(asked, slices: int, keep: int, query_block: int, candidate_block: int, listed: bool):
    """mapInArrow over the candidates (cid, first, v): phase 1 if ``listed``, else phases 2 and 3.

    Either way a task sends ``keep`` rows (qid, cid, first, score) for a query at most.
    """

    def entries(q: np.ndarray, c: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dim = q.shape[1]
        cuts = [s * dim // slices for s in range(slices + 1)]
        parts = [product(q[:, a:b], c[:, a:b]) for a, b in zip(cuts, cuts[1:])]
        chosen = np.zeros(parts[0].shape, bool)
        if listed:
            length = min(len(c), LISTS * keep)
            for part in parts:
                rank = part if part.dtype != object else np.unique(part, return_inverse=True)[1].reshape(part.shape)
                np.put_along_axis(chosen, np.argpartition(-rank, length - 1, axis=1)[:, :length], True, 1)
        else:
            whole = tau == LOWEST
            # Python's integers where a long could not hold what is left to reach.
            cutoff = np.array([0 if w else -(-int(t) // slices) for t, w in zip(tau, whole)], object)
            narrow = cutoff.astype(np.int64)[:, None]
            sent = [part >= narrow for part in parts]
            i, j = np.nonzero(np.logical_or.reduce(sent) | whole[:, None])
            known = sum(np.where(s[i, j], part[i, j], 0).astype(object) + np.where(s[i, j], 0, cutoff[i] - 1) for part, s in zip(parts, sent)) if len(i) else np.zeros(0)
            reach = np.array([bool(x) for x in known >= tau[i]], bool) | whole[i] if len(i) else np.zeros(0, bool)
            chosen[i[reach], j[reach]] = True
        i, j = np.nonzero(chosen)
        exact = object if any(p.dtype == object for p in parts) or max(int(np.abs(p).max(initial=0)) for p in parts) * slices >= 2**63 else np.int64
        total = sum(p[i, j].astype(exact) for p in parts)
        if not listed:
            enough = np.asarray(total >= tau[i], bool)
            i, j, total = i[enough], j[enough], total[enough]
        return i, j, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                if dim not in asked.value.of_dim:
                    continue
                at = np.flatnonzero(lengths == dim)
                own = [batch.column(k).to_numpy()[at] for k in (0, 1)]
                c = matrix(batch.column(2).take(pa.array(at)), dim)
                qids, q, tau = asked.value.of_dim[dim]
                for lo in range(0, len(c), candidate_block):
                    hi = lo + candidate_block
                    for b in range(0, len(q), query_block):
                        i, j, total = entries(q[b : b + query_block], c[lo:hi], tau[b : b + query_block])
                        found = (i, total, own[1][lo:hi][j], own[0][lo:hi][j])
                        if (dim, b) in best:
                            found = tuple(np.concatenate(x) for x in zip(best[dim, b], found))
                        best[dim, b] = _best(*found, keep=keep)
        for (dim, b), (i, total, first, cid) in best.items():
            ids = asked.value.of_dim[dim][0][b : b + query_block][i]
            if listed and total.dtype == object:
                # A total below every long bounds nothing.
                held = np.array([t >= LOWEST for t in total], bool)
                ids, cid, first, total = ids[held], cid[held], first[held], total[held]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cid), pa.array(first), pa.array(_longs(total))], names=["qid", "cid", "first", "score"])

    return run


_ENTRY = "qid long, cid long, first long, score long"


def search(
    vectors: DataFrame, k: int = 5, every: int = 50, slices: int = SLICES, scale: int = SCALE, query_bytes: int = QUERY_BYTES, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best other rows, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``. Vectors that are
    null, or hold null or non-finite components, and rows without a vec_id take no
    part; a query meets vectors of its own length only. Rows that repeat a
    vec_id and its vector count once; another vector of the same vec_id is another row. Empty vectors score 0.
    Components of any size that a long holds after scaling are exact; a larger one, or a result whose score no long
    holds, stops the query with an error. Other columns are ignored; an empty table gives no rows.
    """
    rows = pick(vectors, vec_id="vec_id", v="embedding").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("v"), scale).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).distinct()
    # Spark limits each task to k + 1 rows of a vector before it shuffles them.
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = rows.withColumn("n", first).where(F.col("n") <= k + 1)
    classes = least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # A vec_id with several vectors is in several classes, so these are numbered apart.
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = checkpointed(asked.join(classes.select("v", "cid"), "v").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")))
    wanted = checkpointed(queries.select("qid").distinct().join(classes.select(F.col("cid").alias("qid"), "v"), "qid"))
    n_queries, held = wanted.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("v") + 16), F.lit(0))).first()
    n_blocks = max(1, -(-held // query_bytes))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n_blocks)))
    candidates = classes.select("cid", F.element_at("ids", 1).alias("first"), "v")
    context, keep = vectors.sparkSession.sparkContext, k + 1
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "first"))
    answers = None
    # Each turn collects one block of queries, of bounded size, and sends it to the candidates.
    for block in range(n_blocks if n_queries else 0):
        rows_of = wanted.where(F.col("block") == block).select("qid", "v")
        told = context.broadcast(Asked(rows_of.withColumn("tau", F.lit(LOWEST).cast("long")).toArrow()))
        lists = candidates.mapInArrow(_pass(told, slices, keep, query_block, candidate_block, listed=True), _ENTRY)
        # With fewer than k + 1 classes in reach there is no bound: everything is collected.
        bound = lists.withColumn("n", place).where(F.col("n") == keep).select("qid", F.col("score").alias("tau"))
        bounded = rows_of.join(bound, "qid", "left").withColumn("tau", F.coalesce("tau", F.lit(LOWEST).cast("long")))
        told = context.broadcast(Asked(bounded.toArrow()))
        entries = candidates.mapInArrow(_pass(told, slices, keep, query_block, candidate_block, listed=False), _ENTRY)
        best = entries.withColumn("n", place).where(F.col("n") <= keep).select("qid", "cid", "score")
        best = checkpointed(best) if n_blocks > 1 else best
        answers = best if answers is None else answers.unionByName(best)
    if answers is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    named = answers.join(classes.select("cid", "ids"), "cid").select("qid", "cid", "score", F.explode("ids").alias("vec_id"))
    named = named.groupBy("qid").agg(F.collect_list(F.struct("score", "vec_id", "cid")).alias("found"))
    # Few rows a query, so a query that many equal rows ask is one row here and takes no window.
    before = lambda a, b: F.when((a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["vec_id"] < b["vec_id"])), -1).when((a["score"] == b["score"]) & (a["vec_id"] == b["vec_id"]), 0).otherwise(1)
    named = named.select("qid", F.array_sort("found", before).alias("found"))
    own = lambda x: (x["cid"] == F.col("qid")) & (x["vec_id"] == F.col("query_id"))
    told = queries.join(named, "qid").select("query_id", F.slice(F.filter("found", lambda x: ~own(x)), 1, k).alias("found"))
    return told.select("query_id", F.posexplode("found").alias("place", "x")).select("query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", "x.score")
