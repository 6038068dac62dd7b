"""Embedding near-duplicates by randomised-rotation binary codes (RaBitQ; Gao and Long, 2024).

Sketch: a unit vector x is turned by a random isometry P into D dimensions. Its
code is the signs of Px; with o the code as a unit vector, the stored factor
f = <o, Px> makes <o, Py> / f an unbiased estimate of <x, y>, whose error passes
``EPSILON * sqrt((1 - f^2) / f^2 / (D - 1))`` only with vanishing probability.
Py travels with four bits a component. A pair whose upper bound stays below
the threshold is out; every other pair is computed again exactly, in double
precision, and only the exact cosine links.

Candidates: the signs of a second rotation are cut into keys. Keys get longer with the number of vectors, so
that buckets of unlike vectors do not grow with it. Signs agree with probability 1 - angle / pi; there are so many
tables that a pair at the threshold shares a key with probability :data:`RECALL`, a closer pair more surely.

Two passes over the buckets: the first moves sketches only, a fraction of the
vectors' bytes, and names the members of each bucket with a pair left; the second
fetches the vectors of these. A pair is judged in the first table in which it
meets, so links are counted once without shipping pairs: tasks emit link counts
per vector and a spanning forest. Buckets above ``BLOCK`` are cut into blocks and
each pair of blocks is a task of its own. Equal vectors are one class, whatever
their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed, pick
from tensorloom.llm.components import components

THRESHOLD = 0.95
#: Probability with which a pair at the threshold meets.
RECALL = 0.98
#: Signs of a key: the binary logarithm of the vectors less SPARE, within these bounds.
KEY_BITS, SPARE = (16, 31), 4
EPSILON = 4.0
#: Vectors of one bucket that a task compares at most (times two).
BLOCK = 1024
#: Runs up to this length are compared together, by offset.
SHORT = 12
KEY_SEED, SKETCH_SEED = 20240521, 20240522


def isometry(dim: int, bits: int, seed: int) -> np.ndarray:
    """A random (bits x dim) matrix with orthonormal columns, or orthonormal rows if bits < dim."""
    rng = np.random.default_rng(seed)
    width = max(bits, dim)
    q, r = np.linalg.qr(rng.standard_normal((width, dim)))
    return (q * np.sign(np.diag(r)))[:bits]


def sketch_bits(dim: int) -> int:
    """Dimensions of the sketch: the vector's own, 64 at least, in whole bytes."""
    return max(64, -(-dim // 8) * 8)


def usable(vector: Column) -> Column:
    """Whether a vector is there, finite in every component and not zero."""
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_vectors(cells: pa.ListArray, dim: int) -> np.ndarray:
    raw = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cells), dim)
    # Scaled first, so that very large and very small components do not overflow.
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


class Sketches:
    """Codes, factors and four-bit turned vectors of a batch, as arrays."""

    def __init__(self, signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, step: np.ndarray):
        bits = signs.shape[1]
        self.signs, self.turned = signs / np.sqrt(bits), turned
        self.factor = np.maximum(factor, 1e-6)
        # The sampling error of the code, and the rounding of the other side.
        self.own_slack = EPSILON * np.sqrt(np.maximum(0, 1 - self.factor**2)) / self.factor / np.sqrt(bits - 1)
        self.step_slack = EPSILON * step / np.sqrt(12)

    @staticmethod
    def pack(unit: np.ndarray, turn: np.ndarray) -> list[bytes]:
        """A sketch: factor, low end and step as float32, the code's bits, four bits a component."""
        turned = unit @ turn.T
        signs = turned >= 0
        factor = np.abs(turned).sum(axis=1) / np.sqrt(len(turn))
        low, high = turned.min(axis=1), turned.max(axis=1)
        step = np.maximum((high - low) / 15, 1e-12)
        level = np.rint((turned - low[:, None]) / step[:, None]).clip(0, 15).astype(np.uint8)
        head = np.stack([factor, low, step], axis=1).astype("<f4")
        return [h.tobytes() + s.tobytes() + n.tobytes() for h, s, n in zip(head, np.packbits(signs, axis=1), level[:, ::2] << 4 | level[:, 1::2])]

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> Sketches:
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
        bits = (raw.shape[1] - 12) * 8 // 5
        head = np.ascontiguousarray(raw[:, :12]).view("<f4").astype(np.float64)
        signs = np.unpackbits(raw[:, 12 : 12 + bits // 8], axis=1).astype(np.float32) * 2 - 1
        nibbles = raw[:, 12 + bits // 8 :]
        level = np.stack([nibbles >> 4, nibbles & 15], axis=2).reshape(len(blobs), bits)
        return cls(signs, head[:, 0], (level * head[:, 2:] + head[:, 1:2]).astype(np.float32), head[:, 2])

    def upper(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper confidence bounds of the cosines of the pairs (i, j)."""
        estimate = np.einsum("nd,nd->n", self.signs[i], self.turned[j]) / self.factor[i]
        return estimate + self.own_slack[i] + self.step_slack[j] / self.factor[i]

    def upper_block(self, rows: np.ndarray, s: int, e: int) -> np.ndarray:
        estimate = self.signs[rows] @ self.turned[s:e].T / self.factor[rows][:, None]
        return estimate + self.own_slack[rows][:, None] + self.step_slack[None, s:e] / self.factor[rows][:, None]


class Exact:
    """Cosines in double precision."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit

    def upper(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.einsum("nd,nd->n", self.unit[i], self.unit[j])

    def upper_block(self, rows: np.ndarray, s: int, e: int) -> np.ndarray:
        return self.unit[rows] @ self.unit[s:e].T


def pairs_of_runs(judge, threshold: float, bounds: np.ndarray, own: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of one run each whose judged value reaches the threshold.

    In a run of two blocks (``cross``) only pairs of different blocks count:
    pairs within a block belong to that block's own run.
    """
    sizes = np.diff(bounds)
    run_of = np.repeat(np.arange(len(sizes)), sizes)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    short = ((sizes <= SHORT) & ~cross[bounds[:-1]])[run_of]
    for step in range(1, min(SHORT, len(run_of))):
        i = np.flatnonzero(short[:-step] & (run_of[:-step] == run_of[step:]))
        for at in range(0, len(i), 16384):
            x = i[at : at + 16384]
            x = x[judge.upper(x, x + step) >= threshold]
            left.append(x)
            right.append(x + step)
    index = np.arange(len(run_of))
    for r in np.flatnonzero((sizes > 1) & ((sizes > SHORT) | cross[bounds[:-1]])).tolist():
        s, e = int(bounds[r]), int(bounds[r + 1])
        for at in range(s, e, 256):
            rows = index[at : min(e, at + 256)]
            hit = (judge.upper_block(rows, s, e) >= threshold) & (index[None, s:e] > rows[:, None])
            if cross[s]:
                hit &= own[rows][:, None] != own[s:e][None, :]
            i, j = np.nonzero(hit)
            left.append(rows[i])
            right.append(j + s)
    return np.concatenate(left), np.concatenate(right)


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (i, j): the links that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b = [], []
    for x, y in zip(i.tolist(), j.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[ry] = rx
            a.append(x)
            b.append(y)
    return np.array(a, np.int64), np.array(b, np.int64)


def by_runs(work):
    """mapInArrow over rows sorted by (dim, t, key, p, q, ...): ``work`` gets batches of whole runs of one dim.

    Runs may cross batch edges; a run has two blocks at most, so what is held back is bounded.
    """

    def split(rows: pa.RecordBatch, last: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
        keys = [rows.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        changed = np.zeros(max(0, rows.num_rows - 1), bool)
        for k in keys:
            changed |= k[1:] != k[:-1]
        bounds = np.concatenate(([0], np.flatnonzero(changed) + 1, [rows.num_rows]))
        cut = rows.num_rows if last else int(bounds[-2])
        out: list[pa.RecordBatch] = []
        for dim in np.unique(keys[0][:cut]).tolist():
            lo, hi = np.searchsorted(keys[0][:cut], [dim, dim + 1])
            own_bounds = bounds[(bounds >= lo) & (bounds <= hi)] - lo
            if len(own_bounds) > 1 and np.diff(own_bounds).max() > 1:
                out += work(rows.slice(lo, hi - lo), dim, own_bounds)
        return out, rows.slice(cut) if cut < rows.num_rows else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for part in parts:
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            if part.num_rows:
                out, held = split(part, last=False)
                yield from out
        if held is not None:
            yield from split(held, last=True)[0]

    return run


def _numbers(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [rows.column(rows.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def key_plan(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(signs of a key, tables) for so many vectors."""
    bits = min(max(KEY_BITS[0], math.ceil(math.log2(max(2, vectors))) - SPARE), KEY_BITS[1])
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log1p(-meets)) if meets < 1 else 1


def _codes(key_bits: int, tables: int):
    """mapInArrow, (cid, v) to (cid, keys, sketch): the signs of the first rotation, as numbers, are the keys."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        weights = (1 << np.arange(key_bits)).astype(np.float64)
        for part in parts:
            lengths = part.column(1).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == dim))
                if dim not in turns:
                    turns[dim] = isometry(dim, key_bits * tables, KEY_SEED), isometry(dim, sketch_bits(dim), SKETCH_SEED)
                unit = unit_vectors(part.column(1).take(at), dim)
                signs = (unit @ turns[dim][0].T >= 0).reshape(len(unit), tables, key_bits)
                keys = (signs @ weights).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), flat, pa.array(Sketches.pack(unit, turns[dim][1]), pa.binary())], names=["cid", "keys", "sketch"])

    return run


_PLACE = ["dim", "t", "key", "p", "q", "own", "cid"]
_PLACES = "dim int, t int, key int, p int, q int, own int, cid long"


def _still_open(threshold: float):
    """First pass: the members of each run that have a pair whose upper bound reaches the threshold."""

    def work(rows: pa.RecordBatch, dim: int, bounds: np.ndarray) -> list[pa.RecordBatch]:
        p, q, own = _numbers(rows, "p", "q", "own")
        judge = Sketches.unpack(rows.column(rows.schema.get_field_index("sketch")).to_pylist())
        i, j = pairs_of_runs(judge, threshold, bounds, own, p != q)
        at = np.unique(np.concatenate([i, j]))
        return [rows.select(_PLACE).take(pa.array(at))] if len(at) else []

    return by_runs(work)


def _links(threshold: float):
    """Second pass: rows (a, b, n); b null: a's links, n null: a link of the forest."""
    names = ["a", "b", "n"]

    def work(rows: pa.RecordBatch, dim: int, bounds: np.ndarray) -> list[pa.RecordBatch]:
        t, p, q, own, cid, copies = _numbers(rows, "t", "p", "q", "own", "cid", "copies")
        unit = unit_vectors(rows.column(rows.schema.get_field_index("v")), dim)
        keys = rows.column(rows.schema.get_field_index("keys")).flatten().to_numpy(zero_copy_only=False).reshape(len(cid), -1)
        # The block product may round otherwise than the sum of a pair, so pairs near the threshold are summed again.
        i, j = pairs_of_runs(Exact(unit), threshold - 1e-9, bounds, own, p != q)
        sure = np.einsum("nd,nd->n", unit[i], unit[j]) >= threshold
        i, j = i[sure], j[sure]
        fresh = (keys[i] == keys[j]).argmax(axis=1) == t[i]
        i, j = i[fresh], j[fresh]
        if not len(i):
            return []
        total = np.zeros(len(cid), np.int64)
        np.add.at(total, i, copies[j])
        np.add.at(total, j, copies[i])
        got = np.flatnonzero(total)
        a, b = forest(i, j)
        none = lambda k: pa.nulls(k, pa.int64())
        return [
            pa.RecordBatch.from_arrays([pa.array(cid[got]), none(len(got)), pa.array(total[got])], names=names),
            pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(cid[b]), none(len(a))], names=names),
        ]

    return by_runs(work)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    n_links counts the other rows at a cosine of at least ``threshold``, copies
    among them; component_id is the smallest vec_id that links reach. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. A null vec_id is no smallest id: such a row has its
    component's id (null if it has none) and is not kept. Repeated rows link like copies.
    Other columns are ignored.
    """
    rows = checkpointed(pick(vectors, vec_id="vec_id", v="embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(F.col("v")), F.col("v")).alias("v")))
    classes = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    key_bits, tables = key_plan(classes.count(), threshold)
    coded = checkpointed(classes.select("cid", "v").mapInArrow(_codes(key_bits, tables), "cid long, keys array<int>, sketch binary").join(classes.select("cid", "dim", "copies"), "cid"))
    keyed = coded.select("dim", F.posexplode("keys").alias("t", "key"))
    hot = keyed.groupBy("dim", "t", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = hot.select("dim", "t", "key", F.ceil(F.col("n") / F.lit(block // 2)).cast("int").alias("blocks"))
    placed = coded.select("cid", "dim", "sketch", F.posexplode("keys").alias("t", "key")).join(hot, ["dim", "t", "key"], "left")
    placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("dim", "t", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "cid", "sketch")
    run = ["dim", "t", "key", "p", "q"]
    open_ = placed.repartition(*run).sortWithinPartitions(*run, "cid").mapInArrow(_still_open(threshold), _PLACES)
    fetched = checkpointed(open_).join(classes.select("cid", "v", "copies"), "cid").join(coded.select("cid", "keys"), "cid")
    found = fetched.select(*_PLACE, "copies", "v", "keys").repartition(*run).sortWithinPartitions(*run, "cid")
    found = checkpointed(found.mapInArrow(_links(threshold), "a long, b long, n long"))
    counts = found.where(F.col("n").isNotNull()).groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    linked = components(found.where(F.col("b").isNotNull()).select("a", "b")).select(F.col("node").alias("cid"), "root")
    roots = linked.join(classes, "cid").groupBy("root").agg(F.min("least").alias("component"))
    of_class = linked.join(roots, "root").select("cid", "component")
    of_class = classes.join(counts, "cid", "left").join(of_class, "cid", "left")
    of_class = of_class.select(F.col("v").alias("cv"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    # Cut off, so that both sides are shuffled for this join alone and AQE may split a hot vector.
    of_class = checkpointed(of_class)
    joined = rows.join(of_class, rows["v"] == of_class["cv"], "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
