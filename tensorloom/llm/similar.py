"""Near-duplicate documents by word shingles: SimHash with covering masks for candidates, exact Jaccard for links.

A text stands for the set of its five-word shingles. Its sketch begins with :data:`SIGHT` SimHashes of 64 bits. Of each some bits,
two for a bit of a band's key, are searched by the covering masks of ``simhash``: a pair whose 4 x 32 bits (4 x 52 at a billion
rows) differ in 15 at most differs in :data:`simhash.RADIUS` at most in one of the four, whose masks miss no such pair.

At a Jaccard of 0.8 the sketches of two texts differ in about 15 % of their bits, often more than the masks cover, so the bits are
cut into bands besides: such a pair agrees on some band with probability :data:`RECALL`, closer pairs more
surely. A band's bits grow with the logarithm of the rows, so that unrelated texts of a bucket do not
grow in number, and the bands with them to hold that probability: 40 bands of 16 bits up to a million rows, 213 of
26 at a billion. Pairs of a bucket whose first 256 bits differ in more than :attr:`Plan.far` (65 at 0.8; unrelated
texts: 128 on average, so their chance is below 1e-14) are no candidates.

Candidates' components are small; inside them all pairs are compared exactly, so a link
never rests on a sketch. Equal shingle sets are merged first. Large buckets and
components are cut into blocks as in ``simhash``: nothing is dropped, and tasks emit forests.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed, fresh, small, whole_texts
from tensorloom.llm.components import components
from tensorloom.llm.simhash import BITS, RADIUS, masks

WORDS = 5
SIMILARITY = 0.8
#: Probability with which a pair at the similarity meets in a band.
RECALL = 0.95
#: Bits of a band: the binary logarithm of the rows less SPARE, within these bounds.
BAND_BITS, SPARE = (16, 31), 4
#: Longs of a sketch that travel with each key.
SIGHT = 4
#: Standard deviations above the mean difference of pairs at the similarity from which on a pair is no candidate.
DEVIATIONS = 4.6
#: Labels that the covering masks give to bits in turn; label 0 is in no mask.
LABELS = 1 << (RADIUS + 1)
#: Members of a bucket, and of a candidate component, that a task compares at most (times two).
BLOCK, EXACT_BLOCK = 2048, 256
#: Runs up to this size are compared at once, all pairs; longer ones yield a forest.
SMALL = 16


class Plan(NamedTuple):
    """Bits of a band, bands, and the bits of :data:`SIGHT` longs in which a candidate pair differs at most."""

    bits: int
    bands: int
    far: int

    @property
    def salts(self) -> np.ndarray:
        """One for each long of a sketch."""
        longs = max(SIGHT, -(-self.bits * self.bands // 64))
        return np.array([(k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) for k in range(longs)], np.uint64)

    @property
    def searched(self) -> list[int]:
        """The bits of a long that the covering masks search. Labels of odd weight come first, so that masks keep about half of them each."""
        order = sorted((i for i in range(BITS) if i % LABELS), key=lambda i: (i // LABELS, (i % LABELS).bit_count() % 2 == 0, i))
        return order[: 2 * self.bits]

    @property
    def masks(self) -> list[int]:
        """The covering masks on these bits, as signed longs."""
        kept = sum(1 << i for i in self.searched)
        return [m - (1 << 64) if m >> 63 else m for m in (m & kept for m in masks(RADIUS))]


def band_plan(rows: int, similarity: float = SIMILARITY) -> Plan:
    """The plan for so many rows. Of the pairs at a Jaccard, sets of equal size have the least cosine."""
    bits = min(max(BAND_BITS[0], math.ceil(math.log2(max(2, rows))) - SPARE), BAND_BITS[1])
    apart = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    meets = (1 - apart) ** bits
    bands = math.ceil(math.log(1 - RECALL) / math.log1p(-meets)) if meets < 1 else 1
    n = 64 * SIGHT
    return Plan(bits, bands, round(n * apart + DEVIATIONS * math.sqrt(n * apart * (1 - apart))))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles; a shorter text is one shingle, one without words is hash 0."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(1, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(tokens[i : i + words]), 42) for i in range(max(1, len(tokens) - words + 1))], np.uint64))


def sketch(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The bits of a shingle set, 64 a salt, as 0 and 1."""
    counts = np.zeros(64 * len(salts), np.int64)
    for at in range(0, len(hashes), 2048):
        x = hashes[at : at + 2048, None] ^ salts[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (counts * 2 > len(hashes)).astype(np.uint8)


_SIGHT = [f"s{k}" for k in range(SIGHT)]


def _sketched(plan: Plan):
    """mapInArrow, (doc_id, a, b, text) to the row's name, the hash of its shingle set, and its sketch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts, weights = plan.salts, 1 << np.arange(plan.bits, dtype=np.int64)
        for part in parts:
            sets = [shingles(t.as_py()) for t in part.column(3)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            words, keys = np.empty((len(sets), SIGHT), np.int64), np.empty((len(sets), plan.bands), np.int32)
            for i, held in enumerate(sets):
                bits = sketch(held, salts)
                words[i] = np.packbits(bits[: 64 * SIGHT], bitorder="little").view(np.int64)
                keys[i] = bits[: plan.bits * plan.bands].reshape(plan.bands, plan.bits) @ weights
            listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), plan.bands).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(node), *[pa.array(words[:, k].copy()) for k in range(SIGHT)], listed], names=["doc_id", "a", "b", "node", *_SIGHT, "keys"])

    return run


def _shingled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        sets = [shingles(t.as_py()).view(np.int64) for t in part.column(2)]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["root", "node", "shingles"])


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Spanning forest over 0..n-1; ``near(i, rest)`` says which of rest link with i."""
    rest = np.arange(n)
    a: list[int] = []
    b: list[int] = []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            found, rest = rest[hit].tolist(), rest[~hit]
            a += [i] * len(found)
            b += found
            queue += found
    return a, b


def _by_runs(n_keys: int, link: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """mapInArrow over sorted rows: ``link(rows, bounds)`` over whole runs of equal keys; a run may cross batches."""

    def out(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        a, b = link(rows, bounds)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for part in parts:
            if not part.num_rows:
                continue
            rows = pa.Table.from_batches([part])
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            keys = [held.column(k).to_numpy() for k in range(n_keys)]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            if len(new):
                yield out(held.slice(0, int(new[-1])), np.concatenate(([0], new)))
                held = held.slice(int(new[-1]))
        if held is not None and held.num_rows:
            yield out(held, np.array([0, held.num_rows]))

    return run


def _sketch_links(far: int):
    def link(rows: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, *sight = (rows.column(k).to_numpy() for k in ("node", *_SIGHT))
        apart = lambda i, j: sum(np.bitwise_count((s[i] ^ s[j]).view(np.uint64)).astype(np.int64) for s in sight)
        sizes = np.diff(bounds)
        run = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat(sizes <= SMALL, sizes)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in range(1, SMALL):
            i = np.flatnonzero((run[d:] == run[:-d]) & small[d:]) if len(run) > d else np.empty(0, np.int64)
            if not len(i):
                break
            i = i[apart(i, i + d) <= far]
            a.append(node[i])
            b.append(node[i + d])
        for s, e in ((bounds[k], bounds[k + 1]) for k in np.flatnonzero(sizes > SMALL)):
            x, y = _forest(e - s, lambda i, rest: apart(np.full(len(rest), s + i), s + rest) <= far)
            a.append(node[s + np.array(x, np.int64)])
            b.append(node[s + np.array(y, np.int64)])
        return np.concatenate(a), np.concatenate(b)

    return link


def _exact_links(similarity: float):
    def link(rows: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = rows.column("node").to_numpy()
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(bounds[:-1], bounds[1:]):
            sets = rows.column("shingles").slice(s, e - s).combine_chunks()
            sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
            sizes = np.diff(sets.offsets.to_numpy())
            names, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
            starts = np.concatenate(([0], np.cumsum(sizes)))

            def near(i: int, rest: np.ndarray) -> np.ndarray:
                held = np.zeros(len(names), np.int64)
                held[codes[starts[i] : starts[i + 1]]] = 1
                common = np.add.reduceat(held[codes], starts[:-1])[rest]
                return common >= similarity * (sizes[i] + sizes[rest] - common) - 1e-9

            x, y = _forest(e - s, near)
            a.append(node[s + np.array(x, np.int64)])
            b.append(node[s + np.array(y, np.int64)])
        return np.concatenate(a), np.concatenate(b)

    return link


def _linked(rows: DataFrame, keys: list[str], block: int, link) -> DataFrame:
    """Links ``(a, b)`` inside groups of ``rows(keys.., node, ..)``; larger groups as pairs of blocks."""
    hot = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = hot.select(*keys, F.ceil(F.col("n") / F.lit(block // 2)).cast("int").alias("blocks"))
    # Only groups above a block's size are listed, at most rows / block of them.
    placed = rows.join(small(checkpointed(hot), F.lit(32)), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = [c for c in rows.columns if c not in keys]
    by = [*keys, "p", "q"]
    placed = placed.select(*keys, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), *rest)
    return placed.repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(_by_runs(len(by), link), "a long, b long").distinct()


def _keyed(nodes: DataFrame, plan: Plan) -> DataFrame:
    """``(node, sights.., t, key)``: a row for each band and for each covering mask of each sight."""
    banded = nodes.select("node", *_SIGHT, F.posexplode("keys").alias("t", "key")).withColumn("key", F.col("key").cast("long"))
    tables = [F.col(s).bitwiseAND(F.lit(m)).alias("key") for s in _SIGHT for m in plan.masks]
    covered = nodes.select("node", *_SIGHT, F.explode(F.array(*[F.struct(F.lit(plan.bands + t).alias("t"), key) for t, key in enumerate(tables)])).alias("k"))
    return banded.unionByName(covered.select("node", *_SIGHT, "k.t", "k.key"))


def groups(rows: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Of ``rows(doc_id, a, b, text)``, where (doc_id, a, b) name a row and equal rows have equal names:

    ``(doc_id, a, b, node)`` for each row, and ``(node, doc_id, a, b, root)`` for each shingle set with the least row that
    has it: equal roots, connected by pairs of at least the similarity.
    """
    rows = whole_texts(rows)
    plan = band_plan(rows.count(), similarity)
    kind = f"doc_id long, a long, b long, node long, {', '.join(f'{s} long' for s in _SIGHT)}, keys array<int>"
    marked = checkpointed(rows.select("doc_id", "a", "b", "text").mapInArrow(_sketched(plan), kind))
    nodes = checkpointed(marked.groupBy("node").agg(F.min(F.struct("doc_id", "a", "b", *_SIGHT, "keys")).alias("m")).select("node", "m.*"))
    maybe = components(_linked(_keyed(nodes, plan), ["t", "key"], BLOCK, _sketch_links(plan.far)))
    open_ = checkpointed(maybe.join(nodes.select("node", "doc_id", "a", "b"), "node"))
    # Texts leave their place only for candidates; a name that several equal rows have counts once.
    met = rows.join(small(open_, F.lit(40)), ["doc_id", "a", "b"]).select("root", "node", "text").dropDuplicates(["root", "node"])
    sets = checkpointed(met.mapInArrow(_shingled, "root long, node long, shingles array<long>"))
    linked = components(_linked(sets, ["root"], EXACT_BLOCK, _exact_links(similarity)))
    return marked.select("doc_id", "a", "b", "node"), nodes.select("node", "doc_id", "a", "b").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicate texts: one with its least doc_id. Returns the columns of ``docs``.

    Rows are told apart by all their columns: rows that repeat a doc_id with texts unlike each other all
    stay. Rows without a doc_id stay. An empty table gives an empty result.
    """
    names, (a, b) = docs.columns, fresh(docs, "__a", "__b")
    columns = [F.col(f"`{n}`") for n in names]
    # 128 bits name a row, so that texts need not travel. The hash passes over nulls, so these are told apart first.
    nulls = F.concat(*[c.isNull().cast("string") for c in columns])
    named = docs.withColumn(a, F.xxhash64(nulls, *columns)).withColumn(b, F.xxhash64(F.lit(1), nulls, *columns))
    known = named.where(F.col("doc_id").isNotNull())
    rows = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(a).alias("a"), F.col(b).alias("b"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked, found = groups(rows, similarity)
    kept = checkpointed(found.groupBy("root").agg(F.min(F.struct("doc_id", "a", "b")).alias("m")).select("m.a", "m.b"))
    repeated = marked.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    once, many = kept.join(repeated, ["a", "b"], "left_anti"), checkpointed(kept.join(repeated, ["a", "b"], "left_semi"))

    def those(of: DataFrame) -> DataFrame:
        return known.join(small(of.select(F.col("a").alias(a), F.col("b").alias(b)), F.lit(16)), [a, b], "left_semi")

    out = those(checkpointed(once)).select(*columns)
    if not many.isEmpty():
        out = out.unionByName(those(many).dropDuplicates([a, b]).select(*columns))
    return out.unionByName(docs.where(F.col("doc_id").isNull()))
