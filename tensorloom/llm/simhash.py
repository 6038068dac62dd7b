"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprint: 64 bits by majority over the XXH64 hashes of word shingles.
Search: every bit position gets a label in GF(2)^(r+1), the label of bit i being
i mod 2^(r+1). For each non-zero vector v of that space a table keeps the bits
whose label has odd inner product with v. At most r differing bits span at most
r dimensions, so some v is orthogonal to all of their labels and that table's
key does not see the difference: every pair within radius r meets in one of the
2^(r+1) - 1 tables, with about half of the bits as key. No pair is missed.

Equal fingerprints are merged before the search. A bucket of more than
``block`` fingerprints is cut into blocks and each pair of blocks is a task of
its own, so no task holds more than two blocks and nothing is dropped; each
task emits a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed, pick, whole_texts
from tensorloom.llm.components import components

BITS = 64
RADIUS = 3
#: Fingerprints of one bucket that a task compares with each other at most (times two).
BLOCK = 2048
#: Shingles hashed at once; bounds memory for very long texts.
CHUNK = 1 << 16


def masks(radius: int = RADIUS) -> list[int]:
    """Bit masks of the covering family, as unsigned 64-bit integers."""
    labels = 1 << (radius + 1)
    return [sum(1 << i for i in range(BITS) if ((i % labels) & v).bit_count() % 2) for v in range(1, labels)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of one whole text; no words: 0."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(b" ".join(tokens), 42)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, fp as a signed long. A null text counts as empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.array([fingerprint(t.as_py(), words) for t in part.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = whole_texts(pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string")))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (indices from, to) of the links within ``radius`` bits."""
    n = len(fps)
    if n == 2:
        linked = int(fps[0] ^ fps[1]).bit_count() <= radius
        return (np.zeros(1, np.int64), np.ones(1, np.int64)) if linked else (np.empty(0, np.int64),) * 2
    rest = np.arange(n)
    parents, children = [], []
    while len(rest):
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[queue.pop()]) <= radius
            found, rest = rest[near], rest[~near]
            if len(found):
                parents.append(np.full(len(found), root))
                children.append(found)
                queue.extend(found.tolist())
    return (np.concatenate(parents), np.concatenate(children)) if parents else (np.empty(0, np.int64),) * 2


def _bucket_links(radius: int):
    """mapInArrow over rows sorted by (t, key, p, q): links inside each run.

    Runs may cross batch edges. A run has at most two blocks of rows, so what is
    held back is bounded.
    """
    names = ["a", "b"]

    def links(columns: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray]]:
        t, key, p, q, fp = columns
        n = len(t)
        new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
        bounds = np.concatenate(([0], new, [n])) if n else np.zeros(1, np.int64)
        cut = n if last else int(bounds[-2]) if len(bounds) > 1 else 0
        runs = [(s, e) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if e - s > 1 and e <= cut]
        a, b = [], []
        for s, e in runs:
            x, y = _forest(fp[s:e], radius)
            if len(x):
                a.append(fp[s:e][x])
                b.append(fp[s:e][y])
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=names) if a else None
        return out, [c[cut:] for c in columns]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for part in parts:
            columns = [c.to_numpy(zero_copy_only=False) for c in part.columns]
            columns[4] = columns[4].view(np.uint64)
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            out, held = links(held, last=False)
            if out is not None:
                yield out
        if held is not None:
            out, _ = links(held, last=True)
            if out is not None:
                yield out

    return run


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` among distinct fingerprints ``(fp)`` that connect all pairs within the radius."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])
    keyed = distinct.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    hot = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = hot.select("t", "key", F.ceil(F.col("n") / F.lit(block // 2)).cast("int").alias("blocks"))
    placed = keyed.join(hot, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("t", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    # Over the rows' own hash the tasks get even shares; a run is one bucket or one pair of blocks.
    placed = placed.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q", "fp")
    return placed.mapInArrow(_bucket_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Null and empty texts have fingerprint zero and link with each other and with
    whatever lies within the radius. Repeated rows each get a row. A row whose
    doc_id is null gets its component's id; a component with no other doc_id has
    a null one. An empty table gives an empty result. Other columns are ignored.
    """
    marked = checkpointed(fingerprints(docs, words))
    by_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(by_fp.select("fp"), radius, block))
    linked = linked.select(F.col("node").alias("fp"), "root")
    roots = by_fp.join(linked, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = linked.join(roots, "root").select("fp", "component_id")
    of_fp = by_fp.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # Cut off, so that both sides are shuffled for this join alone and AQE may split a hot fingerprint.
    return marked.join(checkpointed(of_fp), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
