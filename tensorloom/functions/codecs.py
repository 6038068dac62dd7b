"""Byte-stream codecs and their registry, as Arrow-batched column functions.

A codec is a pair of byte functions. Registered ones: none, zlib (level 1), lzma
(preset 6), lzma_fast (preset 3), rans and huffman. ``register`` adds others; the
name is stored with every block, so a reader always knows how to decode it.
"""

from __future__ import annotations

import heapq
import lzma
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

# Fixed values of the rANS stream: lower bound of a state, bits of the scale, most lanes.
STATE_LOW = 1 << 23
SCALE_BITS = 15
SCALE = 1 << SCALE_BITS
MAX_LANES = 4096


def frequencies(counts: np.ndarray) -> np.ndarray:
    """256 frequencies that add up to SCALE; the same rule as the frequency table in SQL."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        out = np.zeros(256, np.int64)
        out[0] = SCALE
        return out
    out = np.where(counts > 0, np.maximum(1, counts * SCALE // total), 0)
    gap = SCALE - int(out.sum())
    if gap > 0:
        out[np.lexsort((np.arange(256), -counts))[:gap]] += 1
    elif gap < 0:
        order = np.lexsort((np.arange(256), -out))
        spare = out[order] - 1
        # Round r takes 1 from every symbol that can still give; find how many full rounds fit.
        rounds = 0
        while (n := int((spare > rounds).sum())) and n <= -gap:
            gap += n
            rounds += 1
        given = np.minimum(np.maximum(spare, 0), rounds)
        given[np.flatnonzero(spare > rounds)[: -gap]] += 1
        out[order] -= given
    return out


def _tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.concatenate(([0], np.cumsum(freq)[:-1]))
    return start, np.repeat(np.arange(256), freq)


def rans_encode(data: bytes) -> bytes:
    """Interleaved static rANS over bytes.

    Position p belongs to lane p mod lanes. Columns are coded from the last to
    the first; a column's emitted bytes are kept as one piece, first every
    emitting lane's byte that is read first, then the second bytes, and pieces are
    stored in column order.
    """
    symbols = np.frombuffer(data, np.uint8)
    freq = frequencies(np.bincount(symbols, minlength=256))
    head = struct.pack("<I", len(data)) + freq.astype("<u2").tobytes()
    if not len(data):
        return head + struct.pack("<III", 0, 0, 0)
    start, _ = _tables(freq)
    lanes = min(MAX_LANES, len(symbols))
    columns = -(-len(symbols) // lanes)
    state = np.full(lanes, STATE_LOW, np.int64)
    pieces: list[np.ndarray] = []
    for column in reversed(range(columns)):
        s = symbols[column * lanes : (column + 1) * lanes]
        f, x = freq[s], state[: len(s)]
        top = (STATE_LOW >> SCALE_BITS << 8) * f
        out = (x >= top).astype(np.int64) + (x >> 8 >= top)
        some, two = out > 0, out > 1
        read_first = x[some] >> 8 * (out[some] - 1)
        pieces.append(np.concatenate((read_first, x[two])).astype(np.uint8))
        x = x >> 8 * out
        state[: len(s)] = (x // f << SCALE_BITS) + x % f + start[s]
    body = np.concatenate(pieces[::-1])
    return head + struct.pack("<III", lanes, columns, len(body)) + state.astype("<u4").tobytes() + body.tobytes()


def rans_decode(blob: bytes) -> bytes:
    """The inverse of :func:`rans_encode`; a stream cut short raises ValueError."""
    if len(blob) < 528:
        raise ValueError("rANS stream: header cut short")
    (n,) = struct.unpack_from("<I", blob)
    freq = np.frombuffer(blob, "<u2", 256, 4).astype(np.int64)
    lanes, columns, size = struct.unpack_from("<III", blob, 516)
    if not n:
        return b""
    if len(blob) < 528 + 4 * lanes + size or int(freq.sum()) != SCALE:
        raise ValueError("rANS stream: damaged or cut short")
    start, symbol_of = _tables(freq)
    state = np.frombuffer(blob, "<u4", lanes, 528).astype(np.int64)
    body = np.frombuffer(blob, np.uint8, size, 528 + 4 * lanes).astype(np.int64)
    out = np.empty(n, np.uint8)
    at = 0
    for column in range(columns):
        width = min(lanes, n - column * lanes)
        x = state[:width]
        slot = x & (SCALE - 1)
        s = symbol_of[slot]
        out[column * lanes : column * lanes + width] = s
        x = freq[s] * (x >> SCALE_BITS) + slot - start[s]
        while len(low := np.flatnonzero(x < STATE_LOW)) and at < size:
            x[low] = x[low] << 8 | body[at : at + len(low)]
            at += len(low)
        state[:width] = x
    return out.tobytes()


def huffman_lengths(counts: np.ndarray) -> np.ndarray:
    """Code lengths of all 256 symbols; absent symbols count as seen once, ties to the smaller symbol."""
    heap = [(max(1, int(c)), s, (s,)) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    lengths = np.zeros(256, np.int64)
    order = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        members = a[2] + b[2]
        lengths[list(members)] += 1
        heapq.heappush(heap, (a[0] + b[0], order, members))
        order += 1
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the lengths: shorter codes first, then by symbol."""
    codes = np.zeros(256, np.int64)
    code = last = 0
    for s in np.lexsort((np.arange(256), lengths)).tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def huffman_table(counts: np.ndarray) -> bytes:
    """The table of 1,280 bytes: for each symbol its code (u32) and its length (u8)."""
    lengths = huffman_lengths(counts)
    return b"".join(struct.pack("<IB", int(c) & 0xFFFFFFFF, int(n)) for c, n in zip(canonical_codes(lengths), lengths))


def huffman_encode(data: bytes) -> bytes:
    """u32 length, 256 code lengths, then the bits, most significant first."""
    symbols = np.frombuffer(data, np.uint8)
    lengths = huffman_lengths(np.bincount(symbols, minlength=256))
    codes = canonical_codes(lengths)
    width = int(lengths.max())
    shifts = np.arange(width)
    bits: list[np.ndarray] = []
    for at in range(0, len(symbols), 1 << 16):
        s = symbols[at : at + (1 << 16)]
        grid = codes[s][:, None] >> np.maximum(lengths[s][:, None] - 1 - shifts, 0) & 1
        bits.append(grid[shifts < lengths[s][:, None]].astype(np.uint8))
    packed = np.packbits(np.concatenate(bits)).tobytes() if bits else b""
    return struct.pack("<I", len(data)) + lengths.astype(np.uint8).tobytes() + packed


def huffman_decode(blob: bytes) -> bytes:
    (n,) = struct.unpack_from("<I", blob)
    lengths = np.frombuffer(blob, np.uint8, 256, 4).astype(np.int64)
    table = {(int(n_), int(c)): s for s, (n_, c) in enumerate(zip(lengths, canonical_codes(lengths)))}
    out = bytearray()
    code = size = 0
    for bit in np.unpackbits(np.frombuffer(blob, np.uint8, offset=260)).tolist():
        if len(out) == n:
            break
        code, size = code << 1 | bit, size + 1
        symbol = table.get((size, code))
        if symbol is not None:
            out.append(symbol)
            code = size = 0
    if len(out) != n:
        raise ValueError("Huffman stream: cut short")
    return bytes(out)


Codec = tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]
CODECS: dict[str, Codec] = {
    "none": (bytes, bytes),
    "zlib": (lambda b: zlib.compress(b, 1), zlib.decompress),
    "lzma": (lambda b: lzma.compress(b, preset=6), lzma.decompress),
    "lzma_fast": (lambda b: lzma.compress(b, preset=3), lzma.decompress),
    "lzma_probe": (lambda b: lzma.compress(b, preset=1), lzma.decompress),
    "rans": (rans_encode, rans_decode),
    "huffman": (huffman_encode, huffman_decode),
}
#: The codec of each stream by backend; signs are always zlib.
BACKENDS = {"lzma": {"sign": "zlib", "exp": "lzma", "mant": "lzma_fast"}, "rans": {"sign": "zlib", "exp": "rans", "mant": "rans"}, "none": {"sign": "zlib", "exp": "none", "mant": "none"}}


def codec(name: str) -> Codec:
    if name not in CODECS:
        raise ValueError(f"unknown codec {name!r}; known: {', '.join(sorted(CODECS))}")
    return CODECS[name]


def register(name: str, encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes]) -> None:
    """Add a codec for this process's queries."""
    CODECS[name] = (encode, decode)


def _coder(side: int, names: dict[str, Codec] | None = None):
    """An Arrow function (blob, codec) that encodes (side 0) or decodes (side 1) by the codec's name.

    The registry of the moment travels with the function, so codecs that were
    added on the driver are known on the executors.
    """
    known = dict(names or CODECS)

    @arrow_udf(BinaryType())
    def run(blob: pa.Array, name: pa.Array) -> pa.Array:
        return pa.array([None if b is None else known[n][side](b) for b, n in zip(blob.to_pylist(), name.to_pylist())], pa.binary())

    return run


def compress(blob: Column, name: str) -> Column:
    """The blob coded by one codec; null stays null."""
    return _coder(0, {name: codec(name)})(blob, F.lit(name))


def compress_by(blob, name) -> Column:
    """The blob coded by the codec that the second column names."""
    return _coder(0)(blob, name)


def decompress_by(blob, name) -> Column:
    """The inverse of :func:`compress_by`."""
    return _coder(1)(blob, name)


def register_sql(spark: SparkSession) -> None:
    """``tl_compress(blob, codec)`` and ``tl_decompress(blob, codec)`` for SQL text."""
    spark.udf.register("tl_compress", _coder(0))
    spark.udf.register("tl_decompress", _coder(1))
