"""Kernels without Spark: streams, codecs, container pieces, factorisation."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tensorloom.functions import codecs, streams
from tensorloom.operators import factor
from tensorloom.sources import container

EDGES = np.array([0x00000000, 0x80000000, 0x7F800000, 0xFF800000, 0x7FC00001, 0x7F800001, 0xFFFFFFFF, 1, 0x007FFFFF, 0x00800000, 0x7F7FFFFF], np.uint32)


@pytest.mark.parametrize("kind", [np.float32, np.float16, np.uint16, np.uint8])
def test_split_merge_every_pattern(kind):
    size = np.dtype(kind).itemsize
    if size == 4:
        raw = np.concatenate([EDGES, np.random.default_rng(0).integers(0, 2**32, 5000, dtype=np.uint32)])
    else:
        raw = np.arange(2 ** (8 * size), dtype=np.uint32).astype({2: np.uint16, 1: np.uint8}[size])
    array = raw.view(kind)
    back = streams.merge(streams.split(array))
    assert back.dtype == array.dtype and back.tobytes() == array.tobytes()


@pytest.mark.parametrize("shape", [(), (0,), (0, 3), (7,), (3, 5), (2, 3, 4), (2, 2, 2, 2), (1, 2, 1, 2, 3), (1, 1, 2, 1, 2, 3)])
def test_shapes_survive(shape):
    array = np.random.default_rng(1).standard_normal(shape).astype(np.float32)
    back = streams.merge(streams.split(array))
    assert back.shape == shape and np.array_equal(back, array)


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
@pytest.mark.parametrize("data", [b"", b"x", b"a" * 5000, bytes(range(256)) * 40, bytes(4095), bytes([1, 2] * 2048), bytes([3] * 4097), b"skew" + b"\0" * 100_000])
def test_codecs_give_the_bytes_back(name, data):
    encode, decode = codecs.codec(name)
    assert decode(encode(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_rans_any_bytes(data):
    assert codecs.rans_decode(codecs.rans_encode(data)) == data


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(1, 3), st.integers(1, 10**7)), min_size=256, max_size=256))
def test_frequencies_add_up(counts):
    counts = np.array(counts)
    freq = codecs.frequencies(counts)
    assert freq.sum() == codecs.SCALE
    if counts.any():
        assert ((freq >= 1) == (counts > 0)).all()


def brute_frequencies(counts):
    """The rule, one step at a time."""
    total, scale = int(counts.sum()), codecs.SCALE
    freq = [max(1, int(c) * scale // total) if c else 0 for c in counts]
    gap = scale - sum(freq)
    if gap > 0:
        for s in sorted(range(256), key=lambda s: (-counts[s], s))[:gap]:
            freq[s] += 1
    order = sorted(range(256), key=lambda s: (-freq[s], s))
    while gap < 0:
        for s in order:
            if gap < 0 and freq[s] > 1:
                freq[s] -= 1
                gap += 1
    return freq


@pytest.mark.parametrize("seed", range(20))
def test_frequencies_match_the_steps(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 4, 256) if seed % 3 == 0 else (rng.pareto(0.3, 256) * 5).clip(0, 1e9).astype(np.int64) + 1
    counts[0] += 1
    assert codecs.frequencies(counts).tolist() == brute_frequencies(counts)


def test_damaged_streams_raise():
    blob = codecs.rans_encode(b"hello" * 100)
    for cut in (10, 520, len(blob) - 1):
        with pytest.raises(ValueError):
            codecs.rans_decode(blob[:cut])
    with pytest.raises(ValueError):
        codecs.codec("nope")


def test_huffman_is_a_prefix_code():
    lengths = codecs.huffman_lengths(np.random.default_rng(3).integers(0, 1000, 256))
    assert sum(2.0 ** -lengths) == 1.0


def test_svd_and_kmeans_invariants():
    rng = np.random.default_rng(4)
    for shape in ((40, 30), (300, 400)):
        w = (rng.standard_normal((shape[0], 8)) @ rng.standard_normal((8, shape[1]))).astype(np.float32)
        u, s, vt = factor.truncated_svd(w, 10)
        assert np.allclose(u.T @ u, np.eye(10), atol=1e-6) and (np.diff(s) <= 1e-6).all()
        assert np.allclose((u * s) @ vt, w, atol=1e-2)
    assert len(factor.kmeans(np.repeat(np.eye(3), 5, axis=0), 8)) == 3
    assert factor.kmeans(rng.standard_normal((500, 4)), 7).shape == (7, 4)
    assert factor.probe(np.zeros((0, 3), np.float32)) == 0


def test_header_codec_and_validation():
    header = container.Header(num_layers=3, checksum=-5)
    data = header.to_bytes()
    assert len(data) == 128 and data[:4] == b"FEMS"
    assert container.Header.from_bytes(data).num_layers == 3
    with pytest.raises(ValueError, match="magic"):
        container.Header.from_bytes(b"XXXX" + data[4:])
    with pytest.raises(ValueError, match="version"):
        container.Header.from_bytes(data[:4] + b"\x09\0" + data[6:])
    with pytest.raises(ValueError, match="short"):
        container.Header.from_bytes(data[:100])


@pytest.mark.parametrize("backend", ["lzma", "rans", "none"])
def test_container_with_deltas_and_dictionary(tmp_path, backend):
    rng = np.random.default_rng(5)
    d = rng.standard_normal((6, 2)).astype(np.float32)
    arrays = [rng.standard_normal((6, 5)).astype(np.float32) for _ in range(4)]
    c = [(d.T @ a).astype(np.float32) for a in arrays]
    r = [(a - d @ x).astype(np.float32) for a, x in zip(arrays, c)]
    blocks = [container.pack_block(True, r[0], c[0], (6, 5), backend)]
    blocks += [container.pack_block(False, r[i] - r[i - 1], c[i] - c[i - 1], (6, 5), backend) for i in (1, 2)]
    blocks.append(container.pack_block(True, r[3], c[3], (6, 5), backend))
    path = str(tmp_path / "x.bin")
    container.assemble(path, list("abcd"), [(6, 5)] * 4, ["float32"] * 4, [[0, 1, 2, 3]], iter(blocks), [len(b) for b in blocks], {6: d}, backend, user={"note": "n", "groups": "shadow"})
    file = container.Container(path, verify=True)
    assert file.meta["note"] == "n" and file.meta["groups"] == [[0, 1, 2, 3]]
    for i, is_iframe, array in file.layers([0, 1, 2, 3]):
        assert is_iframe == (i in (0, 3)) and np.allclose(array, arrays[i], atol=1e-5)
    assert [x[0] for x in file.layers([2])] == [2]
    raw = bytearray(open(path, "rb").read())
    raw[file.starts[1] + 80] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="checksum"):
        container.Container(path, verify=True)
