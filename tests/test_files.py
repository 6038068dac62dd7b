"""Container files from an encode and back, as named arrays."""

import numpy as np
import pytest

from tensorloom.plans import codec, files
from tests.test_engine import state


@pytest.mark.parametrize("options", [codec.Options(), codec.Options(num_atoms=8, atom_rank=8, backend="rans"), codec.Options(dictionary=False, deltas=False)])
def test_file_round_trip(spark, tmp_path, options):
    path, arrays = str(tmp_path / "x.bin"), state()
    stats = files.encode(spark, arrays, path, options, {"note": "kept"})
    back = files.decode(path, verify=True)
    assert set(back) == set(arrays)
    for name, array in arrays.items():
        assert back[name].shape == np.shape(array) and np.allclose(back[name], array, atol=1e-5)
        assert back[name].dtype == (np.float16 if name == "half" else np.float32)
    assert [n for n, _ in files.stream(path)] == sorted(arrays)
    assert stats["n_iframes"] + stats["n_pframes"] == len(arrays) and stats["file_bytes"] > stats["coded_bytes"] > 0
    assert files.header(spark, path).first().num_layers == len(arrays)
    assert files.dictionaries(spark, path).count() == 0 or options.dictionary


def test_half_files_are_smaller_and_exact(spark, tmp_path):
    rng = np.random.default_rng(4)
    arrays = {f"l{i}": rng.normal(0, 0.02, (100, 256)).astype(np.float32) for i in range(4)}
    sizes = {}
    for half in (False, True):
        path = str(tmp_path / f"{half}.bin")
        stats = files.encode(spark, arrays, path, codec.Options(dictionary=False), half=half)
        sizes[half], back = stats["coded_bytes"], files.decode(path, verify=True)
        for name, array in arrays.items():
            want = array.astype(np.float16) if half else array
            assert back[name].dtype == want.dtype and np.allclose(back[name], want, atol=0 if half else 1e-5)
        assert {"coefficient_residual_bytes", "n_eligible", "dictionary_used", "dictionary_bytes", "delta_ratio", "expected_gain"} <= set(stats)
    # Random mantissas do not compress: 10 bits of 16 against 23 of 32, and a byte of exponent each.
    assert sizes[True] < 0.7 * sizes[False]


def test_mixed_layouts_in_both_modes(spark):
    from tensorloom.operators import tensors as T

    rng = np.random.default_rng(5)
    arrays = {f"l{i}": rng.normal(0, 0.02, (8, 16)).astype(np.float16 if i % 3 else np.float32) for i in range(9)}
    tensors, rows = T.from_arrays(spark, arrays)
    for mode in codec.delta.MODES:
        encoded = codec.encode(tensors, rows, codec.Options(dictionary=False, delta_mode=mode))
        layouts = {r.layer_idx: r.layout for r in encoded.blocks.select("layer_idx", "layout").distinct().collect()}
        assert layouts == {i: "fp16" if i % 3 else "fp32" for i in range(9)}
        back = {(r.layer_idx, r.row_idx): r.vals for r in codec.decode(encoded).collect()}
        for i, name in enumerate(sorted(arrays)):
            for k, row in enumerate(arrays[name]):
                assert np.allclose(back[i, k], row.astype(np.float32), atol=0 if mode == "bits" or i % 3 else 1e-5)


def test_no_shared_folder_on_a_cluster_is_an_error(spark, monkeypatch):
    from types import SimpleNamespace

    from tensorloom.plans import lineage

    conf = SimpleNamespace(get=lambda *_: None)
    for master, fine in (("local[4]", True), ("local", True), ("local-cluster[2,1,512]", False), ("yarn", False)):
        session = SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
        if fine:
            assert lineage.shared_base(session)
        else:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                lineage.shared_base(session)


def test_narrowing_and_wide_types(spark, tmp_path):
    path = str(tmp_path / "x.bin")
    arrays = {"a": np.arange(12, dtype=np.float64).reshape(3, 4), "b": np.array([1.5, 2.5], np.float32), "c": np.array([0x3F80, 0x4000], np.uint16), "d": np.array([True, False])}
    files.encode(spark, arrays, path, codec.Options(dictionary=False), half=True)
    back = files.decode(path)
    assert back["a"].dtype == np.float32 and back["b"].dtype == np.float16
    assert back["c"].tolist() == [1.0, 2.0] and back["d"].tolist() == [1.0, 0.0]


def test_bits_mode_is_refused(spark, tmp_path):
    from tensorloom.operators import tensors as T

    encoded = codec.encode(*T.from_arrays(spark, {"a": np.eye(3, dtype=np.float32)}), codec.Options(dictionary=False))
    with pytest.raises(ValueError, match="arith"):
        files.write(encoded, str(tmp_path / "x.bin"))
