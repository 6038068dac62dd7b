"""Dictionary factorisation W = D C + R: fit, project, reconstruct, and the adaptive choice.

A tensor is the unit of the kernels (one group, one task); the dictionary of a
row dimension is fitted on a bounded sample of singular directions, so no task
holds more than that however many tensors there are. Dictionaries are small by
construction (row dimension x atoms, one per row dimension).
"""

from __future__ import annotations

import lzma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions import streams
from tensorloom.operators import tensors as T

# Cells from which on the randomised SVD is used, oversampling, power iterations, seeds.
FULL_SVD_CELLS = 50_000
OVERSAMPLE, POWER_ITERATIONS, SVD_SEED = 10, 4, 42
KMEANS_SEED, KMEANS_ROUNDS, KMEANS_BATCH = 0, 30, 4096
EPS = 1e-8
#: Singular directions of one row dimension that a dictionary is fitted on, at most.
FIT_SAMPLE = 65_536


def truncated_svd(w: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading ``rank`` triplets (U, S, Vt) in double precision; NaN and infinities count as 0."""
    w = np.where(np.isfinite(w), w, 0).astype(np.float64)
    k = min(rank, *w.shape)
    if w.size <= FULL_SVD_CELLS:
        u, s, vt = np.linalg.svd(w, full_matrices=False)
        return u[:, :k], s[:k], vt[:k]
    rng = np.random.default_rng(SVD_SEED)
    basis, _ = np.linalg.qr(w @ rng.standard_normal((w.shape[1], min(k + OVERSAMPLE, *w.shape))))
    for _ in range(POWER_ITERATIONS):
        basis, _ = np.linalg.qr(w.T @ basis)
        basis, _ = np.linalg.qr(w @ basis)
    u, s, vt = np.linalg.svd(basis.T @ w, full_matrices=False)
    return (basis @ u)[:, :k], s[:k], vt[:k]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre, the first among equals, without an (n, k, d) array."""
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = KMEANS_ROUNDS, batch: int = KMEANS_BATCH) -> np.ndarray:
    """Centres by distance-weighted seeding and mini-batch means; k is capped at the distinct rows."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    if k == len(distinct):
        return distinct
    rng = np.random.default_rng(KMEANS_SEED)
    centres = [x[rng.integers(len(x))]]
    reach = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        centres.append(x[rng.choice(len(x), p=reach / reach.sum())])
        reach = np.minimum(reach, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        part = x[rng.permutation(len(x))[:batch]]
        near = _nearest(part, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, part)
        sizes = np.bincount(near, minlength=k)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
    return c


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    """The rows as one matrix, stacked from the arrays that Arrow gives."""
    rows = pdf.sort_values("row_idx").vals.to_numpy()
    return np.stack(rows).astype(np.float32, copy=False) if len(rows) else np.zeros((0, 0), np.float32)


def fit(rows: DataFrame, tensors: DataFrame, num_atoms: int = 64, rank: int = 128, sample: int = FIT_SAMPLE) -> DataFrame:
    """``dictionaries(m, atom_idx, vec)``: unit-norm atoms for each row dimension with two directions at least."""
    nonzero = rows.groupBy("layer_idx").agg(F.max(F.exists("vals", lambda v: v != 0)).alias("nonzero"))
    chosen = tensors.join(nonzero, "layer_idx").where(T.fit_eligible(F.col("dtype"), F.col("shape"), F.col("row_dim"), F.col("col_dim"), F.col("nonzero")))
    chosen = chosen.select(F.col("layer_idx").alias("layer_idx"), F.col("row_dim").alias("m"))

    def directions(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            u, s, _ = truncated_svd(_matrix(pdf), rank)
        except np.linalg.LinAlgError:
            return pd.DataFrame({"m": [], "layer_idx": [], "k": [], "vec": []})
        vectors = (u * s).T
        vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + EPS)
        return pd.DataFrame({"m": pdf.m.iloc[0], "layer_idx": pdf.layer_idx.iloc[0], "k": range(len(vectors)), "vec": list(vectors)})

    found = rows.join(chosen, "layer_idx").groupBy("layer_idx").applyInPandas(directions, "m int, layer_idx int, k int, vec array<double>")
    place = F.row_number().over(Window.partitionBy("m").orderBy(F.xxhash64("layer_idx", "k"), "layer_idx", "k"))
    found = found.withColumn("n", place).where(F.col("n") <= sample)

    def atoms(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values(["layer_idx", "k"]).vec.to_numpy())
        if len(x) < 2:
            return pd.DataFrame({"m": [], "atom_idx": [], "vec": []})
        c = kmeans(x, min(num_atoms, len(x)))
        c = c / (np.linalg.norm(c, axis=1, keepdims=True) + EPS)
        return pd.DataFrame({"m": pdf.m.iloc[0], "atom_idx": range(len(c)), "vec": list(c.astype(np.float32))})

    return found.groupBy("m").applyInPandas(atoms, "m int, atom_idx int, vec array<float>")


def packed(dictionaries: DataFrame) -> DataFrame:
    """One record a row dimension: ``(m, n_atoms, atoms)`` in atom order."""
    atoms = F.sort_array(F.collect_list(F.struct("atom_idx", "vec")))
    return dictionaries.groupBy("m").agg(F.count("*").cast("int").alias("n_atoms"), atoms.alias("pairs")).select("m", "n_atoms", F.transform("pairs", lambda p: p["vec"]).alias("atoms"))


def _apart(df: DataFrame) -> DataFrame:
    """The same table under columns of its own, so that both sides of a cogroup may stem from one source."""
    return df.select(*[(F.col(c) if c != "layer_idx" else F.col(c) + F.lit(0)).alias(c) for c in df.columns])


def probe(array: np.ndarray) -> int:
    """Bytes of the streams under a fast codec: a cheap stand-in for the final size; empty is 0."""
    if not array.size:
        return 0
    s = streams.split(np.ascontiguousarray(array, np.float32))
    return sum(len(lzma.compress(s[k], preset=1)) for k in ("sign", "exp", "mant"))


_FACTORED = "layer_idx int, part string, row_idx int, vals array<float>, mode string, probe_bytes long"


def project(rows: DataFrame, tensors: DataFrame, dictionaries: DataFrame, adaptive: bool = True) -> DataFrame:
    """``factored(layer_idx, part, row_idx, vals, mode)``: C and R of each tensor.

    Mode dict: C = D' W and R = W - D C. Mode passthrough (no dictionary, not
    eligible, or - if adaptive - not smaller by the probe): C is one zero, R = W.
    The choice takes the smaller of both sizes; on ties passthrough.
    """
    meta = tensors.join(packed(dictionaries), tensors["row_dim"] == F.col("m"), "left")
    able = T.encode_eligible(F.col("dtype"), F.col("row_dim"), F.col("col_dim"), F.col("n_atoms"))
    meta = meta.select("layer_idx", F.when(able, F.col("atoms")).alias("atoms"))

    def kernel(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({n: [] for n in ("layer_idx", "part", "row_idx", "vals", "mode", "probe_bytes")})
        w = _matrix(left)
        options = [("passthrough", np.zeros((1, 1), np.float32), w)]
        atoms = right.atoms.iloc[0] if len(right) else None
        if atoms is not None:
            d = np.array([np.asarray(a) for a in atoms], np.float32).T
            c = d.T @ w
            options.append(("dict", c, (w - d @ c).astype(np.float32)))
        out = []
        for mode, c, r in options:
            size = probe(c) + probe(r) if adaptive and len(options) > 1 else 0
            for part, a in (("C", c), ("R", r)):
                out += [(key[0], part, i, row, mode, size) for i, row in enumerate(a)]
        return pd.DataFrame(out, columns=["layer_idx", "part", "row_idx", "vals", "mode", "probe_bytes"])

    both = rows.groupBy("layer_idx").cogroup(_apart(meta).groupBy("layer_idx")).applyInPandas(kernel, _FACTORED)
    # Sizes are compared as rows: min_by over (bytes, dictionary last) keeps passthrough on ties.
    # Without the choice all sizes are 0 and the dictionary comes first.
    first = "passthrough" if adaptive else "dict"
    order = F.struct("probe_bytes", (F.col("mode") != first).cast("int"))
    best = both.groupBy("layer_idx").agg(F.min_by("mode", order).alias("mode"))
    return both.join(best, ["layer_idx", "mode"]).select("layer_idx", "part", "row_idx", "vals", "mode")


def reconstruct(factored: DataFrame, tensors: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """``tensor_rows`` back from C and R: D C + R in fp32, or R."""
    meta = tensors.join(packed(dictionaries), tensors["row_dim"] == F.col("m"), "left").select("layer_idx", "atoms")

    def kernel(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"layer_idx": [], "row_idx": [], "vals": []})
        r = _matrix(left[left.part == "R"])
        if left["mode"].iloc[0] == "dict":
            d = np.array([np.asarray(a) for a in right.atoms.iloc[0]], np.float32).T
            r = d @ _matrix(left[left.part == "C"]) + r
        return pd.DataFrame({"layer_idx": key[0], "row_idx": range(len(r)), "vals": list(r.astype(np.float32))})

    return factored.groupBy("layer_idx").cogroup(_apart(meta).groupBy("layer_idx")).applyInPandas(kernel, "layer_idx int, row_idx int, vals array<float>")
