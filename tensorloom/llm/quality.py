"""Quality classifier by non-negative positive-unlabelled (nnPU) learning.

Trusted positives are the documents labelled good in the learning folds;
everything else that is known is unlabelled web text. The class prior is
estimated from these two samples alone (best-bin estimate on the scores of a
positive-versus-unlabelled model, on rows that model was not fitted on). The
scorer is a logistic model over text statistics and their squares, fitted by
gradient descent on the non-negative unbiased risk
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` with the sigmoid loss (Kiryo et
al., 2017): where the bracket falls below zero the step ascends on it instead.

Scoring reads whole texts in Arrow batches and needs no shuffle.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import pick, whole_texts

#: Rows of the fitting sample at most, positives and unlabelled each.
SAMPLE = 6000
ITERATIONS = 1500
SEED = 17
_REPEATED = re.compile(rb"(.)\1\1")
_KINDS = ("lower", "upper", "digit", "space", "high", "stop", "comma", "mark")

NAMES = (
    "log_words", "log_chars", "mean_word", "upper", "digit", "space", "high", "stop", "comma", "mark",
    "top_mark", "distinct", "adjacent", "top_word", "bare_marks", "marked_words", "upper_words", "line_words",
    "same_lines", "runs", "short_words", "long_words", "worst_marks", "worst_upper", "worst_adjacent", "worst_bare",
)


def _classes() -> np.ndarray:
    kind = np.full(256, _KINDS.index("mark"))
    kind[128:] = _KINDS.index("high")
    kind[ord("a") : ord("z") + 1] = _KINDS.index("lower")
    kind[ord("A") : ord("Z") + 1] = _KINDS.index("upper")
    kind[ord("0") : ord("9") + 1] = _KINDS.index("digit")
    kind[[9, 10, 11, 12, 13, 32]] = _KINDS.index("space")
    kind[[ord(x) for x in ".?"]] = _KINDS.index("stop")
    kind[[ord(x) for x in ",;:'\"-()"]] = _KINDS.index("comma")
    return kind


_CLASS = _classes()
_MARK_BYTES = bytes(i for i in range(256) if _CLASS[i] == _KINDS.index("mark"))
_UPPER_BYTES = bytes(range(ord("A"), ord("Z") + 1))


def _shares(words: list[bytes], raw: bytes, size: int) -> tuple[float, float, float, float]:
    """Of one stretch of text: shares of marks, capitals, adjacent equal words and words of marks only."""
    n = max(1, len(words))
    marks = (size - len(raw.translate(None, _MARK_BYTES))) / max(1, size)
    upper = (size - len(raw.translate(None, _UPPER_BYTES))) / max(1, size)
    adjacent = sum(map(operator.eq, words, words[1:])) / n
    bare = sum(1 for w in words if not w.translate(None, _MARK_BYTES)) / n
    return marks, upper, adjacent, bare


def features(text: str | None) -> np.ndarray:
    """The statistics of :data:`NAMES` of a whole text; null and empty texts give a defined row."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if size else np.zeros(256, np.int64)
    kinds = np.bincount(_CLASS, weights=counts, minlength=len(_KINDS)) / max(1, size)
    marks = counts[_CLASS == _KINDS.index("mark")]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    whole = _shares(words, raw, size)
    stripped = [w.translate(None, _MARK_BYTES) for w in seen]
    marked = sum(c for (w, c), s in zip(seen.items(), stripped) if s and len(s) < len(w)) / max(1, n)
    capitals = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper()) / max(1, n)
    worst = np.zeros(4)
    # Junk may fill one part of a document: the worst of its eighths counts too.
    step = max(12, -(-n // 8))
    for at in range(0, n, step):
        part = words[at : at + step]
        if len(part) >= 6 or n < 12:
            joined = b" ".join(part)
            worst = np.maximum(worst, _shares(part, joined, len(joined)))
    return np.array([
        np.log1p(n), np.log1p(size), size / max(1, n) / 10, *kinds[1:],
        (marks.max() / max(1, size)) if len(marks) else 0.0, len(seen) / max(1, n), whole[2], max(seen.values(), default=0) / max(1, n), whole[3], marked, capitals,
        np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), len(_REPEATED.findall(raw)) / max(1, n),
        sum(c for w, c in seen.items() if len(w) <= 2) / max(1, n), sum(c for w, c in seen.items() if len(w) > 15) / max(1, n), *worst,
    ])


@dataclass(frozen=True)
class QualityModel:
    """A fitted scorer; small and of fixed size, so it may travel in a closure."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_expand(rows, self.mean, self.scale) @ self.weights, -30, 30)))


def _expand(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((rows - mean) / scale, -6, 6)
    return np.hstack([z, z**2 / 6, np.ones((len(z), 1))])


def _adam(gradient, size: int, iterations: int, rate: float = 0.03) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, iterations + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best-bin estimate: the least ratio of upper tails, unlabelled to positive, with a margin for noise."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 60))
    tail_p = np.array([(positive >= c).mean() for c in cuts])
    tail_u = np.array([(unlabelled >= c).mean() for c in cuts])
    noise = np.sqrt(np.log(4 / 0.1) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / 0.1) / (2 * len(positive)))
    best = int(np.argmin((tail_u + noise) / np.maximum(tail_p, 1e-9)))
    return float(np.clip(tail_u[best] / max(tail_p[best], 1e-9), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, iterations: int = ITERATIONS, prior: float | None = None) -> QualityModel:
    """Fit on rows of :func:`features`. Without positives or unlabelled rows every text scores the prior 0.5."""
    width = len(NAMES)
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(2 * width + 1), 0.5)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = _expand(positive, mean, scale), _expand(unlabelled, mean, scale)
    decay = 1e-4

    def against_unlabelled(w: np.ndarray) -> np.ndarray:
        g = p[::2].T @ (_sigmoid(p[::2] @ w) - 1) / len(p[::2]) + u[::2].T @ _sigmoid(u[::2] @ w) / len(u[::2])
        return g + decay * w

    if prior is None:
        first = _adam(against_unlabelled, p.shape[1], iterations // 3)
        held_p, held_u = (p[1::2], u[1::2]) if len(p) > 1 and len(u) > 1 else (p, u)
        prior = estimate_prior(held_p @ first, held_u @ first)

    def risk_gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = su.mean() - prior * sp.mean()
        # Derivatives of the sigmoid losses of both signs.
        dp = p.T @ (sp * (1 - sp)) / len(p)
        du = u.T @ (su * (1 - su)) / len(u)
        back = du - prior * dp
        return (-prior * dp + back if negative >= 0 else -back) + decay * w

    return QualityModel(mean, scale, _adam(risk_gradient, p.shape[1], iterations), float(prior))


def learning_fold(id_col: str = "doc_id") -> F.Column:
    """Rows that labels may be learned from; the others are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on at most ``sample`` trusted positives and as many unlabelled texts.

    Only labels of learning-fold rows are read and only their positives are
    used. Samples are the rows of least hash of doc_id, so reruns agree.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    known = pick(labels, doc_id="doc_id", quality="quality").where(learning_fold() & (F.col("quality") == 1))
    # The samples are picked by id before any text is read; ``sample`` bounds what is broadcast and collected.
    good = known.select("doc_id").distinct().orderBy(order, "doc_id").limit(sample).withColumn("good", F.lit(1))
    web = pick(docs, doc_id="doc_id").where(learning_fold()).distinct().orderBy(order.bitwiseXOR(F.lit(0x5BD1E995)), "doc_id").limit(sample)
    wanted = good.unionByName(web.withColumn("good", F.lit(0)))
    # One row an id and sample, its least text: an id that very many rows repeat is one row of the sample.
    texts = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id")
    rows = whole_texts(texts.groupBy("doc_id", "good").agg(F.min("text").alias("text")).select("doc_id", "text", "good"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = [features(t.as_py()).tolist() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "good", "x"])

    got = rows.mapInArrow(run, "doc_id long, good int, x array<double>").orderBy("good", "doc_id", "x").toPandas()
    side = [np.array(got.x[got.good == k].tolist()).reshape(-1, len(NAMES)) for k in (1, 0)]
    return fit(*side)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, repeated rows and null or empty texts too.

    A null doc_id is never held out. Extra columns are ignored.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array([features(t.as_py()) for t in part.column(1)]).reshape(-1, len(NAMES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = whole_texts(pick(docs, doc_id="doc_id", text="text").withColumn("text", F.col("text").cast("string"))).mapInArrow(run, "doc_id long, score double, predicted int")
    held = F.coalesce(~learning_fold(), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, unchanged."""
    text = docs.columns.index("text")
    schema = docs.schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array([features(t.as_py()) for t in part.column(text)]).reshape(-1, len(NAMES))
            yield part.filter(pa.array(model.score(x) >= threshold))

    return whole_texts(docs).mapInArrow(run, schema)
