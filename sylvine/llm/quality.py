"""Quality classifier by positive-unlabelled learning.

A linear model over character-class statistics of the whole text is fitted on trusted positives (label 1) and unlabelled
documents by the non-negative unbiased risk  prior * R+(P) + max(0, R-(U) - prior * R-(P))  with the logistic loss; the
class prior is estimated from positives and unlabelled rows alone: a classifier of the two is fitted on one half of each,
and on the other half the share of unlabelled rows above a bar, over that of positives, is least where only positives lie
above it; bars are judged with a confidence bound, so that few rows don't decide. Where there are labels 0, a Platt curve
over the labelled learning rows turns the margin into a score from 0 to 1; else the mean score of unlabelled rows is the
prior. Fitting takes bounded samples chosen by a hash of the id (SAMPLE rows each); every row is scored.

A text over 2 MB is read in parts of 1 MB that end between words, with equal features. Null or empty text has features of its own (all zero but the intercept) and a score. Null ids are never held out nor
learned from. Repeated rows get equal scores. Without positives for learning every score is 0.5.
An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylvine.llm.text import blocks, text_bytes, word_cuts, word_hashes, word_spans

SAMPLE, THRESHOLD, SEED = 8_000, 0.3, 7
CHUNK = 1 << 20
CLASSES = 16
CLASS = np.full(256, 15, np.int64)
for _i, _chars in enumerate((" ", "\n\r\t\v\f", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aeiou", "bcdfghjklmnpqrstvwxyz", "", ".", ",", "!?", "|", "#$%&*", "<>/\\={}[]_~^`@+", "'\"", ":;()-")):
    CLASS[[ord(c) for c in _chars]] = _i
CLASS[128:] = 6
EXTRA = 8
WIDTH = CLASSES * CLASSES + EXTRA


def features(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row a text: shares of pairs of neighbouring character classes, then lengths and shares of distinct words and lines."""
    n = len(at) - 1
    out = np.zeros((n, WIDTH), np.float32)
    if not len(buf):
        return out
    if n == 1 and len(buf) > 2 * CHUNK:
        return _long_features(buf)
    size = np.diff(at)
    doc = np.repeat(np.arange(n), size)
    cls = CLASS[buf]
    pair = cls[:-1] * CLASSES + cls[1:] + doc[:-1] * (CLASSES * CLASSES)
    inside = doc[:-1] == doc[1:]
    counts = np.bincount(pair if inside.all() else pair[inside], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    starts, ends, first = word_spans(buf, at)
    words = np.diff(first)
    h = word_hashes(buf, starts, ends)
    owner = np.repeat(np.arange(n), words)
    distinct = _distinct(owner, h, n)
    follow = np.zeros(n)
    if len(h) > 1:
        with np.errstate(over="ignore"):
            two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        same = owner[:-1] == owner[1:]
        follow = _distinct(owner[:-1][same], two[same], n)
    return _filled(out, counts, size, words, distinct, follow)


def _filled(out: np.ndarray, counts: np.ndarray, size: np.ndarray, words: np.ndarray, distinct: np.ndarray, follow: np.ndarray) -> np.ndarray:
    out[:, :-EXTRA] = np.sqrt(counts / np.maximum(size - 1, 1)[:, None])
    x = out[:, -EXTRA:]
    x[:, 0] = np.log1p(size) / 10
    x[:, 1] = np.log1p(words) / 10
    x[:, 2] = np.minimum(size / np.maximum(words, 1), 40) / 10
    x[:, 3] = distinct / np.maximum(words, 1)
    x[:, 4] = follow / np.maximum(words - 1, 1)
    x[:, 5] = (1 - x[:, 4]) ** 2
    x[:, 6] = words <= 3
    x[:, 7] = np.sqrt(1 - x[:, 4])
    x[words == 0, 3:] = 0
    return out


def _long_features(buf: np.ndarray) -> np.ndarray:
    """The features of one long text, part after part."""
    cuts, counts, words = word_cuts(buf, CHUNK), np.zeros(CLASSES * CLASSES, np.int64), 0
    one, two, last = [], [], np.zeros(0, np.uint64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        cls = CLASS[buf[a : b + 1]]
        counts += np.bincount(cls[:-1] * CLASSES + cls[1:], minlength=CLASSES * CLASSES)
        starts, ends, _ = word_spans(buf[a:b], np.array([0, b - a]))
        h = word_hashes(buf[a:b], starts, ends)
        words += len(h)
        one.append(np.unique(h >> np.uint64(24)))
        h = np.concatenate([last, h])
        with np.errstate(over="ignore"):
            two.append(np.unique((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(24)))
        last = h[-1:]
    each = lambda v: np.array([v])
    return _filled(np.zeros((1, WIDTH), np.float32), counts[None], each(len(buf)), each(words), each(len(np.unique(np.concatenate(one)))), each(len(np.unique(np.concatenate(two)))))


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each owner has; owners ascend."""
    key = (h >> np.uint64(24)) | (owner.astype(np.uint64) << np.uint64(40))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk, by Adam over all rows at once."""
    w = np.zeros(positive.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    p = np.hstack([positive, np.ones((len(positive), 1))]).astype(np.float64)
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1))]).astype(np.float64)
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        if negative >= 0:
            g = prior * (p.T @ (sp - 1)) / len(p) + g_negative
        else:
            g = -g_negative
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, risk: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from rows whose order is random; between 0.05 and 0.95."""
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    w, b = fit_pu(positive[::2], unlabelled[::2], 0.5)  # with this prior the risk tells the two samples apart
    zp, zu = np.sort(positive[1::2] @ w + b), np.sort(unlabelled[1::2] @ w + b)
    bars = zp[: max(1, int(0.99 * len(zp)))]
    above_p, above_u = 1 - np.searchsorted(zp, bars) / len(zp), 1 - np.searchsorted(zu, bars) / len(zu)
    slack = np.sqrt(np.log(4 / risk) / 2 / len(zu)) + np.sqrt(np.log(4 / risk) / 2 / len(zp))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(min(max(above_u[best] / above_p[best], 0.05), 0.95))


def centred(z: np.ndarray, prior: float) -> float:
    """The shift of margins that makes the mean score the prior."""
    low, high = -60.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(-np.clip(z + mid, -30, 30)))).mean() < prior else (low, mid)
    return (low + high) / 2


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of the curve 1 / (1 + exp(-(a z + b))), by Newton's method with a little ridge."""
    scale = max(float(np.std(z)), 1e-6)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (q - t) + 1e-3 * w
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def held_out(id_: str | None) -> bool:
    return id_ is not None and zlib.crc32(id_.encode()) % 5 == 0


def _featured(df: DataFrame) -> DataFrame:
    """Rows (id, text, ...): text replaced by its features as little-endian float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = text_bytes(batch.column(1))
            for i, j in blocks(at, CHUNK):
                own = at[i : j + 1]
                x = features(buf[own[0] : own[-1]], own - own[0])
                flat = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.arange(j - i + 1, dtype=np.int32) * (4 * WIDTH)), pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], flat, batch.column(2)[i:j]], ["id", "x", "y"])

    return df.mapInArrow(run, "id string, x binary, y int")


def _collect(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.select("id", "x", "y").toArrow().sort_by("id")
    x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(-1, WIDTH) if t.num_rows else np.zeros((0, WIDTH), np.float32)
    return x, t.column("y").fill_null(0).to_numpy().astype(np.float64)


class Model:
    def __init__(self, w: np.ndarray, b: float):
        self.w, self.b = w.astype(np.float64), b

    def score(self, x: np.ndarray) -> np.ndarray:
        # Row by row in a fixed order, so that a text's score doesn't depend on its neighbours.
        z = (x.astype(np.float64) * self.w).sum(1) + self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample: int = SAMPLE) -> Model:
    """The model from at most about `sample` labelled and `sample` unlabelled rows that are not held out."""
    part = lambda of, most, total: F.pmod(F.xxhash64(F.col("id"), F.lit(SEED)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / max(total, 1))) + 1
    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & (F.crc32(F.col("id").cast("binary")) % 5 != 0))
    y = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & (F.crc32(F.col("id").cast("binary")) % 5 != 0) & F.col("y").isin(0, 1))
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in y.groupBy("y").count().collect()}
    if not counts.get(1):
        return Model(np.zeros(WIDTH), 0.0)
    chosen = y.where(part("id", sample, sum(counts.values())))  # about `sample` ids, so it may be broadcast
    known, truth = _collect(_featured(d.join(F.broadcast(chosen), "id").select("id", "text", "y")))
    free, _ = _collect(_featured(d.where(part("id", sample, docs.count())).select("id", "text", F.lit(None).cast("int").alias("y"))))
    if not (truth == 1).any() or not len(free):
        return Model(np.zeros(WIDTH), 0.0)
    mean, dev = free.mean(0), free.std(0)
    dev = np.where(dev > 1e-4, dev, np.inf)
    trusted, every = (known[truth == 1] - mean) / dev, (free - mean) / dev
    shuffle = np.random.default_rng(SEED)
    trusted, every = trusted[shuffle.permutation(len(trusted))], every[shuffle.permutation(len(every))]
    prior = estimate_prior(trusted, every)
    w, b = fit_pu(trusted, every, prior)
    w = w / dev
    b = b - float(mean @ w)
    if counts.get(0) and (truth == 0).any():
        a, c = platt(known @ w + b, truth)
        w, b = w * a, b * a + c
    else:
        b += centred(free @ w + b, prior)
    return Model(w, b)


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows doc_id, score of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = text_bytes(batch.column(1))
            for i, j in blocks(at, CHUNK):
                own = at[i : j + 1]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(model.score(features(buf[own[0] : own[-1]], own - own[0])))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col="text") -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = text_bytes(batch.column(place))
            for i, j in blocks(at, CHUNK):
                own = at[i : j + 1]
                yield batch.slice(i, j - i).filter(pa.array(model.score(features(buf[own[0] : own[-1]], own - own[0])) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Rows doc_id, held_out, score, predicted of all rows."""
    x = score(docs, fit(docs, labels, **options))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return x.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
