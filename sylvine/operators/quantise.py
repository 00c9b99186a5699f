"""Quantised first-stage scores: 4 bits and 1 bit a rotated coordinate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

# The 16-level quantiser of least squared error for a unit normal variable, its positive half.
LEVELS = np.array([0.1284, 0.3881, 0.6568, 0.9424, 1.2562, 1.6181, 2.0690, 2.7326])
CODE = np.concatenate([-LEVELS[::-1], LEVELS])
EDGES = (CODE[1:] + CODE[:-1]) / 2


def _signs(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return 1.0 - 2.0 * ((z ^ z >> np.uint64(31)) >> np.uint64(63)).astype(np.float64)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of rows of a power of two."""
    h, d = 1, x.shape[1]
    while h < d:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int = 1, rounds: int = 3) -> np.ndarray:
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for r in range(rounds):
        y = hadamard(y * _signs(seed + r, d))
    return y


def codes(y: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and scales of rotated vectors."""
    scale = np.sqrt((y * y).mean(1))
    if bits == 1:
        return np.packbits(y > 0, 1, bitorder="little"), scale
    level = np.searchsorted(EDGES, y / np.maximum(scale, 1e-12)[:, None]).astype(np.uint8)
    return level[:, ::2] | level[:, 1::2] << 4, scale


def levels(raw: np.ndarray) -> np.ndarray:
    return np.stack([raw & 15, raw >> 4], 2).reshape(len(raw), 2 * raw.shape[1])


def decoded(raw: np.ndarray, bits: int) -> np.ndarray:
    """The vectors whose inner products with a rotated query are its scores, with 4 bits before they are scaled."""
    return np.unpackbits(raw, axis=1, bitorder="little").astype(np.float64) if bits == 1 else CODE[levels(raw)]


def scores(q: np.ndarray, raw: np.ndarray, scale: np.ndarray, bits: int) -> np.ndarray:
    """Of each rotated query with the code in the same row, always the same for the same two."""
    if bits == 1:
        return (q * np.unpackbits(raw, axis=1, bitorder="little")[:, : q.shape[1]]).sum(1)
    return (q * CODE[levels(raw)]).sum(1) * scale


def encode(corpus: DataFrame, bits: int = 4, seed: int = 1) -> DataFrame:
    """Rows id, code, scale of (id, vec): two coordinates a byte, or eight with the first in the lowest bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, scale = codes(rotate(np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1), seed), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale)], ["id", "code", "scale"])

    return corpus.select("id", "vec").mapInArrow(run, "id long, code binary, scale double")


def select(candidates: DataFrame, queries: DataFrame, codes: DataFrame, kprime: int, bits: int = 4, seed: int = 1) -> DataFrame:
    """The kprime candidates (qid, doc_id) of largest approximate inner product with their query: rows qid, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = rotate(np.asarray(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, -1), seed)
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            score = scores(q, raw, np.asarray(batch.column(4)), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["qid", "doc_id", "score"])

    x = candidates.select("qid", "doc_id").join(codes.select(F.col("id").alias("doc_id"), "code", "scale"), "doc_id")
    x = x.join(queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), "qid").select("qid", "doc_id", "qvec", "code", "scale")
    x = x.mapInArrow(run, "qid long, doc_id long, score double")
    order = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= kprime).drop("place")
