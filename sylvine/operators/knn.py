"""Exact nearest neighbours of a query set in blocks, candidate reranking and recall."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sylvine.functions.distance import METRICS, distance, matrix

ROWS, QUERIES = 8192, 1024


def vectors(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """Rows (id, vec) of the vectors that are there, of one length if given, and without null components."""
    v = F.col(vec_col)
    x = df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull()))
    x = x.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))
    return x if dim is None else x.where(F.size("vec") == dim)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(len(column), -1)


def exact(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "l2", include_self: bool = False, after: tuple[float, int] | None = None) -> DataFrame:
    """Rows qid, doc_id, dist, rank of (id, vec) tables: each query's k nearest, ties to the smaller id.

    after: only what follows a (distance, id) in that order counts, which gives the next page of a result.

    Both sides go in blocks of bounded size, each pair of blocks is one matrix product, and only its k nearest a query
    leave it; the distance is then computed anew from the two vectors, component after component.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    n_rows, n_queries = max(1, -(-corpus.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    rows = corpus.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_queries)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"qid": [], "doc_id": [], "dist": []}
        if left.num_rows and right.num_rows:
            qid, vid = left.column("id").to_numpy(), right.column("id").to_numpy()
            q, v = _matrix(left.column("vec")), _matrix(right.column("vec"))
            for i in range(0, len(q), 128):
                d = matrix(q[i : i + 128], v, metric)
                if not include_self:
                    d[qid[i : i + 128, None] == vid[None]] = np.inf
                m = min(k, len(v))
                if after is None:
                    far = d
                else:  # near the bound, the distance computed anew decides
                    slack = 1e-9 * max(1.0, abs(after[0]))
                    d[d < after[0] - slack] = np.inf
                    far = np.where(d > after[0] + slack, d, np.inf)
                last = np.partition(far, m - 1, 1)[:, m - 1, None]
                r, c = np.nonzero((d <= last + 1e-9 * np.maximum(1, np.abs(last))) & (d < np.inf))
                a, b = q[i + r], v[c]
                if metric == "l2":
                    got = np.cumsum((a - b) ** 2, 1)[:, -1]
                else:
                    got = np.cumsum(a * b, 1)[:, -1]
                    if metric == "cosine":
                        got = got / np.maximum(1e-12, np.sqrt(np.cumsum(a * a, 1)[:, -1]) * np.sqrt(np.cumsum(b * b, 1)[:, -1]))
                    got = -got
                if after is not None:
                    beyond = (got > after[0]) | (got == after[0]) & (vid[c] > after[1])
                    r, c, got = r[beyond], c[beyond], got[beyond]
                order = np.lexsort((vid[c], got, r))
                r, c, got = r[order], c[order], got[order]
                own = np.arange(len(r)) - np.searchsorted(r, r) < k
                for name, x in zip(out, (qid[i + r[own]], vid[c[own]], got[own]), strict=True):
                    out[name].append(x)
        return pa.table({name: np.concatenate(x) if x else np.zeros(0, np.float64 if name == "dist" else np.int64) for name, x in out.items()})

    pairs = asked.groupBy("qb", "vb").cogroup(rows.groupBy("qb", "vb")).applyInArrow(nearest, "qid long, doc_id long, dist double")
    return top_k(pairs, k)


def top_k(scored: DataFrame, k: int, key: str = "qid") -> DataFrame:
    """The k rows of least (dist, doc_id) of each key, with rank from 1."""
    order = W.partitionBy(key).orderBy("dist", "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """Candidates (qid, doc_id) by exact distance: rows qid, doc_id, dist, rank. Ids without a vector drop out."""
    x = candidates.select("qid", "doc_id").join(corpus.select(F.col("id").alias("doc_id"), "vec"), "doc_id")
    x = x.join(queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), "qid")
    return top_k(x.select("qid", "doc_id", distance(F.col("qvec"), F.col("vec"), metric).alias("dist")), k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row, recall: the share of the first k true neighbours among the first k found."""
    t = truth.where(F.col("rank") <= k).select("qid", "doc_id")
    f = found.where(F.col("rank") <= k).select("qid", "doc_id", F.lit(1).alias("hit"))
    x = t.join(f, ["qid", "doc_id"], "left")
    return x.agg((F.count("hit") / F.count("*")).alias("recall"))


def pad_truth(truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Ranks 1 to k of every query, doc_id -1 where there are fewer neighbours."""
    every = queries.select(F.col("id").alias("qid")).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return every.join(truth.select("qid", "rank", "doc_id"), ["qid", "rank"], "left").select("qid", "rank", F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"))


def running(queries: DataFrame, parts: list[DataFrame], k: int, metric: str = "l2") -> DataFrame:
    """Truth kept up while a corpus arrives in parts: each part's k nearest are merged with the k nearest so far."""
    best = None
    for part in parts:
        best = merged_truth(best, exact(queries, part, k, metric), k)
    return best


def merged_truth(old: DataFrame | None, new: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query over two tables (qid, doc_id, dist, rank); a document in both counts once."""
    if old is None:
        return new
    both = old.drop("rank").unionByName(new.drop("rank")).groupBy("qid", "doc_id").agg(F.min("dist").alias("dist"))
    return top_k(both, k)
