"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform (vectors padded with zeros to a power of
two). A hash is the signed axis nearest to the rotated unit vector, among all axes or the first few; a table's cell joins
as many hashes as make cells of about PER_CELL rows, so cells grow in number with the table and not in size. A query
probes, in each table, the `probes` cells of least cost: the cost of a cell is the sum over its hashes of the squared
distance by which its axis falls behind the nearest one. Candidates of all tables are made distinct before their exact
double-precision inner products with the original vectors are computed. Queries for which fewer than k rows turn up are
compared with all rows, in blocks, so k rows are found where there are k.

Equal vectors are one row of the index, with the k + 1 smallest of their ids: no other can be among k nearest. Equal
queries are searched once. A cell of more than BLOCK rows (of different vectors) is cut in blocks, each probed on its own.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part. Rows
that repeat an id count as one, that of the least hash of its vector. A query is never its own neighbour. Ties go to the
smaller id. Null ids take no part. An empty table gives an empty result. Only the named columns are read.
Driver-side: counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sylvine.llm.joins import joined
from sylvine.llm.text import stream
from sylvine.scratch import Scratch

TABLES, PROBES, PER_CELL = 48, 12, 6
BLOCK, ROWS, QUERIES, HELD = 4096, 8192, 1024, 2_000_000


def rotate(x: np.ndarray, table: int, seed: int = 5) -> np.ndarray:
    """The pseudo-rotated rows, up to a factor."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for r in range(3):
        y *= 1.0 - 2.0 * (stream(seed * 1000 + table * 10 + r, d) >> np.uint64(63)).astype(np.float64)
        h = 1
        while h < d:
            z = y.reshape(len(y), -1, 2, h)
            a, b = z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]
            y = np.stack([a, b], 2).reshape(len(y), d)
            h *= 2
    return y


def axes(n: int, dim: int, per_cell: float = PER_CELL) -> list[int]:
    """How many axes each of a cell's hashes chooses among, for n rows: 2 cells an axis, about n / per_cell in all."""
    d, out, left = 1 << max(0, dim - 1).bit_length(), [], n / per_cell
    while left >= 2:
        out.append(min(d, 1 << int(left / 2).bit_length() - 1))
        left /= 2 * out[-1]
    return out or [1]


def cells(y: np.ndarray) -> np.ndarray:
    """The nearest signed axis: axis a is cell 2a, its negative 2a + 1."""
    a = np.abs(y).argmax(1)
    return 2 * a + (y[np.arange(len(y)), a] < 0)


def _joint(x: np.ndarray, table: int, choice: list[int], seed: int) -> np.ndarray:
    """Each row's cell in a table."""
    cell = np.zeros(len(x), np.int64)
    for i, k in enumerate(choice):
        cell = cell * (2 * k) + cells(rotate(x, table * 8 + i, seed)[:, :k])
    return cell


def probe_cells(x: np.ndarray, table: int, choice: list[int], probes: int, seed: int = 5) -> np.ndarray:
    """The cells of least cost of each row, the nearest first. Costs add up, so the best joint cells have the best prefixes."""
    cost, cell = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for i, k in enumerate(choice):
        y = rotate(x, table * 8 + i, seed)
        y = y[:, :k] / np.maximum(np.sqrt((y * y).mean(1, keepdims=True)), 1e-300)
        both = np.stack([y, -y], 2).reshape(len(x), 2 * k)
        lag = (both.max(1, keepdims=True) - both) ** 2
        cost = (cost[:, :, None] + lag[:, None, :]).reshape(len(x), -1)
        cell = (cell[:, :, None] * (2 * k) + np.arange(2 * k)).reshape(len(x), -1)
        best = np.argsort(cost, 1, kind="stable")[:, :probes]
        cost, cell = np.take_along_axis(cost, best, 1), np.take_along_axis(cell, best, 1)
    return cell


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _points(df: DataFrame, id_col: str, vec_col: str, dim: int | None) -> DataFrame:
    """Rows id, key (a hash of the vector), vec of what takes part, one an id."""
    v = F.col("vec")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & fine)
    if dim is None:
        return x
    x = x.where(F.size("vec") == dim).select("id", F.xxhash64("vec").alias("key"), "vec")
    return x.groupBy("id").agg(F.min_by(F.struct("key", "vec"), "key").alias("p")).select("id", "p.key", "p.vec")


def _hashed(points: DataFrame, tables: int, choice: list[int], probes: int, seed: int) -> DataFrame:
    """Rows t, cell, key of (key, vec): each table's own cell, or those to probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x, key = _unit(_matrix(part.column(1))), part.column(0).to_numpy()
                for t in range(tables):
                    cell = probe_cells(x, t, choice, probes, seed) if probes else _joint(x, t, choice, seed)[:, None]
                    n = cell.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x) * n, t, np.int32)), pa.array(cell.ravel()), pa.array(np.repeat(key, n))], ["t", "cell", "key"])

    return points.select("key", "vec").mapInArrow(run, "t int, cell long, key long")


def _packed(pairs: DataFrame) -> DataFrame:
    """Pairs (q, key) as rows q, vb, slots: the distinct slots of a block of rows, two bytes each; HELD pairs at once.

    A key is a row's block above 16 bits and its slot in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            q, key = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
            order = np.lexsort((key, q))
            q, key = q[order], key[order]
            new = np.append(True, (q[1:] != q[:-1]) | (key[1:] != key[:-1]))
            q, key = q[new], key[new]
            vb = (key >> 16).astype(np.int32)
            edge = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (vb[1:] != vb[:-1])))
            slots = (key & 0xFFFF).astype("<u2")
            lists = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer((np.append(edge, len(q)) * 2).astype(np.int32)), pa.py_buffer(slots)])
            return pa.RecordBatch.from_arrays([pa.array(q[edge]), pa.array(vb[edge]), lists], ["q", "vb", "slots"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return pairs.select("q", "key").mapInArrow(run, "q long, vb int, slots binary")


def candidates(asked: DataFrame, index: DataFrame, n_index: int) -> DataFrame:
    """Rows q, vb, slots (a list of byte strings): each query's candidates in each block of rows, from (t, cell, key) tables."""
    sizes = index.groupBy("t", "cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).withColumn("parts", F.ceil(F.col("n") / BLOCK))
    on = ["t", "cell"]
    if not sizes.isEmpty():
        index = joined(index, sizes, on, ["key"], n_index, "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("key"), F.col("parts"))).otherwise(0)).drop("parts")
        asked = asked.join(sizes.drop("n"), on, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
        on = [*on, "part"]
    pairs = asked.withColumnRenamed("key", "q").join(index, on)
    return _packed(pairs).groupBy("q", "vb").agg(F.collect_list("slots").alias("slots"))


def _nearest(k: int):
    """Of a block of rows and the queries that have candidates there (all its rows where slots is null): the k best of each."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("slot").to_numpy())  # slots are 0 to the number of rows
            key, ids = (right.column(c).to_numpy()[order] for c in ("key", "id"))
            v = _matrix(right.column("vec").combine_chunks())[order]
            q, lists = _matrix(left.column("vec").combine_chunks()), left.column("slots").combine_chunks()
            for r, name in enumerate(left.column("q").to_pylist()):
                if lists[r].is_valid:
                    at = np.unique(np.frombuffer(b"".join(lists[r].as_py()), "<u2"))
                else:
                    at = np.arange(len(key))
                with np.errstate(over="ignore", invalid="ignore"):
                    score = (v[at] * q[r]).sum(1)
                if len(at) > k:
                    floor = np.partition(score, len(at) - k)[len(at) - k]
                    at, score = at[score >= floor], score[score >= floor]
                best = np.lexsort((ids[at], -score))[:k]
                for column, x in zip(out, (np.full(len(best), name), key[at[best]], ids[at[best]], score[best]), strict=True):
                    column.append(x)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table({c: np.concatenate(x).astype(kind) if x else np.zeros(0, kind) for c, x, kind in zip(("q", "key", "id", "score"), out, kinds, strict=True)})

    return run


def search(queries: DataFrame, corpus: DataFrame, k: int = 20, id_col="vec_id", vec_col="embedding", tables=TABLES, probes=PROBES, per_cell=PER_CELL, seed=5, scratch: Scratch | None = None) -> DataFrame:
    """Rows query_id, rank (from 1), vec_id, score: each query's k nearest found by inner product."""
    spark = corpus.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    sizes = _points(corpus, id_col, vec_col, None).groupBy(F.size("vec").alias("d")).count()
    common = sizes.orderBy(F.desc("count"), "d").first()
    dim = common.d if common else 1
    rows = scratch.table(_points(corpus, id_col, vec_col, dim), "rows", common["count"] if common else 0)
    asked = scratch.table(_points(queries, id_col, vec_col, dim), "asked", common["count"] if common else 0)

    first = W.partitionBy("key").orderBy("id")
    copies = scratch.table(rows.select("key", "id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1), "copies", rows.count())
    n = copies.where("r = 1").count()
    n_blocks = n // ROWS + 1
    alone = rows.join(copies.where("r = 1").select("id"), "id", "left_semi").withColumn("vb", F.pmod("key", F.lit(n_blocks)).cast("int"))
    slot = (F.row_number().over(W.partitionBy("vb").orderBy("key")) - 1).cast("int")
    alone = scratch.table(alone.withColumn("slot", slot), "distinct", 20 * rows.count())
    points = scratch.table(asked.join(asked.groupBy("key").agg(F.min("id").alias("id")).select("id"), "id", "left_semi").select("key", "vec"), "points", 200 * asked.count())
    choice = axes(n, dim, per_cell)
    spots = alone.select((F.col("vb").cast("long") * 65536 + F.col("slot")).alias("key"), "vec")
    index = scratch.table(_hashed(spots, tables, choice, 0, seed), "index", n * tables)
    hits = scratch.table(candidates(_hashed(points, tables, choice, probes, seed), index, n * tables), "candidates")

    def best(hits: DataFrame) -> DataFrame:
        """The k + 1 best keys of each query among its candidates, as rows q, key, id, score."""
        n_parts = max(1, -(-hits.count() // (n_blocks * QUERIES)))
        left = hits.join(points.select(F.col("key").alias("q"), "vec"), "q").withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(n_parts)).cast("int"))
        right = alone.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
        found = left.select("vb", "qb", "q", "vec", "slots").groupBy("vb", "qb").cogroup(right.select("vb", "qb", "slot", "key", "id", "vec").groupBy("vb", "qb")).applyInArrow(_nearest(k + 1), "q long, key long, id long, score double")
        order = W.partitionBy("q").orderBy(F.desc("score"), "id")
        return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")

    def spread(found: DataFrame) -> DataFrame:
        """Rows q, near: the k + 1 nearest ids with their scores, nearest first, copies included."""
        every = found.select("q", "key", "score").join(copies.select("key", "id"), "key")
        order = W.partitionBy("q").orderBy(F.desc("score"), "id")
        every = every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
        return every.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("near"))

    near = scratch.table(spread(best(hits)), "near", points.count())
    enough = min(k + 1, rows.count())
    few = points.join(near.where(F.size("near") >= enough).select(F.col("q").alias("key")), "key", "left_anti").select(F.col("key").alias("q"))
    few = scratch.table(few, "few", points.count())
    if not few.isEmpty():
        whole = few.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("slots", F.lit(None).cast("array<binary>"))
        near = near.join(few, "q", "left_anti").unionByName(spread(best(whole)))
    near = near.withColumnRenamed("q", "key").join(asked.groupBy("key").agg(F.count("*").alias("n")), "key")
    near = scratch.table(near, "answers", points.count())
    each = joined(asked.select(F.col("id").alias("query_id"), "key"), near, ["key"], ["query_id"], asked.count())
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    each = each.select("query_id", F.posexplode(others).alias("place", "one"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("one.id").alias("vec_id"), F.col("one.score").alias("score"))
