"""A client of a catalog: indexes by name, inserts one by one or in batches, asynchronous calls."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from sylvine.functions.forest import Forest
from sylvine.plans.search import SearchSpec
from sylvine.streaming.live import Catalog
from sylvine.streaming.sink import MetadataSink


class Client:
    """Calls by index name. Metadata goes to a sink beside each index, and conditions are read from it.

    Errors are Python's: ValueError for a bad argument, KeyError for no such index, FileExistsError for one that is there,
    BufferError for a full buffer.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.catalog, self.root = spark, Catalog(spark, root), root.rstrip("/")

    def health(self) -> dict:
        return {"indexes": len(self.catalog.list()), "wrong": {n: w for n in self.catalog.list() if (w := self.catalog.open(n).verify())}}

    def list(self, pattern: str = "*") -> list[str]:
        return self.catalog.list(pattern)

    def exists(self, name: str) -> bool:
        return self.catalog.exists(name)

    def stats(self, name: str) -> dict:
        return self.catalog.open(name).stats()

    def create(self, name: str, dim: int, n_trees: int = 64, depth: int = 10, **options) -> None:
        self.catalog.create(name, Forest(n_trees=n_trees, depth=depth, dim=dim), **options)

    def drop(self, name: str) -> None:
        self.catalog.drop(name)

    def freeze(self, name: str) -> None:
        self.catalog.open(name).freeze()

    def sink(self, name: str) -> MetadataSink:
        return MetadataSink(self.spark, f"{self.root}/{name}/sink")

    def insert(self, name: str, vec: Iterable[float], id: int | None = None, **meta) -> int:
        """Inserts one vector and returns its id: the next free one if none is given."""
        return self.insert_batch(name, [vec], None if id is None else [id], [meta] if meta else None)[0]

    def insert_batch(self, name: str, vecs: Iterable[Iterable[float]], ids: Iterable[int] | None = None, metas: Iterable[dict] | None = None, batch: str | None = None) -> list[int]:
        index = self.catalog.open(name)
        x = np.asarray(list(vecs), np.float64)
        if x.ndim != 2 or x.shape[1] != index.forest().dim:
            raise ValueError(f"vectors of dimension {index.forest().dim} are wanted")
        first = index.next_id() if ids is None else 0
        ids = list(range(first, first + len(x))) if ids is None else [int(i) for i in ids]
        if len(ids) != len(x):
            raise ValueError("as many ids as vectors are wanted")
        rows = self.spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, vec array<double>")
        if index.insert(rows, batch) and metas is not None:
            self.sink(name).insert(self.spark.createDataFrame([{"doc_id": i, **m} for i, m in zip(ids, metas, strict=True)]))
        return ids

    def delete(self, pattern: str, ids: Iterable[int] | None = None, where: Column | str | None = None) -> list[str]:
        """Deletes ids, or what a condition on each index's own metadata selects, from all indexes that match."""
        names = self.catalog.list(pattern)
        if not names:
            raise KeyError(pattern)
        for name in names:
            if ids is not None:
                gone = self.spark.createDataFrame([(int(i),) for i in ids], "id long")
                self.catalog.delete(name, gone)
            else:
                sink = self.sink(name)
                self.catalog.delete(name, meta=sink.rows(), where=where)
                sink.delete(where)
        return names

    def search(self, pattern: str, vecs: Iterable[Iterable[float]], where: Column | str | None = None, spec: SearchSpec = SearchSpec()) -> DataFrame:
        """Rows qid (the place of the query), index, doc_id, dist, rank over all indexes that match."""
        queries = self.spark.createDataFrame([(i, [float(v) for v in q]) for i, q in enumerate(vecs)], "id long, vec array<double>")
        if where is None:
            return self.catalog.search(pattern, queries, spec)
        allowed = None
        for name in self.catalog.list(pattern):
            own = self.sink(name).rows().where(where).select("doc_id")
            allowed = own if allowed is None else allowed.unionByName(own)
        if allowed is None:
            raise KeyError(pattern)
        return self.catalog.search(pattern, queries, spec, allowed.distinct())


class AsyncClient:
    """The same calls as futures. Searches run beside one another; changes of the indexes go one after another."""

    def __init__(self, client: Client, threads: int = 4):
        self.client, self.pool, self.changes = client, ThreadPoolExecutor(threads), ThreadPoolExecutor(1)

    def __getattr__(self, name: str) -> Callable[..., Future]:
        call = getattr(self.client, name)
        pool = self.changes if name in ("create", "drop", "freeze", "insert", "insert_batch", "delete") else self.pool
        return lambda *args, **options: pool.submit(call, *args, **options)

    def close(self) -> None:
        self.pool.shutdown()
        self.changes.shutdown()


class TokenBucket:
    """Admits `rate` units a second on average, `burst` at once at most."""

    def __init__(self, rate: float = 1000.0, burst: int = 1024, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.free, self.at = float(burst), clock()

    def take(self, n: int = 1) -> None:
        """Waits until n units are free; more than the burst are waited for in turns."""
        while n > 0:
            part = min(n, self.burst)
            now = self.clock()
            self.free, self.at = min(self.burst, self.free + (now - self.at) * self.rate), now
            if self.free < part:
                self.sleep((part - self.free) / self.rate)
                continue
            self.free -= part
            n -= part


class BatchedInserter:
    """Gathers vectors and inserts them when there are `size` or the first has waited `seconds`; closing inserts the rest.

    A thread looks after the time, so a batch goes even if no vector follows. Errors of a batch are raised by the next call.
    """

    def __init__(self, client: Client, name: str, size: int = 1000, seconds: float = 5.0, bucket: TokenBucket | None = None):
        self.client, self.name, self.size, self.seconds, self.bucket = client, name, size, seconds, bucket
        self.rows: list[tuple[int, list[float]]] = []
        self.since, self.error = 0.0, None
        self.lock, self.closed = threading.Condition(), False
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()

    def add(self, id: int, vec: Iterable[float]) -> None:
        if self.bucket:
            self.bucket.take()
        with self.lock:
            self._raise()
            if self.closed:
                raise ValueError("the inserter is closed")
            if not self.rows:
                self.since = time.monotonic()
            self.rows.append((int(id), [float(v) for v in vec]))
            if len(self.rows) >= self.size:
                self._flush()
            self.lock.notify()

    def _raise(self) -> None:
        if self.error:
            error, self.error = self.error, None
            raise error

    def _flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.client.insert_batch(self.name, [v for _, v in rows], [i for i, _ in rows])

    def _watch(self) -> None:
        with self.lock:
            while not self.closed:
                wait = self.since + self.seconds - time.monotonic() if self.rows else None
                if wait is not None and wait <= 0:
                    try:
                        self._flush()
                    except Exception as e:  # noqa: BLE001  the next call raises it
                        self.error = e
                else:
                    self.lock.wait(wait)

    def close(self) -> None:
        with self.lock:
            self._flush()
            self.closed = True
            self.lock.notify()
            self._raise()
        self.thread.join()

    def __enter__(self) -> BatchedInserter:
        return self

    def __exit__(self, *_) -> None:
        self.close()
