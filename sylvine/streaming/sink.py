"""Metadata beside an index: rows by document in append-only tables, deletions by condition, compaction."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sylvine.streaming.live import Store


class MetadataSink:
    """Rows (doc_id, ...) under a folder. Each insert is a table with a number; of several rows of a document the last counts.

    log/NNNNNNNN.json lists the tables, {name, seq} each, as of a change; a change fails if another came first.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)

    def _log(self) -> tuple[list[dict], int]:
        names = self.store.names("log")
        return (json.loads(self.store.get(f"log/{names[-1]}")) if names else [], int(names[-1][:-5]) + 1 if names else 0)

    def _publish(self, tables: list[dict], number: int) -> None:
        self.store.put(f"log/{number:08d}.json", json.dumps(tables))

    def _write(self, rows: DataFrame, kind: str, number: int) -> dict:
        rows.write.parquet(f"{self.path}/{kind}/{number:08d}")
        return {"name": f"{kind}/{number:08d}", "kind": kind, "seq": number}

    def insert(self, rows: DataFrame) -> None:
        tables, n = self._log()
        self._publish([*tables, self._write(rows.withColumn("seq", F.lit(n).cast("long")), "rows", n)], n)

    def delete(self, where: Column | str) -> None:
        """Deletes the documents whose row meets the condition now."""
        tables, n = self._log()
        gone = self.rows().where(F.expr(where) if isinstance(where, str) else where).select("doc_id", F.lit(n).cast("long").alias("seq"))
        self._publish([*tables, self._write(gone, "gone", n)], n)

    def rows(self) -> DataFrame:
        tables, _ = self._log()
        own = [f"{self.path}/{t['name']}" for t in tables if t["kind"] == "rows"]
        if not own:
            return self.spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType())]))
        x = self.spark.read.option("mergeSchema", "true").parquet(*own)
        columns = [c for c in x.columns if c not in ("doc_id", "seq")]
        x = x.groupBy("doc_id").agg(F.max_by(F.struct("seq", *columns), "seq").alias("one"))
        gone = [f"{self.path}/{t['name']}" for t in tables if t["kind"] == "gone"]
        if gone:
            g = self.spark.read.parquet(*gone).groupBy(F.col("doc_id").alias("of")).agg(F.max("seq").alias("at"))
            x = x.join(g, (F.col("doc_id") == F.col("of")) & (F.col("one.seq") < F.col("at")), "left_anti")
        return x.select("doc_id", *[F.col("one").getField(c).alias(c) for c in columns])

    def compact(self) -> None:
        """Rewrites what is there as one table without deletions, and drops the others' names."""
        _, n = self._log()
        self._publish([self._write(self.rows().withColumn("seq", F.lit(n).cast("long")), "rows", n)], n)

    def density(self, where: Column | str | None) -> float:
        from sylvine.operators.meta import density

        return density(self.rows(), where)
