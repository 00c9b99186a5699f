"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FILE_ROWS = 100_000
_OWN: dict[str, str] = {}
_MADE: set[Scratch] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sylvine-")
    return _OWN[app]


class Scratch:
    """Tables written once and read by later jobs; they cut the lineage, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/sylvine/{name}-{uuid.uuid4().hex[:12]}", 0
        _MADE.add(self)

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Writes and rereads a table. rows: at most how many it has, for no more files than FILE_ROWS rows each make."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df = df if rows is None else df.coalesce(rows // FILE_ROWS + 1)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the tables; nothing lazy may still need them. What isn't dropped goes when the driver's Python ends."""
        _MADE.discard(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def drop_all() -> None:
    """Deletes the tables of finished queries, as far as their session is still there."""
    for scratch in list(_MADE):
        try:
            scratch.drop()
        except Exception:  # the session is gone: nothing can be deleted through it any more
            _MADE.clear()


def drop_own() -> None:
    """Deletes the temporary folders that this process made in local mode."""
    for folder in _OWN.values():
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
    _OWN.clear()
