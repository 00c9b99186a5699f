"""Binary vector and id files as a Spark data source, split by byte ranges, and their writers.

Formats: fvecs, bvecs, ivecs (each row is an int32 length and its components), fbin, u8bin, f16bin (uint32 rows and
dimension, then rows), ibin (the same of ids, and distances may follow, as big truth files have them), npy (a 2-d array),
int32 (bare ids). Ids are row numbers. Paths with a scheme (s3a://, hdfs://, gs://) are opened through Arrow's file
systems on the executors, others as local files. A file that still grows is read as a stream of its whole rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ROW_KINDS = {"fvecs": "<f4", "bvecs": "u1", "ivecs": "<i4"}
HEAD_KINDS = {"fbin": "<f4", "u8bin": "u1", "f16bin": "<f2", "ibin": "<u4"}
SPLIT_BYTES = 64 << 20


def format_of(path: str) -> str:
    end = path.rsplit(".", 1)[-1].lower()
    return end if end in ROW_KINDS or end in HEAD_KINDS or end in ("npy", "int32") else "fvecs"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
    return fs.LocalFileSystem(), path


def layout(path: str, kind: str | None = None, growing: bool = False) -> tuple[str, str, int, int, int, int]:
    """Format, component type, rows, dimension, bytes before the first row, bytes a row; raises if rows don't fit the size.

    A head that promises more rows than there are is taken as a file still being written: whole rows count.
    """
    kind, (system, name) = kind or format_of(path), _at(path)
    size = system.get_file_info(name).size or 0
    with system.open_input_file(name) as f:
        if kind in ROW_KINDS:
            dim = int(np.frombuffer(f.read(4), "<i4")[0]) if size >= 4 else 0
            item = np.dtype(ROW_KINDS[kind])
            width = 4 + dim * item.itemsize
            if size and (dim <= 0 or size % width and not growing):
                raise ValueError(f"{path}: {size} bytes aren't whole rows of dimension {dim}")
            return kind, item.str, size // width if size else 0, dim, 0, width
        if kind in HEAD_KINDS:
            n, dim = (int(v) for v in np.frombuffer(f.read(8), "<u4"))
            item = np.dtype(HEAD_KINDS[kind])
            width = dim * item.itemsize
            if size - 8 > n * width and not (kind == "ibin" and size - 8 == 2 * n * width):
                raise ValueError(f"{path}: {size - 8 - n * width} bytes after the last row")
            return kind, item.str, min(n, (size - 8) // width), dim, 8, width
        if kind == "npy":
            major = np.lib.format.read_magic(f)[0]
            shape, fortran, item = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(f)
            if len(shape) != 2 or fortran:
                raise ValueError(f"{path}: not a 2-d array in row order")
            return kind, item.str, shape[0], shape[1], f.tell(), shape[1] * item.itemsize
        if kind == "int32":
            return kind, "<i4", size // 4, 1, 0, 4
    raise ValueError(f"unknown format {kind!r}")


class Span(InputPartition):
    def __init__(self, path: str, first: int, rows: int):
        self.path, self.first, self.rows = path, first, rows


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        _, _, n, _, _, width = layout(self.path, self.kind)
        step = max(1, self.split // max(1, width))
        return [Span(self.path, i, min(step, n - i)) for i in range(0, n, step)] or [Span(self.path, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        kind, item, _, dim, head, width = layout(span.path, self.kind, True)
        whole = kind in ("ivecs", "ibin", "int32")
        system, name = _at(span.path)
        with system.open_input_file(name) as f:
            f.seek(head + span.first * width)
            for i in range(0, span.rows, 4096):
                n = min(4096, span.rows - i)
                raw = np.frombuffer(f.read(n * width), np.uint8).reshape(n, width)
                raw = raw[:, 4:] if kind in ROW_KINDS else raw
                x = np.ascontiguousarray(raw).view(item).astype(np.int64 if whole else np.float32)
                ids = pa.array(np.arange(span.first + i, span.first + i + n))
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([ids, values], ["id", "ids" if whole else "vec"])


class Tail(DataSourceStreamReader):
    """The rows of a file that grows: each micro-batch has the whole rows that came since the last."""

    def __init__(self, options: dict):
        self.inner = Reader(options)

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": layout(self.inner.path, self.inner.kind, True)[2]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        width = layout(self.inner.path, self.inner.kind, True)[5]
        step = max(1, self.inner.split // max(1, width))
        return [Span(self.inner.path, i, min(step, end["rows"] - i)) for i in range(start["rows"], end["rows"], step)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        return self.inner.read(span)


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sylvine-vectors"

    def schema(self) -> str:
        kind = self.options.get("kind") or format_of(self.options["path"])
        return "id long, ids array<long>" if kind in ("ivecs", "ibin", "int32") else "id long, vec array<float>"

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options) | {"splitBytes": self.options.get("splitBytes", str(SPLIT_BYTES))})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Tail(dict(self.options) | {"splitBytes": self.options.get("splitBytes", str(SPLIT_BYTES))})


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Rows (id, vec), or (id, ids) of id files."""
    spark.dataSource.register(VectorSource)
    r = spark.read.format("sylvine-vectors")
    return (r.option("kind", kind) if kind else r).load(path)


def tail(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A stream of the rows of a file that grows."""
    spark.dataSource.register(VectorSource)
    r = spark.readStream.format("sylvine-vectors")
    return (r.option("kind", kind) if kind else r).load(path)


def papers(df: DataFrame, id_col: str = "id", categories: str = "categories", year: str = "year", vec_col: str | None = None, dim: int | None = None) -> DataFrame:
    """Papers as a corpus: the id column, category (the first of a list parted by spaces), top (before its dot), year (two
    digits count from 2000) and internal_id, consecutive in order of the id; and vec where asked.

    Rows without a category, an id or a vector of the dimension are skipped.
    """
    from sylvine.operators.documents import SLOT, before
    from pyspark.sql import Window as W

    first = F.split(F.trim(F.col(categories)), " ")[0]
    x = df.select(F.col(id_col), first.alias("category"), F.col(year).cast("long").alias("year"), *([F.col(vec_col).alias("vec")] if vec_col else []))
    x = x.where(F.col(id_col).isNotNull() & (F.col("category") != ""))
    x = x.where(F.size("vec") == dim) if vec_col and dim else x
    slot = F.floor(F.col(id_col) / SLOT)
    base = before(x.groupBy(slot.alias("key")).agg(F.count("*").alias("n")), 1)
    x = x.withColumn("key", slot).join(base, "key")
    place = F.col("before") + F.row_number().over(W.partitionBy("key").orderBy(id_col)) - 1
    year_of = F.when(F.col("year") < 100, F.col("year") + 2000).otherwise(F.col("year"))
    return x.select(id_col, "category", F.substring_index("category", ".", 1).alias("top"), year_of.alias("year"), place.cast("long").alias("internal_id"), *(["vec"] if vec_col else []))


def truth(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Ground truth files as rows qid, rank, doc_id."""
    return read(spark, path, kind).selectExpr("id AS qid", "posexplode(ids) AS (r, doc_id)").selectExpr("qid", "r + 1 AS rank", "doc_id")


def id_filter(spark: SparkSession, path: str, n_docs: int) -> DataFrame:
    """A file of bare int32 ids as rows doc_id; ids outside 0 to n_docs - 1 drop out."""
    return read(spark, path, "int32").selectExpr("ids[0] AS doc_id").where(f"doc_id >= 0 AND doc_id < {n_docs}").distinct()


def write(rows: DataFrame, path: str, kind: str = "fvecs") -> int:
    """Writes vectors in order of id, row after row; returns how many. The driver sees one row at a time."""
    n, column = 0, "vec" if "vec" in rows.columns else "ids"
    with open(path, "wb") as f:
        if kind in HEAD_KINDS:
            f.write(bytes(8))
        for r in rows.orderBy("id").toLocalIterator():
            x = np.asarray(r[column]).astype((ROW_KINDS | HEAD_KINDS)[kind])
            f.write((np.int32(len(x)).tobytes() if kind in ROW_KINDS else b"") + x.tobytes())
            n, dim = n + 1, len(x)
        if kind in HEAD_KINDS:
            f.seek(0)
            f.write(np.array([n, dim if n else 0], "<u4").tobytes())
    return n


def write_parts(rows: DataFrame, folder: str, kind: str = "fvecs") -> int:
    """Writes vectors in order of id as part files, each partition its own, in parallel; returns how many rows.

    A part is written under another name and renamed when it is whole, so a task that runs twice leaves one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = _at(folder)
        system.create_dir(base, recursive=True)
        name, n, dim = f"{base}/part-{TaskContext.get().partitionId():05d}", 0, 0
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(part) as f:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1).astype(ROW_KINDS[kind])
                n, dim = n + len(x), x.shape[1]
                raw = np.empty((len(x), 4 + dim * x.itemsize), np.uint8)
                raw[:, :4] = np.frombuffer(np.int32(dim).tobytes(), np.uint8)
                raw[:, 4:] = x.view(np.uint8).reshape(len(x), -1)
                f.write(raw.tobytes())
        if n:
            system.move(part, f"{name}.{kind}")
        else:
            system.delete_file(part)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    if kind not in ROW_KINDS:
        raise ValueError(f"{kind} has a head with the number of rows: write one file")
    column = "vec" if "vec" in rows.columns else "ids"
    return rows.select("id", column).repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_results(found: DataFrame, path: str) -> None:
    """Search results as CSV, one line a query: its id and the ids found in order."""
    rows = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    rows.select(F.concat_ws(",", F.col("qid").cast("string"), F.array_join(F.col("r.doc_id").cast("array<string>"), ",")).alias("line")).write.text(path)
