"""The pipeline over documents: quality, near-duplicates, repeated passages, mixture, segmentations.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the runner writes as Parquet and rereads as the next
stage's docs. All but the last return the columns of documents. Rows without an id can't be joined with decisions about
them, so near-duplicate removal keeps them as they are; the mixture repeats and samples them like any other row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvine.llm import mixing, neardup, quality, segment, suffix
from sylvine.scratch import Scratch

PERCENT = 80  # near-duplicates from a similarity of 0.8
ORACLE_SQL = None  # trained models, hashes and suffix arrays are beyond SQL; the stages are tested against brute force
# What lies between the spans, each piece without the bytes of characters cut through at its ends.
PIECES = r"""transform(
  zip_with(concat(array(0L), spans.end), concat(spans.start, array(n_bytes)), (a, b) -> substring(CAST(carried.text AS BINARY), CAST(a + 1 AS INT), CAST(b - a AS INT))),
  p -> CAST(substring(p,
    1 + length(regexp_extract(hex(substring(p, 1, 3)), '^(?:[89AB].)*', 0)) DIV 2,
    length(p) - length(regexp_extract(hex(substring(p, 1, 3)), '^(?:[89AB].)*', 0)) DIV 2
      - length(regexp_extract(hex(substring(p, -3, 3)), '(?:[CDEF].|E.[89AB].|F.(?:[89AB].){1,2})$', 0)) DIV 2) AS STRING))"""
_last: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A new folder for intermediate tables; the stage before has been written, so its tables can go."""
    while _last:
        _last.pop().drop()
    _last.append(Scratch(spark, name))
    return _last[-1]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    _scratch(spark, "quality")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    found = neardup.group(docs, percent=PERCENT, scratch=_scratch(spark, "neardup"))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    # Of rows that repeat an id only one stays, that of the least hash of its text.
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    once = kept.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("order"))
    once = once.groupBy("doc_id").agg(F.min_by("row", "order").alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that repeat anywhere; a character cut through loses its rest, and n_chars follows the text."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    cut = suffix.dedup(row, carry="row", scratch=_scratch(spark, "suffix"))
    touched = F.col("n_removed") > 0
    text = F.when(touched, F.make_valid_utf8(F.array_join(F.expr(PIECES), ""))).otherwise(F.col("carried.text"))
    values = {"text": text, "n_chars": F.when(touched, F.length(text).cast("long")).otherwise(F.col("carried.n_chars"))}
    return cut.select(*[values.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that the sources come to their shares; each copy is a row."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    mixed = mixing.mix(row, carry="row", scratch=_scratch(spark, "mixing"))
    # A document cut at its source's target is kept whole here, and one without words is no word of the mix.
    times = F.ceil(F.col("taken") / F.expr("nullif(size, 0)")).cast("int")
    x = mixed.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return x.select(*[F.col("carried").getField(c).alias(c) for c in docs.columns])


def segment_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every row: doc_id, sample, n_pieces, log_prob, log_inclusion, ids."""
    _scratch(spark, "segment")
    return segment.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", neardup_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", segment_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = between.table(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
