"""Postings, probes and votes: a forest search as joins and aggregates.

postings(tree, leaf, doc_id) has each vector once a tree; probes(qid, tree, leaf, score) are the leaves a query visits. A
document's votes are the number of distinct trees of which a visited leaf holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sylvine.functions.forest import Forest, calibrate

POSTINGS = "tree int, leaf int, doc_id long"
PROBES = "qid long, tree int, leaf int, score double"


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def postings(corpus: DataFrame, forest: Forest) -> DataFrame:
    """Routes (id, vec) through all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = forest.route(_rows(batch.column(1)))
                n, t = leaves.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(leaves.astype(np.int32).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), t))], ["tree", "leaf", "doc_id"])

    return corpus.select("id", "vec").mapInArrow(run, POSTINGS)


def probes(queries: DataFrame, forest: Forest, n_probes: int = 0, span: int | None = None, multi: bool = False) -> DataFrame:
    """The leaves of (id, vec) queries: the main one of each tree and n_probes near ones; span: only the last levels flip."""
    min_flip = 0 if span is None else max(0, forest.depth - span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in range(forest.n_trees if batch.num_rows else 0):
                rows, leaves, scores = forest.probe(_rows(batch.column(1)), t, n_probes, min_flip, multi)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), t, np.int32)), pa.array(leaves.astype(np.int32)), pa.array(scores)], ["qid", "tree", "leaf", "score"])

    return queries.select("id", "vec").mapInArrow(run, PROBES)


def traced(queries: DataFrame, forest: Forest) -> DataFrame:
    """Rows qid, tree, leaf, margins: how far each (id, vec) lies from the threshold at every level of its descent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sylvine.functions.forest import normalise

        for batch in batches:
            x = normalise(_rows(batch.column(1))) if batch.num_rows else None
            for t in range(forest.n_trees if batch.num_rows else 0):
                node, margins = forest.descend(x, t, np.zeros(len(x), np.int64), forest.depth)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * forest.depth), pa.array(np.abs(margins).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), t, np.int32)), pa.array((node - ((1 << forest.depth) - 1)).astype(np.int32)), lists], ["qid", "tree", "leaf", "margins"])

    return queries.select("id", "vec").mapInArrow(run, "qid long, tree int, leaf int, margins array<double>")


def deepened(corpus: DataFrame, posted: DataFrame, forest: Forest, extra: int) -> DataFrame:
    """Postings `extra` levels further down, from the leaves that `posted` has at the forest's depth."""
    lists = posted.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("tree", "leaf"))).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                have = np.asarray(batch.column(2).flatten(), np.int64).reshape(batch.num_rows, -1)
                leaves = forest.deepen(_rows(batch.column(1)), have, extra)
                n, t = leaves.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(leaves.astype(np.int32).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), t))], ["tree", "leaf", "doc_id"])

    return corpus.select("id", "vec").join(lists, "id").select("id", "vec", F.col("l.leaf").alias("leaves")).mapInArrow(run, POSTINGS)


def median_sample(corpus: DataFrame, forest: Forest, med_depth: int, sample: int = 5000) -> np.ndarray:
    """Thresholds from at most `sample` rows, every (n / sample)-th id."""
    n = corpus.count()
    rows = corpus.where(F.col("id") % max(1, n // sample) == 0).orderBy("id").limit(sample).select("vec").toArrow()
    return calibrate(forest, _rows(rows.column("vec").combine_chunks()), med_depth)


def strided_sample(corpus: DataFrame, sample: int = 5000, least: int = 1024) -> DataFrame:
    """Every (n / sample)-th row by order of id, `sample` at most; raises if the table has under `least` rows."""
    n = corpus.count()
    if n < least:
        raise ValueError(f"{n} rows are too few to calibrate with, {least} are needed")
    slot = corpus.groupBy(F.floor(F.col("id") / 4096).alias("key")).agg(F.count("*").alias("n"))
    from sylvine.operators.documents import before

    x = corpus.withColumn("key", F.floor(F.col("id") / 4096)).join(before(slot, 1), "key")
    place = F.col("before") + F.row_number().over(W.partitionBy("key").orderBy("id")) - 1
    step = n / min(sample, n)
    return x.withColumn("place", place).where(F.floor(F.ceil(F.col("place") / step) * step) == F.col("place")).select("id", "vec")


def leaf_sizes(posted: DataFrame) -> DataFrame:
    return posted.groupBy("tree", "leaf").agg(F.count("*").alias("n_docs"))


def leaf_scan(posted: DataFrame, tree: int, leaf: int) -> DataFrame:
    return posted.where((F.col("tree") == tree) & (F.col("leaf") == leaf)).select("doc_id")


def top_paths(probed: DataFrame, most: int) -> DataFrame:
    """The paths of largest margin of each query over all trees and probes; all if most <= 0."""
    if most <= 0:
        return probed
    order = W.partitionBy("qid").orderBy(F.desc("score"), "tree", "leaf")
    return probed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def top_paths_by_size(probed: DataFrame, sizes: DataFrame, most: int, cap: int | None = None) -> DataFrame:
    """The paths to the fullest leaves; empty leaves and those over the cap drop out."""
    x = probed.join(sizes, ["tree", "leaf"])
    x = x if cap is None else x.where(F.col("n_docs") <= cap)
    order = W.partitionBy("qid").orderBy(F.desc("n_docs"), "tree", "leaf")
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(*probed.columns)


def capped(probed: DataFrame, sizes: DataFrame, cap: int) -> DataFrame:
    """Probes whose leaf holds at most cap documents."""
    return probed.join(sizes.where(F.col("n_docs") > cap), ["tree", "leaf"], "left_anti").select(*probed.columns)


def leaf_capped(posted: DataFrame, cap: int) -> DataFrame:
    """Postings of at most cap documents a leaf, those of smallest ids: what stores with slots of a fixed size hold."""
    order = W.partitionBy("tree", "leaf").orderBy("doc_id")
    return posted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).drop("place")


def hot_merged(main: DataFrame, hot: DataFrame) -> DataFrame:
    """Postings of a frozen store and of what was added since, each (tree, leaf, document) once."""
    return main.unionByName(hot).dropDuplicates(["tree", "leaf", "doc_id"])


def compacted(main: DataFrame, hot: DataFrame, path: str, parts: int) -> DataFrame:
    """Writes both as one table sorted by tree, leaf and document in `parts` ranges, and reads it."""
    x = hot_merged(main, hot).select("tree", "leaf", "doc_id")
    x.repartitionByRange(parts, "tree", "leaf").sortWithinPartitions("tree", "leaf", "doc_id").write.parquet(path)
    return main.sparkSession.read.schema(POSTINGS).parquet(path)


def steered(probed: DataFrame, posted: DataFrame, allowed: DataFrame) -> DataFrame:
    """Probes whose leaf holds an allowed document."""
    live = posted.join(allowed, "doc_id", "left_semi").select("tree", "leaf").distinct()
    return probed.join(live, ["tree", "leaf"], "left_semi").select(*probed.columns)


def guided(queries: DataFrame, posted: DataFrame, allowed: DataFrame, forest: Forest) -> DataFrame:
    """Main leaves of a descent that takes the other child where the chosen one holds no allowed document.

    The driver holds one bit a leaf of the forest: n_trees * 2**depth, which must stay under 2**26.
    """
    if forest.n_trees << forest.depth > 1 << 26:
        raise ValueError("the forest has too many leaves for a guided descent")
    alive = np.zeros((forest.n_trees, (2 << forest.depth) - 1), bool)
    for r in posted.join(allowed, "doc_id", "left_semi").select("tree", "leaf").distinct().collect():
        alive[r.tree, r.leaf + (1 << forest.depth) - 1] = True
    for n in range((1 << forest.depth) - 2, -1, -1):
        alive[:, n] = alive[:, 2 * n + 1] | alive[:, 2 * n + 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sylvine.functions.forest import normalise

        for batch in batches:
            if not batch.num_rows:
                continue
            x = normalise(_rows(batch.column(1)))
            for t in range(forest.n_trees):
                node, score = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
                for _ in range(forest.depth):
                    margin = forest.differences(x, t, node) - forest.thresholds(t, node)
                    child = 2 * node + 1 + (margin > 0)
                    other = 4 * node + 3 - child
                    node = np.where(alive[t, child] | ~alive[t, other], child, other)
                    score = np.minimum(score, np.abs(margin))
                leaf = (node - ((1 << forest.depth) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), t, np.int32)), pa.array(leaf), pa.array(score)], ["qid", "tree", "leaf", "score"])

    return queries.select("id", "vec").mapInArrow(run, PROBES)


def votes(probed: DataFrame, posted: DataFrame, depth: int, query_depth: int = 0, allowed: DataFrame | None = None, tombstones: DataFrame | None = None, single: bool = False, unique: bool = True) -> DataFrame:
    """Rows qid, doc_id, votes. query_depth widens a leaf to its ancestor at that depth, as an equality of shifted leaves.

    allowed and tombstones (doc_id) act below the count. single: the caller vouches for one leaf a tree, so probes aren't made
    distinct. A document is in one leaf a tree, so rows are trees; unique=False where postings may hold it twice.
    """
    shift = depth - (query_depth or depth)
    if shift < 0:
        raise ValueError("query_depth exceeds the depth")
    posted = posted if allowed is None else posted.join(allowed.select("doc_id"), "doc_id", "left_semi")
    posted = posted if tombstones is None else posted.join(tombstones.select("doc_id"), "doc_id", "left_anti")
    left = probed.select("qid", "tree", F.shiftright("leaf", shift).alias("at"))
    left = left if single else left.distinct()
    x = left.join(posted.select("tree", F.shiftright("leaf", shift).alias("at"), "doc_id"), ["tree", "at"])
    count = F.count("*") if unique else F.count_distinct("tree")
    return x.groupBy("qid", "doc_id").agg(count.alias("votes"))


def top_n(counted: DataFrame, n: int | None) -> DataFrame:
    """The n documents with most votes of each query, ties to the smaller id; all if n is None."""
    if n is None:
        return counted
    order = W.partitionBy("qid").orderBy(F.desc("votes"), "doc_id")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def first_distinct(counted: DataFrame, most: int) -> DataFrame:
    """The votes of each query's first `most` documents by id, which is what a scan that stops at so many has seen."""
    order = W.partitionBy("qid").orderBy("doc_id")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def union_forests(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """Postings of several forests of one depth as one: (offset, postings), the offset added to a forest's tree numbers.

    Forests that share seeds and hold different documents have the same offset, so a document counts once a tree; other
    forests get offsets that keep their trees apart.
    """
    x = None
    for offset, posted in parts:
        own = posted.select((F.col("tree") + offset).cast("int").alias("tree"), "leaf", "doc_id")
        x = own if x is None else x.unionByName(own)
    return x.distinct()


def observed(counted: DataFrame, name: str = "votes"):
    """Votes with telemetry: (rows, observation); after an action, observation.get has n_candidates, n_distinct, n_votes."""
    from pyspark.sql import Observation

    o = Observation(name)
    return counted.observe(o, F.count("*").alias("n_candidates"), F.approx_count_distinct("doc_id").alias("n_distinct"), F.sum("votes").alias("n_votes")), o


def at_least(counted: DataFrame, threshold: int) -> DataFrame:
    return counted.where(F.col("votes") >= threshold)


def merged(parts: list[DataFrame]) -> DataFrame:
    """Votes of several forests or segments, summed by document."""
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    return x.groupBy("qid", "doc_id").agg(F.sum("votes").alias("votes"))


def balance(posted: DataFrame) -> DataFrame:
    """One row of drift measures: the fullest leaf over the mean, and the mean over trees of the leaves' deviation over their mean."""
    sizes = leaf_sizes(posted)
    trees = sizes.groupBy("tree").agg((F.max("n_docs") / F.avg("n_docs")).alias("peak"), (F.stddev_pop("n_docs") / F.avg("n_docs")).alias("cv"))
    return trees.agg(F.max("peak").alias("peak"), F.avg("cv").alias("cv"))
