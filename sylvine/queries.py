"""Registered queries over whole tables, by operator, and SQL that gives the same rows.

The query set of a search is every vector whose id is divisible by 50, against all vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvine import oracles as Q
from sylvine.functions.distance import normalised
from sylvine.functions.forest import Forest
from sylvine.operators import blocks, documents as D, knn, meta as M, votes as V
from sylvine.operators.project import projected
from sylvine.oracles import DOT, L2
from sylvine.plans import jobs, search as S
from sylvine.plans.search import SearchSpec
from sylvine.scratch import Scratch
from sylvine.sources import bitmaps
from sylvine.sources.vectors import papers
from sylvine.streaming.live import Catalog, LiveIndex, Store
from sylvine.streaming.sink import MetadataSink

SMALL = Forest(n_trees=4, depth=4, dim=64)
MID = Forest(n_trees=32, depth=4, dim=64)
PERMUTED = replace(SMALL, node_perm=True)
SUBSPACE = replace(SMALL, tree_sub=32, tree_sub_groups=2)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return knn.vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).where("id % 50 = 0")


def tidy(x: DataFrame) -> DataFrame:
    return x.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("dist", 6).alias("dist"))


def labels_of(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of vectors by rule: label, category, year."""
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return x.selectExpr("doc_id", "label", "concat('c', doc_id % 10) AS category", "2015 + doc_id % 10 AS year")


def described(spark: SparkSession, d: str) -> DataFrame:
    """Documents with typed metadata: text fields, an integer, a flag, a scaled float, an array."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.selectExpr("doc_id", "lang", "source", "n_chars", "quality", "toxic = 1 AS toxic", "CAST(doc_id % 1000 AS DOUBLE) / 100 AS score", "array(lang, source) AS tags")


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents of ready chunks."""
    x = table(spark, d, "conversations").selectExpr("conv_id AS parent", "CAST(turn AS INT) AS turn", "text")
    first = x.groupBy("parent").agg(F.min("turn").alias("t"))
    return D.numbered(x.join(first, "parent").selectExpr("parent", "turn - t AS seq", "text"))


def half(n: int) -> int:
    """How many candidates a search over these vectors takes: they are random directions, so a fixed number would hold ever
    fewer of the true neighbours as the table grows."""
    return max(200, -(-n // 3))


def _folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, name).path


def _index(spark: SparkSession, d: str) -> LiveIndex:
    """Four segments made one, two levels deeper; a buffer; deletions before and after."""
    index = LiveIndex(spark, _folder(spark, "live"), SMALL, max_active=0)
    x = corpus(spark, d)
    for part in range(4):
        index.insert(x.where(F.col("id") % 5 == part), f"b{part}")
        index.freeze()
    index.insert(x.where("id % 5 = 4"))
    index.delete(x.where("id % 17 = 0").select("id"))
    return index


def live_search(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_index(spark, d).search(asked(spark, d), SearchSpec(n_probes=3, top_n=200)))


def compaction(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the segment that four were compacted to, as of depth 6, whatever depth the table's size makes them have."""
    index = _index(spark, d)
    s = index.manifest()["segments"][0]
    return index.postings(s).select("doc_id", F.col("tree").cast("long").alias("tree"), F.shiftright("leaf", s["depth"] - 6).cast("long").alias("leaf"))


def delete_reinsert(spark: SparkSession, d: str) -> DataFrame:
    """Ids deleted, frozen away, and some of them inserted again: those that are there, and tombstones left."""
    index, x = LiveIndex(spark, _folder(spark, "live"), SMALL, max_active=0), corpus(spark, d)
    index.insert(x)
    index.freeze()
    index.delete(x.where("id % 17 = 0").select("id"))
    index.insert(x.where("id % 34 = 0"))
    index.freeze()
    return index.vectors().select("id")


def live_medians(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of a segment made after thresholds were taken from a sample, by an index opened anew."""
    path, x = _folder(spark, "live"), corpus(spark, d)
    index = LiveIndex(spark, path, SMALL, max_active=0)
    index.insert(x)
    index.recalibrate(3)
    LiveIndex(spark, path, max_active=0).freeze()
    s = index.manifest()["segments"][0]
    return index.postings(s).select("doc_id", F.col("tree").cast("long").alias("tree"), F.shiftright("leaf", s["depth"] - 4).cast("long").alias("leaf"))


def _hot(spark: SparkSession, d: str) -> LiveIndex:
    """A frozen third, and the rest appended in two parts that overlap."""
    index, x = LiveIndex(spark, _folder(spark, "live"), SMALL, max_active=0), corpus(spark, d)
    index.append(x.where("id % 3 = 0"))
    index.merge_hot()
    index.append(x.where("id % 3 = 1"))
    index.append(x.where("id % 3 > 0"))
    return index


def hot_search(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_hot(spark, d).search(asked(spark, d), SearchSpec(n_probes=3, top_n=None)))


def hot_compaction(spark: SparkSession, d: str) -> DataFrame:
    index = _hot(spark, d)
    index.merge_hot()
    m = index.manifest()["segments"]
    return index.postings(*m).groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs")).select(F.col("tree").cast("long").alias("tree"), "n", "n_docs")


def delete_where(spark: SparkSession, d: str) -> DataFrame:
    """Two indexes, one of which matches a pattern and loses what a condition on metadata selects."""
    catalog, x = Catalog(spark, _folder(spark, "catalog")), corpus(spark, d)
    for i, name in enumerate(("docs-a", "media")):
        catalog.create(name, SMALL, max_active=0).insert(x.where(F.col("id") % 2 == i))
    sink = MetadataSink(spark, _folder(spark, "meta"))
    sink.insert(labels_of(spark, d))
    catalog.delete("docs-*", meta=sink.rows(), where="label < 3")
    sink.delete("label < 3")
    left = catalog.open("docs-a").vectors().unionByName(catalog.open("media").vectors()).select(F.col("id").alias("doc_id"))
    return left.join(sink.rows().select("doc_id", F.lit(True).alias("described")), "doc_id", "left").select("doc_id", F.coalesce("described", F.lit(False)).alias("described"))


def backup_restore(spark: SparkSession, d: str) -> DataFrame:
    """Ids of an index restored from a backup taken before more were deleted, and of a copy of the changed one."""
    catalog, x = Catalog(spark, _folder(spark, "catalog")), corpus(spark, d)
    index = catalog.create("a", SMALL, max_active=0)
    index.insert(x)
    index.delete(x.where("id % 3 = 0").select("id"))
    catalog.backup("a", path := _folder(spark, "backup"))
    index.delete(x.where("id % 5 = 0").select("id"))
    old, now = catalog.restore(path, "b"), catalog.copy("a", "c")
    return old.vectors().select(F.lit("restored").alias("index"), "id").unionByName(now.vectors().select(F.lit("copied").alias("index"), "id"))


def pattern_search(spark: SparkSession, d: str) -> DataFrame:
    catalog, x = Catalog(spark, _folder(spark, "catalog")), corpus(spark, d)
    for i, name in enumerate(("docs-202401", "docs-202402", "media-202401")):
        index = catalog.create(name, SMALL, max_active=0)
        index.append(x.where(F.col("id") % 3 == i))
    found = catalog.search("docs-*", asked(spark, d), SearchSpec(n_probes=3, top_n=100))
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "index", "doc_id", F.round("dist", 6).alias("dist"))


def forest_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: route, join, vote, keep the best, rerank. 32 trees of 16 leaves, 4 of them probed."""
    x, q = corpus(spark, d), asked(spark, d)
    return tidy(S.search(q, x, V.postings(x, MID), MID, SearchSpec(n_probes=3, top_n=half(x.count()))))


def _votes(spark, d, forest=SMALL, **options):
    x = corpus(spark, d)
    return V.votes(V.probes(asked(spark, d), forest), V.postings(x, forest), forest.depth, single=True, **options)


def _quantised(bits: int):
    """A third of the table by votes, the best tenth of it by quantised scores, then exact distances."""

    def run(spark, d):
        x, q = corpus(spark, d), asked(spark, d)
        return tidy(blocks.search(q, x, MID, 3, half, lambda n: max(100, -(-n // 10)), Scratch(spark, "quantised"), bits))

    return run


def _contexts(spark, d):
    chunks = chunk_rows(spark, d)
    ranked = chunks.withColumn("qid", F.explode(F.sequence(F.lit(1), F.lit(5)))).selectExpr("CAST(qid AS BIGINT) AS qid", "chunk_id AS doc_id", "CAST(abs(length(text) - 100 * qid) AS DOUBLE) AS dist")
    x = D.best_parents(ranked, chunks, top_docs=5, window=1)
    return x.selectExpr("qid", "CAST(place AS BIGINT) AS place", "parent", "seq", "dist", "concat_ws('|', context) AS context")


def _drift(spark, d):
    x = V.balance(V.postings(corpus(spark, d), SMALL))
    return x.select(F.round("peak", 9).alias("peak"), F.round("cv", 9).alias("cv"))


def _recall(spark, d):
    return knn.recall(forest_search(spark, d), knn.exact(asked(spark, d), corpus(spark, d), 10), 10).select(F.round("recall", 9).alias("recall"))


def _doc_recall(spark, d):
    """Every five vectors are the chunks of a document."""
    parents = corpus(spark, d).selectExpr("id AS chunk_id", "id DIV 5 AS parent")
    x = D.doc_recall(forest_search(spark, d), knn.exact(asked(spark, d), corpus(spark, d), 1), parents)
    return x.select(F.round("recall", 9).alias("recall"))


def _chunked(spark, d):
    return D.numbered(D.chunks(table(spark, d, "documents"))).select("chunk_id", "parent", "seq", "off", F.length("text").alias("size"))


def _store(spark, d) -> D.DocumentStore:
    """Conversations as documents of ready chunks, by key; some are deleted, and some of those inserted again, shorter."""
    store = D.DocumentStore(spark, _folder(spark, "documents"), SMALL)
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    docs = turns.select(F.concat(F.lit("conv"), F.col("conv_id")).alias("key"), F.col("t.text").alias("chunks"), F.create_map(F.lit("odd"), (F.col("conv_id") % 2).cast("string")).alias("meta"), "conv_id")
    store.insert(docs.drop("conv_id"))
    store.delete(docs.where("conv_id % 7 = 0").select("key"))
    store.insert(docs.where("conv_id % 14 = 0").select("key", F.slice("chunks", 1, 1).alias("chunks"), "meta"))
    return store


def _inserted(spark, d):
    return _store(spark, d).documents().select("key", "n_chunks", F.col("meta.odd").alias("odd"))


def _deleted(spark, d):
    store = _store(spark, d)
    return store.chunk_rows().groupBy("parent").agg(F.count("*").alias("n")).join(store.documents().select("key", "parent"), "parent").select("key", "n")


def _by_key(spark, d):
    keys = table(spark, d, "conversations").select(F.concat(F.lit("conv"), F.col("conv_id")).alias("key")).where("key LIKE '%4'")
    return _store(spark, d).get(keys).select("key", F.concat_ws("|", "chunks").alias("text"))


def _store_search(spark, d):
    """First turns as queries: the nearest live documents with metadata odd = 1, by exact distances of their embeddings."""
    store = _store(spark, d)
    q = table(spark, d, "conversations").where("turn = 1 AND conv_id % 50 = 0").select(F.col("conv_id").alias("qid"), "text")
    found = store.search(q, SearchSpec(n_probes=None, top_n=None, top_k=50), "meta.odd = '1'")
    return found.select("qid", "place", "key", "seq", F.round("dist", 6).alias("dist"), F.size("context").alias("n_context"))


def _document_search(spark, d):
    chunks = Scratch(spark, "chunks").table(D.embed(D.numbered(D.chunks(table(spark, d, "documents")))), "chunks")
    x = chunks.select(F.col("chunk_id").alias("id"), "vec")
    q = D.embed(table(spark, d, "benchmark")).select(F.col("item_id").alias("id"), "vec")
    ranked = knn.exact(q, x, 50, "l2", include_self=True)
    return D.best_parents(ranked, chunks).select("qid", "place", "parent", "seq", F.size("context").alias("n_context"))


def _where(**conditions):
    def run(spark, d):
        x = described(spark, d)
        return x.where(M.where(x.schema, conditions, {"score": 2})).select("doc_id")

    return run


def _planes(spark, d):
    """All planes of a forest: the seeds' rule, which must hold to the bit."""
    rows = []
    for t in range(SMALL.n_trees):
        dims, weights = SMALL.planes(t, np.arange((1 << SMALL.depth) - 1))
        rows += [(t, n, k, int(dims[n, k]), round(float(weights[n, k]), 9)) for n in range(len(dims)) for k in range(SMALL.sub_dim)]
    return spark.createDataFrame(rows, "tree long, node long, place long, dim long, weight double")


def _paths(x: DataFrame) -> DataFrame:
    return x.select("qid", F.col("tree").cast("long").alias("tree"), F.col("leaf").cast("long").alias("leaf"), F.round("score", 9).alias("score"))


def _leaves(x: DataFrame) -> DataFrame:
    return x.select("doc_id", F.col("tree").cast("long").alias("tree"), F.col("leaf").cast("long").alias("leaf"))


def _categories(spark, d):
    """Pages as papers: primary category and its group, years of two digits, consecutive numbers of those with a category."""
    x = table(spark, d, "pages").select("page_id", F.split(F.col("url"), "/")[2].alias("categories"), (F.col("page_id") % 130).alias("year"))
    return papers(x, "page_id", "categories", "year")


def _multi_forest(spark, d):
    """Two forests of one seed over halves of the corpus count as one, a third of other seeds counts apart."""
    x, q = corpus(spark, d), asked(spark, d)
    other = replace(SMALL, n_trees=2, node_perm=True)
    posted = V.union_forests([(0, V.postings(x.where("id % 2 = 0"), SMALL)), (0, V.postings(x.where("id % 2 = 1"), SMALL)), (4, V.postings(x, other))])
    probed = V.probes(q, SMALL).unionByName(V.probes(q, other).withColumn("tree", F.col("tree") + 4))
    return V.votes(probed, posted, 4)


def _resumed(spark, d):
    """A build of postings in four parts, of which one is lost and built again."""
    path = _folder(spark, "build")
    jobs.build(corpus(spark, d), SMALL, path, 4)
    Store(spark, path).drop("part=1")
    return _leaves(jobs.build(corpus(spark, d), SMALL, path, 4)[0])


def _sinked(spark, d):
    """Metadata inserted in two batches, deleted by a condition, compacted."""
    sink = MetadataSink(spark, _folder(spark, "meta"))
    x = labels_of(spark, d)
    sink.insert(x.where("doc_id % 2 = 0"))
    sink.insert(x.where("doc_id % 2 = 1"))
    sink.insert(x.where("doc_id % 10 = 0").withColumn("category", F.lit("new")))
    sink.delete("label = 1")
    sink.compact()
    return sink.rows().groupBy("category").agg(F.count("*").alias("n"), F.sum("year").alias("years"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "forest_search": forest_search,
    "s15_point_lookup": lambda s, d: corpus(s, d).where("id = 100").select("id", F.round(F.get("vec", F.lit(0)), 6).alias("first")),
    "s11_primary_category": _categories,
    "r1_planes": _planes,
    "r6_normalise": lambda s, d: corpus(s, d).select("id", F.round(F.get(normalised(F.col("vec")), F.lit(0)), 6).alias("first")),
    "r8_route": lambda s, d: _leaves(V.postings(corpus(s, d), SMALL)),
    "r10_trace": lambda s, d: V.traced(asked(s, d), SMALL).select("qid", F.col("tree").cast("long").alias("tree"), F.posexplode("margins").alias("level", "margin")).withColumn("margin", F.round("margin", 9)),
    "r11_deepen": lambda s, d: _leaves(V.deepened(corpus(s, d), V.postings(corpus(s, d), SMALL), SMALL, 2)),
    "r12_tree_subspace_route": lambda s, d: _leaves(V.postings(corpus(s, d), SUBSPACE)),
    "r13_node_perm_route": lambda s, d: _leaves(V.postings(corpus(s, d), PERMUTED)),
    "r14_live_medians": live_medians,
    "r15_median_route": lambda s, d: _leaves(V.postings(corpus(s, d), replace(SMALL, medians=V.median_sample(corpus(s, d), SMALL, 3)))),
    "r19_projection": lambda s, d: projected(corpus(s, d), 64, 8, 7).select("id", F.posexplode("vec").alias("place", "value")).withColumn("value", F.round("value", 6)),
    "s17_leaf_scan": lambda s, d: V.leaf_scan(V.postings(corpus(s, d), SMALL), 1, 3),
    "p3_single_flip": lambda s, d: _paths(V.probes(asked(s, d), SMALL, 3)),
    "p6_multi_flip": lambda s, d: _paths(V.probes(asked(s, d), SMALL, 6, multi=True)),
    "p7_top_paths": lambda s, d: _paths(V.top_paths(V.probes(asked(s, d), SMALL, 3, span=3), 8)),
    "p8_paths_by_size": lambda s, d: V.top_paths_by_size(V.probes(asked(s, d), SMALL), V.leaf_sizes(V.postings(corpus(s, d), SMALL)), 2).select("qid", F.col("tree").cast("long").alias("tree"), F.col("leaf").cast("long").alias("leaf")),
    "p11_capped_votes": lambda s, d: V.votes(V.capped(V.probes(asked(s, d), SMALL), V.leaf_sizes(V.postings(corpus(s, d), SMALL)), -(-corpus(s, d).count() // 13)), V.postings(corpus(s, d), SMALL), 4),
    "p14_guided_descent": lambda s, d: _paths(V.guided(asked(s, d), V.postings(corpus(s, d), SMALL), labels_of(s, d).where("label = 3"), SMALL)),
    "p15_steered": lambda s, d: V.steered(V.probes(asked(s, d), SMALL), V.postings(corpus(s, d), SMALL), labels_of(s, d).where("label = 3")).select("qid", F.col("tree").cast("long").alias("tree"), F.col("leaf").cast("long").alias("leaf")),
    "v1_votes": _votes,
    "v2_query_depth_votes": lambda s, d: _votes(s, d, query_depth=2),
    "v2_distinct_trees": lambda s, d: V.votes(V.probes(asked(s, d), SMALL, 3), V.postings(corpus(s, d), SMALL), 4, query_depth=3),
    "v3_top_n": lambda s, d: V.top_n(_votes(s, d), 20),
    "v5_multi_forest": _multi_forest,
    "v6_merged_votes": lambda s, d: V.merged([_votes(s, d, allowed=labels_of(s, d).where(f"doc_id % 2 = {i}")) for i in (0, 1)]),
    "v8_first_distinct": lambda s, d: V.first_distinct(_votes(s, d), 15),
    "v13_leaf_capped": lambda s, d: V.votes(V.probes(asked(s, d), SMALL), V.leaf_capped(V.postings(corpus(s, d), SMALL), 12), 4),
    "v15_threshold": lambda s, d: V.at_least(_votes(s, d), 2),
    "r18_votes_only": lambda s, d: S.by_votes(V.probes(asked(s, d), SMALL, 1).select("qid", "tree", "leaf"), V.postings(corpus(s, d), SMALL), SMALL, 10).withColumn("rank", F.col("rank").cast("long")),
    "f1_allowed_votes": lambda s, d: _votes(s, d, allowed=labels_of(s, d).where("label = 3")),
    "f3_allowed_bitmap": lambda s, d: _votes(s, d, allowed=bitmaps.ids(table(s, d, "embeddings").where("label = 3").groupBy().agg(F.collect_list("vec_id").alias("ids")).select(bitmaps.packed("ids").alias("state")), "state")),
    "f4_tombstoned_votes": lambda s, d: _votes(s, d, tombstones=labels_of(s, d).where("doc_id % 17 = 0")),
    "f6_density": lambda s, d: s.range(1).select(F.lit(M.density(labels_of(s, d), "category IN ('c1', 'c2') AND year < 2020")).alias("density")),
    "f7_post_filter": lambda s, d: tidy(S.filtered(asked(s, d), corpus(s, d), V.postings(corpus(s, d), SMALL), SMALL, labels_of(s, d), "label < 8", SearchSpec(n_probes=2, top_n=None), mode="post")),
    "f8_pre_filter": lambda s, d: tidy(S.filtered(asked(s, d), corpus(s, d), V.postings(corpus(s, d), SMALL), SMALL, labels_of(s, d), "label < 5", SearchSpec(n_probes=2, top_n=60), mode="pre")),
    "f11_brute_filter": lambda s, d: tidy(S.filtered(asked(s, d), corpus(s, d), V.postings(corpus(s, d), SMALL), SMALL, labels_of(s, d), "label = 3", mode="brute")),
    "f12_results_metadata": lambda s, d: tidy(knn.exact(asked(s, d), corpus(s, d), 5)).join(labels_of(s, d), "doc_id").select("qid", "rank", "doc_id", "category"),
    "f14_bitmaps": lambda s, d: M.bitmaps(described(s, d), "doc_id", "source").groupBy("category").agg(F.sum("n").alias("n")),
    "f15_key_groups": lambda s, d: M.matching(M.keys(described(s, d), "doc_id", ["lang", "source"]), [["lang=fr", "lang=de"], ["source=src1", "source=src2", "source=src3", "source=none"]]),
    "f16_equal_in": _where(lang="en", source=["src1", "src2"]),
    "f17_range": _where(n_chars=("range", 2000, 500), score=("range", 1.5, 4.25)),
    "f18_pattern": _where(source=("re", "^src1.$")),
    "f19_exists": _where(quality=("exists",), toxic=False),
    "f20_keys": lambda s, d: M.cardinalities(M.keys(described(s, d), "doc_id", ["lang", "n_chars", "score", "toxic", "tags"], {"score": 2})),
    "f22_metadata_compaction": _sinked,
    "d1_knn_l2": lambda s, d: tidy(knn.exact(asked(s, d), corpus(s, d), 10)),
    "d2_knn_cosine": lambda s, d: tidy(knn.exact(asked(s, d), corpus(s, d), 10, "cosine")),
    "d3_knn_ip": lambda s, d: tidy(knn.exact(asked(s, d), corpus(s, d), 10, "ip")),
    "d6_tq4_rerank": _quantised(4),
    "d7_tq1_rerank": _quantised(1),
    "d10_padded_truth": lambda s, d: knn.pad_truth(knn.exact(asked(s, d), corpus(s, d).join(labels_of(s, d).where("label = 3 AND year = 2018").select(F.col("doc_id").alias("id")), "id", "left_semi"), 10), asked(s, d), 10).withColumn("rank", F.col("rank").cast("long")),
    "d11_running_truth": lambda s, d: tidy(knn.running(asked(s, d), [corpus(s, d).where(F.col("id") % 3 == i) for i in range(3)], 10)),
    "d12_recall": _recall,
    "c1_chunks": _chunked,
    "c2_inserted": _inserted,
    "c3_deleted": _deleted,
    "c4_by_key": _by_key,
    "c5_contexts": _contexts,
    "c5_document_search": _document_search,
    "c5_store_search": _store_search,
    "c7_doc_recall": _doc_recall,
    "k3_backup_restore": backup_restore,
    "m2_delete_reinsert": delete_reinsert,
    "m4_live_search": live_search,
    "m5_compacted_deeper": compaction,
    "m10_hot_search": hot_search,
    "m11_hot_compaction": hot_compaction,
    "m15_resumed_build": _resumed,
    "m19_delete_where": delete_where,
    "m20_balance": _drift,
    "x3_pattern_search": pattern_search,
    "x5_leaf_stats": lambda s, d: V.leaf_sizes(V.postings(corpus(s, d), SMALL)).groupBy("tree").agg(F.count("*").alias("leaves"), F.max("n_docs").alias("fullest")).select(F.col("tree").cast("long").alias("tree"), "leaves", "fullest"),
    "a_percentiles": lambda s, d: table(s, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]),
    "a_histogram": lambda s, d: table(s, d, "events").withColumn("bound", F.explode(F.array(*[F.lit(float(b)) for b in (1, 5, 10, 50, 100)]))).groupBy("bound").agg(F.count_if(F.col("value") <= F.col("bound")).alias("n")),
    "a_page_after": lambda s, d: tidy(knn.exact(asked(s, d), corpus(s, d), 5, after=(1.0, 0))),
}


def _knn_sql(score: str, k: int = 10, where: str = "TRUE", self_too: bool = False) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT q.id AS qid, c.id AS doc_id, {score} AS dist FROM v q, v c WHERE q.id % 50 = 0 AND ({where}) {"" if self_too else "AND q.id <> c.id"}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, doc_id) AS rank FROM s)
SELECT qid, rank, doc_id, round(dist, 6) AS dist FROM r WHERE rank <= {k}"""


_META = "m AS (SELECT doc_id, lang, source, n_chars, quality, toxic = 1 AS toxic, (doc_id % 1000)::DOUBLE / 100 AS score FROM documents LEFT JOIN labels USING (doc_id))"
_TURNS = """t AS (SELECT 'conv' || conv_id AS key, conv_id, count(*) AS n, string_agg(text, '|' ORDER BY turn) AS text, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id),
live AS (SELECT key, conv_id, CASE WHEN conv_id % 14 = 0 THEN 1 ELSE n END AS n, CASE WHEN conv_id % 14 = 0 THEN first ELSE text END AS text FROM t WHERE conv_id % 7 <> 0 OR conv_id % 14 = 0)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def oracles() -> dict[str, str]:
    start = (Q.planes(SMALL), Q.VECTORS)
    alone = "q AS (SELECT doc_id AS qid, tree, leaf FROM p WHERE doc_id % 50 = 0)"
    f = _with(*start, Q.routed(SMALL), alone, "sizes AS (SELECT tree, leaf, count(*) AS n_docs FROM p GROUP BY tree, leaf)", "votes AS (SELECT qid, doc_id, count(*) AS votes FROM q JOIN p USING (tree, leaf) GROUP BY qid, doc_id)")
    probing = lambda n, **k: _with(*start, Q.routed(SMALL), Q.probed(SMALL, n, **k))
    top = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, doc_id) AS place FROM"
    third = "(SELECT greatest(200, ceil(count(*) / 3)) FROM embeddings)"
    tenth = "(SELECT greatest(100, ceil(count(*) / 10)) FROM embeddings)"
    mid = (Q.planes(MID), Q.VECTORS, Q.routed(MID), Q.probed(MID, 3), Q.voted())
    found = _with(*mid, Q.reranked(third, 10))
    exact = f"e AS (SELECT q.id AS qid, c.id AS doc_id, {L2} AS dist, row_number() OVER (PARTITION BY q.id ORDER BY {L2}, c.id) AS rank FROM v q, v c WHERE q.id % 50 = 0 AND q.id <> c.id QUALIFY rank <= 10)"

    def quantised(bits: int) -> str:
        cut = f"t AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, doc_id) AS place FROM votes WHERE qid <> doc_id) WHERE place <= {third})"
        return _with(*mid, cut, Q.quantised(bits, tenth), f"r AS (SELECT qid, doc_id, {L2} AS dist, row_number() OVER (PARTITION BY qid ORDER BY {L2}, doc_id) AS rank FROM z JOIN v q ON q.id = qid JOIN v c ON c.id = doc_id QUALIFY rank <= 10)") + rows

    rows = "SELECT qid, rank, doc_id, round(dist, 6) AS dist FROM r"
    deep, wide, three = replace(SMALL, depth=6), "(SELECT * FROM v WHERE id % 5 < 4 AND id % 17 <> 0)", "SELECT qid, tree, leaf, round(score, 9) AS score FROM"
    live = _with(Q.planes(deep), Q.VECTORS, Q.routed(deep, wide), Q.probed(deep, 3), Q.voted(), f"""t AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, doc_id) AS place FROM votes) WHERE place <= 200
UNION SELECT qid, doc_id FROM (SELECT q.id AS qid, c.id AS doc_id, row_number() OVER (PARTITION BY q.id ORDER BY {L2}, c.id) AS place FROM v q, v c WHERE q.id % 50 = 0 AND c.id % 5 = 4 AND c.id % 17 <> 0) WHERE place <= 20)""", f"r AS (SELECT qid, doc_id, {L2} AS dist, row_number() OVER (PARTITION BY qid ORDER BY {L2}, doc_id) AS rank FROM t JOIN v q ON q.id = qid JOIN v c ON c.id = doc_id QUALIFY rank <= 10)") + rows
    patterned = lambda i: _with(*start, Q.routed(SMALL, f"(SELECT * FROM v WHERE id % 3 = {i})"), Q.probed(SMALL, 3), Q.voted(), Q.reranked("100", 10, True)) + "SELECT qid, doc_id, dist FROM r"
    keyed = lambda name, n: f"SELECT '{name}=' || ({n})::VARCHAR AS key, doc_id FROM m WHERE ({n}) IS NOT NULL " + "".join(f"UNION ALL SELECT '{name}.b{b}=' || (({n}) // {10**b})::VARCHAR, doc_id FROM m WHERE ({n}) IS NOT NULL " for b in M.BUCKETS) + f"UNION ALL SELECT '{name}:*', doc_id FROM m WHERE ({n}) IS NOT NULL"
    plain = lambda name, c: f"SELECT '{name}=' || ({c})::VARCHAR AS key, doc_id FROM m WHERE {c} IS NOT NULL UNION ALL SELECT '{name}:*', doc_id FROM m WHERE {c} IS NOT NULL"
    other = replace(SMALL, n_trees=2, node_perm=True)
    return {
        "forest_search": found + rows,
        "s15_point_lookup": "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id = 100",
        "s11_primary_category": "SELECT page_id, split_part(url, '/', 3) AS category, split_part(split_part(url, '/', 3), '.', 1) AS top, CASE WHEN page_id % 130 < 100 THEN page_id % 130 + 2000 ELSE page_id % 130 END AS year, row_number() OVER (ORDER BY page_id) - 1 AS internal_id FROM pages WHERE split_part(url, '/', 3) <> ''",
        "r1_planes": Q.seeds(SMALL),
        "r6_normalise": "SELECT vec_id AS id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) + 1e-10), 6) AS first FROM embeddings",
        "r8_route": f + "SELECT doc_id, tree, leaf FROM p",
        "r10_trace": probing(0) + "SELECT id AS qid, tree::BIGINT AS tree, unnest(range(4))::INT AS level, round(unnest(g), 9) AS margin FROM qw WHERE flip = 0",
        "r11_deepen": _with(Q.planes(deep), Q.VECTORS, Q.routed(deep)) + "SELECT doc_id, tree, leaf FROM p",
        "r12_tree_subspace_route": _with(Q.planes(SUBSPACE), Q.VECTORS, Q.routed(SUBSPACE)) + "SELECT doc_id, tree, leaf FROM p",
        "r13_node_perm_route": _with(Q.planes(PERMUTED), Q.VECTORS, Q.routed(PERMUTED)) + "SELECT doc_id, tree, leaf FROM p",
        "r14_live_medians": _with(*start, Q.routed(SMALL, med_depth=3)) + "SELECT doc_id, tree, leaf FROM p",
        "r15_median_route": _with(*start, Q.routed(SMALL, med_depth=3)) + "SELECT doc_id, tree, leaf FROM p",
        "r19_projection": Q.projection(64, 8, 7) + "SELECT id, place::INT AS place, round(list_inner_product(v.v, w), 6) AS value FROM v, m",
        "s17_leaf_scan": f + "SELECT doc_id FROM p WHERE tree = 1 AND leaf = 3",
        "p3_single_flip": probing(3) + f"{three} q",
        "p6_multi_flip": probing(6, multi=True) + f"{three} q",
        "p7_top_paths": probing(3, min_flip=1) + f"{three} q QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, tree, leaf) <= 8",
        "p8_paths_by_size": f + ", r AS (SELECT q.*, row_number() OVER (PARTITION BY qid ORDER BY n_docs DESC, tree, leaf) AS place FROM q JOIN sizes USING (tree, leaf)) SELECT qid, tree, leaf FROM r WHERE place <= 2",
        "p11_capped_votes": f + "SELECT qid, doc_id, count(*) AS votes FROM q JOIN p USING (tree, leaf) JOIN sizes USING (tree, leaf) WHERE n_docs <= (SELECT ceil(count(*) / 13) FROM embeddings) GROUP BY qid, doc_id",
        "p14_guided_descent": _with(*start, Q.routed(SMALL), Q.guided(SMALL, "label = 3")) + f"{three} g",
        "p15_steered": f + "SELECT qid, tree, leaf FROM q SEMI JOIN (SELECT p.* FROM p JOIN v ON v.id = p.doc_id WHERE label = 3) USING (tree, leaf)",
        "v1_votes": f + "SELECT qid, doc_id, votes FROM votes",
        "v2_query_depth_votes": f + "SELECT qid, p.doc_id, count(*) AS votes FROM q JOIN p ON q.tree = p.tree AND q.leaf >> 2 = p.leaf >> 2 GROUP BY qid, p.doc_id",
        "v2_distinct_trees": _with(*start, Q.routed(SMALL), Q.probed(SMALL, 3), Q.voted(shift=1)) + "SELECT qid, doc_id, votes FROM votes",
        "v3_top_n": f + f"SELECT qid, doc_id, votes FROM ({top} votes) WHERE place <= 20",
        "v5_multi_forest": _with(*start, Q.routed(SMALL), alone, Q.planes(other).replace("nodes(", "nodes2(")) + ", " + Q.routed(other, name="o").replace(" nodes", " nodes2") + " SELECT qid, doc_id, count(*) AS votes FROM (SELECT qid, p.doc_id FROM q JOIN p USING (tree, leaf) UNION ALL SELECT a.doc_id, b.doc_id FROM o a JOIN o b USING (tree, leaf) WHERE a.doc_id % 50 = 0) GROUP BY qid, doc_id",
        "v6_merged_votes": f + "SELECT qid, doc_id, votes FROM votes",
        "v8_first_distinct": f + "SELECT qid, doc_id, votes FROM votes QUALIFY row_number() OVER (PARTITION BY qid ORDER BY doc_id) <= 15",
        "v13_leaf_capped": f + ", few AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY tree, leaf ORDER BY doc_id) <= 12) SELECT qid, few.doc_id, count(*) AS votes FROM q JOIN few USING (tree, leaf) GROUP BY qid, few.doc_id",
        "v15_threshold": f + "SELECT qid, doc_id, votes FROM votes WHERE votes >= 2",
        "r18_votes_only": _with(*start, Q.routed(SMALL), Q.probed(SMALL, 1), Q.voted()) + "SELECT qid, doc_id, votes, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, doc_id) AS rank FROM votes QUALIFY rank <= 10",
        "f1_allowed_votes": f + "SELECT qid, doc_id, votes FROM votes JOIN v ON v.id = doc_id WHERE label = 3",
        "f3_allowed_bitmap": f + "SELECT qid, doc_id, votes FROM votes JOIN v ON v.id = doc_id WHERE label = 3",
        "f4_tombstoned_votes": f + "SELECT qid, doc_id, votes FROM votes WHERE doc_id % 17 <> 0",
        "f6_density": "SELECT count(*) FILTER (vec_id % 10 IN (1, 2) AND 2015 + vec_id % 10 < 2020) / count(*)::DOUBLE AS density FROM embeddings",
        "f7_post_filter": _with(*start, Q.routed(SMALL), Q.probed(SMALL, 2), Q.voted(), Q.reranked("1000000", 20), "a AS (SELECT r.qid, r.doc_id, r.dist, row_number() OVER (PARTITION BY qid ORDER BY r.rank) AS rank FROM r JOIN v ON v.id = doc_id WHERE label < 8 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r.rank) <= 10)") + "SELECT qid, rank, doc_id, round(dist, 6) AS dist FROM a",
        "f8_pre_filter": _with(*start, Q.routed(SMALL), Q.probed(SMALL, 2), Q.voted(where="label < 5"), Q.reranked("60", 10)) + rows,
        "f11_brute_filter": _knn_sql(L2, where="c.label = 3"),
        "f12_results_metadata": f"SELECT qid, rank, doc_id, 'c' || (doc_id % 10)::VARCHAR AS category FROM ({_knn_sql(L2, 5)})",
        "f14_bitmaps": "SELECT source AS category, count(DISTINCT doc_id) AS n FROM documents GROUP BY source",
        "f15_key_groups": "SELECT DISTINCT doc_id FROM documents WHERE lang IN ('fr', 'de') AND source IN ('src1', 'src2', 'src3')",
        "f16_equal_in": "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')",
        "f17_range": f"WITH {_META} SELECT doc_id FROM m WHERE n_chars BETWEEN 500 AND 2000 AND round_even(score * 100, 0) BETWEEN 150 AND 425",
        "f18_pattern": "SELECT doc_id FROM documents WHERE regexp_matches(source, '^src1.$')",
        "f19_exists": f"WITH {_META} SELECT doc_id FROM m WHERE quality IS NOT NULL AND NOT toxic",
        "f20_keys": f"WITH {_META} SELECT key, count(DISTINCT doc_id) AS n_docs FROM ({plain('lang', 'lang')} UNION ALL {keyed('n_chars', 'n_chars')} UNION ALL {keyed('score', 'round_even(score * 100, 0)::BIGINT')} UNION ALL {plain('toxic', 'toxic')} UNION ALL {plain('tags', 'lang')} UNION ALL {plain('tags', 'source')}) GROUP BY key",
        "f22_metadata_compaction": "SELECT CASE WHEN vec_id % 10 = 0 THEN 'new' ELSE 'c' || (vec_id % 10) END AS category, count(*) AS n, sum(2015 + vec_id % 10)::BIGINT AS years FROM embeddings WHERE label <> 1 GROUP BY ALL",
        "d1_knn_l2": _knn_sql(L2),
        "d2_knn_cosine": _knn_sql(f"-{DOT} / greatest(1e-12, sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v)))"),
        "d3_knn_ip": _knn_sql(f"-{DOT}"),
        "d6_tq4_rerank": quantised(4),
        "d7_tq1_rerank": quantised(1),
        "d10_padded_truth": f"SELECT q.qid, g.rank, coalesce(t.doc_id, -1) AS doc_id FROM (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 50 = 0) q CROSS JOIN (SELECT unnest(range(1, 11)) AS rank) g LEFT JOIN ({_knn_sql(L2, where='c.label = 3 AND c.id % 10 = 3')}) t ON t.qid = q.qid AND t.rank = g.rank",
        "d11_running_truth": _knn_sql(L2),
        "d12_recall": found.rstrip() + f",\n{exact} SELECT round(count(r.doc_id) / count(*)::DOUBLE, 9) AS recall FROM e LEFT JOIN r ON e.qid = r.qid AND e.doc_id = r.doc_id",
        "c1_chunks": Q.CHUNKS.format(size=D.SIZE, overlap=D.OVERLAP, near=min(80, D.SIZE // 4)),
        "c2_inserted": f"WITH {_TURNS} SELECT key, n AS n_chunks, (conv_id % 2)::VARCHAR AS odd FROM live",
        "c3_deleted": f"WITH {_TURNS} SELECT key, n FROM live",
        "c4_by_key": f"WITH {_TURNS} SELECT key, text FROM live WHERE key LIKE '%4'",
        "c5_contexts": """WITH c AS (SELECT conv_id AS parent, (turn - min(turn) OVER (PARTITION BY conv_id))::INT AS seq, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS chunk_id FROM conversations),
s AS (SELECT g.qid, c.*, abs(length(text) - 100 * g.qid)::DOUBLE AS dist FROM c CROSS JOIN (SELECT unnest(range(1, 6)) AS qid) g),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, parent ORDER BY dist, chunk_id) AS r FROM s) WHERE r = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS place FROM b)
SELECT t.qid, t.place, t.parent, t.seq, t.dist, string_agg(c.text, '|' ORDER BY c.seq) AS context FROM t JOIN c ON c.parent = t.parent AND c.seq BETWEEN t.seq - 1 AND t.seq + 1 WHERE place <= 5 GROUP BY ALL""",
        "c7_doc_recall": found.rstrip() + f",\n{exact}, b AS (SELECT qid, doc_id // 5 AS parent, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS place FROM r GROUP BY qid, doc_id // 5 QUALIFY place <= 5) SELECT round(count(b.parent) / count(*)::DOUBLE, 9) AS recall FROM e LEFT JOIN b ON e.qid = b.qid AND e.doc_id // 5 = b.parent WHERE e.rank = 1",
        "k3_backup_restore": "SELECT 'restored' AS index, vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT 'copied', vec_id FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0",
        "m2_delete_reinsert": "SELECT vec_id AS id FROM embeddings WHERE vec_id % 17 <> 0 OR vec_id % 34 = 0",
        "m4_live_search": live,
        "m5_compacted_deeper": _with(Q.planes(deep), Q.VECTORS, Q.routed(deep, "(SELECT * FROM v WHERE id % 5 < 4)")) + "SELECT doc_id, tree, leaf FROM p",
        "m10_hot_search": _with(*start, Q.routed(SMALL), Q.probed(SMALL, 3), Q.voted(), Q.reranked("1000000", 10, True)) + rows,
        "m11_hot_compaction": "SELECT tree, count(*) AS n, count(*) AS n_docs FROM embeddings, (SELECT unnest(range(4)) AS tree) GROUP BY tree",
        "m15_resumed_build": f + "SELECT doc_id, tree, leaf FROM p",
        "m19_delete_where": "SELECT vec_id AS doc_id, label >= 3 AS described FROM embeddings WHERE vec_id % 2 = 1 OR label >= 3",
        "m20_balance": f + "SELECT round(max(peak), 9) AS peak, round(avg(cv), 9) AS cv FROM (SELECT tree, max(n_docs) / avg(n_docs) AS peak, stddev_pop(n_docs) / avg(n_docs) AS cv FROM sizes GROUP BY tree)",
        "x3_pattern_search": f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, index, doc_id) AS rank, index, doc_id, round(dist, 6) AS dist FROM (SELECT 'docs-202401' AS index, * FROM ({patterned(0)}) UNION ALL SELECT 'docs-202402', * FROM ({patterned(1)})) QUALIFY rank <= 10",
        "x5_leaf_stats": f + "SELECT tree, count(*) AS leaves, max(n_docs) AS fullest FROM sizes GROUP BY tree",
        "a_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
        "a_histogram": "SELECT b::DOUBLE AS bound, count(*) FILTER (value <= b) AS n FROM events CROSS JOIN (SELECT unnest([1, 5, 10, 50, 100]) AS b) GROUP BY b",
        "a_page_after": _knn_sql(L2, 5, where=f"({L2}) > 1.0 OR ({L2}) = 1.0 AND c.id > 0"),
    }
