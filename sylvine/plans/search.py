"""A forest search as one plan: probes, postings, votes, candidates, exact distances."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sylvine.functions.forest import Forest
from sylvine.operators import knn, votes as V
from sylvine.plans import knobs


@dataclass(frozen=True)
class SearchSpec:
    """n_probes None: every leaf, whatever the depth. top_n None: every document with votes is a candidate."""

    top_k: int = 10
    top_n: int | None = 4000
    n_probes: int | None = 5
    probe_span: int | None = None
    multi_flip: bool = False
    top_paths: int = 0
    query_depth: int = 0
    max_leaf_docs: int | None = None
    metric: str = "l2"

    def __post_init__(self):
        if self.top_k <= 0 or self.top_n is not None and self.top_n <= 0:
            raise ValueError("top_k and top_n must be positive")

    def probes(self, queries: DataFrame, forest: Forest) -> DataFrame:
        if self.n_probes is None:
            return V.probes(queries, forest, (1 << forest.depth) - 1, multi=True)
        return V.probes(queries, forest, self.n_probes, self.probe_span, self.multi_flip)

    @property
    def whole(self) -> bool:
        """Whether every document in the postings is a candidate of every query, so that blocks of them can be ranked at once."""
        return self.n_probes is None and self.top_n is None and self.top_paths <= 0 and self.max_leaf_docs is None


def candidates(queries: DataFrame, posted: DataFrame, forest: Forest, spec: SearchSpec, allowed: DataFrame | None = None, tombstones: DataFrame | None = None, probed: DataFrame | None = None) -> DataFrame:
    """Rows qid, doc_id, votes: the best by votes. probed replaces routing, e.g. with leaves that a client computed itself."""
    if probed is None:
        probed = spec.probes(queries, forest)
    probed = V.top_paths(probed, spec.top_paths)
    if spec.max_leaf_docs is not None:
        probed = V.capped(probed, V.leaf_sizes(posted), spec.max_leaf_docs)
    counted = V.votes(probed, posted, forest.depth, spec.query_depth, allowed, tombstones)
    return V.top_n(counted.join(queries.select(F.col("id").alias("doc_id"), F.col("id").alias("qid")), ["qid", "doc_id"], "left_anti"), spec.top_n)


def by_votes(leaves: DataFrame, posted: DataFrame, forest: Forest, k: int, query_depth: int = 0, **filters) -> DataFrame:
    """Rows qid, doc_id, votes, rank for leaves (qid, tree, leaf) that a client computed: its vectors stay with it, so votes rank."""
    counted = V.votes(leaves, posted, forest.depth, query_depth, **filters)
    order = W.partitionBy("qid").orderBy(F.desc("votes"), "doc_id")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _candidates_of_all(corpus: DataFrame, posted: DataFrame, allowed: DataFrame | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """The vectors that get a vote from every query that probes all leaves."""
    x = corpus.join(posted.select(F.col("doc_id").alias("id")), "id", "left_semi")
    x = x if allowed is None else x.join(allowed.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return x if tombstones is None else x.join(tombstones.select(F.col("doc_id").alias("id")), "id", "left_anti")


def search(queries: DataFrame, corpus: DataFrame, posted: DataFrame, forest: Forest, spec: SearchSpec = SearchSpec(), **filters) -> DataFrame:
    """Rows qid, doc_id, dist, rank; a query isn't its own neighbour. All tables are (id, vec)."""
    if spec.whole and filters.get("probed") is None:
        own = _candidates_of_all(corpus, posted, filters.get("allowed"), filters.get("tombstones"))
        return knn.exact(queries, own, spec.top_k, spec.metric)
    return knn.rerank(candidates(queries, posted, forest, spec, **filters), queries, corpus, spec.top_k, spec.metric)


def filtered(queries: DataFrame, corpus: DataFrame, posted: DataFrame, forest: Forest, meta: DataFrame, where: Column | str, spec: SearchSpec = SearchSpec(), mode: str | None = None, dim: int | None = None) -> DataFrame:
    """A search among documents whose metadata row (doc_id, ...) meets a condition: brute force, before or after the votes."""
    condition = F.expr(where) if isinstance(where, str) else where
    allowed = meta.where(condition).select("doc_id").distinct()
    if mode is None:
        mode = knobs.strategy(allowed.count(), corpus.count(), dim or forest.dim)
    if mode == "brute":
        own = corpus.join(allowed.select(F.col("doc_id").alias("id")), "id", "left_semi")
        return knn.exact(queries, own, spec.top_k, spec.metric)
    if mode == "pre":
        return search(queries, corpus, posted, forest, spec, allowed=allowed)
    if mode != "post":
        raise ValueError(f"unknown filter mode {mode!r}")
    wide, top_n = knobs.oversample(spec.top_k, allowed.count() / max(1, corpus.count()), spec.top_n)
    found = search(queries, corpus, posted, forest, replace(spec, top_k=wide, top_n=None if spec.top_n is None else max(top_n, wide)))
    return knn.top_k(found.drop("rank").join(allowed, "doc_id", "left_semi").select("qid", "doc_id", "dist"), spec.top_k)


def page_after(ranked: DataFrame, dist: float, doc_id: int, k: int) -> DataFrame:
    """The k rows after (dist, doc_id) of each query's order."""
    return knn.top_k(ranked.drop("rank").where((F.col("dist") > dist) | ((F.col("dist") == dist) & (F.col("doc_id") > doc_id))), k)
