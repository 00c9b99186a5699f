"""Registered searches that promise exact results give them on tables larger than the small fixture."""

import pytest
from pyspark.sql import functions as F

from sylvine import queries
from sylvine.operators import knn, votes as V
from sylvine.plans import search as S
from sylvine.streaming.live import LiveIndex

LARGER = "/root/testdata/sf0.1"


def truth(spark, d, where, k=10, self_too=False):
    x = queries.corpus(spark, d)
    return rows(queries.tidy(knn.exact(queries.asked(spark, d), x.where(where), k, include_self=self_too)))


def rows(found):
    return sorted((r.qid, r.rank, r.doc_id, round(r.dist, 5)) for r in found.select("qid", F.col("rank"), "doc_id", "dist").collect())


WHOLE = S.SearchSpec(n_probes=None, top_n=None)


def deep_index(spark, d, path):
    """Four segments compacted to a deeper one, a buffer, deletions."""
    index, x = LiveIndex(spark, f"file://{path}", queries.SMALL, max_active=0), queries.corpus(spark, d)
    for part in range(4):
        index.insert(x.where(F.col("id") % 5 == part))
        index.freeze()
    index.insert(x.where("id % 5 = 4"))
    index.delete(x.where("id % 17 = 0").select("id"))
    return index


def test_whole_searches_of_deep_segments_are_exact(spark, tmp_path):
    found = deep_index(spark, LARGER, f"{tmp_path}/i").search(queries.asked(spark, LARGER), WHOLE)
    assert rows(queries.tidy(found)) == truth(spark, LARGER, "id % 17 <> 0", self_too=True)


def test_probing_every_leaf_is_exact_too(spark, small, tmp_path):
    """The same through postings and votes: as many probes as the deepest segment has leaves."""
    found = deep_index(spark, small, f"{tmp_path}/i").search(queries.asked(spark, small), S.SearchSpec(n_probes=63, multi_flip=True, top_n=None))
    assert rows(queries.tidy(found)) == truth(spark, small, "id % 17 <> 0", self_too=True)


@pytest.mark.parametrize("mode,where", [("pre", "label < 5"), ("post", "label < 8")])
def test_whole_filtered_searches_are_exact(spark, mode, where):
    x, q, label = queries.corpus(spark, LARGER), queries.asked(spark, LARGER), queries.labels_of(spark, LARGER)
    found = S.filtered(q, x, V.postings(x, queries.SMALL), queries.SMALL, label, where, WHOLE, mode=mode)
    near = knn.exact(q, x, 20).drop("rank") if mode == "post" else knn.exact(q, x.join(label.where(where).select(F.col("doc_id").alias("id")), "id", "left_semi"), 20).drop("rank")
    want = knn.top_k(near.join(label.where(where).select("doc_id"), "doc_id", "left_semi").select("qid", "doc_id", "dist"), 10)
    assert rows(queries.tidy(found)) == rows(queries.tidy(want))


def test_no_cut_with_few_probes_keeps_all_voted(spark, small):
    x, q = queries.corpus(spark, small), queries.asked(spark, small)
    posted = V.postings(x, queries.SMALL)
    found = S.candidates(q, posted, queries.SMALL, S.SearchSpec(n_probes=0, top_n=None))
    voted = V.votes(V.probes(q, queries.SMALL), posted, 4).where("qid <> doc_id")
    assert found.select("qid", "doc_id", "votes").exceptAll(voted).isEmpty() and found.count() == voted.count()


@pytest.mark.parametrize("name", ["forest_search", "d6_tq4_rerank", "d7_tq1_rerank"])
def test_searches_hold_their_recall_as_the_table_grows(spark, small, name):
    for d in (small, LARGER):
        x, q = queries.corpus(spark, d), queries.asked(spark, d)
        assert knn.recall(queries.QUERIES[name](spark, d), knn.exact(q, x, 10), 10).first().recall >= 0.85
