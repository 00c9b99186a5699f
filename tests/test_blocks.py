import numpy as np
import pytest

from sylvine import queries
from sylvine.functions.forest import Forest
from sylvine.operators import blocks, knn, quantise, votes as V
from sylvine.plans import search as S
from sylvine.scratch import Scratch

LARGER = "/root/testdata/sf0.1"
FOREST = Forest(n_trees=6, depth=3, dim=16)


def odd_vectors(spark):
    """Random directions, many copies, vectors of zeros, of very different lengths and with components that aren't numbers."""
    x = np.random.default_rng(7).standard_normal((400, 16))
    x[100:180], x[200:230], x[231:235], x[240:250] = x[1], x[0], 0, x[240:250] * 1e6
    x[250], x[251], x[252, 3], x[253, 2], x[254, 5] = 1e200, 1e-200, np.nan, np.inf, -np.inf
    order = np.random.default_rng(8).permutation(400)
    return spark.createDataFrame([(int(i) * 1000 - 99_950, x[i].tolist()) for i in order], "id long, vec array<double>").cache()


def plain(q, x, top_n, kept, bits, n_probes=1):
    found = S.candidates(q, V.postings(x, FOREST), FOREST, S.SearchSpec(n_probes=n_probes, top_n=top_n)).select("qid", "doc_id")
    return knn.rerank(quantise.select(found, q, quantise.encode(x, bits), kept, bits), q, x)


def rows(found):
    return sorted((r.qid, r.rank, r.doc_id, repr(r.dist)) for r in found.collect())


@pytest.mark.parametrize("bits", [4, 1])
@pytest.mark.parametrize("top_n,kept", [(130, 40), (60, 12), (3, 2), (1000, 1000)])
def test_blocks_give_what_a_row_a_pair_gives(spark, tmp_path, monkeypatch, bits, top_n, kept):
    monkeypatch.setattr(blocks, "ROWS", 64)
    monkeypatch.setattr(blocks, "QUERIES", 7)
    x = odd_vectors(spark)
    q = x.where("id % 7 = 0")
    got = blocks.search(q, x, FOREST, 1, top_n, kept, Scratch(spark, "t"), bits)
    assert rows(got) == rows(plain(q, x, top_n, kept, bits))


def test_blocks_of_nothing_and_of_one(spark):
    x = odd_vectors(spark)
    for q, rest in ((x.where("id < 0").limit(0), x), (x.where("id = 50"), x.limit(0)), (x.where("id = 50"), x.where("id = 50"))):
        assert blocks.search(q, rest, FOREST, 1, 20, 10, Scratch(spark, "t")).count() == 0


def shuffled(spark):
    gateway = spark.sparkContext._gateway
    none, quantiles = gateway.jvm.java.util.ArrayList(), gateway.new_array(gateway.jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["d6_tq4_rerank", "d7_tq1_rerank"])
def test_quantised_searches_shuffle_no_row_a_pair(spark, name):
    """A third of the table is a query's candidates, so a row each is as many rows as the product of both tables."""
    pairs = queries.asked(spark, LARGER).count() * queries.corpus(spark, LARGER).count()
    before = shuffled(spark)
    assert queries.QUERIES[name](spark, LARGER).count() == 10 * queries.asked(spark, LARGER).count()
    assert shuffled(spark) - before < pairs / 4


@pytest.mark.parametrize("name", ["d7_tq1_rerank", "d6_tq4_rerank"])
def test_quantised_searches_shuffle_blocks_and_not_a_row_a_document(spark, name):
    """Documents, counts by level, histograms and rows near the cut go packed: fewer rows in all than there are vectors."""
    before = shuffled(spark)
    assert queries.QUERIES[name](spark, LARGER).count() == 10 * queries.asked(spark, LARGER).count()
    assert shuffled(spark) - before < queries.corpus(spark, LARGER).count()
