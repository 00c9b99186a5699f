import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvine import queries
from sylvine.functions.distance import distance
from sylvine.functions.forest import Forest
from sylvine.operators import knn, votes as V
from sylvine.plans import knobs, search as S

FOREST = Forest(n_trees=8, depth=4, dim=64)


def clustered(spark, n=400):
    rng = np.random.default_rng(42)
    centres = rng.standard_normal((10, 64))
    x = centres[np.arange(n) % 10] + 0.15 * rng.standard_normal((n, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"), x


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_exact_equals_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "ROWS", 90)
    df, x = clustered(spark)
    got = knn.exact(df.where("id % 50 = 0"), df, 5, metric).orderBy("qid", "rank").collect()
    d = ((x[::50, None] - x[None]) ** 2).sum(2) if metric == "l2" else -(x[::50] @ x.T)
    d[np.arange(8), np.arange(0, 400, 50)] = np.inf
    assert [r.doc_id for r in got] == np.argsort(d, 1, kind="stable")[:, :5].ravel().tolist()


def test_forest_search_recall_and_filters(spark):
    df, _ = clustered(spark)
    df = df.cache()
    q, posted = df.where("id % 50 = 0"), V.postings(df, FOREST).cache()
    truth = knn.exact(q, df, 5)
    assert knn.recall(S.search(q, df, posted, FOREST, S.SearchSpec(top_k=5, top_n=100)), truth, 5).first().recall > 0.9
    allowed, gone = df.where("id % 3 = 0").select(F.col("id").alias("doc_id")), df.where("id % 17 = 0").select(F.col("id").alias("doc_id"))
    found = S.search(q, df, posted, FOREST, S.SearchSpec(top_k=5), allowed=allowed, tombstones=gone).collect()
    assert found and all(r.doc_id % 3 == 0 and r.doc_id % 17 for r in found)
    one = V.votes(V.probes(q, FOREST), posted, 4)
    wide = V.votes(V.probes(q, FOREST), posted, 4, query_depth=2)
    assert one.join(wide, ["qid", "doc_id"], "left_anti").isEmpty() and wide.agg(F.max("votes")).first()[0] <= 8


def test_empty_and_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (None, [1.0, 1.0]), (4, [0.0, None])], "vec_id long, embedding array<double>")
    assert [r.id for r in knn.vectors(df, "vec_id", "embedding", 2).collect()] == [1]
    none = knn.vectors(df.where("false"), "vec_id", "embedding")
    assert knn.exact(none, none, 3).count() == 0
    with pytest.raises(ValueError):
        distance(F.col("a"), F.col("b"), "l7")
    with pytest.raises(ValueError):
        S.SearchSpec(top_k=0)


def test_pages_follow_one_another(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROWS", 90)
    df, _ = clustered(spark)
    q = df.where("id = 50")
    whole = knn.exact(q, df, 30).orderBy("rank").collect()
    for at in (0, 7, 19):
        page = knn.exact(q, df, 10, after=(whole[at].dist, whole[at].doc_id)).orderBy("rank").collect()
        assert [r.doc_id for r in page] == [r.doc_id for r in whole[at + 1 : at + 11]]


def test_vote_operators(spark):
    df, _ = clustered(spark)
    q, posted = df.where("id % 50 = 0"), V.postings(df, FOREST).cache()
    counted, o = V.observed(V.votes(V.probes(q, FOREST), posted, 4))
    n = counted.count()
    assert o.get["n_candidates"] == n and o.get["n_votes"] >= n
    assert V.leaf_capped(posted, 3).groupBy("tree", "leaf").count().agg(F.max("count")).first()[0] == 3
    assert V.hot_merged(posted, posted.where("doc_id < 50")).count() == posted.count()
    sample = V.strided_sample(spark.range(5000).select("id", F.array(F.lit(1.0)).alias("vec")), 1250)
    assert sample.count() == 1250 and sample.where("id % 4 <> 0").isEmpty()
    with pytest.raises(ValueError):
        V.strided_sample(df)
    assert V.traced(q, FOREST).where("size(margins) = 4").count() == 64


def test_knobs():
    assert knobs.auto_depth(14, 1 << 20, None) == 14 and knobs.auto_depth(14, 1 << 20, 1 << 17) == 11 and knobs.auto_depth(3, 1 << 20, 1) == 1
    assert knobs.oversample(10, 0.8) == (20, 2000) and knobs.oversample(10, 0.01)[0] == 2000 and knobs.oversample(10, 0.0)[0] == 5000
    assert knobs.strategy(100, 10**6, 768) == "brute" and knobs.strategy(20_000, 10**6, 768) == "pre" and knobs.strategy(500_000, 10**6, 768) == "post"
    assert knobs.adaptive_top_n(10**5, 64, 10) == 2000 and knobs.adaptive_top_n(10**8, 768, 10) == 50_000
    assert knobs.deepest(lambda d: 1 - d / 20, range(4, 10), 0.7) == 6 and knobs.auto_depth_measured(14, 100, 400, 800, 10**6) == 11
    assert knobs.calibrate(lambda p, c, n: min(0.9, p / 1000 + c / 10**7), gain=0.01)["recall"] <= 0.9


def test_every_query_has_rows_and_columns_like_its_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("embeddings", "documents", "labels", "pages", "conversations", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    sql = queries.oracles()
    for name in ("d1_knn_l2", "r8_route", "v2_query_depth_votes", "f20_keys", "c5_contexts", "p11_capped_votes"):
        got, want = queries.QUERIES[name](spark, small).toPandas(), con.execute(sql[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert sorted(map(str, got[cols].astype(object).itertuples(index=False, name=None))) == sorted(map(str, want[cols].astype(object).itertuples(index=False, name=None))), name
