import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvine import cli
from sylvine.client import AsyncClient, BatchedInserter, Client, TokenBucket
from sylvine.functions.forest import Forest, sparse_projection
from sylvine.operators import votes as V
from sylvine.operators.project import projected
from sylvine.plans import jobs
from sylvine.plans.search import SearchSpec
from sylvine.sources import vectors

X = np.random.default_rng(3).standard_normal((40, 8))
WHOLE = SearchSpec(n_probes=None, top_n=None, top_k=3)


def rows(spark, n=40, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(X[:n])], "id long, vec array<double>")


def test_client_calls(spark, tmp_path):
    c = Client(spark, f"file://{tmp_path}/c")
    c.create("a", 8, 4, 3)
    with pytest.raises(FileExistsError):
        c.create("a", 8)
    assert c.insert("a", X[0]) == 0 and c.insert("a", X[1]) == 1
    ids = c.insert_batch("a", X[2:10], range(2, 10), [{"lang": "fr" if i % 2 else "en"} for i in range(2, 10)], batch="b")
    assert ids == list(range(2, 10)) and c.stats("a")["n_active"] == 10
    c.insert_batch("a", X[2:10], range(2, 10), batch="b")
    assert c.stats("a")["n_active"] == 10
    for bad in (lambda: c.insert("a", X[0][:3]), lambda: c.insert_batch("a", X[:2], [1])):
        with pytest.raises(ValueError):
            bad()
    assert c.search("a", X[4:5], spec=WHOLE).orderBy("rank").first().doc_id == 4
    assert {r.doc_id % 2 for r in c.search("*", X[4:5], "lang = 'fr'", WHOLE).collect()} == {1}
    c.delete("a", where="lang = 'en'")
    assert c.sink("a").rows().count() == 4 and c.delete("a", ids=[0]) == ["a"]
    c.freeze("a")
    assert c.stats("a")["n_docs"] == 5 and c.health() == {"indexes": 1, "wrong": {}} and c.list("b*") == []
    c.catalog.open("a").vacuum()
    assert c.sink("a").rows().count() == 4
    with pytest.raises(KeyError):
        c.delete("none", ids=[1])
    c.drop("a")
    assert not c.exists("a")


def test_asynchronous_calls(spark, tmp_path):
    c = AsyncClient(Client(spark, f"file://{tmp_path}/c"))
    c.create("a", 8, 4, 3)
    changes = [c.insert_batch("a", X[i : i + 5], range(i, i + 5)) for i in range(0, 20, 5)]
    assert [f.result() for f in changes] == [list(range(i, i + 5)) for i in range(0, 20, 5)]
    assert c.search("a", X[3:4], spec=WHOLE).result().count() == 3
    with pytest.raises(KeyError):
        c.stats("none").result()
    c.close()


def test_batches_go_by_size_and_time(spark, tmp_path):
    c = Client(spark, f"file://{tmp_path}/c")
    c.create("a", 8, 4, 3)
    with BatchedInserter(c, "a", size=4, seconds=0.5) as b:
        for i in range(6):
            b.add(i, X[i])
        assert c.stats("a")["n_active"] == 4
        end = time.monotonic() + 30
        while c.stats("a")["n_active"] < 6 and time.monotonic() < end:
            time.sleep(0.2)
        assert c.stats("a")["n_active"] == 6
        b.add(6, X[6])
    assert c.stats("a")["n_active"] == 7
    with pytest.raises(ValueError):
        b.add(7, X[7])
    now = [0.0]
    bucket = TokenBucket(10, 5, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    bucket.take(25)
    assert now[0] == pytest.approx(2.0)


def test_commands(spark, tmp_path):
    root, file = f"file://{tmp_path}/c", f"{tmp_path}/x.fvecs"
    vectors.write(rows(spark), file)
    call = lambda *args: cli.run(spark, [root, *args])
    assert call("build", "a", file, "--trees", "8", "--depth", "2")["n_docs"] == 40 and call("list") == ["a"]
    found = call("topn", "a", file, "--k", "1", "--probes", "2")
    assert [r["doc_id"] for r in found] == list(range(40)) and call("recall", "a", file, "--k", "1") == 1.0
    call("search", "a", file, "--out", f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 40
    rows(spark).write.parquet(f"{tmp_path}/t.parquet")
    assert call("delete", "a", f"{tmp_path}/t.parquet", "--where", "id < 10") == ["a"] and call("copy", "a", "b")["n_docs"] == 30
    call("append", "b", file)
    assert call("stats", "b")["n_hot"] == 40 and call("compact", "b") == 1 and call("verify", "b") == [] and call("health") == {"a": [], "b": []}
    assert call("backup", "b", f"file://{tmp_path}/k")["n_docs"] == 70 and call("restore", f"file://{tmp_path}/k", "d")["n_docs"] == 70
    call("drop", "a")
    assert call("list") == ["b", "d"] and json.dumps(call("stats", "d"))


def test_deadlines(spark):
    assert jobs.within(spark, 60, lambda: spark.range(10).count()) == (10, False)
    slow = spark.range(4).repartition(4).select(F.udf(lambda x: time.sleep(20) or x, "long")("id"))
    began = time.monotonic()
    assert jobs.within(spark, 1.5, lambda: slow.collect()) == (None, True) and time.monotonic() - began < 15
    with pytest.raises(ZeroDivisionError):
        jobs.within(spark, 60, lambda: 1 / 0)


def test_builds_go_on_where_they_stopped(spark, tmp_path):
    forest, path = Forest(n_trees=3, depth=3, dim=8), f"file://{tmp_path}/p"
    posted, built = jobs.build(rows(spark), forest, path, 4)
    whole = {tuple(r) for r in V.postings(rows(spark), forest).collect()}
    assert built == 4 and {tuple(r) for r in posted.collect()} == whole
    (tmp_path / "p" / "part=2" / "_SUCCESS").unlink()
    posted, built = jobs.build(rows(spark), forest, path, 4)
    assert built == 1 and {tuple(r) for r in posted.collect()} == whole
    with pytest.raises(ValueError):
        jobs.build(rows(spark), Forest(n_trees=3, depth=4, dim=8), path, 4)


def test_projection(spark):
    m = sparse_projection(8, 5, 2)
    got = {r.id: r.vec for r in projected(rows(spark), 8, 5, 2).collect()}
    assert np.allclose([got[i] for i in range(40)], X @ m) and set(np.unique(np.abs(m)).round(9)) <= {0.0, round(float(np.sqrt(3 / 5)), 9)}
