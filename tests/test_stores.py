import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvine.functions.forest import Forest
from sylvine.operators import documents as D, knn, meta as M, quantise
from sylvine.plans import knobs
from sylvine.plans.search import SearchSpec
from sylvine.sources import bitmaps, vectors
from sylvine.streaming.live import Catalog, LiveIndex

FOREST = Forest(n_trees=4, depth=3, dim=8)
ALL = SearchSpec(n_probes=63, multi_flip=True, top_n=10_000, top_k=5)


def points(spark, n=60, first=0):
    x = np.random.default_rng(first).standard_normal((n, 8))
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


@pytest.mark.parametrize("kind", ["fvecs", "bvecs", "fbin", "u8bin", "f16bin"])
def test_files_round_trip(spark, tmp_path, kind):
    rows = [(i, [float((i * 7 + j) % 200) for j in range(5)]) for i in range(30)]
    path = f"{tmp_path}/x.{kind}"
    assert vectors.write(spark.createDataFrame(rows, "id long, vec array<double>"), path, kind) == 30
    reader = spark.read.format("sylvine-vectors")
    spark.dataSource.register(vectors.VectorSource)
    assert [(r.id, list(r.vec)) for r in reader.option("splitBytes", "100").load(path).orderBy("id").collect()] == rows
    with open(path, "ab") as f:
        f.write(b"xyz")
    with pytest.raises(ValueError):
        vectors.layout(path)


def test_npy_truth_and_id_files(spark, tmp_path):
    np.save(f"{tmp_path}/a.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    assert vectors.read(spark, f"{tmp_path}/a.npy").count() == 4
    vectors.write(spark.createDataFrame([(0, [5, 6]), (1, [7, 8])], "id long, ids array<long>"), f"{tmp_path}/t.ivecs", "ivecs")
    assert [tuple(r) for r in vectors.truth(spark, f"{tmp_path}/t.ivecs").orderBy("qid", "rank").collect()] == [(0, 1, 5), (0, 2, 6), (1, 1, 7), (1, 2, 8)]
    np.array([3, -1, 99, 3], "<i4").tofile(f"{tmp_path}/f.int32")
    assert [r.doc_id for r in vectors.id_filter(spark, f"{tmp_path}/f.int32", 50).collect()] == [3]


def test_bitmaps_round_trip():
    for ids in ([], [5], [1, 70_000, 1 << 31], range(0, 200_000, 3)):
        data = bitmaps.to_portable(np.array(list(ids), np.int64))
        assert bitmaps.from_portable(data).tolist() == sorted(ids)
    assert bitmaps.from_state(bytes([0, 2]) + np.array([9, 4], "<u4").tobytes()).tolist() == [4, 9]
    small = bitmaps.to_portable(np.array([1, 2]))
    assert bitmaps.from_state(bytes([1, len(small)]) + small).tolist() == [1, 2]


def test_live_index_life(spark, tmp_path):
    index = LiveIndex(spark, f"file://{tmp_path}/i", FOREST)
    for part in range(4):
        index.insert(points(spark, 20, 20 * part), f"b{part}")
        index.insert(points(spark, 20, 20 * part), f"b{part}")
        if part == 2:
            index.delete(spark.createDataFrame([(3,), (45,)], "id long"))
        index.freeze()
    # The segment that the last freeze made is newer than the deletion, so its tombstones are gone.
    assert index.stats() == {"n_docs": 78, "n_active": 0, "n_deleted": 0, "n_hot": 0, "tiers": {1: 1}} and index.verify() == []
    assert index.manifest()["segments"][0]["depth"] == 5 and index.vacuum() and index.verify() == []
    index.insert(points(spark, 10, 200))
    assert index.next_id() == 210
    q = index.vectors().where("id % 40 = 0")
    truth = knn.exact(q, index.vectors(), 5, include_self=True)
    found = index.search(q, ALL)
    assert {(r.qid, r.rank, r.doc_id) for r in found.collect()} == {(r.qid, r.rank, r.doc_id) for r in truth.collect()}
    assert found.where("doc_id IN (3, 45)").isEmpty()
    with pytest.raises(BufferError):
        LiveIndex(spark, f"file://{tmp_path}/i", max_active=5).insert(points(spark, 1, 500))
    with pytest.raises(KeyError):
        LiveIndex(spark, f"file://{tmp_path}/none")


def test_streaming_ingest(spark, tmp_path):
    points(spark, 30).write.parquet(f"{tmp_path}/in")
    index = LiveIndex(spark, f"file://{tmp_path}/i", FOREST)
    stream = spark.readStream.schema("id long, vec array<double>").parquet(f"{tmp_path}/in")
    for _ in range(2):
        index.ingest(stream, f"{tmp_path}/check").awaitTermination(60)
    assert index.active().count() == 30


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    for i, name in enumerate(("docs-20240101", "docs-20240301", "media")):
        c.create(name, FOREST).insert(points(spark, 10, 100 * i))
    assert c.list("docs-*") == ["docs-20240101", "docs-20240301"] and c.expired(30, dt.date(2024, 3, 2)) == ["docs-20240101"]
    found = c.search("docs-*", points(spark, 1), ALL).collect()
    assert len(found) == 5 and found[0]["index"] == "docs-20240101" and found[0].dist == 0
    with pytest.raises(FileExistsError):
        c.create("media", FOREST)
    c.drop("media")
    with pytest.raises(KeyError):
        c.open("media")


def ruled_chunks(text, size, overlap):
    """The rule, character by character."""
    out, begin = [], 0
    while begin < len(text):
        stop = begin + size
        if stop >= len(text):
            return [*out, (begin, len(text))]
        spaces = [k for k in range(max(begin + 1, stop - min(80, size // 4)), stop) if text[k] == " "]
        stop = spaces[-1] if spaces else stop
        out.append((begin, stop))
        begin = max(stop - overlap, begin + 1)
    return out


def test_chunks_follow_the_rule():
    rng = np.random.default_rng(5)
    for _ in range(400):
        text = "".join(rng.choice(list("ab  é日"), int(rng.integers(0, 150))))
        size = int(rng.integers(1, 50))
        overlap = int(rng.integers(0, size))
        got = D.chunk_bounds(np.frombuffer(text.encode("utf-32-le"), np.uint32), size, overlap)
        assert [tuple(x) for x in got.tolist()] == ruled_chunks(text, size, overlap)
    with pytest.raises(ValueError):
        D.chunk_bounds(np.zeros(0, np.uint32), 10, 10)


def test_chunks_are_numbered_in_order(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(7, text), (9, "short"), (5000, text), (1, None), (70_000_000, "far")], "doc_id long, text string")
    rows = D.numbered(D.chunks(docs, size=200, overlap=40)).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows))) and [r.parent for r in rows] == sorted(r.parent for r in rows)


def test_document_store(spark, tmp_path):
    store = D.DocumentStore(spark, f"file://{tmp_path}/d", Forest(n_trees=8, depth=2, dim=64), size=60, overlap=10)
    docs = [("a", "red apples grow on old trees " * 6, {"kind": "fruit"}), ("b", "ships sail over the cold sea " * 6, {"kind": "sea"}), ("c", "apples and ships", None), ("e", "", None)]
    df = spark.createDataFrame(docs, "key string, text string, meta map<string,string>")
    assert store.insert(df) == 4
    assert {r.key: "".join(r.chunks)[:9] for r in store.get(df).collect()} == {"a": "red apple", "b": "ships sai", "c": "apples an", "e": ""}
    for bad in ("a", None):
        with pytest.raises(ValueError):
            store.insert(spark.createDataFrame([(bad, "x")], "key string, text string"))
    with pytest.raises(ValueError):
        store.insert(spark.createDataFrame([("x", "1"), ("x", "2")], "key string, text string"))
    q = spark.createDataFrame([(1, "red apples grow")], "qid long, text string")
    assert [r.key for r in store.search(q, ALL, top_docs=2).orderBy("place").collect()][0] == "a"
    assert [r.key for r in store.search(q, ALL, "meta.kind = 'sea'", top_docs=2).collect()] == ["b"]
    n = store.chunk_rows().count()
    gone = store.delete(spark.createDataFrame([("a",), ("none",)], "key string"))
    assert gone > 1 and store.chunk_rows().count() == n - gone and store.get(df).count() == 3
    assert "a" not in {r.key for r in store.search(q, ALL).collect()}
    store.insert(spark.createDataFrame([("a", ["red apples", "again"])], "key string, chunks array<string>"))
    again = store.documents().where("key = 'a'").first()
    assert again.n_chunks == 2 and again.first_chunk == n and store.documents().count() == 4
    assert store.search(q, ALL, top_docs=1).first().key == "a"


def test_deletions_live_as_long_as_older_rows(spark, tmp_path):
    index = LiveIndex(spark, f"file://{tmp_path}/i", FOREST)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    index.insert(points(spark, 10))
    index.freeze()
    index.delete(ids(3, 4))
    index.insert(points(spark, 4).where("id = 3"))
    assert index.stats()["n_deleted"] == 2 and sorted(r.id for r in index.vectors().collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert {r.doc_id for r in index.search(points(spark, 4), ALL).collect()} >= {3} and index.search(points(spark, 5), ALL).where("doc_id = 4").isEmpty()
    for part in range(3):
        index.insert(points(spark, 5, 100 + 10 * part))
        index.freeze()
    assert index.stats()["n_deleted"] == 0 and index.stats()["tiers"] == {1: 1} and index.vectors().count() == 24
    index.insert(points(spark, 10).withColumn("vec", F.array([F.lit(9.0)] * 8)).where("id = 5"))  # the latest of two rows of an id
    assert index.vectors().where("id = 5").first().vec[0] == 9.0 and index.vectors().count() == 24


def test_changes_exclude_one_another(spark, tmp_path):
    index = LiveIndex(spark, f"file://{tmp_path}/i", FOREST)
    m = index.manifest()
    index.insert(points(spark, 3), "one")
    with pytest.raises(FileExistsError):
        index.change(m)
    assert not index.insert(points(spark, 3), "one") and index.insert(points(spark, 3, 10), "two") and index.active().count() == 6
    index.store.put("manifests/00000003.json", "{")  # another writer, half way
    with pytest.raises(BlockingIOError):
        index.manifest()
    index.store.age = lambda name="": 1e6
    assert index.manifest()["next"] == 4
    index.delete(points(spark, 1).select("id"))
    assert index.active().count() == 5


def test_medians_outlive_the_session(spark, tmp_path):
    index = LiveIndex(spark, f"file://{tmp_path}/i", FOREST)
    rows = points(spark, 200).withColumn("vec", F.transform("vec", lambda v: v + 2.0))
    index.insert(rows)
    index.recalibrate(3)
    index = LiveIndex(spark, f"file://{tmp_path}/i")
    index.freeze()
    assert index.forest().medians.shape == (4, 7)
    sizes = index.postings(*index.manifest()["segments"]).where("tree = 0").groupBy("leaf").count()
    assert sizes.agg(F.max("count")).first()[0] < 40


def test_appended_segments_merge(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    index = c.create("a", FOREST)
    index.insert(points(spark, 30))
    index.freeze()
    index.append(points(spark, 10, 100))
    index.append(points(spark, 10, 105))
    assert index.stats()["n_hot"] == 20 and c.maintain(50) == {} and c.maintain(15) == {"a": 2}
    assert index.stats() == {"n_docs": 45, "n_active": 0, "n_deleted": 0, "n_hot": 0, "tiers": {0: 2}} and index.verify() == []


def test_backup_adopt_copy_and_expiry(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    index = c.create("a", FOREST)
    index.insert(points(spark, 20))
    assert c.backup("a", f"file://{tmp_path}/b")["n_docs"] == 20
    index.delete(points(spark, 5).select("id"))
    with pytest.raises(FileExistsError):
        c.restore(f"file://{tmp_path}/b", "a")
    assert c.copy("a", "copy").vectors().count() == 15
    assert c.restore(f"file://{tmp_path}/b", "a", force=True).vectors().count() == 20
    assert c.adopt(f"file://{tmp_path}/b", "b").vectors().count() == 20 and c.list() == ["a", "b", "copy"]
    assert c.delete("[ab]", points(spark, 8).select("id")) == ["a", "b"] and c.open("b").vectors().count() == 12
    assert c.drop_expired(1, dt.date.today()) == [] and c.drop_expired(1, dt.date.today() + dt.timedelta(2)) == ["a", "b", "copy"] and c.list() == []


def test_growing_and_remote_files(spark, tmp_path):
    path, first = f"{tmp_path}/x.fvecs", points(spark, 6)
    vectors.write(first, path)
    whole = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(whole[:100])  # two rows and a part of the third
    stream = vectors.tail(spark, path)
    for want in (2, 6):
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/out").count() == want
        with open(path, "wb") as f:
            f.write(whole)
    assert vectors.read(spark, f"file://{path}").count() == 6
    assert vectors.write_parts(first, f"file://{tmp_path}/parts") == 6
    got = [r.id for n in sorted((tmp_path / "parts").iterdir()) if n.suffix == ".fvecs" for r in vectors.read(spark, str(n)).collect()]
    assert len(got) == 6
    np.concatenate([np.array([2, 3], "<u4"), np.arange(6, dtype="<u4"), np.zeros(6, "<f4").view("<u4")]).tofile(f"{tmp_path}/t.ibin")
    assert [list(r.ids) for r in vectors.read(spark, f"{tmp_path}/t.ibin").orderBy("id").collect()] == [[0, 1, 2], [3, 4, 5]]


def test_sets_of_ids_as_columns(spark):
    df = spark.createDataFrame([(list(range(0, 3000, 7)),), ([5, 6],), (None,)], "ids array<long>")
    got = bitmaps.ids(df.select(bitmaps.packed("ids").alias("state")))
    assert sorted(r.doc_id for r in got.collect()) == sorted({5, 6, *range(0, 3000, 7)})


def test_choices_are_measured_and_kept(spark, tmp_path):
    seen = []
    assert knobs.measured_depth(lambda d: seen.append(d) or 100 * 4 ** (14 - d) ** 0.5, 14, 800, 10**6) <= 14 and seen == [14, 12]
    tried = []
    got = knobs.calibrate(lambda p, c, n: tried.append((p, c)) or (0.5 if p == 768 else c / 10**6), gain=0.01)
    assert (1024, 400_000) in tried and (768, 400_000) not in tried and got["recall"] == 0.5
    assert knobs.ladder(lambda cap: "found" if cap < 250_000 else None) == ("found", 200_000) and knobs.ladder(lambda cap: None, seconds=0) == (None, None)
    assert knobs.recalibration_points(99_999) == [] and knobs.recalibration_points(450_000) == [100_000, 200_000, 400_000]
    store = LiveIndex(spark, f"file://{tmp_path}/i", FOREST).store
    knobs.recommend(store, "search.json", top_n=10)
    assert store.get("search.json") == '{"top_n": 10}'


def test_conditions(spark):
    rows = [(1, "fr", True, dt.date(2024, 1, 5), 1.25, ["a", "b"]), (2, "en", False, dt.date(2023, 1, 5), 2.0, []), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, lang string, ok boolean, day date, score double, tags array<string>")
    ids = lambda **c: [r.id for r in df.where(M.where(df.schema, c, {"score": 2})).orderBy("id").collect()]
    assert ids(lang=["fr", "en"]) == [1, 2] and ids(ok=False) == [2] and ids(day=("range", dt.date(2025, 1, 1), dt.date(2024, 1, 1))) == [1]
    assert ids(score=("range", 1.0, 1.25)) == [1] and ids(tags="b") == [1] and ids(tags=("exists",)) == [1] and ids(lang=("re", "^e")) == [2] and ids() == [1, 2, 3]
    with pytest.raises(TypeError):
        M.where(df.schema, {"score": 1.0})
    keys = {r.key for r in M.keys(df, "id", ["lang", "day", "tags"]).collect()}
    assert {"lang=fr", "day=20240105", "day.b3=20240", "tags=a", "tags:*"} <= keys


@pytest.mark.parametrize("bits,least", [(4, 0.9), (1, 0.6)])
def test_quantised_selection_keeps_near_ones(spark, bits, least):
    x = np.random.default_rng(3).standard_normal((300, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    q = df.where("id < 10")
    pairs = q.select(F.col("id").alias("qid")).join(df.select(F.col("id").alias("doc_id")), F.lit(True)).where("qid <> doc_id")
    kept = quantise.select(pairs, q, quantise.encode(df, bits), 60, bits)
    assert knn.recall(knn.rerank(kept, q, df, 10), knn.exact(q, df, 10), 10).first().recall >= least
