import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from sylvine.llm import ann, components, flac, licenses, mixing, neardup, quality, queries, segment, suffix, tokens, urls
from sylvine.scratch import Scratch

LONG = " ".join(f"word{i} tail{i % 7}" for i in range(200))
ROWS = [
    (1, LONG, "en", "a", "x"), (2, LONG.replace("word50 ", "other "), "en", "a", "x"), (3, LONG, None, None, "x"), (3, LONG, None, None, "x"), (4, None, None, "b", None),
    (5, "", "en", "b", "x"), (6, " \t\n", "en", "b", "x"), (7, "Released under the MIT License.", "en", "c", "x"), (None, "no id here at all", "en", "c", "x"), (8, "two words", "en", "a", "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_mixing_targets_and_shares(spark, docs):
    for df in (docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        got = mixing.mix(df).toPandas()
        assert len(got) == df.count() and (got.taken <= 2 * got["size"]).all()
        by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
        assert (abs(by.taken - by.target) < 1).all() and abs(by.target.sum() - 1.5 * got["size"].sum()) < 1e-6
        again = mixing.mix(df).toPandas()
        assert sorted(zip(got.doc_id.fillna(-1), got.taken)) == sorted(zip(again.doc_id.fillna(-1), again.taken))
    assert mixing.mix(docs.where("false")).count() == 0
    uneven = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, source_size long")).collect()}
    assert uneven == {"a": 20.0, "b": pytest.approx(2995 / 3), "c": pytest.approx(5990 / 3)}


def test_licenses(docs):
    assert [(r.doc_id, r.license, r.containment) for r in licenses.scan(docs).collect()] == [(7, "mit", 1.0)]
    assert licenses.scan(docs.where("false")).count() == 0


def brute_components(rows, percent):
    def shingled(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, label = {i: shingled(t) for i, t in rows}, {}
    for i in sorted(sets):
        label[i] = i
        for j in list(label):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return sets, label


def test_neardup_equals_brute_force(spark, docs, monkeypatch):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None]
    for i in range(40):  # a chain: neighbours are similar, its ends are not
        base = list(base)
        base[int(rng.integers(0, 120))] = f"z{i}"
        rows.append((100 + i, " ".join(base)))
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = neardup.group(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    sets, label = brute_components(rows, 85)
    assert len(got) == len(rows) and all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id) for r in got)
    odd = neardup.group(docs.where("doc_id IS NULL")).collect()
    assert [(r.component_id, r.kept) for r in odd] == [(None, None)] and neardup.group(docs.where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100 + i, 200) for i in range(20)] + [(7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in [*range(100, 120), 200]}


def _repeated_bytes(rows, length=200):
    """(id, bytes, removed, spans, kept) of each row by counting all strings."""
    raw, seen, want = [(i, (t or "").encode()) for i, t in rows], {}, []
    for _, b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        want.append((str(i), len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-1])[: len(b)]).sum()), bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return sorted(want)


def _dedup_rows(df, **options):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.dedup(df, **options).collect())


@pytest.mark.parametrize("bound", [suffix.BOUND, 2000])
def test_suffix_equals_brute_force(spark, bound):
    rng = np.random.default_rng(4)
    passage, line = "".join(rng.choice(list("abcde "), 320)), "".join(rng.choice(list("xyz "), 90))
    rows = [(i, "".join(rng.choice(list("abcdefgh "), 150)) + (passage if i % 2 else line) + "".join(rng.choice(list("abcdefgh "), 250))) for i in range(24)]
    rows += [(50, passage), (51, passage + passage), (52, "ab" * 300), (53, "short"), (54, None), (55, ""), (56, "é" * 150), (57, passage), (57, passage), (None, passage[:250]), (-(1 << 63), passage[50:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS r1", "'x' AS ref", "2 AS part", "3 AS n")
    assert _dedup_rows(df, bound=bound, shard=4 * bound) == _repeated_bytes(rows)
    assert suffix.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_splits_the_group_of_a_common_line(spark):
    """A line in every text and a passage in half of them: a shard raises if a suffix array would exceed the bound."""
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnop "))
    draw = lambda n: "".join(letters[rng.integers(0, 17, n)])
    line, passage = draw(150), draw(260)
    rows = [(i if i % 5 else None, draw(120) + line + draw(130) + (passage if i % 2 else "") + draw(90)) for i in range(1500)]
    assert _dedup_rows(spark.createDataFrame(rows, "doc_id long, text string"), bound=20_000, shard=60_000) == _repeated_bytes(rows)


def test_suffix_tells_rows_without_an_id_apart(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdef "), 230)) for _ in range(5000)]
    rows = [(None, t) for t in texts] + [(1, texts[0] + "x"), (1, texts[7][:210]), (1, texts[9][3:])]
    assert _dedup_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == _repeated_bytes(rows)


def test_suffix_of_a_row_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 700)
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdef "), 6000))
    rows = [(1, long + long[1000:1500]), (2, long[5800:] + "q" * 300), (3, long[650:900])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix._find(df.selectExpr("xxhash64(doc_id) AS r1", "xxhash64(text) AS r2", "text"), 200, 32)
    assert found.selectExpr("sum(ref & 255)").first()[0] == sum(len(t) - 199 for _, t in rows)
    assert _dedup_rows(df) == _repeated_bytes(rows)


def test_tokens_round_trip(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    got = tokens.round_trip(docs, path).orderBy("start").collect()
    begin = 0
    for r, (i, t, *_) in zip(got, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, begin, len(ids), np.array(ids, "<u4").tobytes())
        begin += len(ids)
    assert tokens.round_trip(docs.where("false"), path).count() == 0


def test_urls_hold_as_of_the_day(spark):
    entries = spark.createDataFrame([("l", "bad.com", "add", "2024-01-10"), ("l", "bad.com", "remove", "2024-02-01"), ("l", "bad.com", "add", "2024-06-01"), ("m", "x.bad.com", "add", "2024-01-01"), ("l", "same.org", "add", "2024-01-01"), ("l", "same.org", "remove", "2024-01-01"), (None, "x.org", "add", "2024-01-01")], "list string, pattern string, action string, since string")
    urls_ = ["http://bad.com/a", "https://u@X.Bad.com:80/b?c", "http://notbad.com", "http://same.org/", None, "nonsense"]
    rows = [(i, u, d) for i, u in enumerate(urls_) for d in ("2024-01-09", "2024-01-10", "2024-02-01", "2025-01-01", None)]
    got = {(r.page_id, str(r.fetched)): (r.blocked, r.n_lists, r.pattern) for r in urls.screen(spark.createDataFrame(rows, "page_id long, url string, fetched string"), entries).collect()}
    assert len(got) == 30 and [got[0, d][0] for d in ("2024-01-09", "2024-01-10", "2024-02-01", "2025-01-01", "None")] == [False, True, False, True, False]
    assert got[1, "2024-01-10"] == (True, 2, "x.bad.com") and got[1, "2024-02-01"] == (True, 1, "x.bad.com")
    assert not any(v[0] for (i, _), v in got.items() if i > 1)
    empty = urls.screen(spark.createDataFrame([], "page_id long, url string, fetched string"), entries)
    assert empty.count() == 0


def test_segment_round_trips(spark, docs):
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = segment.decode(segment.encode(docs, model, 2), model).collect()
    texts = {}
    for i, t, *_ in ROWS:
        texts.setdefault(i, set()).add(t or "")
    assert all(r.text in texts[r.doc_id] for r in got) and {r.doc_id for r in got} == set(texts)
    again = segment.encode(docs, model, 2).collect()
    assert sorted(map(str, ((r.doc_id, r["sample"], r.ids) for r in got))) == sorted(map(str, ((r.doc_id, r["sample"], r.ids) for r in again)))


def test_quality_on_held_out_rows(spark, docs):
    d = "/root/testdata/sf0.01"
    x = queries.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (x.predicted == x.quality).mean() > 0.93 and x[x.quality == 1].score.mean() > x[x.quality == 0].score.mean() + 0.4
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert quality.classify(docs, labels.where("false")).count() == len(ROWS) and quality.classify(docs.where("false"), labels).count() == 0


def test_ann_recall_and_edges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 64)).astype(np.float32)
    x[300:700] = x[300]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5020, [0.0] * 64), (5040, [float("nan")] * 64), (5060, [None] * 64), (5080, [1.0]), (None, [1.0] * 64), (20, x[20].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK", 8)
    monkeypatch.setattr(ann, "HELD", 5000)
    got = ann.search(df.where("vec_id % 20 = 0"), df).toPandas()
    v = x.astype(np.float64)
    s = v[::20] @ v.T
    hits = 0
    for n, q in enumerate(range(0, 1500, 20)):
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine.vec_id)
        assert np.allclose(mine.score, s[n, mine.vec_id], rtol=0, atol=1e-9)
        order = sorted((-round(float(s[n, j]), 9), j) for j in range(1500) if j != q)
        hits += len({j for _, j in order[:20]} & set(mine.vec_id))
    assert hits / (75 * 20) >= 0.9 and got.query_id.nunique() == 75
    named = df.selectExpr("vec_id AS id", "embedding AS vec", "1 AS key", "'x' AS vec_id", "2 AS q", "3 AS n")
    again = ann.search(named.where("id % 20 = 0"), named, id_col="id", vec_col="vec").toPandas()
    assert sorted(zip(again.query_id, again["rank"], again.vec_id)) == sorted(zip(got.query_id, got["rank"], got.vec_id))
    few = ann.search(df.where("vec_id = 0"), df.where("vec_id < 7"))
    assert few.count() == 6 and ann.search(df.where("false"), df.where("false")).count() == 0


def test_flac_columns(spark, docs):
    got = flac.decode(flac.encode(docs)).collect()
    for r in got:
        texts = [(t or "").encode() for i, t, *_ in ROWS if i == r.doc_id]
        assert r.error is None and any(bytes(r.pcm) == t.ljust(max(1, -(-len(t) // 192)) * 192) and r.n_bytes == len(t) for t in texts) and len(r.frame_offsets) * 192 == len(r.pcm)
    bad = spark.createDataFrame([(1, 1, bytearray(b"junk")), (2, 2, None), (3, 3, got[0].media)], "doc_id long, n_bytes long, media binary")
    assert [(r.doc_id, r.pcm is None, r.error is None) for r in flac.decode(bad).orderBy("doc_id").collect()] == [(1, True, False), (2, True, False), (3, False, True)]


def test_pipeline_stages_take_effect(spark):
    d = "/root/testdata/sf0.001"
    x = docs0 = spark.read.parquet(f"{d}/documents.parquet")
    between, counts = Scratch(spark, "test"), []
    for name, stage in corpus_pipeline.STAGES:
        x = between.table(stage(spark, x, d), name.split()[0])
        counts.append(x.count())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert x.columns == docs0.columns
    assert docs0.count() > counts[0] > counts[1] == counts[2] and counts[3] > 0 and counts[4] > counts[3]


def test_sql_gives_the_same_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, d).toPandas(), con.execute(sql).df()
        cols = sorted(want.columns)
        tidy = lambda t: sorted(str([None if v != v else v for v in r]) for r in t[cols].astype(object).where(t[cols].notna(), None).itertuples(index=False))
        assert sorted(got.columns) == cols and tidy(got) == tidy(want), name
