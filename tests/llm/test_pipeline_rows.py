import math
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from sylvine.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long"


def table(spark, rows):
    """Documents of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def counted(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_mixture_repeats_rows_without_an_id(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, words(f"n{s}{i}", 3 + i), s) for s in ("a", "b", None) for i in range(4)] + [(i, words(f"d{i}", 5 + i % 9), ("a", "b", None)[i % 3]) for i in range(30)] + [(None, None, "a"), (None, "", "b")]
    docs = table(spark, rows)
    got = counted(corpus_pipeline.mixing_stage(spark, docs, ""))
    want = Counter()
    for r in mixing.mix(docs.withColumn("row", docs.text), carry="row").collect():
        if r.taken:
            want[r.doc_id, r.carried, r.source] += math.ceil(r.taken / r["size"])
    assert got == want
    taken = Counter()
    for (i, t, s), n in got.items():
        taken[s] += n * len(t.split())
    goals = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert all(0 <= taken[s] - math.floor(g) <= 13 for s, g in goals.items())  # at most one document is kept beyond its cut
    assert sum(n for (i, _, _), n in got.items() if i is None) > 0


def brute_cut(texts, length=200):
    """Texts without the passages of `length` bytes that repeat; characters cut through lose their rest."""
    raw, seen = [(t or "").encode() for t in texts], Counter()
    for b in raw:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for t, b in zip(texts, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        pieces, piece = [], bytearray()
        for x, g in zip(b, gone, strict=True):
            if g:
                pieces.append(piece)
                piece = bytearray()
            else:
                piece.append(x)
        out.append("".join(bytes(p).decode("utf-8", "ignore") for p in [*pieces, piece]) if gone.any() else t)
    return out


def test_suffix_stage_cuts_passages_and_keeps_replacement_characters(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = word(260)
    rows = [(1, "\ufffd far " + word(50) + passage + word(40) + " tail \ufffd", "a"), (2, passage + word(80), "a"), (None, word(90) + passage + "\ufffd", "b"), (3, "\ufffd untouched", "a"), (4, None, None), (5, "", "b")]
    # Neighbours that differ in one byte of a character, before and behind a passage, so that cuts go through characters.
    for n, (x, y) in enumerate((("é", "è"), ("€", "₭"), ("\U0001f600", "\U0001f601"), ("éé", "ée"))):
        own = word(230)
        for i, (before, behind) in enumerate(((x, x), (y, y), (x[::-1], y))):
            rows.append((10 * n + 10 + i, word(30) + before + own + behind + word(30) + "\ufffd", "a"))
    own = "\u0103" + word(210) + "é"  # leads of other characters with the same last byte, and lasts of the same lead
    rows += [(80, word(9) + own + word(9), "a"), (81, word(9) + "\u0143" + own[1:-1] + "è" + word(9), "a"), (82, passage, "a"), (83, passage, None)]
    got = Counter((r.doc_id, r.text, r.source, r.n_chars) for r in corpus_pipeline.suffix_stage(spark, table(spark, rows), "").collect())
    want = brute_cut([t for _, t, _ in rows])
    assert got == Counter((i, w, s, None if w is None else len(w)) for (i, _, s), w in zip(rows, want, strict=True))
    assert sum(w != t for (_, t, _), w in zip(rows, want, strict=True)) > 10 and want[0].count("\ufffd") == 2


CLASHES = ("of", "times", "copy", "touched", "new_text", "row", "carried", "count", "id", "r1", "part", "n", "size", "component", "component_id", "bucket", "x", "y", "taken", "label", "quality", "score")


def test_stages_take_columns_of_any_name_and_rows_without_an_id(spark, tmp_path):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    rows = [(i if i % 4 else None, text(30 + i % 20), ("a", "b", None)[i % 3]) for i in range(40)]
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, rows).selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        found = got.collect()
        assert all(r[c] == c for r in found for c in CLASHES), name
        if stage in (corpus_pipeline.neardup_stage, corpus_pipeline.suffix_stage):
            assert Counter((r.doc_id, r.text) for r in found) == Counter((i, t) for i, t, _ in rows), name
        assert any(r.doc_id is None for r in found) or stage is corpus_pipeline.quality_stage, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.segment_stage(spark, docs, "").select("doc_id").where("doc_id IS NULL").count() >= 10


def test_neardup_stage_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(11)
    rows, group = [], {}
    for g in range(12):
        base = [f"w{i}" for i in rng.integers(0, 10**6, 150)]
        for j in range(int(rng.integers(1, 6))):
            own = list(base)
            if j:
                own[int(rng.integers(0, 150))] = f"z{j}"  # 5 of 146 shingles: a similarity of 0.93 with the base, 0.87 with one another
            group[100 * g + j] = 100 * g
            rows.append((100 * g + j, " ".join(own), "a"))
    loose = [(None, rows[0][1], "a"), (None, "", "a"), (7000, "", None), (7001, None, None)]
    got = corpus_pipeline.neardup_stage(spark, table(spark, rows + loose), "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows if group[i] == i) + Counter((i, t) for i, t, _ in loose)
