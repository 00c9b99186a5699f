"""Very long texts go part after part, with the results of whole ones."""

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sylvine.llm import flac, neardup, quality, segment, text, tokens

rng = np.random.default_rng(12)
VOCABULARY = ["the", "of", "Água", "x", "1984", "don't", "日本", "stone,", "river.", "a|b", "<tag>"]
LONG = "".join(str(rng.choice(VOCABULARY)) + str(rng.choice([" ", " ", "  ", "\n", "\t "])) for _ in range(4000))
TEXTS = [LONG, LONG.replace(" ", ""), " " * 900, "x", LONG[:300] + "y" * 2000 + " end"]


def raw(t):
    return text.text_bytes(pa.array([t], pa.string()))


@pytest.mark.parametrize("t", TEXTS)
def test_cuts_lie_before_words(t):
    buf, _ = raw(t)
    cuts = text.word_cuts(buf, 100)
    assert cuts[0] == 0 and cuts[-1] == len(buf) and all(text.WHITE[buf[c - 1]] and not text.WHITE[buf[c]] for c in cuts[1:-1])


@pytest.mark.parametrize("t", TEXTS)
def test_sets_and_features(monkeypatch, t):
    buf, at = raw(t)
    s, _ = neardup.sets(buf, at)
    x = quality.features(buf, at)
    m = neardup.minima(s, np.array([0, len(s)]))
    monkeypatch.setattr(neardup, "CHUNK", 150)
    monkeypatch.setattr(quality, "CHUNK", 150)
    again, begin = neardup.sets(buf, at)
    assert (again == s).all() and begin.tolist() == [0, len(s)]
    assert (quality.features(buf, at) == x).all()
    two = neardup.minima(np.concatenate([s, s]), np.array([0, len(s), 2 * len(s)]))
    assert (two == m).all()


@pytest.mark.parametrize("t", TEXTS)
def test_media(monkeypatch, t):
    buf, at = raw(t)
    out, cut = flac.encode_streams(*flac.pad(buf, at))
    pcm, _, offsets, _ = flac.decode_streams(out, cut)
    feature = flac.features(pcm ^ 0x80)
    monkeypatch.setattr(flac, "CHUNK", 1000)
    assert flac.encode_long(buf) == out.tobytes()
    got, starts = flac.decode_long(out)
    assert (got == pcm).all() and (starts == offsets).all() and flac.features(pcm ^ 0x80) == feature
    out[len(out) // 2] ^= 1
    assert flac.decode_long(out) is None


def test_token_words(monkeypatch, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = {r.doc_id: bytes(r.ids) for r in tokens.round_trip(df, path).collect()}
    coder = tokens.Words(path)
    for i, t in enumerate(TEXTS):
        buf, _ = raw(t)
        cuts = text.word_cuts(buf, 200)
        ids = np.concatenate([coder.encode(buf[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        assert np.append(ids, 2).astype("<u4").tobytes() == want[i]
    monkeypatch.setattr(tokens, "PART", 256)
    for v in (rng.integers(0, 50_000, 5000), 2 ** rng.integers(0, 64, 3000, dtype=np.uint64), np.zeros(0)):
        words, index = tokens.pack(v.astype(np.uint64))
        assert (tokens.unpack(words, index, len(v)) == v.astype(np.uint64)).all()


@pytest.mark.parametrize("t", TEXTS)
def test_samples(monkeypatch, t):
    v = segment.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))
    buf, at = segment._prefixed(*raw(t))
    key = text.stream(3, 1)
    want = segment.sample(v, buf, at, key, 3)[0]
    monkeypatch.setattr(segment, "CHUNK", 700)
    monkeypatch.setattr(segment, "HEAD_ENOUGH", -200.0)
    got = segment.sample_long(v, buf, key, 3)
    assert len(got) == len(want)
    for (ids, p, q), (ids2, p2, q2) in zip(got, want, strict=True):
        assert ids.tolist() == ids2.tolist() and p == pytest.approx(p2, abs=1e-6) and q == pytest.approx(q2, abs=1e-6)
    whole = b"".join(v.bytes[i] for i in want[0][0].tolist())
    assert v.spell(want[0][0]) == whole
