import hashlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sylvine.llm import ann, flac, mixing, neardup, quality, segment, suffix, text, tokens

rng = np.random.default_rng(5)
TEXTS = ["", " ", "a", "Hello  World\n\tfoo", "one two three four five six", "naïve café 日本語 x", "x" * 1000, "a b " * 400, "the quick brown fox " * 30, "q! it's <|endoftext|> 12.5% don't"]


def packed(texts):
    return text.text_bytes(pa.array(texts, pa.string()))


def test_words_and_shingles_equal_plain_python():
    buf, at = packed([*TEXTS, None])
    starts, ends, first = text.word_spans(buf, at)
    raw = buf.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [t.split() for t in [*TEXTS, ""]]
    s, begin = neardup.sets(buf, at)
    for t, n in zip([*TEXTS, ""], np.diff(begin), strict=True):
        w = [x.lower() for x in t.split()]
        assert n == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)


def test_minhash_estimates_similarity():
    def pair(j):
        a = rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        n = round(400 * 2 * j / (1 + j))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 400 - n).astype(np.uint64)])
        return neardup.minima(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 400, 800]))

    for j in (0.5, 0.85):
        assert abs(np.mean([(m[0] == m[1]).mean() for m in (pair(j) for _ in range(20))]) - j) < 0.08
    few = neardup.minima(np.sort(rng.integers(0, 2**63, 3).astype(np.uint64)), np.array([0, 3, 3]))
    assert (few[0] != neardup.EMPTY).all() and (few[1] == neardup.EMPTY).all() and len(np.unique(few[0])) == 3


@pytest.mark.parametrize("trial", range(25))
def test_suffix_array_and_prefixes(trial):
    r = np.random.default_rng(trial)
    t = r.integers(1, int(r.integers(2, 6)), int(r.integers(1, 300))).astype(np.uint8)
    t = np.tile(t[: max(1, len(t) // 6)], 6) if trial % 3 == 0 else t
    sa, b = suffix.sort_suffixes(t), t.tobytes()
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    _, prefix = suffix.common_prefixes(t, sa)
    for x, y in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        n = 0
        while max(x, y) + n < len(b) and b[x + n] == b[y + n]:
            n += 1
        assert prefix[y] == n


def test_repeats_of_pieces_and_their_stretches():
    base, parts = rng.integers(97, 101, 3000).astype(np.uint8), []
    for _ in range(30):
        a = int(rng.integers(0, 2700))
        x = base[a : a + int(rng.integers(20, 300))].copy()
        x[rng.integers(0, len(x))] = 101
        parts.append(x)
    buf, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
    valid = np.arange(len(buf)) + 50 <= np.repeat(np.cumsum(sizes), sizes)
    spot = np.arange(len(buf)) + np.repeat(np.arange(len(sizes)), sizes)
    t = np.zeros(len(buf) + len(sizes), np.uint8)
    t[spot] = buf
    strings = [buf[i : i + 50].tobytes() for i in range(len(buf))]
    seen = {}
    for i in np.flatnonzero(valid).tolist():
        seen[strings[i]] = seen.get(strings[i], 0) + 1
    assert (suffix.repeats(t, 50)[spot][valid] == [seen[strings[i]] > 1 for i in np.flatnonzero(valid).tolist()]).all()
    assert suffix.repeats(np.append(np.tile(np.arange(1, 400), 6), 0).astype(np.uint16), 200)[:2195].all()  # more symbols than bytes have values
    row, begin, count, h, e = suffix.stretches(buf, np.concatenate([[0], np.cumsum(sizes)]), 50, 16)
    assert count.sum() == valid.sum() and count.max() <= 35


def test_simple8b_round_trips():
    for v in (np.zeros(1000), rng.integers(0, 50_000, 5000), rng.integers(0, 2, 5000), 2 ** rng.integers(0, 64, 3000, dtype=np.uint64), np.array([2**64 - 1] * 3, np.uint64), np.arange(1), np.zeros(0)):
        v = v.astype(np.uint64)
        words, index = tokens.pack(v)
        assert (tokens.unpack(words, index, len(v)) == v).all()
    data = tokens.to_segment(np.array([4, 9]), np.array([False, True]), np.array([2, 1]), np.array([5, 2, 2]))
    doc, nulls, count, ids = tokens.from_segment(data)
    assert doc.tolist() == [4, 9] and nulls.tolist() == [False, True] and count.tolist() == [2, 1] and ids.tolist() == [5, 2, 2]
    with pytest.raises(ValueError):
        tokens.from_segment(data + b"x")


def test_words_encode_like_the_tokenizer():
    coder = tokens.Words(public_tokenizers.path("word_bpe_49k.json"), most=50)
    texts = [*TEXTS, "a<|endoftext|>b <|ENDOFTEXT|> it's O'REILLY'S don't.x re.'s x'ß é.é A.́  b ΣΑΣ. 12a.3", "日本語.テスト w.、x", "end.", "Start"]
    for _ in range(2):
        ids, count = coder.encode(*packed(texts))
        got = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
        assert got == [e.ids for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_flac_round_trips_and_finds_damage():
    pay = [np.zeros(192, np.uint8), rng.integers(0, 256, 1920).astype(np.uint8), np.concatenate([np.full(191, 5), [255]]).astype(np.uint8), np.tile([0, 255], 96).astype(np.uint8), (np.arange(1920) // 8).astype(np.uint8), np.frombuffer(("the cat sat on the mat. " * 16).encode(), np.uint8), (128 + 100 * np.sin(np.arange(1920) / 9)).astype(np.uint8)]
    buf, sizes = np.concatenate(pay), np.array([len(p) for p in pay])
    out, at = flac.encode_streams(buf, sizes)
    pcm, cut, offsets, good = flac.decode_streams(out, at)
    assert good.all() and (pcm == buf).all() and len(offsets) == sizes.sum() // 192
    for i, p in enumerate(pay):
        samples, bps, seek = flac.decode_stream(out[at[i] : at[i + 1]].tobytes())
        assert bps == 8 and ((samples[:, 0] + 128).astype(np.uint8) == p).all() and [s for s, _, _ in seek] == list(range(0, len(p), 192))
    assert {0x10, 0x42} <= set(out[at[:-1] + 42 + 6].tolist()) | {0x10}
    out[at[5] + 70] ^= 4
    assert flac.decode_streams(out, at)[3].tolist() == [i != 5 for i in range(len(pay))]
    with pytest.raises(Exception):  # noqa: B017
        flac.decode_stream(out[at[5] : at[6]].tobytes())


def test_pu_learning_separates_and_calibrates():
    good, bad = rng.standard_normal((800, 5)) + 1, rng.standard_normal((200, 5)) - 2
    w, b = quality.fit_pu(good[:300], np.vstack([good[300:], bad]), 0.7)
    assert (good @ w + b).mean() > (bad @ w + b).mean() + 1
    a, c = quality.platt(np.concatenate([good @ w + b, bad @ w + b]), np.repeat([1.0, 0.0], [800, 200]))
    assert a > 0 and quality.held_out("5") in (True, False) and not quality.held_out(None)
    x = quality.features(*packed(TEXTS))
    assert np.isfinite(x).all() and (x[0] == 0).all() and (quality.features(*packed(TEXTS[7:8])) == x[7]).all()


def test_cross_polytope_cells_follow_nearness():
    x = rng.standard_normal((500, 64))
    y = x + 0.1 * rng.standard_normal((500, 64))
    a, b = ann.rotate(x, 0), ann.rotate(y, 0)
    assert np.allclose((a * a).sum(1), (x * x).sum(1) * 64**3) and (ann.cells(a) == ann.cells(b)).mean() > 0.6
    for choice in ([64], [64, 4], [8, 8, 2]):
        probes = ann.probe_cells(x, 3, choice, 9)
        assert (probes[:, 0] == ann._joint(x, 3, choice, 5)).all() and all(len(set(p)) == len(p) for p in probes.tolist())
    assert ann.axes(100, 64) == [8] and ann.axes(51_282, 64) == [64, 32] and ann.axes(3, 64) == [1] and len(ann.axes(10**9, 64)) == 4


def test_joint_probes_come_in_order_of_cost():
    x, choice = rng.standard_normal((20, 16)), [16, 4]
    lag = []
    for i, k in enumerate(choice):
        y = ann.rotate(x, 8 * 2 + i)
        y = y[:, :k] / np.sqrt((y * y).mean(1, keepdims=True))
        both = np.stack([y, -y], 2).reshape(20, -1)
        lag.append((both.max(1, keepdims=True) - both) ** 2)
    whole = (lag[0][:, :, None] + lag[1][:, None, :]).reshape(20, -1)
    assert (ann.probe_cells(x, 2, choice, 30) == np.argsort(whole, 1, kind="stable")[:, :30]).all()


def test_gumbel_samples_are_distinct_and_follow_the_lattice():
    v = segment.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"), 10.0, 0.2)
    buf, at = segment._prefixed(*packed(TEXTS))
    got = segment.sample(v, buf, at, text.stream(1, len(TEXTS)), 3)
    raw = buf.tobytes()
    for r, rows in enumerate(got):
        assert all(b"".join(v.bytes[i] for i in ids.tolist()) == raw[at[r] : at[r + 1]] for ids, _, _ in rows)
        assert len({tuple(ids.tolist()) for ids, _, _ in rows}) == len(rows) and all(p <= 1e-9 and q <= 1e-9 for _, p, q in rows)
    assert len(got[0]) == 1 and len(got[8]) == 3
    n, word = 3000, b" th"
    many = segment.sample(v, np.frombuffer(word * n, np.uint8), np.arange(n + 1) * 3, text.stream(9, n), 2)
    probs, first, second = {}, {}, {}
    for rows in many:
        for (ids, p, _), seen in zip(rows, (first, second), strict=False):
            key = tuple(ids.tolist())
            probs[key], seen[key] = np.exp(p), seen.get(key, 0) + 1
    assert abs(sum(probs.values()) - 1) < 1e-6 and all(abs(first.get(k, 0) / n - p) < 0.04 for k, p in probs.items())
    want = {k: sum(probs[j] * p / (1 - probs[j]) for j in probs if j != k) for k, p in probs.items()}
    assert all(abs(second.get(k, 0) / n - p) < 0.04 for k, p in want.items())
