"""Suffix-array deduplication of byte strings that repeat anywhere in a corpus.

sort_suffixes() builds a suffix array by induced sorting. Suffixes are classified as smaller or larger than their right
neighbour; leftmost-smaller substrings are sorted by inducing from their unsorted starts, named, and, where names repeat,
the reduced string is ordered by doubling its ranks among the names still tied (its alphabet is as large as the text, for
which inducing bucket after bucket would not be vectorised); then all suffixes are induced from them. Inducing goes bucket
by bucket, all suffixes of a bucket that are there at once. common_prefixes() computes permuted common prefixes only where
they aren't one less than their left neighbour's.

dedup() finds every byte covered by a string of LENGTH bytes that also starts elsewhere, without one array of the corpus:
1. Each window of LENGTH bytes has an anchor, the run of GRAM bytes in it with the least hash, the leftmost of equals.
   Equal windows have equal anchors at equal places, so it is enough to compare windows of one anchor hash. Neighbouring
   windows with the same anchor form a stretch, at most LENGTH - GRAM + 1 windows.
2. Stretches whose anchor hash occurs once in the corpus are unique. Of the others, equal stretches are aggregated to one
   with a count; a count over 1 makes all its windows repeats.
3. Different stretches of one anchor hash are cut in two by the place of the anchor. What all windows of a half have in
   common (its core) is known by 128 bits of hash, the key; the rest are at most 2 * 84 bytes, the piece. Equal windows
   are in pieces of equal keys, so groups of one key are sent to shards, whose suffix arrays, of left part, key and right
   part of each piece, tell which windows repeat.
4. A group of more than `bound` bytes is not sent: its equal pieces are aggregated (those that come more than once repeat
   as a whole) and the others cut in two again, with longer cores, until groups are small enough; pieces of one window
   have nothing but a core, so equal keys are equal pieces there. No suffix array is of more than `bound` bytes.
5. What repeats goes back to the texts as ranges; they are united and cut out.

Null text is empty. Texts shorter than LENGTH keep everything. A very long text is hashed in overlapping parts of 1 MB. A
row is known by 128 bits of hash of its id, null or not, and its text, so rows may repeat ids, and rows equal in both are
copies of one another. An empty table gives an empty result. Only the named columns are read, and all columns of a row are
handed on where asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sylvine.llm.joins import joined
from sylvine.llm.text import BASE, BYTE, INVERSE, blocks, mix, powers, stream, text_bytes
from sylvine.scratch import Scratch

LENGTH, GRAM = 200, 32
CHUNK, SHARD, BOUND, OVERHEAD = 1 << 18, 4 << 20, 1 << 19, 8
EDGE = stream(77, 256)
SYMBOL = stream(78, 512)
POSITION = np.uint64((1 << 24) - 1)


def sort_suffixes(t: np.ndarray) -> np.ndarray:
    """The suffix array of small symbols (uint8 or uint16); the text's end counts as smaller than all symbols."""
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int32)
    k = int(t.max()) + 1
    step = np.full(n, -1, np.int8)
    step[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    at = np.where(step[:-1] != 0, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.zeros(n, bool)
    smaller[:-1] = step[at] > 0
    del at, step
    starts = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    size = np.bincount(t, minlength=k)
    tail = np.cumsum(size)
    head = tail - size

    def place(sa: np.ndarray, fill: np.ndarray, j: np.ndarray, down: bool) -> None:
        c = t[j]
        order = np.argsort(c, kind="stable")
        c, j = c[order], j[order]
        count = np.bincount(c, minlength=k)
        rank = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count)
        if down:
            sa[fill[c] - 1 - rank] = j
            fill -= count
        else:
            sa[fill[c] + rank] = j
            fill += count

    def induce(ordered: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int32)
        stop = tail.copy()
        place(sa, stop, ordered[::-1], True)
        fill = head.copy()
        place(sa, fill, np.array([n - 1], np.int32), False)  # the last suffix is larger than the end
        for c in range(k):
            done = head[c]
            while done < fill[c]:
                batch = sa[done : fill[c]]
                done = fill[c]
                j = batch[batch > 0] - 1
                place(sa, fill, j[~smaller[j]], False)
            batch = sa[stop[c] : tail[c]]
            j = batch[batch > 0] - 1
            place(sa, fill, j[~smaller[j]], False)
        stop = tail.copy()
        for c in range(k - 1, -1, -1):
            done = tail[c]
            while done > stop[c]:
                batch = sa[stop[c] : done][::-1]
                done = stop[c]
                j = batch[batch > 0] - 1
                place(sa, stop, j[smaller[j]], True)
            batch = sa[head[c] : fill[c]][::-1]
            j = batch[batch > 0] - 1
            place(sa, stop, j[smaller[j]], True)
        return sa

    if len(starts):
        first = np.zeros(n, bool)
        first[starts] = True
        sa = induce(starts)
        ordered = sa[first[sa]]
        del sa, first
        # Names: neighbours in this order with equal substrings get equal names.
        where = np.zeros(n, np.int32)
        where[starts] = np.arange(len(starts))
        stop = np.append(starts[1:] + 1, n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((SYMBOL[t] + smaller.astype(np.uint64)) * powers(BASE, n), out=sums[1:])
            h = (sums[stop] - sums[starts]) * powers(INVERSE, n + 1)[starts]
        del sums
        h, length = mix(h)[where[ordered]], (stop - starts)[where[ordered]]
        new = (h[1:] != h[:-1]) | (length[1:] != length[:-1])
        last = where[ordered] == len(starts) - 1  # reaches the end, so it equals no other
        new |= last[1:] | last[:-1]
        name = np.concatenate([[0], np.cumsum(new)])
        rank = np.empty(len(starts), np.int64)
        rank[where[ordered]] = name
        if name[-1] + 1 < len(starts):
            ordered = starts[_order_ranks(rank)]
        sa = induce(ordered)
    else:
        sa = induce(starts)
    return sa


def _order_ranks(rank: np.ndarray) -> np.ndarray:
    """The suffix array of ranks 0.. by doubling; only tied suffixes are sorted again."""
    n, width = len(rank), 1
    order = np.argsort(rank, kind="stable")
    r = rank[order]
    new = np.append(True, r[1:] != r[:-1])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    while True:
        single = new & np.append(new[1:], True)
        tied = np.flatnonzero(~single)
        if not len(tied):
            return order
        pos = order[tied]
        nxt = pos + width
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        key = rank[pos] * (n + 1) + second + 1
        o = np.argsort(key, kind="stable")
        order[tied] = pos[o]
        key = key[o]
        new[tied] = np.append(True, key[1:] != key[:-1]) | new[tied]
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[tied]] = group[tied]
        width *= 2


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the position before it in the suffix array (-1: none) and how long their common prefix is."""
    n, bits = len(t), 8 * t.itemsize
    per = 64 // bits
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    left = np.append(t[:1], t[:-1])
    i = np.arange(n, dtype=np.int32)
    known = (i == 0) | (before <= 0) | (left != left[before])
    known[1:] |= before[:-1] < 0
    at = np.flatnonzero(known & (before >= 0)).astype(np.int32)
    padded = np.concatenate([t, np.zeros(per, t.dtype)]).astype(np.uint64)
    word = padded[:n].copy()
    for j in range(1, per):
        word |= padded[j : n + j] << np.uint64(bits * j)
    del padded
    length = np.zeros(n, np.int32)
    a, b, own = at, before[at], at
    while len(own):
        diff = word[a] ^ word[b]
        same = diff == 0
        low = diff[~same]
        length[own[~same]] += (np.frexp((low & (~low + np.uint64(1))).astype(np.float64))[1] - 1) // bits
        a, b, own = a[same] + per, b[same] + per, own[same]
        length[own] += per
        more = np.maximum(a, b) < n
        a, b, own = a[more], b[more], own[more]
    length[at] = np.minimum(length[at], n - np.maximum(at, before[at]))
    last = np.maximum.accumulate(np.where(known, i, 0))
    return before, np.maximum(length[last] - (i - last), 0)


def repeats(t: np.ndarray, length: int) -> np.ndarray:
    """Which positions of a text of small symbols begin a string of `length` symbols, none of them 0, that begins elsewhere too.

    Zeros separate pieces; they take part in sorting, so a string must be judged by whether it fits its piece.
    """
    sa = sort_suffixes(t)
    before, prefix = common_prefixes(t, sa)
    hit = prefix >= length
    hit[before[hit]] = True
    return hit


def stretches(buf: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of rows of bytes (16 MB at most together): row, first window, number of windows, anchor hash, hash of the bytes."""
    n, wide = len(buf), length - gram + 1
    none = tuple(np.zeros(0, x) for x in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < length:
        return none
    ends = np.repeat(at[1:], np.diff(at))
    valid = np.arange(n) + length <= ends
    if not valid.any():
        return none
    with np.errstate(over="ignore"):
        x, size = BYTE[buf], 1
        factor = np.uint64(BASE)
        while size < gram:  # gram is a power of two
            x = x[:-size] * factor + x[size:]
            factor, size = factor * factor, size * 2
        m = (x & ~POSITION) | np.arange(len(x), dtype=np.uint64)
        size = 1
        while size * 2 <= wide:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < wide:
            m = np.minimum(m[: len(m) - (wide - size)], m[wide - size :])
        anchor = (m & POSITION).astype(np.int64)
        valid = valid[: len(anchor)]
        same = np.zeros(len(anchor), bool)
        same[1:] = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1])
        begin = np.flatnonzero(valid & ~same)
        sums = np.cumsum(valid)
        count = np.diff(np.append(sums[begin] - 1, sums[-1]))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(EDGE[buf] * powers(BASE, n), out=total[1:])
        stop = begin + count - 1 + length
        e = mix((total[stop] - total[begin]) * powers(INVERSE, n + 1)[begin] + count.astype(np.uint64))
        h = mix(x[anchor[begin]])
    row = np.searchsorted(at, begin, "right") - 1
    return row, begin - at[row], count, h, e


def _long_blocks(at: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """blocks() with rows beyond CHUNK in overlapping parts: rows i to j, bytes from a to b."""
    for i, j in blocks(at, CHUNK):
        a, b = int(at[i]), int(at[j])
        if b - a <= CHUNK:
            yield i, j, a, b
        else:
            for x in range(a, b - length + 1, CHUNK):
                yield i, j, x, min(b, x + CHUNK + length - 1)


def _find(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The stretches of (r1, r2, text): ref has the first window's place above 8 bits and the number of windows in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = text_bytes(batch.column(2))
            for i, j, a, b in _long_blocks(at, length):
                own = np.clip(at[i : j + 1], a, b)
                row, begin, count, h, e = stretches(buf[a:b], own - a, length, gram)
                begin = begin + (own[row] - at[i + row])
                of = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(begin << 8 | count), pa.array(h.view(np.int64)), pa.array(e.view(np.int64))], ["r1", "r2", "ref", "h", "e"])

    return rows.mapInArrow(run, "r1 long, r2 long, ref long, h long, e long")


def _anchors(buf: np.ndarray, begin: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The anchor of each window that begins at `begin`."""
    wide = length - gram + 1
    with np.errstate(over="ignore"):
        x, size, factor = BYTE[buf[begin[:, None] + np.arange(length)]], 1, np.uint64(BASE)
        while size < gram:
            x = x[:, :-size] * factor + x[:, size:]
            factor, size = factor * factor, size * 2
    return begin + (x[:, :wide] >> np.uint64(24)).argmin(1)


PIECES = "ka long, kb long, x1 int, x2 int, r1 long, r2 long, base long, piece binary"


def _batch(ka, kb, x1, x2, r1, r2, base, flat: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    at = np.concatenate([[0], np.cumsum(sizes)])
    piece = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ka.view(np.int64)), pa.array(kb.view(np.int64)), pa.array(x1.astype(np.int32)), pa.array(x2.astype(np.int32)), r1, r2, pa.array(base), piece], ["ka", "kb", "x1", "x2", "r1", "r2", "base", "piece"])


def _gather(buf: np.ndarray, one: np.ndarray, n_one: np.ndarray, two: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """For each i, n_one[i] bytes from one[i] and then n_two[i] bytes from two[i], one after another."""
    sizes = np.stack([n_one, n_two], 1).ravel()
    start = np.stack([one, two], 1).ravel()
    stop = np.cumsum(sizes)
    return buf[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - stop + sizes, sizes)]


def _slice(length: int, gram: int):
    """Cuts the asked stretches out of their texts: pieces of both halves of the places that the anchor can have."""
    wide = length - gram + 1
    w = wide + 1 >> 1
    core = length - w + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that are equal in everything give their pieces once
        for batch in batches:
            buf, at = text_bytes(batch.column(2))
            lists = batch.column(3)
            number = lists.value_lengths().to_numpy().copy()
            for r, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                number[r] *= k not in seen
                seen.add(k)
            row = np.repeat(np.arange(len(lists)), number)
            take = np.repeat(lists.offsets.to_numpy()[:-1] - np.cumsum(number) + number, number) + np.arange(len(row))
            refs = lists.values.to_numpy()[take]
            for lo in range(0, len(refs), 4_000):
                own, ref = row[lo : lo + 4_000], refs[lo : lo + 4_000] >> 1
                begin = at[own] + (ref >> 8)
                anchor = _anchors(buf, begin, length, gram)
                far, near = anchor - begin, anchor - begin - (ref & 0xFF) + 1
                single = (refs[lo : lo + 4_000] & 1).astype(bool)
                for base, x1, x2 in ((anchor, near, np.minimum(far, w - 1)), (anchor - (wide - w), np.maximum(near, w) - (wide - w), far - (wide - w))):
                    use = np.flatnonzero(x1 <= x2)
                    if not len(use):
                        continue
                    b, p, q = base[use], x1[use], x2[use]
                    inside = buf[b[:, None] + np.arange(core)]
                    with np.errstate(over="ignore"):
                        ka, kb = (mix((table[inside] * powers(BASE, core)).sum(1, dtype=np.uint64)) for table in (EDGE, BYTE))
                    of = pa.array(own[use], mask=~single[use])
                    yield _batch(ka, kb, p, q, batch.column(0).take(of), batch.column(1).take(of), b - at[own[use]], _gather(buf, b - q, q, b + core, w - 1 - p), q + w - 1 - p)

    return run, w


def _split(w: int):
    """Pieces of w places as pieces of half as many: what all windows of a half have in common goes into its key."""
    half = w + 1 >> 1
    cut = w - half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = text_bytes(batch.column(7))
            ka, kb = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1))
            x1, x2, base = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3, 6))
            mid = at[:-1] + x2  # where the right part of each piece begins
            with np.errstate(over="ignore"):
                sums = []
                for table in (EDGE, BYTE):
                    s = np.zeros(len(buf) + 1, np.uint64)
                    np.cumsum(table[buf] * powers(BASE, len(buf)), out=s[1:])
                    sums.append(s)
            for which, use in enumerate((x1 < half, x2 >= half)):
                i = np.flatnonzero(use)
                if not len(i):
                    continue
                more = mid[i] if which == 0 else mid[i] - cut
                with np.errstate(over="ignore"):
                    a, b = (mix(mix(k[i] * np.uint64(2 * which + 3)) + (s[more + cut] - s[more]) * powers(INVERSE, len(buf) + 1)[more]) for k, s in zip((ka, kb), sums, strict=True))
                if which == 0:
                    p, q, start = x1[i], np.minimum(x2[i], half - 1), base[i]
                    flat = _gather(buf, mid[i] - q, q, mid[i] + cut, half - 1 - p)
                else:
                    p, q, start = np.maximum(x1[i], half) - cut, x2[i] - cut, base[i] - cut
                    flat = _gather(buf, at[i], q, mid[i], half - 1 - p)
                of = pa.array(i)
                yield _batch(a, b, p, q, batch.column(4).take(of), batch.column(5).take(of), start, flat, q + half - 1 - p)

    return run, half


def _reduced(keys: np.ndarray, x1: np.ndarray, x2: np.ndarray, buf: np.ndarray, begin: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pieces as one text of small symbols: left part, their key's number in digits, right part, 0; where each begins; symbols a window has."""
    digits = max(1, (int(keys.max()).bit_length() + 3) // 4)
    n = len(keys)
    right = w - 1 - x1
    sizes = x2 + digits + right + 1
    start = np.cumsum(sizes) - sizes
    used = np.unique(buf)
    symbol = np.zeros(256, np.uint16)
    symbol[used] = np.arange(1, len(used) + 1)
    t = np.zeros(int(sizes.sum()), np.uint8 if len(used) + 16 < 256 else np.uint16)
    for d in range(digits):
        t[start + x2 + d] = len(used) + 1 + (keys >> 4 * (digits - 1 - d) & 15)
    for source, target, length in ((begin, start, x2), (begin + x2, start + x2 + digits, right)):
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        t[at + np.repeat(target, length)] = symbol[buf[at + np.repeat(source, length)]]
    return t, start, w - 1 + digits


def _shard(w: int, bound: int):
    """Ranges of windows that repeat among a shard's pieces, by suffix arrays of whole groups of at most `bound` bytes together."""

    def run(table: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        buf, at = text_bytes(table.column("piece"))
        ka, kb = (table.column(c).to_numpy() for c in ("ka", "kb"))
        order = np.lexsort((kb, ka))
        new = np.append(True, (ka[order][1:] != ka[order][:-1]) | (kb[order][1:] != kb[order][:-1]))
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        order, group = order[several], group[several]
        if len(order):
            weight = np.diff(at)[order] + OVERHEAD
            x1, x2, base = (table.column(c).to_numpy()[order].astype(np.int64) for c in ("x1", "x2", "base"))
            r1, r2 = (table.column(c).combine_chunks().take(pa.array(order)) for c in ("r1", "r2"))
            member = ~np.asarray(r1.is_null())
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            sums = np.concatenate([[0], np.cumsum(weight)])
            edge = np.append(first, len(order))
            i = 0
            while i < len(first):
                j = max(i + 1, int(np.searchsorted(sums[edge], sums[edge[i]] + bound, "right")) - 1)
                own = slice(edge[i], edge[j])
                if sums[edge[j]] - sums[edge[i]] > bound:
                    raise ValueError("a group of pieces is larger than the bound")
                t, start, length = _reduced(group[own] - group[own][0], x1[own], x2[own], buf, at[order[own]], w)
                piece, lo, hi = _runs(repeats(t, length), start, (x2 - x1 + 1)[own])
                keep = member[own][piece]
                piece, lo, hi = piece[keep] + edge[i], lo[keep], hi[keep]
                out[0].append(r1.take(pa.array(piece))), out[1].append(r2.take(pa.array(piece)))
                out[2].append((base - x2)[piece] + lo), out[3].append((base - x2)[piece] + hi)
                i = j
        if not out[0]:
            return pa.table({c: np.zeros(0, np.int64) for c in ("r1", "r2", "lo", "hi")})
        return pa.table({"r1": pa.concat_arrays(out[0]), "r2": pa.concat_arrays(out[1]), "lo": np.concatenate(out[2]), "hi": np.concatenate(out[3])})

    return run


def _runs(hit: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hits among the first windows[i] positions from start[i]: i, first, end."""
    piece = np.repeat(np.arange(len(start)), windows)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    h = hit[start[piece] + place]
    begin = h & ((place == 0) | ~np.append(False, h[:-1]))
    stop = h & np.append((place[1:] == 0) | ~h[1:], True)
    return piece[begin], place[begin], place[stop] + 1


CUT = "n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept binary"


def _cut(length: int):
    """Unites a row's ranges of windows and cuts their bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n = batch.num_columns - 2
            buf, at = text_bytes(batch.column(n))
            lists = batch.column(n + 1)
            kept, spans, removed = [], [], []
            for r in range(batch.num_rows):
                text = buf[at[r] : at[r + 1]]
                got = lists[r].values if lists[r].is_valid and len(lists[r]) else None
                if got is None:
                    kept.append(text.tobytes()), spans.append([]), removed.append(0)
                    continue
                lo, hi = got.to_numpy() >> 8, (got.to_numpy() >> 8) + (got.to_numpy() & 0xFF) + length - 1
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.append(True, lo[1:] > hi[:-1])
                a, b = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
                kept.append(b"".join(text[x:y].tobytes() for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)))
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                removed.append(int((b - a).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], [*batch.schema.names[:n], "n_bytes", "n_removed", "spans", "kept"])

    return run


def _repeated(pieces: DataFrame, most: int, w: int, bound: int, shard: int, scratch: Scratch) -> DataFrame:
    """Rows r1, r2, lo, hi: the windows from lo to before hi of a row that begin in another of the pieces, `most` at most."""
    key, found = ["ka", "kb"], None
    weight = F.length("piece") + OVERHEAD
    while True:
        pieces = scratch.table(pieces, f"pieces{w}", most)
        large = pieces.groupBy(*key).agg(F.count("*").alias("n"), F.sum(weight).alias("size")).where(F.col("size") > bound).select(*key, "n", F.lit(True).alias("large"))
        rows, size = pieces.agg(F.count("*"), F.sum(weight)).first()
        large = scratch.table(large, "large", int((size or 0) // bound))
        split = not large.isEmpty()
        marked = joined(pieces, large, key, ["r1", "r2", "base"], rows, "left") if split else pieces
        usual = marked.where("large IS NULL") if split else pieces
        shards = int((size or 0) // shard) + 1
        usual = usual.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards))).select("shard", *key, "x1", "x2", "r1", "r2", "base", "piece")
        hits = usual.groupBy("shard").applyInArrow(_shard(w, bound), "r1 long, r2 long, lo long, hi long")
        found = hits if found is None else found.unionByName(hits)
        if not split:
            return found
        # Equal pieces of a large group are one from here on; those that come more than once repeat as a whole.
        marked = scratch.table(marked.where("large").drop("large"), "crowd", rows)
        same = [*key, "x1", "x2", "piece"]
        kinds = scratch.table(marked.groupBy(*same).agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("r1", "r2", "base")]), "kinds", rows)
        twice = joined(marked, kinds.where("n > 1").select(*same, "n"), same, ["r1", "r2", "base"], marked.count())
        found = found.unionByName(twice.where("r1 IS NOT NULL").select("r1", "r2", (F.col("base") - F.col("x2")).alias("lo"), (F.col("base") - F.col("x1") + 1).alias("hi")))
        single = F.col("n") == 1
        kinds = kinds.select(*key, "x1", "x2", F.when(single, F.col("r1")).alias("r1"), F.when(single, F.col("r2")).alias("r2"), "base", "piece")
        run, w = _split(w)
        most, pieces = 2 * kinds.count(), kinds.mapInArrow(run, PIECES)


def dedup(docs: DataFrame, id_col="doc_id", text_col="text", carry: str | None = None, length: int = LENGTH, gram: int = GRAM, bound: int = BOUND, shard: int = SHARD, scratch: Scratch | None = None) -> DataFrame:
    """Rows doc_id, n_bytes, n_removed, spans (removed bytes, from start to before end), kept (bytes); and the column `carry`."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffix")
    more = [F.col(carry).alias("carried")] if carry else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    base = docs.select(own.alias("id"), F.xxhash64(own, text).alias("r1"), F.xxhash64(F.lit(1), own, text).alias("r2"), text.alias("text"), *more)
    found = scratch.table(_find(base.select("r1", "r2", "text"), length, gram), "stretches")
    n = found.count()
    shared = scratch.table(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors", n // 2)
    found = scratch.table(joined(found, shared, ["h"], ["r1", "r2", "ref"], n), "shared", n)
    n = found.count()
    kinds = scratch.table(found.groupBy("h", "e").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("r1", "r2", "ref")]), "kinds", n)
    n_kinds = kinds.count()
    several = scratch.table(kinds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "several", n_kinds // 2)
    asked = joined(kinds.withColumnRenamed("n", "times"), several, ["h"], ["e"], n_kinds)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = base.repartition(parts, "r1", "r2")  # both joins below read one exchange of it
    same = (F.col("r1") == F.col("of1")) & (F.col("r2") == F.col("of2"))
    wanted = asked.select(F.col("r1").alias("of1"), F.col("r2").alias("of2"), (F.shiftleft("ref", 1) + (F.col("times") == 1).cast("long")).alias("ref")).groupBy("of1", "of2").agg(F.collect_list("ref").alias("refs"))
    run, w = _slice(length, gram)
    pieces = texts.join(wanted, same).select("r1", "r2", "text", "refs").mapInArrow(run, PIECES)
    hits = _repeated(pieces, 2 * n_kinds, w, bound, shard, scratch)

    # A stretch that comes more than once repeats as a whole, wherever it is.
    whole = joined(found, kinds.where("n > 1").select("h", "e", "n"), ["h", "e"], ["r1", "r2", "ref"], n)
    hits = hits.select("r1", "r2", (F.shiftleft("lo", 8) + F.col("hi") - F.col("lo")).alias("range")).unionByName(whole.select("r1", "r2", F.col("ref").alias("range")))
    ranges = hits.groupBy(F.col("r1").alias("of1"), F.col("r2").alias("of2")).agg(F.collect_set("range").alias("ranges"))
    x = texts.join(ranges, same, "left").select(F.col("id").alias("doc_id"), *[c for c in ["carried"] if carry], "text", "ranges")
    fields = T.StructType([*x.drop("text", "ranges").schema, *T.StructType.fromDDL(CUT)])
    return x.mapInArrow(_cut(length), fields)
