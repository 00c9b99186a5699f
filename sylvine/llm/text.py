"""Vectorised handling of Arrow text columns: raw UTF-8 bytes, words, word hashes and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n words of a splitmix64 sequence."""
    with np.errstate(over="ignore"):
        return mix(U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


BYTE = stream(11, 256)
BYTE_LOWER = BYTE[LOWER]
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0..n-1, modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        size = max(n, 1 << 16)
        x = np.full(size, base, U64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def blocks(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes; a longer row comes alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def word_cuts(buf: np.ndarray, size: int) -> list[int]:
    """0, places about `size` bytes apart before a word that follows white space, and the end: a long text in parts.

    A text without white space isn't cut.
    """
    out = [0]
    while (p := out[-1] + size) < len(buf):
        while p < len(buf):
            black = ~WHITE[buf[p - 1 : p + 65536]]
            hit = np.flatnonzero(black[1:] & ~black[:-1])
            if len(hit):
                p += int(hit[0])
                break
            p += 65536
        if p >= len(buf):
            break
        out.append(p)
    return [*out, len(buf)]


def word_spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't white space, and each row's first word (n + 1 entries)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    black = ~WHITE[buf]
    edge = at[(at > 0) & (at < len(buf))]
    before = np.empty_like(black)
    before[0], before[1:] = False, black[:-1]
    before[edge] = False
    starts = np.flatnonzero(black & ~before)
    after = np.empty_like(black)
    after[-1], after[:-1] = False, black[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(black & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, after A-Z are lower-cased if asked."""
    n = len(buf)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum((BYTE_LOWER if lower else BYTE)[buf] * powers(BASE, n), out=sums[1:])
        h = (sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xD1B54A32D192ED03))


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words and each row's first shingle (n + 1 entries).

    A row with fewer words, but at least one, has its whole sequence as its one shingle.
    """
    words = np.diff(first)
    count = np.where(words == 0, 0, np.maximum(words - k + 1, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    total = int(begin[-1])
    if not total:
        return np.zeros(0, U64), begin
    pos = np.arange(total) + np.repeat(first[:-1] - begin[:-1], count)
    left = np.repeat(words, count)
    out = np.zeros(total, U64)
    padded = np.concatenate([h, np.zeros(k, U64)])
    with np.errstate(over="ignore"):
        for j in range(k):
            part = padded[pos + j]
            out = out * U64(0xD6E8FEB86659FD93) + (part if left.min(initial=k) >= k else np.where(j < left, part, U64(0)))
        out = mix(out + np.minimum(left, k).astype(U64))
    return out, begin
