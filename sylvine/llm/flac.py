"""Media columns: lossless FLAC coding of 8-bit mono samples and checked, vectorised decoding to PCM blocks.

encode() turns each payload into one FLAC stream of blocks of 192 samples (a block size the format names), a frame a
block: constant, verbatim, fixed predictors of order 0 and 1, or a quantised linear predictor of order 2, whichever
needs the fewest bits, residuals in Rice codes. Sample value = byte - 128.
decode() reads a stream's bytes back: it finds the frames by their sync code, CRC-8 and running number, undoes Rice
codes and predictors of all frames of a batch at once, checks each frame's CRC-16 and the stream's MD5, and gives the
PCM bytes, cut in blocks of known sample offsets. Streams with other features of the format (16-bit, several channels,
other orders, partitions, wasted bits) go through decode_stream(), one bit after another.

A text over 2 MB is coded and decoded some thousand blocks at a time, to the same stream. Null text is empty text; payloads are padded with spaces to a positive multiple of 192 bytes. A null or broken media
value gives pcm null and the reason in error; other rows go on. Repeated rows stay; equal texts give equal values. An
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylvine.llm.text import blocks, text_bytes

BLOCK, LPC_BITS, LPC_SHIFT, RATE = 192, 8, 6, 8000
HEAD = 42
CONSTANT, VERBATIM, FIXED0, FIXED1, LPC2 = range(5)
SUBFRAME = np.array([0x00, 0x02, 0x10, 0x12, 0x42], np.uint8)
ORDER = np.array([0, 0, 0, 1, 2])
CHUNK = 1 << 21


def _crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << bits) - 1)
    return t.astype(np.uint16 if bits == 16 else np.uint8)


CRC8 = _crc_table(0x07, 8)
CRC16 = _crc_table(0x8005, 16)
_two = np.arange(65536, dtype=np.uint32)
_step = CRC16[_two >> 8].astype(np.uint32)
CRC16_PAIR = ((_step << 8 & 0xFFFF) ^ CRC16[(_step >> 8) ^ (_two & 0xFF)]).astype(np.uint16)
del _two, _step
ZEROS16 = np.array([16] + [15 - int(i).bit_length() + 1 for i in range(1, 65536)], np.uint8)


def crc16(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many slices: right-aligned, as leading zeros don't change it."""
    width = int(size.max(initial=0)) + 1 & ~1
    cols = np.arange(width)[:, None] - (width - size)[None, :]
    m = np.where(cols >= 0, buf[np.maximum(begin[None, :] + cols, 0)], 0).astype(np.uint16)
    crc = np.zeros(len(begin), np.uint16)
    for i in range(0, width, 2):
        crc = CRC16_PAIR[crc ^ (m[i] << 8 | m[i + 1])]
    return crc


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8 like code: bytes (rows of 6) and lengths."""
    size = 1 + (n >= 1 << 7).astype(int) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)
    out = np.zeros((len(n), 6), np.uint8)
    for s in range(1, 7):
        own = size == s
        if own.any():
            v = n[own]
            lead = np.array([0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC][s - 1])
            out[own, 0] = lead | (v >> 6 * (s - 1))
            for j in range(1, s):
                out[own, j] = 0x80 | (v >> 6 * (s - 1 - j) & 0x3F)
    return out, size


def _rice(res: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag values, and each row's Rice parameter and bits."""
    zz = ((res << 1) ^ (res >> 15)).astype(np.uint16)
    total = zz.sum(1, dtype=np.int64)
    k = np.clip(np.floor(np.log2(np.maximum(total / res.shape[1] * 0.6931, 1))), 0, 14).astype(np.uint16)
    bits = res.shape[1] * (k.astype(np.int64) + 1) + (zz >> k[:, None]).sum(1, dtype=np.int64)
    return zz, k, bits


def _put(out: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Adds values of at most 17 bits at bit positions of a buffer of zeros, by way of 32-bit words."""
    word = value.astype(np.uint64) << (64 - width - (at & 31)).astype(np.uint64)
    slot, n = at >> 5, len(out) // 4 + 2
    low = word & np.uint64(0xFFFFFFFF)
    over = np.flatnonzero(low)
    sums = np.bincount(slot, word >> np.uint64(32), n).astype(np.uint32) + np.bincount(slot[over] + 1, low[over], n).astype(np.uint32)
    out += sums.astype(">u4").view(np.uint8)[: len(out)]


def encode_streams(payload: np.ndarray, sizes: np.ndarray, first_number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """FLAC streams of payloads that lie one after another; sizes are positive multiples of 192. Returns bytes and offsets."""
    x = payload.reshape(-1, BLOCK).astype(np.int16) - 128
    n = len(x)
    frames = sizes // BLOCK
    first = np.concatenate([[0], np.cumsum(frames)])
    number = first_number + np.arange(n) - np.repeat(first[:-1], frames)
    f = x.astype(np.float32)
    r0, r1, r2 = (f * f).sum(1), (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = r0 * r0 - r1 * r1
    det[det <= 0] = 1
    c1 = np.clip(np.rint((r1 * r0 - r1 * r2) / det * (1 << LPC_SHIFT)), -128, 127).astype(np.int16)
    c2 = np.clip(np.rint((r2 * r0 - r1 * r1) / det * (1 << LPC_SHIFT)), -128, 127).astype(np.int16)
    wide = x.astype(np.int32)
    guess = (c1[:, None] * wide[:, 1:-1] + c2[:, None] * wide[:, :-2]) >> LPC_SHIFT
    rice = {FIXED0: _rice(x), FIXED1: _rice(x[:, 1:] - x[:, :-1]), LPC2: _rice((wide[:, 2:] - guess).astype(np.int16))}
    cost = np.full((5, n), 1 << 40)
    cost[CONSTANT, (x == x[:, :1]).all(1)] = 8
    cost[VERBATIM] = 8 * BLOCK
    for kind, extra in ((FIXED0, 10), (FIXED1, 18), (LPC2, 16 + 35)):
        cost[kind] = rice[kind][2] + extra
    kind = cost.argmin(0)
    bits = cost[kind, np.arange(n)]

    num, num_size = _number(number)
    size = 4 + num_size + 1 + 1 + (bits + 7) // 8 + 2
    ends = np.cumsum(size)
    doc_of = np.repeat(np.arange(len(sizes)), frames)
    begin = ends - size + HEAD * (doc_of + 1)
    at = np.concatenate([[0], ends[first[1:] - 1]]) + HEAD * np.arange(len(sizes) + 1)
    out = np.zeros(int(at[-1]), np.uint8)
    head = np.zeros((n, 11), np.uint8)
    head[:, :4] = 0xFF, 0xF8, 0x10, 0x02
    head[:, 4:10] = num
    crc = np.zeros(n, np.uint8)
    for j in range(10):
        crc = np.where(j < 4 + num_size, CRC8[crc ^ head[:, j]], crc)
        out[(begin + j)[j < 4 + num_size]] = head[j < 4 + num_size, j]
    body = begin + 4 + num_size
    out[body] = crc
    out[body + 1] = SUBFRAME[kind]
    start = (body + 2) * 8

    plain = x.view(np.uint16) & 0xFF
    own = kind == CONSTANT
    out[body[own] + 2] = plain[own, 0]
    own = np.flatnonzero(kind == VERBATIM)
    out[(body[own] + 2)[:, None] + np.arange(BLOCK)] = plain[own]
    places, values, widths = [], [], []

    def put(at, value, width):
        at, value, width = np.broadcast_arrays(at, value, width)
        places.append(at.ravel()), values.append(value.ravel()), widths.append(width.ravel())

    for which in (FIXED0, FIXED1, LPC2):
        own = np.flatnonzero(kind == which)
        if not len(own):
            continue
        order, pos = int(ORDER[which]), start[own]
        for j in range(order):
            put(pos + 8 * j, plain[own, j], 8)
        pos = pos + 8 * order
        if which == LPC2:
            put(pos, np.full(len(own), (LPC_BITS - 1) << 5 | LPC_SHIFT), 9)
            put(pos + 9, c1[own] & 0xFF, 8)
            put(pos + 17, c2[own] & 0xFF, 8)
            pos = pos + 25
        zz, k, _ = rice[which]
        zz, k = zz[own], k[own]
        put(pos, k, 10)
        length = (zz >> k[:, None]).astype(np.int64) + 1 + k[:, None]
        stop = np.cumsum(length, 1) + (pos + 10)[:, None]
        width = k[:, None] + 1
        put(stop - width, (zz & ((1 << k) - 1)[:, None]) | (1 << k)[:, None], width)
    if places:
        _put(out, np.concatenate(places).astype(np.int64), np.concatenate(values), np.concatenate(widths).astype(np.int64))
    crc = crc16(out, begin, size - 2)
    out[begin + size - 2], out[begin + size - 1] = crc >> 8, crc & 0xFF

    signed = (payload ^ 0x80).tobytes()
    cut = np.concatenate([[0], np.cumsum(sizes)])
    smallest, largest = (np.minimum.reduceat(size, first[:-1]), np.maximum.reduceat(size, first[:-1])) if n else (size, size)
    for i, a in enumerate(at[:-1].tolist()):
        digest = hashlib.md5(signed[cut[i] : cut[i + 1]]).digest()
        out[a : a + HEAD] = np.frombuffer(_head(int(smallest[i]), int(largest[i]), int(sizes[i]), digest), np.uint8)
    return out, at


def _head(smallest: int, largest: int, total: int, digest: bytes) -> bytes:
    info = BLOCK.to_bytes(2, "big") * 2 + smallest.to_bytes(3, "big") + largest.to_bytes(3, "big")
    return b"fLaC\x80\x00\x00\x22" + info + (RATE << 44 | 7 << 36 | total).to_bytes(8, "big") + digest


def encode_long(text: np.ndarray) -> bytes:
    """The stream of one long text, padded, made of parts of whole blocks; equal to that of encode_streams."""
    total = max(1, -(-len(text) // BLOCK)) * BLOCK
    parts, digest, smallest, largest = [], hashlib.md5(), 1 << 24, 0
    step = CHUNK // BLOCK * BLOCK
    for a in range(0, total, step):
        part = text[a : min(a + step, total)]
        if a + step >= total:
            part = np.concatenate([part, np.full(total - a - len(part), 32, np.uint8)])
        out, _ = encode_streams(part, np.array([len(part)]), a // BLOCK)
        smallest, largest = min(smallest, int.from_bytes(out[12:15].tobytes(), "big")), max(largest, int.from_bytes(out[15:18].tobytes(), "big"))
        digest.update((part ^ 0x80).tobytes())
        parts.append(out[HEAD:].tobytes())
    return b"".join([_head(smallest, largest, total, digest.digest()), *parts])


class Bits:
    """Reads a byte string bit after bit."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def get(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        a, b = self.at >> 3, self.at + n + 7 >> 3
        v = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n) & ((1 << n) - 1)
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.get(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.get(1):
            n += 1
        return n


def _subframe(b: Bits, n: int, bps: int) -> list[int]:
    if b.get(1):
        raise ValueError("bad subframe")
    code = b.get(6)
    wasted = b.zeros() + 1 if b.get(1) else 0
    bps -= wasted
    if code == 0:
        s = [b.signed(bps)] * n
    elif code == 1:
        s = [b.signed(bps) for _ in range(n)]
    elif 8 <= code <= 12 or code >= 32:
        order = code - 8 if code < 32 else code - 31
        s = [b.signed(bps) for _ in range(order)]
        if code < 32:
            coef, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order], 0
        else:
            precision = b.get(4) + 1
            shift = b.signed(5)
            coef = [b.signed(precision) for _ in range(order)]
        wide = 4 + b.get(2)
        if wide > 5:
            raise ValueError("bad residual coding")
        parts = b.get(4)
        for p in range(1 << parts):
            k = b.get(wide)
            for _ in range((n >> parts) - (order if p == 0 else 0)):
                if k == (1 << wide) - 1:
                    raise NotImplementedError("escaped partition")
                v = b.zeros() << k
                v |= b.get(k)
                s.append((v >> 1 ^ -(v & 1)) + (sum(c * y for c, y in zip(coef, s[: -order - 1 : -1], strict=False)) >> shift if order else 0))
    else:
        raise ValueError("reserved subframe")
    return [v << wasted for v in s]


def decode_stream(data: bytes) -> tuple[np.ndarray, int, list[tuple[int, int, int]]]:
    """Any stream, sample by sample: samples (channels in columns), bits a sample, and (first sample, byte offset, samples) of each frame."""
    if data[:4] != b"fLaC":
        raise ValueError("not FLAC")
    at, info = 4, None
    while True:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 0x7F == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 0x80:
            break
    packed = int.from_bytes(info[10:18], "big")
    info_bps = (packed >> 36 & 31) + 1
    rows, seek, done = [], [], 0
    while at < len(data):
        b = Bits(data, at)
        if b.get(15) != 0x7FFC:
            raise ValueError("no sync code")
        b.get(1)
        size_code, rate_code, channels, bps_code = b.get(4), b.get(4), b.get(4), b.get(3)
        b.get(1)
        lead = b.get(8)
        for _ in range(max(0, 8 - (lead ^ 0xFF).bit_length() - 1) if lead >= 0x80 else 0):
            b.get(8)
        n = 192 if size_code == 1 else 144 << size_code if size_code <= 5 else b.get(8) + 1 if size_code == 6 else b.get(16) + 1 if size_code == 7 else 1 << size_code
        if rate_code in (12, 13, 14):
            b.get(8 if rate_code == 12 else 16)
        head_end = b.at >> 3
        crc = 0
        for byte in data[at:head_end]:
            crc = int(CRC8[crc ^ byte])
        if crc != b.get(8):
            raise ValueError("CRC-8")
        bps = {0: info_bps, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[bps_code]
        two = channels >= 8
        ch = [np.array(_subframe(b, n, bps + (two and j == (0 if channels == 9 else 1))), np.int64) for j in range(2 if two else channels + 1)]
        if channels == 8:
            ch[1] = ch[0] - ch[1]
        elif channels == 9:
            ch[0] = ch[0] + ch[1]
        elif channels == 10:
            mid = ch[0] << 1 | ch[1] & 1
            ch = [mid + ch[1] >> 1, mid - ch[1] >> 1]
        end = b.at + 7 >> 3
        crc = 0
        for byte in data[at:end]:
            crc = (crc << 8 & 0xFFFF) ^ int(CRC16[crc >> 8 ^ byte])
        if crc != int.from_bytes(data[end : end + 2], "big"):
            raise ValueError("CRC-16")
        seek.append((done, at, n))
        rows.append(np.stack(ch, 1))
        done, at = done + n, end + 2
    samples = np.concatenate(rows) if rows else np.zeros((0, 1), np.int64)
    raw = samples.astype("<i4").view(np.uint8).reshape(*samples.shape, 4)[:, :, : (info_bps + 7) // 8].tobytes()
    if info[18:34] != bytes(16) and hashlib.md5(raw).digest() != info[18:34]:
        raise ValueError("MD5")
    return samples, info_bps, seek


def _frame_starts(data: np.ndarray) -> np.ndarray | None:
    """Where the frames of one long stream begin, found part after part by sync code, number and CRC-8; None if they don't fit."""
    out, number = [], 0
    for a in range(HEAD, len(data), CHUNK):
        b = np.concatenate([data[a : a + CHUNK + 16], np.zeros(16, np.uint8)])
        sync = np.flatnonzero((b[:-16] == 0xFF) & (b[1:-15] == 0xF8) & (b[2:-14] == 0x10) & (b[3:-13] == 0x02))
        for p in sync[sync < min(CHUNK, len(data) - a)].tolist():
            want = _number(np.array([number]))
            size = int(want[1][0])
            head = b[p : p + 5 + size].tobytes()
            if head[4 : 4 + size] == want[0][0, :size].tobytes():
                crc = 0
                for byte in head[:-1]:
                    crc = int(CRC8[crc ^ byte])
                if crc == head[-1]:
                    out.append(a + p)
                    number += 1
    return np.array(out) if out and out[0] == HEAD else None


def decode_long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """PCM and frame offsets of one long stream of the profile, some frames at a time; None if a check fails."""
    starts = _frame_starts(data)
    if starts is None or data[:8].tobytes() != b"fLaC\x80\x00\x00\x22":
        return None
    total = int.from_bytes(data[21:26].tobytes(), "big") & (1 << 36) - 1
    if total != len(starts) * BLOCK:
        return None
    pcm, digest, step, edge = np.empty(total, np.uint8), hashlib.md5(), CHUNK // BLOCK, np.append(starts, len(data))
    for i in range(0, len(starts), step):
        j = min(i + step, len(starts))
        head = np.frombuffer(_head(0, 0, (j - i) * BLOCK, bytes(16)), np.uint8)
        part = np.concatenate([head, data[edge[i] : edge[j]]])
        got, _, _, good = decode_streams(part, np.array([0, len(part)]), i)
        if not good[0]:
            return None
        pcm[i * BLOCK : j * BLOCK] = got
        digest.update((got ^ 0x80).tobytes())
    return (pcm, starts) if digest.digest() == data[26:42].tobytes() else None


def decode_streams(buf: np.ndarray, at: np.ndarray, first_number: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Streams of encode_streams' profile at once: PCM bytes, their offsets, byte offsets of all frames, and whether each stream is sound.

    A stream that doesn't fit the profile, or fails a check, is marked unsound and has no PCM here. first_number: the streams
    are parts of longer ones, from that frame on, and have no MD5.
    """
    n = len(at) - 1
    size = np.diff(at)
    good = size >= HEAD
    for j, byte in enumerate(b"fLaC\x80\x00\x00\x22"):
        good[good] &= buf[at[:-1][good] + j] == byte
    b = np.concatenate([buf, np.zeros(16, np.uint8)])
    sync = np.flatnonzero((b[:-16] == 0xFF) & (b[1:-15] == 0xF8) & (b[2:-14] == 0x10) & (b[3:-13] == 0x02))
    doc = np.searchsorted(at, sync, "right") - 1
    keep = good[doc] & (sync >= at[doc] + HEAD)
    sync, doc = sync[keep], doc[keep]
    # Length of the coded number, its value and the CRC-8 tell true frames from chance matches.
    lead = b[sync + 4].astype(np.int64)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 1, 2, 3, 4], 5)
    value = np.where(more == 0, lead, lead & (0x3F >> more))
    crc = np.zeros(len(sync), np.uint8)
    for j in range(10):
        inside = j < 5 + more
        if j > 4:
            value = np.where(inside, value << 6 | (b[np.minimum(sync + j, len(b) - 1)] & 0x3F), value)
        crc = np.where(inside, CRC8[crc ^ b[np.minimum(sync + j, len(b) - 1)]], crc)
    keep = crc == b[np.minimum(sync + 5 + more, len(b) - 1)]
    sync, doc, value, more = sync[keep], doc[keep], value[keep], more[keep]
    first = np.searchsorted(doc, np.arange(n + 1))
    frames = np.diff(first)
    stop = np.append(sync[1:], at[-1])
    last = first[1:][frames > 0] - 1
    stop[last] = at[1:][frames > 0]
    sound = (value == (first_number or 0) + np.arange(len(sync)) - first[doc]) & (stop - sync < 4 * BLOCK)
    total = np.zeros(n, np.int64)
    for j in range(5):
        total[good] = total[good] << 8 | (b[at[:-1][good] + 21 + j] & (0x0F if j == 0 else 0xFF))
    good &= total == frames * BLOCK
    good[doc[~sound]] = False
    use = good[doc]
    sync, doc, more, stop = sync[use], doc[use], more[use], stop[use]
    frames = np.where(good, frames, 0)
    ok = crc16(b, sync, stop - sync - 2) == (b[stop - 2].astype(np.uint16) << 8 | b[stop - 1])

    words = b[:-8].astype(np.uint64)
    for j in range(1, 8):
        words = words << np.uint64(8) | b[j : len(b) - 8 + j]
    top = len(words) - 1
    body = sync + 6 + more
    code = b[body]
    kind = np.select([code == c for c in SUBFRAME], range(5), -1)
    ok &= kind >= 0
    x = np.zeros((len(sync), BLOCK), np.int16)
    own = np.flatnonzero(ok & (kind == CONSTANT))
    x[own] = b[body[own] + 1].view(np.int8)[:, None]
    ok[own] &= body[own] + 2 == stop[own] - 2
    own = np.flatnonzero(ok & (kind == VERBATIM) & (body + 1 + BLOCK == stop - 2))
    x[own] = b[(body[own] + 1)[:, None] + np.arange(BLOCK)].view(np.int8)
    ok &= (kind != VERBATIM) | (body + 1 + BLOCK == stop - 2)
    one, seven = np.uint64(1), np.uint64(7)

    def read(pos: np.ndarray, width: int) -> np.ndarray:
        w = words[np.minimum((pos >> np.uint64(3)).view(np.int64), top)]
        return (w << (pos & seven)) >> np.uint64(64 - width)

    for which in (FIXED0, FIXED1, LPC2):
        own = np.flatnonzero(ok & (kind == which))
        if not len(own):
            continue
        order = int(ORDER[which])
        pos = ((body[own] + 1) * 8).astype(np.uint64)
        y = np.zeros((BLOCK, len(own)), np.int32)
        for j in range(order):
            y[j] = read(pos, 8).astype(np.uint8).view(np.int8)
            pos = pos + np.uint64(8)
        fine = np.ones(len(own), bool)
        if which == LPC2:
            head = read(pos, 9)
            c1, c2 = (read(pos + np.uint64(j), 8).astype(np.uint8).view(np.int8).astype(np.int32) for j in (9, 17))
            fine &= head == (LPC_BITS - 1) << 5 | LPC_SHIFT
            pos = pos + np.uint64(25)
        k = read(pos, 10)
        fine &= k < 15
        k = np.minimum(k, np.uint64(14))
        pos = pos + np.uint64(10)
        right = np.uint64(63) - k
        step = k + one
        limit = (stop[own].astype(np.uint64) + one) * np.uint64(8)
        zz = np.zeros((BLOCK, len(own)), np.uint64)
        for j in range(order, BLOCK):
            w = words[np.minimum((pos >> np.uint64(3)).view(np.int64), top)] << (pos & seven)
            q = ZEROS16[(w >> np.uint64(48)).view(np.int64)].astype(np.uint64)
            if (long := q == 16).any():  # a run of 16 zeros or more: go on word by word
                idx = np.flatnonzero(long)
                while len(idx):
                    p = pos[idx] + q[idx]
                    w2 = words[np.minimum((p >> np.uint64(3)).view(np.int64), top)] << (p & seven)
                    z = ZEROS16[(w2 >> np.uint64(48)).view(np.int64)].astype(np.uint64)
                    q[idx] += z
                    idx = idx[(z == 16) & (pos[idx] + q[idx] < limit[idx])]
                far = np.flatnonzero(long)
                p = pos[far] + q[far]
                w[far] = words[np.minimum((p >> np.uint64(3)).view(np.int64), top)] << (p & seven)
                zz[j] = q << k | (w << np.where(long, one, q + one)) >> right >> one
            else:
                zz[j] = q << k | (w << (q + one)) >> right >> one
            pos = pos + q + step
        r = (zz >> one).astype(np.int32) ^ -(zz & one).astype(np.int32)
        fine &= (pos.astype(np.int64) + 7 >> 3) == stop[own] - 2
        if which == FIXED0:
            y = r
        elif which == FIXED1:
            y[1:] = r[1:]
            y = np.cumsum(y, 0, dtype=np.int32)
        else:
            for j in range(2, BLOCK):
                y[j] = r[j] + (c1 * y[j - 1] + c2 * y[j - 2] >> LPC_SHIFT)
        x[own] = y.T
        ok[own] &= fine
    good[doc[~ok]] = False
    pcm = (x.astype(np.uint8) ^ 0x80).reshape(-1)
    kept = good[doc]
    if not kept.all():
        pcm = pcm.reshape(-1, BLOCK)[kept].reshape(-1)
        sync, doc = sync[kept], doc[kept]
        frames = np.where(good, frames, 0)
    cut = np.concatenate([[0], np.cumsum(frames * BLOCK)])
    if first_number is not None:
        return pcm, cut, sync - at[doc], good
    signed = (pcm ^ 0x80).tobytes()
    raw = buf.tobytes()
    for i in np.flatnonzero(good).tolist():
        if hashlib.md5(signed[cut[i] : cut[i + 1]]).digest() != raw[at[i] + 26 : at[i] + 42]:
            good[i] = False
    return pcm, cut, sync - at[doc], good


def pad(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with spaces to positive multiples of 192 bytes: bytes and sizes."""
    size = np.diff(at)
    full = np.maximum((size + BLOCK - 1) // BLOCK, 1) * BLOCK
    begin = np.cumsum(full) - full
    out = np.full(int(full.sum()), 32, np.uint8)
    out[np.arange(len(buf)) + np.repeat(begin - at[:-1], size)] = buf
    return out, full


def _binary(buf: np.ndarray, at: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    parts = [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]
    if valid is not None and not valid.all():
        parts[0] = pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, parts).cast(pa.binary())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_bytes, media: the text's bytes, padded, as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = text_bytes(batch.column(1))
            for i, j in blocks(at, CHUNK):
                own = at[i : j + 1]
                if j == i + 1 and own[1] - own[0] > CHUNK:
                    out = np.frombuffer(encode_long(buf[own[0] : own[1]]), np.uint8)
                    cut = np.array([0, len(out)])
                else:
                    out, cut = encode_streams(*pad(buf[own[0] : own[-1]], own - own[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(own)), _binary(out, cut)], ["doc_id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def features(samples: np.ndarray) -> str:
    """Peak, mean, root mean square and zero crossings of the samples, fixed decimals."""
    peak = total = square = crossings = 0
    for a in range(0, len(samples), CHUNK):
        s = samples[max(a - 1, 0) : a + CHUNK].view(np.int8)
        crossings += int(((s[1:] < 0) != (s[:-1] < 0)).sum())
        s = s[min(a, 1) :].astype(np.int64)
        peak, total, square = max(peak, int(np.abs(s).max(initial=0))), total + int(s.sum()), square + int((s * s).sum())
    n = len(samples)
    return f"peak={peak};mean={total / n:.3f};rms={np.sqrt(square / n):.3f};zc={crossings}"


def decode(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The kept columns, media, and of its decoded stream: pcm (unsigned 8-bit), block_samples, frame_offsets (byte offset of each block; block i begins at sample i * block_samples), feature, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            buf, at = text_bytes(column)
            for i, j in blocks(at, CHUNK):
                own = at[i : j + 1]
                part = buf[own[0] : own[-1]]
                if j == i + 1 and len(part) > CHUNK and (long := decode_long(part)) is not None:
                    pcm, offsets = long
                    cut, good = np.array([0, len(pcm)]), np.ones(1, bool)
                else:
                    pcm, cut, offsets, good = decode_streams(part, own - own[0])
                seek = np.concatenate([[0], np.cumsum(np.diff(cut) // BLOCK)])
                errors, feats = [], []
                pieces, lists = None, None
                if not good.all():
                    pieces, lists = [], []
                for r in range(j - i):
                    data, error = pcm[cut[r] : cut[r + 1]], None
                    if not good[r]:
                        seeks = None
                        try:
                            samples, bps, seeks = decode_stream(part[own[r] - own[0] : own[r + 1] - own[0]].tobytes())
                            if bps != 8 or samples.shape[1] != 1:
                                raise ValueError("not 8-bit mono")
                            data = (samples[:, 0] + 128).astype(np.uint8)
                        except Exception as e:  # noqa: BLE001  a broken value mustn't end the others' work
                            error, data = f"{type(e).__name__}: {e}" if column[i + r].is_valid else "null", None
                    if pieces is not None:
                        pieces.append(None if data is None else data.tobytes())
                        lists.append([] if data is None else offsets[seek[r] : seek[r + 1]].tolist() if good[r] else [y for _, y, _ in seeks])
                    errors.append(error)
                    feats.append(None if data is None else features(data ^ 0x80))
                col = _binary(pcm, cut) if pieces is None else pa.array(pieces, pa.binary())
                lst = pa.ListArray.from_arrays(pa.array(seek, pa.int32()), pa.array(offsets, pa.int64())) if lists is None else pa.array(lists, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[i:j] for c in range(len(keep))], column[i:j], col, pa.array(np.full(j - i, BLOCK, np.int32)), lst, pa.array(feats, pa.string()), pa.array(errors, pa.string())], [*keep, "media", "pcm", "block_samples", "frame_offsets", "feature", "error"])

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(media_col).alias("media")).mapInArrow(run, f"{fields}, media binary, pcm binary, block_samples int, frame_offsets array<long>, feature string, error string")
