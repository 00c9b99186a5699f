"""Token-ID output: texts to ids, ids to Simple-8b segment files, and back.

Words. Each 64-bit word has a selector in its top 4 bits that says how many ids it holds and how wide each is (the table
COUNTS, WIDTHS); ids lie from the low bits up. Selector 0 is the escape: the next word is one id of up to 64 bits as it is.
Ids go in blocks of 128; a block's last word may hold fewer ids than its selector says. The index has each block's first
word, so blocks decode on their own, and all at once with a few array operations for each selector.

Segment (little-endian): magic, then as u64 the number of documents, ids, words and blocks; i64 document ids; u8 whether a
document's id is null; u32 tokens of each document; u32 first word of each block, its top bit set if the block has escapes;
u64 words. write() puts segments in ascending order of doc_id in a Parquet table, one a row, so Spark's committer makes the
files safe against lost executors; export() writes them as plain files. Counts of rows before a segment come from sums by
partition, then within a partition.

Null text is empty text, and a document without tokens still has its end id. Repeated rows each get their tokens, in the
order of the text. Null ids come first. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sylvine.llm.text import LOWER, blocks, text_bytes, word_cuts, word_hashes, word_spans
from sylvine.scratch import Scratch

# Fixed values of the format: ids a word and bits an id of selectors 0 to 15; selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 128
MAGIC = b"SLVN-S8B"
ESCAPED = np.uint32(1 << 31)
CHUNK, PART = 4 << 20, 1 << 20


def _bit_length(v: np.ndarray) -> np.ndarray:
    """Bits of each value; at most one more than needed beyond 2**53."""
    return np.frexp(v.astype(np.float64))[1]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ids (unsigned), and each block's first word with its escape bit; PART ids at a time."""
    parts, index, done = [], [], 0
    for a in range(0, max(len(ids), 1), PART):
        words, first = _pack(ids[a : a + PART])
        parts.append(words)
        index.append(first + np.uint32(done))
        done += len(words)
    return np.concatenate(parts), np.concatenate(index)


def _pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    nb = -(-n // BLOCK)
    v = np.zeros(nb * BLOCK + BLOCK, np.uint64)
    v[:n] = ids
    bits = _bit_length(v).astype(np.int8)
    total = nb * BLOCK
    # runs[w]: how many values from here on have at most w bits; the most values that fit is then a table lookup.
    best = np.zeros(total, np.int8)
    window = {1: bits}
    size = 1
    while size < 64:
        m = window[size]
        nxt = m.copy()
        nxt[:-size] = np.maximum(m[:-size], m[size:])
        size *= 2
        window[size] = nxt
    open_ = np.ones(total, bool)
    for sel in range(1, 16):
        c, w = int(COUNTS[sel]), int(WIDTHS[sel])
        p = 1 << c.bit_length() - 1
        m = window[p]
        most = np.maximum(m[:total], m[c - p : total + c - p])
        fits = open_ & (most <= w)
        best[fits] = sel
        open_ &= ~fits
    # best 0 is left where one value needs more than 60 bits.
    limit = np.minimum(BLOCK, n - np.arange(nb) * BLOCK)
    pos, row = np.zeros(nb, np.int64), np.arange(nb)
    begins = np.zeros(total, bool)
    while len(row):
        at = row * BLOCK + pos
        begins[at] = True
        pos = pos + COUNTS[best[at]]
        more = pos < limit[row]
        row, pos = row[more], pos[more]
    at = np.flatnonzero(begins)
    owner, sel = at // BLOCK, best[at]
    # A window must not reach over its block's end: values beyond it count as none.
    words = sel.astype(np.uint64) << np.uint64(60)
    stop = np.minimum((owner + 1) * BLOCK, n)
    for s in np.unique(sel).tolist():
        if s == 0 or WIDTHS[s] == 0:
            continue
        own = np.flatnonzero(sel == s)
        for j in range(int(COUNTS[s])):
            i = at[own] + j
            words[own] |= np.where(i < stop[own], v[i], np.uint64(0)) << np.uint64(j * int(WIDTHS[s]))
    first = np.searchsorted(owner, np.arange(nb))
    raw = np.flatnonzero(sel == 0)
    index = first.astype(np.uint32)
    if len(raw):
        words = np.insert(words, raw + 1, v[at[raw]])
        index = (first + np.searchsorted(raw, first)).astype(np.uint32)
        index[np.unique(owner[raw])] |= ESCAPED
    return words, index


def unpack(words: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """All n ids, PART at a time."""
    step = PART // BLOCK
    edge = np.append((index & ~ESCAPED).astype(np.int64), len(words))
    parts = []
    for i in range(0, len(index), step):
        p = _unpack(words[edge[i] : edge[min(i + step, len(index))]], index[i : i + step] - np.uint32(edge[i]), min(n - i * BLOCK, PART))
        parts.append(p.astype(np.uint32) if len(index) > step and p.max(initial=0) < 1 << 32 else p)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _unpack(words: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(index) * BLOCK, np.uint64)
    escaped = index & ESCAPED != 0
    first = (index & ~ESCAPED).astype(np.int64)
    stop = np.append(first[1:], len(words))
    owner = np.repeat(np.arange(len(index)), stop - first)
    plain = ~escaped[owner]
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(plain, COUNTS[sel], 0)
    ends = np.cumsum(count)
    at = ends - count
    start = at[np.minimum(first, max(len(at) - 1, 0))] if len(at) else at
    at = at - start[owner] + owner * BLOCK
    for s in np.unique(sel[plain]).tolist():
        own = np.flatnonzero(plain & (sel == s))
        width, top = int(WIDTHS[s]), (owner[own] + 1) * BLOCK
        if width == 0:
            continue
        for j in range(int(COUNTS[s])):
            i = at[own] + j
            inside = i < top
            out[i[inside]] = (words[own[inside]] >> np.uint64(j * width)) & np.uint64((1 << width) - 1)
    for b in np.flatnonzero(escaped).tolist():
        i, w = b * BLOCK, int(first[b])
        while w < stop[b]:
            s = int(words[w]) >> 60
            if s == 0:
                out[i] = words[w + 1]
                i, w = i + 1, w + 2
                continue
            for j in range(min(int(COUNTS[s]), (b + 1) * BLOCK - i)):
                out[i + j] = int(words[w]) >> j * int(WIDTHS[s]) & (1 << int(WIDTHS[s])) - 1
            i, w = i + int(COUNTS[s]), w + 1
    return out[:n]


def to_segment(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, index = pack(ids)
    head = MAGIC + struct.pack("<4Q", len(doc_ids), len(ids), len(words), len(index))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), counts.astype("<u4").tobytes(), index.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def from_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, whether they are null, tokens of each, and all ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment")
    docs, n, words, nb = struct.unpack_from("<4Q", data, 8)
    at, parts = 40, []
    for kind, k in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", nb), ("<u8", words)):
        parts.append(np.frombuffer(data, kind, k, at))
        at += parts[-1].nbytes
    if at != len(data):
        raise ValueError("a segment of the wrong length")
    return parts[0], parts[1].astype(bool), parts[2], unpack(parts[4].astype(np.uint64), parts[3], n)


class Words:
    """Token ids of texts by way of their words, each distinct word encoded once and kept.

    Right for tokenizers that never join bytes over ASCII white space and treat A-Z as a-z, such as the one this is for.
    Words also end between an ASCII letter and a punctuation mark other than ' and |, where the tokenizer's pattern
    always ends a piece; | and < occur in special tokens, and words with < are told apart by case.
    A word is known by 64 bits of hash and by its first and last four bytes.
    """

    SPLIT = np.zeros(256, bool)
    SPLIT[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True
    LETTER = np.zeros(256, bool)
    KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
    LETTER[65:91] = LETTER[97:123] = True

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.clear()

    def clear(self) -> None:
        self.keys, self.marks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.table = np.full(1 << (2 * self.most - 1).bit_length(), -1, np.int32)
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Each key's place among the kept words, or -1; the table is probed place after place."""
        mask = np.uint64(len(self.table) - 1)
        found = np.full(len(key), -1, np.int32)
        left, at = np.arange(len(key)), (key & mask).view(np.int64)
        while len(left):
            got = self.table[at]
            own = got >= 0
            left, at, got = left[own], at[own], got[own]
            hit = self.keys[got] == key[left]
            found[left[hit]] = got[hit]
            left, at = left[~hit], (at[~hit] + 1) & int(mask)
        return found

    def _add(self, key: np.ndarray) -> None:
        mask, n = np.uint64(len(self.table) - 1), len(self.keys)
        self.keys = np.concatenate([self.keys, key])
        own, at = np.arange(n, n + len(key), dtype=np.int32), (key & mask).view(np.int64)
        while len(own):
            free = self.table[at] < 0
            self.table[at[free]] = own[free]
            lost = self.table[at] != own
            own, at = own[lost], (at[lost] + 1) & int(mask)

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each row has."""
        starts, ends, first = word_spans(buf, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        cut = np.flatnonzero(self.LETTER[buf[:-1]] & self.SPLIT[buf[1:]]) + 1
        cut = np.setdiff1d(cut, at, assume_unique=False)  # rows may meet there
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        first = np.searchsorted(starts, at)
        key = word_hashes(buf, starts, ends)
        low = np.concatenate([LOWER[buf], np.zeros(4, np.uint8)]).astype(np.uint32)
        quad = low[:-3] | low[1:-2] << 8 | low[2:-1] << 16 | low[3:] << 24
        size = ends - starts
        head = quad[starts] & self.KEEP[np.minimum(size, 4)]
        mark = head.astype(np.uint64) | quad[np.maximum(ends - 4, starts)].astype(np.uint64) << np.uint64(32)
        mark = np.where(size < 4, head.astype(np.uint64), mark)
        if (angle := buf == ord("<")).any():
            sums = np.concatenate([[0], np.cumsum(angle)])
            own = np.flatnonzero(sums[ends] > sums[starts])
            key[own] = word_hashes(buf, starts[own], ends[own], lower=False) ^ np.uint64(0x5DEECE66D)
        slot = self._find(key)
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            _, one, back = np.unique(key[fresh], return_index=True, return_inverse=True)
            where = fresh[one]
            if len(self.keys) + len(where) > self.most and len(self.keys):
                self.clear()
                return self.encode(buf, at)
            raw = buf.tobytes()
            new = self._ids([raw[x:y] for x, y in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            size_new = np.array([len(x) for x in new], np.int64)
            slot[fresh] = len(self.keys) + back
            self._add(key[where])
            self.marks = np.concatenate([self.marks, mark[where]])
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size_new) - size_new])
            self.size = np.concatenate([self.size, size_new])
            self.ids = np.concatenate([self.ids, np.array([i for x in new for i in x], np.uint32)])
        begin, count = self.first[slot], self.size[slot]
        other = np.flatnonzero(self.marks[slot] != mark)
        source = self.ids
        if len(other):  # another word of the same hash
            raw = buf.tobytes()
            new = self._ids([raw[x:y] for x, y in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
            count[other] = [len(x) for x in new]
            begin[other] = len(source) + np.cumsum(count[other]) - count[other]
            source = np.concatenate([source, np.array([i for x in new for i in x], np.uint32)])
        stop = np.cumsum(count)
        ids = source[np.arange(int(stop[-1])) + np.repeat(begin - stop + count, count)]
        sums = np.concatenate([[0], stop])
        return ids, np.diff(sums[first])

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        texts = [w.decode("utf-8", "replace") for w in words]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Encodes all rows and writes their segments, in ascending order of the id, to a table at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, coder = TaskContext.get().partitionId(), 0, words_of(tokenizer)
        for batch in batches:
            buf, at = text_bytes(batch.column(1))
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = batch.column(0).fill_null(0).to_numpy()
            for i, j in blocks(at, CHUNK):
                own = at[i : j + 1]
                text = buf[own[0] : own[-1]]
                if j == i + 1 and len(text) > CHUNK:  # words are encoded one by one, so a text may be cut between them
                    cuts = word_cuts(text, CHUNK)
                    ids = np.concatenate([coder.encode(text[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                    count = np.array([len(ids)])
                else:
                    ids, count = coder.encode(text, own - own[0])
                ids = np.insert(ids, np.cumsum(count), end_id)
                data = to_segment(doc[i:j], nulls[i:j], count + 1, ids)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([j - i], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_ids", "segment"])
                seq += 1

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x = x.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    x.mapInArrow(run, "part int, seq long, n_docs long, n_ids long, segment binary").write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids (little-endian u32) from the segments at path."""
    x = spark.read.schema("part int, seq long, n_docs long, n_ids long, segment binary").parquet(path)
    before = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = x.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    parts = parts.select("part", F.coalesce(F.sum("all_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    places = sizes.select("part", "seq", before.alias("before")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("before")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc, nulls, count, ids = from_segment(data.as_buffer().to_pybytes())
                stop = np.cumsum(count, dtype=np.int64)
                flat = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.concatenate([[0], stop]) * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=nulls), pa.array(begin + stop - count), pa.array(count, pa.int64()), flat], ["doc_id", "start", "n_tokens", "ids"])

    return x.select("part", "seq", "segment").join(places, ["part", "seq"]).select("start", "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, scratch: Scratch | None = None, **options) -> DataFrame:
    """Writes the segments of all rows to the shared folder and reads them back."""
    scratch = scratch or Scratch(docs.sparkSession, "tokens")
    write(docs, f"{scratch.path}/segments", tokenizer, **options)
    return read(docs.sparkSession, f"{scratch.path}/segments")


def export(spark, path: str, folder: str) -> int:
    """Writes the segments as files NNNNN-NNNNNNNN.s8b to a local folder, a segment at a time; returns how many."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in spark.read.parquet(path).select("part", "seq", "segment").toLocalIterator():
        with open(f"{folder}/{row.part:05d}-{row.seq:08d}.s8b", "wb") as f:
            f.write(row.segment)
        n += 1
    return n
