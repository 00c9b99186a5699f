"""MinHash near-duplicates: one-permutation hashing, optimal densification, bands, star-shaped candidate edges.

A document's words are the runs of bytes other than white space after A-Z are lower-cased; its set is that of its runs of
5 words (the whole sequence if it has fewer words). One hash of each shingle gives BINS bins, each with its least hash;
an empty bin copies the first full one among bins drawn by a hash of (bin, attempt), the same draws for all documents.
BANDS bands of ROWS bins are bucket keys: a pair of similarity 0.85 shares no bucket with a chance of 6e-11, one of 0.8
with 5e-8.

Documents of equal sets are one node (its least id) from the start, found by aggregation. In a bucket only star edges are
made: each node with one centre. Nodes that a star leaves in another component than the centre get a second star around
the node with most confirmed links. Buckets that then still hold several components are united to clusters, and blocks of
bounded size of a cluster are compared: pairs of different components whose signatures agree in BINS * (similarity - SLACK)
bins (a linked pair doesn't with a chance of 7e-12 at 0.85, 8e-11 at 0.8, less than that of sharing no bucket) have their
full sets intersected, and only a spanning forest of the links goes out, so no group gives more rows than it has members.
Every link is confirmed on the full sets of both texts.

A text over 4 MB is read in parts of 2 MB that end between words; its set, 8 bytes a distinct shingle, is held whole.
Null and empty texts, and those of white space only: empty set, linked with nothing. Null ids: no component, kept null.
Rows that repeat an id are one document of both texts' links. An empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylvine.llm.components import components
from sylvine.llm.joins import frequent, joined
from sylvine.llm.text import blocks, mix, shingles, stream, text_bytes, word_cuts, word_hashes, word_spans
from sylvine.scratch import Scratch

WORDS, BINS, BANDS, ROWS = 5, 128, 32, 4
CHUNK, BLOCK, BLOCK_BYTES = 2 << 20, 1024, 16 << 20
ATTEMPTS, SLACK = 1024, 0.24
DRAWS = (stream(31, BINS * ATTEMPTS).reshape(ATTEMPTS, BINS) >> np.uint64(57)).astype(np.int64)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, signature binary, bands array<long>"


def _long_set(buf: np.ndarray, words: int) -> np.ndarray:
    """The set of one long text, part after part; a part begins with the last words of the one before."""
    cuts, found, carried = word_cuts(buf, CHUNK), [], np.zeros(0, np.uint64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        starts, ends, _ = word_spans(buf[a:b], np.array([0, b - a]))
        h = np.concatenate([carried, word_hashes(buf[a:b], starts, ends)])
        if len(h) >= words or b == len(buf):
            found.append(np.unique(shingles(h, np.array([0, len(h)]), words)[0]) if len(h) >= words or len(found) == 0 else h[:0])
        carried = h[-(words - 1) :] if words > 1 else h[:0]
    s = np.concatenate(found)
    del found
    s.sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return s[new]


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Each row's sum, modulo 2**64."""
    if len(begin) == 2:
        return x.sum(keepdims=True, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return total[begin[1:]] - total[begin[:-1]]


def sets(buf: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, ascending, and where each row's begin (n + 1 entries)."""
    if len(at) == 2 and len(buf) > 2 * CHUNK:
        s = _long_set(buf, words)
        return s, np.array([0, len(s)])
    starts, ends, first = word_spans(buf, at)
    s, begin = shingles(word_hashes(buf, starts, ends), first, words)
    cut = begin.tolist()
    for i in range(len(cut) - 1):
        s[cut[i] : cut[i + 1]].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[begin[:-1][begin[:-1] < len(s)]] = True
    sums = np.concatenate([[0], np.cumsum(new)])
    return s[new], sums[begin]


def minima(s: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One-permutation hashes: rows of BINS least hashes, empty bins filled by optimal densification; EMPTY for empty sets."""
    n = len(begin) - 1
    raw = np.full(n * BINS, EMPTY)
    if n == 1:  # sets ascend, and a bin is the top bits
        edge = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
        full = edge < np.append(edge[1:], len(s))
        raw[full] = s[edge[full]]
    else:
        owner = np.repeat(np.arange(n), np.diff(begin))
        place = owner * BINS + (s >> np.uint64(57)).astype(np.int64)
        first = np.ones(len(s), bool)
        first[1:] = place[1:] != place[:-1]
        raw[place[first]] = s[first]
    raw = raw.reshape(n, BINS)
    out = raw.copy()
    row, col = np.nonzero((raw == EMPTY) & (np.diff(begin) > 0)[:, None])
    attempt = 0
    while len(row):
        draw = DRAWS[attempt][col] if attempt < ATTEMPTS else (col + attempt - ATTEMPTS + 1) % BINS
        got = raw[row, draw]
        full = got != EMPTY
        out[row[full], col[full]] = got[full]
        row, col, attempt = row[~full], col[~full], attempt + 1
    return out


def sign(docs: DataFrame, id_col="doc_id", text_col="text", words: int = WORDS) -> DataFrame:
    """Rows doc_id, n_shingles, h1 and h2 (128 bits of hash of the set), signature (a byte a bin), bands (bucket keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = text_bytes(batch.column(1))
            for i, j in blocks(at, CHUNK):
                own = at[i : j + 1]
                s, begin = sets(buf[own[0] : own[-1]], own - own[0], words)
                with np.errstate(over="ignore"):
                    h1, h2 = mix(_sums(s, begin)).view(np.int64), mix(_sums(mix(s ^ np.uint64(0xA5A5)), begin)).view(np.int64)
                    m = minima(s, begin)
                    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (j - i, BANDS)).copy()
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + m[:, r::ROWS])
                byte = np.ascontiguousarray((mix(m) & np.uint64(0xFF)).astype(np.uint8))
                sig = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.arange(j - i + 1, dtype=np.int32) * BINS), pa.py_buffer(byte)])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(begin)), pa.array(h1), pa.array(h2), sig, bands], ["doc_id", "n_shingles", "h1", "h2", "signature", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) of ids whose texts' full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in (0, 1))
            ids, where = np.unique(np.concatenate([a, b]), return_index=True)
            column = pa.concat_arrays([batch.column(2).cast(pa.large_string()), batch.column(3).cast(pa.large_string())]).take(pa.array(where))
            buf, at = text_bytes(column)
            every = []
            for i, j in blocks(at, CHUNK):
                s, begin = sets(buf[at[i] : at[j]], at[i : j + 1] - at[i], words)
                every += np.split(s, begin[1:-1])
            keep = np.zeros(len(a), bool)
            for r, (x, y) in enumerate(zip(np.searchsorted(ids, a).tolist(), np.searchsorted(ids, b).tolist(), strict=True)):
                x, y = every[x], every[y]
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if small and 100 * small >= percent * large:
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep[r] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    n = pairs.count()
    x = joined(pairs, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), ["a"], ["b"], n, hot=frequent(pairs, ["a"], n))
    x = joined(x, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), ["b"], ["a"], n, hot=frequent(pairs, ["b"], n))
    return x.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _pairs(x: DataFrame) -> DataFrame:
    return x.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _link(percent: int, words: int):
    """Of a block of a cluster, or two: confirmed links between components, a spanning forest of them.

    Pairs that agree in too few bins are passed over; the others' intersections are counted exactly on bit sets of the
    shingles that more than one document here has.
    """
    least = int(BINS * (percent / 100 - SLACK))

    def run(table: pa.Table) -> pa.Table:
        ids, comp, side = (table.column(c).to_numpy() for c in ("id", "comp", "block"))
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, BINS)
        one = side.min() == side.max()
        left = np.arange(len(ids)) if one else np.flatnonzero(side == side.min())
        right = left if one else np.flatnonzero(side == side.max())
        pairs = []
        for i in left.tolist():
            other = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (not one))]
            pairs.append(np.stack([np.full(len(other), i), other], 1)[(sig[other] == sig[i]).sum(1) >= least])
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        used = np.unique(pairs)
        if not len(used):
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        pairs = np.searchsorted(used, pairs)
        buf, at = text_bytes(table.column("text").combine_chunks().cast(pa.large_string()).take(pa.array(used)))
        parts = [sets(buf[at[i] : at[j]], at[i : j + 1] - at[i], words) for i, j in blocks(at, CHUNK)]
        size = np.concatenate([np.diff(begin) for _, begin in parts])
        _, column, count = np.unique(np.concatenate([s for s, _ in parts]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(used)), size)[count[column] > 1]
        column = (np.cumsum(count > 1) - 1)[column[count[column] > 1]]
        both = np.zeros(len(pairs), np.int64)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int(column.max(initial=-1)) + 1, 8192):
            cut = slice(*np.searchsorted(column, [lo, lo + 8192]))
            has = np.zeros((len(used), 8192), bool)
            has[row[cut], column[cut] - lo] = True
            bits = np.packbits(has, 1).view(np.uint64)
            for i in range(0, len(pairs), 16384):
                p = pairs[i : i + 16384]
                both[i : i + 16384] += np.bitwise_count(bits[p[:, 0]] & bits[p[:, 1]]).sum(1, dtype=np.int64)
        union = size[pairs[:, 0]] + size[pairs[:, 1]] - both
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for x, y in used[pairs[100 * both >= percent * union]].tolist():
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p != q:
                parent[p] = q
                links.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def group(docs: DataFrame, percent: int = 85, id_col="doc_id", text_col="text", words: int = WORDS, scratch: Scratch | None = None) -> DataFrame:
    """Rows doc_id, n_shingles, component_id, kept of all rows."""
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    signed = scratch.table(sign(docs, id_col, text_col, words), "signatures")
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = full.groupBy("h1", "h2").agg(F.min_by(F.struct("doc_id", "signature", "bands"), "doc_id").alias("n"))
    nodes = scratch.table(nodes.select("h1", "h2", F.col("n.doc_id").alias("id"), F.col("n.signature").alias("signature"), F.col("n.bands").alias("bands")), "nodes")
    every = nodes.select("id", F.explode("bands").alias("bucket"))
    crowded = every.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("centre")).where("n > 1")
    members = scratch.table(every.join(crowded, "bucket"), "members")
    n_members = members.count()
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = scratch.table(texts.join(wanted, "doc_id", "left_semi"), "texts")

    tried = scratch.table(_pairs(members), "pairs", n_members)
    n_tried = tried.count()
    links = scratch.table(confirm(tried, texts, percent, words), "links", 10 * n_tried)

    def labelled() -> tuple[DataFrame, DataFrame]:
        comp = scratch.table(components(links, scratch), "components", 2 * n_tried)
        m = members.select("bucket", "id").join(comp, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
        open_ = m.groupBy("bucket").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "n")
        return comp, m.join(open_, "bucket")

    comp, left = labelled()
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    left = scratch.table(left.join(degree, "id", "left"), "open", n_members)
    n_open = left.count()
    hub = left.groupBy("bucket").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("d"), F.xxhash64("id", F.lit(1)).alias("p"), "id", "comp")).alias("c")).select("bucket", F.col("c.id").alias("centre"), F.col("c.comp").alias("centre_comp"))
    more = _pairs(left.join(hub, "bucket").where("comp <> centre_comp")).join(tried, ["a", "b"], "left_anti")
    more = scratch.table(more, "pairs", n_open)
    links = scratch.table(links.union(confirm(more, texts, percent, words)), "links", 10 * (n_tried + n_open))

    # What is still open: buckets that hold several components, united to clusters, so that each text is compared once.
    comp, left = labelled()
    left = scratch.table(left.select("bucket", "id", "comp"), "open", n_open)
    star = left.join(left.groupBy("bucket").agg(F.min("id").alias("centre")), "bucket").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    cluster = components(star, scratch).select("id", F.col("component").alias("cluster"))
    left = left.select("id", "comp").distinct().join(cluster, "id").join(nodes.select("id", "signature"), "id").join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    left = scratch.table(left, "clusters")
    spread = left.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("text")) / BLOCK_BYTES)).cast("int").alias("spread"))
    left = left.join(spread, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("spread")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)))
    left = left.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with"))
    rest = left.select("cluster", "lo", "hi", "id", "comp", "block", "signature", "text").groupBy("cluster", "lo", "hi").applyInArrow(_link(percent, words), "a long, b long")
    links = scratch.table(links.union(rest), "links", 10 * (n_tried + 2 * n_open))

    comp = scratch.table(components(links, scratch), "components", n_tried + 2 * n_open)
    of_set = nodes.select("h1", "h2", "id").join(comp, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("of_set"))
    x = signed.select("doc_id", "n_shingles", "h1", "h2").join(of_set, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("of_set")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return x.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
