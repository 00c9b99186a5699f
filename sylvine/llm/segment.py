"""SentencePiece encoding and decoding with Gumbel top-k: distinct segmentations sampled without replacement.

The lattice of a text has a node before each byte and an edge for each piece of a public vocabulary that matches there;
characters without a piece of their own are spelt in byte pieces. Piece i (in vocabulary order) weighs 1 / (rank + OFFSET)
by Zipf's law, as the vocabulary was built by merges and has no probabilities of its own; POWER flattens or sharpens.
A segmentation's log_prob is the sum of its pieces' log weights less that of all segmentations of the text.

Sampling is a perturbed search from the top: the root's value is a Gumbel variable; a node's best child inherits its value
and is drawn by its conditional probability, the other children get Gumbel variables truncated at it; a queue holds what
was passed by, and the next sample goes on from its best entry. The k samples are thus the k largest perturbed
log-probabilities, distinct, in order; log_inclusion is the log of the chance that the sample's perturbed value exceeds
the first one left out. All draws are hashes of (row key, sample, place), so reruns agree.

The lattice falls apart wherever two neighbouring bytes stand together in no piece. Each distinct part gets its edges and
backward sums once, for all its occurrences in a batch of bytes, and all parts of all texts are walked at once. Passed-by
children are drawn only while they can still be among the best k: a Gumbel variable of 53 bits is below 38.

A text over 1 MB is sampled a part of 1 MB at a time, to the same samples. Null and empty text: one sample with no pieces, log_prob 0. Texts with fewer than k segmentations give as many rows.
Repeated rows give equal samples. Null keys are keys of their own. An empty table gives an empty result. A literal U+2581
is a space, as the format has it. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylvine.llm.text import BASE, BYTE, INVERSE, blocks, mix, powers, text_bytes

OFFSET, POWER, SAMPLES, SEED = 10.0, 1.0, 2, 1
CHUNK = 1 << 20
SPACE = "▁"
LARGEST, KEPT, HEAD_ENOUGH = 38.0, 2_000_000, -1000.0


def _hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which window hashes follow."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[buf] * powers(BASE, len(buf)), out=sums[1:])
    return sums


def _heads(byte, size: int) -> np.ndarray:
    """16 bits of the first bytes of strings of a size, from rows of their first four bytes."""
    if size < 2:
        return byte[0].astype(np.uint16)
    two = byte[0].astype(np.uint16) | byte[1].astype(np.uint16) << 8
    return two if size < 4 else two * np.uint16(40503) ^ (byte[2].astype(np.uint16) | byte[3].astype(np.uint16) << 8)


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Vocabulary:
    """The pieces of a model file, and lattices over them."""

    def __init__(self, path: str, offset: float = OFFSET, power: float = POWER):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        plain, weights, self.of_byte, self.byte_weight = {}, {}, np.full(256, -1), np.zeros(256)
        logs = -power * np.log(np.arange(n) + offset)
        logs -= np.log(np.exp(logs).sum())
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.bytes[i], self.of_byte[b], self.byte_weight[b] = bytes([b]), i, logs[i]
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = piece.replace(SPACE, " ").encode()
                plain[self.bytes[i]] = i
                weights[i] = logs[i]
        self.together = np.zeros((256, 256), bool)
        by_size: dict[int, list[tuple[int, int]]] = {}
        for p, i in plain.items():
            x = np.frombuffer(p, np.uint8)
            self.together[x[:-1], x[1:]] = True
            with np.errstate(over="ignore"):
                h = int(mix(_hash(x)[-1:])[0])
            by_size.setdefault(len(x), []).append((h, i))
        self.tables = {}
        for size, rows in sorted(by_size.items()):
            rows.sort()
            ids = np.array([i for _, i in rows])
            heads = np.zeros(1 << 16, bool)  # tells most places where no piece of this size begins at once
            first = np.frombuffer(b"".join(self.bytes[i][:4].ljust(4, b"\0") for i in ids.tolist()), np.uint8).reshape(-1, 4)
            heads[_heads(first.T, size)] = True
            self.tables[size] = (np.array([h for h, _ in rows], np.uint64), ids, np.array([weights[i] for i in ids.tolist()]), heads)
        self.most = KEPT
        self.forget()
        flat = b"".join(self.bytes)
        self.flat = np.frombuffer(flat, np.uint8)
        self.size = np.array([len(x) for x in self.bytes])
        self.begin = np.cumsum(self.size) - self.size

    def forget(self) -> None:
        """Drops the kept lattice."""
        self.kept, self.known, self.places = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of pieces, one after another."""
        size = self.size[ids]
        stop = np.cumsum(size)
        return self.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.begin[ids] - stop + size, size)].tobytes()

    def parts(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the parts of all rows begin: at row starts and between bytes that no piece holds together."""
        cut = np.zeros(len(buf), bool)
        cut[1:] = ~self.together[buf[:-1], buf[1:]] & ((buf[1:] & 0xC0) != 0x80)
        cut[at[:-1][at[:-1] < len(buf)]] = True
        return np.flatnonzero(cut)

    def lattice(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[Lattice, np.ndarray]:
        """A lattice that has all the parts, and each part's place in it. Parts of earlier batches are kept up to `most` edges."""
        sums = _hash(buf)
        with np.errstate(over="ignore"):
            h = mix((sums[starts + sizes] - sums[starts]) * powers(INVERSE, len(buf) + 1)[starts] + sizes.astype(np.uint64))
        distinct, where, kind = np.unique(h, return_index=True, return_inverse=True)
        if self.kept is None or len(self.kept.to) > self.most:
            self.forget()
        slot = np.searchsorted(self.known, distinct)
        old = np.append(self.known, np.uint64(0))[slot] == distinct
        old &= slot < len(self.known)
        place = np.where(old, np.append(self.places, 0)[slot], -1)
        fresh = np.flatnonzero(~old)
        if len(fresh) or self.kept is None:
            size = sizes[where[fresh]]
            stop = np.cumsum(size)
            own = buf[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(starts[where[fresh]] - stop + size, size)]
            new = Lattice(self, own, size)
            n = len(self.kept.start) if self.kept else 0
            self.kept = self.kept.extended(new) if self.kept else new
            place[fresh] = np.arange(n, n + len(fresh))
            self.known, self.places = np.insert(self.known, slot[fresh], distinct[fresh]), np.insert(self.places, slot[fresh], place[fresh])
        return self.kept, place[kind]


class Lattice:
    """Edges of parts that lie one after another. Node p + i stands before byte p of part i, so each part has its end node."""

    def __init__(self, vocabulary: Vocabulary, buf: np.ndarray, sizes: np.ndarray):
        n = len(buf)
        part = np.repeat(np.arange(len(sizes)), sizes)
        end = np.cumsum(sizes)
        left = end[part] - np.arange(n)
        sums = _hash(buf)
        src, dst, ids, weights = [], [], [], []
        single = np.zeros(n, bool)  # whether a character has a piece of its own
        lead = (buf & 0xC0) != 0x80
        width = np.select([buf < 0x80, buf < 0xE0, buf < 0xF0], [1, 2, 3], 4)
        near = np.concatenate([buf, np.zeros(3, np.uint8)])
        near = [near[j : n + j] for j in range(4)]
        codes = {size: _heads(near, size) for size in (1, 2, 4)}
        with np.errstate(over="ignore"):
            for size, (hashes, own_ids, own_weights, heads) in vocabulary.tables.items():
                pos = np.flatnonzero(heads[codes[1 if size < 2 else 2 if size < 4 else 4]] & lead & (left >= size))
                if not len(pos):
                    continue
                h = mix((sums[pos + size] - sums[pos]) * powers(INVERSE, n + 1)[pos])
                slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[slot] == h
                pos, slot = pos[hit], slot[hit]
                src.append(pos.astype(np.int32)), dst.append((pos + size).astype(np.int32)), ids.append(own_ids[slot].astype(np.int32)), weights.append(own_weights[slot])
                single[pos[width[pos] == size]] = True
        del sums
        owner = np.maximum.accumulate(np.where(lead, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        spelt = np.flatnonzero(~single[owner] | (~lead & (owner == 0) & ~lead[0])).astype(np.int32) if n else owner
        # Sizes ascend, so a stable sort by source leaves each source's edges in order of their ends.
        src, dst, ids, weights = [spelt, *src], [spelt + 1, *dst], [vocabulary.of_byte[buf[spelt]].astype(np.int32), *ids], [vocabulary.byte_weight[buf[spelt]], *weights]
        src, dst, ids, weights = (np.concatenate(x) for x in (src, dst, ids, weights))
        order = np.argsort(src, kind="stable")
        src, dst, ids, weights = src[order], dst[order], ids[order], weights[order]
        del order
        shift = part[src].astype(np.int32) if len(src) else src
        step = (end[shift] - src).astype(np.int32) if len(src) else src
        self.start = np.cumsum(sizes) - sizes + np.arange(len(sizes))
        self.end = end + np.arange(len(sizes))
        self.to, self.id = dst + shift, ids
        nodes = n + len(sizes)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(src + shift, minlength=nodes))])
        # Backward sums, from the parts' ends on: nodes at the same distance from the end together.
        back = np.full(nodes, -np.inf)
        back[self.end] = 0
        by_step = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 65536 else step, kind="stable")
        bound = np.searchsorted(step[by_step], np.arange(int(step.max(initial=0)) + 2))
        total = np.zeros(len(src))
        node = src + shift
        for s in range(1, len(bound) - 1):
            e = by_step[bound[s] : bound[s + 1]]
            if not len(e):
                continue
            x = weights[e] + back[self.to[e]]
            total[e] = x
            own = np.append(True, node[e][1:] != node[e][:-1])
            seg = np.flatnonzero(own)
            most = np.maximum.reduceat(x, seg)
            floor = np.where(most == -np.inf, 0, most)
            with np.errstate(divide="ignore"):
                back[node[e][seg]] = floor + np.log(np.add.reduceat(np.exp(x - np.repeat(floor, np.diff(np.append(seg, len(x))))), seg))
        with np.errstate(invalid="ignore"):
            self.share = np.where(total == -np.inf, -np.inf, total - back[node])  # log of the conditional probability
        self.prob = np.exp(self.share)
        # The last edge of each node that leads to the end, so that rounding doesn't end a draw on one that doesn't.
        self.last = self.first[1:] - 1
        while len(self.share) and len(dead := np.flatnonzero((self.last > self.first[:-1]) & (self.share[np.maximum(self.last, 0)] == -np.inf))):
            self.last[dead] -= 1

    def extended(self, other: Lattice) -> Lattice:
        """This lattice with another's parts after its own; arrays grow in place, so this one must not be extended again."""
        out = object.__new__(Lattice)
        nodes, edges = len(self.last), len(self.to)
        out.room = getattr(self, "room", {})
        for name, shift in (("start", nodes), ("end", nodes), ("to", nodes), ("id", 0), ("share", 0), ("prob", 0), ("last", edges), ("first", edges)):
            own, new = getattr(self, name), getattr(other, name)
            n = len(own) - (name == "first")
            room = out.room.get(name)
            if room is None or len(room) < n + len(new):
                room = np.empty(2 * (n + len(new)), own.dtype)
                room[:n] = own[:n]
                out.room[name] = room
            room[n : n + len(new)] = new
            if shift:
                room[n : n + len(new)] += shift
            setattr(out, name, room[: n + len(new)])
        return out

    def walk(self, node: np.ndarray, stop: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node to its part's end by draws: all edges, walk after walk, and how many each walk has."""
        active = np.flatnonzero(node < stop)
        at, stop, key = node[active], stop[active], key[active]
        count = np.zeros(len(node), np.int64)
        who, what, when = [], [], 0
        while len(active):
            with np.errstate(over="ignore"):
                rest = _uniform(key + np.uint64(when) * np.uint64(0x9E3779B97F4A7C15))
            e, last = self.first[at], self.last[at]
            rest -= self.prob[e]
            go = np.flatnonzero((rest >= 0) & (e < last))
            while len(go):
                e[go] += 1
                rest[go] -= self.prob[e[go]]
                go = go[(rest[go] >= 0) & (e[go] < last[go])]
            who.append(active), what.append(e)
            when += 1
            at = self.to[e]
            on = at < stop
            if not on.all():
                count[active[~on]] = when
                active, at, stop, key = active[on], at[on], stop[on], key[on]
        out = np.zeros(int(count.sum()), np.int64)
        begin = np.cumsum(count) - count
        for t, (a, e) in enumerate(zip(who, what, strict=True)):
            out[begin[a] + t] = e
        return out, count


class Path:
    """A sampled segmentation of one text: edges, the part each belongs to, the node each leaves, and log-probability before each edge and at the end."""

    __slots__ = ("edges", "part", "nodes", "sums", "value")

    def __init__(self, edges: np.ndarray, part: np.ndarray, nodes: np.ndarray, share: np.ndarray, value: float):
        self.edges, self.part, self.nodes, self.value = edges, part, nodes, value
        self.sums = np.concatenate([[0.0], np.cumsum(share)])


def _passed_by(lattice: Lattice, paths: list[tuple[Path, int]], keys: np.ndarray, most: int, floor: float = -44.0) -> list[list]:
    """For each path and the place where its new part begins: the best `most` children that the new part passed by.

    Entries are (value, path, place, edge, log-probability). A path's far nodes, of log-probability below the floor, are
    left out at first, and taken in where the best found don't exceed all they could give.
    """
    number = [int(np.count_nonzero(p.sums[b:-1] >= floor)) for p, b in paths]  # the sums descend
    total = np.array(number)
    owner = np.repeat(np.arange(len(paths)), total)
    out: list[list] = [[] for _ in paths]
    if len(owner):
        take = [(p, slice(b, b + c)) for (p, b), c in zip(paths, number, strict=True)]
        node, edge, before = (np.concatenate([getattr(p, name)[c] for p, c in take]) for name in ("nodes", "edges", "sums"))
        place = np.arange(len(owner)) - np.repeat(np.cumsum(total) - total, total) + np.repeat([b for _, b in paths], total)
        first = lattice.first[node]
        size = lattice.first[node + 1] - first
        at = np.repeat(np.arange(len(node)), size)
        e = np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)
        other = (e != edge[at]) & (lattice.share[e] > -np.inf)
        at, e = at[other], e[other]
        with np.errstate(over="ignore"):
            u = _uniform(keys[owner[at]] + place[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + (e - first[at]).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        phi = before[at] + lattice.share[e]
        value = phi - np.logaddexp(phi - np.array([p.value for p, _ in paths])[owner[at]], np.log(-np.log(u)))
        row = owner[at]
        for _ in range(most):
            if not len(value):
                break
            seg = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            best = np.maximum.reduceat(value, seg)
            hit = np.flatnonzero(value == np.repeat(best, np.diff(np.append(seg, len(value)))))
            hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]
            for i, r in zip(hit.tolist(), row[hit].tolist(), strict=True):
                out[r].append((float(value[i]), paths[r][0], int(place[at[i]]), int(e[i]), float(phi[i])))
            value[hit] = -np.inf
            keep = value > -np.inf
            value, row, at, e, phi = value[keep], row[keep], at[keep], e[keep], phi[keep]
    if floor > -np.inf:
        short = [i for i, ((p, b), c) in enumerate(zip(paths, number, strict=True)) if b + c < len(p.edges) and (len(out[i]) < most or out[i][-1][0] < p.sums[b + c] + LARGEST)]
        if short:
            for i, got in zip(short, _passed_by(lattice, [paths[i] for i in short], keys[short], most, -np.inf), strict=True):
                out[i] = got
    return out


def _chance(log_prob: float, left: float) -> float:
    """The log of the chance that a perturbed value exceeds `left`, the best value that was left out."""
    gap = log_prob - left
    return 0.0 if left == -np.inf else float(np.log(-np.expm1(-np.exp(min(gap, 30.0))))) if gap > -30 else gap


def _part_seed(key: np.ndarray, s: int) -> np.ndarray:
    """The seed of sample s (from 0) for the parts that it walks whole."""
    with np.errstate(over="ignore"):
        return mix(key + np.uint64(s) * np.uint64(0x9FB21C651E98DF25)) if s else key


def sample_long(vocabulary: Vocabulary, buf: np.ndarray, key: np.ndarray, k: int) -> list[tuple[np.ndarray, float, float]]:
    """Samples of one long text, CHUNK bytes at a time.

    What samples branch at lies where a path's probability is still above e ** HEAD_ENOUGH, so the head decides, and behind
    it every part is walked on its own with the sample's seed. Where the head doesn't decide, the whole text is sampled at once.
    """
    cuts = [0]
    while cuts[-1] < len(buf):
        place, width = cuts[-1] + CHUNK, 65536
        while place < len(buf):
            near = buf[place - 1 : place + width]
            cut = np.flatnonzero(~vocabulary.together[near[:-1], near[1:]] & ((near[1:] & 0xC0) != 0x80))
            if len(cut):
                place += int(cut[0])
                break
            place += width
        cuts.append(min(place, len(buf)))
    head = 1
    while True:
        end = cuts[head]
        rows = _sampled(vocabulary, buf[:end], np.array([0, end]), key, k)[0]
        if end == len(buf):
            return [(ids, p, _chance(p, left)) for ids, p, left in rows]
        if len(rows) == k and all(p < HEAD_ENOUGH and left > HEAD_ENOUGH / 2 for _, p, left in rows):
            break
        head += 1
    seen = len(vocabulary.parts(buf[:end], np.array([0, end])))
    pieces, total = [[ids.astype("<u2")] for ids, _, _ in rows], [p for _, p, _ in rows]
    for a, b in zip(cuts[head:-1], cuts[head + 1 :], strict=True):
        starts = vocabulary.parts(buf[a:b], np.array([0, b - a]))
        lattice, kind = vocabulary.lattice(buf[a:b], starts, np.diff(np.append(starts, b - a)))
        with np.errstate(over="ignore"):
            place = np.arange(seen, seen + len(starts), dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
            for s in range(k):
                edges, _ = lattice.walk(lattice.start[kind], lattice.end[kind], mix(_part_seed(key, s) + place))
                pieces[s].append(lattice.id[edges].astype("<u2"))
                total[s] += float(lattice.share[edges].sum())
        seen += len(starts)
    return [(np.concatenate(ids), p, _chance(p, left)) for ids, p, (_, _, left) in zip(pieces, total, rows, strict=True)]


def sample(vocabulary: Vocabulary, buf: np.ndarray, at: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each row of bytes up to k samples (ids, log_prob, log_inclusion); keys are the rows' hashes."""
    return [[(ids, p, _chance(p, left)) for ids, p, left in rows] for rows in _sampled(vocabulary, buf, at, keys, k)]


def _sampled(vocabulary: Vocabulary, buf: np.ndarray, at: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """The samples (ids, log_prob, the best perturbed value left out)."""
    starts = vocabulary.parts(buf, at)
    sizes = np.diff(np.append(starts, len(buf)))
    lattice, kind = vocabulary.lattice(buf, starts, sizes)
    first = np.searchsorted(starts, at)
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(first))
    local = np.arange(len(starts)) - first[row_of] if len(starts) else starts
    begin_node, end_node = lattice.start[kind], lattice.end[kind]
    place = local.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    n = len(at) - 1
    edges, count = lattice.walk(begin_node, end_node, mix(keys[row_of] + place)) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    bound = np.concatenate([[0], np.cumsum(count)])
    part_of = np.repeat(np.arange(len(starts)), count)
    share = lattice.share[edges]
    root = -np.log(-np.log(_uniform(keys ^ np.uint64(0xABCDEF12345))))
    before = np.append(-1, part_of[:-1])
    nodes = np.where(part_of != before, begin_node[part_of], lattice.to[np.append(0, edges[:-1])]) if len(edges) else edges
    done: list[list[Path]] = []
    for r in range(n):
        cut = slice(bound[first[r]], bound[first[r + 1]])
        done.append([Path(edges[cut], part_of[cut], nodes[cut], share[cut], float(root[r]))])
    queues = _passed_by(lattice, [(x[0], 0) for x in done], keys ^ np.uint64(0x51), k)
    for s in range(1, k):
        going, node, stop, key, heads = [], [], [], [], []
        for r in range(n):
            if len(done[r]) == s and queues[r]:
                best = max(range(len(queues[r])), key=lambda i: queues[r][i][0])
                going.append((r, queues[r].pop(best)))
        if not going:
            break
        for r, (_, path, place_, edge, _) in going:
            part = int(path.part[place_])
            with np.errstate(over="ignore"):
                seed = _part_seed(keys[r : r + 1], s)[0]
                whole = np.arange(part + 1, first[r + 1])
                node.append(np.append(lattice.to[edge], begin_node[whole]))
                stop.append(np.append(end_node[part], end_node[whole]))
                key.append(mix(seed + np.append(local[part : part + 1].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D), place[whole])))
            heads.append(len(whole) + 1)
        new, number = lattice.walk(np.concatenate(node), np.concatenate(stop), np.concatenate(key))
        ends = np.cumsum(heads)
        edge_bound = np.concatenate([[0], np.cumsum(number)])
        children = []
        for (r, (value, path, place_, edge, _)), b, c in zip(going, (ends - heads).tolist(), ends.tolist(), strict=True):
            part = int(path.part[place_])
            own_edges = new[edge_bound[b] : edge_bound[c]]
            own_parts = np.repeat(np.append(part, np.arange(part + 1, first[r + 1])), number[b:c])
            e = np.concatenate([path.edges[:place_], [edge], own_edges])
            p = np.concatenate([path.part[:place_], [part], own_parts])
            fresh = np.where(own_parts != np.append(part, own_parts[:-1]), begin_node[own_parts], lattice.to[np.append(edge, own_edges[:-1])]) if len(own_edges) else own_edges
            child = Path(e, p, np.concatenate([path.nodes[: place_ + 1], fresh]), lattice.share[e], value)
            children.append((child, place_ + 1))
            done[r].append(child)
        rows = np.array([r for r, _ in going])
        with np.errstate(over="ignore"):
            found = _passed_by(lattice, children, mix(keys[rows] + np.uint64(s)), k - s)
        for r, got in zip(rows.tolist(), found, strict=True):
            queues[r] += got
    out = []
    for paths, queue in zip(done, queues, strict=True):
        left = max((q[0] for q in queue), default=-np.inf)
        out.append([(lattice.id[path.edges], float(path.sums[-1]), left) for path in paths])
    return out


_kept: dict[tuple, Vocabulary] = {}


def vocabulary_of(path: str, offset: float = OFFSET, power: float = POWER) -> Vocabulary:
    if (path, offset, power) not in _kept:
        _kept[path, offset, power] = Vocabulary(path, offset, power)
    return _kept[path, offset, power]


def _prefixed(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each text that isn't empty; U+2581 becomes a space."""
    size = np.diff(at)
    raw = buf
    if (mark := (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)).any():
        spot = np.flatnonzero(mark)
        spot = spot[np.searchsorted(at, spot, "right") == np.searchsorted(at, spot + 2, "right")]
        keep = np.ones(len(raw), bool)
        keep[spot + 1] = keep[spot + 2] = False
        raw = raw.copy()
        raw[spot] = 32
        gone = np.concatenate([[0], np.cumsum(~keep)])
        raw, at = raw[keep], at - gone[at]
        size = np.diff(at)
    add = (size > 0).astype(np.int64)
    stop = np.cumsum(size + add)
    out = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.cumsum(add), size)] = raw
    return out, np.concatenate([[0], stop])


def encode(docs: DataFrame, model: str, k: int = SAMPLES, id_col="doc_id", text_col="text", seed: int = SEED, offset: float = OFFSET, power: float = POWER, kept: int = KEPT) -> DataFrame:
    """Rows doc_id, sample (from 1), n_pieces, log_prob, log_inclusion, ids (little-endian u16): up to k for each row.

    kept: edges of earlier lattices that a worker holds, about 45 bytes each; more of them cost memory and save time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model, offset, power)
        vocabulary.most = kept
        try:
            for batch in batches:
                buf, at = text_bytes(batch.column(2))
                keys = batch.column(1).to_numpy().view(np.uint64)
                for i, j in blocks(at, CHUNK):
                    own = at[i : j + 1]
                    if j == i + 1 and own[1] - own[0] > CHUNK:
                        text = b" " + buf[own[0] : own[1]].tobytes().replace(SPACE.encode(), b" ")
                        got = [sample_long(vocabulary, np.frombuffer(text, np.uint8), keys[i:j], k)]
                        del text
                    else:
                        got = sample(vocabulary, *_prefixed(buf[own[0] : own[-1]], own - own[0]), keys[i:j], k)
                    row = np.repeat(np.arange(i, j), [len(x) for x in got])
                    flat = [y for x in got for y in x]
                    sizes = np.array([len(y[0]) for y in flat], np.int64)
                    data = np.concatenate([y[0] for y in flat]).astype("<u2", copy=False)
                    ids = pa.Array.from_buffers(pa.large_binary(), len(flat), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]) * 2), pa.py_buffer(data)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([s for x in got for s in range(1, len(x) + 1)], pa.int32()), pa.array(sizes), pa.array([y[1] for y in flat], pa.float64()), pa.array([y[2] for y in flat], pa.float64()), ids], ["doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", "ids"])
        finally:  # an idle worker is kept; its lattice needn't be
            vocabulary.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    x = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(run, f"doc_id {kind}, sample int, n_pieces long, log_prob double, log_inclusion double, ids binary")


def decode(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """All columns, and text: the bytes that the ids spell, as a string, without the space put before the text."""
    place = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(model)
        for batch in batches:
            raw, at = text_bytes(batch.column(place))
            for i, j in blocks(at, 1 << 19):
                own = at[i : j + 1]
                if j == i + 1 and own[1] - own[0] > 1 << 20:
                    ids = np.frombuffer(raw[own[0] : own[1]].tobytes(), "<u2")
                    data = b"".join(v.spell(ids[a : a + (1 << 18)]) for a in range(0, len(ids), 1 << 18))
                    data = data[1:] if data[:1] == b" " else data
                    text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)])), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, text.cast(pa.string())], [*batch.schema.names, "text"])
                    continue
                ids, cut = np.ascontiguousarray(raw[own[0] : own[-1]]).view("<u2").astype(np.int32), (own - own[0]) // 2
                size = v.size[ids]
                stop = np.cumsum(size)
                flat = v.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(v.begin[ids] - stop + size, size)]
                bound = np.concatenate([[0], stop])[cut]
                drop = bound[:-1][(np.diff(bound) > 0)]
                drop = drop[flat[drop] == 32]
                keep = np.ones(len(flat), bool)
                keep[drop] = False
                bound = bound - np.searchsorted(drop, bound)
                text = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(bound.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat[keep]))])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, text.cast(pa.string())], [*batch.schema.names, "text"])

    return df.mapInArrow(run, df.withColumn("text", F.lit("")).schema)
