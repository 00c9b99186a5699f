"""The random-projection forest: seeds, node vectors, routing and probing, as numpy kernels over whole batches.

A tree is a perfect binary tree in heap order; node n has children 2n + 1 and 2n + 2. A vector goes right where its
product with the node's second vector exceeds that with the first by more than the node's threshold. Both vectors touch
only `sub_dim` coordinates, so a node is one sparse row w = v1 - v0 (coordinates drawn twice add up), and routing a batch
through a level is a gather and a row product. All arithmetic is in double precision; seeds are unsigned 64-bit.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

U = np.uint64
# The seed arithmetic must equal the published one for equal trees.
TREE_MUL, TREE_ADD = 99991, 7
HASH_MUL, NODE_MUL = 2654435761, 40503
SUB_SALT = 0x9E3779B97F4A7C15
GROUP_MUL, GROUP_ADD = 0x100000001B3, 0x9E3779B1
PERM_SALT, PERM_MUL, PERM_ADD, PERM_SHIFT = 0xDEADBEEFCAFEBABE, 6364136223846793005, 1442695040888963407, 32
SUB_FOLD, SUB_SHIFT, SUB_STEP, SUB_FIRST, NODE_STEP = 29, 33, 7, 3, 3
SHIFTS = (13, 7, 17)
MASK = (1 << 64) - 1
SHALLOW = 5


def tree_seed(tree: int) -> int:
    return (tree * TREE_MUL + TREE_ADD) & MASK


def node_seeds(seed: int, index: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = U(seed * HASH_MUL & MASK) ^ (index.astype(U) * U(NODE_MUL))
    return np.where(h == 0, U(1), h)


def _xorshift(state: np.ndarray) -> np.ndarray:
    state = state ^ state << U(SHIFTS[0])
    state = state ^ state >> U(SHIFTS[1])
    return state ^ state << U(SHIFTS[2])


def node_vectors(seeds: np.ndarray, dim: int, version: int = 3) -> np.ndarray:
    """One unit vector a seed. Version 0 sums four draws a coordinate, version 3 takes two coordinates from one draw."""
    state, columns = np.where(seeds == 0, U(1), seeds), []
    low = U(0xFFFFFF)
    unit = lambda x: (x & low).astype(np.float64) / float(0xFFFFFF) - 0.5
    if version == 3:
        while len(columns) < dim:
            state = _xorshift(state)
            columns += [unit(state), unit(state >> U(24))]
    else:
        for _ in range(dim):
            total = np.zeros(len(seeds))
            for _ in range(4):
                state = _xorshift(state)
                total += unit(state)
            columns.append(total)
    x = np.stack(columns[:dim], 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True) + 1e-10)


def _draws(start: np.ndarray, salts: np.ndarray, full: int) -> np.ndarray:
    """Coordinates of a linear congruential chain, one chain a row."""
    h, out = start, []
    with np.errstate(over="ignore"):
        for salt in salts.tolist():
            h = h * U(HASH_MUL) + U(salt * NODE_MUL & MASK)
            out.append((h % U(full)).astype(np.int64))
    return np.stack(out, 1)


def normalise(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True) + 1e-10)


@dataclass(frozen=True)
class Forest:
    """Parameters of a forest; everything else follows from them. medians: a threshold for each (tree, node) of the top levels."""

    n_trees: int = 16
    depth: int = 6
    dim: int = 64
    sub_dim: int = 16
    version: int = 3
    tree_sub: int = 0
    tree_sub_groups: int = 0
    node_perm: bool = False
    medians: np.ndarray | None = field(default=None, compare=False)

    def __post_init__(self):
        if not 0 < self.depth <= 28:
            raise ValueError("depth must be from 1 to 28")

    def _subspace(self, tree: int) -> np.ndarray | None:
        if not 0 < self.tree_sub < self.dim:
            return None
        seed = tree_seed(tree)
        if self.tree_sub_groups > 0:
            h = (seed ^ seed >> SUB_FOLD) * SUB_SALT & MASK
            seed = ((h >> SUB_SHIFT) % self.tree_sub_groups * GROUP_MUL + GROUP_ADD) & MASK
        start = np.array([seed * HASH_MUL & MASK ^ SUB_SALT], U)
        return _draws(start, np.arange(self.tree_sub) * SUB_STEP + SUB_FIRST, self.dim)[0]

    def _permutation(self, tree: int, full: int) -> np.ndarray:
        order, state = list(range(full)), (tree_seed(tree) | 1) ^ PERM_SALT
        for i in range(full - 1, 0, -1):
            state = (state * PERM_MUL + PERM_ADD) & MASK
            j = (state >> PERM_SHIFT) % (i + 1)
            order[i], order[j] = order[j], order[i]
        return np.array(order)

    def planes(self, tree: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct nodes of a tree: the coordinates they touch (of the whole vector) and the weights."""
        seed, inner = tree_seed(tree), self._subspace(tree)
        full = self.dim if inner is None else self.tree_sub
        if full <= self.sub_dim:
            dims = np.tile(np.arange(self.sub_dim) % full, (len(nodes), 1))
        elif self.node_perm:
            order, cycle = self._permutation(tree, full), max(1, full // self.sub_dim)
            level = np.floor(np.log2(nodes + 1)).astype(np.int64)
            dims = order[(level % cycle * self.sub_dim)[:, None] + np.arange(self.sub_dim)]
        else:
            with np.errstate(over="ignore"):
                start = U(seed * HASH_MUL & MASK) ^ (nodes.astype(U) * U(NODE_STEP) * U(NODE_MUL))
            dims = _draws(start, np.arange(self.sub_dim), full)
        weights = node_vectors(node_seeds(seed, 2 * nodes + 1), self.sub_dim, self.version) - node_vectors(node_seeds(seed, 2 * nodes), self.sub_dim, self.version)
        return (dims if inner is None else inner[dims]), weights

    def thresholds(self, tree: int, nodes: np.ndarray) -> np.ndarray:
        if self.medians is None:
            return np.zeros(len(nodes))
        inside = nodes < self.medians.shape[1]
        return np.where(inside, self.medians[tree, np.minimum(nodes, self.medians.shape[1] - 1)], 0.0)

    def differences(self, x: np.ndarray, tree: int, nodes: np.ndarray) -> np.ndarray:
        """How much further right each vector lies at its node, before the threshold."""
        distinct, back = np.unique(nodes, return_inverse=True)
        dims, weights = self.planes(tree, distinct)
        return (np.take_along_axis(x, dims[back], 1) * weights[back]).sum(1)

    def descend(self, x: np.ndarray, tree: int, nodes: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """From each vector's node down: the node reached, and the signed margin at each level."""
        margins = np.zeros((len(x), levels))
        for level in range(levels):
            margins[:, level] = self.differences(x, tree, nodes) - self.thresholds(tree, nodes)
            nodes = 2 * nodes + 1 + (margins[:, level] > 0)
        return nodes, margins

    def _margins(self, x: np.ndarray, tree: int, depth: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """The margins of rows of x at nodes. Of a shallow tree those at all nodes are made at once, by the same sums."""
        if depth > SHALLOW:
            return lambda rows, nodes: self.differences(x[rows], tree, nodes) - self.thresholds(tree, nodes)
        every = np.arange((1 << depth) - 1)
        dims, weights = self.planes(tree, every)
        found = [(np.take(x[i : i + 1024], dims.ravel(), 1) * weights.ravel()).reshape(-1, *dims.shape).sum(2) for i in range(0, max(1, len(x)), 1024)]
        found = np.concatenate(found) - self.thresholds(tree, every)
        return lambda rows, nodes: found[rows, nodes]

    def _sides(self, x: np.ndarray, tree: int, depth: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Values of the sign of the margins of rows of x at nodes: one matrix product, and the margin itself where that may err."""
        every = np.arange((1 << depth) - 1)
        dims, weights = self.planes(tree, every)
        dense = np.zeros((x.shape[1], len(every)))
        np.add.at(dense, (dims, every[:, None]), weights)
        with np.errstate(all="ignore"):
            found, least = x @ dense - self.thresholds(tree, every), 1e-14 * (x.shape[1] + 64)

        def at(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            out = found[rows, nodes]
            open_ = np.flatnonzero(~(np.abs(out) > least))
            if len(open_):
                out[open_] = self.differences(x[rows[open_]], tree, nodes[open_]) - self.thresholds(tree, nodes[open_])
            return out

        return at

    def _down(self, margins: Callable, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        rows, nodes, out = np.arange(n), np.zeros(n, np.int64), np.zeros((n, depth))
        for level in range(depth):
            out[:, level] = margins(rows, nodes)
            nodes = 2 * nodes + 1 + (out[:, level] > 0)
        return nodes, out

    def route(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Leaves (from 0) of normalised vectors in every tree."""
        depth = depth or self.depth
        x = normalise(np.asarray(x, np.float64))
        sides = self._sides if depth <= SHALLOW else self._margins
        return np.stack([self._down(sides(x, t, depth), len(x), depth)[0] for t in range(self.n_trees)], 1) - ((1 << depth) - 1)

    def deepen(self, x: np.ndarray, leaves: np.ndarray, extra: int) -> np.ndarray:
        """Leaves `extra` levels further down from leaves of this depth; equal to routing afresh."""
        x = normalise(np.asarray(x, np.float64))
        base = (1 << self.depth) - 1
        return np.stack([self.descend(x, t, leaves[:, t] + base, extra)[0] for t in range(self.n_trees)], 1) - ((1 << self.depth + extra) - 1)

    def probe(self, x: np.ndarray, tree: int, n_probes: int, min_flip: int = 0, multi: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector the main leaf and up to n_probes more, with the least margin on the path to each: rows, leaves, scores.

        Single flips turn one of the levels from min_flip on, smallest margin first, shallower on ties. Multiple flips
        turn sets of levels in order of the sum of their margins. All paths of all vectors descend together.
        """
        x = normalise(np.asarray(x, np.float64))
        at = self._margins(x, tree, self.depth)
        margins = np.abs(self._down(at, len(x), self.depth)[1])
        if multi:
            flips = [_flips(m, n_probes, min_flip) for m in margins]
            rows = np.repeat(np.arange(len(x)), [len(f) for f in flips])
            turned = np.zeros((len(rows), self.depth), bool)
            for i, levels in enumerate(f for each in flips for f in each):
                turned[i, list(levels)] = True
        else:
            order = min_flip + np.argsort(margins[:, min_flip:], 1, kind="stable")[:, :n_probes]
            rows = np.repeat(np.arange(len(x)), order.shape[1] + 1)
            turned = np.zeros((len(x), order.shape[1] + 1, self.depth), bool)
            np.put_along_axis(turned[:, 1:], order[:, :, None], True, 2)
            turned = turned.reshape(len(rows), self.depth)
        node, score = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
        for level in range(self.depth if len(rows) else 0):
            margin = at(rows, node)
            score = np.minimum(score, np.abs(margin))
            node = 2 * node + 1 + ((margin > 0) != turned[:, level])
        return rows, node - ((1 << self.depth) - 1), score


def _flips(margins: np.ndarray, n_probes: int, min_flip: int) -> list[tuple[int, ...]]:
    """The sets of levels to turn, the empty one first, then by the sum of their margins."""
    levels = sorted(range(min_flip, len(margins)), key=lambda i: (margins[i], i))
    out: list[tuple[int, ...]] = [()]
    queue = [(float(margins[levels[0]]), (0,))] if levels else []
    while queue and len(out) <= n_probes:
        cost, places = heapq.heappop(queue)
        out.append(tuple(levels[i] for i in places))
        last = places[-1]
        if last + 1 < len(levels):
            step = float(margins[levels[last + 1]])
            heapq.heappush(queue, (cost + step, (*places, last + 1)))
            heapq.heappush(queue, (cost + step - float(margins[levels[last]]), (*places[:-1], last + 1)))
    return out


def calibrate(forest: Forest, sample: np.ndarray, med_depth: int, least: int = 8) -> np.ndarray:
    """Thresholds of the top levels: the median difference of the sample's vectors at each node, 0 under `least` vectors."""
    x = normalise(np.asarray(sample, np.float64))
    table = np.zeros((forest.n_trees, (1 << med_depth) - 1))
    for t in range(forest.n_trees):
        nodes = np.zeros(len(x), np.int64)
        for _ in range(med_depth):
            diff = forest.differences(x, t, nodes)
            order = np.lexsort((diff, nodes))
            for n, values in zip(*_groups(nodes[order], diff[order]), strict=True):
                if len(values) >= least:
                    table[t, n] = np.median(values)
            nodes = 2 * nodes + 1 + (diff > table[t, nodes])
    return table


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[start], np.split(values, start[1:])


def sparse_projection(dim_in: int, dim_out: int, seed: int) -> np.ndarray:
    """A matrix of 0 with chance 2/3 and plus or minus sqrt(3 / dim_out) with 1/6 each."""
    rng = np.random.default_rng(seed)
    return rng.choice(np.array([-1.0, 0.0, 1.0]), (dim_in, dim_out), p=[1 / 6, 2 / 3, 1 / 6]) * np.sqrt(3.0 / dim_out)
