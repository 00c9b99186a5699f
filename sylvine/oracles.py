"""SQL of forests: planes as a table, routing level by level, probes, votes, and seeds from their rule."""

from __future__ import annotations

import numpy as np

from sylvine.functions import forest as kernel
from sylvine.functions.forest import Forest
from sylvine.operators import quantise

VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
L2 = "list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DOT = "list_inner_product(q.v, c.v)"


def _doubles(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def planes(forest: Forest) -> str:
    """A table nodes(tree, node, dims, w): the coordinates, from 1, that a node touches and their weights."""
    rows = []
    for t in range(forest.n_trees):
        dims, weights = forest.planes(t, np.arange((1 << forest.depth) - 1))
        rows += [f"({t}, {n}, [{', '.join(str(int(d) + 1) for d in dims[n])}], {_doubles(weights[n])})" for n in range(len(dims))]
    return f"nodes(tree, node, dims, w) AS (VALUES {', '.join(rows)})"


_DIFF = "list_inner_product(list_transform(n.dims, lambda d: {v}.v[d]), n.w) / sqrt(list_inner_product({v}.v, {v}.v) + 1e-10)"


def routed(forest: Forest, rows: str = "v", name: str = "p", med_depth: int = 0) -> str:
    """Tables that end in name(doc_id, tree, leaf). With med_depth, the top levels part at the median of their differences."""
    at, out = f"{name}0", [f"{name}0 AS (SELECT id, v, tree, 0 AS node FROM {rows}, (SELECT DISTINCT tree FROM nodes))"]
    for level in range(forest.depth):
        d, m, after = f"{name}d{level}", f"{name}m{level}", f"{name}{level + 1}"
        out.append(f"{d} AS MATERIALIZED (SELECT l.id, l.v, l.tree, l.node, {_DIFF.format(v='l')} AS diff FROM {at} l JOIN nodes n ON l.tree = n.tree AND l.node = n.node)")
        if level < med_depth:
            out.append(f"{m} AS (SELECT tree, node, CASE WHEN count(*) >= 8 THEN median(diff) ELSE 0 END AS th FROM {d} GROUP BY tree, node)")
            out.append(f"{after} AS (SELECT d.id, d.v, d.tree, 2 * d.node + 1 + (diff > th)::INT AS node FROM {d} d JOIN {m} m ON d.tree = m.tree AND d.node = m.node)")
        else:
            out.append(f"{after} AS (SELECT id, v, tree, 2 * node + 1 + (diff > 0)::INT AS node FROM {d})")
        at = after
    out.append(f"{name} AS (SELECT id AS doc_id, tree::BIGINT AS tree, (node - {(1 << forest.depth) - 1})::BIGINT AS leaf FROM {at})")
    return ",\n".join(out)


def probed(forest: Forest, n_probes: int, min_flip: int = 0, multi: bool = False, rows: str = "(SELECT * FROM v WHERE id % 50 = 0)", name: str = "q") -> str:
    """Tables that end in name(qid, tree, leaf, score): the main leaf and those of the n_probes cheapest sets of turned levels."""
    depth = forest.depth
    sets = [b for b in range(1 << depth) if not b & ((1 << min_flip) - 1) and (multi or b.bit_count() <= 1)]
    chain = ", ".join([f"1 + ((m[1] > 0) <> (flip & 1 > 0))::INT AS {name}n1", *[f"2 * {name}n{i} + 1 + ((m[{name}n{i} + 1] > 0) <> (flip >> {i} & 1 > 0))::INT AS {name}n{i + 1}" for i in range(1, depth)]])
    nodes = ["0", *[f"{name}n{i}" for i in range(1, depth)]]
    margins = ", ".join(f"abs(m[{n} + 1])" for n in nodes)
    cost = " + ".join(f"(flip >> {i} & 1) * g[{i + 1}]" for i in range(depth))
    return f"""{name}m AS MATERIALIZED (SELECT x.id, n.tree, list({_DIFF.format(v="x")} ORDER BY node) AS m FROM {rows} x, nodes n GROUP BY x.id, n.tree),
{name}w AS (SELECT id, tree, m, flip, {chain}, [{margins}] AS g FROM {name}m, (SELECT unnest({sets}) AS flip)),
{name}c AS (SELECT w.*, {cost.replace("g[", "z.g[").replace("flip", "w.flip")} AS cost FROM {name}w w JOIN {name}w z ON z.id = w.id AND z.tree = w.tree AND z.flip = 0),
{name}k AS (SELECT *, row_number() OVER (PARTITION BY id, tree ORDER BY flip > 0, cost, flip) AS place FROM {name}c),
{name} AS (SELECT id AS qid, tree::BIGINT AS tree, ({name}n{depth} - {(1 << depth) - 1})::BIGINT AS leaf, list_min(g) AS score FROM {name}k WHERE place <= {n_probes + 1})"""


def voted(depth: int = 0, where: str = "TRUE", name: str = "votes", shift: int = 0) -> str:
    s = f" >> {shift}" if shift else ""
    return f"{name} AS (SELECT qid, doc_id, count(DISTINCT tree) AS votes FROM (SELECT DISTINCT qid, tree, leaf{s} AS spot FROM q) q JOIN (SELECT tree, leaf{s} AS spot, doc_id FROM p JOIN v ON v.id = doc_id WHERE {where}) p USING (tree, spot) GROUP BY qid, doc_id)"


def reranked(top: str, k: int, self_too: bool = False, source: str = "votes", where: str = "TRUE") -> str:
    """Tables that end in r(qid, doc_id, dist, rank): the best `top` (an expression) by votes, ranked by distance."""
    return f"""t AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, doc_id) AS place FROM {source} WHERE {"TRUE" if self_too else "qid <> doc_id"}) WHERE place <= {top}),
s AS (SELECT t.qid, t.doc_id, {L2} AS dist FROM t JOIN v q ON q.id = t.qid JOIN v c ON c.id = t.doc_id WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, doc_id) AS rank FROM s QUALIFY rank <= {k})"""


def guided(forest: Forest, allowed: str) -> str:
    """Tables that end in g(qid, tree, leaf, score): a descent that takes the other child where the chosen one has no allowed document."""
    first = (1 << forest.depth) - 1
    up = " UNION ".join(f"SELECT tree, ((leaf + {first + 1}) >> {i}) - 1 AS node FROM a" for i in range(forest.depth + 1))
    out = [f"a AS (SELECT DISTINCT tree, leaf FROM p JOIN v ON v.id = doc_id WHERE {allowed})", f"alive AS MATERIALIZED ({up})", "g0 AS (SELECT id, v, tree, 0 AS node, 1e308::DOUBLE AS score FROM v, (SELECT DISTINCT tree FROM nodes) WHERE id % 50 = 0)"]
    for i in range(forest.depth):
        out.append(f"h{i} AS MATERIALIZED (SELECT l.id, l.v, l.tree, l.score, 2 * l.node + 1 + ({_DIFF.format(v='l')} > 0)::INT AS c, 4 * l.node + 3 - (2 * l.node + 1 + ({_DIFF.format(v='l')} > 0)::INT) AS o, abs({_DIFF.format(v='l')}) AS m FROM g{i} l JOIN nodes n ON l.tree = n.tree AND l.node = n.node)")
        out.append(f"g{i + 1} AS MATERIALIZED (SELECT h.id, h.v, h.tree, CASE WHEN x.node IS NOT NULL OR y.node IS NULL THEN c ELSE o END AS node, least(score, m) AS score FROM h{i} h LEFT JOIN alive x ON x.tree = h.tree AND x.node = c LEFT JOIN alive y ON y.tree = h.tree AND y.node = o)")
    out.append(f"g AS (SELECT id AS qid, tree::BIGINT AS tree, (node - {first})::BIGINT AS leaf, score FROM g{forest.depth})")
    return ",\n".join(out)


def quantised(bits: int, kept: str, seed: int = 1, dim: int = 64) -> str:
    """From t(qid, doc_id): tables that end in z(qid, doc_id), the best `kept` by quantised inner products."""
    rotation = quantise.rotate(np.eye(dim), seed).T
    matrix = ", ".join(f"({j}, {_doubles(row)})" for j, row in enumerate(rotation))
    value = "(r.y[j] > 0)::INT" if bits == 1 else f"({_doubles(quantise.CODE)})[len(list_filter({_doubles(quantise.EDGES)}, lambda e: e < r.y[j] / greatest(r.scale, 1e-12))) + 1]"
    scale = "1.0" if bits == 1 else "c.scale"
    return f"""rotation(j, w) AS (VALUES {matrix}),
y AS (SELECT id, list(list_inner_product(v.v, w) ORDER BY j) AS y FROM v, rotation GROUP BY id),
coded AS MATERIALIZED (SELECT id, y, list_transform(range(1, {dim + 1}), lambda j: {value}) AS code, scale FROM (SELECT id, y, sqrt(list_inner_product(y, y) / {dim}) AS scale FROM y) r),
z AS (SELECT qid, doc_id FROM (SELECT t.qid, t.doc_id, row_number() OVER (PARTITION BY t.qid ORDER BY list_inner_product(q.y, c.code::DOUBLE[]) * {scale} DESC, t.doc_id) AS place FROM t JOIN coded q ON q.id = t.qid JOIN coded c ON c.id = t.doc_id) WHERE place <= {kept})"""


def projection(dim_in: int, dim_out: int, seed: int) -> str:
    columns = kernel.sparse_projection(dim_in, dim_out, seed).T
    return f"WITH m(place, w) AS (VALUES {', '.join(f'({j}, {_doubles(c)})' for j, c in enumerate(columns))}),\n{VECTORS}\n"


def seeds(forest: Forest, version: int = 3) -> str:
    """The planes of a forest from the seed rule itself, in 128-bit integers: rows tree, node, place, dim, weight."""
    word, full = "18446744073709551616::HUGEINT", forest.dim
    mod = lambda x: f"(({x}) % {word})"
    a, b, c = kernel.SHIFTS
    left = lambda s, n: f"(({s} % {1 << (64 - n)}::HUGEINT) * {1 << n}::HUGEINT)"
    return f"""WITH RECURSIVE heads AS (
  SELECT t.tree, n.node, k.side, {mod(f"t.tree::HUGEINT * {kernel.TREE_MUL} + {kernel.TREE_ADD}")} AS seed
  FROM (SELECT unnest(range({forest.n_trees})) AS tree) t, (SELECT unnest(range({(1 << forest.depth) - 1})) AS node) n, (SELECT unnest([0, 1]) AS side) k),
start AS (SELECT tree, node, side, CASE WHEN h = 0 THEN 1 ELSE h END AS h FROM (SELECT *, xor({mod(f"seed * {kernel.HASH_MUL}")}, {mod(f"(2 * node + side)::HUGEINT * {kernel.NODE_MUL}")}) AS h FROM heads)),
draws(tree, node, side, i, h) AS (
  SELECT tree, node, side, 0, h FROM start
  UNION ALL
  SELECT tree, node, side, i + 1, xor(h2, {left("h2", c)}) FROM (
    SELECT tree, node, side, i, xor(h1, h1 // {1 << b}::HUGEINT) AS h2 FROM (SELECT *, xor(h, {left("h", a)}) AS h1 FROM draws WHERE i < {forest.sub_dim // 2}))),
halves AS (SELECT tree, node, side, 2 * (i - 1) AS place, (h % 16777216) / 16777215.0::DOUBLE - 0.5 AS x FROM draws WHERE i > 0
  UNION ALL SELECT tree, node, side, 2 * (i - 1) + 1, (h // 16777216 % 16777216) / 16777215.0::DOUBLE - 0.5 FROM draws WHERE i > 0),
unit AS (SELECT tree, node, side, place, x / sqrt(sum(x * x) OVER (PARTITION BY tree, node, side) + 1e-10) AS x FROM halves),
chain(tree, node, place, h) AS (
  SELECT tree, node, -1, xor({mod(f"seed * {kernel.HASH_MUL}")}, {mod(f"node::HUGEINT * {kernel.NODE_STEP} * {kernel.NODE_MUL}")}) FROM heads WHERE side = 0
  UNION ALL
  SELECT tree, node, place + 1, {mod(f"{mod(f'h * {kernel.HASH_MUL}')} + (place + 1)::HUGEINT * {kernel.NODE_MUL}")} FROM chain WHERE place < {forest.sub_dim - 1})
SELECT a.tree::BIGINT AS tree, a.node::BIGINT AS node, a.place::BIGINT AS place, (d.h % {full})::BIGINT AS dim, round(b.x - a.x, 9) AS weight
FROM unit a JOIN unit b ON a.tree = b.tree AND a.node = b.node AND a.place = b.place AND a.side = 0 AND b.side = 1 JOIN chain d ON d.tree = a.tree AND d.node = a.node AND d.place = a.place"""


CHUNKS = """WITH RECURSIVE parts(parent, text, n, seq, a, b) AS (
  SELECT doc_id, text, length(text), 0, 0, CASE WHEN length(text) > {size} THEN coalesce(list_max(list_filter(range({size} - {near}, {size}), lambda k: k > 0 AND substr(text, k::INT + 1, 1) = ' ')), {size}) ELSE length(text) END FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT parent, text, n, seq + 1, i, CASE WHEN n > i + {size} THEN i + coalesce(list_max(list_filter(range({size} - {near}, {size}), lambda k: k > 0 AND substr(substr(text, i::INT + 1, {size}), k::INT + 1, 1) = ' ')), {size}) ELSE n END
  FROM (SELECT *, greatest(b - {overlap}, a + 1) AS i FROM parts WHERE b < n))
SELECT row_number() OVER (ORDER BY parent, seq) - 1 AS chunk_id, parent, seq::INT AS seq, a::BIGINT AS off, (b - a)::INT AS size FROM parts"""
