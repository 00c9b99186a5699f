"""Connected components of a table of links, without gathering them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylvine.llm.joins import joined
from sylvine.scratch import Scratch

HELD = 500_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some links as stars: each node but the least of its component, and that least one."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _contract(links: DataFrame) -> DataFrame:
    """Links with each HELD of them replaced by their components' stars: fewer links, the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            u, v = contracted(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows id, component (the smallest id reachable) of all ids in links (a, b), by alternating large and small stars.

    Each round links nodes closer to the smallest of their neighbours; before, what a task holds of the links is replaced
    by its components' stars. Groups are only ever aggregated and joined, never gathered, and nodes of many links are cut
    in the joins. The driver sees a count and a checksum a round.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    edges = scratch.table(_contract(edges), "edges")
    sums = (F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003))
    before = edges.agg(*sums).first()
    while True:
        # Large star: a node's larger neighbours link to the least of its neighbourhood.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = joined(both, least, ["u"], ["v"], 2 * before[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours link to the least of them. No node has more links here than it had.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        edges = scratch.table(_contract(small.coalesce(2 * before[0] // HELD + 1)), "edges")
        now = edges.agg(*sums).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
