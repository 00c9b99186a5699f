"""Driver-side choices: how deep to query, how wide to search, and which way to filter."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

BRUTE_MB, PRE_DENSITY = 50, 0.03


def auto_depth(depth: int, n_docs: int, n_filter: int | None) -> int:
    """The depth at which a filter's documents fill a leaf as all documents do at full depth."""
    if not n_filter:
        return depth
    return min(depth, max(1, depth - math.ceil(math.log2(max(1.0, n_docs / n_filter)))))


def auto_depth_measured(depth: int, at_depth: int, two_above: int, target: int, n_docs: int, n_filter: int | None = None, mode: int = 1) -> int:
    """From candidates counted at the depth and two levels above: go up until `target` candidates are to be expected."""
    factor = 1.7 if at_depth <= 0 or two_above <= 0 else max(1.05, (two_above / at_depth) ** 0.5)
    levels = max(0, math.ceil(math.log(target / max(at_depth, 1)) / math.log(factor)))
    extra = 0
    if n_filter and mode:
        lg = math.log2(n_docs / n_filter)
        extra = max(0, math.floor(lg / 2) if mode == 2 else math.floor(lg) - 1)
    return min(depth, max(1, depth - levels - extra))


def oversample(top_k: int, density: float, top_n: int | None = None) -> tuple[int, int]:
    """How many to rank before a filter, and how many to collect by votes."""
    if density >= 0.5:
        wide = max(2 * top_k, 20)
    else:
        wide = min(500 * top_k, max(10 * top_k, 2 * math.ceil(top_k / max(density, 1e-6))))
    return wide, top_n or max(2000, 4 * wide)


def strategy(card: int, n_docs: int, dim: int) -> str:
    """brute for a filter whose vectors are few megabytes, pre for a rare one, else post."""
    if card * dim * 4 / 2**20 <= BRUTE_MB:
        return "brute"
    return "pre" if card / max(1, n_docs) <= PRE_DENSITY else "post"


def adaptive_top_n(n_docs: int, dim: int, top_k: int) -> int:
    ratio = 0.02 if n_docs < 1_000_000 else 0.05 if dim >= 384 else 0.001
    return min(50_000, max(int(n_docs * ratio), 10 * top_k, 2000))


def segment_depth(depth: int, n: int) -> int:
    return max(depth, int(math.log2(max(2, n))) - 2)


def recalibration_points(n_docs: int, first: int = 100_000) -> list[int]:
    """The sizes up to n_docs at which thresholds are taken anew: the first and each doubling of it."""
    return [first << i for i in range(max(0, n_docs // first).bit_length())]


def measured_depth(count: Callable[[int], float], depth: int, target: int, n_docs: int, n_filter: int | None = None, mode: int = 1) -> int:
    """auto_depth_measured from a measure of the candidates a query has at a depth: it is asked at the depth and two levels above."""
    above = max(1, depth - 2)
    at, wide = count(depth), count(above)
    return auto_depth_measured(depth, round(at), round(wide), target, n_docs, n_filter, mode)


def calibrate(measure: Callable[[int, int, int], float], paths: Iterable[int] = (768, 1024), caps: Iterable[int] = (200_000, 300_000, 400_000), gain: float = 0.005, top_n: int = 4000) -> dict:
    """Walks a grid by recall, each path through the caps until a step gains less than `gain`, then tries twice the candidates."""
    best = None
    for p in paths:
        before = None
        for c in caps:
            got = measure(p, c, top_n)
            if best is None or got > best["recall"]:
                best = {"top_paths": p, "cap": c, "top_n": top_n, "recall": got}
            if before is not None and got - before < gain:
                break
            before = got
    wide = measure(best["top_paths"], best["cap"], 2 * top_n)
    return best | {"top_n": 2 * top_n, "recall": wide} if wide - best["recall"] >= gain else best


def ladder(run: Callable[[int], DataFrame | None], caps: Iterable[int] = (400_000, 300_000, 200_000, 150_000), seconds: float = 30.0, clock: Callable[[], float] = time.monotonic) -> tuple[DataFrame | None, int | None]:
    """Tries leaf caps from the largest down until one gives a result; no further try begins after `seconds`.

    run(cap) returns its result, or None where it gave up. Returns the result and the cap, or None twice.
    """
    end = clock() + seconds
    for cap in caps:
        if clock() >= end:
            break
        found = run(cap)
        if found is not None:
            return found, cap
    return None, None


def deepest(measure: Callable[[int], float], depths: Iterable[int], target: float) -> int:
    """The largest query depth whose recall reaches the target; the smallest where none does."""
    order = sorted(depths, reverse=True)
    return next((d for d in order if measure(d) >= target), order[-1])


def recommend(store, name: str, **choices) -> dict:
    """Writes calibrated choices as JSON to a live index's or catalog's store, over what was there; returns them."""
    store.put(name, json.dumps(choices, sort_keys=True), True)
    return choices
