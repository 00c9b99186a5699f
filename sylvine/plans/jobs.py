"""Jobs that end in time, and builds that go on where they stopped."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvine.functions.forest import Forest
from sylvine.operators import votes as V
from sylvine.streaming.live import Store


def within(spark: SparkSession, seconds: float, action: Callable[[], Any]) -> tuple[Any, bool]:
    """Runs an action (a collect, a write) and cancels its Spark jobs when the time is up: (result, False), or (None, True)."""
    group, box = f"within-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "an action with a deadline", interruptOnCancel=True)
        try:
            box["result"] = action()
        except BaseException as e:  # noqa: BLE001  handed on below, unless it is the cancellation
            box["error"] = e

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        late = threading.Event()
        while thread.is_alive() and not late.wait(0.2):  # a job may be submitted just after a cancellation
            spark.sparkContext.cancelJobGroup(group)
            thread.join(0.2)
        return (box["result"], False) if "result" in box else (None, True)
    if "error" in box:
        raise box["error"]
    return box["result"], False


def build(corpus: DataFrame, forest: Forest, path: str, parts: int) -> tuple[DataFrame, int]:
    """Postings of a corpus at path, built in `parts` by a hash of the id; returns them and how many parts this call built.

    A part that is complete isn't built again, so a build that was stopped goes on when it is called anew with the same
    corpus, forest and number of parts. The parts of another forest are refused.
    """
    spark = corpus.sparkSession
    store, told = Store(spark, path), repr((forest, parts, None if forest.medians is None else forest.medians.tobytes()))
    if store.exists("forest.txt"):
        if store.get("forest.txt") != told:
            raise ValueError(f"{path} holds parts of another build")
    else:
        store.put("forest.txt", told)
    done = 0
    for i in range(parts):
        if not store.exists(f"part={i}/_SUCCESS"):
            own = corpus.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
            V.postings(own, forest).sortWithinPartitions("tree", "leaf", "doc_id").write.mode("overwrite").parquet(f"{path}/part={i}")
            done += 1
    return spark.read.schema(V.POSTINGS).parquet(*[f"{path}/part={i}" for i in range(parts)]), done
