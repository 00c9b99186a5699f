"""Commands over a catalog: python -m sylvine.cli ROOT COMMAND ..."""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvine.functions.forest import Forest
from sylvine.operators import knn
from sylvine.plans.search import SearchSpec
from sylvine.sources import vectors
from sylvine.streaming.live import Catalog


def _vectors(spark: SparkSession, path: str, id_col: str, vec_col: str) -> DataFrame:
    """Vectors of a Parquet table, or of a file by its extension."""
    if path.rstrip("/").endswith(".parquet"):
        return knn.vectors(spark.read.parquet(path), id_col, vec_col)
    return vectors.read(spark, path).select("id", F.col("vec").cast("array<double>").alias("vec"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sylvine")
    p.add_argument("root")
    p.add_argument("--id", default="id")
    p.add_argument("--vec", default="vec")
    c = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [s := c.add_parser(name), *[s.add_argument(a) for a in args]][0]
    for name in ("list", "health", "maintain"):
        add(name)
    for name in ("stats", "verify", "freeze", "compact", "drop"):
        add(name, "name")
    s = add("build", "name", "vectors")
    s.add_argument("--trees", type=int, default=64)
    s.add_argument("--depth", type=int, default=10)
    add("insert", "name", "vectors")
    add("append", "name", "vectors")
    add("delete", "pattern", "ids").add_argument("--where")
    for name in ("topn", "search", "recall"):
        s = add(name, "pattern", "queries")
        s.add_argument("--k", type=int, default=10)
        s.add_argument("--top-n", type=int, default=4000)
        s.add_argument("--probes", type=int, default=5)
        s.add_argument("--depth", type=int, default=0)
        s.add_argument("--out")
    add("backup", "name", "path")
    add("restore", "path", "name").add_argument("--force", action="store_true")
    add("copy", "name", "to")
    add("adopt", "path", "name")
    add("expire", "days")
    return p


def run(spark: SparkSession, args: list[str]) -> object:
    """Runs a command; returns what it prints: a value, or rows of a search."""
    a = parser().parse_args(args)
    c = Catalog(spark, a.root)
    load = lambda path: _vectors(spark, path, a.id, a.vec)
    if a.command in ("topn", "search", "recall"):
        q = load(a.queries)
        found = c.search(a.pattern, q, SearchSpec(top_k=a.k, top_n=a.top_n, n_probes=a.probes, query_depth=a.depth))
        if a.command == "recall":
            every = None
            for name in c.list(a.pattern):
                own = c.open(name).vectors()
                every = own if every is None else every.unionByName(own)
            return knn.recall(found, knn.exact(q, every, a.k, include_self=True), a.k).first().recall
        if a.out:
            vectors.write_results(found, a.out)
            return a.out
        return [r.asDict() for r in found.orderBy("qid", "rank").collect()]
    if a.command == "build":
        x = load(a.vectors)
        index = c.create(a.name, Forest(n_trees=a.trees, depth=a.depth, dim=len(x.first().vec)), max_active=0)
        index.insert(x)
        index.freeze()
        return index.stats()
    if a.command == "delete":
        return c.delete(a.pattern, load(a.ids).select("id") if a.where is None else load(a.ids).where(a.where).select("id"))
    index = lambda: c.open(a.name, max_active=0)
    return {
        "list": c.list,
        "health": lambda: {n: c.open(n).verify() for n in c.list()},
        "maintain": lambda: c.maintain(1),
        "stats": lambda: index().stats(),
        "verify": lambda: index().verify(),
        "freeze": lambda: index().freeze(),
        "compact": lambda: index().merge_hot(),
        "drop": lambda: c.drop(a.name),
        "insert": lambda: index().insert(load(a.vectors)),
        "append": lambda: index().append(load(a.vectors)),
        "backup": lambda: c.backup(a.name, a.path),
        "restore": lambda: c.restore(a.path, a.name, a.force).stats(),
        "copy": lambda: c.copy(a.name, a.to).stats(),
        "adopt": lambda: c.adopt(a.path, a.name).stats(),
        "expire": lambda: c.drop_expired(int(a.days), dt.date.today()),
    }[a.command]()


def main() -> None:
    spark = SparkSession.builder.appName("sylvine").getOrCreate()
    print(json.dumps(run(spark, None), default=str))


if __name__ == "__main__":
    main()
