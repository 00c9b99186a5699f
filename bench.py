"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from sylvine import queries
from sylvine.operators import knn

HEADLINES = ("forest_search", "d1_knn_l2", "f8_pre_filter", "v2_query_depth_votes", "r8_route", "d6_tq4_rerank", "c5_contexts", "f20_keys", "d12_recall", "m20_balance")

SEARCHES = ("forest_search", "d6_tq4_rerank", "d7_tq1_rerank")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries.QUERIES["r8_route"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the workers
    times = {}
    for name in HEADLINES:
        began = time.perf_counter()
        queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    recall = {n: round(knn.recall(queries.QUERIES[n](spark, folder), truth, 10).first().recall, 3) for truth in [knn.exact(queries.asked(spark, folder), queries.corpus(spark, folder), 10).cache()] for n in SEARCHES}
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "recall_at_10": recall, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
