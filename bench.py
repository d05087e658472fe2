"""Seconds per query over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Beside the queries: ``calibration_s``, a fixed loop before and after them, by
which machines can be told apart; ``index_rebuild_s``, the index of all
documents written anew; ``warm``, some queries once more.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from loomstone.plans import index_queries
from loomstone.plans.catalogue import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "x02_fold_key", "x18_extract_title", "w03_dedup_runs", "w05_chunks", "f03_phrase", "f05_bm25_topk", "f07_expand", "a01_stats", "a05_canonical", "j07_suggestions",
    "j08_edges", "a07_degree", "a08_components", "w01_date_anomaly", "j09_adjudicate", "j10_witnesses", "a23_divergence", "j11_place_resolve", "j15_quote_verify",
    "j18_sync_plan", "h04_schedule", "a13_spine", "a15_swimlanes", "a16_places_map", "a18_lowercase", "t01_dated", "v15_corpus_shape",
]

#: Queries that are run once more after the others.
WARM = ["x02_fold_key", "j15_quote_verify", "f05_bm25_topk", "w01_date_anomaly"]


def calibration() -> float:
    """Seconds of a fixed loop of one core, the least of five."""
    took = []
    for _ in range(5):
        began = time.time()
        sum(i * i % 7 for i in range(1_000_000))
        took.append(time.time() - began)
    return round(min(took), 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda q: QUERIES[q](spark, SF).write.format("noop").mode("overwrite").save()
    run("x02_fold_key")  # starts the JVM's compiled code and the table readers

    def timed(work) -> float:
        began = time.time()
        work()
        return round(time.time() - began, 3)

    fixed = [calibration()]
    seconds = {q: timed(lambda: run(q)) for q in HEADLINE}  # noqa: B023
    more = {"index_rebuild_s": timed(lambda: index_queries.build(spark, SF)), "warm": {q: timed(lambda: run(q)) for q in WARM}}  # noqa: B023
    fixed.append(calibration())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF, "calibration_s": fixed, **more}))
    spark.stop()


if __name__ == "__main__":
    main()
