"""Times headline queries once warm; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quillon.queries import ALL
from quillon.sources.tables import corpus_of

HEADLINE = ("count_lemma_by_lang", "pred_whole_regex", "pred_region_overlapping", "seq_adjacent", "seq_optional", "seq_maximal_runs", "tree_children", "tree_descendants", "within_nested", "containing_region", "coll_window", "keyness_rest", "count_hierarchy")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    start = time.time()
    corpus_of(spark, sf_dir)
    seconds["ingest"] = round(time.time() - start, 3)
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.time()
            ALL[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({"metric": "seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))[2:]}))


if __name__ == "__main__":
    main()
