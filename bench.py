"""Time the headline queries. Prints one JSON line; sizes come from BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from mediaflow.plans import QUERIES

HEADLINE = [
    "tag_counts",
    "tag_records",
    "tag_union",
    "attach_payload",
    "filter_in_list",
    "hash_split",
    "three_way_split",
    "shuffle_rows",
    "pi_estimate",
    "label_freq",
    "string_index",
    "csv_load_train",
    "feature_stats",
    "standardize",
    "channel_planes",
    "layout_convert",
    "flip_horizontal",
    "one_hot",
    "softmax_scores",
    "confusion_wide",
    "precision_recall",
    "image_decode",
    "image_resize",
    "image_materialise",
    "averaged_train",
    "cnn_scores",
    "cnn_predict",
    "staged_predict",
]


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", f"file://{os.path.abspath('spark-warehouse')}/_scratch")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first Python worker and the first job pay for start-up, not for a query.
    spark.range(1000).mapInArrow(lambda batches: batches, "id bigint").count()
    seconds: dict[str, float] = {}
    for name in names or HEADLINE:
        runs = []
        for _ in range(3):
            begin = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(runs), 4)
    print(
        json.dumps(
            {
                "metric": "headline queries, median of three runs each, summed",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
