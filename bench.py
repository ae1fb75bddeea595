"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS the cores.
Each query is run to its full result, written to a sink that discards rows.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from roentgrid.plans import catalog

HEADLINE = [
    "b2_full_report", "b17_eval_text", "b22_sentences", "c8_union_iou", "d1_image_paths", "d8_eval_set",
    "e1_studies", "e7_phrase_instances", "e10_pseudo_reports", "f3_location_stats", "f7_prompt_type_metrics",
    "g2_waterfill", "g7_weighted_sequence", "g10_core_sample", "h5_curriculum_cycle", "i1_bleu", "i2_rouge_n",
    "i3_rouge_l", "i8_classification_report", "i9_max_mean_cosine", "i16_bootstrap_mean", "j1_location_queries",
    "j5_rate_plan", "j7_validate_reply",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("roentgrid-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    out = {
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(folder)),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
