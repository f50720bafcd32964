"""Headline timings: one warm-up, then the median of three runs. Prints one JSON line."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioscope.catalog import registry
from folioscope.session import local_session

HEADLINE = ["g1_feature_matrix", "prep6_selection_report", "j7_knn_exact", "a46_mean_roc", "w5_stratified_folds", "x4_linear_attributions"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    queries = registry.queries()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for i in range(4):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf).name, "frame_rows_per_sec": round(rows / seconds["g1_feature_matrix"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
