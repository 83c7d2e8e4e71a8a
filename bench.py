"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the
local cores (default 8), BENCH_QUERIES a comma-separated list of queries in
place of the headline ones, `all` for every one.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "similarity_in_category", "weighted_similarity", "max_score_per_product_tag",
    "candidates_with_region", "prefilter_topk", "cosine_rerank_top", "mean_pool_by_label",
    "threshold_pushdown", "concat_distinct", "product_description", "catalog_description",
    "dedupe_first", "catalog_text", "normalize_text", "hash_embed", "catalog_candidates",
    "trend_product_mapping", "flatten_trends", "valid_answers", "batch_state", "pending_files",
]


def main() -> None:
    from trendloom.session import build_session
    from trendloom.workload.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    timings = {name: min(run(name), run(name)) for name in names}
    print(json.dumps({
        "metric": "total time of the headline queries, better of two runs each",
        "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
