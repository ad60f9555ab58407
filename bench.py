"""Times the headline queries over BENCH_SF_DIR on local[BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = ["hybrid_retrieve", "bm25_topk", "bm25_porter", "dense_topk", "rrf_fuse", "chunk_windows", "chunk_materialise", "parse_turns", "tokenize_terms", "topics_topk", "extractive_answer", "hash_embed_sparse", "mmr_select", "eval_recall", "event_windows"]


def main() -> None:
    from pyspark.sql import SparkSession

    from colloquy.plans.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "512k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["token_estimate"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the executors' code
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
