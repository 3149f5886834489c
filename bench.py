"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

HERE = str(Path(__file__).resolve().parent)
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH", "")) if x)

NAMES = "popularity_baseline t1_user_rolling t1_item_rolling t1_pair_rolling history_strict_asof itemcf_cosine itemcf_padded_topk exact_topk exposure_pool log_q auc_global gauc calibration sample_assembly vocab_video".split()


def pairs_per_second(spark, sf_dir: str) -> dict[str, float]:
    """Exact top 10 of every fourth part among all parts, by vectors of 64 hashed numbers: 1e8 pairs at sf0.1."""
    from pyspark.sql import functions as F

    from feedloom.operators.retrieval import exact_top_k

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("item_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.xxhash64("p_partkey", i) % 1000) / 1000.0).alias("v"))
    queries = parts.where("item_id % 4 = 0").select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    pairs, began = queries.count() * parts.count(), time.time()
    exact_top_k(queries, parts, 10).write.format("noop").mode("overwrite").save()
    took = time.time() - began
    return {"pairs": pairs, "seconds": round(took, 3), "pairs_per_second": round(pairs / took)}


def main() -> None:
    from feedloom.registry import QUERIES
    from feedloom.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["popularity_baseline"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's threads
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"), "exact_topk_pairs": pairs_per_second(spark, sf_dir)}))


if __name__ == "__main__":
    main()
