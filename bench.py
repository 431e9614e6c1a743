"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

index_build pays for the stored index that the searches after it read.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("index_build", "bm25_topk", "tfidf_cosine_topk", "dense_ip_topk", "dense_parent_max", "hybrid_rrf", "rerank_topk", "compare_stages", "parse_sections", "child_bounds", "index_diff", "cache_misses")


def main() -> None:
    from pyspark.sql import SparkSession

    from quillspark.queries import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["corpus_stats"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers and Python workers
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
