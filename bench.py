"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from orthoflow.catalog import QUERIES

HEADLINE = [
    "document_vocabulary",
    "out_of_lexicon",
    "near_candidates",
    "find_errors",
    "document_results",
    "mark_occurrences",
    "highlight_text",
    "apply_corrections",
    "unit_comments",
    "second_layer",
    "orthography_filter",
    "word_affixes",
    "gender_number",
    "build_package",
    "expand_package",
    "apply_row_changes",
    "publish_version",
    "course_header",
    "publication_readiness",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("orthoflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("orthoflow.input.partitions", cpus)  # the tables are one small file each
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # compile and class-load once, on the smallest tables
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        QUERIES["find_errors"](spark, warm).write.format("noop").mode("overwrite").save()
    only = os.environ.get("BENCH_ONLY")
    times = {}
    for name in only.split(",") if only else HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    rates = {}
    if "find_errors" in times:
        size = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("count(*) n", "sum(regexp_count(text, '[^ ]+')) w").first()
        rates = {"documents_per_sec": round(size.n / times["find_errors"]), "words_per_sec": round(size.w / times["find_errors"])}
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
             "queries": times, "sf": os.path.basename(sf.rstrip("/")), **rates}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
