"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.  Each query is executed to completion with the
``noop`` sink (the whole plan runs, nothing is collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kbspark.plans.ingest_checks import written_manuals  # noqa: E402
from kbspark.plans.queries import QUERIES  # noqa: E402
from kbspark.session import READ_PARTITIONS, build_session, clear_intermediates  # noqa: E402
from kbspark.sources.fixtures import Fixtures  # noqa: E402

HEADLINE = [
    "m4_topk_documents",   # flagship: substring + fuzzy top-5, documents x benchmark
    "m2_match_score",
    "m1_like_search",
    "m3_token_sort_pairs",
    "m7_best_match",
    "m8_nearest",
    "m9_tfidf_best",
    "c4_append_images",
    "c6_reingest_matrix",
    "d1_replace_by_position",
    "d5_documents",
    "d6_caption_paragraphs",
    "f4_slug",
    "t8_postprocess",
    "t9_request_rows",
    "e3_threshold_sweep",
    "i2_parse_runs",
    "s4_assemble_chunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    spark.conf.set(READ_PARTITIONS, cpus)  # the bench tables have one row group each
    # warm-up: JVM, Python workers, parquet footers
    QUERIES["f1_normalize"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    # what an ingest writes once and several queries read: runs, images, manuals, captions;
    # timed on its own, as the queries' figures leave it out
    t0 = time.perf_counter()
    fx = Fixtures(spark, sf_dir)
    written_manuals(fx)
    for table in (fx.assistants, fx.captions):
        table()
    setup = {"ingested_tables": round(time.perf_counter() - t0, 3)}
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "setup": setup, "sf": sf}))
    clear_intermediates(spark)
    spark.stop()


if __name__ == "__main__":
    main()
