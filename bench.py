"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from commentmill.plans.catalog import QUERIES
from commentmill.session import local_session

HEADLINE = [
    "flagged_share_by_language", "clean_configured", "clean_unicode", "text_statistics",
    "scan_documents", "mask_profanity", "replace_profanity", "augment_synonyms", "augment_swap",
    "augment_noise", "column_profile", "sampled_rows_large", "split_stratified", "split_sizes",
    "scan_report", "tfidf_vocabulary", "knn_predictions", "naive_bayes_predictions",
    "packed_batches", "score_rows", "score_summary", "parsed_answers", "history_totals",
    "history_newest_per_user",
]
# One small file is one scan task; a large table comes in many files.
SPREAD = ("documents", "pages", "conversations")


def spread_tables(spark, sf_dir: str, parts: int) -> str:
    """The same tables, those with texts in many files, in a folder of their own."""
    out = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(sf_dir)):
        if name.removesuffix(".parquet") in SPREAD:
            spark.read.parquet(f"{sf_dir}/{name}").repartition(parts).write.parquet(f"{out}/{name}")
        else:
            os.symlink(os.path.abspath(f"{sf_dir}/{name}"), f"{out}/{name}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, "16g")
    data = spread_tables(spark, sf_dir, 2 * int(cpus) if cpus.isdigit() else 16)
    wanted = os.environ.get("BENCH_QUERIES", "").split(",")
    names = [n for n in HEADLINE if wanted == [""] or n in wanted]
    QUERIES["history_totals"](spark, data).collect()  # start the JVM's workers
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
