"""Benchmark the headline queries.

Runs each query to completion (a no-op write forces every row to be computed
without collecting to the driver) at $BENCH_SF_DIR on local[$BENCH_CPUS] and
prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from litspark.plans.catalog import load_all  # noqa: E402
from litspark.session import build_session  # noqa: E402

HEADLINE = [
    "txt6_distinctive_terms",      # flagship: clean -> TF-IDF -> distinctive terms
    "str21_clean_documents",       # full cleaner over every document
    "str16_tokens",                # token stream
    "txt1_phrase_detection",       # phrase statistics
    "txt3_apply_phrases",          # greedy phrase merge
    "vec1_document_mean_vectors",  # document vectors
    "agg5_6_yearly_percentiles_and_mean",
    "agg9_top_terms",
    "agg11_ngram_counts",
    "jn10_fuzzy_closest_title",
    "jn11_fragment_in_documents",
    "win2_nearest_at_positions",
    "smp8_oversample_minority",
    "smp12_kfold_assignment",
    "agg24_roc_auc",
    "ml4_linear_batch_scoring",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="litspark-bench")
    reg = load_all()
    times: dict[str, float] = {}
    for name in names:
        spark.catalog.clearCache()  # no query profits from another's cached data
        t0 = time.perf_counter()
        reg[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
