"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from marketloom.plans import QUERIES
from marketloom.session import build_session

HEADLINE = [
    "h5_monthly_change", "f4_source_price_comparison", "f18_daily_prices", "f10_writer_metrics", "f11_source_metrics", "f19_run_summary",
    "k3_drift_warnings", "g1_source_registry", "g8_either_key", "e1_search_products", "e2_product_view", "h2_newest_per_domain", "h9_duplicate_rows",
    "b7_page_class", "b10_links", "c19_page_text", "d1_clean_text", "d20_fold_documents", "a14_upsert", "j2_work_list", "j4_promotion", "l1_retention",
    "k5_synthetic_checks", "c2_listing_rows", "c7_extracted_products", "i3_canonical_features", "i5_components", "i5_canonical_products",
    "i1_duplicate_pairs", "m2_daily_prices",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = [q for q in HEADLINE if not sys.argv[1:] or q in sys.argv[1:]]
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
