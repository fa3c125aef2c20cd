"""Bench of the headline queries: python bench.py prints one JSON line.

Data folder and cores come from BENCH_SF_DIR and BENCH_CPUS. Every query is written to
the no-op sink; the first of two runs counts as cold, the second as warm, and the warm
time is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfspark.plans.registry import queries  # noqa: E402
from shelfspark.session import local_session  # noqa: E402

HEADLINE = [
    "D1_reprice", "D1_rule_families", "W1_ranked_listings", "W5_offer_rank", "A1_catalog_summary",
    "A4_category_hierarchy", "S2_catalog_page", "U1_catalog_merge", "J1_observation_to_product",
    "D3_review_rows", "D5_apply_actions", "D7_alerts", "U10_new_alert_events", "D8_selection_gate",
    "FN16_normalize_url", "U3_imported_url_merge", "J13_sources_from_urls", "A22_import_counters",
    "D14_batch_resolution", "D28_catalog_diff", "D31_field_plan", "W7_related_products",
    "D23_filter_values", "A26_quality_score", "FN42_text_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    # The one line of output must stand alone on stdout.
    out = os.dup(1)
    os.dup2(2, 1)
    spark = local_session("bench")
    known = queries()
    cold, warm = {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_warm_total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": os.environ.get("BENCH_CPUS", "8"),
        "spark": spark.version,
    }
    os.write(out, (json.dumps(line) + "\n").encode())
    spark.stop()


if __name__ == "__main__":
    main()
