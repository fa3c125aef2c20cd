"""Bounds on the scans and shuffles of plans that once exploded."""

import re

import pytest

from shelfspark.plans.registry import queries

SF = "/root/testdata/sf0.001"
MOST = {  # query: scans, shuffles without broadcasts
    "D22_template_match": (10, 15),
    "W11_best_template": (9, 14),
    "J18_template_pool": (8, 13),
    "D23_filter_values": (19, 22),
    "A22_import_counters": (7, 13),
    "D28_catalog_diff": (2, 2),
    "W5_offer_rank": (4, 6),
    "W1_ranked_listings": (4, 6),
    "J8_offers_to_observations": (10, 16),
}


@pytest.mark.parametrize("name", sorted(MOST))
def test_scans_and_shuffles_stay_few(spark, name):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    query = queries()[name](spark, SF)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = query._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    scans, shuffles = MOST[name]
    assert len(re.findall("FileScan", plan)) <= scans
    assert len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single)", plan)) <= shuffles
