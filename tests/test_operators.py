"""Operators on small frames: merge rules, ranks under skew, brute-force comparisons, streams."""

import difflib
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import attributes as A
from shelfspark.operators import catalog as C
from shelfspark.operators import changes as X
from shelfspark.operators import listings as L
from shelfspark.operators import matching as K
from shelfspark.operators import monitoring as O
from shelfspark.operators import quality as Q
from shelfspark.operators import registry as R
from shelfspark.operators.skew import exact_rank, first_row, multiset_hash, top_rows
from shelfspark.sources import readers as RD
from shelfspark.streaming import jobs as J


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ------------------------------------------------------------------------ skew
def test_exact_rank_numbers_a_hot_group_without_gaps(spark):
    rng = random.Random(7)
    # One group of more than half of the rows, one of 0.9 %, many small ones.
    data = [("hot", rng.randrange(400), i) for i in range(6000)] + [("warm", i % 9, i) for i in range(62)]
    data += [(f"k{i % 50}", i % 7, i) for i in range(900)]
    df = spark.createDataFrame(data, "k string, p int, id int").repartition(8)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data in several ranges
    got = rows(exact_rank(df, ["k"], ["p", "id"]), "k", "rank", "p", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    want = []
    for key in {d[0] for d in data}:
        for n, (_k, p, i) in enumerate(sorted(d for d in data if d[0] == key), 1):
            want.append((key, n, p, i))
    assert got == sorted(want)


def test_exact_rank_reads_its_input_once_and_splits_the_hot_group(spark, tmp_path):
    spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("p"), F.lit(None).alias("n").cast("int")).write.parquet(f"{tmp_path}/in")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranked = exact_rank(spark.read.parquet(f"{tmp_path}/in"), ["k", "n"], ["p"])
    assert [r["rank"] for r in ranked.orderBy("p").collect()] == list(range(1, 5001))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert f"{tmp_path}/in" not in plan  # only the written ranges are read again
    assert len({f.rsplit("/", 1)[-1][:10] for f in ranked.inputFiles()}) > 1  # one file per range


def test_top_rows_cuts_groups_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = top_rows(df, ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_first_row_settles_ties_by_all_columns(spark):
    df = spark.createDataFrame([("a", 1, "z"), ("a", 1, "b"), ("a", 2, "a")], "k string, o int, v string")
    assert rows(first_row(df, ["k"], [F.col("o")]), "k", "o", "v") == [("a", 1, "b")]


def test_multiset_hash_ignores_order_and_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i int, t string")
    h = lambda d: multiset_hash(d, ["i", "t"]).first().content_hash
    assert h(a) == h(b) != h(a.union(a.limit(1)))


# --------------------------------------------------------------------- catalog
def test_merge_quarantines_repeated_new_models(spark):
    old = spark.createDataFrame([("1", "a", True), ("2", "b", True), ("3", "c", False)], "model string, name string, active boolean")
    new = spark.createDataFrame([("1", "x", 1), ("1", "y", 2), ("9", "p", 3), ("9", "q", 4), ("8", "n", 5), (" ", "s", 6)], "model string, name string, row_no int")
    merged = C.merge_catalog(old, new)
    assert rows(merged, "model", "action", "name", "active") == [
        ("1", "updated", "y", True), ("2", "inactivated", "b", False), ("3", "unchanged", "c", False),
        ("8", "inserted", "n", True), ("9", "quarantined", "q", False),
    ]
    got = C.ingest_result(merged, new).first().asDict()
    assert got == {"imported": 5, "inserted": 1, "updated": 2, "quarantined": 2, "inactive_or_missing": 1, "skipped_invalid": 1}


def test_descending_sort_puts_missing_prices_first(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0)], "product_id int, price double")
    assert [r.product_id for r in C.catalog_page(df, 1, 9, "price", True).collect()] == [2, 3, 1]
    assert [r.product_id for r in C.catalog_page(df, 1, 9, "price").collect()] == [1, 3, 2]


def test_leading_zeros_are_another_model(spark):
    a = spark.createDataFrame([("005606",), ("5606",), ("",)], "model string")
    assert rows(C.exclude_models(a, a.where("model = '5606'")), "model") == [("",), ("005606",)]


# -------------------------------------------------------------------- listings
def listings(spark, data):
    return spark.createDataFrame([(1, s, D(p), u, i) for i, (s, p, u) in enumerate(data)], "product_id int, store string, price decimal(12,2), url string, seq int")


def test_listing_dedupe_prefers_a_url_and_keeps_blank_stores_apart(spark):
    df = listings(spark, [("A", "10", ""), ("a", "10", "u1"), ("A", "10", "u2"), ("", "10", "x"), ("", "10", "y"), ("", "10", "X"), ("B", "0", "z")])
    got = rows(L.rank_listings(df, ["product_id"], ["seq"]), "rank", "store", "url")
    assert got == [(1, "", "x"), (2, "", "y"), (3, "a", "u1")]


def test_own_price_equal_to_best_uses_the_next_store(spark):
    df = listings(spark, [("A", "100", "a"), ("B", "105", "b"), ("C", "107", "c"), ("D", "109", "d")])
    best = L.best_and_next(df, ["product_id"], ["seq"]).withColumns({"model": F.lit("123456"), "current_price": F.lit(D("100.03")).cast("decimal(12,2)")})
    r = O.review_rows(best).first()
    assert (r.delta_basis, r.price_delta, r.recommended_action, r.captured_listings_count) == ("next_store", D("-4.97"), "match_price", 4)


def test_offer_rank_of_the_shop_wins_when_any_offer_has_one(spark):
    df = spark.createDataFrame([(1, "a", D(5), None, 1), (1, "b", D(9), 1, 2), (2, "a", D(5), 0, 3), (2, "b", D(4), None, 4)], "s int, seller_name string, price decimal(12,2), raw_rank int, offer_id int")
    assert rows(L.rank_offers(df, ["s"], ["offer_id"]), "s", "rank", "offer_id") == [(1, 1, 2), (1, 2, 1), (2, 1, 4), (2, 2, 3)]


def test_raw_payload_shapes(spark):
    data = [
        (1, '{"offers":[{"shop":"A","finalPrice":"10,50 €"},{"shop":"Z","price":"0"}]}'), (2, '{"store_1":"B","price_1":"7","url_1":"u"}'),
        (3, '{"x":{"shops":[{"merchantName":"C","amount":3.5,"shipping":"1"}]}}'), (4, "{bad"), (5, None), (6, '[{"title":"D","value":"2"}]'),
    ]
    got = rows(L.raw_listings(spark.createDataFrame(data, "id int, raw_observation string")), "id", "store", "price")
    assert got == [(1, "A", D("10.50")), (2, "B", D("7.00")), (3, "C", D("3.50")), (6, "D", D("2.00"))]


# ---------------------------------------------------------------------- alerts
RULES = "rule_id int, rule_type string, product_id int, catalog_source string, model string, mpn string, threshold_amount decimal(12,2), threshold_percent decimal(12,4), active boolean"
OBS = "observation_id int, run_id string, catalog_source string, source string, model string, mpn string, product_id int, competitor_price decimal(12,2), own_price decimal(12,2)"


def alert_frames(spark):
    kind = "competitor_below_own_price"
    rules = spark.createDataFrame(
        [(1, kind, 7, "main", "zzz", None, None, None, True), (2, kind, None, "main", "000007", None, D(5), None, True),
         (3, kind, None, "main", None, "M7", D(5), D(7), True), (4, kind, 7, None, None, None, None, D(5), True), (5, kind, 7, None, None, None, None, None, False)], RULES)
    obs = spark.createDataFrame(
        [(1, "r", "main", "a", "000007", "M7", 7, D(94), D(100)), (2, "r", "main", "b", "000007", "M7", 7, D(101), D(100)), (3, "r", "main", "c", "000007", "M7", 7, None, D(100))], OBS)
    return rules, obs


def test_alert_thresholds_are_anded_and_a_rerun_adds_nothing(spark):
    rules, obs = alert_frames(spark)
    none = spark.createDataFrame([], "dedupe_key string")
    events = O.new_alert_events(obs, rules, none)
    assert rows(events, "rule_id") == [(1,), (2,), (4,)]  # rule 3 wants 7 percent as well
    assert O.new_alert_events(obs, rules, events).count() == 0
    again = O.alert_evaluation(obs, rules, events).first()
    assert (again.created_event_count, again.duplicate_event_count) == (0, 3)


def test_actions_are_checked_and_rounded_half_up(spark):
    review = spark.createDataFrame([("000001", D("10.00"), "review_required"), ("000002", None, "not_exportable"), ("1-2", D("5"), "review_required")], "model string, competitor_price decimal(12,2), status string")
    acts = [("000001", "undercut", D("0.015")), ("000002", "match_price", None), ("1-2", "match_price", None), ("9", "ignore", None), ("000002", "ignore", None)]
    actions = spark.createDataFrame(acts, "model string, selected_action string, undercut_amount decimal(12,4)")
    checked = O.check_actions(actions, review)
    assert {(r.model, r.reject_reason) for r in checked.collect()} == {
        ("000001", None), ("000002", "duplicate action"), ("1-2", "non-atomic model"), ("9", "unknown model")}
    assert rows(O.apply_actions(review, checked).where("target_price IS NOT NULL"), "model", "target_price", "status") == [("000001", D("9.99"), "exportable")]


# -------------------------------------------------------------------- registry
def test_ambiguous_mpn_is_no_match_but_observations_take_the_lowest_id(spark):
    cat = spark.createDataFrame([(1, "main", "000001", "M", True), (2, "main", "000002", "M", True)], "product_id int, catalog_source string, model string, mpn string, active boolean")
    ev = spark.createDataFrame([("", "M"), ("000002", "M"), ("000001;000002", "x"), ("", "")], "model string, mpn string")
    got = [(r.match_type, r.resolved_id) for r in R.resolve_for_import(ev, cat).orderBy("model", "mpn").collect()]
    assert sorted(got, key=str) == sorted([("ambiguous_mpn", None), ("model", 2), ("unresolved", None), ("missing_identity", None)], key=str)
    obs = spark.createDataFrame([("main", None, "M")], "catalog_source string, model string, mpn string")
    assert O.match_observations(obs, cat).first().matched_product_id == 1


def url_row(status, kind="imported", ok=None):
    return ("shop", "x.gr", "http://x.gr/a", kind, "import", "imported", status, "2024-01-02", ok, None, None)


@pytest.mark.parametrize(
    "old, new, want",
    [
        (url_row("disabled"), url_row("active", ok="2024-01-03"), "disabled"), (url_row("broken"), url_row("active"), "broken"),
        (url_row("broken"), url_row("active", ok="2024-01-03"), "active"), (url_row("needs_review"), url_row("active"), "active"),
        (url_row("active"), url_row("needs_review"), "active"),
    ],
)
def test_imported_url_status_rules(spark, old, new, want):
    schema = "product_id int, url_normalized string, " + ", ".join(f"{c} string" for c in R.MERGE_FIELDS)
    frame = lambda r: spark.createDataFrame([(1, "http://x.gr/a", *r)], schema)
    assert R.merge_imported_urls(frame(old), frame(new)).first().status == want


def test_manual_origin_is_kept_and_equal_rows_are_duplicates(spark):
    schema = "product_id int, url_normalized string, " + ", ".join(f"{c} string" for c in R.MERGE_FIELDS)
    frame = lambda r: spark.createDataFrame([(1, "http://x.gr/a", *r)], schema)
    r = R.merge_imported_urls(frame(url_row("active", "manual")), frame(url_row("active"))).first()
    assert (r.url_type, r.action, r.changed_fields) == ("manual", "duplicate", [])


# --------------------------------------------------------------------- matching
def test_name_similarity_equals_the_sequence_matcher(spark):
    pairs = [("Steel kettle 2000w red", "Red steel kettle 2000w Braun"), ("Steel kettle", "Gas oven"), ("one", "one"), ("alpha beta gamma delta", "alpha beta")]
    df = spark.createDataFrame(pairs, "n string, t string")
    for r in K.name_similarity(df, "n", "t", "s").collect():
        a, b = r.n.lower().split(), set(r.t.lower().split())
        hit = [w for w in a if w in b]
        seq = difflib.SequenceMatcher(None, r.n.lower(), r.t.lower()).ratio()
        share = len(hit) / len(a)
        weak = len(hit) < 2 or (share < 0.35 and seq < 0.55)
        assert r.s == (0.0 if weak else round(0.75 * share + 0.25 * seq, 4))


def nearest_texts(key):
    """Nearest other row of every row by the ratio of all pairs, smallest key of equal ones."""
    want = {}
    for m, t in key.items():
        best = (0.0, None)
        for o, u in sorted(key.items()):
            if o != m and t and u:
                s = difflib.SequenceMatcher(None, t, u).ratio()
                best = (s, o) if s > best[0] else best
        want[m] = (best[1], round(best[0], 4), "fail" if best[0] >= 0.9 else "warn" if best[0] >= 0.8 else "pass")
    return want


def similar_of(spark, texts):
    df = spark.createDataFrame(texts, "model string, name string")
    key = {r.model: r.k for r in df.select("model", Q.catalog_text_key(F.col("name")).alias("k")).collect()}
    return {r["key"]: (r["nearest"], r["score"], r["band"]) for r in Q.similar_texts(df, "model", "name").collect()}, nearest_texts(key)


def test_similar_texts_equals_brute_force(spark):
    rng = random.Random(3)
    base = ["red kettle steel", "blue washer front load", "gas oven wide", "παλιό ψυγείο λευκό"]
    texts = []
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz ")
        texts.append((f"m{i:03d}", "".join(t) + rng.choice(["", " pro", " x1"])))
    texts += [(f"c{i}", "same copy text") for i in range(3)] + [("e", "")]
    got, want = similar_of(spark, texts)
    assert got == want


def test_similar_texts_of_every_ratio(spark):
    """Very short texts, texts like no other, letters only one text has, and ties."""
    rng = random.Random(8)
    texts = [(f"s{i:03d}", "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))) for i in range(60)]
    texts += [(f"w{i:03d}", " ".join(rng.choice(["zinc", "oak", "plum", "fir", "quartz", "jade"]) + rng.choice("stuvw") for _ in range(rng.randint(1, 5)))) for i in range(50)]
    texts += [("x1", "日本"), ("x2", "ω"), ("x3", "kkkkkkkkkkkkkkkkkkkkkkkkkkkkkk"), ("x4", None)]
    got, want = similar_of(spark, texts)
    assert got == want
    assert {w[2] for w in want.values()} == {"fail", "warn", "pass"} and min(w[1] for w in want.values()) == 0


def test_probes_are_far_fewer_than_pairs(spark):
    """Names of a catalog with a common vocabulary: rows are done at high bounds, on rare pairs of letters."""
    rng = random.Random(4)
    made = [f"{rng.choice(['steel', 'glass', 'black'])} kettle {rng.getrandbits(40):x} {rng.getrandbits(20):x}" for _ in range(300)]
    texts = [(i, t.translate(str.maketrans("0123456789", "ghijklmnop")) + end) for i, t in enumerate(made) for end in ("", "q")]
    bags = Q._text_parts(spark.createDataFrame([(t, len(t)) for _, t in texts], "text string, n int"))
    probes = Q._probes(bags, 0.9)
    met = probes.alias("x").join(probes.alias("y"), "token").where("x.text <> y.text").select("x.text", "y.text").distinct().count()
    assert 600 <= met < 600 * 600 / 10


@pytest.mark.parametrize("with_btu", [False, True])
def test_related_products_equals_brute_force_with_hot_groups(spark, with_btu):
    rng = random.Random(11)
    data = []
    for i in range(260):
        hot = i % 3 == 0
        data.append((f"{i:06d}", "HOT" if hot and i % 2 else rng.choice(["", "p", "q", f"u{i}"]), "b1" if hot else rng.choice(["b1", "b2", "b3"]),
                     "c1" if i % 2 else rng.choice(["c1", "c2", ""]), rng.choice(["", "", "s1", "s2"]), rng.choice(["1", "1", "0"]),
                     rng.choice(["", "9000", "9000", "12000"]) if with_btu and i > 100 else "9000" if with_btu else ""))
    df = spark.createDataFrame(data, "model string, mpn string, manufacturer string, category string, series string, status string, btu string")
    got = rows(Q.related_products(df if with_btu else df.drop("btu")), "model", "rank", "related_model", "reason")
    want = []
    for m, mpn, b, c, s, _, btu in data:
        ranked = []
        for m2, mpn2, b2, c2, s2, st, btu2 in data:
            if m2 == m or st == "0":
                continue
            ss, sb, sc = bool(s) and s == s2, b == b2, c == c2
            other = bool(btu) and btu != btu2 or mpn != mpn2
            if ss or sc:
                reason = "same_series" if ss else "same_brand_category" if sb else "comparable_category"
                ranked.append(((not ss, not sb, not other, m2), reason))
        for n, (k, reason) in enumerate(sorted(ranked)[:4], 1):
            want.append((m, n, k[3], reason))
    assert got == sorted(want)


def test_related_products_of_one_mpn_differ_by_capacity(spark):
    """Equal MPN: the one of another BTU goes before the one of the same, though its model is later."""
    df = spark.createDataFrame(
        [("000001", "m", "b", "c", "", "1", "9000"), ("000002", "m", "b", "c", "", "1", "9000"), ("000003", "m", "b", "c", "", "1", "12000")],
        "model string, mpn string, manufacturer string, category string, series string, status string, btu string")
    got = {(r.model, r.rank): r.related_model for r in Q.related_products(df).collect()}
    assert got[("000001", 1)] == "000003" and got[("000001", 2)] == "000002"


def test_repeated_phrases(spark):
    docs = spark.createDataFrame([(1, "quiet strong motor and a quiet strong motor here"), (2, "quiet strong motor " + "filler words follow " * 0 + "one two"), (3, "big red box. Big red box!")], "id int, t string")
    assert rows(Y_repeated(docs), "id", "phrase") == [(1, "quiet strong motor")]


def Y_repeated(docs):
    from shelfspark.functions.copy import repeated_phrases

    return repeated_phrases(docs, "id", "t", ["with"])


def test_score_gate_is_strict(spark):
    base = {"product_id": 1, "source_name": "s", "mpn": "AB1234", "name": "Oven", "title": "t", "canonical_url": "http://x/a", "requested_url": "http://x/a",
            "evidence_text": "", "mpn_found": True, "brand_found": True, "model_found": False, "title_similarity": 0.0, "category_compatible": False, "mpn_source": "title",
            "evidence_source": "fetched_page", "source_type": "shop", "price_compatible": False, "title_only": False, "blocked": False, "error_code": "", "valid_url": True}
    r = K.score_candidates(spark.createDataFrame([base])).first()
    assert (r.confidence, r.match_status) == (0.9, "needs_review")
    ok = dict(base, price_compatible=True)
    assert K.score_candidates(spark.createDataFrame([ok])).first().match_status == "matched"
    two = K.score_candidates(spark.createDataFrame([ok, ok])).collect()
    assert {x.match_status for x in two} == {"needs_review"}


# ------------------------------------------------------------------- attributes
def test_taxonomy_blocking_loses_no_scored_path(spark):
    paths = spark.createDataFrame([("A > Washers > Front", "A", "Washers", "Front", "http://x/a"), ("A > Dryers > -", "A", "Dryers", None, "http://x/d"), ("B > Kettles > Steel kettle", "B", "Kettles", "Steel kettle", "http://x/k")],
                                  "path string, parent string, leaf string, sub string, url string")
    prods = spark.createDataFrame([(1, ["Home", "A", "Washers", "Front"], "http://s/x", "washer front", ""), (2, ["Home"], "http://s/k", "kettle", ""), (3, ["Home"], "http://s/zz", "zzz", "")],
                                  "product_id int, breadcrumbs array<string>, url string, name string, evidence string")
    found = A.taxonomy_candidates(prods, paths)
    got = {(r.product_id, r.path.split(" > ")[1]): r.confidence for r in found.collect()}
    assert got[(1, "Washers")] == 3 + 4 + 5 + 4 + 0.5 + 1.5 + 2.0 and got[(2, "Kettles")] == 0.5 + 1.5 + 1.0
    res = {r.product_id: (r.path, r.reason) for r in A.resolve_taxonomy(prods, found).collect()}
    assert res[1][0] == "A > Washers > Front" and res[2] == (None, "low_confidence") and res[3] == (None, "no_candidates")


def test_alias_families_and_identity_conflict(spark):
    prods = spark.createDataFrame([(1, "000001", "air_conditioner"), (2, "000002", "other")], "product_id int, model string, family string")
    cands = [(p, v, "s", 0.8, "verified", n) for p in (1, 2) for n, v in enumerate(["A1/B1", "A1"])] + [(2, "000002", "x", 0.99, "verified", 9)]
    got = {r.product_id: (r.mpn, r.mpn_status) for r in A.resolve_identity(prods, spark.createDataFrame(cands, "product_id int, value string, source string, confidence double, status string, seq int")).collect()}
    assert got == {1: ("", "conflicting"), 2: ("A1", "verified")}


# --------------------------------------------------------------------- changes
def test_each_plan_row_has_one_class_and_protected_fields_are_blocked(spark):
    cur = spark.createDataFrame([("000001", "a", "10", "M1", "1")], "model string, name string, price string, mpn string, status string")
    new = spark.createDataFrame([("000001", "b", "11", "M2", "1", "verified")], "model string, name string, price string, mpn string, status string, mpn_status string")
    plan = X.field_plan(cur, new)
    got = {r.field: r.classification for r in plan.collect()}
    assert len(got) == plan.count() == len(X.FIELD_POLICIES)
    assert (got["name"], got["price"], got["mpn"], got["status"], got["category"]) == ("safe_content_update", "blocked", "blocked", "unchanged", "unavailable")


def test_plan_pairs_each_current_row_with_each_candidate_row_once(spark):
    cur = spark.createDataFrame([("1", "a", None), ("1", "b", "x"), ("2", "c", ""), (None, "d", "")], "model string, name string, mpn string")
    new = spark.createDataFrame(
        [("1", "a", "verified"), ("1", "n", "inferred"), ("2", "c", ""), (None, "d", "")], "model string, name string, mpn_status string")
    got = rows(X.field_plan(cur, new, ["name", "mpn"]).where("field = 'name'"), "model", "current_value", "candidate_value", "classification")
    safe = "safe_content_update"
    assert got == [("1", "a", "a", "unchanged"), ("1", "a", "n", safe), ("1", "b", "a", safe), ("1", "b", "n", safe), ("2", "c", "c", "unchanged")]
    assert X.field_plan(cur, new, ["name", "mpn"]).where("field = 'mpn' AND classification = 'unavailable' AND candidate_value IS NULL").count() == 5


def test_rollback_judges_each_row_once_against_repeated_models(spark):
    rollback = spark.createDataFrame(
        [("1", "name", "new", "old"), ("2", "name", "new", "old"), ("3", "name", None, "old"), ("4", "name", "new", "old"), ("1", "gone", "x", "y")],
        "model string, field string, expected_value string, restore_value string")
    now = spark.createDataFrame(
        [("1", "new", "p"), ("1", "new", "q"), ("1", "old", "p"), ("2", "old", ""), ("2", "other", ""), ("3", None, "")], "model string, name string, price string")
    got = rows(X.rollback_check(rollback, now), "model", "field", "action")
    assert got == [("1", "gone", "missing"), ("1", "name", "restore"), ("2", "name", "noop"), ("3", "name", "restore"), ("4", "name", "missing")]


def test_canary_covers_every_kind(spark):
    goals = X.CANARY_GOALS
    data = [(f"{i:06d}", *[bool((i >> g) & 1) for g in range(len(goals))]) for i in range(200)]
    df = spark.createDataFrame(data, "model string, " + ", ".join(f"{g} boolean" for g in goals))
    chosen = [r.model for r in X.propose_canary(df, 5).orderBy("place").collect()]
    assert chosen[0] == "000127" and len(chosen) == 5


# ------------------------------------------------------------------------ files
def test_headers_and_contracts(spark):
    df = spark.createDataFrame([("1", "2", "3")], "Model string, MPN string, price string")
    assert RD.resolve_headers(df, ["model", "mpn"]).columns == ["model", "mpn", "price"]
    with pytest.raises(RD.SourceError):
        RD.resolve_headers(df, ["name"])
    with pytest.raises(RD.SourceError):
        RD.detect_contract(["model"])
    assert RD.detect_contract(RD.CONTRACTS["skroutz"]) == "skroutz"


def test_csv_keeps_leading_zeros_quotes_and_bom(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('﻿model; name \n005606;"a;""b""\nline"\n', encoding="utf-8")
    r = RD.load_csv(spark, str(path), ["model", "name"]).collect()
    assert [(x.model, x.name) for x in r] == [("005606", 'a;"b"\nline')]


def test_batch_file_is_rejected_by_one_bad_row(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("model,brand,name\n1,b,n\n,b,n\n", encoding="utf-8")
    with pytest.raises(RD.SourceError, match="empty_model"):
        RD.require_clean(RD.read_batch_csv(spark, str(path)))


# ---------------------------------------------------------------------- streams
def test_alert_stream_raises_each_key_once(spark, tmp_path):
    rules, obs = alert_frames(spark)
    timed = obs.withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    src, out = str(tmp_path / "obs"), str(tmp_path / "out")
    for _ in range(2):
        timed.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(src)
    run = J.alert_events(stream, rules, "at").select("dedupe_key").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    none = spark.createDataFrame([], "dedupe_key string")
    assert rows(spark.read.parquet(out), "dedupe_key") == rows(O.new_alert_events(obs, rules, none), "dedupe_key")


def test_filter_values_found_by_keys_longer_than_the_listed_names(spark):
    cases = {"a": ("NoFrost", "full no frost system"), "b": ("Total NoFrost", "with total no frost inside"),
             "c": ("7", "load 7 kg max"), "d": ("7kg", "load 7 kg max"), "e": ("HD", "an hd ready panel")}
    products = spark.createDataFrame([(1, "c")], "product_id int, filter_category_id string")
    groups = spark.createDataFrame(
        [("c", g, f"Group {g}", False, "active") for g in cases],
        "category_id string, group_id string, group_name string, required boolean, status string")
    values = spark.createDataFrame(
        [(g, v, "active", None) for g, (v, _) in cases.items()], "group_id string, value string, status string, aliases array<string>")
    evidence = spark.createDataFrame(
        [(1, "source", f"Group {g}", t, n) for n, (g, (_, t)) in enumerate(cases.items())],
        "product_id int, kind string, label string, value string, seq int")
    got = rows(A.resolve_filter_values(products, groups, values, evidence), "group_id", "resolved_value", "outside_allowed")
    assert got == [(g, v, False) for g, (v, _) in sorted(cases.items())]


def test_filter_values_found_as_phrases_inside_a_text(spark):
    """One listed name inside the text decides, two leave it open; part of a word is no phrase."""
    cases = {"a": "very dark blue frame", "b": "dark blue or steel", "c": "steelwork", "d": "dark and blue", "e": "Dark Blue"}
    products = spark.createDataFrame([(i, "c") for i in range(len(cases))], "product_id int, filter_category_id string")
    groups = spark.createDataFrame([("c", "g", "Finish", False, "active")], "category_id string, group_id string, group_name string, required boolean, status string")
    values = spark.createDataFrame(
        [("g", "Dark blue", "active", []), ("g", "Steel", "active", ["inox"])], "group_id string, value string, status string, aliases array<string>")
    evidence = spark.createDataFrame(
        [(i, "source", "Finish", t, 1) for i, t in enumerate(cases.values())], "product_id int, kind string, label string, value string, seq int")
    got = rows(A.resolve_filter_values(products, groups, values, evidence), "product_id", "resolved_value", "outside_allowed")
    assert got == [(0, "Dark blue", False), (1, "dark blue or steel", True), (2, "steelwork", True), (3, "dark and blue", True), (4, "Dark blue", False)]


GOOD = {
    "brand": "Acme", "mpn": "AB-1/CD-2", "mpn_status": "verified", "mpn_scope": "complete_set", "components": ["AB-1", "CD-2"], "primary_model": "AB-1",
    "set_model": "ab - 1 / cd-2", "series": "Breeze", "warnings": [], "source": "maker", "csv_mpn": "ab-1/cd-2", "name": "Acme AB-1 set",
    "meta_title": "AB-1 by Acme", "seo_keyword": "acme-ab-1-set", "product_url": "https://x.example/p", "description_heading": "Acme Breeze",
    "structured": '{"@type":"Product","name":"n","brand":{"name":"ACME"},"sku":"000001","mpn":"AB-1/CD-2","url":"https://x.example/p","image":["i"]}',
    "feed": '{"id":"000001","brand":"acme","mpn":"ab-1/cd-2","identifier_mode":"mpn_only","price":{"value":"1","currency":"EUR"},"availability":"in_stock"}',
    "errors": [],
}


def profile(spark, changed, **how):
    row = {"model": "000001", **GOOD, **changed}
    kinds = {"components": "array<string>", "warnings": "array<string>", "errors": "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row)
    df = spark.createDataFrame([tuple(row.values())], schema)
    identity = df.select("model", "brand", "mpn", "mpn_status", "mpn_scope", "components", "primary_model", "set_model", "series", "warnings", "source")
    outputs = df.select("model", "csv_mpn", "name", "meta_title", "seo_keyword", "product_url", "description_heading")
    found = Q.artifact_profile(identity, outputs, df.select("model", "structured", "feed", "errors"), **how).collect()
    assert len(found) == 28 and sum(r.weight for r in found) == 20
    return found


@pytest.mark.parametrize("changed, failed", [
    ({}, set()),
    ({"mpn": None, "csv_mpn": ""}, {"identity.mpn_present", "identity.complete_set_preserved", "structured_data.mpn_matches_verified_identity", "feed.mpn_matches_verified_identity"}),
    ({"mpn_status": "conflicting"}, {"identity.mpn_verified", "identity.no_component_set_conflict", "structured_data.mpn_matches_verified_identity", "feed.mpn_matches_verified_identity"}),
    ({"warnings": ["complete_set_and_component_identifier_conflict"]}, {"identity.no_component_set_conflict"}),
    ({"components": ["AB-1", " "]}, {"identity.complete_set_preserved", "identity.component_models_preserved"}),
    ({"mpn_scope": "other"}, {"identity.mpn_scope_valid", "identity.complete_set_preserved"}),
    ({"seo_keyword": "acme-set"}, {"identity.consistent_across_outputs"}),
    ({"description_heading": "Acme other"}, {"identity.consistent_across_outputs"}),
    ({"source": None, "brand": ""}, {"identity.provenance_present", "identity.brand_present_phase3", "identity.consistent_across_outputs", "structured_data.brand_matches", "feed.brand_matches"}),
    ({"errors": ["forbidden_identifier:gtin"]}, {"structured_data.product_json_valid", "structured_data.forbidden_identifier_fields_absent", "feed.feed_json_valid", "feed.forbidden_identifier_fields_absent"}),
    ({"errors": ["feed_price"]}, {"feed.feed_json_valid"}),
    ({"structured": '{"@type":"Thing","name":"","brand":"x","sku":"2","mpn":"z","image":[],"offers":[]}'},
     {"structured_data." + c for c in ("schema_type_product", "name_present", "brand_matches", "sku_matches_internal_model", "mpn_matches_verified_identity", "url_matches_canonical", "images_present", "offer_consistent")}),
    ({"feed": '{"id":"2","price":{"value":"1","currency":"USD"},"availability":"soon"}'},
     {"feed." + c for c in ("id_matches_internal_model", "brand_matches", "mpn_matches_verified_identity", "identifier_mode_mpn_only", "price_and_availability_consistent")}),
])
def test_artifact_profile(spark, changed, failed):
    found = profile(spark, changed)
    assert {r.check for r in found if r.status == "fail"} == failed
    assert {r.check for r in found if r.blocks_publish} == failed - set(Q.ARTIFACT_ADVISORY)
    assert all(r.points == (r.weight if r.status == "pass" else 0) for r in found)


def test_artifact_profile_of_missing_and_switched_off_artifacts(spark):
    found = {r.check: r for r in profile(spark, {"structured": None, "mpn_status": "candidate", "feed": "not json"}, require_verified=False)}
    assert {r.status for c, r in found.items() if c.startswith("structured")} == {"not_run"}
    assert found["feed.feed_json_valid"].status == "fail" and found["identity.mpn_verified"].status == "warn"
    assert found["identity.mpn_verified"].points == 1
    off = profile(spark, {}, feed_enabled=False)
    assert {r.status for r in off if r.group == "feed"} == {"not_applicable"}


def test_a_payload_is_read_once_and_its_listings_field_names_are_reduced_once(spark):
    df = spark.createDataFrame([(1, '{"offers":[{"Shop Name":"a","final-price":"1,5 €"},{"price":"0"}],"store_2":"b","price_2":"2"}')], "id int, raw_observation string")
    found = L.raw_listings(df)
    assert rows(found, "id", "store", "listing_no") == [(1, "a", 1), (1, "b", 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]") == 1 and plan.lower().count("parsejson") <= 1


def test_lowest_tier_reads_each_source_once_and_drops_rows_without_a_key(spark):
    at = lambda *data: spark.createDataFrame(list(data), "p int, run string, store string")
    tiers = [at((1, "a", "x"), (None, "a", "n")), at((1, "a", "y"), (2, "a", "z"), (2, "a", "z"), (2, None, "n")), at((3, "a", "q"), (2, "b", None))]
    found = L.lowest_tier(tiers, ["p", "run"])
    assert found.columns == ["p", "run", "tier", "store"]
    assert rows(found.fillna("-", ["store"]), "p", "run", "tier", "store") == [(1, "a", 0, "x"), (2, "a", 1, "z"), (2, "a", 1, "z"), (2, "b", 2, "-"), (3, "a", 2, "q")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3


def test_products_in_which_the_paths_find_the_same_words_are_scored_once(spark):
    paths = spark.createDataFrame(
        [("Home > Washers > Slim", "Home", "Washers", "Slim", "https://x/home/washers"), ("Home > Kettles", "Home", "Kettles", None, "https://x/home/kettles")],
        "path string, parent string, leaf string, sub string, url string")
    data = [(i, ["Root", "Home", "Washers", "Slim"], f"https://s/home/{i}", f"washer number{i}", "none") for i in range(40)]
    data += [(40, ["Root"], "https://s/q/1", "odd", ""), (None, ["Home"], "https://s/home", "washer", ""), (41, None, "https://s/home", "washer", "")]
    products = spark.createDataFrame(data + data[:1], "product_id int, breadcrumbs array<string>, url string, name string, evidence string")
    t = A._with_rare_word(A.prepare_paths(paths))
    seen = A._taxonomy_profiles(products, t, [])
    assert seen.where("product_id < 40").select("_profile").distinct().count() == 1
    found = A.taxonomy_candidates(products, paths)
    best = A.taxonomy_candidates(products, paths, most=1)
    assert rows(found.where("product_id < 2"), "product_id", "path", "confidence") == sorted(
        [(i, "Home > Washers > Slim", 18.0) for i in (0, 0, 1)] + [(i, "Home > Kettles", 3.5) for i in (0, 0, 1)])
    assert rows(best, "product_id", "path") == sorted([(i, "Home > Washers > Slim") for i in (*range(40), 0)])


def test_pages_are_read_before_they_meet_the_catalog(spark):
    page = '<title>T</title><link rel="canonical" href="https://s/p/1"><h1>N</h1>'
    pages = spark.createDataFrame([("1", 200, "https://s/p/1", page), (None, 200, "", "")], "model string, status_code int, final_url string, html string")
    cols = ["model", "product_url", "canonical_url", "meta_title", "meta_description", "h1", "image", "price", "mpn"]
    expected = spark.createDataFrame([("1", "https://s/p/1", "", t, "", "N", "", "", "") for t in ("T", "U")], ", ".join(f"{c} string" for c in cols))
    found = X.page_checks(pages, expected)
    assert rows(found.where("check = 'live.title'"), "model", "status") == [("1", "fail"), ("1", "pass")]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "html#" not in above and found.count() == 18
