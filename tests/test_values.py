"""Column functions on literals: parsers, rounding, keys, URLs, categories."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import categories as G
from shelfspark.functions import copy as Y
from shelfspark.functions import money as M
from shelfspark.functions import text as S
from shelfspark.functions import urls as U
from shelfspark.functions import values as N
from shelfspark.functions.timefn import parse_timestamp
from shelfspark.operators import attributes as A
from shelfspark.operators import matching as K
from shelfspark.operators import pricing as P
from shelfspark.operators import quality as Q
from shelfspark.operators.monitoring import age_text
from shelfspark.operators.registry import sanitize_json


@pytest.mark.parametrize(
    "value, mode, want",
    [
        ("2.125", "keep_2dp", "2.12"), ("2.135", "keep_2dp", "2.14"), ("178.99", "floor", "178"), ("178.01", "ceil", "179"),
        ("178.50", "nearest", "179"), ("178.79", "minus_one_if_decimal_79_99", "178"), ("178.99", "minus_one_if_decimal_79_99", "178"),
        ("178.78", "minus_one_if_decimal_79_99", "179"), ("178.995", "minus_one_if_decimal_79_99", "179"), ("178.40", "minus_one_if_decimal_79_99", "178"),
    ],
)
def test_rounding_modes(one, value, mode, want):
    assert one(P.round_price(F.lit(D(value)), mode)) == want


def test_negative_price_is_clamped_before_rounding(spark):
    rule = {"rule_family": "fixed_offset", "offset": -500, "rounding_mode": "minus_one_if_decimal_79_99"}
    row = spark.createDataFrame([(D("450.21"),)], "p decimal(12,2)").select(P.new_price(rule, "p").alias("x")).first()
    assert row.x == "0"


def test_formula_checks_its_text(spark):
    df = spark.createDataFrame([(D("100.00"),)], "p decimal(12,2)")
    rule = {"rule_family": "formula_with_rounding", "formula": "-(observed_price / 4) + 2 * 30.5", "rounding_mode": "keep_2dp"}
    assert df.select(P.new_price(rule, "p").alias("x")).first().x == "36.00"
    for bad in ("observed_price ** 2", "price + 1", "observed_price; 1", "__import__('os')", "", "observed_price // 2"):
        with pytest.raises(ValueError):
            P.formula_column(bad, "p")


def test_store_positioning(spark):
    rule = {"rule_family": "bestprice_store_positioning", "own_store": "Ours", "target_gap": "0.1", "min_gap": "0.05", "max_gap": "5", "rounding_mode": "keep_2dp"}
    rows = [("OURS ", D("10"), D("12"), "10.00"), ("ours", D("10"), D("30"), "29.90"), ("ours", D("10"), None, "10.00"), ("them", D("10"), D("12"), "9.90")]
    df = spark.createDataFrame([r[:3] for r in rows], "s string, b decimal(12,2), n decimal(12,2)")
    price = P.new_price(rule, "b", best_store=F.col("s"), best_price=F.col("b"), next_price=F.col("n"))
    assert [r.x for r in df.select(price.alias("x")).collect()] == [r[3] for r in rows]


@pytest.mark.parametrize("text, want", [("1.234,56 €", "1234.56"), ("12", "12"), ("1234,5", None), ("12.34", None), ("EUR 9,99", "9.99"), ("", None)])
def test_greek_money(one, text, want):
    got = one(M.greek_money(F.col("t")), t=text)
    assert got == (D(want) if want else None)


@pytest.mark.parametrize("text, want", [("178.99", "178.99"), ("178,99", None), ("1e3", None), ("+5", None), ("-1", None), ("NaN", None), (" 7 ", "7"), ("", None)])
def test_dot_decimal(one, text, want):
    got = one(M.dot_decimal(F.col("t")), t=text)
    assert got == (D(want) if want else None)


def test_dot_decimal_error_texts(one):
    assert one(M.dot_decimal_error(F.lit(" "))) == "missing required row value: price"
    assert one(M.dot_decimal_error(F.lit("1,5"))) == "invalid input price format"
    assert one(M.dot_decimal_error(F.lit("1.5"))) == ""


def test_last_price_in_text(one):
    assert one(M.last_euro_price(F.lit("από 1.299,90 € τώρα 1.199"))) == 1199.0
    assert one(M.last_euro_price(F.lit("κωδικός"))) is None


def test_final_sigma_and_sharp_s(one):
    assert one(S.fold_case(F.lit("ΚΑΛΟΣ Größe"))) == "καλοσ grösse"
    assert one(S.product_text_key(F.lit(" Ψυγείο  ΘΕΡΜΟΣ! "))) == "psygeio thermos"


def test_accents_by_table(one):
    assert one(S.strip_accents(F.lit("ΐΰάέήίόύώ ÀÉîõü Ἀ"))) == "ιυαεηιουω AEiou Α"


def test_tokens_and_search_queries(one):
    assert one(S.product_tokens(F.lit("Σκούπα Miele Κόκκινη x me HX1"))) == ["red", "hx1"]
    got = one(S.search_queries(F.lit("Gadget abcd1 12345"), "P"))
    assert got == ["Gadget abcd1 12345", "P gadget", "P gadget abcd1"]


def test_meta_title_drops_by_priority(one):
    s = lambda v, r, p: F.struct(F.lit(v).alias("value"), F.lit(r).alias("required"), F.lit(p).alias("priority"))
    parts = F.array(s("Brand", True, 0), s("x" * 20, False, 2), s("y" * 20, False, 1), s("brand", False, 3), s("M1", True, 0))
    assert one(S.meta_title(parts, " | Shop", 36)) == "Brand " + "y" * 20 + " M1 | Shop"
    assert one(S.meta_title(parts, " | Shop", 10)) == "Brand M1 | Shop"


def test_keyword_fits_length(one):
    parts = F.array(F.lit("Ψυγείο"), F.lit("ABC 1"), F.lit("abc-1"), F.lit("last"))
    assert one(S.seo_keyword_from_parts(parts)) == "psygeio-abc-1-last"
    assert one(S.seo_keyword_from_parts(parts, 14)) == "psygeio-abc-1"


@pytest.mark.parametrize(
    "url, registry, capture",
    [
        ("HTTPS://User@Shop.GR:443/A/b/?utm_source=x&b=2&a=%20#top", "https://shop.gr:443/A/b/?b=2&a=+", "https://shop.gr:443/A/b?b=2&a=+"),
        ("http://x.gr", "http://x.gr", "http://x.gr"), ("http://x.gr/", "http://x.gr/", "http://x.gr"),
        ("http://x.gr/?flag&GCLID=1", "http://x.gr/?flag=", "http://x.gr?flag="), ("ftp://x.gr/a", None, None), ("", None, None), ("http://x.gr:ab/", None, None),
    ],
)
def test_url_forms(one, url, registry, capture):
    assert one(U.normalize_url(F.col("u")), u=url) == registry
    assert one(U.canonical_url(F.col("u")), u=url) == capture


def test_product_url_shape(one):
    check = lambda u: one(U.is_product_url(F.lit(u), F.lit("www.s.gr"), F.lit("/p/[0-9]+"), F.lit("/p/9")))
    assert check("https://s.gr/p/1?x=1") and not check("https://s.gr/p/9") and not check("https://t.gr/p/1")
    assert not check("https://www.s.gr/p/1/review") and not check("https://www.s.gr/promo/p/1")


def test_category_levels(one):
    assert one(G.deepest_levels(F.lit("A:::A///B:::C///D"))) == ["C", "D"]  # the last of equal depth
    assert one(G.deepest_paths(F.lit("A///B:::C///D"))) == ["A > B", "C > D"]
    assert one(G.deepest_levels(F.lit(None).cast("string"))) == []
    assert one(G.serialize_category(F.lit("A"), F.lit(""), F.array(F.lit("x")))) == ""


def test_mojibake(one):
    damaged = "Ψυγείο μαύρο".encode("utf-8").decode("cp1253", errors="ignore")
    assert one(Y.repair_mojibake(F.lit("Ξ±Ξ²Ξ³"))) == "αβγ"
    assert one(Y.repair_mojibake(F.lit("Ψυγείο"))) == "Ψυγείο"
    assert damaged != "Ψυγείο μαύρο"


def test_label_value_pairs(one):
    got = one(Y.label_value_pairs(F.lit("Color: red Weight: 5 kg. COLOR: red. Model: X. 12: 5. Note: -")))
    assert [(p.label, p.value) for p in got] == [("Color", "red"), ("Weight", "5 kg")]


def test_section_class(one):
    def kind(body, title="t", image=""):
        m = Y.text_metrics(F.lit(body))
        return one(Y.section_class(F.lit(title), F.lit(body), F.lit(image), F.lit(""), m)["reason"])

    long = "This panel keeps every dish clean while the quiet motor saves energy and water for all families who cook at home with many large pots and pans daily"
    assert kind(long) == "usable_clean" and kind(long, title="") == "weak_missing_title"
    assert kind("few words") == "missing_empty_after_clean" and kind("", image="i") == "missing_image_only"
    assert kind("spam spam spam spam eggs cheese bread milk butter honey") == "weak_noisy_body"


def test_lint_flags(one):
    flags = one(Y.lint_flags(F.lit("Oven X1 is an oven. Use X1 and X1."), F.lit("X1"), F.lit("oven"), F.array(F.lit("x1"))))
    assert flags == ["authoring_duplicate_prose_subject", "authoring_duplicate_category", "authoring_duplicate_identifier_phrase"]


def test_value_keys(one):
    assert one(N.value_alias_keys(F.lit("50 Watts")))[:3] == ["50 watt", "50watt", "50 w"]
    assert one(N.energy_class(F.lit("(Α+++)"))) == "A+++"
    assert one(N.energy_class_in_text(F.lit("Κλιματιστικό A/B 9000 Α++"))) == "A++"
    assert one(N.btu_in_text(F.lit("split 12.000 btu"))) == "12000 BTU"


def test_codes_and_variants(one):
    assert one(K.product_codes(F.lit("Bosch WAN28163GR + SMS-25 set ab-12"))) == ["WAN28163GR", "SMS25"]
    assert one(K.split_unit_mpn(F.lit("FTXM35R/RXM35R-EU"))) == "FTXM35R-EU/RXM35R-EU"


def test_identifier_search(one):
    assert one(K.identifier_fragment(F.lit("WAN-28 163"), F.lit("the wan-28  163!"))) == "wan-28  163"
    assert one(K.identifier_fragment(F.lit("WAN-28163"), F.lit("code WAN 28163 GR"))) == "WAN-28163"
    assert one(K.identifier_fragment(F.lit("W1"), F.lit("W12"))) == ""


def test_composite(one):
    def reason(title, mpn="AB1234", name="Oven"):
        c = K.composite_mismatch(F.lit(mpn), F.lit(name), F.lit(True), F.array(F.lit(title)))
        return one(c["reason"])

    assert reason("Oven AB1234 + CD5678") == "candidate_contains_expected_identifier_with_extra_identifier"
    assert reason("Oven AB1234 with hob CD5678") == "candidate_contains_expected_identifier_with_extra_identifier"
    assert reason("Φούρνος AB1234 με εστίες") == "candidate_contains_composite_phrase"
    assert reason("Oven AB1234 set CD5678") == "candidate_contains_bundle_marker_with_extra_identifier"
    assert reason("Oven AB1234") == "" and reason("Oven AB1234 + CD5678", name="Set oven CD5678") == ""


def test_identity_values(one):
    assert one(A.mpn_display(F.lit("MPN: kx–1 / b2;"))) == "kx-1/b2"
    assert one(A.mpn_display(F.lit("N/A"))) == "" and one(A.mpn_match_key(F.lit("kx - 1"))) == "KX-1"


def test_fuzzy_label_score(one):
    score = lambda a, b: one(A.fuzzy_label_score(F.lit(a), F.lit(b)))
    assert score("Net weight kg", "net weight") == 110
    assert score("Χρώμα πόρτας", "χρώμα") == 105 and score("Power", "cord") == 0


def test_json_is_cleaned_at_any_depth(one):
    payload = '{"a":[{"authToken":1,"b":{"Session_Id":2,"c":3}}],"d":"x"}'
    assert one(sanitize_json(F.lit(payload))) == '{"a":[{"b":{"c":3}}],"d":"x"}'


def test_times(one):
    assert str(one(parse_timestamp(F.lit("2024-01-02T03:04:05Z")))) == "2024-01-02 03:04:05"
    assert one(parse_timestamp(F.lit("soon"))) is None
    assert [one(age_text(F.lit(s))) for s in (45, 65, 3700, 97200)] == ["45s", "1m 5s", "1h 1m", "1d 3h"]


@pytest.mark.parametrize(
    "text, issues",
    [
        ("Γάλα φρέσκο", []), ("ΜΑΓΕΙΡΙΚΗ ΓΩΝΙΑ", []), ("Γ", []), ("Γƒx", ["mojibake_pattern"]), ("Γ‚ ", ["mojibake_pattern"]),
        ("Γ\u008ex", ["c1_control_character", "mojibake_pattern"]), ("ΓΆβ‚¬™", ["mojibake_pattern"]), ("Γƒ", []), ("Γƒ\n", []),
        ("what???", ["question_mark_run"]), ("http://x/???", []), ("�", ["replacement_character"]),
    ],
)
def test_text_issues(one, text, issues):
    assert one(S.text_issues(F.lit(text))) == issues


@pytest.mark.parametrize(
    "label, value, category, unit",
    [
        ("Όγκος", "5lt", "", "Lt"), ("Πόδια", "12cm", "", "cm"), ("Πόδια", "12 cm", "", "cm"), ("Volt", "230", "", "V"),
        ("Χωρητικότητα", "8", "Πλυντήρια", "kg"), ("Χωρητικότητα", "300", "Καταψύκτες", "Lt"), ("Χωρητικότητα", "8", "", ""),
        ("Χρώμα", "λευκό", "Ψυγεία", ""),
    ],
)
def test_units(one, label, value, category, unit):
    assert one(N.unit_of(F.lit(label), F.lit(value), F.lit(category))) == unit


@pytest.mark.parametrize("text, found", [("ψυγείο a++ inverter", "A++"), ("fridge α+", "A+"), ("δ+ γ", "D+"), ("TV G/F", ""), ("plus", "")])
def test_energy_class_in_either_case(one, text, found):
    assert one(N.energy_class_in_text(F.lit(text))) == found


@pytest.mark.parametrize(
    "text, fixed", [("Ξ±Ξ²Ξ³ kettle", "αβγ kettle"), ("Γάλα", "Γάλα"), ("Ξ±", "Ξ±"), ("plain", "plain"), ("αβγ ™", "αβγ ™"), ("日本", "日本")],
)
def test_repair_of_a_wrong_code_page(one, text, fixed):
    assert one(Y.repair_mojibake(F.lit(text))) == fixed


@pytest.mark.parametrize(
    "text, found",
    [("split 12.000 btu", "12000 BTU"), ("9 000BTU/h", "9000 BTU"), ("24000 btu inverter", "24000 BTU"), ("x12.000 btu", ""), ("123 456 btu", ""),
     ("1.12.000 btu", "12000 BTU"), ("btu 9000", ""), ("9000 btux, 18000 BTU", "18000 BTU"), ("12,000 btu", ""), ("900 btu", ""), ("", ""), ("12\t000 btu", "12000 BTU"), ("x9000 btu", "")],
)
def test_btu_in_text(one, text, found):
    assert one(N.btu_in_text(F.lit(text))) == found


@pytest.mark.parametrize(
    "text, found",
    [("A++ / A+", "A++"), ("X/A+", "A+"), ("A/B/C+", "C+"), ("X/A/B+", "A"), ("SEER A+++, SCOP A+", "A+++"), ("AA++", ""), ("A++++", ""), ("9A++", "A++"), ("E", "E"), ("class Ζ", "F")],
)
def test_energy_class_tokens(one, text, found):
    assert one(N.energy_class_in_text(F.lit(text))) == found


@pytest.mark.parametrize(
    "text, key",
    [("Bosch WAN28163GR, 8kg", "bosch <model> <model>"), ("AC 12.000 BTU white", "ac <capacity> white"), ("AC 9 btu/12 btu", "ac 9 <model> btu"),
     ("-ab1- x1 1234", "<model> x1 1234"), ("12.0000 btu", "12 0000 btu"), ("κλιματιστικό 18,000 btu FTXM-35", "κλιματιστικο <capacity> <model>"),
     ("", ""), ("plain words only", "plain words only"), ("1 12.000 btu", "1 <capacity>")],
)
def test_catalog_text_key(one, text, key):
    assert one(Q.catalog_text_key(F.lit(text))) == key
