"""Attribute resolution: taxonomy, templates, filter values, specs, names, identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.categories import deepest_paths, stable_id
from shelfspark.functions.common import bind, empty_texts, texts
from shelfspark.functions.text import (
    label_key, match_key, normalize_spaces, null_dashes, trim_text, words,
)
from shelfspark.functions.values import value_alias_keys
from shelfspark.operators.catalog import labels
from shelfspark.operators.skew import first_row, last_row, top_rows
from shelfspark.session import written

# ---------------------------------------------------------------- fixed values
FUZZY_SINGLE_WORDS = [
    "βαθος", "διαμετρος", "ισχυς", "καναλια", "κιλα", "πλατος", "προτυπα", "συνδεσιμοτητα",
    "ταση", "υψος", "χωρητικοτητα", "χρωμα",
]
FUZZY_DENIED_WORDS = ["τυπος"]
ARTICLES = {"fem": "Η", "neut": "Το", "masc": "Ο"}
MPN_PLACEHOLDERS = ["-", "n/a", "na", "none", "unknown", "not available", "tbd"]
MPN_LABEL = (
    "(?iu)^\\s*(?:mpn|model|manufacturer\\s+model|product\\s+model|κωδικός\\s+μοντέλου)\\s*[:#-]?\\s*"
)
MPN_SCOPES = ["complete_product", "complete_set", "single_unit", "indoor_unit", "outdoor_unit", "component"]
EVIDENCE_TIERS = {
    "approved_review": 0, "derived": 1, "source": 2, "manufacturer": 4, "description": 6, "normalized": 8,
}


# ------------------------------------------------------------------- taxonomy
def _soft_keys(tokens: Column, side: str) -> Column:
    """Join keys that a path word and a name word share exactly when they are softly equal.

    Softly equal are equal words, one the start of the other, or six first letters in common:
    six first letters meet six first letters; a word shorter than six meets the starts
    of longer words, from either side.
    """
    starts = lambda t: F.transform(
        F.sequence(F.lit(1), F.least(F.length(t), F.lit(5))), lambda n: F.substring(t, F.lit(1), n)
    )
    own, other = ("L", "N") if side == "path" else ("N", "L")

    def keys(t: Column) -> Column:
        whole = F.when(F.length(t) < 6, F.array(F.concat(F.lit(own + ":"), t))).otherwise(
            F.array(F.concat(F.lit("6:"), F.substring(t, 1, 6)))
        )
        return F.concat(whole, F.transform(starts(t), lambda s: F.concat(F.lit(other + ":"), s)))

    return F.array_distinct(F.flatten(F.transform(tokens, keys)))


def prepare_paths(paths: DataFrame) -> DataFrame:
    """Taxonomy paths with their match keys and word lists."""
    keyed = paths.select(
        "path", "parent", "leaf", "sub",
        match_key(F.col("parent")).alias("parent_key"),
        match_key(F.col("leaf")).alias("leaf_key"),
        match_key(F.coalesce("sub", F.lit(""))).alias("sub_key"),
        match_key(F.col("path")).alias("path_key"),
        F.array_distinct(words(match_key(F.col("url")))).alias("url_words"),
    )
    return keyed.withColumns(
        {
            "leaf_words": F.array_distinct(words(F.col("leaf_key"))),
            "sub_words": F.array_distinct(words(F.col("sub_key"))),
        }
    )


def _with_rare_word(paths: DataFrame) -> DataFrame:
    """Adds the word of the sub-category that fewest paths use.

    A crumb that holds all words of a sub-category holds this one, so it is enough to meet on.
    """
    used = paths.select("path", F.explode("sub_words").alias("_word"))
    counts = used.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    rare = used.join(counts, "_word").groupBy("path").agg(
        F.min_by("_word", F.struct("_n", "_word")).alias("rare_word")
    )
    return paths.join(rare, "path", "left")


def _taxonomy_profiles(products: DataFrame, t: DataFrame, rule_words: Sequence[str]) -> DataFrame:
    """Each product row with what the paths ``t`` can see of it, under the name ``_profile``.

    That is the crumbs, words and crumb path that some path has too, the path words its name is
    softly equal to, and the rule words in its evidence. All products of one profile score alike.
    """
    p = products.where("product_id IS NOT NULL").select(
        "product_id",
        F.filter(F.transform("breadcrumbs", match_key), lambda c: c != "").alias("crumbs"),
        F.array_distinct(words(match_key(F.regexp_replace("url", "^[a-z]+://[^/]*", "")))).alias("url_words"),
        F.array_distinct(words(match_key(F.col("name")))).alias("name_words"),
        F.array_sort(F.array_intersect(
            words(match_key(F.concat_ws(" ", "name", "url", "evidence"))), texts(*rule_words) if rule_words else empty_texts())).alias("evidence_words"),
        match_key(F.array_join(F.slice("breadcrumbs", 2, 3), " > ")).alias("crumb_path"),
    ).where("crumbs IS NOT NULL AND url_words IS NOT NULL AND name_words IS NOT NULL")
    p = p.withColumn("crumb_words", F.transform("crumbs", words)).withColumn("_row", F.md5(F.to_json(F.struct("*"))))
    tag = lambda name, arr: F.transform(arr, lambda x: F.concat(F.lit(name), x))
    full = F.when((F.size("crumbs") >= 3) & (F.col("crumb_path") != ""), F.array("crumb_path")).otherwise(empty_texts())
    asked = p.select("product_id", "_row", F.explode(F.array_distinct(F.concat(
        tag("c:", F.col("crumbs")), tag("x:", F.flatten("crumb_words")), tag("u:", F.col("url_words")), tag("p:", full),
        _soft_keys(F.col("name_words"), "name")))).alias("_key")).distinct()
    own = lambda name, arr: F.transform(arr, lambda x: F.struct(F.concat(F.lit(name), x).alias("key"), F.lit(name).alias("kind"), x.alias("text")))
    soft = F.flatten(F.transform(F.array_union("leaf_words", "sub_words"), lambda w: F.transform(
        _soft_keys(F.array(w), "path"), lambda k: F.struct(k.alias("key"), F.lit("n:").alias("kind"), w.alias("text")))))
    none = F.array().cast("array<struct<key:string,kind:string,text:string>>")
    listed = F.concat(*[F.coalesce(c, none) for c in (
        own("c:", F.array("parent_key", "leaf_key", "sub_key")), own("x:", F.col("sub_words")), own("u:", F.col("url_words")),
        own("p:", F.array("path_key")), soft)])
    known = t.select(F.explode(listed).alias("k")).select(F.col("k.key").alias("_key"), "k.kind", "k.text").distinct()
    hits = asked.join(known, "_key").groupBy("product_id", "_row").agg(F.collect_set(F.struct("kind", "text")).alias("_hits"))
    of = lambda kind: F.transform(F.filter("_hits", lambda h: h["kind"] == kind), lambda h: h["text"])
    both = lambda arr, kind: F.array_sort(F.array_intersect(F.coalesce(arr, empty_texts()), of(kind)))
    seen = p.join(hits, ["product_id", "_row"], "left").withColumn(
        "_hits", F.coalesce("_hits", F.array().cast("array<struct<kind:string,text:string>>")))
    profile = seen.select(
        "product_id", both(F.col("crumbs"), "c:").alias("crumbs"), both(F.col("url_words"), "u:").alias("p_url_words"),
        F.array_sort(of("n:")).alias("name_words"), "evidence_words", F.coalesce(F.get(of("p:"), F.lit(0)), F.lit("")).alias("crumb_path"),
        bind(of("x:"), lambda x: F.array_sort(F.array_distinct(F.transform(
            "crumb_words", lambda c: F.array_sort(F.array_intersect(c, x)))))).alias("crumb_words"),
    )
    return profile.withColumn("_profile", F.md5(F.to_json(F.struct(*profile.columns[1:]))))


def taxonomy_candidates(products: DataFrame, paths: DataFrame, rules: Sequence[dict] = (), most: int | None = None) -> DataFrame:
    """Scored taxonomy paths of each product.

    ``products``: ``product_id, breadcrumbs, url, name, evidence`` (evidence is free text
    of the specs). Pairs meet on shared keys only: a crumb, a word of the address, or a
    name word that is softly equal to a path word. A path without any shared key scores 0.
    Products in which the paths find the same words are scored once. ``most`` leaves the
    best paths of each product row, by score and path.

    A rule is a dict of ``reason, points, path_word`` and ``words``: it applies when the
    path's keys contain the word and the product's evidence has one of the words.
    """
    t = _with_rare_word(prepare_paths(paths))
    tag = lambda name, arr: F.transform(arr, lambda x: F.concat(F.lit(name), x))
    rows = written(_taxonomy_profiles(products, t, sorted({w for r in rules for w in r["words"]})))
    p = rows.drop("product_id").dropDuplicates(["_profile"])
    p_keys = F.concat(
        tag("c:", F.col("crumbs")), tag("w:", F.array_distinct(F.flatten("crumb_words"))), tag("u:", F.col("p_url_words")),
        tag("n:", F.col("name_words")), tag("r:", F.col("evidence_words")),
    )
    path_rule_words = F.concat(
        *[
            F.when(F.array_contains(F.concat("leaf_words", "sub_words"), r["path_word"]),
                   F.array(*[F.lit(w) for w in r["words"]])).otherwise(empty_texts())
            for r in rules
        ],
        empty_texts(),
    )
    t_keys = F.concat(
        tag("c:", F.filter(F.array("parent_key", "leaf_key", "sub_key"), lambda k: k != "")),
        tag("w:", F.filter(F.array("rare_word"), lambda w: w.isNotNull())), tag("u:", F.col("url_words")),
        tag("n:", F.array_union("leaf_words", "sub_words")), tag("r:", F.array_distinct(path_rule_words)),
    )
    meet = (
        p.select("_profile", F.explode(F.array_distinct(p_keys)).alias("_key"))
        .join(t.select("path", F.explode(F.array_distinct(t_keys)).alias("_key")), "_key")
        .select("_profile", "path")
        .distinct()
    )
    pairs = meet.join(p, "_profile").join(t, "path")
    in_crumbs = lambda k: (F.col(k) != "") & F.array_contains("crumbs", F.col(k))
    share = lambda w: F.size(F.array_intersect(w, "name_words")) / F.greatest(F.size(w), F.lit(1))
    own_words = F.concat("leaf_words", "sub_words")
    # Features first, so that each is worked out once and then used twice.
    facts = {
        "_parent": in_crumbs("parent_key"),
        "_leaf": in_crumbs("leaf_key"),
        "_sub": in_crumbs("sub_key") | ((F.col("sub_key") != "") & F.exists(
            "crumb_words", lambda c: F.size(F.array_except("sub_words", c)) == 0)),
        "_full": (F.col("crumb_path") != "") & (F.col("crumb_path") == F.col("path_key")),
        "_shared": F.size(F.array_intersect("p_url_words", "url_words")),
        "_leaf_share": share("leaf_words"),
        "_sub_share": share("sub_words"),
    }
    parts = [
        (F.col("_parent"), F.lit(3.0), "parent_breadcrumb"),
        (F.col("_leaf"), F.lit(4.0), "leaf_breadcrumb"),
        (F.col("_sub"), F.lit(5.0), "sub_breadcrumb"),
        (F.col("_full"), F.lit(4.0), "full_breadcrumb_path"),
        (F.col("_shared") > 0, F.least(F.col("_shared") * 0.5, F.lit(3.0)), "url_overlap"),
        (F.col("_leaf_share") > 0, F.col("_leaf_share") * 1.5, "leaf_name_overlap"),
        (F.col("_sub_share") > 0, F.col("_sub_share") * 2.0, "sub_name_overlap"),
    ]
    for n, r in enumerate(rules):
        facts[f"_rule{n}"] = F.array_contains(own_words, r["path_word"]) & F.arrays_overlap(
            "evidence_words", F.array(*[F.lit(w) for w in r["words"]])
        )
        parts.append((F.col(f"_rule{n}"), F.lit(float(r["points"])), r["reason"]))
    score = F.lit(0.0)
    for cond, points, _ in parts:
        score = score + F.when(cond, points).otherwise(F.lit(0.0))
    scored = pairs.withColumns(facts).select(
        "_profile", "path", "parent", "leaf", "sub",
        F.bround(score, 4).alias("confidence"),
        labels(*[(c, name) for c, _, name in parts]).alias("reasons"),
    )
    if most:
        scored = top_rows(scored, ["_profile"], [F.desc("confidence"), F.col("path")], most, "_place").drop("_place")
    return rows.select("product_id", "_profile").join(scored, "_profile").drop("_profile")


def resolve_taxonomy(products: DataFrame, candidates: DataFrame, strong_reasons: Sequence[str] = ()) -> DataFrame:
    """Best path per product when its score and its lead over the runner-up are enough."""
    top = top_rows(candidates, ["product_id"], [F.desc("confidence"), F.col("path")], 2)
    second = top.where("rank = 2").select("product_id", F.col("confidence").alias("_second"))
    best = top.where("rank = 1").join(second, "product_id", "left")
    score, lead = F.col("confidence"), F.col("confidence") - F.coalesce("_second", F.lit(0.0))
    any_of = lambda names: F.arrays_overlap("reasons", F.array(*[F.lit(n) for n in names])) if names else F.lit(False)
    sure = (
        (score >= 7.0)
        | ((score >= 5.0) & (lead >= 1.5) & any_of(["sub_breadcrumb", "full_breadcrumb_path"]))
        | ((score >= 4.5) & (lead >= 2.0) & any_of(["leaf_breadcrumb"]))
        | ((score >= 3.5) & (lead >= 2.0) & any_of(list(strong_reasons)))
    )
    joined = products.select("product_id").join(best, "product_id", "left")
    return joined.select(
        "product_id",
        F.when(sure, F.col("path")).alias("path"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("path").isNull(), "no_candidates")
        .when(sure, F.array_join("reasons", ","))
        .otherwise("low_confidence").alias("reason"),
    )


def category_hint(rows: DataFrame, rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """First rule (family, field, pattern, path) that a product meets; an empty family fits all."""
    hit = None
    number = None
    for i, (family, field, pattern, path) in enumerate(rules):
        cond = match_key(F.col(field)).rlike(pattern)
        if family:
            cond = cond & (F.col("family") == family)
        hit = F.when(cond, path) if hit is None else hit.when(cond, path)
        number = F.when(cond, i) if number is None else number.when(cond, i)
    return rows.withColumns({"hint_path": hit, "rule_no": number})


def select_category_path(rows: DataFrame, existing_paths: DataFrame) -> DataFrame:
    """Category path of a row: the only deepest one, else the only known one, else the first."""
    found = rows.withColumn("_paths", deepest_paths(F.col("category")))
    known = (
        found.select("row_no", F.posexplode("_paths").alias("_pos", "path"))
        .join(existing_paths.select("path").distinct(), "path", "left_semi")
        .groupBy("row_no")
        .agg(F.count(F.lit(1)).alias("_known"), F.min("path").alias("_one"))
    )
    n = F.size("_paths")
    how = (
        F.when(n == 0, "none").when(n == 1, "deepest")
        .when(F.col("_known") == 1, "existing").otherwise("first_deepest")
    )
    return found.join(known, "row_no", "left").withColumns(
        {"how": how, "path": F.when(how == "existing", F.col("_one")).otherwise(F.get("_paths", F.lit(0)))}
    ).drop("_paths", "_known", "_one")


# ------------------------------------------------------------------- templates
def product_label_sets(products: DataFrame, specs: str = "specs") -> DataFrame:
    """Distinct section, label and section-label keys of a product's own spec sheet."""
    col = F.col(specs)
    pair = lambda s: match_key(F.concat_ws(" || ", s["section"], s["label"]))
    keep = lambda arr: F.array_distinct(F.filter(arr, lambda k: k != ""))
    return products.withColumns(
        {
            "titles": keep(F.transform(col, lambda s: match_key(s["section"]))),
            "labels": keep(F.transform(col, lambda s: match_key(s["label"]))),
            "pairs": keep(F.transform(col, lambda s: F.when((s["section"] != "") & (s["label"] != ""), pair(s)).otherwise(""))),
        }
    )


def template_pool(products: DataFrame, templates: DataFrame) -> DataFrame:
    """Templates a product may use: of its exact path, else leaf templates that allow it.

    When the product prefers source files, templates built from them push out the rest.
    """
    t = templates.withColumns(
        {
            "_path": match_key(F.col("category_path")), "_parent": match_key(F.col("t_parent")),
            "_leaf": match_key(F.col("t_leaf")), "_sub": match_key(F.coalesce("t_sub", F.lit(""))),
        }
    )
    p = products.select("product_id", "taxonomy_path", "parent", "leaf", "sub", "preferred_files")
    exact = p.join(t, match_key(F.col("taxonomy_path")) == F.col("_path")).withColumn("tier", F.lit(0))
    loose = t.where((F.col("_sub") == "") & F.col("match_policy").isin("leaf_family", "mixed_family"))
    fallback = (
        p.where(F.coalesce("sub", F.lit("")) != "")
        .join(loose, (match_key(F.col("parent")) == F.col("_parent")) & (match_key(F.col("leaf")) == F.col("_leaf")))
        .withColumn("tier", F.lit(1))
    )
    # A product's pool is small: tier and preference are settled over one shuffle of it.
    own = Window.partitionBy("product_id")
    wanted = F.arrays_overlap(F.transform("preferred_files", match_key), F.transform("source_files", match_key))
    pool = exact.unionByName(fallback).withColumn("_tier", F.min("tier").over(own)).where("tier = _tier").withColumn("_wanted", wanted)
    return pool.withColumn("_any", F.coalesce(F.max("_wanted").over(own), F.lit(False))).where(~F.col("_any") | F.col("_wanted")).drop(
        "_path", "_parent", "_leaf", "_sub", "_wanted", "_any", "_tier",
        "taxonomy_path", "parent", "leaf", "sub", "preferred_files",
    )


def gate_templates(pool: DataFrame, sets: DataFrame) -> DataFrame:
    """Pool rows with overlap counts, gate failures and the weighted score."""
    joined = pool.join(sets.select("product_id", "titles", "labels", "pairs"), "product_id")
    overlap = lambda a, b: F.size(F.array_intersect(a, b))
    ratio = lambda n, arr: n / F.greatest(F.size(arr), F.lit(1))
    counted = joined.withColumns(
        {
            "section_overlap": overlap("titles", "section_names"),
            "label_overlap": overlap("labels", "label_set"),
            "pair_overlap": overlap("pairs", "pair_set"),
            "discriminator_overlap": overlap("labels", "discriminators"),
        }
    )
    reasons = labels(
        ((F.size("required_all") > 0) & (F.size(F.array_except("required_all", "labels")) > 0), "missing_required_labels_all"),
        ((F.size("required_any") > 0) & ~F.arrays_overlap("required_any", "labels"), "missing_required_labels_any"),
        (F.arrays_overlap("forbidden", "labels"), "forbidden_labels_present"),
        (F.col("section_overlap") < F.col("min_section_overlap"), "min_section_overlap"),
        (F.col("label_overlap") < F.col("min_label_overlap"), "min_label_overlap"),
    )
    score = (
        ratio(F.col("section_overlap"), "section_names") * 0.2
        + ratio(F.col("label_overlap"), "label_set") * 0.3
        + ratio(F.col("pair_overlap"), "pair_set") * 0.4
        + ratio(F.col("discriminator_overlap"), "discriminators") * 0.1
    )
    return counted.withColumns({"gate_reasons": reasons, "score": F.bround(score, 4)})


def match_templates(products: DataFrame, pool: DataFrame, sets: DataFrame) -> DataFrame:
    """Selected template per product with its score, or the reason there is none."""
    gated = gate_templates(pool, sets)
    active = F.col("template_status") == "active"
    passed = active & (F.size("gate_reasons") == 0)
    labels_miss = F.arrays_overlap(
        "gate_reasons",
        F.array(*[F.lit(x) for x in ("missing_required_labels_any", "missing_required_labels_all", "forbidden_labels_present")]),
    )
    only = lambda name: (F.size("gate_reasons") == 1) & F.array_contains("gate_reasons", name)
    order = [
        -F.col("score"), -F.col("pair_overlap"), -F.col("label_overlap"), -F.col("section_overlap"),
        -F.col("discriminator_overlap"), F.col("template_id"),
    ]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], "template_id", "score")
    # One aggregate gives the pool's counts, its only active template and its best passed one.
    summary = gated.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("pool_size"),
        F.count_if(active).alias("_active"),
        F.count_if(F.col("template_status") != "manual_only").alias("_not_manual"),
        F.count_if(passed).alias("_passed"),
        F.bool_and(F.when(active, labels_miss)).alias("_labels"),
        F.bool_and(F.when(active, only("min_section_overlap"))).alias("_sections"),
        F.bool_and(F.when(active, only("min_label_overlap"))).alias("_label_count"),
        F.min(F.when(active, F.col("template_id"))).alias("_single"),
        F.min(F.when(passed, ranked)).alias("_best"),
    )
    direct = F.col("_active") == 1
    chosen = summary.withColumns({
        "template_id": F.when(direct, F.col("_single")).otherwise(F.col("_best.template_id")),
        "score": F.when(direct, 1.0).otherwise(F.col("_best.score")),
        "match_mode": F.when(direct, "direct_single").when(F.col("_best").isNotNull(), "category_pool"),
    })
    reason = (
        F.when(F.col("template_id").isNotNull(), "")
        .when(F.col("pool_size").isNull(), "pool_empty_for_category")
        .when((F.col("_active") == 0) & (F.col("_not_manual") == 0), "manual_only_category")
        .when(F.col("_active") == 0, "no_active_templates")
        .when(F.col("_labels"), "discriminator_miss")
        .when(F.col("_sections"), "insufficient_section_overlap")
        .when(F.col("_label_count"), "insufficient_label_overlap")
        .otherwise("no_safe_template_match")
    )
    weak = (F.col("match_mode") == "category_pool") & (F.col("_passed") > 1) & (F.col("score") < 0.35)
    return (
        products.select("product_id").join(chosen, "product_id", "left")
        .select(
            "product_id", "template_id", F.coalesce("score", F.lit(0.0)).alias("score"), "match_mode",
            F.coalesce("pool_size", F.lit(0)).alias("pool_size"), reason.alias("fail_reason"),
            F.coalesce(weak, F.lit(False)).alias("weak_match"),
        )
    )


def template_discriminators(templates: DataFrame) -> DataFrame:
    """Label roles of active templates, one row per template and label.

    A label only one template of a category has tells it apart. The first such label is
    required, one of the first three must appear (of the own labels when there is none).
    """
    active = templates.where(F.col("template_status") == "active")
    rows = active.select("category_path", "template_id", F.posexplode("label_set").alias("pos", "label")).where("label <> ''")
    owners = rows.groupBy("category_path", "label").agg(F.count_distinct("template_id").alias("owners"))
    marked = rows.join(owners, ["category_path", "label"]).withColumn("unique", F.col("owners") == 1)
    has_unique = marked.groupBy("template_id").agg(F.max("unique").alias("any_unique"))
    m = marked.join(has_unique, "template_id").withColumn("candidate", F.col("unique") | ~F.col("any_unique"))
    first = top_rows(m.where("candidate"), ["template_id"], [F.col("pos")], 3, "place").select("template_id", "label", "place")
    return m.join(first, ["template_id", "label"], "left").select(
        "category_path", "template_id", "label",
        F.col("unique").alias("discriminator"),
        (F.coalesce("place", F.lit(99)) <= 3).alias("required_any"),
        (F.col("unique") & (F.col("place") == 1)).alias("required_all"),
    )


def template_gates(templates: DataFrame) -> DataFrame:
    """Minimum overlaps of a template and how many sibling labels it must not show."""
    active = templates.where(F.col("template_status") == "active")
    own = active.select("template_id", "category_path", F.size(F.array_distinct("label_set")).alias("own"),
                        F.size("section_names").alias("sections"))
    whole = active.select("category_path", F.explode("label_set").alias("label")).groupBy("category_path").agg(
        F.count_distinct("label").alias("all_labels")
    )
    at_least = lambda n, part, most: F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(n * F.lit(part)).cast("int")))
    return own.join(whole, "category_path").select(
        "template_id", (F.col("all_labels") - F.col("own")).alias("forbidden_labels"),
        at_least(F.col("sections"), 0.5, 3).alias("min_section_overlap"),
        at_least(F.col("own"), 0.2, 8).alias("min_label_overlap"),
    )


def template_coverage(expected: DataFrame, templates: DataFrame) -> DataFrame:
    """Expected categories against templates: missing, fine, manual or to review; loose ones too."""
    seen = templates.groupBy("category_path").agg(
        F.count(F.lit(1)).alias("templates"), F.min("template_status").alias("_status"),
        F.min("template_id").alias("template_id"),
    )
    wanted = expected.select("category_path").distinct().withColumn("_wanted", F.lit(True))
    state = (
        F.when(F.col("_wanted").isNull(), "UNBOUND")
        .when(F.col("templates").isNull(), "MISSING")
        .when(F.col("templates") > 1, "REVIEW")
        .when(F.col("_status") == "manual_only", "NEEDS_MANUAL")
        .otherwise("OK")
    )
    return wanted.join(seen, "category_path", "full_outer").select(
        "category_path", F.coalesce("templates", F.lit(0)).alias("templates"), "template_id", state.alias("state")
    )


def bind_templates(templates: DataFrame, paths: DataFrame) -> DataFrame:
    """Taxonomy path of a template: by its link, else by its label as sub-category, else as leaf.

    Of several paths the one sharing most words with the template's own names is taken;
    a tie leaves the template unbound.
    """
    t = templates.withColumn("_words", F.array_distinct(words(match_key(F.concat_ws(" ", "template_id", "label", "source_file")))))
    p = paths.withColumn("_path_words", words(match_key(F.concat_ws(" ", "parent", "leaf", "sub", "path"))))
    by_link = t.where("cta_url <> ''").join(p, t["cta_url"] == p["url"]).withColumn("tier", F.lit(0))
    key = match_key(F.col("label"))
    by_sub = t.join(p, key == match_key(F.coalesce("sub", F.lit("")))).where("label <> ''").withColumn("tier", F.lit(1))
    by_leaf = t.join(p.where(F.coalesce("sub", F.lit("")) == ""), key == match_key(F.col("leaf"))).where(
        "label <> ''"
    ).withColumn("tier", F.lit(2))
    cols = ["template_id", "path", "tier", "_words", "_path_words"]
    both = by_link.select(*cols).unionByName(by_sub.select(*cols)).unionByName(by_leaf.select(*cols))
    score = F.size(F.array_intersect("_words", "_path_words"))
    ranked = both.withColumn("shared", score)
    summary = ranked.groupBy("template_id", "tier").agg(
        F.count(F.lit(1)).alias("_n"), F.max("shared").alias("shared")
    )
    best = ranked.join(summary, ["template_id", "tier", "shared"]).groupBy("template_id", "tier", "_n", "shared").agg(
        F.count(F.lit(1)).alias("_ties"), F.min("path").alias("path")
    )
    fits = (F.col("_n") == 1) | ((F.col("shared") > 0) & (F.col("_ties") == 1))
    chosen = first_row(best.where(fits), ["template_id"], [F.col("tier")], ["tier", "path"])
    return templates.select("template_id").join(chosen, "template_id", "left")


def duplicate_keys(rows: DataFrame, key: str, evidence: str) -> DataFrame:
    """Keys used more than once, with the number of uses and the first place."""
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(
        F.count(F.lit(1)).alias("uses"), F.min(evidence).alias("first_use")
    ).where("uses > 1")


# -------------------------------------------------------------- filter map
def filter_map_rows(catalog: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Distinct (category path, group, value) with stable ids, from ``filter_group:*`` columns.

    ``catalog`` carries ``path`` (see ``select_category_path``) and one column per group.
    """
    cols = [f"filter_group:{g}" for g in groups]
    long = catalog.where("path IS NOT NULL").unpivot(
        ["path"], [F.col(f"`{c}`") for c in cols], "group_column", "value"
    )
    rows = long.select(
        "path", F.trim(F.substring_index("group_column", ":", -1)).alias("group_name"),
        trim_text(F.col("value")).alias("value"),
    ).where("value <> ''").distinct()
    category_id = stable_id("cat_", F.col("path"))
    with_ids = rows.withColumn("category_id", category_id)
    with_ids = with_ids.withColumn("group_id", stable_id("fg_", F.col("category_id"), F.col("group_name")))
    return with_ids.withColumn("value_id", stable_id("fv_", F.col("group_id"), F.col("value")))


def filter_map_counts(rows: DataFrame, catalog: DataFrame, existing_paths: DataFrame) -> DataFrame:
    """Categories, groups and values seen, and how many categories are new."""
    seen = catalog.where("path IS NOT NULL").select("path").distinct()
    known = existing_paths.select("path").distinct().withColumn("_known", F.lit(True))
    cats = seen.join(known, "path", "left").agg(
        F.count(F.lit(1)).alias("categories_seen"), F.count_if(F.col("_known").isNull()).alias("categories_added")
    )
    groups = rows.select("group_id").distinct().agg(F.count(F.lit(1)))
    values = rows.select("value_id").distinct().agg(F.count(F.lit(1)))
    return cats.withColumns({"groups_seen": groups.scalar(), "values_seen": values.scalar()})


def filter_category_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("required")).alias("required"),
        F.count_if(F.col("status") == "inactive").alias("inactive"),
        F.count_if(F.col("status") == "deprecated").alias("deprecated"),
    )


def apply_overrides(base: DataFrame, overrides: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Base rows with overrides on top: changed fields, added rows, omitted rows.

    ``overrides`` has ``omit`` and a NULL in every field it leaves alone. A new row needs
    its first field.
    """
    o = overrides.select(key, F.col("omit").alias("_omit"), F.lit(True).alias("_o"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = base.withColumn("_b", F.lit(True)).join(o, key, "full_outer")
    keep = ~F.coalesce("_omit", F.lit(False)) & (F.col("_b").isNotNull() | F.col(f"_{fields[0]}").isNotNull())
    changed = F.lit(False)
    for f in fields:
        changed = changed | (F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f)))
    action = F.when(F.col("_b").isNull(), "added").when(changed, "overridden").otherwise("kept")
    return both.where(keep).select(key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields], action.alias("action"))


def find_filter_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Filter category of a product by normalized path, else by category id."""
    by_path = categories.groupBy(match_key(F.col("path")).alias("_path")).agg(F.min("category_id").alias("_by_path"))
    by_id = categories.select(F.col("category_id").alias("_by_id")).distinct()
    joined = products.join(by_path, F.nullif(match_key(F.col("taxonomy_path")), F.lit("")) == F.col("_path"), "left").join(
        by_id, F.col("category_id") == F.col("_by_id"), "left"
    )
    return joined.withColumns(
        {
            "filter_category_id": F.coalesce("_by_path", "_by_id"),
            "found_by": F.when(F.col("_by_path").isNotNull(), "path").when(F.col("_by_id").isNotNull(), "category_id"),
        }
    ).drop("_path", "_by_path", "_by_id")


def resolve_filter_values(
    products: DataFrame, groups: DataFrame, values: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Value of every filter group of every product, and what is wrong with it.

    ``products``: ``product_id, filter_category_id``; ``groups``: ``category_id, group_id,
    group_name, required, status``; ``values``: ``group_id, value, status, aliases``;
    ``evidence``: ``product_id, kind, label, value, seq`` with the kinds of
    ``EVIDENCE_TIERS``. The first tier with a value wins, a label equal to the group name
    before one with the same key.
    """
    spelled = values.withColumn("_names", F.concat(F.array("value"), F.coalesce("aliases", empty_texts())))
    # Groups and whether they list a value that may be used: both go by group id, so one grouping serves them.
    fields = F.struct("category_id", "group_name", "required", F.col("status").alias("group_status"))
    known = groups.select("group_id", fields.alias("g"), F.lit(None).cast("boolean").alias("allowed")).unionByName(
        spelled.select("group_id", F.lit(None).alias("g"), (F.col("status") != "inactive").alias("allowed")))
    listed = known.groupBy("group_id").agg(F.collect_list("g").alias("g"), F.max("allowed").alias("_has_allowed")).select(
        "group_id", F.explode("g").alias("g"), "_has_allowed")
    asked = products.join(
        listed.select(F.col("g.category_id").alias("filter_category_id"), "group_id", "g.group_name", "g.required", "g.group_status", "_has_allowed"),
        "filter_category_id",
    )
    facts = evidence.withColumn("_value", null_dashes(F.col("value"))).where(
        F.col("_value").isNotNull() & (F.col("label") != "")
    )
    tier = F.lit(None)
    for kind, n in EVIDENCE_TIERS.items():
        tier = F.when(F.col("kind") == kind, n).otherwise(tier)
    facts = facts.select("product_id", "kind", "label", "seq", "_value", label_key(F.col("label")).alias("_key"), tier.alias("_tier"))
    # Every asked group stays, with its evidence if it has any.
    hits = asked.withColumn("_key", label_key(F.col("group_name"))).join(facts, ["product_id", "_key"], "left")
    exact = F.col("label") == F.col("group_name")
    strict = F.col("kind").isin("source", "manufacturer", "description")
    place = F.when(strict & ~exact, F.lit(EVIDENCE_TIERS["normalized"])).otherwise(F.col("_tier"))
    origin = (
        F.when(F.col("kind") == "approved_review", "approved_review")
        .when(strict & exact, F.concat("kind", F.lit("_exact")))
        .when(strict, F.concat(F.lit("normalized_"), "kind"))
        .otherwise(F.col("kind"))
    )
    usable_hit = F.col("_value").isNotNull() & ((F.col("group_status") != "inactive") | (F.col("kind") == "approved_review"))
    last = F.lit(len(EVIDENCE_TIERS) + 99)
    own = ["group_name", "group_status", "required", "_has_allowed"]
    found = first_row(
        hits.select(
            "product_id", "group_id", *own, F.when(usable_hit, place).alias("_place"), F.when(usable_hit, F.col("_tier")).alias("_tier"),
            "seq", F.when(usable_hit, F.col("_value")).alias("_value"), F.when(usable_hit, origin).alias("resolved_from")),
        ["product_id", "group_id"], [F.coalesce("_place", last), F.coalesce("_tier", last), F.col("seq")], [*own, "_value", "resolved_from"],
    )
    joined = _canonical_values(found, spelled, [*own, "resolved_from"])
    has = F.col("resolved_value").isNotNull()
    status = F.col("group_status")
    inactive_ok = (status == "inactive") & (F.col("resolved_from") == "approved_review")
    outside = has & F.coalesce("_has_allowed", F.lit(False)) & ~F.coalesce(F.col("value_status") != "inactive", F.lit(False))
    missing = F.col("required") & (status == "active") & ~has
    return joined.select(
        "product_id", "group_id", "group_name", "group_status", "required",
        F.coalesce("resolved_value", F.lit("")).alias("resolved_value"),
        F.coalesce("resolved_from", F.lit("")).alias("resolved_from"),
        (has & (status.isin("active", "deprecated") | F.coalesce(inactive_ok, F.lit(False)))).alias("emitted"),
        missing.alias("missing_required"),
        outside.alias("outside_allowed"),
        (F.coalesce("value_status", F.lit("")) == "deprecated").alias("deprecated_value"),
    )


def _canonical_values(found: DataFrame, spelled: DataFrame, carry: list[str]) -> DataFrame:
    """Found values in the spelling of the filter map, with the status they have there.

    An equal alias key decides; else the one listed value whose key stands as a phrase in the
    found text. In one equality join the keys of a text meet equal keys, and each of its words
    meets the keys that begin with it; the words behind it then tell whether the key goes on
    like the text. So a text gives as many rows as its keys have words, however long keys are.
    """
    keys = (
        spelled.select("group_id", F.struct(F.col("value").alias("name"), "status").alias("canonical"), F.posexplode("_names").alias("_n", "_name"))
        .select("group_id", "canonical", "_n", F.explode(value_alias_keys(F.col("_name"))).alias("_key"))
    )
    owner = first_row(keys, ["group_id", "_key"], [F.col("_n"), F.col("canonical")], ["canonical"])
    none = empty_texts()
    probe = lambda kind, text, own: F.struct(F.lit(kind).alias("kind"), text.alias("text"), own.alias("own"))
    of_key = bind(words(F.col("_key")), lambda w: F.array(
        probe("key", F.col("_key"), none), probe("word", F.when(F.length("_key") > 2, F.get(w, F.lit(0))), w)))
    probes = owner.select("group_id", "canonical", F.explode(of_key).alias("p")).where("p.text IS NOT NULL").select(
        "group_id", "canonical", "p.*")

    asked = found.withColumn("_keys", F.coalesce(value_alias_keys(F.col("_value")), none))
    ask = lambda pos, kind, text, rest: F.struct(
        pos.alias("pos"), F.lit(kind).alias("kind"), text.alias("text"), rest.alias("rest"))
    no_place = F.lit(None).cast("int")
    by_word = F.flatten(F.transform("_keys", lambda k: bind(words(k), lambda w: F.transform(
        w, lambda t, i: ask(no_place, "word", t, F.slice(w, i + 1, F.size(w)))))))
    tries = F.concat(F.transform("_keys", lambda k, i: ask(i, "key", k, none)), F.array_distinct(by_word))
    rows = asked.select("product_id", "group_id", *carry, "_value", F.explode_outer(tries).alias("_t")).select(
        "product_id", "group_id", *carry, "_value", "_t.*")
    met = rows.join(probes, ["group_id", "kind", "text"], "left").withColumn(
        "canonical", F.when((F.col("kind") == "key") | (F.slice("rest", 1, F.size("own")) == F.col("own")), F.col("canonical")))
    phrase = F.when(F.col("pos").isNull(), F.col("canonical"))
    best = met.groupBy("product_id", "group_id").agg(
        *[F.min(c).alias(c) for c in [*carry, "_value"]],
        F.min(F.when(F.col("canonical").isNotNull() & F.col("pos").isNotNull(), F.struct("pos", "canonical"))).alias("_equal"),
        F.min(phrase).alias("_low"), F.max(phrase).alias("_high"),
    )
    chosen = F.coalesce("_equal.canonical", F.when(F.col("_low.name") == F.col("_high.name"), F.col("_low")))
    return best.withColumn("_chosen", chosen).select(
        "product_id", "group_id", *carry, F.coalesce("_chosen.name", "_value").alias("resolved_value"), F.col("_chosen.status").alias("value_status")
    )


def filter_review_state(resolved: DataFrame) -> DataFrame:
    """Advisory state per product: counts of groups that need a look, and the gate."""
    n = lambda c: F.count_if(F.col(c))
    counts = resolved.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("groups"),
        n("emitted").alias("emitted"),
        n("missing_required").alias("missing_required"),
        n("outside_allowed").alias("outside_allowed"),
        n("deprecated_value").alias("deprecated_values"),
    )
    clean = (F.col("missing_required") == 0) & (F.col("outside_allowed") == 0) & (F.col("deprecated_values") == 0)
    return counts.withColumn("gate_open", clean)


# ----------------------------------------------------------------------- specs
def spec_lookup(specs: DataFrame) -> DataFrame:
    """First value per product and label key, by source order and position."""
    rows = specs.withColumns({"label_key": label_key(F.col("label")), "_v": normalize_spaces(F.col("value"))}).where(
        "label_key <> '' AND _v <> ''"
    )
    return first_row(rows, ["product_id", "label_key"], [F.col("priority"), F.col("seq")], ["_v", "label", "priority"]).withColumnRenamed("_v", "value")


def with_alias_family(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows with the alias family of their label; labels without one keep NULL."""
    known = first_row(
        aliases.withColumn("label_key", label_key(F.col("alias"))).where("label_key <> ''"),
        ["label_key"], [F.col("seq")], ["family_id"],
    )
    return rows.withColumn("label_key", label_key(F.col("label"))).join(known, "label_key", "left")


def merge_spec_sections(specs: DataFrame) -> DataFrame:
    """Specs of several documents as one sheet: the first document that names a field wins."""
    rows = specs.withColumns(
        {
            "section_key": match_key(F.col("section")), "label_key": label_key(F.col("label")),
            "value": normalize_spaces(F.col("value")),
        }
    ).where("section_key <> '' AND label_key <> '' AND value <> ''")
    return first_row(
        rows, ["product_id", "section_key", "label_key"], [F.col("priority"), F.col("document"), F.col("seq")],
        ["section", "label", "value", "document"],
    )


def fuzzy_label_score(label: Column, alias: Column) -> Column:
    """How well a spec label fits an alias: containment beats shared words."""
    def judge(p: Column) -> Column:
        a_words = F.filter(words(p["a"]), lambda t: F.length(t) >= 2)
        l_words = F.filter(words(p["l"]), lambda t: F.length(t) >= 2)
        lone = F.size(a_words) == 1
        denied = lone & (
            F.get(a_words, F.lit(0)).isin(FUZZY_DENIED_WORDS)
            | (~F.get(a_words, F.lit(0)).isin(FUZZY_SINGLE_WORDS) & (F.length(F.get(a_words, F.lit(0))) < 8))
        )
        inside = (F.length(p["a"]) >= 2) & (F.contains(p["l"], p["a"]) | F.contains(p["a"], p["l"]))
        hits = F.size(
            F.filter(a_words, lambda a: F.exists(l_words, lambda t: F.contains(t, a) | F.contains(a, t)))
        )
        partial = (F.size(a_words) > 1) & (hits < F.size(a_words))
        return (
            F.when((p["l"] == "") | (p["a"] == "") | F.coalesce(denied, F.lit(False)), 0)
            .when(inside, F.length(p["a"]) + 100)
            .when((F.size(a_words) == 0) | partial | (hits == 0), 0)
            .otherwise(hits * 10 + F.size(a_words))
        )

    return bind(F.struct(match_key(label).alias("l"), match_key(alias).alias("a")), judge)


def spec_value_for(specs: Column, aliases: Column) -> Column:
    """Struct(value, source, matched_label) for one field out of a product's own specs.

    ``specs`` is the product's array<struct<label,value>>; an alias with an equal key wins,
    else the label with the best fuzzy score.
    """
    usable_specs = F.filter(specs, lambda s: null_dashes(s["value"]).isNotNull())
    made = lambda s, kind: F.struct(
        normalize_spaces(s["value"]).alias("value"), F.lit(kind).alias("source"), s["label"].alias("matched_label")
    )
    exact = F.get(
        F.flatten(
            F.transform(aliases, lambda a: F.filter(usable_specs, lambda s: label_key(s["label"]) == label_key(a)))
        ),
        F.lit(0),
    )
    scored = F.transform(
        usable_specs,
        lambda s, i: F.struct(
            F.array_max(F.transform(aliases, lambda a: fuzzy_label_score(s["label"], a))).alias("score"),
            (-i).alias("order"), s["label"].alias("label"), s["value"].alias("value"),
        ),
    )
    best = F.array_max(F.filter(scored, lambda s: s["score"] > 0))
    return F.when(exact.isNotNull(), made(exact, "exact_spec")).when(best.isNotNull(), made(best, "fuzzy_spec"))


def fill_template_fields(products: DataFrame, fields: DataFrame) -> DataFrame:
    """Value and origin of every field of a product's template.

    ``products`` carries its ``specs`` and ``description_specs`` arrays; ``fields`` has
    ``template_id, field, aliases, fallback``.
    """
    rows = products.join(fields, "template_id")
    spec = spec_value_for(F.col("specs"), F.col("aliases"))
    text = spec_value_for(F.col("description_specs"), F.col("aliases"))
    return rows.withColumns({"_s": spec, "_d": text}).select(
        "product_id", "template_id", "field",
        F.coalesce("_s.value", "_d.value", "fallback").alias("value"),
        F.when(F.col("_s").isNotNull(), F.concat(F.col("_s.source"), F.lit(":"), F.col("_s.matched_label")))
        .when(F.col("_d").isNotNull(), F.concat(F.lit("description_"), F.col("_d.source"), F.lit(":"), F.col("_d.matched_label")))
        .when(F.col("fallback").isNotNull(), "fallback")
        .otherwise("unresolved").alias("source"),
    )


def compose_names(products: DataFrame, rules: DataFrame) -> DataFrame:
    """Product name by rule: brand, MPN, category phrase and the first differentiators.

    ``rules``: ``leaf, sub, category_phrase, alias_groups (array<array<string>>),
    max_differentiators``; a rule without sub-category serves the whole leaf.
    """
    exact = rules.where(F.coalesce("sub", F.lit("")) != "").withColumn("_exact", F.lit(0))
    leaf = rules.where(F.coalesce("sub", F.lit("")) == "").drop("sub").withColumn("_exact", F.lit(1))
    a = products.join(exact, ["leaf", "sub"])
    b = products.join(leaf, "leaf")
    both = a.unionByName(b, allowMissingColumns=True)
    chosen = both.groupBy("product_id").agg(F.min("_exact").alias("_exact"))
    rows = both.join(chosen, ["product_id", "_exact"])
    values = F.filter(
        F.transform("alias_groups", lambda g: spec_value_for(F.col("specs"), g)["value"]), lambda v: v.isNotNull()
    )
    picked = rows.withColumn("differentiators", F.slice(values, F.lit(1), F.col("max_differentiators")))
    name = normalize_spaces(F.concat_ws(" ", "brand", "mpn", "category_phrase", F.array_join("differentiators", " ")))
    article = F.create_map(*[F.lit(x) for p in ARTICLES.items() for x in p])
    specs = F.array_join("differentiators", ", ")
    draft = F.concat(
        F.concat_ws(" ", F.coalesce(F.try_element_at(article, F.col("gender")), F.lit("Το")), "brand", "mpn", F.lit("είναι"), "category_phrase"),
        F.when(specs != "", F.concat(F.lit(" με "), specs)).otherwise(""), F.lit("."),
    )
    return picked.select("product_id", "differentiators", name.alias("name"), normalize_spaces(draft).alias("meta_draft"))


# -------------------------------------------------------------------- identity
def mpn_display(col: Column) -> Column:
    """MPN for showing: label words gone, dashes plain, placeholders empty."""
    text = F.regexp_replace(normalize_spaces(col), MPN_LABEL, "")
    text = F.translate(text, "‐‑‒–—−", "------")
    text = F.regexp_replace(F.regexp_replace(text, "\\s*/\\s*", "/"), "^[ :;,]+|[ :;,]+$", "")
    text = normalize_spaces(text)
    bad = F.lower(text).isin(MPN_PLACEHOLDERS) | (F.length(text) > 80) | ~text.rlike("[\\p{L}\\p{N}]")
    return F.when((text == "") | bad, "").otherwise(text)


def mpn_match_key(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(mpn_display(col)), "\\s*([/-])\\s*", "$1"), "\\s+", " ")


def mpn_scope(col: Column) -> Column:
    shown = mpn_display(col)
    return F.when(shown.rlike("^[^/]+/[^/]+"), "complete_set").when(shown != "", "single_unit").otherwise("unknown")


def resolve_identity(products: DataFrame, candidates: DataFrame) -> DataFrame:
    """MPN of a product: highest confidence, verified first; a set against a part is a conflict.

    ``candidates``: ``product_id, value, source, confidence, status, seq``. The internal
    model never counts as an MPN.
    """
    models = products.select("product_id", "model", "family")
    valid = (
        candidates.join(models.drop("family"), "product_id")
        .withColumns({"display": mpn_display(F.col("value")), "key": mpn_match_key(F.col("value")), "scope": mpn_scope(F.col("value"))})
        .where((F.col("key") != "") & (F.col("key") != mpn_match_key(F.col("model"))))
    )
    once = last_row(
        valid, ["product_id", "key"],
        [F.col("confidence"), F.col("status") == "verified", -F.col("seq")],
        ["display", "scope", "source", "confidence", "status"],
    )
    kinds = once.groupBy("product_id").agg(
        F.max(F.when(F.col("scope") == "complete_set", F.lit(True))).alias("_set"),
        F.max(F.when(F.col("scope") != "complete_set", F.lit(True))).alias("_part"),
        F.count(F.lit(1)).alias("candidates"),
    )
    best = first_row(once, ["product_id"], [-F.col("confidence"), F.col("status") != "verified", F.col("key")])
    joined = models.join(kinds, "product_id", "left").join(best, "product_id", "left")
    conflict = (F.col("family") == "air_conditioner") & F.coalesce(F.col("_set") & F.col("_part"), F.lit(False))
    when_ok = lambda c: F.when(~conflict, F.col(c))
    return joined.select(
        "product_id", "model", "family",
        F.coalesce(when_ok("display"), F.lit("")).alias("mpn"),
        F.when(conflict, "conflicting").when(F.col("display").isNull(), "missing").otherwise(F.col("status")).alias("mpn_status"),
        F.coalesce(when_ok("scope"), F.lit("unknown")).alias("mpn_scope"),
        when_ok("source").alias("source"),
        F.coalesce(when_ok("confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


def identity_errors(csv_mpn: Column, active: Column) -> Column:
    """Names of the identity rules a resolved row breaks (columns of ``resolve_identity``)."""
    mpn, status, scope = F.col("mpn"), F.col("mpn_status"), F.col("mpn_scope")
    set_broken = (F.col("family") == "air_conditioner") & (scope == "complete_set") & ~F.contains(mpn, F.lit("/"))
    return labels(
        (status == "conflicting", "mpn_candidates_conflicting"),
        ((mpn != "") & (mpn_match_key(mpn) == mpn_match_key(F.col("model"))), "mpn_is_internal_model"),
        ((mpn != "") & ~scope.isin(MPN_SCOPES), "mpn_scope_invalid"),
        ((mpn != "") & (csv_mpn != "") & (mpn_match_key(mpn) != mpn_match_key(csv_mpn)), "csv_mpn_identity_mismatch"),
        (set_broken, "complete_set_not_preserved"),
        (active & (status != "verified"), "mpn_not_verified"),
    )


