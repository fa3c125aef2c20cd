"""Attribute-resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import categories as G
from shelfspark.functions import values as N
from shelfspark.operators import attributes as A
from shelfspark.plans.registry import query
from shelfspark.plans.views import VIEWS

_LEAF = "CASE p_size % 3 WHEN 0 THEN 'Washers' WHEN 1 THEN 'Dryer units' ELSE 'Kettles' END"
_PATH = f"p_type || ' > ' || {_LEAF} || ' > Model ' || cast(p_size AS string)"
VIEWS["paths_v"] = f"""
    SELECT DISTINCT {_PATH} AS path, p_type AS parent, {_LEAF} AS leaf, 'Model ' || cast(p_size AS string) AS sub,
           'https://x.example.com/' || lower(p_type) || '/' || lower({_LEAF}) AS url FROM {{part}}"""
VIEWS["tax_products_v"] = f"""
    SELECT p_partkey AS product_id,
           split('Home~' || p_type || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '~' || {_LEAF} END
               || CASE p_partkey % 3 WHEN 0 THEN '~Model ' || cast(p_size AS string)
                    WHEN 1 THEN '~the Model ' || cast(p_size AS string) || ' line' ELSE '' END, '~') AS breadcrumbs,
           'https://shop.example.com/' || lower(p_type) || '/' || cast(p_partkey AS string) AS url,
           p_name || CASE p_partkey % 5 WHEN 0 THEN ' washing set' WHEN 1 THEN ' dryer' WHEN 2 THEN ' kettle set'
               WHEN 3 THEN ' model 5' ELSE ' washers' END AS name,
           CASE WHEN p_partkey % 6 = 0 THEN 'steam power' ELSE 'none' END AS evidence
    FROM {{part}}"""
VIEWS["two_paths_v"] = """
    SELECT p_partkey AS row_no, p_type,
           CASE WHEN p_partkey % 9 = 0 THEN 'plain' WHEN p_partkey % 4 = 0 THEN p_type || ':::' || p_type || '///B'
                ELSE p_type || '///B' || ':::' || p_type || '/// A ' || ':::' || p_brand || '///A' || ':::x' END AS category,
           p_brand AS "filter_group:Brand", CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || cast(p_size AS string) || ' ' END AS "filter_group:Size"
    FROM {part}"""
VIEWS["two_paths_v"] = VIEWS["two_paths_v"].replace('"filter_group:Brand"', "fg_brand").replace('"filter_group:Size"', "fg_size")
VIEWS["known_paths_v"] = "SELECT DISTINCT p_type || CASE WHEN p_type < 'M' THEN ' > A' ELSE ' > Z' END AS path FROM {part}"
VIEWS["templates_v"] = f"""
    SELECT p_type || '-' || cast(p_size AS string) || '-' || variant AS template_id, {_PATH} AS category_path, p_type AS t_parent,
           {_LEAF} AS t_leaf, 'Model ' || cast(p_size AS string) AS t_sub, 'exact' AS match_policy,
           CASE WHEN p_size <> 48 AND (p_size > 44 OR variant = 'b' AND p_size < 15) THEN 'draft'
                WHEN p_size % 10 = 0 THEN 'manual_only' WHEN p_size % 10 = 1 THEN 'draft' ELSE 'active' END AS template_status,
           split('general~power', '~') AS section_names,
           CASE variant WHEN 'a' THEN split('color~size~steam~weight', '~') ELSE split('color~size~noise', '~') END AS label_set,
           CASE variant WHEN 'a' THEN split('general color~general size~general steam', '~') ELSE split('general color~general size', '~') END AS pair_set,
           CASE variant WHEN 'a' THEN 'steam' ELSE '' END AS only_label,
           CASE variant WHEN 'a' THEN 1 ELSE CASE WHEN p_size % 4 = 0 THEN 3 ELSE 1 END END AS min_label_overlap,
           1 AS min_section_overlap, 'file_' || variant || '.json' AS source_file
    FROM (SELECT DISTINCT p_type, p_size, 'a' AS variant FROM {{part}}
          UNION SELECT DISTINCT p_type, p_size, 'b' AS variant FROM {{part}}
          UNION SELECT DISTINCT p_type, 48, 'a' AS variant FROM {{part}})"""
VIEWS["filter_groups_v"] = """
    SELECT 'cat_' || p_type AS category_id, 'fg_' || p_type || '_' || lower(g) AS group_id, g AS group_name,
           g = 'Color' AS required, CASE g WHEN 'Mode' THEN 'inactive' WHEN 'Old' THEN 'deprecated' ELSE 'active' END AS status
    FROM (SELECT DISTINCT p_type, 'Color' AS g FROM {part} UNION ALL SELECT DISTINCT p_type, 'Size' FROM {part}
          UNION ALL SELECT DISTINCT p_type, 'Mode' FROM {part} UNION ALL SELECT DISTINCT p_type, 'Old' FROM {part})"""
VIEWS["filter_values_v"] = """
    SELECT 'fg_' || p_type || '_color' AS group_id, v AS value, CASE v WHEN 'Blue' THEN 'deprecated' ELSE 'active' END AS status
    FROM (SELECT DISTINCT p_type, 'Red' AS v FROM {part} UNION ALL SELECT DISTINCT p_type, 'Black' FROM {part}
          UNION ALL SELECT DISTINCT p_type, 'Blue' FROM {part})
    UNION ALL SELECT DISTINCT 'fg_' || p_type || '_size', cast(p_size AS string) || ' kg', 'active' FROM {part}"""
VIEWS["filter_evidence_v"] = """
    SELECT p_partkey AS product_id, 'source' AS kind, 'Color' AS label, CASE WHEN p_partkey % 3 <> 0 THEN split_part(p_name, ' ', 1) ELSE '—' END AS value, 1 AS seq FROM {part}
    UNION ALL SELECT p_partkey, 'manufacturer', 'COLOR', CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 THEN 'black matt' ELSE '' END, 2 FROM {part}
    UNION ALL SELECT p_partkey, 'source', 'size', cast(p_size AS string) || 'kg', 3 FROM {part}
    UNION ALL SELECT p_partkey, 'approved_review', 'Mode', CASE WHEN p_partkey % 7 = 0 THEN 'Turbo' ELSE ' ' END, 4 FROM {part}
    UNION ALL SELECT p_partkey, 'source', 'Mode', 'Eco', 5 FROM {part}
    UNION ALL SELECT p_partkey, 'source', 'Old', CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE 'x' END, 6 FROM {part}"""
VIEWS["specs_v"] = """
    SELECT p_partkey AS product_id, 1 AS priority, 'doc-b' AS document, 'General' AS section, 'Brand' AS label, p_type AS value, 1 AS seq FROM {part}
    UNION ALL SELECT p_partkey, 0, 'doc-a', 'general', 'BRAND:', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END, 2 FROM {part}
    UNION ALL SELECT p_partkey, 1, 'doc-b', 'Power', 'Type & use', p_name, 3 FROM {part}
    UNION ALL SELECT p_partkey, 0, 'doc-a', 'Power', 'Size (cm)', cast(p_size AS string), 4 FROM {part}"""
VIEWS["mpn_candidates_v"] = """
    SELECT p_partkey AS product_id, 'MPN: kx ' || cast(p_partkey AS string) || '/ B' || cast(p_size AS string) AS value, 'source' AS source,
           0.8 AS confidence, 'verified' AS status, 1 AS seq FROM {part}
    UNION ALL SELECT p_partkey, 'KX ' || cast(p_partkey AS string) || '/B' || cast(p_size AS string), 'title', 0.6, 'inferred', 2 FROM {part}
    UNION ALL SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN '' WHEN p_partkey % 4 = 0 THEN 'Z' || cast(p_partkey AS string) WHEN p_partkey % 4 = 1 THEN 'n/a'
        ELSE lpad(cast(p_partkey AS string), 6, '0') END, 'existing', 0.99, 'verified', 3 FROM {part}"""

RULES = [{"reason": "steam_evidence", "points": 3, "path_word": "kettles", "words": ["steam", "boil"]}]


def mk(x: str) -> str:
    """DuckDB text of the match key for plain Latin text."""
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def ws(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda z: z <> ''))"


# -------------------------------------------------------------------- taxonomy
_SOFT = "len(list_filter({a}, lambda l: len(list_filter(name_words, lambda n: l = n OR starts_with(l, n) OR starts_with(n, l) OR (len(l) >= 6 AND len(n) >= 6 AND l[1:6] = n[1:6]))) > 0))"
_TAX = f"""p AS (SELECT product_id, list_transform(breadcrumbs, lambda c: {mk('c')}) AS crumbs, {ws(mk("regexp_replace(url, '^[a-z]+://[^/]*', '')"))} AS uw,
          {ws(mk('name'))} AS name_words, {ws(mk("name || ' ' || url || ' ' || evidence"))} AS ew, {mk("array_to_string(breadcrumbs[2:4], ' > ')")} AS crumb_path FROM tax_products_v),
     t AS (SELECT *, {mk('parent')} AS pk, {mk('leaf')} AS lk, {mk('sub')} AS sk, {mk('path')} AS ptk, {ws(mk('url'))} AS tw FROM paths_v),
     x AS (SELECT p.*, t.*, {ws('lk')} AS lw, {ws('sk')} AS sw, len(list_intersect(uw, tw)) AS shared FROM p, t),
     y AS (SELECT *, {_SOFT.format(a='lw')}::double / greatest(len(lw), 1) * 1.5 AS ls, {_SOFT.format(a='sw')}::double / greatest(len(sw), 1) * 2.0 AS ss,
             list_contains(crumbs, pk) AS c1, list_contains(crumbs, lk) AS c2,
             list_contains(crumbs, sk) OR len(list_filter(crumbs, lambda c: len(list_filter(sw, lambda q: NOT list_contains(string_split(c, ' '), q))) = 0)) > 0 AS c3,
             len(crumbs) >= 3 AND crumb_path = ptk AS c4, list_contains(lw, 'kettles') AND list_has_any(ew, ['steam', 'boil']) AS c5 FROM x),
     c AS (SELECT product_id, path, round(CASE WHEN c1 THEN 3.0 ELSE 0.0 END + CASE WHEN c2 THEN 4.0 ELSE 0.0 END + CASE WHEN c3 THEN 5.0 ELSE 0.0 END + CASE WHEN c4 THEN 4.0 ELSE 0.0 END
               + CASE WHEN shared > 0 THEN least(shared * 0.5, 3.0) ELSE 0.0 END + ls::double + ss::double + CASE WHEN c5 THEN 3.0 ELSE 0.0 END, 4)::double AS confidence,
             concat_ws(',', CASE WHEN c1 THEN 'parent_breadcrumb' END, CASE WHEN c2 THEN 'leaf_breadcrumb' END, CASE WHEN c3 THEN 'sub_breadcrumb' END,
               CASE WHEN c4 THEN 'full_breadcrumb_path' END, CASE WHEN shared > 0 THEN 'url_overlap' END, CASE WHEN ls > 0 THEN 'leaf_name_overlap' END,
               CASE WHEN ss > 0 THEN 'sub_name_overlap' END, CASE WHEN c5 THEN 'steam_evidence' END) AS reasons FROM y)"""


@query(
    "J19_taxonomy_candidates",
    "WITH " + _TAX + """SELECT product_id, path, confidence, replace(reasons, ',', '|') AS reasons FROM c WHERE confidence > 0
       QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY confidence DESC, path) <= 3""",
)
def _(v):
    # The best three paths per product; the task-side cut keeps the others out of the shuffle.
    found = A.taxonomy_candidates(v.tax_products_v, v.paths_v, RULES, 3).where("confidence > 0")
    return A.top_rows(found, ["product_id"], [F.desc("confidence"), F.col("path")], 3).select(
        "product_id", "path", "confidence", "reasons"
    )


@query(
    "D20_taxonomy_resolution",
    "WITH " + _TAX + """, r AS (SELECT *, row_number() OVER w AS rank, lead(confidence, 1, 0.0::double) OVER w AS second FROM c WHERE confidence > 0 WINDOW w AS (PARTITION BY product_id ORDER BY confidence DESC, path)),
       b AS (SELECT *, confidence >= 7 OR (confidence >= 5 AND confidence - second >= 1.5 AND (contains(reasons, 'sub_breadcrumb') OR contains(reasons, 'full_breadcrumb_path')))
              OR (confidence >= 4.5 AND confidence - second >= 2 AND contains(reasons, 'leaf_breadcrumb')) OR (confidence >= 3.5 AND confidence - second >= 2 AND contains(reasons, 'steam_evidence')) AS sure
             FROM r WHERE rank = 1)
       SELECT product_id, CASE WHEN sure THEN path END AS path, confidence, CASE WHEN sure THEN reasons ELSE 'low_confidence' END AS reason FROM b""",
)
def _(v):
    found = A.taxonomy_candidates(v.tax_products_v, v.paths_v, RULES, 2)
    return A.resolve_taxonomy(v.tax_products_v, found, ["steam_evidence"])


@query(
    "W10_taxonomy_margin",
    "WITH " + _TAX + """, r AS (SELECT *, row_number() OVER w AS rank, lead(confidence, 1, 0.0::double) OVER w AS second FROM c WHERE confidence > 0 WINDOW w AS (PARTITION BY product_id ORDER BY confidence DESC, path))
       SELECT product_id, confidence, round(confidence - second, 4) AS lead FROM r WHERE rank = 1""",
)
def _(v):
    found = A.taxonomy_candidates(v.tax_products_v, v.paths_v, RULES, 2).where("confidence > 0")
    top = A.top_rows(found, ["product_id"], [F.desc("confidence"), F.col("path")], 2)
    wide = top.groupBy("product_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("confidence"),
        F.max(F.when(F.col("rank") == 2, F.col("confidence"))).alias("second"),
    )
    return wide.select(
        "product_id", "confidence", F.round(F.col("confidence") - F.coalesce("second", F.lit(0.0)), 4).alias("lead")
    )


@query(
    "D21_category_hint",
    """SELECT product_id, CASE WHEN contains(name, 'wash') AND product_id % 2 = 0 THEN 'Laundry > Washers' WHEN contains(name, 'dryer') THEN 'Laundry > Dryers' WHEN contains(name, 'set') THEN 'Sets' END AS hint_path,
          CASE WHEN contains(name, 'wash') AND product_id % 2 = 0 THEN 0 WHEN contains(name, 'dryer') THEN 1 WHEN contains(name, 'set') THEN 2 END::bigint AS rule_no FROM tax_products_v""",
)
def _(v):
    rules = [("laundry", "name", "wash", "Laundry > Washers"), ("", "name", "dryer", "Laundry > Dryers"), ("", "name", "(^| )set( |$)", "Sets")]
    rows = v.tax_products_v.withColumn("family", F.when(F.col("product_id") % 2 == 0, "laundry").otherwise("other"))
    return A.category_hint(rows, rules).select("product_id", "hint_path", "rule_no")


_SELECT = """s AS (SELECT *, CASE WHEN row_no % 9 = 0 THEN [] WHEN row_no % 4 = 0 THEN [p_type || ' > B'] ELSE [p_type || ' > B', p_type || ' > A', split_part(category, ':::', 3)] END AS ps0 FROM two_paths_v),
     s1 AS (SELECT * EXCLUDE ps0, list_transform(ps0, lambda x: replace(x, '///', ' > ')) AS ps FROM s),
     s2 AS (SELECT s1.*, list_intersect(ps, kp) AS known FROM s1, (SELECT list(path) AS kp FROM known_paths_v)),
     s3 AS (SELECT *, CASE WHEN len(ps) = 0 THEN 'none' WHEN len(ps) = 1 THEN 'deepest' WHEN len(known) = 1 THEN 'existing' ELSE 'first_deepest' END AS how FROM s2),
     s4 AS (SELECT *, CASE WHEN how = 'existing' THEN known[1] ELSE ps[1] END AS path FROM s3)"""


@query("FN14_category_path_choice", "WITH " + _SELECT + "SELECT row_no, how, path FROM s4")
def _(v):
    return A.select_category_path(v.two_paths_v, v.known_paths_v).select("row_no", "how", "path")


@query(
    "FN13_deepest_category",
    "SELECT row_no, CASE WHEN row_no % 9 = 0 THEN 'plain' WHEN row_no % 4 = 0 THEN p_type || '|B' ELSE split_part(split_part(category, ':::', 3), '///', 1) || '|A' END AS levels FROM two_paths_v",
)
def _(v):
    return v.two_paths_v.select("row_no", G.deepest_levels(F.col("category")).alias("levels"))


@query(
    "FN15_serialize_category",
    "SELECT path, parent || ':::' || parent || '///' || leaf || ':::' || parent || '///' || leaf || '///' || sub AS category FROM paths_v",
)
def _(v):
    return v.paths_v.select(
        "path", G.serialize_category(F.col("parent"), F.col("leaf"), F.array("sub", F.lit(""), "sub")).alias("category")
    )


@query(
    "FN19_stable_ids",
    "SELECT path, 'cat_' || substr(sha1(path), 1, 12) AS category_id, 'fg_' || substr(sha1('cat_' || substr(sha1(path), 1, 12) || '::' || sub), 1, 12) AS group_id FROM paths_v",
)
def _(v):
    category = G.stable_id("cat_", F.col("path"))
    return v.paths_v.select("path", category.alias("category_id"), G.stable_id("fg_", category, F.col("sub")).alias("group_id"))


# ------------------------------------------------------------------- templates
def _template_products(v):
    part = v.part
    k, size = F.col("p_partkey"), F.col("p_size")
    spec = lambda section, label: F.struct(F.lit(section).alias("section"), F.lit(label).alias("label"))
    none = F.array().cast("array<struct<section:string,label:string>>")
    specs = F.concat(
        F.array(spec("General", "Color"), spec(" General", "SIZE")),
        F.when(k % 2 == 0, F.array(spec("General", "Steam"))).otherwise(none),
        F.when(k % 5 == 0, F.array(spec("General", "Forbid"))).otherwise(none),
        F.when(k % 3 == 0, F.array(spec("Power", "Noise"))).otherwise(none),
    )
    leaf = F.when(size % 3 == 0, "Washers").when(size % 3 == 1, "Dryer units").otherwise("Kettles")
    sub = F.concat(F.lit("Model "), size.cast("string"))
    return part.select(
        k.alias("product_id"), F.col("p_type").alias("parent"), leaf.alias("leaf"), sub.alias("sub"),
        F.concat_ws(" > ", "p_type", leaf, sub).alias("taxonomy_path"),
        F.when(k % 11 == 0, F.array(F.lit("FILE b json"))).otherwise(F.array().cast("array<string>")).alias("preferred_files"),
        specs.alias("specs"),
    )


def _templates(v):
    none = F.array().cast("array<string>")
    only = F.when(F.col("only_label") != "", F.array("only_label")).otherwise(none)
    exact = v.templates_v.withColumns({
        "discriminators": only, "required_any": only, "required_all": none,
        "forbidden": F.when(F.col("only_label") != "", F.array(F.lit("forbid"))).otherwise(none),
        "source_files": F.array("source_file"),
    }).drop("only_label", "source_file")
    # A template of size 48 stands for the whole leaf of its type.
    leafy = F.col("t_sub") == "Model 48"
    return exact.withColumns({
        "t_sub": F.when(leafy, "").otherwise(F.col("t_sub")),
        "category_path": F.when(leafy, F.concat_ws(" > ", "t_parent", "t_leaf")).otherwise(F.col("category_path")),
        "match_policy": F.when(leafy, "leaf_family").otherwise(F.col("match_policy")),
    })


_POOL = f"""t AS (SELECT * REPLACE (CASE WHEN t_sub = 'Model 48' THEN '' ELSE t_sub END AS t_sub, CASE WHEN t_sub = 'Model 48' THEN t_parent || ' > ' || t_leaf ELSE category_path END AS category_path) FROM templates_v),
     p AS (SELECT p_partkey AS product_id, p_type, {_LEAF} AS leaf, {_PATH} AS path, p_partkey % 11 = 0 AS pref,
             p_partkey % 2 = 0 AS steam, p_partkey % 5 = 0 AS forbid, p_partkey % 3 = 0 AS power FROM part),
     e AS (SELECT p.*, t.template_id, t.template_status, t.only_label, t.min_label_overlap, t.source_file, 0 AS tier FROM p JOIN t ON t.category_path = p.path
           UNION ALL SELECT p.*, t.template_id, t.template_status, t.only_label, t.min_label_overlap, t.source_file, 1 FROM p JOIN t ON t.t_sub = '' AND t.t_parent = p.p_type AND t.t_leaf = p.leaf),
     e2 AS (SELECT * FROM e QUALIFY tier = min(tier) OVER (PARTITION BY product_id)),
     pool AS (SELECT * FROM (SELECT *, max(pref AND source_file = 'file_b.json') OVER (PARTITION BY product_id) AS anyp FROM e2) WHERE NOT anyp OR source_file = 'file_b.json'),
     g AS (SELECT *, CASE WHEN power THEN 2 ELSE 1 END AS so, 2 + CASE WHEN only_label <> '' THEN steam::int ELSE power::int END AS lo,
             2 + CASE WHEN only_label <> '' THEN steam::int ELSE 0 END AS po, CASE WHEN only_label <> '' THEN steam::int ELSE 0 END AS dx FROM pool),
     h AS (SELECT *, concat_ws('|', CASE WHEN only_label <> '' AND NOT steam THEN 'missing_required_labels_any' END, CASE WHEN only_label <> '' AND forbid THEN 'forbidden_labels_present' END,
             CASE WHEN lo < min_label_overlap THEN 'min_label_overlap' END) AS reasons,
             round(so::double / 2 * 0.2 + lo::double / CASE WHEN only_label <> '' THEN 4 ELSE 3 END * 0.3 + po::double / CASE WHEN only_label <> '' THEN 3 ELSE 2 END * 0.4
                   + dx::double * 0.1, 4) AS score FROM g)"""


@query("J18_template_pool", "WITH " + _POOL + "SELECT product_id, template_id, tier::bigint AS tier FROM pool")
def _(v):
    return A.template_pool(_template_products(v), _templates(v)).select("product_id", "template_id", "tier")


def _gated(v):
    products = _template_products(v)
    pool = A.template_pool(products, _templates(v))
    return products, pool, A.product_label_sets(products.select("product_id", "specs"))


@query("SO4_template_gates", "WITH " + _POOL + "SELECT product_id, template_id, reasons AS gate_reasons, score FROM h")
def _(v):
    _p, pool, sets = _gated(v)
    return A.gate_templates(pool, sets).select("product_id", "template_id", "gate_reasons", "score")


@query(
    "D22_template_match",
    "WITH " + _POOL + """, s AS (SELECT product_id, count(*) AS pool_size, count(*) FILTER (template_status = 'active') AS act, count(*) FILTER (template_status <> 'manual_only') AS nm,
           count(*) FILTER (template_status = 'active' AND reasons = '') AS ok,
           bool_and(contains(reasons, 'required') OR contains(reasons, 'forbidden')) FILTER (template_status = 'active') AS lab,
           bool_and(reasons = 'min_label_overlap') FILTER (template_status = 'active') AS lc FROM h GROUP BY 1),
       b AS (SELECT h.product_id, h.template_id, CASE WHEN act = 1 THEN 1.0 ELSE score END AS score, CASE WHEN act = 1 THEN 'direct_single' ELSE 'category_pool' END AS match_mode,
           row_number() OVER (PARTITION BY h.product_id ORDER BY score DESC, po DESC, lo DESC, so DESC, dx DESC, template_id) AS k FROM h JOIN s USING (product_id) WHERE template_status = 'active' AND (act = 1 OR reasons = ''))
       SELECT p.product_id, template_id, coalesce(score, 0.0)::double AS score, match_mode, coalesce(pool_size, 0) AS pool_size,
          CASE WHEN template_id IS NOT NULL THEN '' WHEN pool_size IS NULL THEN 'pool_empty_for_category' WHEN act = 0 AND nm = 0 THEN 'manual_only_category' WHEN act = 0 THEN 'no_active_templates'
               WHEN lab THEN 'discriminator_miss' WHEN lc THEN 'insufficient_label_overlap' ELSE 'no_safe_template_match' END AS fail_reason,
          coalesce(match_mode = 'category_pool' AND ok > 1 AND score < 0.35, false) AS weak_match
       FROM p LEFT JOIN s USING (product_id) LEFT JOIN b ON b.product_id = p.product_id AND k = 1""",
)
def _(v):
    return A.match_templates(*_gated(v))


@query(
    "W11_best_template",
    "WITH " + _POOL + """SELECT product_id, template_id FROM h WHERE template_status = 'active' AND reasons = ''
       QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, po DESC, lo DESC, so DESC, dx DESC, template_id) = 1""",
)
def _(v):
    _p, pool, sets = _gated(v)
    passed = A.gate_templates(pool, sets).where("template_status = 'active' AND size(gate_reasons) = 0")
    order = [-F.col(c) for c in ("score", "pair_overlap", "label_overlap", "section_overlap", "discriminator_overlap")]
    return A.first_row(passed, ["product_id"], [*order, F.col("template_id")], ["template_id"])


@query(
    "A33_template_discriminators",
    """WITH r AS (SELECT category_path, template_id, unnest(label_set) AS label, generate_subscripts(label_set, 1) AS pos FROM templates_v WHERE template_status = 'active'),
       o AS (SELECT category_path, label, count(DISTINCT template_id) = 1 AS u FROM r GROUP BY 1, 2),
       m AS (SELECT r.*, u, max(u) OVER (PARTITION BY template_id) AS au FROM r JOIN o USING (category_path, label)),
       c AS (SELECT *, CASE WHEN u OR NOT au THEN row_number() OVER (PARTITION BY template_id, (u OR NOT au) ORDER BY pos) END AS place FROM m)
       SELECT category_path, template_id, label, u AS discriminator, coalesce(place, 99) <= 3 AS required_any, u AND coalesce(place = 1, false) AS required_all FROM c""",
)
def _(v):
    rows = A.template_discriminators(v.templates_v)
    return rows.withColumn("required_all", F.coalesce("required_all", F.lit(False)))


@query(
    "A33_template_gate_sizes",
    """WITH a AS (SELECT category_path, count(DISTINCT label) AS n FROM (SELECT category_path, unnest(label_set) AS label FROM templates_v WHERE template_status = 'active') GROUP BY 1)
       SELECT template_id, n - len(label_set) AS forbidden_labels, 1::bigint AS min_section_overlap, 1::bigint AS min_label_overlap
       FROM templates_v JOIN a USING (category_path) WHERE template_status = 'active'""",
)
def _(v):
    return A.template_gates(v.templates_v)


@query(
    "J22_template_coverage",
    """WITH s AS (SELECT category_path, count(*) AS n, min(template_status) AS st, min(template_id) AS template_id FROM templates_v GROUP BY 1)
       SELECT coalesce(path, category_path) AS category_path, coalesce(n, 0) AS templates, template_id,
          CASE WHEN path IS NULL THEN 'UNBOUND' WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'REVIEW' WHEN st = 'manual_only' THEN 'NEEDS_MANUAL' ELSE 'OK' END AS state
       FROM paths_v FULL OUTER JOIN s ON s.category_path = path""",
)
def _(v):
    return A.template_coverage(v.paths_v.select(F.col("path").alias("category_path")), v.templates_v)


@query(
    "J30_template_binding",
    f"""WITH t AS (SELECT template_id, CASE WHEN t_parent < 'M' THEN '' ELSE 'https://x.example.com/' || lower(t_parent) || '/' || lower(t_leaf) END AS cta, {mk('t_sub')} AS lk,
             {ws(mk("template_id || ' ' || t_sub || ' ' || source_file"))} AS tw FROM templates_v),
       p AS (SELECT path, url, {mk('sub')} AS sk, {ws(mk("parent || ' ' || leaf || ' ' || sub || ' ' || path"))} AS pw FROM paths_v),
       c AS (SELECT template_id, path, 0 AS tier, len(list_intersect(tw, pw)) AS shared FROM t JOIN p ON cta = url WHERE cta <> ''
             UNION ALL SELECT template_id, path, 1, len(list_intersect(tw, pw)) FROM t JOIN p ON lk = sk),
       g AS (SELECT template_id, tier, count(*) AS n, max(shared) AS mx FROM c GROUP BY 1, 2),
       b AS (SELECT template_id, tier, min(path) AS path FROM c JOIN g USING (template_id, tier) WHERE shared = mx GROUP BY template_id, tier HAVING min(n) = 1 OR (min(mx) > 0 AND count(*) = 1)),
       f AS (SELECT template_id, min(tier) AS tier, arg_min(path, tier) AS path FROM b GROUP BY 1)
       SELECT t.template_id, f.tier::bigint AS tier, f.path FROM t LEFT JOIN f ON f.template_id = t.template_id""",
)
def _(v):
    t = v.templates_v.select(
        "template_id", F.col("t_sub").alias("label"), "source_file",
        F.when(F.col("t_parent") < "M", "").otherwise(
            F.concat(F.lit("https://x.example.com/"), F.lower("t_parent"), F.lit("/"), F.lower("t_leaf"))).alias("cta_url"),
    )
    return A.bind_templates(t, v.paths_v)


@query(
    "A34_duplicate_keys",
    "SELECT p_name AS key, count(*) AS uses, min(p_brand) AS first_use FROM part GROUP BY 1 HAVING count(*) > 1",
)
def _(v):
    rows = v.part.select(F.col("p_name").alias("key"), F.col("p_brand").alias("place"))
    return A.duplicate_keys(rows, "key", "place")


# ------------------------------------------------------------------ filter map
def _map_catalog(v):
    rows = A.select_category_path(v.two_paths_v, v.known_paths_v)
    return rows.withColumnsRenamed({"fg_brand": "filter_group:Brand", "fg_size": "filter_group:Size"})


_MAP = _SELECT + """, m AS (SELECT DISTINCT path, 'Brand' AS group_name, fg_brand AS value FROM s4 WHERE path IS NOT NULL AND fg_brand <> ''
        UNION SELECT DISTINCT path, 'Size', trim(fg_size) FROM s4 WHERE path IS NOT NULL AND trim(fg_size) <> ''),
     m1 AS (SELECT *, 'cat_' || substr(sha1(path), 1, 12) AS category_id FROM m), m2 AS (SELECT *, 'fg_' || substr(sha1(category_id || '::' || group_name), 1, 12) AS group_id FROM m1),
     m3 AS (SELECT *, 'fv_' || substr(sha1(group_id || '::' || value), 1, 12) AS value_id FROM m2)"""


@query("A31_filter_map", "WITH " + _MAP + "SELECT path, group_name, value, category_id, group_id, value_id FROM m3")
def _(v):
    return A.filter_map_rows(_map_catalog(v), ["Brand", "Size"])


@query(
    "A31_filter_map_counts",
    "WITH " + _MAP + """SELECT (SELECT count(DISTINCT path) FROM s4 WHERE path IS NOT NULL) AS categories_seen,
        (SELECT count(DISTINCT path) FROM s4 WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM known_paths_v)) AS categories_added,
        (SELECT count(DISTINCT group_id) FROM m3) AS groups_seen, (SELECT count(DISTINCT value_id) FROM m3) AS values_seen""",
)
def _(v):
    catalog = _map_catalog(v)
    return A.filter_map_counts(A.filter_map_rows(catalog, ["Brand", "Size"]), catalog, v.known_paths_v)


@query(
    "A32_filter_category_counts",
    """SELECT category_id, count(*) AS groups, count(*) FILTER (status = 'active') AS active, count(*) FILTER (required) AS required,
          count(*) FILTER (status = 'inactive') AS inactive, count(*) FILTER (status = 'deprecated') AS deprecated FROM filter_groups_v GROUP BY 1""",
)
def _(v):
    return A.filter_category_counts(v.filter_groups_v)


VIEWS["overrides_v"] = """
    SELECT group_id, group_name = 'Old' AS omit, CASE WHEN group_name = 'Size' THEN 'Weight' ELSE NULL END AS name,
           CASE WHEN group_name = 'Mode' THEN 'active' ELSE NULL END AS status FROM {filter_groups_v}
    UNION ALL SELECT 'new_' || group_id, false, CASE WHEN group_name = 'Color' THEN 'Shade' ELSE NULL END, 'active' FROM {filter_groups_v}"""


@query(
    "U12_filter_overrides",
    """SELECT group_id, CASE WHEN group_name = 'Size' THEN 'Weight' ELSE group_name END AS name, CASE WHEN group_name = 'Mode' THEN 'active' ELSE status END AS status,
          CASE WHEN group_name IN ('Size', 'Mode') THEN 'overridden' ELSE 'kept' END AS action FROM filter_groups_v WHERE group_name <> 'Old'
       UNION ALL SELECT 'new_' || group_id, 'Shade', 'active', 'added' FROM filter_groups_v WHERE group_name = 'Color'""",
)
def _(v):
    base = v.filter_groups_v.select("group_id", F.col("group_name").alias("name"), "status")
    return A.apply_overrides(base, v.overrides_v, "group_id", ["name", "status"])


@query(
    "J20_filter_category",
    """SELECT p_partkey AS product_id, 'cat_' || p_type AS filter_category_id, CASE WHEN p_partkey % 3 = 0 THEN 'category_id' ELSE 'path' END AS found_by FROM part WHERE p_partkey % 6 <> 0
       UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'cat_' || p_type END, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'category_id' END FROM part WHERE p_partkey % 6 = 0""",
)
def _(v):
    categories = v.filter_groups_v.select("category_id", F.concat(F.lit("Root > "), F.substring("category_id", 5, 50)).alias("path")).distinct()
    k = F.col("p_partkey")
    products = v.part.select(
        k.alias("product_id"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("root >  "), F.lower("p_type"))).alias("taxonomy_path"),
        F.when((k % 6 == 0) & (k % 4 == 0), "none").otherwise(F.concat(F.lit("cat_"), "p_type")).alias("category_id"),
    )
    return A.find_filter_category(products, categories).select("product_id", "filter_category_id", "found_by")


_FILTERS = """r AS (SELECT p_partkey AS product_id, 'fg_' || p_type || '_color' AS group_id, 'Color' AS group_name, 'active' AS group_status, true AS required,
          CASE WHEN p_partkey % 3 <> 0 THEN CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'Red' WHEN 'blue' THEN 'Blue' WHEN 'black' THEN 'Black' ELSE split_part(p_name, ' ', 1) END
               WHEN p_partkey % 5 <> 0 THEN 'Black' ELSE '' END AS v, CASE WHEN p_partkey % 3 <> 0 THEN 'source_exact' WHEN p_partkey % 5 <> 0 THEN 'normalized_manufacturer' ELSE '' END AS f FROM part
        UNION ALL SELECT p_partkey, 'fg_' || p_type || '_size', 'Size', 'active', false, p_size || ' kg', 'normalized_source' FROM part
        UNION ALL SELECT p_partkey, 'fg_' || p_type || '_mode', 'Mode', 'inactive', false, CASE WHEN p_partkey % 7 = 0 THEN 'Turbo' ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN 'approved_review' ELSE '' END FROM part
        UNION ALL SELECT p_partkey, 'fg_' || p_type || '_old', 'Old', 'deprecated', false, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'x' END, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'source_exact' END FROM part),
     d AS (SELECT product_id, group_id, group_name, group_status, required, v AS resolved_value, f AS resolved_from, v <> '' AS emitted, required AND v = '' AS missing_required,
          group_name = 'Color' AND v NOT IN ('', 'Red', 'Blue', 'Black') AS outside_allowed, v = 'Blue' AS deprecated_value FROM r)"""


def _filters(v):
    products = v.part.select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("cat_"), "p_type").alias("filter_category_id"))
    values = v.filter_values_v.withColumn("aliases", F.array().cast("array<string>"))
    return A.resolve_filter_values(products, v.filter_groups_v, values, v.filter_evidence_v)


@query("D23_filter_values", "WITH " + _FILTERS + "SELECT * FROM d")
def _(v):
    return _filters(v)


@query(
    "D24_filter_review_state",
    "WITH " + _FILTERS + """SELECT product_id, count(*) AS groups, count(*) FILTER (emitted) AS emitted, count(*) FILTER (missing_required) AS missing_required,
        count(*) FILTER (outside_allowed) AS outside_allowed, count(*) FILTER (deprecated_value) AS deprecated_values,
        NOT bool_or(missing_required OR outside_allowed OR deprecated_value) AS gate_open FROM d GROUP BY 1""",
)
def _(v):
    return A.filter_review_state(_filters(v))


# ----------------------------------------------------------------------- specs
@query(
    "W15_first_spec_value",
    """SELECT p_partkey AS product_id, 'brand' AS label_key, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END AS value FROM part
       UNION ALL SELECT p_partkey, 'type και use', p_name FROM part UNION ALL SELECT p_partkey, 'size cm', p_size::varchar FROM part""",
)
def _(v):
    return A.spec_lookup(v.specs_v).select("product_id", "label_key", "value")


@query(
    "J21_label_alias_family",
    """SELECT product_id, label, CASE WHEN label IN ('Brand', 'BRAND:') THEN 'maker' WHEN label = 'Size (cm)' THEN 'dimension' END AS family_id FROM specs_v""",
)
def _(v):
    aliases = v.spark.createDataFrame(
        [("maker", "Brand", 1), ("maker", "Maker", 2), ("dimension", "size cm", 3), ("other", "brand", 4)], "family_id string, alias string, seq int"
    )
    return A.with_alias_family(v.specs_v, aliases).select("product_id", "label", "family_id")


@query(
    "D39_spec_merge",
    """SELECT p_partkey AS product_id, 'general' AS section_key, 'brand' AS label_key, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END AS value,
          CASE WHEN p_partkey % 4 = 0 THEN 'doc-b' ELSE 'doc-a' END AS document FROM part
       UNION ALL SELECT p_partkey, 'power', 'type και use', p_name, 'doc-b' FROM part UNION ALL SELECT p_partkey, 'power', 'size cm', p_size::varchar, 'doc-a' FROM part""",
)
def _(v):
    return A.merge_spec_sections(v.specs_v).select("product_id", "section_key", "label_key", "value", "document")


def _spec_products(v):
    k = F.col("p_partkey")
    s = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    none = F.array().cast("array<struct<label:string,value:string>>")
    return v.part.select(
        k.alias("product_id"), F.concat(F.lit("t-"), "p_type").alias("template_id"), F.col("p_brand").alias("brand"), F.concat(F.lit("M"), k).alias("mpn"),
        F.col("p_type").alias("leaf"), F.when(F.col("p_size") % 2 == 0, "Even").otherwise("Odd").alias("sub"), F.lit("fem").alias("gender"),
        F.concat(
            F.array(s("Net weight in kg", F.col("p_size").cast("string")), s("Finish", F.lit("—"))),
            F.when(k % 2 == 0, F.array(s("COLOUR:", F.split("p_name", " ")[0]))).otherwise(none),
        ).alias("specs"),
        F.when(k % 3 == 0, F.array(s("Color", F.lit("from text")))).otherwise(none).alias("description_specs"),
    )


@query(
    "D25_template_fields",
    """SELECT p_partkey AS product_id, 'color' AS field, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) WHEN p_partkey % 3 = 0 THEN 'from text' END AS value,
          CASE WHEN p_partkey % 2 = 0 THEN 'exact_spec:COLOUR:' WHEN p_partkey % 3 = 0 THEN 'description_exact_spec:Color' ELSE 'unresolved' END AS source FROM part
       UNION ALL SELECT p_partkey, 'weight', p_size::varchar, 'fuzzy_spec:Net weight in kg' FROM part
       UNION ALL SELECT p_partkey, 'finish', 'n/a', 'fallback' FROM part""",
)
def _(v):
    # Every product type has a template of its own with the same three fields.
    field = lambda name, aliases, fallback: F.struct(
        F.lit(name).alias("field"), F.array(*map(F.lit, aliases)).alias("aliases"), F.lit(fallback).cast("string").alias("fallback"))
    listed = F.array(field("color", ["Color", "Colour"], None), field("weight", ["Net weight"], None), field("finish", ["Finish"], "n/a"))
    fields = v.part.select(F.concat(F.lit("t-"), "p_type").alias("template_id")).distinct().select("template_id", F.inline(listed))
    return A.fill_template_fields(_spec_products(v), fields).drop("template_id")


@query(
    "D26_name_composition",
    """SELECT product_id, d AS differentiators, trim(brand || ' ' || mpn || ' ' || phrase || ' ' || replace(d, '|', ' ')) AS name,
          'Η ' || brand || ' ' || mpn || ' είναι ' || phrase || CASE WHEN d <> '' THEN ' με ' || replace(d, '|', ', ') ELSE '' END || '.' AS meta_draft
       FROM (SELECT p_partkey AS product_id, p_brand AS brand, 'M' || p_partkey AS mpn, CASE WHEN p_size % 2 = 0 THEN 'Even thing' ELSE 'Thing' END AS phrase,
             CASE WHEN p_size % 2 = 0 THEN p_size::varchar ELSE concat_ws('|', CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) END, p_size::varchar) END AS d FROM part WHERE p_type = 'PROMO' OR p_size % 2 = 0)""",
)
def _(v):
    weight, color = ["Net weight"], ["Colour"]
    rules = [(t, "Even", "Even thing", [weight, color], 1) for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")]
    rules.append(("PROMO", "", "Thing", [color, weight], 2))
    frame = v.spark.createDataFrame(rules, "leaf string, sub string, category_phrase string, alias_groups array<array<string>>, max_differentiators int")
    return A.compose_names(_spec_products(v), frame)


_IDENT = """p AS (SELECT p_partkey AS k, 'KX ' || p_partkey || '/B' || p_size AS setv, 'kx ' || p_partkey || '/B' || p_size AS shown, p_size % 3 = 0 AND p_partkey % 4 = 0 AS extra, p_partkey % 2 = 0 AS ac FROM part),
     i AS (SELECT k AS product_id, CASE WHEN extra AND ac THEN '' WHEN extra THEN 'Z' || k ELSE shown END AS mpn,
           CASE WHEN extra AND ac THEN 'conflicting' ELSE 'verified' END AS mpn_status, CASE WHEN extra AND ac THEN 'unknown' WHEN extra THEN 'single_unit' ELSE 'complete_set' END AS mpn_scope,
           CASE WHEN extra AND ac THEN 0.0 WHEN extra THEN 0.99 ELSE 0.8 END::double AS confidence, CASE WHEN extra THEN 2 ELSE 1 END::bigint AS candidates FROM p)"""


def _identity(v):
    k = F.col("p_partkey")
    products = v.part.select(k.alias("product_id"), F.lpad(k.cast("string"), 6, "0").alias("model"),
                             F.when(k % 2 == 0, "air_conditioner").otherwise("other").alias("family"))
    return A.resolve_identity(products, v.mpn_candidates_v)


@query("D27_identity", "WITH " + _IDENT + "SELECT * FROM i")
def _(v):
    return _identity(v).drop("model", "family", "source")


@query(
    "D27_identity_errors",
    "WITH " + _IDENT + """SELECT product_id, concat_ws('|', CASE WHEN mpn_status = 'conflicting' THEN 'mpn_candidates_conflicting' END,
        CASE WHEN mpn <> '' AND mpn_scope = 'single_unit' THEN 'csv_mpn_identity_mismatch' END, CASE WHEN mpn_status <> 'verified' THEN 'mpn_not_verified' END) AS errors FROM i""",
)
def _(v):
    rows = _identity(v).join(v.part.select(F.col("p_partkey").alias("product_id"), "p_size"), "product_id")
    csv = F.concat(F.lit("KX "), "product_id", F.lit(" / b"), "p_size")
    return rows.select("product_id", A.identity_errors(csv, F.lit(True)).alias("errors"))


# ---------------------------------------------------------------------- values
@query(
    "FN37_measurement",
    """SELECT p_partkey AS product_id, p_size || ',5 kg' AS weight, CASE WHEN p_size % 2 = 0 THEN p_size || '0W' ELSE p_size || ',5 kg' END AS first_found,
          p_size || '.00L'  AS capacity FROM part""",
)
def _(v):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("Load "), size, F.lit(",5 kg with "), size, F.lit(".00L tank"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), size, F.lit("0W"))).otherwise(""))
    return v.part.select(
        F.col("p_partkey").alias("product_id"), N.measurement_in_text(text, ["kg"]).alias("weight"),
        N.measurement_in_text(text, ["kg", "watt"]).alias("first_found"), N.measurement_in_text(text, ["lt"]).alias("capacity"),
    )


# Label, value and category of a field; the unit is what a reader expects, by number of the case.
_UNIT_CASES = [
    ("Net βάρος", "5", ""), ("Όγκος", "5lt", ""), ("Πόδια", "12cm", ""), ("Πόδια", "12 cm", ""), ("Τάση", "230", ""),
    ("Ισχύς", "800", ""), ("Χωρητικότητα", "8", "Πλυντήρια Ρούχων"), ("Χωρητικότητα", "320", "Ψυγεία"), ("Χωρητικότητα", "8", "Τηλεοράσεις"),
    ("Χρώμα", "μαύρο", "Ψυγεία"), ("Φορτίο", "8", ""), ("Ύψος", "85", "Πλυντήρια"),
]


@query(
    "FN37_unit",
    """SELECT p_partkey AS product_id, list_extract(['kg', 'Lt', 'cm', 'cm', 'V', 'W', 'kg', 'Lt', '', '', 'kg', 'cm'], (p_partkey % 12 + 1)::int) AS unit FROM part""",
)
def _(v):
    cases = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(c, ("label", "value", "category"))]) for c in _UNIT_CASES])
    case = F.element_at(cases, (F.col("p_partkey") % len(_UNIT_CASES) + 1).cast("int"))
    return v.part.select(F.col("p_partkey").alias("product_id"), N.unit_of(case["label"], case["value"], case["category"]).alias("unit"))


@query(
    "FN37_compact_unit",
    "SELECT p_partkey AS product_id, p_size || 'kg' AS compact FROM part",
)
def _(v):
    return v.part.select(
        F.col("p_partkey").alias("product_id"), N.compact_unit_value(F.concat("p_size", F.lit(",00 kg")), "kg").alias("compact")
    )


@query(
    "FN38_value_alias_keys",
    """SELECT p_partkey AS product_id, CASE p_partkey % 6 WHEN 0 THEN p_size || 'kg|' || p_size || ' kg|' || p_size
            WHEN 1 THEN 'front load|εμπρος' WHEN 2 THEN p_size || '|' || p_size || ' kg|' || p_size || 'lt|' || p_size || ' rpm'
            WHEN 3 THEN 'silver|ασημι' WHEN 4 THEN p_size || ' κιλα|' || p_size || ' kg|' || p_size ELSE '4k uhd|4k ultra hd|ultra hd 4k|ultra hd' END AS keys FROM part""",
)
def _(v):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    value = (F.when(kind == 0, F.concat(size, F.lit("KG"))).when(kind == 1, "Front Load").when(kind == 2, size)
             .when(kind == 3, "Silver").when(kind == 4, F.concat(size, F.lit(" κιλά"))).otherwise("4K UHD"))
    return v.part.select(F.col("p_partkey").alias("product_id"), N.value_alias_keys(value).alias("keys"))


# Titles by number of the case, and the class that a reader finds in them.
_CLASS_CASES = ["ψυγείο a++ inverter", "fridge α+ white", "X B A++ 5", "Y Β, 3", "no class here", "Κλάση C/D+", "TV G/F", "oven A+++", "δ+ γ"]


@query(
    "FN39_energy_and_btu",
    """SELECT p_partkey AS product_id, list_extract(['A++', 'A+', 'A++', 'B', '', 'C', '', 'A+++', 'D+'], (p_partkey % 9 + 1)::int) AS energy, p_size || '000 BTU' AS btu,
          CASE p_size % 2 WHEN 0 THEN 'C+' ELSE '' END AS class_text FROM part""",
)
def _(v):
    size = F.col("p_size")
    title = F.element_at(F.array(*[F.lit(t) for t in _CLASS_CASES]), (F.col("p_partkey") % len(_CLASS_CASES) + 1).cast("int"))
    return v.part.select(
        F.col("p_partkey").alias("product_id"), N.energy_class_in_text(title).alias("energy"),
        N.btu_in_text(F.concat("p_brand", F.lit(" "), size.cast("string"), F.lit(".000 BTU"))).alias("btu"),
        N.energy_class(F.when(size % 2 == 0, "(Γ+)").otherwise("kappa")).alias("class_text"),
    )


@query(
    "FN40_yes_no",
    "SELECT p_partkey AS product_id, CASE p_size % 3 WHEN 0 THEN 'Ναι' WHEN 1 THEN 'Όχι' ELSE '' END AS answer FROM part",
)
def _(v):
    text = F.when(F.col("p_size") % 3 == 0, "Υποστηρίζεται").when(F.col("p_size") % 3 == 1, "ΟΧΙ").otherwise("maybe")
    return v.part.select(F.col("p_partkey").alias("product_id"), N.yes_no(text).alias("answer"))
