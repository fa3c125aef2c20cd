"""Domain-shaped views over the driver tables.

Each view is one SELECT that Spark and DuckDB both understand; ``{name}`` stands for
a driver table or another view. ``SPARK_VIEWS`` are computed by operators instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_PAD = (
    "CASE WHEN {k} < 1000000 THEN lpad(cast({k} AS string), 6, '0') ELSE cast({k} AS string) END"
)


def _pad(key: str) -> str:
    return _PAD.replace("{k}", key)


VIEWS: dict[str, str] = {
    # One text row per product, as a catalog export delivers it.
    "catalog_raw_v": f"""
        SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 17 = 0
                    THEN ({_pad('p_partkey')}) || '-' || ({_pad('(p_partkey + 1)')})
                    ELSE {_pad('p_partkey')} END AS model,
               CASE WHEN p_partkey % 10 = 0 THEN ''
                    WHEN p_partkey % 11 = 0 THEN 'MPN-' || cast(p_partkey + 1 AS string)
                    ELSE ' MPN-' || cast(p_partkey AS string) || ' ' END AS mpn,
               CASE WHEN p_partkey % 13 = 0 THEN '  Ψυγείο  ' || p_name || ' Λευκό '
                    WHEN p_partkey % 53 = 0 THEN ''
                    ELSE p_name || ' ' || cast(p_size AS string) END AS name,
               CASE WHEN p_partkey % 29 = 0 THEN ''
                    WHEN p_partkey % 31 = 0 THEN p_type
                    ELSE p_type || ':::' || p_type || '/// size '
                         || cast(p_size % 3 AS string) || ':::' || p_type || '///size '
                         || cast(p_size % 3 AS string) || '///S' || cast(p_size AS string)
               END AS category,
               CASE WHEN p_partkey % 37 = 0 THEN '' ELSE p_brand END AS manufacturer,
               CASE WHEN p_partkey % 19 = 0 THEN ''
                    WHEN p_partkey % 43 = 0 THEN 'n/a'
                    WHEN p_partkey % 41 = 0 THEN replace(cast(p_retailprice AS string), '.', ',')
                    ELSE cast(p_retailprice AS string) END AS price,
               CASE WHEN p_partkey % 47 = 0 THEN '' ELSE cast(p_size - 5 AS string) END AS quantity,
               CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE '1' END AS status,
               CASE WHEN p_partkey % 3 = 0 THEN '1' WHEN p_partkey % 3 = 1 THEN '0' ELSE '' END
                    AS market_a_status,
               CASE WHEN p_partkey % 5 < 2 THEN '1' ELSE '0' END AS market_b_status
        FROM {{part}}""",
    "catalog_v": """
        SELECT product_id, 'main' AS catalog_source, trim(model) AS model, trim(mpn) AS mpn,
               trim(name) AS name, category, category AS raw_category,
               CASE WHEN category = '' THEN '' ELSE trim(split_part(category, ':::', 1)) END AS family,
               CASE WHEN contains(category, '///')
                    THEN trim(split_part(split_part(category, ':::', 3), '///', 2)) ELSE '' END
                    AS category_name,
               CASE WHEN contains(category, '///')
                    THEN trim(split_part(split_part(category, ':::', 3), '///', 3)) ELSE '' END
                    AS sub_category,
               manufacturer,
               try_cast(replace(price, ',', '.') AS decimal(12,2)) AS price,
               try_cast(quantity AS int) AS quantity, try_cast(status AS int) AS status,
               try_cast(market_a_status AS int) AS market_a_status,
               try_cast(market_b_status AS int) AS market_b_status,
               regexp_matches(trim(model), '^[0-9]{{6}}$') AS is_atomic_model,
               regexp_matches(trim(model), '^[0-9]{{6}}$') AND trim(mpn) <> '' AS automation_eligible,
               product_id % 59 <> 0 AS active
        FROM {catalog_raw_v}""",
    # Captured seller offers; (order, line) is no key, so offer_key joins all columns.
    "offers_v": """
        SELECT l_partkey AS product_id, l_suppkey AS seller_id,
               CASE WHEN l_suppkey % 13 = 0 THEN ''
                    ELSE 'Supplier#' || cast(l_suppkey AS string) END AS store,
               CASE WHEN l_linenumber % 3 = 0 THEN ''
                    ELSE 'https://shop' || cast(l_suppkey AS string) || '.example.com/p/'
                         || cast(l_partkey AS string) END AS url,
               cast(cast(CASE WHEN (l_partkey + l_suppkey) % 5 = 0
                         THEN 90000 + (l_partkey % 1000) * 10 + (l_suppkey % 9) - 4
                         ELSE cast(floor(l_extendedprice * 100 / l_quantity) AS bigint) END
                    AS double) / 100 AS decimal(12,2)) AS price,
               CASE WHEN l_discount > 0.05 THEN NULL
                    ELSE cast(l_tax * 100 AS decimal(12,2)) END AS shipping,
               l_shipdate AS captured_at,
               cast(year(l_shipdate) AS string) || '-'
                   || lpad(cast(month(l_shipdate) AS string), 2, '0') AS run_id,
               CASE WHEN day(l_shipdate) <= 15 THEN 1 ELSE 2 END AS attempt,
               l_linestatus AS availability,
               cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-'
                   || cast(l_suppkey AS string) || '-' || cast(cast(l_quantity AS bigint) AS string)
                   || '-' || cast(cast(round(l_extendedprice * 100) AS bigint) AS string) AS offer_key
        FROM {lineitem}""",
    # One competitor price per run, attempt, product and seller.
    "observations_v": """
        SELECT o.run_id || '/' || cast(o.attempt AS string) || '/' || cast(o.product_id AS string)
                   || '/' || cast(o.seller_id AS string) AS observation_id,
               o.run_id, o.attempt,
               o.run_id || CASE WHEN o.attempt = 1 THEN '-01' ELSE '-16' END AS created_at,
               o.product_id, c.catalog_source,
               CASE WHEN o.product_id % 9 = 0 THEN NULL ELSE c.model END AS model,
               nullif(c.mpn, '') AS mpn, c.name AS product_name,
               CASE WHEN o.seller_id % 2 = 0 THEN 'market_a' ELSE 'market_b' END AS source,
               nullif(o.store, '') AS competitor_name,
               CASE WHEN o.seller_id % 11 = 0 THEN NULL ELSE o.price END AS competitor_price,
               c.price AS own_price, o.url AS product_url,
               CASE WHEN o.seller_id % 7 = 0 THEN 'unmatched' ELSE 'matched' END AS match_status
        FROM (SELECT run_id, attempt, product_id, seller_id, min(store) AS store,
                     min(price) AS price, max(url) AS url
              FROM {offers_v} GROUP BY run_id, attempt, product_id, seller_id) o
        JOIN {catalog_v} c ON c.product_id = o.product_id""",
    "runs_v": """
        SELECT o_orderkey AS id, 'run-' || cast(o_orderkey AS string) AS run_id,
               o_custkey % 40 AS source_no,
               CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running'
                    ELSE 'failed' END AS status,
               o_orderdate AS created_at, o_orderpriority AS priority, o_totalprice AS total
        FROM {orders}""",
    # Registered source URLs, up to three per product.
    "urls_v": """
        SELECT page_id AS url_id, cast(floor(page_id / 3) AS bigint) * 2 AS product_id, url,
               CASE page_id % 5 WHEN 0 THEN 'broken' WHEN 1 THEN 'needs_review'
                    WHEN 2 THEN 'disabled' ELSE 'active' END AS status,
               CASE page_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'discovered'
                    ELSE 'imported' END AS url_type,
               CASE page_id % 3 WHEN 0 THEN 'market_a' WHEN 1 THEN 'market_b'
                    ELSE 'shop' END AS source_name,
               page_id % 4 AS failure_count,
               '2024-01-' || lpad(cast(page_id % 28 + 1 AS string), 2, '0') AS updated_at
        FROM {pages}""",
    # Capture attempts on sources.
    "captures_v": """
        SELECT event_id AS attempt_id, user_id AS source_id, ts AS captured_at,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success'
                    WHEN 'signup' THEN 'skipped' WHEN 'view' THEN 'success'
                    ELSE 'failed' END AS fetch_status,
               CASE event_type WHEN 'error' THEN 'HTTP_403' WHEN 'click' THEN 'parse_failed'
                    ELSE NULL END AS error_code,
               value, props
        FROM {events}""",
    "jobs_v": """
        SELECT event_id AS job_id, event_type AS job_type, ts AS heartbeat_at, user_id,
               CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running'
                    WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status
        FROM {events}""",
}

# Views that Spark computes with the library's own operators.
SPARK_VIEWS: dict[str, Callable[["Views"], DataFrame]] = {}


def spark_view(name: str):
    def register(fn):
        SPARK_VIEWS[name] = fn
        return fn

    return register


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


class Views:
    """Driver tables and adapter views of one data folder, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in SPARK_VIEWS:
            return SPARK_VIEWS[name](self)
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        """Run a SELECT whose ``{name}`` marks are views or tables."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in _names(text)})


def duckdb_sql(body: str) -> str:
    """Complete a DuckDB statement: every view it names becomes a leading CTE."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ctes or name not in VIEWS:
            return
        text = VIEWS[name]
        for used in _names(text):
            add(used)
        plain = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text).replace("{{", "{").replace("}}", "}")
        ctes[name] = plain

    for word in re.findall(r"\b\w+_v\b", body):
        add(word)
    if not ctes:
        return body.strip()
    head = ",\n".join(f"{n} AS ({t})" for n, t in ctes.items())
    rest = body.strip()
    if rest[:5].upper() == "WITH ":
        return f"WITH {head},\n{rest[5:]}"
    return f"WITH {head}\n{rest}"
