"""Stand-in views of the catalog's tables over the given tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from kinfold.sources.tables import read_table

ASOF = "TIMESTAMP '2024-01-31 00:00:00'"


def _source(key: str) -> str:
    return f"CASE {key} % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE 'delta' END"


#: name -> SQL; {table} stands for a given table or another view.
VIEWS: dict[str, str] = {
    "identity": f"""
        SELECT p_partkey AS id, p_partkey - p_partkey % 2 AS series_id, {_source("p_partkey")} AS source,
               p_name || ' ' || lower(p_type) AS title, lower(replace(p_brand, '#', '-')) || '-' || CAST(p_partkey % 50 AS VARCHAR(9)) AS source_id,
               'https://www.' || {_source("p_partkey")} || '.example.test/Title/' || lower(replace(p_brand, '#', '-')) || '-' || CAST(p_partkey % 50 AS VARCHAR(9)) || '/?ref=' || CAST(p_size AS VARCHAR(9)) AS url,
               p_retailprice AS popularity, p_size AS size FROM {{part}}""",
    "chapter": "SELECT DISTINCT l_partkey AS identity_id, l_suppkey % 12 + 1 AS number FROM {lineitem}",
    "alias": "SELECT a.p_partkey AS identity_id, b.p_name AS alias FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 3 = 0",
    "external_id": "SELECT p_partkey AS identity_id, CASE WHEN p_partkey % 10 = 0 THEN 'x' ELSE 'y' END AS provider, CAST(p_size AS VARCHAR(9)) AS value FROM {part} WHERE p_partkey % 5 = 0",
    "decision": """
        SELECT id, least(id, other) AS left_id, greatest(id, other) AS right_id, confidence, decision
        FROM (SELECT p_partkey AS id, (13 * p_partkey + 5) % (SELECT count(*) FROM {part}) AS other, p_size / CAST(50 AS DOUBLE) AS confidence,
                     CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS decision
              FROM {part} WHERE p_partkey % 7 = 0) d WHERE id <> other""",
    "release": f"""
        SELECT o_orderkey AS id, o_custkey AS series_id, o_orderdate AS published_at, {_source("o_orderkey")} AS source,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 10000) AS BIGINT) END AS number,
               6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS quality, o_orderkey % 11 <> 0 AS available FROM {{orders}}""",
    "series": f"""
        SELECT c_custkey AS id, c_name AS title, CASE c_custkey % 5 WHEN 0 THEN 'interested' WHEN 1 THEN 'reading' WHEN 2 THEN 'caught_up' WHEN 3 THEN 'paused' ELSE 'untracked' END AS status,
               CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE w.id END AS latest_id, w.number AS latest_number
        FROM {{customer}} LEFT JOIN (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY series_id ORDER BY CASE WHEN number IS NULL THEN 1 ELSE 0 END, number DESC,
                  CASE WHEN number IS NULL THEN published_at END DESC NULLS LAST, id DESC) AS rn FROM {{release}} r) z WHERE rn = 1) w ON w.series_id = c_custkey""",
    "reading": "SELECT o_orderkey AS release_id, o_custkey AS series_id, CASE WHEN o_orderkey % 4 = 0 THEN 'read' ELSE 'reading' END AS state, o_orderdate AS updated_at FROM {orders} WHERE o_orderkey % 4 < 2",
    "job": f"""
        SELECT event_id AS id, event_type AS kind, CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'leased' WHEN 2 THEN 'retrying' WHEN 3 THEN 'succeeded' WHEN 4 THEN 'failed' ELSE 'cancelled' END AS status,
               CAST(user_id AS VARCHAR(20)) || ':' || event_type AS dedupe_key, {_source("user_id")} AS source, CAST(event_id % 5 * 10 AS INT) AS priority,
               CASE WHEN event_id % 3 = 0 THEN '' ELSE 'group-' || CAST(user_id % 20 AS VARCHAR(9)) END AS group_key, user_id % 50 AS series_id,
               ts AS created_at, ts + CAST(floor(value) AS INT) * INTERVAL '1' SECOND AS completed_at, ts + INTERVAL '1' HOUR AS lease_expires_at,
               ts + CAST(event_id % 7 AS INT) * INTERVAL '1' MINUTE AS due_at, CAST(event_id % 4 AS INT) AS attempts,
               CASE WHEN event_id % 6 = 4 THEN CASE event_id % 4 WHEN 0 THEN 'rate_limited' ELSE 'source_network_error' END ELSE '' END AS error_code,
               CASE WHEN event_id % 6 = 4 AND event_id % 5 = 0 THEN 'error ''522'' token=abc' || CAST(event_id AS VARCHAR(20)) ELSE '' END AS message, props AS payload FROM {{events}}""",
    "request_sample": f"""
        SELECT event_id AS id, user_id % 10 AS run, {_source("user_id")} AS source, CAST(floor(value) AS BIGINT) AS latency, CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status, ts AS sampled_at FROM {{events}}""",
    "artifact": """
        SELECT l_partkey * 1000 + l_suppkey AS id, l_partkey AS series_id, l_suppkey % 12 + 1 AS chapter, CAST(l_partkey AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) AS checksum,
               CASE WHEN (l_partkey + l_suppkey) % 4 = 0 THEN 'quarantined' ELSE 'active' END AS state FROM {lineitem} GROUP BY l_partkey, l_suppkey""",
    "blob": "SELECT checksum FROM {artifact} WHERE id % 11 <> 0",
    "projection": "SELECT id AS artifact_id, series_id, chapter FROM {artifact} WHERE id % 13 <> 0",
    # Signs of the first 24 dimensions; AT_ is the engine's name for an element of a list, from 1.
    "signature": "SELECT vec_id AS id, " + " + ".join(f"CASE WHEN AT_(embedding, {k + 1}) > 0 THEN CAST({1 << k} AS BIGINT) ELSE CAST(0 AS BIGINT) END" for k in range(24)) + " AS hash FROM {embeddings}",
    "source_state": "SELECT 'alpha' AS source, true AS enabled, CAST(NULL AS TIMESTAMP) AS cooldown_until UNION ALL SELECT 'beta', true, TIMESTAMP '2024-02-01 00:00:00' UNION ALL SELECT 'gamma', true, TIMESTAMP '2024-01-20 00:00:00' UNION ALL SELECT 'delta', false, NULL",
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view, or one of the given tables."""
    if name not in VIEWS:
        return read_table(spark, folder, name)
    sql = re.sub(r"VARCHAR\(\d+\)", "STRING", VIEWS[name]).replace("AT_(", "element_at(")
    return spark.sql(sql, **{x: view(spark, folder, x) for x in set(re.findall(r"\{([a-z_]\w*)\}", VIEWS[name]))})


def oracle(sql: str) -> str:
    """DuckDB SQL with the views it names in front; {view} in the text stands for a view or table."""
    found: dict[str, str] = {}

    def need(text: str) -> None:
        for x in re.findall(r"\{([a-z_]\w*)\}", text):
            if x in VIEWS and x not in found:
                need(VIEWS[x])
                found[x] = f"v_{x} AS ({_named(VIEWS[x])})"

    need(sql)
    body = _named(sql).strip()
    if not found:
        return body
    head = ", ".join(found.values())
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def _named(text: str) -> str:
    return re.sub(r"\{([a-z_]\w*)\}", lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], text).replace("AT_(", "list_extract(")
