"""Queries of predicates, joins, reports, windows, pages and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import aggregates as A
from kinfold.operators import pages as L
from kinfold.operators import relational as R
from kinfold.operators import sets as U
from kinfold.operators import windows as W
from kinfold.operators.search import TrigramIndex, search_indexed, searched_texts
from kinfold.plans.build import Queries
from kinfold.plans.scalar_queries import _norm
from kinfold.session import fresh_path

Q = Queries()
C = F.col


def asof():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def mid():
    return F.lit("2024-01-15 00:00:00").cast("timestamp")


_MID, _ASOF = "TIMESTAMP '2024-01-15'", "TIMESTAMP '2024-01-31'"
_ACTIVE = "('queued', 'leased', 'retrying')"
_GROUP = "coalesce(nullif(group_key, ''), kind || ':' || id)"


def _series(v):
    return v("identity").groupBy(C("series_id").alias("id")).agg(F.min("title").alias("title"))


_SERIES = "SELECT series_id AS id, min(title) AS title FROM {identity} GROUP BY series_id"


def _aliases(v):
    return v("alias").join(v("identity").select(C("id").alias("identity_id"), "series_id"), "identity_id").select("series_id", "alias")


_ALIASES = "SELECT i.series_id, a.alias FROM {alias} a JOIN {identity} i ON i.id = a.identity_id"

Q.add("r01_search", lambda v: R.search(_series(v), _aliases(v), v("identity"), "red%GE", ["alpha", "gamma"]), f"WITH s AS ({_SERIES}), a AS ({_ALIASES}) SELECT * FROM s WHERE (title ILIKE '%red%GE%' OR id IN (SELECT series_id FROM a WHERE alias ILIKE '%red%GE%')) AND id IN (SELECT series_id FROM {{identity}} WHERE source IN ('alpha', 'gamma'))")


def _index(v):
    described = _series(v).withColumn("description", F.concat(F.lit("about "), F.reverse("title")))
    return described, TrigramIndex(v("region").sparkSession, fresh_path(v("region").sparkSession, "search")).build(searched_texts(described, _aliases(v)))


def _found(v, terms, sources):
    """Series found for each term over one index."""
    series, index = _index(v)
    return reduce(DataFrame.unionByName, (search_indexed(series, v("identity"), index, t, sources).select("id", "title").withColumn("term", F.lit(t)) for t in terms))


_TERMS = [" red ", "e%GE", "ge_r", "oo", "zzz", "a_e", "uobA"]
Q.add("r01_search_indexed", lambda v: _found(v, _TERMS, ["alpha", "gamma"]), f"WITH s AS ({_SERIES}), a AS ({_ALIASES}) SELECT s.id, title, term FROM s, (SELECT unnest({_TERMS}) AS term) WHERE (title ILIKE '%' || trim(term) || '%' OR {_norm('title')} ILIKE '%' || trim(term) || '%' OR 'about ' || reverse(title) ILIKE '%' || trim(term) || '%' OR id IN (SELECT series_id FROM a WHERE alias ILIKE '%' || trim(term) || '%')) AND id IN (SELECT series_id FROM {{identity}} WHERE source IN ('alpha', 'gamma'))")
Q.add("r02_latest_unresolved_failures", lambda v: R.latest_unresolved_failures(v("job")).select("id", "kind", "dedupe_key"), "SELECT id, kind, dedupe_key FROM {job} j WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM {job} k WHERE k.kind = j.kind AND k.dedupe_key = j.dedupe_key AND k.id > j.id)")
Q.add("r03_merge_blocking_work", lambda v: R.merge_blocking_work(v("job"), ["click", "view"], "$.k", "7").select("id", "status"), f"SELECT id, status FROM {{job}} WHERE status IN {_ACTIVE} AND kind IN ('click', 'view') AND coalesce(json_extract_string(payload, '$.k'), '') <> '7'")
_BLOCKED = "SELECT source FROM {source_state} WHERE NOT enabled OR cooldown_until > TIMESTAMP '2024-01-15'"
Q.add("r04_runnable_or_live", lambda v: R.runnable_or_live(v("job"), v("source_state"), mid()), f"SELECT series_id, bool_or((status IN ('queued', 'retrying') AND due_at <= {_MID} AND attempts < 3 AND source NOT IN ({_BLOCKED})) OR (status = 'leased' AND lease_expires_at > {_MID})) AS active FROM {{job}} GROUP BY series_id")
Q.add(
    "r05_ready_work", lambda v: R.ready_work(v("job"), v("source_state"), mid(), 200).select("id", "priority", "group_load"),
    f"""WITH live AS (SELECT * FROM {{job}} WHERE status = 'leased' AND lease_expires_at > {_MID}), load AS (SELECT group_key, count(*) AS n FROM live GROUP BY group_key)
    SELECT j.id, j.priority, coalesce(l.n, 0) AS group_load FROM {{job}} j LEFT JOIN load l USING (group_key)
    WHERE ((status IN ('queued', 'retrying') AND due_at <= {_MID}) OR (status = 'leased' AND lease_expires_at <= {_MID})) AND attempts < 3 AND source NOT IN ({_BLOCKED})
      AND NOT EXISTS (SELECT 1 FROM live x WHERE x.series_id = j.series_id AND x.kind = j.kind) ORDER BY j.priority, group_load, due_at, j.id LIMIT 200""",
)
Q.add("r06_pending_sync", lambda v: R.pending_sync(v("series"), v("projection"), v("reading").groupBy(C("series_id").alias("id")).agg(F.max("updated_at").alias("synced_at")), F.lit("1999-01-01").cast("timestamp"), 100).select("id", "synced_at"), "SELECT s.id, r.synced_at FROM {series} s LEFT JOIN (SELECT series_id, max(updated_at) AS synced_at FROM {reading} GROUP BY series_id) r ON r.series_id = s.id WHERE status <> 'untracked' AND s.id IN (SELECT series_id FROM {projection}) AND (synced_at IS NULL OR synced_at < TIMESTAMP '1999-01-01') ORDER BY synced_at NULLS FIRST, s.id LIMIT 100")
Q.add("r07_pending_projection_repair", lambda v: R.pending_projection_repair(v("series"), v("artifact"), v("projection"), v("projection").filter("artifact_id % 17 <> 0")).select("id"), "SELECT id FROM {series} WHERE status <> 'untracked' AND id IN (SELECT series_id FROM {artifact} a WHERE state = 'active' AND (a.id NOT IN (SELECT artifact_id FROM {projection}) OR a.id NOT IN (SELECT artifact_id FROM {projection} WHERE artifact_id % 17 <> 0)))")
Q.add("r08_pending_signatures", lambda v: R.pending_signatures(v("identity"), v("identity").filter("id % 3 > 0").selectExpr("id", "IF(id % 4 = 0, 'v2', 'v3') AS algorithm", "IF(id % 5 = 0, NULL, array('a')) AS bands"), v("identity").filter("id % 7 = 0").select(F.substring(F.sha1(F.concat(F.lit("v3:"), "url")), 1, 12).alias("key")), "v3"), "WITH k AS (SELECT id, sha1('v3:' || url)[1:12] AS key FROM {identity} WHERE NOT (id % 3 > 0 AND id % 4 <> 0 AND id % 5 <> 0)) SELECT id, key FROM k WHERE key NOT IN (SELECT sha1('v3:' || url)[1:12] FROM {identity} WHERE id % 7 = 0)")
Q.add("r09_pending_rescore", lambda v: R.pending_rescore(v("decision").selectExpr("id", "decision", "left_id AS series_id", """concat('{"version": "v', id % 4, '"}') AS evidence"""), "v3", 50), "SELECT left_id AS series_id, min(id) AS first_id FROM {decision} WHERE decision = 'pending' AND id % 4 <> 3 GROUP BY left_id ORDER BY first_id LIMIT 50")
Q.add("r10_recoverable_failures", lambda v: R.recoverable_failures(v("job"), ["rate_limited"], "'52[0-7]'").select("id"), "SELECT id FROM {job} j WHERE status = 'failed' AND (error_code = 'rate_limited' OR regexp_matches(message, '''52[0-7]''')) AND NOT EXISTS (SELECT 1 FROM {job} k WHERE k.kind = j.kind AND k.dedupe_key = j.dedupe_key AND k.status = 'succeeded' AND k.id > j.id)")
Q.add("r11_fresh_workers", lambda v: R.fresh_workers(v("job").groupBy(C("source").alias("worker"), "kind").agg(F.max("created_at").alias("seen_at")), F.lit("2024-01-30 00:00:00").cast("timestamp"), "INTERVAL '5' HOUR"), "SELECT source AS worker, kind, max(created_at) AS seen_at FROM {job} GROUP BY source, kind HAVING max(created_at) >= TIMESTAMP '2024-01-30' - INTERVAL 5 HOUR")
Q.add("r12_tracked_not_observed", lambda v: R.tracked_not_observed(v("identity").select("id", "source"), v("identity").filter("id % 4 < 2 OR id % 5 > 0").select("id"), v("source_state").selectExpr("source", "source = 'gamma' AS flag")), "SELECT id, source FROM {identity} WHERE source = 'gamma' AND id % 5 = 0")
Q.add("j01_inner_chain", lambda v: v("reading").join(v("release").select(C("id").alias("release_id"), "number"), "release_id").join(v("series").select(C("id").alias("series_id"), "title"), "series_id").select("release_id", "number", "title", "state"), "SELECT g.release_id, r.number, s.title, g.state FROM {reading} g JOIN {release} r ON r.id = g.release_id JOIN {series} s ON s.id = g.series_id")
Q.add("j02_left_missing_or", lambda v: R.left_missing_or(v("release").select(C("id").alias("release_id"), "series_id"), v("reading"), "release_id", "state", "read").select("release_id", "state"), "SELECT r.id AS release_id, g.state FROM {release} r LEFT JOIN {reading} g ON g.release_id = r.id WHERE g.state IS NULL OR g.state <> 'read'")
Q.add("j03_missing_partner", lambda v: R.missing_partner(v("artifact"), v("blob"), ["checksum"]).select("id"), "SELECT id FROM {artifact} WHERE checksum NOT IN (SELECT checksum FROM {blob})")
Q.add("j04_pair_sides", lambda v: R.pair_sides(v("decision"), v("identity"), ["title", "source"]).select("id", "left_title", "right_title", "left_source", "right_source"), "SELECT d.id, l.title AS left_title, r.title AS right_title, l.source AS left_source, r.source AS right_source FROM {decision} d JOIN {identity} l ON l.id = d.left_id JOIN {identity} r ON r.id = d.right_id")
Q.add("j05_touching", lambda v: R.touching(v("decision").select("id", "left_id", "right_id").withColumnRenamed("id", "pair"), v("identity").filter("source = 'beta' AND id % 3 = 0")), "SELECT DISTINCT id AS pair, left_id, right_id FROM {decision} WHERE left_id IN (SELECT id FROM {identity} WHERE source = 'beta' AND id % 3 = 0) OR right_id IN (SELECT id FROM {identity} WHERE source = 'beta' AND id % 3 = 0)")
Q.add("j06_tuple_member", lambda v: R.tuple_member(v("chapter"), v("chapter").filter("identity_id % 2 = 0").selectExpr("identity_id + 1 AS identity_id", "number"), ["identity_id", "number"]), "SELECT * FROM {chapter} WHERE (identity_id, number) IN (SELECT identity_id + 1, number FROM {chapter} WHERE identity_id % 2 = 0)")
Q.add("j07_with_later_row", lambda v: R.with_later_row(v("job"), ["kind", "dedupe_key"]).select("id"), "SELECT id FROM {job} j WHERE EXISTS (SELECT 1 FROM {job} k WHERE k.kind = j.kind AND k.dedupe_key = j.dedupe_key AND k.id > j.id)")
Q.add("j08_band_pairs", lambda v: R.band_pairs(v("identity").selectExpr("id", "array(substr(sha2(string(id), 256), 1, 2), substr(sha2(string(id), 256), 3, 2)) AS bands", "concat(title, id) AS title")), "WITH s AS (SELECT id, sha256(id::VARCHAR)[1:2] AS x, sha256(id::VARCHAR)[3:4] AS y, (title || id)[1:12] AS t FROM {identity}) SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND (a.x = b.x OR a.y = b.y OR a.t = b.t)")
Q.add("j09_differs", lambda v: v("series").filter(R.differs(C("latest_id"), C("latest_number"))).select("id"), "SELECT id FROM {series} WHERE latest_id IS DISTINCT FROM latest_number")

Q.add("a01_job_groups", lambda v: A.job_groups(v("job")), f"SELECT {_GROUP} AS work_group, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'leased') AS leased, count(*) FILTER (status = 'retrying') AS retrying, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled, min(priority) AS priority, min(due_at) AS due_at, max(id) AS last_id FROM {{job}} GROUP BY 1")
Q.add("a02_status_counts", lambda v: A.counts_by(v("job"), "kind", "source", "status", "error_code"), "SELECT kind, source, status, error_code, count(*) AS n FROM {job} GROUP BY ALL")
Q.add("a03_active_group_count", lambda v: A.active_group_count(v("job")), f"SELECT count(DISTINCT {_GROUP}) AS groups FROM {{job}} WHERE status IN {_ACTIVE}")
Q.add(
    "a04_cycle_summary", lambda v: A.cycle_summary(v("job").withColumns({"cycle": C("id") % 40, "units": C("id") % 3 + 1}), "cycle", "units", C("id") % 4 == 1, C("id") % 4 == 3),
    f"""WITH o AS (SELECT *, id % 40 AS cycle, id % 3 + 1 AS u, status = 'failed' AND id = max(id) OVER (PARTITION BY kind, dedupe_key) AS open, status = 'cancelled' AND id % 4 = 1 AS merged, status = 'cancelled' AND id % 4 = 3 AS waived FROM {{job}}),
    t AS (SELECT cycle, sum(u) AS total, coalesce(sum(u) FILTER (status IN {_ACTIVE}), 0) AS active, coalesce(sum(u) FILTER (status = 'succeeded'), 0) AS succeeded, coalesce(sum(u) FILTER (status = 'failed' OR waived), 0) AS failed, coalesce(sum(u) FILTER (open), 0) AS unresolved,
          coalesce(sum(u) FILTER (waived), 0) AS dismissed, coalesce(sum(u) FILTER (merged), 0) AS coalesced, coalesce(sum(u) FILTER (status = 'cancelled' AND NOT waived), 0) AS withdrawn FROM o GROUP BY cycle),
    s AS (SELECT *, coalesced + greatest(failed - unresolved - dismissed, 0) AS superseded, greatest(withdrawn - coalesced, 0) + dismissed AS cancelled FROM t)
    SELECT cycle, total::BIGINT AS total, active::BIGINT AS active, succeeded::BIGINT AS succeeded, unresolved::BIGINT AS unresolved, dismissed::BIGINT AS dismissed, coalesced::BIGINT AS coalesced, superseded::BIGINT AS superseded, cancelled::BIGINT AS cancelled, greatest(total, succeeded + unresolved + cancelled + superseded + active)::BIGINT AS effective_total FROM s""",
)
_OLD = f"status IN ('succeeded', 'failed', 'cancelled') AND completed_at < {_ASOF} - INTERVAL 14 DAY"
_ROLL = "SELECT completed_at::DATE AS day, kind, source, status, error_code, count(*) AS n, sum(attempts)::BIGINT AS attempts, sum(greatest(floor(epoch_us(completed_at) / 1e6 - epoch_us(created_at) / 1e6), 0))::BIGINT AS seconds FROM {job}"


def _rollup(v):
    empty = v("job").limit(0).selectExpr("to_date(completed_at) AS day", "kind", "source", "status", "error_code", "0L AS n", "0L AS attempts", "0L AS seconds")
    return A.retention_rollup(v("job"), empty, asof())


Q.add("a05_retention_rollup", lambda v: _rollup(v)[0], f"{_ROLL} WHERE {_OLD} GROUP BY ALL")
Q.add("a05_retention_kept", lambda v: _rollup(v)[1].groupBy("status").agg(F.count("*").alias("n")), f"SELECT status, count(*) AS n FROM {{job}} WHERE NOT ({_OLD}) GROUP BY status")
Q.add("a06_retention_expire", lambda v: A.expire(v("request_sample"), "sampled_at", asof(), 7).select("id"), f"SELECT id FROM {{request_sample}} WHERE sampled_at >= {_ASOF} - INTERVAL 7 DAY")
Q.add("a06_expire_unreferenced", lambda v: A.expire_unreferenced(v("job").groupBy("dedupe_key").agg(F.max("completed_at").alias("settled_at")), "settled_at", asof(), 3, v("job").filter("status = 'queued'"), "dedupe_key").select("dedupe_key"), f"SELECT dedupe_key FROM {{job}} GROUP BY dedupe_key HAVING NOT (max(completed_at) < {_ASOF} - INTERVAL 3 DAY) OR count(*) FILTER (status = 'queued') > 0")
Q.add("a07_pool_depth", lambda v: A.pool_depth(v("job"), "kind", asof()), f"SELECT kind, count(*) AS depth, floor((epoch_us({_ASOF}) - epoch_us(min(created_at))) / 1000000)::BIGINT AS oldest_seconds FROM {{job}} WHERE status IN {_ACTIVE} GROUP BY kind")
Q.add("a08_mean_latency", lambda v: A.newest_mean(v("request_sample"), "source", C("latency").cast("double"), "sampled_at", mid(), 5000), f"SELECT source, count(*) AS n, round(avg(greatest(latency, 0)::DOUBLE), 6) AS mean FROM (SELECT * FROM {{request_sample}} WHERE sampled_at >= {_MID} ORDER BY sampled_at DESC, id DESC LIMIT 5000) GROUP BY source")
Q.add("a09_route_counters", lambda v: A.route_counters(v("request_sample"), ["source", "status"], ["latency"]), "SELECT source, status, count(*) AS requests, sum(latency)::BIGINT AS latency FROM {request_sample} GROUP BY ALL")
Q.add("a10_progress_counts", lambda v: A.progress_counts(v("release"), v("reading")), "SELECT r.series_id, count(*) AS total, count(*) FILTER (g.state = 'read') AS read, greatest(count(*) - count(*) FILTER (g.state = 'read'), 0) AS unread FROM {release} r LEFT JOIN {reading} g ON g.release_id = r.id GROUP BY r.series_id")
Q.add("a11_plan_progress", lambda v: A.plan_progress(v("release").selectExpr(*[x.strip() for x in ("series_id AS plan_id", "id", "IF(id % 3 = 0, 'priority', 'backfill') AS tier", "CASE id % 4 WHEN 1 THEN 'cancelled' WHEN 2 THEN 'blocked' ELSE 'satisfied' END AS state")])), "WITH i AS (SELECT series_id AS plan_id, id % 3 = 0 AS p, CASE id % 4 WHEN 1 THEN 'cancelled' WHEN 2 THEN 'blocked' ELSE 'satisfied' END AS state FROM {release}) SELECT plan_id, count(*) AS total, count(*) FILTER (state = 'satisfied') AS satisfied, count(*) FILTER (state = 'blocked') AS attention, coalesce(bool_and(state <> 'blocked') FILTER (p), true) AS priority_done, bool_and(state <> 'blocked') AS complete FROM i GROUP BY plan_id")
Q.add("a12_multi_provider_series", lambda v: A.multi_provider_series(v("identity")), "SELECT series_id, count(*) AS n FROM {identity} GROUP BY series_id HAVING count(*) > 1")
Q.add("a13_reservation_summary", lambda v: A.reservation_summary(v("job").selectExpr("lease_expires_at AS expires_at", "priority AS bytes"), mid(), 100_000, 1_000), f"SELECT r AS reserved, 100000 - r < 1000 AS paused, CASE WHEN 100000 - r < 1000 THEN 'low_space' ELSE '' END AS reason FROM (SELECT coalesce(sum(priority) FILTER (lease_expires_at > {_MID}), 0)::BIGINT AS r FROM {{job}})")
Q.add("a14_run_summary", lambda v: A.run_summary(v("request_sample").withColumns({"error_code": F.when(C("id") % 9 == 0, "timeout"), "retry_after": F.when(C("id") % 7 == 0, C("id") % 60)})), "WITH t AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'timeout' ELSE '' END AS e, CASE WHEN id % 7 = 0 THEN id % 60 END AS r FROM {request_sample}), b AS (SELECT *, status >= 400 OR e <> '' AS bad FROM t) SELECT run, count(*) AS requests, count(*) FILTER (bad) AS failures, count(*) FILTER (NOT bad) AS successes, min(id) FILTER (bad) AS first_limit, coalesce(arg_min(trim('HTTP ' || status || ' ' || e), id) FILTER (bad), '') AS limiting_signal, max(latency) AS max_latency, max(r) AS max_retry_after FROM b GROUP BY run")
Q.add("a15_nested_series", lambda v: A.nested_series(_series(v), v("identity"), _aliases(v)), f"WITH s AS ({_SERIES}), a AS ({_ALIASES}) SELECT s.id, s.title, (SELECT string_agg(source || ':' || i.id, ',' ORDER BY source, i.id) FROM {{identity}} i WHERE i.series_id = s.id) AS sources, coalesce((SELECT string_agg(DISTINCT alias, ',' ORDER BY alias) FROM a WHERE a.series_id = s.id), '') AS aliases FROM s")
Q.add("a16_revision_consensus", lambda v: A.revision_consensus(v("identity").selectExpr("source", "CAST(size % 5 AS STRING) AS revision", "series_id AS item", "id AS position"), 3), "WITH n AS (SELECT source, (size % 5)::VARCHAR AS revision, count(DISTINCT series_id) AS n, min(id) AS p FROM {identity} GROUP BY ALL) SELECT source, arg_max(revision, (n, -p)) AS revision, max(n) AS n FROM n GROUP BY source HAVING max(n) >= 3")
Q.add("a17_storage_health", lambda v: A.storage_health(v("artifact"), v("blob"), v("projection")), "SELECT count(*) FILTER (state = 'active') AS active, count(*) FILTER (checksum NOT IN (SELECT checksum FROM {blob})) AS without_blob, count(*) FILTER (state = 'active' AND id NOT IN (SELECT artifact_id FROM {projection})) AS without_projection FROM {artifact}")
Q.add("a18_group_progress", lambda v: A.group_progress(v("job")), f"SELECT {_GROUP} AS work_group, count(*) FILTER (status IN ('succeeded', 'failed', 'cancelled')) AS done, count(*) AS total, round_even(100.0 * count(*) FILTER (status IN ('succeeded', 'failed', 'cancelled')) / count(*), 0)::INT AS percent FROM {{job}} GROUP BY 1")
Q.add("a18_download_progress", lambda v: A.group_progress(v("job"), v("job").filter("group_key <> ''").select(C("group_key").alias("work_group")).distinct().selectExpr("work_group", "CAST(length(work_group) AS BIGINT) AS satisfied", "20L AS total").filter("work_group LIKE '%1%'")), f"SELECT {_GROUP} AS work_group, CASE WHEN any_value(group_key) LIKE '%1%' THEN length(any_value(group_key)) ELSE count(*) FILTER (status IN ('succeeded', 'failed', 'cancelled')) END AS done, CASE WHEN any_value(group_key) LIKE '%1%' THEN 20 ELSE count(*) END AS total, round_even(100.0 * CASE WHEN any_value(group_key) LIKE '%1%' THEN length(any_value(group_key)) ELSE count(*) FILTER (status IN ('succeeded', 'failed', 'cancelled')) END / CASE WHEN any_value(group_key) LIKE '%1%' THEN 20 ELSE count(*) END, 0)::INT AS percent FROM {{job}} GROUP BY 1")

_PREF = "CASE source WHEN 'alpha' THEN 4 WHEN 'beta' THEN 3 WHEN 'gamma' THEN 2 WHEN 'delta' THEN 1 ELSE 0 END"


def _top(cols: str, table: str, part: str, order: str, where: str = "true") -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn FROM {{{table}}} WHERE {where}) WHERE rn = 1"


Q.add("w01_latest_release", lambda v: W.latest_release(v("release")).select("series_id", "id", "number"), _top("series_id, id, number", "release", "series_id", "number IS NULL, number DESC, CASE WHEN number IS NULL THEN published_at END DESC NULLS LAST, id DESC"))
Q.add("w02_queue_position", lambda v: W.queue_position(v("job")).select("id", "kind", "position"), "SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY priority, due_at, id) AS position FROM {job} WHERE status IN ('queued', 'retrying')")
Q.add("w03_group_representative", lambda v: W.group_representative(v("job"), A.group_name()).select("work_group", "id"), f"SELECT work_group, id FROM (SELECT {_GROUP} AS work_group, id, row_number() OVER (PARTITION BY {_GROUP} ORDER BY status <> 'leased', priority, due_at, id) AS rn FROM {{job}}) WHERE rn = 1")
Q.add("w04_latest_by_identity", lambda v: W.latest_by_identity(v("release"), ["series_id", "source"]).select("series_id", "source", "id"), _top("series_id, source, id", "release", "series_id, source", "number DESC NULLS LAST, published_at DESC NULLS LAST, id DESC"))
Q.add("w05_best_release", lambda v: W.best_release(v("release"), ["series_id", "number"]).select("series_id", "number", "id"), _top("series_id, number, id", "release", "series_id, number", f"{_PREF} DESC, quality DESC, id DESC", "available"))
Q.add("w06_ranked_covers", lambda v: W.ranked_covers(v("identity").selectExpr("id", "series_id", "source", "100 + size AS width", "300 - size * 2 AS height")).select("id", "rank"), f"SELECT id, row_number() OVER (PARTITION BY series_id ORDER BY (100 + size) * (300 - size * 2) DESC, least(100 + size, 300 - size * 2) DESC, greatest(100 + size, 300 - size * 2) DESC, {_PREF} DESC, id) AS rank FROM {{identity}}")
Q.add("w07_tier_children", lambda v: W.tier_children(v("release"), "series_id", F.lit("1998-01-01").cast("timestamp")).select("id", "tier"), "SELECT id, CASE WHEN u <= 2 OR d <= 2 THEN 'priority' WHEN published_at > TIMESTAMP '1998-01-01' THEN 'current' ELSE 'backfill' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY number NULLS LAST, id) AS u, row_number() OVER (PARTITION BY series_id ORDER BY number DESC NULLS FIRST, id DESC) AS d FROM {release})")
Q.add("w08_rolling_admission", lambda v: W.rolling_admission(v("release").selectExpr("id", "series_id", "quality AS tier"), v("reading").groupBy("series_id").agg(F.count("*").alias("n")), 5).select("id"), "SELECT id FROM (SELECT id, series_id, row_number() OVER (PARTITION BY series_id ORDER BY quality, id) AS p FROM {release}) t LEFT JOIN (SELECT series_id, count(*) AS n FROM {reading} GROUP BY series_id) a USING (series_id) WHERE p <= 5 - coalesce(n, 0)")
Q.add("w09_stable_frontier_cut", lambda v: W.stable_frontier_cut(v("identity").selectExpr("id", "source", "id AS position", "CASE WHEN id % 20 = 0 THEN id % 40 = 0 END AS stable"), 3).select("id"), "WITH t AS (SELECT id, source, CASE WHEN id % 20 = 0 THEN id % 40 = 0 END AS s FROM {identity}), w AS (SELECT *, count(s) OVER (PARTITION BY source) AS known, count(*) FILTER (coalesce(s, false)) OVER (PARTITION BY source ORDER BY id ROWS UNBOUNDED PRECEDING) AS seen FROM t) SELECT id FROM w WHERE NOT coalesce(s, false) AND (known = 0 OR seen < least(3, known))")
Q.add("w10_listing_frontier", lambda v: W.listing_frontier(v("identity").selectExpr("id", "source", "id AS position", "CASE WHEN id % 3 > 0 THEN size END AS latest"), 10).select("id", "rank"), "SELECT id, rn AS rank FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM {identity} WHERE id % 3 > 0) WHERE rn <= 10")
Q.add("w11_frontier_hits", lambda v: W.frontier_hits(v("identity").selectExpr("id", "size AS latest"), v("identity").filter("id % 9 = 0").selectExpr("id", "source", "25 AS known")), "SELECT source, count(*) AS sentinels, count(*) FILTER (size <= 25) AS hits, count(*) FILTER (size <= 25) >= least(3, count(*)) AS reached FROM {identity} WHERE id % 9 = 0 GROUP BY source")
Q.add("w12_unread_children", lambda v: W.unread_children(v("release"), v("reading")), f"WITH b AS ({_top('series_id, number, id', 'release', 'series_id, number', f'{_PREF} DESC, quality DESC, id DESC', 'available AND number IS NOT NULL AND id NOT IN (SELECT release_id FROM {reading} WHERE state = ' + chr(39) + 'read' + chr(39) + ')')}) SELECT series_id, count(*) AS n, string_agg(number || ':' || id, ',' ORDER BY number, id) AS items FROM b GROUP BY series_id")

Q.add("l01_keyset_page", lambda v: L.keyset_page(v("release").withColumn("published_at", F.when(C("id") % 4 > 0, C("published_at"))), [("published_at", "desc"), ("id", "desc")], ["1998-06-01 00:00:00", 100], 25).select("id", "published_at"), "SELECT id, published_at FROM (SELECT id, CASE WHEN id % 4 > 0 THEN published_at END AS published_at FROM {release}) WHERE published_at IS NULL OR published_at < TIMESTAMP '1998-06-01' OR (published_at = TIMESTAMP '1998-06-01' AND id < 100) ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 25")
Q.add("l01_keyset_null_tail", lambda v: L.keyset_page(v("release").withColumn("published_at", F.when(C("id") % 4 > 0, C("published_at"))), [("published_at", "desc"), ("id", "desc")], [None, 100], 25).select("id"), "SELECT id FROM {release} WHERE id % 4 = 0 AND id < 100 ORDER BY id DESC LIMIT 25")
Q.add("l02_updates_page", lambda v: L.updates_page(v("release"), v("reading"), ["2000-01-01 00:00:00", 50], 30), "SELECT series_id, max(published_at) AS newest, count(*) AS n FROM {release} WHERE id NOT IN (SELECT release_id FROM {reading} WHERE state = 'read') GROUP BY series_id HAVING max(published_at) < TIMESTAMP '2000-01-01' OR (max(published_at) = TIMESTAMP '2000-01-01' AND series_id < 50) ORDER BY newest DESC, series_id DESC LIMIT 30")
Q.add("l03_group_page", lambda v: L.keyset_page(A.job_groups(v("job")), [("leased", "desc"), ("priority", "asc"), ("due_at", "asc"), ("last_id", "asc")], [1, 0, "2024-01-02 00:00:00", 5], 40).select("work_group", "leased", "last_id"), f"WITH g AS (SELECT {_GROUP} AS work_group, count(*) FILTER (status = 'leased') AS leased, min(priority) AS priority, min(due_at) AS due_at, max(id) AS last_id FROM {{job}} GROUP BY 1) SELECT work_group, leased, last_id FROM g WHERE leased < 1 OR (leased = 1 AND (priority > 0 OR (priority = 0 AND (due_at > TIMESTAMP '2024-01-02' OR (due_at = TIMESTAMP '2024-01-02' AND last_id > 5))))) ORDER BY leased DESC, priority, due_at, last_id LIMIT 40")
Q.add("l04_resume_after", lambda v: L.resume_after(v("decision").filter("decision = 'pending'"), v("decision").filter("decision <> 'pending'").orderBy("id").limit(1), [("confidence", "desc"), ("id", "asc")], 20).select("id", "confidence"), "WITH k AS (SELECT confidence AS c, id AS i FROM {decision} WHERE decision <> 'pending' ORDER BY id LIMIT 1) SELECT id, confidence FROM {decision}, k WHERE decision = 'pending' AND (confidence < c OR (confidence = c AND id > i)) ORDER BY confidence DESC, id LIMIT 20")
Q.add("l05_recent_failures", lambda v: L.recent_failures(v("job"), 50).select("id", "message"), "SELECT id, CASE WHEN message <> '' THEN 'error ''522'' token=[redacted]' ELSE '' END AS message FROM {job} WHERE status IN ('failed', 'retrying') OR error_code <> '' ORDER BY created_at DESC, id DESC LIMIT 50")
Q.add("l06_activity_page", lambda v: L.activity_page(v("job").selectExpr("id", "id + 1 AS job_id", "status AS event"), v("job"), ["click", "error"], 900, 40).select("id", "event", "kind"), "SELECT e.id, e.status AS event, j.kind FROM {job} e JOIN {job} j ON j.id = e.id + 1 WHERE j.kind IN ('click', 'error') AND e.id < 900 ORDER BY e.id DESC LIMIT 40")
Q.add("s09_tail_events", lambda v: L.tail_events(v("job"), 500, 100).select("id", "kind"), "SELECT id, kind FROM {job} WHERE id > least(500, (SELECT max(id) FROM {job})) ORDER BY id LIMIT 100")
Q.add("s01_read_table", lambda v: v("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first")), "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_shipdate) AS first FROM lineitem GROUP BY ALL")

Q.add("u01_table_counts", lambda v: U.table_counts({"series": v("series"), "release": v("release"), "active": v("artifact").filter("state = 'active'")}), "SELECT 'series' AS name, count(*) AS n FROM {series} UNION ALL SELECT 'release', count(*) FROM {release} UNION ALL SELECT 'active', count(*) FROM {artifact} WHERE state = 'active'")
Q.add("u02_portable_selection", lambda v: U.portable_selection(v("series"), v("artifact"), v("identity"), v("decision")), "SELECT id FROM {series} WHERE status <> 'untracked' UNION SELECT series_id FROM {artifact} WHERE state = 'active' UNION SELECT series_id FROM {identity} GROUP BY series_id HAVING count(*) > 1 UNION SELECT i.series_id FROM {decision} JOIN {identity} i ON i.id IN (left_id, right_id) WHERE decision = 'rejected'")
Q.add("u03_orphan_paths", lambda v: U.orphan_paths(v("artifact").select("checksum"), v("blob"), "checksum"), "SELECT checksum FROM {artifact} EXCEPT SELECT checksum FROM {blob}")
Q.add("u04_set_overlap", lambda v: U.set_overlap(v("decision").selectExpr("left_id AS a", "right_id AS b").distinct(), v("chapter")), "WITH p AS (SELECT DISTINCT left_id AS a, right_id AS b FROM {decision}), n AS (SELECT identity_id AS k, count(*) AS n FROM {chapter} GROUP BY 1), c AS (SELECT a, b, count(*) AS common FROM p JOIN {chapter} x ON x.identity_id = a JOIN {chapter} y ON y.identity_id = b AND x.number = y.number GROUP BY a, b), t AS (SELECT p.a, p.b, coalesce(common, 0) AS common, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb FROM p LEFT JOIN c USING (a, b) LEFT JOIN n x ON x.k = p.a LEFT JOIN n y ON y.k = p.b) SELECT *, least(na, nb) AS smaller, CASE WHEN least(na, nb) = 0 THEN 0.0 ELSE common / least(na, nb) END::DOUBLE AS ratio, CASE WHEN na + nb - common = 0 THEN 0.0 ELSE common / (na + nb - common) END::DOUBLE AS jaccard FROM t")
