"""Queries of audits, merges and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import audit as I
from kinfold.operators import merge as M
from kinfold.operators import planning as P
from kinfold.operators import repairs as R
from kinfold.operators import windows as W
from kinfold.plans.build import Queries
from kinfold.plans.relational_queries import _PREF, _top, mid
from kinfold.plans.scalar_queries import _norm, _number
from kinfold.session import Tables

Q = Queries()
C = F.col
_MID = "TIMESTAMP '2024-01-15'"
_ACTIVE = "('queued', 'leased', 'retrying')"
_LATEST = _top("series_id, id, number", "release", "series_id", "number IS NULL, number DESC, CASE WHEN number IS NULL THEN published_at END DESC NULLS LAST, id DESC")
_MISMATCH = f"SELECT s.id, s.latest_id, w.id AS want_id FROM {{series}} s LEFT JOIN ({_LATEST}) w ON w.series_id = s.id WHERE s.latest_id IS DISTINCT FROM w.id OR s.latest_number IS DISTINCT FROM w.number"

Q.add("i01_latest_mismatch", lambda v: I.latest_mismatch(v("series"), v("release")), _MISMATCH)
Q.add("i02_duplicate_keys", lambda v: I.duplicate_keys(v("artifact").filter("state = 'active'"), ["series_id", "chapter"]), "SELECT series_id, chapter, count(*) AS n FROM {artifact} WHERE state = 'active' GROUP BY ALL HAVING count(*) > 1")
Q.add("i03_orphans", lambda v: I.orphans(v("artifact").filter("state = 'active'"), v("blob"), "checksum").select("id"), "SELECT id FROM {artifact} WHERE state = 'active' AND checksum NOT IN (SELECT checksum FROM {blob})")
Q.add("i04_expired_leases", lambda v: I.expired(v("job").filter("status = 'leased'"), "lease_expires_at", mid()).select("id"), f"SELECT id FROM {{job}} WHERE status = 'leased' AND lease_expires_at < {_MID}")
Q.add("i05_out_of_domain", lambda v: I.out_of_domain(v("job"), "kind", ["click", "view"]).select("id"), "SELECT id FROM {job} WHERE kind NOT IN ('click', 'view')")
Q.add("i06_excess_active", lambda v: I.excess_active(v("job"), ["kind", "dedupe_key"]), f"SELECT kind, dedupe_key, count(*) AS n, count(*) - 1 AS excess FROM {{job}} WHERE status IN {_ACTIVE} GROUP BY ALL HAVING count(*) > 1")
Q.add("i07_obsolete_pending", lambda v: I.obsolete_pending(v("decision"), v("identity").selectExpr("id", "CAST(id / 100 AS BIGINT) AS series_id")), "SELECT id FROM {decision} WHERE decision = 'pending' AND left_id // 100 = right_id // 100")


def _checks(v):
    return {"latest": I.latest_mismatch(v("series"), v("release")), "no_blob": I.orphans(v("artifact").filter("state = 'active'"), v("blob"), "checksum"), "excess": I.excess_active(v("job"), ["kind", "dedupe_key"]), "expired": I.expired(v("job").filter("status = 'leased'"), "lease_expires_at", mid()), "unknown": I.out_of_domain(v("series"), "status", ["interested", "reading", "caught_up", "paused", "untracked"])}


_REPORT = f"""SELECT 'latest' AS name, count(*) AS n FROM ({_MISMATCH}) UNION ALL SELECT 'no_blob', count(*) FROM {{artifact}} WHERE state = 'active' AND checksum NOT IN (SELECT checksum FROM {{blob}})
    UNION ALL SELECT 'excess', count(*) FROM (SELECT 1 FROM {{job}} WHERE status IN {_ACTIVE} GROUP BY kind, dedupe_key HAVING count(*) > 1) UNION ALL SELECT 'expired', count(*) FROM {{job}} WHERE status = 'leased' AND lease_expires_at < {_MID}
    UNION ALL SELECT 'unknown', count(*) FROM {{series}} WHERE status NOT IN ('interested', 'reading', 'caught_up', 'paused', 'untracked')"""
Q.add("i08_audit_report", lambda v: I.audit_report(_checks(v)), f"WITH r AS ({_REPORT}) SELECT name, n, (SELECT sum(n) = 0 FROM r) AS ok FROM r")
Q.add("i09_stage_check", lambda v: I.stage_check(v("job"), ["purchase"], _checks(v)).select("name", "status"), f"WITH r AS ({_REPORT}) SELECT name, CASE WHEN (SELECT count(*) FROM {{job}} WHERE kind = 'purchase' AND status IN {_ACTIVE}) > 0 THEN 'deferred' WHEN n = 0 THEN 'ok' ELSE 'failed' END AS status FROM r")
Q.add("i12_foreign_key_check", lambda v: I.foreign_key_check([("blob", v("artifact"), "checksum", v("blob"), "checksum"), ("series", v("release"), "series_id", v("series").filter("id % 7 > 0"), "id")]), "SELECT 'blob' AS rule, checksum AS key FROM {artifact} WHERE checksum NOT IN (SELECT checksum FROM {blob}) UNION ALL SELECT 'series', series_id::VARCHAR FROM {release} WHERE series_id % 7 = 0")
Q.add("i13_empty_metadata", lambda v: I.empty_metadata(v("job").withColumn("m", F.when(C("id") % 5 == 0, " ").when(C("id") % 5 > 1, C("payload"))), "m"), "SELECT id, '{}' AS after FROM {job} WHERE id % 5 < 2")
Q.add("i14_provider_collision", lambda v: I.provider_collision(v("identity").selectExpr("id", "CAST(id / 20 AS BIGINT) AS series_id", "source", "CASE WHEN id % 3 = 0 THEN 'same' ELSE source_id END AS source_id", "url")), "WITH t AS (SELECT id, id // 20 AS s, source, CASE WHEN id % 3 = 0 THEN 'same' ELSE source_id END AS k FROM {identity}), f AS (SELECT *, first_value(id) OVER w AS kept, first_value(k) OVER w AS fk FROM t WINDOW w AS (PARTITION BY s, source ORDER BY id)) SELECT id, kept, CASE WHEN k = fk THEN 'consolidate' ELSE 'split' END AS action FROM f WHERE id <> kept")
Q.add("i15_release_rules", lambda v: I.release_rules(v("release").selectExpr("id", "CASE id % 4 WHEN 0 THEN 'Latest: x' WHEN 1 THEN 'Chapter {{ number }}' WHEN 2 THEN 'First  Chapter' ELSE 'Chapter 5' END AS title", "CASE WHEN id % 8 = 3 THEN 'https://x.test/chapter-6' ELSE '' END AS url", "'5' AS number")), "SELECT id, CASE WHEN id % 8 = 3 THEN 'url_number_disagreement' ELSE CASE id % 4 WHEN 0 THEN 'latest_prefix' WHEN 1 THEN 'template_release' ELSE 'helper_release' END END AS rule FROM {release} WHERE id % 4 <> 3 OR id % 8 = 3")
Q.add("i16_sourceless_series", lambda v: I.sourceless_series(v("series"), v("identity").filter("series_id % 3 > 0"), v("release").filter("id % 3 = 0")), "SELECT id, status = 'untracked' AND id NOT IN (SELECT series_id FROM {release} WHERE id % 3 = 0) AS deletable FROM {series} WHERE id NOT IN (SELECT series_id FROM {identity} WHERE series_id % 3 > 0)")


def _plan(v):
    return I.repair_plan({"latest": I.latest_mismatch(v("series"), v("release")).selectExpr("id", "want_id AS after"), "metadata": I.empty_metadata(v("job").withColumn("m", F.when(C("id") % 5 == 0, " ").otherwise(C("payload"))), "m")})


Q.add("i17_repair_plan", _plan, f"WITH a AS (SELECT 'latest' AS category, id::VARCHAR AS row_id, want_id::VARCHAR AS after FROM ({_MISMATCH}) UNION ALL SELECT 'metadata', id::VARCHAR, '{{}}' FROM {{job}} WHERE id % 5 = 0) SELECT *, sha256(category || '|' || row_id || '|' || coalesce(after, ''))[1:16] AS key FROM a".replace("'{{}}'", "'{' || '}'"))
Q.add("i18_apply_repairs", lambda v: I.apply_repairs(v("series"), _plan(v), "latest_id", "latest").select("id", "latest_id"), f"SELECT s.id, CASE WHEN w.id IS NULL THEN s.latest_id ELSE w.id END::VARCHAR AS latest_id FROM {{series}} s LEFT JOIN ({_LATEST}) w ON w.series_id = s.id")
Q.add("i20_transition_check", lambda v: I.transition_check(v("job"), ["queued", "leased", "retrying", "succeeded", "failed"], 2, mid()), f"SELECT id, unnest(list_filter([CASE WHEN status = 'cancelled' THEN 'unknown_state' END, CASE WHEN attempts > 2 THEN 'attempts_out_of_bounds' END, CASE WHEN completed_at < created_at THEN 'ends_before_it_begins' END, CASE WHEN status = 'leased' AND lease_expires_at < {_MID} THEN 'lease_in_the_past' END], lambda x: x IS NOT NULL)) AS rule FROM {{job}}")


def _members(v):
    return v("identity").selectExpr("CAST(id / 6 AS BIGINT) AS cluster", "id", "source", "size % 4 AS filled", "size AS children", "CASE id % 3 WHEN 0 THEN 'reading' WHEN 1 THEN 'paused' ELSE 'interested' END AS status")


Q.add("m01_survivor", lambda v: M.survivor(_members(v)), f"SELECT id // 6 AS cluster, arg_max(id, ({_PREF}, size % 4, size, -id)) AS survivor, arg_max(CASE id % 3 WHEN 0 THEN 'reading' WHEN 1 THEN 'paused' ELSE 'interested' END, CASE id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END) AS status, count(*) AS members FROM {{identity}} GROUP BY 1")
Q.add("m02_remap_ids", lambda v: M.remap_ids(v("release").select("id", "series_id"), v("series").filter("id % 2 = 1").selectExpr("id AS old", "id - 1 AS new"), "series_id"), "SELECT id, series_id - series_id % 2 AS series_id FROM {release}")
Q.add("m03_collapse_children", lambda v: M.collapse_children(v("release").filter("number IS NOT NULL")), "SELECT r.id AS old, min(r.id) OVER (PARTITION BY series_id, number) AS new FROM {release} r WHERE number IS NOT NULL")
Q.add("m04_merge_reading", lambda v: M.merge_reading(v("reading"), ["series_id"]), "SELECT series_id, arg_max(state, (state = 'read', updated_at)) AS state, arg_max(updated_at, (state = 'read', updated_at)) AS updated_at FROM {reading} GROUP BY series_id")
Q.add("m05_merge_artifacts", lambda v: M.merge_artifacts(v("artifact"), ["series_id", "chapter"]).select("id", "state"), "SELECT id, CASE WHEN state = 'active' AND row_number() OVER (PARTITION BY series_id, chapter, state ORDER BY id) > 1 THEN 'quarantined' ELSE state END AS state FROM {artifact}")
Q.add("m06_merge_aliases", lambda v: M.merge_aliases(v("alias").selectExpr("CAST(identity_id / 30 AS BIGINT) AS series_id", "alias", "identity_id % 2 = 0 AS own").distinct()), f"WITH a AS (SELECT DISTINCT identity_id // 30 AS series_id, alias, identity_id % 2 = 0 AS own FROM {{alias}}) SELECT series_id, alias, own FROM (SELECT *, row_number() OVER (PARTITION BY series_id, {_norm('alias')} ORDER BY own DESC, alias) AS rn FROM a) WHERE rn = 1")
Q.add("m07_merge_identities", lambda v: M.merge_identities(v("identity").selectExpr("id", "CAST(id / 12 AS BIGINT) AS series_id", "source", "CASE WHEN id % 5 = 0 THEN title ELSE '' END AS description")), "WITH t AS (SELECT id, id // 12 AS series_id, source, CASE WHEN id % 5 = 0 THEN title ELSE '' END AS d FROM {identity}) SELECT series_id, source, min(id) AS id, coalesce(arg_min(d, id) FILTER (d <> ''), '') AS description, string_agg(id, ',' ORDER BY id) AS all_ids FROM t GROUP BY series_id, source")
Q.add("m08_rewrite_json_refs", lambda v: M.rewrite_json_refs(v("job").select("id", "payload"), v("series").filter("id < 50").selectExpr("id AS old", "id + 1000 AS new"), "payload", "k").select("id", F.get_json_object("payload", "$.k").cast("bigint").alias("k")), "SELECT id, k + CASE WHEN k < 50 AND k IN (SELECT id FROM {series}) THEN 1000 ELSE 0 END AS k FROM (SELECT id, json_extract(payload, '$.k')::BIGINT AS k FROM {job})")
Q.add("m07_move_children", lambda v: M.move_children(v("chapter"), v("identity").selectExpr("id", "CAST(id / 12 AS BIGINT) AS series_id", "source")), "WITH t AS (SELECT id, min(id) OVER (PARTITION BY id // 12, source) AS keeper FROM {identity}) SELECT coalesce(keeper, identity_id) AS identity_id, number, min(identity_id) AS moved_from FROM {chapter} LEFT JOIN t ON t.id = identity_id GROUP BY 1, 2")
Q.add("m09_merge_preview", lambda v: M.merge_preview(_members(v), v("identity").selectExpr("CAST(id / 6 AS BIGINT) AS cluster", "concat('same_', source) AS conflict").filter("cluster % 4 = 0").distinct()).select("cluster", "survivor", "summary", "conflicts", "can_merge"), f"SELECT id // 6 AS cluster, arg_max(id, ({_PREF}, size % 4, size, -id)) AS survivor, string_agg(id || ':' || source || ':' || size, ',' ORDER BY id) AS summary, CASE WHEN (id // 6) % 4 = 0 THEN string_agg(DISTINCT 'same_' || source, ',' ORDER BY 'same_' || source) ELSE '' END AS conflicts, (id // 6) % 4 <> 0 AS can_merge FROM {{identity}} GROUP BY id // 6")
Q.add("m10_close_obsolete", lambda v: M.close_obsolete(v("decision").select("id", "left_id", "right_id", "decision"), v("identity").selectExpr("id", "CAST(id / 100 AS BIGINT) AS series_id")), "SELECT id, left_id, right_id, CASE WHEN decision = 'pending' AND left_id // 100 = right_id // 100 THEN 'accepted' ELSE decision END AS decision FROM {decision}")
Q.add("m11_label_reviewed", lambda v: M.label_reviewed(v("decision"), v("identity"), v("decision").filter("id % 2 = 0").selectExpr("id AS decision_id", "1 AS label")), "SELECT d.id AS decision_id, (decision = 'accepted')::INT AS label, l.title AS left_title, r.title AS right_title FROM {decision} d JOIN {identity} l ON l.id = left_id JOIN {identity} r ON r.id = right_id WHERE decision <> 'pending' AND NOT (d.id % 2 = 0 AND decision = 'accepted')")
Q.add("m12_activate_artifact", lambda v: M.activate_artifact(v("artifact").filter("state <> 'active'").select("id", "series_id", "chapter", "checksum"), W.first_row(v("artifact").filter("state = 'active'"), ["series_id", "chapter"], [C("id")])), "SELECT q.id, q.series_id, q.chapter, q.checksum, CASE WHEN a.c IS NULL THEN 'activated' WHEN a.c = q.checksum THEN 'duplicate' ELSE 'conflict' END AS verdict FROM {artifact} q LEFT JOIN (SELECT series_id, chapter, arg_min(checksum, id) AS c FROM {artifact} WHERE state = 'active' GROUP BY ALL) a USING (series_id, chapter) WHERE state <> 'active'")

Q.add("k06_snapshot_upsert", lambda v: P.snapshot_upsert(v("series").select("id", "title", "status"), v("series").filter("id % 3 = 0").selectExpr("id + 100 AS id", "upper(title) AS title", "CAST(NULL AS STRING) AS status"), ["id"]), "SELECT coalesce(o.id, n.id) AS id, coalesce(n.t, o.title) AS title, o.status FROM {series} o FULL JOIN (SELECT id + 100 AS id, upper(title) AS t FROM {series} WHERE id % 3 = 0) n ON n.id = o.id")
Q.add("p01_changed_listings", lambda v: P.changed_listings(v("identity").selectExpr("id", "CAST(size AS STRING) AS latest"), v("identity").filter("id % 4 > 0").selectExpr("id", "'25' AS version", "CASE WHEN id % 5 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-14' END AS detailed_at"), mid()), "SELECT id FROM {identity} WHERE id % 4 = 0 OR size > 25 OR id % 5 = 0")
Q.add("p02_upsert_children", lambda v: P.upsert_children(v("release").filter("number IS NOT NULL").groupBy("series_id", C("number").cast("string").alias("number")).agg(F.lit("").alias("title")), v("release").selectExpr("series_id", "concat('Ch ', id % 30, '.0') AS number", "id AS position", "concat('t', id) AS title")), "WITH o AS (SELECT DISTINCT series_id, number::VARCHAR AS number FROM {release} WHERE number IS NOT NULL), n AS (SELECT series_id, (id % 30)::VARCHAR AS number, arg_max('t' || id, id) AS t FROM {release} GROUP BY ALL) SELECT series_id, number, coalesce(t, '') AS title FROM o FULL JOIN n USING (series_id, number)")
Q.add("p04_sync_aliases", lambda v: P.sync_aliases(v("alias").selectExpr("identity_id AS series_id", "upper(alias) AS alias"), v("alias").selectExpr("identity_id AS series_id", "alias", "1 AS position").union(v("alias").selectExpr("identity_id", "'Home'", "2"))), f"SELECT identity_id AS series_id, upper(alias) AS alias FROM {{alias}} WHERE {_norm('alias')} <> ''")
Q.add("p06_split_rejected", lambda v: P.split_rejected(v("job").select("id", C("dedupe_key").alias("key"), "status"), F.when(C("status") == "failed", F.concat(F.lit("bad "), "id")), v("job").filter("id % 2 = 0 AND status = 'leased'").select(C("dedupe_key").alias("key")))[1].select("id", "reason"), "SELECT id, 'bad ' || id AS reason FROM {job} WHERE status = 'failed' AND dedupe_key NOT IN (SELECT dedupe_key FROM {job} WHERE id % 2 = 0 AND status = 'leased')")
Q.add("p07_reconcile_intents", lambda v: P.reconcile_intents(v("job").selectExpr("id", "IF(id % 2 = 0, 'queued', 'pending') AS state"), v("job").filter("id % 5 = 0").select("id"), v("job").filter("id % 7 > 0")), f"SELECT id, CASE WHEN id % 5 = 0 THEN 'satisfied' WHEN id % 7 > 0 AND status IN {_ACTIVE} THEN 'queued' WHEN id % 7 > 0 AND status = 'failed' THEN 'blocked' ELSE 'pending' END AS state FROM {{job}}")
Q.add("p08_fallback_release", lambda v: P.fallback_release(v("release"), v("release").filter("quality = 5"), ["series_id", "number"]).select("series_id", "id"), _top("series_id, id", "release", "series_id, number", f"{_PREF} DESC, quality DESC, id DESC", "available AND quality <> 5"))
Q.add("p10_preferred_upgrades", lambda v: P.preferred_upgrades(v("release").filter("number IS NOT NULL AND id % 5 = 0"), v("release"), ["series_id", "number"]), f"SELECT h.id, b.id AS best_id FROM {{release}} h JOIN ({_top('series_id, number, id, source, quality', 'release', 'series_id, number', f'{_PREF} DESC, quality DESC, id DESC', 'available')}) b ON b.series_id = h.series_id AND b.number = h.number WHERE h.id % 5 = 0 AND ({_PREF.replace('source', 'b.source')}, b.quality) > ({_PREF.replace('source', 'h.source')}, h.quality)")
Q.add(
    "p11_coalesce_work", lambda v: P.coalesce_work(v("job").withColumn("batch", (C("id") % 9).cast("string"))),
    f"""WITH t AS (SELECT kind, dedupe_key, id, priority, id % 9 AS b, status = 'leased' AS leased FROM {{job}} WHERE status IN {_ACTIVE}), k AS (SELECT kind, dedupe_key, min(id) FILTER (leased) AS l, max(id) AS m, min(priority) AS priority FROM t GROUP BY ALL),
    f AS (SELECT kind, dedupe_key, b, min(id) AS i, max(leased) AS flying FROM t GROUP BY ALL), g AS (SELECT f.*, l IS NOT NULL AS held FROM f JOIN k USING (kind, dedupe_key))
    SELECT kind, dedupe_key, coalesce(l, m) AS id, priority, coalesce((SELECT string_agg(b::VARCHAR, ',' ORDER BY i) FROM g WHERE g.kind = k.kind AND g.dedupe_key = k.dedupe_key AND (flying OR NOT held)), '') AS batches,
           coalesce((SELECT string_agg(b::VARCHAR, ',' ORDER BY i) FROM g WHERE g.kind = k.kind AND g.dedupe_key = k.dedupe_key AND held AND NOT flying), '') AS pending FROM k""",
)


def _requests(v):
    return P.merge_repair_requests(v("job").selectExpr("id", "status", "series_id * 40 + id % 40 AS series_id", "kind AS reason", "priority AS rank", "IF(id % 5 < 3, '', CAST(id % 7 AS STRING)) AS key"))


_REQUESTS = f"""r AS (SELECT id, status, series_id * 40 + id % 40 AS s, kind, priority, CASE WHEN id % 5 >= 3 THEN (id % 7)::VARCHAR END AS key FROM {{job}} WHERE status IN {_ACTIVE}),
    k AS (SELECT s, coalesce(min(id) FILTER (status = 'leased'), min(id)) AS id, count(*) FILTER (status = 'leased') > 0 AS leased, count(key) AS keys, count(*) - 1 AS cancelled, arg_max(kind, (priority, -id)) AS reason FROM r GROUP BY s),
    y AS (SELECT r.s, key, max(leased) AND NOT max(r.id = k.id) AS pending FROM r JOIN k USING (s) WHERE key IS NOT NULL GROUP BY r.s, key)"""
Q.add("p12_merge_repair_requests", lambda v: _requests(v)[0].select("series_id", "id", "status", "reason", "pending", "cancelled"), f"WITH {_REQUESTS} SELECT k.s AS series_id, k.id, status, CASE WHEN keys > 0 THEN 'merge' ELSE reason END AS reason, k.s IN (SELECT s FROM y WHERE pending) AS pending, cancelled FROM k JOIN {{job}} USING (id)")
Q.add("p12_repair_keys", lambda v: _requests(v)[1], f"WITH {_REQUESTS} SELECT s AS series_id, key, pending FROM y")
Q.add("p13_bounded_backlog", lambda v: P.bounded_backlog(v("job"), 50).groupBy("kind", "status").agg(F.count("*").alias("n")), f"WITH t AS (SELECT kind, status, row_number() OVER (PARTITION BY kind ORDER BY status <> 'leased', created_at, id) AS p FROM {{job}} WHERE status IN {_ACTIVE}) SELECT kind, CASE WHEN status <> 'leased' AND p > 50 THEN 'cancelled' ELSE status END AS status, count(*) AS n FROM t GROUP BY ALL")
Q.add("p16_stranded_operations", lambda v: P.stranded_operations(v("job").selectExpr("id", "IF(id % 2 = 0, 'running', 'done') AS status", "id + 1 AS job_id"), v("job")).select("id", "status"), f"SELECT id, CASE WHEN id % 2 = 1 THEN 'done' WHEN id + 1 IN (SELECT id FROM {{job}} WHERE status IN {_ACTIVE}) THEN 'running' ELSE 'failed' END AS status FROM {{job}}")
Q.add("p17_equivalent_operation", lambda v: P.equivalent_operation(v("job").selectExpr("id", "kind AS action", "array(series_id, id % 3, series_id) AS ids")), "SELECT kind AS action, array_to_string(list_sort(list_distinct([series_id, id % 3])), ',') AS ids, max(id) AS id, count(*) AS n FROM {job} GROUP BY 1, 2")
Q.add("p18_due_polls", lambda v: P.due_polls(v("source_state"), v("job").groupBy("source").agg(F.max("created_at").alias("polled_at")).withColumn("interval_seconds", F.lit(3600)), F.lit("2024-02-01 12:00:00").cast("timestamp")), "SELECT s.source FROM {source_state} s JOIN (SELECT source, max(created_at) AS p FROM {job} GROUP BY source) j USING (source) WHERE enabled AND (cooldown_until IS NULL OR cooldown_until <= TIMESTAMP '2024-02-01 12:00:00') AND p + INTERVAL 1 HOUR <= TIMESTAMP '2024-02-01 12:00:00'")
_AT = "TIMESTAMP '2024-01-31 00:00:00'"


def _limited(v):
    """Policies of identities: some expired, paced, limited, clean again or exploring; some have none."""
    at = lambda c: f"{_AT} - make_dt_interval(0, 0, 0, CAST({c} AS INT))"
    rows = v("identity").selectExpr(
        "id", "IF(id % 4 = 0, NULL, CAST(id % 9 AS INT)) AS limit", "id % 11 > 0 AS known", f"IF(id % 5 = 0, NULL, {at('(id % 7 - 5) * 1000')}) AS expires_at", "CAST(id % 3 * 7.5 AS DOUBLE) AS interval", "CAST(size % 6 AS INT) AS learned",
        f"IF(id % 2 = 0, NULL, {at('id % 9000')}) AS limited_at", f"IF(id % 13 = 0, NULL, {at('id % 5000')}) AS clean_since", "CAST(size * 20 AS INT) AS cooldown", "CAST(id % 6 AS INT) AS tier", f"IF(id % 10 < 6, NULL, {at('(id % 3 - 1) * 500')}) AS explore_until",
    )
    policy = {c: C(c) for c in ("known", "expires_at", "interval", "learned", "limited_at", "clean_since", "cooldown", "tier", "explore_until")}
    return rows.select("id", P.effective_limit(C("limit"), policy, F.lit("2024-01-31 00:00:00").cast("timestamp"), 60.0).cast("int").alias("n"))


Q.add(
    "p19_effective_limit", _limited,
    """WITH t AS (SELECT id, CASE WHEN id % 4 > 0 THEN id % 9 END AS l, id % 11 > 0 AND NOT coalesce(CASE WHEN id % 5 > 0 THEN (id % 7 - 5) * 1000 END >= 0, false) AS valid, id % 3 * 7.5 AS i, size % 6 AS learned, CASE WHEN id % 2 > 0 THEN id % 9000 END AS limited, CASE WHEN id % 13 > 0 THEN id % 5000 END AS clean,
              size * 20 AS cooldown, id % 6 AS tier, coalesce(CASE WHEN id % 10 >= 6 THEN (id % 3 - 1) * 500 END < 0, false) AS explores FROM {identity}),
    p AS (SELECT *, least(l, CASE WHEN i > 0 THEN greatest(1, floor(60 / i)) END) AS paced, CASE WHEN limited IS NOT NULL THEN greatest(1, learned) + CASE WHEN clean < limited THEN floor(clean / greatest(cooldown, 300)) ELSE 0 END END AS adaptive FROM t),
    q AS (SELECT *, least(paced, adaptive) AS learnt FROM p)
    SELECT id, CASE WHEN NOT valid THEN l WHEN explores THEN greatest(coalesce(nullif(learnt, 0), 1), coalesce(nullif(tier, 0), learnt, 1)) ELSE learnt END::INT AS n FROM q""",
)


def _read(v):
    progress = v("release").filter("id % 3 <> 0 AND series_id % 4 <> 1").selectExpr("id AS child_id", "IF(id % 50 = 7, 0, 20) AS pages", "id % 25 AS pages_read")
    known = v("reading").selectExpr("release_id AS child_id", "state", "IF(state = 'read', updated_at, NULL) AS read_at", "updated_at")
    return progress, P.child_states(progress, known, mid())


_READ = f"""p AS (SELECT id, CASE WHEN id % 50 = 7 THEN 0 ELSE 20 END AS pages, id % 25 AS n FROM {{release}} WHERE id % 3 <> 0 AND series_id % 4 <> 1),
    c AS (SELECT coalesce(p.id, k.release_id) AS child_id, CASE WHEN p.id IS NULL THEN state WHEN pages > 0 AND n >= pages THEN 'read' WHEN n > 0 THEN 'reading' ELSE 'unread' END AS state,
          CASE WHEN p.id IS NULL THEN CASE WHEN state = 'read' THEN updated_at END WHEN pages > 0 AND n >= pages THEN coalesce(CASE WHEN state = 'read' THEN updated_at END, {_MID}) END AS read_at, CASE WHEN p.id IS NULL THEN updated_at ELSE {_MID} END AS updated_at FROM p FULL JOIN {{reading}} k ON k.release_id = p.id)"""
Q.add("p20_child_states", lambda v: _read(v)[1], f"WITH {_READ} FROM c")
Q.add(
    "p20_reading_state", lambda v: P.reading_state(v("series"), v("release").select("id", "series_id"), _read(v)[1], _read(v)[0]),
    f"""WITH {_READ}, o AS (SELECT series_id AS id, count(*) FILTER (state = 'read') AS read, count(*) FILTER (state = 'reading') AS reading, count(*) AS total, count(*) FILTER (id % 3 <> 0 AND series_id % 4 <> 1) AS told FROM {{release}} LEFT JOIN c ON child_id = id GROUP BY 1)
    SELECT s.id, coalesce(read, 0) AS read, coalesce(reading, 0) AS reading, coalesce(total, 0) AS total, CASE WHEN coalesce(told, 0) = 0 OR status IN ('paused', 'untracked') THEN status WHEN read = total THEN 'caught_up' WHEN read + reading > 0 THEN 'reading' ELSE 'interested' END AS status FROM {{series}} s LEFT JOIN o USING (id)""",
)
Q.add("p21_mark_all_read", lambda v: P.mark_all_read(v("release"), v("reading").selectExpr("release_id AS id", "state", "updated_at"), 7, mid()).select("id", "state"), "SELECT coalesce(o.release_id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.state ELSE 'read' END AS state FROM {reading} o FULL JOIN (SELECT id FROM {release} WHERE series_id = 7) n ON n.id = o.release_id")
Q.add("p22_covers_to_change", lambda v: P.covers_to_change(v("series").selectExpr("id", "IF(id % 4 = 0, id, NULL) AS cover_id"), W.ranked_covers(v("identity").selectExpr("id", "series_id", "source", "100 + size AS width", "200 AS height")), 20), f"WITH b AS (SELECT series_id, arg_min(id, (-(100 + size) * 200, -least(100 + size, 200), -greatest(100 + size, 200), -({_PREF}), id)) AS best FROM {{identity}} GROUP BY 1) SELECT s.id, CASE WHEN s.id % 4 = 0 THEN s.id END AS cover_id, best FROM {{series}} s JOIN b ON b.series_id = s.id WHERE CASE WHEN s.id % 4 = 0 THEN s.id END IS DISTINCT FROM best ORDER BY s.id LIMIT 20")
Q.add("p23_backfill_latest", lambda v: P.backfill_latest(v("series"), v("release")).select("id", "latest_id", "latest_number"), f"SELECT s.id, coalesce(w.id, s.latest_id) AS latest_id, CASE WHEN w.id IS NULL THEN s.latest_number ELSE w.number END AS latest_number FROM {{series}} s LEFT JOIN ({_LATEST}) w ON w.series_id = s.id")
Q.add("p24_backfill_group_keys", lambda v: P.backfill_group_keys(v("job")).select("id", "group_key"), "SELECT id, coalesce(nullif(group_key, ''), CASE WHEN kind = 'error' THEN 'source:' || source ELSE 'series:' || series_id END) AS group_key FROM {job}")
Q.add("p25_sync_projections", lambda v: P.sync_projections(W.first_row(v("artifact"), ["series_id", "chapter"], [C("id")]).selectExpr("series_id", "chapter", "id AS artifact_id"), W.first_row(v("projection").filter("artifact_id % 5 > 0"), ["series_id", "chapter"], [F.desc("artifact_id")])), "WITH w AS (SELECT series_id, chapter, min(id) AS w FROM {artifact} GROUP BY ALL), e AS (SELECT series_id, chapter, max(artifact_id) AS e FROM {projection} WHERE artifact_id % 5 > 0 GROUP BY ALL) SELECT series_id, chapter, CASE WHEN e IS NULL THEN 'insert' WHEN w IS NULL THEN 'delete' WHEN w = e THEN 'keep' ELSE 'update' END AS action FROM w FULL JOIN e USING (series_id, chapter)")
Q.add("p26_release_recovered", lambda v: P.release_recovered(v("job").withColumn("error_code", F.when(C("id") % 2 == 0, "source_down").otherwise("")), ["alpha", "gamma"], ["source_down"], mid())[0].select("id", "due_at", "error_code"), f"SELECT id, CASE WHEN h THEN least(due_at, {_MID}) ELSE due_at END AS due_at, CASE WHEN h OR id % 2 > 0 THEN '' ELSE 'source_down' END AS error_code FROM (SELECT *, status IN ('queued', 'retrying') AND source IN ('alpha', 'gamma') AND id % 2 = 0 AS h FROM {{job}})")
Q.add("p27_dismiss_failures", lambda v: P.dismiss_failures(v("job"))[0].groupBy("status").agg(F.count("*").alias("n")), "WITH t AS (SELECT CASE WHEN status = 'failed' AND id = max(id) OVER (PARTITION BY kind, dedupe_key) THEN 'cancelled' ELSE status END AS status FROM {job}) SELECT status, count(*) AS n FROM t GROUP BY 1")
Q.add("p29_chapterless_acquisition", lambda v: P.chapterless_acquisition(v("series"), v("release").filter("series_id % 3 > 0"), v("identity"), v("identity").filter("size = 3").select(F.concat_ws(":", "source", "id").alias("key"))), "SELECT series_id, source || ':' || id AS key FROM {identity} WHERE series_id IN (SELECT id FROM {series} WHERE status <> 'untracked') AND series_id NOT IN (SELECT series_id FROM {release} WHERE series_id % 3 > 0) AND size <> 3")


# All tables of identities of one series and source, as one identity.
def _merged(v):
    i = v("identity").selectExpr("id", "CAST(id / 12 AS BIGINT) AS series_id", "source", "source_id", "url", "title", "CASE WHEN id % 5 = 0 THEN title ELSE '' END AS description", "CASE WHEN id % 4 = 1 THEN url END AS cover_url", "CASE WHEN id % 9 = 0 THEN '{}' ELSE '' END AS metadata")
    alternates = W.first_row(v("identity").filter("id % 6 = 0").selectExpr("id AS primary_id", "source", "concat('alt-', id % 40) AS source_id", "title", "url"), ["source", "source_id"], [C("primary_id")])
    releases = v("chapter").selectExpr("identity_id * 100 + number AS id", "identity_id", "IF(number = 7, NULL, CAST(number AS STRING)) AS release_key")
    aliases = v("alias").selectExpr("identity_id * 10 AS id", "CAST(identity_id / 12 AS BIGINT) AS series_id", "identity_id", "split(alias, ' ')[0] AS alias")
    return M.merge_identity_tables(i, alternates, releases, aliases, v("external_id"), v("decision"), 21)


_I = """i AS (SELECT id, id // 12 AS s, source, source_id, url, title, min(id) OVER (PARTITION BY id // 12, source) AS keeper, CASE WHEN id % 5 = 0 THEN nullif(title, '') END AS d, CASE WHEN id % 4 = 1 THEN url END AS c, CASE WHEN id % 9 = 0 THEN '{}' END AS m FROM {identity})""".replace("'{}'", "'{' || '}'")
Q.add("m07_merged_identities", lambda v: _merged(v)["identities"].select("id", "series_id", "source", "description", "cover_url", "metadata"), f"WITH {_I} SELECT keeper AS id, s AS series_id, source, coalesce(arg_min(d, id) FILTER (d IS NOT NULL), '') AS description, arg_min(c, id) FILTER (c IS NOT NULL) AS cover_url, coalesce(arg_min(m, id) FILTER (m IS NOT NULL), '') AS metadata FROM i GROUP BY keeper, s, source")
Q.add(
    "m07_alternates", lambda v: _merged(v)["alternates"],
    f"""WITH {_I}, a AS (SELECT id, source, 'alt-' || (id % 40) AS source_id, title, url FROM {{identity}} WHERE id % 6 = 0 QUALIFY row_number() OVER (PARTITION BY source, id % 40 ORDER BY id) = 1),
    u AS (SELECT keeper AS primary_id, source, source_id, title, url, 0 AS o, id AS f FROM i WHERE id <> keeper UNION ALL SELECT keeper, a.source, a.source_id, a.title, a.url, 1, a.id FROM a JOIN i USING (id))
    SELECT primary_id, source, source_id, title, url FROM u QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY o, f) = 1""",
)
_R = "r AS (SELECT identity_id * 100 + number AS id, keeper, identity_id AS f, CASE WHEN number <> 7 THEN number::VARCHAR END AS k, identity_id <> keeper AS moved, first_value(identity_id * 100 + number) OVER (PARTITION BY keeper, number ORDER BY identity_id <> keeper, identity_id, number) AS best FROM {chapter} JOIN i ON i.id = identity_id)"
Q.add("m07_moved_releases", lambda v: _merged(v)["releases"], f"WITH {_I}, {_R} SELECT id, keeper AS identity_id, k AS release_key FROM r WHERE NOT moved OR k IS NULL OR id = best")
Q.add("m07_release_map", lambda v: _merged(v)["release_map"], f"WITH {_I}, {_R} SELECT id AS old, best AS new FROM r WHERE moved AND k IS NOT NULL AND id <> best")
Q.add("m07_moved_external_ids", lambda v: _merged(v)["external_ids"], f"WITH {_I} SELECT keeper AS identity_id, provider, value FROM {{external_id}} JOIN i ON i.id = identity_id QUALIFY row_number() OVER (PARTITION BY keeper, provider ORDER BY identity_id <> keeper, identity_id) = 1")
Q.add("m07_moved_aliases", lambda v: _merged(v)["aliases"], f"WITH {_I}, n AS (SELECT identity_id * 10 AS id, s AS series_id, keeper AS identity_id, string_split(alias, ' ')[1] AS alias, identity_id <> keeper AS moved FROM {{alias}} JOIN i ON i.id = identity_id) SELECT id, series_id, identity_id, alias FROM n QUALIFY NOT moved OR row_number() OVER (PARTITION BY series_id, {_norm('alias')} ORDER BY moved, id) = 1")
Q.add("m07_decisions_left", lambda v: _merged(v)["decisions"].select("id", "left_id", "right_id", "decision"), f"WITH {_I}, g AS (SELECT id FROM i WHERE id <> keeper) SELECT id, left_id, right_id, decision FROM {{decision}} WHERE id = 21 OR (left_id NOT IN (FROM g) AND right_id NOT IN (FROM g))")


# A catalog with every fault that repairs mend: identities of one source in a series, releases without a chapter of their own,
# series that nothing provides, and activity about what isn't there.
def _catalog(v, tables):
    """Written once where a table is a set made of others, as each step reads several tables anew."""
    given = lambda df, name: tables.write(df, f"given-{name}")
    kids = given(v("chapter").selectExpr("identity_id * 100 + number AS id", "identity_id", "CAST(identity_id / 20 AS BIGINT) * 100 + number AS chapter_id", "number AS n"), "kids")
    named = kids.selectExpr(
        "id", "identity_id", "chapter_id", "IF(n = 12, 'Latest Chapter', CAST(n AS STRING)) AS number", "CASE n WHEN 11 THEN 'Chapter {{ number }}' WHEN 10 THEN concat('Latest: Chapter 10 of ', identity_id) ELSE concat('Chapter ', n) END AS title",
        "CASE n WHEN 12 THEN 'https://t.test/chapter-1' WHEN 9 THEN 'https://t.test/chapter-2' ELSE '' END AS url",
    )
    identities = v("identity").selectExpr("id", "CAST(id / 20 AS BIGINT) AS series_id", "source", "IF(id % 3 = 0, 'same', source_id) AS source_id", "url", "title", "IF(id % 5 = 0, ' ', '[]') AS metadata")
    series = identities.selectExpr("series_id AS id", "concat('S', series_id) AS title", "'reading' AS status").distinct().unionByName(v("series").filter("id % 7 = 0").selectExpr("id + 1000000 AS id", "title", "status"))
    return {
        "series": given(series, "series"), "identities": identities, "releases": named, "chapters": given(kids.selectExpr("chapter_id AS id", "CAST(chapter_id / 100 AS BIGINT) AS series_id", "CAST(n AS STRING) AS number", "'' AS title").distinct(), "chapters"),
        "files": kids.selectExpr("id", "id AS release_id", "chapter_id", "n % 2 = 0 AS active"), "jobs": kids.filter("identity_id % 2 = 0").selectExpr("id", "id AS release_id"),
        "progress": given(kids.filter("n < 4").selectExpr("chapter_id", "'read' AS state").distinct(), "progress"), "activity": kids.selectExpr("id", "CAST(identity_id / 20 AS BIGINT) AS series_id", "chapter_id", "IF(identity_id % 5 = 0, -id, IF(identity_id % 2 = 0, id, NULL)) AS job_id"),
    }


def _repaired(v):
    tables = Tables(v("region").sparkSession, "repairs")
    c = _catalog(v, tables)
    return R.apply_plan(c, R.plan_repairs(c, tables), tables)


_MENDED = f"""i AS (SELECT id, id // 20 AS s, source, title, CASE WHEN id % 3 = 0 THEN 'same' ELSE rtrim(lower(trim(source_id)), '/') END AS k FROM {{identity}}), f AS (SELECT *, first_value(id) OVER w AS kept, first_value(k) OVER w AS kk FROM i WINDOW w AS (PARTITION BY s, source ORDER BY id)),
    j AS (SELECT *, id <> kept AND k = kk AS merged, id <> kept AND k <> kk AS split FROM f), r AS (SELECT c.identity_id * 100 + number AS id, identity_id, number AS n, merged, split, CASE WHEN merged THEN kept ELSE identity_id END AS owner FROM {{chapter}} c JOIN j ON j.id = identity_id),
    b AS (SELECT owner, n, arg_min(id, (merged, id)) AS best FROM r WHERE n NOT IN (9, 11, 12) GROUP BY ALL), w AS (SELECT r.*, CASE n WHEN 12 THEN 1 WHEN 9 THEN 2 ELSE CASE WHEN merged THEN n END END AS wanted FROM r),
    o AS (SELECT w.*, w.n = 11 OR (best IS NOT NULL AND best <> id) AS gone, CASE WHEN w.n <> 11 AND best <> id THEN best END AS target FROM w LEFT JOIN b ON b.owner = w.owner AND b.n = wanted),
    top AS (SELECT greatest(max(id // 20), (SELECT max(id) + 1000000 FROM {{series}} WHERE id % 7 = 0)) AS t FROM {{identity}}), fresh AS (SELECT id, (SELECT t FROM top) + row_number() OVER (ORDER BY id) AS s FROM j WHERE split)"""
Q.add(
    "i18_repaired_releases", lambda v: (lambda c: c["releases"].join(c["chapters"].select(C("id").alias("chapter_id"), "series_id"), "chapter_id").select("id", "identity_id", "title", "series_id"))(_repaired(v)),
    f"WITH {_MENDED} SELECT o.id, owner AS identity_id, CASE WHEN n = 10 THEN 'Chapter 10 of ' || identity_id WHEN n = 11 THEN '' ELSE 'Chapter ' || n END AS title, coalesce(fresh.s, identity_id // 20) AS series_id FROM o LEFT JOIN fresh ON fresh.id = identity_id WHERE NOT gone",
)
Q.add(
    "i18_repaired_files", lambda v: _repaired(v)["files"].select("id", "release_id", "active"),
    f"WITH {_MENDED}, g AS (SELECT target, max(id) FILTER (n % 2 = 0) AS giver FROM o WHERE target IS NOT NULL GROUP BY 1) SELECT o.id, coalesce(o.target, o.id) AS release_id, n % 2 = 0 AND coalesce(giver = o.id, true) AS active FROM o LEFT JOIN g ON g.target = coalesce(o.target, o.id) WHERE n <> 11",
)
Q.add("i18_repaired_identities", lambda v: _repaired(v)["identities"].select("id", "series_id", "metadata"), f"WITH {_MENDED} SELECT j.id, coalesce(fresh.s, j.s) AS series_id, CASE WHEN j.id % 5 = 0 THEN '{{' || '}}' ELSE '[]' END AS metadata FROM j LEFT JOIN fresh USING (id) WHERE NOT merged".replace("'{{'", "'{'").replace("'}}'", "'}'"))
Q.add("i18_repaired_series", lambda v: _repaired(v)["series"], f"WITH {_MENDED} SELECT DISTINCT s AS id, 'S' || s AS title, 'reading' AS status FROM i UNION ALL SELECT id + 1000000, title, status FROM {{series}} WHERE id % 7 = 0 AND status <> 'untracked' UNION ALL SELECT fresh.s, title, 'reading' FROM fresh JOIN j USING (id)")
Q.add("i17_typed_actions", lambda v: (lambda tables: R.plan_repairs(_catalog(v, tables), tables))(Tables(v("region").sparkSession, "repairs")).groupBy("category", "action").agg(F.count("*").alias("n")), f"""WITH {_MENDED} SELECT 'metadata' AS category, 'normalize_metadata' AS action, count(*) AS n FROM i WHERE id % 5 = 0 UNION ALL SELECT 'identity', CASE WHEN merged THEN 'consolidate_identity' ELSE 'split_identity' END, count(*) FROM j WHERE merged OR split GROUP BY 2
    UNION ALL SELECT 'release', CASE WHEN n = 11 THEN 'quarantine_release' WHEN gone THEN 'consolidate_release' ELSE 'remove_prefix' END, count(*) FROM o WHERE gone OR n = 10 GROUP BY 2 UNION ALL SELECT 'integrity', 'null_reference', count(*) FROM r WHERE identity_id % 5 = 0
    UNION ALL SELECT 'integrity', 'delete_series', count(*) FROM {{series}} WHERE id % 7 = 0 AND status = 'untracked'""")


def _second_plan(v):
    """Actions that a plan of the repaired catalog would have: none."""
    return R.plan_repairs(_repaired(v), Tables(v("region").sparkSession, "repairs")).agg(F.count("*").alias("n"))


Q.add("i18_second_plan", _second_plan, "SELECT 0::BIGINT AS n FROM {region} LIMIT 1")
