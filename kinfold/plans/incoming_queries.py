"""Queries of incoming listings, portable documents, plans of work and stored files."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import audit as I
from kinfold.operators import catalog_io as IO
from kinfold.operators import incoming as R
from kinfold.operators import planning as P
from kinfold.operators import portable as X
from kinfold.operators import resolve as E
from kinfold.operators.sets import set_overlap
from kinfold.plans.build import Queries
from kinfold.plans.relational_queries import _PREF, mid
from kinfold.plans.resolve_queries import _KEY, _URL, _series_pairs
from kinfold.plans.scalar_queries import _norm
from kinfold.session import Tables, fresh_path, write_table
from kinfold.sources import files as S

Q = Queries()
C = F.col
_NEW = 10_000_000  # ids of incoming rows


def _incoming(v):
    """Every fifth identity comes again: under its own id, a known other one, or a new one."""
    return v("identity").filter("id % 5 = 0").selectExpr(f"id + {_NEW} AS id", "source", "title", "CASE id % 3 WHEN 0 THEN source_id WHEN 1 THEN concat('alt-', id) ELSE concat('new-', id) END AS source_id", "concat('https://new.test/', id) AS url")


_INCOMING = f"SELECT id + {_NEW} AS id, source, title, CASE id % 3 WHEN 0 THEN source_id WHEN 1 THEN 'alt-' || id ELSE 'new-' || id END AS source_id FROM {{identity}} WHERE id % 5 = 0"


def _incoming_children(v):
    return v("chapter").unionByName(v("chapter").filter("identity_id % 5 = 0").select((C("identity_id") + _NEW).alias("identity_id"), "number"))


def _equivalents(v):
    return R.equivalent_listing(_incoming(v), v("identity"), _incoming_children(v), v("external_id"))


_EQUIVALENT = f"""c AS (SELECT * FROM {{chapter}} UNION ALL SELECT identity_id + {_NEW}, number FROM {{chapter}} WHERE identity_id % 5 = 0), n AS (SELECT identity_id AS i, count(*) AS n FROM c GROUP BY 1),
    inc AS ({_INCOMING}), d AS (SELECT *, {_norm('title')} AS t, {_KEY} AS k FROM {{identity}}), di AS (SELECT *, {_norm('title')} AS t, {_KEY} AS k FROM inc),
    p AS (SELECT d.id AS a, di.id AS b, d.k = di.k AS same FROM d JOIN di ON d.source = di.source AND d.t = di.t AND d.t <> '' AND di.id IN (SELECT identity_id FROM c)),
    o AS (SELECT a, b, count(*) AS common FROM p JOIN c x ON x.identity_id = a JOIN c y ON y.identity_id = b AND x.number = y.number GROUP BY a, b),
    r AS (SELECT p.*, coalesce(common, 0) AS common, least(coalesce(na.n, 0), coalesce(nb.n, 0)) AS smaller FROM p LEFT JOIN o USING (a, b) LEFT JOIN n na ON na.i = p.a LEFT JOIN n nb ON nb.i = p.b),
    q AS (SELECT *, CASE WHEN smaller = 0 THEN 0 ELSE round_even(common / smaller, 4) END::DOUBLE AS ratio FROM r WHERE same OR (smaller >= 5 AND common / nullif(smaller, 0) >= 0.9)),
    eq AS (SELECT b AS incoming, a AS identity, ratio, common FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY ratio DESC, common DESC, a) AS rn FROM q) WHERE rn = 1)"""
Q.add("e29_equivalent_listing", _equivalents, f"WITH {_EQUIVALENT} SELECT * FROM eq")
_FRESH = f"('0x' || substr(md5(source || ':' || {_KEY}), 1, 15))::BIGINT"
Q.add(
    "e30_resolve_identity",
    lambda v: R.resolve_identity(
        _incoming(v), v("identity"), v("identity").filter("id % 10 = 0").selectExpr("source", "concat('alt-', id) AS source_id", "id + 1 AS identity_id"), _equivalents(v), v("external_id"),
        v("external_id").selectExpr(f"identity_id + {_NEW} AS id", "provider", "CAST(CAST(value AS INT) + 1 AS STRING) AS value"),
    ),
    f"""WITH {_EQUIVALENT}, e AS (SELECT di.id, min(d.id) AS exact FROM di JOIN d ON d.source = di.source AND (d.source_id = di.source_id OR (d.k <> '' AND d.k = di.k)) GROUP BY di.id),
    a AS (SELECT di.id, x.id + 1 AS alternate FROM di JOIN {{identity}} x ON x.id % 10 = 0 AND x.source = di.source AND di.source_id = 'alt-' || x.id),
    own AS (SELECT DISTINCT provider, value, series_id FROM {{external_id}} JOIN {{identity}} i ON i.id = identity_id), taken AS (SELECT DISTINCT series_id, source FROM {{identity}}),
    s AS (SELECT id, arg_min(series_id, (provider, series_id)) AS shared FROM (SELECT di.id, o.provider, o.series_id FROM {{external_id}} w JOIN di ON di.id = w.identity_id + {_NEW} JOIN own o ON o.provider = w.provider AND o.value = (w.value::INT + 1)::VARCHAR LEFT JOIN taken t ON t.series_id = o.series_id AND t.source = di.source WHERE t.series_id IS NULL) GROUP BY id),
    f AS (SELECT di.id, di.source, di.source_id, coalesce(exact, alternate, identity) AS identity_id, shared, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN alternate IS NOT NULL THEN 'alternate' WHEN identity IS NOT NULL THEN 'equivalent' WHEN shared IS NOT NULL THEN 'external_id' ELSE 'new' END AS how
          FROM di LEFT JOIN e USING (id) LEFT JOIN a USING (id) LEFT JOIN eq ON eq.incoming = di.id LEFT JOIN s USING (id))
    SELECT f.id, f.identity_id, coalesce(i.series_id, shared, {_FRESH.replace('source_id', 'f.source_id').replace('source ||', 'f.source ||')}) AS series_id, how FROM f LEFT JOIN {{identity}} i ON i.id = f.identity_id""",
)
Q.add(
    "p05_sync_external_ids", lambda v: R.sync_external_ids(v("external_id"), v("identity").selectExpr("id AS identity_id", "IF(id % 2 = 0, 'x', 'y') AS provider", "IF(id % 9 = 0, '', CAST(size + id % 4 AS STRING)) AS value")),
    """WITH w AS (SELECT id AS identity_id, CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS provider, (size + id % 4)::VARCHAR AS want FROM {identity} WHERE id % 9 <> 0),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, want ORDER BY identity_id) AS rn FROM w) WHERE rn = 1), o AS (SELECT provider, value AS want, min(identity_id) AS owner FROM {external_id} GROUP BY 1, 2),
    g AS (SELECT f.* FROM f LEFT JOIN o USING (provider, want) WHERE owner IS NULL OR owner = identity_id)
    SELECT identity_id, provider, coalesce(want, value) AS value FROM {external_id} FULL JOIN g USING (identity_id, provider)""",
)


def _bands(v):
    return v("signature").select("id", "hash", F.array(*(F.conv(((F.shiftrightunsigned("hash", s)).bitwiseAND(255)).cast("string"), 10, 16) for s in (16, 8, 0))).alias("bands"))


_BANDS = "SELECT id, unnest(['0:' || (hash >> 16 & 255), '1:' || (hash >> 8 & 255), '2:' || (hash & 255)]) AS k FROM {signature}"
Q.add(
    "e05_block_cover_band", lambda v: R.block_cover_band(v("signature"), v("identity"), _bands(v)),
    f"""WITH d AS (SELECT id, source, series_id, substr({_norm('title')}, 1, 12) AS t FROM {{identity}}), r AS (SELECT d.*, k FROM d JOIN ({_BANDS}) USING (id) UNION ALL SELECT *, 't:' || t FROM d WHERE t <> ''),
    m AS (SELECT DISTINCT x.id AS a, y.id AS b FROM r x JOIN r y ON x.k = y.k AND x.source <> y.source AND x.series_id <> y.series_id WHERE x.id IN (SELECT id FROM {{signature}}))
    SELECT a, b FROM m""",
)
Q.add("e05_cover_shortlist", lambda v: R.cover_shortlist(R.block_cover_band(v("signature"), v("identity"), _bands(v)), v("identity"), v("signature")))
_TERM = f"SELECT DISTINCT unnest(string_split({_norm('title')}, ' ')) AS term FROM {{series}} WHERE id IN (4, 10)"
Q.add(
    "e06_merge_shortlist", lambda v: R.merge_shortlist(v("series").filter("id IN (4, 10)").select("id"), v("series").withColumn("title", F.concat_ws(" ", "title", F.concat(F.lit("vol"), (C("id") % 9).cast("string")))), v("identity"), v("decision"), _bands(v)),
    f"""WITH s AS (SELECT id, status, {_norm("title || ' vol' || (id % 9)")} AS t FROM {{series}}), m AS (SELECT id FROM {{identity}} WHERE series_id IN (4, 10)), terms AS (SELECT DISTINCT term FROM (SELECT unnest(string_split(t, ' ')) AS term FROM s WHERE id IN (4, 10)) WHERE length(term) >= 4),
    i AS (SELECT right_id AS id FROM {{decision}} WHERE decision <> 'rejected' AND left_id IN (FROM m) UNION SELECT left_id FROM {{decision}} WHERE decision <> 'rejected' AND right_id IN (FROM m)
          UNION SELECT id FROM ({_BANDS.replace("'0:' || ", '').replace("'1:' || ", '').replace("'2:' || ", '')}) WHERE k IN (SELECT k FROM ({_BANDS.replace("'0:' || ", '').replace("'1:' || ", '').replace("'2:' || ", '')}) WHERE id IN (FROM m))),
    f AS (SELECT series_id AS id FROM {{identity}} WHERE id IN (FROM i) UNION SELECT s.id FROM s JOIN terms ON contains(s.t, term))
    SELECT s.id FROM s JOIN f USING (id) WHERE status <> 'untracked' AND s.id NOT IN (4, 10) ORDER BY t, s.id LIMIT 500""",
)


def _overlap_score(v):
    kids = v("chapter").join(v("identity").select(C("id").alias("identity_id"), "series_id"), "identity_id").select(C("series_id").alias("identity_id"), "number").distinct()
    return lambda pairs: set_overlap(pairs, kids).select("a", "b", F.round("jaccard", 6).alias("score"))


Q.add(
    "e19_rescore_pending", lambda v: R.rescore_pending(v("decision"), v("identity"), v("identity").filter("series_id % 3 = 0").select(C("series_id").alias("id")), _overlap_score(v)),
    """WITH k AS (SELECT DISTINCT series_id, number FROM {chapter} JOIN {identity} i ON i.id = identity_id), n AS (SELECT series_id, count(*) AS n FROM k GROUP BY 1),
    d AS (SELECT d.*, l.series_id AS a, r.series_id AS b FROM {decision} d LEFT JOIN {identity} l ON l.id = left_id LEFT JOIN {identity} r ON r.id = right_id),
    p AS (SELECT DISTINCT a, b FROM d WHERE decision = 'pending' AND a <> b AND (a % 3 = 0 OR b % 3 = 0)),
    o AS (SELECT p.a, p.b, count(*) FILTER (y.number IS NOT NULL) AS c FROM p LEFT JOIN k x ON x.series_id = p.a LEFT JOIN k y ON y.series_id = p.b AND y.number = x.number GROUP BY ALL),
    s AS (SELECT o.a, o.b, round(coalesce(c / nullif(coalesce(na.n, 0) + coalesce(nb.n, 0) - c, 0), 0)::DOUBLE, 6) AS score FROM o LEFT JOIN n na ON na.series_id = o.a LEFT JOIN n nb ON nb.series_id = o.b)
    SELECT d.id, left_id, right_id, CASE WHEN decision = 'pending' THEN coalesce(score, confidence) ELSE confidence END AS confidence, decision FROM d LEFT JOIN s USING (a, b)""",
)
Q.add("e19_rescore_all_evidence", lambda v: R.rescore_pending(v("decision"), v("identity"), v("identity").select(C("series_id").alias("id")), lambda pairs: E.score_pairs(pairs, v("identity"), v("alias"), v("chapter"), v("external_id"), v("signature"))))


# Portable documents: suppliers' nations as series, suppliers as their sources.
def _portable(v):
    s = v("identity").selectExpr("CAST(id / 7 AS BIGINT) AS key", "id", "source", "source_id", "url", "title")
    series = s.groupBy("key").agg(F.min_by("title", "id").alias("title")).selectExpr("key", "IF(key % 20 = 3, '', title) AS title", "CASE key % 6 WHEN 0 THEN 'interested' WHEN 1 THEN 'reading' WHEN 2 THEN 'paused' WHEN 3 THEN 'untracked' WHEN 4 THEN 'caught_up' ELSE 'odd' END AS status")
    sources = s.selectExpr("key", "IF(id % 31 = 0, 'Bad Name', source) AS source", "source_id", "IF(id % 17 = 0, concat('ftp://x/', id), url) AS url")
    apart = s.filter("id % 13 = 0").selectExpr("source AS left_source", "source_id AS left_id", "IF(id % 2 = 0, source, 'alpha') AS right_source", "IF(id % 2 = 0, source_id, concat('none-', id)) AS right_id")
    return series, sources, apart


_PORTABLE = """s AS (SELECT id // 7 AS key, id, source, source_id, url, title FROM {identity}),
    series AS (SELECT key, CASE WHEN key % 20 = 3 THEN '' ELSE arg_min(title, id) END AS title, CASE key % 6 WHEN 0 THEN 'interested' WHEN 1 THEN 'reading' WHEN 2 THEN 'paused' WHEN 3 THEN 'untracked' WHEN 4 THEN 'caught_up' ELSE 'odd' END AS status FROM s GROUP BY key),
    sources AS (SELECT key, CASE WHEN id % 31 = 0 THEN 'Bad Name' ELSE source END AS source, source_id, CASE WHEN id % 17 = 0 THEN 'ftp://x/' || id ELSE url END AS url FROM s),
    apart AS (SELECT source AS left_source, source_id AS left_id, CASE WHEN id % 2 = 0 THEN source ELSE 'alpha' END AS right_source, CASE WHEN id % 2 = 0 THEN source_id ELSE 'none-' || id END AS right_id FROM s WHERE id % 13 = 0)"""
_I = f"source || ':' || {_KEY}"


def _key_of(column: str) -> str:
    return _KEY.replace("source_id", column)


Q.add(
    "p03_validate_document", lambda v: X.validate_document(*_portable(v), ("alpha", "beta", "gamma")),
    f"""WITH {_PORTABLE}, i AS (SELECT key, {_I} AS identity FROM sources), e AS (SELECT left_source || ':' || {_key_of('left_id')} AS l, right_source || ':' || {_key_of('right_id')} AS r FROM apart)
    SELECT key::VARCHAR AS row_key, 'title_length' AS rule FROM series WHERE length(title) NOT BETWEEN 1 AND 500 UNION SELECT key::VARCHAR, 'status_unknown' FROM series WHERE status = 'odd'
    UNION SELECT key::VARCHAR, 'source_form' FROM sources WHERE NOT regexp_full_match(source, '[a-z0-9_-]{{1,50}}') UNION SELECT key::VARCHAR, 'source_unsupported' FROM sources WHERE source NOT IN ('alpha', 'beta', 'gamma')
    UNION SELECT key::VARCHAR, 'url_scheme' FROM sources WHERE url LIKE 'ftp:%' UNION SELECT key::VARCHAR, 'provider_twice' FROM sources GROUP BY key, source HAVING count(*) > 1
    UNION SELECT identity, 'identity_shared' FROM i GROUP BY identity HAVING count(DISTINCT key) > 1 UNION SELECT l || '|' || r, 'separation_of_one' FROM e WHERE l = r
    UNION SELECT l || '|' || r, 'separation_missing' FROM e WHERE l NOT IN (SELECT identity FROM i) OR r NOT IN (SELECT identity FROM i)""",
)


def _document(v):
    """A document that fits the catalog: series by pairs of identities, each source once, every seventh of them unknown here."""
    s = v("identity").selectExpr("CAST(id / 2 AS BIGINT) AS key", "id", "source", "IF(id % 7 = 0, concat('fresh-', id), concat(source_id, '-', id)) AS source_id", "'' AS url")
    series = s.select("key").distinct().selectExpr("key", "concat('T', key) AS title", "CASE key % 3 WHEN 0 THEN 'interested' WHEN 1 THEN 'paused' ELSE 'untracked' END AS status")
    reading = s.filter("id % 3 = 0").selectExpr("key", "id % 5 AS number", "IF(id % 2 = 0, 'read', 'unread') AS state")
    apart = s.alias("x").join(s.alias("y").hint("merge"), F.expr("y.id = x.id + 2 AND x.id % 6 = 1")).select(C("x.source").alias("left_source"), C("x.source_id").alias("left_id"), C("y.source").alias("right_source"), C("y.source_id").alias("right_id"))
    return series, s.select("key", "source", "source_id", "url"), reading, apart


def _local(v):
    return v("identity").selectExpr("id", "id - id % 2 AS series_id", "source", "concat(source_id, '-', id) AS source_id", "'' AS url")


_DOCUMENT = "s AS (SELECT id // 2 AS key, id, source, id % 7 = 0 AS fresh FROM {identity})"
Q.add(
    "x02_plan_import", lambda v: X.plan_import(_document(v)[0], _document(v)[1], _document(v)[3], _local(v))[0],
    f"WITH {_DOCUMENT}, k AS (SELECT key, count(*) AS n, count(*) FILTER (fresh) AS new, count(DISTINCT CASE WHEN NOT fresh THEN id - id % 2 END) AS local FROM s GROUP BY key) SELECT count(*) AS series, sum(n)::BIGINT AS sources, count(*) FILTER (local = 0) AS create_series, sum(new)::BIGINT AS create_sources, sum(greatest(local - 1, 0))::BIGINT AS merge_series FROM k",
)
Q.add(
    "x02_import_conflicts", lambda v: X.plan_import(*_portable(v), v("identity"))[1],
    f"""WITH {_PORTABLE}, d AS (SELECT id, series_id, {_I} AS i, source || ':' || {_URL} AS u FROM {{identity}}), f AS (SELECT sources.*, {_I} AS i, source || ':' || coalesce(nullif({_URL}, ''), 'x' || substr(url, 6)) AS u FROM sources), g AS (SELECT i, min(id) AS exact FROM d GROUP BY i), h AS (SELECT u, count(*) AS near, min(id) AS one FROM d GROUP BY u),
    r AS (SELECT f.*, CASE WHEN exact IS NOT NULL THEN 1 ELSE coalesce(near, 0) END AS n, coalesce(exact, CASE WHEN near = 1 THEN one END) AS id FROM f LEFT JOIN g USING (i) LEFT JOIN h USING (u)), t AS (SELECT r.key, d.series_id FROM r JOIN d ON d.id = r.id),
    e AS (SELECT DISTINCT left_source || ':' || {_key_of('left_id')} AS l, right_source || ':' || {_key_of('right_id')} AS r FROM apart), o AS (SELECT DISTINCT {_I} AS i, key FROM sources)
    SELECT 'claimed_twice' AS kind, series_id::VARCHAR AS key FROM t GROUP BY series_id HAVING count(DISTINCT key) > 1 UNION ALL SELECT DISTINCT 'merged_and_separated', e.l || '|' || e.r FROM e JOIN o x ON x.i = e.l JOIN o y ON y.i = e.r AND x.key = y.key UNION ALL SELECT DISTINCT 'ambiguous', i FROM r WHERE n > 1""",
)


def _applied(v, k):
    d = _document(v)
    local = _local(v).select(C("series_id").alias("id")).distinct().selectExpr("id", "CASE id % 5 WHEN 0 THEN 'reading' WHEN 1 THEN 'paused' ELSE 'untracked' END AS status")
    read = _local(v).filter("id % 4 = 1").selectExpr("series_id", "id % 5 AS number", "'reading' AS state")
    return X.apply_import(d[0], d[1], d[2], d[3], _local(v), local, read.dropDuplicates(["series_id", "number"]), v("decision"))[k]


_MINE = f"{_DOCUMENT}, hit AS (SELECT key, min(id - id % 2) AS id FROM s WHERE NOT fresh GROUP BY key)"
_RANK = "list_position(['untracked', 'paused', 'caught_up', 'interested', 'reading'], status)"
Q.add(
    "x03_import_statuses", lambda v: _applied(v, 0),
    f"WITH {_MINE}, a AS (SELECT DISTINCT id - id % 2 AS id, CASE (id - id % 2) % 5 WHEN 0 THEN 'reading' WHEN 1 THEN 'paused' ELSE 'untracked' END AS status FROM {{identity}} UNION ALL SELECT id, CASE key % 3 WHEN 0 THEN 'interested' WHEN 1 THEN 'paused' ELSE 'untracked' END FROM hit) SELECT id, arg_max(status, {_RANK}) AS status FROM a GROUP BY id",
)
Q.add(
    "x03_import_reading", lambda v: _applied(v, 1),
    f"WITH {_MINE}, a AS (SELECT DISTINCT id - id % 2 AS series_id, id % 5 AS number, 'reading' AS state FROM {{identity}} WHERE id % 4 = 1 UNION ALL SELECT h.id, s.id % 5, CASE WHEN s.id % 2 = 0 THEN 'read' ELSE 'unread' END FROM s JOIN hit h USING (key) WHERE s.id % 3 = 0) SELECT series_id, number, arg_max(state, list_position(['unread', 'reading', 'read'], state)) AS state FROM a GROUP BY ALL",
)
Q.add(
    "x03_import_separations", lambda v: _applied(v, 2),
    f"WITH {_DOCUMENT}, p AS (SELECT x.id AS left_id, y.id AS right_id FROM s x JOIN s y ON y.id = x.id + 2 AND x.id % 6 = 1 WHERE NOT x.fresh AND NOT y.fresh) SELECT left_id, right_id, decision FROM {{decision}} d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.left_id = d.left_id AND p.right_id = d.right_id) UNION ALL SELECT left_id, right_id, 'rejected' FROM p",
)


# Plans of work.
def _waiting(v):
    return v("release").selectExpr("id + 1 AS id", "IF(id % 2 = 0, 'queued', 'leased') AS status", "source", "id AS release_id", "id % 5 = 0 AS preferred_only", "IF(id % 3 = 0, array('alpha'), array()) AS attempted")


_RETRY = "TIMESTAMP '2024-02-01 00:00:00'"


def _rerouted(v):
    return P.reroute_cooling(_waiting(v), v("release"), v("source_state").filter("cooldown_until IS NOT NULL").selectExpr("source", f"{_RETRY} AS retry_after"), ["series_id", "number"], mid())


_REROUTED = f"""j AS (SELECT r.id + 1 AS id, r.id AS release_id, series_id, number, source, r.id % 5 = 0 AS preferred, CASE WHEN r.id % 3 = 0 THEN ['alpha'] ELSE [] END AS attempted FROM {{release}} r WHERE r.id % 2 = 0 AND source IN ('beta', 'gamma')),
    o AS (SELECT j.id, r.id AS other, r.source, row_number() OVER (PARTITION BY j.id ORDER BY {_PREF.replace('source', 'r.source')} DESC, quality DESC, r.id DESC) AS rn FROM j JOIN {{release}} r ON r.series_id = j.series_id AND r.number = j.number AND available AND NOT list_contains(attempted, r.source) AND r.source <> j.source WHERE NOT preferred)"""
Q.add(
    "p09_reroute_cooling", lambda v: _rerouted(v)[0].withColumn("attempted", F.array_join("attempted", ",")),
    f"""WITH {_REROUTED} SELECT j.id, CASE WHEN other IS NULL THEN 'wait' ELSE 'rerouted' END AS action, coalesce(other, release_id) AS release_id, coalesce(o.source, j.source) AS source, CASE WHEN other IS NULL THEN {_RETRY} ELSE TIMESTAMP '2024-01-15' END AS due_at,
    array_to_string(CASE WHEN other IS NULL THEN attempted ELSE list_sort(list_concat(attempted, [j.source])) END, ',') AS attempted FROM j LEFT JOIN o ON o.id = j.id AND rn = 1""",
)
Q.add("p09_attempts", lambda v: _rerouted(v)[1], f"WITH {_REROUTED} SELECT series_id, number, other AS release_id, j.id AS job_id, o.source, 'fallback_queued' AS outcome, {_RETRY} AS retry_after, j.source AS bypassed_source, release_id AS bypassed_release_id FROM j JOIN o ON o.id = j.id AND rn = 1")
_VERSION = "CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN 'x' WHEN 4 THEN '9' ELSE '1' END"
Q.add(
    "p14_audit_payload_versions", lambda v: P.audit_payload_versions(v("job").selectExpr("id", "status", f"map('version', {_VERSION.replace('id %', '(id div 6) %')}, 'source_id', IF(id % 11 = 0, '', kind)) AS payload", "group_key", "IF(id % 7 = 0, '', 'w') AS workflow_key"), ("source_id",)),
    f"""WITH t AS (SELECT id, status, group_key, id % 7 = 0 AS bare, id % 11 = 0 AS missing, {_VERSION.replace('id %', '(id // 6) %')} AS said FROM {{job}} WHERE status IN ('queued', 'leased', 'retrying')), u AS (SELECT *, CASE WHEN said = '' THEN 1 ELSE coalesce(try_cast(said AS INT), 0) END AS version FROM t)
    SELECT id, version, CASE WHEN missing THEN 'blocked' WHEN version NOT IN (1, 2, 3) THEN CASE WHEN status = 'leased' THEN 'defer_rebuild' ELSE 'rebuild' END WHEN group_key = '' OR bare THEN 'regroup' WHEN version < 3 THEN 'upgrade' ELSE 'preserve' END AS action FROM u""",
)
Q.add(
    "p15_normalize_payload", lambda v: v("job").selectExpr("id", "map('version', '1', 'source_id', kind, 'junk', status, 'mode', IF(id % 2 = 0, 'full', NULL)) AS p").select("id", F.array_join(F.array_sort(F.transform(F.map_entries(P.normalize_payload(C("p"), ("version", "source_id", "mode"), {"mode": "quick", "pages": "1"})), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("payload")),
    "SELECT id, 'mode=' || CASE WHEN id % 2 = 0 THEN 'full' ELSE 'quick' END || ',pages=1,source_id=' || kind || ',version=3' AS payload FROM {job}",
)


def _untracked(v):
    plans = v("series").selectExpr("id AS series_id", "'active' AS status")
    intents = v("release").selectExpr("id", "series_id", "CASE id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'satisfied' WHEN 2 THEN 'blocked' ELSE 'pending' END AS state", "IF(id % 3 = 0, NULL, id) AS job_id")
    out = P.untrack(v("series").filter("status = 'untracked'"), plans, intents, v("job").select("id", "status"))
    return out[0].selectExpr("'plan' AS kind", "series_id AS id", "status").union(out[1].selectExpr("'intent'", "id", "state")).union(out[2].selectExpr("'job'", "id", "status"))


Q.add(
    "p28_untrack", _untracked,
    """WITH u AS (SELECT id FROM {series} WHERE status = 'untracked'), i AS (SELECT id, CASE id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'satisfied' WHEN 2 THEN 'blocked' ELSE 'pending' END AS state, CASE WHEN id % 3 > 0 THEN id END AS job_id, series_id IN (FROM u) AND id % 4 <> 1 AS hit FROM {release})
    SELECT 'plan' AS kind, id, CASE WHEN id IN (FROM u) THEN 'cancelled' ELSE 'active' END AS status FROM {series} UNION ALL SELECT 'intent', id, CASE WHEN hit THEN 'cancelled' ELSE state END FROM i
    UNION ALL SELECT 'job', id, CASE WHEN status IN ('queued', 'retrying') AND id IN (SELECT job_id FROM i WHERE hit AND job_id IS NOT NULL) THEN 'cancelled' ELSE status END FROM {job}""",
)


# Stored files: blobs and their projections, some lost, some changed, some that nothing names.
def _stored(v):
    a = v("artifact").filter("state = 'active'")
    expected = a.selectExpr("concat('blobs/', checksum) AS blob_path", "checksum", "concat('library/', id) AS projection_path")
    files = v("artifact").filter("id % 11 <> 0").selectExpr("concat('blobs/', checksum) AS path", "IF(id % 19 = 0, 'other', checksum) AS sha256").union(v("artifact").filter("id % 13 <> 0").selectExpr("concat('library/', id)", "IF(id % 23 = 0, 'other', checksum)"))
    return I.storage_reconcile(expected, files, v("artifact").filter("id % 5 <> 0").selectExpr("concat('blobs/', checksum) AS blob_path"))


_STATE = "CASE WHEN id % 11 = 0 OR id % 19 = 0 THEN 'missing_blob' WHEN id % 13 = 0 OR id % 23 = 0 THEN 'repair' ELSE 'ok' END"
Q.add("i11_storage_states", lambda v: _stored(v)[0], f"SELECT 'blobs/' || checksum AS blob_path, 'library/' || id AS projection_path, {_STATE} AS state FROM {{artifact}} WHERE state = 'active'")
Q.add("i11_storage_reconcile", lambda v: _stored(v)[1], f"WITH t AS (SELECT {_STATE} AS s FROM {{artifact}} WHERE state = 'active') SELECT count(*) AS checked, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'repair') AS repair, count(*) FILTER (s = 'missing_blob') AS missing_blobs, (SELECT count(*) FROM {{artifact}} WHERE id % 11 <> 0 AND id % 5 = 0) AS orphan_blobs FROM t")
Q.add("i19_identity_repair_audit", lambda v: I.identity_repair_audit(v("identity").selectExpr("id", "series_id", "source", "regexp_extract(source_id, '^(.*)-[^-]*$', 1) AS stable", "title", "CAST(size % 3 AS STRING) AS cover"), v("chapter"), 0.3))


# Benchmark runs of providers close, and their policies learn from them.
def _runs(v):
    return v("request_sample").groupBy("source").agg(F.count("*").alias("requests"), (F.count_if(C("status") >= 400) > 0).alias("limited"), F.max(C("id") % 900).alias("max_retry_after")).withColumns({"tier": F.length("source"), "limited": C("limited") & (C("source") != "beta"), "requests": F.when(C("source") == "gamma", 50).otherwise(C("requests"))})


def _policies(v):
    return v("source_state").select("source").filter("source <> 'delta'").selectExpr("source", "2 AS job_limit", "6 AS page_limit", "IF(source = 'alpha', 0.0D, 0.25D) AS interval", "300L AS cooldown", "1 AS clean_runs")


Q.add(
    "t07_benchmark_learning", lambda v: P.learn_policies(_runs(v), _policies(v), mid()),
    """WITH r AS (SELECT source, CASE WHEN source = 'gamma' THEN 50 ELSE count(*) END AS n, count(*) FILTER (status >= 400) > 0 AND source <> 'beta' AS bad, max(id % 900) AS retry, length(source) AS tier FROM {request_sample} GROUP BY source),
    p AS (SELECT source, 2 AS job_limit, 6 AS page_limit, CASE WHEN source = 'alpha' THEN 0.0 ELSE 0.25 END::DOUBLE AS i, 300 AS cooldown, 1 AS clean_runs FROM {source_state} WHERE source <> 'delta'),
    j AS (SELECT r.source, tier, retry, coalesce(job_limit, 1) AS jl, coalesce(page_limit, 2) AS pl, coalesce(i, 0) AS i, coalesce(cooldown, 0) AS cd, coalesce(clean_runs, 0) AS cr, CASE WHEN bad THEN 'limited' WHEN n >= 100 THEN 'succeeded' ELSE 'inconclusive' END AS state FROM r LEFT JOIN p USING (source))
    SELECT source, state, CASE state WHEN 'limited' THEN greatest(1, tier - 1) WHEN 'succeeded' THEN greatest(jl, tier) ELSE jl END::INT AS job_limit, CASE state WHEN 'limited' THEN greatest(1, least(pl, greatest(2, (tier - 1) * 2))) WHEN 'succeeded' THEN greatest(pl, tier * 2) ELSE pl END::INT AS page_limit,
           CASE state WHEN 'limited' THEN greatest(0.5, i * 2) WHEN 'succeeded' THEN round(i * 0.8, 3) ELSE i END::DOUBLE AS interval, CASE state WHEN 'limited' THEN greatest(cd, retry) ELSE cd END::BIGINT AS cooldown, CASE state WHEN 'succeeded' THEN cr + 1 ELSE 0 END::INT AS clean_runs,
           TIMESTAMP '2024-01-15' + CASE state WHEN 'limited' THEN INTERVAL 30 DAY WHEN 'succeeded' THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END AS next_run FROM j""",
)
Q.add(
    "t06_recovery_probes", lambda v: P.recovery_probes(v("request_sample").select("source", "id", C("sampled_at").alias("at"), (C("id") % 7 < 3).alias("ok"))),
    """WITH a AS (SELECT source, id, sampled_at AS t, id % 7 < 3 AS ok, count(*) FILTER (id % 7 >= 3) OVER (PARTITION BY source ORDER BY id) AS run FROM {request_sample}),
    b AS (SELECT *, ok AND count(*) FILTER (ok) OVER (PARTITION BY source, run ORDER BY id) % 2 = 0 AS back FROM a),
    c AS (SELECT *, coalesce(count(*) FILTER (back) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM b),
    d AS (SELECT *, least(count(*) FILTER (NOT ok) OVER (PARTITION BY source, epoch ORDER BY id), 6) AS step, min(epoch_us(t)) FILTER (NOT ok) OVER (PARTITION BY source, epoch ORDER BY id) AS started FROM c)
    SELECT source, id, CASE WHEN back THEN 0 WHEN ok THEN 30 ELSE 60 * [1, 2, 5, 10, 20, 40, 60][step + 1] END::BIGINT AS wait, CASE WHEN back AND started IS NOT NULL THEN greatest(60, least(21600, floor(floor((epoch_us(t) - started) / 1000000) * 1.2))) END::BIGINT AS cooldown FROM d""",
)


# Artifacts as archives: some unreadable, empty, without metadata, or with another number than the catalog's.
def _breaches(v):
    a = v("artifact").withColumn("path", F.concat(F.lit("a/"), C("id").cast("string")))
    members = a.filter("id % 9 <> 0").selectExpr("path", "checksum", "explode(IF(id % 8 = 0, array('1.jpg'), array('1.jpg', '2.png', 'info.xml', 'logo.png'))) AS member")
    told = a.filter("id % 10 <> 0").selectExpr("path", "checksum", "series_id", "CAST(chapter AS DOUBLE) / 2 + IF(id % 21 = 0, 1, 0) AS number")
    known = a.filter("id % 25 <> 0").selectExpr("path", "checksum", "series_id", "CAST(chapter AS DOUBLE) / 2 AS number")
    return I.archive_check(a.selectExpr("path", "checksum", "id % 12 <> 0 AS readable"), members, told, known, a.filter("id % 6 = 1").select("checksum"), ("path", "checksum"))


_FACTS = """f AS (SELECT id, 'a/' || id AS path, id % 12 <> 0 AS readable, CASE WHEN id % 9 = 0 THEN 0 WHEN id % 8 = 0 THEN 1 ELSE 2 END AS pages, id % 10 <> 0 AS told, id % 21 = 0 AS wrong, id % 25 <> 0 AS placed, chapter % 2 = 1 AS half FROM {artifact} WHERE id % 6 <> 1),
    b AS (SELECT path, unnest(list_filter([CASE WHEN NOT readable THEN 'unreadable' END, CASE WHEN readable AND pages = 0 THEN 'no_images' END, CASE WHEN readable AND NOT told THEN 'no_metadata' END, CASE WHEN readable AND told AND placed AND wrong THEN 'metadata_differs' END, CASE WHEN NOT placed THEN 'places' END,
                 CASE WHEN readable AND pages = 1 AND placed AND half THEN 'review_single_page' END], lambda x: x IS NOT NULL)) AS rule FROM f)"""
Q.add("i10_archive_check", _breaches, f"WITH {_FACTS} SELECT path, rule FROM b")
Q.add(
    "x04_import_records", lambda v: I.import_records(v("artifact").withColumn("path", F.concat(F.lit("a/"), C("id").cast("string"))).select("id", "path", "series_id", "chapter", "checksum"), v("artifact").filter("id % 14 = 0"), _breaches(v), v("artifact").filter("id % 4 = 2").groupBy("series_id", "chapter").agg(F.min("checksum").alias("checksum"))),
    f"""WITH {_FACTS}, r AS (SELECT path, string_agg(DISTINCT rule, ',' ORDER BY rule) AS reason FROM b WHERE rule NOT LIKE 'review%' GROUP BY path), n AS (SELECT series_id, chapter, min(checksum) AS now FROM {{artifact}} WHERE id % 4 = 2 GROUP BY ALL)
    SELECT id, CASE WHEN id % 14 = 0 THEN 'resumed' WHEN reason IS NOT NULL THEN 'invalid' WHEN now IS NULL THEN 'activated' WHEN now = checksum THEN 'duplicate' ELSE 'conflict' END AS status, CASE WHEN id % 14 <> 0 THEN coalesce(reason, '') ELSE '' END AS reason
    FROM {{artifact}} a LEFT JOIN n USING (series_id, chapter) LEFT JOIN r ON r.path = 'a/' || a.id""",
)


# A whole catalog as a document, written, read, checked, and imported where there is nothing yet.
def _whole(v):
    i = v("identity").filter("id % 7 <> 3").selectExpr("id", "id - id % 2 AS series_id", "source", "concat(source_id, '-', id) AS source_id", "title", "url", "'' AS description", "IF(id % 10 = 0, 'r1', '') AS revision")
    kept = i.select(C("id").alias("identity_id"), "series_id")
    status = "CASE series_id % 5 WHEN 0 THEN 'untracked' WHEN 1 THEN 'interested' WHEN 2 THEN 'reading' WHEN 3 THEN 'caught_up' ELSE 'paused' END"
    chapters = write_table(v("chapter").join(kept, "identity_id").selectExpr("series_id * 100 + number AS id", "series_id", "CAST(number AS STRING) AS number").distinct(), "chapters")  # of all lines
    return {
        "series": i.groupBy("series_id").agg(F.min("title").alias("title")).selectExpr("series_id AS id", "title", "concat('about ', series_id) AS description", f"{status} AS status"), "identities": i,
        "aliases": v("alias").join(kept, "identity_id").select("series_id", "identity_id", "alias").unionByName(i.filter("id % 8 = 0").selectExpr("series_id", "CAST(NULL AS BIGINT) AS identity_id", "concat('own ', id) AS alias")),
        "external_ids": v("external_id").join(kept, "identity_id").selectExpr("identity_id", "provider", "concat(value, '-', identity_id) AS value"),
        "alternates": i.filter("id % 6 = 0").selectExpr("id AS identity_id", "source", "concat('alt-', id) AS source_id", "title", "url"), "chapters": chapters,
        "reading": chapters.filter("id % 3 = 0").selectExpr("id AS chapter_id", "CASE id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'reading' ELSE 'unread' END AS state", "IF(id % 4 = 0 OR id % 5 = 0, TIMESTAMP '2024-01-03 04:05:06', NULL) AS read_at"),
        "artifacts": chapters.filter("id % 11 = 0").selectExpr("id AS chapter_id", "IF(id % 2 = 0, 'active', 'quarantined') AS state"), "decisions": v("decision").select("left_id", "right_id", "decision"), "providers": v("source_state").select("source", "enabled"),
    }


def _written(v, whole=None):
    """The exported document through its file."""
    spark = v("region").sparkSession
    path = fresh_path(spark, "document")
    S.document_lines(IO.export_catalog(whole or _whole(v)), "2024-01-31T00:00:00Z").write.text(path)
    return S.load_document(spark, path)


def _created(v):
    spark = v("region").sparkSession
    whole = _whole(v)
    empty = {k: df.limit(0) for k, df in whole.items()}
    return IO.import_catalog(_written(v, whole)[0], empty, Tables(spark, "import"))


_CAT = """i AS (SELECT id, id - id % 2 AS s, source, source_id || '-' || id AS source_id, title, url FROM {identity} WHERE id % 7 <> 3), ch AS (SELECT DISTINCT s * 100 + number AS id, s, number FROM {chapter} JOIN i ON i.id = identity_id),
    held AS (SELECT DISTINCT s FROM ch WHERE id % 11 = 0 AND id % 2 = 0), k AS (SELECT s FROM i WHERE s % 5 <> 0 UNION SELECT s FROM held UNION SELECT s FROM i GROUP BY s HAVING count(*) > 1 UNION SELECT i.s FROM {decision} JOIN i ON i.id IN (left_id, right_id) WHERE decision = 'rejected'),
    x AS (SELECT s, min(title) AS title, CASE WHEN s % 5 = 0 THEN CASE WHEN s IN (FROM held) THEN 'interested' ELSE 'untracked' END ELSE ['interested', 'reading', 'caught_up', 'paused'][s % 5] END AS status FROM i JOIN k USING (s) GROUP BY s),
    r AS (SELECT s, number, CASE id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'reading' ELSE 'unread' END AS state, CASE WHEN id % 4 = 0 OR id % 5 = 0 THEN TIMESTAMP '2024-01-03 04:05:06' END AS read_at FROM ch JOIN k USING (s) WHERE id % 3 = 0),
    n AS (SELECT i.id, (SELECT count(*) FROM {alias} a WHERE a.identity_id = i.id) AS aliases, (SELECT count(DISTINCT provider) FROM {external_id} e WHERE e.identity_id = i.id) AS ids, (i.id % 6 = 0)::BIGINT AS alternates FROM i)"""


def _belongings(sources, aliases, ids, alternates, on):
    of = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    out = sources.join(of(aliases, "aliases"), on, "left").join(of(ids, "ids"), on, "left").join(of(alternates, "alternates"), on, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("aliases", "ids", "alternates")})


Q.add("x01_catalog_series", lambda v: IO.export_catalog(_whole(v))["series"], f"WITH {_CAT} SELECT s::VARCHAR AS key, title, status, 'about ' || s AS description, s IN (FROM held) AS downloaded FROM x")
Q.add("x01_catalog_reading", lambda v: IO.export_catalog(_whole(v))["reading"], f"WITH {_CAT} SELECT s::VARCHAR AS key, number::VARCHAR AS chapter, state, read_at FROM r WHERE state <> 'unread' OR read_at IS NOT NULL")
Q.add(
    "k02_document_sources", lambda v: (lambda d: _belongings(d["sources"].join(d["series"].select("key", C("title").alias("series"), "status"), "key"), d["source_aliases"], d["external_ids"], d["alternates"], ["key", "source"]).select("series", "status", "source", "source_id", "revision", "aliases", "ids", "alternates"))(_written(v)[0]),
    f"WITH {_CAT} SELECT x.title AS series, status, source, source_id, CASE WHEN i.id % 10 = 0 THEN 'r1' ELSE '' END AS revision, aliases, ids, alternates FROM i JOIN x USING (s) JOIN n USING (id)",
)
Q.add("p03_document_is_sound", lambda v: (lambda d, u: IO.validate(d, ("alpha", "beta", "gamma", "delta"), u))(*_written(v)), "SELECT '' AS row_key, '' AS rule FROM {region} WHERE false")
Q.add(
    "x03_created_identities", lambda v: (lambda c: _belongings(c["identities"].withColumnRenamed("id", "identity_id").join(c["series"].select(C("id").alias("series_id"), C("title").alias("series"), "status"), "series_id"), c["aliases"].filter("identity_id IS NOT NULL"), c["external_ids"], c["alternates"], ["identity_id"]).select("series", "status", "source", "source_id", "ids", "alternates"))(_created(v)),
    f"WITH {_CAT} SELECT x.title AS series, status, source, source_id, ids, alternates FROM i JOIN x USING (s) JOIN n USING (id)",
)
Q.add("x03_created_reading", lambda v: (lambda c: c["reading"].join(c["chapters"].select(C("id").alias("chapter_id"), "series_id", "number"), "chapter_id").join(c["series"].select(C("id").alias("series_id"), "title"), "series_id").select("title", "number", "state", "read_at"))(_created(v)), f"WITH {_CAT} SELECT title, number::VARCHAR AS number, state, read_at FROM r JOIN x USING (s) WHERE state <> 'unread' OR read_at IS NOT NULL")
Q.add("x03_created_separations", lambda v: (lambda c: (lambda i: c["decisions"].join(i.selectExpr("id AS left_id", "n AS l"), "left_id").join(i.selectExpr("id AS right_id", "n AS r"), "right_id").select(F.least("l", "r").alias("lo"), F.greatest("l", "r").alias("hi"), "decision").distinct())(c["identities"].selectExpr("id", "concat(source, ':', source_id) AS n")))(_created(v)), f"WITH {_CAT}, d AS (SELECT l.source || ':' || l.source_id AS l, r.source || ':' || r.source_id AS r FROM {{decision}} JOIN i l ON l.id = left_id JOIN i r ON r.id = right_id WHERE decision = 'rejected') SELECT DISTINCT least(l, r) AS lo, greatest(l, r) AS hi, 'rejected' AS decision FROM d")
