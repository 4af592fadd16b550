"""Queries of entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import blocking as B
from kinfold.operators import resolve as E
from kinfold.operators.components import connected_components
from kinfold.operators.sets import gathered
from kinfold.plans.build import Queries
from kinfold.plans.fixtures import oracle
from kinfold.plans.scalar_queries import _norm
from kinfold.session import write_table

Q = Queries()
C = F.col
_KEY = "regexp_replace(trim(regexp_replace(lower(source_id), '[^a-z0-9]+', '-', 'g'), '-'), '-[0-9a-f]{8}$', '')"
_URL = "regexp_replace(rtrim(lower(regexp_extract(url, '^https?://([^?#]*)', 1)), '/'), '^www\\.', '')"
_TOK = f"list_sort(list_distinct(list_filter(string_split({_norm('title')}, ' '), lambda t: len(t) > 1 AND t NOT IN ('an', 'and', 'of', 'the', 'to'))))"


_N = f"SELECT *, {_norm('title')} AS t, {_KEY} AS k, {_URL} AS u, {_TOK} AS toks FROM {{identity}}"

Q.add("e01_block_exact_title", lambda v: E.block_exact_title(v("identity")), f"WITH n AS ({_N}) SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.source = y.source AND x.t = y.t AND x.id < y.id")
Q.add("e02_block_identity_key", lambda v: E.block_identity_key(v("identity")), f"WITH n AS ({_N}) SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.source = y.source AND (x.k = y.k OR x.u = y.u) AND x.id < y.id")
Q.add("e03_block_token_pair", lambda v: E.block_token_pair(v("identity"), v("signature"), 8), f"WITH n AS (SELECT i.id, source, {_TOK} AS toks, s.hash FROM {{identity}} i JOIN {{signature}} s ON s.id = i.id) SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.source = y.source AND x.id < y.id AND len(list_intersect(x.toks, y.toks)) >= 2 AND bit_count(xor(x.hash, y.hash)) <= 8")
Q.add("e04_block_title_or_alias", lambda v: E.block_title_or_alias(v("identity").select("id", "source", "title", F.array(F.concat("title", F.lit(" x")), F.lit("Red Ring Small")).alias("aliases")), v("identity"), v("alias")), f"WITH n AS ({_N}), o AS (SELECT id, source, t FROM n UNION SELECT n.id, n.source, {_norm('a.alias')} FROM n JOIN {{alias}} a ON a.identity_id = n.id), i AS (SELECT id, source, unnest([t, trim(t || ' x'), 'red ring small']) AS t FROM n) SELECT DISTINCT i.id AS incoming, o.id FROM i JOIN o ON o.t = i.t AND o.source <> i.source")


def _pairs(v):
    return v("decision").selectExpr("left_id AS a", "right_id AS b").distinct()


_P = "SELECT DISTINCT left_id AS a, right_id AS b FROM {decision}"
_TITLED = "SELECT id, source, title, source_id, url FROM {identity}"
Q.add("e08_external_conflicts", lambda v: E.external_conflicts(v("external_id").selectExpr("identity_id AS a", "identity_id + 10 AS b"), v("external_id")), "SELECT x.identity_id AS a, y.identity_id AS b, count(DISTINCT CASE WHEN x.value <> y.value THEN x.provider END) AS conflicts, count(DISTINCT CASE WHEN x.value = y.value THEN x.provider || ':' || x.value END) AS shared FROM {external_id} x JOIN {external_id} y ON y.identity_id = x.identity_id + 10 AND x.provider = y.provider GROUP BY ALL")
_OVER = "n AS (SELECT identity_id AS i, count(*) AS n FROM {chapter} GROUP BY 1), c AS (SELECT a, b, count(*) AS common FROM p JOIN {chapter} x ON x.identity_id = a JOIN {chapter} y ON y.identity_id = b AND x.number = y.number GROUP BY a, b)"
Q.add(
    "e07_duplicate_evidence",
    lambda v: _all_evidence(v),
    _EVIDENCE := f"""WITH d AS (SELECT *, {_norm('title')} AS t, {_KEY} AS k, {_URL} AS u, {_TOK} AS toks FROM {{identity}}),
    p AS (SELECT x.id AS a, y.id AS b FROM d x JOIN d y ON x.source = y.source AND x.t = y.t AND x.id < y.id UNION {_P}), {_OVER},
    e AS (SELECT a, b, bool_or(x.value <> y.value) AS bad FROM p JOIN {{external_id}} x ON x.identity_id = a JOIN {{external_id}} y ON y.identity_id = b AND x.provider = y.provider GROUP BY a, b),
    r AS (SELECT p.a, p.b, coalesce(common, 0) AS common, least(coalesce(na.n, 0), coalesce(nb.n, 0)) AS smaller, x.source = y.source AND (x.k = y.k OR x.u = y.u) AS identity_equivalent, x.t = y.t AS title_agrees,
                 len(list_intersect(x.toks, y.toks)) >= 2 AS tokens_agree, coalesce(bit_count(xor(s.hash, z.hash)), 64) AS distance, coalesce(e.bad, false) AS conflict
          FROM p JOIN d x ON x.id = p.a JOIN d y ON y.id = p.b LEFT JOIN c ON c.a = p.a AND c.b = p.b LEFT JOIN n na ON na.i = p.a LEFT JOIN n nb ON nb.i = p.b LEFT JOIN e ON e.a = p.a AND e.b = p.b LEFT JOIN {{signature}} s ON s.id = p.a LEFT JOIN {{signature}} z ON z.id = p.b),
    q AS (SELECT *, CASE WHEN smaller = 0 THEN 0 ELSE round_even(common / smaller, 4) END::DOUBLE AS ratio, smaller >= 5 AND common / nullif(smaller, 0) >= 0.9 AS sc FROM r)
    SELECT * EXCLUDE (sc), sc AS strong_children, identity_equivalent OR (title_agrees AND sc AND NOT conflict) OR (distance <= 8 AND tokens_agree AND sc AND NOT conflict) AS equivalent FROM q""",
)
Q.add("e09_title_score", lambda v: E.title_score(_pairs(v), v("identity").select("id", "title").unionByName(v("alias").selectExpr("identity_id AS id", "alias AS title"))))
Q.add("e10_latest_evidence", lambda v: v("identity").selectExpr("id", "size AS a", "CASE WHEN id % 7 > 0 THEN CAST(id % 50 AS INT) END AS b").select("id", E.latest_evidence(C("a"), C("b")).alias("x")).select("id", "x.*"), "SELECT id, id % 7 > 0 AS compared, CASE WHEN id % 7 > 0 THEN abs(size - id % 50) END AS delta, CASE WHEN id % 7 = 0 THEN 0 WHEN abs(size - id % 50) <= 2 THEN 1 WHEN abs(size - id % 50) <= 6 THEN 1 - (abs(size - id % 50) - 2) / 4.0 ELSE 0 END::DOUBLE AS similarity, id % 7 > 0 AND abs(size - id % 50) <= 2 AS match FROM {identity}")
Q.add("e10_latest_similarity", lambda v: v("identity").selectExpr("id", "size AS a", "CASE WHEN id % 7 > 0 THEN CAST(id % 50 AS INT) END AS b").select("id", E.latest_similarity(C("a"), C("b")).alias("latest")), "SELECT id, CASE WHEN id % 7 = 0 THEN 0 WHEN abs(size - id % 50) <= 2 THEN 1 WHEN abs(size - id % 50) <= 6 THEN 1 - (abs(size - id % 50) - 2) / 4.0 ELSE 0 END::DOUBLE AS latest FROM {identity}")
_COVER = "SELECT id, CAST(id % 33 AS INT) AS distance, CAST(id % 17 AS INT) AS inliers, CAST(id % 17 + id % 5 AS INT) AS good FROM {identity}"
_STATE = "CASE WHEN (inliers >= 12 AND r >= 0.65 AND distance <= 18) OR (inliers >= 4 AND r >= 0.6 AND distance <= 4) THEN 'match' WHEN (inliers >= 8 AND r >= 0.5 AND distance <= 22) OR (inliers >= 4 AND r >= 0.5 AND distance <= 10) THEN 'likely' WHEN distance >= 28 AND inliers < 4 THEN 'different' ELSE 'inconclusive' END"


def _covers(v):
    rows = v("identity").selectExpr("id", "CAST(id % 33 AS INT) AS distance", "CAST(id % 17 AS INT) AS inliers", "CAST(id % 17 + id % 5 AS INT) AS good")
    return rows.withColumn("state", E.cover_state(C("distance"), C("inliers"), C("good")))


Q.add("e11_cover_state", lambda v: _covers(v).select("id", "state"), f"SELECT id, {_STATE} AS state FROM (SELECT *, inliers / greatest(good, 1) AS r FROM ({_COVER}))")
Q.add("e12_cover_similarity", lambda v: _covers(v).select("id", F.round(E.cover_similarity(C("state"), C("distance"), C("inliers") / F.greatest("good", F.lit(1))), 6).alias("cover")), f"WITH t AS (SELECT *, {_STATE} AS state, greatest(0, 1 - distance / 32.0, r) AS raw FROM (SELECT *, inliers / greatest(good, 1) AS r FROM ({_COVER}))) SELECT id, round(CASE state WHEN 'match' THEN greatest(raw, 0.98) WHEN 'likely' THEN least(greatest(raw, 0.7), 0.89) WHEN 'different' THEN least(raw, 0.15) ELSE least(raw, 0.6) END::DOUBLE, 6) AS cover FROM t")


def _series_pairs(v):
    return v("decision").selectExpr("left_id - left_id % 2 AS a", "right_id - right_id % 2 AS b").filter("a <> b").distinct()


_SP = "SELECT DISTINCT left_id - left_id % 2 AS a, right_id - right_id % 2 AS b FROM {decision} WHERE left_id - left_id % 2 <> right_id - right_id % 2"
Q.add(
    "e13_best_cover_pair", lambda v: E.best_cover_pair(_series_pairs(v), v("identity"), v("signature")).select("a", "b", F.round("cover", 6).alias("cover"), "state", "l", "r"),
    f"""WITH p AS ({_SP}), o AS (SELECT i.id, series_id, hash FROM {{identity}} i JOIN {{signature}} s ON s.id = i.id),
    x AS (SELECT a, b, l.id AS l, r.id AS r, bit_count(xor(l.hash, r.hash)) AS d FROM p JOIN o l ON l.series_id = a JOIN o r ON r.series_id = b),
    y AS (SELECT *, CASE WHEN d <= 4 THEN 'match' WHEN d <= 10 THEN 'likely' WHEN d >= 28 THEN 'different' ELSE 'inconclusive' END AS state, greatest(0, 1 - d / 32.0) AS raw FROM x),
    z AS (SELECT *, CASE state WHEN 'match' THEN greatest(raw, 0.98) WHEN 'likely' THEN least(greatest(raw, 0.7), 0.89) WHEN 'different' THEN least(raw, 0.15) ELSE least(raw, 0.6) END AS c FROM y)
    SELECT a, b, round(c::DOUBLE, 6) AS cover, state, l, r FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY c DESC, l, r) AS rn FROM z) WHERE rn = 1""",
)
Q.add("e14_knn_ratio_matches", lambda v: E.knn_ratio_matches(_pairs(v), v("signature").selectExpr("id", "posexplode(array(hash, shiftright(hash, 3), hash & 65535)) AS (k, d)")), f"WITH p AS ({_P}), d AS (SELECT id, unnest([hash, hash >> 3, hash & 65535]) AS d, unnest([1, 2, 3]) AS k FROM {{signature}}), x AS (SELECT a, b, l.k, bit_count(xor(l.d, r.d)) AS h, row_number() OVER (PARTITION BY a, b, l.k ORDER BY bit_count(xor(l.d, r.d))) AS rn FROM p JOIN d l ON l.id = a JOIN d r ON r.id = b), t AS (SELECT a, b, k, max(h) FILTER (rn = 1) AS n1, max(h) FILTER (rn = 2) AS n2 FROM x GROUP BY ALL) SELECT a, b, count(*) FILTER (n1 < 0.78 * n2) AS good FROM t GROUP BY a, b")
Q.add("e15_combined_score", lambda v: v("identity").select("id", F.round(E.combined_score((C("id") % 11) / 10, (C("id") % 7) / 10, F.lit(0.1), (C("id") % 3) / 2, F.when(C("id") % 4 == 0, 1.0).otherwise(0.5), C("id") % 5 == 0), 6).alias("score")), "WITH t AS (SELECT id, id % 11 / 10 AS ti, 0.2 * (id % 11 / 10) + 0.55 * (id % 7 / 10) + 0.08 * 0.1 + 0.05 * (id % 3 / 2) + 0.12 * CASE WHEN id % 4 = 0 THEN 1 ELSE 0.5 END AS s FROM {identity}) SELECT id, round(CASE WHEN id % 5 > 0 THEN s WHEN id % 4 = 0 OR ti >= 0.75 THEN greatest(s, 0.9) ELSE greatest(s, 0.86) END::DOUBLE, 6) AS score FROM t")


def flagship(v):
    told = v("identity").groupBy(C("series_id").alias("id")).agg(F.concat_ws(" / ", F.min("title"), F.max("source_id"), F.min("source")).alias("text"))
    return E.score_pairs(_series_pairs(v), v("identity"), v("alias"), v("chapter"), v("external_id"), v("signature"), told)


Q.add("e16_score_pairs", flagship)
Q.add("e17_best_selected", lambda v: E.best_selected(flagship(v)))
Q.add("e18_record_candidates", lambda v: E.record_candidates(v("identity").selectExpr("id AS a", "CAST((13 * id + 5) % 100 AS BIGINT) AS b"), v("decision"), "manual"), "SELECT DISTINCT least(id, (13 * id + 5) % 100) AS left_id, greatest(id, (13 * id + 5) % 100) AS right_id, 'pending' AS decision, 'manual' AS policy FROM {identity} i WHERE id <> (13 * id + 5) % 100 AND NOT EXISTS (SELECT 1 FROM {decision} d WHERE d.left_id = least(i.id, (13 * i.id + 5) % 100) AND d.right_id = greatest(i.id, (13 * i.id + 5) % 100))")


def _edges(v):
    return v("decision").filter("decision = 'accepted'").selectExpr("left_id AS a", "right_id AS b")


_EDGES = "SELECT left_id AS a, right_id AS b FROM {decision} WHERE decision = 'accepted'"
_CC = "e AS ({edges} UNION SELECT b, a FROM ({edges})), r AS (SELECT a AS node, a AS root FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.root), cc AS (SELECT node, min(root) AS root FROM r GROUP BY node)"
# All links are those of a title, so that no link is left between representatives.
Q.add("e20_clique_groups", lambda v: E.clique_groups(v("decision").limit(0).selectExpr("left_id AS a", "right_id AS b"), E.title_classes(v("identity"))))
Q.add("e21_connected_components", lambda v: connected_components(_edges(v)))
Q.oracles["e21_connected_components"] = oracle(f"WITH {_CC.replace('{edges}', _EDGES)} SELECT * FROM cc").replace("WITH ", "WITH RECURSIVE ", 1)
Q.add("e22_review_proposals", lambda v: E.review_proposals(v("decision"), _edges(v)))
Q.oracles["e22_review_proposals"] = oracle(f"WITH {_CC.replace('{edges}', _EDGES)}, p AS (SELECT d.*, coalesce(x.root, left_id) AS l, coalesce(y.root, right_id) AS h FROM {{decision}} d LEFT JOIN cc x ON x.node = left_id LEFT JOIN cc y ON y.node = right_id WHERE decision = 'pending') SELECT least(l, h) AS lo, greatest(l, h) AS hi, arg_max(id, (confidence, -id)) AS representative, max(confidence) AS confidence, count(*) AS decisions, string_agg(id, ',' ORDER BY id) AS decision_ids, array_to_string(list_sort(list_distinct(list_concat(any_value(lm), any_value(hm)))), ',') AS members FROM (SELECT p.*, coalesce((SELECT list(node) FROM cc WHERE root = l), [l]) AS lm, coalesce((SELECT list(node) FROM cc WHERE root = h), [h]) AS hm FROM p) WHERE l <> h GROUP BY 1, 2").replace("WITH ", "WITH RECURSIVE ", 1)
_PENDING = "p AS (SELECT d.id, coalesce(x.root, left_id) AS l, coalesce(y.root, right_id) AS h FROM {decision} d LEFT JOIN cc x ON x.node = left_id LEFT JOIN cc y ON y.node = right_id WHERE decision = 'pending'), q AS (SELECT id, least(l, h) AS lo, greatest(l, h) AS hi FROM p WHERE l <> h)"
Q.add("e22_proposal_members", lambda v: E.proposal_rows(v("decision"), _edges(v))[0])
Q.oracles["e22_proposal_members"] = oracle(f"WITH {_CC.replace('{edges}', _EDGES)}, {_PENDING}, z AS (SELECT DISTINCT lo, hi, unnest([lo, hi]) AS root FROM q) SELECT lo, hi, coalesce(node, z.root) AS member FROM z LEFT JOIN cc ON cc.root = z.root").replace("WITH ", "WITH RECURSIVE ", 1)
Q.add("e22_proposal_decisions", lambda v: E.proposal_rows(v("decision"), _edges(v))[1])
Q.oracles["e22_proposal_decisions"] = oracle(f"WITH {_CC.replace('{edges}', _EDGES)}, {_PENDING} SELECT lo, hi, id FROM q").replace("WITH ", "WITH RECURSIVE ", 1)
Q.add("e23_proposal_components", lambda v: E.proposal_components(E.review_proposals(v("decision"), _edges(v))))
Q.add("e24_provider_conflicts", lambda v: E.provider_conflicts(v("identity").selectExpr("CAST(id / 8 AS BIGINT) AS group_id", "series_id").distinct(), v("identity"), v("chapter")), f"WITH g AS (SELECT DISTINCT id // 8 AS group_id, series_id FROM {{identity}}), m AS (SELECT group_id, id, source, {_KEY} AS k, {_URL} AS u FROM g JOIN {{identity}} i USING (series_id)), s AS (SELECT x.group_id, x.id AS a, y.id AS b, x.k = y.k OR x.u = y.u AS key FROM m x JOIN m y ON x.group_id = y.group_id AND x.source = y.source AND x.id < y.id), p AS (SELECT DISTINCT a, b FROM s), {_OVER} SELECT group_id, bool_or(NOT key AND (coalesce(common, 0) < 2 OR (least(coalesce(na.n, 0), coalesce(nb.n, 0)) > 0 AND common / least(na.n, nb.n) < 0.5))) AS conflict FROM s LEFT JOIN c USING (a, b) LEFT JOIN n na ON na.i = a LEFT JOIN n nb ON nb.i = b GROUP BY group_id")
Q.add("e25_blockers", lambda v: E.blockers(v("decision").selectExpr("id", "explode(array(left_id, right_id)) AS series_id"), v("decision").filter("id % 5 = 0").select("id"), v("job").filter("status = 'leased'").select("series_id"), v("identity").filter("size = 7").select("series_id")).select("id", F.array_join("blockers", ",").alias("blockers")), "WITH p AS (SELECT id, unnest([left_id, right_id]) AS s FROM {decision}) SELECT id, concat_ws(',', CASE WHEN id % 5 = 0 THEN 'provider_conflict' END, CASE WHEN bool_or(s IN (SELECT series_id FROM {job} WHERE status = 'leased')) THEN 'active_work' END, CASE WHEN bool_or(s IN (SELECT series_id FROM {identity} WHERE size = 7)) THEN 'reserved' END) AS blockers FROM p GROUP BY id")
Q.add("e26_hydrate_proposals", lambda v: E.hydrate(v("decision").orderBy(F.desc("confidence"), "id").limit(20), v("identity"), ["title", "url"]).select("id", "left_title", "right_url"), "SELECT d.id, l.title AS left_title, r.url AS right_url FROM (SELECT * FROM {decision} ORDER BY confidence DESC, id LIMIT 20) d JOIN {identity} l ON l.id = left_id JOIN {identity} r ON r.id = right_id")
Q.add("e27_merge_candidates", lambda v: E.merge_candidates_ranked(v("identity").selectExpr("id", "title", "source", "size / 50.0D AS stored", "CASE WHEN id % 3 = 0 THEN id % 40 / 40.0D END AS fresh"), v("source_state").filter("NOT enabled"), 50).select("id", F.round("score", 6).alias("score")), "SELECT id, round(greatest(size / 50, coalesce(CASE WHEN id % 3 = 0 THEN id % 40 / 40 END, 0))::DOUBLE, 6) AS score FROM {identity} WHERE source <> 'delta' ORDER BY greatest(size / 50, coalesce(CASE WHEN id % 3 = 0 THEN id % 40 / 40 END, 0)) DESC, title, id LIMIT 50")
# Every second snapshot row has lost its external id; all identities are snapshot and candidates.
Q.add("e28_match_external", lambda v: E.match_external(v("identity").selectExpr("id", "id + 1 AS hint", "IF(id % 2 = 0, source_id, concat('old-', source_id)) AS ext", "CAST(series_id AS STRING) AS folder", "title"), v("identity").selectExpr("id AS cid", "source_id AS ext", "CAST(series_id AS STRING) AS folder", "title")))
# The key of every second legacy row is out of date.
Q.add("e31_recovery_match", lambda v: E.recovery_match(v("identity").selectExpr("id", "IF(id % 2 = 0, concat(source, source_id), concat('old-', source, source_id)) AS key", "title"), v("identity").selectExpr("concat(source, source_id) AS key", "series_id"), v("identity").select("title", "series_id")), f"WITH f AS (SELECT id, CASE WHEN id % 2 = 0 THEN source || source_id ELSE 'old-' || source || source_id END AS key, {_norm('title')} AS t FROM {{identity}}), a AS (SELECT f.id, count(DISTINCT series_id) AS n, min(series_id) AS s FROM f JOIN {{identity}} i ON i.source || i.source_id = f.key GROUP BY f.id), o AS (SELECT DISTINCT {_norm('title')} AS t, series_id FROM {{identity}}), b AS (SELECT f.id, count(DISTINCT series_id) AS n, min(series_id) AS s FROM f JOIN o ON o.t = f.t GROUP BY f.id) SELECT f.id, coalesce(a.s, b.s) AS series_id, CASE WHEN coalesce(a.n, b.n, 0) = 0 THEN 'create_track' WHEN coalesce(a.n, b.n) > 1 THEN 'review_merge' WHEN a.n IS NOT NULL THEN 'verified' ELSE 'track' END AS action FROM f LEFT JOIN a USING (id) LEFT JOIN b USING (id)")
Q.add("e32_recovery_review_pairs", lambda v: E.first_per_pair(v("decision").selectExpr("id", "left_id - left_id % 2 AS a", "right_id - right_id % 2 AS b"), ["a", "b"], ["id"]), "SELECT id, a, b FROM (SELECT id, left_id - left_id % 2 AS a, right_id - right_id % 2 AS b, row_number() OVER (PARTITION BY left_id - left_id % 2, right_id - right_id % 2 ORDER BY id) AS rn FROM {decision}) WHERE rn = 1")
Q.add("e33_batch_preview", lambda v: E.batch_preview(v("decision").select("id"), v("decision").selectExpr("id", "IF(id % 3 = 0, array('x'), array()) AS blockers"), v("decision").filter("id % 4 = 0")), "SELECT count(*) AS selected, count(*) FILTER (id % 3 > 0) AS eligible, count(*) FILTER (id % 3 = 0) AS blocked FROM {decision} WHERE id % 4 > 0")

# Every second proposal is chosen; a reason against one stands against all that share a series with it.
_CHOSEN = "SELECT left_id AS a, right_id AS b FROM {decision} WHERE id % 2 = 0"
Q.add("e33_batch_of_components", lambda v: E.batch_preview(v("decision").select("id", C("left_id").alias("lo"), C("right_id").alias("hi")), v("decision").selectExpr("id", "IF(id % 5 = 0, array('x'), array()) AS blockers"), v("decision").limit(0), v("decision").filter("id % 2 = 0")))
Q.oracles["e33_batch_of_components"] = oracle(f"WITH {_CC.replace('{edges}', _CHOSEN)}, t AS (SELECT id, id % 5 = 0 AS bad, root FROM {{decision}} JOIN cc ON node = left_id WHERE id % 2 = 0), g AS (SELECT root, bool_or(bad) AS bad FROM t GROUP BY root) SELECT count(*) AS selected, count(*) FILTER (NOT g.bad) AS eligible, count(*) FILTER (g.bad) AS blocked FROM t JOIN g USING (root)").replace("WITH ", "WITH RECURSIVE ", 1)

# Pairs by classes, expanded: the rows of the pairs made one by one.
Q.add("e01_exact_title_all", lambda v: B.expand(B.title_classes(v("identity"))))
Q.add("e02_identity_key_all", lambda v: B.expand(B.key_classes(v("identity"))))
Q.oracles["e01_exact_title_all"], Q.oracles["e02_identity_key_all"] = Q.oracles["e01_block_exact_title"], Q.oracles["e02_block_identity_key"]


def _title_evidence(v, chapters=None):
    """Evidence on identities of one title, by profile: (pairs of profiles, members, evidence)."""
    chapters = write_table(gathered(v("chapter")), "chapters") if chapters is None else chapters
    pairs, members = B.class_pairs(B.title_classes(v("identity")), B.evidence_profiles(v("identity"), chapters, v("external_id"), v("signature")))
    return pairs, members, E.duplicate_evidence(pairs.select("a", "b").distinct(), v("identity"), chapters, v("external_id"), v("signature"))


def _all_evidence(v):
    """Evidence on identities of one title, by profile, and on decided pairs of other titles."""
    chapters = write_table(gathered(v("chapter")), "chapters")
    pairs, members, evidence = _title_evidence(v, chapters)
    decided = E.duplicate_evidence(B.pairs_apart(_pairs(v), members), v("identity"), chapters, v("external_id"), v("signature"))
    return B.expand_evidence(pairs, members, evidence).unionByName(decided)


Q.add("e07_evidence_of_classes", lambda v: B.expand_evidence(*_title_evidence(v)))
Q.oracles["e07_evidence_of_classes"] = oracle(_EVIDENCE.replace(f" UNION {_P}", ""))
# Every identity four times over: profiles are shared, and rows stay as many as the pairs of profiles.
Q.add(
    "e07_profile_pairs", lambda v: (lambda c: B.class_pairs(B.title_classes(c), B.evidence_profiles(c, v("chapter").limit(0), v("external_id").limit(0), v("signature").limit(0)))[0].groupBy("class").agg(F.count("*").alias("rows"), F.sum("n").alias("pairs")))(v("identity").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("id", C("id") * 4 + C("k")).drop("k")),
    f"WITH n AS ({_N}), c AS (SELECT source, t, 4 * min(id) AS class, count(*) AS m, count(DISTINCT (k, u)) AS p FROM n WHERE t <> '' GROUP BY ALL) SELECT class, (p * (p - 1) // 2 + p)::BIGINT AS rows, 4 * m * (4 * m - 1) // 2 AS pairs FROM c",
)
_NEAR = f"WITH n AS (SELECT i.id, source, {_TOK} AS toks, s.hash FROM {{identity}} i JOIN {{signature}} s ON s.id = i.id) SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.source = y.source AND x.id < y.id AND len(list_intersect(x.toks, y.toks)) >= 2 AND bit_count(xor(x.hash, y.hash)) <= "
Q.add("e03_near_token_pairs", lambda v: B.near_token_pairs(v("identity"), v("signature"), 8, bits=24), _NEAR + "8")
Q.add("e03_wider_token_pairs", lambda v: B.near_token_pairs(v("identity"), v("signature"), 11, 4, bits=24), _NEAR + "11")
# A third of all hashes under one title: near ones are found without all pairs of it.
Q.add("j08_near_hashes", lambda v: B.near_pairs(v("signature").withColumn("t", F.when(C("id") % 3 == 0, "hot").otherwise((C("id") % 50).cast("string"))), ["t"], 3, bits=24).select("a", "b", "distance"), "WITH s AS (SELECT id, hash, CASE WHEN id % 3 = 0 THEN 'hot' ELSE (id % 50)::VARCHAR END AS t FROM {signature}) SELECT x.id AS a, y.id AS b, bit_count(xor(x.hash, y.hash)) AS distance FROM s x JOIN s y ON x.t = y.t AND x.id < y.id AND bit_count(xor(x.hash, y.hash)) <= 3")
