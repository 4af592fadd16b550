"""Queries of feeds, exports and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinfold.functions.text import is_page_image
from kinfold.operators import feeds as N
from kinfold.operators import sets as U
from kinfold.plans.build import Queries
from kinfold.plans.fixtures import oracle, view
from kinfold.session import fresh_path
from kinfold.sources import files as S
from kinfold.sources import images as IMG
from kinfold.sources.snapshots import SnapshotTable
from kinfold.streaming import feeds as T
from kinfold.streaming import runs as R

Q = Queries()
C = F.col

Q.add("n01_series_from_feed", lambda v: N.series_from_feed(v("identity").selectExpr("id", "IF(id % 3 = 0, array('de'), array('en', 'de')) AS langs", "map('en', title) AS titles", "array(named_struct('type', 'author', 'name', source), named_struct('type', 'cover', 'name', url)) AS relations"), "en"), "SELECT id, title, source AS authors, url AS cover FROM {identity} WHERE id % 3 > 0")
Q.add("n02_chapters_from_feed", lambda v: N.chapters_from_feed(v("identity").selectExpr("id", "array(named_struct('number', concat('Ch ', id, '.50'), 'title', ' x ', 'official', id % 2 = 0, 'verified', false, 'pages', id % 1200, 'at', '1700000000')) AS children")), "SELECT id, 0 AS position, id || '.5' AS number, 'x' AS title, CASE WHEN id % 2 = 0 THEN 10000 ELSE 0 END + least(id % 1200, 999) AS quality, make_timestamp(1700000000000000) AS published_at FROM {identity}")
Q.add("n03_best_release_per_number", lambda v: N.best_release_per_number(v("release").filter("number IS NOT NULL"), ["series_id", "number"]), "WITH t AS (SELECT *, row_number() OVER (PARTITION BY series_id, number ORDER BY quality DESC, published_at DESC, id DESC) AS rn FROM {release} WHERE number IS NOT NULL) SELECT series_id, number, min(id) FILTER (rn = 1) AS id, coalesce(string_agg(id, ',' ORDER BY rn) FILTER (rn > 1), '') AS others FROM t GROUP BY ALL")
Q.add("n04_dedupe_first", lambda v: N.dedupe_first(v("conversations"), ["text"], "conv_id").select("text", "conv_id"), "SELECT text, min(conv_id) AS conv_id FROM conversations GROUP BY text")
Q.add("n05_dedupe_by_quality", lambda v: N.dedupe_by_quality(v("release"), ["series_id", "number"], "quality", "id").select("series_id", "number", "id", "quality").filter("number IS NOT NULL"), "SELECT series_id, number, min(id) AS id, max(quality) AS quality FROM {release} WHERE number IS NOT NULL GROUP BY ALL")
Q.add("n06_merge_observations", lambda v: N.merge_observations(v("release").selectExpr("series_id AS id", "id AS position", "IF(id % 3 = 0, '', concat('t', id)) AS title", "quality AS popularity", "array(CAST(id % 9 AS STRING), CAST(id % 5 AS STRING)) AS recent")).select("id", "title", "popularity", "recent"), "WITH e AS (SELECT series_id, id, unnest([id % 9, id % 5]) AS n, unnest([1, 2]) AS i FROM {release}), f AS (SELECT series_id, n, min((id, i)) AS p FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p) AS rn FROM f), l AS (SELECT series_id, string_agg(n, ',' ORDER BY rn) AS recent FROM r WHERE rn <= 6 GROUP BY 1) SELECT r.series_id AS id, coalesce('t' || min(id) FILTER (id % 3 > 0), '') AS title, max(quality) AS popularity, any_value(recent) AS recent FROM {release} r JOIN l USING (series_id) GROUP BY r.series_id")
Q.add("n07_overlay_detail", lambda v: N.overlay_detail(v("identity").select("id", "title", "source"), v("identity").filter("id % 2 = 0").selectExpr("id", "IF(id % 4 = 0, '', upper(title)) AS title", "'z' AS source")), "SELECT id, CASE WHEN id % 4 = 2 THEN upper(title) ELSE title END AS title, CASE WHEN id % 2 = 0 THEN 'z' ELSE source END AS source FROM {identity}")
Q.add("n08_extract_links", lambda v: N.extract_links(v("pages")))
# An image element, one that is no page, and addresses in a script: a whole one, an escaped one, and a path of this site.
_IMAGES = """<img src='https://i.test/p{0}.webp'><img src='/logo.png'><script>var x = ["https:\\/\\/i.test\\/s{0}.jpg", "/r/a{0}.png", "https://i.test/p{0}.webp"];</script>"""
Q.add("n09_extract_image_urls", lambda v: N.extract_image_urls(v("pages").withColumn("html", F.concat("html", F.replace(F.lit(_IMAGES), F.lit("{0}"), C("page_id").cast("string"))))).select("page_id", "url"), "SELECT page_id, unnest(['https://i.test/p' || page_id || '.webp', 'https://i.test/s' || page_id || '.jpg', regexp_extract(url, '^(https?://[^/]+)', 1) || '/r/a' || page_id || '.png']) AS url FROM pages")


def _by_sql(v, pages, text):
    """SQL over pages with the table functions."""
    spark = v("region").sparkSession
    N.register_page_functions(spark)
    return spark.sql(text, pages=pages)


Q.add("d05_html_links", lambda v: _by_sql(v, v("pages"), f"SELECT p.page_id, l.position, l.href, l.text FROM {{pages}} p, LATERAL html_links(p.html) l WHERE lower(l.text) NOT IN ({', '.join(map(repr, N.HELPERS))})"))
Q.add("d05_html_images", lambda v: _by_sql(v, v("pages").withColumn("html", F.concat("html", F.replace(F.lit(_IMAGES), F.lit("{0}"), C("page_id").cast("string")))), "SELECT p.page_id, i.url FROM {pages} p, LATERAL html_images(p.html, p.url) i").filter(is_page_image(C("url"))).distinct(), "SELECT page_id, unnest(['https://i.test/p' || page_id || '.webp', 'https://i.test/s' || page_id || '.jpg', regexp_extract(url, '^(https?://[^/]+)', 1) || '/r/a' || page_id || '.png']) AS url FROM pages")


def _bitmap(values):
    """A bitmap file of 13 x 11 pixels, colours from the signs and sizes of 64 numbers."""
    at = (np.arange(11)[:, None] * 13 + np.arange(13)) % len(values)
    x = np.clip(np.round((np.asarray(values, np.float64) + 1) * 127), 0, 255).astype(np.uint8)
    rgb = np.stack([x[at], x[(at * 7 + 3) % len(values)], x[(at * 5 + 1) % len(values)]], axis=2)
    return IMG.bitmap_file(rgb)


def _covers(v):
    """Vectors as pictures: written as bitmap files, read by the JVM, hashed."""
    spark = v("region").sparkSession
    folder = fresh_path(spark, "pictures")
    rows = v("embeddings").select("vec_id", C("embedding").cast("array<double>").alias("x"))

    def write(batches):
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            for i, x in zip(pdf["vec_id"], pdf["x"]):
                with fs.open_output_stream(f"{base}/{i}.bmp") as out:
                    out.write(_bitmap(x))
            yield pdf[["vec_id"]]

    rows.mapInPandas(write, "vec_id bigint").write.parquet(fresh_path(spark, "pictures-written"))
    hashes = IMG.cover_hashes(IMG.read_images(spark, folder))
    return hashes.select(F.regexp_extract("origin", r"(\d+)\.bmp$", 1).cast("bigint").alias("vec_id"), *(C("hashes")[k].alias(f"h{k}") for k in range(len(IMG.MARGINS))))


Q.add("f25_cover_hashes", _covers)
Q.add("n10_page_flags", lambda v: N.page_flags(v("pages")))
Q.add("n11_page_count_hint", lambda v: N.page_count_hint(v("pages")))
Q.add("n12_observation_version", lambda v: v("identity").selectExpr("id", "IF(id % 2 = 0, '', '7') AS latest", "array('3', CAST(size AS STRING), 'x') AS recent").select("id", N.observation_version(C("latest"), C("recent")).alias("version")), "SELECT id, CASE WHEN id % 2 = 1 THEN '7' ELSE greatest(3, size)::VARCHAR END AS version FROM {identity}")


def _feed(spark, folder):
    """The identities as a provider's JSON documents, ten entries each, read back by the feed reader."""
    v = view(spark, folder, "identity")
    entry = F.expr("struct(CAST(id AS STRING) AS id, struct(map('en', title) AS title, CAST(size AS STRING) AS chapter, size AS pages, array('en') AS translatedLanguage) AS attributes, array(struct('author' AS type, source AS id, source AS name)) AS relationships, 'x' AS junk)")
    path = fresh_path(spark, "feed")
    v.groupBy(F.floor(C("id") / 10).alias("page")).agg(F.collect_list(entry).alias("data")).select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    return S.read_json_feed(spark, path, lines=True).selectExpr("CAST(id AS BIGINT) AS id", "attributes.title['en'] AS title", "attributes.pages AS pages", "relationships[0].name AS author")


Q.queries["s02_json_feed"] = _feed
Q.oracles["s02_json_feed"] = oracle("SELECT id, title, size AS pages, source AS author FROM {identity}")
Q.add("s02_job_payload", lambda v: v("job").select("id", F.from_json("payload", "k bigint").alias("x")).select("id", "x.k"), "SELECT id, json_extract(payload, '$.k')::BIGINT AS k FROM {job}")
Q.add("s04_legacy_catalog", lambda v: S.legacy_catalog(v("series"), v("release"), v("release").selectExpr("id AS child_id", "id AS release_id", "id % 4 < 3 AS active"), v("release").selectExpr("id", "id % 150 AS identity_id"), v("identity")), "WITH r AS (SELECT DISTINCT series_id, id % 150 AS identity_id FROM {release} WHERE id % 4 < 3) SELECT s.id, s.title, s.status, string_agg(DISTINCT source || ':' || source_id, ',' ORDER BY source || ':' || source_id) AS identities FROM {series} s JOIN r ON r.series_id = s.id JOIN {identity} i ON i.id = identity_id GROUP BY ALL")


def _manifest(spark, folder):
    """Lists of customers by nation, written as one file each; half of the hashes are known, and only the others are read."""
    path = fresh_path(spark, "manifest")
    names = spark.read.parquet(f"{folder}/customer.parquet").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ";").alias("value"))
    names.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    first = S.read_manifest(spark, path)
    known = first.filter("bytes % 2 = 0").withColumn("sha256", F.concat(F.lit("known-"), "sha256"))
    return S.read_manifest(spark, path, known).select("bytes", "sha256")


Q.queries["s05_manifest"] = _manifest
Q.oracles["s05_manifest"] = "WITH t AS (SELECT string_agg(c_name, ';' ORDER BY c_name) || chr(10) AS x FROM customer GROUP BY c_nationkey) SELECT length(x) AS bytes, CASE WHEN length(x) % 2 = 0 THEN 'known-' ELSE '' END || sha256(x) AS sha256 FROM t"


def _export(v):
    series, active = v("series"), v("artifact").filter("state = 'active'").select(C("series_id").alias("id")).distinct().withColumn("__held", F.lit(True))
    out = U.portable_selection(series, v("artifact"), v("identity"), v("decision")).join(series.select("id", "title", "status"), "id").join(active, "id", "left")
    out = out.withColumn("status", F.when((C("status") == "untracked") & C("__held"), "interested").otherwise(C("status")))
    own = v("identity").select(C("series_id").alias("id"), C("id").alias("identity_id"), "source", "source_id", "url")
    sources = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("source", "source_id", "url"))).alias("sources"))
    aliases = v("alias").join(own, "identity_id").groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    reading = v("reading").groupBy(C("series_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(C("release_id").alias("number"), "state"))).alias("reading"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    out = out.join(sources, "id", "left").join(aliases, "id", "left").join(reading, "id", "left")
    return out.select("id", "title", "status", none("aliases", "array<string>"), none("sources", "array<struct<source:string,source_id:string,url:string>>"), none("reading", "array<struct<number:bigint,state:string>>"))


_SERIES = """k AS (SELECT id FROM {series} WHERE status <> 'untracked' UNION SELECT series_id FROM {artifact} WHERE state = 'active' UNION SELECT series_id FROM {identity} GROUP BY series_id HAVING count(*) > 1 UNION SELECT i.series_id FROM {decision} JOIN {identity} i ON i.id IN (left_id, right_id) WHERE decision = 'rejected'),
    x AS (SELECT s.id, title, CASE WHEN status = 'untracked' AND s.id IN (SELECT series_id FROM {artifact} WHERE state = 'active') THEN 'interested' ELSE status END AS status FROM {series} s JOIN k USING (id)),
    src AS (SELECT series_id AS id, string_agg('{"source":"' || source || '","source_id":"' || source_id || '","url":"' || url || '"}', ',' ORDER BY source, source_id, url) AS j FROM {identity} GROUP BY 1), ali AS (SELECT series_id AS id, string_agg(DISTINCT '"' || alias || '"', ',' ORDER BY '"' || alias || '"') AS j FROM {alias} JOIN {identity} i ON i.id = identity_id GROUP BY 1),
    rd AS (SELECT series_id AS id, string_agg('{"number":' || release_id || ',"state":"' || state || '"}', ',' ORDER BY release_id) AS j FROM {reading} GROUP BY 1)"""
Q.add("x01_export_portable", lambda v: S.portable_json(_export(v)), "WITH " + _SERIES + """ SELECT x.id, '{"title":"' || title || '","status":"' || status || '","aliases":[' || coalesce(ali.j, '') || '],"sources":[' || coalesce(src.j, '') || '],"reading":[' || coalesce(rd.j, '') || ']}' AS document FROM x LEFT JOIN src USING (id) LEFT JOIN ali USING (id) LEFT JOIN rd USING (id)""")
Q.add("x01_export_separations", lambda v: U.portable_separations(v("decision"), v("identity"), _export(v).select("id")), "WITH " + _SERIES.split("),\n")[0] + ") SELECT l.source AS left_source, l.source_id AS left_id, r.source AS right_source, r.source_id AS right_id FROM {decision} JOIN {identity} l ON l.id = left_id JOIN {identity} r ON r.id = right_id WHERE decision = 'rejected' AND l.series_id IN (SELECT k.id FROM k JOIN {series} USING (id)) AND r.series_id IN (SELECT k.id FROM k JOIN {series} USING (id))")


def _round_trip(spark, folder):
    """The exported documents, written and read again."""
    path = fresh_path(spark, "portable")
    S.portable_document(_export(lambda x: view(spark, folder, x)), "2024-01-31T00:00:00Z").write.text(path)
    return S.load_portable(spark, path).select("version", F.size("unknown").alias("unknown"), "title", "status", F.size("sources").alias("sources"), F.size("aliases").alias("aliases"), F.size("reading").alias("reading"))


Q.queries["s08_portable_round_trip"] = _round_trip
Q.oracles["s08_portable_round_trip"] = oracle("WITH " + _SERIES.split(",\n    src AS")[0] + ", src AS (SELECT series_id AS id, count(*) AS n FROM {identity} GROUP BY 1), ali AS (SELECT series_id AS id, count(DISTINCT alias) AS n FROM {alias} JOIN {identity} i ON i.id = identity_id GROUP BY 1), rd AS (SELECT series_id AS id, count(*) AS n FROM {reading} GROUP BY 1) SELECT 1 AS version, 0 AS unknown, title, status, coalesce(src.n, 0) AS sources, coalesce(ali.n, 0) AS aliases, coalesce(rd.n, 0) AS reading FROM x LEFT JOIN src USING (id) LEFT JOIN ali USING (id) LEFT JOIN rd USING (id)")
Q.add("k01_training_jsonl", lambda v: S.training_jsonl(v("decision").filter("decision <> 'pending'").selectExpr("id AS decision_id", "left_id", "right_id", "IF(decision = 'accepted', 1, 0) AS label")), """SELECT id AS decision_id, '{"decision_id":' || id || ',"label":' || CASE WHEN decision = 'accepted' THEN 1 ELSE 0 END || ',"left_id":' || left_id || ',"right_id":' || right_id || '}' AS value FROM {decision} WHERE decision <> 'pending'""")
Q.add("k03_audit_markdown", lambda v: S.audit_markdown(U.table_counts({"series": v("series"), "release": v("release")})), "SELECT 'series' AS name, '| series | ' || count(*) || ' |' AS line FROM {series} UNION ALL SELECT 'release', '| release | ' || count(*) || ' |' FROM {release}")
Q.add("k03_audit_json", lambda v: S.audit_json(U.table_counts({"series": v("series"), "release": v("release")})), """SELECT chr(123) || '"ok":' || (a = 0 AND b = 0)::VARCHAR || ',"checks":' || chr(123) || '"release":' || a || ',"series":' || b || chr(125) || chr(125) AS document FROM (SELECT (SELECT count(*) FROM {release}) AS a, (SELECT count(*) FROM {series}) AS b)""")
Q.add("k04_action_report", lambda v: S.action_report(v("decision"), "decision"), "SELECT decision, count(*) AS n FROM {decision} GROUP BY 1")
Q.add("k05_prometheus_lines", lambda v: S.prometheus_lines(v("job").groupBy("kind", "status").agg(F.count("*").alias("n")), "jobs", ["kind", "status"], "n"), """SELECT 'jobs{kind="' || kind || '",status="' || status || '"} ' || count(*) AS line FROM {job} GROUP BY kind, status""")


def _samples(spark, folder):
    e = T.stream_table(spark, folder, "events")
    return e.select(C("event_id").alias("id"), F.concat(F.lit("s"), (C("user_id") % 4).cast("string")).alias("source"), C("ts").alias("at"), F.floor("value").alias("latency"), (C("event_type") == "error").alias("failed"), C("event_type").alias("kind"))


Q.queries["t01_status_counts"] = lambda spark, folder: T.run(T.status_counts(_samples(spark, folder), "kind"), "complete", "status-counts")
Q.oracles["t01_status_counts"] = "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1"
Q.queries["t03_latency_windows"] = lambda spark, folder: T.run(T.latency_windows(_samples(spark, folder)), "complete", "latency")
Q.oracles["t03_latency_windows"] = oracle("SELECT date_trunc('hour', ts) AS hour, 's' || (user_id % 4) AS source, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, round(avg(floor(value)), 6) AS mean FROM events GROUP BY 1, 2")
def _enriched(spark, folder):
    jobs = spark.read.parquet(f"{folder}/customer.parquet").select(C("c_custkey").alias("job_id"), C("c_name").alias("job"))
    events = _samples(spark, folder).select("id", "kind", (C("id") % 2000).alias("job_id"))
    return T.run(T.enriched(events, jobs), "append", "enriched").select("id", "kind", "job")


Q.queries["t01_enriched_events"] = _enriched
Q.oracles["t01_enriched_events"] = "SELECT event_id AS id, event_type AS kind, c_name AS job FROM events LEFT JOIN customer ON c_custkey = event_id % 2000"


def _events(spark, folder):
    """The event log as a table."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    return e.select(C("event_id").alias("id"), C("user_id").alias("user"), F.concat(F.lit("s"), (C("user_id") % 4).cast("string")).alias("source"), C("ts").cast("timestamp").alias("at"), (C("event_type") == "error").alias("failed"), C("event_type").alias("kind"))


#: The log arrives in three parts, each a run of its own that goes on where the one before stopped.
_PARTS = ("at < TIMESTAMP '2024-01-08'", "at >= TIMESTAMP '2024-01-08' AND at < TIMESTAMP '2024-01-21'", "at >= TIMESTAMP '2024-01-21' OR at IS NULL")


def _in_runs(rows, step, parts=_PARTS):
    spark = rows.sparkSession
    folder, out = fresh_path(spark, "parts"), None
    for p in parts:
        rows.filter(p).write.mode("append").parquet(folder)
        out = step(spark.readStream.schema(rows.schema).parquet(folder))
    return out


def _state(spark, schema, keys, **more):
    return SnapshotTable(spark, fresh_path(spark, "state"), schema, keys, **more), fresh_path(spark, "stream")


def _resumed(spark, folder):
    home, rows = fresh_path(spark, "stream"), _events(spark, folder).select("id", "kind", "at", (C("id") % 2000).alias("job_id"))
    jobs = spark.read.parquet(f"{folder}/customer.parquet").select(C("c_custkey").alias("job_id"), C("c_name").alias("job"))
    return _in_runs(rows, lambda stream: T.follow_events(stream, rows, jobs, home, after=3, last="10")).select("id", "kind", "job")


Q.queries["t01_resumed_events"] = _resumed
Q.oracles["t01_resumed_events"] = "SELECT event_id AS id, event_type AS kind, c_name AS job FROM events LEFT JOIN customer ON c_custkey = event_id % 2000 WHERE event_id > 10"


def _breaker(spark, folder):
    table, home = _state(spark, T.BREAKER, ["source"])
    return _in_runs(_events(spark, folder).select("id", "source", "at", "failed"), lambda stream: T.circuit_breaker(stream, table, home)).read()


def _polls(spark, folder):
    table, home = _state(spark, T.CADENCE, ["source"])
    outcome = F.when(C("kind") == "error", "failure").when(C("kind") == "purchase", "change").otherwise("none")
    return _in_runs(_events(spark, folder).select("id", "source", "at", outcome.alias("outcome")), lambda stream: T.poll_cadence(stream, table, home)).read()


Q.queries["t04_circuit_breaker"] = _breaker
Q.queries["t05_poll_cadence"] = _polls

_SLICES = [f"id % 4 = {k}" for k in range(4)]


def _listed(spark, folder):
    """Listings in four parts; users 3, 10, 17, ... are alternates of users 0, 7, 14, ... unless known themselves."""
    table, home = _state(spark, "id bigint, version bigint, detailed_at timestamp", ["id"], compact_every=2)
    rows = _events(spark, folder)
    known = rows.filter("user % 5 = 0").select(C("user").alias("id"), F.lit(100).cast("bigint").alias("version"), F.expr("IF(user % 2 = 0, TIMESTAMP '2024-01-10 00:00:00', NULL)").alias("detailed_at")).distinct()
    table.commit(known, -1)
    alternates = rows.filter("user % 7 = 3").select(C("user").alias("id"), (C("user") - 3).alias("primary")).distinct()
    changes = _in_runs(rows, lambda stream: T.listing_changes(stream.select(C("user").alias("id"), (C("id") % 1000).alias("version"), "at"), table, home, alternates), _SLICES)
    return table.read(), changes


_LISTED = "e AS (SELECT event_id % 4 AS k, user_id AS u, event_id % 1000 AS version, ts AS when_at FROM events), s0 AS (SELECT DISTINCT user_id AS id, 100::BIGINT AS version, CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' END AS detailed_at FROM events WHERE user_id % 5 = 0)" + "".join(
    f""", m{k} AS (SELECT CASE WHEN s.id IS NULL AND u % 7 = 3 THEN u - 3 ELSE u END AS id, e.version, when_at FROM e LEFT JOIN s{k} s ON s.id = u WHERE k = {k}),
    l{k} AS (SELECT * FROM m{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, when_at DESC) = 1),
    c{k} AS (SELECT * FROM (SELECT l.id, greatest(l.version, s.version) AS version, when_at, CASE WHEN s.id IS NULL THEN 'new' WHEN l.version > s.version THEN 'advanced' WHEN detailed_at IS NULL OR detailed_at < when_at - INTERVAL 7 DAY THEN 'stale' END AS reason FROM l{k} l LEFT JOIN s{k} s USING (id)) WHERE reason IS NOT NULL),
    s{k + 1} AS (SELECT * FROM s{k} WHERE id NOT IN (SELECT id FROM c{k}) UNION ALL SELECT id, version, when_at FROM c{k})"""
    for k in range(4)
)
Q.queries["t02_listing_changes"] = lambda spark, folder: _listed(spark, folder)[0]
Q.oracles["t02_listing_changes"] = f"WITH {_LISTED} FROM s4"
Q.queries["t02_change_rows"] = lambda spark, folder: _listed(spark, folder)[1].select("id", "version", "at", "reason")
Q.oracles["t02_change_rows"] = f"WITH {_LISTED} " + " UNION ALL ".join(f'SELECT id, version, when_at AS "at", reason FROM c{k}' for k in range(4))


def _active(spark, folder):
    """Three events of each piece of work: it waits, runs, and ends or tries again."""
    table, home = _state(spark, "kind string, dedupe_key string, id bigint, seq bigint", ["kind", "dedupe_key"])
    rows = _events(spark, folder).selectExpr("at", "CAST(id DIV 3 % 4 AS STRING) AS kind", "CAST(id DIV 3 % 211 AS STRING) AS dedupe_key", "id DIV 3 AS id", "id AS seq", "CASE WHEN id % 3 = 0 THEN 'queued' WHEN id % 3 = 1 THEN 'leased' WHEN id DIV 3 % 6 = 0 THEN 'retrying' ELSE 'succeeded' END AS status")
    _in_runs(rows, lambda stream: T.dedupe_active(stream, table, home))
    return table.read()


Q.queries["t09_dedupe_active"] = _active
Q.oracles["t09_dedupe_active"] = """WITH e AS (SELECT (event_id // 3 % 4)::VARCHAR AS kind, (event_id // 3 % 211)::VARCHAR AS dedupe_key, event_id // 3 AS id, event_id AS seq, event_id % 3 < 2 OR event_id // 3 % 6 = 0 AS active FROM events),
    a AS (SELECT kind, dedupe_key, arg_max(id, seq) AS id, max(seq) AS seq FROM e WHERE active GROUP BY ALL) SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE NOT active AND e.id = a.id AND e.seq > a.seq)"""


def _runs(spark, folder):
    """Requests five a second, with limit signals now and then."""
    home, e = fresh_path(spark, "runs"), _events(spark, folder)
    rows = e.select("source", "id", F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + C("id") * 200_000).alias("at"), "failed", (C("failed") & (C("user") % 25 == 0)).alias("limited"), (C("user") % 900).alias("retry_after"))
    n = rows.count()
    return _in_runs(rows, lambda stream: R.closed_runs(stream, home), (f"id < {n // 3}", f"id >= {n // 3} AND id < {n // 2}", f"id >= {n // 2}"))


def _probes(spark, folder):
    home = fresh_path(spark, "probes")
    rows = _events(spark, folder).select("source", "id", "at", (C("id") % 7 < 3).alias("ok"))
    return _in_runs(rows, lambda stream: R.probe_steps(stream, home))


Q.queries["t06_probe_stream"] = lambda spark, folder: _probes(spark, folder).drop("batch")
Q.oracles["t06_probe_stream"] = """WITH a AS (SELECT 's' || (user_id % 4) AS source, event_id AS id, ts AS t, event_id % 7 < 3 AS ok FROM events), r AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY source ORDER BY id) AS run FROM a),
    b AS (SELECT *, ok AND count(*) FILTER (ok) OVER (PARTITION BY source, run ORDER BY id) % 2 = 0 AS back FROM r), c AS (SELECT *, coalesce(count(*) FILTER (back) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM b),
    d AS (SELECT *, least(count(*) FILTER (NOT ok) OVER (PARTITION BY source, epoch ORDER BY id), 6) AS step, min(epoch_us(t)) FILTER (NOT ok) OVER (PARTITION BY source, epoch ORDER BY id) AS started FROM c)
    SELECT source, id, CASE WHEN back THEN 0 WHEN ok THEN 30 ELSE 60 * [1, 2, 5, 10, 20, 40, 60][step + 1] END::BIGINT AS wait, CASE WHEN back AND started IS NOT NULL THEN greatest(60, least(21600, floor(floor((epoch_us(t) - started) / 1000000) * 1.2))) END::BIGINT AS cooldown FROM d"""
Q.queries["t07_closed_runs"] = lambda spark, folder: _runs(spark, folder).drop("batch")


def _versions(spark, folder):
    """The latest release of a series by slices of releases, as versions; slice 1 comes twice, and some series go at the end."""
    table = SnapshotTable(spark, fresh_path(spark, "versions"), "series_id bigint, release_id bigint", ["series_id"], compact_every=2)
    rows = view(spark, folder, "release")
    for k in (0, 1, 1, 2, 3):
        gone = rows.filter("series_id % 17 = 0").select("series_id").distinct() if k == 3 else None
        table.commit(rows.filter((C("id") % 4 == k) & ~((C("series_id") % 17 == 0) & F.lit(k == 3))).groupBy("series_id").agg(F.max("id").alias("release_id")), k, gone)
    return table.read()


Q.queries["k06_versions"] = _versions
Q.oracles["k06_versions"] = oracle("WITH t AS (SELECT series_id, id % 4 AS k, max(id) AS id FROM {release} WHERE series_id % 17 <> 0 GROUP BY ALL) SELECT series_id, arg_max(id, k) AS release_id FROM t GROUP BY 1")
