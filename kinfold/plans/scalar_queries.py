"""A query for each scalar function."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.plans.build import Queries

Q = Queries()
C = F.col
_STOP = "|".join(T.TITLE_STOP_WORDS)


def _norm(c: str) -> str:
    """normalize_title of ASCII text, in DuckDB."""
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '\\b({_STOP})\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _number(c: str) -> str:
    raw = f"regexp_extract({c}, '(\\d+(?:\\.\\d+)?)', 1)"
    return f"CASE WHEN {raw} = '' THEN trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')) WHEN contains({raw}, '.') THEN rtrim(rtrim(regexp_replace({raw}, '^0+(\\d)', '\\1'), '0'), '.') ELSE regexp_replace({raw}, '^0+(\\d)', '\\1') END"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


_TITLED = "CASE id % 4 WHEN 0 THEN 'The ' || title || ' (Official) Manhwa!' WHEN 1 THEN title || ' [Season ' || CAST(id % 3 AS STRING) || ']' ELSE upper(title) END AS title"
_NUMBERS = "CASE id % 5 WHEN 0 THEN 'Chapter ' || CAST(id AS STRING) || '.50: Side' WHEN 1 THEN 'Ch. 00' || CAST(id AS STRING) WHEN 2 THEN CAST(id AS STRING) || '.0' WHEN 3 THEN '  Special   EDITION ' ELSE '0.0' END AS text"
_DATES = "CASE id % 7 WHEN 0 THEN 'just now' WHEN 1 THEN 'Yesterday' WHEN 2 THEN 'Mar ' || CAST(id % 28 + 1 AS STRING) || ', 2023' WHEN 3 THEN 'on 2023-05-0' || CAST(id % 9 + 1 AS STRING) WHEN 4 THEN CAST(id % 12 + 1 AS STRING) || '/' || CAST(id % 28 + 1 AS STRING) || '/2022' WHEN 5 THEN 'June 5 2021' ELSE 'soon' END AS text"

Q.add("f01_normalize_title_unicode", lambda v: v("documents").select("doc_id", F.sha2(T.normalize_title(C("text")), 256).alias("result")))
Q.scalar("f01_normalize_title", "identity", _TITLED, lambda: T.normalize_title(C("title")), _norm("title"))
Q.scalar("f02_canonical_number", "identity", _NUMBERS, lambda: T.canonical_number(C("text")), _number("text"))
Q.scalar("f03_sort_number", "identity", _NUMBERS, lambda: T.sort_number(C("text")).cast("double"), f"TRY_CAST(TRY_CAST({_number('text')} AS DECIMAL(20,6)) AS DOUBLE)")
Q.add(
    "f04_number_key",
    lambda v: v("identity").selectExpr("id", "source", "CASE WHEN id % 3 = 0 THEN CAST(id % 50 AS STRING) || '.5' WHEN id % 3 = 1 THEN 'extra ' || CAST(id % 7 AS STRING) ELSE CAST(id % 90 AS STRING) END AS n").groupBy("source").agg(F.max_by("n", T.number_key(C("n"))).alias("latest"), F.min_by("n", T.number_key(C("n"))).alias("first")),
    """WITH t AS (SELECT source, CASE WHEN id % 3 = 0 THEN (id % 50)::VARCHAR || '.5' WHEN id % 3 = 1 THEN 'extra ' || (id % 7)::VARCHAR ELSE (id % 90)::VARCHAR END AS n FROM {identity}),
       k AS (SELECT *, TRY_CAST(n AS DOUBLE) IS NOT NULL AS num, coalesce(TRY_CAST(n AS DOUBLE), 0) AS val FROM t)
       SELECT source, arg_max(n, (num, val, n)) AS latest, arg_min(n, (num, val, n)) AS first FROM k GROUP BY source""",
)
Q.scalar("f05_normalize_source_id", "identity", "upper(source_id) || '%20x_' || CASE WHEN id % 2 = 0 THEN '-0a1b2c3d' ELSE '/' END AS x", lambda: T.normalize_source_id(C("x")), "regexp_replace(trim(regexp_replace(lower(replace(x, '%20', ' ')), '[^a-z0-9]+', '-', 'g'), '-'), '-[0-9a-f]{8}$', '')")
Q.scalar("f06_canonical_url", "identity", "url", lambda: T.canonical_url(C("url")), "regexp_replace(rtrim(lower(regexp_extract(url, '^https?://([^?#]*)', 1)), '/'), '^www\\.', '')")
Q.scalar("f06_canonical_page_url", "pages", "url", lambda: T.canonical_url(C("url")), "regexp_replace(rtrim(lower(regexp_extract(url, '^https?://([^?#]*)', 1)), '/'), '^www\\.', '')", key="page_id")
_REV = "'/comics/' || source_id || CASE WHEN id % 2 = 0 THEN '-0A1b2C3d/' ELSE '' END AS x"
Q.scalar("f07_split_revision_id", "identity", _REV, lambda: F.concat_ws("|", T.split_revision_id(C("x"))["stable"], T.split_revision_id(C("x"))["revision"]), "regexp_replace(trim(x, '/'), '-([0-9a-fA-F]{8})$', '') || '|' || lower(regexp_extract(trim(x, '/'), '-([0-9a-fA-F]{8})$', 1))")
Q.scalar("f08_legacy_identity", "identity", "CASE WHEN id % 3 = 0 THEN NULL ELSE upper(source_id) || '/' END AS sid, url", lambda: T.legacy_identity(C("sid"), C("url")), "coalesce(nullif(rtrim(lower(trim(coalesce(sid, ''))), '/'), ''), rtrim(split_part(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '?', 1), '/'))")
Q.scalar("f09_url_number", "identity", "CASE id % 3 WHEN 0 THEN 'https://x.test/chapter-' || CAST(id AS STRING) || '-5' ELSE 'https://x.test/p' END AS u, CASE WHEN id % 3 = 1 THEN 'Chapter ' || CAST(id AS STRING) || '.50' ELSE 'Prologue' END AS t", lambda: T.url_number(C("u"), C("t")), "CASE WHEN regexp_extract(u, 'chapter-(\\d+)', 1) <> '' THEN regexp_extract(u, 'chapter-(\\d+)', 1) || '.' || regexp_extract(u, 'chapter-\\d+-(\\d+)', 1) WHEN t LIKE 'Chapter%' THEN rtrim(rtrim(regexp_extract(t, 'Chapter ([\\d.]+)', 1), '0'), '.') END")
Q.scalar("f10_parse_source_date", "identity", _DATES, lambda: T.parse_source_date(C("text"), F.lit("2024-01-31").cast("timestamp")), "CASE id % 7 WHEN 0 THEN TIMESTAMP '2024-01-31' WHEN 1 THEN TIMESTAMP '2024-01-30' WHEN 2 THEN strptime(text, '%b %d, %Y') WHEN 3 THEN strptime(text[4:], '%Y-%m-%d') WHEN 4 THEN strptime(text, '%m/%d/%Y') WHEN 5 THEN TIMESTAMP '2021-06-05' END")
Q.scalar("f11_parse_iso_or_epoch", "job", "CASE id % 3 WHEN 0 THEN CAST(1700000000 + id AS STRING) WHEN 1 THEN '2024-01-02T03:04:05Z' ELSE 'x' END AS text", lambda: T.parse_iso_or_epoch(C("text")), "CASE id % 3 WHEN 0 THEN make_timestamp((1700000000 + id) * 1000000) WHEN 1 THEN TIMESTAMP '2024-01-02 03:04:05' END")
Q.scalar("f12_clean_item_title", "release", "'Latest: Part ' || CAST(id % 9 AS STRING) || CASE WHEN id % 2 = 0 THEN ' · 2 days ago' ELSE ' May 3, 2021' END AS t, published_at, CAST(id AS STRING) AS n", lambda: T.clean_item_title(C("n"), C("t"), C("published_at")), "'Part ' || (id % 9)::VARCHAR")
Q.scalar("f13_clean_series_title", "identity", "CASE id % 3 WHEN 0 THEN '12 ' || upper(title) || ' Chapter 12 new' WHEN 1 THEN title || '  3 hours ago x' ELSE title END AS t", lambda: T.clean_series_title(C("t")), "CASE id % 3 WHEN 0 THEN regexp_replace(regexp_replace(t, ' Chapter.*', ''), '^12 ', '') WHEN 1 THEN regexp_replace(t, '  3 hours.*', '') ELSE t END")
Q.scalar("f14_clean_aliases", "identity", "title, array(' ' || upper(title), title || ' /', 'Other;', 'OTHER', '', source) AS a => title, source, [' ' || upper(title), title || ' /', 'Other;', 'OTHER', '', source] AS a", lambda: F.array_join(T.clean_aliases(C("a"), C("title")), "|"), "'Other|' || source")
Q.scalar("f15_is_page_image", "identity", "'https://i.test/' || CASE id % 4 WHEN 0 THEN 'Logo' WHEN 1 THEN 'p' ELSE 'x' END || CAST(id AS STRING) || CASE id % 3 WHEN 0 THEN '.JPG?w=1' WHEN 1 THEN '.txt' ELSE '.webp' END AS u", lambda: T.is_page_image(C("u")), "id % 3 <> 1 AND id % 4 <> 0")
Q.scalar("f16_localized", "identity", "CASE id % 3 WHEN 0 THEN map('de', title, 'en', 'x') WHEN 1 THEN map('en', title || ' ') ELSE map('fr', title) END AS m => title", lambda: T.localized(C("m"), "de"), "title")
Q.scalar("f17_localized_values", "identity", "array(map('en', title, 'de', ' b '), NULL, map('fr', title, 'es', '')) AS m => title", lambda: F.array_join(T.localized_values(C("m")), "|"), "title || '|b'")
Q.scalar("f18_relationship", "identity", "array(named_struct('type', 'author', 'name', title), named_struct('type', 'cover', 'name', source), named_struct('type', 'author', 'name', '')) AS r => title, source", lambda: F.concat_ws("|", T.relationship(C("r"), "cover")["name"], F.array_join(T.relationship_names(C("r"), "author"), ",")), "source || '|' || title")
Q.scalar("f19_quality_rank", "identity", "id % 2 = 0 AS o, id % 3 = 0 AS w, CAST(id * 7 % 1500 - 5 AS INT) AS p", lambda: T.quality_rank(C("o"), C("w"), C("p")), "o::INT * 10000 + w::INT * 1000 + least(greatest(p, 0), 999)")
Q.scalar("f20_compact_map", "identity", "map('a', title, 'b', '', 'c', CASE WHEN id % 2 = 0 THEN source END) AS m => source", lambda: F.array_join(F.array_sort(F.map_keys(T.compact_map(C("m")))), ","), "CASE WHEN id % 2 = 0 THEN 'a,c' ELSE 'a' END")
Q.scalar("f21_first_present", "job", "parse_json(CASE WHEN id % 2 = 0 THEN payload ELSE '{\"key\": 7}' END) AS p => payload", lambda: T.first_present(C("p"), ["k", "key"], "bigint"), "CASE WHEN id % 2 = 0 THEN json_extract(payload, '$.k')::BIGINT ELSE 7 END")
Q.scalar("f22_redact_text", "job", "message || ' https://u.test/a?b=' || payload AS m", lambda: T.redact_text(C("m")), "CASE WHEN message <> '' THEN 'error ''522'' token=[redacted]' ELSE '' END || ' https://u.test/a?[redacted]\"k\": ' || json_extract(payload, '$.k')::VARCHAR || '}'".replace("message", "regexp_replace(m, ' https.*', '')").replace("payload", "regexp_extract(m, '\\{.*')"))
Q.add("f22_redact_documents", lambda v: v("documents").select("doc_id", F.sha2(T.redact_text(C("text"), 1 << 30), 256).alias("result")))
Q.scalar("f23_hamming64", "identity", "id AS a, id * 2654435761 AS b", lambda: T.hamming64(C("a"), C("b")), "bit_count(xor(a, b))")
Q.scalar("f24_hash_bands", "identity", "sha2(CAST(id AS STRING), 256) AS h => sha256(CAST(id AS STRING)) AS h", lambda: F.array_join(T.hash_bands(C("h")), "-"), "h[1:4] || '-' || h[5:8] || '-' || h[9:12] || '-' || h[13:16]")
Q.add("f25_dhash", lambda v: v("embeddings").select("vec_id", F.lpad(F.bin(T.dhash(F.concat("embedding", F.slice("embedding", 1, 8)))), 64, "0").alias("bits")), "SELECT vec_id, list_reduce(list_transform(range(64), lambda k: CASE WHEN p[k // 8 * 9 + k % 8 + 1] > p[k // 8 * 9 + k % 8 + 2] THEN '1' ELSE '0' END), lambda a, b: a || b) AS bits FROM (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS p FROM embeddings)")
Q.scalar("f26_title_tokens", "identity", _TITLED, lambda: F.array_join(F.array_sort(T.title_tokens(C("title"))), " "), f"array_to_string(list_sort(list_distinct(list_filter(string_split({_norm('title')}, ' '), lambda t: len(t) > 1 AND t NOT IN ('an', 'and', 'of', 'the', 'to')))), ' ')")
_NEXT = "title, source || ' ' || upper(title) || CASE WHEN id % 3 = 0 THEN ' of Old' ELSE '' END AS other"
Q.scalar("f27_title_similarity", "identity", _NEXT, lambda: T.title_similarity(C("title"), C("other")), "NULL")
Q.oracles.pop("f27_title_similarity")
Q.scalar("f28_matching_title_similarity", "identity", _NEXT, lambda: T.matching_title_similarity(C("title"), C("other")), "NULL")
Q.oracles.pop("f28_matching_title_similarity")
Q.scalar("f29_text_similarity", "benchmark", "text, reverse(text) AS other", lambda: T.text_similarity(C("text"), C("other")), "NULL", key="item_id")
Q.oracles.pop("f29_text_similarity")
Q.scalar("f30_revision_hash", "identity", "url", lambda: T.revision_hash(F.lit("v3"), C("url")), "sha1('v3:' || url)[1:12]")
_EVID = "named_struct('shared_external_id', id % 5 = 0, 'cover_state', CASE id % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'likely' WHEN 2 THEN 'different' ELSE '' END, 'cover_match', id % 4 = 0, 'cover_compared', id % 2 = 0, 'inliers', CAST(id % 3 AS INT), 'title_match', id % 6 = 0, 'latest_compared', id % 2 = 0, 'latest_match', id % 4 = 0, 'latest_delta', CAST(id % 9 AS STRING), 'external_id', id % 7 = 0, 'cover_signature_invalid', id % 8 = 3, 'title_or_alias', id % 10 = 0, 'chapter_fingerprint', id % 11 = 0, 'policy', IF(id % 12 = 0, 'manual_review_required', NULL)) AS e => source"
Q.scalar(
    "f31_human_evidence", "identity", _EVID, lambda: F.array_join(F.transform(T.human_evidence(C("e")), lambda x: x["label"]), ";"),
    """concat_ws(';', CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 'Shared external ID' END,
       CASE id % 4 WHEN 0 THEN CASE WHEN id % 3 > 0 THEN 'Visual cover match · ' || (id % 3) || ' aligned features' ELSE 'Cover match' END WHEN 1 THEN 'Covers are likely similar' WHEN 2 THEN 'Cover artwork differs' ELSE CASE WHEN id % 8 = 3 THEN 'Cover signature needs refresh' ELSE 'Cover comparison pending' END END,
       CASE WHEN id % 6 = 0 OR id % 10 = 0 THEN 'Strong title or alias match' END, CASE WHEN id % 11 = 0 THEN 'Chapter fingerprint match' END,
       CASE WHEN id % 4 = 0 THEN 'Latest chapters align · Δ' || (id % 9) WHEN id % 2 = 0 THEN 'Latest chapters differ · Δ' || (id % 9) END, CASE WHEN id % 12 = 0 THEN 'Manual review required' END)""",
)
Q.scalar("f32_error_message", "job", "CASE id % 4 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'disk_full_now' ELSE '' END AS c, CASE WHEN id % 3 = 0 THEN 'Said so' ELSE ' ' END AS m", lambda: T.error_message(C("c"), C("m")), "CASE WHEN id % 3 = 0 THEN 'Said so' WHEN id % 4 = 0 THEN 'Provider rate limit reached; waiting for the shared cooldown.' WHEN id % 4 = 1 THEN 'Disk full now' ELSE '' END")
Q.scalar("f33_failure_class", "job", "CAST(id % 600 AS INT) AS s, message AS m", lambda: F.concat_ws(",", *(T.failure_class(C("s"), C("m"))[k].cast("string") for k in ("transient", "origin", "forbidden"))), "(s IN (408, 425, 429, 500, 502, 503, 504) OR s BETWEEN 520 AND 527)::VARCHAR || ',' || (s BETWEEN 520 AND 527 OR m LIKE 'error ''52%')::VARCHAR || ',false'")
Q.scalar("f34_cursor", "job", "id AS k, CASE WHEN id % 4 > 0 THEN created_at END AS t, id % 5 = 0 AS broken", lambda: T.decode_cursor(F.concat(T.encode_cursor(C("t"), C("k")), F.when(C("broken"), "x").otherwise("")))["time"], "CASE WHEN NOT broken THEN t END")
Q.scalar("f35_count_suffix", "identity", "CASE id % 3 WHEN 0 THEN '1.2K views' WHEN 1 THEN 'Views ' || CAST(id AS STRING) ELSE '' END AS t", lambda: T.count_suffix(C("t"), "view"), "CASE id % 3 WHEN 0 THEN '1.2K' WHEN 1 THEN id::VARCHAR END")
Q.scalar("f36_strip_query_keys", "identity", "'https://c.test/' || CASE WHEN id % 2 = 0 THEN 'uploads/' ELSE 'x/' END || source || '.jpg?w=1&a=2&Resize=3&b=' || CAST(id AS STRING) AS u", lambda: T.strip_query_keys(C("u")), "CASE WHEN id % 2 = 0 THEN replace(replace(u, 'w=1&', ''), 'Resize=3&', '') ELSE u END")
Q.scalar("f37_aliases_from_text", "identity", "title, 'Read manhwa ' || title || ' / Other One / ' || source || ' Plot it is' AS d => title, source", lambda: F.array_join(T.aliases_from_text(C("d"), C("title")), "|"), "'Other One|' || source")
Q.add("d01_sequence_ratio", lambda v: v("benchmark").select("item_id", T.sequence_ratio(C("text"), F.reverse("text")).alias("ratio")))
Q.add("d02_ascii_fold", lambda v: v("documents").select("doc_id", F.sha2(T.ascii_fold(C("text")), 256).alias("folded")))
