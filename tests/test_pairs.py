"""Pairs of keys: each once, and without a shuffle of the pairs themselves."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinfold.operators import blocking as B
from kinfold.operators import relational as R
from kinfold.operators import resolve as E
from kinfold.operators.sets import key_pairs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [["k"], ["s", "k"]])
def test_pairs_of_several_keys_come_once(spark, keys):
    r = random.Random(len(keys))
    rows = [(r.randrange(40), r.choice("ab"), r.choice([None, "p", "q", "r", "t"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "id bigint, s string, k string")
    of = {}
    for i, s, k in rows:
        if k is not None:
            of.setdefault(i, set()).add((s, k) if len(keys) > 1 else k)
    want = [(a, b) for a, b in combinations(sorted(of), 2) if of[a] & of[b]]
    assert sorted(map(tuple, key_pairs(df, keys).collect())) == want and want


IDENTITIES = [(5, "alpha", "One", "x-1", ""), (6, "alpha", "Two", "x-1", ""), (7, "alpha", "Two", "y-1", "https://t.test/a"), (5, "alpha", "One", "x-1", "https://t.test/a"), (8, "beta", "Two", "x-1", "")]


def identities(spark):
    rows = [x for x in IDENTITIES if x[:1] != (5,) or x[4]]
    return spark.createDataFrame(rows, "id bigint, source string, title string, source_id string, url string")


def test_classes_of_one_least_id_stay_apart(spark):
    """5 shares its id with 6 and its address with 7; 6 and 7 share neither."""
    assert sorted(map(tuple, B.expand(B.key_classes(identities(spark))).collect())) == [(5, 6), (5, 7)]


def exchanges_of_pairs(df):
    """Lines of a plan's exchanges by the ids of a pair."""
    return [x for x in plan(df).splitlines() if "Exchange hashpartitioning(a#" in x or "Exchange hashpartitioning(incoming#" in x and "id#" in x.split("]")[0].split("(")[1].split(")")[0]]


def test_no_query_deals_its_pairs(spark):
    i = identities(spark)
    aliases = spark.createDataFrame([(5, "Two")], "identity_id bigint, alias string")
    incoming = i.select("id", "source", "title", F.array(F.lit("Two")).alias("aliases"))
    bands = i.select("id", F.array("source_id", "url").alias("bands"), "title")
    classes = B.title_classes(i)
    evidence = spark.createDataFrame([], "a bigint, b bigint, same boolean")
    profiles = i.select("id", F.col("url").alias("profile"))
    pairs, members = B.class_pairs(classes, profiles)
    found = [E.block_exact_title(i), E.block_identity_key(i), B.expand(classes), B.expand(B.key_classes(i)), E.block_title_or_alias(incoming, i, aliases), R.band_pairs(bands)]
    for df in found:
        assert not exchanges_of_pairs(df)
    out = plan(B.expand_evidence(pairs, members, evidence))
    assert "Exchange hashpartitioning(a#" not in out.split("Generate")[0]
    assert sorted(map(tuple, found[0].collect())) == [(6, 7)] and sorted(map(tuple, found[1].collect())) == [(5, 6), (5, 7)]
    assert sorted(map(tuple, found[4].collect())) == [(5, 8), (6, 8), (7, 8), (8, 5), (8, 6), (8, 7)]


def test_members_are_not_broadcast(spark, tmp_path):
    """A small file may hold many members: no join of classes and profiles rests on an estimate of its size."""
    spark.range(1000).selectExpr("id", "'alpha' AS source", "'One' AS title", "IF(id % 2 = 0, 'even', 'odd') AS source_id", "'' AS url").write.parquet(str(tmp_path / "i"))
    i = spark.read.parquet(str(tmp_path / "i"))
    none = lambda s: spark.createDataFrame([], s)
    profiles = B.evidence_profiles(i, none("identity_id bigint, number bigint"), none("identity_id bigint, provider string, value string"), none("id bigint, hash bigint"))
    pairs, members = B.class_pairs(B.title_classes(i), profiles)
    assert "Broadcast" not in plan(pairs) and "Broadcast" not in plan(B.title_classes(i)) and "Broadcast" not in plan(members.join(profiles.hint("merge"), "id"))
    assert "Broadcast" not in plan(key_pairs(i, ["source", "title"]))
    assert sorted(r.n for r in pairs.collect()) == [124_750, 124_750, 250_000]


def test_evidence_of_titles_is_gathered_by_profile(spark, tmp_path, monkeypatch):
    """120 identities of one title and few profiles: evidence is looked up for pairs of profiles and decided pairs of other
    titles, not for all 7,140 pairs of the title, and is the SQL's."""
    import duckdb

    from kinfold.plans import registry

    con = duckdb.connect()
    con.sql("CREATE TABLE part AS SELECT 100 * r AS p_partkey, 'red ring' AS p_name, 'TIN' AS p_type, 'Brand#1' AS p_brand, 1::DOUBLE AS p_retailprice, 1 AS p_size FROM range(120) t(r)")
    con.sql("CREATE TABLE lineitem AS SELECT p_partkey AS l_partkey, s AS l_suppkey FROM part, range(6) t(s) WHERE s < 5 OR p_partkey % 200 = 0")
    con.sql("CREATE TABLE embeddings AS SELECT 100::BIGINT AS vec_id, [1::FLOAT FOR x IN range(24)] AS embedding, 1 AS label")
    for t in ("part", "lineitem", "embeddings"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    asked = []
    look = E.duplicate_evidence
    monkeypatch.setattr(E, "duplicate_evidence", lambda pairs, *rest: asked.append(pairs.count()) or look(pairs, *rest))
    df = registry.QUERIES["e07_duplicate_evidence"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES['e07_duplicate_evidence']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) >= 7140
    assert sum(asked) < 100


@pytest.mark.parametrize("name", ["x03_import_statuses", "x03_import_reading", "x03_import_separations", "x02_import_conflicts"])
def test_an_import_sends_no_table_through_the_driver(spark, name):
    from kinfold.plans import registry

    assert "Broadcast" not in plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_cover_bands_deal_lists_not_pairs(spark):
    """A probe takes a list of each of its keys; pairs were dealt twice, once by both ids."""
    from kinfold.operators import incoming as N

    rows = spark.createDataFrame([(i, "ab"[i % 2], i // 3, "T", ["x"]) for i in range(40)], "id bigint, source string, series_id bigint, title string, bands array<string>")
    df = N.block_cover_band(rows.select("id"), rows, rows, 5)
    want = [(a, b) for a in range(40) for b in [b for b in range(40) if a % 2 != b % 2 and a // 3 != b // 3][:5]]
    assert sorted(map(tuple, df.collect())) == want
    assert not [x for x in plan(df).splitlines() if "hashpartitioning(a#" in x and "b#" in x.split("200")[0]]
