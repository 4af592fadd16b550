"""Pairs made tile by tile, evidence from gathered children, shared ids by kinds of series, and cover blocks without a cap."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinfold.operators import blocking as B
from kinfold.operators import incoming as N
from kinfold.operators import relational as R
from kinfold.operators import resolve as E
from kinfold.operators.sets import gathered, key_meetings, key_pairs, keys_listed, tile_counts, tiles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joined_rows(df):
    """Pairs (a, b) of a query, and the rows that its last join made for them."""
    rows = sorted(map(tuple, df.collect()))
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop(0)
        if p.nodeName() in ("AdaptiveSparkPlan", "ResultQueryStage"):
            todo.append(p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan())
            continue
        if "Join" in p.nodeName():
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return rows, found[0]


def test_both_sides_cut_the_same_pieces(spark):
    """Lists are gathered in the order in which blocks arrive, in a cluster another one for each side of a join."""
    r = random.Random(2)
    ids = r.sample(range(1000), 300)
    df = spark.createDataFrame([(i, "k") for i in ids], "id bigint, k string")
    listed = keys_listed(df, ["id"], "k")
    sides = [tiles(x, ["id"], "k", tile_counts(x, "k")) for x in (listed, listed.orderBy(F.desc("id")).coalesce(1))]
    cut = [sorted(tuple(x.ids) for x in side.collect()) for side in sides]
    assert cut[0] == cut[1] == sorted(tuple(sorted(ids)[k : k + 64]) for k in range(0, 300, 64))


@pytest.mark.parametrize("tile", [1, 7, 5000])
def test_tiles_of_a_key_hold_every_pair_once(spark, tile):
    r = random.Random(tile)
    rows = [(i, r.choice(["hot", "hot", "p", None])) for i in range(120)] + [(r.randrange(120), r.choice("pqrst")) for _ in range(150)]
    df = spark.createDataFrame(rows, "id bigint, k string")
    of = {}
    for i, k in rows:
        if k is not None:
            of.setdefault(i, set()).add(k)
    assert sorted(map(tuple, key_pairs(df, ["k"], tile).collect())) == [(a, b) for a, b in combinations(sorted(of), 2) if of[a] & of[b]]
    left, right = ([(i, "ab"[i % 3 > 0], k) for i, k in rows if i % 4 != n and k] for n in (1, 2))
    have = lambda some: {i: {k for j, _, k in some if j == i} for i, _, _ in some}
    x, y = have(left), have(right)
    want = sorted((a, b) for a in x for b in y if x[a] & y[b] and (a % 3 > 0) != (b % 3 > 0))
    shaped = lambda some: spark.createDataFrame(some, "id bigint, s string, k string")
    assert sorted(map(tuple, key_meetings(shaped(left), shaped(right), ["id", "s"], ["s"], tile).collect())) == want and want


def test_band_pairs_of_a_common_band_are_joined_in_groups(spark):
    """200 rows of one band: 19,900 pairs, which were joined one by one."""
    df = spark.range(200).selectExpr("id", "array('x', string(id)) AS bands", "concat('t', id) AS title")
    rows, joined = joined_rows(R.band_pairs(df))
    assert rows == list(combinations(range(200), 2)) and joined < 100


def test_identities_of_one_id_and_address_are_joined_in_groups(spark):
    """They met under both keys, one by one, to be dropped under the second."""
    df = spark.range(200).selectExpr("id", "'alpha' AS source", "'T' AS title", "'x-1' AS source_id", "'https://t.test/a' AS url")
    rows, joined = joined_rows(E.block_identity_key(df))
    assert rows == list(combinations(range(200), 2)) and joined < 100


def test_listings_of_a_common_alias_are_joined_in_groups(spark):
    i = spark.range(200).selectExpr("id", "IF(id % 2 = 0, 'alpha', 'beta') AS source", "IF(id < 100, 'Red Ring', concat('Other ', id)) AS title")
    incoming = i.withColumn("aliases", F.array(F.lit("red ring"), F.lit("Red  Ring")))
    aliases = spark.createDataFrame([(150, "Red Ring"), (3, "Other 4")], "identity_id bigint, alias string")
    rows, joined = joined_rows(E.block_title_or_alias(incoming, i, aliases))
    named = [*range(100), 150]
    assert rows == sorted((a, b) for a in range(200) for b in named if a % 2 != b % 2) and joined < 1000


def test_evidence_takes_children_as_arrays(spark, tmp_path):
    """Pairs were joined with one row for each child of both sides; a missing number counts as a child in common with none."""
    r = random.Random(5)
    kids = [(i, r.choice([1, 2, 3, 4, 5, 6, 7, None])) for i in range(12) for _ in range(9)]
    of = {i: {n for j, n in kids if j == i} for i in range(12)}
    spark.createDataFrame(kids, "identity_id bigint, number bigint").write.parquet(str(tmp_path / "given"))
    children = spark.read.parquet(str(tmp_path / "given"))
    i = spark.range(14).selectExpr("id", "'alpha' AS source", "'One Big Title' AS title", "'' AS source_id", "'' AS url")
    external = spark.createDataFrame([(0, "p", "1"), (1, "p", "2"), (1, "p", "1"), (2, "p", None), (3, "q", "1"), (4, "p", "1")], "identity_id bigint, provider string, value string")
    pairs = spark.createDataFrame(list(combinations(range(14), 2)), "a bigint, b bigint")
    signatures = i.select("id", F.lit(0).cast("bigint").alias("hash"))
    for given in (children, gathered(children)):
        out = E.duplicate_evidence(pairs, i, given, external, signatures)
        assert "/given" not in plan(out) and "number#" not in plan(out)
        got = {(x.a, x.b): (x.common, x.smaller, x.conflict) for x in out.collect()}
        side = lambda k: of.get(k, set())
        values = {0: {"1"}, 1: {"1", "2"}, 4: {"1"}}
        conflict = lambda a, b: any(u != v for u in values.get(a, ()) for v in values.get(b, ()))
        assert got == {(a, b): (len((side(a) & side(b)) - {None}), min(len(side(a)), len(side(b))), conflict(a, b)) for a, b in combinations(range(14), 2)}


def test_evidence_of_classes_is_joined_in_groups(spark):
    """300 identities of one profile: one row of evidence, 44,850 pairs, whose ids travel by tiles."""
    i = spark.range(300).selectExpr("id", "'alpha' AS source", "'One Title' AS title", "'' AS source_id", "'' AS url")
    none = lambda s: spark.createDataFrame([], s)
    profiles = B.evidence_profiles(i, none("identity_id bigint, number bigint"), none("identity_id bigint, provider string, value string"), none("id bigint, hash bigint"))
    assert dict(profiles.dtypes)["profile"] == "binary" and profiles.select(F.max(F.length("profile"))).first()[0] == 16  # 64 letters before
    pairs, members = B.class_pairs(B.title_classes(i), profiles)
    assert "Exchange" not in plan(pairs)  # written once: evidence and its expansion both read them
    rows, joined = joined_rows(B.expand_evidence(pairs, members, pairs.select("a", "b", F.lit(1).alias("x"))))
    assert rows == [(a, b, 1) for a, b in combinations(range(300), 2)] and joined < 100


def test_a_listing_reads_children_once(spark, tmp_path):
    i = spark.createDataFrame([(1, "alpha", "One", "a", ""), (2, "alpha", "One", "b", ""), (3, "beta", "One", "c", "")], "id bigint, source string, title string, source_id string, url string")
    incoming = spark.createDataFrame([(11, "alpha", "One", "z", ""), (12, "beta", "Two", "c", "")], i.schema)
    spark.createDataFrame([(k, n) for k in (1, 2, 11, 12) for n in range(6 if k != 1 else 5)], "identity_id bigint, number bigint").write.parquet(str(tmp_path / "given"))
    out = N.equivalent_listing(incoming, i, spark.read.parquet(str(tmp_path / "given")), spark.createDataFrame([], "identity_id bigint, provider string, value string"))
    assert "/given" not in plan(out)
    assert [tuple(x) for x in out.select("incoming", "identity", "ratio", "common").collect()] == [(11, 2, 1.0, 6)]


def test_a_shared_external_id_of_many(spark):
    """200 listings and 200 series of one external id met one by one, to find the least series that has no such source."""
    r = random.Random(3)
    own = [(i, i // 8, r.choice(["alpha", "beta", "gamma", None]), f"k{i}") for i in range(400)]
    listed = [(1000 + i, r.choice(["alpha", "beta", "gamma", "delta", None]), f"new{i}") for i in range(200)]
    i = spark.createDataFrame(own, "id bigint, series_id bigint, source string, source_id string")
    incoming = spark.createDataFrame(listed, "id bigint, source string, source_id string")
    ids = [(k, r.choice("pq"), r.choice(["1", "2"])) for k, *_ in own if k > 7 and k % 2]
    asked = [(k, p, "1") for k, *_ in listed for p in "pq"]
    ext = lambda rows, c: spark.createDataFrame(rows, f"{c} bigint, provider string, value string")
    alternates, equivalents = spark.createDataFrame([], "source string, source_id string, identity_id bigint"), spark.createDataFrame([], "incoming bigint, identity bigint")
    out = N.resolve_identity(incoming, i, alternates, equivalents, ext(ids, "identity_id"), ext(asked, "id"))
    assert "LeftAnti" not in plan(out)
    has = {(s, x) for _, s, x, _ in own if x is not None}
    series = {k: s for k, s, _, _ in own}
    want = {}
    for k, source, _ in listed:
        found = sorted((p, series[j]) for j, p, v in ids if v == "1" and (series[j], source) not in has)
        want[k] = found[0][1] if found else None
    assert {x.id: x.series_id for x in out.collect() if x.how == "external_id"} == {k: s for k, s in want.items() if s is not None} and len(set(want.values())) > 2


def test_cover_blocks_have_no_cap(spark):
    """A probe with 250 partners had the first 200; an id with two rows gives a pair once."""
    rows = [(i, "ab"[i % 2], i // 3, "Some Title", ["x", None, str(i % 9)]) for i in range(500)] + [(499, "a", 900, "Some Title", ["x"])]
    df = spark.createDataFrame(rows, "id bigint, source string, series_id bigint, title string, bands array<string>")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] in (3, 4, 499) and a[1] != b[1] and a[2] != b[2]}
    got = N.block_cover_band(df.filter("id IN (3, 4, 499)").select("id"), df, df.select("id", "bands"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 600
