from __future__ import annotations

import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.operators.components import connected_components
from kinfold.operators.resolve import block_exact_title, clique_groups, title_classes


def roots(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == roots(pairs)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_cliques(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6), (5, 6)], "a bigint, b bigint")
    assert {x.id: x.clique for x in clique_groups(edges).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4}


@pytest.mark.parametrize("seed", [1, 2])
def test_cliques_of_classes(spark, seed):
    """Classes of 1 to 4 members, linked as wholes: the same as the plain greedy on all pairs."""
    r = random.Random(seed)
    ids = r.sample(range(100), 40)
    sets = []
    while ids:
        sets.append(sorted(ids.pop() for _ in range(min(len(ids), r.randint(1, 4)))))
    links = [(x, y) for x in sets for y in sets if x[0] < y[0] and r.random() < 0.3]
    pairs = [(a, b) for s in sets for a in s for b in s if a < b] + [tuple(sorted((a, b))) for x, y in links for a in x for b in y]
    want = {x.id: x.clique for x in clique_groups(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    between = spark.createDataFrame([(x[0], y[0]) for x, y in links], "a bigint, b bigint")
    classes = spark.createDataFrame([(a, s[0]) for s in sets if len(s) > 1 for a in s], "id bigint, rep bigint")
    assert {x.id: x.clique for x in clique_groups(between, classes).collect()} == want


def test_title_classes(spark):
    """A third of all rows with one title make a row each, and the same groups as all their pairs."""
    rows = [(i, "s" if i % 7 else "t", "The Red Ring" if i % 3 == 0 else f"Title {i % 40}" if i % 5 else "") for i in range(240)]
    df = spark.createDataFrame(rows, "id bigint, source string, title string")
    want = {(x.id, x.clique) for x in clique_groups(block_exact_title(df)).collect()}
    assert {(x.id, x.clique) for x in clique_groups(spark.createDataFrame([], "a bigint, b bigint"), title_classes(df)).collect()} == want


def test_clique_query_is_whole(spark):
    """Every identity that shares its source and normalised title with another, whatever its size."""
    from kinfold.functions.text import normalize_title
    from kinfold.plans import registry
    from kinfold.plans.fixtures import view

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    least = {}
    rows = view(spark, folder, "identity").select("id", "source", normalize_title(F.col("title")).alias("t")).collect()
    rows = [(x.id, (x.source, x.t)) for x in rows if x.t]
    for i, k in rows:
        least.setdefault(k, []).append(i)
    got = {x.id: x.clique for x in registry.QUERIES["e20_clique_groups"](spark, folder).collect()}
    assert got == {i: min(least[k]) for i, k in rows if len(least[k]) > 1}


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(pairs=st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=12))
def test_any(spark, pairs):
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == roots(pairs)
