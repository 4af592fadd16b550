from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import ngram_join as J
from kinfold.llm import neighbours as N


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_documents(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(docs.withColumn("component_id", F.lit("x"))).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_borderline_sizes(spark, seed):
    """Chains of edits around the threshold, at every small size and at some larger ones."""
    r, rows = random.Random(seed), []
    for n in [*range(1, 30), 45, 64, 90, 150, 320]:
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for k in range(6):
            rows.append((len(rows), " ".join(words)))
            if k % 2:
                words = words[: len(words) - max(1, n // 40)] + [f"x{r.randrange(10**6)}"]
            else:
                words = [f"y{r.randrange(10**6)}", *words]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_large_group_makes_few_rows(spark):
    """A thousand near copies are joined through hubs."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:k] + [f"z{i}"] + words[k:])) for i in range(1000) for k in [r.randrange(200)]]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.select("component_id").distinct().count() == 1


def crowd_rows(n=60, passages=2):
    """Documents that share passages but are not alike, near copies among them, and copies."""
    r, rows = random.Random(8), []
    shared = [" ".join(f"p{k}x{i}" for i in range(40)) for k in range(passages)]
    for i in range(n):
        own = [f"o{i}x{k}" for k in range(30)]
        rows.append((2 * i, " ".join([*own, shared[i % passages]])))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join([*own[1:], shared[i % passages]])))
        if i % 10 == 0:
            rows += [(5000 + i, rows[-1][1]), (6000 + i, rows[-1][1].upper())]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,direct,levels,hot", [(3, 1, 1, 1), (8, 2, 3, 4), (2048, 4, 3, 64)])
def test_crowds(spark, monkeypatch, block, direct, levels, hot):
    """Keys that many documents share: in small blocks, keyed again, block by block, and dealt over tasks."""
    for name, value in {"CROWD": 2, "BLOCK_ROWS": block, "DIRECT_BLOCKS": direct, "LEVELS": levels, "HOT_LEAST": hot, "HOT_SHARE": 1}.items():
        monkeypatch.setattr(J, name, value)
    rows = crowd_rows()
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_query(spark, folder, docs):
    """The registered query against brute force."""
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.op7_ngram_join(spark, folder).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_ids(spark):
    """Rows of one doc_id are one document with several texts; a null doc_id takes no part."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (4, c), (None, c), (5, c)]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None)} and len(got) == len(rows)


def test_long_text(spark):
    """A text of 600,000 words and a near copy of it; words without end, and an unbroken one."""
    words = [f"w{i}" for i in range(600_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:300_000] + ["new"] + words[300_000:])), (3, " ".join(words[:300_000])), (4, "same " * 1_000_000), (5, "x" * 5_000_000)]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_sketches():
    """Sketches never differ by more bits than the sets by elements, at equal and at unequal lengths."""
    rng = np.random.default_rng(1)
    for n in [1, 5, 60, 64, 130, 1000, 40_000]:
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        for drop, add in [(0, 0), (1, 0), (0, n // 3), (n // 3, n // 5), (n - 1, n)]:
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
            x, y = (np.frombuffer(J.sketch(s), np.uint64) for s in (a, b))
            size = min(len(x), len(y))
            assert np.bitwise_count(J.folded(x, size) ^ J.folded(y, size)).sum() <= len(np.setxor1d(a, b))


def test_pigeonhole():
    """Any two sets within the similarity share a key, one of them own and one asking."""
    rng = np.random.default_rng(0)
    for n in [*range(1, 60), 100, 250, 600]:
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        for level in range(4):
            drop = rng.integers(0, J.most_difference(2 * n, 85) + 1)
            b = np.concatenate([a[int(drop) :], rng.integers(0, 2**63, int(rng.integers(0, 3)), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
                ka, kb = (list(zip(*map(np.ndarray.tolist, J.keys(np.unique(x), 85, level)))) for x in (a, b))
                x = {}
                for k, own, ask in ka:
                    x.setdefault(k, []).append((own, ask))
                assert any((o and q2) or (o2 and q) for k, o2, q2 in kb for o, q in x.get(k, []))


def test_empty(none):
    assert J.near_duplicates(none).count() == 0


def test_null_ids(spark):
    got = J.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (None, None), (1, "a b c d e")], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == [(False, 2, 1)]
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]


def vectors(n, d=32, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)).astype(np.float32)


def exact(x, q, k=5):
    score = (x.astype(float) * x[q].astype(float)).sum(axis=1) / (np.linalg.norm(x.astype(float), axis=1) * np.linalg.norm(x[q].astype(float)))
    score[q] = -9
    return np.lexsort((np.arange(len(x)), -score))[:k].tolist()


def test_neighbours(spark):
    x = vectors(1500)
    x[700:900] = x[7]  # a common vector
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + [(5000, None, "x"), (5001, [0.0] * 32, "x"), (5002, [float("nan")] * 32, "x"), (5003, [1.0], "x"), (5050, [None] * 32, "x")], "vec_id bigint, embedding array<float>, score string")
    got = N.nearest(df, df.filter("vec_id % 50 = 0"), block_rows=64, block_queries=4).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == set(range(0, 1500, 50)) and all(len(v) == 5 for v in by.values())
    hits = sum(len(set(exact(x, q)) & set(v)) for q, v in by.items())
    assert hits >= 0.9 * 5 * len(by)
    assert by[750] == [7, 700, 701, 702, 703]  # ties to the smaller id


@pytest.mark.parametrize("rows_per_bucket", [7, 3])
def test_recall_of_split_buckets(spark, rows_per_bucket):
    """Buckets split by 2 and 4."""
    x = vectors(2000, 64, seed=1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    by = {}
    for r in N.nearest(df, df.filter("vec_id % 20 = 0"), rows_per_bucket=rows_per_bucket).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(set(exact(x, q)) & by[q]) for q in range(0, 2000, 20))
    assert hits >= 0.9 * 500


def test_neighbours_query(spark, folder):
    """The registered query against brute force: exact scores and order, and the share of the nearest that it finds."""
    rows = [(r.vec_id, np.array(r.embedding, np.float32)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding and any(r.embedding)]
    ids, x = [i for i, _ in sorted(rows)], np.stack([v for _, v in sorted(rows)])
    got = N.op9_neighbours(spark, folder).collect()
    by, hits = {}, 0
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(range(0, 600, 50)) and all(len(v) == 5 for v in by.values())
    for q, found in by.items():
        a = x[ids.index(q)].astype(float)
        for i, score in found:
            b = x[ids.index(i)].astype(float)
            assert abs(score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
        assert [i for i, _ in found] == [i for i, _ in sorted(found, key=lambda p: (-p[1], p[0]))]
        hits += len({ids[i] for i in exact(x, ids.index(q))} & {i for i, _ in found})
    assert hits >= 0.9 * 5 * len(by)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [-1.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = N.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    none = df.limit(0)
    assert N.nearest(none, none).count() == 0


def test_a_recall_out_of_reach_is_answered_by_a_scan(spark):
    """Where no number of probes finds what is asked, the answer is exact, and of all queries."""
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for row in N.nearest(df, df.filter("vec_id % 20 = 0"), tables=1, rows_per_bucket=10, recall=1.1).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 400, 20):
        near = y @ y[q]
        near[q] = -2
        assert [i for _, i in sorted(got[q])] == np.argsort(-near)[:5].tolist()


def test_vectors_at_the_ends_of_doubles(spark):
    """Lengths that over- or underflow as such still have cosines."""
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 8))
    scales = np.where(np.arange(60) % 3 == 0, 1e200, np.where(np.arange(60) % 3 == 1, 1e-200, 1.0))
    df = spark.createDataFrame([(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, scales))], "vec_id bigint, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    for row in N.nearest(df, df.filter("vec_id % 20 = 0")).collect():
        assert abs(row.score - float(y[row.query_id] @ y[row.vec_id])) < 1e-9


def test_parts_of_keys(spark, docs, monkeypatch):
    """Keys are dealt part by part: no part has much more than its share, and together they are all."""
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    frame = J.pd.DataFrame(texts, columns=["doc_id", "text"])
    whole, *parts = (J.pd.concat(J._keys(iter([frame]), 5, 80, 0, k, n)) for k, n in [(0, 1), (0, 3), (1, 3), (2, 3)])
    assert sorted(J.pd.concat(parts).itertuples(index=False)) == sorted(whole.itertuples(index=False))
    assert max(map(len, parts)) < 0.4 * len(whole)
    found, write = [], J.Tables.write
    monkeypatch.setattr(J.Tables, "write", lambda self, df, name: (found.append(name), write(self, df, name))[1])
    got = {n: sorted(map(tuple, (monkeypatch.setattr(J, "PARTS", n), J.near_duplicates(docs))[1].collect()), key=str) for n in (1, 3)}
    assert got[1] == got[3] and {"keys/0", "keys/1", "keys/2"} <= set(found)
