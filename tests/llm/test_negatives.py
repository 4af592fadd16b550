from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import negatives
from kinfold.llm.common import Tables
from kinfold.llm.queries import ORACLES, QUERIES

ROW = "vec_id bigint, label int, embedding array<float>"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchors, k=5, positives=5, low=80, high=100):
    ok = {(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, lab, v in rows if None not in (i, lab) and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, lab, x in sorted(ok):
        if a not in anchors:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), b, other) for b, other, y in ok if b != a and len(y) == len(x)]
        for s, p, _ in sorted(z for z in scored if z[2] == lab)[:positives]:
            near = sorted(z for z in scored if z[2] != lab and low * -s <= 100 * -z[0] <= high * -s)
            out += [(a, p, n + 1, b, -s, -t) for n, (t, b, _) in enumerate(near[:k])]
    return sorted(out)


def mined(spark, rows, anchors, **more):
    df = spark.createDataFrame(rows, ROW).withColumn("x", F.lit("extra")).withColumn("d", F.lit(1))
    out = negatives.hard_negatives(df, df.filter(F.col("vec_id").isin(anchors)), Tables(spark, "negatives"), **more)
    assert out.columns == NAMES
    return sorted(tuple(r) for r in out.collect())


def test_negatives(spark):
    r = random.Random(4)
    v = lambda d=8: [r.gauss(0, 1) for _ in range(d)]
    rows = [(i, 0 if i % 3 == 0 else i % 5, v()) for i in range(300)]
    rows += [(i, 7, v()) for i in range(300, 303)] + [(i, i, v()) for i in range(303, 340)]  # labels of few rows
    same = v()
    rows += [(i, i % 2, same) for i in range(400, 440)]  # ties
    rows += [(500, None, v()), (501, 1, None), (502, 1, [None, *v(7)]), (503, 1, [math.nan, *v(7)]), (504, 1, [math.inf, *v(7)]), (None, 1, v()), (505, 1, [0.0] * 8), (506, 2, []), (507, 2, []), (508, 3, []), (509, 1, v(3)), (510, 1, v(3)), (511, 2, v(3)), rows[6], rows[6], (6, 1, v()), (512, 1, [0.0] * 7 + [-1.0])]
    anchors = [*range(0, 340, 9), 400, 401, 500, 501, 505, 506, 509, 512, 6]
    got = mined(spark, rows, anchors)
    assert got == brute(rows, anchors) and len(got) > 300
    assert mined(spark, rows, anchors, k=2, positives=3, percent=(50, 90)) == brute(rows, anchors, 2, 3, 50, 90)
    assert mined(spark, rows, []) == [] and mined(spark, [], [1]) == []


def test_large_components(spark):
    """Beyond 24 and 53 bits; rows whose scores would leave 64 bits take no part."""
    r = random.Random(5)
    for size in (30.0, 2e6, 5e6):
        rows = [(i, i % 2, [float(np.float32(r.uniform(-size, size))) for _ in range(4)]) for i in range(60)]
        assert mined(spark, [*rows, (99, 1, [1e30, 1.0, 1.0, 1.0])], [0, 7, 20, 99]) == brute(rows, [0, 7, 20])


def test_the_search_stops_at_the_threshold():
    """A few rows far ahead of the rest are found without scoring the rest; the answer is that of all rows."""
    r = np.random.default_rng(2)
    x = np.floor(r.normal(0, 20, (4000, 6))).astype(np.int64)
    anchor = np.array([40, -30, 0, 25, -10, 5])
    x[:12] = anchor * 4 + r.integers(-3, 4, (12, 6))
    labels = np.arange(4000) % 2
    lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
    shard = negatives.Shard(6, np.arange(4000).tobytes(), labels.tobytes(), x.tobytes(), lists.tobytes())
    score = x @ anchor
    for low, high in ((-(1 << 63), (1 << 63) - 1), (int(score[:12].min()), int(np.sort(score)[-3]))):
        best = negatives.Best(4, low, high)
        scored = negatives.threshold_search(shard, anchor, labels == 1, [best])
        want = sorted((-s, i) for i, s in enumerate(score.tolist()) if i % 2 and low <= s <= high)[:4]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want
        assert scored < 400


def test_negatives_query(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, i % 10, [r.gauss(0, 0.125) for _ in range(16)]) for i in range(500)] + [(700, None, [1.0] * 16), (800, 1, None)]
    path = str(tmp_path)
    spark.createDataFrame(rows, ROW).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    got = sorted(tuple(r) for r in QUERIES["op12_negatives"](spark, path).select(*NAMES).collect())
    moved = [(i, (lab + 1) % 10 if lab is not None and i % 7 == 0 else lab, v) for i, lab, v in rows]
    assert got == brute(moved, range(0, 10**6, 100)) and got
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(ORACLES["op12_negatives"]).fetchall())
