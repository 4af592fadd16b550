from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from kinfold.sources.snapshots import SnapshotTable
from kinfold.streaming import feeds as T

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def samples(n: int, seed: int) -> list[tuple]:
    """Failures in bursts, so that all lengths of a cooldown occur; two thirds of one source."""
    r, out, at, bad = random.Random(seed), [], 0, 0.3
    for i in range(n):
        at += r.choice([1, 30, 400, 3000])
        bad = r.choice([0.05, 0.5, 0.97]) if r.random() < 0.02 else bad
        out.append((i, "hot" if i % 3 else "cold", at, r.random() < bad))
    return out


def brute(rows):
    states = {}
    for _, source, at, failed in sorted(rows):
        states[source] = T.breaker_step(states.get(source, (0, 0.0)), START.timestamp() + at, failed)
    return states


@pytest.mark.parametrize("seed", range(4))
def test_segments_join(seed):
    """Any cuts of a sequence lead from any state to the state of the plain fold."""
    import numpy as np

    r = random.Random(seed)
    for _ in range(60):
        rows = [x for x in samples(400, r.randrange(10**6)) if x[1] == "hot"][: r.randrange(1, 260)]
        ends = sorted({len(rows), *(r.randrange(1, len(rows) + 1) for _ in range(5))})
        parts, last = [], 0
        for end in ends:
            ids, _, at, failed = (np.array(c) for c in zip(*rows[last:end]))
            parts.append(T._segment(ids, at.astype(float), failed))
            last = end
        for state in ((0, 0.0), (2, 0.0), (3, 900.0), (12, 30_000.0), (40, 10.0)):
            want, one, all_of = state, state, parts[0]
            for _, _, at, failed in rows:
                want = T.breaker_step(want, float(at), failed)
            for p in parts:
                one = T._after(one, p)
            for p in parts[1:]:
                all_of = T._join_segments(all_of, p)
            assert one == want == T._after(state, all_of)


def test_breaker_of_many_interleaved_rows(spark, tmp_path):
    """More than 10,000 rows of a source whose files all span its whole range of ids; each file may be a batch of its own."""
    rows = samples(24_000, 9)
    rows += [(30_000 + i, "down", i, True) for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, source string, s bigint, failed boolean").withColumn("at", F.timestamp_seconds(F.col("s") + int(START.timestamp())))
    df.select("id", "source", "at", "failed").orderBy(F.rand(1)).repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, source string, at timestamp, failed boolean").parquet(f"{tmp_path}/in")
    table = SnapshotTable(spark, f"{tmp_path}/state", T.BREAKER, ["source"])
    got = {r.source: (r.failures, r.cooling_until) for r in T.circuit_breaker(stream, table, f"{tmp_path}/home").read().collect()}
    assert got == brute(rows)


def test_breaker_of_several_batches(spark, tmp_path):
    rows = samples(900, 3)
    df = spark.createDataFrame(rows, "id bigint, source string, s bigint, failed boolean").withColumn("at", F.timestamp_seconds(F.col("s") + int(START.timestamp())))
    for k in range(3):
        df.select("id", "source", "at", "failed").filter(F.floor(F.col("id") / 300) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, source string, at timestamp, failed boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = T.circuit_breaker(stream, SnapshotTable(spark, f"{tmp_path}/state", T.BREAKER, ["source"]), f"{tmp_path}/home")
    for k in range(3):
        want = brute([r for r in rows if r[0] < 300 * (k + 1)])
        assert {r.source: (r.failures, r.cooling_until) for r in table.read(k + 1).collect()} == want
