"""Versioned tables, and streams that stop and start again."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import planning as P
from kinfold.session import fresh_path
from kinfold.sources.snapshots import SnapshotTable
from kinfold.streaming import feeds as T
from kinfold.streaming import runs as R

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def table(spark, schema, keys, **more):
    return SnapshotTable(spark, fresh_path(spark, "state"), schema, keys, **more)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("compact_every", [0, 1, 3, 50])
def test_versions(spark, compact_every):
    """Commits against a dictionary; replays do nothing, each kept version stays as it was, old ones go."""
    r, t, want, history = random.Random(compact_every), table(spark, "k bigint, s string, v bigint", ["k", "s"], compact_every=compact_every, keep=3), {}, {}
    assert t.read().count() == 0 and t.entry() is None
    for batch in range(7):
        changes = {(r.randrange(6), r.choice("ab")): r.choice([None, 1, 2, 3]) for _ in range(4)}
        gone = {k for k in want if r.random() < 0.2 and k not in changes}
        df = spark.createDataFrame([(*k, v) for k, v in changes.items()], "k bigint, s string, v bigint")
        assert t.commit(df, batch, spark.createDataFrame(sorted(gone), "k bigint, s string"))
        assert not t.commit(df.withColumn("v", F.lit(99)), batch) and t.done(batch) and not t.done(batch + 1)
        want = {k: v for k, v in (want | changes).items() if k not in gone}
        history[t.entry()["version"]] = {(*k, v) for k, v in want.items()}
        assert set(map(tuple, t.read().collect())) == history[t.entry()["version"]]
    assert t.versions() == [5, 6, 7]
    for v in t.versions():
        assert set(map(tuple, t.read(v).collect())) == history[v]
    assert len(t._names("data")) == len({f for v in t.versions() for f in t.entry(v)["folders"]})


def test_a_version_has_one_writer(spark):
    a = table(spark, "k bigint, v bigint", ["k"])
    a.commit(spark.createDataFrame([(1, 1)], "k bigint, v bigint"), 0)
    with pytest.raises(Exception, match="(?i)exist"):
        a._publish({"version": 1, "batch": 5, "folders": []})
    assert a.entry()["batch"] == 0 and rows_of(a.read()) == [(1, 1)]


def in_runs(spark, df, parts, step, per_file=None):
    """df as a stream whose files come part by part, with a restart before each."""
    path, out = fresh_path(spark, "in"), None
    for p in parts:
        df.filter(p).repartition(3).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema)
        out = step((stream.option("maxFilesPerTrigger", per_file) if per_file else stream).parquet(path))
    return out


def test_events_resume(spark):
    """Each event once, through restarts; a cursor beyond the log is taken back to its end."""
    df = spark.range(100).select("id", (F.col("id") % 7).alias("job_id"))
    jobs, home = spark.createDataFrame([(k, f"j{k}") for k in range(5)], "job_id bigint, job string"), fresh_path(spark, "events")
    seen = []

    def step(stream):
        out = T.follow_events(stream, df, jobs, home, after=4, last="9")
        seen.append(out.count())
        return out

    out = in_runs(spark, df, ["id < 50", "id >= 50 AND id < 70", "id >= 70"], step)
    assert seen == [40, 60, 90]
    assert rows_of(out.select("id", F.coalesce("job", F.lit("-")))) == [(i, f"j{i % 7}" if i % 7 < 5 else "-") for i in range(10, 100)]
    home = fresh_path(spark, "events")
    path = fresh_path(spark, "in")
    df.write.parquet(path)
    assert T.follow_events(spark.readStream.schema(df.schema).parquet(path), df, jobs, home, after=10_000).count() == 0
    spark.range(100, 103).select("id", F.lit(0).cast("bigint").alias("job_id")).write.mode("append").parquet(path)
    assert T.follow_events(spark.readStream.schema(df.schema).parquet(path), df, jobs, home, after=10_000).count() == 3  # a new sequence goes on


@pytest.mark.parametrize(("after", "last", "most", "want"), [(3, None, 10, 3), (3, "7", 10, 7), (3, "x", 10, 3), (50, "7", 10, 10), (-4, "-9", 10, 0), (5, "6", None, 0)])
def test_resume_cursor(after, last, most, want):
    assert T.resume_cursor(after, last, most) == want


def samples(n, seed, rate=0.004):
    """Requests in bursts, so that runs close by time, by number and by a signal."""
    r, out, at = random.Random(seed), [], 0
    for i in range(n):
        at += r.choice([0, 1, 1, 1, 2]) if r.random() < 0.995 else r.randrange(60, 2000)
        out.append((i, r.choice(["a", "a", "a", "b"]), START + datetime.timedelta(seconds=at), r.random() < 0.1, r.random() < rate, r.choice([None, 30, 900])))
    return out


SAMPLE = "id bigint, source string, at timestamp, failed boolean, limited boolean, retry_after bigint"


def plain_runs(rows, ceiling, most, seconds):
    """The same runs, sample by sample; at the end those close whose time is over for the whole stream."""
    policy, run, out = {}, {}, []

    def close(s, ended, reason):
        tier, n, bad, retry, began = run.pop(s)
        state, policy[s] = R.learn_step(policy.get(s, R.FIRST_POLICY), tier, n, reason == "limit", retry)
        out.append((s, policy[s][0], tier, n, bad, retry, began, ended, reason, state, *policy[s][1:]))

    span = datetime.timedelta(seconds=seconds)
    for _, s, at, failed, limited, retry in rows:
        if s in run and at >= run[s][4] + span:
            close(s, run[s][4] + span, "time")
        tier, n, bad, longest, began = run.get(s) or (min(ceiling, policy.get(s, R.FIRST_POLICY)[1] + 1), 0, 0, None, at)
        run[s] = (tier, n + 1, bad + failed, max((x for x in (longest, retry) if x is not None), default=None), began)
        if limited or n + 1 == most:
            close(s, at, "limit" if limited else "requests")
    for s in list(run):
        if run[s][4] + span < rows[-1][2]:
            close(s, run[s][4] + span, "time")
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [["true"], ["id < 700", "id >= 700 AND id < 1900", "id >= 1900"]])
def test_runs_close(spark, parts):
    """In one batch and through restarts: the runs of the plain fold. The last sample, much later, lets the timers close the rest."""
    rows = samples(4000, 1)
    rows.append((4000, "z", rows[-1][2] + datetime.timedelta(hours=3), False, False, None))
    df, home = spark.createDataFrame([*rows, (5000, None, START, False, False, None), (5001, "a", None, False, False, None)], SAMPLE), fresh_path(spark, "runs")
    out = in_runs(spark, df, parts, lambda stream: R.closed_runs(stream, home, ceiling=4, requests=120, seconds=200))
    names = [c.split()[0] for c in R.CLOSED.split(", ")][:-1]
    got = [tuple(x.astimezone(datetime.UTC) if isinstance(x, datetime.datetime) else x for x in r) for r in out.select(*names).collect()]
    want = plain_runs(rows, 4, 120, 200)
    assert sorted(got, key=str) == want
    assert {r[8] for r in want} == {"limit", "requests", "time"} and {r[9] for r in want} == {"limited", "succeeded", "inconclusive"}
    days = out.select(F.datediff("next_run", "ended"), "state").distinct().collect()
    assert {tuple(r) for r in days} == {(30, "limited"), (7, "succeeded"), (1, "inconclusive")}


def test_one_run_teaches_as_the_table_rule_does(spark):
    r, cases = random.Random(3), []
    for i in range(60):
        cases.append((f"s{i}", r.randint(1, 6), r.choice([5, 99, 100, 400]), r.random() < 0.4, r.choice([None, 60, 5000]), (0, r.randint(1, 5), r.randint(2, 9), r.choice([0.0, 0.3, 0.7, 2.0]), r.choice([0, 300]), r.randint(0, 3))))
    runs = spark.createDataFrame([c[:5] for c in cases], "source string, tier int, requests bigint, limited boolean, max_retry_after bigint")
    policies = spark.createDataFrame([(c[0], *c[5][1:]) for c in cases], "source string, job_limit int, page_limit int, interval double, cooldown bigint, clean_runs int")
    got = {r.source: (r.state, r.job_limit, r.page_limit, r.interval, r.cooldown, r.clean_runs) for r in P.learn_policies(runs, policies, F.lit("2024-01-01").cast("timestamp")).collect()}
    for s, tier, n, limited, retry, policy in cases:
        state, after = R.learn_step(policy, tier, n, limited, retry)
        assert got[s] == (state, *after[1:])


@pytest.mark.parametrize("parts", [["true"], ["seq < 300", "seq >= 300 AND seq < 310", "seq >= 310 OR seq IS NULL"]])
def test_one_active_row_a_key(spark, parts):
    r, rows = random.Random(7), []
    for seq in range(800):
        i = r.randrange(120)
        rows.append((f"k{i % 3}", f"d{i % 10}", i, r.choice(["queued", "leased", "retrying", "succeeded", "failed", "cancelled", None]), seq))
    held = {}
    for kind, key, i, status, seq in rows:
        if status in ("queued", "leased", "retrying"):
            held[kind, key] = (i, seq)
        elif held.get((kind, key), (None,))[0] == i:
            del held[kind, key]
    rows += [(None, "d", 1, "queued", 900), ("k0", None, 1, "queued", 901), ("k0", "d0", None, "queued", 902), ("k0", "d0", 1, "queued", None)]
    df = spark.createDataFrame(rows, "kind string, dedupe_key string, id bigint, status string, seq bigint")
    t, home = table(spark, "kind string, dedupe_key string, id bigint, seq bigint", ["kind", "dedupe_key"], compact_every=1), fresh_path(spark, "active")
    actions = in_runs(spark, df, parts, lambda stream: T.dedupe_active(stream, t, home))
    assert rows_of(t.read()) == sorted((*k, *v) for k, v in held.items())
    count = dict(actions.groupBy("action").count().collect())
    assert count.get("opened", 0) - count.get("closed", 0) == len(held)


def test_listings(spark):
    """New, advanced, stale, alternate and unchanged listings over restarts; a batch that comes again changes nothing."""
    day = lambda d: START + datetime.timedelta(days=d)
    t, home = table(spark, "id bigint, version bigint, detailed_at timestamp", ["id"]), fresh_path(spark, "listings")
    t.commit(spark.createDataFrame([(1, 5, day(0)), (2, 5, day(0)), (3, 5, None), (4, None, day(0))], "id bigint, version bigint, detailed_at timestamp"), -1)
    rows = [(0, 1, 5, day(1)), (0, 1, 4, day(2)), (0, 2, 7, day(1)), (0, 3, 5, day(1)), (0, 4, 1, day(1)), (0, 9, 1, day(1)), (0, None, 1, day(1)), (0, 20, 8, day(1)), (1, 1, 5, day(9)), (1, 2, 6, day(3)), (1, 9, 1, day(2))]
    df = spark.createDataFrame(rows, "part int, id bigint, version bigint, at timestamp")
    alternates = spark.createDataFrame([(20, 2), (9, 2)], "id bigint, primary bigint")
    changes = in_runs(spark, df, ["part = 0", "part = 1"], lambda stream: T.listing_changes(stream, t, home, alternates))
    got = sorted((r.batch, r.id, r.version, r.reason) for r in changes.collect())
    assert got == [(0, 2, 8, "advanced"), (0, 3, 5, "stale"), (0, 4, 1, "advanced"), (1, 1, 5, "stale")]
    assert [(r.id, r.version) for r in t.read().orderBy("id").collect()] == [(1, 5), (2, 8), (3, 5), (4, 1)]


def test_cadence_below_a_minute(spark):
    rows = [(i, "s", o, i) for i, o in enumerate(["failure", "none", "change", "none", "failure"])]
    df = spark.createDataFrame(rows, "id bigint, source string, outcome string, seq bigint")
    t, home = table(spark, T.CADENCE, ["source"]), fresh_path(spark, "cadence")
    in_runs(spark, df, ["seq < 2", "seq >= 2"], lambda stream: T.poll_cadence(stream, t, home, base=30))
    assert rows_of(t.read()) == [("s", 120, 0)]


@pytest.mark.parametrize("parts", [["true"], ["id < 40", "id >= 40 AND id < 41", "id >= 41"]])
def test_probes(spark, parts):
    """The stream gives the rows of the table operator, in one batch and through restarts."""
    r, at, rows = random.Random(5), 0, []
    for i in range(300):
        at += r.choice([1, 40, 900, 7000])
        rows.append((i, r.choice("ab"), START + datetime.timedelta(seconds=at), r.choice([True, True, False, None])))
    df, home = spark.createDataFrame(rows, "id bigint, source string, at timestamp, ok boolean"), fresh_path(spark, "probes")
    out = in_runs(spark, df, parts, lambda stream: R.probe_steps(stream, home)).drop("batch")
    want = P.recovery_probes(df).select("source", "id", "wait", "cooldown")
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
