"""Change-driven parts on Structured Streaming. Each function takes a streaming frame and uses up what it holds now.

Those with a `home` keep their place there: a later call with the same home goes on after what was read. Those that keep
state keep it in a SnapshotTable: each micro-batch is one commit by its number, so a batch that runs again changes nothing,
and what a batch reads is the state, not the batches before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import fresh_path
from kinfold.sources.snapshots import SnapshotTable

C = F.col


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files, timestamps in UTC."""
    path = f"{folder}/{name}.parquet"
    now = spark.read.parquet(path)
    stream = spark.readStream.schema(now.schema)
    one_file = all(f.endswith(f"{name}.parquet") for f in now.inputFiles())  # the source reads folders only
    df = stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one_file else stream.parquet(path)
    return df.withColumns({c: C(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def run(stream: DataFrame, mode: str, name: str, each: Callable[[DataFrame, int], None] | None = None, home: str | None = None) -> DataFrame:
    """Run over what there is now; the result as a table. A batch that runs again replaces what it wrote."""
    spark = stream.sparkSession
    path = home or fresh_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(each or put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def fold_into(stream: DataFrame, table: SnapshotTable, home: str, step: Callable[[DataFrame, DataFrame, int], tuple[DataFrame, DataFrame | None]]) -> SnapshotTable:
    """Each micro-batch of a stream into a table: step(batch, the table's rows, number) gives changed rows and keys to remove.
    One stream a table, as its batches are known by number."""

    def put(batch: DataFrame, number: int) -> None:
        if not table.done(number):
            changed, gone = step(batch, table.read(), number)
            table.commit(changed, number, gone)

    stream.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return table


def status_counts(events: DataFrame, key: str) -> DataFrame:
    """Running counts of an event log."""
    return events.groupBy(key).agg(F.count("*").alias("n"))


def enriched(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """An event log (id, job_id) with what is known of each event's job (jobs: job_id and more; a static table, read
    anew in each micro-batch). What was read is kept with the checkpoint, so a restart goes on after it."""
    return events.join(jobs, "job_id", "left")


def resume_cursor(after: int, last: str | None, most: int | None) -> int:
    """Where a reader goes on: the greater of two cursors that it names, but no further than there are events, as a
    database that was set up anew starts from low ids again. A cursor that isn't a number doesn't count."""
    said = int(last) if last and last.strip().lstrip("-").isdigit() else 0
    return min(max(after, said, 0), max(most or 0, 0))


def follow_events(events: DataFrame, known: DataFrame, jobs: DataFrame, home: str, after: int = 0, last: str | None = None) -> DataFrame:
    """All events (id, job_id) so far read at this home, with what is known of each one's job. known: the event log as a
    table, for its greatest id; events up to the cursor are left out."""
    most = known.agg(F.max("id").alias("id")).first()["id"]
    return run(enriched(events.filter(C("id") > resume_cursor(after, last, most)), jobs), "append", "events", home=home)


def listing_changes(listings: DataFrame, table: SnapshotTable, home: str, alternates: DataFrame | None = None, days: int = 7) -> DataFrame:
    """Listings (id, version, at) into the table of known ones (id, version, detailed_at), and the change rows (id, version,
    at, reason, batch) so far.

    Each micro-batch is reduced to the latest row of each id. Listed ids that aren't known may be alternates (id, primary) of
    ones that are. A listing is a change if it is new, has advanced, or its detail is older than `days` before it (or was
    never taken); changes become known, with their detail as of now. A version never goes back. Null ids are left out.
    """
    spark, schema = listings.sparkSession, "id bigint, version bigint, at timestamp, reason string, batch bigint"

    def step(batch: DataFrame, old: DataFrame, number: int) -> tuple[DataFrame, None]:
        rows = batch.filter("id IS NOT NULL").select("id", "version", "at")
        if alternates is not None:
            rows = rows.join(old.select("id", F.lit(True).alias("__known")), "id", "left").join(alternates.select("id", "primary").dropDuplicates(["id"]), "id", "left")
            rows = rows.withColumn("id", F.when(C("__known"), C("id")).otherwise(F.coalesce("primary", "id")))
        last = rows.groupBy("id").agg(F.max(F.struct("version", "at")).alias("x")).select("id", "x.*")
        old = old.select("id", C("version").alias("__old"), "detailed_at", F.lit(True).alias("__known"))
        stale = C("detailed_at").isNull() | (C("detailed_at") < C("at") - F.make_dt_interval(F.lit(days)))
        reason = F.when(C("__known").isNull(), "new").when(C("__old").isNull() | (C("version") > C("__old")), "advanced").when(stale, "stale")
        out = last.join(old, "id", "left").withColumn("reason", reason).filter("reason IS NOT NULL")
        out.select("id", F.greatest("version", "__old").alias("version"), "at", "reason").write.mode("overwrite").parquet(f"{home}/changes/batch={number}")
        out = batch.sparkSession.read.schema(schema).parquet(f"{home}/changes").filter(C("batch") == number)
        return out.select("id", "version", C("at").alias("detailed_at")), None

    fold_into(listings, table, home, step)
    return spark.read.schema(schema).parquet(f"{home}/changes")


def latency_windows(samples: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """By source and hour: requests, failures and mean latency (samples: source, at, latency, failed)."""
    hours = samples.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "source")
    return hours.agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.round(F.avg("latency"), 6).alias("mean")).select(C("w.start").alias("hour"), "source", "n", "failures", "mean")


def dedupe_active(rows: DataFrame, table: SnapshotTable, home: str, active: tuple[str, ...] = ("queued", "leased", "retrying")) -> DataFrame:
    """A stream of states of work (kind, dedupe_key, id, status, seq) into the table of active rows (kind, dedupe_key, id,
    seq), one a key at most, and what happened to keys by batch (kind, dedupe_key, id, action, batch).

    In order of seq, a row that is active takes its key over from any other, and the end of the row that holds a key frees it;
    ends of others mean nothing. The table holds live keys only, so it doesn't grow with the stream. Rows without a key, id or
    seq are left out; batches come in order of seq.
    """
    spark, schema, key = rows.sparkSession, "kind string, dedupe_key string, id bigint, action string, batch bigint", ["kind", "dedupe_key"]

    def step(batch: DataFrame, old: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        here = batch.filter("kind IS NOT NULL AND dedupe_key IS NOT NULL AND id IS NOT NULL AND seq IS NOT NULL").withColumn("__on", F.coalesce(C("status").isin(*active), F.lit(False)))
        touched = old.join(here.select(*key).distinct(), key, "left_semi")
        both = here.select(*key, "id", "seq", "__on").unionByName(touched.select(*key, "id", "seq", F.lit(True).alias("__on")))
        ids = both.groupBy(*key, "id").agg(F.max(F.when(C("__on"), C("seq"))).alias("seq"), F.max(F.when(~C("__on"), C("seq"))).alias("ended"))
        last = ids.groupBy(*key).agg(F.max(F.when(C("seq").isNotNull(), F.struct("seq", "id", "ended"))).alias("x")).filter("x IS NOT NULL").select(*key, "x.*")
        before = touched.select(*key, C("id").alias("__was"))
        out = last.join(before, key, "left").withColumn("live", C("ended").isNull() | (C("ended") < C("seq")))
        action = F.when(~C("live"), F.when(C("__was").isNull(), "passed").otherwise("closed")).when(C("__was").isNull(), "opened").when(C("__was") == C("id"), "kept").otherwise("replaced")
        out.select(*key, "id", "seq", "live", action.alias("action")).write.mode("overwrite").parquet(f"{home}/actions/batch={number}")
        out = batch.sparkSession.read.schema(schema + ", seq bigint, live boolean").parquet(f"{home}/actions").filter(C("batch") == number)
        return out.filter("live").select(*key, "id", "seq"), out.filter("NOT live").select(*key)

    fold_into(rows, table, home, step)
    return spark.read.schema(schema).parquet(f"{home}/actions")


def breaker_step(state: tuple[int, float], at: float, failed: bool, threshold: int = 3, base: float = 300.0, most: float = 21_600.0) -> tuple[int, float]:
    """T4: (consecutive failures, end of cooldown): from the threshold on, a failure cools down for base * 2^(n - threshold)
    seconds, at most `most`; a success resets both unless the source is still cooling."""
    n, until = state
    if failed:
        n += 1
        return n, at + min(most, base * 2 ** min(n - threshold, 1000)) if n >= threshold else until
    return (n, until) if at < until else (0, 0.0)


#: From so many failures on every cooldown is the longest, with breaker_step's own values.
LONGEST = 10
_SUMMARY = "source string, first bigint, lead double, failures array<bigint>, until array<double>, reset array<boolean>"


def _segment(ids: np.ndarray, at: np.ndarray, failed: np.ndarray) -> dict:
    """What a run of one source's samples, in order of id, does to any state: the latest success before its first failure
    (lead), and the state after the rest for each number of failures before, LONGEST standing for all above it.

    No more is needed, as a state of fewer than three failures isn't cooling and from the third on each failure sets the
    end of cooldown anew.
    """
    bad = np.flatnonzero(failed)
    k = int(bad[0]) if len(bad) else len(at)
    out: dict = {"first": int(ids[0]), "lead": float(at[:k].max()) if k else -math.inf, "failures": [], "until": [], "reset": []}
    if len(bad):
        states, reset = [(n, 0.0) for n in range(LONGEST + 1)], [False] * (LONGEST + 1)
        for a, f in zip(at[k:].tolist(), failed[k:].tolist()):
            if len(states) > 1:
                states = [breaker_step(x, a, f) for x in states]
                reset = [r or x[0] == 0 for r, x in zip(reset, states)]
                states = states[:1] if all(reset) and len(set(states)) == 1 else states
            else:
                states = [breaker_step(states[0], a, f)]
        states = states * (len(reset) // len(states))
        out |= {"failures": [x[0] for x in states], "until": [float(x[1]) for x in states], "reset": reset}
    return out


def _join_segments(a: dict, b: dict) -> dict:
    """The summary of segment a followed by segment b."""
    if not a["failures"]:
        return b | {"first": a["first"], "lead": max(a["lead"], b["lead"])}
    out: dict = {"first": a["first"], "lead": a["lead"], "failures": [], "until": [], "reset": []}
    for n, until, reset in zip(a["failures"], a["until"], a["reset"]):
        m, then = _after((n, until), b)
        out["failures"].append(m)
        out["until"].append(then)
        out["reset"].append(bool(reset or _resets((n, until), b)))
    return out


def _start(state: tuple[int, float], s: dict) -> int:
    """The number of failures with which a state enters a segment's first failure."""
    return 0 if s["lead"] >= state[1] else state[0]


def _resets(state: tuple[int, float], s: dict) -> bool:
    return s["lead"] >= state[1] or (len(s["failures"]) > 0 and bool(s["reset"][min(state[0], LONGEST)]))


def _after(state: tuple[int, float], s: dict) -> tuple[int, float]:
    """The state after a segment."""
    n = _start(state, s)
    if not len(s["failures"]):
        return (0, 0.0) if s["lead"] >= state[1] else state
    i = min(n, LONGEST)
    return int(s["failures"][i]) + (0 if s["reset"][i] else n - i), float(s["until"][i])


def segments(samples: DataFrame) -> DataFrame:
    """Summaries of runs of samples, dealt by ranges of source and id: one or a few of each source in each range."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, now = None, None
        for pdf in batches:
            for at in np.split(np.arange(len(pdf)), np.flatnonzero(pdf["source"].to_numpy()[1:] != pdf["source"].to_numpy()[:-1]) + 1):
                if not len(at):
                    continue
                part = pdf.iloc[at]
                one = _segment(part["id"].to_numpy(), part["at"].to_numpy(), part["failed"].to_numpy(bool))
                if now is not None and part["source"].iloc[0] == source:
                    now = _join_segments(now, one)
                    continue
                if now is not None:
                    yield pd.DataFrame([{"source": source} | now])
                source, now = part["source"].iloc[0], one
        if now is not None:
            yield pd.DataFrame([{"source": source} | now])

    rows = samples.select("source", "id", (F.unix_micros("at") / 1e6).alias("at"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return _in_ranges(rows).mapInPandas(fold, _SUMMARY)


def _in_ranges(rows: DataFrame) -> DataFrame:
    return rows.filter("source IS NOT NULL").repartitionByRange("source", "id").sortWithinPartitions("source", "id")


#: Columns of the tables that circuit_breaker() and poll_cadence() keep, by source.
BREAKER, CADENCE = "source string, failures bigint, cooling_until double", "source string, interval bigint, streak bigint"


def circuit_breaker(samples: DataFrame, table: SnapshotTable, home: str) -> SnapshotTable:
    """T4: the state of each source (columns BREAKER) after samples (source, id, at, failed), rows of a batch in order of id.

    A batch is folded in ranges of (source, id) on all tasks; a source's own task gets one row for each range only.
    """

    def fold(key: tuple, parts: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        state = (int(before["failures"].iloc[0]), float(before["cooling_until"].iloc[0])) if len(before) else (0, 0.0)
        for s in parts.sort_values("first").to_dict("records"):
            state = _after(state, s)
        return pd.DataFrame({"source": [key[0]], "failures": [state[0]], "cooling_until": [state[1]]} if len(parts) else {"source": [], "failures": [], "cooling_until": []})

    def step(batch: DataFrame, old: DataFrame, number: int) -> tuple[DataFrame, None]:
        return segments(batch).groupBy("source").cogroup(old.groupBy("source")).applyInPandas(fold, BREAKER), None

    return fold_into(samples, table, home, step)


#: Factors of a poll interval after a failure and a change, without one, and per poll without one in a row (STREAK at most).
FAILURE, CHANGE, UNCHANGED, PER_POLL, STREAK, LEAST = 1.5, 0.75, 1.1, 0.02, 5, 60


def cadence_step(interval: np.ndarray, streak: np.ndarray, outcome: str, base: int) -> tuple[np.ndarray, np.ndarray]:
    """T5: the next poll intervals and numbers of polls in a row without a change (STREAK stands for all above it)."""
    if outcome == "failure":
        interval, streak = np.minimum(4 * base, np.round(np.maximum(interval, base) * FAILURE)), np.zeros_like(streak)
    elif outcome == "change":
        interval, streak = np.maximum(base // 2, np.round(interval * CHANGE)), np.zeros_like(streak)
    else:
        streak = np.minimum(streak + 1, STREAK)
        interval = np.minimum(4 * base, np.round(interval * (UNCHANGED + streak * PER_POLL)))
    return np.maximum(LEAST, interval).astype(np.int64), streak


def poll_cadence(samples: DataFrame, table: SnapshotTable, home: str, base: int = 300) -> SnapshotTable:
    """T5: interval and streak of each source (columns CADENCE) after samples (source, id, outcome), from base (LEAST seconds at
    least) and 0 on.

    There are few states (intervals of LEAST to 4 * base seconds, streaks up to STREAK), so a range of samples is folded for
    all of them at once, on all tasks; a source's own task gets one row for each range only.
    """
    width, most = STREAK + 1, max(LEAST, 4 * base)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = np.arange(LEAST, most + 1).repeat(width), np.tile(np.arange(width), most + 1 - LEAST)
        source, now, first = None, every, 0
        row = lambda: pd.DataFrame({"source": [source], "first": [first], "interval": [now[0]], "streak": [now[1]]})
        for pdf in batches:
            for key, n, outcome in zip(pdf["source"], pdf["id"], pdf["outcome"]):
                if key != source:
                    if source is not None:
                        yield row()
                    source, now, first = key, every, n
                now = cadence_step(*now, outcome, base)
                if len(now[0]) > 1 and (now[0] == now[0][0]).all() and (now[1] == now[1][0]).all():
                    now = now[0][:1], now[1][:1]  # whatever the state was before
        if source is not None:
            yield row()

    def join(key: tuple, parts: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        interval, streak = (int(before["interval"].iloc[0]), int(before["streak"].iloc[0])) if len(before) else (max(LEAST, base), 0)
        for p in parts.sort_values("first").itertuples():
            i = (interval - LEAST) * width + streak if len(p.interval) > 1 else 0
            interval, streak = int(p.interval[i]), int(p.streak[i])
        return pd.DataFrame({"source": [key[0]], "interval": [interval], "streak": [streak]} if len(parts) else {"source": [], "interval": [], "streak": []})

    def step(batch: DataFrame, old: DataFrame, number: int) -> tuple[DataFrame, None]:
        parts = _in_ranges(batch.select("source", "id", "outcome")).mapInPandas(fold, "source string, first bigint, interval array<bigint>, streak array<bigint>")
        return parts.groupBy("source").cogroup(old.groupBy("source")).applyInPandas(join, CADENCE), None

    return fold_into(samples, table, home, step)
