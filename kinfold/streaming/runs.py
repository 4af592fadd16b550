"""Benchmark runs of providers, closed while samples come in, and probes of providers that recover: keyed state, with event-time
timers where nothing else ends a run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinfold.operators.planning import NEXT_DAYS, PROBE_AGAIN, PROBE_COOLDOWN, PROBE_FACTOR, PROBE_MINUTES, PROBE_SUCCESSES, USEFUL_REQUESTS
from kinfold.session import fresh_path

C = F.col

#: Requests and seconds after which a run closes.
RUN_REQUESTS, RUN_SECONDS = 500, 600
#: A source's policy: number of the last run, limits, pause between requests, cooldown, runs in a row without a limit.
POLICY = "number bigint, job_limit int, page_limit int, interval double, cooldown bigint, clean_runs int"
FIRST_POLICY = (0, 1, 2, 0.0, 0, 0)
#: An open run; times in microseconds, retry -1 without one.
RUN = "tier int, requests bigint, failures bigint, retry bigint, started bigint"
CLOSED = "source string, run bigint, tier int, requests bigint, failures bigint, max_retry_after bigint, started timestamp, ended timestamp, reason string, state string, job_limit int, page_limit int, interval double, cooldown bigint, clean_runs int, next_run timestamp"


def learn_step(policy: tuple, tier: int, requests: int, limited: bool, retry: int | None) -> tuple[str, tuple]:
    """How a closed run ended, and the policy after it: the rules of learn_policies for one run."""
    number, jobs, pages, interval, cooldown, clean = policy
    if limited:
        return "limited", (number + 1, max(1, tier - 1), max(1, min(pages, max(2, (tier - 1) * 2))), max(0.5, interval * 2), max(cooldown, retry or 0), 0)
    if requests >= USEFUL_REQUESTS:
        return "succeeded", (number + 1, max(jobs, tier), max(pages, tier * 2), round(interval * 0.8, 3), cooldown, clean + 1)
    return "inconclusive", (number + 1, jobs, pages, interval, cooldown, 0)


class CloseRuns(StatefulProcessor):
    """State of a source: its policy and its open run. A timer closes the run that no further sample closes."""

    def __init__(self, ceiling: int, requests: int, seconds: int):
        self.ceiling, self.most, self.span = ceiling, requests, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.policy, self.open = handle.getValueState("policy", POLICY), handle.getValueState("run", RUN)

    def _close(self, source: str, policy: tuple, run: list, ended: int, reason: str) -> tuple[tuple, tuple]:
        tier, requests, failures, retry, started = run
        state, policy = learn_step(policy, tier, requests, reason == "limit", None if retry < 0 else retry)
        at = lambda us: pd.Timestamp(us, unit="us")
        row = (source, policy[0], tier, requests, failures, None if retry < 0 else retry, at(started), at(ended), reason, state, *policy[1:], at(ended) + pd.Timedelta(days=NEXT_DAYS[state]))
        return policy, row

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in CLOSED.split(", ")])
        return out.astype({"max_retry_after": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(rows).sort_values(["us", "id"], kind="stable")
        at, failed, limited = pdf["us"].to_numpy(np.int64), pdf["failed"].to_numpy(bool), pdf["limited"].to_numpy(bool)
        retry = pdf["retry_after"].fillna(-1).to_numpy(np.int64)
        signals = np.append(np.flatnonzero(limited), len(at))
        policy = tuple(self.policy.get()) if self.policy.exists() else FIRST_POLICY
        run = list(self.open.get()) if self.open.exists() else None
        i, n, out = 0, len(at), []
        while i < n:  # once for each run
            if run is None:
                run = [min(self.ceiling, policy[1] + 1), 0, 0, -1, int(at[i])]
            due, full = run[4] + self.span, i + self.most - run[1]
            late = int(np.searchsorted(at, due))
            signal = int(signals[np.searchsorted(signals, i)]) + 1
            end = min(late, full, signal, n)
            run[1:4] = run[1] + end - i, run[2] + int(failed[i:end].sum()), max(run[3], int(retry[i:end].max(initial=-1)))
            reason = "limit" if end == signal else "requests" if end == full else "time" if end == late < n else None
            i = end
            if reason:
                policy, row = self._close(key[0], policy, run, due if reason == "time" else int(at[end - 1]), reason)
                out.append(row)
                run = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.policy.update(policy)
        if run is None:
            self.open.clear()
        else:
            self.open.update(tuple(run))
            self.handle.registerTimer(-(-(run[4] + self.span) // 1000))
        yield self._table(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.open.exists():
            run = list(self.open.get())
            policy, row = self._close(key[0], tuple(self.policy.get()), run, run[4] + self.span, "time")
            self.policy.update(policy)
            self.open.clear()
            out.append(row)
        yield self._table(out)

    def close(self) -> None:
        pass


#: State in RocksDB, which keyed state of any kind asks for.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def closed_runs(samples: DataFrame, home: str | None = None, ceiling: int = 8, requests: int = RUN_REQUESTS, seconds: int = RUN_SECONDS, late: str = "0 seconds") -> DataFrame:
    """The runs closed so far of a stream of samples (source, id, at, failed, limited, retry_after), and what each taught.

    A run begins with a sample, one tier above the limit learnt so far (at most `ceiling`). A limit signal closes it, or
    `requests` samples, or `seconds` after it began, whichever comes first; the next sample begins the next run. Samples count in
    order of time, then id; they may come `late` behind the latest of the stream, and later ones go uncounted. A run that no
    sample closes is closed by a timer when the stream's time has passed its end. Rows without source or time are left out.
    With the same home, a later call goes on with the open runs. The samples of one source in one micro-batch are sorted in
    one task: `maxFilesPerTrigger` of the stream bounds them.
    """
    spark = samples.sparkSession
    path = home or fresh_path(spark, "runs")
    flag = lambda c: F.coalesce(C(c), F.lit(False)).alias(c)
    rows = samples.filter("source IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    rows = rows.select("source", "id", "at", F.unix_micros("at").alias("us"), flag("failed"), flag("limited"), C("retry_after").cast("bigint").alias("retry_after"))
    closed = rows.groupBy("source").transformWithStateInPandas(statefulProcessor=CloseRuns(ceiling, requests, seconds), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime")

    return _kept(closed, path, CLOSED)


def _kept(rows: DataFrame, path: str, schema: str) -> DataFrame:
    """Run over what there is now with state in RocksDB; the rows of all batches so far, a batch that runs again once."""
    spark = rows.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(schema).parquet(f"{path}/out")


#: State of a source that is probed: failures since it was last well, successes since the last of them, and when they began (-1:
#: none did).
PROBED, STEPS = "failures bigint, successes bigint, started bigint", "source string, id bigint, wait bigint, cooldown bigint"


class FollowProbes(StatefulProcessor):
    """The rules of recovery_probes, probe by probe."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("probed", PROBED)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(rows).sort_values("id", kind="stable")
        failures, successes, started = self.state.get() if self.state.exists() else (0, 0, -1)
        low, high = PROBE_COOLDOWN
        out = []
        for i, at, ok in zip(pdf["id"].tolist(), pdf["us"].tolist(), pdf["ok"].tolist()):
            wait, cooldown = PROBE_AGAIN, None
            if not ok:
                failures, successes, started = failures + 1, 0, at if started < 0 else min(started, at)
                wait = PROBE_MINUTES[min(failures, len(PROBE_MINUTES) - 1)] * 60
            else:
                successes += 1
                if successes % PROBE_SUCCESSES == 0:
                    wait = 0
                    if started >= 0:
                        cooldown = max(low, min(high, int((at - started) // 1_000_000 * PROBE_FACTOR)))
                    failures, started = 0, -1
            out.append((key[0], i, wait, cooldown))
        self.state.update((failures, successes, started))
        yield pd.DataFrame(out, columns=["source", "id", "wait", "cooldown"]).astype({"cooldown": "Int64"})

    def close(self) -> None:
        pass


def probe_steps(probes: DataFrame, home: str | None = None) -> DataFrame:
    """T6 on a stream: what each probe (source, id, at, ok) so far led to (source, id, wait, cooldown), as recovery_probes says.
    Batches come in order of id; probes without source or time are left out, a null ok is a failure. With the same home, a later
    call goes on from the state of each source. Times are after 1970."""
    path = home or fresh_path(probes.sparkSession, "probes")
    rows = probes.filter("source IS NOT NULL AND at IS NOT NULL").select("source", "id", F.unix_micros("at").alias("us"), F.coalesce("ok", F.lit(False)).alias("ok"))
    steps = rows.groupBy("source").transformWithStateInPandas(statefulProcessor=FollowProbes(), outputStructType=STEPS, outputMode="Append", timeMode="None")
    return _kept(steps, path, STEPS)
