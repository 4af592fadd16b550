"""Reports by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.relational import ACTIVE, latest_unresolved_failures

C = F.col
TERMINAL = ("succeeded", "failed", "cancelled")


def group_name(group: str = "group_key", kind: str = "kind", key: str = "id") -> Column:
    """The group of a row, or a group of its own."""
    return F.coalesce(F.nullif(F.col(group), F.lit("")), F.concat_ws(":", kind, C(key).cast("string")))


def job_groups(jobs: DataFrame) -> DataFrame:
    """A1."""
    states = ("queued", "leased", "retrying", "succeeded", "failed", "cancelled")
    counts = [F.count_if(C("status") == s).alias(s) for s in states]
    return jobs.groupBy(group_name().alias("work_group")).agg(*counts, F.min("priority").alias("priority"), F.min("due_at").alias("due_at"), F.max("id").alias("last_id"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """A2."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def active_group_count(jobs: DataFrame) -> DataFrame:
    """A3."""
    return jobs.filter(C("status").isin(*ACTIVE)).agg(F.count_distinct(group_name()).alias("groups"))


def cycle_summary(jobs: DataFrame, cycle: str, units: str | None = None, coalesced: Column | None = None, dismissed: Column | None = None) -> DataFrame:
    """A4: by cycle, in units of work (1 a row without a column of them): active, succeeded, unresolved failed, cancelled,
    superseded, and the total that counts. A failure that a later attempt followed, and what was merged into other work
    (coalesced, of cancelled rows), is superseded; a failure that was dismissed (of cancelled rows) is cancelled."""
    open_failures = latest_unresolved_failures(jobs).select("id").withColumn("__open", F.lit(True))
    rows = jobs.join(open_failures, "id", "left")
    n, no = (C(units) if units else F.lit(1)), F.lit(False)
    of = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    cancelled, merged, waived = C("status") == "cancelled", no if coalesced is None else coalesced, no if dismissed is None else dismissed
    out = rows.groupBy(cycle).agg(
        of(F.lit(True)).alias("total"),
        of(C("status").isin(*ACTIVE)).alias("active"),
        of(C("status") == "succeeded").alias("succeeded"),
        of((C("status") == "failed") | (cancelled & waived)).alias("failed"),
        of(C("__open")).alias("unresolved"),
        of(cancelled & waived).alias("dismissed"),
        of(cancelled & merged).alias("coalesced"),
        of(cancelled & ~waived).alias("withdrawn"),
    )
    positive = lambda c: F.greatest(c, F.lit(0))
    out = out.withColumn("superseded", C("coalesced") + positive(C("failed") - C("unresolved") - C("dismissed")))
    out = out.withColumn("cancelled", positive(C("withdrawn") - C("coalesced")) + C("dismissed"))
    settled = C("succeeded") + C("unresolved") + C("cancelled") + C("superseded")
    return out.withColumn("effective_total", F.greatest(C("total"), settled + C("active"))).drop("withdrawn", "failed")


def retention_rollup(jobs: DataFrame, rollup: DataFrame, asof: Column, days: int = 14, batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A5: (rollup with the rows that ended more than `days` ago added, the rows that stay). Strictly before the limit;
    the oldest `batch` of them only, if given; whole seconds, never negative. Adding is additive: rows given again count again."""
    old = jobs.filter(C("status").isin(*TERMINAL) & (C("completed_at") < asof - F.make_dt_interval(F.lit(days))))
    if batch is not None:
        old = old.orderBy("completed_at", "id").limit(batch)
    seconds = F.greatest(F.floor(F.unix_micros("completed_at") / 1_000_000 - F.unix_micros("created_at") / 1_000_000), F.lit(0))
    keys = ["day", "kind", "source", "status", "error_code"]
    new = old.withColumn("day", F.to_date("completed_at")).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("attempts").cast("long").alias("attempts"), F.sum(seconds).cast("long").alias("seconds"))
    both = new.unionByName(rollup.select(*new.columns)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "attempts", "seconds")))
    return both, jobs.join(old.select("id"), "id", "left_anti")


def expire(rows: DataFrame, column: str, asof: Column, days: int) -> DataFrame:
    """What is not older than so many days (strictly)."""
    return rows.filter(~(C(column) < asof - F.make_dt_interval(F.lit(days))))


def expire_unreferenced(rows: DataFrame, column: str, asof: Column, days: int, references: DataFrame, key: str) -> DataFrame:
    """Old rows go only if nothing refers to them."""
    old = rows.filter(C(column) < asof - F.make_dt_interval(F.lit(days))).select(key).join(references.select(key), key, "left_anti")
    return rows.join(old, key, "left_anti")


def pool_depth(jobs: DataFrame, pool: str, asof: Column) -> DataFrame:
    """A7."""
    age = F.floor((F.unix_micros(asof) - F.unix_micros(F.min("created_at"))) / 1_000_000)
    return jobs.filter(C("status").isin(*ACTIVE)).groupBy(pool).agg(F.count("*").alias("depth"), age.cast("long").alias("oldest_seconds"))


def newest_mean(rows: DataFrame, key: str, value: Column, time: str, since: Column, limit: int = 5000) -> DataFrame:
    """Mean by key of the newest `limit` rows since a time (the limit is part of what is asked), negatives as 0."""
    newest = rows.filter(C(time) >= since).withColumn("__v", F.greatest(value, F.lit(0.0))).orderBy(F.desc(time), F.desc("id")).limit(limit)
    return newest.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("__v"), 6).alias("mean"))


def route_counters(log: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """A9."""
    return log.groupBy(*keys).agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in sums))


def progress_counts(children: DataFrame, reading: DataFrame, key: str = "series_id") -> DataFrame:
    """A10: children, read ones and unread ones of each series. children: id, series_id; reading: release_id, state."""
    out = children.join(reading.select(C("release_id").alias("id"), "state"), "id", "left").groupBy(key).agg(F.count("*").alias("total"), F.count_if(C("state") == "read").alias("read"))
    return out.withColumn("unread", F.greatest(C("total") - C("read"), F.lit(0)))


def plan_progress(intents: DataFrame) -> DataFrame:
    """A11. intents: plan_id, tier, state."""
    done = C("state").isin("satisfied", "cancelled")
    return intents.groupBy("plan_id").agg(
        F.count("*").alias("total"),
        F.count_if(C("state") == "satisfied").alias("satisfied"),
        F.count_if(C("state") == "blocked").alias("attention"),
        F.coalesce(F.bool_and(F.when(C("tier") == "priority", done)), F.lit(True)).alias("priority_done"),
        F.bool_and(done).alias("complete"),
    )


def multi_provider_series(identities: DataFrame) -> DataFrame:
    """A12."""
    return identities.groupBy("series_id").agg(F.count("*").alias("n")).filter("n > 1")


def reservation_summary(reservations: DataFrame, asof: Column, free: int, reserve: int) -> DataFrame:
    """A13."""
    live = F.coalesce(F.sum(F.when(C("expires_at") > asof, C("bytes"))), F.lit(0))
    out = reservations.agg(live.cast("long").alias("reserved"))
    paused = F.lit(free) - C("reserved") < F.lit(reserve)
    return out.withColumn("paused", paused).withColumn("reason", F.when(paused, "low_space").otherwise(""))


def run_summary(samples: DataFrame) -> DataFrame:
    """By run (samples: run, id, status, error_code, latency, retry_after): requests, failures (an error, or a status of
    400 and more), successes, what limited it first, in order of id, and the greatest latency and retry-after."""
    bad = (C("status") >= 400) | (F.coalesce("error_code", F.lit("")) != "")
    signal = F.trim(F.concat_ws(" ", F.lit("HTTP"), C("status").cast("string"), F.coalesce("error_code", F.lit(""))))
    return samples.groupBy("run").agg(
        F.count("*").alias("requests"), F.count_if(bad).alias("failures"), F.count_if(~bad).alias("successes"), F.min(F.when(bad, C("id"))).alias("first_limit"),
        F.coalesce(F.min_by(F.when(bad, signal), F.when(bad, C("id"))), F.lit("")).alias("limiting_signal"), F.max("latency").alias("max_latency"), F.max("retry_after").alias("max_retry_after"),
    )


def nested_series(series: DataFrame, identities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Series with their sources and aliases as sorted arrays."""
    src = identities.groupBy(C("series_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "id"))), lambda s: F.concat_ws(":", s["source"], s["id"])), ",").alias("sources"))
    ali = aliases.groupBy(C("series_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))
    return series.join(src, "id", "left").join(ali, "id", "left").select("id", "title", F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("aliases", F.lit("")).alias("aliases"))


def revision_consensus(listings: DataFrame, least: int = 3) -> DataFrame:
    """The commonest revision by distinct listings, if there are enough; ties to the one seen first. listings: source, revision, item, position."""
    n = listings.groupBy("source", "revision").agg(F.count_distinct("item").alias("n"), F.min("position").alias("position"))
    return n.groupBy("source").agg(F.max_by("revision", F.struct(C("n"), -C("position"))).alias("revision"), F.max("n").alias("n")).filter(C("n") >= least)


def storage_health(artifacts: DataFrame, blobs: DataFrame, projections: DataFrame) -> DataFrame:
    """One row of counts."""
    active = artifacts.filter(C("state") == "active")
    parts = [active.agg(F.count("*").alias("active")), artifacts.join(blobs, "checksum", "left_anti").agg(F.count("*").alias("without_blob")), active.select(C("id").alias("artifact_id")).join(projections, "artifact_id", "left_anti").agg(F.count("*").alias("without_projection"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def group_progress(jobs: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """By work group: done, total and percent, half to even, over all statuses of its rows; where a plan stands for a
    group (plans: work_group, satisfied, total), its counters take their place."""
    out = jobs.groupBy(group_name().alias("work_group")).agg(F.count_if(C("status").isin(*TERMINAL)).alias("done"), F.count("*").alias("total"))
    if plans is not None:
        counters = plans.select("work_group", C("satisfied").alias("__done"), C("total").alias("__total"))
        out = out.join(counters, "work_group", "left").select("work_group", F.coalesce("__done", "done").alias("done"), F.coalesce("__total", "total").alias("total"))
    return out.withColumn("percent", F.bround(100.0 * C("done") / C("total"), 0).cast("int"))
