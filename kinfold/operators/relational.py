"""Predicates, semi- and anti-joins, and joins of the catalog's tables. Every time is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.sets import key_pairs

C = F.col
ACTIVE = ("queued", "leased", "retrying")
WAITING = ("queued", "retrying")


def search(series: DataFrame, aliases: DataFrame, identities: DataFrame, term: str, sources: list[str]) -> DataFrame:
    """Series whose title, or an alias of which, contains the term in any case, with an identity of one of the sources.
    % and _ in the term are wildcards. series: id, title; aliases: series_id, alias; identities: series_id, source."""
    like = f"%{term}%"
    named = aliases.filter(C("alias").ilike(like)).select(C("series_id").alias("id")).distinct().withColumn("__named", F.lit(True))
    listed = identities.filter(C("source").isin(sources)).select(C("series_id").alias("id")).distinct()
    found = series.join(named, "id", "left").filter(C("title").ilike(like) | F.coalesce("__named", F.lit(False))).drop("__named")
    return found.join(listed, "id", "left_semi")


def latest_unresolved_failures(jobs: DataFrame, keys: tuple[str, ...] = ("kind", "dedupe_key"), order: str = "id") -> DataFrame:
    """R2: failed rows without a later row of the same keys."""
    last = F.max(order).over(Window.partitionBy(*keys))
    return jobs.withColumn("__last", last).filter((C("status") == "failed") & (C(order) == C("__last"))).drop("__last")


def merge_blocking_work(jobs: DataFrame, kinds: list[str], path: str, harmless: str) -> DataFrame:
    """Active rows of some kinds, but for those whose payload names the harmless action."""
    action = F.coalesce(F.get_json_object("payload", path), F.lit(""))
    return jobs.filter(C("status").isin(*ACTIVE) & C("kind").isin(kinds) & (action != harmless))


def blocked_sources(states: DataFrame, asof: Column) -> DataFrame:
    return states.filter(~F.coalesce("enabled", F.lit(True)) | F.coalesce(C("cooldown_until") > asof, F.lit(False))).select("source")


def runnable_or_live(jobs: DataFrame, states: DataFrame, asof: Column, max_attempts: int = 3, paused: bool = False) -> DataFrame:
    """By series, whether any row could run now (due, attempts left, source open, storage not paused) or has a live lease."""
    blocked = blocked_sources(states, asof).withColumn("__blocked", F.lit(True))
    out = jobs.join(blocked, "source", "left")
    runnable = C("status").isin(*WAITING) & (C("due_at") <= asof) & (C("attempts") < max_attempts) & C("__blocked").isNull() & F.lit(not paused)
    live = (C("status") == "leased") & (C("lease_expires_at") > asof)
    return out.groupBy("series_id").agg(F.bool_or(runnable | live).alias("active"))


def ready_work(jobs: DataFrame, states: DataFrame, asof: Column, limit: int, max_attempts: int = 3) -> DataFrame:
    """Rows that may run, in the order in which they should: priority, load of their group, due time, id."""
    blocked = blocked_sources(states, asof)
    live = jobs.filter((C("status") == "leased") & (C("lease_expires_at") > asof))
    conflict = live.select("series_id", "kind").distinct()
    load = live.groupBy("group_key").agg(F.count("*").alias("group_load"))
    due = C("status").isin(*WAITING) & (C("due_at") <= asof) | (C("status") == "leased") & (C("lease_expires_at") <= asof)
    ready = jobs.filter(due & (C("attempts") < max_attempts)).join(blocked, "source", "left_anti").join(conflict, ["series_id", "kind"], "left_anti")
    ready = ready.join(load, "group_key", "left").withColumn("group_load", F.coalesce("group_load", F.lit(0)))
    return ready.orderBy("priority", "group_load", "due_at", "id").limit(limit)


def pending_sync(series: DataFrame, projections: DataFrame, synced: DataFrame, stale_before: Column, limit: int) -> DataFrame:
    """Tracked series with a projection, never synchronised or not since stale_before; the longest ago first."""
    tracked = series.filter(C("status") != "untracked").join(projections.select(C("series_id").alias("id")).distinct(), "id", "left_semi")
    due = tracked.join(synced, "id", "left").filter(C("synced_at").isNull() | (C("synced_at") < stale_before))
    return due.orderBy(C("synced_at").asc_nulls_first(), "id").limit(limit)


def pending_projection_repair(series: DataFrame, artifacts: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Tracked series with an active artifact that lacks either projection."""
    active = artifacts.filter(C("state") == "active").select(C("id").alias("artifact_id"), "series_id")
    lacking = active.join(first, "artifact_id", "left_anti").unionByName(active.join(second, "artifact_id", "left_anti"))
    return series.filter(C("status") != "untracked").join(lacking.select(C("series_id").alias("id")), "id", "left_semi")


def pending_signatures(identities: DataFrame, signatures: DataFrame, exhausted: DataFrame, algorithm: str) -> DataFrame:
    """Identities whose signature is absent, of another algorithm or without bands, and not given up (exhausted: key)."""
    from kinfold.functions.text import revision_hash

    out = identities.join(signatures.select("id", "algorithm", "bands"), "id", "left")
    out = out.filter(C("algorithm").isNull() | (C("algorithm") != algorithm) | C("bands").isNull())
    return out.withColumn("key", revision_hash(F.lit(algorithm), C("url"))).join(exhausted, "key", "left_anti").select("id", "key")


def pending_rescore(decisions: DataFrame, version: str, limit: int) -> DataFrame:
    """Series of pending decisions scored by another version, in the order first seen."""
    stale = decisions.filter((C("decision") == "pending") & ~F.get_json_object("evidence", "$.version").eqNullSafe(F.lit(version)))
    return stale.groupBy("series_id").agg(F.min("id").alias("first_id")).orderBy("first_id").limit(limit)


def recoverable_failures(jobs: DataFrame, codes: list[str], pattern: str) -> DataFrame:
    """Failed rows of some codes, or whose message matches, without a later success of the same key."""
    failed = jobs.filter((C("status") == "failed") & (C("error_code").isin(codes) | C("message").rlike(pattern)))
    success = jobs.filter(C("status") == "succeeded").groupBy("kind", "dedupe_key").agg(F.max("id").alias("__ok"))
    return failed.join(success, ["kind", "dedupe_key"], "left").filter(C("__ok").isNull() | (C("__ok") < C("id"))).drop("__ok")


def fresh_workers(beats: DataFrame, asof: Column, within: str = "INTERVAL '5' MINUTE") -> DataFrame:
    """R11."""
    return beats.filter(C("seen_at") >= asof - F.expr(within)).orderBy(F.desc("seen_at"), "worker")


def tracked_not_observed(tracked: DataFrame, observed: DataFrame, truncated: DataFrame) -> DataFrame:
    """Tracked (id, source) absent from the listing; only for sources whose scan was cut short (truncated: source, flag)."""
    cut_short = truncated.filter("flag").select("source")
    return tracked.join(cut_short, "source", "left_semi").join(observed.select("id"), "id", "left_anti")


def left_missing_or(left: DataFrame, right: DataFrame, on: str, column: str, value: str) -> DataFrame:
    """Rows of left without a partner, or whose partner has another value."""
    return left.join(right.select(on, column), on, "left").filter(C(column).isNull() | (C(column) != value))


def missing_partner(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """J3."""
    return left.join(right.select(*on), on, "left_anti")


def pair_sides(pairs: DataFrame, items: DataFrame, columns: list[str], key: str = "id", left: str = "left_id", right: str = "right_id") -> DataFrame:
    """A pair table with the columns of both sides, prefixed."""
    one = lambda side, k: items.select(C(key).alias(k), *(C(c).alias(f"{side}_{c}") for c in columns))
    return pairs.join(one("left", left), left).join(one("right", right), right)


def touching(pairs: DataFrame, ids: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Pairs with either side in ids (id): pairs become two directed rows, so the join stays an equality."""
    directed = pairs.withColumn("id", F.explode(F.array(left, right)))
    return directed.join(ids.select("id").distinct(), "id", "left_semi").select(*pairs.columns).distinct()


def tuple_member(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """J6."""
    return rows.join(keys.select(*on), on, "left_semi")


def with_later_row(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Rows that a later one of the same keys follows, by a window instead of a self-join."""
    return rows.withColumn("__last", F.max(order).over(Window.partitionBy(*keys))).filter(C(order) < C("__last")).drop("__last")


def band_pairs(signatures: DataFrame, bands: int = 4, width: int = 12) -> DataFrame:
    """Pairs (a < b) that agree in any hash band or in the beginning of the title. signatures: id, bands (array), title."""
    keys = F.concat(F.transform(C("bands"), lambda x, i: F.concat_ws(":", i, x)), F.array(F.concat(F.lit("t:"), F.substring("title", 1, width))))
    return key_pairs(signatures.select("id", F.explode(F.array_distinct(keys)).alias("key")), ["key"])


def differs(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~a.eqNullSafe(b)
