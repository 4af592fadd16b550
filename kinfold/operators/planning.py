"""Maintenance and work planning, table to table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators.relational import ACTIVE, WAITING, latest_unresolved_failures
from kinfold.operators.windows import best_release, first_few, first_row, latest_release, preference, with_positions

C = F.col


def snapshot_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K6: rows of old with what new says (non-null values win), and the rows that only new has; new has one row a key."""
    values = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *(C(c).alias(f"__{c}") for c in values))
    return old.join(renamed, keys, "full").select(*keys, *(F.coalesce(f"__{c}", c).alias(c) for c in values)).select(*old.columns)


def changed_listings(listing: DataFrame, known: DataFrame, asof: Column, days: int = 7) -> DataFrame:
    """Listed items (id, latest) that are new, have advanced, or whose detail is old (known: id, version, detailed_at)."""
    out = listing.join(known, "id", "left")
    return out.filter(C("version").isNull() | (T.number_key(C("latest")) > T.number_key(C("version"))) | (C("detailed_at") < asof - F.make_dt_interval(F.lit(days)))).select("id")


def upsert_children(children: DataFrame, incoming: DataFrame) -> DataFrame:
    """The last incoming row of each canonical number; titles are only filled where empty."""
    rows = first_row(incoming.withColumn("number", T.canonical_number(C("number"))), ["series_id", "number"], [F.desc("position")]).select("series_id", "number", C("title").alias("__t"))
    out = children.join(rows, ["series_id", "number"], "full")
    return out.select("series_id", "number", F.coalesce(F.nullif("title", F.lit("")), "__t", F.lit("")).alias("title"))


def split_rejected(rows: DataFrame, reason: Column, open_keys: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected ones with their reason in at most 4000 characters, once for each open key)."""
    out = rows.withColumn("reason", F.substring(reason, 1, 4000))
    return out.filter("reason IS NULL").drop("reason"), out.filter("reason IS NOT NULL").join(open_keys.select(key), key, "left_anti")


def sync_aliases(current: DataFrame, wanted: DataFrame, polluted: tuple[str, ...] = ("home", "manga list")) -> DataFrame:
    """Wanted aliases (series_id, alias, position), first of each normalised value, without polluted ones; own ones stay."""
    rows = wanted.withColumn("__n", T.normalize_title(C("alias"))).filter((C("__n") != "") & ~F.lower(F.trim("alias")).isin(*polluted))
    want = first_row(rows, ["series_id", "__n"], [C("position")]).select("series_id", "__n", "alias")
    have = current.withColumn("__n", T.normalize_title(C("alias"))).select("series_id", "__n", C("alias").alias("__old")).dropDuplicates(["series_id", "__n"])
    return want.join(have, ["series_id", "__n"], "left").select("series_id", F.coalesce("__old", "alias").alias("alias"))


def reconcile_intents(intents: DataFrame, artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """State of intents (id, state) from an artifact (id), or the status of their work (id, status)."""
    out = intents.join(artifacts.select("id").distinct().withColumn("__a", F.lit(True)), "id", "left").join(jobs.select("id", C("status").alias("__s")), "id", "left")
    state = F.when(C("__a"), "satisfied").when(C("__s").isin(*ACTIVE), "queued").when(C("__s") == "failed", "blocked").when(C("state") == "queued", "pending").otherwise(C("state"))
    return out.withColumn("state", state).drop("__a", "__s")


def fallback_release(releases: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """P8."""
    return best_release(releases.join(excluded.select("id"), "id", "left_anti"), keys)


def preferred_upgrades(held: DataFrame, releases: DataFrame, keys: list[str]) -> DataFrame:
    """P10: held releases that the best available one outranks by provider, then quality."""
    best = best_release(releases, keys).select(*keys, C("id").alias("best_id"), F.struct(preference(), C("quality")).alias("__best"))
    return held.withColumn("__own", F.struct(preference(), C("quality"))).join(best, keys).filter("__best > __own").select("id", "best_id")


def coalesce_work(jobs: DataFrame, most: int = 100) -> DataFrame:
    """One active row of each kind and key: the leased one if there is one, else the newest, with the least priority.
    batches: the batch ids that it holds, in order of arrival; those of a leased row are in flight, and what else came in waits
    in `pending`, without them. `most` ids at most in each, as a request has."""
    rows, keys = jobs.filter(C("status").isin(*ACTIVE)), ["kind", "dedupe_key"]
    leased = C("status") == "leased"
    out = rows.groupBy(*keys).agg(F.min(F.when(leased, C("id"))).alias("__leased"), F.max("id").alias("__newest"), F.min("priority").alias("priority"))
    batches = rows.filter(C("batch").isNotNull()).groupBy(*keys, "batch").agg(F.min("id").alias("at"), F.max(leased).alias("flying"))
    batches = batches.join(out.select(*keys, C("__leased").isNotNull().alias("held")), keys)
    few = lambda df, name: first_few(df, keys, "at", "batch", most).withColumnRenamed("few", name)
    out = out.select(*keys, F.coalesce("__leased", "__newest").alias("id"), "priority")
    out = out.join(few(batches.filter("flying OR NOT held"), "batches"), keys, "left").join(few(batches.filter("held AND NOT flying"), "pending"), keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("batches", "pending")})


def merge_repair_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active requests (id, status, series_id, reason, rank, key) as one a series: (requests (series_id, id, status, reason,
    pending, cancelled), keys (series_id, key, pending)). The leased request is kept as it runs, else the first; the reason is
    `merge` if there are obsolete keys, else that of the highest rank. Keys that a leased request doesn't hold itself wait for
    its next run (pending), and the request has one then."""
    rows = requests.filter(C("status").isin(*ACTIVE) & C("series_id").isNotNull()).withColumn("key", F.nullif("key", F.lit("")))
    leased = C("status") == "leased"
    keep = rows.groupBy("series_id").agg(
        F.min(F.struct(~leased, "id", "status")).alias("x"), F.count_distinct("id").alias("n"), F.count("key").alias("keys"), F.max_by("reason", F.struct(C("rank"), -C("id"))).alias("reason")
    )
    keep = keep.select("series_id", C("x.id").alias("id"), C("x.status").alias("status"), F.when(C("keys") > 0, "merge").otherwise(C("reason")).alias("reason"), (C("n") - 1).alias("cancelled"))
    held = rows.join(keep.select("series_id", C("id").alias("__id"), (C("status") == "leased").alias("__leased")), "series_id").filter("key IS NOT NULL")
    keys = held.groupBy("series_id", "key").agg((F.max("__leased") & ~F.max(C("id") == C("__id"))).alias("pending"))
    waits = keys.filter("pending").select("series_id", F.lit(True).alias("__waits")).distinct()
    return keep.join(waits, "series_id", "left").withColumn("pending", F.coalesce("__waits", F.lit(False))).drop("__waits"), keys


def bounded_backlog(jobs: DataFrame, limit: int, pool: str = "kind") -> DataFrame:
    """Leased rows and the oldest waiting ones stay, the others are cancelled."""
    out = with_positions(jobs.filter(C("status").isin(*ACTIVE)), [pool], [(C("status") != "leased").cast("int"), C("created_at"), C("id")], "__p")
    return out.withColumn("status", F.when((C("status") != "leased") & (C("__p") > limit), "cancelled").otherwise(C("status"))).drop("__p")


def stranded_operations(operations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active operations (id, status, job_id) whose work is gone or over have failed."""
    live = jobs.filter(C("status").isin(*ACTIVE)).select(C("id").alias("job_id")).withColumn("__live", F.lit(True))
    out = operations.join(live, "job_id", "left")
    return out.withColumn("status", F.when(C("status").isin("queued", "running") & C("__live").isNull(), "failed").otherwise(C("status"))).drop("__live")


def equivalent_operation(operations: DataFrame) -> DataFrame:
    """The greatest id among operations (id, action, ids) of one action on the same set of ids."""
    return operations.groupBy("action", F.array_join(F.array_sort(F.array_distinct("ids")), ",").alias("ids")).agg(F.max("id").alias("id"), F.count("*").alias("n"))


def due_polls(states: DataFrame, policies: DataFrame, asof: Column) -> DataFrame:
    """Sources to poll now (states: source, enabled, cooldown_until; policies: source, interval_seconds, polled_at)."""
    rows = states.filter(C("enabled") & (C("cooldown_until").isNull() | (C("cooldown_until") <= asof))).join(policies, "source")
    return rows.filter(C("polled_at").isNull() | (F.unix_micros(C("polled_at")) + C("interval_seconds").cast("bigint") * 1_000_000 <= F.unix_micros(asof))).select("source")


def effective_limit(limit: Column, policy: dict[str, Column], asof: Column, window: float = 60.0) -> Column:
    """How much may run at once at a source. limit: what the network allows (null: no bound); policy: columns known (whether
    there is one), expires_at, interval (seconds between requests), learned, limited_at, clean_since, cooldown (seconds),
    tier and explore_until.

    Without a policy, or with one that has expired, the limit. Else no more than the interval lets through in a window; after
    a limit signal no more than was learnt, and one more for each cooldown (five minutes at least) without a further one since;
    and during an exploration at least its tier."""
    p = policy
    seconds = lambda c: F.unix_micros(c) / 1e6
    paced = F.least(limit, F.when(p["interval"] > 0, F.greatest(F.lit(1), F.floor(F.lit(window) / p["interval"]).cast("int"))))
    grown = F.when(p["clean_since"] > p["limited_at"], F.floor(F.greatest(F.lit(0.0), seconds(asof) - seconds(p["clean_since"])) / F.greatest(F.coalesce(p["cooldown"], F.lit(0)), F.lit(300))).cast("int")).otherwise(0)
    learnt = F.least(paced, F.when(p["limited_at"].isNotNull(), F.greatest(F.lit(1), p["learned"]) + grown))
    explored = F.greatest(F.coalesce(F.nullif(learnt, F.lit(0)), F.lit(1)), F.coalesce(F.nullif(p["tier"], F.lit(0)), learnt, F.lit(1)))
    valid = F.coalesce(p["known"], F.lit(False)) & ~F.coalesce(p["expires_at"] <= asof, F.lit(False))
    return F.when(valid, F.when(p["explore_until"] > asof, explored).otherwise(learnt)).otherwise(limit)


#: Statuses that the user sets, which reading doesn't change.
BY_HAND = ("paused", "untracked")


def child_states(progress: DataFrame, known: DataFrame, asof: Column) -> DataFrame:
    """P20: reading states (child_id, state, read_at, updated_at) after progress (child_id, pages, pages_read): read with all of
    some pages, reading with a few, else unread. The time of the first reading stays while a child is read. Children without
    progress keep what is known of them."""
    out = known.join(progress.select("child_id", "pages", "pages_read", F.lit(True).alias("__p")), "child_id", "full")
    whole = (C("pages") > 0) & (C("pages_read") >= C("pages"))
    state = F.when(C("__p").isNull(), C("state")).when(whole, "read").when(C("pages_read") > 0, "reading").otherwise("unread")
    read_at = F.when(C("__p").isNull(), C("read_at")).when(whole, F.coalesce("read_at", asof))
    return out.select("child_id", state.alias("state"), read_at.alias("read_at"), F.when(C("__p").isNull(), C("updated_at")).otherwise(asof).alias("updated_at"))


def reading_state(series: DataFrame, children: DataFrame, states: DataFrame, progress: DataFrame) -> DataFrame:
    """P20: series (id, status) after states of their children (id, series_id), and how many are read and reading: caught_up with
    all read, reading with any begun, else interested; paused and untracked series, and those of which no child has progress
    (child_id), keep their status."""
    rows = children.select(C("id").alias("child_id"), "series_id").join(states.select("child_id", "state"), "child_id", "left").join(progress.select("child_id", F.lit(True).alias("__p")), "child_id", "left")
    of = rows.groupBy(C("series_id").alias("id")).agg(F.count_if(C("state") == "read").alias("read"), F.count_if(C("state") == "reading").alias("reading"), F.count("*").alias("total"), F.count("__p").alias("told"))
    out = series.select("id", "status").join(of, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("read", "reading", "total", "told")})
    earned = F.when(C("read") == C("total"), "caught_up").when((C("read") > 0) | (C("reading") > 0), "reading").otherwise("interested")
    return out.select("id", "read", "reading", "total", F.when((C("told") == 0) | C("status").isin(*BY_HAND), C("status")).otherwise(earned).alias("status"))


def backfill_latest(series: DataFrame, releases: DataFrame) -> DataFrame:
    """Latest columns set from W1; what has no release keeps its values."""
    want = latest_release(releases).select(C("series_id").alias("id"), C("id").alias("__id"), C("number").alias("__n"))
    out = series.join(want, "id", "left")
    return out.withColumn("latest_number", F.when(C("__id").isNotNull(), C("__n")).otherwise(C("latest_number"))).withColumn("latest_id", F.coalesce("__id", "latest_id")).drop("__id", "__n")


def backfill_group_keys(jobs: DataFrame) -> DataFrame:
    """Blank group keys derived from the kind."""
    derived = F.when(C("kind") == "error", F.concat_ws(":", F.lit("source"), "source")).otherwise(F.concat_ws(":", F.lit("series"), "series_id"))
    return jobs.withColumn("group_key", F.coalesce(F.nullif("group_key", F.lit("")), derived))


def sync_projections(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """P25: (series_id, chapter, action): insert, update, delete or keep."""
    out = wanted.select("series_id", "chapter", C("artifact_id").alias("w")).join(existing.select("series_id", "chapter", C("artifact_id").alias("e")), ["series_id", "chapter"], "full")
    return out.select("series_id", "chapter", F.when(C("e").isNull(), "insert").when(C("w").isNull(), "delete").when(C("w") == C("e"), "keep").otherwise("update").alias("action"))


def release_recovered(jobs: DataFrame, sources: list[str], codes: list[str], asof: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with waiting ones of recovered sources due now and their codes cleared, one event for each)."""
    hit = C("status").isin(*WAITING) & C("source").isin(sources) & C("error_code").isin(codes)
    out = jobs.withColumn("due_at", F.when(hit, F.least("due_at", asof)).otherwise(C("due_at"))).withColumn("error_code", F.when(hit, "").otherwise(C("error_code")))
    return out, jobs.filter(hit).select("id", F.lit("source_recovered").alias("event"))


def dismiss_failures(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with unresolved failures cancelled, one event for each)."""
    open_rows = latest_unresolved_failures(jobs).select("id").withColumn("__open", F.lit(True))
    out = jobs.join(open_rows, "id", "left")
    return out.withColumn("status", F.when(C("__open"), "cancelled").otherwise(C("status"))).drop("__open"), open_rows.select("id", F.lit("dismissed").alias("event"))


def chapterless_acquisition(series: DataFrame, children: DataFrame, identities: DataFrame, active_keys: DataFrame) -> DataFrame:
    """A refresh request for each usable identity of tracked series without children, but for those under way."""
    bare = series.filter("status <> 'untracked'").select(C("id").alias("series_id")).join(children.select("series_id").distinct(), "series_id", "left_anti")
    out = identities.filter((F.coalesce("source_id", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")).join(bare, "series_id", "left_semi")
    return out.select("series_id", F.concat_ws(":", "source", "id").alias("key")).join(active_keys.select("key"), "key", "left_anti")


def covers_to_change(current: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """Series (id, cover_id) whose cover isn't the first ranked one, by id."""
    best = ranked.filter("rank = 1").select(C("series_id").alias("id"), C("id").alias("best"))
    return current.join(best, "id").filter(~C("cover_id").eqNullSafe(C("best"))).orderBy("id").limit(limit)


def mark_all_read(children: DataFrame, reading: DataFrame, series_id: int, asof: Column) -> DataFrame:
    """Reading states (id, state, updated_at) with all children of a series read."""
    new = children.filter(C("series_id") == series_id).select("id", F.lit("read").alias("state"), asof.alias("updated_at"))
    return snapshot_upsert(reading, new, ["id"])


def reroute_cooling(jobs: DataFrame, releases: DataFrame, cooling: DataFrame, keys: list[str], asof: Column) -> tuple[DataFrame, DataFrame]:
    """(actions (id, action, release_id, source, due_at, attempted), attempts) of waiting jobs (id, status, source, release_id,
    preferred_only, attempted: array of sources) of cooling sources (source, retry_after): moved to the best available release
    of the same keys from a source not yet tried, due now, or waiting until the retry. Jobs for the preferred release only
    always wait. attempts has a row for each move: keys, release_id, job_id, source, outcome, retry_after, and the source and
    release that it bypasses."""
    rows = jobs.filter(C("status").isin(*WAITING)).join(cooling.select("source", "retry_after"), "source").join(releases.select(C("id").alias("release_id"), *keys), "release_id")
    rows = rows.withColumn("tried", F.array_sort(F.array_union(F.coalesce("attempted", F.array().cast("array<string>")), F.array("source"))))
    asked = rows.filter(~C("preferred_only")).select(C("id").alias("job"), *keys, "tried")
    other = asked.join(releases.filter("available"), keys).filter(~F.array_contains("tried", C("source")))
    best = first_row(other, ["job"], [preference().desc(), F.desc("quality"), F.desc("id")]).select(C("job").alias("id"), C("id").alias("__id"), C("source").alias("__source"))
    out = rows.join(best, "id", "left")
    moved = C("__id").isNotNull()
    actions = out.select("id", F.when(moved, "rerouted").otherwise("wait").alias("action"), F.coalesce("__id", "release_id").alias("release_id"), F.coalesce("__source", "source").alias("source"), F.when(moved, asof).otherwise(C("retry_after")).alias("due_at"), F.when(moved, C("tried")).otherwise(C("attempted")).alias("attempted"))
    attempts = out.filter(moved).select(*keys, C("__id").alias("release_id"), C("id").alias("job_id"), C("__source").alias("source"), F.lit("fallback_queued").alias("outcome"), "retry_after", C("source").alias("bypassed_source"), C("release_id").alias("bypassed_release_id"))
    return actions, attempts


#: Versions of payloads that can be brought up to date in place, and the current one.
COMPATIBLE_VERSIONS, CURRENT_VERSION = (1, 2, 3), 3


def audit_payload_versions(jobs: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(id, version, action) of active jobs (id, status, payload: map of strings, group_key, workflow_key): blocked if a
    required key is missing, rebuild (deferred while leased) if the version isn't compatible, regroup without group or
    workflow, upgrade if older than the current version, else preserve. No version: 1; one that isn't a number: 0."""
    said = F.nullif(C("payload")["version"], F.lit(""))
    version = F.when(said.isNull(), 1).otherwise(F.coalesce(said.try_cast("int"), F.lit(0)))
    missing = reduce(lambda a, b: a | b, (F.coalesce(C("payload")[k], F.lit("")) == "" for k in required))
    blank = lambda c: F.coalesce(C(c), F.lit("")) == ""
    action = (
        F.when(missing, "blocked")
        .when(~C("version").isin(*COMPATIBLE_VERSIONS), F.when(C("status") == "leased", "defer_rebuild").otherwise("rebuild"))
        .when(blank("group_key") | blank("workflow_key"), "regroup")
        .when(C("version") < CURRENT_VERSION, "upgrade")
        .otherwise("preserve")
    )
    return jobs.filter(C("status").isin(*ACTIVE)).withColumn("version", version.cast("int")).select("id", "version", action.alias("action"))


def normalize_payload(payload: Column, allowed: tuple[str, ...], defaults: dict[str, str]) -> Column:
    """A payload (map of strings) with its allowed keys only, the current version, and defaults for what it lacks."""
    kept = F.map_filter(payload, lambda k, v: k.isin(*allowed) & (k != "version") & v.isNotNull())
    given = F.create_map(*(F.lit(x) for k, v in {**defaults, "version": str(CURRENT_VERSION)}.items() for x in (k, v)))
    return F.map_concat(F.map_filter(given, lambda k, v: ~F.map_contains_key(kept, k)), kept)


def untrack(series: DataFrame, plans: DataFrame, intents: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plans (series_id, status), intents (id, series_id, state, job_id), jobs (id, status)) after series (id) are
    untracked: plans and open intents cancelled, and their work where it waits (what is leased runs on)."""
    gone = series.select(C("id").alias("series_id")).distinct().withColumn("__gone", F.lit(True))
    plans = plans.join(gone, "series_id", "left").withColumn("status", F.when(C("__gone"), "cancelled").otherwise(C("status"))).drop("__gone")
    hit = intents.join(gone, "series_id", "left").withColumn("__hit", F.coalesce(C("__gone") & C("state").isin("blocked", "pending", "queued"), F.lit(False)))
    work = hit.filter("__hit AND job_id IS NOT NULL").select(C("job_id").alias("id")).distinct().withColumn("__stop", F.lit(True))
    jobs = jobs.join(work, "id", "left").withColumn("status", F.when(C("__stop") & C("status").isin(*WAITING), "cancelled").otherwise(C("status"))).drop("__stop")
    return plans, hit.withColumn("state", F.when(C("__hit"), "cancelled").otherwise(C("state"))).drop("__gone", "__hit"), jobs


#: Requests that make a run worth learning from, and days until the next one by how a run ended.
USEFUL_REQUESTS, NEXT_DAYS = 100, {"limited": 30, "succeeded": 7, "inconclusive": 1}


def learn_policies(runs: DataFrame, policies: DataFrame, asof: Column) -> DataFrame:
    """Policies after one closed run of each source (runs: source, tier, requests, limited, max_retry_after; policies:
    source, job_limit, page_limit, interval, cooldown, clean_runs; a source without one starts from the least).

    A limited run puts the limits below its tier, doubles the interval and raises the cooldown to the longest retry-after;
    one of enough requests raises the limits to its tier and shortens the interval; any other changes nothing."""
    out = runs.join(policies, "source", "left")
    given = {"job_limit": 1, "page_limit": 2, "interval": 0.0, "cooldown": 0, "clean_runs": 0}
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in given.items()})
    out = out.withColumn("state", F.when(C("limited"), "limited").when(C("requests") >= USEFUL_REQUESTS, "succeeded").otherwise("inconclusive"))
    case = lambda limited, good, other: F.when(C("state") == "limited", limited).when(C("state") == "succeeded", good).otherwise(other)
    one, below = F.lit(1), C("tier") - 1
    return out.select(
        "source", "state",
        case(F.greatest(one, below), F.greatest("job_limit", "tier"), C("job_limit")).cast("int").alias("job_limit"),
        case(F.greatest(one, F.least("page_limit", F.greatest(F.lit(2), below * 2))), F.greatest("page_limit", C("tier") * 2), C("page_limit")).cast("int").alias("page_limit"),
        case(F.greatest(F.lit(0.5), C("interval") * 2), F.round(C("interval") * 0.8, 3), C("interval")).alias("interval"),
        case(F.greatest("cooldown", F.coalesce("max_retry_after", "cooldown")), C("cooldown"), C("cooldown")).cast("long").alias("cooldown"),
        case(F.lit(0), C("clean_runs") + 1, F.lit(0)).cast("int").alias("clean_runs"),
        (asof + F.make_dt_interval(case(*map(F.lit, NEXT_DAYS.values())))).alias("next_run"),
    )


#: Minutes until the next probe by failures so far, seconds after a lone success, successes in a row that end a
#: recovery, and the factor and bounds (in seconds) of the cooldown that it teaches.
PROBE_MINUTES, PROBE_AGAIN, PROBE_SUCCESSES, PROBE_FACTOR, PROBE_COOLDOWN = (1, 2, 5, 10, 20, 40, 60), 30, 2, 1.2, (60, 21_600)


def recovery_probes(probes: DataFrame) -> DataFrame:
    """What each probe (source, id, at, ok), in order of id, leads to: (source, id, wait, cooldown). A failure waits by
    the ladder of failures since the last recovery, a first success half a minute; the second in a row is a recovery: no wait,
    and a cooldown of 1.2 times the time since the first failure, within bounds (null without a failure). Running windows by
    source: the probes of a source are few, as each waits for the one before."""
    order = Window.partitionBy("source").orderBy("id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = probes.select("source", "id", "at", F.coalesce("ok", F.lit(False)).alias("ok"))
    rows = rows.withColumn("__run", F.count_if(~C("ok")).over(upto))
    run = Window.partitionBy("source", "__run").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__back", C("ok") & (F.count_if("ok").over(run) % PROBE_SUCCESSES == 0))
    rows = rows.withColumn("__epoch", F.coalesce(F.count_if("__back").over(before), F.lit(0)))
    since = Window.partitionBy("source", "__epoch").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.least(F.count_if(~C("ok")).over(since), F.lit(len(PROBE_MINUTES) - 1))
    started = F.min(F.when(~C("ok"), F.unix_micros("at"))).over(since)
    low, high = PROBE_COOLDOWN
    learnt = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.floor((F.unix_micros("at") - started) / 1_000_000) * PROBE_FACTOR))).cast("long")
    wait = F.when(C("__back"), F.lit(0)).when(C("ok"), PROBE_AGAIN).otherwise(F.get(F.lit(list(PROBE_MINUTES)), step.cast("int")) * 60)
    return rows.select("source", "id", wait.cast("long").alias("wait"), F.when(C("__back") & started.isNotNull(), learnt).alias("cooldown"))
