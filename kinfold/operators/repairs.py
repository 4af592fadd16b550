"""Repairs of a whole catalog: a plan of typed actions over its tables (I17) and its application to all of them.

A catalog is a dictionary of tables:
    series: id, title, status                          identities: id, series_id, source, source_id, url, title, metadata
    chapters: id, series_id, number, title             releases: id, identity_id, chapter_id, number, title, url
    files: id, release_id, chapter_id, active          jobs: id, release_id
    progress: chapter_id, state                        activity: id, series_id, chapter_id, job_id
A plan has rows (key, category, action, row_id, target_id, after).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators.audit import empty_metadata, provider_collision, sourceless_series
from kinfold.operators.windows import first_row, with_positions
from kinfold.session import Tables

C = F.col
Catalog = dict[str, DataFrame]
#: Titles and numbers of releases that stand for no chapter of their own.
PREFIX, TEMPLATE, HELPER = r"(?i)^\s*latest:\s*(.*)$", r"(?i)\{\{\s*(?:number|date)\s*\}\}", r"(?i)^(?:first|latest)\s+chapter$"
REMOVALS = ("quarantine_release", "consolidate_release")


def _actions(rows: DataFrame, category: str, action: str | Column, target: Column | None = None, after: Column | None = None) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    named = F.lit(action) if isinstance(action, str) else action
    return rows.select(F.lit(category).alias("category"), named.alias("action"), C("id").cast("bigint").alias("row_id"), (none("bigint") if target is None else target.cast("bigint")).alias("target_id"), (none("string") if after is None else after.cast("string")).alias("after"))


def release_actions(releases: DataFrame, collisions: DataFrame) -> DataFrame:
    """The one removal, if any, of each release: (id, action, target), and its title without a prefix (title_after).

    A release with a template in title or address is put aside. One that is named a helper, or whose address gives another
    number than its own, joins the release of the number that address (or title) gives; one that comes over from a
    consolidated identity joins what its new identity has of its number. Targets are sound releases of a chapter only, those
    of the kept identity before others, then the least id: so no target is itself removed, whatever else is planned.
    """
    merged = collisions.filter("action = 'consolidate'").select(C("id").alias("identity_id"), "kept")
    rows = releases.join(merged, "identity_id", "left").withColumn("moved", C("kept").isNotNull()).withColumn("owner", F.coalesce("kept", "identity_id"))
    title, url = F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))
    own = T.canonical_number(F.coalesce("number", F.lit("")))
    rows = rows.withColumn("helper", F.trim(F.coalesce("number", F.lit(""))).rlike(HELPER) | F.trim(title).rlike(HELPER))
    rows = rows.withColumn("said", T.canonical_number(F.when(C("helper"), T.url_number(url, title)).otherwise(T.url_number(url, F.lit(""))))).withColumn("own", own)
    rows = rows.withColumn("template", title.rlike(TEMPLATE) | url.rlike(TEMPLATE))
    rows = rows.withColumn("stray", C("helper") | F.coalesce((C("own") != "") & (C("said") != C("own")), F.lit(False)))
    sound = rows.filter("NOT template AND NOT stray AND chapter_id IS NOT NULL")
    best = sound.groupBy("owner", "own").agg(F.min(F.struct("moved", "id")).alias("best")).select("owner", C("own").alias("wanted"), C("best.id").alias("best"))
    rows = rows.withColumn("wanted", F.when(C("stray"), C("said")).when(C("moved") & C("chapter_id").isNotNull(), C("own")))
    rows = rows.join(best, ["owner", "wanted"], "left")
    joins = C("best").isNotNull() & (C("best") != C("id"))
    action = F.when(C("template"), "quarantine_release").when(joins, "consolidate_release")
    after = F.when(title.rlike(PREFIX), F.regexp_extract(title, PREFIX, 1))
    return rows.select("id", action.alias("action"), F.when(~C("template") & joins, C("best")).alias("target"), after.alias("title_after"))


def _orphan_references(c: Catalog) -> list[DataFrame]:
    """Activity that names a series, chapter or job that isn't there."""
    out = []
    for column, parent in (("series_id", "series"), ("chapter_id", "chapters"), ("job_id", "jobs")):
        lost = c["activity"].filter(C(column).isNotNull()).join(c[parent].select(C("id").alias(column)), column, "left_anti")
        out.append(_actions(lost, "integrity", "null_reference", after=F.lit(column)))
    return out


def plan_repairs(c: Catalog, tables: Tables) -> DataFrame:
    """I17 over I13-I16 and orphaned activity: all actions, sorted, each with a key that is the same on every run.

    Series that nothing provides are deleted if they are untracked and have no chapters once the other actions are done."""
    collisions = tables.write(provider_collision(c["identities"]), "collisions")
    found = tables.write(release_actions(c["releases"], collisions), "release-actions")
    parts = [
        _actions(empty_metadata(c["identities"], "metadata"), "metadata", "normalize_metadata", after=F.lit("{}")),
        _actions(collisions, "identity", F.concat(C("action"), F.lit("_identity")), target=C("kept")),
        _actions(found.filter("action IS NOT NULL"), "release", C("action"), target=C("target")),
        _actions(found.filter("action IS NULL AND title_after IS NOT NULL"), "release", "remove_prefix", after=C("title_after")),
        *_orphan_references(c),
    ]
    plan = tables.write(reduce(DataFrame.unionByName, parts), "actions")
    rest = _applied(c, plan, tables, "trial")  # three tables of it are read, once each
    bare = sourceless_series(rest["series"], rest["identities"], rest["chapters"]).filter("deletable")
    plan = plan.unionByName(_actions(bare, "integrity", "delete_series"))
    said = F.concat_ws("|", "category", "action", "row_id", F.coalesce(C("target_id").cast("string"), F.lit("")), F.coalesce("after", F.lit("")))
    return tables.write(plan.withColumn("key", F.substring(F.sha2(said, 256), 1, 16)).select("key", *plan.columns), "plan")


def plan_conflicts(c: Catalog, plan: DataFrame) -> DataFrame:
    """What makes a plan, perhaps an edited one, impossible to apply: (row_id, conflict)."""
    say = lambda df, what: df.select("row_id", F.lit(what).alias("conflict"))
    removed = plan.filter(C("action").isin(*REMOVALS))
    joins, merges = plan.filter("action = 'consolidate_release'"), plan.filter("action = 'consolidate_identity'")
    target = lambda table, columns: c[table].select(C("id").alias("target_id"), *columns)
    own = c["identities"].select(C("id").alias("row_id"), "series_id", "source")
    kept = target("identities", [C("series_id").alias("__s"), C("source").alias("__p")])
    identity = plan.filter(C("action").isin("consolidate_identity", "split_identity"))
    parts = [
        say(removed.groupBy("row_id").agg(F.count("*").alias("n")).filter("n > 1"), "release_removed_twice"),
        say(identity.groupBy("row_id").agg(F.count("*").alias("n")).filter("n > 1"), "identity_moved_twice"),
        say(joins.join(target("releases", []), "target_id", "left_anti"), "no_target"),
        say(joins.join(c["releases"].filter("chapter_id IS NULL").select(C("id").alias("target_id")), "target_id", "left_semi"), "target_without_chapter"),
        say(joins.join(removed.select(C("row_id").alias("target_id")), "target_id", "left_semi"), "target_removed"),
        say(merges.join(identity.select(C("row_id").alias("target_id")), "target_id", "left_semi"), "target_removed"),
        say(merges.join(own, "row_id").join(kept, "target_id", "left").filter("__s IS NULL OR series_id <> __s OR source <> __p"), "identities_of_different_series_or_source"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def apply_plan(c: Catalog, plan: DataFrame, tables: Tables, name: str = "repaired") -> Catalog:
    """The catalog after a plan: columns edited, identities split and consolidated, releases joined or put aside, series
    deleted, lost references cleared, in this order. A plan with conflicts is refused. A plan of the result is empty.

    A split identity gets a series and chapters of its own (ids above the greatest, by order of identity and number); progress
    goes with the first identity that leaves a chapter. Of joined releases the last one with an active file gives the target
    its file, if there is any, and the first one with jobs its jobs, if the target has none. Chapters that lose their last
    release and have no files go, with their progress. Tables are written under `tables` as <name>-<table>.
    """
    if plan_conflicts(c, plan).limit(1).count():
        raise ValueError("the plan can't be applied: see plan_conflicts")
    return {k: tables.write(df, f"{name}-{k}") for k, df in _applied(c, plan, tables, name).items()}


def _applied(c: Catalog, plan: DataFrame, tables: Tables, name: str) -> Catalog:
    """The tables of apply_plan, not written yet; what several of them need is."""
    of = lambda *actions: plan.filter(C("action").isin(*actions))
    edit = lambda rows, action, column: rows.join(of(action).select(C("row_id").alias("id"), C("after").alias("__a")), "id", "left").withColumn(column, F.coalesce("__a", column)).select(*rows.columns)
    out = dict(c) | {"identities": edit(c["identities"], "normalize_metadata", "metadata"), "releases": edit(c["releases"], "remove_prefix", "title")}
    out["releases"] = out["releases"].withColumn("__old", C("chapter_id"))
    out = _split(out, of("split_identity"), tables, name)
    merged = of("consolidate_identity").select(C("row_id").alias("identity_id"), C("target_id").alias("__k"))
    releases = out["releases"].join(merged, "identity_id", "left").withColumn("identity_id", F.coalesce("__k", "identity_id")).select(*c["releases"].columns)
    places = tables.write(out["releases"].select("id", C("__old").alias("old"), "chapter_id"), f"{name}-places")
    out["identities"] = out["identities"].join(merged.select(C("identity_id").alias("id")), "id", "left_anti")

    gone = of(*REMOVALS).select(C("row_id").alias("id"), "target_id")
    to = gone.filter("target_id IS NOT NULL").join(places.select(C("id").alias("target_id"), C("chapter_id").alias("to_chapter")), "target_id").select(C("id").alias("release_id"), "target_id", "to_chapter")
    to = tables.write(to, f"{name}-joins")
    aside = gone.filter("target_id IS NULL").select(C("id").alias("release_id"))
    activity = out["activity"]
    lost_jobs = out["jobs"].join(gone.select(C("id").alias("release_id")), "release_id", "left_semi").select(C("id").alias("job_id"), F.lit(True).alias("__lost"))
    activity = activity.join(lost_jobs, "job_id", "left").withColumn("job_id", F.when(C("__lost").isNull(), C("job_id"))).select(*c["activity"].columns)
    moves = to.join(places.select(C("id").alias("release_id"), C("chapter_id").alias("from_chapter")), "release_id").filter("from_chapter <> to_chapter").groupBy(C("from_chapter").alias("chapter_id")).agg(F.min("to_chapter").alias("__to"))
    activity = activity.join(moves, "chapter_id", "left").withColumn("chapter_id", F.coalesce("__to", "chapter_id")).select(*c["activity"].columns)

    files = out["files"].join(aside, "release_id", "left_anti").join(to, "release_id", "left")
    files = files.withColumns({"__from": C("release_id"), "release_id": F.coalesce("target_id", "release_id"), "chapter_id": F.coalesce("to_chapter", "chapter_id")})
    giver = files.filter("target_id IS NOT NULL AND active").groupBy("target_id").agg(F.max("__from").alias("__giver")).withColumnRenamed("target_id", "release_id")
    files = files.drop("target_id").join(giver, "release_id", "left").withColumn("active", C("active") & (C("__giver").isNull() | (C("__giver") == C("__from")))).select(*c["files"].columns)
    jobs = out["jobs"].join(aside, "release_id", "left_anti").join(to, "release_id", "left")
    holder = jobs.select(F.coalesce("target_id", "release_id").alias("to"), F.struct(C("target_id").isNotNull(), C("release_id")).alias("who")).groupBy("to").agg(F.min("who").alias("who")).select("to", C("who.release_id").alias("release_id"))
    jobs = jobs.join(holder, "release_id", "left_semi").withColumn("release_id", F.coalesce("target_id", "release_id")).select(*c["jobs"].columns)
    left = releases.join(gone.select("id"), "id", "left_anti")

    placed = places.join(gone.select("id", F.lit(True).alias("__gone")), "id", "left")
    touched = placed.filter("__gone OR NOT old <=> chapter_id").select(F.explode(F.array("old", "chapter_id")).alias("id")).filter("id IS NOT NULL").distinct()
    dead = touched.join(placed.filter("__gone IS NULL").select(C("chapter_id").alias("id")), "id", "left_anti").join(files.select(C("chapter_id").alias("id")), "id", "left_anti")
    dead = tables.write(dead, f"{name}-dead")
    as_chapter = dead.select(C("id").alias("chapter_id"))
    deleted = of("delete_series").select(C("row_id").alias("series_id"), F.lit(True).alias("__del"))
    activity = activity.join(as_chapter.withColumn("__dead", F.lit(True)), "chapter_id", "left").join(deleted, "series_id", "left")
    activity = activity.withColumns({"chapter_id": F.when(C("__dead").isNull(), C("chapter_id")), "series_id": F.when(C("__del").isNull(), C("series_id"))})
    nulls = of("null_reference").groupBy(C("row_id").alias("id")).agg(F.collect_set("after").alias("__n"))  # three columns at most
    activity = activity.join(nulls, "id", "left")
    activity = activity.withColumns({x: F.when(~F.coalesce(F.array_contains("__n", x), F.lit(False)), C(x)) for x in ("series_id", "chapter_id", "job_id")}).select(*c["activity"].columns)
    out |= {
        "series": out["series"].join(deleted.select(C("series_id").alias("id")), "id", "left_anti"),
        "chapters": out["chapters"].join(dead, "id", "left_anti"), "releases": left, "files": files, "jobs": jobs,
        "progress": out["progress"].join(as_chapter, "chapter_id", "left_anti"), "activity": activity,
    }
    return {k: df.select(*c[k].columns) for k, df in out.items()}


def _split(c: Catalog, split: DataFrame, tables: Tables, name: str) -> Catalog:
    """Identities (row_id) under series of their own, with their chapters, files and progress."""
    most = lambda df: df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__most"))
    new = with_positions(split.select("action", C("row_id").alias("id")), ["action"], [C("id")])
    new = new.crossJoin(most(c["series"])).select(C("id").alias("identity_id"), (C("__most") + C("position")).cast("bigint").alias("new_series"))  # one row
    new = tables.write(new.join(c["identities"].select(C("id").alias("identity_id"), C("series_id").alias("old_series"), C("title").alias("__t")), "identity_id"), f"{name}-splits")
    own = new.join(c["series"].withColumnRenamed("id", "old_series"), "old_series")
    series = own.select(C("new_series").alias("id"), *(F.coalesce(F.nullif("__t", F.lit("")), "title").alias("title") if x == "title" else C(x) for x in c["series"].columns if x != "id"))
    rows = c["releases"].join(new.select("identity_id", "new_series"), "identity_id").select("id", "identity_id", "new_series", "number", C("chapter_id").alias("old"))
    fresh = rows.groupBy("new_series", "number").agg(F.min_by("old", "id").alias("like")).withColumn("__all", F.lit(1))
    fresh = with_positions(fresh, ["__all"], [C("new_series"), C("number")]).crossJoin(most(c["chapters"]))  # one row
    fresh = tables.write(fresh.select("new_series", "number", "like", (C("__most") + C("position")).cast("bigint").alias("chapter")), f"{name}-fresh")
    like = c["chapters"].select(C("id").alias("like"), *(x for x in c["chapters"].columns if x not in ("id", "series_id", "number")))
    chapters = fresh.join(like, "like", "left").select(C("chapter").alias("id"), C("new_series").alias("series_id"), "number", *(x for x in like.columns if x != "like"))
    placed = rows.join(fresh.select("new_series", C("number").alias("__n"), "chapter"), (rows["number"].eqNullSafe(C("__n"))) & (rows["new_series"] == fresh["new_series"])).select("id", "identity_id", "old", "chapter")
    placed = tables.write(placed, f"{name}-placed")
    taken = first_row(placed.filter("old IS NOT NULL"), ["old"], [C("identity_id"), F.desc("id")]).select("old", "chapter")
    taken = first_row(taken.join(c["progress"].select(C("chapter_id").alias("old")), "old", "left_semi"), ["chapter"], [C("old")]).select(C("old").alias("chapter_id"), "chapter")
    at = placed.select(C("id").alias("__r"), "chapter")
    repoint = lambda df, key: df.join(at, df[key] == C("__r"), "left").withColumn("chapter_id", F.coalesce("chapter", "chapter_id")).select(*df.columns)
    return c | {
        "series": c["series"].unionByName(series.select(*c["series"].columns)),
        "identities": c["identities"].join(new.select(C("identity_id").alias("id"), "new_series"), "id", "left").withColumn("series_id", F.coalesce("new_series", "series_id")).select(*c["identities"].columns),
        "chapters": c["chapters"].unionByName(chapters.select(*c["chapters"].columns)),
        "releases": repoint(c["releases"], "id"), "files": repoint(c["files"], "release_id"),
        "progress": c["progress"].join(taken, "chapter_id", "left").withColumn("chapter_id", F.coalesce("chapter", "chapter_id")).select(*c["progress"].columns),
    }
