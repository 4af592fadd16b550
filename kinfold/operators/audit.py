"""Integrity audits: each check is rows that break a rule; a report is the counts of several checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators.relational import ACTIVE
from kinfold.operators.windows import latest_release

C = F.col


def latest_mismatch(series: DataFrame, releases: DataFrame) -> DataFrame:
    """Series whose stored latest columns aren't those of W1, or should be empty."""
    want = latest_release(releases).select(C("series_id").alias("id"), C("id").alias("want_id"), C("number").alias("want_number"))
    return series.join(want, "id", "left").filter(~C("latest_id").eqNullSafe(C("want_id")) | ~C("latest_number").eqNullSafe(C("want_number"))).select("id", "latest_id", "want_id")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """I2."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key no parent has; null keys refer to nothing."""
    return child.filter(C(key).isNotNull()).join(parent.select(C(parent_key or key).alias(key)), key, "left_anti")


def expired(rows: DataFrame, column: str, asof: Column) -> DataFrame:
    """I4."""
    return rows.filter(C(column) < asof)


def out_of_domain(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """I5."""
    return rows.filter(~C(column).isin(values))


def excess_active(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Active rows beyond the one that is allowed."""
    n = jobs.filter(C("status").isin(*ACTIVE)).groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("excess", F.greatest(C("n") - 1, F.lit(0))).filter("excess > 0")


def obsolete_pending(decisions: DataFrame, identities: DataFrame) -> DataFrame:
    """Pending pairs whose sides are already one series."""
    from kinfold.operators.relational import pair_sides

    return pair_sides(decisions.filter("decision = 'pending'"), identities, ["series_id"]).filter("left_series_id = right_series_id").select("id")


def audit_report(checks: dict[str, DataFrame]) -> DataFrame:
    """I8: number of rows of each check, and whether all are clean: one job for the whole report."""
    rows = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in checks.items()))
    total = rows.agg((F.sum("n") == 0).alias("ok"))
    return rows.crossJoin(total)  # one row


def stage_check(jobs: DataFrame, mutating: list[str], checks: dict[str, DataFrame]) -> DataFrame:
    """The report, deferred while work that changes tables is active."""
    busy = jobs.filter(C("kind").isin(mutating) & C("status").isin(*ACTIVE)).agg((F.count("*") > 0).alias("deferred"))
    return audit_report(checks).crossJoin(busy).withColumn("status", F.when(C("deferred"), "deferred").when(C("n") == 0, "ok").otherwise("failed"))  # one row


def foreign_key_check(rules: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Every reference without a target: (rule, key). Rules: name, child, column, parent, column."""
    return reduce(DataFrame.unionByName, (orphans(c, p, k, pk).select(F.lit(name).alias("rule"), C(k).cast("string").alias("key")) for name, c, k, p, pk in rules))


def empty_metadata(rows: DataFrame, column: str) -> DataFrame:
    """Blank JSON becomes {}."""
    return rows.filter(F.trim(F.coalesce(column, F.lit(""))) == "").select("id", F.lit("{}").alias("after"))


def provider_collision(identities: DataFrame) -> DataFrame:
    """Further identities of a source in one series: consolidate if they are the first one again, else split."""
    from pyspark.sql import Window

    w = Window.partitionBy("series_id", "source").orderBy("id")
    key = T.legacy_identity(C("source_id"), C("url"))
    rows = identities.withColumn("key", key).withColumn("kept", F.first("id").over(w)).withColumn("kept_key", F.first("key").over(w))
    return rows.filter("id <> kept").select("id", "kept", F.when(C("key") == C("kept_key"), "consolidate").otherwise("split").alias("action"))


def release_rules(releases: DataFrame) -> DataFrame:
    """(id, rule) for releases (id, title, url, number) that stand for no chapter of their own or for another one."""
    evidence = T.url_number(C("url"), C("title"))
    rules = {
        "latest_prefix": F.lower("title").startswith("latest:"),
        "template_release": C("title").rlike(r"(?i)\{\{\s*(?:number|date)\s*\}\}"),
        "helper_release": F.trim("title").rlike(r"(?i)^(?:first|latest)\s+chapter$"),
        "url_number_disagreement": evidence.isNotNull() & (T.canonical_number(evidence) != T.canonical_number(C("number"))),
    }
    hits = F.array_compact(F.array(*(F.when(cond, F.lit(k)) for k, cond in rules.items())))
    return releases.select("id", F.explode(hits).alias("rule"))


def sourceless_series(series: DataFrame, identities: DataFrame, children: DataFrame) -> DataFrame:
    """I16: series without identities; deletable if untracked and childless."""
    bare = series.join(identities.select(C("series_id").alias("id")).distinct(), "id", "left_anti")
    kids = children.select(C("series_id").alias("id")).distinct().withColumn("__kids", F.lit(True))
    return bare.join(kids, "id", "left").select("id", ((C("status") == "untracked") & C("__kids").isNull()).alias("deletable"))


def repair_plan(rules: dict[str, DataFrame]) -> DataFrame:
    """Actions (key, category, row_id, after) of all rules, with a key that is the same on every run."""
    parts = [df.select(F.lit(k).alias("category"), C("id").cast("string").alias("row_id"), C("after").cast("string").alias("after")) for k, df in rules.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("key", F.substring(F.sha2(F.concat_ws("|", "category", "row_id", F.coalesce("after", F.lit(""))), 256), 1, 16)).orderBy("category", "row_id")


def apply_repairs(rows: DataFrame, plan: DataFrame, column: str, category: str) -> DataFrame:
    """The rows with the plan's values in a column; applying a plan made from the result changes nothing."""
    after = plan.filter(C("category") == category).select(C("row_id").alias("__row"), C("after").alias("__after"))
    out = rows.join(after, C("id").cast("string") == C("__row"), "left")
    return out.withColumn(column, F.coalesce("__after", C(column).cast("string"))).drop("__row", "__after")


def transition_check(jobs: DataFrame, states: list[str], max_attempts: int, asof: Column) -> DataFrame:
    """(id, rule) of forbidden combinations."""
    rules = {
        "unknown_state": ~C("status").isin(states),
        "leased_without_expiry": (C("status") == "leased") & C("lease_expires_at").isNull(),
        "attempts_out_of_bounds": (C("attempts") < 0) | (C("attempts") > max_attempts),
        "ends_before_it_begins": C("completed_at") < C("created_at"),
        "lease_in_the_past": (C("status") == "leased") & (C("lease_expires_at") < asof),
    }
    return jobs.select("id", F.explode(F.array_compact(F.array(*(F.when(cond, F.lit(k)) for k, cond in rules.items())))).alias("rule"))


def storage_reconcile(expected: DataFrame, manifest: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state of each expected row: ok, repair or missing_blob; one row of counts, orphan blobs among them).

    expected: blob_path, checksum, projection_path; manifest: path, sha256 of the files there are; known: blob_path. Several
    rows may expect a file at one path, and several volumes hold one: a row has its file if any of them has its checksum."""
    held = manifest.select("path", "sha256").distinct()

    def has(rows: DataFrame, p: str) -> DataFrame:
        files = held.select(F.col("path").alias("__path"), F.col("sha256").alias("__sum"), F.lit(True).alias(f"__{p}"))
        return rows.join(files, (F.col(f"{p}_path") == F.col("__path")) & F.col("checksum").eqNullSafe(F.col("__sum")), "left").drop("__path", "__sum")

    rows = has(has(expected, "blob"), "projection")
    state = F.when(F.col("__blob").isNull(), "missing_blob").when(F.col("__projection").isNull(), "repair").otherwise("ok")
    rows = rows.select("blob_path", "projection_path", state.alias("state"))
    count = lambda s: F.count_if(F.col("state") == s)
    numbers = rows.agg(F.count("*").alias("checked"), count("ok").alias("ok"), count("repair").alias("repair"), count("missing_blob").alias("missing_blobs"))
    blobs = held.select(F.col("path").alias("blob_path")).filter(F.col("blob_path").startswith("blobs/")).distinct()
    orphans = blobs.join(known.select("blob_path"), "blob_path", "left_anti").agg(F.count("*").alias("orphan_blobs"))
    return rows, numbers.crossJoin(orphans)  # one row each


def identity_repair_audit(identities: DataFrame, children: DataFrame, least_title: float = 0.85) -> DataFrame:
    """Groups of identities (id, series_id, source, stable, title, cover) that are revisions of one listing: the least
    title similarity and the least number of common children of any two, whether they share one cover, and whether to
    consolidate them (alike titles, and common children, a cover or a series) or to quarantine them.

    Titles are compared once for each two different ones, both ways, as the ratio of sequences has a direction. Identities
    with the same children count as one in pairs.
    """
    from kinfold.functions import text as T
    from kinfold.operators.blocking import child_profiles
    from kinfold.operators.sets import set_overlap

    keys, C = ["source", "stable"], F.col
    groups = identities.groupBy(*keys).agg(F.count("*").alias("identities"), F.count_distinct("series_id").alias("series"), F.count_distinct(F.nullif("cover", F.lit(""))).alias("covers"))
    titles = identities.select(*keys, "title").distinct()
    two = titles.alias("x").join(titles.alias("y"), F.expr("x.source = y.source AND x.stable = y.stable AND x.title <> y.title")).select("x.source", "x.stable", C("x.title").alias("a"), C("y.title").alias("b"))
    scored = two.select("a", "b").distinct().withColumn("s", T.title_similarity(C("a"), C("b")))
    worst = two.join(scored, ["a", "b"]).groupBy(*keys).agg(F.min("s").alias("title"))
    rows = identities.select("id", *keys).join(child_profiles(children), "id", "left").groupBy(*keys, "kids").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    pairs = rows.alias("x").join(rows.alias("y"), F.expr("x.source = y.source AND x.stable = y.stable AND x.id < y.id")).select("x.source", "x.stable", C("x.id").alias("a"), C("y.id").alias("b"))
    apart = pairs.join(set_overlap(pairs.select("a", "b"), children).select("a", "b", "common"), ["a", "b"]).select(*keys, "common")
    alike = rows.filter("n > 1").select(*keys, F.coalesce("kids.n", F.lit(0)).alias("common"))  # two of one set have all of it in common
    overlap = apart.unionByName(alike).groupBy(*keys).agg(F.min("common").alias("common"))
    out = groups.join(worst, keys, "left").join(overlap, keys, "left").withColumns({"title": F.coalesce("title", F.lit(1.0)), "common": F.coalesce("common", F.lit(0)), "cover_agrees": C("covers") == 1})
    safe = (C("title") >= least_title) & ((C("common") >= 1) | C("cover_agrees") | (C("series") == 1))
    return out.select(*keys, "identities", F.round("title", 4).alias("title"), "common", "cover_agrees", F.when(safe, "consolidate").otherwise("quarantine").alias("action"))


def archive_check(archives: DataFrame, members: DataFrame, metadata: DataFrame, expected: DataFrame, checked: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(path, rule) of stored archives (path, checksum, readable) that weren't checked yet (checksum): unreadable, without
    page images (members: path, member), without metadata or with another series or number than the catalog's (metadata,
    expected: path, series_id, number), in the catalog not exactly once, or of one page and a fractional number (to review).
    keys tell archives apart; where a path may hold several, all tables but the last have their checksum too, and keys names it."""
    from kinfold.functions import text as T

    C, of = F.col, list(keys)
    pages = members.filter(T.is_page_image(F.concat(F.lit("https://archive.test/"), "member"))).groupBy(*of).agg(F.count("*").alias("pages"))
    told = metadata.groupBy(*of).agg(F.min(F.struct(C("series_id").alias("s"), C("number").alias("n"))).alias("told"))
    known = expected.groupBy(*of).agg(F.count("*").alias("places"), F.min(F.struct(C("series_id").alias("s"), C("number").alias("n"))).alias("known"))
    rows = archives.join(checked.select("checksum").distinct(), "checksum", "left_anti").join(pages, of, "left").join(told, of, "left").join(known, of, "left")
    n, places = F.coalesce("pages", F.lit(0)), F.coalesce("places", F.lit(0))
    rules = {
        "unreadable": ~C("readable"),
        "no_images": C("readable") & (n == 0),
        "no_metadata": C("readable") & C("told").isNull(),
        "metadata_differs": C("readable") & C("told").isNotNull() & (places == 1) & ~C("told").eqNullSafe(C("known")),
        "places": places != 1,
        "review_single_page": C("readable") & (n == 1) & (C("known.n") % 1 != 0),
    }
    return rows.select("path", F.explode(F.array_compact(F.array(*(F.when(cond, F.lit(k)) for k, cond in rules.items())))).alias("rule"))


def import_records(files: DataFrame, completed: DataFrame, breaches: DataFrame, active: DataFrame) -> DataFrame:
    """(id, status, reason) of legacy files (id, path, series_id, chapter, checksum): resumed if completed before (id),
    invalid with the rules it breaks (breaches: path, rule; a review alone is none), else the verdict of M12 on activating it
    beside the active artifacts (series_id, chapter, checksum)."""
    from kinfold.operators.merge import activate_artifact

    C = F.col
    reasons = breaches.filter(~C("rule").startswith("review")).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("reason"))
    done = completed.select("id").distinct().withColumn("__done", F.lit(True))
    out = activate_artifact(files, active).join(done, "id", "left").join(reasons, "path", "left")
    status = F.when(C("__done"), "resumed").when(C("reason").isNotNull(), "invalid").otherwise(C("verdict"))
    return out.select("id", status.alias("status"), F.when(status == "invalid", C("reason")).otherwise("").alias("reason"))
