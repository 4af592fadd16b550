"""Canonical merge, set-based: survivors of clusters, and their children re-keyed and collapsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators.windows import first_row, preference

C = F.col
STATUS_RANK = ("untracked", "interested", "paused", "reading", "caught_up")


def status_rank(c: Column) -> Column:
    return F.coalesce(*(F.when(c == s, F.lit(i)) for i, s in enumerate(STATUS_RANK)), F.lit(-1))


def survivor(members: DataFrame) -> DataFrame:
    """M1: by cluster: the member of the best provider, most metadata, most children, lowest id; the highest status of all.
    members: cluster, id, source, filled, children, status."""
    best = F.max_by("id", F.struct(preference(), C("filled"), C("children"), -C("id")))
    return members.groupBy("cluster").agg(best.alias("survivor"), F.max_by("status", status_rank(C("status"))).alias("status"), F.count("*").alias("members"))


def remap_ids(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """M2: a key column through a mapping (old, new)."""
    m = mapping.select(C("old").alias(column), C("new").alias("__new"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(*rows.columns)


def collapse_children(children: DataFrame, key: str = "series_id", number: str = "number") -> DataFrame:
    """M3: (old, new) of children with an equal number in one series: the lowest id stays."""
    keep = children.groupBy(key, number).agg(F.min("id").alias("new"))
    return children.join(keep, [key, number]).select(C("id").alias("old"), "new")


def merge_reading(states: DataFrame, keys: list[str]) -> DataFrame:
    """M4: the furthest state wins, with its time."""
    rank = F.when(C("state") == "read", 2).when(C("state") == "reading", 1).otherwise(0)
    return states.groupBy(*keys).agg(F.max_by(F.struct("state", "updated_at"), F.struct(rank, "updated_at")).alias("x")).select(*keys, "x.*")


def merge_artifacts(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """M5: of several active artifacts of one key the lowest id stays active, the others are put aside. Artifacts of other keys
    may have the same id."""
    place = F.row_number().over(Window.partitionBy(*keys, "state").orderBy("id"))
    out = artifacts.withColumn("__place", place)
    return out.withColumn("state", F.when((C("state") == "active") & (C("__place") > 1), "quarantined").otherwise(C("state"))).drop("__place")


def merge_aliases(aliases: DataFrame, key: str = "series_id") -> DataFrame:
    """M6: one alias for each normalised value; the target's own first (own: boolean), then by text."""
    rows = aliases.withColumn("__n", T.normalize_title(C("alias")))
    return first_row(rows, [key, "__n"], [F.desc("own"), C("alias")]).drop("__n")


def merge_identities(identities: DataFrame) -> DataFrame:
    """M7: identities of one series and source become one; empty columns are filled from the others, which become
    alternate listings."""
    keep = first_row(identities, ["series_id", "source"], [C("id")])
    filled = identities.groupBy("series_id", "source").agg(F.min_by(F.when(C("description") != "", C("description")), F.when(C("description") != "", C("id"))).alias("__d"), F.array_join(F.array_sort(F.filter(F.collect_list("id"), lambda x: x.isNotNull())), ",").alias("all_ids"))
    out = keep.join(filled, ["series_id", "source"])
    return out.withColumn("description", F.coalesce(F.nullif("description", F.lit("")), "__d", F.lit(""))).drop("__d")


def move_children(children: DataFrame, identities: DataFrame, key: str = "number") -> DataFrame:
    """M7: children (identity_id, key) after identities (id, series_id, source) of one series and source have become the
    least of them: the keeper's own child of a key stays, else that of the least identity moves to it."""
    keeper = identities.groupBy("series_id", "source").agg(F.min("id").alias("keeper"))
    to = identities.join(keeper, ["series_id", "source"]).select(C("id").alias("identity_id"), "keeper")
    rows = children.join(to, "identity_id", "left").withColumn("keeper", F.coalesce("keeper", "identity_id"))
    return rows.groupBy(C("keeper").alias("identity_id"), key).agg(F.min("identity_id").alias("moved_from"))


def rewrite_json_refs(rows: DataFrame, mapping: DataFrame, column: str, field: str) -> DataFrame:
    """M8: an id inside JSON payloads through a mapping (old, new)."""
    ref = F.get_json_object(column, f"$.{field}").try_cast("bigint")
    out = rows.withColumn("__ref", ref).join(mapping.select(C("old").alias("__ref"), "new"), "__ref", "left")
    swapped = F.regexp_replace(F.col(column), F.concat(F.lit(f'("{field}"\\s*:\\s*)'), C("__ref").cast("string"), F.lit(r"\b")), F.concat(F.lit("$1"), C("new").cast("string")))
    return out.withColumn(column, F.when(C("new").isNotNull(), swapped).otherwise(C(column))).drop("__ref", "new")


def merge_preview(members: DataFrame, conflicts: DataFrame) -> DataFrame:
    """M9: survivor of each cluster, its members (id, source and number of children of each, by id), the conflicts against it
    (conflicts: cluster, conflict, which may be true alone or a text), and whether it can be merged."""
    each = members.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "source", "children"))), lambda m: F.concat_ws(":", m["id"], m["source"], m["children"])), ",").alias("summary"))
    against = conflicts.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set(C("conflict").cast("string"))), ",").alias("conflicts"))
    out = survivor(members).join(each, "cluster").join(against, "cluster", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit("")))
    return out.withColumn("can_merge", C("conflicts") == "")


def close_obsolete(decisions: DataFrame, identities: DataFrame) -> DataFrame:
    """Pending pairs whose sides share a series become accepted."""
    side = lambda p: identities.select(C("id").alias(f"{p}_id"), C("series_id").alias(f"__{p}"))
    out = decisions.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    done = (C("decision") == "pending") & (C("__left") == C("__right"))
    return out.withColumn("decision", F.when(done, "accepted").otherwise(C("decision"))).select(*decisions.columns)


def label_reviewed(decisions: DataFrame, identities: DataFrame, labels: DataFrame) -> DataFrame:
    """A training label with both titles for each reviewed decision that has none yet (labels: decision_id, label)."""
    from kinfold.operators.relational import pair_sides

    new = decisions.filter("decision <> 'pending'").select(C("id").alias("decision_id"), (C("decision") == "accepted").cast("int").alias("label"), "left_id", "right_id")
    return pair_sides(new.join(labels, ["decision_id", "label"], "left_anti"), identities, ["title"]).select("decision_id", "label", "left_title", "right_title")


def activate_artifact(incoming: DataFrame, active: DataFrame, replace: bool = False) -> DataFrame:
    """Verdict of each incoming artifact (id, series_id, chapter, checksum) against the active one."""
    now = active.select("series_id", "chapter", C("checksum").alias("__sum"))
    verdict = F.when(C("__sum").isNull(), "activated").when(C("__sum") == C("checksum"), "duplicate").when(F.lit(replace), "activated").otherwise("conflict")
    return incoming.join(now, ["series_id", "chapter"], "left").withColumn("verdict", verdict).drop("__sum")


def merge_identity_tables(identities: DataFrame, alternates: DataFrame, releases: DataFrame, aliases: DataFrame, external_ids: DataFrame, decisions: DataFrame, current: int | None = None) -> dict[str, DataFrame]:
    """M7: all tables after the identities (id, series_id, source, source_id, url, title, description, cover_url, metadata) of each
    series and source have become the least of them (columns `keeper` in `map`: old, new).

    Empty columns of a keeper are filled from the least other that has them. Each other is an alternate listing (primary_id,
    source, source_id, title, url) of its keeper afterwards, and so are its own alternates; a source's id is listed once.
    Releases (id, identity_id, release_key), external ids (identity_id, provider, value) move to the keeper unless it has one of
    their key or provider, the least identity first; `release_map` (old, new) says which releases stand for those that don't
    move. Of aliases (id, series_id, identity_id, alias) of one normalised value in a series that the others share, one stays,
    those of identities that stay first. Decisions (id, left_id, right_id) about identities that go are dropped but for
    `current`.
    """
    same = ["series_id", "source"]
    keeper = identities.groupBy(*same).agg(F.min("id").alias("new"))
    mapping = identities.join(keeper, same).filter("id <> new").select(C("id").alias("old"), "new", "source", "source_id", "title", "url")
    filled = {c: F.min_by(F.nullif(c, F.lit("")), F.when(F.nullif(c, F.lit("")).isNotNull(), C("id"))).alias(f"__{c}") for c in ("description", "cover_url", "metadata")}
    fill = identities.groupBy(*same).agg(F.min("id").alias("id"), *filled.values()).drop(*same)
    kept = identities.join(fill, "id").select(*(F.coalesce(F.nullif(c, F.lit("")), f"__{c}", c).alias(c) if c in filled else C(c) for c in identities.columns))

    to = mapping.select(C("old").alias("__old"), C("new").alias("__new"))
    moved = lambda df, c: df.join(to, df[c] == C("__old"), "left").withColumn("__from", C(c)).withColumn(c, F.coalesce("__new", c)).drop("__old")
    own = mapping.select(C("new").alias("primary_id"), "source", "source_id", "title", "url", F.lit(0).alias("__order"), C("old").alias("__from"))
    listed = moved(alternates, "primary_id").select("primary_id", "source", "source_id", "title", "url", F.lit(1).alias("__order"), "__from")
    listed = first_row(own.unionByName(listed), ["source", "source_id"], [C("__order"), C("__from")]).drop("__order", "__from")

    rows = moved(releases, "identity_id")
    best = rows.groupBy("identity_id", "release_key").agg(F.min(F.struct(C("__new").isNotNull(), C("__from"), C("id"))).alias("x"))
    rows = rows.join(best.select(C("identity_id").alias("__i"), C("release_key").alias("__r"), C("x.id").alias("__best")), (C("identity_id") == C("__i")) & C("release_key").eqNullSafe(C("__r")), "left")
    stays = C("__new").isNull() | C("release_key").isNull() | (C("id") == C("__best"))
    ids = first_row(moved(external_ids, "identity_id"), ["identity_id", "provider"], [C("__new").isNotNull(), C("__from")])
    names = moved(aliases, "identity_id").withColumn("__n", T.normalize_title(C("alias")))
    first = names.groupBy("series_id", "__n").agg(F.min(F.struct(C("__new").isNotNull(), C("id"))).alias("x")).select("series_id", "__n", C("x.id").alias("__best"))
    names = names.join(first, ["series_id", "__n"]).filter("__new IS NULL OR id = __best")
    gone = mapping.select(C("old").alias("__gone"))
    touched = decisions.select("id", F.explode(F.array("left_id", "right_id")).alias("__gone")).join(gone, "__gone", "left_semi").select("id").distinct()
    return {
        "map": mapping.select("old", "new"), "identities": kept, "alternates": listed,
        "releases": rows.filter(stays).select(*releases.columns), "release_map": rows.filter(~stays).select(C("id").alias("old"), C("__best").alias("new")),
        "external_ids": ids.select(*external_ids.columns), "aliases": names.select(*aliases.columns),
        "decisions": decisions.join(touched.filter(C("id") != F.lit(current)) if current is not None else touched, "id", "left_anti"),
    }
