"""Portable catalog documents as tables: validation, plan of an import, and its application.

series: key, title, status; sources: key (of their series), source, source_id, url; reading: key, number, state;
separations: left_source, left_id, right_source, right_id. A local catalog has identities (id, series_id, source, source_id,
url), series (id, status) and reading (series_id, number, state).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators.components import connected_components

C = F.col
#: Statuses of series; the same by strength in an import, and reading states, each stronger than the one before.
STATUSES = ("untracked", "interested", "reading", "caught_up", "paused")
IMPORT_STATUSES = ("untracked", "paused", "caught_up", "interested", "reading")
READING = ("unread", "reading", "read")


def _identity(source: str = "source", key: str = "source_id") -> Column:
    return F.concat_ws(":", source, T.normalize_source_id(C(key)))


def _rank(state: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), state), F.lit(0))


def validate_document(series: DataFrame, sources: DataFrame, separations: DataFrame, providers: tuple[str, ...], most: int = 500) -> DataFrame:
    """(row_key, rule) for every breach: title, status, source and id of the right form, http(s) addresses, at least one
    source and a provider once in a series, an identity in one series, separations of two identities that exist."""
    rule = lambda df, key, name: df.select(C(key).cast("string").alias("row_key"), F.lit(name).alias("rule"))
    outside = lambda c: C(c).isNull() | ~F.length(c).between(1, most)
    identity = sources.select("key", "source", _identity().alias("identity"))
    ends = separations.select(_identity("left_source", "left_id").alias("l"), _identity("right_source", "right_id").alias("r")).withColumn("row_key", F.concat_ws("|", "l", "r"))
    known = identity.select("identity").distinct()
    missing = ends.select("row_key", F.explode(F.array("l", "r")).alias("identity")).join(known, "identity", "left_anti").select("row_key").distinct()
    breaches = [
        rule(series.filter(outside("title")), "key", "title_length"),
        rule(series.filter(~F.coalesce(C("status").isin(*STATUSES), F.lit(False))), "key", "status_unknown"),
        rule(series.join(sources.select("key"), "key", "left_anti"), "key", "no_source"),
        rule(sources.filter(~F.coalesce(C("source").rlike("^[a-z0-9_-]{1,50}$"), F.lit(False))), "key", "source_form"),
        rule(sources.filter(~F.coalesce(C("source").isin(*providers), F.lit(False))), "key", "source_unsupported"),
        rule(sources.filter(outside("source_id")), "key", "source_id_length"),
        rule(sources.filter(~F.coalesce(C("url").rlike("(?i)^https?:"), F.lit(False))), "key", "url_scheme"),
        rule(sources.groupBy("key", "source").agg(F.count("*").alias("n")).filter("n > 1"), "key", "provider_twice"),
        rule(identity.groupBy("identity").agg(F.count_distinct("key").alias("n")).filter("n > 1"), "identity", "identity_shared"),
        rule(ends.filter("l = r"), "row_key", "separation_of_one"),
        rule(missing, "row_key", "separation_missing"),
    ]
    return reduce(DataFrame.unionByName, breaches).distinct()


def resolve_sources(sources: DataFrame, identities: DataFrame) -> DataFrame:
    """sources with id and series_id of the local identity: the exact normalised id, else the only one of its source with
    the same address; n_matches says how many of these there are. Local tables are as many as identities, so they are dealt (an
    estimate from the size of a file would send them through the driver)."""
    address = F.concat(C("source"), F.lit(":"), F.nullif(T.canonical_url(C("url")), F.lit("")))
    local = identities.select("id", "series_id", _identity().alias("i"), address.alias("u"))
    rows = sources.withColumns({"i": _identity(), "u": address})
    exact = local.groupBy("i").agg(F.min("id").alias("exact"))
    near = local.filter("u IS NOT NULL").groupBy("u").agg(F.count("*").alias("near"), F.min("id").alias("only"))
    out = rows.join(exact.hint("merge"), "i", "left").join(near.hint("merge"), "u", "left")
    n = F.when(C("exact").isNotNull(), 1).otherwise(F.coalesce("near", F.lit(0))).cast("long")
    out = out.withColumn("n_matches", n).withColumn("id", F.coalesce("exact", F.when(C("near") == 1, C("only"))))
    return out.join(identities.select("id", "series_id").hint("merge"), "id", "left").select(*sources.columns, "id", "series_id", "n_matches")


def plan_import(series: DataFrame, sources: DataFrame, separations: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of numbers: series, sources, create_series, create_sources, merge_series; conflicts as kind and key)."""
    found = resolve_sources(sources, identities)
    of = found.groupBy("key").agg(F.count("*").alias("n"), F.count_if(C("id").isNull()).alias("new"), F.count_distinct("series_id").alias("local"))
    numbers = series.select("key").join(of.hint("merge"), "key", "left").agg(
        F.count("*").alias("series"), F.sum(F.coalesce("n", F.lit(0))).alias("sources"), F.count_if(F.coalesce("local", F.lit(0)) == 0).alias("create_series"),
        F.sum(F.coalesce("new", F.lit(0))).alias("create_sources"), F.sum(F.greatest(F.coalesce("local", F.lit(0)) - 1, F.lit(0))).alias("merge_series"),
    )
    twice = found.filter("series_id IS NOT NULL").groupBy("series_id").agg(F.count_distinct("key").alias("n")).filter("n > 1").select(F.lit("claimed_twice").alias("kind"), C("series_id").cast("string").alias("key"))
    owner = sources.select(_identity().alias("i"), "key").distinct()
    ends = separations.select(_identity("left_source", "left_id").alias("l"), _identity("right_source", "right_id").alias("r")).distinct()
    both = ends.join(owner.select(C("i").alias("l"), C("key").alias("lk")).hint("merge"), "l").join(owner.select(C("i").alias("r"), C("key").alias("rk")).hint("merge"), "r").filter("lk = rk")
    merged = both.select(F.lit("merged_and_separated").alias("kind"), F.concat_ws("|", "l", "r").alias("key")).distinct()
    unclear = found.filter("n_matches > 1").select(F.lit("ambiguous").alias("kind"), _identity().alias("key")).distinct()
    return numbers, twice.union(merged).union(unclear)


def apply_import(series: DataFrame, sources: DataFrame, reading: DataFrame, separations: DataFrame, identities: DataFrame, local_series: DataFrame, local_reading: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statuses (id, status) of local series, reading (series_id, number, state), decisions (left_id, right_id, decision)).

    A status or reading state never falls below what is there; local series that one portable series names are one, the
    least id; separations are rejected pairs, whatever was decided. Series that are not here yet are left to their creation.
    A plan with conflicts is refused. Applying twice is applying once.
    """
    if plan_import(series, sources, separations, identities)[1].limit(1).count():
        raise ValueError("the document conflicts with the catalog: see plan_import")
    found = resolve_sources(sources, identities).filter("id IS NOT NULL")
    first = found.groupBy("key").agg(F.min("series_id").alias("first"))
    roots = connected_components(found.join(first.hint("merge"), "key").filter("series_id <> first").select(C("series_id").alias("a"), C("first").alias("b")))
    root = lambda df, c: df.join(roots.select(C("node").alias(c), "root").hint("merge"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    target = root(first.select("key", C("first").alias("id")), "id")
    stronger = lambda c, order: F.max_by(c, _rank(C(c), order))
    status = root(local_series.select("id", "status"), "id").unionByName(series.join(target.hint("merge"), "key").select("id", "status"))
    states = root(local_reading.select(C("series_id").alias("id"), "number", "state"), "id").unionByName(reading.join(target.hint("merge"), "key").select("id", "number", "state"))
    of = resolve_sources(separations.select(C("left_source").alias("source"), C("left_id").alias("source_id"), F.lit("").alias("url"), "right_source", "right_id"), identities).select(C("id").alias("l"), C("right_source").alias("source"), C("right_id").alias("source_id"), F.lit("").alias("url"))
    apart = resolve_sources(of, identities).filter("l <> id").select(F.least("l", "id").alias("left_id"), F.greatest("l", "id").alias("right_id")).distinct()
    kept = decisions.select("left_id", "right_id", "decision").join(apart.hint("merge"), ["left_id", "right_id"], "left_anti").unionByName(apart.withColumn("decision", F.lit("rejected")))
    return (
        status.groupBy("id").agg(stronger("status", IMPORT_STATUSES).alias("status")),
        states.groupBy(C("id").alias("series_id"), "number").agg(stronger("state", READING).alias("state")),
        kept,
    )
