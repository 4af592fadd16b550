"""A whole catalog as a portable document and back: export (X1), validation (P3) and import with creation.

A document is a dictionary of tables; key names a series of it:
    series: key, title, status, description, downloaded          series_aliases: key, alias
    sources: key, source, source_id, title, url, description, revision
    source_aliases: key, source, alias      external_ids: key, source, provider, value
    alternates: key, source, source_id, title, url               reading: key, chapter, state, read_at
    separations: left_source, left_id, right_source, right_id    providers: source, enabled
A catalog:
    series: id, title, description, status      identities: id, series_id, source, source_id, title, url, description, revision
    aliases: series_id, identity_id (null: the series' own), alias
    external_ids: identity_id, provider, value  alternates: identity_id, source, source_id, title, url
    chapters: id, series_id, number             reading: chapter_id, state, read_at
    artifacts: chapter_id, state                decisions: left_id, right_id, decision      providers: source, enabled
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators.components import connected_components
from kinfold.operators.portable import IMPORT_STATUSES, READING, _identity, _rank, plan_import, resolve_sources, validate_document
from kinfold.operators.sets import portable_selection, portable_separations
from kinfold.operators.windows import first_row, with_positions
from kinfold.session import Tables, write_table

C = F.col
Catalog = dict[str, DataFrame]
Document = dict[str, DataFrame]


def export_catalog(c: Catalog) -> Document:
    """The series that U2 selects and that have a source, with all that belongs to them. Untracked series that hold an
    active artifact are exported as interested. Unread chapters without a time are left out; of separations those with both
    ends exported."""
    held = c["artifacts"].filter("state = 'active'").join(c["chapters"].select(C("id").alias("chapter_id"), "series_id"), "chapter_id").select("series_id", "state")
    chosen = portable_selection(c["series"], held, c["identities"], c["decisions"]).join(c["identities"].select(C("series_id").alias("id")), "id", "left_semi")
    chosen = write_table(chosen, "chosen")  # six tables look at it
    has = held.select(C("series_id").alias("id"), F.lit(True).alias("__held")).distinct()
    series = c["series"].join(chosen, "id", "left_semi").join(has, "id", "left").withColumn("downloaded", F.coalesce("__held", F.lit(False)))
    status = F.when((C("status") == "untracked") & C("downloaded"), "interested").otherwise(C("status"))
    key = C("series_id").cast("string").alias("key")
    own = c["identities"].join(chosen.select(C("id").alias("series_id")), "series_id", "left_semi").join(c["series"].select(C("id").alias("series_id"), C("title").alias("__t")), "series_id", "left")
    of = own.select(C("id").alias("identity_id"), key, C("source").alias("own_source"))
    reading = c["reading"].filter("state <> 'unread' OR read_at IS NOT NULL").join(c["chapters"].select(C("id").alias("chapter_id"), "series_id", "number"), "chapter_id")
    none = lambda x: F.coalesce(x, F.lit(""))
    return {
        "series": series.select(C("id").cast("string").alias("key"), "title", status.alias("status"), none("description").alias("description"), "downloaded"),
        "series_aliases": c["aliases"].filter("identity_id IS NULL").join(chosen.select(C("id").alias("series_id")), "series_id", "left_semi").select(key, "alias"),
        "sources": own.select(key, "source", "source_id", F.coalesce(F.nullif("title", F.lit("")), "__t").alias("title"), "url", none("description").alias("description"), none("revision").alias("revision")),
        "source_aliases": c["aliases"].join(of, "identity_id").select("key", C("own_source").alias("source"), "alias"),
        "external_ids": c["external_ids"].join(of, "identity_id").select("key", C("own_source").alias("source"), "provider", "value"),
        "alternates": c["alternates"].drop("source").join(of, "identity_id").select("key", C("own_source").alias("source"), "source_id", "title", "url"),
        "reading": reading.join(chosen.select(C("id").alias("series_id")), "series_id", "left_semi").select(key, C("number").alias("chapter"), "state", "read_at"),
        "separations": portable_separations(c["decisions"], c["identities"], chosen.join(c["series"].select("id"), "id", "left_semi")),
        "providers": c["providers"].select("source", "enabled"),
    }


def validate(d: Document, providers: tuple[str, ...], unknown: DataFrame | None = None) -> DataFrame:
    """(row_key, rule) for every breach: the rules of validate_document, and the forms of titles, addresses, revisions,
    aliases, external ids, alternates, reading states and provider preferences. unknown: (row_key, name) of fields that a
    document shouldn't have, as its reader found them."""
    rule = lambda df, key, name: df.select((C(key) if isinstance(key, str) else key).cast("string").alias("row_key"), F.lit(name).alias("rule"))
    outside = lambda c, low, high: C(c).isNull() & F.lit(low > 0) | ~F.coalesce(F.length(c).between(low, high), F.lit(low == 0))
    link = lambda c: ~F.coalesce(C(c).rlike("(?i)^https?:"), F.lit(False))
    at = F.concat_ws("|", "key", "source")
    aliases = d["series_aliases"].select("key", "alias").unionByName(d["source_aliases"].select(at.alias("key"), "alias"))
    breaches = [
        validate_document(d["series"], d["sources"], d["separations"], providers),
        rule(d["sources"].filter(outside("title", 1, 500)), at, "source_title_length"),
        rule(d["sources"].filter(outside("url", 1, 4096)), at, "url_length"),
        rule(d["sources"].filter(outside("revision", 0, 20)), at, "revision_length"),
        rule(aliases.filter(outside("alias", 1, 500)), "key", "alias_length"),
        rule(d["external_ids"].filter(outside("provider", 1, 50) | outside("value", 1, 200)), at, "external_id_form"),
        rule(d["external_ids"].groupBy("key", "source", "provider").agg(F.count("*").alias("n")).filter("n > 1"), at, "external_id_twice"),
        rule(d["alternates"].filter(outside("source_id", 1, 500)), at, "alternate_id_length"),
        rule(d["alternates"].filter(outside("title", 0, 500)), at, "alternate_title_length"),
        rule(d["alternates"].filter(outside("url", 0, 4096)), at, "alternate_url_length"),
        rule(d["alternates"].filter((F.coalesce("url", F.lit("")) != "") & link("url")), at, "alternate_url_scheme"),
        rule(d["reading"].filter(outside("chapter", 1, 100)), "key", "chapter_length"),
        rule(d["reading"].filter(~F.coalesce(C("state").isin(*READING), F.lit(False))), "key", "reading_unknown"),
        rule(d["providers"].filter(~F.coalesce(C("source").rlike("^[a-z0-9_-]{1,50}$"), F.lit(False)) | C("enabled").isNull()), F.coalesce("source", F.lit("")), "preference_form"),
    ]
    if unknown is not None:
        breaches.append(rule(unknown, "row_key", "unknown_key"))
    return reduce(DataFrame.unionByName, breaches).distinct()


def _numbered(rows: DataFrame, table: DataFrame, order: list[Column]) -> DataFrame:
    """rows with new ids above those of a table."""
    most = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__most"))
    out = with_positions(rows.withColumn("__all", F.lit(1)), ["__all"], order, "__p").crossJoin(most)  # one row
    return out.withColumn("id", (C("__most") + C("__p")).cast("bigint")).drop("__all", "__p", "__most")


def import_catalog(d: Document, c: Catalog, tables: Tables) -> Catalog:
    """The catalog with a document in it. Applying it again changes nothing; an empty catalog then exports the document.

    Sources are found as plan_import finds them, and a plan with conflicts is refused. Local series that one portable series
    names become one, the least id: their chapters of one number, and reading and artifacts with them. What isn't here yet is
    created, with ids above the greatest: series, identities, chapters that have a reading state. A status or reading state
    never falls. Titles and descriptions of series are filled only; identities take over what the document says. Aliases are
    added unless the series has the normalised value; an external id unless another identity has it; alternates unless the
    listing is known. Separations are rejected pairs. Of things that claim one place in the document the first by key, then
    source, gets it. Tables of `tables`: import-...
    """
    if plan_import(d["series"], d["sources"], d["separations"], c["identities"])[1].limit(1).count():
        raise ValueError("the document conflicts with the catalog: see plan_import")
    put = lambda df, name: tables.write(df, f"import-{name}")
    found = put(resolve_sources(d["sources"], c["identities"]), "found")
    first = found.filter("series_id IS NOT NULL").groupBy("key").agg(F.min("series_id").alias("first"))
    roots = connected_components(found.filter("series_id IS NOT NULL").join(first, "key").filter("series_id <> first").select(C("series_id").alias("a"), C("first").alias("b")))
    roots = put(roots.filter("node <> root").select(C("node").alias("__node"), "root"), "roots")
    root = lambda df, col: df.join(roots, df[col] == C("__node"), "left").withColumn(col, F.coalesce("root", col)).drop("__node", "root")

    # Local series that are one now.
    stronger = lambda col, order: F.max_by(col, _rank(C(col), order))
    filled = lambda col: F.coalesce(F.min_by(F.nullif(col, F.lit("")), F.when(F.nullif(col, F.lit("")).isNotNull(), C("__id0"))), F.lit(""))
    local = c["series"].withColumn("__id0", C("id")).transform(lambda df: root(df, "id")).groupBy("id").agg(filled("title").alias("title"), filled("description").alias("description"), stronger("status", IMPORT_STATUSES).alias("status"))
    chapters = root(c["chapters"], "series_id").withColumn("__n", T.canonical_number(C("number")))
    keep = chapters.groupBy("series_id", "__n").agg(F.min("id").alias("__keep"))
    place = put(chapters.join(keep, ["series_id", "__n"]).select(C("id").alias("chapter_id"), "__keep"), "chapters-of")
    chapters = chapters.join(keep, ["series_id", "__n"]).filter("id = __keep").select("id", "series_id", "number", "__n")
    to_kept = lambda df: df.join(place, "chapter_id", "left").withColumn("chapter_id", F.coalesce("__keep", "chapter_id"))
    reading = to_kept(c["reading"]).groupBy("chapter_id").agg(F.max_by(F.struct("state", "read_at"), F.struct(_rank(C("state"), READING), "read_at")).alias("x")).select("chapter_id", "x.*")
    artifacts = to_kept(c["artifacts"]).drop("__keep")

    # Series, and the local id of each key.
    target = first.join(roots, C("first") == C("__node"), "left").select("key", F.coalesce("root", "first").alias("id"))
    fresh = put(_numbered(d["series"].join(target.select("key"), "key", "left_anti").select("key", "title", "description", "status"), c["series"], [C("key")]), "new-series")
    target = put(target.unionByName(fresh.select("key", "id")), "target")
    said = d["series"].join(target, "key")
    told = said.groupBy("id").agg(F.min_by(F.nullif("title", F.lit("")), "key").alias("__t"), F.min_by(F.nullif("description", F.lit("")), "key").alias("__d"), stronger("status", IMPORT_STATUSES).alias("__s"))
    series = local.join(told, "id", "full")
    better = (C("status").isNull()) | (_rank(C("__s"), IMPORT_STATUSES) > _rank(C("status"), IMPORT_STATUSES))
    series = series.select("id", F.coalesce(F.nullif("title", F.lit("")), "__t", F.lit("")).alias("title"), F.coalesce(F.nullif("description", F.lit("")), "__d", F.lit("")).alias("description"), F.when(C("__s").isNotNull() & better, C("__s")).otherwise(C("status")).alias("status"))

    # Identities.
    added = put(_numbered(found.filter("id IS NULL").select("key", "source").distinct(), c["identities"], [C("key"), C("source")]), "new-identities")
    of = put(found.filter("id IS NOT NULL").select("key", "source", "id").unionByName(added.select("key", "source", "id")).dropDuplicates(["key", "source"]), "identities-of")
    new = d["sources"].join(of, ["key", "source"]).join(target.withColumnRenamed("id", "series_id"), "key")
    new = new.select("id", "series_id", "source", "source_id", "title", "url", *(F.coalesce(x, F.lit("")).alias(x) for x in ("description", "revision")))
    identities = root(c["identities"], "series_id").join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)

    # What belongs to them.
    have = root(c["aliases"], "series_id").select("series_id", "identity_id", "alias", F.lit(0).alias("__o"), F.lit("").alias("source"))
    asked = d["series_aliases"].join(target.withColumnRenamed("id", "series_id"), "key").select("series_id", F.lit(None).cast("bigint").alias("identity_id"), "alias", F.lit(1).alias("__o"), F.lit("").alias("source"))
    asked = asked.unionByName(d["source_aliases"].join(of, ["key", "source"]).join(target.withColumnRenamed("id", "series_id"), "key").select("series_id", C("id").alias("identity_id"), "alias", F.lit(2).alias("__o"), "source"))
    names = have.unionByName(asked).withColumn("__n", T.normalize_title(C("alias"))).filter("__o = 0 OR __n <> ''")
    aliases = first_row(names, ["series_id", "__n"], [C("__o"), C("source"), C("identity_id"), C("alias")]).select("series_id", "identity_id", "alias")
    owner = c["external_ids"].groupBy("provider", "value").agg(F.min("identity_id").alias("__owner"))
    claims = d["external_ids"].join(of, ["key", "source"]).select(C("id").alias("identity_id"), "provider", "value", "key", "source").join(owner, ["provider", "value"], "left")
    claims = first_row(claims.filter("__owner IS NULL OR __owner = identity_id"), ["provider", "value"], [C("key"), C("source"), C("identity_id")])
    claims = first_row(claims, ["identity_id", "provider"], [C("value")]).select("identity_id", "provider", C("value").alias("__v"))
    external = c["external_ids"].join(claims, ["identity_id", "provider"], "full").select("identity_id", "provider", F.coalesce("__v", "value").alias("value"))
    listed = d["alternates"].join(of, ["key", "source"]).join(d["sources"].select("key", "source", C("title").alias("__t"), C("url").alias("__u")).dropDuplicates(["key", "source"]), ["key", "source"])
    listed = first_row(listed.select(C("id").alias("identity_id"), "source", "source_id", F.coalesce(F.nullif("title", F.lit("")), "__t").alias("title"), F.coalesce(F.nullif("url", F.lit("")), "__u").alias("url"), "key"), ["source", "source_id"], [C("key")]).drop("key")
    alternates = c["alternates"].select(*listed.columns).unionByName(listed.join(c["alternates"].select("source", "source_id"), ["source", "source_id"], "left_anti").select(*listed.columns))

    # Chapters and their reading.
    states = d["reading"].join(target.withColumnRenamed("id", "series_id"), "key").withColumn("__n", T.canonical_number(C("chapter")))
    states = states.groupBy("series_id", "__n").agg(F.max_by(F.struct("state", "read_at"), F.struct(_rank(C("state"), READING), "read_at")).alias("x"), F.min("chapter").alias("chapter"))
    missing = states.join(chapters.select("series_id", "__n"), ["series_id", "__n"], "left_anti").select("series_id", "__n", "chapter")
    made = put(_numbered(missing, c["chapters"], [C("series_id"), C("__n")]), "new-chapters").select("id", "series_id", C("__n").alias("number"), "__n")
    chapters = chapters.unionByName(made)
    states = states.join(chapters.select("id", "series_id", "__n"), ["series_id", "__n"]).select(C("id").alias("chapter_id"), C("x.state").alias("__s"), C("x.read_at").alias("__r"))
    wins = C("state").isNull() | (_rank(C("__s"), READING) >= _rank(C("state"), READING))
    reading = reading.join(states, "chapter_id", "full").select("chapter_id", F.when(C("__s").isNotNull() & wins, C("__s")).otherwise(C("state")).alias("state"), F.when(C("__s").isNotNull() & wins, F.coalesce("__r", "read_at")).otherwise(C("read_at")).alias("read_at"))

    # Separations and preferences.
    names = d["sources"].select("key", "source", _identity().alias("__i")).join(of, ["key", "source"]).groupBy("__i").agg(F.min("id").alias("id"))
    side = lambda p: names.select(C("__i").alias(f"__{p}"), C("id").alias(f"__{p}_id"))
    apart = d["separations"].select(_identity("left_source", "left_id").alias("__l"), _identity("right_source", "right_id").alias("__r")).join(side("l"), "__l").join(side("r"), "__r")
    apart = apart.select(F.least("__l_id", "__r_id").alias("left_id"), F.greatest("__l_id", "__r_id").alias("right_id")).distinct()
    decisions = c["decisions"].select("left_id", "right_id", "decision").join(apart, ["left_id", "right_id"], "left_anti").unionByName(apart.withColumn("decision", F.lit("rejected")))
    wanted = d["providers"].groupBy("source").agg(F.max("enabled").alias("__e"))
    preferences = c["providers"].join(wanted, "source", "full").select("source", F.coalesce("__e", "enabled").alias("enabled"))
    out = {
        "series": series, "identities": identities, "aliases": aliases, "external_ids": external, "alternates": alternates, "chapters": chapters.drop("__n"),
        "reading": reading, "artifacts": artifacts, "decisions": decisions, "providers": preferences,
    }
    return {k: put(df, k) for k, df in out.items()}
