"""Incoming listings against the catalog: alternate listings, identities, external ids, and shortlists of what may match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators.blocking import evidence_profiles
from kinfold.operators.resolve import duplicate_evidence
from kinfold.operators.sets import gathered, key_meetings
from kinfold.operators.windows import first_row
from kinfold.session import write_table

C = F.col


def equivalent_listing(incoming: DataFrame, identities: DataFrame, children: DataFrame, external: DataFrame) -> DataFrame:
    """(incoming, identity, ratio, common): the identity of the same source and title that an incoming row is another
    listing of: greatest child ratio, then overlap, then least id. Identities that are alike in all that evidence looks at are
    compared once, as their least id would win, and so are incoming rows. Both have id (disjoint), source, title, source_id, url;
    children and external ids name either. Rows without a title or without children match none. An id or address that the other
    side of a source doesn't have is left out of the comparison of profiles, as it can't agree with any: rows that differ in
    such alone count as one, and pairs stay as many as those of profiles."""
    columns = ["id", "source", "title", "source_id", "url"]
    every = identities.select(*columns).unionByName(incoming.select(*columns))
    none = identities.limit(0).select("id", F.lit(0).cast("bigint").alias("hash"))
    told = _only_shared(identities.select(*columns), incoming).unionByName(_only_shared(incoming.select(*columns), identities))
    children = write_table(gathered(children), "children")
    profiles = write_table(evidence_profiles(told, children, external, none), "profiles")
    named = lambda df: df.select("id", "source", T.normalize_title(C("title")).alias("t")).filter("t <> ''").join(profiles.hint("merge"), "id")
    with_children = named(incoming.join(children.select(C("identity_id").alias("id")), "id", "left_semi"))
    key = ["source", "t", "profile"]
    mine, theirs = (df.groupBy(*key).agg(F.min("id").alias(p)) for df, p in ((named(identities), "a"), (with_children, "b")))
    pairs = mine.drop("profile").join(theirs.drop("profile").hint("merge"), ["source", "t"]).select("a", "b")
    evidence = duplicate_evidence(pairs, every, children, external, none)
    best = F.max_by(F.struct("a", "ratio", "common"), F.struct(C("ratio"), C("common"), -C("a")))
    found = evidence.filter("equivalent").groupBy("b").agg(best.alias("x"))
    return with_children.join(theirs.hint("merge"), key).join(found.hint("merge"), "b").select(C("id").alias("incoming"), C("x.a").alias("identity"), "x.ratio", "x.common")


def _only_shared(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows (id, source, title, source_id, url) with an empty source_id or url where no row of the others has that one, normalised,
    in the same source."""
    for column, normal in (("source_id", T.normalize_source_id), ("url", T.canonical_url)):
        theirs = others.select(C("source").alias("__s"), normal(C(column)).alias("__k")).filter("__k <> ''").distinct().withColumn("__has", F.lit(True))
        rows = rows.withColumn("__n", normal(C(column))).join(theirs.hint("merge"), (C("source") == C("__s")) & (C("__n") == C("__k")), "left")
        rows = rows.withColumn(column, F.when(C("__has"), C(column)).otherwise("")).drop("__s", "__k", "__n", "__has")
    return rows


def resolve_identity(incoming: DataFrame, identities: DataFrame, alternates: DataFrame, equivalents: DataFrame, external: DataFrame, incoming_external: DataFrame) -> DataFrame:
    """(id, identity_id, series_id, how) for incoming rows (id, source, source_id), by the first step that finds one:

    exact (the raw or normalised id of its source), alternate (a known listing: source, source_id, identity_id), equivalent
    (E29), external_id (the series of a shared id, providers in order, if it has no identity of this source yet), new. A new
    identity has no id yet; a new series gets one from a hash of source and id, the same in every run.
    """
    rows = incoming.select("id", "source", "source_id", T.normalize_source_id(C("source_id")).alias("key"))
    keyed = identities.select("source", C("id").alias("found"), F.explode(F.array_distinct(F.array(F.concat(F.lit("="), "source_id"), F.concat(F.lit("~"), T.normalize_source_id(C("source_id")))))).alias("k")).filter("k <> '~'")
    asked = rows.select("id", "source", F.explode(F.array(F.concat(F.lit("="), "source_id"), F.concat(F.lit("~"), "key"))).alias("k"))
    exact = asked.join(keyed.groupBy("source", "k").agg(F.min("found").alias("found")), ["source", "k"]).groupBy("id").agg(F.min("found").alias("exact"))
    other = rows.join(alternates.groupBy("source", "source_id").agg(F.min("identity_id").alias("alternate")), ["source", "source_id"]).select("id", "alternate")
    # Series of one shared id with the same sources count as their least, so an id of many series meets few of them.
    taken = identities.groupBy("series_id").agg(F.array_sort(F.collect_set("source")).alias("taken"))
    owned = external.join(identities.select(C("id").alias("identity_id"), "series_id"), "identity_id").join(taken, "series_id", "left")
    kinds = owned.groupBy("provider", "value", "taken").agg(F.min(F.struct("series_id")).alias("least"))
    asks = incoming_external.select("id", "provider", "value").join(rows.select("id", "source"), "id")
    free = asks.select("provider", "value", "source").distinct().join(kinds, ["provider", "value"]).filter(~F.coalesce(F.array_contains("taken", C("source")), F.lit(False)))
    free = free.groupBy(C("provider").alias("__p"), C("value").alias("__v"), C("source").alias("__s")).agg(F.min("least").alias("least"))
    shared = asks.join(free.hint("merge"), (C("provider") == C("__p")) & (C("value") == C("__v")) & C("source").eqNullSafe(C("__s")))
    shared = shared.groupBy("id").agg(F.min(F.struct("provider", "least")).alias("x")).select("id", C("x.least.series_id").alias("shared"))
    out = rows.join(exact, "id", "left").join(other, "id", "left").join(equivalents.select(C("incoming").alias("id"), C("identity").alias("equivalent")), "id", "left").join(shared, "id", "left")
    out = out.withColumn("identity_id", F.coalesce("exact", "alternate", "equivalent"))
    out = out.join(identities.select(C("id").alias("identity_id"), C("series_id").alias("known")), "identity_id", "left")
    fresh = F.conv(F.substring(F.md5(F.concat_ws(":", "source", "key")), 1, 15), 16, 10).cast("long")
    how = F.when(C("exact").isNotNull(), "exact").when(C("alternate").isNotNull(), "alternate").when(C("equivalent").isNotNull(), "equivalent").when(C("shared").isNotNull(), "external_id").otherwise("new")
    return out.select("id", "identity_id", F.coalesce("known", "shared", fresh).alias("series_id"), how.alias("how"))


def sync_external_ids(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """P5: (identity_id, provider, value) after the wanted ones: an identity's value of a provider changes unless another
    identity owns the new one, and a free one is added. Blank providers or values count for nothing; of several that want
    one value the least identity gets it, and of an identity's several values the least counts."""
    want = wanted.filter("provider <> '' AND value <> ''").groupBy("identity_id", "provider").agg(F.min("value").alias("want"))
    want = first_row(want, ["provider", "want"], [C("identity_id")])
    owner = current.groupBy("provider", C("value").alias("want")).agg(F.min("identity_id").alias("owner"))
    free = want.join(owner, ["provider", "want"], "left").filter("owner IS NULL OR owner = identity_id").select("identity_id", "provider", "want")
    return current.join(free, ["identity_id", "provider"], "full").select("identity_id", "provider", F.coalesce("want", "value").alias("value"))


def block_cover_band(probes: DataFrame, identities: DataFrame, signatures: DataFrame, most: int | None = None, prefix: int = 12) -> DataFrame:
    """E5: (a, b): for each probe (id) the identities of another source and series that share a band of the cover hash
    (signatures: id, bands) or begin with the same letters of the normalised title, each once. Pairs are made last, tile by tile
    of a key. With `most` a probe has the first `most` of them by id: of a key and source only the rows that can be among these
    are joined, as one list a key."""
    rows = identities.select("id", "source", "series_id", F.substring(T.normalize_title(C("title")), 1, prefix).alias("t")).join(signatures.select("id", "bands"), "id", "left")
    titled = F.when(C("t") != "", F.concat(F.lit("t:"), "t"))
    keys = F.array_append(F.transform(F.coalesce("bands", F.array().cast("array<string>")), lambda b, i: F.when(b != "", F.concat_ws(":", i.cast("string"), b))), titled)
    rows = rows.select("id", "source", "series_id", F.explode(F.array_compact(keys)).alias("k"))
    own = rows.join(probes.select("id").distinct(), "id", "left_semi")
    if most is None:
        met = key_meetings(own, rows, ["id", "source", "series_id"], ["source", "series_id"])
        repeated = identities.groupBy("id").agg(F.count_distinct(F.struct("source", "series_id")).alias("n")).filter("n > 1")
        return met if repeated.isEmpty() else met.distinct()  # else no two rows of one id can make the same pair
    few = _first_of_keys(_first_of_keys(rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))), most, ["k", "source", "salt"]), most, ["k", "source"])
    listed = few.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("id", "source", "series_id"))).alias("ys"))  # some 2 * most a source
    others = F.filter("ys", lambda y: (y["source"] != C("source")) & (y["series_id"] != C("series_id")))
    met = own.join(listed.hint("merge"), "k").select(C("id").alias("a"), F.slice(F.transform(others, lambda y: y["id"]), 1, most).alias("bs"))
    first = met.groupBy("a").agg(F.flatten(F.collect_list("bs")).alias("bs"))  # `most` of each of a probe's few keys
    return first.select("a", F.explode(F.slice(F.array_sort(F.array_distinct("bs")), 1, most)).alias("b"))


def _first_of_keys(rows: DataFrame, most: int, group: list[str]) -> DataFrame:
    """The rows of each group that may be among the first `most` by id for anybody who leaves out one series, some 2 * most at
    most: a row isn't if `most` rows of its own series come before it, or if `most` rows come before it whichever series is
    left out. Groups within a key may be thinned first, and what is left then together."""
    from pyspark.sql import Window

    rows = rows.withColumn("__c", F.row_number().over(Window.partitionBy(*group, "series_id").orderBy("id"))).filter(C("__c") <= most)
    order = Window.partitionBy(*group).orderBy("id", "series_id")
    before = F.row_number().over(order) - 1 - F.coalesce(F.max("__c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__b", before).filter(C("__b") < most).drop("__b", "__c")


def first_rows(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(C("__rn") <= most).drop("__rn")


def cover_shortlist(pairs: DataFrame, identities: DataFrame, signatures: DataFrame, title: float = 0.65, quick: int = 18, final: int = 14) -> DataFrame:
    """E5: the pairs (a, b) worth a comparison: alike titles, or covers whose hashes are near (signatures: id, hash)."""
    side = lambda p: identities.select(C("id").alias(p), C("title").alias(f"{p}_title")).join(signatures.select(C("id").alias(p), C("hash").alias(f"{p}_hash")), p)
    out = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("distance", T.hamming64(C("a_hash"), C("b_hash")))
    texts = out.select("a_title", "b_title").distinct().withColumn("title", T.title_similarity(C("a_title"), C("b_title")))
    return out.join(texts, ["a_title", "b_title"]).filter((C("title") >= title) | (C("distance") <= min(quick, final))).select("a", "b", F.bround("title", 6).alias("title"), "distance")


def merge_shortlist(selected: DataFrame, series: DataFrame, identities: DataFrame, decisions: DataFrame, signatures: DataFrame, tracked: tuple[str, ...] = ("interested", "reading", "caught_up", "paused"), most: int = 500) -> DataFrame:
    """Tracked series (id) that may belong to the selected ones (id; a few): a decision between them that isn't a
    rejection, a common title term of four letters or more, or a common band; the first `most` by title and id."""
    picked = F.broadcast(selected.select("id").distinct())  # what a user has selected
    named = series.select("id", "status", T.normalize_title(C("title")).alias("t"))
    terms = named.join(picked, "id", "left_semi").select(F.explode(F.split("t", " ")).alias("term")).filter("length(term) >= 4").agg(F.coalesce(F.collect_set("term"), F.array().cast("array<string>")).alias("terms"))
    own = identities.select(C("id").alias("identity_id"), C("series_id").alias("id"))
    mine = own.join(picked, "id", "left_semi").select("identity_id")
    sides = decisions.filter("decision <> 'rejected'").select(F.explode(F.array(F.struct(C("left_id").alias("x"), C("right_id").alias("y")), F.struct(C("right_id").alias("x"), C("left_id").alias("y")))).alias("p"))
    decided = sides.join(mine.select(C("identity_id").alias("x")), F.expr("p.x = x")).select(C("p.y").alias("identity_id")).join(own, "identity_id").select("id")
    bands = signatures.select(C("id").alias("identity_id"), F.posexplode("bands").alias("i", "band")).filter("band <> ''").select("identity_id", "band").distinct()
    alike = bands.join(bands.join(mine, "identity_id", "left_semi").select("band").distinct(), "band", "left_semi").join(own, "identity_id").select("id")
    termed = named.crossJoin(F.broadcast(terms)).filter(F.exists("terms", lambda x: C("t").contains(x))).select("id")  # one row of terms
    found = decided.union(alike).union(termed).distinct().join(picked, "id", "left_anti")
    return named.filter(C("status").isin(*tracked)).join(found, "id", "left_semi").orderBy("t", "id").limit(most).select("id")


def rescore_pending(decisions: DataFrame, identities: DataFrame, series: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Decisions with the confidence of pending ones between the given series (id) and others scored anew; reviewed
    ones and those within one series stay. score: pairs of series (a < b) to (a, b, score)."""
    of = lambda p: identities.select(C("id").alias(f"{p}_id"), C("series_id").alias(f"__{p}"))
    out = decisions.join(of("left"), "left_id", "left").join(of("right"), "right_id", "left")
    touched = out.filter("decision = 'pending' AND __left <> __right").withColumns({"a": F.least("__left", "__right"), "b": F.greatest("__left", "__right")})
    ids = series.select("id").distinct()
    pairs = touched.join(ids.select(C("id").alias("a")), "a", "left_semi").select("a", "b").union(touched.join(ids.select(C("id").alias("b")), "b", "left_semi").select("a", "b")).distinct()
    fresh = score(pairs).select(C("a").alias("__a"), C("b").alias("__b"), C("score").alias("__score"))
    out = out.join(fresh, (F.least("__left", "__right") == C("__a")) & (F.greatest("__left", "__right") == C("__b")) & (C("decision") == "pending"), "left")
    return out.withColumn("confidence", F.coalesce("__score", "confidence")).select(*decisions.columns)
