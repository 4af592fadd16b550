"""First rows, positions and running sums within groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Preference of providers, best first; unknown ones come last.
PREFERENCE = ("alpha", "beta", "gamma", "delta")


def preference(source: str = "source", order: tuple[str, ...] = PREFERENCE) -> Column:
    return F.coalesce(*(F.when(C(source) == s, F.lit(len(order) - i)) for i, s in enumerate(order)), F.lit(0))


def first_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; the order must end in something unique."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def first_few(rows: DataFrame, keys: list[str], order: str, value: str, most: int) -> DataFrame:
    """keys and few: the first values of each group, `most` at most, separated by commas. No group is gathered whole."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    few = rows.withColumn("__place", place).filter(C("__place") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("__place", C(value).cast("string").alias("v")))), lambda x: x["v"])
    return few.groupBy(*keys).agg(F.array_join(listed, ",").alias("few"))


def with_positions(rows: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Add each row's place among those of its keys, for keys that may hold a large share of all rows: the table is dealt by
    ranges of (keys, order), places are counted within each range, and ranges are moved on by the numbers before them. The
    order must end in something unique. The dealt table is written once, as two steps need the same ranges."""
    from kinfold.session import write_table

    marks = {f"__o{i}": o for i, o in enumerate(order)}
    ordering = [C(k) for k in marks]
    dealt = rows.withColumns(marks).repartitionByRange(*keys, *ordering).withColumn("__range", F.spark_partition_id())
    dealt = write_table(dealt, "ranges")
    counts = dealt.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before).select(*(C(k).alias(f"__k{i}") for i, k in enumerate(keys)), C("__range").alias("__r"), "__before")
    place = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*ordering))
    same = reduce(lambda a, b: a & b, (C(k).eqNullSafe(C(f"__k{i}")) for i, k in enumerate(keys)))
    out = dealt.withColumn(name, place).join(counts, (C("__range") == C("__r")) & same)
    return out.withColumn(name, (C(name) + C("__before")).cast("int")).drop(*marks, "__range", "__r", "__before", *(f"__k{i}" for i in range(len(keys))))


def latest_release(releases: DataFrame, key: str = "series_id") -> DataFrame:
    """Numeric ones first, greatest number; by time only without a number; greatest id."""
    order = [C("number").isNull().cast("int"), F.desc("number"), F.when(C("number").isNull(), C("published_at")).desc_nulls_last(), F.desc("id")]
    return first_row(releases, [key], order)


def queue_position(jobs: DataFrame, pool: str = "kind") -> DataFrame:
    """Place of waiting rows in their pool."""
    return with_positions(jobs.filter(C("status").isin("queued", "retrying")), [pool], [C("priority"), C("due_at"), C("id")])


def group_representative(jobs: DataFrame, group: Column) -> DataFrame:
    """Leased rows first, then priority, due time and id."""
    return first_row(jobs.withColumn("work_group", group), ["work_group"], [(C("status") != "leased").cast("int"), C("priority"), C("due_at"), C("id")])


def latest_by_identity(releases: DataFrame, keys: list[str]) -> DataFrame:
    """Number, then time, then id, all descending, nulls last."""
    return first_row(releases, keys, [C("number").desc_nulls_last(), C("published_at").desc_nulls_last(), F.desc("id")])


def best_release(releases: DataFrame, keys: list[str]) -> DataFrame:
    """Preferred provider, then quality, then greatest id, among available ones."""
    return first_row(releases.filter("available"), keys, [preference().desc(), F.desc("quality"), F.desc("id")])


def ranked_covers(covers: DataFrame, key: str = "series_id") -> DataFrame:
    """By pixels, least side, greatest side, provider and lowest id. covers: id, series_id, source, width, height."""
    order = [(C("width") * C("height")).desc(), F.least("width", "height").desc(), F.greatest("width", "height").desc(), preference().desc(), C("id")]
    return covers.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def tier_children(children: DataFrame, key: str, planned_at: Column) -> DataFrame:
    """The first and last two of a series are priority, those newer than the plan current, others backfill."""
    up = F.row_number().over(Window.partitionBy(key).orderBy(C("number").asc_nulls_last(), C("id")))
    down = F.row_number().over(Window.partitionBy(key).orderBy(C("number").desc_nulls_first(), C("id").desc()))
    tier = F.when((up <= 2) | (down <= 2), "priority").when(C("published_at") > planned_at, "current").otherwise("backfill")
    return children.withColumn("tier", tier)


def rolling_admission(intents: DataFrame, active: DataFrame, window: int, key: str = "series_id") -> DataFrame:
    """Pending intents that fit beside the active ones of their series. active: series_id, n."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("tier", "id"))
    out = intents.withColumn("__place", place).join(active.select(key, C("n").alias("__n")), key, "left")
    return out.filter(C("__place") <= window - F.coalesce("__n", F.lit(0))).drop("__place", "__n")


def stable_frontier_cut(listing: DataFrame, needed: int, key: str = "source", position: str = "position") -> DataFrame:
    """Changed rows up to where so many stable ones have been seen. listing has stable (boolean); rows without a sentinel
    have it null and count as changed; fewer sentinels than needed ask for all of them, none for everything."""
    known = listing.groupBy(key).agg(F.count_if(C("stable").isNotNull()).alias("__known"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(position))
    stable = listing.filter("stable").select(key, position).withColumn("__place", place).filter(C("__place") <= needed)  # a few of each key
    cut = stable.join(known, key).filter(C("__place") == F.least(F.lit(needed), C("__known"))).select(key, C(position).alias("__cut"))
    out = listing.filter(~F.coalesce("stable", F.lit(False))).join(cut, key, "left")
    return out.filter(C("__cut").isNull() | (C(position) < C("__cut"))).drop("__cut")


def listing_frontier(listing: DataFrame, limit: int, key: str = "source", position: str = "position") -> DataFrame:
    """The first rows with a latest value."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(position))
    return listing.filter(C("latest").isNotNull()).withColumn("rank", rn).filter(C("rank") <= limit)


def frontier_hits(listing: DataFrame, sentinels: DataFrame, required: int = 3, key: str = "source") -> DataFrame:
    """By source, rows at or behind their sentinel, and whether there are enough. sentinels: id, source, known."""
    counts = sentinels.groupBy(key).agg(F.count("*").alias("sentinels"))
    hits = listing.select("id", "latest").join(sentinels.select("id", key, "known"), "id").groupBy(key).agg(F.count_if(C("latest") <= C("known")).alias("hits"))
    out = counts.join(hits, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("reached", C("hits") >= F.least(F.lit(required), C("sentinels")))


def unread_children(releases: DataFrame, reading: DataFrame) -> DataFrame:
    """Unread numbers of each series, the best release of each, as an ordered list."""
    unread = releases.join(reading.filter("state = 'read'").select(C("release_id").alias("id")), "id", "left_anti").filter(C("number").isNotNull())
    best = best_release(unread, ["series_id", "number"])
    items = F.transform(F.sort_array(F.collect_list(F.struct("number", "id"))), lambda s: F.concat_ws(":", s["number"], s["id"]))
    return best.groupBy("series_id").agg(F.count("*").alias("n"), F.array_join(items, ",").alias("items"))
