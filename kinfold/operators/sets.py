"""Set operations and overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Name and number of rows."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()))


def portable_selection(series: DataFrame, artifacts: DataFrame, identities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Series that are tracked, have an active artifact, have several identities, or have
    one that a rejected decision is about."""
    parts = [
        series.filter("status <> 'untracked'").select("id"),
        artifacts.filter("state = 'active'").select(C("series_id").alias("id")),
        identities.groupBy("series_id").agg(F.count("*").alias("n")).filter("n > 1").select(C("series_id").alias("id")),
        decisions.filter("decision = 'rejected'").select(F.explode(F.array("left_id", "right_id")).alias("__i")).join(identities.select(C("id").alias("__i"), C("series_id").alias("id")), "__i").select("id"),
    ]
    return reduce(DataFrame.union, parts).distinct()


def portable_separations(decisions: DataFrame, identities: DataFrame, exported: DataFrame) -> DataFrame:
    """Rejected pairs whose series (exported: id) are both exported, as two identities."""
    side = lambda p: identities.join(exported.select(C("id").alias("series_id")), "series_id", "left_semi").select(C("id").alias(f"__{p}"), C("source").alias(f"{p}_source"), C("source_id").alias(f"{p}_id"))
    rows = decisions.filter("decision = 'rejected'").select(C("left_id").alias("__left"), C("right_id").alias("__right"))
    return rows.join(side("left"), "__left").join(side("right"), "__right").select("left_source", "left_id", "right_source", "right_id")


def orphan_paths(stored: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """U3."""
    return stored.join(known.select(key), key, "left_anti")


def set_overlap(pairs: DataFrame, children: DataFrame, key: str = "identity_id", item: str = "number") -> DataFrame:
    """U4: for pairs (a, b): common items, the smaller size, their ratio, Jaccard. Sets stay rows: no arrays are gathered."""
    items = children.select(C(key).alias("k"), C(item).alias("i")).distinct()
    sizes = items.groupBy("k").agg(F.count("*").alias("n"))
    common = pairs.select("a", "b").join(items.select(C("k").alias("a"), "i"), "a").join(items.select(C("k").alias("b"), "i"), ["b", "i"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    out = pairs.select("a", "b").join(common, ["a", "b"], "left").join(sizes.select(C("k").alias("a"), C("n").alias("na")), "a", "left").join(sizes.select(C("k").alias("b"), C("n").alias("nb")), "b", "left")
    out = out.select("a", "b", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("common", "na", "nb")))
    out = out.withColumn("smaller", F.least("na", "nb"))
    return out.withColumn("ratio", F.coalesce(F.try_divide("common", "smaller"), F.lit(0.0))).withColumn("jaccard", F.coalesce(F.try_divide("common", C("na") + C("nb") - C("common")), F.lit(0.0)))


def gathered(children: DataFrame, key: str = "identity_id", item: str = "number") -> DataFrame:
    """(key, items: sorted, blanks: 1 if one is null) of rows (key, item), or what is gathered already. One entity's items, some
    hundred, are one array; rows are dealt by key as they are, as sets of one or two would take more room."""
    if "items" in children.columns:
        return children
    rows = children.select(key, item).filter(C(key).isNotNull()).repartition(key)
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"), F.max(C(item).isNull().cast("int")).alias("blanks"))


#: Fixed value: ids of a key that are kept as one tile; pairs are made tile by tile.
TILE = 2048

#: Fixed value: ids of a tile that stand in one row; Spark holds all rows of two such in memory before it passes them on.
PIECE = 64


def keys_listed(rows: DataFrame, own: list[str], key: str) -> DataFrame:
    """(own, key, before): each key of a row's own columns once, with the lesser ones (sorted). One entity's keys, a few, are
    gathered; rows of one key never are."""
    listed = rows.filter(C(key).isNotNull()).groupBy(*own).agg(F.array_sort(F.collect_set(key)).alias("all"))
    return listed.select(*own, "all", F.posexplode("all").alias("at", key)).select(*own, key, F.slice("all", 1, C("at")).alias("before"))


def tile_counts(listed: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """(key, of): keys of several tiles."""
    return listed.groupBy(key).agg(F.ceil(F.count("*") / tile).cast("int").alias("of")).filter("of > 1")


def tiles(listed: DataFrame, own: list[str], key: str, counts: DataFrame) -> DataFrame:
    """(key, at: a tile of the key, of: how many it has, and other columns of counts; columns of own but the first, the id;
    before, sig, ids) of keys_listed. Rows of one tile with the same lesser keys stand together. counts: key, of, for keys of
    several tiles; they come by a salted join, so that rows of one key never meet in one task."""
    told = [c for c in counts.columns if c != key]
    many = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    one = listed.withColumn("salt", F.pmod(F.xxhash64(own[0]), F.lit(64)).cast("int")).join(many.hint("merge"), [key, "salt"], "left").fillna(1, subset=told)
    groups = one.groupBy(key, F.pmod(F.xxhash64(own[0], F.lit(1)), C("of")).cast("int").alias("at"), *told, *own[1:], "before").agg(F.array_sort(F.collect_list(own[0])).alias("ids"))  # two readers must cut the same pieces
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / PIECE).cast("int")), lambda i: F.slice("ids", i * PIECE + 1, PIECE))
    groups = groups.withColumn("ids", F.explode(pieces))
    # One bit for each lesser key: groups without a common bit have no common key.
    bits = F.transform("before", lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(k), F.lit(64)).cast("int")))
    return groups.withColumn("sig", F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x)))


def new_meeting(x: str = "x", y: str = "y") -> Column:
    """Whether groups x and y of a key share no lesser key: so each pair counts once, under its least common key."""
    return (C(f"{x}.sig").bitwiseAND(C(f"{y}.sig")) == 0) | ~F.arrays_overlap(f"{x}.before", f"{y}.before")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys over as many tasks as there are, whatever the size of the rows: a few rows make many pairs."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def key_meetings(left: DataFrame, right: DataFrame, own: list[str], apart: list[str], tile: int = TILE) -> DataFrame:
    """(a, b) of the ids of left and right (own: the id first; k) that have a key k in common and differ in all columns of apart,
    each two rows of own once. Null keys, and nulls in apart, meet none. Made as in key_pairs."""
    x, y = keys_listed(left, own, "k"), keys_listed(right, own, "k")
    rows = x.select("k", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(y.select("k", F.lit(0).alias("x"), F.lit(1).alias("y")))
    number = lambda c: F.greatest(F.ceil(F.sum(c) / tile), F.lit(1)).cast("int")
    counts = rows.groupBy("k").agg(number("x").alias("xs"), number("y").alias("ys")).filter("xs > 1 OR ys > 1")
    x = tiles(x, own, "k", counts.select("k", C("xs").alias("of"), C("ys").alias("others")))
    y = tiles(y, own, "k", counts.select("k", C("ys").alias("of"), C("xs").alias("others")))
    x = x.withColumn("i", C("at")).withColumn("j", F.explode(F.sequence(F.lit(0), C("others") - 1)))
    y = y.withColumn("j", C("at")).withColumn("i", F.explode(F.sequence(F.lit(0), C("others") - 1)))
    x, y = (dealt(df, "k", "i", "j").alias(p) for df, p in ((x, "x"), (y, "y")))
    due = [C(f"x.{c}") == C(f"y.{c}") for c in ("k", "i", "j")] + [C(f"x.{c}") != C(f"y.{c}") for c in apart]
    met = x.join(y.hint("merge"), reduce(Column.__and__, due) & new_meeting()).select(C("x.ids").alias("xs"), C("y.ids").alias("ys"))
    return met.select("ys", F.explode("xs").alias("a")).select("a", F.explode("ys").alias("b"))


def key_pairs(rows: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """(a, b), a < b, of ids whose rows (id, keys) agree in all keys, each pair once. Rows with a null key agree with none.
    Ids of a key are kept in tiles and grouped by their lesser keys: two groups are compared once, and their pairs are made last
    and never dealt. A key of many tiles is dealt by pairs of these, and nothing is broadcast on an estimate of its size."""
    whole = rows.dropna(subset=keys).select("id", F.struct(*keys).alias("k") if len(keys) > 1 else C(keys[0]).alias("k"))
    one = keys_listed(whole, ["id"], "k")
    counts = tile_counts(one, "k", tile)
    groups = tiles(one, ["id"], "k", counts).withColumn("first", F.array_min("ids"))
    left = groups.withColumn("lo", C("at")).withColumn("hi", F.explode(F.sequence("at", C("of") - 1)))
    right = groups.withColumn("hi", C("at")).withColumn("lo", F.explode(F.sequence(F.lit(0), "at")))
    x, y = (dealt(df, "k", "lo", "hi").alias(p) for df, p in ((left, "x"), (right, "y")))
    same = C("x.first") == C("y.first")
    due = (C("x.lo") < C("x.hi")) | (C("x.first") <= C("y.first"))
    met = x.join(y.hint("merge"), (C("x.k") == C("y.k")) & (C("x.lo") == C("y.lo")) & (C("x.hi") == C("y.hi")) & due & new_meeting())
    met = met.select(same.alias("same"), C("x.ids").alias("xs"), C("y.ids").alias("ys"))
    met = met.select("same", "ys", F.explode("xs").alias("x")).select("same", "x", F.explode("ys").alias("y")).filter(~C("same") | (C("x") < C("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
