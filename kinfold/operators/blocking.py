"""Candidate pairs without all pairs of a key: pairs near in Hamming distance, and pairs as classes.

A class stands for identities that agree in a key (or in all that evidence looks at); a pair of classes stands for all pairs of
their members, and is expanded only where somebody asks for it.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators.sets import dealt, gathered, key_pairs, keys_listed, new_meeting, tile_counts, tiles
from kinfold.session import write_table

C = F.col


def _bands(bits: int, bands: int) -> list[tuple[int, int]]:
    """(shift, width) of nearly equal parts of a number."""
    edges = [bits * k // bands for k in range(bands + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _part(c: Column, shift: int, width: int) -> Column:
    return c if width == 64 else F.shiftrightunsigned(c, shift).bitwiseAND((1 << width) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(rows: DataFrame, keys: list[str], radius: int, bands: int | None = None, bits: int = 64) -> DataFrame:
    """(a, b, distance), a < b, of rows (id, hash, keys) that agree in the keys and differ in `radius` bits at most, each once.

    Multi-index hashing: cut in `bands` parts, two such hashes differ in radius // bands bits at most in one part at least. One
    side is listed under its parts, the other under all variants of its parts within that, so only rows that are near in a part
    meet. A pair that meets in several parts counts in the first. Rows of one id and several keys give a pair once for each
    common key; rows with a null hash or key give none. Fewer, wider parts mean fewer rows that meet by chance and more
    variants; without `bands` there are as many as leave one bit to vary.
    """
    n = bands or max(1, radius // 2 + 1)
    vary = radius // n
    parts = _bands(bits, n)
    masks = lambda w: [_signed(sum(1 << i for i in some)) for k in range(vary + 1) for some in combinations(range(w), k)]
    here = rows.filter("hash IS NOT NULL").select("id", "hash", *keys)
    entry = lambda k, value: F.struct(F.lit(k).alias("part"), value.alias("value"))
    left = here.withColumn("x", F.explode(F.array(*(entry(k, _part(C("hash"), s, w)) for k, (s, w) in enumerate(parts)))))

    def variants(k: int, shift: int, width: int) -> Column:
        return F.transform(F.lit(masks(width)).cast("array<bigint>"), lambda m: entry(k, _part(C("hash"), shift, width).bitwiseXOR(m)))

    near = [variants(k, s, w) for k, (s, w) in enumerate(parts)]
    right = here.withColumn("y", F.explode(F.concat(*near)))
    left = left.select(*keys, C("x.part").alias("part"), C("x.value").alias("value"), C("id").alias("a"), C("hash").alias("h"))
    right = right.select(*keys, C("y.part").alias("part"), C("y.value").alias("value"), C("id").alias("b"), C("hash").alias("g"))
    met = left.join(right, [*keys, "part", "value"]).filter("a < b").withColumn("d", C("h").bitwiseXOR(C("g")))
    first = F.coalesce(*(F.when(F.bit_count(_part(C("d"), s, w)) <= vary, F.lit(k)) for k, (s, w) in enumerate(parts)))
    return met.filter((F.bit_count("d") <= radius) & (first == C("part"))).select(*keys, "a", "b", F.bit_count("d").alias("distance"))


def near_token_pairs(identities: DataFrame, signatures: DataFrame, distance: int = 8, bands: int | None = None, bits: int = 64) -> DataFrame:
    """Pairs (a, b) of one source with two title tokens in common and hashes within a distance: near_pairs within each source
    and pair of tokens, so that neither a common pair of tokens nor a common hash alone makes rows meet."""
    tokens = F.array_sort(T.title_tokens(C("title")))
    two = F.expr("flatten(transform(t, (x, i) -> transform(slice(t, i + 2, size(t)), y -> concat_ws(' ', x, y))))")
    rows = identities.join(signatures, "id").select("id", "source", "hash", tokens.alias("t"))
    rows = rows.withColumn("tokens", F.explode(two)).select("id", "source", "hash", "tokens")
    return near_pairs(rows, ["source", "tokens"], distance, bands, bits).select("a", "b").distinct()


def classes(rows: DataFrame, keys: list[str], kind: list[str] | None = None) -> DataFrame:
    """(class, id) of rows (id, keys) that share all keys with another: class is the least id of the key. Where an id has several
    keys, `kind` names those of them that tell classes of one least id apart, and the result has them too."""
    first = rows.groupBy(*keys).agg(F.min("id").alias("class"), F.count_distinct("id").alias("n")).filter("n > 1")
    return rows.join(first.hint("merge"), keys).select("class", *(kind or []), "id").distinct()


def title_classes(identities: DataFrame) -> DataFrame:
    """E1 as classes: identities of one source and normalised title."""
    return classes(identities.select("id", "source", T.normalize_title(C("title")).alias("t")).filter("t <> ''"), ["source", "t"])


def key_classes(identities: DataFrame) -> DataFrame:
    """E2 as classes (class, kind, id): identities of one source and normalised id (i), and those of one source and address (u);
    an id may be in two."""
    keys = F.array(F.concat(F.lit("i:"), T.normalize_source_id(C("source_id"))), F.concat(F.lit("u:"), T.canonical_url(C("url"))))
    rows = identities.select("id", "source", F.explode(keys).alias("k")).filter("k NOT IN ('i:', 'u:')")
    return classes(rows.withColumn("kind", F.substring("k", 1, 1)), ["source", "k", "kind"], ["kind"])


def expand(members: DataFrame) -> DataFrame:
    """All pairs (a < b) of ids that share a class (all columns but id)."""
    return key_pairs(members, [c for c in members.columns if c != "id"])


def pairs_apart(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ids share no class (members: class, id; an id is in one class at most)."""
    of = lambda p: members.select(C("id").alias(p), C("class").alias(f"__{p}"))
    out = pairs.join(of("a").hint("merge"), "a", "left").join(of("b").hint("merge"), "b", "left")
    return out.filter(~F.coalesce(C("__a") == C("__b"), F.lit(False))).select("a", "b")


def _set_of(columns: list[str]) -> Column:
    """A set of rows by its size and 128 bits of hashes of its members, whatever their order."""
    both = (F.sum(F.xxhash64(F.lit(k), *map(C, columns)).cast("decimal(38,0)")) for k in (1, 2))
    return F.struct(F.count("*").alias("n"), *(x.alias(f"h{k}") for k, x in enumerate(both)))


def _digest(c: Column) -> Column:
    """128 bits of a text's hash."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def child_profiles(children: DataFrame) -> DataFrame:
    """(id, kids): identities (identity_id, number; or gathered) of equal kids (n: how many) have the same set of numbers, by 128 bits."""
    kids = F.struct((F.size("items") + C("blanks")).cast("bigint").alias("n"), _digest(F.to_json(F.struct("items", "blanks"))).alias("h"))
    return gathered(children).select(C("identity_id").alias("id"), kids.alias("kids"))


def evidence_profiles(identities: DataFrame, children: DataFrame, external_ids: DataFrame, signatures: DataFrame) -> DataFrame:
    """(id, profile): identities of one profile are alike in all that evidence of pairs looks at: source, normalised title, id and
    address, title tokens, hash, children and external ids. Sets count by 128 bits of hashes of their members."""
    kids = child_profiles(children)
    ids = external_ids.select("identity_id", "provider", "value").distinct().groupBy(C("identity_id").alias("id")).agg(_set_of(["provider", "value"]).alias("ids"))
    own = identities.select("id", F.struct("source", T.normalize_title(C("title")).alias("t"), T.normalize_source_id(C("source_id")).alias("k"), T.canonical_url(C("url")).alias("u"), F.array_sort(T.title_tokens(C("title"))).alias("w")).alias("own"))
    rows = own.join(kids.hint("merge"), "id", "left").join(ids.hint("merge"), "id", "left").join(signatures.select("id", "hash").hint("merge"), "id", "left")
    return rows.select("id", _digest(F.to_json(F.struct("own", "kids", "ids", "hash"))).alias("profile"))


def class_pairs(members: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of a class once for each two profiles in it: (pairs (class, p, q, a, b, n), members (class, profile, id)).

    a and b are ids of the profiles p and q, of the same one the two least, and n pairs of members have their evidence; so a
    class makes rows by the number of its profiles, not of its members. Evidence of (a, b) holds for all of them, as evidence
    looks at profiles only and has no direction. Members are as many as identities, so they are dealt by id (an estimate from
    the size of a file would broadcast them); they and the pairs are written once for the steps that read them.
    """
    rows = write_table(members.join(profiles.hint("merge"), "id").select("class", "profile", "id"), "profiles")
    of = rows.groupBy("class", "profile").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    second = rows.join(of.select("class", "profile", "first").hint("merge"), ["class", "profile"]).filter("id > first").groupBy("class", "profile").agg(F.min("id").alias("second"))
    x, y = of.alias("x"), of.alias("y")
    apart = x.join(y.hint("merge"), F.expr("x.class = y.class AND x.profile < y.profile")).select(C("x.class").alias("class"), C("x.profile").alias("p"), C("y.profile").alias("q"), F.least("x.first", "y.first").alias("a"), F.greatest("x.first", "y.first").alias("b"), (C("x.size") * C("y.size")).alias("n"))
    same = of.join(second.hint("merge"), ["class", "profile"]).select("class", C("profile").alias("p"), C("profile").alias("q"), C("first").alias("a"), C("second").alias("b"), (C("size") * (C("size") - 1) / 2).cast("bigint").alias("n"))
    return write_table(apart.unionByName(same), "pairs"), rows


def expand_evidence(pairs: DataFrame, members: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence (a, b, ...) of class_pairs for every pair of members (a < b), once. The ids of one class and profile travel as
    arrays of a tile's length at most, so that pairs are made last and never dealt."""
    facts = [c for c in evidence.columns if c not in ("a", "b")]
    rows = pairs.join(evidence.hint("merge"), ["a", "b"]).select("class", "p", "q", *facts)
    listed = keys_listed(members.select("id", "profile", "class"), ["id", "profile"], "class")
    own = tiles(listed, ["id", "profile"], "class", tile_counts(listed, "class"))
    x, y = (own.select("class", C("profile").alias(p), F.struct("ids", "before", "sig").alias(i)) for p, i in (("p", "__x"), ("q", "__y")))
    left = dealt(rows, "class", "p").join(dealt(x, "class", "p").hint("merge"), ["class", "p"])
    met = dealt(left, "class", "q").join(dealt(y, "class", "q").hint("merge"), ["class", "q"]).filter(new_meeting("__x", "__y"))
    met = met.select((C("p") == C("q")).alias("__same"), C("__x.ids").alias("__xs"), C("__y.ids").alias("__ys"), *facts)
    out = met.select("__same", "__ys", *facts, F.explode("__xs").alias("__x")).select("__same", "__x", *facts, F.explode("__ys").alias("__y"))
    out = out.filter((C("__x") < C("__y")) | (~C("__same") & (C("__x") != C("__y"))))
    return out.select(F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b"), *facts)
