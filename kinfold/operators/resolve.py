"""Entity resolution: blocking, evidence of pairs, scores, clusters and review proposals.

Identities have id, series_id, source, title, source_id, url; children identity_id, number; signatures id, hash (64 bits).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators.components import connected_components
from kinfold.operators.sets import gathered, key_meetings, key_pairs, set_overlap
from kinfold.session import cut, write_table

C = F.col


def block_exact_title(identities: DataFrame) -> DataFrame:
    """Same source, same normalised title."""
    rows = identities.select("id", "source", T.normalize_title(C("title")).alias("t")).filter("t <> ''")
    return key_pairs(rows, ["source", "t"])


def block_identity_key(identities: DataFrame) -> DataFrame:
    """Same source and same normalised id or address."""
    keys = F.array(F.concat(F.lit("i:"), T.normalize_source_id(C("source_id"))), F.concat(F.lit("u:"), T.canonical_url(C("url"))))
    rows = identities.select("id", "source", F.explode(keys).alias("k")).filter("k NOT IN ('i:', 'u:')")
    return key_pairs(rows, ["source", "k"])


def block_token_pair(identities: DataFrame, signatures: DataFrame, distance: int = 8) -> DataFrame:
    """Same source, two common title tokens, and hashes within a distance."""
    tokens = F.array_sort(T.title_tokens(C("title")))
    rows = identities.join(signatures, "id").select("id", "source", "hash", tokens.alias("t"))
    two = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice(C("t"), i + 2, F.size("t")), lambda y: F.concat_ws(" ", x, y))))
    rows = rows.select("id", "source", "hash", F.explode(two).alias("k"))
    near = F.expr(f"x.source = y.source AND x.k = y.k AND x.id < y.id AND bit_count(x.hash ^ y.hash) <= {distance}")
    return rows.alias("x").join(rows.alias("y"), near).select(C("x.id").alias("a"), C("y.id").alias("b")).distinct()


def block_title_or_alias(incoming: DataFrame, identities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(incoming, id) of another source whose normalised title is the incoming title or one of its aliases (array). Ids are
    keys of both tables."""
    names = incoming.select("id", "source", F.explode(F.array_union(F.array("title"), C("aliases"))).alias("title"))
    own = identities.select("id", "source", "title").unionByName(identities.join(aliases.select(C("identity_id").alias("id"), "alias"), "id").select("id", "source", C("alias").alias("title")))
    keyed = lambda df: df.select("id", "source", T.normalize_title(C("title")).alias("k")).filter("k <> ''")
    return key_meetings(keyed(names), keyed(own), ["id", "source"], ["source"]).select(C("a").alias("incoming"), C("b").alias("id"))


def external_conflicts(pairs: DataFrame, external: DataFrame) -> DataFrame:
    """For pairs (a, b): number of providers with different values on both sides, and of shared values."""
    own = external.select("identity_id", "provider", "value").distinct()
    both = pairs.select("a", "b").join(own.select(C("identity_id").alias("a"), "provider", C("value").alias("va")), "a").join(own.select(C("identity_id").alias("b"), "provider", C("value").alias("vb")), ["b", "provider"])
    return both.groupBy("a", "b").agg(F.count_distinct(F.when(C("va") != C("vb"), C("provider"))).alias("conflicts"), F.count_distinct(F.when(C("va") == C("vb"), F.concat_ws(":", "provider", "va"))).alias("shared"))


def _facts(pairs: DataFrame, identities: DataFrame, children: DataFrame, external: DataFrame, signatures: DataFrame) -> DataFrame:
    """What evidence looks at, of the identities that pairs (a, b) name: their children and external ids as arrays."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().hint("merge")
    own = identities.join(ids, "id", "left_semi").select("id", "source", T.normalize_title(C("title")).alias("title"), T.title_tokens(C("title")).alias("tokens"), T.normalize_source_id(C("source_id")).alias("key"), T.canonical_url(C("url")).alias("url"))
    kids = gathered(children).withColumnRenamed("identity_id", "id").join(ids, "id", "left_semi")
    other = external.select(C("identity_id").alias("id"), "provider", "value").join(ids, "id", "left_semi").groupBy("id").agg(F.collect_set(F.struct("provider", "value")).alias("ids"))
    return own.join(kids.hint("merge"), "id", "left").join(other.hint("merge"), "id", "left").join(signatures.select("id", "hash").hint("merge"), "id", "left")


def duplicate_evidence(pairs: DataFrame, identities: DataFrame, children: DataFrame, external: DataFrame, signatures: DataFrame, least: int = 5, ratio: float = 0.9, distance: int = 8) -> DataFrame:
    """Evidence on pairs (a, b) of one provider, and whether they are the same work."""
    pairs = write_table(pairs.select("a", "b"), "pairs")
    facts = write_table(_facts(pairs, identities, children, external, signatures), "facts")  # as many as identities at most
    side = lambda p: facts.select(*(C(c).alias(p if c == "id" else f"{p}_{c}") for c in facts.columns))
    # Common children count once for each row of a pair that comes several times.
    out = pairs.repartition("a").withColumn("times", F.count("*").over(Window.partitionBy("a", "b")))
    out = out.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    common = F.size(F.array_intersect("a_items", "b_items")) * C("times")
    out = out.withColumns({"common": F.coalesce(common, F.lit(0)), "smaller": F.least(*(F.coalesce(F.size(f"{p}_items") + C(f"{p}_blanks"), F.lit(0)).cast("bigint") for p in ("a", "b")))})
    out = out.withColumn("ratio", F.coalesce(F.try_divide("common", "smaller"), F.lit(0.0)))
    differ = F.exists("a_ids", lambda x: F.exists("b_ids", lambda y: (x["provider"] == y["provider"]) & (x["value"] != y["value"])))
    same_key = (C("a_source") == C("b_source")) & (((C("a_key") != "") & (C("a_key") == C("b_key"))) | ((C("a_url") != "") & (C("a_url") == C("b_url"))))
    tokens = F.size(F.array_intersect("a_tokens", "b_tokens"))
    out = out.select(
        "a", "b", "common", "smaller",
        F.bround("ratio", 4).alias("ratio"),
        same_key.alias("identity_equivalent"),
        ((C("a_title") != "") & (C("a_title") == C("b_title"))).alias("title_agrees"),
        (tokens >= 2).alias("tokens_agree"),
        ((C("smaller") >= least) & (C("ratio") >= ratio)).alias("strong_children"),
        T.hamming64(C("a_hash"), C("b_hash")).alias("distance"),
        F.coalesce(differ, F.lit(False)).alias("conflict"),
    )
    backed = C("strong_children") & ~C("conflict")
    return out.withColumn("equivalent", C("identity_equivalent") | (C("title_agrees") & backed) | ((C("distance") <= distance) & C("tokens_agree") & backed))


#: Aliases that name a page rather than a work.
POLLUTED = ("home", "manga list")


def title_score(pairs: DataFrame, titles: DataFrame, polluted: tuple[str, ...] = POLLUTED) -> DataFrame:
    """For pairs (a, b): the greatest similarity of their titles and aliases (titles: id, title). Similarities are
    computed once for each two texts, whatever the number of pairs that need them."""
    own = titles.filter(~F.lower(F.trim("title")).isin(*polluted)).select("id", T.normalize_title(C("title")).alias("t")).filter("t <> ''").distinct()
    each = pairs.select("a", "b").join(own.select(C("id").alias("a"), C("t").alias("x")), "a").join(own.select(C("id").alias("b"), C("t").alias("y")), "b")
    scored = each.select("x", "y").distinct().withColumn("s", T.matching_title_similarity(C("x"), C("y")))
    best = each.join(scored, ["x", "y"]).groupBy("a", "b").agg(F.max("s").alias("title"))
    return pairs.select("a", "b").join(best, ["a", "b"], "left").select("a", "b", F.coalesce("title", F.lit(0.0)).alias("title"))


def latest_similarity(a: Column, b: Column, buffer: float = 2, fade: float = 4) -> Column:
    """1 within the buffer, falling to 0 over `fade`, 0 if either is missing."""
    delta = F.abs(a - b)
    return F.coalesce(F.when(delta <= buffer, 1.0).when(delta <= buffer + fade, (1 - (delta - buffer) / fade).cast("double")).otherwise(0.0), F.lit(0.0))


def latest_evidence(a: Column, b: Column, buffer: float = 2, fade: float = 4) -> Column:
    """Struct of compared, delta, similarity and match (within the buffer); not compared if either is missing."""
    delta = F.abs(a - b)
    return F.struct(delta.isNotNull().alias("compared"), delta.alias("delta"), F.round(latest_similarity(a, b, buffer, fade), 6).alias("similarity"), F.coalesce(delta <= buffer, F.lit(False)).alias("match"))


def cover_state(distance: Column, inliers: Column, good: Column) -> Column:
    """E11."""
    ratio = inliers / F.greatest(good, F.lit(1))
    match = ((inliers >= 12) & (ratio >= 0.65) & (distance <= 18)) | ((inliers >= 4) & (ratio >= 0.6) & (distance <= 4))
    likely = ((inliers >= 8) & (ratio >= 0.5) & (distance <= 22)) | ((inliers >= 4) & (ratio >= 0.5) & (distance <= 10))
    return F.when(match, "match").when(likely, "likely").when((distance >= 28) & (inliers < 4), "different").otherwise("inconclusive")


def cover_similarity(state: Column, distance: Column, ratio: Column) -> Column:
    """E12."""
    raw = F.greatest(F.lit(0.0), 1.0 - distance / 32.0, ratio)
    return F.when(state == "match", F.greatest(raw, F.lit(0.98))).when(state == "likely", F.least(F.greatest(raw, F.lit(0.7)), F.lit(0.89))).when(state == "different", F.least(raw, F.lit(0.15))).otherwise(F.least(raw, F.lit(0.6)))


def best_cover_pair(pairs: DataFrame, identities: DataFrame, signatures: DataFrame) -> DataFrame:
    """For pairs of series (a, b): the best cover similarity over their identities, and the two ids (ties: lowest)."""
    own = identities.select("id", "series_id").join(signatures, "id")
    each = pairs.select("a", "b").join(own.select(C("series_id").alias("a"), C("id").alias("l"), C("hash").alias("lh")), "a").join(own.select(C("series_id").alias("b"), C("id").alias("r"), C("hash").alias("rh")), "b")
    distance = T.hamming64(C("lh"), C("rh"))
    state = F.when(distance <= 4, "match").when(distance <= 10, "likely").when(distance >= 28, "different").otherwise("inconclusive")
    each = each.withColumn("distance", distance).withColumn("state", state)
    each = each.withColumn("cover", cover_similarity(C("state"), C("distance"), F.lit(0.0)))
    best = F.max_by(F.struct("cover", "state", "l", "r"), F.struct(C("cover"), -C("l"), -C("r")))
    return each.groupBy("a", "b").agg(best.alias("x")).select("a", "b", "x.*")


def combined_score(title: Column, cover: Column, description: Column, children: Column, latest: Column, cover_match: Column) -> Column:
    """E15."""
    score = 0.20 * title + 0.55 * cover + 0.08 * description + 0.05 * children + 0.12 * latest
    strong = (latest == 1.0) | (F.greatest(title, description) >= 0.75)
    return F.when(cover_match, F.when(strong, F.greatest(score, F.lit(0.90))).otherwise(F.greatest(score, F.lit(0.86)))).otherwise(score)


def score_pairs(pairs: DataFrame, identities: DataFrame, aliases: DataFrame, children: DataFrame, external: DataFrame, signatures: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Pairs of series (a, b) with all evidence and a score: 0.99 with a shared external id, else at most 0.98.
    descriptions: id (of a series, one row each), text; a pair without both has a description similarity of 0."""
    of_series = identities.select(C("id").alias("identity_id"), "series_id")
    kids = children.join(of_series, "identity_id").select(C("series_id").alias("identity_id"), "number").distinct()
    ids = external.join(of_series, "identity_id").select(C("series_id").alias("identity_id"), "provider", "value")
    titles = identities.select(C("series_id").alias("id"), "title").unionByName(aliases.join(of_series, "identity_id").select(C("series_id").alias("id"), C("alias").alias("title")))
    last = kids.groupBy("identity_id").agg(F.max("number").alias("last"))
    pairs = cut(pairs.select("a", "b").distinct())  # four kinds of evidence start from them
    facts = last.select(C("identity_id").alias("id"), "last")
    facts = facts.join(descriptions.select("id", "text"), "id", "full") if descriptions is not None else facts.withColumn("text", F.lit(""))
    cover = best_cover_pair(pairs, identities, signatures)
    parts = [
        title_score(pairs, titles).select("a", "b", "title"), set_overlap(pairs, kids).select("a", "b", "jaccard"),
        external_conflicts(pairs, ids).select("a", "b", "shared"), cover.select("a", "b", F.struct("cover", "state", "l", "r").alias("__cover")),
    ]
    together = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    out = together.groupBy("a", "b").agg(F.max("title").alias("title"), F.max("jaccard").alias("jaccard"), F.max("shared").alias("shared"), F.max("__cover").alias("__cover")).select("a", "b", "title", "jaccard", "shared", "__cover.*")
    for p in ("a", "b"):
        out = out.join(facts.select(C("id").alias(p), C("last").alias(f"{p}_last"), C("text").alias(f"__{p}")), p, "left")
    out = out.withColumn("latest", latest_similarity(C("a_last"), C("b_last")))
    out = out.withColumn("description", F.lit(0.0) if descriptions is None else T.text_similarity(F.coalesce("__a", F.lit("")), F.coalesce("__b", F.lit(""))))
    match = F.coalesce(C("state") == "match", F.lit(False))
    score = combined_score(C("title"), F.coalesce("cover", F.lit(0.0)), C("description"), C("jaccard"), C("latest"), match)
    shared = F.coalesce(C("shared"), F.lit(0)) > 0
    return out.select("a", "b", F.bround("title", 6).alias("title"), F.bround(F.coalesce("cover", F.lit(0.0)), 6).alias("cover"), F.bround("jaccard", 6).alias("children"), F.bround("latest", 6).alias("latest"), F.bround("description", 6).alias("description"), (C("a_last").isNotNull() & C("b_last").isNotNull()).alias("latest_compared"), F.abs(C("a_last") - C("b_last")).alias("latest_delta"), F.coalesce("state", F.lit("")).alias("cover_state"), "l", "r", shared.alias("shared_external_id"), match.alias("cover_match"), F.when(shared, 0.99).otherwise(F.bround(F.least(score, F.lit(0.98)), 6)).alias("score"))


def best_selected(scored: DataFrame, candidate: str = "b", selected: str = "a") -> DataFrame:
    """The strongest selected partner of each candidate, ties to the lowest id."""
    return scored.groupBy(candidate).agg(F.max_by(F.struct(selected, "score"), F.struct(C("score"), -C(selected))).alias("x")).select(candidate, f"x.{selected}", "x.score")


def record_candidates(pairs: DataFrame, decisions: DataFrame, policy: str) -> DataFrame:
    """Pairs not decided on yet, in canonical order, as pending decisions."""
    new = pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).filter("left_id <> right_id").distinct()
    return new.join(decisions.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti").withColumn("decision", F.lit("pending")).withColumn("policy", F.lit(policy))


def greedy_cliques(pdf: pd.DataFrame) -> pd.DataFrame:
    """One component: ids in order join the first group all of whose members they are linked with (rows: root, a, b, a < b)."""
    links: dict[int, set[int]] = {}
    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    groups: list[list[int]] = []
    for x in sorted(links):
        home = next((g for g in groups if all(y in links[x] for y in g)), None)
        if home is None:
            groups.append([x])
        else:
            home.append(x)
    return pd.DataFrame([(x, g[0]) for g in groups for x in g], columns=["id", "clique"])


def title_classes(identities: DataFrame) -> DataFrame:
    """(id, rep): identities of one source and normalised title, and the least id among them; each class is a clique."""
    rows = identities.select("id", "source", T.normalize_title(C("title")).alias("t")).filter("t <> ''")
    return rows.join(rows.groupBy("source", "t").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n")).filter("n > 1"), ["source", "t"]).select("id", "rep").distinct()


def clique_groups(edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(id, clique): deterministic greedy cliques of an equivalence graph; a clique lies within one component.

    classes (id, rep: the least id) are sets whose members are all linked, and with the same others: edges then name
    representatives only, and members follow theirs, as the plain greedy would put them.
    """
    roots = connected_components(edges).select(C("node").alias("a"), "root")
    groups = edges.select("a", "b").distinct().join(roots, "a").groupBy("root").applyInPandas(greedy_cliques, "id bigint, clique bigint")
    if classes is None:
        return groups
    members = classes.join(groups.select(C("id").alias("rep"), "clique"), "rep", "left").select("id", F.coalesce("clique", "rep").alias("clique"))
    return members.unionByName(groups.join(classes.select("id"), "id", "left_anti"))


def _cluster_pairs(decisions: DataFrame, roots: DataFrame) -> DataFrame:
    """Pending decisions between two clusters, lo and hi the least ids of these."""
    out = decisions.filter("decision = 'pending'")
    for p in ("left", "right"):
        out = out.join(roots.select(C("node").alias(f"{p}_id"), C("root").alias(f"{p}_root")), f"{p}_id", "left").withColumn(f"{p}_c", F.coalesce(f"{p}_root", f"{p}_id"))
    return out.filter("left_c <> right_c").withColumn("lo", F.least("left_c", "right_c")).withColumn("hi", F.greatest("left_c", "right_c"))


def _members(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(lo, hi, member) of pairs of clusters; what belongs to no cluster is one of its own."""
    ends = pairs.select("lo", "hi").distinct().select("lo", "hi", F.explode(F.array("lo", "hi")).alias("root")).join(roots, "root", "left")
    return ends.select("lo", "hi", F.coalesce("node", "root").alias("member"))


def review_proposals(decisions: DataFrame, equivalences: DataFrame) -> DataFrame:
    """Pending decisions collapsed to pairs of clusters: representative (highest confidence, lowest id), number and ids
    of the decisions, and the members of both clusters; pairs within a cluster are dropped."""
    roots = connected_components(equivalences)
    out = _cluster_pairs(decisions, roots)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    pairs = out.groupBy("lo", "hi").agg(F.max_by("id", F.struct(C("confidence"), -C("id"))).alias("representative"), F.max("confidence").alias("confidence"), F.count("*").alias("decisions"), listed("id").alias("decision_ids"))
    members = _members(pairs, roots).groupBy("lo", "hi").agg(listed("member").alias("members"))
    return pairs.join(members, ["lo", "hi"])


def proposal_rows(decisions: DataFrame, equivalences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E22 without lists, for clusters of any size: (members (lo, hi, member), decisions (lo, hi, id))."""
    roots = connected_components(equivalences)
    out = _cluster_pairs(decisions, roots).select("lo", "hi", "id")
    return _members(out, roots), out


def proposal_components(proposals: DataFrame) -> DataFrame:
    """Proposals (lo, hi) that share a series are one batch: (lo, hi, batch)."""
    roots = connected_components(proposals.select(C("lo").alias("a"), C("hi").alias("b")))
    return proposals.select("lo", "hi").join(roots.select(C("node").alias("lo"), C("root").alias("batch")), "lo")


def provider_conflicts(groups: DataFrame, identities: DataFrame, children: DataFrame) -> DataFrame:
    """Groups (group_id, series_id) with two identities of one source that share neither key nor enough children
    (two of them, and half of the smaller side). Identities of a group and source that are alike in keys and children count
    as one, as they don't conflict and others conflict with all or none of them."""
    from kinfold.operators.blocking import child_profiles

    rows = groups.join(identities, "series_id").select("group_id", "id", "source", T.normalize_source_id(C("source_id")).alias("k"), T.canonical_url(C("url")).alias("u")).join(child_profiles(children), "id", "left")
    shared = rows.groupBy("group_id", "source").agg(F.count("*").alias("n")).filter("n > 1").select("group_id").distinct()
    rows = rows.groupBy("group_id", "source", "k", "u", "kids").agg(F.min("id").alias("id"))
    same = rows.alias("x").join(rows.alias("y"), F.expr("x.group_id = y.group_id AND x.source = y.source AND x.id < y.id")).select(C("x.group_id").alias("group_id"), C("x.id").alias("a"), C("y.id").alias("b"), ((C("x.k") == C("y.k")) | (C("x.u") == C("y.u"))).alias("key"))
    over = set_overlap(same.select("a", "b").distinct(), children)
    bad = ~C("key") & ((C("common") < 2) | ((C("smaller") > 0) & (C("ratio") < 0.5)))
    found = same.join(over, ["a", "b"]).groupBy("group_id").agg(F.bool_or(bad).alias("conflict"))
    return shared.join(found, "group_id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def blockers(proposals: DataFrame, conflicts: DataFrame, active: DataFrame, reserved: DataFrame) -> DataFrame:
    """Reasons against each proposal (id, series_id rows): conflicts (id), active work and reservations (series_id)."""
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = proposals.join(flag(active, "series_id", "w"), "series_id", "left").join(flag(reserved, "series_id", "r"), "series_id", "left").groupBy("id").agg(F.bool_or("w").alias("w"), F.bool_or("r").alias("r"))
    out = out.join(flag(conflicts, "id", "c"), "id", "left")
    labels = F.array_compact(F.array(F.when(C("c"), "provider_conflict"), F.when(C("w"), "active_work"), F.when(C("r"), "reserved")))
    return out.select("id", labels.alias("blockers"))


def hydrate(page: DataFrame, identities: DataFrame, columns: list[str]) -> DataFrame:
    """A page of pairs with details of both sides, fetched after the limit."""
    from kinfold.operators.relational import pair_sides

    return pair_sides(page, identities, columns)


def knn_ratio_matches(pairs: DataFrame, descriptors: DataFrame, ratio: float = 0.78) -> DataFrame:
    """For pairs (a, b): descriptors of a (id, d: 64 bits, k: which of its own) whose nearest of b is clearly nearer
    than the second. The descriptors of one picture, some hundred, are one array, so a pair is one row."""
    packed = descriptors.groupBy("id").agg(F.collect_list("d").alias("d"))
    each = pairs.select("a", "b").join(packed.select(C("id").alias("a"), C("d").alias("x")), "a").join(packed.select(C("id").alias("b"), C("d").alias("y")), "b")

    def two(x: Column) -> Column:
        """The least and the second least distance of x to y."""
        start = F.struct(F.lit(65).alias("n"), F.lit(65).alias("m"))
        closer = lambda s, h: F.struct(F.least(s["n"], h).alias("n"), F.least(s["m"], F.greatest(s["n"], h)).alias("m"))
        return F.aggregate("y", start, lambda s, y: closer(s, F.bit_count(x.bitwiseXOR(y))))

    good = F.size(F.filter(F.transform("x", two), lambda s: (s["m"] < 65) & (s["n"] < ratio * s["m"])))
    return each.select("a", "b", good.cast("long").alias("good"))


def match_external(snapshot: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each snapshot row (id, hint, ext, folder, title) to the one candidate (cid, ext, folder, title) of the first
    tier with exactly one: the hinted one if its title or external id agrees, external id, folder, title. Candidates are
    counted by key before anything is joined, so a folder or title of many gives one row."""
    s, c = snapshot.withColumn("t", T.normalize_title(C("title"))), candidates.withColumn("t", T.normalize_title(C("title")))
    hinted = s.join(c.select(C("cid").alias("hint"), C("ext").alias("__ext"), C("t").alias("__t")), "hint").filter((C("ext") == C("__ext")) | (C("t") == C("__t")))
    found = [hinted.select("id", C("hint").alias("cid"), F.lit(0).alias("tier")).distinct()]
    for i, key in enumerate(("ext", "folder", "t")):
        only = c.filter(C(key).isNotNull()).groupBy(key).agg(F.count_distinct("cid").alias("n"), F.min("cid").alias("cid")).filter("n = 1")
        found.append(s.select("id", key).join(only, key).select("id", "cid", F.lit(i + 1).alias("tier")))
    best = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min_by(F.struct("cid", "tier"), "tier").alias("x")).select("id", "x.*")
    return s.select("id").join(best, "id", "left")


def merge_candidates_ranked(shortlist: DataFrame, occupied: DataFrame, limit: int) -> DataFrame:
    """Shortlist (id, title, stored, fresh, source) without occupied sources, by the better score, title and id."""
    out = shortlist.join(occupied.select("source"), "source", "left_anti").withColumn("score", F.greatest(F.coalesce("stored", F.lit(0.0)), F.coalesce("fresh", F.lit(0.0))))
    return out.orderBy(F.desc("score"), "title", "id").limit(limit)


def batch_preview(proposals: DataFrame, reasons: DataFrame, excluded: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Selected, eligible and blocked numbers of the chosen proposals (id), or of the whole queue (id) but for exclusions
    (id); reasons: id, blockers. With columns lo and hi, proposals that share a series stand together: a reason against one of
    those selected is one against all of them."""
    rows = proposals.join(chosen.select("id"), "id", "left_semi") if chosen is not None else proposals.join(excluded.select("id"), "id", "left_anti")
    rows = rows.join(reasons, "id", "left").withColumn("bad", F.coalesce(F.size("blockers"), F.lit(0)) > 0)
    if "lo" in proposals.columns:
        batches = proposal_components(rows.select("lo", "hi").distinct())
        rows = rows.join(batches, ["lo", "hi"])
        rows = rows.select("id", "batch").join(rows.groupBy("batch").agg(F.bool_or("bad").alias("bad")), "batch")
    return rows.agg(F.count("*").alias("selected"), F.count_if(~C("bad")).alias("eligible"), F.count_if("bad").alias("blocked"))


def first_per_pair(rows: DataFrame, pair: list[str], order: list[str]) -> DataFrame:
    """One row for each pair, the first in order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*pair).orderBy(*order))).filter("__rn = 1").drop("__rn")


def recovery_match(legacy: DataFrame, by_identity: DataFrame, by_title: DataFrame) -> DataFrame:
    """Legacy rows (id, key, title) to current series: all that share an identity (key, series_id), else those of the
    normalised title (title, series_id); action by the number of matches. Series are counted by key before anything is joined:
    whether there are none, one or more is all that counts."""
    def matches(rows: DataFrame, series: DataFrame, key: str) -> DataFrame:
        of = series.groupBy(key).agg(F.min("series_id").alias("lo"), F.max("series_id").alias("hi"))
        found = rows.select("id", key).join(of, key).groupBy("id").agg(F.min("lo").alias("series_id"), F.max("hi").alias("hi"))
        return found.select("id", "series_id", (C("series_id") < C("hi")).alias("more"))

    titled = legacy.withColumn("t", T.normalize_title(C("title")))
    a = matches(legacy, by_identity, "key").withColumnRenamed("more", "a_more")
    b = matches(titled, by_title.withColumn("t", T.normalize_title(C("title"))), "t").select("id", C("series_id").alias("other"), C("more").alias("b_more"))
    out = legacy.select("id").join(a, "id", "left").join(b, "id", "left")
    to, more = F.coalesce("series_id", "other"), F.when(C("series_id").isNotNull(), C("a_more")).otherwise(C("b_more"))
    action = F.when(to.isNull(), "create_track").when(more, "review_merge").when(C("series_id").isNotNull(), "verified").otherwise("track")
    return out.select("id", to.alias("series_id"), action.alias("action"))
