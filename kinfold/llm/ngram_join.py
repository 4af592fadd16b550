"""Jaccard self-join over word shingles by universe-partition pigeonhole.

The universe of shingles is hashed into m segments. If two sets differ by at most H elements and the segments' credits
add up to H + 1, some segment with credit 1 is equal in both sets, or some segment with credit 2 differs by one element
at most. Sets are indexed in bands of their size; each emits a key for a segment of credit 1, and for one of credit 2 a
key for the segment and for each of its one-deletion neighbours. How many segments there are and how many of them get
credit 2 is chosen for each band by least cost. Sets that share a key are candidates, and candidates are verified exactly.

Only components are wanted, so a key that many sets share does not make all pairs: first each of them is verified against
one hub of the key; then only pairs of sets that still lie in different components. Where a key still has many of those (a
passage that many documents share), they meet in blocks if they are few enough; if not, they are keyed again by another
partition of the universe, and only those that share a key there too go on together.

Before sets are moved to be compared, their parity sketches are: bit i is the parity of the number of elements hashed to i,
so two sets differ by at least as many elements as their sketches differ by bits. What differs by too many is dropped,
exactly, at a thirtieth of the bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.bpe import slices
from kinfold.llm.common import Tables, cut, documents, join_small
from kinfold.operators.components import connected_components

C = F.col
_U = np.uint64
#: A key with more classes than this in different components goes to crowds().
CROWD = 16
#: Most sets that are compared with each other in one block, how many such blocks a crowd may have that is compared at
#: once, and how often a larger one is keyed again.
BLOCK_ROWS, DIRECT_BLOCKS, LEVELS = 8192, 4, 3
#: A key that HOT_LEAST rows of a sample (one in HOT_SHARE documents) have is dealt over SALTS tasks; HOT_MOST keys at most.
HOT_SHARE, HOT_LEAST, HOT_MOST, SALTS = 32, 64, 100_000, 256
#: Keys are dealt in so many parts, one after the other: nearly all keys are of one document only and go at the end of a part,
#: so what is on disk at once is a part of them. Each part makes the sets from the texts again.
PARTS = 2
#: Bits of the smallest and the greatest sketch.
LEAST_BITS, MOST_BITS = 1 << 8, 1 << 17
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, width: int = 4) -> np.ndarray:
    """64-bit hashes of the word shingles, sorted and distinct; A-Z count as a-z, a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, _U)
    w = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    size = min(width, len(w))
    h = np.full(len(w) - size + 1, _U(size))
    for k in range(size):
        h = mix(h * _A + w[k : len(w) - size + 1 + k])
    return np.unique(h)


def sketch(h: np.ndarray) -> bytes:
    """Parities of the numbers of elements in two to four times as many cells as there are elements."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * len(h)).bit_length()))
    return np.packbits(np.bincount((mix(h ^ _C) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(s: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) with as few words as `size`: the parities of cells that fall together are added."""
    while s.shape[-1] > size:
        s = s[..., : s.shape[-1] // 2] ^ s[..., s.shape[-1] // 2 :]
    return s


def most_difference(total: int, percent: int) -> int:
    """Greatest symmetric difference of two sets of `total` elements together that reach the similarity."""
    return (100 - percent) * total // (100 + percent)


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    segments: int
    double: int  # the first so many segments have credit 2


@lru_cache(4096)
def _tail(segments: int, empty: float, allowed: int) -> float:
    """Probability that more than `allowed` of the segments are empty (binomial)."""
    if allowed >= segments:
        return 0.0
    if allowed < 0:
        return 1.0
    mean = segments * empty
    if allowed > mean + 9 * math.sqrt(mean) + 9:
        return 0.0
    at_most = 0.0
    for k in range(allowed + 1):
        log = math.lgamma(segments + 1) - math.lgamma(k + 1) - math.lgamma(segments - k + 1) + k * math.log(max(empty, 1e-300)) + (segments - k) * math.log1p(-min(empty, 1 - 1e-12))
        at_most += math.exp(log)
    return max(0.0, 1.0 - at_most)


@lru_cache(8)
def bands(percent: int, growth: float = 1.5, short_cost: float = 5e5) -> list[Band]:
    """Bands of sizes up to 2**31. Cost of a band's split: keys of its largest sets, and short_cost times the probability
    that a set has too few segments that aren't empty (it must then be compared with all sets that miss the same ones)."""
    out, low = [], 1
    while low < 1 << 31:
        high = max(low, int(low * growth))
        need = most_difference(high + high * 100 // percent, percent) + 1
        best = None
        tops = {0, *(d for e in range(13) if (d := 1 << e) <= need // 2 + 1), (need + 1) // 2}
        for double in sorted(tops):
            least = max(double, need - double, 1)
            for extra in sorted({0, 1, 2, 3, 4, 6, 8, *(int(need * x / 50) for x in range(1, 16))}):
                m = least + extra
                keys = m + double * high / m
                risk = 0.0 if m == double else max(_tail(m - double, (1 - 1 / m) ** s, m + double - (most_difference(2 * s, percent) + 1)) for s in (low, high))
                cost = keys + short_cost * risk
                if best is None or cost < best[0]:
                    best = (cost, m, double)
        out.append(Band(len(out), low, high, best[1], best[2]))
        low = high + 1
    return out


def band_of(size: int, table: list[Band]) -> int:
    return int(np.searchsorted([b.high for b in table], size))


def keys(h: np.ndarray, percent: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, own and ask of a set: own rows stand for the set's own band, and a pair needs a row that is own and one that
    asks. Each level partitions the universe anew."""
    table, size = bands(percent), len(h)
    if level:
        h = np.sort(mix(h + mix(np.full(1, level, _U) * _A)))
    home = band_of(size, table)
    least = -(-percent * size // 100)
    mixed = mix(h ^ _A)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mixed)])
    found = []
    for b in table[max(0, home - 8) : home + 1]:
        own = b.number == home
        if b.high < least:
            continue
        m, d = b.segments, b.double
        seg = ((h >> _U(32)) * _U(m)) >> _U(32)  # ascending, as h is sorted
        start = np.searchsorted(seg, np.arange(m + 1, dtype=np.uint64))
        count = np.diff(start)
        sums = total[start[1:]] - total[start[:-1]]
        salt = mix(_U(b.number << 32) + np.arange(1, m + 1, dtype=np.uint64))
        whole = mix(sums + salt)
        credit = 2 * d + int((count[d:] > 0).sum())
        need = most_difference(size + min(b.high, size), percent) + 1
        single = np.flatnonzero(count[d:] > 0) + d
        if not own and credit > need:  # any segments will do: the fullest are the rarest
            single = single[np.argsort(-count[single], kind="stable")[: max(0, need - 2 * d)]]
        parts = [whole[:d], whole[single]]
        if d:
            at = np.flatnonzero(seg < d)
            parts.append(mix(sums[seg[at].astype(np.int64)] - mixed[at] + salt[seg[at].astype(np.int64)]))
        bare = np.flatnonzero(count[:d] < 2)  # empty, or empty but for one element
        k = np.setdiff1d(np.concatenate(parts), mix(salt[bare]))
        found.append((k, np.full(len(k), own), np.ones(len(k), bool)))
        found += _by_size(mix(salt[bare]), size, own, max(b.low, least), min(b.high, size))
        gaps = np.flatnonzero(count[d:] == 0) + d
        # Asked of sets so large that the differences may be as many as the credit.
        low = -(-credit * (100 + percent) // (100 - percent)) - size if credit < need else size + 1
        found += _by_size(mix(~salt[gaps]), size, own, max(b.low, least, low), min(b.high, size))
    return tuple(np.concatenate(x) for x in zip(*found))


def _by_size(voids: np.ndarray, size: int, own: bool, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of segments without elements, which say little: an own set has them with its size, and a set asks for each size
    from low to high. Without sizes all sets of a band that miss a segment would meet."""
    if not len(voids):
        return []
    asked = np.arange(low, high + 1, dtype=np.uint64)
    n = np.union1d(asked, _U(size)) if own else asked
    k = mix(voids[:, None] + mix(n * _A)).ravel()
    return [(k, np.tile(n == size, len(voids)) & own, np.tile((n >= low) & (n <= high), len(voids)))] if len(k) else []


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list]]:
    for pdf in batches:
        texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
        for part in slices(texts, 500_000):
            yield pdf["doc_id"].to_numpy()[part], texts[part]


def _sizes(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Size, two independent 64-bit sums and sketch of each set: equal sets have equal ones."""
    for ids, texts in _texts(batches):
        sets = [shingle_set(t, width) for t in texts]
        sums = {f: [int(mix(s + salt).sum(dtype=_U).astype(np.int64)) for s in sets] for f, salt in (("f1", _B), ("f2", _A))}
        yield pd.DataFrame({"doc_id": ids, "n": [len(s) for s in sets], **sums, "s": [sketch(s) for s in sets]})


def _keys(batches: Iterator[pd.DataFrame], width: int, percent: int, level: int, part: int = 0, parts: int = 1) -> Iterator[pd.DataFrame]:
    """Keys of the sets, of one of `parts` parts."""
    for ids, texts in _texts(batches):
        rows = [(i, len(s), keys(s, percent, level)) for i, t in zip(ids, texts) if len(s := shingle_set(t, width))]
        if rows:
            doc, n, found = zip(*rows)
            key, own, ask = (np.concatenate(x) for x in zip(*found))
            count = [len(k) for k, _, _ in found]
            doc, code = np.repeat(doc, count), np.repeat(n, count) * 4 + own * 2 + ask
            at = key % _U(parts) == part
            yield pd.DataFrame({"key": key[at].astype(np.int64), "doc": doc[at], "code": code[at]})


def _sets(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for ids, texts in _texts(batches):
        yield pd.DataFrame({"doc": ids, "n": 0, "s": [shingle_set(t, width).tobytes() for t in texts]})


def _maybe(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs whose sketches differ by no more bits than similar sets can differ by elements."""
    for pdf in batches:
        keep = []
        for x, y, total in zip(pdf["x"], pdf["y"], pdf["nx"] + pdf["ny"]):
            p, q = np.frombuffer(x, _U), np.frombuffer(y, _U)
            size = min(len(p), len(q))
            keep.append(int(np.bitwise_count(folded(p, size) ^ folded(q, size)).sum()) <= most_difference(total, percent))
        yield pdf.loc[keep, ["a", "b"]]


def _linked(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for x, y in zip(pdf["x"], pdf["y"]):
            p, q = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = len(p) + len(q) - len(np.union1d(p, q))
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        yield pdf.loc[keep, ["a", "b"]]


def _block(g: pd.DataFrame, percent: int) -> np.ndarray:
    """Pairs (a, b), a < b, of one block (rows of blocks i and j) with different labels whose sizes and sketches are near."""
    g = g.sort_values("n")
    n, rep, label, block = (g[c].to_numpy() for c in ("n", "rep", "label", "block"))
    cross, words = g["i"].iloc[0] != g["j"].iloc[0], np.array([len(s) // 8 for s in g["s"]])
    level = {int(w): np.stack([folded(np.frombuffer(s, _U), int(w)) for s, k in zip(g["s"], words) if k >= w]) for w in np.unique(words)}
    out = []
    for i in range(len(g)):
        # Sizes ascend, so what is folded to this row's sketch are the rows from the first of its length on.
        last = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
        if last <= i + 1:
            continue
        own = level[int(words[i])]
        first = len(g) - len(own)
        bits = np.bitwise_count(own[i + 1 - first : last - first] ^ own[i - first]).sum(axis=1)
        near = bits <= (100 - percent) * (n[i] + n[i + 1 : last]) // (100 + percent)
        near &= label[i + 1 : last] != label[i]
        if cross:
            near &= block[i + 1 : last] != block[i]
        at = np.flatnonzero(near) + i + 1
        out.append(np.stack([np.minimum(rep[i], rep[at]), np.maximum(rep[i], rep[at])], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _blocks(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    found = [_block(g, percent) for _, g in pdf.groupby(["key", "i", "j"], sort=False)]
    return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])


class Join:
    """One run of the join over docs (doc_id, text): where its tables are, and how sets, sketches and keys are had."""

    def __init__(self, docs: DataFrame, percent: int, width: int):
        self.docs, self.percent, self.width = docs, percent, width
        self.tables = Tables(docs.sparkSession, "ngram-join")
        self.sketches: DataFrame | None = None

    def texts_of(self, ids: DataFrame, how: str = "left_semi") -> DataFrame:
        """The documents whose doc_id is (or, left_anti, is not) in ids (doc_id, distinct)."""
        return join_small(self.docs, ids, ["doc_id"], how, max_rows=1_000_000, salts=1)

    def keys_of(self, docs: DataFrame, level: int, part: int = 0, parts: int = 1) -> DataFrame:
        """key, doc, code (size * 4 + own * 2 + ask), of one of `parts` parts of the keys."""
        width, percent = self.width, self.percent
        return docs.mapInPandas(lambda it: _keys(it, width, percent, level, part, parts), "key bigint, doc bigint, code bigint")

    def with_sets(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) with their sets (or sketches) x and y and sizes. Only those that a pair needs are moved: those
        of a, which has few partners, to the task of b, of which there are fewer."""

        def of(side: str, name: str) -> DataFrame:
            needed = join_small(sets, pairs.select(C(side).alias("doc")).distinct(), ["doc"], "left_semi", salts=1)
            return needed.select(C("doc").alias(side), C("s").alias(name), C("n").alias(f"n{name}"))

        return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y", "nx", "ny")

    def sift(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches may belong to similar sets."""
        percent = self.percent
        return self.with_sets(pairs, self.sketches).mapInPandas(lambda it: _maybe(it, percent), "a bigint, b bigint").distinct()

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of a table whose sets reach the similarity, written as table `name`. Sets are made again from
        the texts of the documents in question."""
        percent, width, t = self.percent, self.width, self.tables
        needed = cut(pairs.selectExpr("explode(array(a, b)) AS doc_id").distinct())
        sets = t.write(self.texts_of(needed).mapInPandas(lambda it: _sets(it, width), "doc bigint, n bigint, s binary"), f"{name}-sets")
        out = t.write(self.with_sets(pairs, sets).mapInPandas(lambda it: _linked(it, percent), "a bigint, b bigint").distinct(), name)
        t.drop(f"{name}-sets")
        return out

    def shared_keys(self, docs: DataFrame) -> DataFrame:
        """key, doc, n, own, ask, hub, hub_n: rows of keys that several documents have, some of them own and some asking.
        The hub is the smallest own document. Keys that are hot in a sample are dealt over tasks, each with a hub of its
        own, which give way to one of the whole key afterwards. Part after part is dealt and written."""
        t = self.tables
        sample = self.keys_of(docs.filter(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(HOT_SHARE)) == 0), 0)
        hot = cut(sample.groupBy("key").agg(F.count("*").alias("c")).filter(C("c") >= HOT_LEAST).orderBy(F.desc("c")).limit(HOT_MOST).select("key", F.lit(True).alias("hot")))
        written = []
        for part in range(PARTS):
            rows = self.keys_of(docs, 0, part, PARTS).join(F.broadcast(hot), "key", "left")  # HOT_MOST rows at most
            rows = rows.select("key", "doc", "code", F.when(C("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int") + 1).otherwise(0).alias("salt"))
            key = Window.partitionBy("key", "salt")
            rows = rows.withColumns({"hub": F.min(F.expr("IF(code & 2 = 2, struct(doc, shiftright(code, 2) AS n), NULL)")).over(key), "asked": F.max(F.expr("code & 1")).over(key), "c": F.count("*").over(key)})
            written.append(t.write(rows.filter("salt > 0 OR (c > 1 AND hub IS NOT NULL AND asked = 1)").drop("c"), f"keys/{part}"))
        rows = reduce(DataFrame.union, written)
        flags = ["key", "doc", F.expr("shiftright(code, 2) AS n"), F.expr("code & 2 = 2 AS own"), F.expr("code & 1 = 1 AS ask")]
        ours = join_small(rows.filter("salt > 0").drop("hub"), rows.filter("salt > 0").groupBy("key").agg(F.min("hub").alias("hub"), F.max("asked").alias("some"), F.count("*").alias("c")).filter("c > 1 AND hub IS NOT NULL AND some = 1").select("key", "hub"), ["key"])
        hub = ["hub.doc AS hub", "hub.n AS hub_n"]
        return rows.filter("salt = 0").select(*flags, *map(F.expr, hub)).unionByName(ours.select(*flags, *map(F.expr, hub)))

    def crowds(self, rows: DataFrame) -> DataFrame:
        """Candidates (a < b) among the classes (rep, label) of each key, for keys that many of them share.

        Keys of one hub are taken together. Up to BLOCK_ROWS classes meet in one block, DIRECT_BLOCKS times as many block by
        block; still more are keyed again, LEVELS times at most (a passage that all share gives few common keys there), and
        what is then left meets block by block.
        """
        t, found = self.tables, []
        crowd = rows.join(rows.groupBy("key").agg(F.min("rep").alias("g")), "key").select(C("g").alias("key"), "rep", "label", F.lit(True).alias("own"), F.lit(True).alias("ask"))
        most = BLOCK_ROWS * DIRECT_BLOCKS
        for level in range(1, LEVELS + 2):
            crowd = t.write(crowd.groupBy("key", "rep", "label").agg(F.bool_or("own").alias("own"), F.bool_or("ask").alias("ask")), f"crowd-{level}")
            sizes = crowd.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.bool_or("own").alias("o"), F.bool_or("ask").alias("q"))
            sized = t.write(crowd.join(sizes.filter("l0 <> l1 AND o AND q").select("key", "c"), "key"), f"sized-{level}")
            t.drop(f"crowd-{level}")
            last = level > LEVELS
            found.append(t.write(self.compare(sized if last else sized.filter(C("c") <= most)), f"found-{level}"))
            big = sized.filter(C("c") > most)
            if last or not big.limit(1).count():
                t.drop(f"sized-{level}")
                break
            again = self.keys_of(self.texts_of(cut(big.select(C("rep").alias("doc_id")).distinct())), level)
            crowd = big.select(C("key").alias("g"), C("rep").alias("doc"), "label").join(again, "doc")
            crowd = crowd.select(F.xxhash64("g", "key").alias("key"), C("doc").alias("rep"), "label", F.expr("code & 2 = 2 AS own"), F.expr("code & 1 = 1 AS ask"))
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def compare(self, rows: DataFrame) -> DataFrame:
        """Candidates among the classes of each key (key, rep, label, c): its blocks of about BLOCK_ROWS, two by two."""
        percent = self.percent
        rows = rows.withColumn("blocks", F.ceil(C("c") / BLOCK_ROWS).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), C("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), C("blocks") - 1))).select("key", "rep", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        buckets = max(1, -(-rows.count() // BLOCK_ROWS))
        known = join_small(self.sketches, rows.select(C("rep").alias("doc")).distinct(), ["doc"], "left_semi", salts=1)
        rows = rows.join(known.withColumnRenamed("doc", "rep"), "rep").withColumn("bucket", F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets)))
        return rows.groupBy("bucket").applyInPandas(lambda pdf: _blocks(pdf, percent), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 4) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text; other columns are ignored).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of shingles, over whole texts of any
    length. No text or no words: an empty set, linked with nothing. Equal sets are one class, represented by its smallest
    doc_id; links between classes are found without a cap. Rows that share a doc_id are one document with several texts:
    it links if one of them does. A null doc_id takes no part and gets a null component. Empty table: empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    join = Join(docs, percent, width)
    t = join.tables
    sizes = t.write(docs.mapInPandas(lambda it: _sizes(it, width), "doc_id bigint, n bigint, f1 bigint, f2 bigint, s binary"), "sizes")
    full = sizes.filter("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    member = t.write(full.drop("s").join(classes, ["n", "f1", "f2"]).select(C("doc_id").alias("doc"), "rep", "n"), "members")
    reps = member.filter("doc = rep").select("doc")
    copies = member.filter("doc <> rep").select("doc").distinct().join(reps, "doc", "left_anti").withColumnRenamed("doc", "doc_id")
    join.sketches = full.select(C("doc_id").alias("doc"), "n", "s")

    shared = join.shared_keys(join.texts_of(cut(copies), "left_anti").filter("doc_id IS NOT NULL"))
    star = shared.filter(f"ask AND doc <> hub AND 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select(C("doc").alias("a"), C("hub").alias("b"))
    star = t.write(star.distinct(), "hub-pairs")
    links = join.links(t.write(join.sift(star), "hub-near"), "hub-links")
    labels = connected_components(links)

    # What shares a key but not yet a component: one row for each key and class.
    left = shared.select("key", C("doc").alias("rep"), "n", "own", "ask").join(labels.selectExpr("node AS rep", "root"), "rep", "left")
    left = left.groupBy("key", "rep", "n", F.coalesce("root", "rep").alias("label")).agg(F.max("own").alias("own"), F.max("ask").alias("ask"))
    mixed = left.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("c")).filter("l0 <> l1").select("key", (C("c") > CROWD).alias("crowd"))
    left = t.write(left.join(mixed, "key"), "open-keys")
    t.drop("keys")
    x, y = left.filter("NOT crowd").alias("x"), left.filter("NOT crowd").alias("y")
    cross = x.join(y, F.expr(f"x.key = y.key AND x.rep < y.rep AND x.label <> y.label AND (x.own AND y.ask OR x.ask AND y.own) AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"))
    tried = star.selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    cross = t.write(cross.selectExpr("x.rep AS a", "y.rep AS b").distinct().join(tried, ["a", "b"], "left_anti"), "cross-pairs")
    near = join.sift(cross)
    if left.filter("crowd").limit(1).count():
        near = near.union(join.crowds(left.filter("crowd").select("key", "rep", "label"))).distinct().join(tried, ["a", "b"], "left_anti")
    near = t.write(near, "cross-near")
    if near.limit(1).count():
        labels = connected_components(links.union(join.links(near, "cross-links")))

    whole = member.join(labels.selectExpr("node AS rep", "root"), "rep", "left").selectExpr("doc AS doc_id", "n AS n_shingles", "coalesce(root, rep) AS component_id")
    rest = sizes.filter("n = 0 OR doc_id IS NULL").selectExpr("doc_id", "n AS n_shingles", "doc_id AS component_id")
    return whole.unionByName(rest)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
