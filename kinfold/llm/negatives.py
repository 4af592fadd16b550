"""Hard negatives by Fagin's threshold algorithm over integer inner products.

Rows are stored in shards. A shard holds the integer components of its rows and, for each dimension, its rows in order of
their component. An anchor reads these lists from the end that its own component's sign favours, all to the same depth,
scores the rows it meets by random access, and stops once no row that it hasn't met can score as high as the k-th it has:
the threshold, the sum over dimensions of anchor times list value at the depth reached, lies strictly below.

Anchors visit the shards in blocks that are broadcast; a task keeps the best of each window over all of its shards.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import Tables, join_small

#: Components (rows times dimensions) of a shard and of a block of anchors, about; rows of a shard at most.
SHARD_CELLS, SHARD_ROWS, BLOCK_CELLS = 1 << 20, 4096, 1 << 22


def integer_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, d and x (floor(scale * component) as bigint) of the rows that take part, each once: those with vec_id,
    label and a vector of finite components, whose inner products fit 64 bits."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").withColumn("d", F.size("v"))
    v = v.filter(f"forall(v, e -> e IS NOT NULL AND abs(e) < sqrt(9.0e18 / (d + 1)) / {scale})")
    return v.select("vec_id", "label", "d", F.expr(f"transform(v, e -> cast(floor({scale} * e) as bigint))").alias("x")).distinct()


def build_shards(rows: DataFrame, cells: int = SHARD_CELLS, most: int = SHARD_ROWS) -> DataFrame:
    """One row a shard: d, ids and labels (int64), x (int64, row by row) and lists (int32, dimension by dimension: rows in rising
    order of the component). Labels of many rows have shards of their own, dealt by hash; the others share shards by label."""
    size = F.greatest(F.lit(64), F.least(F.lit(most), F.floor(cells / F.greatest("d", F.lit(1)))))
    labels = rows.groupBy("d", "label").agg(F.count("*").alias("n")).withColumn("size", size)
    small = labels.filter("n < size").groupBy("d").agg(F.ceil(F.sum("n") / F.max("size")).alias("pools"))  # a row a length
    labels = labels.join(F.broadcast(small), "d", "left")
    own = F.col("n") >= F.col("size")
    labels = labels.select("d", "label", F.when(own, F.col("label")).alias("of"), F.when(own, F.ceil(F.col("n") / F.col("size"))).otherwise(F.lit(1)).alias("chunks"), F.when(~own, F.pmod(F.xxhash64("label"), F.col("pools"))).otherwise(F.lit(0)).alias("pool"))
    dealt = join_small(rows, labels, ["d", "label"]).withColumn("chunk", F.col("pool") + F.pmod(F.xxhash64("vec_id", "x"), F.col("chunks")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        x = np.concatenate(pdf["x"].to_numpy()).astype(np.int64).reshape(len(pdf), d) if d else np.zeros((len(pdf), 0), np.int64)
        lists = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        return pd.DataFrame({"d": [d], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "labels": [pdf["label"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "lists": [np.ascontiguousarray(lists).tobytes()]})

    return dealt.groupBy("d", "of", "chunk").applyInPandas(pack, "d int, ids binary, labels binary, x binary, lists binary")


class Shard:
    def __init__(self, d: int, ids: bytes, labels: bytes, x: bytes, lists: bytes):
        self.d, self.ids, self.labels = d, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.x = np.frombuffer(x, np.int64).reshape(len(self.ids), d)
        self.lists = np.frombuffer(lists, np.int32).reshape(d, len(self.ids))
        self.most = int(np.abs(self.x).max(initial=0))
        self.kinds = np.unique(self.labels)
        self.as_float: dict = {}

    def numbers(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows and the anchor in the narrowest type in which every partial sum of their product is exact."""
        bound = self.d * self.most * int(np.abs(anchor).max(initial=0))
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        if kind not in self.as_float:
            self.as_float[kind] = self.x.astype(kind)
        return self.as_float[kind], anchor.astype(kind)


class Best:
    """The k best rows so far of one window: scores from low to high."""

    __slots__ = ("ids", "k", "low", "high", "scores")

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low
        some = np.flatnonzero((scores >= least) & (scores <= self.high))
        if not len(some):
            return
        if len(some) > 8 * self.k:  # the k best and the ties of the last
            kth = np.partition(scores[some], len(some) - self.k)[len(some) - self.k]
            some = some[scores[some] >= kth]
        scores, ids = np.concatenate([self.scores, scores[some]]), np.concatenate([self.ids, ids[some]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    def closed(self, threshold: int) -> bool:
        """Whether no row that scores `threshold` at most can enter."""
        return threshold < self.low or (len(self.scores) == self.k and threshold < self.scores[-1])


def threshold_search(shard: Shard, anchor: np.ndarray, allowed: np.ndarray, windows: list[Best]) -> int:
    """Offer rows of the shard for which `allowed` to the windows until none that is left can enter; how many were scored."""
    n = len(shard.ids)
    x, a = shard.numbers(anchor)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    seen, depth, step, scored = ~allowed, 0, max(8, n // 256), 0
    if not len(up) and not len(down):  # every row scores 0
        for w in windows:
            w.add(np.zeros(int(allowed.sum()), np.int64), shard.ids[allowed])
        return int(allowed.sum())
    while depth < n:
        end = min(n, depth + step)
        met = np.zeros(n, bool)
        met[shard.lists[up, n - end : n - depth]] = True
        met[shard.lists[down, depth:end]] = True
        new = np.flatnonzero(met & ~seen)
        seen |= met
        if len(new):
            scores, ids = (x[new] @ a).astype(np.int64), shard.ids[new]
            scored += len(new)
            for w in windows:
                w.add(scores, ids)
        depth, step = end, 2 * step
        edge = int(shard.x[shard.lists[up, n - end], up] @ anchor[up]) + int(shard.x[shard.lists[down, end - 1], down] @ anchor[down])
        if all(w.closed(edge) for w in windows):
            break
    return scored


_FOUND = "anchor bigint, vec_id bigint, low bigint, high bigint, score bigint"


def search(shards: DataFrame, anchors: pd.DataFrame, same_label: bool, k: int) -> DataFrame:
    """anchor, vec_id, low, high, score: for each window of each anchor (columns anchor, vec_id, label, x, windows: pairs of
    lowest and highest score) the k best rows of the shards of each task, of the anchor's label or of all others."""
    shared = shards.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        asked = [(n, v, lab, np.asarray(x, np.int64), [Best(k, int(lo), int(hi)) for lo, hi in w]) for n, v, lab, x, w in zip(table["anchor"], table["vec_id"], table["label"], table["x"], table["windows"])]
        for pdf in batches:
            for row in pdf[["d", "ids", "labels", "x", "lists"]].itertuples(index=False):
                shard = Shard(*row)
                for _, vec_id, label, x, windows in asked:
                    if len(x) != shard.d or (same_label and label not in shard.kinds) or not windows:
                        continue
                    allowed = ((shard.labels == label) == same_label) & (shard.ids != vec_id)
                    if allowed.any():
                        threshold_search(shard, x, allowed, windows)
        out = [(n, i, w.low, w.high, s) for n, _, _, _, windows in asked for w in windows for i, s in zip(w.ids.tolist(), w.scores.tolist())]
        yield pd.DataFrame(out, columns=["anchor", "vec_id", "low", "high", "score"])

    found = shards.mapInPandas(run, _FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "low", "high").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, tables: Tables, k: int = 5, positives: int = 5, percent: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding; anchors: those of its rows that ask. Components are floor(scale * x), scores integer
    inner products. An anchor's positives are the `positives` best rows of its label; for each, the k best rows of other labels
    that score from percent[0] to percent[1] hundredths of it. Higher scores come first, ties by smaller vec_id. Fewer where
    there are fewer.

    Rows with a null vec_id, label, vector or component, or one that isn't finite, take no part, nor do rows whose components
    are so large that scores leave 64 bits; rows that repeat count once; a row never answers an anchor of its own vec_id; rows
    of another length aren't compared. A vector without components scores 0 with its like. Other columns are ignored. Empty
    tables give an empty result. Tables of `tables`: `shards` and `anchors` are read while this runs, `negatives-...` by the
    result.
    """
    spark = vectors.sparkSession
    shards = tables.write(build_shards(integer_rows(vectors, scale)), "shards")
    ask = tables.write(integer_rows(anchors, scale).withColumn("h", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(1 << 20))), "anchors")
    total, cells = ask.agg(F.count("*"), F.sum(F.col("d") + 64)).first()
    blocks, out = -(-(cells or 0) // BLOCK_CELLS), None
    for b in range(blocks):  # bounded blocks of the query set against all shards
        block = ask.filter(F.col("h") % blocks == b).toPandas()
        if not len(block):
            continue
        block["anchor"] = np.arange(len(block))
        block["windows"] = [[(-(1 << 63), (1 << 63) - 1)]] * len(block)
        best = search(shards, block, True, positives).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).toPandas()
        lows = [-(-percent[0] * s // 100) for s in best["positive_score"].tolist()]
        highs = [percent[1] * s // 100 for s in best["positive_score"].tolist()]
        best = best.assign(low=np.array(lows, np.int64), high=np.array(highs, np.int64))
        windows: list[set] = [set() for _ in range(len(block))]
        for n, lo, hi in zip(best["anchor"].tolist(), lows, highs):
            if lo <= hi:
                windows[n].add((lo, hi))
        block["windows"] = [sorted(w) for w in windows]
        names = block[["anchor", "vec_id"]].rename(columns={"vec_id": "anchor_id"})
        asked = spark.createDataFrame(best.merge(names, on="anchor"), "anchor bigint, positive_id bigint, positive_score bigint, low bigint, high bigint, anchor_id bigint")
        found = search(shards, block, False, k).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        found = found.join(F.broadcast(asked), ["anchor", "low", "high"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        found = tables.write(found, f"negatives-{b}")
        out = found if out is None else out.unionByName(found)
    tables.drop("shards", "anchors")
    return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint") if out is None else out


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings, with every seventh label moved on by one; cases as in hard_negatives."""
    vectors = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")).select("vec_id", "label", "embedding")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long")))
    return hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"), Tables(spark, "negatives"))


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
found AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
          FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""
