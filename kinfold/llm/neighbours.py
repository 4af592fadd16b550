"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and
assigns them to the nearest signed axis. Queries probe the next nearest axes of each table as well; the candidates of a
bucket are ranked by exact cosine, block by block, and the best of all blocks win.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import join_small, write_table


def rotate(x: np.ndarray, table: int, turn: int = 0) -> np.ndarray:
    """The pseudo-rotation of a table: rows padded to a power of two, three rounds of signs and Hadamard transform."""
    d = 1 << max(0, math.ceil(math.log2(max(1, x.shape[1]))))
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    signs = np.random.Generator(np.random.PCG64([table, turn])).choice([-1.0, 1.0], (3, d))
    for s in signs:
        y = y * s
        h = 1
        while h < d:
            z = y.reshape(len(x), d // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(x), d)
            h *= 2
        y /= math.sqrt(d)
    return y


def axes(x: np.ndarray, table: int, fine: int) -> list[np.ndarray]:
    """Nearness to each signed axis; with fine > 0 also to 2**fine signed axes of a second rotation."""
    y = rotate(x, table)
    found = [np.hstack([y, -y])]
    if fine:
        z = rotate(x, table, 1)[:, : 1 << (fine - 1)]
        found.append(np.hstack([z, -z]))
    return found


def bucket(x: np.ndarray, table: int, fine: int) -> np.ndarray:
    parts = axes(x, table, fine)
    out = parts[0].argmax(axis=1)
    return out if not fine else (out << fine) + parts[1].argmax(axis=1)


def probes(x: np.ndarray, table: int, fine: int, count: int) -> np.ndarray:
    """The count most likely buckets of each row, by the squared distance that its values lack to the nearest axis."""
    loss = [(p.max(axis=1, keepdims=True) - p) ** 2 for p in axes(x, table, fine)]
    total = loss[0] if not fine else (loss[0][:, :, None] + loss[1][:, None, :]).reshape(len(x), -1)
    return np.argsort(total, axis=1, kind="stable")[:, :count]


def stacked(vectors: pd.Series) -> np.ndarray:
    """Rows of doubles, each times a power of two that brings its greatest component near one: cosines stay the same, and no
    square over- or underflows."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(vectors: pd.Series) -> np.ndarray:
    x = stacked(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the vectors that take part: not null, finite, not zero, of the commonest length. Arrays of float stay
    so (half the bytes to move, the same numbers); any others become arrays of double."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    v = v.filter("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    lengths = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return v.filter(F.size("v") == (lengths[0]["d"] if lengths else 0))


def _best(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query within one block, scored in double precision one pair at a time."""
    x, y = stacked(q["v"]), stacked(c["v"])
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    near = (x / nx[:, None]) @ (y / ny[:, None]).T
    qid, cid = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
    near[qid[:, None] == cid[None, :]] = -np.inf
    least = np.full((len(q), 1), -2.0)
    if near.shape[1] > k:
        least = np.maximum(least, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None] - 1e-9)
    a, b = np.nonzero(near >= least)  # ties of the k-th, too
    score = (x[a] * y[b]).sum(axis=1) / (nx[a] * ny[b])
    order = np.lexsort((cid[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return pd.DataFrame({"query_id": qid[a[keep]], "vec_id": cid[b[keep]], "score": score[keep]})


_PAIR = "query_id bigint, vec_id bigint, score double"


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Probes of a table among which tune() chooses.
PROBES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)


def tune(vectors: DataFrame, queries: DataFrame, k: int, tables: int, fine: int, recall: float, sample: int) -> tuple[int, float]:
    """Probes of each table with which a hash-chosen sample of queries finds the asked share of its exact neighbours, and the
    share that it finds; with fewer than asked, no number of PROBES is enough.

    The sample has `sample` queries at most, whatever the size of the tables; its exact neighbours come from one scan.
    """
    asked = queries.orderBy(F.xxhash64(F.lit("tune"), "vec_id"), "vec_id").limit(sample)
    truth = scan(vectors, asked, k)
    if truth is None:
        return PROBES[0], 1.0
    ends = truth.select("query_id", "vec_id").toPandas()  # sample * k rows
    known = vectors.join(F.broadcast(truth.select("vec_id").union(truth.select("query_id")).distinct()), "vec_id", "left_semi").dropDuplicates(["vec_id"]).toPandas()
    if not len(ends):
        return PROBES[0], 1.0
    at = pd.Series(np.arange(len(known)), known["vec_id"])
    x, q, c = unit(known["v"]), at[ends["query_id"]].to_numpy(), at[ends["vec_id"]].to_numpy()
    place = np.full(len(ends), np.iinfo(np.int64).max)  # of the candidate's bucket among the query's probes, in the best table
    for t in range(tables):
        order = np.argsort(probes(x, t, fine, 1 << 30), axis=1)
        place = np.minimum(place, order[q, bucket(x, t, fine)[c]])
    count = next((p for p in PROBES if (place < p).mean() >= recall), PROBES[-1])
    return count, float((place < count).mean())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = 32, rows_per_bucket: int = 1000, block_rows: int = 4096, block_queries: int = 512, recall: float = 0.96, sample: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors (vec_id, embedding) found for each row of queries.

    Buckets hold about rows_per_bucket rows: past 2 * dimensions buckets a second rotation splits them. How many buckets of
    each table a query probes is measured (see tune): as many as give the asked recall on a sample of `sample` queries. If even
    the most probes don't, all queries are answered by a scan of all rows, in blocks: the answer is then exact. A bucket of more than block_rows rows or block_queries queries (a common vector) is dealt over several tasks, none is cut
    off. Queries for which the buckets hold fewer than k others are answered by a scan of all rows, in blocks. Rows of equal
    vec_id count as one vector at several places. A query never finds its own vec_id. Ties go to the smaller vec_id. Other
    columns are ignored. Empty tables give an empty result.
    """
    vectors = write_table(usable(vectors), "vectors")
    queries = write_table(usable(queries), "vector-queries")
    n = vectors.count()
    d = vectors.select(F.size("v").alias("d")).first()
    axis_count = 2 << max(0, math.ceil(math.log2(max(1, d["d"] if d else 1))))
    fine = max(0, math.floor(math.log2(max(1, n / (axis_count * rows_per_bucket)))))
    fine = min(fine, axis_count.bit_length() - 2)
    count, reached = tune(vectors, queries, k, tables, fine, recall, sample)
    if reached < recall:
        return scan(vectors, queries, k, block_queries)
    count = min(count, axis_count << fine)
    step = max(1, (1 << 22) // max(axis_count << fine, tables * count))  # rows whose buckets are ordered at once

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = unit(pdf["v"])
                codes = np.stack([bucket(x, t, fine) for t in range(tables)], axis=1)
                yield pdf.assign(codes=list(codes.astype(np.int64)))

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), step):
                pdf = batch.iloc[i : i + step]
                x = unit(pdf["v"])
                codes = np.stack([probes(x, t, fine, count) for t in range(tables)], axis=1).reshape(len(pdf), -1)
                yield pdf.assign(codes=list(codes.astype(np.int64)))

    schema = f"vec_id bigint, v {dict(vectors.dtypes)['v']}, codes array<bigint>"
    here = vectors.mapInPandas(placed, schema).select("vec_id", "v", F.posexplode("codes").alias("table", "bucket"))
    ask = queries.mapInPandas(probing, schema).select("vec_id", "v", F.posexplode("codes").alias("table", "bucket")).withColumn("table", F.floor(F.col("table") / count).cast("int"))
    sizes = here.groupBy("table", "bucket").agg(F.count("*").alias("rows"))
    asked = ask.groupBy("table", "bucket").agg(F.count("*").alias("queries"))
    deal = sizes.join(asked, ["table", "bucket"]).select("table", "bucket", F.ceil(F.col("rows") / block_rows).cast("int").alias("row_parts"), F.ceil(F.col("queries") / block_queries).cast("int").alias("query_parts"))
    deal = write_table(deal, "buckets")
    part = lambda c: F.pmod(F.xxhash64("vec_id", "v"), F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    here = join_small(here, deal, ["table", "bucket"]).withColumn("row_part", part("row_parts")).withColumn("query_part", all_of("query_parts"))
    ask = join_small(ask, deal, ["table", "bucket"]).withColumn("query_part", part("query_parts")).withColumn("row_part", all_of("row_parts"))
    key = ["table", "bucket", "row_part", "query_part"]

    def rank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return _best(q, c, k) if len(q) and len(c) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    pairs = ask.select(*key, "vec_id", "v").groupBy(*key).cogroup(here.select(*key, "vec_id", "v").groupBy(*key)).applyInPandas(rank, _PAIR)
    found = write_table(_ranked(pairs, k), "neighbours")
    short = queries.join(found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    rest = scan(vectors, short, k, block_queries)
    return found if rest is None else found.join(rest.select("query_id"), "query_id", "left_anti").unionByName(rest)


def scan(vectors: DataFrame, queries: DataFrame, k: int, block_queries: int = 512) -> DataFrame | None:
    """Exact answers: every block of queries goes to all tasks, which keep k rows for each; None without queries."""
    ids = write_table(queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 16)).alias("h")), "scan-queries")
    total = ids.count()
    if not total:
        return None
    blocks, out = -(-total // block_queries), None
    for b in range(blocks):
        block = ids.filter(F.col("h") % blocks == b).toPandas()
        if not len(block):
            continue
        shared = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield _best(shared.value, pdf, k)

        one = _ranked(vectors.mapInPandas(run, _PAIR), k)
        out = one if out is None else out.unionByName(one)
    return write_table(out, "scanned")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")).select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)
