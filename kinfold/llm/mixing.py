"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a mean repetition rate (target rows over rows there are). The count of copies of a document is the
inverse Poisson distribution function at a uniform number made from a hash of seed and doc_id, so it depends on
nothing else: any task can compute it, again and again, without coordination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import documents, join_small, let

#: A mean above this is split into equal parts with draws of their own, so that exp(-mean) stays exact enough.
PART_MEAN, LAST_COUNT = 16, 80


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """source, n_rows, rate: the mean number of copies. weights: shares of the output by source (sources not named get
    none); without them a source's share is its number of rows to the power of temperature. Output has epochs times the
    rows of the input on average. A null source is a source of its own, named null."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_rows"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(temperature)))
    else:
        given = [F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()]
        sizes = sizes.withColumn("weight", F.coalesce(*given, F.lit(0.0)) if given else F.lit(0.0))
    total = sizes.agg(F.sum("n_rows").alias("all_rows"), F.sum("weight").alias("all_weight"))
    out = sizes.crossJoin(F.broadcast(total))  # one row
    return out.select("source", "n_rows", F.coalesce(F.try_divide(epochs * F.col("all_rows") * F.col("weight"), F.col("all_weight") * F.col("n_rows")), F.lit(0.0)).alias("rate"))


def with_cdf(table: DataFrame) -> DataFrame:
    """Add parts (bigint) and cdf: the Poisson distribution function of rate / parts at 0..LAST_COUNT."""
    table = table.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("long"))
    cdf = F.expr(f"""
        element_at(transform(array(rate / parts), m ->
          aggregate(sequence(1, {LAST_COUNT}),
                    named_struct('p', exp(-m), 'sum', exp(-m), 'cdf', array(exp(-m))),
                    (a, k) -> named_struct('p', a.p * m / k, 'sum', a.sum + a.p * m / k, 'cdf', concat(a.cdf, array(a.sum + a.p * m / k))),
                    a -> a.cdf)), 1)""")
    return table.withColumn("cdf", cdf)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """Each document as often as its Poisson draw says, with copy (from 1) and shuffle_key, in order of shuffle_key.

    Rows of one doc_id get the same draw; a null doc_id is drawn as one id. Null texts are replicated as any other.
    Columns named copy or shuffle_key are replaced. Empty table: empty result.
    """
    docs = docs.drop("copy", "shuffle_key")
    table = with_cdf(rates(docs, weights, temperature, epochs))
    table = table.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("__key"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    out = join_small(docs.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))), table, ["__key"], max_rows=20_000)  # 82 numbers a source
    draw = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("__parts")), F.lit(0), lambda a, j: a + _inverse(uniform(F.lit(seed), F.col("doc_id"), j)))
    out = out.withColumn("__n", draw).filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__key", "__parts", "__cdf", "__n")
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("order"), F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("copy"))), 1, 15), 16, 10).cast("long")
    out = out.withColumn("shuffle_key", key)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, "shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


def _inverse(u: Column) -> Column:
    return let(u, lambda x: F.size(F.filter(F.col("__cdf"), lambda c: c <= x)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"))


OP3_SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n_rows, count(*) ** 0.5 AS weight FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n_rows) FROM sizes) * weight / ((SELECT sum(weight) FROM sizes) * n_rows) AS rate FROM sizes),
parts AS (SELECT *, greatest(1, ceil(rate / {PART_MEAN}))::BIGINT AS parts FROM rates),
cdf AS (SELECT source, parts, k, sum(exp(-rate / parts) * (rate / parts) ** k / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS c
        FROM parts, range({LAST_COUNT + 1}) r(k)),
lists AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
draws AS (SELECT d.*, (SELECT sum(len(list_filter(l.cdf, lambda c: c <= ('0x' || substr(md5('17|' || d.doc_id || '|' || j), 1, 13))::BIGINT / 4503599627370496.0)))
                       FROM range(1, 2) r(j)) AS n, l.parts
          FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
copies AS (SELECT *, unnest(range(1, n::BIGINT + 1)) AS copy FROM draws)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       ('0x' || substr(md5('order|17|' || doc_id || '|' || copy), 1, 15))::BIGINT AS shuffle_key
FROM copies
"""
