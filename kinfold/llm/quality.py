"""Quality rules: minimum-covariance-determinant outliers over text statistics, in DataFrame functions only.

Every text gets counts of words, symbols, repeated lines and repeated five-word windows. Four transformed rates of
them are the vector of a document. Location and scatter of these vectors are estimated per language and source by
the minimum covariance determinant: from several starts, concentration steps keep the h rows of least Mahalanobis
distance and re-estimate from them. Documents beyond a chi-square quantile are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import cut, documents, join_small, let, unused, word_list, write_table

#: The features, and for each the least standard deviation that counts: rates that hardly vary within a language
#: (most texts have no symbols at all) must not turn harmless small values into outliers.
FEATURES = {"z_length": 0.1, "z_symbols": 0.45, "z_lines": 0.6, "z_repeats": 1.0}
BINS_PER_UNIT, LAST_BIN = 64, 4095


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) and base_failed.

    A null or blank text has 0 words and fails. Repeated windows are neighbours when 64-bit window hashes are sorted with
    their positions; texts without a repeated hash aren't sorted. Columns of these names are replaced.
    """
    docs = docs.drop(*ADDED[:6])
    t = F.coalesce(F.col(text), F.lit(""))
    w, lines, h = (unused(docs, f"__{x}") for x in ("words", "lines", "hashes"))
    out = docs.withColumn(w, word_list(F.col(text)))
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
            lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            h: F.expr(
                f"CASE WHEN size(`{w}`) < 6 THEN CAST(array() AS array<bigint>) ELSE element_at(transform(array(`{w}`), w -> "
                "transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))), 1) END"
            ),
        }
    )
    repeats = f"""
        CASE WHEN size(`{h}`) = size(array_distinct(`{h}`)) THEN 0L ELSE
          element_at(transform(array(sort_array(transform(`{h}`, (x, i) -> struct(x AS h, i AS i)))), s ->
            aggregate(
              array_sort(transform(
                filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) OR coalesce(x.h = get(s, i + 1).h, false)),
                x -> CAST(x.i AS bigint))),
              named_struct('last', -5L, 'total', 0L),
              (a, p) -> named_struct('last', p, 'total', a.total + least(5L, p - a.last)),
              a -> a.total)
          ), 1) END"""
    out = out.withColumns({"n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"), "n_repeat_words": F.expr(repeats).cast("long")})
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).drop(w, lines, h)


def features() -> dict[str, Column]:
    """The transformed features from the statistics; short texts are shrunk towards a usual word length."""
    n = F.col("n_words").cast("double")
    rate = lambda c: F.round(F.log1p(100.0 * F.col(c) / F.greatest(n, F.lit(1.0))), 6)
    length = F.round(F.log((F.col("word_chars") + 100.0) / (n + 20.0)), 6)
    return dict(zip(FEATURES, [length, rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]))


def _key(lang: Column, source: Column) -> Column:
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(part(lang), part(source))


def levels() -> list[Column]:
    """The group of a row at each level: language and source, language, all."""
    return [F.concat(F.lit("s"), _key(F.col("lang"), F.col("source"))), F.concat(F.lit("l"), _key(F.col("lang"), F.lit(None).cast("string"))), F.lit("a")]


def _moments(names: list[str]) -> list[Column]:
    d = len(names)
    return [F.count("*").alias("n"), *(F.sum(a).alias(f"s{i}") for i, a in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}{j}") for i in range(d) for j in range(i + 1))]


def _factor(df: DataFrame, floors: list[float], scale: float) -> DataFrame:
    """Mean m{i} and Cholesky factor l{i}{j} of scale * covariance + floors^2, from sums; logdet."""
    d = len(floors)
    df = df.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(d)})
    df = df.withColumns({f"c{i}{j}": scale * (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + (floors[i] ** 2 if i == j else 0.0) for i in range(d) for j in range(i + 1)})
    for j in range(d):
        left = lambda i, j=j: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - left(j), F.lit(floors[j] ** 2 / 4))))
        if j + 1 < d:
            df = df.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - left(i)) / F.col(f"l{j}{j}") for i in range(j + 1, d)})
    keep = [c for c in ("g", "start") if c in df.columns]
    logdet = sum((F.log(f"l{i}{i}") for i in range(d)), F.lit(0.0))
    return df.select(*keep, "n", *(f"m{i}" for i in range(d)), *(f"l{i}{j}" for i in range(d) for j in range(i + 1)), (2 * logdet).alias("logdet"))


def _distance2(z: list[Column], model: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution, within one expression; model: the struct that holds m{i} and l{i}{j}."""
    solved, of = F.array().cast("array<double>"), lambda name: F.col(f"`{model}`.{name}" if model else name)

    def then(i: int):
        return lambda y: F.concat(y, F.array((z[i] - of(f"m{i}") - sum((of(f"l{i}{k}") * y[k] for k in range(i)), F.lit(0.0))) / of(f"l{i}{i}")))

    for i in range(len(z)):
        solved = let(solved, then(i))
    return F.aggregate(solved, F.lit(0.0), lambda a, y: a + y * y)


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its power series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, d: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(d / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def consistency(h: float, d: int) -> float:
    """What the covariance of the h share nearest the centre is multiplied by to be that of all, for normal data."""
    return h / _gamma_p(d / 2 + 1, chi2_quantile(h, d) / 2)


def fit_mcd(rows: DataFrame, features: dict[str, float], h: float = 0.75, starts: int = 2, first_steps: int = 2, steps: int = 6) -> DataFrame:
    """One row of location and scatter for each group `g` of rows with the features: n, m{i}, l{i}{j}, logdet.

    Rows should be distinct vectors: a text copied many times then counts once and can't pull the estimate to itself.
    Starts: coordinate medians with absolute deviations, and `starts` hash-seeded small subsets. After first_steps
    concentration steps the start of least determinant goes on. The h rows are found by a histogram of distances
    (LAST_BIN + 1 bins, ties of a bin kept together), so a group of any size costs one aggregation a step and no sort.
    """
    names, floors = list(features), list(features.values())
    d, scale = len(names), consistency(h, len(features))
    cols = {c: f"z{i}" for i, c in enumerate(names)}
    z = [f"z{i}" for i in range(d)]
    rows = rows.select("g", *(F.col(c).cast("double").alias(v) for c, v in cols.items()))
    med = rows.groupBy("g").agg(F.count("*").alias("n"), *(F.percentile_approx(c, 0.5, 2000).alias(f"a{i}") for i, c in enumerate(z)))
    med = cut(med)
    mad = join_small(rows, med, ["g"]).groupBy("g").agg(F.first("n").alias("n"), *(F.first(f"a{i}").alias(f"a{i}") for i in range(d)), *(F.percentile_approx(F.abs(F.col(c) - F.col(f"a{i}")), 0.5, 2000).alias(f"b{i}") for i, c in enumerate(z)))
    sums = {"s%d" % i: F.col(f"a{i}") * F.col("n") for i in range(d)}
    sums |= {f"p{i}{j}": F.col("n") * (F.col(f"a{i}") * F.col(f"a{j}") + ((1.4826 * F.col(f"b{i}")) ** 2 if i == j else F.lit(0.0))) for i in range(d) for j in range(i + 1)}
    state = _factor(mad.withColumns(sums).withColumn("start", F.lit(0)), floors, 1.0)
    for k in range(1, starts + 1):
        rank = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64(F.lit(k), *z), *z))
        few = rows.withColumn("__r", rank).filter(F.col("__r") <= 3 * (d + 1)).groupBy("g").agg(*_moments(z)).withColumn("start", F.lit(k))
        state = state.unionByName(_factor(few, floors, 1.0))
    state = cut(state)
    for step in range(first_steps + steps):
        if step == first_steps:
            best = Window.partitionBy("g").orderBy("logdet", "start")
            state = state.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")
        near = (join_small(rows, state.drop("n", "logdet"), ["g"]) if step >= first_steps else _with_starts(rows, state.drop("n", "logdet"))).withColumn("__d2", _distance2([F.col(c) for c in z]))
        bins = near.withColumn("bin", F.least(F.lit(LAST_BIN), F.floor(F.log1p("__d2") * BINS_PER_UNIT)).cast("int")).groupBy("g", "start", "bin").agg(*_moments(z))
        upto = Window.partitionBy("g", "start").orderBy("bin")
        bins = bins.withColumn("__before", F.sum("n").over(upto) - F.col("n")).withColumn("__all", F.sum("n").over(Window.partitionBy("g", "start")))
        inner = bins.filter(F.col("__before") < F.ceil(h * F.col("__all")))
        state = cut(_factor(inner.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(d)), *(f"p{i}{j}" for i in range(d) for j in range(i + 1))])), floors, scale))
    return state.drop("start")


def _with_starts(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows once for each start of their group."""
    packed = state.groupBy("g").agg(F.collect_list(F.struct(*(c for c in state.columns if c != "g"))).alias("__s"))
    return join_small(rows, packed, ["g"]).withColumn("__s", F.explode("__s")).select(*rows.columns, "__s.*")


def fit_quality(stats: DataFrame, min_rows: int = 60) -> DataFrame:
    """The model: a row for each group of min_rows distinct vectors or more, at the levels language and source, language, all."""
    rows = stats.filter(~F.col("base_failed")).select(F.explode(F.array(*levels())).alias("g"), *(c.alias(k) for k, c in features().items())).distinct()
    rows = write_table(rows, "vectors")
    sizes = cut(rows.groupBy("g").agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_rows))
    return fit_mcd(join_small(rows, sizes, ["g"], "left_semi"), FEATURES)


def apply_quality(stats: DataFrame, model: DataFrame, quantile: float = 0.9999) -> DataFrame:
    """Add distance2 (null where base_failed or where no group is large enough) and kept.

    The finest group that the model has is used: language and source, else language, else all.
    """
    d, out = len(FEATURES), stats.drop("distance2", "kept")
    keys, fits = ([unused(out, f"__{x}{k}") for k in range(3)] for x in ("group", "fit"))
    parts = model.select("g", F.struct(*(f"m{i}" for i in range(d)), *(f"l{i}{j}" for i in range(d) for j in range(i + 1))).alias("fit"))
    out = out.withColumns(dict(zip(keys, levels())))
    for key, fit in zip(keys, fits):
        out = join_small(out, parts.select(F.col("g").alias(key), F.col("fit").alias(fit)), [key], "left")
    out = out.withColumn(fits[0], F.coalesce(*fits))
    out = out.withColumn("distance2", F.when(~F.col("base_failed"), _distance2(list(features().values()), fits[0])))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi2_quantile(quantile, d), F.lit(True))
    return out.withColumn("kept", kept).drop(*keys, *fits)


#: What the rules add; a document column of such a name is replaced.
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept"]


def quality_rules(docs: DataFrame) -> DataFrame:
    """Documents (text, lang, source and any other columns) with the statistics, distance2 and kept.

    Null text: 0 words, rejected. Null lang or source: a group of their own. Empty table: empty result. Copies and repeated
    rows get equal verdicts. Columns named as those added are replaced, any others pass. Very long texts are judged whole.
    The documents are written once with their statistics, from which the model is fitted and applied.
    """
    stats = write_table(statistics(docs.drop(*ADDED)), "quality")
    return apply_quality(stats, fit_quality(stats))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and verdict of every row of documents; cases as in quality_rules. Texts aren't written again."""
    stats = write_table(statistics(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    return apply_quality(stats, fit_quality(stats)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
