from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import quality


def brute(text):
    text = text or ""
    w = text.encode().split()
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, docs):
    extra = spark.createDataFrame([(9000, "a b c d e f a b c d e f a b c d e\n# x\n# x\n\n \n", "en", "s", 1), (9001, "p q r s t\x0bp q r s t p", "en", "s", 1)], docs.schema)
    got = {(r.doc_id, r.text): (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.statistics(docs.union(extra)).collect()}
    for (_, text), g in got.items():
        want = brute(text)
        assert g[:5] == want
        assert g[5] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_mcd_finds_planted_outliers(spark):
    rng = np.random.default_rng(1)
    clean = rng.multivariate_normal([1, 2], [[1, 0.6], [0.6, 1]], 400)
    junk = rng.normal([12, -8], 0.5, (120, 2))
    rows = [("a", float(x), float(y)) for x, y in np.vstack([clean, junk])]
    m = quality.fit_mcd(spark.createDataFrame(rows, "g string, x double, y double"), {"x": 0.05, "y": 0.05}, h=0.6).first()
    assert abs(m.m0 - 1) < 0.3 and abs(m.m1 - 2) < 0.3
    # Plain concentration from the clean rows' own mean and covariance must lead to the same place.
    z = np.array([r[1:] for r in rows])
    mu, cov = clean.mean(0), np.cov(clean.T)
    for _ in range(20):
        d2 = np.einsum("ij,jk,ik->i", z - mu, np.linalg.inv(cov), z - mu)
        near = z[np.argsort(d2)[: int(np.ceil(0.6 * len(z)))]]
        mu, cov = near.mean(0), quality.consistency(0.6, 2) * np.cov(near.T, bias=True) + np.eye(2) * 0.05**2
    assert np.allclose([m.m0, m.m1], mu, atol=0.1)
    low = np.array([[m.l00, 0], [m.l10, m.l11]])
    assert np.allclose(low @ low.T, cov, atol=0.25)


def test_rules(docs):
    out = quality.quality_rules(docs.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash")))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count()
    assert not got[3000].kept and not got[3001].kept and not got[3003].kept and not got[3009].kept
    assert all(got[i].kept for i in range(120) if got[i].n_words >= 10)


def test_query(spark, folder, docs):
    """The registered query: counts by brute force, verdicts by distances that numpy finds from the fitted groups."""
    texts = {(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()}
    stats = quality.statistics(docs)
    model = {r.g: r for r in quality.fit_quality(stats).collect()}
    limit = quality.chi2_quantile(0.9999, 4)
    want = Counter()
    for d, text, lang, source in texts:
        n, chars, symbols, lines, repeats = brute(text)
        failed = n < 10 or 100 * repeats > 20 * n
        name = lambda c: "-" if c is None else f"{len(c)}:{c}"
        fit = next((model[g] for g in (f"s{name(lang)}{name(source)}", f"l{name(lang)}-", "a") if g in model), None)
        kept = not failed
        if kept and fit:
            z = np.array([np.log((chars + 100) / (n + 20)), *(np.log1p(100 * x / n) for x in (symbols, lines, repeats))])
            low = np.array([[fit[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
            y = np.linalg.solve(low, z - [fit[f"m{i}"] for i in range(4)])
            kept = bool(y @ y <= limit)
        want[(d, n, chars, symbols, lines, repeats, failed, kept)] += 1
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.op1_quality(spark, folder).collect()}
    assert got == set(want) and "a" in model


def test_clashing_columns(docs):
    """Names that the operator uses inside pass untouched."""
    mine = {c: F.lit(7) for c in ("m0", "l00", "g", "__words", "__hashes", "__group0", "__fit0", "__x", "z_length", "n", "start")}
    out = quality.quality_rules(docs.withColumns(mine))
    assert set(mine) <= set(out.columns)
    assert out.select(*mine).distinct().collect() == [tuple([7] * len(mine))]
    plain = {(r.doc_id, r.text): r.kept for r in quality.quality_rules(docs).collect()}
    assert plain == {(r.doc_id, r.text): r.kept for r in out.collect()}


def test_long_text(spark, docs):
    """A text of 300,000 different words has no repeated window; one repeated at its ends has ten words of them."""
    words = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(words + words[:5]), "en", "s", 1)]
    got = {r.doc_id: r.n_repeat_words for r in quality.statistics(spark.createDataFrame(rows, docs.schema)).collect()}
    assert got == {1: 0, 2: 10}


def test_symbols_are_rejected(spark, docs):
    junk = spark.createDataFrame([(8000 + i, " ".join(f"w{i}{j}***" for j in range(60)), "en", "hot", 1) for i in range(5)], docs.schema)
    got = quality.quality_rules(docs.union(junk)).filter("doc_id >= 8000 AND doc_id < 9000").collect()
    assert len(got) == 5 and not any(r.kept for r in got)


def test_empty(none):
    assert quality.quality_rules(none).count() == 0


def test_chi2():
    assert abs(quality.chi2_quantile(0.95, 4) - 9.4877) < 1e-3
