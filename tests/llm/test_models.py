from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import katz, langid
from kinfold.llm.bpe import vocabulary_path


def test_katz(spark, folder, docs):
    got = {r.doc_id: r for r in katz.op4_katz(spark, folder).collect()}
    T = [(r.doc_id, [*(r.text or "").encode().lower().split(), 0], zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in docs.collect()]
    c = Counter(w for _, t, train in T if train for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for _, t, train in T if train for p in zip([1, *t], t))
    ch = Counter()
    for (h, _), x in pairs.items():
        ch[h] += x

    def cut(counts):
        times = Counter(counts.values())
        d = [1.0, *katz.discounts([times[k] for k in range(1, 7)])]
        return lambda r: d[r] if r <= katz.K else 1.0

    d1, d2 = cut(c), cut(pairs)
    lost = 1 - sum(d1(x) * x for x in c.values()) / n
    p = lambda w: d1(c[w]) * c[w] / n if w in c else lost
    seen, below = defaultdict(float), defaultdict(float)
    for (h, w), r in pairs.items():
        seen[h] += d2(r) * r / (ch[h] + 1)
        below[h] += p(w)
    weight = {h: (1 - seen[h]) / (1 - below[h]) for h in ch}
    # Each context's probabilities sum to one over all known words and the class of unknown ones.
    for h in itertools.islice(ch, 20):
        total = sum(d2(pairs[h, w]) * pairs[h, w] / (ch[h] + 1) if (h, w) in pairs else weight[h] * p(w) for w in c) + weight[h] * lost
        assert abs(total - 1) < 1e-9
    for d, t, train in T:
        score = sum(math.log10(p(w) if h not in ch else d2(pairs[h, w]) * pairs[h, w] / (ch[h] + 1) if (h, w) in pairs else weight[h] * p(w)) for h, w in zip([1, *t], t))
        base = sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in c for w in t), n, not train)
        assert math.isclose(r.score, score, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)


def test_katz_slices_and_hot_contexts(spark, docs):
    """Tiny slices and partitions, and a context that is dealt out, change nothing."""
    text = docs.withColumn("text", F.concat_ws(" ", "text", F.repeat(F.lit("hot "), 40), F.lit("a hot b hot c"))).withColumn("train", F.col("doc_id") % 5 > 0)
    one = {r.doc_id: r.score for r in katz.score_katz(text).collect()}
    many = {r.doc_id: r.score for r in katz.score_katz(text, slice_chars=3000, bucket_tokens=500).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-9) for k in one)


def test_katz_edges(spark, none, docs):
    empty = none.withColumn("train", F.lit(True))
    assert katz.score_katz(empty).count() == 0
    untrained = katz.score_katz(docs.withColumn("train", F.lit(False))).collect()
    assert {r.train_tokens for r in untrained} == {0}
    nulls = spark.createDataFrame([(None, "a b", True), (1, None, None), (2, "a", True)], "doc_id bigint, text string, train boolean")
    assert sorted((r.doc_id is None, r.n_tokens) for r in katz.score_katz(nulls).collect()) == [(False, 1), (False, 2), (True, 3)]


def test_pack():
    for x in (np.array([], np.int64), np.array([0, 5, 300], np.int64), np.array([-1, 2**40]), np.array([0.5, -1.0]), np.array([2**64 - 1, 1], np.uint64)):
        assert (katz.unpack(katz.pack(x)).astype(x.dtype) == x).all()


def test_forward_sums_all_segmentations():
    ids, byte = langid.pieces(vocabulary_path("piece_bpe_32k.model"))
    size = max(max(ids.values()), max(byte)) + 1
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(size), 2).T)
    lattice = langid.Lattice(logp, vocabulary_path("piece_bpe_32k.model"))
    for word in ("▁the", "▁x日☃z"):
        total = np.zeros(2)
        for cut in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for i, c in enumerate((*cut, 1), 1):
                if c:
                    parts.append(word[last:i])
                    last = i
            p = np.zeros(2)
            for x in parts:
                if x in ids:
                    p += logp[ids[x]]
                elif len(x) == 1:
                    p += logp[[byte[b] for b in x.encode()]].sum(axis=0)
                else:
                    p += -np.inf
            total += np.exp(p)
        assert np.allclose(lattice.forward([word])[0], np.log(total), atol=1e-5)


def test_languages(spark, folder, docs):
    got = {r.doc_id: r for r in langid.op6_langid(spark, folder).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    known = [d for d in lang if d < 3000]
    held = [d for d in known if got[d].held_out]
    assert held and sum(got[d].lang_pred == lang[d] for d in held) >= 0.95 * len(held)
    for d in (3000, 3001, 3002, 3005):
        assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())


def segmentations(word, ids, byte):
    """Every way to cut a word into pieces, as lists of piece ids (a character without a piece is its bytes)."""
    for cut in itertools.product([0, 1], repeat=len(word) - 1):
        parts, last = [], 0
        for i, c in enumerate((*cut, 1), 1):
            if c:
                parts.append(word[last:i])
                last = i
        if all(x in ids or len(x) == 1 for x in parts):
            yield [y for x in parts for y in ([ids[x]] if x in ids else [byte[b] for b in x.encode()])]


def test_expected_uses():
    """What one round of expectation maximisation adds up, against all segmentations."""
    path = vocabulary_path("piece_bpe_32k.model")
    ids, byte = langid.pieces(path)
    size = max(max(ids.values()), max(byte)) + 1
    logp = np.log(np.random.default_rng(3).dirichlet(np.ones(size), 2).T)
    for words, counts in ((["▁there", "▁under"], [3.0, 5.0]), (["▁x日☃"], [2.0])):
        got, want = np.zeros(size), np.zeros(size)
        langid.Lattice(logp, path).expected(words, np.array(counts), 1, got)
        for word, n in zip(words, counts):
            ways = list(segmentations(word, ids, byte))
            p = np.exp([logp[w, 1].sum() for w in ways])
            for w, q in zip(ways, p / p.sum()):
                np.add.at(want, w, n * q)
        assert np.allclose(got, want, atol=1e-6)


def plain_scores(model, text):
    """Log likelihood of a text in each language: one sum after the other, a plain forward pass over each word."""
    ids, byte = langid.pieces(model.vocabulary)
    total = np.zeros(len(model.languages))
    for word in langid.marked(text):
        a = [np.zeros(len(model.languages))]
        for j in range(1, len(word) + 1):
            ways = [a[i] + model.logp[ids[word[i:j]]].astype(float) for i in range(max(0, j - langid.LONGEST), j) if word[i:j] in ids]
            if word[j - 1] not in ids:
                ways.append(a[j - 1] + model.logp[[byte[b] for b in word[j - 1].encode()]].astype(float).sum(axis=0))
            a.append(np.logaddexp.reduce(ways, axis=0))
        total += a[-1]
    return total


def test_predictions(spark, folder, docs):
    """lang_pred and score of the registered query against plain sums over the fitted model."""
    model = langid.fit_languages(docs.filter(~langid.in_fold()))
    got = {(r.doc_id, r.held_out): r for r in langid.op6_langid(spark, folder).collect()}
    for r in docs.filter("text IS NOT NULL AND length(text) < 2000").limit(60).collect():
        mine = got[r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
        if not any(c.isalpha() for c in r.text):
            assert mine.lang_pred == "und"
            continue
        ll = plain_scores(model, r.text)
        assert mine.lang_pred == model.languages[int(ll.argmax())]
        assert math.isclose(mine.score, 1 / np.exp(ll - ll.max()).sum(), rel_tol=1e-6)


def test_long_runs_ties_and_clashes(spark, none):
    path = vocabulary_path("piece_bpe_32k.model")
    size = max(max(langid.pieces(path)[0].values()), max(langid.pieces(path)[1])) + 1
    same = langid.Model(["aa", "bb"], np.full((size, 2), -5.0, np.float32), path)
    rows = [(1, "word", "x"), (2, "日本" * 100_000, "x"), (3, "ab" * 100_000, "x"), (4, None, "x"), (5, "", "x"), (1, "word", "x")]
    got = langid.identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string"), same).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in got) == [(1, "aa", 0.5), (1, "aa", 0.5), (2, "aa", 0.5), (3, "aa", 0.5), (4, "und", 0.0), (5, "und", 0.0)]
    assert langid.identify_languages(none, same).count() == 0


@pytest.mark.parametrize("length", [1, 15, 1024, 1025, 1500, 4095, 4096, 4097, 9000])
def test_long_runs_are_summed_whole(length):
    """Over all segmentations, those across any block of letters among them: the sum of the plain forward pass."""
    path = vocabulary_path("piece_bpe_32k.model")
    size = max(max(langid.pieces(path)[0].values()), max(langid.pieces(path)[1])) + 1
    r = np.random.default_rng(length)
    logp = np.log(r.dirichlet(np.full(size, 0.3), 3).T + 1e-12).astype(np.float32)
    model = langid.Model(["aa", "bb", "cc"], logp, path)
    text = "".join(r.choice(list("theandingßж本"), length))
    want = plain_scores(model, text)
    assert np.allclose(langid.Scorer(model).score([text])[0], want, rtol=1e-9)
    assert np.allclose(langid.Lattice(logp, path).forward_long("▁" + text, block=100), want, rtol=1e-9)


def test_no_languages(none, docs):
    model = langid.fit_languages(none)
    assert model.languages == []
    assert {r.lang_pred for r in langid.identify_languages(docs.withColumn("score", F.lit("x")), model).collect()} == {"und"}


def test_sample_is_bounded(docs):
    assert langid.fit_languages(docs, docs_per_language=5, rounds=1).languages == ["de", "en"]


@pytest.mark.parametrize("seed", [0])
def test_discounts(seed):
    r = random.Random(seed)
    for _ in range(50):
        assert all(0 < d < 1 for d in katz.discounts([r.randrange(0, 1000) for _ in range(6)]))
