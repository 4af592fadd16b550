from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import passages
from kinfold.llm.queries import QUERIES

DOC = "doc_id bigint, text string"


def brute(rows, width):
    """doc_id, n_words, n_removed, kept of each row, by counting every window."""
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(b" ".join(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[b" ".join(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def found(df, width):
    return sorted((tuple(r) for r in passages.remove_repeats(df, width).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def awkward(seed):
    r = random.Random(seed)
    word = lambda k: f"w{r.randrange(k)}"
    text = lambda n, k=5000: " ".join(word(k) for _ in range(n))
    passage, other = text(40), text(90)
    rows = [(i, text(r.randint(0, 120))) for i in range(30)]
    rows += [(100 + i, f"{text(r.randint(0, 30))}\n{passage}\t{text(r.randint(0, 30))}") for i in range(40)]  # one passage in many
    rows += [(200 + i, " ".join(w if r.random() > 0.02 else word(9) for w in other.split())) for i in range(30)]  # near copies
    rows += [(300, other), (301, other), (None, other), (None, text(60)), (302, None), (303, ""), (304, " \t\n"), (305, "a b   c"), (300, other)]
    rows += [(306, "x " * 400), (307, "a b c " * 60), (308, text(34)), (309, text(3000, 2)), (310, text(3000, 2)), (311, passage), (312, "y" * 100_000 + " " + passage), (313, "日本 " * 50 + text(40))]
    return rows


@pytest.mark.parametrize("width", [20, 35])
def test_passages(spark, width):
    rows = awkward(width)
    df = spark.createDataFrame(rows, DOC).withColumn("n_words", F.lit("x")).withColumn("k", F.lit(1)).repartition(7)
    assert found(df, width) == brute(rows, width)
    assert found(df.limit(0), width) == []


def test_passages_with_frequent_shingles_and_small_steps(spark, monkeypatch):
    """Whatever counts as frequent, and however texts are cut, combined and sorted, the result is the same."""
    rows = awkward(3)
    df = spark.createDataFrame(rows, DOC)
    want = brute(rows, 35)
    for name, value in (("FREQUENT_SHARE", 1 << 40), ("FREQUENT_LEAST", 2), ("STEP_BYTES", 900), ("TABLE_BYTES", 20_000), ("SORT_BYTES", 4_000), ("RUN", 3)):
        monkeypatch.setattr(passages, name, value)
    # workers import the module anew, so the mappers run here
    found_in = lambda t: passages.shingle_ranks(*passages.normalised([t.encode()])[:2])[0][:-3]
    frequent = np.unique(np.concatenate([found_in(t) for _, t in rows[30:100] if len(t.split()) > 3]))
    table, places = Counter(), []
    for parts in passages.batches_of_pieces([t for _, t in rows], 34):
        out = passages.super_kmers(parts, 35, frequent)
        places += list(out[["text", "start", "minimiser", "packed"]].itertuples(index=False))
        table.update(zip(out["minimiser"], out["packed"], out["again"]))
    assert any(m < 0 for m, _, _ in table) and any(m >= 0 for m, _, _ in table)
    groups = {}
    for (m, p, again), n in table.items():
        groups.setdefault(m, []).append((p, n, again))
    bits = {(m, p): b for m, g in groups.items() for p, b in passages.repeated_windows(sorted(g), 35)}
    marks = {}
    for t, start, m, p in places:
        if (m, p) in bits:
            marks.setdefault(t, []).append(int(start).to_bytes(8, "big") + bits[m, p])
    kept = passages.kept_words([t for _, t in rows], [marks.get(i) for i in range(len(rows))], 35)
    assert sorted(((d, *k) for (d, _), k in zip(rows, kept)), key=str) == want
    assert found(df, 35) == want


def test_passages_query(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_passages"](spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == sorted(((d, n, m, sha256(k.encode()).hexdigest()) for d, n, m, k in brute(rows, 35)), key=str)
    assert sum(x[2] for x in got) > 1000


def test_a_bucket_holds_few_of_a_passage_in_all_texts(spark):
    """A passage in a third of all texts: windows that reach beyond it go to the buckets of what is beyond."""
    r = random.Random(1)
    text = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    passage = text(40)
    texts = [f"{text(30)} {passage} {text(30)}" if i % 3 == 0 else text(100) for i in range(900)]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    frequent = passages.frequent_shingles(df)
    assert len(frequent) == 37
    table = Counter()
    for parts in passages.batches_of_pieces(texts, 34):
        out = passages.super_kmers(parts, 35, frequent)
        table.update(set(zip(out["minimiser"], out["packed"])))
    buckets = Counter(m for m, _ in table)
    assert max(buckets.values()) <= 2
