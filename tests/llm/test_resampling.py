from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.llm import resampling
from kinfold.llm.common import Tables
from kinfold.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id bigint, text string"


def runs(text, longest):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, longest=1, buckets=10_000, seed=2024, percent=10, least=20):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t, longest)[1])
    s, t = count(x for _, x in rows), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out, able = [], []
    for d, x in rows:
        n, found = runs(x, longest)
        h = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        able += [out[-1]] if n >= least else []
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=str)


def awkward():
    r = random.Random(8)
    text = lambda n: " ".join(r.choice(["The", "of", "naïve", "x1", "日本", "don't", "E-mail", "q_w", "42"]) + r.choice(["", ".", "\n", "!"]) for _ in range(n))
    rows = [(i, text(r.randint(0, 60))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, " \t.,;"), (903, "a\x00b"), (904, text(40_000)), (905, "z" * 300_000), (None, text(50)), (None, text(5)), rows[3], rows[3], (906, rows[3][1])]
    return rows, [text(30) for _ in range(20)] + [None, "", "the of the"]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling(spark, longest):
    rows, target = awkward()
    df = spark.createDataFrame(rows, DOC).withColumn("score", F.lit("x")).withColumn("rank", F.lit(7)).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resample(df, goal, Tables(spark, "resampling"), longest=longest, buckets=97, percent=30)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, target, longest, 97, percent=30)
    assert resampling.resample(df.limit(0), goal, Tables(spark, "resampling")).count() == 0
    assert resampling.resample(df, goal.limit(0), Tables(spark, "resampling")).count() == len(rows)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(resampling, "STEP_BYTES", 50)
    rows, _ = awkward()
    texts = [t for _, t in rows[:30]] + [None, "z" * 400 + " end", "日本語 " * 40, "." * 500, ""]
    got, at = [Counter() for _ in texts], 0
    for numbers, parts in resampling._parts(pa.array(texts, pa.string())):
        assert numbers[0] == at
        at = numbers[-1] + 1
        for text, found in resampling.features(numbers, parts, 2, 1009):
            for i, b in zip(text.tolist(), found.tolist()):
                got[i][b] += 1
    assert at == len(texts)
    assert got == [Counter(zlib.crc32(f.encode()) % 1009 for f in runs(t, 2)[1]) for t in texts]


def test_resampling_query(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [t for _, t in rows[:20]]
    spark.createDataFrame(list(enumerate(target)), "item_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    got = QUERIES["op13_resampling"](spark, folder).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target)
