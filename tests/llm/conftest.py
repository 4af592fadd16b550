from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(r: random.Random, n: int, lang: str = "en") -> str:
    parts = {"en": ["the", "ing", "tion", "and", "er", "ly"], "de": ["sch", "ein", "und", "ich", "über", "ver"]}[lang]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


def rows(n: int = 120, seed: int = 5) -> list[tuple]:
    """Documents with near and exact copies, and every awkward case."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = "de" if i % 4 == 0 else "en"
        t = prose(r, r.randint(20, 120), lang)
        out.append((i, t, lang, "hot" if i % 3 == 0 else f"s{i % 4}"))
        if i % 10 == 0:
            words = t.split(" ")
            words[r.randrange(len(words))] = "changed"
            out += [(1000 + i, t, lang, "hot"), (2000 + i, " ".join(words), lang, "s1")]
    out += [(3000, None, "en", "s1"), (3001, "", "en", "s1"), (3002, " \n\t ", None, None), (3003, "one two", "en", None), (3004, "日本語のテキスト。" * 50, None, "s2"), (3005, "12 34 ½", "en", "s2"), (3006, "a<|endoftext|>b  x", "en", "s2")]
    out += [(3007, prose(r, 6000), "en", "s3"), (3008, "x" * 30_000, "en", "s3"), (3009, "same words here again " * 200, "en", "hot"), next(x for x in out if x[0] == 5)]
    return [(d, t, l, s, None if t is None else len(t)) for d, t, l, s in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    r = random.Random(6)
    vectors = [(i, [r.gauss(0, 1) for _ in range(64)], "x") for i in range(600)] + [(700, None, "x"), (750, [0.0] * 64, "x")]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, codes string").repartition(2).write.parquet(f"{path}/embeddings.parquet")
    return path
