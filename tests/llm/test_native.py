from __future__ import annotations

import math
import random
import re
from hashlib import md5

from pyspark.sql import functions as F

from kinfold.llm import chat, licenses, mixing


def poisson(u, mean):
    k, p = 0, math.exp(-mean)
    total = p
    while u >= total and k < mixing.LAST_COUNT:
        k += 1
        p *= mean / k
        total += p
    return k


def test_mixing(docs):
    out = mixing.mix_sources(docs.withColumn("copy", F.lit("x")), epochs=2.0).collect()
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    whole = sum(math.sqrt(n) for n in sizes.values())
    want = {}
    for r in rows:
        mean = 2.0 * len(rows) * math.sqrt(sizes[r.source]) / whole / sizes[r.source]
        u = int(md5(f"17|{r.doc_id}|1".encode()).hexdigest()[:13], 16) / 2**52
        want[r.doc_id] = want.get(r.doc_id, 0) + poisson(u, mean)
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in want.items() if n}
    assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)


def test_mixing_weights_and_large_means(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(2000)], "doc_id bigint, source string")
    out = mixing.mix_sources(df, weights={"b": 1.0}, epochs=5.0)
    assert {r.source for r in out.select("source").distinct().collect()} == {"b"}
    assert abs(out.count() - 10_000) < 500  # mean 50 for each: several draws a document
    assert mixing.mix_sources(df, weights={}).count() == 0
    assert mixing.mix_sources(df.limit(0)).count() == 0


def license_of(text):
    """Best licence, its coefficient and the number of units that match any, by brute force."""
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    pairs = lambda t: {*zip(words(t), words(t)[1:])}
    text = text or ""
    units = {*text.split("\n"), *(re.split(r"\n[ \t\x0b-\r]*\n", text) if "\n" in text else []), text}
    found = []
    for x in map(pairs, units):
        scores = [(-2 * len(x & y) / (len(x) + len(y)), name) for name, y in ((i, pairs(t)) for i, t in licenses.TEMPLATES)] if x else []
        found += [min(scores)] if scores and min(scores)[0] <= -0.8 else []
    return (min(found)[1], round(-min(found)[0], 6), len(found)) if found else (None, None, 0)


def test_licenses(spark, docs):
    texts = ["Hello\nReleased under the MIT License!\nbye", licenses.TEMPLATES[5][1].replace(" of charge", " of  CHARGE"), "All rights reserved", "rights", None, "x\n\nThis work is licensed\nunder the GNU General Public License, version 3.\n\ny"]
    r = random.Random(1)
    for name, body in licenses.FULL_TEXTS:
        words = body.split(" ")
        texts += ["Copyright (c) 2020 Someone\n\n" + body, body.replace("\n\n", "\n"), " ".join(w for w in words if r.random() > 0.05), " ".join(w for w in words if r.random() > 0.3), body + " " + "x y z " * 200_000]
    texts += ["All rights reserved. All rights reserved.", "Released under the MIT"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate([*texts, texts[0]])], "doc_id bigint, text string, license int, __matches string")
    got = licenses.scan_licenses(df)
    assert got.columns == ["doc_id", "text", "__matches", "license", "license_dice", "n_license_units"]
    got = [(r.license, r.license_dice, r.n_license_units) for r in got.orderBy("doc_id").collect()]
    assert [x for x, _, _ in got[:6]] == ["mit", "mit", "all-rights-reserved", None, None, "gpl-3.0"]
    assert got == [license_of(t) for t in [*texts, texts[0]]]
    for r in licenses.scan_licenses(docs).collect():
        assert (r.license, r.license_dice, r.n_license_units) == license_of(r.text)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_ties(spark):
    """Of two templates of one coefficient the smaller name wins."""
    df = spark.createDataFrame([(1, "free for all who ask")], "doc_id bigint, text string")
    out = licenses.scan_licenses(df, [("b", "free for all who ask"), ("a", "Free for all, who ask!"), ("c", "x y")]).first()
    assert (out.license, out.license_dice, out.n_license_units) == ("a", 1.0, 1)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, "user", None), (6, 0, None, ""), (7, 0, "user", None), (8, 0, "user", "hi"), (8, 1, "assistant", "yo"), (8, 2, "user", "more"), (None, 0, "user", "lost"), (None, 3, "user", "lost"), (None, 0, "user", "hi")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("n_turns", F.lit("x"))).collect()
    assert len(out) == 5
    out = {r.conv_id: r for r in out}
    assert set(out) == {3, 4, 5, 6, None}  # 1 and 2 begin 3; 8 is 3 again; 7 is 5 again
    assert out[None].n_turns == 1 and out[None].rendered == "<|im_start|>user\nlost<|im_end|>\n"  # once; 3 begins with "hi"
    assert out[3].n_turns == 3 and out[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert out[6].rendered == "<|im_start|>\n<|im_end|>\n"
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
