"""Pairs without all pairs of a key, pictures, page functions and the search index."""

from __future__ import annotations

import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import blocking as B
from kinfold.operators import feeds as N
from kinfold.operators.search import TrigramIndex
from kinfold.plans import feed_queries
from kinfold.plans.fixtures import view
from kinfold.session import fresh_path
from kinfold.sources import images as IMG

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("radius", "bands", "bits"), [(8, None, 64), (14, 5, 64), (14, None, 64), (0, None, 64), (1, None, 64), (3, 4, 24)])
def test_near_pairs(spark, radius, bands, bits):
    """Against all pairs; a third of the rows under one key, and equal hashes among them."""
    r = random.Random(radius)
    centres = [r.getrandbits(bits) for _ in range(12)]
    rows = []
    for i in range(240):
        h = r.choice(centres)
        for _ in range(r.choice([0, 0, 3, 7, 12])):
            h ^= 1 << r.randrange(bits)
        rows.append((i, h - (1 << 64) if h >> 63 else h, "hot" if i % 3 == 0 else f"k{i % 5}"))
    rows += [(500, None, "hot"), (501, 5, None), (502, 5, None)]
    df = spark.createDataFrame(rows, "id bigint, hash bigint, k string")
    dist = lambda x, y: ((x ^ y) & ((1 << 64) - 1)).bit_count()
    want = sorted((a, b, dist(x, y)) for (a, x, k), (b, y, m) in combinations(rows, 2) if k == m and k and None not in (x, y) and dist(x, y) <= radius)
    assert sorted(map(tuple, B.near_pairs(df, ["k"], radius, bands, bits).select("a", "b", "distance").collect())) == want and want


def test_rows_of_a_hot_key_do_not_all_meet(spark):
    """3,000 hashes under one key: what meets is a small part of all pairs."""
    r = random.Random(1)
    rows = [(i, r.getrandbits(63), "hot") for i in range(3000)]
    met = B.near_pairs(spark.createDataFrame(rows, "id bigint, hash bigint, k string"), ["k"], 8)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and met.count() == 0


def test_profiles_make_few_rows(spark):
    """1,000 identities of one title and two profiles: three pairs stand for half a million."""
    df = spark.range(1000).selectExpr("id", "'alpha' AS source", "'One  Title' AS title", "IF(id % 2 = 0, 'even', 'odd') AS source_id", "'' AS url")
    none = lambda s: spark.createDataFrame([], s)
    profiles = B.evidence_profiles(df, none("identity_id bigint, number bigint"), none("identity_id bigint, provider string, value string"), none("id bigint, hash bigint"))
    pairs, members = B.class_pairs(B.title_classes(df), profiles)
    assert sorted(r.n for r in pairs.collect()) == [124_750, 124_750, 250_000] and members.count() == 1000
    evidence = pairs.select("a", "b", (F.col("p") == F.col("q")).alias("same"))
    out = B.expand_evidence(pairs, members, evidence)
    assert out.count() == 499_500 and out.filter(F.col("same") != ((F.col("a") % 2) == (F.col("b") % 2))).count() == 0


def plain_hash(gray, margin):
    """Part by part, pixel by pixel, in fractions."""
    h, w = gray.shape
    x, y = int(w * margin), int(h * margin * 0.75)
    right, bottom = max(x + 1, w - x), max(y + 1, h - y)
    cells = []
    for j in range(8):
        for i in range(9):
            x0, x1 = x + Fraction(i * (right - x), 9), x + Fraction((i + 1) * (right - x), 9)
            y0, y1 = y + Fraction(j * (bottom - y), 8), y + Fraction((j + 1) * (bottom - y), 8)
            cells.append(sum(int(gray[v, u]) * (min(u + 1, x1) - max(u, x0)) * (min(v + 1, y1) - max(v, y0)) for v in range(int(y0), min(h, int(y1) + 1)) for u in range(int(x0), min(w, int(x1) + 1)) if u < x1 and v < y1))
    bits = "".join("1" if cells[j * 9 + i] > cells[j * 9 + i + 1] else "0" for j in range(8) for i in range(8))
    n = int(bits, 2)
    return n - (1 << 64) if n >> 63 else n


def test_picture_hashes(spark, tmp_path):
    r = np.random.default_rng(3)
    pictures = {f"p{k}": r.integers(0, 256, (h, w, 3)).astype(np.uint8) for k, (h, w) in enumerate([(8, 9), (40, 31), (1, 1), (5, 60), (64, 48)])}
    pictures["flat"] = np.full((20, 20, 3), 77, np.uint8)
    for name, rgb in pictures.items():
        (tmp_path / f"{name}.bmp").write_bytes(IMG.bitmap_file(rgb))
    (tmp_path / "broken.bmp").write_bytes(b"BM, but no picture")
    got = {x.origin.rpartition("/")[2][:-4]: x.hashes for x in IMG.cover_hashes(IMG.read_images(spark, str(tmp_path))).collect()}
    assert got.keys() == pictures.keys() and got["flat"] == [0] * 4
    for name, rgb in pictures.items():
        gray = rgb.astype(np.int64) @ np.array([299, 587, 114])
        assert got[name] == [plain_hash(gray, m) for m in IMG.MARGINS]
    odd = spark.createDataFrame([("x", 2, 2, 1, b"\x01\x02\x03\x04"), ("y", 2, 2, 3, b"\x01"), ("z", 2, 2, 1, None)], "origin string, height int, width int, nChannels int, data binary")
    assert [x.hashes is None for x in IMG.cover_hashes(odd).orderBy("origin").collect()] == [False, True, True]


def test_cover_hashes_of_the_vectors(spark):
    rows = {r.vec_id: r.embedding for r in view(spark, FOLDER, "embeddings").collect()}
    got = {r.vec_id: [r[f"h{k}"] for k in range(4)] for r in feed_queries.Q.queries["f25_cover_hashes"](spark, FOLDER).collect()}
    assert got.keys() == rows.keys()
    for i in list(rows)[:12]:
        raw = np.frombuffer(feed_queries._bitmap(rows[i])[54:], np.uint8).reshape(11, 40)[::-1, :39].reshape(11, 13, 3)
        assert got[i] == [plain_hash(raw.astype(np.int64) @ np.array([114, 587, 299]), m) for m in IMG.MARGINS]


def test_page_functions_in_sql(spark):
    """LATERAL functions give the rows of the DataFrame operators."""
    ask = lambda n: sorted(map(tuple, feed_queries.Q.queries[n](spark, FOLDER).select("page_id", "position", "href", "text").collect()))
    assert ask("d05_html_links") == ask("n08_extract_links") != []
    N.register_page_functions(spark)
    pages = spark.createDataFrame([(1, None, None), (2, "", "https://t.test"), (3, '<a href="/x"> one\n two</a><img src="a.png">', "https://t.test/b/")], "page_id bigint, html string, url string")
    assert [tuple(r) for r in spark.sql("SELECT p.page_id, l.* FROM {p} p, LATERAL html_links(p.html) l", p=pages).collect()] == [(3, 0, "/x", "one two")]
    assert [tuple(r) for r in spark.sql("SELECT p.page_id, i.url FROM {p} p, LATERAL html_images(p.html, p.url) i WHERE i.position = 0", p=pages).collect()] == [(3, "https://t.test/b/a.png")]


def test_search_index(spark):
    """The rows of a scan; only texts with the rarest gram are looked at; short terms look at all."""
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abÄ %_x") for _ in range(r.randint(0, 12)))) for i in range(400)] + [(1, "Needle in a haystack"), (7, "NEEDLE"), (None, "needle"), (8, None), (9, "a%b")]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    index = TrigramIndex(spark, fresh_path(spark, "search")).build(texts)
    for term in ["needle", "ab", "a%b", "b_Ä", "äx ", "xxxx", "%", "abx", "A X", "zzz"]:
        want = {x.id for x in texts.filter(F.col("text").ilike(f"%{term}%") & F.col("id").isNotNull()).collect()}
        assert {x.id for x in index.search(term).collect()} == want, term
    assert {x.id for x in index.candidates("needle").collect()} == {1, 7} and index.candidates("a_%b") is None
    empty = TrigramIndex(spark, fresh_path(spark, "search")).build(texts.limit(0))
    assert empty.search("needle").count() == 0 and empty.search("n").count() == 0
