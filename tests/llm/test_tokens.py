from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import bpe, token_files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_op2(spark, folder, docs, library):
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.op2_bpe(spark, folder).collect()}
    want = set()
    for r in docs.collect():
        ids = ids_of(library, r.text)
        text = library.decode(list(np.frombuffer(ids, "<u4")), skip_special_tokens=False)
        want.add((r.doc_id, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), len(ids) // 4))
    assert got == want


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab é日'st\n \t_²<|endoftext>1٣.,"), max_size=3000))
def test_any_text(text):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = bpe.chunk_encoder(bpe.vocabulary_path()).encode([text])[0]
    assert got == ids_of(library, text)


def test_chunks_are_shared_and_joined():
    r = random.Random(2)
    shared = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(4000))
    enc = bpe.ChunkEncoder(bpe.vocabulary_path())
    a, b = enc.encode([f"start {shared} end", f"another way to begin, {shared}"])
    assert enc.reused > 5
    assert [a, b] == enc.encoder.encode([f"start {shared} end", f"another way to begin, {shared}"])


@pytest.mark.parametrize("blanks", [" " * 2_000_000, " \n\u3000\t" * 400_000])
def test_long_runs_of_blanks(library, blanks):
    for text in (f"a few words{blanks}and more", blanks, f"x{blanks}"):
        assert bpe.chunk_encoder(bpe.vocabulary_path()).encode([text])[0] == ids_of(library, text)


def test_cuts_are_characters():
    data = ("日本語" * 40_000).encode()
    last = 0
    for end in bpe.cuts(data):
        data[last:end].decode()
        last = end
    assert last == len(data)


def test_op10(spark, folder, docs, library):
    got = token_files.op10_token_files(spark, folder).collect()
    want, start = [], 0
    for d, ids in sorted((r.doc_id, ids_of(library, r.text) + np.array([2], "<u4").tobytes()) for r in docs.collect()):
        want.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


@settings(max_examples=40, deadline=None)
@given(values=st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_round_trip(values):
    x = np.array(values, "<u4")
    control, data = token_files.pack(x)
    assert len(control) == (len(x) + 3) // 4
    assert (token_files.unpack(control, data, len(x)) == x).all()


def test_empty_and_clashes(spark, none, docs, tmp_path):
    assert bpe.encode_chunked(none, bpe.vocabulary_path()).count() == 0
    assert bpe.encode_chunked(docs.withColumn("n_tokens", F.lit("x")), bpe.vocabulary_path(), decode=True).filter("n_tokens IS NULL").count() == 0
    token_files.write_token_files(none, f"file://{tmp_path}/none", bpe.vocabulary_path(), end=2)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0
    odd = spark.createDataFrame([(None, "x"), (None, None), (-5, "y")], "doc_id bigint, text string")
    token_files.write_token_files(odd.withColumn("ids", F.lit(1)), f"file://{tmp_path}/odd", bpe.vocabulary_path(), end=2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_files(spark, f"file://{tmp_path}/odd").collect())
    assert [d for _, d, _ in got] == [None, None, -5] and sorted(n for _, _, n in got) == [1, 2, 2] and got[2][0] == 3


def test_offsets_go_by_numbers(spark):
    """Beyond any padding of names, and whatever the order of the rows: 100000 comes after 99999, file 10 after file 9."""
    files = [(p, k, 1 + (p * 7 + k) % 5) for p in (99_999, 100_000, 10**10, 3, 1_000_000) for k in (0, 1, 9, 10)]
    manifest = spark.createDataFrame([*files, files[0]][::-1], "part bigint, number bigint, n bigint").repartition(5)
    total, want = 0, []
    for p, k, n in sorted(files):
        want.append((p, k, total))
        total += n
    assert sorted(map(tuple, token_files.offsets_of(manifest).collect())) == want
    assert token_files.offsets_of(manifest.limit(0)).count() == 0


def test_many_files(spark, docs, library, tmp_path):
    """Partitions by ids, and files closed at a size, give the same rows."""
    folder = f"file://{tmp_path}/many"
    token_files.BLOCK, before = 500, token_files.BLOCK
    try:
        token_files.write_token_files(docs, folder, bpe.vocabulary_path(), end=2, file_ids=6000, file_bytes=3000)
        got = token_files.read_token_files(spark, folder).collect()
    finally:
        token_files.BLOCK = before
    names = sorted(p.name for p in (tmp_path / "many").glob("*.ktf"))
    assert len(names) > 5 and any(x.endswith("-0000000001.ktf") for x in names)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in docs.collect())
    assert sorted(bytes(r.ids) for r in got) == sorted(ids_of(library, r.text) + np.array([2], "<u4").tobytes() for r in docs.collect())


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "a few words" + "\n" * 1_500_000 + "and more", "ab" * 1_000_000, "7" * 2_000_000, "日本" * 700_000])
def test_long_runs_through_queries(spark, docs, library, tmp_path, text):
    """Unbroken runs through both registered queries."""
    spark.createDataFrame([(1, text, "en", "s", len(text)), (2, None, "en", "s", None)], docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    ids = ids_of(library, text)
    got = {r.doc_id: r for r in bpe.op2_bpe(spark, str(tmp_path)).collect()}
    assert got[1].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[2].n_tokens == 0
    read = {r.doc_id: r for r in token_files.op10_token_files(spark, str(tmp_path)).collect()}
    assert read[1].ids_crc32 == zlib.crc32(ids + np.array([2], "<u4").tobytes()) and (read[2].start, read[2].n_tokens) == (len(ids) // 4 + 1, 1)
