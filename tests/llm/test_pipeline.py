from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline as P
from kinfold import session
from kinfold.llm.bpe import vocabulary_path
from kinfold.llm.quality import quality_rules


def test_stages(spark, folder, docs):
    rows, before = docs, None
    for k, (name, stage) in enumerate(P.STAGES):
        rows = P.write_table(stage(spark, rows, folder), f"test-{k}")
        if k < len(P.STAGES) - 1:
            assert rows.columns == docs.columns
        ids = {r.doc_id for r in rows.select("doc_id").collect()}
        assert before is None or ids <= before
        before = ids
        if name == "quality rules":
            assert not ids & {3000, 3001, 3002, 3003, 3009}
        if name == "n-gram Jaccard join":
            assert not ids & {1000, 1010, 2000} and {0, 10, 20} <= ids
            assert rows.count() == len(ids)
    library, texts = Tokenizer.from_file(vocabulary_path()), {r.doc_id: r.text for r in docs.collect()}
    for r in rows.collect():
        assert r.round_trip
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_extra_columns(spark, docs):
    """Columns named as an operator's own come out as they came in."""
    mine = {c: F.lit(f"my {c}") for c in ("kept", "n_words", "score", "lang_pred", "copy", "shuffle_key", "n_tokens", "component_id")}
    some = docs.filter("doc_id < 40 OR doc_id = 3000").withColumns(mine)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, some, "")
        assert out.columns == some.columns and out.select(*mine).distinct().collect() == [tuple(f"my {c}" for c in mine)], name


def test_rows_of_one_id(spark, docs):
    """Equal rows are one; rows that share a doc_id and differ all stay, if it is the smallest of its group."""
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (3, b + " c", "en", "s", 1), (None, a, "en", "s", 1), (4, None, "en", "s", 0), (5, "", "en", "s", 0)]
    got = sorted((r.doc_id or 0, r.text or "") for r in P.keep_distinct(spark, spark.createDataFrame(rows, docs.schema), "").collect())
    assert got == [(0, a), (1, a), (1, b), (4, ""), (5, "")]


def test_empty(spark, none, folder):
    rows = none
    for k, (_, stage) in enumerate(P.STAGES):
        rows = P.write_table(stage(spark, rows, folder), f"none-{k}")
    assert rows.count() == 0


def _tables(spark, monkeypatch):
    """Paths and columns of the tables that are written from now on."""
    found, write = [], session._write
    monkeypatch.setattr(session, "_write", lambda df, path: (found.append((path, df.columns)), write(df, path))[1])
    return found


def _there(path):
    return os.path.exists(path.removeprefix("file://"))


def test_quality_leaves_no_texts(spark, docs, monkeypatch):
    """What the stage leaves on disk has no texts, and its verdicts are those of the rules."""
    found = _tables(spark, monkeypatch)
    kept = P.keep_quality(spark, docs, "").collect()
    assert found and not [path for path, columns in found if "text" in columns]
    assert sorted(kept, key=str) == sorted(quality_rules(docs).filter("kept").select(*docs.columns).collect(), key=str)


def test_stage_tables_go(spark, folder, monkeypatch):
    """Of the stages' tables the last one stays."""
    found = _tables(spark, monkeypatch)
    rows = P.run(spark, folder)
    stages = [path for path, _ in found if path.rsplit("/", 1)[1].split("-")[0] in {name.split(" ")[0] for name, _ in P.STAGES}]
    assert rows.count() and [path for path, columns in found if "text" in columns and _there(path)] == []
    assert _there(stages[-1]) and "token_ids" in rows.columns


def test_texts_are_not_dealt(spark, docs):
    """Documents that go are told by a broadcast, not by a shuffle of all texts."""
    plan = P.keep_distinct(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
