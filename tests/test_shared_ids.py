"""Rows of one id, and files of one path, that aren't the same."""

from __future__ import annotations

import duckdb
import pytest

from kinfold.operators import audit as I
from kinfold.operators import merge as M
from kinfold.plans import registry


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_artifacts_of_one_id_in_two_series(spark):
    a = spark.createDataFrame([(1, 10, 1, "active"), (2, 10, 1, "active"), (2, 20, 1, "active"), (1, 20, 2, "active"), (3, 20, 1, "active"), (3, 30, 1, "lost")], "id bigint, series_id bigint, chapter bigint, state string")
    got = rows(M.merge_artifacts(a, ["series_id", "chapter"]).select("series_id", "chapter", "id", "state"))
    assert got == [(10, 1, 1, "active"), (10, 1, 2, "quarantined"), (20, 1, 2, "active"), (20, 1, 3, "quarantined"), (20, 2, 1, "active"), (30, 1, 3, "lost")]


def test_archives_of_one_path(spark):
    archives = spark.createDataFrame([("a/1", "x", True), ("a/1", "y", True), ("a/2", "z", True)], "path string, checksum string, readable boolean")
    members = spark.createDataFrame([("a/1", "x", "1.jpg"), ("a/1", "y", "1.jpg"), ("a/1", "y", "2.jpg"), ("a/2", "z", "1.jpg")], "path string, checksum string, member string")
    told = spark.createDataFrame([("a/1", "x", 10, 1.5), ("a/1", "y", 20, 2.5), ("a/2", "z", 30, 4.0)], "path string, checksum string, series_id bigint, number double")
    known = spark.createDataFrame([("a/1", "x", 10, 1.5), ("a/1", "y", 20, 3.5), ("a/2", "z", 30, 4.0)], "path string, checksum string, series_id bigint, number double")
    none = archives.limit(0).select("checksum")
    assert rows(I.archive_check(archives, members, told, known, none, ("path", "checksum"))) == [("a/1", "metadata_differs"), ("a/1", "review_single_page")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Lines of 30 parts and 4 suppliers, who have keys in three thousands: one artifact id stands for up to three."""
    path = tmp_path_factory.mktemp("shared")
    duckdb.sql(f"COPY (SELECT p AS l_partkey, s + 1000 * k AS l_suppkey FROM range(30) a(p), range(4) b(s), range(3) c(k)) TO '{path}/lineitem.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["m05_merge_artifacts", "i10_archive_check", "x04_import_records", "i11_storage_states", "i11_storage_reconcile"])
def test_queries_of_shared_ids(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert rows(df) == sorted(want)


def test_files_of_one_path(spark):
    expected = spark.createDataFrame([("blobs/x", "x", "library/1"), ("blobs/y", "y", "library/1"), ("blobs/z", "z", "library/1"), ("blobs/n", None, "library/2")], "blob_path string, checksum string, projection_path string")
    manifest = spark.createDataFrame([("blobs/x", "x"), ("blobs/x", "x"), ("blobs/y", "y"), ("blobs/z", "z"), ("library/1", "x"), ("library/1", "y"), ("blobs/o", "o"), ("blobs/o", "p")], "path string, sha256 string")
    states, numbers = I.storage_reconcile(expected, manifest, expected.select("blob_path"))
    assert rows(states.select("blob_path", "state")) == [("blobs/n", "missing_blob"), ("blobs/x", "ok"), ("blobs/y", "ok"), ("blobs/z", "repair")]
    assert numbers.first().asDict() == {"checked": 4, "ok": 2, "repair": 1, "missing_blobs": 1, "orphan_blobs": 1}
