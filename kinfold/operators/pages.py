"""Keyset pages: order, cursor and limit; they run as a top-k, never as an offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def after(keys: list[tuple[str, str]], cursor: list) -> Column:
    """Rows behind the cursor in an order of (column, 'asc' or 'desc'); nulls come last, and None in the cursor is null."""
    out = F.lit(False)
    for (name, way), value in reversed(list(zip(keys, cursor))):
        if value is None:
            same, beyond = C(name).isNull(), F.lit(False)
        else:
            same = C(name).eqNullSafe(F.lit(value))
            beyond = C(name).isNull() | ((C(name) > F.lit(value)) if way == "asc" else (C(name) < F.lit(value)))
        out = beyond | (same & out)
    return out


def keyset_page(rows: DataFrame, keys: list[tuple[str, str]], cursor: list | None, limit: int) -> DataFrame:
    """L1, L3."""
    order = [C(k).asc_nulls_last() if way == "asc" else C(k).desc_nulls_last() for k, way in keys]
    return (rows if cursor is None else rows.filter(after(keys, cursor))).orderBy(*order).limit(limit)


def updates_page(releases: DataFrame, reading: DataFrame, cursor: list | None, limit: int) -> DataFrame:
    """L2: series by the time of their newest unread release; the cursor applies to the aggregate."""
    unread = releases.join(reading.filter("state = 'read'").select(C("release_id").alias("id")), "id", "left_anti")
    return keyset_page(unread.groupBy("series_id").agg(F.max("published_at").alias("newest"), F.count("*").alias("n")), [("newest", "desc"), ("series_id", "desc")], cursor, limit)


def resume_after(rows: DataFrame, stored: DataFrame, keys: list[tuple[str, str]], limit: int) -> DataFrame:
    """L4: the page behind a row that has left the list; stored holds its keys (one row)."""
    row = stored.select(*(k for k, _ in keys)).first()
    return keyset_page(rows, keys, list(row) if row else None, limit)


def recent_failures(jobs: DataFrame, k: int) -> DataFrame:
    """Failed or retrying rows, or those with a code, newest first, with the message masked."""
    from kinfold.functions.text import redact_text

    bad = C("status").isin("failed", "retrying") | (C("error_code") != "")
    return jobs.filter(bad).orderBy(F.desc("created_at"), F.desc("id")).limit(k).withColumn("message", redact_text(C("message")))


def activity_page(events: DataFrame, jobs: DataFrame, kinds: list[str], cursor: int | None, limit: int) -> DataFrame:
    """Events (id, job_id, event) of jobs of some kinds, newest first."""
    rows = events.join(jobs.filter(C("kind").isin(kinds)).select(C("id").alias("job_id"), "kind", "source"), "job_id")
    return keyset_page(rows, [("id", "desc")], None if cursor is None else [cursor], limit)


def tail_events(events: DataFrame, cursor: int, limit: int) -> DataFrame:
    """What comes after a cursor, which counts as the greatest id there is if it lies beyond."""
    top = events.agg(F.max("id").alias("__top"))
    return events.crossJoin(top).filter(C("id") > F.least(F.lit(cursor), "__top")).drop("__top").orderBy("id").limit(limit)  # one row
