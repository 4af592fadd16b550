"""Catalogs to portable documents and back."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import catalog_io as X
from kinfold.session import Tables, fresh_path
from kinfold.sources import files as S

CATALOG = {
    "series": "id bigint, title string, description string, status string",
    "identities": "id bigint, series_id bigint, source string, source_id string, title string, url string, description string, revision string",
    "aliases": "series_id bigint, identity_id bigint, alias string",
    "external_ids": "identity_id bigint, provider string, value string",
    "alternates": "identity_id bigint, source string, source_id string, title string, url string",
    "chapters": "id bigint, series_id bigint, number string",
    "reading": "chapter_id bigint, state string, read_at timestamp",
    "artifacts": "chapter_id bigint, state string",
    "decisions": "left_id bigint, right_id bigint, decision string",
    "providers": "source string, enabled boolean",
}
PROVIDERS = ("alpha", "beta", "gamma")
AT = datetime.datetime(2024, 1, 5, 3, 4, 5, 678)


def catalog(seed):
    r = random.Random(seed)
    series = [(s, f"Title {s}", r.choice(["", f"About {s}"]), r.choice(["untracked", "interested", "reading", "caught_up", "paused"])) for s in range(1, 13)]
    identities, n = [], 0
    for s, *_ in series[:-1]:  # the last has no source
        for source in r.sample(PROVIDERS, r.randint(1, 3)):
            n += 1
            identities.append((n, s, source, f"id-{n}", f"Name {n}", f"https://x.test/{n}", "", r.choice(["", "r1"])))
    aliases = [(s, None, f"Other {s}") for s, *_ in series[::2]] + [(i[1], i[0], f"Also {i[0]}") for i in identities[::2]]
    external = [(i[0], p, f"{p}{i[0]}") for i in identities for p in ("x", "y") if r.random() < 0.5]
    alternates = [(i[0], i[2], f"alt-{i[0]}-{k}", f"Alt {k}", "https://x.test/a") for i in identities for k in range(r.choice([0, 0, 2]))]
    chapters = [(10 * s + k, s, str(k)) for s, *_ in series for k in range(1, 5)]
    reading = [(c[0], *r.choice([("read", AT), ("reading", None), ("unread", None), ("unread", AT)])) for c in chapters if r.random() < 0.5]
    artifacts = [(c[0], r.choice(["active", "quarantined"])) for c in chapters if r.random() < 0.2]
    decisions = [(a[0], b[0], r.choice(["rejected", "accepted"])) for a, b in zip(identities, identities[3:]) if a[1] != b[1]]
    return dict(zip(CATALOG, (series, identities, aliases, external, alternates, chapters, reading, artifacts, decisions, [("alpha", True), ("beta", False)])))


def frames(spark, c):
    return {k: spark.createDataFrame(c.get(k, []), s) for k, s in CATALOG.items()}


def rows(tables, rekey=None):
    out = {}
    for k, df in tables.items():
        names = sorted(df.columns)
        found = [tuple((rekey or {}).get(r[x], r[x]) if x == "key" else r[x] for x in names) for r in df.collect()]
        out[k] = sorted(found, key=str)
    return out


def keys_by_title(d):
    return {r.key: r.title for r in d["series"].collect()}


def written(spark, d):
    path = fresh_path(spark, "document")
    S.document_lines(d, "2024-01-31T00:00:00Z").write.text(path)
    return S.load_document(spark, path)


@pytest.mark.parametrize("seed", [1, 2])
def test_round_trip_into_an_empty_catalog(spark, seed):
    c = frames(spark, catalog(seed))
    d = X.export_catalog(c)
    want = rows(d, keys_by_title(d))
    assert {s[3] for s in want["reading"]} == {"read", "reading", "unread"} and len(want["separations"]) > 2
    loaded, unknown = written(spark, d)
    assert unknown.count() == 0 and X.validate(loaded, PROVIDERS, unknown).count() == 0
    assert rows(loaded, keys_by_title(loaded)) == want
    made = X.import_catalog(loaded, frames(spark, {}), Tables(spark, "import"))
    # what was downloaded is no longer, so status and flag come from the document alone
    again = X.export_catalog(made)
    got = rows(again, keys_by_title(again))
    drop = lambda t: sorted(tuple(r[:1] + r[2:]) for r in t)  # noqa: E731 (description, downloaded, ...)
    untracked = {r[3] for r in want["series"]} - {r[3] for r in got["series"]}
    assert not untracked and drop(got["series"]) == drop(want["series"])
    for k in want:
        ends = (lambda t: {frozenset((x[:2], x[2:])) for x in t}) if k == "separations" else (lambda t: t)  # either may come first
        assert k == "series" or ends(got[k]) == ends(want[k]), k
    second = X.import_catalog(loaded, made, Tables(spark, "import"))
    assert rows(second) == rows(made)


def test_import_into_its_own_catalog_changes_nothing_but_the_restored_status(spark):
    c = frames(spark, catalog(3))
    d = X.export_catalog(c)
    out = X.import_catalog(d, c, Tables(spark, "import"))
    before, after = rows({k: df.select(*sorted(df.columns)) for k, df in c.items()}), rows(out)
    for k in CATALOG:
        if k == "series":
            said = {r.key: r.status for r in d["series"].collect()}
            assert after[k] == sorted(((r[0], r[1], said.get(str(r[1]), r[2]) if r[2] == "untracked" else r[2], r[3]) for r in before[k]), key=str)
        elif k == "decisions":
            assert {(r[1], r[2]) for r in after[k]} == {(r[1], r[2]) for r in before[k]}
        else:
            assert after[k] == before[k], k


def document(spark, **tables):
    kinds = {
        "series": "key string, title string, status string, description string, downloaded boolean", "series_aliases": "key string, alias string",
        "sources": "key string, source string, source_id string, title string, url string, description string, revision string", "source_aliases": "key string, source string, alias string",
        "external_ids": "key string, source string, provider string, value string", "alternates": "key string, source string, source_id string, title string, url string",
        "reading": "key string, chapter string, state string, read_at timestamp", "separations": "left_source string, left_id string, right_source string, right_id string", "providers": "source string, enabled boolean",
    }
    return {k: spark.createDataFrame(tables.get(k, []), s) for k, s in kinds.items()}


def test_import_merges_and_never_falls(spark):
    """One portable series names two local ones; states and statuses only rise; claims go to the first."""
    c = frames(spark, {
        "series": [(1, "", "", "caught_up"), (2, "Two", "D2", "paused"), (3, "Three", "", "reading")],
        "identities": [(1, 1, "alpha", "a", "A", "https://x.test/a", "", ""), (2, 2, "beta", "b", "B", "https://x.test/b", "", ""), (3, 3, "alpha", "c", "C", "https://x.test/c", "", "")],
        "aliases": [(1, None, "One"), (2, 2, "one!"), (3, None, "Third")], "external_ids": [(1, "x", "7"), (3, "x", "9")], "alternates": [(3, "beta", "z", "Z", "")],
        "chapters": [(1, 1, "1"), (2, 2, "1.0"), (3, 2, "2")], "reading": [(1, "reading", None), (2, "read", AT), (3, "read", None)], "artifacts": [(2, "active")],
        "decisions": [(1, 3, "accepted")], "providers": [("alpha", True)],
    })
    d = document(
        spark,
        series=[("k", "New", "interested", "DN", False), ("m", "Fresh", "paused", "", False)],
        sources=[("k", "alpha", "a", "A2", "https://x.test/a2", "da", "r"), ("k", "beta", "b", "B", "https://x.test/b", "", ""), ("m", "gamma", "g", "G", "https://x.test/g", "", ""), ("m", "alpha", "c9", "C9", "https://x.test/c9", "", "")],
        series_aliases=[("k", "ONE"), ("k", "Uno"), ("m", "")], source_aliases=[("m", "gamma", "Gee"), ("m", "alpha", "gee")],
        external_ids=[("k", "alpha", "x", "8"), ("k", "beta", "x", "9"), ("m", "gamma", "x", "5"), ("m", "alpha", "x", "5")], alternates=[("k", "beta", "z", "", ""), ("k", "beta", "zz", "", "")],
        reading=[("k", "1", "unread", None), ("k", "02", "read", AT), ("k", "3", "reading", None)], separations=[("alpha", "a", "alpha", "c9")], providers=[("alpha", False), ("beta", True)],
    )
    out = X.import_catalog(d, c, Tables(spark, "import"))
    get = lambda k, *names: sorted((tuple(r) for r in out[k].select(*names).collect()), key=str)
    assert get("series", "id", "title", "description", "status") == [(1, "Two", "D2", "interested"), (3, "Three", "", "reading"), (4, "Fresh", "", "paused")]
    assert get("identities", "id", "series_id", "source_id", "title", "revision") == [(1, 1, "a", "A2", "r"), (2, 1, "b", "B", ""), (3, 3, "c", "C", ""), (4, 4, "c9", "C9", ""), (5, 4, "g", "G", "")]
    assert get("aliases", "series_id", "identity_id", "alias") == [(1, None, "One"), (1, None, "Uno"), (3, None, "Third"), (4, 4, "gee")]
    assert get("external_ids", "identity_id", "provider", "value") == [(1, "x", "8"), (3, "x", "9"), (4, "x", "5")]
    assert get("alternates", "identity_id", "source_id", "title") == [(2, "zz", "B"), (3, "z", "Z")]
    assert get("chapters", "id", "series_id", "number") == [(1, 1, "1"), (3, 1, "2"), (4, 1, "3")]
    assert get("reading", "chapter_id", "state", "read_at") == [(1, "read", AT), (3, "read", AT), (4, "reading", None)]
    assert get("artifacts", "chapter_id") == [(1,)] and get("providers", "source", "enabled") == [("alpha", False), ("beta", True)]
    assert get("decisions", "left_id", "right_id", "decision") == [(1, 3, "accepted"), (1, 4, "rejected")]
    assert rows(X.import_catalog(d, out, Tables(spark, "import"))) == rows(out)
    twice = document(spark, series=[("k", "a", "paused", "", False), ("m", "b", "paused", "", False)], sources=[("k", "alpha", "a", "A", "https://x.test/1", "", ""), ("m", "alpha", "a ", "A", "https://x.test/2", "", "")])
    with pytest.raises(ValueError, match="plan_import"):
        X.import_catalog(twice, c, Tables(spark, "import"))


def test_every_rule(spark):
    ok = ("k", "alpha", "1", "T", "https://x.test", "", "")
    d = document(
        spark,
        series=[("k", "t", "paused", "", False), ("e", "t", "odd", "", False)], sources=[ok, ("k", "beta", "2", "", "http://" + "u" * 4096, "", "r" * 21), ("k", "gamma", "3", None, None, None, None)],
        series_aliases=[("k", ""), ("k", "fine")], source_aliases=[("k", "alpha", "a" * 501)], external_ids=[("k", "alpha", "", "1"), ("k", "beta", "x", "v" * 201), ("k", "gamma", "y", "1"), ("k", "gamma", "y", "2")],
        alternates=[("k", "alpha", "", "", ""), ("k", "beta", "b", "t" * 501, "https://x.test/" + "u" * 4096), ("k", "gamma", "c", "", "ftp://x.test")],
        reading=[("k", "", "read", None), ("k", "1", "odd", None)], providers=[("Alpha", True), ("beta", None)],
    )
    unknown = spark.createDataFrame([("document", "extra")], "row_key string, name string")
    got = {r.rule for r in X.validate(d, PROVIDERS, unknown).collect()}
    assert got >= {"source_title_length", "url_length", "revision_length", "alias_length", "external_id_form", "external_id_twice", "alternate_id_length", "alternate_title_length", "alternate_url_length", "alternate_url_scheme", "chapter_length", "reading_unknown", "preference_form", "unknown_key", "no_source", "status_unknown", "url_scheme"}
    clean = document(spark, series=[("k", "t", "paused", "", False)], sources=[ok])
    assert X.validate(clean, PROVIDERS).count() == 0 and X.validate(document(spark), PROVIDERS).count() == 0


def test_unknown_fields_are_found(spark):
    path = fresh_path(spark, "document")
    lines = ['{"format": "catalog", "version": 1, "more": 1, "series": [{"title": "t", "status": "paused", "odd": 2, "sources": [{"source": "alpha", "source_id": "1", "new": 3}]}]}', "no json", "", '{"series": []}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    d, unknown = S.load_document(spark, path)
    assert sorted(map(tuple, unknown.collect())) == [("document", "more"), ("document", "value"), ("series:t", "odd"), ("source:1", "new")]
    assert d["series"].count() == 1 and d["sources"].select("key", "source_id").first() == ("alpha:1", "1")
    assert d["reading"].count() == 0 and d["providers"].filter(F.col("enabled")).count() == 0


def test_a_document_is_parsed_once(spark, tmp_path):
    """Tables of a document come from its parsed form: no text is read again, whatever the number of rules that look at them."""
    from kinfold.sources import files

    (tmp_path / "d.jsonl").write_text('{"format":"catalog","version":1,"series":[{"title":"T","sources":[{"source":"a","source_id":"1"}]}],"odd":1}\nnot json\n')
    d, unknown = files.load_document(spark, str(tmp_path / "d.jsonl"))
    assert [r.key for r in d["series"].collect()] == ["a:1"] and sorted(map(tuple, unknown.collect())) == [("document", "odd"), ("document", "value")]
    assert all(x.endswith(".parquet") for df in [*d.values(), unknown] for x in df.inputFiles())
