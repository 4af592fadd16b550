"""Repair plans over whole catalogs against plain Python."""

from __future__ import annotations

import random
import re

import pytest

from kinfold.operators import repairs as R
from kinfold.session import Tables

SCHEMAS = {
    "series": "id bigint, title string, status string",
    "identities": "id bigint, series_id bigint, source string, source_id string, url string, title string, metadata string",
    "chapters": "id bigint, series_id bigint, number string, title string",
    "releases": "id bigint, identity_id bigint, chapter_id bigint, number string, title string, url string",
    "files": "id bigint, release_id bigint, chapter_id bigint, active boolean",
    "jobs": "id bigint, release_id bigint",
    "progress": "chapter_id bigint, state string",
    "activity": "id bigint, series_id bigint, chapter_id bigint, job_id bigint",
}
NAMES = {k: [c.split()[0] for c in s.split(", ")] for k, s in SCHEMAS.items()}


def catalog(seed):
    r = random.Random(seed)
    series = [(s, f"S{s}", r.choice(["untracked", "reading"])) for s in range(1, 9)]
    identities = [(i, r.randint(1, 6), r.choice("ab"), r.choice(["x", "x/", "y", f"z{i}"]), "", r.choice(["", f"T{i}"]), r.choice([None, " ", "{}", "[1]"])) for i in range(1, 17)]
    chapters, releases, files, jobs = {}, [], [], []
    for n in range(1, 90):
        identity = r.choice(identities)
        number = r.choice(["1", "2", "3", "4.50", "Latest Chapter", ""])
        key = (identity[1], number)
        if r.random() < 0.95:
            chapters.setdefault(key, 100 + len(chapters))
        title = r.choice([f"Chapter {number}", "Latest: Chapter 2", "First  chapter", "Chapter {{ number }}", "Latest: {{date}}", None])
        url = r.choice(["", "https://t.test/chapter-1", "https://t.test/chapter-2/", "https://t.test/chapter-4-5", "https://t.test/x", None])
        releases.append((n, identity[0], chapters.get(key) if r.random() < 0.95 else None, number, title, url))
        files += [(1000 + 3 * n + k, n, releases[-1][2], r.random() < 0.6) for k in range(r.choice([0, 0, 1, 2])) if releases[-1][2]]
        jobs += [(2000 + 2 * n + k, n) for k in range(r.choice([0, 0, 1]))]
    chapters = [(i, s, number, f"C{i}") for (s, number), i in chapters.items()] + [(90, 7, "1", "C90")]
    progress = [(c[0], r.choice(["read", "reading"])) for c in chapters if r.random() < 0.5]
    some = lambda rows: r.choice([None, 9999, *(x[0] for x in rows)])
    activity = [(3000 + k, some(series), some(chapters), some(jobs)) for k in range(60)]
    return dict(zip(SCHEMAS, (series, identities, chapters, releases, files, jobs, progress, activity)))


def canonical(text):
    m = re.search(r"(\d+)(?:\.(\d+))?", text)
    if not m:
        return " ".join(text.lower().split())
    part = (m[2] or "").rstrip("0")
    return (m[1].lstrip("0") or "0") + ("." + part if part else "")


def said(url, title):
    m = re.search(r"(?i)(?:chapter|ch)[-_/ ]+(\d+)(?:[.-](\d+))?", url)
    if m:
        return canonical(m[1] + ("." + m[2] if m[2] else ""))
    m = re.search(r"(?i)\bchapter\s+(\d+(?:\.\d+)?)\b", title)
    return canonical(m[1]) if m else None


def repaired(c):
    """The plan's actions and the repaired catalog, row by row."""
    t = {k: {r[0]: dict(zip(NAMES[k], r)) for r in rows} for k, rows in c.items()}
    plan = set()
    for name, parent in (("series_id", "series"), ("chapter_id", "chapters"), ("job_id", "jobs")):
        plan |= {("null_reference", a, None, name) for a, r in t["activity"].items() if r[name] is not None and r[name] not in t[parent]}
    kept, split, merged = {}, [], {}
    for i, r in sorted(t["identities"].items()):
        if (r["metadata"] or "").strip() == "":
            plan.add(("normalize_metadata", i, None, "{}"))
        first = kept.setdefault((r["series_id"], r["source"]), i)
        if first != i:
            same = r["source_id"].rstrip("/") == t["identities"][first]["source_id"].rstrip("/")
            plan.add(("consolidate_identity" if same else "split_identity", i, first, None))
            merged |= {i: first} if same else {}
            split += [] if same else [i]
    best, about = {}, {}
    for n, r in sorted(t["releases"].items()):
        title, url = r["title"] or "", r["url"] or ""
        number = (r["number"] or "").strip()
        helper = bool(re.match(R.HELPER, number) or re.match(R.HELPER, title.strip()))
        template = bool(re.search(R.TEMPLATE, title) or re.search(R.TEMPLATE, url))
        own, told = canonical(number), said(url, title if helper else "")
        stray = helper or (own != "" and told is not None and told != own)
        owner = merged.get(r["identity_id"], r["identity_id"])
        about[n] = (template, stray, owner, told if stray else own, r["identity_id"] in merged)
        if not template and not stray and r["chapter_id"] is not None:
            best[owner, own] = min(best.get((owner, own), (True, 10**9)), (about[n][4], n))
    target, aside = {}, set()
    for n, (template, stray, owner, wanted, moved) in about.items():
        r = t["releases"][n]
        to = best.get((owner, wanted), (0, None))[1] if stray or (moved and r["chapter_id"] is not None) else None
        prefix = re.match(R.PREFIX, r["title"] or "")
        if template:
            aside.add(n)
            plan.add(("quarantine_release", n, None, None))
        elif to not in (None, n):
            target[n] = to
            plan.add(("consolidate_release", n, to, None))
        elif prefix:
            plan.add(("remove_prefix", n, None, prefix[1]))
    # application
    old = {n: r["chapter_id"] for n, r in t["releases"].items()}
    for action, i, _, after in plan:
        if action == "normalize_metadata":
            t["identities"][i]["metadata"] = after
        if action == "remove_prefix":
            t["releases"][i]["title"] = after
    top = max(t["series"])
    fresh = {}
    for k, i in enumerate(split):
        r = t["identities"][i]
        t["series"][top + 1 + k] = t["series"][r["series_id"]] | {"id": top + 1 + k, "title": r["title"] or t["series"][r["series_id"]]["title"]}
        r["series_id"] = top + 1 + k
        for n, x in sorted(t["releases"].items()):
            if x["identity_id"] == i:
                fresh.setdefault((top + 1 + k, x["number"]), old[n])
    high, number_of = max(t["chapters"]), {}
    for k, key in enumerate(sorted(fresh)):
        number_of[key] = high + 1 + k
        t["chapters"][high + 1 + k] = {"id": high + 1 + k, "series_id": key[0], "number": key[1], "title": t["chapters"][fresh[key]]["title"] if fresh[key] else None}
    taken = {}
    for i in split:
        for n, x in sorted(t["releases"].items(), reverse=True):
            if x["identity_id"] == i:
                x["chapter_id"] = number_of[t["identities"][i]["series_id"], x["number"]]
                if old[n] is not None:
                    taken.setdefault(old[n], x["chapter_id"])
                for f in t["files"].values():
                    if f["release_id"] == n:
                        f["chapter_id"] = x["chapter_id"]
    for o in sorted(taken):
        if o in t["progress"] and taken[o] not in t["progress"]:
            t["progress"][taken[o]] = t["progress"].pop(o) | {"chapter_id": taken[o]}
    for i, k in merged.items():
        for x in t["releases"].values():
            x["identity_id"] = k if x["identity_id"] == i else x["identity_id"]
        del t["identities"][i]
    gone = set(target) | aside
    lost = {j for j, r in t["jobs"].items() if r["release_id"] in gone}
    moves = {}
    for n, to in target.items():
        a, b = t["releases"][n]["chapter_id"], t["releases"][to]["chapter_id"]
        if a is not None and a != b:
            moves[a] = min(moves.get(a, b), b)
    for r in t["activity"].values():
        r["job_id"] = None if r["job_id"] in lost else r["job_id"]
        r["chapter_id"] = moves.get(r["chapter_id"], r["chapter_id"])
    giver = {}
    for f in t["files"].values():
        if f["active"] and f["release_id"] in target:
            giver[target[f["release_id"]]] = max(giver.get(target[f["release_id"]], 0), f["release_id"])
    for i, f in list(t["files"].items()):
        n = f["release_id"]
        if n in aside:
            del t["files"][i]
            continue
        to = target.get(n, n)
        f["active"] = f["active"] and giver.get(to, n) == n
        if n in target:
            f |= {"release_id": to, "chapter_id": t["releases"][to]["chapter_id"]}
    with_jobs = {j["release_id"] for j in t["jobs"].values()}
    for i, j in list(t["jobs"].items()):
        n = j["release_id"]
        to = target.get(n, n)
        first = to if to in with_jobs else min((m for m, x in target.items() if x == to and m in with_jobs), default=n)
        if n in aside or n != first:
            del t["jobs"][i]
        else:
            j["release_id"] = to
    touched = {x for n, r in t["releases"].items() if n in gone or r["chapter_id"] != old[n] for x in (old[n], r["chapter_id"])}
    for n in gone:
        del t["releases"][n]
    used = {r["chapter_id"] for r in t["releases"].values()} | {f["chapter_id"] for f in t["files"].values()}
    for x in touched - used - {None}:
        del t["chapters"][x]
        t["progress"].pop(x, None)
        for r in t["activity"].values():
            r["chapter_id"] = None if r["chapter_id"] == x else r["chapter_id"]
    for s, r in list(t["series"].items()):
        if r["status"] == "untracked" and not any(i["series_id"] == s for i in t["identities"].values()) and not any(x["series_id"] == s for x in t["chapters"].values()):
            plan.add(("delete_series", s, None, None))
            del t["series"][s]
            for a in t["activity"].values():
                a["series_id"] = None if a["series_id"] == s else a["series_id"]
    for action, i, _, after in plan:
        if action == "null_reference":
            t["activity"][i][after] = None
    return plan, {k: sorted((tuple(r[x] for x in NAMES[k]) for r in rows.values()), key=str) for k, rows in t.items()}


def frames(spark, c):
    return {k: spark.createDataFrame(rows, SCHEMAS[k]) for k, rows in c.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repairs(spark, seed):
    rows = catalog(seed)
    c, tables = frames(spark, rows), Tables(spark, "repairs")
    plan = R.plan_repairs(c, tables)
    want, after = repaired(rows)
    got = [(r.action, r.row_id, r.target_id, r.after) for r in plan.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert R.plan_conflicts(c, plan).count() == 0
    out = R.apply_plan(c, plan, tables)
    for k in SCHEMAS:
        assert sorted(map(tuple, out[k].select(*NAMES[k]).collect()), key=str) == after[k], k
    again = R.plan_repairs(out, Tables(spark, "repairs"))
    assert again.count() == 0


def test_a_plan_of_every_action_and_one_of_none(spark):
    actions = {a for seed in (1, 2, 3) for a, *_ in repaired(catalog(seed))[0]}
    assert actions == {"null_reference", "normalize_metadata", "consolidate_identity", "split_identity", "quarantine_release", "consolidate_release", "remove_prefix", "delete_series"}
    empty = {k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}
    tables = Tables(spark, "repairs")
    plan = R.plan_repairs(empty, tables)
    assert plan.count() == 0 and all(df.count() == 0 for df in R.apply_plan(empty, plan, tables).values())


def test_an_edited_plan_with_conflicts_is_refused(spark):
    c = frames(spark, catalog(1))
    row = lambda action, i, to: ("k", "c", action, i, to, None)
    bad = [row("consolidate_release", 1, 2), row("quarantine_release", 1, None), row("quarantine_release", 2, None), row("consolidate_release", 3, 5000), row("consolidate_identity", 1, 9999)]
    plan = spark.createDataFrame(bad, "key string, category string, action string, row_id bigint, target_id bigint, after string")
    found = {tuple(r) for r in R.plan_conflicts(c, plan).collect()}
    assert {(1, "release_removed_twice"), (1, "target_removed"), (3, "no_target"), (1, "identities_of_different_series_or_source")} <= found
    with pytest.raises(ValueError, match="plan_conflicts"):
        R.apply_plan(c, plan, Tables(spark, "repairs"))


def test_a_plan_writes_no_catalog_of_its_own(spark):
    """The trial of a plan looks at three tables; it wrote all eight, and each release several times over."""
    import os

    tables = Tables(spark, "repairs")
    R.plan_repairs({k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in catalog(1).items()}, tables)
    assert not {x for x in os.listdir(tables.base.removeprefix("file://")) if x in {f"trial-{k}" for k in SCHEMAS}}


def test_the_given_catalog_is_derived_once(spark):
    """Chapters are distinct lines: no table of the catalog reads lines again."""
    from kinfold.plans.fixtures import view
    from kinfold.plans.maintenance_queries import _catalog

    folder = "/root/testdata/sf0.001"
    c = _catalog(lambda x: view(spark, folder, x), Tables(spark, "repairs"))
    assert not [f for df in c.values() for f in df.inputFiles() if "lineitem" in f]
