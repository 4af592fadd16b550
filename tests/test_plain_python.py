"""Queries that SQL can't express against plain Python, at the smallest scale."""

from __future__ import annotations

import datetime
import hashlib
import os
import re
import unicodedata
from collections import defaultdict
from difflib import SequenceMatcher

import pytest

from kinfold.functions import text as T
from kinfold.operators.feeds import HELPERS
from kinfold.plans import registry
from kinfold.plans.fixtures import view

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def ask(spark, name):
    return registry.QUERIES[name](spark, FOLDER).collect()


def norm(title):
    t = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()
    t = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", t)
    t = re.sub(r"\b(" + "|".join(T.TITLE_STOP_WORDS) + r")\b", " ", t)
    return re.sub(r"[^a-z0-9]+", " ", t).strip()


def seq(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def tokens(t):
    return {x for x in t.split(" ") if x}


def similar(a, b):
    """The greater of token Jaccard and sequence ratio."""
    x, y = norm(a), norm(b)
    if not x or not y:
        return 0.0
    return max(len(tokens(x) & tokens(y)) / len(tokens(x) | tokens(y)), seq(x, y))


def matching(x, y):
    """Of normalised titles: 1 if equal, else the weighed mean, bounded with fewer than two common tokens."""
    if not x or not y:
        return 0.0
    common = len(tokens(x) & tokens(y))
    score = 0.6 * common / len(tokens(x) | tokens(y)) + 0.4 * seq(x, y)
    return 1.0 if x == y else score if common >= 2 else min(score, 0.45)


def near(a, b):
    return abs(a - b) < 2e-6


@pytest.fixture(scope="module")
def tables(spark):
    return lambda name: view(spark, FOLDER, name).collect()


def test_titles(spark, tables):
    other = {r.id: (r.title, f"{r.source} {r.title.upper()}{' of Old' if r.id % 3 == 0 else ''}") for r in tables("identity")}
    for r in ask(spark, "f27_title_similarity"):
        assert near(r.result, similar(*other[r.id]))
    for r in ask(spark, "f28_matching_title_similarity"):
        assert near(r.result, matching(*map(norm, other[r.id])))


def test_texts(spark, tables):
    items = {r.item_id: r.text for r in tables("benchmark")}
    squeeze = lambda t: " ".join(t.lower().split())
    assert {r.item_id for r in ask(spark, "d01_sequence_ratio")} == set(items)
    for r in ask(spark, "d01_sequence_ratio"):
        assert near(r.ratio, seq(items[r.item_id], items[r.item_id][::-1]))
    for r in ask(spark, "f29_text_similarity"):
        assert near(r.result, seq(squeeze(items[r.id]), squeeze(items[r.id][::-1])))


def test_redacted_documents(spark, tables):
    masks = [(re.compile(p, re.ASCII), m.replace("$1", r"\g<1>").replace("$2", r"\g<2>")) for p, m in T.SECRETS.items()]
    got = {r.doc_id: r.result for r in ask(spark, "f22_redact_documents")}
    docs = tables("documents")
    assert len(got) == len({r.doc_id for r in docs})
    for r in docs:
        text = r.text or ""
        for pattern, mask in masks:
            text = pattern.sub(mask, text)
        assert got[r.doc_id] == hashlib.sha256(text.encode()).hexdigest(), r.doc_id


def score_of(tables, told=True):
    """Evidence and score of pairs of series, from whole tables."""
    identities = tables("identity")
    series, hashes = {r.id: r.series_id for r in identities}, {r.id: r.hash for r in tables("signature")}
    titles, kids, ids, own = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(list)
    for r in identities:
        titles[r.series_id].add(norm(r.title))
        own[r.series_id].append(r.id)
    for r in tables("alias"):
        titles[series[r.identity_id]].add(norm(r.alias))
    for r in tables("chapter"):
        if r.identity_id in series:
            kids[series[r.identity_id]].add(r.number)
    for r in tables("external_id"):
        ids[series[r.identity_id]].add((r.provider, r.value))

    about = {}
    for s in own:
        mine = [r for r in identities if r.series_id == s]
        about[s] = " / ".join((min(r.title for r in mine), max(r.source_id for r in mine), min(r.source for r in mine))).lower()

    def score(a, b):
        description = seq(" ".join(about.get(a, "").split()), " ".join(about.get(b, "").split())) if told else 0.0
        title = max((matching(x, y) for x in titles[a] for y in titles[b] if x and y), default=0.0)
        cover, state = 0.0, None
        for x in own[a]:
            for y in own[b]:
                if x in hashes and y in hashes:
                    d = (hashes[x] ^ hashes[y]).bit_count()
                    s = "match" if d <= 4 else "likely" if d <= 10 else "different" if d >= 28 else "inconclusive"
                    raw = max(0.0, 1 - d / 32)
                    c = {"match": max(raw, 0.98), "likely": min(max(raw, 0.7), 0.89), "different": min(raw, 0.15)}.get(s, min(raw, 0.6))
                    if state is None or c > cover:
                        cover, state = c, s
        union = kids[a] | kids[b]
        children = len(kids[a] & kids[b]) / len(union) if union else 0.0
        latest = 0.0
        if kids[a] and kids[b]:
            delta = abs(max(kids[a]) - max(kids[b]))
            latest = 1.0 if delta <= 2 else 1 - (delta - 2) / 4 if delta <= 6 else 0.0
        total = 0.20 * title + 0.55 * cover + 0.08 * description + 0.05 * children + 0.12 * latest
        if state == "match":
            total = max(total, 0.9 if latest == 1.0 or max(title, description) >= 0.75 else 0.86)
        return (title, cover, children, latest, description, 0.99 if ids[a] & ids[b] else min(total, 0.98))

    return score


def test_scores(spark, tables):
    score = score_of(tables)
    pairs = {(r.left_id - r.left_id % 2, r.right_id - r.right_id % 2) for r in tables("decision")}
    got = {(r.a, r.b): r for r in ask(spark, "e16_score_pairs")}
    assert set(got) == {p for p in pairs if p[0] != p[1]}
    for (a, b), r in got.items():
        assert all(map(near, (r.title, r.cover, r.children, r.latest, r.description, r.score), score(a, b))), (a, b)
    best = {}
    for (a, b), r in got.items():
        best[b] = max(best.get(b, (-1.0, 0)), (r.score, -a))
    assert {(r.b, r.a, r.score) for r in ask(spark, "e17_best_selected")} == {(b, -a, s) for b, (s, a) in best.items()}


def test_rescored_decisions(spark, tables):
    score, series = score_of(tables, told=False), {r.id: r.series_id for r in tables("identity")}
    got = {r.id: r for r in ask(spark, "e19_rescore_all_evidence")}
    changed = 0
    for r in tables("decision"):
        a, b = sorted((series.get(r.left_id, -1), series.get(r.right_id, -1)))
        want = score(a, b)[-1] if r.decision == "pending" and -1 not in (a, b) and a != b else r.confidence
        assert near(got[r.id].confidence, want) and got[r.id].decision == r.decision
        changed += want != r.confidence
    assert changed


def test_title_scores(spark, tables):
    own = defaultdict(set)
    for r in tables("identity"):
        own[r.id].add(norm(r.title))
    for r in tables("alias"):
        own[r.identity_id].add(norm(r.alias))
    for r in ask(spark, "e09_title_score"):
        assert near(r.title, max((matching(x, y) for x in own[r.a] for y in own[r.b] if x and y), default=0.0))


def test_identity_repair(spark, tables):
    """Groups of revisions: least title similarity and overlap over all pairs."""
    kids, groups = defaultdict(set), defaultdict(list)
    for r in tables("chapter"):
        kids[r.identity_id].add(r.number)
    for r in tables("identity"):
        groups[r.source, r.source_id.rsplit("-", 1)[0]].append(r)
    want = {}
    for (source, stable), rows in groups.items():
        pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :]]
        title = min((min(similar(a.title, b.title), similar(b.title, a.title)) for a, b in pairs), default=1.0)
        common = min((len(kids[a.id] & kids[b.id]) for a, b in pairs), default=0)
        one, cover = len({r.series_id for r in rows}) == 1, len({r.size % 3 for r in rows}) == 1
        want[source, stable] = (len(rows), round(title, 4), common, cover, "consolidate" if title >= 0.3 and (common >= 1 or cover or one) else "quarantine")
    got = {(r.source, r.stable): (r.identities, r.title, r.common, r.cover_agrees, r.action) for r in ask(spark, "i19_identity_repair_audit")}
    assert got.keys() == want.keys()
    for k, g in got.items():
        assert abs(g[1] - want[k][1]) < 2e-4 and (g[0], *g[2:]) == (want[k][0], *want[k][2:]), k


def test_cover_shortlist(spark, tables):
    rows, hashes = {r.id: r for r in tables("identity")}, {r.id: r.hash for r in tables("signature")}
    blocked = {(r.a, r.b) for r in ask(spark, "e05_block_cover_band")}
    want = {}
    for a, b in blocked:
        if a in hashes and b in hashes:
            title, distance = similar(rows[a].title, rows[b].title), (hashes[a] ^ hashes[b]).bit_count()
            if title >= 0.65 or distance <= 14:
                want[a, b] = (title, distance)
    got = {(r.a, r.b): (r.title, r.distance) for r in ask(spark, "e05_cover_shortlist")}
    assert got.keys() == want.keys() and all(near(got[p][0], want[p][0]) and got[p][1] == want[p][1] for p in want)


def test_proposal_components(spark):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    proposals = [(r.lo, r.hi) for r in ask(spark, "e22_review_proposals")]
    for lo, hi in proposals:
        x, y = find(lo), find(hi)
        root[max(x, y)] = min(x, y)
    assert sorted(map(tuple, ask(spark, "e23_proposal_components"))) == sorted((lo, hi, find(lo)) for lo, hi in proposals)


def test_pages(spark, tables):
    """Links, flags and page hints, by regular expressions over the source."""
    pages = tables("pages")
    link = re.compile(r'<a href="([^"]*)">(.*?)</a>', re.DOTALL)
    plain = lambda t: " ".join(re.sub(r"<[^>]*>", "", t).split())
    want = {}
    for p in pages:
        want[p.page_id] = [(h, plain(t)) for h, t in link.findall(re.sub(r"<!--.*?-->|<(script|style)>.*?</\1>", "", p.html or "", flags=re.DOTALL))]
    got = defaultdict(list)
    for r in sorted(ask(spark, "n08_extract_links"), key=lambda r: (r.page_id, r.position)):
        got[r.page_id].append((r.href, r.text))
    assert dict(got) == {k: [x for x in v if x[1].lower() not in HELPERS] for k, v in want.items() if any(x[1].lower() not in HELPERS for x in v)}
    for r in ask(spark, "n11_page_count_hint"):
        url = next(p.url for p in pages if p.page_id == r.page_id)
        own = re.search(r"[?&]page=(\d+)(?:&|#|$)", url or "")
        after = str((int(own[1]) if own else 1) + 1)
        assert r.has_next == any((m := re.search(r"[?&]page=(\d+)", h)) and m[1] == after for h, _ in want[r.page_id])
    for r in ask(spark, "n10_page_flags"):
        html = re.sub(r"<!--.*?-->|<(script|style)>.*?</\1>", " ", next(p.html for p in pages if p.page_id == r.page_id) or "", flags=re.DOTALL)
        text = re.sub(r"<[^>]*>", " ", html).lower()
        assert r.locked == any(x in " ".join(text.split()) for x in ("premium", "early access", "locked"))
        assert r.template == bool(re.search(r"\{\{\s*(number|date)\s*\}\}", text)) and r.n_helpers == sum(t.lower() in HELPERS for _, t in want[r.page_id])


def test_poll_cadence(spark, tables):
    """Interval and streak of each source, poll by poll."""
    state = {}
    for r in sorted(tables("events"), key=lambda r: r.event_id):
        source = f"s{r.user_id % 4}"
        interval, streak = state.get(source, (300, 0))
        if r.event_type == "error":
            interval, streak = min(1200, round(max(interval, 300) * 1.5)), 0
        elif r.event_type == "purchase":
            interval, streak = max(150, round(interval * 0.75)), 0
        else:
            streak = min(streak + 1, 5)
            interval = min(1200, round(interval * (1.1 + streak * 0.02)))
        state[source] = (max(60, interval), streak)
    got = {}
    for r in ask(spark, "t05_poll_cadence"):
        got[r.source] = (r.interval, r.streak)
    assert got == state


def test_circuit_breaker(spark, tables):
    """Failures and the end of the cooldown of each source, sample by sample."""
    state = {}
    for r in sorted(tables("events"), key=lambda r: r.event_id):
        n, until = state.get(source := f"s{r.user_id % 4}", (0, 0.0))
        at = r.ts.replace(tzinfo=datetime.UTC).timestamp()
        if r.event_type == "error":
            n += 1
            until = at + min(360 * 60, 300 * 2 ** min(n - 3, 60)) if n >= 3 else until
        elif at >= until:
            n, until = 0, 0.0
        state[source] = (n, until)
    got = {r.source: (r.failures, r.cooling_until) for r in ask(spark, "t04_circuit_breaker")}
    assert got.keys() == state.keys() and all(got[s][0] == n and abs(got[s][1] - u) < 1e-3 for s, (n, u) in state.items())


def test_closed_runs(spark, tables):
    """Runs of requests, five a second, closed by a signal, by number or by time; those still open at the end aren't rows."""
    open_runs, learnt, out = {}, {}, []
    rows = sorted(tables("events"), key=lambda r: r.event_id)
    for r in rows:
        source, at = f"s{r.user_id % 4}", r.event_id * 200_000
        if source in open_runs and at >= open_runs[source][3] + 600_000_000:
            out.append((source, *open_runs.pop(source)[:3], "time"))
        tier, n, bad, began = open_runs.get(source) or (min(8, learnt.get(source, 1) + 1), 0, 0, at)
        failed = r.event_type == "error"
        open_runs[source] = (tier, n + 1, bad + failed, began)
        limited = failed and r.user_id % 25 == 0
        if limited or n + 1 == 500:
            out.append((source, tier, n + 1, bad + failed, "limit" if limited else "requests"))
            learnt[source] = max(1, tier - 1) if limited else max(learnt.get(source, 1), tier)
            del open_runs[source]
        elif source not in learnt:
            learnt[source] = 1
    got = sorted((r.source, r.tier, r.requests, r.failures, r.reason) for r in ask(spark, "t07_closed_runs"))
    timed = [x for x in out if x[4] == "time"]
    assert got and not timed and got == sorted(out)


def test_pages_come_to_python_a_few_at_a_time(spark):
    """Arrow's batches of ten thousand pages made a worker grow with its share of the table; and a page is parsed once."""
    from kinfold.operators import feeds

    pages = spark.createDataFrame([(1, "https://t.test/?page=1", "<a href='?page=2'>next</a> locked"), (2, "https://t.test/?page=2", None)], "page_id bigint, url string, html string")
    flags, hint = feeds.page_flags(pages), feeds.page_count_hint(pages)
    assert sorted(map(tuple, flags.collect())) == [(1, True, False, 0), (2, False, False, 0)] and sorted(map(tuple, hint.collect())) == [(1, True), (2, False)]
    for df in (flags, hint, feeds.extract_links(pages)):
        said = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in said and said.count("BatchEvalPython") == 1
