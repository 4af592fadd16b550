"""Incoming listings against identities of the same title."""

from __future__ import annotations

from kinfold.operators import incoming as R


def test_own_addresses_make_no_pairs(spark, monkeypatch):
    """300 listings of new addresses and 300 identities of one title: few pairs are compared, and all listings are matched."""
    row = "id bigint, source string, title string, source_id string, url string"
    mine = spark.createDataFrame([(i, "alpha", "One", f"m-{i}", f"https://t.test/m/{i}") for i in range(300)], row)
    new = spark.createDataFrame([(1000 + i, "alpha", "One", "m-7" if i == 5 else f"n-{i}", f"https://t.test/n/{i}") for i in range(300)], row)
    kids = spark.createDataFrame([(i, n) for i in [*range(300), *range(1000, 1300)] for n in range(6 if i != 9 else 5)], "identity_id bigint, number bigint")
    ids = spark.createDataFrame([(3, "x", "1")], "identity_id bigint, provider string, value string")
    seen, plain = [], R.duplicate_evidence

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(R, "duplicate_evidence", counted)
    got = {r.incoming: (r.identity, r.ratio, r.common) for r in R.equivalent_listing(new, mine, kids, ids).collect()}
    assert got == {1000 + i: (0, 1.0, 6) for i in range(300)} and seen[0] <= 10
    few = kids.filter("identity_id = 7 OR identity_id >= 1000 OR number < 4").filter("identity_id = 7 OR identity_id >= 1000 OR identity_id = 2")
    got = {r.incoming: (r.identity, r.common) for r in R.equivalent_listing(new.filter("id = 1005"), mine, few.filter("identity_id <> 7 OR number < 2"), ids).collect()}
    assert got == {1005: (7, 2)}
