"""What follows the duplicates, over both tiers, against one plain loop over the registered transactions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import duplicates, ledger
from tallyloom.plans import queries

SMALL = "/root/testdata/sf0.001"
DOUBT = "Possible duplicate with low confidence"


def plain_loop(rows):
    """id to (duplicate_of, in doubt); later verdicts replace earlier ones."""
    rows = sorted(rows, key=lambda r: (r.txn_date, r.ord))
    matched, out = set(), {}
    for i, a in enumerate(rows):
        if a.id in matched:
            continue
        for b in rows[i + 1 :]:
            x, y = a.amount_original, b.amount_original
            if b.id in matched or a.currency != b.currency or abs((b.txn_date - a.txn_date).days) > 3:
                continue
            near = x != 0 and abs(x - y) / abs(x) <= 0.02
            same, sure = (True, "high") if x == y else duplicates.similar_merchants(a.asDict(), b.asDict()) if near else (False, "high")
            if same:
                matched.add(b.id)
                out[b.id] = (a.id, False)
            elif sure == "low":
                out[b.id] = (None, True)
    return out


@pytest.fixture(scope="module")
def expected(spark):
    tx = queries.categorized(spark, SMALL)
    found = plain_loop(tx.collect())
    out = []
    for r in ledger.suspicious(tx).collect():
        anchor, doubt = found.get(r.id, (None, False))
        out.append(r.asDict() | {"duplicate_of": anchor, "needs_review": r.needs_review or doubt, "review_reason": DOUBT if doubt else r.review_reason})
    return out


def run(spark, name):
    return queries.QUERIES[f"{name}_greedy"](spark, SMALL).collect()


def pairs(expected):
    return [r for r in expected if r["duplicate_of"]]


def test_merged_and_headline(spark, expected):
    cols = queries._MERGED_COLS.split(", ")
    assert {tuple(r[c] for c in cols) for r in run(spark, "merged_flags")} == {tuple(r[c] for c in cols) for r in expected}
    n = len(pairs(expected))
    assert n > queries.QUERIES["duplicates_exact"](spark, SMALL).count()
    flags = [sum(r[c] for r in expected) for c in ("suspicious", "needs_review")]
    assert [tuple(r) for r in run(spark, "report_headline")] == [(len(expected), 2 * n, n, *flags)]
    (report,) = run(spark, "report_text")
    assert report.report.startswith(f"Transactions: {len(expected)}\nDuplicates: {2 * n}\nSuspicious: {flags[0]}\nNeeds review: {flags[1]}\n")


def test_entries_and_review(spark, expected):
    amount = {r["id"]: r["amount_original"] for r in expected}
    assert sorted(map(tuple, run(spark, "duplicate_entries"))) == sorted((r["id"], k, amount[k]) for r in pairs(expected) for k in (r["duplicate_of"], r["id"]))
    asked = {r["id"]: r["review_reason"] for r in expected if r["needs_review"]}
    assert {r.id: r.reason for r in run(spark, "review_queue")} == asked
    status = lambda r: ("rejected" if r["ord"] % 2 else "confirmed") if r["needs_review"] else None
    assert {r.id: r.review_status for r in run(spark, "apply_decisions")} == {r["id"]: status(r) for r in expected}


VIEWS = {
    "view_transactions": lambda r: True,
    "view_duplicates": lambda r: r["duplicate_of"],
    "view_suspicious": lambda r: r["suspicious"],
    "view_needs_review": lambda r: r["needs_review"],
    "view_clean": lambda r: not (r["duplicate_of"] or r["suspicious"] or r["needs_review"]),
    "view_filtered": lambda r: r["account"] == "ACCT-7" and r["category"] == "Shopping",
}


@pytest.mark.parametrize("name", VIEWS)
def test_views(spark, expected, name):
    flags = lambda r: " ".join(x for x, c in (("D", "duplicate_of"), ("S", "suspicious"), ("R", "needs_review")) if r[c])
    assert {r.id: r.flags for r in run(spark, name)} == {r["id"]: flags(r) for r in expected if VIEWS[name](r)}


def test_doubt_reaches_review_queue(spark):
    own = "id string, txn_date date, date string, ord long, currency string, amount_original double, merchant string, account string, category string, needs_review boolean, review_reason string"
    day = dt.date(2026, 1, 1)
    rows = [(i, day, str(day), k, "USD", a, m, "acc", None, n, n and "own reason" or None) for k, (i, a, m, n) in enumerate([("a", -100.0, "shop one", False), ("b", -101.0, "shop two", False), ("c", -101.5, "shop two", True), ("d", -100.0, "x", True)])]
    tx = spark.createDataFrame(rows, own)
    got = ledger.merge_flags(tx, duplicates.greedy(tx), ledger.suspicious(tx).withColumn("suspicious_reason", F.lit(None).cast("string")))
    assert {r.id: (r.duplicate_of, r.needs_review, r.review_reason) for r in got.collect()} == {"a": (None, False, None), "b": (None, True, DOUBT), "c": ("b", True, "own reason"), "d": ("a", True, "own reason")}
    assert {r.id: r.reason for r in ledger.review_queue(got).collect()} == {"b": DOUBT, "c": "own reason", "d": "own reason"}
