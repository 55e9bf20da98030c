"""How much the greedy queries do, and what the shorter way must not change."""

import contextlib
import datetime as dt
import io
import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import duplicates, ledger
from tallyloom.plans import queries

SMALL = "/root/testdata/sf0.001"
#: Scans of events in the plan: one of the rows, four of classes and islands, two of suspicion's typical amounts and usual currencies; rates and decided rows are more.
SCANS = {
    "apply_decisions": 6, "duplicate_entries": 5, "merged_flags": 7, "report_headline": 7, "report_text": 9, "review_queue": 7, "view_clean": 7, "view_needs_review": 7, "view_suspicious": 7,
}


@pytest.mark.parametrize("name", SCANS)
def test_rows_are_moved_by_account_and_class_alone(spark, name):
    """Before, 6 to 25 scans; 6 to 12 shuffles by id in all but duplicate_entries; two greedy runs in apply_decisions and report_text."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        queries.QUERIES[f"{name}_greedy"](spark, SMALL).explain()
    plan = out.getvalue()
    assert plan.count("FileScan parquet") <= SCANS[name] and plan.count("FlatMapGroupsInArrow") == 1
    assert len(re.findall(r"hashpartitioning\(id#", plan)) == (2 if name == "apply_decisions" else 0)  # the rows and their decisions


NAN = float("nan")
TX = "id string, txn_date date, ord long, currency string, amount_original double, merchant string, account string, category string"


def rows(seed, n=160):
    rng = random.Random(seed)
    day = lambda: rng.choice([None, *(dt.date(2026, 1, 1 + k) for k in range(8))])
    amounts = [0.0, -0.0, NAN, None, -10.0, -10.1, -30.0, -400.0, 25.0, 25.4]
    return [
        (f"t{k}", day(), o, rng.choice(["USD", "UYU", None]), rng.choice(amounts), rng.choice(["shop one", "shop two", None]), rng.choice(["a", "b", None]), rng.choice(["Shopping", "Salary", None]))
        for k, o in enumerate(rng.sample(range(10 * n), n))
    ]


@pytest.mark.parametrize("seed", range(3))
def test_mark_keeps_all_rows_and_the_anchors_amount(spark, seed):
    tx = spark.createDataFrame(rows(seed), TX)
    marked = duplicates.mark(ledger.suspicious(tx), plain=tx)
    amount = {r.id: repr(r.amount_original) for r in tx.collect()}
    found = {r.id: r for r in duplicates.greedy(tx).collect()}
    got = marked.collect()
    assert sorted(r.id for r in got) == sorted(amount)
    for r in got:
        want = found.get(r.id)
        assert (r.duplicate_of, r.in_doubt, r.doubt_reason) == ((want.duplicate_of, want.needs_review, want.review_reason) if want else (None, False, None))
        assert repr(r.duplicate_amount) == (amount[r.duplicate_of] if r.duplicate_of else "None")  # with its sign: 0.0 and -0.0 are one class
    entries = sorted((r.member, r.id, repr(r.amount_original)) for r in duplicates.marked_entries(marked).collect())
    assert entries == sorted((r.member, r.id, repr(r.amount_original)) for r in duplicates.entries(tx, duplicates.greedy(tx)).select("member", "id", "amount_original").collect())


@pytest.mark.parametrize("seed", range(3))
def test_suspicious_is_a_plain_loop(spark, seed):
    """Without NaN, which has no median. Rows without date, account, merchant or amount take part."""
    own = [r for r in rows(seed) if r[4] is None or r[4] == r[4]]
    tx = spark.createDataFrame(own, TX)
    all_ = [r.asDict() for r in tx.collect()]
    early = lambda r: (r["txn_date"] or dt.date.min, r["ord"])

    def reason(r):
        a = r["amount_original"]
        if a is None or a >= 0 or r["category"] in ledger.ROUTINE:
            return None
        like = [abs(x["amount_original"]) for x in all_ if (x["category"], x["currency"]) == (r["category"], r["currency"]) and x["amount_original"] is not None]
        if abs(a) > 10 * median(like):
            return "Amount far out of line for its category"
        mine = sorted((x for x in all_ if (x["account"], x["merchant"]) == (r["account"], r["merchant"])), key=early)
        if sum(x["txn_date"] == r["txn_date"] for x in mine) > 1:
            return "Several charges by one merchant on one day"
        at = [x["id"] for x in mine].index(r["id"])
        last = mine[at - 1]["amount_original"] if at else None
        if last and abs(a - last) > 0.5 * abs(last):
            return "Recurring payment changed significantly"
        if r["account"] is None or r["currency"] is None:
            return None
        counts = {}
        for x in all_:
            if x["account"] == r["account"]:
                counts[x["currency"]] = counts.get(x["currency"], 0) + 1
        usual = min(counts, key=lambda c: (-counts[c], c is not None, c or ""))
        return "Unexpected currency for the account" if usual is not None and r["currency"] != usual else None

    assert {r.id: r.suspicious_reason for r in ledger.suspicious(tx).collect()} == {r["id"]: reason(r) for r in all_}


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_headline_scans_once_for_classes_and_moves_rows_by_account_alone(spark):
    """Before, classes were computed anew for days, for amounts and for themselves, and all rows were moved to their classes to be counted."""
    plan = final_plan(queries.QUERIES["report_headline_greedy"](spark, SMALL))
    assert plan.count("FileScan parquet") == 4 and "_found" not in plan  # rows, classes, typical amounts, usual currencies


MOVED = ["merged_flags", "review_queue", "view_clean", "view_needs_review", "view_suspicious"]


@pytest.mark.parametrize("name", MOVED)
def test_rows_meet_classes_by_their_hash(spark, name):
    """Before, they were dealt and sorted by all columns of a class, null or not."""
    plan = final_plan(queries.QUERIES[f"{name}_greedy"](spark, SMALL))
    assert plan.count("FileScan parquet") <= 4
    assert re.search(r"Join \[_class#\d+L\], \[_found#\d+L\], LeftOuter", plan)


@pytest.mark.parametrize("seed", range(3))
def test_classes_by_numbers_alone_are_the_same(spark, seed):
    """``id_of`` changes nothing where ids are numbers: neither anchors, nor the sign of an anchor's zero, nor the totals."""
    own = [(str(r[2]), *r[1:], r[2] % 3 == 0) for r in rows(seed)]
    tx = spark.createDataFrame(own, TX + ", needs_review boolean")
    told = lambda df: sorted(tuple(repr(x) for x in r) for r in df.collect())
    plain = duplicates.mark(tx)
    assert told(plain) == told(duplicates.mark(tx, id_of="cast(ord as string)"))
    marked = plain.collect()
    want = (sum(r.duplicate_of is not None for r in marked), sum(r.in_doubt and not r.needs_review for r in marked))
    assert want[0]
    for id_of in (None, "cast(ord as string)"):
        assert [tuple(r) for r in duplicates.totals(tx, id_of=id_of).collect()] == [want]


def test_totals_without_rows_are_zero(spark):
    tx = spark.createDataFrame([], TX + ", needs_review boolean")
    assert [tuple(r) for r in duplicates.totals(tx, id_of="cast(ord as string)").collect()] == [(0, 0)]


def test_own_judge_reads_ids(spark):
    """By default it may read ids, so a row is a class of its own, whatever ``id_of`` says."""
    tx = spark.createDataFrame([(str(r[2]), *r[1:]) for r in rows(0, 40)], TX)
    judge = lambda a, b: (int(a["id"]) % 2 == int(b["id"]) % 2, "low")
    told = lambda df: sorted(tuple(repr(x) for x in r) for r in df.collect())
    assert told(duplicates.mark(tx, judge)) == told(duplicates.mark(tx, judge, id_of="cast(ord as string)"))


@pytest.mark.parametrize("id_of", [None, "cast(ord as string)"])
@pytest.mark.parametrize("seed", range(3))
def test_mark_apart_is_mark(spark, seed, id_of):
    """Also for a part of the rows, and where a row stands for its class."""
    tx = spark.createDataFrame([(str(r[2]), *r[1:]) for r in rows(seed)], TX)
    want = {r.id: (r.duplicate_of is not None, r.in_doubt, r.doubt_reason) for r in duplicates.mark(tx).collect()}
    assert any(w[1] for w in want.values())
    for part in (tx, tx.where("ord % 3 = 0"), duplicates.classes(tx, id_of=id_of).where("ord is not null")):
        got = {r.id: (r.duplicate, r.in_doubt, r.doubt_reason) for r in duplicates.mark_apart(part, tx, id_of=id_of).collect()}
        assert got == {i: want[i] for i in got} and got


def test_review_queue_asks_no_suspicion(spark):
    """Before, all rows were moved by account and sorted for reasons that no row in review shows, and then moved by class."""
    plan = final_plan(queries.QUERIES["review_queue_greedy"](spark, SMALL))
    assert "turn#" not in plan and plan.count("FileScan parquet") == 2  # rows, classes


ODD = [
    (1, "2026-01-01", 2, "shop onex", 100.0), (2, "2026-01-02", 4, "shop two", 101.0), (3, "2026-01-02", 4, "shop two", 101.0), (4, "2026-01-03", 6, "view", 7.0), (5, "2026-01-04", 8, "vie", 7.1),
    (6, None, 2, "view", 3.0), (7, "2026-01-05", 2, None, 0.0), (8, "2026-01-05", 2, "purchase", -0.0), (9, "2026-01-05", 3, "purchase", None), (10, "2026-01-06", 3, "signup", NAN),
    (11, "2026-01-06", 3, "purchases", 50.0), (12, "2026-01-06", 5, "purchase", 50.5), (13, "2026-01-06", None, "click", 50.4), (14, "2026-01-06", 5, "cli", 50.9), (15, "2026-01-07", 5, "signup", 200.0),
    (16, "2026-01-07", 7, "click", 1000.0), (17, "2026-01-07", 7, "clip", 1001.0), (18, "2026-01-09", 7, "clack", 1002.0), (19, "2026-01-09", 8, "purchase", 2000.0), (20, "2026-01-10", 9, "purchas", 2001.0),
    (21, "2026-01-20", 2, "clip", 500.0), (22, "2026-01-21", 4, "click", 501.0), (23, "2026-01-21", 6, "click", 501.0), (24, "2026-01-10", 4, "click", 100.0), (25, "2026-01-20", 4, "signup", 1.0),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Events with doubts about rows that ask for review and about rows that don't, and with nulls."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, d and dt.datetime.fromisoformat(d), u, m, a, None) for i, d, u, m, a in ODD]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def view(flag):
    return lambda merged: ledger.display(ledger.choose(merged, flag=flag))


OLD = {"review_queue": ledger.review_queue, "view_clean": view("Clean"), "view_needs_review": view("Needs Review"), "view_suspicious": view("Suspicious")}


@pytest.mark.parametrize("name", OLD)
def test_shorter_ways_tell_what_merged_greedy_tells(spark, odd, name):
    merged = queries.merged_greedy(spark, odd)
    doubts = [r for r in merged.collect() if r.review_reason == "Possible duplicate with low confidence"]
    assert {queries.RULES.get(r.merchant, "null") == "null" for r in doubts} == {True, False}
    told = lambda df: sorted(tuple(repr(x) for x in r) for r in df.collect())
    got = queries.QUERIES[f"{name}_greedy"](spark, odd)
    want = OLD[name](merged)
    assert got.schema.names == want.schema.names and got.dtypes == want.dtypes
    assert told(got) == told(want)


@pytest.mark.parametrize("name", ["view_clean", "view_needs_review", "view_suspicious"])
def test_views_move_numbers(spark, name):
    """Before, names of accounts were moved and compared, typical amounts read all rows again, and rows were sorted for their classes."""
    plan = final_plan(queries.QUERIES[f"{name}_greedy"](spark, SMALL))
    assert plan.count("FileScan parquet") <= 3  # rows, classes, usual currencies
    assert "SortMergeJoin [_class" not in plan and plan.count("ACCT-") == 1


@pytest.mark.parametrize("seed", range(2))
def test_suspicious_among_some(spark, seed):
    """Of wanted rows it says the same, whether amounts are counted before and columns computed again or not. A category is told by the merchant."""
    tx = spark.createDataFrame([r for r in rows(seed) if r[4] is None or r[4] == r[4]], TX)
    category = F.when(F.col("merchant") == "shop one", "Shopping").when(F.col("merchant") == "shop two", "Salary")
    tx = tx.withColumn("category", category)
    told = lambda df: sorted(tuple(repr(x) for x in r) for r in df.collect())
    counted = tx.groupBy("category", "currency", "amount_original", "txn_date").agg(F.count(F.lit(1)).alias("n"))
    among = ~F.coalesce(F.col("category").isin(*ledger.ROUTINE), F.lit(False))
    want = told(ledger.suspicious(tx).where(among))
    assert any("None" not in r[-1] for r in want)
    assert told(ledger.suspicious(tx, among)) == want
    assert told(ledger.suspicious(tx, among, counted, {"category": category})) == want
