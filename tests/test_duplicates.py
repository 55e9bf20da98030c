"""Duplicates where rows have many copies."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import duplicates, ledger
from tallyloom.plans import queries

TX = "id string, txn_date date, ord long, currency string, amount_original double, merchant string"
NAN, INF = float("nan"), float("inf")


def copied(spark, rng, n=240):
    """Few values, so that most rows have copies, in one window of dates and more; amounts chain within two percent."""
    amounts = [0.0, -0.0, NAN, INF, -INF, *(round(-100.0 * 1.009**k, 2) for k in range(8)), *(round(40.0 * 1.019**k, 2) for k in range(4))]
    names = ["shop one", "shop two", "shop onf", "xx", None, ""]
    rows = [(f"t{k}", dt.date(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 9)), o, rng.choice(["USD", None]), rng.choice(amounts), rng.choice(names)) for k, o in enumerate(rng.sample(range(10 * n), n))]
    return spark.createDataFrame(rows, TX)


def in_order(tx):
    return sorted((r.asDict() for r in tx.collect()), key=lambda r: (r["txn_date"], r["ord"]))


@pytest.mark.parametrize("seed", range(4))
def test_classes_of_copies_equal_one_loop(spark, seed):
    def moody(a, b):
        """Reads amounts and merchants, fails for some, is in doubt for others."""
        if a["merchant"] == b["merchant"] == "xx":
            raise RuntimeError
        k = round(a["amount_original"] * 7 + b["amount_original"] * 3) % 4
        return k == 0, "low" if k == 1 else "high"

    tx = copied(spark, random.Random(seed))
    plain = in_order(tx)
    for judge, reads in ((duplicates.similar_merchants, None), (moody, None), (moody, ("merchant", "amount_original"))):
        got = {r.id: (r.duplicate_of, r.needs_review, r.review_reason) for r in duplicates.greedy(tx, judge, reads).collect()}
        assert got == duplicates.resolve(plain, judge)


def test_judge_is_asked_once_for_two_kinds(spark, tmp_path):
    """300 amounts in a chain, 100 copies each, three kinds of merchants: a loop over pairs asks a hundred thousand times."""
    log = str(tmp_path / "asked")

    def judge(a, b):
        with open(log, "a") as f:
            f.write(f"{a['merchant']} {b['merchant']}\n")
        return a["merchant"] == b["merchant"], "high"

    k = F.col("id")
    tx = spark.range(90_000).select(
        k.cast("string").alias("id"), F.lit(dt.date(2026, 1, 1)).alias("txn_date"), k.alias("ord"), F.lit("USD").alias("currency"),
        F.round(F.pow(F.lit(1.015), k % 300), 4).alias("amount_original"), F.element_at(F.array(*map(F.lit, "abc")), (k % 3 + 1).cast("int")).alias("merchant"),
    )
    found = duplicates.greedy(tx, judge, ("merchant",))
    assert found.where("duplicate_of is not null").count() + found.select("duplicate_of").distinct().count() == 90_000
    with open(log) as f:
        assert len(f.read().split("\n")) <= 2 * 9 + 1  # two runs


#: All pairs, as the SQL of duplicate_candidates said before it read classes.
PAIRS_SQL = f"""SELECT a.id AS id_a, b.id AS id_b, a.amount_original = b.amount_original AS exact FROM tx a JOIN tx b ON a.currency = b.currency
    AND (a.txn_date, a.ord) < (b.txn_date, b.ord) AND b.txn_date - a.txn_date <= {ledger.DAYS}
    AND (a.amount_original = b.amount_original OR (a.amount_original <> 0 AND abs(a.amount_original - b.amount_original) / abs(a.amount_original) <= {ledger.TOLERANCE}))"""


@pytest.mark.parametrize("copies", [1, 3])
def test_candidate_classes_are_all_pairs(spark, tmp_path, copies):
    """The query's pairs, expanded by its members, are the pairs of the SQL over all rows; copies don't add pairs between classes."""
    import duckdb

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    more = events.crossJoin(spark.range(copies).withColumnRenamed("id", "k")).withColumn("event_id", F.expr("event_id + 1000 * k")).drop("k")
    more.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(queries.ALL_SQL + PAIRS_SQL).fetchall())
    found = queries.QUERIES["duplicate_candidates"](spark, str(tmp_path)).collect()
    place = {r.id: (r.txn_date, r.ord) for r in queries.transactions(spark, str(tmp_path)).collect()}
    members = {}
    for r in found:
        if r.kind == "member":
            members.setdefault(r.id_a, []).append(r.id_b)
    assert sorted(i for own in members.values() for i in own) == sorted(place)
    pairs = [r for r in found if r.kind == "pair"]
    assert sorted((a, b, r.exact) for r in pairs for a in members[r.id_a] for b in members[r.id_b] if place[a] < place[b]) == want
    assert sorted(map(tuple, duplicates.candidates(queries.transactions(spark, str(tmp_path))).collect())) == want
    assert copies == 1 or len(pairs) < len(want) / 4
