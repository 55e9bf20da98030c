"""Duplicate transactions: exact and fuzzy tiers, resolved greedily in date order.

The greedy run is order-dependent: a matched row never anchors, and an anchor absorbs every later match. Pairs only exist within one
currency, three days and two percent, so rows fall into *islands* that can't affect each other: date gaps over three
days cut, then amount gaps over two percent. Each island is resolved on its own, in parallel, with the same result as one loop over all
rows. An island is as dense as its data: it is the unit that must fit in a task.

Rows that no test tells apart (one currency, date and amount, and what the judge reads) are one *class*, and the run is over classes. When
the first row of a class has its turn, either an earlier anchor took it, and with it all the others, which come later still; or it becomes
an anchor and takes them itself. So its place and its fate decide for all of them, however many copies a row has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import DAYS, TOLERANCE

_WIDER = TOLERANCE * 1.00005  # a wider cut only joins islands, which is safe


def near_amount(a: Column, b: Column) -> Column:
    """Relative to the earlier amount; never if that is zero."""
    return (a != 0) & (F.abs(a - b) / F.abs(F.nullif(a, F.lit(0.0))) <= TOLERANCE)


#: Width of an amount bucket in logarithms: two amounts within the tolerance are in one bucket or in neighbours.
_STEP = 0.021


def _close(rows: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """Pairs of rows by the tests on currency, days and amount, as columns ``own`` with _a and _b and ``exact``; a is not of a later date.

    An equi-join on currency, a bucket of days and a bucket of amounts. Buckets of amounts are as wide as the tolerance, so the rows
    that meet are in proportion to the pairs that match.
    """
    amount = F.col("amount_original")
    size = F.when(amount != 0, F.floor(F.ln(F.abs(amount)) / _STEP)).otherwise(F.lit(0)).cast("long")
    rows = rows.select(*own, "currency", F.floor(F.unix_date("txn_date") / (DAYS + 1)).alias("b"), F.signum(amount).cast("int").alias("sign"), size.alias("k"))
    near = F.when(F.col("sign") == 0, F.array("k")).otherwise(F.array(F.col("k") - 1, "k", F.col("k") + 1))
    left = rows.select(*(F.col(c).alias(f"{c}_a") for c in own), "currency", "sign", "b", F.explode(near).alias("k"))
    left = left.withColumn("b", F.explode(F.array("b", F.col("b") + 1)))
    right = rows.select(*(F.col(c).alias(f"{c}_b") for c in own), "currency", "sign", "b", "k")
    exact = F.col("amount_original_a") == F.col("amount_original_b")
    met = left.join(right, ["currency", "sign", "b", "k"]).where(F.datediff("txn_date_b", "txn_date_a").between(0, DAYS) & (exact | near_amount(F.col("amount_original_a"), F.col("amount_original_b"))))
    return met.withColumn("exact", exact)


def candidates(tx: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b, exact), a before b. All of them: of n copies of a row, n * (n - 1) / 2; :func:`candidate_classes` says the same without."""
    rows = tx.where("txn_date is not null and amount_original is not null")
    first = F.struct("txn_date_a", "ord_a") < F.struct("txn_date_b", "ord_b")
    return _close(rows, ("id", "txn_date", "ord", "amount_original")).where(first).select("id_a", "id_b", "exact")


def candidate_classes(tx: DataFrame) -> DataFrame:
    """(kind, id_a, id_b, exact): the pairs of :func:`candidates` between classes, and what belongs to a class.

    A class is the rows of one currency, date and amount; the first by ``ord`` represents it. ``member``: row b, of class a; every row with a
    date, an amount and an ``ord`` is one. ``pair``: each member of class a that comes before a member of class b is a pair with it, and
    there is such a one. A class of several rows is paired with itself.
    """
    keys = ["currency", "txn_date", "amount_original"]
    rows = tx.where("txn_date is not null and amount_original is not null and ord is not null").select(*keys, "id", "ord")
    classes = rows.groupBy(*keys).agg(F.min_by("id", "ord").alias("first"), F.min("ord").alias("low"), F.max("ord").alias("high"))
    some = (F.col("txn_date_a") < F.col("txn_date_b")) | (F.col("low_a") < F.col("high_b"))
    pairs = _close(classes, ("first", "txn_date", "low", "high", "amount_original")).where(some)
    members = _null_safe(rows.select(*keys, "id"), classes.select(*keys, "first"), keys)
    return pairs.select(F.lit("pair").alias("kind"), F.col("first_a").alias("id_a"), F.col("first_b").alias("id_b"), "exact").unionByName(
        members.select(F.lit("member").alias("kind"), F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit(None).cast("boolean").alias("exact"))
    )


def exact_tier(tx: DataFrame) -> DataFrame:
    """(id, duplicate_of) by equal amounts alone: in each currency and amount, rows within three days of the anchor belong to it.

    The fold runs over a group's distinct dates, which are few however many rows it has; rows then join their date's anchor.
    """
    start = F.expr("cast(struct(null as d, null as anchor, array() as out) as struct<d:date,anchor:string,out:array<struct<d:date,anchor:string>>>)")

    def step(acc, x):
        near = F.coalesce(F.datediff(x["d"], acc["d"]) <= DAYS, F.lit(False))
        anchor = F.when(near, acc["anchor"]).otherwise(x["id"])
        out = F.concat(acc["out"], F.array(F.struct(x["d"].alias("d"), anchor.alias("anchor"))))
        return F.struct(F.when(near, acc["d"]).otherwise(x["d"]).alias("d"), anchor.alias("anchor"), out.alias("out"))

    rows = tx.where("txn_date is not null and amount_original is not null").select("id", "txn_date", "ord", "currency", "amount_original")
    days = rows.groupBy("currency", "amount_original", F.col("txn_date").alias("d")).agg(F.min_by("id", "ord").alias("id"))
    groups = days.groupBy("currency", "amount_original").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("days"))
    anchors = groups.select(F.col("currency").alias("c"), F.col("amount_original").alias("a"), F.inline(F.aggregate("days", start, step, lambda acc: acc["out"])))
    met = rows.join(anchors, F.col("currency").eqNullSafe(F.col("c")) & (F.col("amount_original") == F.col("a")) & (F.col("txn_date") == F.col("d")))
    return met.where("id <> anchor").select("id", F.col("anchor").alias("duplicate_of"))


def islands(tx: DataFrame) -> DataFrame:
    """``date_island`` and ``amount_island``: rows in different islands are never a pair. Null currencies are one currency; rows without date or amount are in none."""
    return _islands(tx.where("txn_date is not null and amount_original is not null"))


def _islands(rows: DataFrame) -> DataFrame:
    day = Window.partitionBy("currency").orderBy("txn_date")
    days = rows.select("currency", "txn_date").distinct()  # as many rows as days
    cut = (F.datediff("txn_date", F.lag("txn_date").over(day)) > DAYS).cast("int")
    days = days.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("date_island", F.sum("cut").over(day)).drop("cut")
    own = _null_safe(rows, F.broadcast(days), ["currency", "txn_date"])
    value = Window.partitionBy("currency", "date_island").orderBy("amount_original")
    values = own.select("currency", "date_island", "amount_original").distinct()
    last = F.lag("amount_original").over(value)
    gap = F.abs(F.col("amount_original") - last) > _WIDER * F.greatest(F.abs("amount_original"), F.abs(last))
    values = values.withColumn("cut", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("amount_island", F.sum("cut").over(value)).drop("cut")
    return _null_safe(own, values, ["currency", "date_island", "amount_original"])


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", *also: Column) -> DataFrame:
    """Join on keys of which nulls are equal; what else must hold is compared first."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [*also, *(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)]
    return left.join(named, same, how).drop(*(f"_{k}" for k in keys))


Judge = Callable[[dict, dict], tuple[bool, str]]


def similar_merchants(a: dict, b: dict) -> tuple[bool, str]:
    """(duplicate, confidence) by the merchants' edit distance: 0.8 and more is a duplicate, 0.5 and more is doubt."""
    x, y = a["merchant"] or "", b["merchant"] or ""
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, last = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    like = 1 - row[-1] / max(len(x), len(y), 1)
    return like >= 0.8, "high" if like >= 0.8 or like < 0.5 else "low"


def resolve(rows: list[dict], judge: Judge) -> dict[str, tuple[str | None, bool, str | None]]:
    """id to (duplicate_of, needs_review, review_reason), for rows in date order."""
    taken: set[str] = set()
    out: dict[str, tuple[str | None, bool, str | None]] = {}
    for i, a in enumerate(rows):
        if a["id"] in taken:
            continue
        for b in rows[i + 1 :]:
            if b["currency"] != a["currency"]:
                continue
            if (b["txn_date"] - a["txn_date"]).days > DAYS:
                break  # rows are in date order
            if b["id"] in taken:
                continue
            if a["amount_original"] == b["amount_original"]:
                taken.add(b["id"])
                out[b["id"]] = (a["id"], False, None)
            elif a["amount_original"] and abs(a["amount_original"] - b["amount_original"]) / abs(a["amount_original"]) <= TOLERANCE:
                try:
                    same, confidence = judge(a, b)
                    reason = "Possible duplicate with low confidence"
                except Exception:
                    same, confidence, reason = False, "low", "Duplicate check failed"
                if same:
                    taken.add(b["id"])
                    out[b["id"]] = (a["id"], False, None)
                elif confidence == "low":
                    out[b["id"]] = (None, True, reason)
    return out


#: Reasons of doubt by their number in :func:`sweep`; zero is none.
_REASONS = (None, "Possible duplicate with low confidence", "Duplicate check failed")
_SEEN = ("id", "txn_date", "ord", "currency", "amount_original", "merchant")


def sweep(island: pa.Table, judge: Judge, reads: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`resolve` for the classes of one island: of each its anchor's row or -1, and the number of its reason of doubt.

    Each date's amounts are in order, so an anchor finds its candidates by bisection; the judge is asked once for two values of ``reads``.
    """
    n = island.num_rows
    day = island["txn_date"].cast(pa.int32()).to_numpy()
    amount = island["amount_original"].cast(pa.float64()).to_numpy()
    turn = np.lexsort((island["ord"].cast(pa.int64()).to_numpy(), day))
    kind = np.zeros(n, dtype=np.int64)
    for c in reads:
        values = island[c].combine_chunks().dictionary_encode("encode")
        kind = np.unique(kind * (len(values.dictionary) + 1) + values.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, example = np.unique(kind, return_index=True)

    @lru_cache(maxsize=2**18)
    def verdict(a: int, b: int) -> tuple[bool, int]:
        try:
            same, confidence = judge(*(island.slice(int(example[k]), 1).to_pylist()[0] for k in (a, b)))
        except Exception:
            return False, 2
        return bool(same), int(not same and confidence == "low")

    place = np.lexsort((amount, day))  # rows by date, then amount
    days, begins = np.unique(day[place], return_index=True)
    ends = np.append(begins[1:], n)
    sizes, kinds = amount[place], kind[place]
    at = np.empty(n, dtype=np.int64)
    at[place] = np.arange(n)
    first_day, last_day = np.searchsorted(days, day), np.searchsorted(days, day + DAYS, "right")
    open_, anchor, doubt = np.ones(n, dtype=bool), np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int8)
    for i in turn:
        if not open_[at[i]]:
            continue
        open_[at[i]] = False
        a = amount[i]
        reach = abs(a) * _WIDER if np.isfinite(a) else 0.0
        parts = []
        for d in range(first_day[i], last_day[i]):
            own = sizes[begins[d] : ends[d]]
            low, high = begins[d] + own.searchsorted(a - reach), begins[d] + own.searchsorted(a + reach, "right")
            if low < high:
                parts.append(low + np.flatnonzero(open_[low:high]))
        met = np.concatenate(parts) if parts else place[:0]
        if not met.size:
            continue
        values = sizes[met]
        equal = values == a
        taken = [met[equal]]
        if a and np.isfinite(a):
            near = met[~equal & (np.abs(a - values) / abs(a) <= TOLERANCE)]
            theirs = kinds[near]
            for k in np.unique(theirs):
                same, reason = verdict(int(kind[i]), int(k))
                if same:
                    taken.append(near[theirs == k])
                elif reason:
                    doubt[near[theirs == k]] = reason
        for found in taken:
            open_[found], anchor[found], doubt[found] = False, i, 0
    return anchor[at], doubt[at]


def greedy(tx: DataFrame, judge: Judge = similar_merchants, reads: Sequence[str] | None = None) -> DataFrame:
    """(id, duplicate_of, needs_review, review_reason) of rows that are duplicates or in doubt. Ids are unique. ``reads``: see :func:`mark`."""
    out = mark(tx, judge, reads).where("duplicate_of is not null or in_doubt")
    return out.select("id", "duplicate_of", F.col("in_doubt").alias("needs_review"), F.col("doubt_reason").alias("review_reason"))


def mark(tx: DataFrame, judge: Judge = similar_merchants, reads: Sequence[str] | None = None, plain: DataFrame | None = None, id_of: str | None = None) -> DataFrame:
    """All rows, with ``duplicate_of``, that anchor's amount as ``duplicate_amount``, ``in_doubt`` and ``doubt_reason``. Ids are unique.

    A row finds its class by its own columns, so nothing is joined by id. Rows are dealt and sorted by a hash of these columns alone, then compared.
    ``plain``: the rows of ``tx`` as they were before other steps added columns; classes are read from it, so that these steps run once.

    ``reads``: the columns that the judge's answer depends on; two rows that agree in them get one answer. By default the merchant for
    the default judge; any other may depend on all that it is given, so every row is a class of its own unless the caller says more.

    ``id_of``: the id as an SQL expression of ``ord`` alone, where it is one and ``ord`` a whole number; then classes are found without a sort of all rows.
    """
    keys, found = _found(tx if plain is None else plain, judge, reads, id_of)
    tx = tx.withColumn("_class", F.xxhash64(*keys))
    named = found.withColumnsRenamed({"_class": "_found", **{k: f"_{k}" for k in keys}})
    # The alternative never holds where the hashes are equal. It keeps Spark from sorting by the columns too, which rows of a class agree in.
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)) | F.col("_found").isNull()
    met = tx.join(named, (F.col("_class") == F.col("_found")) & same, "left")
    lone = F.col("id") == F.col("first")
    reason = F.when(lone, F.col("reason"))
    return met.select(
        *(c for c in tx.columns if c != "_class"), F.coalesce("anchor", F.when(~lone, F.col("first"))).alias("duplicate_of"),
        F.coalesce("anchor_amount", F.when(~lone, F.col("first_amount"))).alias("duplicate_amount"), reason.isNotNull().alias("in_doubt"), reason.alias("doubt_reason"),
    )


def mark_apart(tx: DataFrame, plain: DataFrame, judge: Judge = similar_merchants, reads: Sequence[str] | None = None, id_of: str | None = None) -> DataFrame:
    """``tx``, some rows of ``plain`` or of its classes' first ones, with ``duplicate``, ``in_doubt`` and ``doubt_reason``: :func:`mark` for those who don't ask of what a row is a duplicate.

    A row with a date and an amount is a duplicate unless it is the first of a class that no anchor took, and only such a row can be in doubt. These
    are few where rows are alike, and each is known by its ``ord``, which must be unique; they are met by the hash of their class.
    """
    keys, found = _found(plain, judge, reads, id_of)
    apart = found.where("anchor is null").select(F.col("_class").alias("_found"), "first_ord", "reason").hint("shuffle_hash")  # no sort of all rows for them
    one = F.col("ord").eqNullSafe(F.col("first_ord")) | F.col("_found").isNull()  # the alternative never holds, as in mark
    met = tx.withColumn("_class", F.xxhash64(*keys)).join(apart, (F.col("_class") == F.col("_found")) & one, "left")
    known = F.expr("txn_date is not null and amount_original is not null and not isnan(amount_original)")
    return met.select(*tx.columns, (known & F.col("_found").isNull()).alias("duplicate"), F.col("reason").isNotNull().alias("in_doubt"), F.col("reason").alias("doubt_reason"))


def _keys(judge: Judge, reads: Sequence[str] | None) -> tuple[tuple[str, ...], list[str]]:
    """``reads`` as :func:`mark` takes it, and the columns that make a class."""
    reads = tuple(reads) if reads is not None else ("merchant",) if judge is similar_merchants else _SEEN
    return reads, list(dict.fromkeys(("currency", "txn_date", "amount_original", *reads)))


def classes(tx: DataFrame, judge: Judge = similar_merchants, reads: Sequence[str] | None = None, id_of: str | None = None, asked: bool = False) -> DataFrame:
    """Each class with its first row's ``ord``, ``id`` and ``first_amount``, its rows ``n`` and how many of them have a date and an amount, ``known``: all or none.

    Spark computes them once for all uses, if no use filters by the columns that make a class alone.
    """
    _, keys = _keys(judge, reads)
    if "id" in keys or "ord" in keys:
        id_of = None  # a row is a class of its own
    is_known = F.expr("txn_date is not null and amount_original is not null and not isnan(amount_original)")  # NaN equals nothing
    counts = {"n": F.count(F.lit(1)), "known": F.count(F.when(is_known, 1))}
    rows = tx.withColumn("_class", F.xxhash64(*keys))
    # A filter on classes always holds. Because of it each use of them needs all of their columns, so Spark computes them once for all uses.
    if id_of is None:
        first = F.struct(F.col("ord").isNull().alias("late"), "ord", "id", F.col("amount_original").alias("amount"), *["needs_review"] * asked)
        found = rows.groupBy("_class", *keys).agg(F.min(first).alias("_first"), *(c.alias(k) for k, c in counts.items())).where("_first is not null and n >= known and n > 0")
        fields = {c: F.col("_first")[c] for c in ("ord", "id") if c not in keys} | {"first_amount": F.col("_first.amount"), "needs_review": F.col("_first")["needs_review"]}
    else:  # numbers alone are aggregated by hash, without a sort
        ord_, negative = F.col("ord").cast("long"), (F.col("amount_original") == 0) & (F.col("amount_original").cast("string") == "-0.0")
        marks = {"ord": ord_, "zero": F.when(negative, ord_)} | ({"asked": F.when(F.col("needs_review"), ord_)} if asked else {})
        found = rows.groupBy("_class", *keys).agg(*(F.min(c).alias(f"_{k}") for k, c in marks.items()), *(c.alias(k) for k, c in counts.items()))
        found = found.where(F.greatest("n", "known", *(f"_{k}" for k in marks)) >= F.col("n")).withColumnsRenamed({"_ord": "ord"})
        amount = F.when(F.col("ord") == F.col("_zero"), F.lit(-0.0)).otherwise(F.col("amount_original"))
        fields = {"ord": F.col("ord"), "id": F.expr(id_of), "first_amount": amount, "needs_review": F.coalesce(F.col("ord") == F.col("_asked"), F.lit(False)) if asked else F.lit(False)}
        fields = {k: c for k, c in fields.items() if k not in keys}
    if not asked:
        del fields["needs_review"]
    return found.select("_class", *keys, "n", "known", *(c.alias(k) for k, c in fields.items()))


def _found(tx: DataFrame, judge: Judge, reads: Sequence[str] | None, id_of: str | None, asked: bool = False) -> tuple[list[str], DataFrame]:
    """The columns that make a class, and each class with its number of rows, its first row and what became of it. ``asked``: with that row's ``needs_review``."""
    reads, keys = _keys(judge, reads)
    own = ["_class", *dict.fromkeys((*keys, "id", "ord")), "first_amount", "n", *["needs_review"] * asked]
    known = classes(tx, judge, reads, id_of, asked).where("known > 0")

    def run(island: pa.Table) -> pa.Table:
        anchor, doubt = sweep(island, judge, reads)
        ids = island["id"].combine_chunks()
        at = pa.array(anchor, mask=anchor < 0)
        out = {c: island[c] for c in ("_class", *keys, "n", *["needs_review"] * asked)} | {
            "first": ids, "first_ord": island["ord"], "anchor": ids.take(at), "first_amount": island["first_amount"], "anchor_amount": island["first_amount"].combine_chunks().take(at),
            "reason": pa.array([_REASONS[k] for k in doubt], pa.string()),
        }
        return pa.table(out)

    types = {f.name: f.dataType.simpleString() for f in known.schema}
    amount = types["amount_original"]
    kept = ", ".join(f"`{c}` {types[c]}" for c in ("_class", *keys, "n", *["needs_review"] * asked))
    schema = f"{kept}, first string, first_ord {types['ord']}, anchor string, first_amount {amount}, anchor_amount {amount}, reason string"
    return keys, _islands(known).select(*own, "date_island", "amount_island").groupBy("currency", "date_island", "amount_island").applyInArrow(run, schema)


def totals(tx: DataFrame, judge: Judge = similar_merchants, reads: Sequence[str] | None = None, id_of: str | None = None) -> DataFrame:
    """One row: ``duplicate_pairs``, and ``asked``, the rows in doubt that ``needs_review`` doesn't mark already. As :func:`mark` says, from the classes alone: no row is moved."""
    _, found = _found(tx, judge, reads, id_of, asked=True)
    pairs = F.col("n") - F.when(F.col("anchor").isNull(), 1).otherwise(0)
    new = F.col("reason").isNotNull() & ~F.coalesce("needs_review", F.lit(False))
    return found.agg(F.coalesce(F.sum(pairs), F.lit(0)).cast("long").alias("duplicate_pairs"), F.count_if(new).alias("asked"))


def entries(tx: DataFrame, matched: DataFrame) -> DataFrame:
    """Two entries for each match: the anchor and its member."""
    pairs = matched.where("duplicate_of is not null").select(F.col("id").alias("member"), F.explode(F.array("duplicate_of", "id")).alias("id"))
    return pairs.join(tx, "id")


def marked_entries(marked: DataFrame) -> DataFrame:
    """(member, id, amount_original) of :func:`entries`, from what :func:`mark` leaves: an anchor's amount is on its members' rows, so nothing is joined."""
    both = F.array(F.struct(F.col("duplicate_of").alias("id"), F.col("duplicate_amount").alias("amount_original")), F.struct("id", "amount_original"))
    return marked.where("duplicate_of is not null").select(F.col("id").alias("member"), F.inline(both))
