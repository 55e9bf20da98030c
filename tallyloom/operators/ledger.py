"""Reconciliation steps: each takes and returns DataFrames and runs nothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The category list, in order.
CATEGORIES = (
    "Groceries", "Dining", "Transport", "Utilities", "Healthcare", "Entertainment", "Shopping", "Travel",
    "Education", "Transfer", "Fees & Charges", "Salary", "Freelance", "Other Income", "Other", "Rent",
)
NOT_CONFIDENT = "Could not confidently categorize transaction"
BATCH_FAILED = "Categorization batch failed"
BATCH = 50
DAYS, TOLERANCE = 3, 0.02
#: Categories that are never suspicious.
ROUTINE = ("Salary", "Freelance", "Other Income", "Transfer", "Utilities", "Rent")


# Caches: documents by content, rates by key.

def with_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content_hash", F.sha2("content", 256))


def cache_hits(docs: DataFrame, cache: DataFrame) -> DataFrame:
    return docs.join(cache, ["source_file", "content_hash"])


def cache_misses(docs: DataFrame, cache: DataFrame) -> DataFrame:
    return docs.join(cache, ["source_file", "content_hash"], "left_anti")


def last_of(df: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """One row for each key: the last by ``order`` if there is such a column, else the greatest."""
    rest = [c for c in df.columns if c not in keys]
    if len(rest) == 1 and rest[0] != order:
        return df.groupBy(*keys).agg(F.max(rest[0]).alias(rest[0]))  # without a struct Spark needs no sort
    whole = F.struct(*rest)
    one = F.max_by(whole, order) if order in df.columns else F.max(whole)
    return df.groupBy(*keys).agg(one.alias("_one")).select(*keys, *(F.col("_one")[c].alias(c) for c in rest)) if rest else df.distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The last of ``new`` replaces rows of ``old`` with equal keys. Write the result to a new place, never over ``old``."""
    return old.join(new, keys, "left_anti").unionByName(last_of(new, keys))


def cache_entries(tx: DataFrame, hashes: DataFrame, fields: list[str]) -> DataFrame:
    """(source_file, content_hash, transactions_json): each document's rows in order of ``pos``, as JSON. A document without rows has an empty list.

    ``hashes``: (source_file, content_hash) of the documents read; a document's rows are one statement's.
    """
    rows = tx.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("rows"))
    return hashes.join(rows, "source_file", "left").select("source_file", "content_hash", F.coalesce(F.to_json("rows"), F.lit("[]")).alias("transactions_json"))


def cached_rows(cache: DataFrame, schema: str) -> DataFrame:
    """(source_file, content_hash, ...): the rows of cache entries; ``schema`` is the fields' DDL without ``pos``. Malformed entries have none."""
    rows = F.from_json("transactions_json", f"array<struct<pos:int,{schema}>>")
    return cache.select("source_file", "content_hash", F.inline(F.coalesce(rows, F.array())))


def normalize(docs: DataFrame, cache: DataFrame, extract, schema: str, fields: list[str]) -> DataFrame:
    """Rows of all documents: cached ones from the cache, the others by ``extract``, which sees no others."""
    known = docs.select("source_file", "content_hash")
    old = cached_rows(cache.join(known, ["source_file", "content_hash"], "left_semi"), schema)
    missing = cache_misses(docs, cache)
    fresh = extract(missing).join(missing.select("source_file", "content_hash"), "source_file")
    return old.unionByName(fresh.select("source_file", "content_hash", F.col("pos").cast("int").alias("pos"), *fields))


def with_row_id(tx: DataFrame) -> DataFrame:
    """``id`` from the document's name, its content and the row's place: the same on every run."""
    return tx.withColumn("id", F.sha2(F.concat_ws("|", "source_file", "content_hash", F.col("pos").cast("string")), 256))


def with_date(tx: DataFrame) -> DataFrame:
    """``txn_date`` from the ISO text in ``date``, null if it is none; such rows ask for review and are never matched."""
    return tx.withColumn("txn_date", F.expr("try_to_date(date, 'yyyy-MM-dd')"))


# Currency.

def rates_needed(tx: DataFrame, base: str) -> DataFrame:
    """Distinct (date, currency) pairs that need a rate: one attempt each, also for those that fail."""
    return tx.where(F.col("currency") != base).select("date", "currency").distinct()


def complete_rates(tx: DataFrame, cache: DataFrame, base: str, provider) -> DataFrame:
    """``cache`` and the missing rates that ``provider`` finds: a function of (date, currency, base) to a rate or null.

    It is called once for each missing pair of date and currency; a call that fails gives no rate. Write the result down before
    use, so that calls are not repeated.
    """
    have = cache.where(F.col("to_currency") == base).select("date", F.col("from_currency").alias("currency"))
    missing = rates_needed(tx, base).join(have, ["date", "currency"], "left_anti")

    def fetch(batches):
        for rows in batches:
            found = []
            for date, currency in zip(rows["date"], rows["currency"], strict=True):
                try:
                    rate = provider(date, currency, base)
                except Exception:
                    rate = None
                if rate is not None:
                    found.append((date, currency, base, float(rate)))
            yield pd.DataFrame(found, columns=["date", "from_currency", "to_currency", "rate"])

    kind = dict(cache.dtypes)["date"]
    return cache.select("date", "from_currency", "to_currency", "rate").unionByName(missing.mapInPandas(fetch, f"date {kind}, from_currency string, to_currency string, rate double"))


def convert(tx: DataFrame, rates: DataFrame, base: str) -> DataFrame:
    """``amount_base``: the amount itself in the base currency, else rounded to cents by the day's rate; null without one. Rates of zero are missing."""
    r = rates.where(F.col("to_currency") == base).select("date", F.col("from_currency").alias("currency"), F.nullif("rate", F.lit(0.0)).alias("rate"))
    r = last_of(r, ["date", "currency"])
    converted = F.round(F.col("amount_original").cast("decimal(24,8)") * F.col("rate").cast("decimal(14,8)"), 2).cast("double")
    return tx.join(r, ["date", "currency"], "left").withColumn("amount_base", F.when(F.col("currency") == base, F.col("amount_original")).otherwise(converted))


# Categories.

def in_batches(tx: DataFrame, order: list[str], size: int = BATCH) -> DataFrame:
    """``batch`` by position: for prompts, which are small; the position is a global order."""
    return tx.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("long"))


def prompt_lines(tx: DataFrame) -> DataFrame:
    return tx.withColumn("line", F.concat_ws(" | ", "id", "merchant", F.concat_ws(" ", F.col("amount_original").cast("string"), "currency")))


#: Keywords of the default categorizer, for merchants in lower case.
KEYWORDS = {
    "supermarket": "Groceries", "grocery": "Groceries", "market": "Groceries", "restaurant": "Dining", "coffee": "Dining", "cafe": "Dining", "pizza": "Dining",
    "taxi": "Transport", "uber": "Transport", "fuel": "Transport", "parking": "Transport", "electric": "Utilities", "water": "Utilities", "internet": "Utilities", "phone": "Utilities",
    "pharmacy": "Healthcare", "clinic": "Healthcare", "hospital": "Healthcare", "cinema": "Entertainment", "music": "Entertainment", "streaming": "Entertainment",
    "hotel": "Travel", "airline": "Travel", "flight": "Travel", "course": "Education", "university": "Education", "transfer": "Transfer", "fee": "Fees & Charges",
    "salary": "Salary", "payroll": "Salary", "freelance": "Freelance", "interest": "Other Income", "rent": "Rent", "store": "Shopping", "shop": "Shopping",
}


def keyword_category(merchant: Column, keywords: dict[str, str] = KEYWORDS) -> Column:
    """The category of the longest keyword in the merchant's name, of equally long ones the first by name; null if there is none."""
    out, name = F.lit(None).cast("string"), F.lower(merchant)
    for word in sorted(keywords, key=lambda w: (-len(w), w), reverse=True):
        out = F.when(name.contains(word), keywords[word]).otherwise(out)
    return out


def in_taxonomy(category: Column) -> Column:
    """Whether a category is one of the list; assigning doesn't ask this."""
    return category.isin(*CATEGORIES)


def assign_categories(tx: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (id, category); none, null or "null" asks for review. The list of categories isn't enforced."""
    own = last_of(answers.select("id", F.col("category").alias("answer"), *(c for c in ("pos",) if c in answers.columns)), ["id"]).select("id", "answer")
    return answered(tx.join(own, "id", "left"), F.col("answer")).drop("answer")


def answered(tx: DataFrame, answer: Column) -> DataFrame:
    """:func:`assign_categories` where the answer is known from the row itself, so that nothing is joined."""
    missing = answer.isNull() | (answer == "null")
    return tx.select("*", F.when(~missing, answer).alias("category"), missing.alias("needs_review"), F.when(missing, NOT_CONFIDENT).alias("review_reason"))


def fail_batches(tx: DataFrame, replies: DataFrame) -> DataFrame:
    """All rows of a batch whose reply (batch, ok) did not parse ask for review."""
    replies = replies.groupBy("batch").agg(F.every("ok").alias("ok"))  # a batch with a failed reply has failed
    return tx.join(replies, "batch", "left").withColumn("needs_review", ~F.coalesce("ok", F.lit(False))).withColumn("review_reason", F.when(F.col("needs_review"), BATCH_FAILED)).drop("ok")


def flag_by_replies(tx: DataFrame, reasons: DataFrame) -> DataFrame:
    """``suspicious`` and ``suspicious_reason`` from answers (id, reason), of several for an id the last."""
    own = last_of(reasons, ["id"]).select("id", F.col("reason").alias("suspicious_reason"), F.lit(True).alias("suspicious"))
    return tx.join(own, "id", "left").withColumn("suspicious", F.coalesce("suspicious", F.lit(False)))


# Suspicion: the first rule that holds gives the reason.

def _in_turn():
    """``turn`` is a hash of the account: long names that begin alike are compared by it first."""
    return Window.partitionBy("turn", "account", "merchant").orderBy("txn_date", "ord")


def same_day_charges() -> Column:
    """In date order a day's charges are neighbours; rows without date are of one day."""
    day = F.coalesce(F.unix_date("txn_date").cast("long"), F.lit(-(2**62)))  # no date's number
    near = lambda row: F.coalesce(row == day, F.lit(False))
    return near(F.lag(day).over(_in_turn())) | near(F.lead(day).over(_in_turn()))


def out_of_line(tx: DataFrame, factor: float = 10.0, counted: DataFrame | None = None) -> DataFrame:
    """``outlier``: more than ``factor`` times the median of its merchant's category and currency. Each amount is counted first; categories and currencies are few.

    ``counted``: the rows whose median it is, (category, currency, amount_original); with ``n``, each stands for that many. By default those of ``tx``.
    """
    keys = [F.col("category").alias("t_category"), F.col("currency").alias("t_currency")]
    counted = tx if counted is None else counted
    counted = counted if "n" in counted.columns else counted.withColumn("n", F.lit(1))
    amounts = counted.groupBy(*keys, F.abs("amount_original").alias("size")).agg(F.sum("n").alias("n"))
    typical = amounts.groupBy("t_category", "t_currency").agg(F.expr("percentile(size, 0.5D, n)").alias("typical"))
    both = F.col("category").eqNullSafe(F.col("t_category")) & F.col("currency").eqNullSafe(F.col("t_currency"))
    return tx.join(F.broadcast(typical), both, "left").select(*tx.columns, (F.abs("amount_original") > factor * F.col("typical")).alias("outlier"))


def changed_amount(share: float = 0.5) -> Column:
    last = F.lag("amount_original").over(_in_turn())
    return F.coalesce((last != 0) & (F.abs(F.col("amount_original") - last) > share * F.abs(last)), F.lit(False))


def usual_currency(tx: DataFrame) -> DataFrame:
    """(account, usual): the currency of most transactions; ties go to the first by name. Accounts of one currency are left out: nothing is unusual there."""
    counts = tx.groupBy("account", "currency").agg(F.count(F.lit(1)).alias("n"))
    usual = F.min_by("currency", F.struct(-F.col("n"), F.col("currency"))).alias("usual")
    return counts.groupBy("account").agg(usual, F.count(F.lit(1)).alias("currencies")).where("currencies > 1").drop("currencies")


def suspicious(tx: DataFrame, among: Column | str | None = None, counted: DataFrame | None = None, again: dict[str, Column] | None = None) -> DataFrame:
    """``suspicious`` and ``suspicious_reason``; credits and routine categories never are.

    Rows are dealt by account, which serves the windows over its merchants and the join with its usual currency: they are moved and sorted once.

    ``among``: only rows of which this holds are wanted. It must say the same of all rows of one account and merchant, which are compared with each other; what is
    typical or usual is still learned from all. ``counted``: see :func:`out_of_line`. ``again``: columns that follow from others, which aren't moved but computed again.
    """
    columns, usual, again, counted = tx.columns, usual_currency(tx), again or {}, tx if counted is None else counted
    tx = tx if among is None else tx.where(among)
    open_ = ~F.coalesce(F.col("category").isin(*ROUTINE), F.lit(False)) & (F.col("amount_original") < 0)
    by = {"turn": F.xxhash64("account")}
    marked = tx.withColumns(by).drop(*again).repartition("turn", "account").withColumns({"repeat": same_day_charges(), "changed": changed_amount()}).withColumns(again)
    # What is typical is met after the move, so that the rows needn't wait for it.
    marked = out_of_line(marked, counted=counted).join(usual.withColumns(by), ["turn", "account"], "left").withColumn("open", open_)
    reason = F.when(F.col("outlier"), "Amount far out of line for its category").when(F.col("repeat"), "Several charges by one merchant on one day").when(
        F.col("changed"), "Recurring payment changed significantly"
    ).when(F.col("currency") != F.col("usual"), "Unexpected currency for the account")
    out = marked.withColumn("suspicious_reason", F.when(F.col("open"), reason)).withColumn("suspicious", F.col("suspicious_reason").isNotNull())
    return out.select(*columns, "suspicious", "suspicious_reason")


def merge_flags(tx: DataFrame, duplicates: DataFrame, flags: DataFrame) -> DataFrame:
    """Both branches' results on one row: neither is lost. A row that the duplicates' ``needs_review`` marks takes their reason; others keep their own."""
    doubt, reason = (F.col(c) if c in duplicates.columns else F.lit(None) for c in ("needs_review", "review_reason"))
    own = duplicates.select("id", "duplicate_of", F.coalesce(doubt, F.lit(False)).alias("in_doubt"), reason.cast("string").alias("doubt_reason"))
    both = tx.join(own, "id", "left").join(flags.select("id", "suspicious", "suspicious_reason"), "id", "left").withColumn("suspicious", F.coalesce("suspicious", F.lit(False)))
    return settle(both)


def settle(tx: DataFrame) -> DataFrame:
    """:func:`merge_flags` for rows that carry both branches' results already, as ``duplicates.mark`` and :func:`suspicious` leave them."""
    doubted = F.coalesce("in_doubt", F.lit(False))
    return tx.withColumns({"needs_review": F.col("needs_review") | doubted, "review_reason": F.when(doubted, F.col("doubt_reason")).otherwise(F.col("review_reason"))}).drop("in_doubt", "doubt_reason")


# Review and report.

def review_queue(tx: DataFrame) -> DataFrame:
    label = F.concat_ws(" · ", "date", "merchant", F.format_string("%+.2f", "amount_original"), "currency")
    reason = F.coalesce(F.nullif("review_reason", F.lit("")), F.nullif("suspicious_reason", F.lit("")), F.lit("—"))
    return tx.where("needs_review").select("id", label.alias("label"), reason.alias("reason"))


def apply_decisions(tx: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (id, checked); an unchecked one rejects."""
    own = last_of(decisions, ["id"]).select("id", F.when(F.col("checked"), "confirmed").otherwise("rejected").alias("review_status"))
    return tx.join(own, "id", "left")


def headline(tx: DataFrame) -> DataFrame:
    pairs = F.count("duplicate_of")
    return tx.agg(F.count(F.lit(1)).alias("transactions"), (2 * pairs).alias("duplicate_entries"), pairs.alias("duplicate_pairs"), F.count_if("suspicious").alias("suspicious"), F.count_if("needs_review").alias("needs_review"))


def by_category(tx: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized"))
    total = F.sum(F.abs(F.coalesce("amount_base", F.lit(0.0))).cast("decimal(18,2)")).cast("double")
    return tx.groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


def report_text(head: DataFrame, categories: DataFrame) -> DataFrame:
    """One row: the report as text. Categories are few."""
    lines = categories.agg(F.array_join(F.sort_array(F.collect_list(F.format_string("%s: %d transactions, %.2f", "category", "n", "total"))), "\n").alias("by_category"))
    top = head.select(F.format_string("Transactions: %d\nDuplicates: %d\nSuspicious: %d\nNeeds review: %d\n\nBy category:\n", "transactions", "duplicate_entries", "suspicious", "needs_review").alias("top"))
    return top.join(lines).select(F.concat("top", "by_category").alias("report"))  # one row each


def statement_summary(tx: DataFrame, key: str) -> DataFrame:
    cents = F.col("amount_original").cast("decimal(18,2)")
    part = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return tx.groupBy(key).agg(F.count(F.lit(1)).alias("n"), part(cents).alias("net"), part(F.when(cents > 0, cents)).alias("credits"), part(F.when(cents < 0, cents)).alias("debits"))


def account_short(title: Column, names: dict[str, str]) -> Column:
    """The short name of the first key that the title contains, else the title."""
    out = title
    for part, short in reversed(names.items()):
        out = F.when(title.contains(part), short).otherwise(out)
    return out


def reference_number(number: Column) -> Column:
    return F.format_string("REF%04d", number)


def money(amount: Column) -> Column:
    """With sign, thousands marks and cents."""
    return F.format_string("%+,.2f", amount)


def by_date(tx: DataFrame) -> DataFrame:
    """In date order, for presentation."""
    return tx.orderBy("txn_date", "ord")


def is_duplicate(tx: DataFrame) -> Column:
    """By ``duplicate`` where rows have it, as ``duplicates.mark_apart`` leaves them, else by ``duplicate_of``."""
    return F.col("duplicate") if "duplicate" in tx.columns else F.col("duplicate_of").isNotNull()


def display(tx: DataFrame, show_id: bool = True) -> DataFrame:
    flags = F.concat_ws(" ", F.when(is_duplicate(tx), "D"), F.when(F.col("suspicious"), "S"), F.when(F.col("needs_review"), "R"))
    return tx.select(
        F.concat(F.substring("id", 1, 8), F.lit("…")).alias("short_id"), *(["id"] if show_id else []), "date", "merchant", "amount_original", "currency", F.coalesce("category", F.lit("—")).alias("category"), "account", flags.alias("flags")
    )


def choose(tx: DataFrame, account: str = "All", category: str = "All", flag: str = "All") -> DataFrame:
    """Filters of the transactions view; "All" is no filter."""
    own = is_duplicate(tx)
    tests = {"Duplicate": own, "Suspicious": F.col("suspicious"), "Needs Review": F.col("needs_review"), "Clean": ~own & ~F.col("suspicious") & ~F.col("needs_review")}
    if account != "All":
        tx = tx.where(F.col("account") == account)
    if category != "All":
        tx = tx.where(F.coalesce("category", F.lit("—")) == category)
    return tx.where(tests[flag]) if flag != "All" else tx


def options(tx: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column and "All", with their place in the list."""
    values = tx.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().select(F.lit(1).alias("place"), "value")
    return values.unionByName(tx.sparkSession.sql("select 0 as place, 'All' as value"))
