"""JSON replies of pluggable deciders, parsed without failing a job on a malformed one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSACTIONS = "array<struct<date:string,amount_original:double,amount_base:double,currency:string,merchant:string,account:string,source_file:string>>"
CATEGORIES = "array<struct<id:string,category:string>>"
VERDICT = "struct<is_duplicate:boolean,confidence:string,reason:string>"
REASONS = "array<struct<id:string,reason:string>>"


def reply_text(reply: Column) -> Column:
    """No reply is an empty list."""
    return F.coalesce(reply, F.lit("[]"))


def parse(reply: Column, schema: str) -> Column:
    """Null if malformed."""
    return F.from_json(reply_text(reply), schema)


def items(df: DataFrame, reply_col: str, schema: str, order: str | None = None) -> DataFrame:
    """Rows of list replies, with ``pos``: the reply's ``order`` and then the place in its list. Malformed replies have none."""
    rows = F.posexplode(F.coalesce(parse(F.col(reply_col), schema), F.array()))
    turn = F.col(order).cast("long") if order else F.lit(0).cast("long")
    return df.select(*(c for c in df.columns if c != reply_col), turn.alias("_turn"), rows.alias("_at", "_item")).select(
        *(c for c in df.columns if c != reply_col), F.struct("_turn", "_at").alias("pos"), "_item.*"
    )


def verdict(reply: Column) -> Column:
    """(is_duplicate, needs_review, reason) of a judge's reply: doubt only if it says no with low confidence, or is malformed."""
    v = parse(reply, VERDICT)
    same = F.coalesce(v["is_duplicate"], F.lit(False))
    bad = F.coalesce(v["is_duplicate"].cast("string"), v["confidence"], v["reason"]).isNull()  # a malformed object has only nulls
    doubt = bad | (~same & (F.coalesce(v["confidence"], F.lit("")) == "low"))
    reason = F.when(bad, "Duplicate check failed").when(doubt, F.coalesce(v["reason"], F.lit("Possible duplicate with low confidence")))
    return F.struct((same & ~bad).alias("is_duplicate"), doubt.alias("needs_review"), reason.alias("reason"))
