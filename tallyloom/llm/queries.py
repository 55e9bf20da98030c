"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, line_runs, mixing, near_dedup, ngram_lm, quality, sharding, warc
from .shared import WorkArea

RANKS = "byte_bpe_50k.tiktoken"
#: Domains of the labelled table, and the tokens wanted of each as a multiple of those expected now.
DOMAIN = "case when toxic = 1 then 2 when quality = 1 then 1 else 0 end"
TARGETS = {0: 0.5, 1: 1.05, 2: 0.1}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _id(name: str = "doc_id"):
    return F.col(name).cast("long").alias(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    assert public_tokenizers.PATTERN == bpe.PATTERN
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"), keep="largest")
    return out.select(_id(), F.col("keep_id").cast("long").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    model = ngram_lm.train(docs.where(~held_out))
    out = ngram_lm.score(docs, model, flag=held_out)
    return out.select("doc_id", F.col("flag").alias("held_out"), "n_tokens", "n_known", F.lit(model.totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = WorkArea(spark, "warc")
    warc.write_archive(_read(spark, sf_dir, "pages"), area.path("archive"), area)
    return warc.read_archive(spark, area.path("archive"), area, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_read(spark, sf_dir, "documents")).select(_id(), "n_shingles", _id("component_id"), "kept")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    tree = chat.linear_tree(rows.unionByName(extra))
    return chat.digests(chat.format_paths(chat.reply_paths(tree, WorkArea(spark, "chat"))))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.drop_repeated_runs(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(_id(), "removed_lines", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.expr(DOMAIN).alias("domain"))
    out = mixing.document_rates(_read(spark, sf_dir, "documents"), labels, TARGETS)
    p = [F.round(F.get("p", F.lit(k)), 6).alias(n) for k, n in enumerate(("p_poor", "p_good", "p_toxic"))]
    return out.select(F.col("id").cast("long").alias("doc_id"), F.col("tokens").alias("n_tokens"), *p, F.round("rate", 6).alias("rate"), "copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    order = quality.order_rules(docs, quality.STYLE_RULES)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality.with_features(docs.select(_id(), "text"), base)
    failed = F.coalesce(*(F.when(r.reject(F.col), True) for r in quality.BASE_RULES), F.lit(False))
    text = F.coalesce(F.col("text"), F.lit(""))
    feature = lambda name: F.col(name) if name in base else quality.FEATURES[name](text)
    kept = F.when(F.col("base_failed"), False).otherwise(quality.cascade(order, feature).isNull())
    return rows.withColumn("base_failed", failed).select("doc_id", *base, "base_failed", kept.alias("kept"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(_read(spark, sf_dir, "documents").select(_id(), "text"), 8)
    text = F.coalesce(F.col("text"), F.lit(""))  # as exchanged
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_exact_dedup, op3_ngram_lm, op4_warc, op5_near_dedup, op6_chat, op7_line_runs, op8_mixing, op9_quality, op10_sharding)
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_quality": r"""
        WITH split AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
            FROM documents),
        windows AS (
            SELECT doc_id, i, list_slice(w, i, i + 7) AS win FROM split, unnest(range(1, len(w) - 6)) AS r(i)),
        repeated AS (
            SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        covered AS (
            SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
            FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM repeated) GROUP BY doc_id),
        base AS (
            SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
                   len(regexp_extract_all(t, '[A-Z]')) AS caps, len(regexp_extract_all(t, '[A-Za-z]')) AS letters
            FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 5 * n_symbols > n_words OR 2 * caps > letters
                    OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
        FROM base""",
}
