"""Exact deduplication by a log-structured merge index of text digests.

Method. Rows are dealt to a few *memtables*. Each is flushed as one run: its distinct digests,
sorted, with the identifier to keep and a count. A run has a filter: a bitmap over digest bits
(Spark's bitmap aggregates); the run files also carry Parquet Bloom filters for later point lookups.
*Compaction* merges only entries whose digest may be in another run by that run's filter; the others
pass through. Digests that occur more than once are *hits*, and hits are verified on the bytes: texts
that share a digest are grouped by the text itself, so rows are equal only if their bytes are. If one
digest covers several texts, each text is its own class.

Only DataFrame functions run: no Python on the executors. Map-side combination absorbs hot groups:
a text with any number of copies reaches the shuffle once per task. No row's text is shuffled
unless its digest may be a hit.

Defined results. Null text counts as empty, so all null and empty texts are one class. A null
identifier takes part; ``keep_id`` is null only if all of a class are null. Rows that repeat an
identifier with the same text are one class and all are marked kept; :func:`drop_copies` returns one row
of each class. An empty table gives an empty result. Extra columns are ignored by
:func:`exact_dedup` and carried by :func:`drop_copies`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WorkArea, bit_at, fresh_name, mark_known


def sha256_digest(text: Column) -> Column:
    """The 32 bytes of SHA-256 over the text's UTF-8."""
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class DigestIndex:
    """The outcome: every row's digest, the compacted index, and the verified classes of more than one row."""

    rows: DataFrame  #: (id, digest) of every input row
    compacted: DataFrame  #: (digest, keep_id, n), one row for each digest, sorted
    classes: DataFrame  #: (digest, keep_id, n) of digests with one text and more than one row
    collided: DataFrame  #: (id, digest, keep_id, n) of rows whose digest covers several texts
    collisions: bool


def _best(ids: Column, keep: str) -> Column:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return F.min(ids) if keep == "smallest" else F.max(ids)


def _flush(rows: DataFrame, memtables: int, keep: str, area: WorkArea) -> DataFrame:
    dealt = rows.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int"))
    runs = dealt.groupBy("run", "digest").agg(_best(F.col("id"), keep).alias("keep_id"), F.count(F.lit(1)).alias("n"))
    bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    return area.table(runs.sortWithinPartitions("run", "digest"), "runs", **bloom)


def _compact(runs: DataFrame, keep: str, area: WorkArea) -> DataFrame:
    """Merge the runs; entries that no other run's filter knows are not shuffled by digest again."""
    largest = runs.groupBy("run").count().agg(F.max("count")).first()[0] or 1  # one number for each memtable
    bits_log2 = max(15, min(38, (8 * largest - 1).bit_length()))
    slot = F.pmod(F.xxhash64("digest"), F.lit(1 << bits_log2)) + 1
    keyed = runs.withColumns({"bucket": F.bitmap_bucket_number(slot), "pos": F.bitmap_bit_position(slot)})
    filters = keyed.groupBy("run", "bucket").agg(F.bitmap_construct_agg("pos").alias("bits"))
    filters = filters.groupBy("bucket").agg(F.collect_list(F.struct("run", "bits")).alias("filters"))  # at most one for each memtable
    elsewhere = F.exists("filters", lambda f: (f["run"] != F.col("run")) & bit_at(f["bits"], F.col("pos")))
    marked = keyed.join(filters, "bucket").select("digest", "keep_id", "n", elsewhere.alias("elsewhere"))
    marked = area.table(marked, "marked")
    alone = marked.where(~F.col("elsewhere")).select("digest", "keep_id", "n")
    merged = marked.where("elsewhere").groupBy("digest").agg(_best(F.col("keep_id"), keep).alias("keep_id"), F.sum("n").alias("n"))
    out = area.table(alone.unionByName(merged).sortWithinPartitions("digest"), "compacted")
    area.drop("marked")
    return out


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    memtables: int = 4,
    digest: Callable[[Column], Column] = sha256_digest,
    area: WorkArea | None = None,
) -> DigestIndex:
    """Flush, compact and verify."""
    area = area or WorkArea(docs.sparkSession, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = area.table(source.select("id", digest(F.col("text")).alias("digest")), "rows")
    compacted = _compact(_flush(rows, memtables, keep, area), keep, area)
    hits = compacted.where("n > 1").select(F.xxhash64("digest").alias("h"))
    hit_texts = mark_known(source.withColumn("digest", digest(F.col("text"))), F.xxhash64("digest"), hits).where("maybe")
    # Grouping by the text compares the bytes; a digest of several texts gets several rows.
    variants = area.table(
        hit_texts.groupBy("digest", "text")
        .agg(_best(F.col("id"), keep).alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .select("digest", "keep_id", "n", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), F.length("text").alias("t3")),
        "variants",
    )
    per = variants.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.first("keep_id").alias("keep_id"), F.first("n").alias("n"))
    per = area.table(per.where("texts > 1 or n > 1"), "classes")
    shared = per.where("texts > 1").select("digest")
    collisions = not shared.isEmpty()
    if collisions:
        own = hit_texts.join(shared, "digest", "left_semi")
        sized = own.groupBy("digest", "text").agg(_best(F.col("id"), keep).alias("keep_id"), F.count(F.lit(1)).alias("n"))
        collided = area.table(own.select("id", "digest", "text").join(sized, ["digest", "text"]).select("id", "digest", "text", "keep_id", "n"), "collided")
    else:
        collided = per.limit(0).select(F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), "digest", F.lit("").alias("text"), "keep_id", "n")
    return DigestIndex(rows, compacted, per.where("texts = 1").select("digest", "keep_id", "n"), collided, collisions)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **options) -> DataFrame:
    """One row for each input row: ``id_col, digest, keep_id, group_size, kept``."""
    index = build_index(docs, id_col, text_col, keep, **options)
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    rows = index.rows
    if index.collisions:
        rows = rows.join(index.collided.select("digest").distinct(), "digest", "left_anti")
    joined = rows.join(index.classes, "digest", "left").select(
        "id", "digest", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n")
    )
    if index.collisions:
        joined = joined.unionByName(index.collided.select("id", "digest", "keep_id", "n"))
    return joined.select(F.col("id").alias(id_col), "digest", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **options) -> DataFrame:
    """``docs`` with one row of each class of equal texts, all columns kept.

    Rows that cannot be copies by the index's filter stay where they are. Of the others, those that are not their class's
    row to keep go by a join on the digest; what is left is grouped by text only where ids repeat or texts share a digest.
    """
    index = build_index(docs, id_col, text_col, keep, **options)
    digest = options.get("digest", sha256_digest)
    names = docs.columns
    flag, own, other, best, key, row = (fresh_name(names, x) for x in ("maybe", "own_digest", "class_digest", "class_keep", "key", "row"))
    hits = index.classes.select("digest")
    twice = index.rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest").distinct()
    if index.collisions:
        hits, twice = (x.unionByName(index.collided.select("digest").distinct()) for x in (hits, twice))
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = mark_known(docs.withColumn(own, digest(text)), F.xxhash64(own), hits.select(F.xxhash64("digest").alias("h")), flag)
    alone = marked.where(~F.col(flag)).select(*names)
    classes = index.classes.select(F.col("digest").alias(other), F.col("keep_id").alias(best))
    kept = marked.where(flag).join(classes, F.col(own) == F.col(other), "left").where(F.col(other).isNull() | F.col(id_col).eqNullSafe(F.col(best)))
    if twice.isEmpty():
        return alone.unionByName(kept.select(*names))
    twice = twice.select(F.col("digest").alias(other))
    kept = kept.drop(other)
    sure = kept.join(twice, F.col(own) == F.col(other), "left_anti").select(*names)
    order = F.struct(F.col(id_col).isNull() if keep == "smallest" else F.col(id_col).isNotNull(), F.col(id_col))
    pick = (F.min_by if keep == "smallest" else F.max_by)(F.struct(*names), order)
    merged = kept.join(twice, F.col(own) == F.col(other), "left_semi").groupBy(text.alias(key)).agg(pick.alias(row)).select(f"{row}.*")
    return alone.unionByName(sure).unionByName(merged)
