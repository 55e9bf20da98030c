"""Shared storage and set filters used by the training-data operators.

Intermediate tables cut lineage: they are written once to the folder that the
cluster names in ``spark.checkpoint.dir`` and read back, so a lost executor
costs a re-read of a table, not a recomputation of the plan before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: A run of separators, as a Java pattern.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

_LOCAL_FALLBACK: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` if set. Otherwise, and only on a local master (as in
    tests), one temporary folder per application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    return _LOCAL_FALLBACK[app]


_BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MiB, where the session has Spark's default of 64 MiB: texts may be long, and a task holds several batches."""
    key, default, most = _BATCH_BYTES
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, most)


class WorkArea:
    """A fresh folder below :func:`shared_root` that holds the tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` as Parquet under ``name`` and return it re-read."""
        schema = df.schema
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no returned plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)


#: Estimates from here on are no sizes: Spark gives such for sources of unknown size, and products for joins.
_NO_SIZE = 1 << 50


def text_bytes(df: DataFrame, text_col: str) -> int:
    """The optimizer's size estimate of ``df`` or, where it has none, the bytes of ``text_col`` by one scan; used only to choose numbers of shards."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < _NO_SIZE:
        return estimate
    return df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0


#: Bits in one row of Spark's bitmap aggregates.
BITMAP_ROW_BITS = 32768


def bitmap_filter(keys: DataFrame, hashed: str, bits_log2: int = 24) -> DataFrame:
    """A bit set of ``2**bits_log2`` bits over the 64-bit column ``hashed``.

    Rows ``(f_bucket, f_bits)``: at most ``2**bits_log2 / 32768`` of them, 4 KiB each, whatever
    the number of keys. That fixed bound is what makes it safe to broadcast.
    """
    slot = F.pmod(F.col(hashed), F.lit(1 << bits_log2)) + 1
    return (
        keys.select(F.bitmap_bucket_number(slot).alias("f_bucket"), F.bitmap_bit_position(slot).alias("f_pos"))
        .groupBy("f_bucket")
        .agg(F.bitmap_construct_agg("f_pos").alias("f_bits"))
    )


def bit_at(bitmap: Column, position: Column) -> Column:
    """Whether bit ``position`` of a binary bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.lit(1) + F.floor(position / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.expr("true") & (F.call_function("getbit", byte, F.pmod(position, F.lit(8)).cast("int")) == 1)


def mark_maybe(df: DataFrame, hashed: Column, filter_rows: DataFrame, bits_log2: int = 24, flag: str = "maybe") -> DataFrame:
    """Add boolean ``flag``: false for rows whose key is certainly not in the filter's key set.

    The filter is broadcast; see :func:`bitmap_filter` for its bound. A null hash is never in.
    """
    slot = F.pmod(hashed, F.lit(1 << bits_log2)) + 1
    key, bits = (fresh_name([*df.columns, flag], x) for x in ("f_key", "f_bits"))
    keyed = df.withColumn(key, F.bitmap_bucket_number(slot))
    right = F.broadcast(filter_rows.select(F.col("f_bucket").alias(key), F.col("f_bits").alias(bits)))
    test = F.coalesce(bit_at(F.col(bits), F.bitmap_bit_position(slot)), F.lit(False))
    return keyed.join(right, key, "left").withColumn(flag, test).drop(key, bits)


#: Keys up to which a bitmap is broadcast; 16 bits for each key, so 64 MiB at most.
MOST_KEYS = 1 << 25


def mark_known(df: DataFrame, hashed: Column, keys: DataFrame, flag: str = "maybe") -> DataFrame:
    """Add boolean ``flag``: false for rows whose ``hashed`` is certainly not in the 64-bit column ``h`` of ``keys``, a cheap table.

    The keys are counted first. Up to :data:`MOST_KEYS` they are broadcast as a bitmap sized by their number; more are joined.
    """
    n = keys.count()
    if n <= MOST_KEYS:
        bits = max(20, (16 * n - 1).bit_length()) if n else 15
        return mark_maybe(df, hashed, bitmap_filter(keys, "h", bits), bits, flag)
    key, own = (fresh_name([*df.columns, flag], x) for x in ("known_key", "known_own"))
    wanted = keys.select(F.col("h").alias(key)).distinct()
    return df.withColumn(own, hashed).join(wanted, F.col(own) == F.col(key), "left").withColumn(flag, F.col(key).isNotNull()).drop(own, key)


def fresh_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column has that name (case-insensitively)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
