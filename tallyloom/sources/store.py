"""Tables that outlive a session: caches, snapshots before a review, and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RATES = "date string, from_currency string, to_currency string, rate double"
DOCUMENTS = "source_file string, content_hash string, transactions_json string"


def root(spark: SparkSession) -> str:
    """The folder for tables: ``spark.tallyloom.dir``, else one below the warehouse."""
    return spark.conf.get("spark.tallyloom.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/tallyloom"


def _path(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def open_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's latest version; a table that doesn't exist is made, empty."""
    own, fs = _path(spark, path)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(own)) if fs.exists(own) else []
    whole = [v for v in versions if fs.exists(_path(spark, f"{path}/{v}/_SUCCESS")[0])]
    if not whole:
        return replace(spark.createDataFrame([], schema), path)
    return spark.read.schema(schema).parquet(f"{path}/{whole[-1]}")


def replace(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as the table's next version, beside the one it may be read from, and return it. Earlier versions stay until :func:`prune`."""
    spark = df.sparkSession
    own, fs = _path(spark, path)
    last = max((int(s.getPath().getName()[1:]) for s in fs.listStatus(own)), default=0) if fs.exists(own) else 0
    target = f"{path}/v{last + 1:09d}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions."""
    own, fs = _path(spark, path)
    for s in sorted(fs.listStatus(own), key=lambda s: s.getPath().getName())[:-keep]:
        fs.delete(s.getPath(), True)


def snapshot(tx: DataFrame, run: str, base: str | None = None) -> DataFrame:
    """Write a run's rows before the review and return them: the review may come in another session."""
    spark = tx.sparkSession
    path = f"{base or root(spark)}/runs/{run}/before-review"
    tx.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume(spark: SparkSession, run: str, base: str | None = None) -> DataFrame:
    """The rows that :func:`snapshot` wrote."""
    return spark.read.parquet(f"{base or root(spark)}/runs/{run}/before-review")


def write_report(report: DataFrame, path: str) -> None:
    """The report's text, one row, as a text file in the folder ``path``."""
    report.select("report").coalesce(1).write.mode("overwrite").text(path)
