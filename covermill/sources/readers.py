"""Readers and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermill import constants as C


def read_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet written by several releases: columns missing from older files read as null."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def union_releases(*frames: DataFrame) -> DataFrame:
    """Union of frames whose columns drifted; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def parse_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines as rows; blank and malformed lines are skipped one by one."""
    parsed = F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return (
        lines.where(F.length(F.trim("value")) > 0)
        .select(parsed.alias("r"))
        .where(F.col("r").isNotNull() & F.col("r._bad").isNull())
        .select("r.*")
        .drop("_bad")
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_json_lines(spark.read.text(path), schema)


def count_bad_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Readable and unreadable lines, for a log whose owner wants to know."""
    parsed = F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = parsed.isNull() | parsed["_bad"].isNotNull()
    return lines.where(F.length(F.trim("value")) > 0).agg(
        F.count(F.when(~bad, 1)).alias("good"), F.count(F.when(bad, 1)).alias("bad")
    )


def parse_seed_lines(lines: DataFrame) -> DataFrame:
    """Training seeds from header-less CSV lines.

    A line holds the 12 features and a label, or 10 features and a label (the last two features are
    then 0). Blank lines, comments, other widths and non-numbers are skipped.
    """
    text = F.trim("value")
    cells = F.transform(F.split(text, ","), lambda c: F.trim(c))
    df = lines.where((text != "") & ~text.startswith("#")).select(cells.alias("c")).withColumn("w", F.size("c"))
    df = df.where(F.col("w").isin(11, 13))

    def cell(i: int) -> Column:
        return F.when(F.col("w") > i + 1, F.try_element_at("c", F.lit(i + 1)).try_cast("double")).otherwise(F.lit(0.0))

    features = [cell(i).alias(n) for i, n in enumerate(C.RISK_FEATURES)]
    out = df.select(*features, F.try_element_at("c", F.lit(-1)).try_cast("int").alias("label"))
    return out.dropna()


def read_seed_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_seed_lines(spark.read.text(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One artifact per text file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def read_rdbms(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """An external table; give (column, lower, upper, parts) to read it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()


def write_log(df: DataFrame, path: str, run: str | None, *by: str) -> None:
    """Adds rows to a log split by columns. With a ``run``, a repeat of that run replaces its rows; without, rows are appended.

    A log is written either with runs or without, since the run is its first partition column.
    """
    if run is None:
        df.write.mode("append").partitionBy(*by).parquet(path)
    else:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/run={run}")


def append_log(df: DataFrame, path: str, time_column: str, run: str | None = None) -> None:
    """Adds events to a log partitioned by their day, see ``write_log``.

    The rebalance hint groups rows by day to keep files few, and lets Spark split a day that is too
    large for one task.
    """
    day = df.withColumn("event_date", F.to_date(time_column))
    write_log(day.hint("rebalance", "event_date"), path, run, "event_date")
