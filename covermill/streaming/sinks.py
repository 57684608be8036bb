"""Running streams to the end of their input, and sinks that repeat a batch without harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from covermill.streaming.paged_state import PAGE_SCHEMA

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Processes what is there, in as many batches as the source's limits ask for, then stops."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def per_batch(stream: DataFrame, checkpoint: str, job: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Calls ``job`` with each batch and its number; state, where the stream has any, is kept in RocksDB."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    run_available(stream.writeStream.outputMode(mode).foreachBatch(job), checkpoint)


def write_batch(df: DataFrame, path: str, batch_id: int, *by: str) -> None:
    """Writes one batch's rows to its own folder, split by the given columns; a repeated batch replaces it."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All batches' rows, or those before a batch; none if nothing was written yet."""
    try:
        df = spark.read.schema(f"{schema}, batch_id BIGINT").option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], f"{schema}, batch_id BIGINT")
    return df if before is None else df.where(f"batch_id < {before}")


#: The stateful operator nearest to the sink, where a query chains several.
LAST_OPERATOR = -1


def _operator(spark: SparkSession, checkpoint: str, variable: str, which: int) -> int:
    """The id of a stateful operator that holds the variable; ids count from the sink."""
    if which != LAST_OPERATOR:
        return which
    found = spark.read.format("state-metadata").load(checkpoint).where(F.col("operatorProperties").contains(f'"{variable}"'))
    return found.agg(F.min("operatorId")).first()[0] or 0


def read_state(spark: SparkSession, checkpoint: str, variable: str, key_schema: str, value_schema: str, operator: int = 0) -> DataFrame:
    """A variable's values, or a list's elements, after the last batch, as columns of key and value; none before the first batch."""
    keys, values = ([c.split()[0] for c in schema.split(", ")] for schema in (key_schema, value_schema))
    empty = spark.createDataFrame([], f"{key_schema}, {value_schema}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    try:
        state = spark.read.format("statestore").option("stateVarName", variable).option("operatorId", _operator(spark, checkpoint, variable, operator)).load(checkpoint)
    except PySparkException as e:
        if e.getCondition() != "STDS_COMMITTED_BATCH_UNAVAILABLE":
            raise
        return empty
    held = "list_element" if "list_element" in state.columns else "value"
    cells = [*[F.col(f"key.{c}") for c in keys], *[F.col(f"{held}.{c}") for c in values]]
    return empty.union(state.select(*cells))


def read_pages(spark: SparkSession, checkpoint: str, variable: str, schema: str, operator: int = 0) -> DataFrame:
    """What paged state keeps, one row per key."""
    pages = read_state(spark, checkpoint, variable, PAGE_SCHEMA, "value STRING", operator)
    return pages.select(F.inline(F.from_json("value", f"ARRAY<STRUCT<{schema}>>")))
