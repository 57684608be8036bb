"""Row limits per key and over all rows, safe for a key that holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    salts: int = 16,
    rank: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of each key in the given order.

    Two steps: the first ``k`` per (key, slot), where the slot is the input partition modulo
    ``salts``, then the first ``k`` of those per key. Spark limits each group before the shuffle as
    well, so a hot key sends at most ``k`` rows per input partition, its first step is spread over
    ``salts`` tasks, and its second step sees at most ``k * salts`` rows. The result is exact.
    """
    rn = rank or "_rank"
    if salts > 1:
        w = Window.partitionBy(*keys, "_slot").orderBy(*order)
        df = (
            df.withColumn("_slot", F.spark_partition_id() % salts)
            .withColumn("_slot_rank", F.row_number().over(w))
            .where(F.col("_slot_rank") <= k)
            .drop("_slot", "_slot_rank")
        )
    df = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rn) <= k)
    return df if rank else df.drop(rn)


def most_common(df: DataFrame, item: str, k: int, count: str = "n") -> DataFrame:
    """The ``k`` most frequent items, ties by item; counts are merged before any row is ranked."""
    return df.groupBy(item).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), F.asc(item)).limit(k)
