"""Bounded samples for what is trained: dictionaries, automata, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.llm.names import unused

_RANGE = 1 << 30


def bounded_sample(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The first ``size`` rows in order of a hash of ``keys``, the same ones on every run.

    Rows whose hash is certainly too large go before anything is sorted, so that the tasks send about
    twice the sample in all, however many there are. Rows equal in all keys share a hash; where most are,
    the sample may be smaller.
    """
    n = df.count()
    held = unused(df, "__hash")
    df = df.withColumn(held, F.xxhash64(*keys))
    if n > 4 * size:
        df = df.where(F.pmod(held, F.lit(_RANGE)) < int(_RANGE * 2 * size / n) + 1)
    return df.orderBy(F.pmod(held, F.lit(_RANGE)), held, *keys).limit(size).drop(held)
