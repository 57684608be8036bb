"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.llm.library_tokens import library_encoder, tokenizer_path
from covermill.llm.pieces import by_slices

VOCABULARY = "byte_bpe_50k.json"


def token_counter(vocabulary: str = VOCABULARY, batch_bytes: int = 4 << 20):
    """An Arrow function from a text to its number of tokens.

    Rows are encoded in batches of about ``batch_bytes``, whatever the number of rows; long texts are
    split at spaces where the vocabulary always has a boundary. Only lengths go back to Spark.
    """

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = library_encoder(tokenizer_path(vocabulary))
        yield from by_slices(lambda texts: pa.array(encoder.count(texts), pa.int64()), batches, batch_bytes)

    return n_tokens


def with_token_counts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = 1024) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` to every row.

    Null and empty texts have no tokens. Columns of these names are replaced, all others kept;
    repeated rows are counted each for itself; an empty table gives an empty result. No text is cut.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return (
        df.withColumns({"n_bytes": F.octet_length(body).cast("long"), "n_tokens": token_counter(vocabulary)(body)})
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
