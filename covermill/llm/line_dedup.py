"""Line de-duplication with DataFrame operations only.

Lines are exploded with their position and hashed by their normalised form; the distinct documents of
a hash are counted; lines of hashes that too many documents share are dropped, and the others are
put together again by position. Texts don't travel with the lines: a line is its hash and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermill.llm.token_files import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    """128 bits, so that different lines don't meet at any number of lines."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drops lines found in ``min_docs`` documents or more, except in the largest id that holds them.

    Lines are split at line feeds; a null or empty text is one empty line. A key of fewer than
    ``min_chars`` code points is never dropped. Adds ``n_lines``, ``n_dropped`` and ``kept_text`` and
    keeps all other columns, whatever their names, and every row. Rows that share an id are one document; rows with a null id
    are one document too, the smallest. A document whose lines are all dropped gets an empty text.
    """
    spark = docs.sparkSession
    # a row is found again by its id and its text: rows equal in both lose the same lines
    body = F.coalesce(F.col(text), F.lit(""))
    row = [F.col(doc_id).alias("_id"), F.xxhash64(body).alias("_row")]
    lines = docs.select(*row, F.posexplode(F.split(body, "\n", -1)).alias("_pos", "_line")).select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
    long = lines.where(F.length("_key") >= min_chars).select("_id", "_row", "_pos", _hash(F.col("_key")).alias("_h")).select("_id", "_row", "_pos", "_h.a", "_h.b")

    # counted by (line, document) first, then by line: a line of every document is summed before it is sent
    per_doc = long.groupBy("a", "b", "_id").agg(F.count(F.lit(1)).alias("_n"))
    shared = per_doc.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_last")).where(F.col("_docs") >= min_docs)
    folder = new_folder(spark, "lines")
    shared.select("a", "b", "_last").write.parquet(f"{folder}/shared")
    # read again as a plain table, so that a hot line on the other side can be split, or this side broadcast if Spark finds it small
    shared = spark.read.schema("a long, b long, _last long").parquet(f"{folder}/shared")
    last = F.coalesce(F.col("_id") == F.col("_last"), F.col("_id").isNull() & F.col("_last").isNull())
    dropped = long.join(shared, ["a", "b"]).where(~last).groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_drop"))

    # the input's columns travel as one, so that no name of theirs meets one of these; lines are cut again behind the join
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_held"), *row)
    back = dropped.select(F.col("_id").alias("_drop_id"), F.col("_row").alias("_drop_row"), "_drop")
    joined = keyed.join(back, F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_row") == F.col("_drop_row")), "left")
    joined = joined.withColumn("_body", F.coalesce(F.col("_held")[text], F.lit(""))).withColumn("_cut", F.split("_body", "\n", -1))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_cut") - 1), "_drop"), lambda i: F.get("_cut", i))
    return joined.select(
        "_held.*",
        F.size("_cut").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), F.col("_body")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
