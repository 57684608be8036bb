"""Reviews, the page fetch queue, service tickets, answers by destination and audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.sources.readers import write_log


def review_state(log: DataFrame) -> DataFrame:
    """Latest state per review from its log of transitions; a resolution wins a tie in time."""
    order = F.struct("at", (F.col("status") != "pending").alias("resolved"))
    row = F.struct("action", "status", "reason", F.when(F.col("status") != "pending", F.col("at")).alias("resolved_at"))
    return (
        log.groupBy("review_id")
        .agg(F.max_by(row, order).alias("r"), F.min("at").alias("created_at"))
        .select("review_id", "created_at", "r.*")
    )


def backlog(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def fetch_queue(requests: DataFrame) -> DataFrame:
    """One row per url: its latest request."""
    row = F.struct("brand", "model", "region", "status")
    return requests.groupBy("url").agg(F.max_by(row, "seq").alias("r")).select("url", "r.*")


def needing_review(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pending fetches without an open review."""
    opened = reviews.where((F.col("action") == "oem_fetch") & (F.col("status") == "pending")).select("url").distinct()
    return queue.where(F.col("status") == "pending").join(opened, "url", "left_anti")


def mark_fetched(queue: DataFrame, arrived: DataFrame) -> DataFrame:
    """Queue rows become fetched when a page arrived for their url, brand and model."""
    keys = ["url", "brand", "model"]
    got = arrived.where(F.col("url").isNotNull()).select(*keys).distinct().withColumn("got", F.lit(True))
    return (
        queue.join(got, keys, "left")
        .withColumn("status", F.when(F.col("got"), "fetched").otherwise(F.col("status")))
        .drop("got")
    )


def ticket_parts(tickets: DataFrame) -> DataFrame:
    """Parts recommended for each ticket's symptom, none for other symptoms."""
    table = F.create_map(*[c for k, v in C.SYMPTOM_PARTS.items() for c in (F.lit(k), S.text_array(v))])
    parts = F.coalesce(F.try_element_at(table, F.col("symptom")), F.expr("cast(array() AS array<string>)"))
    return tickets.withColumn("parts", parts).withColumn("status", F.lit("draft"))


def route_answers(answers: DataFrame) -> DataFrame:
    """Adds each answer's destination: manufacturer questions carry a prefix."""
    return answers.withColumn("sink", F.when(F.col("question_id").startswith("oemq_"), "oem").otherwise("bank"))


def write_answers(answers: DataFrame, path: str, run: str | None = None) -> None:
    """Adds answers to one log per destination; a repeated ``run`` replaces its own."""
    write_log(route_answers(answers), path, run, "sink")


def audit_rows(contents: DataFrame) -> DataFrame:
    """Audit details of logged contents: full with a length limit, and redacted."""
    return contents.withColumn("detail", S.trim_detail(F.col("content"))).withColumn(
        "redacted", S.redacted_detail(F.col("content"))
    )
