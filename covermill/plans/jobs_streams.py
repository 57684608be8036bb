"""Streaming queries: each reads a given table as a stream and must equal its batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from covermill.functions.scalars import PAIR
from covermill.operators import behaviour as B
from covermill.operators import oem as O
from covermill.operators import telemetry as T
from covermill.plans.jobs_core import scores
from covermill.plans.registry import big, instant, joined, oracle_of, register
from covermill.session import shared_dir
from covermill.sources.domain import AS_OF, LATE, DomainTables, StreamedTables
from covermill.streaming import jobs as J


def fresh(d: DomainTables, name: str) -> tuple[str, str]:
    """A new output and checkpoint folder in the shared folder."""
    base = f"{shared_dir(d.spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def streamed(d: DomainTables, table: str, batches: int = 3) -> StreamedTables:
    """The table as a stream of some batches, each with rows of all times, so that most rows come late."""
    df, folder = d.table(table), f"{shared_dir(d.spark)}/{table}-{uuid.uuid4().hex}"
    mixed = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(batches))
    for k in range(batches):
        df.where(mixed == k).write.mode("append").parquet(folder)
    files = len(d.spark.read.schema(df.schema).parquet(folder).inputFiles())
    return StreamedTables(d.spark, d.folder, table, folder, files_per_trigger=max(1, -(-files // batches)))


@register("stream_telemetry_ingest", oracle_of("telemetry_scan"))
def stream_telemetry_ingest(d):
    out, ckpt = fresh(d, "telemetry")
    J.ingest_telemetry(streamed(d, "events").telemetry(), out, ckpt)
    return d.spark.read.parquet(out).select("id", *PAIR, "event_type", "payload", instant("ts").alias("ts"))


@register("stream_behaviour_signal", oracle_of("behaviour_signal"))
def stream_behaviour_signal(d):
    _, ckpt = fresh(d, "signal")
    J.follow_signal(streamed(d, "events").telemetry(), ckpt)
    df = T.with_signal(J.current_pairs(d.spark, ckpt), J.current_signal(d.spark, ckpt, AS_OF))
    return df.select(
        *PAIR, "usage_intensity", big("error_burden").alias("error_burden"), (F.col("delta_h") / 100).alias("behaviour_delta"),
        "hours_window", joined("signal_reasons").alias("reasons"),
    )


@register("stream_behaviour_signal_late", oracle_of("behaviour_signal_late"))
def stream_behaviour_signal_late(d):
    """The streamed signal read at a later day: silent pairs lose theirs."""
    _, ckpt = fresh(d, "signal")
    J.follow_signal(streamed(d, "events").telemetry(), ckpt)
    df = T.with_signal(J.current_pairs(d.spark, ckpt), J.current_signal(d.spark, ckpt, LATE))
    return df.select(
        *PAIR, "usage_intensity", big("error_burden").alias("error_burden"), (F.col("delta_h") / 100).alias("behaviour_delta"),
        "hours_window", joined("signal_reasons").alias("reasons"),
    )


@register("stream_notification_dedupe", f"SELECT id, user_id, type, audience FROM ({oracle_of('notification_dedupe')}) WHERE kept")
def stream_notification_dedupe(d):
    out, ckpt = fresh(d, "notifications")
    J.keep_notifications(streamed(d, "events").notification(), out, ckpt)
    return J.kept_notifications(d.spark, out).select("id", big("user_id").alias("user_id"), "type", "audience")


@register("stream_behaviour_profile", oracle_of("behaviour_profile"))
def stream_behaviour_profile(d):
    _, ckpt = fresh(d, "profiles")
    J.follow_profiles(streamed(d, "events").answer(), d.warranty(), ckpt)
    return J.current_profiles(d.spark, ckpt).select(
        *B.PROFILE_KEY, "answers", *[big(c).alias(c) for c in ("behaviour_h", "care_h", "resp_h")], instant("last_question_at").alias("last_question_at")
    )


@register("stream_interest_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, product_id AS item, count(*) AS n FROM v_interest GROUP BY 1, 2")
def stream_interest_counts(d):
    out, ckpt = fresh(d, "interest")
    J.count_by_day(streamed(d, "events").interest(), "product_id", "ts", out, ckpt)
    return J.current_counts(d.spark, out).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register(
    "stream_symptom_counts",
    "SELECT strftime(created_at, '%Y-%m-%d') AS day, matched_component AS item, count(*) AS n FROM v_symptom_search WHERE matched_component <> '' GROUP BY 1, 2",
)
def stream_symptom_counts(d):
    out, ckpt = fresh(d, "symptoms")
    searches = streamed(d, "documents").symptom_search().where("matched_component <> ''")
    J.count_by_day(searches, "matched_component", "created_at", out, ckpt)
    return J.current_counts(d.spark, out).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("stream_cluster_alerts", oracle_of("high_risk_clusters"))
def stream_cluster_alerts(d):
    out, ckpt = fresh(d, "clusters")
    # one batch: what an alert says depends on what has arrived by then, and a group is silent for seven days after it
    profiles = streamed(d, "lineitem", 1).profile().select("id", *PAIR, "product_type")
    J.alert_clusters(O.score_profiles(profiles, d.warranty(), scores(d)), out, ckpt, AS_OF)
    return J.alerts(d.spark, out).select("brand", "region_code", "total", "high", "message")
