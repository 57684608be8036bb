"""Risk jobs: behaviour-event risk, feature vectors, and the predictive score per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR
from covermill.operators import telemetry as T

NOT_READY = "Predictive engine not ready yet."


def risk_score(telemetry: DataFrame, as_of) -> DataFrame:
    """Predictive score of every pair with telemetry: counts, recent behaviour, label, reasons.

    The log is read twice on purpose: one read merges counts over all time before the exchange, the
    other only touches the recent window and keeps 50 rows per pair. Both sides end up partitioned
    by pair, so the join adds no exchange.
    """
    base = T.base_risk(T.telemetry_counts(telemetry))
    return finish_score(T.with_signal(base, T.recent_signal(telemetry, as_of)))


def finish_score(scored: DataFrame) -> DataFrame:
    """Final score, label and reasons from a base score and a behaviour delta."""
    filled = F.when(F.size("base_reasons") > 0, F.col("base_reasons")).otherwise(F.array(F.lit(NOT_READY)))
    reasons = F.when(F.col("delta_h") != 0, F.concat("signal_reasons", filled)).otherwise(filled)
    return (
        scored.withColumn("score_h", S.clamp(F.col("base_h") + F.col("delta_h"), 0, 100))
        .withColumn("risk_label", S.label_of(F.col("score_h")))
        .withColumn("reasons", F.slice(reasons, 1, 4))
        .withColumn("behaviour_reasons", F.slice("signal_reasons", 1, 4))
        .withColumn("risk_score", F.col("score_h") / 100)
        .withColumn("base_risk_score", F.col("base_h") / 100)
        .withColumn("behaviour_delta", F.col("delta_h") / 100)
    )


def behaviour_risk(events: DataFrame, warranties: DataFrame) -> DataFrame:
    """Rule-based risk of every pair with behaviour events or an owned warranty."""
    rows = events.select(*PAIR, "event_type").unionByName(
        warranties.where(F.col("user_id").isNotNull()).select(*PAIR, F.lit("owner").alias("event_type"))
    )
    kind = F.col("event_type")
    counts = rows.groupBy(*PAIR).agg(
        S.flag_count(kind == "nudge_dismissed").alias("dismissed"),
        S.flag_count(kind == "task_completed").alias("completed"),
        S.flag_count(kind == "issue_reported").alias("issues"),
    )
    known = warranties.select("warranty_id", "expiry_date", F.lit(True).alias("warranty_known"))
    parts = {
        "dismissed_nudges": F.least(F.col("dismissed") * 5, F.lit(25)),
        "recent_care": -F.least(F.col("completed") * 3, F.lit(15)),
        "recent_issue": F.least(F.col("issues") * 10, F.lit(30)),
        "expiry_known": F.when(F.col("expiry_date").isNotNull(), -5).otherwise(0),
    }
    total = F.lit(35)
    for part in parts.values():
        total = total + part
    entries = F.array(*[F.struct(F.lit(k).alias("k"), (v / 100).alias("v")) for k, v in parts.items()])
    value = F.col("value_h")
    return (
        counts.join(known, "warranty_id", "left")
        .withColumn("warranty_known", F.coalesce("warranty_known", F.lit(False)))
        .withColumn("value_h", S.clamp(total, 0, 100).cast("int"))
        .withColumn("band", F.when(value >= 75, "high").when(value >= 50, "medium").otherwise("low"))
        .withColumn("contributors", F.map_from_entries(F.filter(entries, lambda e: e["v"] != 0)))
    )


def latest_profile(profiles: DataFrame) -> DataFrame:
    """Newest profile per pair by id.

    One ``max_by`` per column keeps the buffers fixed-width, so the aggregation hashes instead of
    sorting; ids are unique, so the columns come from one row.
    """
    cols = [c for c in ("behaviour_h", "care_h", "resp_h", "aqi_band", "last_question_at", "product_type") if c in profiles.columns]
    return profiles.groupBy(*PAIR).agg(F.max("id").alias("id"), *[F.max_by(c, "id").alias(c) for c in cols])


def feature_vector(
    counts: DataFrame, warranties: DataFrame, profiles: DataFrame, as_of, product_type_override: str | None = None
) -> DataFrame:
    """The 12 risk features per pair with telemetry, plus the days of cover left."""
    newest = latest_profile(profiles.select("id", *PAIR, "behaviour_h", "care_h", "resp_h"))
    w = warranties.select("warranty_id", "product_name", "purchase_date", "expiry_date", "region_code", "climate_zone")
    label = F.coalesce(S.truthy(F.lit(product_type_override)), S.truthy(F.col("product_name")))
    half = F.lit(50)
    return (
        counts.join(newest, PAIR, "left")
        .join(w, "warranty_id", "left")
        .select(
            *PAIR,
            S.product_type_code(label).alias("product_type"),
            F.coalesce(S.age_months(F.col("purchase_date"), as_of), F.lit(0.0)).alias("age_months"),
            F.col("usage_hours_per_event").alias("usage_hours_per_day"),
            F.col("error_count").cast("double").alias("error_count"),
            F.col("failure_count").cast("double").alias("failure_count"),
            F.col("maintenance_count").cast("double").alias("maintenance_count"),
            (F.coalesce("behaviour_h", half) / 100).alias("behaviour_score"),
            (F.coalesce("care_h", half) / 100).alias("care_score"),
            (F.coalesce("resp_h", half) / 100).alias("responsiveness_score"),
            S.vocabulary_code(F.col("region_code")).cast("double").alias("region_code"),
            S.vocabulary_code(F.col("climate_zone"), C.CLIMATES).cast("double").alias("climate_band"),
            F.lit(0.0).alias("power_quality_band"),
            F.when(
                F.col("expiry_date").isNotNull(), F.greatest(F.lit(0), S.days_left(F.col("expiry_date"), as_of))
            ).alias("days_left"),
        )
    )


def model_reasons(features: DataFrame) -> DataFrame:
    """Reasons a model score is shown with: from the features, then from cover and maintenance."""
    f = F.col
    low = (f("behaviour_score") < 0.4) | (f("care_score") < 0.4) | (f("responsiveness_score") < 0.4)
    good = (f("behaviour_score") > 0.7) & (f("care_score") > 0.7) & (f("responsiveness_score") > 0.7)
    explained = F.slice(
        S.compact_texts(
            F.when(f("age_months") > 30, "Device is older and may see more wear.").when(
                f("age_months") < 12, "Device is relatively new."
            ),
            F.when(f("usage_hours_per_day") > 4, "High daily use.").otherwise("Light to moderate daily use."),
            F.when(f("error_count") >= 3, "Multiple errors recorded."),
            F.when(f("failure_count") >= 1, "Past breakdowns detected."),
            F.when(f("maintenance_count") == 0, "No maintenance recorded."),
            F.when(low, "Habits suggest limited care or responsiveness."),
            F.when(good, "Good care habits help keep risk low."),
        ),
        1,
        4,
    )
    context = S.compact_texts(
        F.when(f("days_left") <= 60, "Warranty is close to expiry.").when(
            f("days_left").isNotNull(), "Warranty still has time left."
        ),
        F.when(f("maintenance_count") == 0, "No maintenance recorded."),
    )
    return features.withColumn("explained", explained).withColumn(
        "base_reasons", F.concat("explained", context)
    )
