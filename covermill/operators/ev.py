"""EV battery jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR
from covermill.operators.telemetry import parse_payload

READINGS = ["daily_km", "fast_charge_sessions", "deep_discharge_events", "max_temp_seen", "region_climate_band"]


def features_from_telemetry(telemetry: DataFrame) -> DataFrame:
    """Default features per pair, replaced by the last reading each kind of event carries."""
    order = F.struct("ts", "id")
    last = lambda kind, field: F.max_by(
        F.col(f"p.{field}").cast("double"),
        F.when((F.col("event_type") == kind) & F.col(f"p.{field}").isNotNull(), order),
    )
    d = C.EV_DEFAULTS
    return (
        parse_payload(telemetry)
        .groupBy(*PAIR)
        .agg(
            F.coalesce(last("usage", "daily_km"), F.lit(float(d["daily_km"]))).alias("daily_km"),
            F.coalesce(last("failure", "deep_discharge_events"), F.lit(float(d["deep_discharge_events"]))).alias("deep_discharge_events"),
            F.coalesce(last("maintenance", "max_temp_seen"), F.lit(float(d["max_temp_seen"]))).alias("max_temp_seen"),
        )
        .withColumn("product_type", F.lit(d["product_type"]))
        .withColumn("age_months", F.lit(d["age_months"]))
        .withColumn("fast_charge_sessions", F.lit(float(d["fast_charge_sessions"])))
        .withColumn("region_climate_band", F.lit(float(d["region_climate_band"])))
    )


def override_by_latest(features: DataFrame, ev_telemetry: DataFrame) -> DataFrame:
    """Readings replaced by the non-null ones of the pair's newest EV telemetry row (by id)."""
    newest = ev_telemetry.groupBy(*PAIR).agg(*[F.max_by(c, "id").alias(f"n_{c}") for c in READINGS])
    df = features.join(newest, PAIR, "left")
    for c in READINGS:
        df = df.withColumn(c, F.coalesce(F.col(f"n_{c}").cast("double"), F.col(c)))
    return df.drop(*[f"n_{c}" for c in READINGS])


def with_habits(features: DataFrame, latest_profiles: DataFrame) -> DataFrame:
    """Adds the profile scores in hundredths, 50 without a profile."""
    cols = ["behaviour_h", "care_h", "resp_h"]
    df = features.join(latest_profiles.select(*PAIR, *cols), PAIR, "left")
    for c in cols:
        df = df.withColumn(c, F.coalesce(c, F.lit(50)))
    return df


def battery_score(features: DataFrame) -> DataFrame:
    """Rule-based EV battery risk in hundredths, label, reasons and suggestions."""
    f = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    checks = [
        (f("daily_km", 0.0) > 60, 20, "High daily kilometres."),
        (f("fast_charge_sessions", 0.0) > 8, 20, "Frequent fast charging."),
        (f("deep_discharge_events", 0.0) > 2, 20, "Battery often drops below 10%."),
        ((f("max_temp_seen", 25.0) > 40) | (f("region_climate_band", 0.0) >= 2), 15, "Used in hot conditions."),
        ((f("behaviour_h", 50) < 40) | (f("care_h", 50) < 40), 10, "Limited care habits."),
    ]
    score = F.lit(20)
    for cond, points, _ in checks:
        score = score + F.when(cond, points).otherwise(0)
    reasons = S.compact_texts(*[F.when(cond, text) for cond, _, text in checks])
    return (
        features.withColumn("ev_score_h", score)
        .withColumn("ev_label", F.when(F.col("ev_score_h") >= 66, "HIGH").when(F.col("ev_score_h") >= 40, "MEDIUM").otherwise("LOW"))
        .withColumn("ev_reasons", reasons)
        .withColumn("ev_reasons", F.when(F.size("ev_reasons") > 0, F.col("ev_reasons")).otherwise(F.array(F.lit("Light usage so far."))))
        .withColumn("ev_suggestions", S.text_array(C.EV_SUGGESTIONS))
    )


def model_texts(scored: DataFrame) -> DataFrame:
    """Reasons and suggestions that go with a model's score."""
    f = F.col
    checks = [
        f("daily_km") > 60,
        f("fast_charge_sessions") > 8,
        f("deep_discharge_events") > 2,
        (f("max_temp_seen") > 40) | (f("region_climate_band") >= 2),
        f("behaviour_h") < 40,
    ]
    reasons = F.slice(S.compact_texts(*[F.when(c, text) for c, text in zip(checks, C.EV_MODEL_REASONS, strict=True)]), 1, 4)
    return scored.withColumn("ev_reasons", reasons).withColumns(
        {
            "ev_reasons": F.when(F.size("ev_reasons") > 0, F.col("ev_reasons")).otherwise(F.array(F.lit(C.EV_MODEL_HEALTHY))),
            "ev_suggestions": S.text_array(C.EV_MODEL_SUGGESTIONS),
        }
    )
