"""Telemetry jobs: payload access, counts, risk from counts, and the recent behaviour signal.

Shuffle budget: the counts are merged before their one exchange on the pair, so a pair holding a
large share of all events still sends one row per input partition. The recent signal keeps the
newest 50 rows per pair before its exchange (see ``first_rows_per_key``); its further ranking and
aggregation reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermill.functions.scalars import PAIR, clamp, compact_texts, flag_count, truthy, ts_lit
from covermill.functions.topk import first_rows_per_key

PAYLOAD_SCHEMA = (
    "hours string, errors string, code string, message string, reason string, "
    "daily_km double, deep_discharge_events int, max_temp_seen double"
)


def _numbers(p: Column) -> Column:
    """Hours and errors as numbers, whether they came as numbers or as text; whole numbers may have a fraction of zero."""
    return p.withField("hours", p["hours"].try_cast("double")).withField("errors", p["errors"].try_cast("double").try_cast("int"))


def unique_events(*copies: DataFrame) -> DataFrame:
    """Events from several copies of the log, each counted once by id."""
    df = copies[0]
    for other in copies[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    return df.dropDuplicates(["id"])


def parse_payload(telemetry: DataFrame) -> DataFrame:
    """The payload's fields as columns; a missing, malformed or wrongly typed field is null.

    Only the fields a job uses are parsed: Catalyst prunes the parse schema.
    """
    p = F.from_json("payload", PAYLOAD_SCHEMA, {"mode": "PERMISSIVE"})
    return telemetry.withColumn("p", _numbers(p))


def usage_payload(telemetry: DataFrame) -> DataFrame:
    """Parses the payload of usage events only."""
    return telemetry.withColumn("p", F.when(_kind("usage"), _numbers(F.from_json("payload", "hours string, errors string"))))


def payload_fields(telemetry: DataFrame) -> DataFrame:
    """The fields scoring reads, with the defaults it assumes (an empty value counts as missing)."""
    df = parse_payload(telemetry)
    return df.select(
        "id",
        *PAIR,
        "event_type",
        "ts",
        F.coalesce("p.hours", F.lit(0.0)).alias("hours"),
        F.coalesce("p.errors", F.lit(0)).alias("errors"),
        F.when(
            F.col("event_type") == "error",
            F.coalesce(truthy(F.col("p.code")), truthy(F.col("p.message")), F.lit("unknown_error")),
        )
        .when(F.col("event_type") == "failure", F.coalesce(truthy(F.col("p.reason")), F.lit("unspecified_failure")))
        .alias("reason"),
    )


def _kind(name: str) -> Column:
    return F.col("event_type") == name


def telemetry_counts(telemetry: DataFrame) -> DataFrame:
    """One row per pair: events per kind, usage hours, hours per usage event."""
    return (
        usage_payload(telemetry)
        .groupBy(*PAIR)
        .agg(
            F.coalesce(F.sum("p.hours"), F.lit(0.0)).alias("usage_hours"),
            flag_count(_kind("usage")).alias("usage_events"),
            flag_count(_kind("error")).alias("error_count"),
            flag_count(_kind("failure")).alias("failure_count"),
            flag_count(_kind("maintenance")).alias("maintenance_count"),
        )
        .withColumn("usage_hours_per_event", F.col("usage_hours") / F.greatest(F.lit(1), F.col("usage_events")))
    )


def base_risk(counts: DataFrame) -> DataFrame:
    """Rule-based score in hundredths from the counts, with the reasons for it."""
    high_usage = F.col("usage_hours") > 100
    score = (
        F.lit(20)
        + F.when(high_usage, 15).otherwise(0)
        + F.least(F.col("error_count") * 5, F.lit(30))
        + F.least(F.col("failure_count") * 20, F.lit(40))
        - F.least(F.col("maintenance_count") * 3, F.lit(15))
    )
    return counts.withColumn("base_h", clamp(score, 0, 100).cast("int")).withColumn(
        "base_reasons",
        compact_texts(
            F.when(high_usage, "High usage hours"),
            F.when(F.col("error_count") > 0, F.concat(F.col("error_count").cast("string"), F.lit(" error events"))),
            F.when(F.col("failure_count") > 0, F.concat(F.col("failure_count").cast("string"), F.lit(" recorded failures"))),
            F.when(F.col("maintenance_count") > 0, "Recent maintenance lowers risk"),
        ),
    )


def suggested_questions(telemetry: DataFrame) -> DataFrame:
    """Follow-up questions per pair for the kinds of telemetry that are missing."""
    seen = telemetry.groupBy(*PAIR).agg(
        *[F.max(_kind(k)).alias(k) for k in ("maintenance", "error", "usage")],
    )
    return seen.select(*PAIR, questions_for(F.col("maintenance"), F.col("error"), F.col("usage")).alias("questions"))


def questions_for(maintenance: Column, error: Column, usage: Column) -> Column:
    return compact_texts(
        F.when(~maintenance, "When was the last maintenance or cleaning performed?"),
        F.when(error, "Have you noticed specific conditions when errors appear (load, temperature, firmware)?"),
        F.when(~usage, "How many hours per day/week do you use the product?"),
        F.lit("Any unusual noises, smells, or performance drops recently?"),
    )


def top_failure_reasons(telemetry: DataFrame, k: int = 5) -> DataFrame:
    """The heaviest failure reasons over all events: an error weighs 1, a failure 2."""
    weighed = payload_fields(telemetry.where(F.col("event_type").isin("error", "failure")))
    return (
        weighed.groupBy("reason")
        .agg(F.sum(F.when(_kind("failure"), 2).otherwise(1)).alias("weight"))
        .orderBy(F.desc("weight"), "reason")
        .limit(k)
    )


def signal_events(telemetry: DataFrame) -> DataFrame:
    """What the recent signal looks at, per event."""
    return usage_payload(telemetry).select(
        *PAIR,
        "event_type",
        "ts",
        "id",
        F.coalesce("p.hours", F.lit(0.0)).alias("hours"),
        F.coalesce("p.errors", F.lit(0)).alias("errors"),
    )


def recent_signal(telemetry: DataFrame, as_of, window_days: int = 30, max_events: int = 50) -> DataFrame:
    """Usage intensity and error burden per pair with events in the window."""
    cutoff = ts_lit(as_of) - F.expr(f"INTERVAL {window_days} DAYS")
    return signal_of(signal_events(telemetry.where(F.col("ts") >= cutoff)), max_events)


def signal_of(events: DataFrame, max_events: int = 50) -> DataFrame:
    """The signal of each pair in a window's ``signal_events``.

    The newest ``max_events`` events of the pair count; of those, the last 10 usage and the last 5
    error events.
    """
    newest = [F.desc("ts"), F.desc("id")]
    recent = first_rows_per_key(events, PAIR, newest, max_events)
    ranked = recent.withColumn(
        "kind_rank", F.row_number().over(Window.partitionBy(*PAIR, "event_type").orderBy(*newest))
    )
    last = _kind("usage") & (F.col("kind_rank") == 1)
    used = _kind("usage") & (F.col("kind_rank") <= 10)
    return (
        ranked.groupBy(*PAIR)
        .agg(
            F.coalesce(F.max(F.when(last, F.col("hours"))), F.lit(0.0)).alias("last_hours"),
            F.coalesce(F.sum(F.when(used, F.col("hours"))), F.lit(0.0)).alias("hours_window"),
            flag_count(used).alias("used"),
            (
                F.coalesce(F.max(F.when(last, F.col("errors"))), F.lit(0))
                + flag_count(_kind("error") & (F.col("kind_rank") <= 5))
            ).alias("error_burden"),
        )
        .withColumn("avg_hours", F.col("hours_window") / F.greatest(F.lit(1), F.col("used")))
        .drop("used")
    )


def with_signal(pairs: DataFrame, recent: DataFrame) -> DataFrame:
    """Adds the behaviour delta and its reasons to pairs that have telemetry.

    A pair without recent events counts as lightly used and free of errors.
    """
    df = pairs.join(recent, PAIR, "left")
    for name in ("last_hours", "hours_window", "avg_hours"):
        df = df.withColumn(name, F.coalesce(name, F.lit(0.0)))
    df = df.withColumn("error_burden", F.coalesce("error_burden", F.lit(0)))
    burden = F.col("error_burden")
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    intensity = F.when(F.col("last_hours") < 10, "low").when(F.col("avg_hours") < 500, "medium").otherwise("high")
    use = F.col("usage_intensity")
    delta = F.when(use == "low", -12).when(use == "medium", 5).otherwise(18) + F.when(burden == 0, -2).when(
        burden <= 3, 8
    ).otherwise(20)
    return (
        df.withColumn("usage_intensity", intensity)
        .withColumn("delta_h", clamp(delta, -25, 25))
        .withColumn(
            "signal_reasons",
            compact_texts(
                F.when(use == "low", F.concat(F.lit("Light recent usage ("), whole("last_hours"), F.lit(" hrs last event)")))
                .when(use == "medium", F.concat(F.lit("Moderate usage ("), whole("avg_hours"), F.lit(" hrs avg recent)")))
                .otherwise(F.concat(F.lit("Heavy use ("), whole("hours_window"), F.lit(" hrs recent window)"))),
                F.when(burden == 0, F.lit(None).cast("string"))
                .when(burden <= 3, F.concat(F.lit("Some errors recorded ("), burden.cast("string"), F.lit(")")))
                .otherwise(F.concat(F.lit("Multiple recent errors ("), burden.cast("string"), F.lit(")"))),
            ),
        )
    )


def behaviour_signal(telemetry: DataFrame, as_of) -> DataFrame:
    return with_signal(telemetry.select(*PAIR).distinct(), recent_signal(telemetry, as_of))
