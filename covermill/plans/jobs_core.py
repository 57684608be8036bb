"""Telemetry, risk, behaviour and EV queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR
from covermill.operators import behaviour as B
from covermill.operators import ev as EV
from covermill.operators import oem as O
from covermill.operators import risk as R
from covermill.operators import telemetry as T
from covermill.plans.oracle_views import AS_OF as NOW
from covermill.plans.oracle_views import AS_OF_DAY as TODAY
from covermill.plans.oracle_views import quoted, text_list
from covermill.plans.registry import big, instant, joined, register
from covermill.sources.domain import AS_OF, LATE

QUESTIONS = (
    "When was the last maintenance or cleaning performed?",
    "Have you noticed specific conditions when errors appear (load, temperature, firmware)?",
    "How many hours per day/week do you use the product?",
    "Any unusual noises, smells, or performance drops recently?",
)


def scores(d):
    return R.risk_score(d.telemetry(), AS_OF)


@register(
    "risk_score",
    """SELECT user_id, warranty_id, CAST(score_h AS DOUBLE) / 100 AS risk_score, risk_label, CAST(base_h AS DOUBLE) / 100 AS base_risk_score,
    CAST(delta_h AS DOUBLE) / 100 AS behaviour_delta, array_to_string(reasons, '|') AS reasons, array_to_string(signal_reasons, '|') AS behaviour_reasons FROM v_score""",
)
def risk_score(d):
    return scores(d).select(
        *PAIR, "risk_score", "risk_label", "base_risk_score", "behaviour_delta",
        joined("reasons").alias("reasons"), joined("behaviour_reasons").alias("behaviour_reasons"),
    )


@register(
    "telemetry_scan",
    f"""SELECT id, user_id, warranty_id, event_type, payload, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM v_telemetry""",
)
def telemetry_scan(d):
    """Two copies of the log read as one; every event is counted once."""
    both = T.unique_events(d.telemetry(), d.telemetry())
    return both.select("id", *PAIR, "event_type", "payload", instant("ts").alias("ts"))


@register(
    "telemetry_payload",
    """SELECT id, user_id, warranty_id, event_type, CAST(coalesce(TRY_CAST(json_extract_string(payload, '$.hours') AS DOUBLE), 0) AS DOUBLE) AS hours,
      CAST(coalesce(TRY_CAST(json_extract_string(payload, '$.errors') AS BIGINT), 0) AS BIGINT) AS errors,
      CASE event_type WHEN 'error' THEN coalesce(nullif(json_extract_string(payload, '$.code'), ''), nullif(json_extract_string(payload, '$.message'), ''), 'unknown_error')
        WHEN 'failure' THEN coalesce(nullif(json_extract_string(payload, '$.reason'), ''), 'unspecified_failure') END AS reason FROM v_telemetry""",
)
def telemetry_payload(d):
    return T.payload_fields(d.telemetry()).select("id", *PAIR, "event_type", "hours", big("errors").alias("errors"), "reason")


@register(
    "telemetry_risk",
    """SELECT user_id, warranty_id, CAST(base_h AS DOUBLE) / 100 AS score, CASE WHEN base_h > 66 THEN 'HIGH' WHEN base_h >= 33 THEN 'MEDIUM' ELSE 'LOW' END AS label,
      array_to_string(list_filter([CASE WHEN usage_hours > 100 THEN 'High usage hours' END, CASE WHEN errors > 0 THEN errors || ' error events' END,
            CASE WHEN failures > 0 THEN failures || ' recorded failures' END, CASE WHEN maintenance > 0 THEN 'Recent maintenance lowers risk' END], lambda x: x IS NOT NULL), '|') AS reasons FROM v_base_risk""",
)
def telemetry_risk(d):
    df = T.base_risk(T.telemetry_counts(d.telemetry()))
    return df.select(*PAIR, (F.col("base_h") / 100).alias("score"), S.label_of(F.col("base_h")).alias("label"), joined("base_reasons").alias("reasons"))


@register(
    "telemetry_counts",
    """SELECT user_id, warranty_id, CAST(usage_hours AS DOUBLE) AS usage_hours, usage_events, errors AS error_count, failures AS failure_count, maintenance AS maintenance_count,
      CAST(usage_hours AS DOUBLE) / greatest(1, usage_events) AS usage_hours_per_event FROM v_base_risk""",
)
def telemetry_counts(d):
    return T.telemetry_counts(d.telemetry())


_SIGNAL_SQL = """SELECT user_id, warranty_id, intensity AS usage_intensity, CAST(burden AS BIGINT) AS error_burden, CAST(delta_h AS DOUBLE) / 100 AS behaviour_delta,
      CAST(total_hours AS DOUBLE) AS hours_window, array_to_string(signal_reasons, '|') AS reasons FROM {view}"""


@register("behaviour_signal", _SIGNAL_SQL.format(view="v_signal"))
def behaviour_signal(d):
    return T.behaviour_signal(d.telemetry(), AS_OF).select(
        *PAIR, "usage_intensity", big("error_burden").alias("error_burden"), (F.col("delta_h") / 100).alias("behaviour_delta"),
        "hours_window", joined("signal_reasons").alias("reasons"),
    )


@register("behaviour_signal_late", _SIGNAL_SQL.format(view="v_signal_late"))
def behaviour_signal_late(d):
    """The signal at a day when the window leaves events out and some pairs have gone silent."""
    return T.behaviour_signal(d.telemetry(), LATE).select(
        *PAIR, "usage_intensity", big("error_burden").alias("error_burden"), (F.col("delta_h") / 100).alias("behaviour_delta"),
        "hours_window", joined("signal_reasons").alias("reasons"),
    )


@register(
    "suggested_questions",
    f"""SELECT user_id, warranty_id, array_to_string(list_filter([CASE WHEN NOT bool_or(event_type = 'maintenance') THEN {quoted(QUESTIONS[0])} END,
      CASE WHEN bool_or(event_type = 'error') THEN {quoted(QUESTIONS[1])} END, CASE WHEN NOT bool_or(event_type = 'usage') THEN {quoted(QUESTIONS[2])} END, {quoted(QUESTIONS[3])}],
      lambda x: x IS NOT NULL), '|') AS questions FROM v_telemetry GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY user_id, warranty_id"),
)
def suggested_questions(d):
    return T.suggested_questions(d.telemetry()).select(*PAIR, joined("questions").alias("questions"))


@register(
    "failure_reasons_top",
    """SELECT reason, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT CASE event_type WHEN 'error' THEN json_extract_string(payload, '$.code') ELSE json_extract_string(payload, '$.reason') END AS reason,
      CASE event_type WHEN 'failure' THEN 2 ELSE 1 END AS w FROM v_telemetry WHERE event_type IN ('error', 'failure')) GROUP BY reason ORDER BY weight DESC, reason LIMIT 5""",
)
def failure_reasons_top(d):
    return T.top_failure_reasons(d.telemetry())


@register(
    "behaviour_risk",
    """SELECT user_id, warranty_id, CAST(value_h AS DOUBLE) / 100 AS value, band, concat_ws('|',
      CASE WHEN dismissed > 0 THEN 'dismissed_nudges=' || least(5 * dismissed, 25) END, CASE WHEN expiry_date IS NOT NULL THEN 'expiry_known=-5' END,
      CASE WHEN completed > 0 THEN 'recent_care=' || -least(3 * completed, 15) END, CASE WHEN issues > 0 THEN 'recent_issue=' || least(10 * issues, 30) END) AS contributors
    FROM v_behaviour_risk""",
)
def behaviour_risk(d):
    df = R.behaviour_risk(d.behaviour_event(), d.warranty())
    entries = F.transform(
        F.array_sort(F.map_entries("contributors")),
        lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("int").cast("string")),
    )
    return df.select(*PAIR, (F.col("value_h") / 100).alias("value"), "band", joined(entries).alias("contributors"))


def features(d):
    return R.feature_vector(T.telemetry_counts(d.telemetry()), d.warranty(), d.profile(), AS_OF)


_FEATURES_SQL = f"""SELECT b.user_id, b.warranty_id,
  CASE WHEN product_name IS NULL THEN 0.0 WHEN contains(lower(product_name), 'fridge') OR lower(product_name) = 'refrigerator' THEN 1.0
    WHEN contains(lower(product_name), 'ac') OR contains(lower(product_name), 'air') THEN 2.0
    WHEN regexp_matches(lower(product_name), '^[0-9]+$') THEN TRY_CAST(product_name AS DOUBLE) ELSE 0.0 END::DOUBLE AS product_type,
  coalesce(greatest(0, CAST({TODAY} - purchase_date AS DOUBLE) / 30), 0)::DOUBLE AS age_months,
  CAST(usage_hours AS DOUBLE) / greatest(1, usage_events) AS usage_hours_per_day, errors::DOUBLE AS error_count, failures::DOUBLE AS failure_count, maintenance::DOUBLE AS maintenance_count,
  CAST(coalesce(behaviour_h, 50) AS DOUBLE) / 100 AS behaviour_score, CAST(coalesce(care_h, 50) AS DOUBLE) / 100 AS care_score, CAST(coalesce(resp_h, 50) AS DOUBLE) / 100 AS responsiveness_score,
  CASE WHEN regexp_matches(region_code, '^[0-9]+$') THEN CAST(region_code AS DOUBLE) ELSE 0 END::DOUBLE AS region_code,
  coalesce(list_position({text_list(C.CLIMATES)}, climate_zone) - 1, 0)::DOUBLE AS climate_band, 0::DOUBLE AS power_quality_band,
  CAST(CASE WHEN expiry_date IS NULL THEN 0 ELSE greatest(0, expiry_date - {TODAY}) END AS BIGINT) AS days_left, expiry_date IS NOT NULL AS has_expiry
  FROM v_base_risk b LEFT JOIN v_warranty w USING (warranty_id) LEFT JOIN v_latest_profile p ON p.user_id = b.user_id AND p.warranty_id = b.warranty_id"""


@register("risk_feature_vector", f"SELECT * EXCLUDE (has_expiry, days_left), CASE WHEN has_expiry THEN days_left END AS days_left FROM ({_FEATURES_SQL})")
def risk_feature_vector(d):
    return features(d).withColumn("days_left", big("days_left"))


MODEL_REASONS_SQL = f"""SELECT user_id, warranty_id, e, list_concat(e, list_filter([CASE WHEN has_expiry AND days_left <= 60 THEN 'Warranty is close to expiry.'
        WHEN has_expiry THEN 'Warranty still has time left.' END, CASE WHEN maintenance_count = 0 THEN 'No maintenance recorded.' END], lambda x: x IS NOT NULL)) AS base FROM (
      SELECT *, list_filter([CASE WHEN age_months > 30 THEN 'Device is older and may see more wear.' WHEN age_months < 12 THEN 'Device is relatively new.' END,
        CASE WHEN usage_hours_per_day > 4 THEN 'High daily use.' ELSE 'Light to moderate daily use.' END, CASE WHEN error_count >= 3 THEN 'Multiple errors recorded.' END,
        CASE WHEN failure_count >= 1 THEN 'Past breakdowns detected.' END, CASE WHEN maintenance_count = 0 THEN 'No maintenance recorded.' END,
        CASE WHEN behaviour_score < 0.4 OR care_score < 0.4 OR responsiveness_score < 0.4 THEN 'Habits suggest limited care or responsiveness.' END,
        CASE WHEN behaviour_score > 0.7 AND care_score > 0.7 AND responsiveness_score > 0.7 THEN 'Good care habits help keep risk low.' END], lambda x: x IS NOT NULL)[1:4] AS e FROM ({_FEATURES_SQL}))"""


@register("risk_reasons", f"SELECT user_id, warranty_id, array_to_string(e, '|') AS explained, array_to_string(base, '|') AS base_reasons FROM ({MODEL_REASONS_SQL})")
def risk_reasons(d):
    return R.model_reasons(features(d)).select(*PAIR, joined("explained").alias("explained"), joined("base_reasons").alias("base_reasons"))


@register(
    "risk_band",
    """SELECT id, behaviour_h, CASE WHEN behaviour_h < 33 THEN 'LOW' WHEN behaviour_h < 66 THEN 'MEDIUM' ELSE 'HIGH' END AS band_of_score,
      CASE WHEN behaviour_h > 66 THEN 'HIGH' WHEN behaviour_h >= 33 THEN 'MEDIUM' ELSE 'LOW' END AS final_label,
      CASE WHEN upper(product_type) IN ('LOW', 'MEDIUM', 'HIGH') THEN upper(product_type) WHEN product_type IS NULL THEN 'MEDIUM' WHEN behaviour_h < 33 THEN 'LOW' WHEN behaviour_h < 66 THEN 'MEDIUM' ELSE 'HIGH' END AS band_without_score
    FROM v_profile""",
)
def risk_band(d):
    h = F.col("behaviour_h")
    kind = F.col("product_type")
    return d.profile().select(
        "id", "behaviour_h", S.band_of(F.lit(None).cast("string"), h).alias("band_of_score"), S.label_of(h).alias("final_label"),
        S.band_of(kind, F.when(kind.isNotNull(), h)).alias("band_without_score"),
    )


@register("latest_profile", "SELECT user_id, warranty_id, id, behaviour_h, care_h, resp_h, aqi_band FROM v_latest_profile")
def latest_profile(d):
    return R.latest_profile(d.profile()).select(*PAIR, "id", "behaviour_h", "care_h", "resp_h", "aqi_band")


_TYPED = """SELECT a.*, CASE WHEN nullif(a.product_type, '') IS NOT NULL THEN a.product_type WHEN contains(lower(w.product_name), 'fridge') THEN 'fridge'
  WHEN contains(lower(w.product_name), 'ac') OR contains(lower(w.product_name), 'air') THEN 'ac' WHEN contains(lower(w.product_name), 'wash') THEN 'washer'
  ELSE nullif(w.model_code, '') END AS pt FROM {src} a LEFT JOIN v_warranty w USING (warranty_id)"""


@register(
    "behaviour_profile",
    f"""SELECT user_id, pt AS product_type, warranty_id, CAST(count(*) AS BIGINT) AS answers,
      CAST(list_reduce(list_transform(list(struct_pack(t := created_at, i := id, a := lower(answer_value)) ORDER BY created_at, id), lambda x: CASE
          WHEN x.a IN ('yes', 'y', 'true', '1', '5') THEN 1 WHEN x.a IN ('no', 'n', 'false', '0') THEN 2 WHEN x.a = '2' THEN 3 ELSE 0 END + CASE WHEN x.a = '1' THEN 10 ELSE 0 END),
        lambda s, x: CASE x WHEN 1 THEN least(100, s + 1) WHEN 11 THEN greatest(0, least(100, s + 1) - 5) WHEN 2 THEN greatest(0, s - 2) WHEN 3 THEN greatest(0, s - 5) ELSE s END, 50) AS BIGINT) AS behaviour_h,
      CAST(least(100, 50 + 3 * count(*) FILTER (lower(answer_value) IN ('yes', 'y', 'true', '1', '5'))) AS BIGINT) AS care_h,
      CAST(least(100, 50 + 2 * count(*) + 2 * count(*) FILTER (lower(answer_value) IN ('4', '5'))) AS BIGINT) AS resp_h,
      strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') AS last_question_at
    FROM ({_TYPED.format(src='v_answer')}) GROUP BY user_id, pt, warranty_id""",
)
def behaviour_profile(d):
    return B.behaviour_profiles(d.answer(), d.warranty()).select(
        *B.PROFILE_KEY, "answers", *[big(c).alias(c) for c in ("behaviour_h", "care_h", "resp_h")], instant("last_question_at").alias("last_question_at")
    )


_PAIRS = "SELECT user_id, warranty_id FROM v_event UNION SELECT user_id, warranty_id FROM v_warranty"


def asking_pairs(d):
    """Every pair with events or a warranty, with its warranty's brand."""
    pairs = d.event().select(*PAIR).unionByName(d.warranty().select(*PAIR)).distinct()
    return pairs.join(d.warranty().select("warranty_id", "brand", "model_code"), "warranty_id", "left")


def oem_questions(d):
    return O.disable_by_log(O.normalize_questions(d.oem_question_raw()), d.oem_question_disabled(), "enabled", False)


@register(
    "next_question",
    f"""SELECT user_id, warranty_id, coalesce(oq, bq) AS question_id, CASE WHEN oq IS NOT NULL THEN 'oem_question_available' WHEN bq IS NOT NULL THEN 'question_available' ELSE 'no_question_available' END AS reason, coalesce(oq, bq) IS NULL AS done FROM (
      SELECT p.user_id, p.warranty_id,
        (SELECT arg_min(q.id, q.priority * 1000000 + q.seq) FROM v_oem_question q WHERE q.enabled AND (p.brand IS NULL OR q.brand = p.brand)
          AND NOT EXISTS (SELECT 1 FROM v_oem_answer a WHERE a.user_id = p.user_id AND a.warranty_id = p.warranty_id AND a.question_id = q.id)) AS oq,
        (SELECT min(id) FROM (SELECT unnest({text_list(q[0] for q in C.QUESTION_BANK)}) AS id) b
          WHERE NOT EXISTS (SELECT 1 FROM v_answer a WHERE a.user_id = p.user_id AND a.warranty_id = p.warranty_id AND a.question_id = b.id)) AS bq
      FROM (SELECT x.user_id, x.warranty_id, w.brand FROM ({_PAIRS}) x LEFT JOIN v_warranty w USING (warranty_id)) p)""",
)
def next_question(d):
    pairs = asking_pairs(d).withColumn("model_code", F.lit(None).cast("string")).withColumn("product_type", F.lit(None).cast("string"))
    q = oem_questions(d).where("enabled")
    return B.next_question(pairs, d.answer(), q, d.oem_answer()).select(*PAIR, "question_id", "reason", "done")


@register(
    "scoped_questions",
    f"""SELECT a.user_id, a.warranty_id, arg_min(q.id, -q.weight * 1000000 + q.id) AS question_id
      FROM (SELECT t.*, l.last_question_at FROM ({_TYPED.format(src='(SELECT x.*, NULL::VARCHAR AS product_type FROM (' + _PAIRS + ') x)')}) t
        LEFT JOIN (SELECT * FROM v_profile QUALIFY row_number() OVER (PARTITION BY user_id, warranty_id, product_type ORDER BY id DESC) = 1) l
        ON l.user_id = t.user_id AND l.warranty_id IS NOT DISTINCT FROM t.warranty_id AND l.product_type IS NOT DISTINCT FROM t.pt) a
      LEFT JOIN v_warranty w USING (warranty_id) JOIN v_scoped_question q ON q.is_active = 1 AND (q.brand IS NULL OR q.brand = w.brand)
        AND (q.model_code IS NULL OR q.model_code = w.model_code) AND (q.product_type IS NULL OR q.product_type = a.pt)
      WHERE (a.last_question_at IS NULL OR a.last_question_at <= {NOW} - INTERVAL 7 DAY)
        AND NOT EXISTS (SELECT 1 FROM ({_TYPED.format(src='v_scoped_answer')}) s WHERE s.user_id = a.user_id AND s.pt IS NOT DISTINCT FROM a.pt AND s.question_id = q.id)
      GROUP BY a.user_id, a.warranty_id""",
)
def scoped_questions(d):
    asks = asking_pairs(d).withColumn("product_type", F.lit(None).cast("string"))
    profiles = d.profile().select("id", *B.PROFILE_KEY, "last_question_at")
    return B.scoped_question(asks, d.scoped_question(), d.scoped_answer(), profiles, d.warranty(), AS_OF).select(*PAIR, "question_id")


# --- EV ----------------------------------------------------------------------------------------------

_EV_BASE = """SELECT user_id, warranty_id, coalesce(arg_max(km, (ts, id)) FILTER (km IS NOT NULL), 40)::DOUBLE AS daily_km, 4::DOUBLE AS fast_charge_sessions,
  coalesce(arg_max(deep, (ts, id)) FILTER (deep IS NOT NULL), 1)::DOUBLE AS deep_discharge_events, coalesce(arg_max(temp, (ts, id)) FILTER (temp IS NOT NULL), 32)::DOUBLE AS max_temp_seen,
  1::DOUBLE AS region_climate_band FROM v_ev_payload GROUP BY user_id, warranty_id"""
_EV_LATEST = "SELECT * FROM v_ev_telemetry QUALIFY row_number() OVER (PARTITION BY user_id, warranty_id ORDER BY id DESC) = 1"
_EV_OVER = f"""SELECT b.user_id, b.warranty_id, coalesce(t.daily_km, b.daily_km)::DOUBLE AS daily_km, coalesce(t.fast_charge_sessions, b.fast_charge_sessions)::DOUBLE AS fast_charge_sessions,
  coalesce(t.deep_discharge_events, b.deep_discharge_events)::DOUBLE AS deep_discharge_events, coalesce(t.max_temp_seen, b.max_temp_seen)::DOUBLE AS max_temp_seen,
  coalesce(t.region_climate_band, b.region_climate_band)::DOUBLE AS region_climate_band FROM ({_EV_BASE}) b LEFT JOIN ({_EV_LATEST}) t USING (user_id, warranty_id)"""


def ev_scored(features_sql: str) -> str:
    """DuckDB SQL of the EV score over rows that carry readings and profile scores."""
    return f"""SELECT *, CASE WHEN h >= 66 THEN 'HIGH' WHEN h >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS ev_label FROM (SELECT *, 20 + CASE WHEN c1 THEN 20 ELSE 0 END + CASE WHEN c2 THEN 20 ELSE 0 END
      + CASE WHEN c3 THEN 20 ELSE 0 END + CASE WHEN c4 THEN 15 ELSE 0 END + CASE WHEN c5 THEN 10 ELSE 0 END AS h FROM (
      SELECT *, daily_km > 60 AS c1, fast_charge_sessions > 8 AS c2, deep_discharge_events > 2 AS c3, max_temp_seen > 40 OR region_climate_band >= 2 AS c4,
        behaviour_h < 40 OR care_h < 40 AS c5 FROM ({features_sql})))"""


def ev_features_of(d):
    return EV.features_from_telemetry(d.ev_payload_telemetry())


def ev_rated(d, telemetry):
    """EV features of every pair with telemetry: its readings and its habits."""
    df = EV.override_by_latest(EV.features_from_telemetry(telemetry), d.ev_telemetry())
    habits = R.latest_profile(d.profile().select("id", *PAIR, "behaviour_h", "care_h", "resp_h"))
    return EV.with_habits(df, habits)


def ev_scores(d):
    return EV.battery_score(ev_rated(d, d.ev_payload_telemetry()))


EV_SCORE_SQL = ev_scored(
    f"""SELECT e.*, coalesce(p.behaviour_h, 50) AS behaviour_h, coalesce(p.care_h, 50) AS care_h FROM ({_EV_OVER}) e LEFT JOIN v_latest_profile p ON p.user_id = e.user_id AND p.warranty_id = e.warranty_id"""
)


@register("ev_features", _EV_BASE)
def ev_features(d):
    return ev_features_of(d).select(*PAIR, *EV.READINGS)


@register("ev_latest_override", _EV_OVER)
def ev_latest_override(d):
    return EV.override_by_latest(ev_features_of(d), d.ev_telemetry()).select(*PAIR, *EV.READINGS)


@register(
    "ev_battery_score",
    f"""SELECT user_id, warranty_id, CAST(h AS DOUBLE) / 100 AS risk_score, ev_label AS risk_label, CASE WHEN c1 OR c2 OR c3 OR c4 OR c5 THEN concat_ws('|', CASE WHEN c1 THEN 'High daily kilometres.' END,
      CASE WHEN c2 THEN 'Frequent fast charging.' END, CASE WHEN c3 THEN 'Battery often drops below 10%.' END, CASE WHEN c4 THEN 'Used in hot conditions.' END, CASE WHEN c5 THEN 'Limited care habits.' END)
      ELSE 'Light usage so far.' END AS reasons, {quoted('|'.join(C.EV_SUGGESTIONS))} AS suggestions FROM ({EV_SCORE_SQL})""",
)
def ev_battery_score(d):
    return ev_scores(d).select(
        *PAIR, (F.col("ev_score_h") / 100).alias("risk_score"), F.col("ev_label").alias("risk_label"),
        joined("ev_reasons").alias("reasons"), joined("ev_suggestions").alias("suggestions"),
    )
