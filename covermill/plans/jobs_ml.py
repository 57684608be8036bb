"""Model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR
from covermill.operators import ev as EV
from covermill.operators import ml as M
from covermill.operators import nudges as N
from covermill.operators import risk as R
from covermill.operators import signals as G
from covermill.operators import telemetry as T
from covermill.plans.jobs_core import EV_SCORE_SQL, MODEL_REASONS_SQL, ev_rated, ev_scores, features
from covermill.plans.jobs_domain import PEER_SQL, peer_input
from covermill.plans.oracle_views import AS_OF_DAY as TODAY
from covermill.plans.oracle_views import quoted
from covermill.plans.registry import joined, register
from covermill.session import shared_dir
from covermill.sources.domain import AS_OF


def _hot_sql(value: str, vocab: list[str], prefix: str) -> str:
    return ", ".join(f"CASE WHEN {value} = '{v}' THEN 1 ELSE 0 END AS {prefix}_{v}" for v in vocab)


@register("one_hot_features", f"SELECT warranty_id, {_hot_sql('lower(region_code)', C.REGIONS, 'region')}, {_hot_sql('climate_zone', C.CLIMATES, 'climate')} FROM v_warranty")
def one_hot_features(d):
    return d.warranty().select("warranty_id", *S.one_hot(F.lower("region_code"), C.REGIONS, "region"), *S.one_hot(F.col("climate_zone"), C.CLIMATES, "climate"))


#: Models learn from what was known before this day, their labels are the failures from then on.
CUTOFF = "2024-01-16 00:00:00"


def before(df, column, cutoff):
    return df if cutoff is None else df.where(F.col(column) < S.ts_lit(cutoff))


def v2_table(d, cutoff=None):
    profile = R.latest_profile(d.profile().select("id", *PAIR, "behaviour_h", "care_h", "resp_h"))
    searches = before(d.symptom_search(), "created_at", cutoff)
    return M.v2_features(
        T.telemetry_counts(before(d.telemetry(), "ts", cutoff)), d.warranty(), profile, N.nudge_stats(before(d.nudge_event(), "shown_at", cutoff)),
        G.peer_features(peer_input(d), d.peer_signal()), G.search_features(searches), G.search_components(searches), cutoff or AS_OF,
    )


@register(
    "v2_feature_table",
    f"""SELECT b.user_id, b.warranty_id, CAST(usage_hours AS DOUBLE) AS usage_hours, errors::DOUBLE AS errors, failures::DOUBLE AS failures, maintenance::DOUBLE AS maintenance,
      coalesce(greatest(0, CAST({TODAY} - purchase_date AS DOUBLE) / 30), 0)::DOUBLE AS months_used, coalesce(expiry_date - {TODAY}, 0)::DOUBLE AS days_to_expiry,
      CASE WHEN expiry_date - {TODAY} < 0 THEN 1 ELSE 0 END::DOUBLE AS is_out_of_coverage, CAST(coalesce(behaviour_h, 50) AS DOUBLE) / 100 AS behaviour_score,
      CAST(coalesce(care_h, 50) AS DOUBLE) / 100 AS care_score, CAST(coalesce(resp_h, 50) AS DOUBLE) / 100 AS response_speed_score,
      coalesce(n.shown, 0)::DOUBLE AS nudges_shown, coalesce(n.acted, 0)::DOUBLE AS nudges_acted, coalesce(n.ignored, 0)::DOUBLE AS nudges_ignored,
      coalesce(r.avg_rating, 0)::DOUBLE AS avg_rating, coalesce(r.review_sentiment, 0)::DOUBLE AS review_sentiment, coalesce(r.failure_keyword_count, 0)::DOUBLE AS failure_keyword_count,
      coalesce(s.n, 0)::DOUBLE AS search_count, coalesce(s.open, 0)::DOUBLE AS unresolved_search_count, coalesce(w.oem_risk_factor, 0)::DOUBLE AS oem_risk_factor,
      coalesce(w.brand_reliability_score, 0)::DOUBLE AS brand_reliability_score, {_hot_sql('lower(region_code)', C.REGIONS, 'region')}, {_hot_sql('climate_zone', C.CLIMATES, 'climate')},
      {_hot_sql('f.component', C.COMPONENTS, 'component')}
    FROM v_base_risk b LEFT JOIN v_warranty w USING (warranty_id) LEFT JOIN v_latest_profile p ON p.user_id = b.user_id AND p.warranty_id = b.warranty_id
    LEFT JOIN (SELECT user_id, warranty_id, count(*) AS shown, count(acted_at) AS acted, count(*) FILTER (ignored_at IS NOT NULL AND acted_at IS NULL) AS ignored FROM v_nudge_event GROUP BY 1, 2) n
      ON n.user_id = b.user_id AND n.warranty_id = b.warranty_id
    LEFT JOIN ({PEER_SQL}) r ON r.warranty_id = b.warranty_id
    LEFT JOIN (SELECT user_id, warranty_id, count(*) AS n, count(*) FILTER (nullif(matched_component, '') IS NULL) AS open FROM v_symptom_search GROUP BY 1, 2) s ON s.user_id = b.user_id AND s.warranty_id = b.warranty_id
    LEFT JOIN (SELECT user_id, warranty_id, component FROM (SELECT user_id, warranty_id, coalesce(nullif(matched_component, ''), 'other') AS component, count(*) AS n FROM v_symptom_search GROUP BY 1, 2, 3)
      QUALIFY row_number() OVER (PARTITION BY user_id, warranty_id ORDER BY n DESC, component DESC) = 1) f ON f.user_id = b.user_id AND f.warranty_id = b.warranty_id""",
)
def v2_feature_table(d):
    return v2_table(d)


def risk_training(d):
    """The 12 features with the rule-based label as the class to learn."""
    label = T.base_risk(T.telemetry_counts(d.telemetry())).select(*PAIR, S.label_of(F.col("base_h")).alias("rule_label"))
    return M.labelled(features(d).join(label, PAIR), F.col("rule_label"))


def ev_inputs(rated):
    """The EV model's features from rated pairs."""
    return rated.withColumns({n: F.col(h) / 100 for n, h in (("behaviour_score", "behaviour_h"), ("care_score", "care_h"), ("responsiveness_score", "resp_h"))})


def _balance_sql(label: str) -> str:
    return f"""WITH pairs AS (SELECT CAST({label} AS DOUBLE) AS label, CAST('0x' || md5('{M.SEED}:' || user_id || ':' || warranty_id)[1:8] AS BIGINT) % 1000 < 200 AS held FROM (
        SELECT user_id, warranty_id, count(*) FILTER (ts >= TIMESTAMP '{CUTOFF}' AND event_type = 'failure') AS later FROM v_telemetry
        GROUP BY user_id, warranty_id HAVING count(*) FILTER (ts < TIMESTAMP '{CUTOFF}') > 0))
      SELECT label, count(*) AS n, count(*) FILTER (NOT held) AS n_train, count(*) FILTER (held) AS n_held,
        (SELECT count(DISTINCT label) FILTER (held) >= 2 FROM pairs) AS evaluated FROM pairs GROUP BY label"""


@register("ml_risk_train", _balance_sql("least(later, 2)"))
def ml_risk_train(d):
    known = R.feature_vector(T.telemetry_counts(before(d.telemetry(), "ts", CUTOFF)), d.warranty(), d.profile(), CUTOFF)
    table = M.written(M.with_outcome(known, d.telemetry(), CUTOFF))
    _, metrics = M.train_three_class(table, C.RISK_FEATURES, M.RISK_ROUNDS, M.RISK_DEPTH)
    return M.report(table, metrics)


@register("ml_ev_train", _balance_sql("least(2, later)"))
def ml_ev_train(d):
    known = ev_inputs(ev_rated(d, before(d.ev_payload_telemetry(), "ts", CUTOFF)))
    table = M.written(M.with_outcome(known, d.telemetry(), CUTOFF))
    _, metrics = M.train_three_class(table, C.EV_FEATURES, M.OTHER_ROUNDS, M.OTHER_DEPTH)
    return M.report(table, metrics)


@register("ml_v2_train", _balance_sql("least(later, 1)"))
def ml_v2_train(d):
    table = M.written(M.with_outcome(v2_table(d, CUTOFF), d.telemetry(), CUTOFF).withColumn("label", F.least("label", F.lit(1.0))))
    _, metrics = M.train_binary(table, M.v2_names(), M.OTHER_ROUNDS, M.OTHER_DEPTH)
    return M.report(table, metrics)


def _kept(spark, model, names):
    """A model as scoring finds it: stored, then loaded."""
    folder = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    version = M.save_model(model, spark, folder, names, AS_OF)
    return M.load_model(spark, folder, names, version)


def _sums_to_one():
    return F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9


@register(
    "risk_score_model",
    f"""SELECT m.user_id, m.warranty_id, CAST(delta_h AS DOUBLE) / 100 AS behaviour_delta, array_to_string(signal_reasons, '|') AS behaviour_reasons,
      array_to_string((CASE WHEN delta_h <> 0 THEN list_concat(signal_reasons, base) ELSE base END)[1:4], '|') AS reasons, TRUE AS proba_ok, TRUE AS base_ok, TRUE AS label_ok
      FROM ({MODEL_REASONS_SQL}) m JOIN v_signal s ON s.user_id = m.user_id AND s.warranty_id = m.warranty_id""",
)
def risk_score_model(d):
    """Every pair scored by a stored model, with the model's reasons and the behaviour delta; flags check the numbers, which SQL can't train."""
    trained, _ = M.train_three_class(risk_training(d), C.RISK_FEATURES, M.RISK_ROUNDS, M.RISK_DEPTH)
    model = _kept(d.spark, trained, C.RISK_FEATURES)
    based = R.model_reasons(M.model_or_rule(model, features(d), F.lit(20)))
    done = R.finish_score(T.with_signal(based, T.recent_signal(d.telemetry(), AS_OF)))
    label = F.when(F.col("risk_score") > 0.66, "HIGH").when(F.col("risk_score") >= 0.33, "MEDIUM").otherwise("LOW")
    return done.select(
        *PAIR, "behaviour_delta", joined("behaviour_reasons").alias("behaviour_reasons"), joined("reasons").alias("reasons"),
        _sums_to_one().alias("proba_ok"), (F.abs(F.col("base_risk_score") - F.col("model_score")) < 0.00501).alias("base_ok"), (F.col("risk_label") == label).alias("label_ok"),
    )


@register(
    "ev_battery_score_model",
    f"""SELECT user_id, warranty_id, CASE WHEN len(r) > 0 THEN array_to_string(r[1:4], '|') ELSE {quoted(C.EV_MODEL_HEALTHY)} END AS reasons, {quoted('|'.join(C.EV_MODEL_SUGGESTIONS))} AS suggestions,
      TRUE AS proba_ok, TRUE AS label_ok FROM (SELECT *, list_filter([CASE WHEN c1 THEN {quoted(C.EV_MODEL_REASONS[0])} END, CASE WHEN c2 THEN {quoted(C.EV_MODEL_REASONS[1])} END,
        CASE WHEN c3 THEN {quoted(C.EV_MODEL_REASONS[2])} END, CASE WHEN c4 THEN {quoted(C.EV_MODEL_REASONS[3])} END, CASE WHEN behaviour_h < 40 THEN {quoted(C.EV_MODEL_REASONS[4])} END],
        lambda x: x IS NOT NULL) AS r FROM ({EV_SCORE_SQL}))""",
)
def ev_battery_score_model(d):
    """Every EV pair scored by a model, with the texts that go with a model."""
    rated = M.written(ev_inputs(ev_scores(d)))
    trained, _ = M.train_three_class(M.labelled(rated, F.col("ev_label")), C.EV_FEATURES, M.OTHER_ROUNDS, M.OTHER_DEPTH)
    model = _kept(d.spark, trained, C.EV_FEATURES)
    done = EV.model_texts(M.score(model, rated))
    best = F.element_at("proba", F.col("model_label")) == F.array_max("p")
    return done.select(*PAIR, joined("ev_reasons").alias("reasons"), joined("ev_suggestions").alias("suggestions"), _sums_to_one().alias("proba_ok"), best.alias("label_ok"))
