"""Manufacturer views: question and recommendation lists, statistics, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR
from covermill.operators import ev as EV
from covermill.operators import signals as G

PROFILE_SCORES = ["behaviour", "care", "resp"]


# --- published questions and recommendations -----------------------------------------------------


def normalize_questions(raw: DataFrame) -> DataFrame:
    return (
        raw.withColumn("text", F.trim("text"))
        .withColumn("answer_type", F.coalesce(S.truthy(F.col("answer_type")), F.lit("text")))
        .withColumn("options", F.coalesce("options", F.expr("cast(array() AS array<string>)")))
        .withColumn("priority", F.coalesce("priority", F.lit(50)))
        .withColumn("enabled", F.coalesce("enabled", F.lit(True)))
        .withColumn("source", F.coalesce("source", F.lit("manual")))
    )


def normalize_recommendations(raw: DataFrame) -> DataFrame:
    return (
        raw.withColumn("tags", F.coalesce("tags", F.expr("cast(array() AS array<string>)")))
        .withColumn("status", F.coalesce(S.truthy(F.col("status")), F.lit("active")))
        .withColumn("source", F.coalesce(S.truthy(F.col("source")), F.lit("oem_manual")))
    )


def disable_by_log(df: DataFrame, disabled: DataFrame, column: str, value) -> DataFrame:
    """Applies a log of switched-off ids to a state column."""
    off = disabled.select("id").distinct().withColumn("off", F.lit(True))
    return df.join(off, "id", "left").withColumn(column, F.when(F.col("off"), F.lit(value)).otherwise(F.col(column))).drop("off")


def active_questions(questions: DataFrame, **filters) -> DataFrame:
    """Enabled questions equal to every given filter (a null in the row fails), by priority."""
    return G.filtered(questions.where("enabled"), **filters).orderBy("priority", "seq")


def active_recommendations(recs: DataFrame, **filters) -> DataFrame:
    """Active recommendations; a null or empty column passes any filter on it."""
    df = recs.where(F.col("status") == "active")
    for name, value in filters.items():
        if value:
            df = df.where(S.truthy(F.col(name)).isNull() | (F.col(name) == value))
    return df


# --- statistics ----------------------------------------------------------------------------------


def compact_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles merged per pair, product type and care level: counts and sums.

    The statistics need no more, so a pair with very many profiles reaches the joins as a few rows.
    ``poor`` is the care level the EV score looks at.
    """
    poor = (F.col("behaviour_h") < 40) | (F.col("care_h") < 40)
    return profiles.groupBy(*PAIR, "product_type", poor.alias("poor")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"{c}_h").alias(f"{c}_sum") for c in PROFILE_SCORES]
    )


def score_profiles(profiles: DataFrame, warranties: DataFrame, scores: DataFrame) -> DataFrame:
    """Profiles with their warranty, if any, and their pair's predictive score.

    A pair without telemetry scores the base of 20. ``warranty_known`` tells a missing warranty from
    one without a brand.
    """
    w = warranties.select(
        "warranty_id", "brand", "model_code", "region_code", "product_name", F.lit(True).alias("warranty_known")
    )
    s = scores.select(*PAIR, "score_h", "risk_label")
    return (
        profiles.join(s, PAIR, "left")
        .join(w, "warranty_id", "left")
        .withColumn("warranty_known", F.coalesce("warranty_known", F.lit(False)))
        .withColumn("score_h", F.coalesce("score_h", F.lit(20)))
        .withColumn("risk_label", F.coalesce("risk_label", F.lit("LOW")))
    )


def behaviour_stats(scored: DataFrame) -> DataFrame:
    """Mean profile scores and risk per brand and model of the profiles whose warranty is known."""
    name = lambda c: F.coalesce(S.truthy(F.col(c)), F.lit("unknown")).alias(c)
    n = F.sum("n")
    mean = lambda c: F.sum(c) / (n * 100)
    return (
        scored.where("warranty_known")
        .groupBy(name("brand"), name("model_code"))
        .agg(
            mean("behaviour_sum").alias("avg_behaviour"),
            mean("care_sum").alias("avg_care"),
            mean("resp_sum").alias("avg_responsiveness"),
            mean(F.col("score_h") * F.col("n")).alias("avg_predictive_risk"),
            n.alias("sample_size"),
        )
    )


def for_brand(scored: DataFrame, brand: str | None = None, model: str | None = None) -> DataFrame:
    """The dashboard's filter: a profile without a warranty passes, a warranty without the brand fails."""
    for column, value in (("brand", brand), ("model_code", model)):
        if value:
            scored = scored.where(~F.col("warranty_known") | F.coalesce(F.col(column) == value, F.lit(False)))
    return scored


_LABELS = [*C.RISK_LABELS, "UNKNOWN"]


def _label_sums(label: str, cond: Column | None = None) -> dict[str, Column]:
    """Profiles per label (of those meeting a condition), zeros included, anything else as UNKNOWN."""
    shown = F.coalesce(F.when(F.col(label).isin(*C.RISK_LABELS), F.col(label)), F.lit("UNKNOWN"))
    hit = lambda n: shown == n if cond is None else (shown == n) & cond
    return {n: F.coalesce(F.sum(F.when(hit(n), F.col("n"))), F.lit(0)) for n in _LABELS}


def _label_rows(df: DataFrame, label: str) -> DataFrame:
    counts = df.agg(*[v.alias(k) for k, v in _label_sums(label).items()])
    rows = F.array(*[F.struct(F.lit(n).alias(label), F.col(n).alias("n")) for n in _LABELS])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def _means() -> dict[str, Column]:
    n = F.sum("n") * 100
    return {
        "behaviour_score": F.sum("behaviour_sum") / n,
        "care_score": F.sum("care_sum") / n,
        "responsiveness_score": F.sum("resp_sum") / n,
    }


def risk_distribution(scored: DataFrame) -> DataFrame:
    return _label_rows(scored, "risk_label")


def behaviour_snapshot(profiles: DataFrame) -> DataFrame:
    """Overall profile means from merged profiles; no row without profiles."""
    means = [v.alias(k) for k, v in _means().items()]
    return profiles.agg(*means, F.sum("n").alias("n")).where(F.col("n") > 0)


def is_ev_profile() -> Column:
    named = F.coalesce(F.lower("product_name"), F.lit("")).contains("ev")
    return named | F.coalesce(F.lower("product_type"), F.lit("")).contains("ev")


def with_ev_label(scored: DataFrame, ev_telemetry: DataFrame) -> DataFrame:
    """Adds the EV battery label merged profiles would have with their pair's newest readings."""
    care = F.when(F.col("poor"), 0).otherwise(50)
    features = scored.withColumns({"behaviour_h": care, "care_h": care})
    for name in EV.READINGS:
        features = features.withColumn(name, F.lit(float(C.EV_DEFAULTS[name])))
    return EV.battery_score(EV.override_by_latest(features, ev_telemetry))


def ev_distribution(scored: DataFrame, ev_telemetry: DataFrame) -> DataFrame:
    """EV battery labels of the profiles whose product is an EV."""
    return _label_rows(with_ev_label(scored.where(is_ev_profile()), ev_telemetry), "ev_label")


def profile_sections(scored: DataFrame, ev_telemetry: DataFrame) -> DataFrame:
    """The dashboard's three profile sections from one pass over the scored profiles."""
    rated = with_ev_label(scored, ev_telemetry)
    groups = {
        "risk_distribution": _label_sums("risk_label"),
        "behaviour_snapshot": _means(),
        "ev_battery": _label_sums("ev_label", is_ev_profile()),
    }
    flat = [(g, k, f"{g}_{k}", v) for g, cols in groups.items() for k, v in cols.items()]
    one = rated.agg(*[v.cast("double").alias(name) for _, _, name, v in flat])
    rows = F.array(
        *[F.struct(F.lit(g).alias("section"), F.lit(k).alias("item"), F.col(name).alias("value")) for g, k, name, _ in flat]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*").where("value IS NOT NULL")


def _cluster_message(brand: Column, region: Column) -> Column:
    # The alert's text.
    return F.concat(
        F.lit("We’ve detected an elevated number of HIGH-risk warranties for "),
        F.coalesce(S.truthy(brand), F.lit("your brand")),
        F.lit(" in region "),
        F.coalesce(S.truthy(region), F.lit("all regions")),
        F.lit(". Check OEM Analytics to review affected devices."),
    )


def high_risk_clusters(scored: DataFrame) -> DataFrame:
    """Brand and region groups with 10 or more HIGH profiles, or with 30 % of them HIGH."""
    groups = scored.where("warranty_known").groupBy("brand", "region_code").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("risk_label") == "HIGH", F.col("n"))), F.lit(0)).alias("high"),
    )
    return alarming_groups(groups)


def alarming_groups(groups: DataFrame) -> DataFrame:
    """The groups (``brand``, ``region_code``, ``total``, ``high``) that call for an alert, with its message."""
    total, high = F.col("total"), F.col("high")
    # 10 * high >= 3 * total is high / total >= 0.3 without rounding.
    alarming = (total > 0) & ((high >= C.CLUSTER_MIN_HIGH) | (high * 10 >= total * 3))
    return groups.where(alarming).withColumn("message", _cluster_message(F.col("brand"), F.col("region_code")))


def cluster_alert(scored: DataFrame, brand: str | None = None, region: str | None = None) -> DataFrame:
    """The alert over all shown profiles: one row with its message and the HIGH profiles, or none."""
    high = F.coalesce(F.sum(F.when(F.col("risk_label") == "HIGH", F.col("n"))), F.lit(0))
    one = scored.agg(F.sum("n").alias("total"), high.alias("n"))
    alarming = (F.col("total") > 0) & ((F.col("n") >= C.CLUSTER_MIN_HIGH) | (F.col("n") * 10 >= F.col("total") * 3))
    return one.where(alarming).withColumn("message", _cluster_message(F.lit(brand), F.lit(region)))


def dashboard(
    scored: DataFrame,
    ev_telemetry: DataFrame,
    signals: DataFrame,
    searches: DataFrame,
    interest: DataFrame,
    brand: str | None = None,
    model: str | None = None,
    product_type: str | None = None,
    region: str | None = None,
) -> DataFrame:
    """Every dashboard section for one brand, as rows (section, item, value)."""
    mine = for_brand(scored, brand, model)
    peers = G.filtered(signals, product_type=product_type, brand=brand, model=model)
    asked = G.filtered(searches, product_type=product_type, brand=brand, model=model, region=region)

    def section(name: str, df: DataFrame, item: str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.col(item).alias("item"), F.col("n").cast("double").alias("value"))

    issues = G.peer_issue_stats(peers.withColumn("all", F.lit(1)), ["all"]).select(
        F.col("signals").cast("double").alias("signals"), "avg_rating", "avg_sentiment"
    )
    parts = [
        profile_sections(mine, ev_telemetry),
        issues.unpivot([], issues.columns, "item", "value").select(F.lit("peer_review").alias("section"), "item", "value"),
        section("peer_severity", G.peer_severity(peers, []), "severity_hint"),
        section("peer_keywords", G.peer_top_keywords(peers, []), "keyword"),
        section("symptom_searches", asked.agg(F.count(F.lit(1)).alias("n")).withColumn("count", F.lit("count")), "count"),
        section("symptom_components", G.symptom_top_components(asked), "component"),
        section("symptom_words", G.symptom_top_tokens(asked), "token"),
        section("product_interest", G.interest_top(interest, region=region), "product_id"),
        section("cluster_alert", cluster_alert(mine, brand, region), "message"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
