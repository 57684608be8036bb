"""Peer reviews, symptom searches and product interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermill.functions import scalars as S
from covermill.functions import text as X
from covermill.functions.scalars import PAIR
from covermill.functions.topk import most_common


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every filter that was given."""
    for name, value in wanted.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


# --- peer reviews --------------------------------------------------------------------------------


def upsert_peer_signals(updates: DataFrame) -> DataFrame:
    """Current signal per (warranty, brand, model), nulls being equal, from an ordered update log.

    A later value replaces an earlier one only if it is present: non-empty text or list, non-null
    number. Each column keeps its last present value, so updates merge before the shuffle.
    """
    keys = ["warranty_id", "brand", "model"]
    order = F.struct("last_updated_at", "id")
    texts = ["product_type", "symptom_keyword", "severity_hint", "source"]
    numbers = ["avg_rating", "review_sentiment"]
    last = lambda c, present: F.max_by(c, F.when(present, order))
    aggs = [F.coalesce(last(c, S.truthy(F.col(c)).isNotNull()), F.min_by(c, order)).alias(c) for c in texts]
    aggs += [last(c, F.col(c).isNotNull()).alias(c) for c in numbers]
    aggs.append(
        F.coalesce(last("failure_keywords", F.size("failure_keywords") > 0), F.expr("cast(array() AS array<string>)")).alias(
            "failure_keywords"
        )
    )
    aggs.append(F.max("last_updated_at").alias("last_updated_at"))
    df = updates
    for k in keys:
        df = df.withColumn(k, S.truthy(F.col(k)))
    return df.groupBy(*keys).agg(*aggs)


def peer_features(warranties: DataFrame, signals: DataFrame) -> DataFrame:
    """Rating, sentiment and keyword count per warranty: its own newest signal, else the newest of
    its brand and model. Only counts travel, not the keywords."""
    order = F.struct("last_updated_at", "id")
    row = F.struct(
        F.coalesce("avg_rating", F.lit(0)).cast("double").alias("avg_rating"),
        F.coalesce("review_sentiment", F.lit(0)).cast("double").alias("review_sentiment"),
        F.coalesce(F.size("failure_keywords"), F.lit(0)).alias("failure_keyword_count"),
    )
    slim = signals.select("warranty_id", "brand", "model", order.alias("o"), row.alias("row"))
    own = slim.where("warranty_id IS NOT NULL").groupBy("warranty_id").agg(F.max_by("row", "o").alias("own"))
    family = (
        slim.where("brand IS NOT NULL AND model IS NOT NULL")
        .groupBy(F.col("brand").alias("f_brand"), F.col("model").alias("f_model"))
        .agg(F.max_by("row", "o").alias("family"))
    )
    brand, model = (F.coalesce(c, F.lit("")) for c in ("brand", "model_code"))
    best = F.coalesce("own", F.when((brand != "") | (model != ""), F.col("family")))
    return (
        warranties.join(own, "warranty_id", "left")
        .join(family, (F.col("f_brand") == brand) & (F.col("f_model") == model), "left")
        .select(
            "warranty_id",
            "user_id",
            F.coalesce(best["avg_rating"], F.lit(0.0)).alias("avg_rating"),
            F.coalesce(best["review_sentiment"], F.lit(0.0)).alias("review_sentiment"),
            F.coalesce(best["failure_keyword_count"], F.lit(0)).alias("failure_keyword_count"),
        )
    )


def peer_issue_stats(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Signals, mean rating and mean sentiment per group, a missing value counting as 0."""
    n = F.count(F.lit(1))
    mean = lambda c: F.sum(F.coalesce(c, F.lit(0))) / n
    return signals.groupBy(*keys).agg(
        n.alias("signals"), mean("avg_rating").alias("avg_rating"), mean("review_sentiment").alias("avg_sentiment")
    )


def peer_severity(signals: DataFrame, keys: list[str]) -> DataFrame:
    hints = signals.where(S.truthy(F.col("severity_hint")).isNotNull())
    return hints.groupBy(*keys, "severity_hint").agg(F.count(F.lit(1)).alias("n"))


def _top_per_group(items: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """Most frequent items per group, ties by item; ranks the counts, never the rows."""
    counts = items.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc(item))
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def peer_keywords(signals: DataFrame) -> DataFrame:
    """One row per keyword mentioned: the symptom and every failure keyword."""
    symptom = F.array_compact(F.array(S.truthy(F.col("symptom_keyword"))))
    return signals.withColumn(
        "keyword", F.explode(F.concat(symptom, F.coalesce("failure_keywords", F.expr("cast(array() AS array<string>)"))))
    )


def peer_top_keywords(signals: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    return _top_per_group(peer_keywords(signals).select(*keys, "keyword"), keys, "keyword", k)


# --- symptom searches ----------------------------------------------------------------------------


def search_features(searches: DataFrame) -> DataFrame:
    """Searches, unresolved searches and distinct components per pair."""
    part = S.truthy(F.col("matched_component"))
    per_part = searches.groupBy(*PAIR, F.coalesce(part, F.lit("other")).alias("component")).agg(
        F.count(F.lit(1)).alias("n"), S.flag_count(part.isNull()).alias("open")
    )
    return per_part.groupBy(*PAIR).agg(
        F.sum("n").alias("search_count"), F.sum("open").alias("unresolved"), F.count(F.lit(1)).alias("components")
    )


def search_components(searches: DataFrame) -> DataFrame:
    """Searches per pair and matched component, "other" without one."""
    part = F.coalesce(S.truthy(F.col("matched_component")), F.lit("other"))
    return searches.groupBy(*PAIR, part.alias("component")).agg(F.count(F.lit(1)).alias("n"))


def symptom_top_tokens(searches: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent words over the whole query texts."""
    return most_common(searches.select(F.explode(X.words(F.col("query_text"))).alias("token")), "token", k)


def symptom_top_components(searches: DataFrame, k: int = 5) -> DataFrame:
    part = S.truthy(F.col("matched_component"))
    return most_common(searches.where(part.isNotNull()).select(part.alias("component")), "component", k)


# --- product interest ----------------------------------------------------------------------------


def _passes(name: str, value: str | None) -> Column:
    col = S.truthy(F.col(name))
    return F.lit(True) if not value else (col.isNull() | (col == value))


def interest_top(events: DataFrame, region: str | None = None, risk_band: str | None = None, k: int = 5) -> DataFrame:
    """Products by number of events; an event without region or band passes those filters.

    A product is titled by its first event's title, or by its id if that event has none.
    """
    df = events.where(_passes("region", region) & _passes("risk_band", risk_band) & S.truthy(F.col("product_id")).isNotNull())
    return (
        df.groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by(F.coalesce(S.truthy(F.col("title")), "product_id"), F.struct("ts", "id")).alias("title"))
        .orderBy(F.desc("n"), "product_id")
        .limit(k)
    )
