"""Nudges, experiment variants and advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR


def hashed_variant(experiment: str, variants: tuple[str, ...] = ("A", "B")) -> Column:
    """A variant that depends only on experiment and pair: the first md5 byte, modulo the variants."""
    key = F.concat_ws(":", F.lit(experiment), F.col("user_id").cast("string"), F.col("warranty_id"))
    byte = F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int")
    return F.element_at(S.text_array(list(variants)), (byte % len(variants)) + 1)


def assign_variants(pairs: DataFrame, assignments: DataFrame, experiment: str = "fogg_nudge") -> DataFrame:
    """Sticky variants: the earliest logged one of the pair, else the hashed one."""
    logged = (
        assignments.where((F.col("experiment") == experiment) & F.col("variant").isNotNull())
        .groupBy(*PAIR)
        .agg(F.min_by("variant", "id").alias("logged_variant"))
    )
    return (
        pairs.join(logged, PAIR, "left")
        .withColumn("variant", F.coalesce("logged_variant", hashed_variant(experiment)))
        .withColumn("is_new", F.col("logged_variant").isNull())
        .drop("logged_variant")
    )


def _nudge(kind: str, title: Column, message: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        title.alias("title"),
        message.alias("message"),
        F.lit(C.NUDGE_REASONS[kind]).alias("reason"),
        S.text_array(C.NUDGE_ACTIONS.get(kind, [])).alias("actions"),
    )


def nudges(risk: DataFrame, as_of) -> DataFrame:
    """One row per nudge of each pair with a behaviour risk and a variant; at most three per pair."""
    is_b = F.col("variant") == "B"
    copy = lambda name: F.when(is_b, C.NUDGE_COPY["B"][name]).otherwise(C.NUDGE_COPY["A"][name])
    left = S.days_left(F.col("expiry_date"), as_of)
    items = F.array_compact(
        F.array(
            F.when(F.col("warranty_known"), _nudge("snapshot", copy("snapshot_title"), copy("snapshot_msg"))),
            F.when(F.col("band") != "low", _nudge("care", copy("care_title"), copy("care_msg"))),
            F.when(
                left < 60,
                _nudge(
                    "expiry",
                    copy("expiry_title"),
                    F.concat(F.lit("Warranty ends in "), left.cast("string"), F.lit(" days. Capture proofs and run checks now.")),
                ),
            ),
        )
    )
    none = F.array(
        _nudge("all_good", F.lit("All Good"), F.lit("No pressing actions. We will refresh advisories on schedule."))
    )
    return risk.withColumn("n", F.explode(F.when(F.size(items) > 0, items).otherwise(none))).select("*", "n.*").drop("n")


def advisories(risk: DataFrame, as_of) -> DataFrame:
    """Advisory items of pairs whose warranty is known."""
    return nudges(risk.where("warranty_known"), as_of).withColumn("severity", S.severity_of(F.col("band")))


def nudge_events(outcomes: DataFrame) -> DataFrame:
    """Reported outcomes as nudge events: the time of an ``acted`` or ``ignored`` one, null for any other."""
    at = lambda outcome: F.when(F.col("outcome") == outcome, F.col("shown_at"))
    return outcomes.withColumns({"acted_at": at("acted"), "ignored_at": at("ignored")})


def nudge_stats(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nudges shown, acted on and ignored, and the acted rate, per pair or other keys."""
    acted = F.col("acted_at").isNotNull()
    return (
        events.groupBy(*(keys or PAIR))
        .agg(
            F.count(F.lit(1)).alias("shown"),
            S.flag_count(acted).alias("acted"),
            S.flag_count(F.col("ignored_at").isNotNull() & ~acted).alias("ignored"),
        )
        .withColumn("acted_rate", F.col("acted") / F.col("shown"))
    )
