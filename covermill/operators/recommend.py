"""Rule and product recommendations per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR
from covermill.functions.topk import first_rows_per_key
from covermill.session import ensure_checkpoint_dir


def _catalog_item(row: tuple) -> Column:
    pid, category, title, regions, band, priority, tags = row
    return F.struct(
        F.lit(pid).alias("product_id"),
        F.lit(category).alias("category"),
        F.lit(title).alias("title"),
        (S.text_array(regions) if regions else F.lit(None).cast("array<string>")).alias("regions"),
        F.lit(C.RISK_LABELS.index(band)).alias("min_rank"),
        F.lit(priority).alias("priority"),
        S.text_array(tags).alias("tags"),
    )


def product_recommendations(scored: DataFrame, k: int = 6) -> DataFrame:
    """Catalogue items that fit each pair's category, band and region, best ``k``, one row each.

    The catalogue is a constant array in its final order, so a filter and a slice per row replace a
    join, a shuffle and a rank. Needs ``category``, ``band``, ``region_code`` and the reasons.
    """
    ordered = sorted(C.PRODUCT_CATALOG, key=lambda r: (r[5], r[0]))
    catalog = F.array(*[_catalog_item(r) for r in ordered])
    rank = S.risk_rank(F.col("band"))
    region = S.truthy(F.col("region_code"))

    def fits(item: Column) -> Column:
        place = item["regions"].isNull() | region.isNull() | F.array_contains(item["regions"], region)
        return ((item["category"] == F.col("category")) | (item["category"] == "general")) & (item["min_rank"] <= rank) & place

    reasons = F.when(F.size("behaviour_reasons") > 0, F.col("behaviour_reasons")).otherwise(F.col("reasons"))
    why = F.when(F.size(reasons) > 0, F.array_join(F.slice(reasons, 1, 2), "; ")).otherwise(
        F.concat(F.lit("Risk band: "), F.col("band"))
    )
    picked = scored.withColumn("why", why).withColumn("item", F.explode(F.slice(F.filter(catalog, fits), 1, k)))
    return picked.select(
        *PAIR,
        F.col("item.product_id"),
        F.col("item.title"),
        F.col("item.category").alias("item_category"),
        F.col("item.priority"),
        F.coalesce(F.try_element_at("item.tags", F.lit(1)), F.col("item.category"), F.lit("view")).alias("action"),
        "region_code",
        F.col("band").alias("risk_band"),
        "why",
    )


def with_catalog_context(scores: DataFrame, warranties: DataFrame) -> DataFrame:
    w = warranties.select("warranty_id", "product_name", "model_code", "region_code")
    return (
        scores.join(w, "warranty_id", "left")
        .withColumn("category", S.product_category(F.lit(None).cast("string"), F.col("product_name"), F.col("model_code")))
        .withColumn("band", S.band_of(F.col("risk_label"), F.col("score_h")))
    )


def default_rules(spark) -> DataFrame:
    cols = "id bigint, segment string, condition_json string, title string, message string, priority int"
    return spark.createDataFrame(C.DEFAULT_RULES, cols).withColumn("active", F.lit(1))


_CONDITION = "min_aqi_band int, min_risk_label string, max_behaviour_score double, max_care_score double"


def parse_rules(rules: DataFrame) -> DataFrame:
    """Active rules with their conditions as columns; a product filter may be a list or a string."""
    raw = F.get_json_object("condition_json", "$.product_type_filter")
    c = F.from_json("condition_json", _CONDITION)
    return rules.where(F.col("active") == 1).select(
        F.col("id").alias("rule_id"),
        "segment",
        "title",
        "message",
        "priority",
        c["min_aqi_band"].alias("min_aqi"),
        F.when(S.truthy(c["min_risk_label"]).isNotNull(), S.risk_rank(c["min_risk_label"])).otherwise(0).alias("min_rank"),
        F.round(c["max_behaviour_score"] * 100).cast("int").alias("max_behaviour_h"),
        F.round(c["max_care_score"] * 100).cast("int").alias("max_care_h"),
        F.when(raw.startswith("["), F.from_json(raw, "array<string>")).alias("types"),
        F.when(~raw.startswith("["), S.truthy(raw)).alias("type_text"),
    )


def rule_context(pairs: DataFrame, latest_profiles: DataFrame, scores: DataFrame) -> DataFrame:
    """What rules look at, per pair; without a profile or a score the neutral values."""
    p = latest_profiles.select(*PAIR, "behaviour_h", "care_h", "aqi_band", F.col("product_type").alias("profile_type"))
    return (
        pairs.join(p, PAIR, "left")
        .join(scores.select(*PAIR, "risk_label"), PAIR, "left")
        .select(
            *PAIR,
            F.coalesce("behaviour_h", F.lit(50)).alias("behaviour_h"),
            F.coalesce("care_h", F.lit(50)).alias("care_h"),
            F.coalesce("aqi_band", F.lit(0)).alias("aqi_band"),
            F.lower(F.coalesce("profile_type", F.lit(""))).alias("profile_type"),
            S.risk_rank(F.coalesce("risk_label", F.lit("LOW"))).alias("risk_rank"),
        )
    )


_CONDITIONS = ["min_rank", "min_aqi", "max_behaviour_h", "max_care_h", "types", "type_text"]
_FACTS = ["risk_rank", "aqi_band", "behaviour_h", "care_h", "profile_type"]
_POINT = ["risk_rank", "aqi_band", "behaviour_h", "care_h"]
_CELL = ["risk_rank", "aqi_band", "behaviour_cell", "care_cell", "type_key"]
_SHOWN = ["rule_id", "segment", "title", "message", "priority"]

#: Scores lie in 0..100. Cells of 1, 4, 16, 64 and 256 scores cover a range by at most three cells a size.
CELL_SIZES = [1, 4, 16, 64, 256]
TOP_SCORE = 255
#: Type keys of rules that fit any type, and of profiles without one.
ANY_TYPE, NO_TYPE = "any", "none"


def _cell(size: int, number: Column) -> Column:
    return (F.lit(CELL_SIZES.index(size) * 256) + number).cast("int")


def _cells(size: int, first: Column, count: Column) -> Column:
    """Up to three neighbouring cells."""
    return F.transform(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < count), lambda i: _cell(size, first + i))


def cells_of(score_h: Column) -> Column:
    """The cells that hold a score, one of each size."""
    inside = S.clamp(score_h, 0, TOP_SCORE)
    return F.array(*[_cell(n, F.floor(inside / n)) for n in CELL_SIZES])


def cells_up_to(limit_h: Column) -> Column:
    """The fewest cells that cover the scores from 0 to a limit; all scores without a limit, none below 0."""
    end = F.when(limit_h.isNull() | (limit_h >= TOP_SCORE), TOP_SCORE + 1).otherwise(F.greatest(limit_h + 1, F.lit(0)))
    parts = []
    for n, wider in zip(CELL_SIZES, [*CELL_SIZES[1:], None], strict=True):
        first = F.floor(end / wider) * (wider // n) if wider else F.lit(0)
        count = F.floor(end / n) - first
        parts.append(_cells(n, first, count))
    return F.flatten(F.array(*parts))


def _type_key(value: Column) -> Column:
    return F.concat(F.lit("="), value)


def _grams(value: Column) -> Column:
    """The distinct stretches of one to three characters of a text."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(value), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substr(value, i, n)))))


def typed_rules(rules: DataFrame, kinds: DataFrame) -> DataFrame:
    """A row per rule and type key it fits, of those that ``kinds`` (distinct ``profile_type``) can ask for.

    A type lies in a rule's text if it is one of its parts: both are joined by the type's first three
    characters, then compared.
    """
    texts = rules.where(F.col("type_text").isNotNull()).select("type_text").distinct()
    inside = (
        texts.withColumn("gram", F.explode(_grams(F.col("type_text"))))
        .join(kinds.where("profile_type <> ''").withColumn("gram", F.substring("profile_type", 1, 3)), "gram")
        .where(F.col("type_text").contains(F.col("profile_type")))
        .select("type_text", _type_key(F.col("profile_type")).alias("type_key"))
    )
    free = (F.col("types").isNull() & F.col("type_text").isNull()) | (F.size("types") == 0)
    listed = F.transform(F.filter("types", lambda t: t.isNotNull()), _type_key)
    own = F.when(F.coalesce(free, F.lit(False)), F.array(F.lit(ANY_TYPE))).otherwise(F.coalesce(listed, F.array().cast("array<string>")))
    alone = rules.withColumn("type_key", F.explode(F.array_distinct(F.concat(F.array(F.lit(NO_TYPE)), own))))
    return alone.unionByName(rules.join(inside, "type_text").select(*alone.columns))


def rule_index(rules: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rules of each cell of the facts, as one array ``best`` per cell.

    A rule is listed in the cells that its limits cover, so it fits every fact in them and nothing is
    compared any more. Per cell ``k`` rules are kept before they are exchanged: the index follows the number of cells.
    """
    first = [F.col("priority"), F.col("rule_id")]
    useful = first_rows_per_key(rules, _CONDITIONS, first, k)
    bands = facts.select("risk_rank", "aqi_band").distinct().groupBy("risk_rank").agg(F.collect_set("aqi_band").alias("bands"))
    ranks = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda r: r >= F.col("min_rank"))
    spread = (
        typed_rules(useful, facts.select("profile_type").distinct())
        .withColumn("risk_rank", F.explode(ranks))
        .join(F.broadcast(bands), "risk_rank")  # three rows at most
        .withColumn("aqi_band", F.explode(F.filter("bands", lambda b: F.col("min_aqi").isNull() | (b >= F.col("min_aqi")))))
        .withColumn("behaviour_cell", F.explode(cells_up_to(F.col("max_behaviour_h"))))
        .withColumn("care_cell", F.explode(cells_up_to(F.col("max_care_h"))))
        .select(*_CELL, "priority", "rule_id")
    )
    kept = first_rows_per_key(spread, _CELL, first, k, salts=1)
    return kept.groupBy(*_CELL).agg(F.collect_list(F.struct("priority", "rule_id")).alias("best"))


def recommendation_events(shown: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """The log rows of shown recommendations: those of active stored rules. Default rules aren't logged."""
    stored = parse_rules(rules).select("rule_id").distinct()
    return shown.join(stored, "rule_id", "left_semi").select(*PAIR, "rule_id", S.ts_lit(as_of).alias("shown_at"))


def rule_recommendations(context: DataFrame, rules: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` matching rules by priority of each pair; the default rules if none is active.

    Distinct facts look their rules up in ``rule_index`` by equality of cells, and pairs pick up their
    facts' rules. What rules look at without the type has few distinct values whatever the number of
    pairs, and each type key has no more, so no cell is asked for by an unbounded number of rows.
    Scores are taken as 0..100 and rule ids as unique; a pair with a null fact is shown nothing. One small job finds whether any rule is active.
    """
    own = parse_rules(rules)
    if own.isEmpty():
        own = parse_rules(default_rules(rules.sparkSession))
    ensure_checkpoint_dir(context.sparkSession)
    facts = context.select(*_FACTS).distinct().dropna().checkpoint()  # read five times, and far fewer than pairs
    keys = F.when(F.col("profile_type") == "", F.array(F.lit(NO_TYPE))).otherwise(F.array(F.lit(ANY_TYPE), _type_key(F.col("profile_type"))))
    keyed = facts.withColumn("type_key", F.explode(keys))
    merged = lambda c: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k)
    found = (
        keyed.select(*_POINT, "type_key").distinct()
        .withColumn("behaviour_cell", F.explode(cells_of(F.col("behaviour_h"))))
        .withColumn("care_cell", F.explode(cells_of(F.col("care_h"))))
        .join(rule_index(own, facts, k), _CELL)
        .groupBy(*_POINT, "type_key")
        .agg(merged("best").alias("best"))
    )
    matched = (
        keyed.join(found, [*_POINT, "type_key"])
        .groupBy(*_FACTS)
        .agg(merged("best").alias("best"))
        .select(*_FACTS, F.posexplode("best").alias("at", "rule"))
        .select(*_FACTS, (F.col("at") + 1).alias("place"), "rule.rule_id")
        .join(own.select(*_SHOWN), "rule_id")
    )
    return context.join(matched, _FACTS).select(*PAIR, "place", *_SHOWN)
