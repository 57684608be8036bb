"""Artifact, warranty, nudge, recommendation, notification, signal and manufacturer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR
from covermill.operators import nudges as N
from covermill.operators import notify as Y
from covermill.operators import oem as O
from covermill.operators import recommend as P
from covermill.operators import risk as R
from covermill.operators import signals as G
from covermill.operators import warranty as W
from covermill.operators import workflow as K
from covermill.plans.jobs_core import EV_SCORE_SQL, ev_scored, ev_scores, oem_questions, scores
from covermill.plans.oracle_views import AS_OF as NOW
from covermill.plans.oracle_views import AS_OF_DAY as TODAY
from covermill.plans.oracle_views import SPACE, quoted, text_list
from covermill.plans.registry import big, day, instant, joined, oracle_of, register
from covermill.sources import readers
from covermill.sources.domain import AS_OF

# --- artifacts and warranties -------------------------------------------------------------------


@register(
    "artifact_scan",
    """SELECT 'art_' || sha256(concat_ws(',', type, CAST(ref AS VARCHAR), source, content))[1:32] AS artifact_id, type, source, length(content) AS chars FROM v_artifact""",
)
def artifact_scan(d):
    return W.with_artifact_id(d.artifact()).select("artifact_id", "type", "source", big(F.length("content")).alias("chars"))


@register(
    "artifact_fields",
    "SELECT type, ref, brand, model_code, serial_no, strftime(purchase_date, '%Y-%m-%d') AS purchase_date, CAST(coverage_months AS BIGINT) AS coverage_months FROM v_artifact_fields",
)
def artifact_fields(d):
    return W.extract_fields(d.artifact()).select(
        "type", "ref", "brand", "model_code", "serial_no", day("purchase_date").alias("purchase_date"), big("coverage_months").alias("coverage_months")
    )


def _map_text(col: str):
    return joined(F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@register(
    "artifact_confidence",
    """SELECT type, ref, concat_ws(',', CASE WHEN brand IS NOT NULL THEN 'brand=0.7' END, CASE WHEN coverage_months IS NOT NULL THEN 'coverage_months=0.6' END,
      CASE WHEN model_code IS NOT NULL THEN 'model_code=0.65' END, CASE WHEN purchase_date IS NOT NULL THEN 'purchase_date=0.6' END, CASE WHEN serial_no IS NOT NULL THEN 'serial_no=0.6' END) AS confidence,
      CASE WHEN brand IS NULL AND coverage_months IS NULL AND model_code IS NULL AND purchase_date IS NULL AND serial_no IS NULL
        THEN 'No strong signals found; manual confirmation required.' END AS notes FROM v_artifact_fields""",
)
def artifact_confidence(d):
    return W.extract_fields(d.artifact()).select("type", "ref", _map_text("confidence").alias("confidence"), "notes")


@register(
    "artifact_purchase_date",
    "SELECT strftime(purchase_date, '%Y-%m-%d') AS purchase_date, type, count(*) AS n FROM v_artifact_fields GROUP BY purchase_date, type",
)
def artifact_purchase_date(d):
    return K.backlog(W.extract_fields(d.artifact()).select("type", day("purchase_date").alias("purchase_date")), "purchase_date", "type")


def canonical(d):
    return W.canonical_warranty(d.artifact(), d.override())


@register(
    "canonical_warranty",
    """SELECT id, product_name, brand, model_code, serial_no, strftime(purchase_date, '%Y-%m-%d') AS purchase_date, CAST(coverage_months AS BIGINT) AS coverage_months,
      strftime(expiry_date, '%Y-%m-%d') AS expiry_date, confidence, notes, source_artifact_ids FROM v_canonical""",
)
def canonical_warranty(d):
    return canonical(d).select(
        "id", "product_name", "brand", "model_code", "serial_no", day("purchase_date").alias("purchase_date"),
        big("coverage_months").alias("coverage_months"), day("expiry_date").alias("expiry_date"), _map_text("confidence").alias("confidence"), "notes",
        joined("source_artifact_ids").alias("source_artifact_ids"),
    )


@register(
    "warranty_upsert",
    "SELECT id, brand, CAST(coverage_months AS BIGINT) AS coverage_months, strftime(expiry_date, '%Y-%m-%d') AS expiry_date FROM v_canonical",
)
def warranty_upsert(d):
    """Warranties written twice, as extracted and then as corrected; the later write stays."""
    nothing = d.override().where(F.lit(False))
    cols = ["id", "brand", "coverage_months", "expiry_date"]
    first = W.canonical_warranty(d.artifact(), nothing).select(*cols, S.ts_lit("2024-01-01").alias("created_at"))
    second = canonical(d).select(*cols, S.ts_lit("2024-01-02").alias("created_at"))
    return W.latest_by_id(first.unionByName(second)).select(
        "id", "brand", big("coverage_months").alias("coverage_months"), day("expiry_date").alias("expiry_date")
    )


@register("warranty_summary", "SELECT id, summary FROM v_summary")
def warranty_summary(d):
    return W.warranty_summary(canonical(d)).select("id", "summary")


@register("warranty_export_html", "SELECT id, '<html><body><pre>' || summary || '</pre></body></html>' AS html FROM v_summary")
def warranty_export_html(d):
    return W.summary_html(W.warranty_summary(canonical(d))).select("id", "html")


@register(
    "warranty_expiry",
    "SELECT warranty_id, strftime(purchase_date, '%Y-%m-%d') AS purchase_date, CAST(coverage_months AS BIGINT) AS coverage_months, strftime(expiry_date, '%Y-%m-%d') AS expiry_date FROM v_warranty",
)
def warranty_expiry(d):
    df = d.warranty().withColumn("expiry_date", S.expiry_date(F.col("purchase_date"), F.col("coverage_months")))
    return df.select("warranty_id", day("purchase_date").alias("purchase_date"), big("coverage_months").alias("coverage_months"), day("expiry_date").alias("expiry_date"))


@register(
    "expiry_alerts",
    f"""SELECT warranty_id, CAST(l AS BIGINT) AS days_left, l < 60 AS nudge_window, l < 30 AS score_window, l BETWEEN 0 AND 30 AS onboarding_window,
      CASE WHEN l > 0 THEN 'warning' ELSE 'critical' END AS severity, CAST(greatest(l, 0) AS BIGINT) AS days_shown
      FROM (SELECT warranty_id, expiry_date - {TODAY} AS l FROM v_warranty WHERE expiry_date IS NOT NULL)""",
)
def expiry_alerts(d):
    return W.expiry_alerts(d.warranty(), AS_OF).select(
        "warranty_id", big("days_left").alias("days_left"), "nudge_window", "score_window", "onboarding_window", "severity", big("days_shown").alias("days_shown")
    )


@register(
    "product_type_infer",
    """SELECT warranty_id, product_name, model_code, CASE WHEN contains(lower(product_name), 'fridge') THEN 'fridge' WHEN contains(lower(product_name), 'ac') OR contains(lower(product_name), 'air') THEN 'ac'
      WHEN contains(lower(product_name), 'wash') THEN 'washer' ELSE nullif(model_code, '') END AS product_type FROM v_warranty""",
)
def product_type_infer(d):
    kind = S.infer_product_type(F.lit(None).cast("string"), F.col("product_name"), F.col("model_code"))
    return d.warranty().select("warranty_id", "product_name", "model_code", kind.alias("product_type"))


_CATEGORY = """CASE WHEN contains(nm, 'phone') OR contains(nm, 'galaxy') OR contains(nm, 'iphone') OR contains(md, 'sm-') THEN 'smartphone'
  WHEN contains(nm, 'laptop') OR contains(nm, 'notebook') THEN 'laptop' WHEN contains(nm, 'ev') OR contains(nm, 'battery') THEN 'ev'
  WHEN contains(nm, 'fridge') OR contains(nm, 'washer') OR contains(nm, 'ac') OR contains(nm, 'dishwasher') OR contains(nm, 'appliance') THEN 'appliance' ELSE 'general' END"""
_NAMED = "(SELECT *, coalesce(lower(product_name), '') AS nm, coalesce(lower(model_code), '') AS md FROM v_warranty)"


@register(
    "product_category",
    f"""SELECT warranty_id, {_CATEGORY} AS category, CASE WHEN contains(nm, 'phone') OR contains(nm, 'galaxy') OR contains(nm, 'iphone') OR contains(md, 'sm-')
      THEN 'smartphone' ELSE 'generic_device' END AS segment FROM {_NAMED}""",
)
def product_category(d):
    name, model = F.col("product_name"), F.col("model_code")
    return d.warranty().select(
        "warranty_id", S.product_category(F.lit(None).cast("string"), name, model).alias("category"), S.device_segment(name, model).alias("segment")
    )


_PART = "CASE WHEN regexp_extract(t, '{p}', 1, 'i') <> '' AND ({hint} OR NOT known) THEN struct_pack(k := regexp_extract(t, '{p}', 1, 'i'), v := regexp_extract(t, '{p}', 2, 'i') || ' years') END"
_PARTS = ", ".join(_PART.format(p=p, hint=f"coalesce(lower(brand_hint), '') = '{b}'") for b, p in C.OEM_PART_PATTERNS)
_OP = C.OEM_TEXT_PATTERNS


@register(
    "oem_page_fields",
    f"""SELECT url, nullif(trim(regexp_extract(t, '{_OP["brand"]}', 1, 'i'), ' '), '') AS brand, nullif(trim(regexp_extract(t, '{_OP["model"]}', 1, 'i'), ' '), '') AS model_code,
      CAST(coalesce(TRY_CAST(nullif(regexp_extract(t, '{_OP["months"]}', 1, 'i'), '') AS INT), TRY_CAST(nullif(regexp_extract(t, '{_OP["years"]}', 1, 'i'), '') AS INT) * 12) AS BIGINT) AS coverage_months,
      array_to_string(regexp_extract_all(t, '{_OP["exclusion"]}', 1, 'i'), '|') AS exclusions,
      array_to_string(list_sort(list_transform(list_filter(parts, lambda x, i: NOT list_contains(list_transform(parts[i + 1:], lambda y: y.k), x.k)), lambda x: x.k || '=' || x.v)), '|') AS extended_parts
    FROM (SELECT *, list_filter([{_PARTS}], lambda x: x IS NOT NULL) AS parts
      FROM (SELECT *, regexp_replace(html, '\\s+', ' ', 'g') AS t, coalesce(lower(brand_hint), '') IN ('samsung', 'lg', 'bosch', 'whirlpool') AS known FROM v_oem_page))""",
)
def oem_page_fields(d):
    df = W.oem_page_fields(d.oem_page())
    parts = F.array_sort(F.transform(F.map_entries("extended_parts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return df.select("url", "brand", "model_code", big("coverage_months").alias("coverage_months"), joined("exclusions").alias("exclusions"), joined(parts).alias("extended_parts"))


@register(
    "oem_page_blocks",
    """SELECT url, CASE WHEN p % 7 <> 0 AND brand_hint <> 'Other' THEN (1 + p_size % 36) || ' months cover for ' || p_name END AS coverage_block,
      CASE WHEN p % 7 <> 0 AND (brand_hint IN ('samsung', 'lg') OR (brand_hint IN ('bosch', 'whirlpool'))) THEN 'Keep the invoice.' END AS terms_block FROM v_oem_page""",
)
def oem_page_blocks(d):
    return W.oem_page_blocks(d.oem_page()).select("url", "coverage_block", "terms_block")


@register(
    "portal_artifacts",
    """SELECT url, 'Brand: ' || coalesce(brand_hint, '') || chr(10) || 'Model: ' || coalesce(model, '') || chr(10) || 'Region: ' || coalesce(region, '') AS head,
      regexp_replace(html, '\\s+', ' ', 'g') AS page_text FROM v_oem_page""",
)
def portal_artifacts(d):
    """Head and page text of the artifacts; what stands between is checked by the queries of fields and blocks."""
    df = W.portal_artifacts(d.oem_page())
    return df.select("url", F.substring_index("content", "\n", 3).alias("head"), F.substring_index("content", "\n\n", -1).alias("page_text"))


# --- files with drift and dirt --------------------------------------------------------------------

_ANSWER_SCHEMA = "user_id BIGINT, warranty_id STRING, question_id STRING, answer STRING"


@register(
    "jsonl_scan",
    "SELECT user_id, warranty_id, question_id, answer_value AS answer FROM v_raw_answer WHERE id % 7 NOT IN (3, 5)",
)
def jsonl_scan(d):
    """Answer log lines, some blank and some cut off; the good ones are read."""
    line = F.to_json(F.struct("user_id", "warranty_id", "question_id", F.col("answer_value").alias("answer")))
    damaged = F.when(F.col("id") % 7 == 3, F.lit("  ")).when(F.col("id") % 7 == 5, F.substring(line, 1, 25)).otherwise(line)
    return readers.parse_json_lines(d.raw_answer().select(damaged.alias("value")), _ANSWER_SCHEMA)


@register(
    "seed_csv_scan",
    """SELECT 0::DOUBLE + l_linenumber AS product_type, l_quantity AS age_months, l_discount AS usage_hours_per_day, CAST(l_tax AS DOUBLE) AS error_count, 1::DOUBLE AS failure_count, 2::DOUBLE AS maintenance_count,
      0.5::DOUBLE AS behaviour_score, 0.25::DOUBLE AS care_score, 0.75::DOUBLE AS responsiveness_score, CAST(l_suppkey AS DOUBLE) AS region_code,
      CASE WHEN m = 0 THEN 1 ELSE 0 END::DOUBLE AS climate_band, CASE WHEN m = 0 THEN 2 ELSE 0 END::DOUBLE AS power_quality_band, CAST(l_partkey % 3 AS BIGINT) AS label
      FROM (SELECT *, l_orderkey % 6 AS m FROM lineitem) WHERE m IN (0, 1)""",
)
def seed_csv_scan(d):
    """Seed lines of every width, with blanks, comments and text among them."""
    m = F.col("l_orderkey") % 6
    ten = F.concat_ws(",", *[F.col(c).cast("string") for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax")], F.lit("1,2,0.5, 0.25,0.75"), F.col("l_suppkey").cast("string"))
    label = (F.col("l_partkey") % 3).cast("string")
    line = (
        F.when(m == 0, F.concat_ws(",", ten, F.lit("1,2"), label))
        .when(m == 1, F.concat_ws(",", ten, label))
        .when(m == 2, ten)
        .when(m == 3, F.lit("   "))
        .when(m == 4, F.concat(F.lit("# "), ten))
        .otherwise(F.concat(ten, F.lit(",high")))
    )
    return readers.parse_seed_lines(d.table("lineitem").select(line.alias("value"))).withColumn("label", big("label"))


@register(
    "schema_drift_union",
    """SELECT warranty_id, product_name, brand, region_code, climate_zone FROM v_warranty
      UNION ALL SELECT 'old_' || warranty_id, product_name, brand, NULL, NULL FROM v_warranty""",
)
def schema_drift_union(d):
    """Warranties of two releases; the older one lacks region and climate."""
    new = d.warranty().select("warranty_id", "product_name", "brand", "region_code", "climate_zone")
    old = d.warranty().select(F.concat(F.lit("old_"), "warranty_id").alias("warranty_id"), "product_name", "brand")
    return readers.union_releases(new, old)


# --- nudges ---------------------------------------------------------------------------------------


def nudge_input(d):
    risk = R.behaviour_risk(d.behaviour_event(), d.warranty())
    return N.assign_variants(risk, d.policy_assignment())


@register("ab_assignment", """SELECT v.user_id, v.warranty_id, v.variant, s.variant IS NULL AS is_new FROM v_variant v LEFT JOIN v_sticky s ON s.user_id = v.user_id AND s.warranty_id = v.warranty_id""")
def ab_assignment(d):
    pairs = d.behaviour_event().select(*PAIR).unionByName(d.warranty().select(*PAIR)).distinct()
    return N.assign_variants(pairs, d.policy_assignment()).select(*PAIR, "variant", "is_new")


_NUDGE_REASON = "CASE kind " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in C.NUDGE_REASONS.items()) + " END"
_NUDGE_ACTIONS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {quoted('|'.join(v))}" for k, v in C.NUDGE_ACTIONS.items()) + " ELSE '' END"


@register("nudges", f"SELECT user_id, warranty_id, variant, kind, title, message, {_NUDGE_REASON} AS reason, {_NUDGE_ACTIONS} AS actions FROM v_nudge")
def nudges(d):
    return N.nudges(nudge_input(d), AS_OF).select(*PAIR, "variant", "kind", "title", "message", "reason", joined("actions").alias("actions"))


@register(
    "advisories",
    """SELECT user_id, warranty_id, variant, title, message AS body, CASE band WHEN 'high' THEN 'critical' WHEN 'medium' THEN 'warning' ELSE 'info' END AS severity,
      CAST(value_h AS DOUBLE) / 100 AS risk FROM v_nudge WHERE known""",
)
def advisories(d):
    return N.advisories(nudge_input(d), AS_OF).select(
        *PAIR, "variant", "title", F.col("message").alias("body"), "severity", (F.col("value_h") / 100).alias("risk")
    )


_NUDGE_COUNTS = "count(*) AS shown, count(acted_at) AS acted, count(*) FILTER (ignored_at IS NOT NULL AND acted_at IS NULL) AS ignored, CAST(count(acted_at) AS DOUBLE) / count(*) AS acted_rate"


@register(
    "nudge_events",
    """SELECT id, user_id, warranty_id, nudge_type, CASE event_type WHEN 'purchase' THEN 'acted' WHEN 'error' THEN 'ignored' ELSE 'dismissed' END AS outcome,
      CASE WHEN event_type = 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS acted_at, CASE WHEN event_type = 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ignored_at
      FROM (SELECT e.event_id, e.event_type, e.ts, n.* FROM v_event e JOIN v_nudge_event n ON n.id = e.event_id)""",
)
def nudge_events(d):
    df = N.nudge_events(d.nudge_event().drop("acted_at", "ignored_at"))
    return df.select("id", *PAIR, "nudge_type", "outcome", instant("acted_at").alias("acted_at"), instant("ignored_at").alias("ignored_at"))


@register("nudge_stats", f"SELECT user_id, warranty_id, {_NUDGE_COUNTS} FROM v_nudge_event GROUP BY user_id, warranty_id")
def nudge_stats(d):
    return N.nudge_stats(d.nudge_event())


@register("nudge_variant_rates", f"SELECT variant, nudge_type, {_NUDGE_COUNTS} FROM v_nudge_event GROUP BY variant, nudge_type")
def nudge_variant_rates(d):
    return N.nudge_stats(d.nudge_event(), ["variant", "nudge_type"])


# --- recommendations ------------------------------------------------------------------------------

_CATALOG = ", ".join(
    f"({quoted(p)}, {quoted(c)}, {quoted(t)}, {text_list(r) if r else 'NULL'}, {C.RISK_LABELS.index(b)}, {n}, {quoted(tags[0])})" for p, c, t, r, b, n, tags in C.PRODUCT_CATALOG
)


@register(
    "product_recommendations",
    f"""SELECT user_id, warranty_id, product_id, title, item_category, priority, action, region_code, risk_label AS risk_band, array_to_string(signal_reasons[1:2], '; ') AS why FROM (
      SELECT s.*, c.*, w.region_code, row_number() OVER (PARTITION BY s.user_id, s.warranty_id ORDER BY c.priority, c.product_id) AS rn
      FROM v_score s LEFT JOIN (SELECT warranty_id, region_code, {_CATEGORY} AS category FROM {_NAMED}) w USING (warranty_id)
      JOIN (VALUES {_CATALOG}) c(product_id, item_category, title, regions, min_rank, priority, action)
        ON c.item_category IN (coalesce(w.category, 'general'), 'general') AND c.min_rank <= CASE s.risk_label WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END
        AND (c.regions IS NULL OR w.region_code IS NULL OR list_contains(c.regions, w.region_code))) WHERE rn <= 6""",
)
def product_recommendations(d):
    return P.product_recommendations(P.with_catalog_context(scores(d), d.warranty()))


def rule_input(d):
    pairs = d.event().select(*PAIR).unionByName(d.warranty().select(*PAIR)).distinct()
    profile = R.latest_profile(d.profile().select("id", *PAIR, "behaviour_h", "care_h", "aqi_band", "product_type"))
    return P.rule_context(pairs, profile, scores(d))


_RULE_CONTEXT = """SELECT x.user_id, x.warranty_id, coalesce(p.behaviour_h, 50) AS behaviour_h, coalesce(p.care_h, 50) AS care_h, coalesce(p.aqi_band, 0) AS aqi_band, lower(coalesce(p.product_type, '')) AS pt,
  CASE s.risk_label WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS rr
  FROM (SELECT user_id, warranty_id FROM v_event UNION SELECT user_id, warranty_id FROM v_warranty) x
  LEFT JOIN v_latest_profile p USING (user_id, warranty_id) LEFT JOIN v_score s ON s.user_id = x.user_id AND s.warranty_id = x.warranty_id"""


@register(
    "rule_recommendations",
    f"""SELECT user_id, warranty_id, place, r.rule_id AS rule_id, r.segment AS segment, r.title AS title, r.message AS message, r.priority AS priority FROM (
      SELECT user_id, warranty_id, unnest(picks) AS r, unnest(range(1, len(picks) + 1)) AS place FROM (SELECT c.user_id, c.warranty_id, list_filter(rules, lambda r: CASE r.m WHEN 0 THEN c.aqi_band >= r.aqi
          WHEN 1 THEN c.rr >= 2 WHEN 2 THEN c.rr >= 1 AND c.behaviour_h <= 60 AND c.care_h <= 50 WHEN 3 THEN c.pt IN ('', 'fridge', 'ac')
          WHEN 4 THEN c.care_h <= 30 AND contains('my ev car park', c.pt) ELSE true END)[1:3] AS picks
        FROM ({_RULE_CONTEXT}) c, (SELECT list(struct_pack(rule_id := n_nationkey, segment := 'SEG_' || (n_nationkey % 4), title := n_name, message := 'Message of ' || n_name,
          priority := CAST(n_nationkey * 7 % 10 AS INT), m := n_nationkey % 6, aqi := n_nationkey % 4) ORDER BY n_nationkey * 7 % 10, n_nationkey) AS rules FROM nation WHERE n_nationkey % 5 <> 4)))""",
)
def rule_recommendations(d):
    return P.rule_recommendations(rule_input(d), d.rule()).withColumn("place", big("place"))


@register("recommendation_events", f"SELECT user_id, warranty_id, rule_id, '{AS_OF}.000000' AS shown_at FROM ({oracle_of('rule_recommendations')})")
def recommendation_events(d):
    shown = P.rule_recommendations(rule_input(d), d.rule())
    return P.recommendation_events(shown, d.rule(), AS_OF).withColumn("shown_at", instant("shown_at"))


_DEFAULT_RULES = ", ".join(f"({r[0]}, {quoted(r[1])}, {quoted(r[3])}, {quoted(r[4])}, {r[5]})" for r in C.DEFAULT_RULES)


@register(
    "rule_recommendations_default",
    f"""SELECT user_id, warranty_id, row_number() OVER (PARTITION BY user_id, warranty_id ORDER BY priority, rule_id) AS place, CAST(rule_id AS BIGINT) AS rule_id, segment, title, message, priority
      FROM ({_RULE_CONTEXT}) JOIN (VALUES {_DEFAULT_RULES}) r(rule_id, segment, title, message, priority)
      ON CASE rule_id WHEN 1 THEN aqi_band >= 2 ELSE rr >= 1 AND behaviour_h <= 60 AND care_h <= 60 END""",
)
def rule_recommendations_default(d):
    return P.rule_recommendations(rule_input(d), P.default_rules(d.spark)).withColumn("place", big("place"))


# --- notifications --------------------------------------------------------------------------------


@register(
    "notification_dedupe_existing",
    f"""SELECT c.user_id, c.type, c.audience FROM (SELECT DISTINCT user_id, type, audience FROM v_notification) c WHERE NOT EXISTS (SELECT 1 FROM v_notification e
      WHERE e.user_id = c.user_id AND e.type = c.type AND e.audience = c.audience AND NOT e.is_read AND e.created_at >= {NOW} - INTERVAL 7 DAY)""",
)
def notification_dedupe_existing(d):
    return Y.new_against_existing(d.notification_candidate(), d.notification(), AS_OF).select("user_id", "type", "audience")


@register(
    "notification_dedupe",
    """WITH RECURSIVE u AS (SELECT user_id, type, audience, min((created_at, id)) AS a FROM v_notification WHERE NOT is_read GROUP BY user_id, type, audience),
      chain AS (SELECT user_id, type, audience, a FROM u UNION ALL
        SELECT c.user_id, c.type, c.audience, min((n.created_at, n.id)) FROM chain c JOIN v_notification n ON n.user_id = c.user_id AND n.type = c.type AND n.audience = c.audience
          AND NOT n.is_read AND n.created_at > struct_extract(c.a, 1) + INTERVAL 7 DAY GROUP BY c.user_id, c.type, c.audience)
      SELECT n.id, n.user_id, n.type, n.audience, NOT EXISTS (SELECT 1 FROM chain c WHERE c.user_id = n.user_id AND c.type = n.type AND c.audience = n.audience
        AND (struct_extract(c.a, 1), struct_extract(c.a, 2)) < (n.created_at, n.id) AND struct_extract(c.a, 1) >= n.created_at - INTERVAL 7 DAY) AS kept FROM v_notification n""",
)
def notification_dedupe(d):
    return Y.dedupe_chain(d.notification(), Y.KEY).select("id", "user_id", "type", "audience", "kept")


_READ = """SELECT n.*, n.is_read OR EXISTS (SELECT 1 FROM v_read_mark m WHERE m.marked AND m.notification_id = n.id AND m.user_id = n.user_id) AS seen FROM v_notification n"""


@register("notification_read_state", f"SELECT id, user_id, seen AS is_read FROM ({_READ})")
def notification_read_state(d):
    return Y.with_read_state(d.notification(), d.read_mark()).select("id", "user_id", "is_read")


@register(
    "notifications_latest",
    """SELECT id, user_id, type, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, place FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS place FROM v_notification WHERE audience = 'oem' AND NOT is_read) WHERE place <= 50""",
)
def notifications_latest(d):
    df = Y.latest_notifications(d.notification(), "oem", limit=50, only_unread=True)
    return df.select("id", "user_id", "type", instant("created_at").alias("created_at"), big("place").alias("place"))


@register(
    "notifications_user_unread",
    "SELECT id, user_id, type FROM v_notification WHERE audience = 'user' AND NOT is_read",
)
def notifications_user_unread(d):
    return Y.latest_notifications(d.notification(), "user", limit=None, only_unread=True).select("id", "user_id", "type")


@register(
    "notification_candidates",
    f"""SELECT x.*, NOT EXISTS (SELECT 1 FROM v_pair_notification e WHERE e.user_id = x.user_id AND e.warranty_id = x.warranty_id AND e.type = x.type AND NOT e.is_read
        AND e.created_at >= {NOW} - INTERVAL 7 DAY) AS is_new FROM (SELECT user_id, warranty_id, n.t AS type, n.m AS message, n.s AS severity FROM (
      SELECT w.user_id, w.warranty_id, unnest(list_filter([
        struct_pack(t := 'warranty_onboarded', m := 'We’ve registered your ' || coalesce(nullif(product_name, ''), 'device') || ' and started health checks.', s := 'info'),
        CASE s.risk_label WHEN 'MEDIUM' THEN struct_pack(t := 'risk_medium', m := 'Our checks suggest this device may need some care soon.', s := 'warning') END,
        CASE s.risk_label WHEN 'HIGH' THEN struct_pack(t := 'risk_high', m := 'This device shows a high risk of issues. Consider backup or service.', s := 'critical') END,
        CASE WHEN w.category = 'ev' AND e.ev_label IN ('MEDIUM', 'HIGH') THEN struct_pack(t := 'ev_battery_risk', m := 'We’ve detected potential stress on your EV battery. See EV tips in your dashboard.',
          s := CASE e.ev_label WHEN 'MEDIUM' THEN 'warning' ELSE 'critical' END) END,
        CASE WHEN w.expiry_date - {TODAY} BETWEEN 0 AND 30 THEN struct_pack(t := 'expiry_soon', m := 'Your warranty expires in ' || (w.expiry_date - {TODAY})
          || ' days. Consider backing up receipts or buying extended cover.', s := 'warning') END], lambda x: x IS NOT NULL)) AS n
      FROM (SELECT *, {_CATEGORY} AS category FROM {_NAMED}) w LEFT JOIN v_score s USING (user_id, warranty_id) LEFT JOIN ({EV_SCORE_SQL}) e ON e.user_id = w.user_id AND e.warranty_id = w.warranty_id)) x""",
)
def notification_candidates(d):
    """Every onboarding notification, marked with whether an unread stored one suppresses it."""
    found = Y.onboarding_candidates(d.warranty(), scores(d), ev_scores(d), AS_OF)
    open_keys = (
        d.pair_notification()
        .where(~F.col("is_read") & (F.col("created_at") >= S.ts_lit(AS_OF) - F.expr("INTERVAL 7 DAYS")))
        .select(*Y.KEY)
        .distinct()
        .withColumn("stored", F.lit(True))
    )
    return found.join(open_keys, Y.KEY, "left").select(*PAIR, "type", "message", "severity", F.col("stored").isNull().alias("is_new"))


@register(
    "scoring_notifications",
    f"""SELECT user_id, warranty_id, n.t AS type, n.h AS title, n.m AS message, n.s AS severity FROM (
      SELECT s.user_id, s.warranty_id, unnest(list_filter([
        CASE s.risk_label WHEN 'MEDIUM' THEN struct_pack(t := 'risk_medium', h := 'Risk Medium detected', m := 'Predictive model flagged medium risk for warranty ' || s.warranty_id || '.', s := 'warning')
          WHEN 'HIGH' THEN struct_pack(t := 'risk_high', h := 'Risk High detected', m := 'Predictive model flagged high risk for warranty ' || s.warranty_id || '.', s := 'critical') END,
        CASE WHEN w.expiry_date - {TODAY} < 30 THEN struct_pack(t := 'expiry_soon', h := 'Warranty expiring soon', m := 'Warranty ' || s.warranty_id || ' ends in ' || greatest(w.expiry_date - {TODAY}, 0) || ' days.',
          s := CASE WHEN w.expiry_date - {TODAY} > 0 THEN 'warning' ELSE 'critical' END) END], lambda x: x IS NOT NULL)) AS n
      FROM v_score s LEFT JOIN v_warranty w ON w.warranty_id = s.warranty_id)""",
)
def scoring_notifications(d):
    """What scoring every pair would notify about; expired warranties included."""
    return Y.scoring_candidates(scores(d), d.warranty(), AS_OF).select(*PAIR, "type", "title", "message", "severity")


# --- peer signals, searches, interest -------------------------------------------------------------


@register(
    "peer_signal_upsert",
    """SELECT warranty_id, brand, model, coalesce(arg_max(product_type, id) FILTER (product_type <> ''), arg_min_null(product_type, id)) AS product_type,
      coalesce(arg_max(symptom_keyword, id) FILTER (symptom_keyword <> ''), arg_min_null(symptom_keyword, id)) AS symptom_keyword,
      coalesce(arg_max(severity_hint, id) FILTER (severity_hint <> ''), arg_min_null(severity_hint, id)) AS severity_hint,
      CAST(arg_max(avg_rating, id) FILTER (avg_rating IS NOT NULL) AS BIGINT) AS avg_rating, CAST(arg_max(review_sentiment, id) FILTER (review_sentiment IS NOT NULL) AS BIGINT) AS review_sentiment,
      CAST(coalesce(len(arg_max(failure_keywords, id) FILTER (len(failure_keywords) > 0)), 0) AS BIGINT) AS keywords, strftime(max(last_updated_at), '%Y-%m-%d %H:%M:%S.%f') AS last_updated_at
    FROM v_peer_signal GROUP BY warranty_id, brand, model""",
)
def peer_signal_upsert(d):
    return G.upsert_peer_signals(d.peer_signal()).select(
        "warranty_id", "brand", "model", "product_type", "symptom_keyword", "severity_hint", big("avg_rating").alias("avg_rating"),
        big("review_sentiment").alias("review_sentiment"), big(F.size("failure_keywords")).alias("keywords"), instant("last_updated_at").alias("last_updated_at"),
    )


PEER_WARRANTIES = """SELECT warranty_id, user_id, CASE WHEN contains(model_code, 'ECONOMY') THEN 'src1' WHEN brand IS NOT NULL THEN 'src2' ELSE '' END AS brand,
  'M' || (length(model_code) % 4) AS model_code FROM v_warranty"""
PEER_SQL = f"""SELECT w.warranty_id, w.user_id, coalesce(o.avg_rating, f.avg_rating, 0)::DOUBLE AS avg_rating, coalesce(o.review_sentiment, f.review_sentiment, 0)::DOUBLE AS review_sentiment,
  CAST(coalesce(o.kw, f.kw, 0) AS BIGINT) AS failure_keyword_count FROM ({PEER_WARRANTIES}) w
  LEFT JOIN (SELECT warranty_id, coalesce(avg_rating, 0) AS avg_rating, coalesce(review_sentiment, 0) AS review_sentiment, len(failure_keywords) AS kw FROM v_peer_signal
    WHERE warranty_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY warranty_id ORDER BY last_updated_at DESC, id DESC) = 1) o USING (warranty_id)
  LEFT JOIN (SELECT brand, model, coalesce(avg_rating, 0) AS avg_rating, coalesce(review_sentiment, 0) AS review_sentiment, len(failure_keywords) AS kw FROM v_peer_signal
    QUALIFY row_number() OVER (PARTITION BY brand, model ORDER BY last_updated_at DESC, id DESC) = 1) f ON f.brand = w.brand AND f.model = w.model_code"""


def peer_input(d):
    """Warranties under the brand and model names the review sources use."""
    return d.warranty().selectExpr(
        "warranty_id",
        "user_id",
        "CASE WHEN contains(model_code, 'ECONOMY') THEN 'src1' WHEN brand IS NOT NULL THEN 'src2' END AS brand",
        "concat('M', length(model_code) % 4) AS model_code",
    )


@register("peer_features", PEER_SQL)
def peer_features(d):
    return G.peer_features(peer_input(d), d.peer_signal()).withColumn("failure_keyword_count", big("failure_keyword_count"))


@register(
    "peer_issue_stats",
    """SELECT brand, count(*) AS signals, CAST(sum(coalesce(avg_rating, 0)) AS DOUBLE) / count(*) AS avg_rating, CAST(sum(coalesce(review_sentiment, 0)) AS DOUBLE) / count(*) AS avg_sentiment
      FROM v_peer_signal GROUP BY brand""",
)
def peer_issue_stats(d):
    return G.peer_issue_stats(d.peer_signal(), ["brand"])


@register("peer_severity", "SELECT brand, severity_hint, count(*) AS n FROM v_peer_signal WHERE severity_hint <> '' GROUP BY brand, severity_hint")
def peer_severity(d):
    return G.peer_severity(d.peer_signal(), ["brand"])


@register(
    "peer_top_keywords",
    """SELECT brand, keyword, n, row_number() OVER (PARTITION BY brand ORDER BY n DESC, keyword) AS place FROM (SELECT brand, keyword, count(*) AS n FROM (
      SELECT brand, unnest(list_concat(CASE WHEN symptom_keyword <> '' THEN [symptom_keyword] ELSE [] END, failure_keywords)) AS keyword FROM v_peer_signal) GROUP BY brand, keyword)
      QUALIFY place <= 5""",
)
def peer_top_keywords(d):
    return G.peer_top_keywords(d.peer_signal(), ["brand"]).withColumn("place", big("place"))


@register(
    "search_features",
    """SELECT user_id, warranty_id, count(*) AS search_count, count(*) FILTER (nullif(matched_component, '') IS NULL) AS unresolved,
      count(DISTINCT coalesce(nullif(matched_component, ''), 'other')) AS components FROM v_symptom_search GROUP BY user_id, warranty_id""",
)
def search_features(d):
    return G.search_features(d.symptom_search())


@register(
    "search_components",
    "SELECT user_id, warranty_id, coalesce(nullif(matched_component, ''), 'other') AS component, count(*) AS n FROM v_symptom_search GROUP BY 1, 2, 3",
)
def search_components(d):
    return G.search_components(d.symptom_search())


_TOKENS = f"SELECT unnest(regexp_split_to_array(lower(query_text), '[{SPACE}]+')) AS token FROM v_symptom_search"


@register("symptom_top_tokens", f"SELECT token, count(*) AS n FROM ({_TOKENS}) WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 5")
def symptom_top_tokens(d):
    return G.symptom_top_tokens(d.symptom_search())


@register(
    "symptom_top_components",
    "SELECT matched_component AS component, count(*) AS n FROM v_symptom_search WHERE matched_component <> '' GROUP BY 1 ORDER BY n DESC, component LIMIT 5",
)
def symptom_top_components(d):
    return G.symptom_top_components(d.symptom_search())


@register(
    "product_interest_top",
    """SELECT product_id, count(*) AS n, arg_min(coalesce(title, product_id), id) AS title FROM v_interest WHERE (region IS NULL OR region = 'APAC') AND (risk_band IS NULL OR risk_band = 'HIGH')
      GROUP BY product_id ORDER BY n DESC, product_id LIMIT 5""",
)
def product_interest_top(d):
    return G.interest_top(d.interest(), region="APAC", risk_band="HIGH")


# --- manufacturers ----------------------------------------------------------------------------------


@register("oem_question_normalize", "SELECT id, brand, model_code, region, text, answer_type, options, CAST(priority AS BIGINT) AS priority, published AS enabled, source FROM v_oem_question")
def oem_question_normalize(d):
    return O.normalize_questions(d.oem_question_raw()).select(
        "id", "brand", "model_code", "region", "text", "answer_type", joined("options").alias("options"), big("priority").alias("priority"), "enabled", "source"
    )


@register("oem_questions_active", "SELECT id, brand, region, CAST(priority AS BIGINT) AS priority FROM v_oem_question WHERE enabled AND region = 'APAC'")
def oem_questions_active(d):
    return O.active_questions(oem_questions(d), region="APAC").select("id", "brand", "region", big("priority").alias("priority"))


@register(
    "oem_recs_active",
    """SELECT id, product_type, brand, region, title, tags, source FROM v_oem_rec WHERE status = 'active' AND (coalesce(product_type, '') = '' OR product_type = 'fridge') AND (region IS NULL OR region = 'EU')""",
)
def oem_recs_active(d):
    recs = O.disable_by_log(O.normalize_recommendations(d.oem_rec_raw()), d.oem_rec_disabled(), "status", "disabled")
    return O.active_recommendations(recs, product_type="fridge", region="EU").select("id", "product_type", "brand", "region", "title", joined("tags").alias("tags"), "source")


def scored_profiles(d):
    return O.score_profiles(O.compact_profiles(d.profile()), d.warranty(), scores(d))


@register(
    "oem_behaviour_stats",
    """SELECT coalesce(nullif(brand, ''), 'unknown') AS brand, coalesce(nullif(model_code, ''), 'unknown') AS model_code, CAST(sum(behaviour_h) AS DOUBLE) / (count(*) * 100) AS avg_behaviour,
      CAST(sum(care_h) AS DOUBLE) / (count(*) * 100) AS avg_care, CAST(sum(resp_h) AS DOUBLE) / (count(*) * 100) AS avg_responsiveness,
      CAST(sum(score_h) AS DOUBLE) / (count(*) * 100) AS avg_predictive_risk, count(*) AS sample_size FROM v_profile_score WHERE known GROUP BY 1, 2""",
)
def oem_behaviour_stats(d):
    return O.behaviour_stats(scored_profiles(d))


_LABELS = "(VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('UNKNOWN')) l(label)"
_MINE = "(SELECT * FROM v_profile_score WHERE NOT known OR brand = 'Brand#13')"


@register("oem_risk_distribution", f"SELECT label AS risk_label, (SELECT count(*) FROM {_MINE} WHERE risk_label = label) AS n FROM {_LABELS}")
def oem_risk_distribution(d):
    return O.risk_distribution(O.for_brand(scored_profiles(d), brand="Brand#13"))


@register(
    "oem_behaviour_snapshot",
    """SELECT CAST(sum(behaviour_h) AS DOUBLE) / (count(*) * 100) AS behaviour_score, CAST(sum(care_h) AS DOUBLE) / (count(*) * 100) AS care_score,
      CAST(sum(resp_h) AS DOUBLE) / (count(*) * 100) AS responsiveness_score, count(*) AS n FROM v_profile""",
)
def oem_behaviour_snapshot(d):
    return O.behaviour_snapshot(O.compact_profiles(d.profile()))


def _ev_of(rows: str) -> str:
    latest = "SELECT * FROM v_ev_telemetry QUALIFY row_number() OVER (PARTITION BY user_id, warranty_id ORDER BY id DESC) = 1"
    return ev_scored(
        f"""SELECT p.behaviour_h, p.care_h, coalesce(t.daily_km, 40) AS daily_km, coalesce(t.fast_charge_sessions, 4) AS fast_charge_sessions, coalesce(t.deep_discharge_events, 1) AS deep_discharge_events,
        coalesce(t.max_temp_seen, 32) AS max_temp_seen, coalesce(t.region_climate_band, 1) AS region_climate_band FROM {rows} p LEFT JOIN ({latest}) t ON t.user_id = p.user_id AND t.warranty_id = p.warranty_id
        WHERE contains(lower(coalesce(p.product_name, '')), 'ev') OR contains(lower(coalesce(p.product_type, '')), 'ev')"""
    )


@register("oem_ev_distribution", f"SELECT label AS ev_label, (SELECT count(*) FROM ({_ev_of('v_profile_score')}) WHERE ev_label = label) AS n FROM {_LABELS}")
def oem_ev_distribution(d):
    return O.ev_distribution(scored_profiles(d), d.ev_telemetry())


@register(
    "high_risk_clusters",
    """SELECT brand, region_code, total, high, 'We’ve detected an elevated number of HIGH-risk warranties for ' || coalesce(brand, 'your brand') || ' in region ' || coalesce(region_code, 'all regions')
      || '. Check OEM Analytics to review affected devices.' AS message FROM (SELECT brand, region_code, count(*) AS total, count(*) FILTER (risk_label = 'HIGH') AS high FROM v_profile_score WHERE known GROUP BY brand, region_code)
      WHERE high >= 10 OR high * 10 >= total * 3""",
)
def high_risk_clusters(d):
    return O.high_risk_clusters(scored_profiles(d))


def _found_sql(peer: str, search: str, brand: str, region: str, profiles: str) -> str:
    """SQL of the dashboard's sections on reviews' words, searches, and the alert; the filters are SQL conditions."""
    return f"""UNION ALL (SELECT 'peer_keywords', keyword, CAST(count(*) AS DOUBLE) FROM (SELECT unnest(list_concat(CASE WHEN symptom_keyword <> '' THEN [symptom_keyword] ELSE [] END, failure_keywords)) AS keyword
        FROM v_peer_signal WHERE {peer}) GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 5)
      UNION ALL SELECT 'symptom_searches', 'count', CAST(count(*) AS DOUBLE) FROM v_symptom_search WHERE {search}
      UNION ALL (SELECT 'symptom_components', matched_component, CAST(count(*) AS DOUBLE) FROM v_symptom_search WHERE matched_component <> '' AND {search} GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 5)
      UNION ALL (SELECT 'symptom_words', token, CAST(count(*) AS DOUBLE) FROM ({_TOKENS} WHERE {search}) WHERE token <> '' GROUP BY token ORDER BY count(*) DESC, token LIMIT 5)
      UNION ALL SELECT 'cluster_alert', 'We’ve detected an elevated number of HIGH-risk warranties for {brand} in region {region}. Check OEM Analytics to review affected devices.', CAST(high AS DOUBLE) FROM (
        SELECT count(*) AS total, count(*) FILTER (risk_label = 'HIGH') AS high FROM {profiles}) WHERE total > 0 AND (high >= 10 OR high * 10 >= total * 3)"""


@register(
    "oem_dashboard",
    f"""SELECT 'risk_distribution' AS section, label AS item, CAST((SELECT count(*) FROM {_MINE} WHERE risk_label = label) AS DOUBLE) AS value FROM {_LABELS}
      UNION ALL SELECT 'behaviour_snapshot', k, v FROM (SELECT unnest(['behaviour_score', 'care_score', 'responsiveness_score']) AS k,
        unnest([CAST(sum(behaviour_h) AS DOUBLE) / (count(*) * 100), CAST(sum(care_h) AS DOUBLE) / (count(*) * 100), CAST(sum(resp_h) AS DOUBLE) / (count(*) * 100)]) AS v FROM {_MINE})
      UNION ALL SELECT 'ev_battery', label, CAST((SELECT count(*) FROM ({_ev_of(_MINE)}) WHERE ev_label = label) AS DOUBLE) FROM {_LABELS}
      UNION ALL SELECT 'peer_review', k, v FROM (SELECT unnest(['signals', 'avg_rating', 'avg_sentiment']) AS k,
        unnest([CAST(count(*) AS DOUBLE), CAST(sum(coalesce(avg_rating, 0)) AS DOUBLE) / count(*), CAST(sum(coalesce(review_sentiment, 0)) AS DOUBLE) / count(*)]) AS v FROM v_peer_signal WHERE brand = 'Brand#13' HAVING count(*) > 0)
      UNION ALL SELECT 'peer_severity', severity_hint, CAST(count(*) AS DOUBLE) FROM v_peer_signal WHERE brand = 'Brand#13' AND severity_hint <> '' GROUP BY severity_hint
      {_found_sql("brand = 'Brand#13'", "brand = 'Brand#13' AND region = 'EU'", "Brand#13", "EU", _MINE)}
      UNION ALL (SELECT 'product_interest', product_id, CAST(count(*) AS DOUBLE) FROM v_interest WHERE region IS NULL OR region = 'EU' GROUP BY product_id ORDER BY count(*) DESC, product_id LIMIT 5)""",
)
def oem_dashboard(d):
    """The dashboard of one brand in one region."""
    return O.dashboard(scored_profiles(d), d.ev_telemetry(), d.peer_signal(), d.symptom_search(), d.interest(), brand="Brand#13", region="EU")


@register(
    "oem_dashboard_all",
    f"""SELECT 'risk_distribution' AS section, label AS item, CAST((SELECT count(*) FROM v_profile_score WHERE risk_label = label) AS DOUBLE) AS value FROM {_LABELS}
      UNION ALL SELECT 'behaviour_snapshot', k, v FROM (SELECT unnest(['behaviour_score', 'care_score', 'responsiveness_score']) AS k,
        unnest([CAST(sum(behaviour_h) AS DOUBLE) / (count(*) * 100), CAST(sum(care_h) AS DOUBLE) / (count(*) * 100), CAST(sum(resp_h) AS DOUBLE) / (count(*) * 100)]) AS v FROM v_profile_score)
      UNION ALL SELECT 'ev_battery', label, CAST((SELECT count(*) FROM ({_ev_of('v_profile_score')}) WHERE ev_label = label) AS DOUBLE) FROM {_LABELS}
      UNION ALL SELECT 'peer_review', k, v FROM (SELECT unnest(['signals', 'avg_rating', 'avg_sentiment']) AS k,
        unnest([CAST(count(*) AS DOUBLE), CAST(sum(coalesce(avg_rating, 0)) AS DOUBLE) / count(*), CAST(sum(coalesce(review_sentiment, 0)) AS DOUBLE) / count(*)]) AS v FROM v_peer_signal)
      UNION ALL SELECT 'peer_severity', severity_hint, CAST(count(*) AS DOUBLE) FROM v_peer_signal WHERE severity_hint <> '' GROUP BY severity_hint
      {_found_sql("TRUE", "TRUE", "your brand", "all regions", "v_profile_score")}
      UNION ALL (SELECT 'product_interest', product_id, CAST(count(*) AS DOUBLE) FROM v_interest GROUP BY product_id ORDER BY count(*) DESC, product_id LIMIT 5)""",
)
def oem_dashboard_all(d):
    """The dashboard without a filter."""
    return O.dashboard(scored_profiles(d), d.ev_telemetry(), d.peer_signal(), d.symptom_search(), d.interest())


# --- workflow ---------------------------------------------------------------------------------------


@register(
    "review_backlog",
    "SELECT CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status, o_orderpriority AS action, count(*) AS n FROM orders GROUP BY 1, 2",
)
def review_backlog(d):
    return K.backlog(K.review_state(d.review_event()), "status", "action")


@register(
    "review_state",
    """SELECT o_orderkey AS review_id, o_orderpriority AS action, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status,
      CASE WHEN o_orderstatus <> 'P' THEN 'by ' || o_custkey END AS reason, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate + INTERVAL 5 DAY, '%Y-%m-%d') END AS resolved_on FROM orders""",
)
def review_state(d):
    return K.review_state(d.review_event()).select("review_id", "action", "status", "reason", day("resolved_at").alias("resolved_on"))


@register("fetch_queue_state", "SELECT url, brand, model, region, status FROM v_fetch_queue")
def fetch_queue_state(d):
    return K.fetch_queue(d.fetch_request())


@register(
    "fetch_queue_needing_review",
    "SELECT url, brand, model FROM v_fetch_queue q WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM pages r WHERE r.url = q.url AND r.page_id % 4 = 0)",
)
def fetch_queue_needing_review(d):
    return K.needing_review(K.fetch_queue(d.fetch_request()), d.fetch_review()).select("url", "brand", "model")


@register(
    "fetch_queue_marked",
    """SELECT url, brand, model, CASE WHEN EXISTS (SELECT 1 FROM pages r WHERE r.page_id % 6 <> 5 AND r.url = q.url AND 'B' || (r.page_id % 5) = q.brand
      AND CASE WHEN r.page_id % 6 = 3 THEN 'M9' ELSE 'M' || (r.page_id % 4) END = q.model) THEN 'fetched' ELSE status END AS status FROM v_fetch_queue q""",
)
def fetch_queue_marked(d):
    return K.mark_fetched(K.fetch_queue(d.fetch_request()), d.fetched_page()).select("url", "brand", "model", "status")


@register(
    "ticket_parts",
    """SELECT o_orderkey AS id, 'wty_' || (o_custkey % 150) || '_' || (o_orderkey % 12) AS warranty_id, ['no_cooling', 'noise', 'power_failure', 'other'][o_orderkey % 4 + 1] AS symptom,
      ['capacitor|blower_motor', 'suspension_kit|drum_stabiliser', 'power_board', ''][o_orderkey % 4 + 1] AS parts, 'draft' AS status FROM orders""",
)
def ticket_parts(d):
    return K.ticket_parts(d.ticket()).select("id", "warranty_id", "symptom", joined("parts").alias("parts"), "status")


@register("ticket_backlog", "SELECT 'wty_' || (o_custkey % 150) || '_' || (o_orderkey % 12) AS warranty_id, count(*) AS n FROM orders GROUP BY 1")
def ticket_backlog(d):
    return K.backlog(d.ticket(), "warranty_id")


@register("unread_counts", "SELECT user_id, audience, count(*) AS n FROM v_notification WHERE NOT is_read GROUP BY user_id, audience")
def unread_counts(d):
    return K.backlog(d.notification().where(~F.col("is_read")), "user_id", "audience")


@register("answer_routing", "SELECT id, question_id, CASE WHEN starts_with(question_id, 'oemq_') THEN 'oem' ELSE 'bank' END AS sink FROM v_raw_answer")
def answer_routing(d):
    return K.route_answers(d.raw_answer()).select("id", "question_id", "sink")


@register(
    "audit_redact",
    """SELECT doc_id, 'upload_' || source AS action, sha256(CASE WHEN length(text) > 2000 THEN text[1:2000] || '...(truncated)' ELSE text END) AS detail_hash,
      'len=' || length(text) || ' preview=' || text[1:128] AS redacted FROM documents""",
)
def audit_redact(d):
    return K.audit_rows(d.audit()).select("doc_id", "action", F.sha2("detail", 256).alias("detail_hash"), "redacted")
