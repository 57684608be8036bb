"""The warranty domain as views over the given tables.

The given tables hold no warranties, so each domain table is a deterministic projection or join of
them, over all their rows. Jobs never look behind these views: a deployment replaces
``DomainTables`` by readers of its own tables with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions.text import split_words

AS_OF = "2024-01-31 00:00:00"
#: A day when the recent window starts within the log.
LATE = "2024-02-12 00:00:00"

# Text of an artifact, by the part's key: brand, model, serial, purchase date and coverage.
_ARTIFACT_TEXT = """
concat_ws(
  CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '\\n' END,
  concat('Brand: ', replace(p_brand, '#', '-')),
  concat('Model: ', p_type, '-', p_size),
  CASE WHEN p_partkey % 5 <> 0 THEN concat('Serial: SN', lpad(cast(p_partkey AS string), 6, '0')) END,
  concat('Purchase: ', CASE p_partkey % 4
    WHEN 0 THEN concat_ws('-', cast(1 + p_partkey % 28 AS string), cast(1 + p_partkey % 12 AS string), cast(2020 + p_partkey % 5 AS string))
    WHEN 1 THEN concat_ws('/', cast(1 + p_partkey % 28 AS string), cast(1 + p_partkey % 12 AS string), cast(10 + p_partkey % 90 AS string))
    WHEN 2 THEN '31/02/2023'
    ELSE concat_ws('-', cast(2020 + p_partkey % 5 AS string), lpad(cast(1 + p_partkey % 12 AS string), 2, '0'), lpad(cast(1 + p_partkey % 31 AS string), 2, '0')) END),
  CASE WHEN p_partkey % 6 <> 0 THEN concat(cast(1 + p_size % 36 AS string), ' months warranty') END)
"""

# A manufacturer page, by the part's key: a coverage block and a terms block as each brand names them.
_OEM_HTML = """
CASE WHEN p_partkey % 7 = 0 THEN concat('<html><body><p>', p_name, ' has no block</p></body></html>')
ELSE concat(
  '<html><body><h1>Brand: ', replace(p_brand, '#', '-'), ' | Model: ', p_type, '-', p_size, ' |</h1>',
  '<div class="', CASE p_partkey % 5 WHEN 0 THEN 'box warranty-coverage' WHEN 1 THEN 'warranty-details' WHEN 2 THEN 'service-info wide' WHEN 3 THEN 'warranty' ELSE 'other' END, '">',
  '<b>', 1 + p_size % 36, ' months</b> cover for ', p_name, '</div>',
  '<p>exclusion: ', p_name, ' misuse</p><p>Exclusion - rust, wear</p>',
  '<section id="terms" class="', CASE WHEN p_partkey % 2 = 0 THEN 'terms' ELSE 'conditions small' END, '"><i>Keep</i> the invoice.</section>',
  '<p>motor:5 years compressor warranty:10 years  digital inverter:', 1 + p_size % 9, ' years drum:2 year</p></body></html>') END
"""

_WARRANTY_ID = "concat('wty_', cast(floor({p} / 12) AS bigint), '_', {p} % 12) AS warranty_id"
_OWNER = "cast(floor({p} / 12) AS bigint) AS user_id"
_REGION_CODE = "CASE r_name WHEN 'AFRICA' THEN 'MEA' WHEN 'AMERICA' THEN 'NA' WHEN 'ASIA' THEN 'APAC' WHEN 'EUROPE' THEN 'EU' END AS region_code"


class DomainTables:
    """Domain tables of one data folder; every method returns a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def event(self) -> DataFrame:
        return (
            self.table("events")
            .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
            .selectExpr(
                "event_id",
                "user_id",
                "concat('wty_', user_id, '_', k % 13) AS warranty_id",
                "k",
                "event_type",
                "value",
                "ts",
            )
        )

    def telemetry(self, events: DataFrame | None = None) -> DataFrame:
        return (self.event() if events is None else events).selectExpr(
            "concat('tel_', event_id) AS id",
            "user_id",
            "warranty_id",
            "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'maintenance' WHEN 'purchase' THEN 'failure' ELSE 'usage' END AS event_type",
            """CASE event_type
                 WHEN 'error' THEN concat('{"code": "E', k % 7, '"}')
                 WHEN 'purchase' THEN concat('{"reason": "R', k % 5, '"}')
                 WHEN 'signup' THEN '{}'
                 ELSE concat('{"hours": ', cast(floor(value * 8) AS bigint), ', "errors": ', k % 4, '}') END AS payload""",
            "ts",
        )

    def ev_payload_telemetry(self) -> DataFrame:
        """Telemetry whose payloads carry the EV fields some of the time."""
        return self.event().selectExpr(
            "concat('tel_', event_id) AS id",
            "user_id",
            "warranty_id",
            "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'maintenance' WHEN 'purchase' THEN 'failure' ELSE 'usage' END AS event_type",
            """CASE WHEN k % 3 = 0 THEN '{}'
                 WHEN event_type = 'purchase' THEN concat('{"deep_discharge_events": ', k % 6, '}')
                 WHEN event_type = 'signup' THEN concat('{"max_temp_seen": ', 20 + k % 30, '}')
                 ELSE concat('{"daily_km": ', k, '}') END AS payload""",
            "ts",
        )

    def warranty(self) -> DataFrame:
        parts = self.table("part").selectExpr("*", "cast(floor(p_partkey / 12) AS bigint) AS owner")
        # nation and region are fixed-size dimensions; Spark broadcasts them by their file size.
        where = (
            self.table("customer")
            .join(self.table("nation"), F.expr("c_nationkey = n_nationkey"))
            .join(self.table("region"), F.expr("n_regionkey = r_regionkey"))
            .select("c_custkey", "n_nationkey", "r_name")
        )
        return parts.join(where, F.expr("c_custkey = owner")).selectExpr(
            _WARRANTY_ID.format(p="p_partkey"),
            "owner AS user_id",
            """CASE p_partkey % 8 WHEN 0 THEN 'Galaxy phone' WHEN 1 THEN 'Laptop 14' WHEN 2 THEN 'Fridge Max'
                 WHEN 3 THEN 'Air cooler' WHEN 4 THEN 'EV scooter' WHEN 5 THEN 'Washer 900' WHEN 6 THEN p_name END AS product_name""",
            "CASE WHEN p_partkey % 29 <> 0 THEN p_brand END AS brand",
            "concat(p_type, '-', p_size) AS model_code",
            "date_add(DATE'2022-01-01', cast(p_partkey * 37 % 900 AS int)) AS purchase_date",
            "CASE WHEN p_size % 10 <> 0 THEN 12 * (1 + p_size % 3) END AS coverage_months",
            _REGION_CODE,
            "CASE n_nationkey % 6 WHEN 0 THEN 'hot' WHEN 1 THEN 'humid' WHEN 2 THEN 'dry' WHEN 3 THEN 'cold' WHEN 4 THEN 'coastal' END AS climate_zone",
            "p_size / 100.0D AS oem_risk_factor",
            "(p_partkey % 10) / 10.0D AS brand_reliability_score",
        ).withColumn("expiry_date", F.expr("CASE WHEN coverage_months <> 0 THEN add_months(purchase_date, coverage_months) END"))

    def profile(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "(l_orderkey * 8 + l_linenumber) * 4096 + l_suppkey % 64 * 64 + CAST(l_quantity AS BIGINT) AS id",
            _OWNER.format(p="l_partkey"),
            _WARRANTY_ID.format(p="l_partkey"),
            "CASE l_linenumber WHEN 7 THEN 'EV car' WHEN 1 THEN 'fridge' END AS product_type",
            "cast(l_quantity * 2 AS int) AS behaviour_h",
            "cast(round(l_discount * 1000) AS int) AS care_h",
            "cast(round(l_tax * 1250) AS int) AS resp_h",
            "cast(l_suppkey % 4 AS int) AS aqi_band",
            "CASE WHEN l_suppkey % 3 <> 0 THEN TIMESTAMP_NTZ'2024-01-20 00:00:00' + make_dt_interval(cast(l_suppkey % 20 AS int)) END AS last_question_at",
        )

    def ev_telemetry(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "(l_orderkey * 8 + l_linenumber) * 4096 + l_suppkey % 64 * 64 + CAST(l_quantity AS BIGINT) AS id",
            _OWNER.format(p="l_partkey"),
            _WARRANTY_ID.format(p="l_partkey"),
            "l_quantity * 2 AS daily_km",
            "l_linenumber * 2 AS fast_charge_sessions",
            "cast(round(l_discount * 50) AS int) AS deep_discharge_events",
            "CASE WHEN l_suppkey % 7 <> 6 THEN 20.0D + round(l_tax * 400) END AS max_temp_seen",
            "CASE WHEN l_suppkey % 5 <> 4 THEN cast(l_suppkey % 3 AS int) END AS region_climate_band",
        )

    def artifact(self) -> DataFrame:
        """Invoices composed from parts, and all documents as artifacts of another type."""
        invoices = self.table("part").selectExpr(
            "p_partkey AS ref", "'invoice' AS type", "'upload' AS source", f"{_ARTIFACT_TEXT} AS content"
        )
        others = self.table("documents").selectExpr("doc_id AS ref", "'other' AS type", "source", "text AS content")
        return invoices.unionByName(others)

    def override(self) -> DataFrame:
        """What users corrected; a null leaves the extracted value."""
        return self.table("part").selectExpr(
            "p_partkey AS ref",
            "'invoice' AS type",
            "CASE WHEN p_partkey % 9 = 0 THEN p_name END AS product_name",
            "CASE WHEN p_partkey % 9 = 1 THEN p_brand END AS brand",
            "CASE WHEN p_partkey % 9 = 2 THEN p_type END AS model_code",
            "CASE WHEN p_partkey % 9 = 3 THEN concat('C', p_partkey) END AS serial_no",
            "CASE p_partkey % 9 WHEN 4 THEN concat('2023-', lpad(cast(1 + p_partkey % 12 AS string), 2, '0'), '-15') WHEN 5 THEN 'last spring' END AS purchase_date",
            "CASE p_partkey % 9 WHEN 0 THEN '24' WHEN 6 THEN 'two years' END AS coverage_months",
        )

    def behaviour_event(self) -> DataFrame:
        return self.event().selectExpr(
            "event_id",
            "user_id",
            "warranty_id",
            "CASE event_type WHEN 'click' THEN 'nudge_dismissed' WHEN 'purchase' THEN 'task_completed' WHEN 'error' THEN 'issue_reported' ELSE 'other' END AS event_type",
            "ts",
        )

    def raw_answer(self) -> DataFrame:
        """Answers as they arrive, to the question bank and to manufacturer questions alike."""
        bank = ", ".join(f"'{q[0]}'" for q in C.QUESTION_BANK)
        return self.event().selectExpr(
            "event_id AS id",
            "user_id",
            "warranty_id",
            f"""CASE WHEN event_type IN ('view', 'click') THEN element_at(array({bank}), cast(event_id % 6 AS int) + 1)
                 ELSE concat('oemq_', event_id % 100) END AS question_id""",
            "element_at(array('yes', 'no', '1', '2', '4', '5', 'Not sure', 'High'), k % 8 + 1) AS answer_value",
            "CASE WHEN k % 3 = 0 THEN 'fridge' END AS product_type",
            "ts AS created_at",
        )

    def answer(self) -> DataFrame:
        return self.raw_answer().where(~F.col("question_id").startswith("oemq_"))

    def oem_answer(self) -> DataFrame:
        return self.raw_answer().where(F.col("question_id").startswith("oemq_"))

    def scoped_answer(self) -> DataFrame:
        """Answers to the stored, scoped behaviour questions."""
        return self.event().selectExpr(
            "user_id",
            "warranty_id",
            "CASE WHEN k % 3 = 0 THEN 'fridge' WHEN k % 3 = 1 THEN 'ac' END AS product_type",
            "cast(event_id % 50 AS bigint) AS question_id",
        )

    def scoped_question(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey AS id",
            "s_name AS text",
            "'choice' AS answer_type",
            "s_nationkey / 10.0D AS weight",
            "CASE WHEN s_suppkey % 5 <> 0 THEN 1 ELSE 0 END AS is_active",
            "CASE WHEN s_suppkey % 3 <> 0 THEN concat('Brand#', 1 + s_suppkey % 25) END AS brand",
            "CASE WHEN s_suppkey % 10 = 9 THEN concat('ECONOMY-', 1 + s_suppkey % 50) END AS model_code",
            "CASE s_suppkey % 4 WHEN 1 THEN 'fridge' WHEN 2 THEN 'ac' WHEN 3 THEN 'washer' END AS product_type",
        )

    def oem_question_raw(self) -> DataFrame:
        """Questions as manufacturers send them, before defaults are filled in."""
        return self.table("supplier").selectExpr(
            "concat('oemq_', s_suppkey) AS id",
            "CASE WHEN s_suppkey % 7 <> 0 THEN concat('Brand#', 1 + s_suppkey % 25) END AS brand",
            "CASE WHEN s_suppkey % 2 = 1 THEN concat('ECONOMY-', 1 + s_suppkey % 50) END AS model_code",
            "CAST(NULL AS string) AS product_type",
            "CASE s_nationkey % 5 WHEN 0 THEN 'MEA' WHEN 1 THEN 'NA' WHEN 2 THEN 'APAC' WHEN 3 THEN 'EU' END AS region",
            "concat('  ', s_name, ' ') AS text",
            "CASE s_suppkey % 3 WHEN 0 THEN 'choice' WHEN 1 THEN '' END AS answer_type",
            "CASE WHEN s_suppkey % 3 = 0 THEN array('Yes', 'No') END AS options",
            "CASE WHEN s_suppkey % 6 <> 0 THEN cast(s_suppkey % 10 * 10 AS int) END AS priority",
            "CASE WHEN s_suppkey % 4 = 3 THEN false WHEN s_suppkey % 4 = 2 THEN true END AS enabled",
            "CASE WHEN s_suppkey % 2 = 0 THEN 'generated' END AS source",
            "s_suppkey AS seq",
        )

    def oem_question_disabled(self) -> DataFrame:
        """Ids of questions that were switched off later."""
        return self.table("nation").selectExpr("concat('oemq_', n_nationkey * 3) AS id")

    def oem_rec_raw(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "concat('oemr_', s_suppkey) AS id",
            "CASE s_suppkey % 4 WHEN 1 THEN 'fridge' WHEN 2 THEN 'ac' WHEN 3 THEN '' END AS product_type",
            "CASE WHEN s_suppkey % 7 <> 0 THEN concat('Brand#', 1 + s_suppkey % 25) END AS brand",
            "CAST(NULL AS string) AS model",
            "CASE s_nationkey % 5 WHEN 0 THEN 'MEA' WHEN 1 THEN 'NA' WHEN 2 THEN 'APAC' WHEN 3 THEN 'EU' END AS region",
            "s_name AS title",
            "concat('Offer from ', s_name) AS message",
            "CASE WHEN s_suppkey % 2 = 0 THEN array('offer') END AS tags",
            "CASE s_suppkey % 9 WHEN 3 THEN 'draft' WHEN 4 THEN '' END AS status",
            "CASE WHEN s_suppkey % 2 = 0 THEN 'feed' END AS source",
        )

    def oem_rec_disabled(self) -> DataFrame:
        return self.table("nation").selectExpr("concat('oemr_', n_nationkey * 4) AS id")

    def nudge_event(self) -> DataFrame:
        return self.event().selectExpr(
            "event_id AS id",
            "user_id",
            "warranty_id",
            "element_at(array('snapshot', 'care', 'expiry'), k % 3 + 1) AS nudge_type",
            "CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS variant",
            "CASE event_type WHEN 'purchase' THEN 'acted' WHEN 'error' THEN 'ignored' ELSE 'dismissed' END AS outcome",
            "ts AS shown_at",
            "CASE WHEN event_type = 'purchase' THEN ts END AS acted_at",
            "CASE WHEN event_type IN ('error', 'purchase') AND k % 4 <> 1 THEN ts END AS ignored_at",
        )

    def policy_assignment(self) -> DataFrame:
        """Logged experiment assignments, with repeats; rows without a variant carry none."""
        return self.table("lineitem").selectExpr(
            "(l_orderkey * 8 + l_linenumber) * 4096 + l_suppkey % 64 * 64 + CAST(l_quantity AS BIGINT) AS id",
            "'fogg_nudge' AS experiment",
            _OWNER.format(p="l_partkey"),
            _WARRANTY_ID.format(p="l_partkey"),
            "CASE WHEN l_tax > 0.075D AND l_returnflag = 'A' THEN 'A' WHEN l_tax > 0.075D AND l_returnflag = 'R' THEN 'B' END AS variant",
        )

    def interest(self) -> DataFrame:
        ids = ", ".join(f"'{p[0]}'" for p in C.PRODUCT_CATALOG)
        region = (
            self.table("customer")
            .join(self.table("nation"), F.expr("c_nationkey = n_nationkey"))
            .join(self.table("region"), F.expr("n_regionkey = r_regionkey"))
            .selectExpr("c_custkey", _REGION_CODE.replace("region_code", "region"))
        )
        return (
            self.event()
            .join(region, F.expr("c_custkey = user_id"), "left")
            .selectExpr(
                "event_id AS id",
                "user_id",
                "warranty_id",
                f"element_at(array({ids}), cast(event_id % 13 AS int) + 1) AS product_id",
                "region",
                "element_at(array('LOW', 'MEDIUM', 'HIGH', NULL), k % 4 + 1) AS risk_band",
                "CASE WHEN k % 3 <> 0 THEN concat('Offer ', k % 5) END AS title",
                "ts",
            )
        )

    def symptom_search(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id AS id",
            "doc_id % 15 AS user_id",
            "concat('wty_', doc_id % 15, '_', doc_id % 12) AS warranty_id",
            "lang AS product_type",
            "CASE WHEN doc_id % 3 = 0 THEN 'Brand#13' ELSE source END AS brand",
            "CAST(NULL AS string) AS model",
            "CASE doc_id % 4 WHEN 0 THEN 'EU' WHEN 1 THEN 'NA' WHEN 2 THEN 'APAC' END AS region",
            "text AS query_text",
            "CASE doc_id % 7 WHEN 0 THEN 'motor' WHEN 1 THEN 'drum' WHEN 2 THEN 'bearing' WHEN 3 THEN 'pump' WHEN 4 THEN 'seal' WHEN 5 THEN '' END AS matched_component",
            "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id AS int)) AS created_at",
        )

    def peer_signal(self) -> DataFrame:
        return (
            self.table("labels")
            .join(self.table("documents"), "doc_id")
            .withColumn("failure_keywords", split_words(F.col("text")))
            .selectExpr(
                "doc_id AS id",
                "CASE WHEN doc_id % 3 <> 0 THEN concat('wty_', doc_id % 15, '_', doc_id % 12) END AS warranty_id",
                "lang AS product_type",
                "CASE WHEN doc_id % 3 = 0 THEN 'Brand#13' ELSE source END AS brand",
                "concat('M', doc_id % 4) AS model",
                "CASE WHEN doc_id % 5 <> 0 THEN 1 + 4 * quality END AS avg_rating",
                "CASE WHEN doc_id % 7 <> 0 THEN quality - toxic END AS review_sentiment",
                "CASE doc_id % 6 WHEN 0 THEN 'motor' WHEN 1 THEN 'drum' WHEN 2 THEN 'bearing' WHEN 3 THEN 'pump' WHEN 4 THEN '' END AS symptom_keyword",
                "CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' END AS severity_hint",
                "failure_keywords",
                "source",
                "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id AS int)) AS last_updated_at",
            )
        )

    def notification(self) -> DataFrame:
        """Stored notifications: one per event, addressed to the user without a warranty."""
        return self.event().selectExpr(
            "concat('ntf_', event_id) AS id",
            "user_id",
            "CAST(NULL AS string) AS warranty_id",
            "event_type AS type",
            "CASE WHEN k % 11 = 0 THEN 'oem' ELSE 'user' END AS audience",
            "k % 5 = 0 AS is_read",
            "ts AS created_at",
        )

    def notification_candidate(self) -> DataFrame:
        """Notifications about to be sent: one per user and event type seen."""
        return self.notification().groupBy("user_id", "warranty_id", "type", "audience").agg(F.count(F.lit(1)).alias("n"))

    def read_mark(self) -> DataFrame:
        """Read receipts; some come from a user who does not own the notification."""
        return self.event().selectExpr(
            "concat('ntf_', event_id) AS notification_id",
            "CASE WHEN k % 8 = 5 THEN user_id + 1 ELSE user_id END AS user_id",
            "k % 4 = 1 AS marked",
        )

    def pair_notification(self) -> DataFrame:
        """Stored notifications of single warranties, of the kinds the onboarding check sends."""
        return self.event().selectExpr(
            "concat('ntp_', event_id) AS id",
            "user_id",
            "warranty_id",
            "CASE event_type WHEN 'error' THEN 'risk_medium' WHEN 'purchase' THEN 'risk_high' WHEN 'signup' THEN 'warranty_onboarded' WHEN 'view' THEN 'expiry_soon' ELSE 'ev_battery_risk' END AS type",
            "'user' AS audience",
            "k % 5 = 0 AS is_read",
            "ts AS created_at",
        )

    def review_event(self) -> DataFrame:
        """Review log: created as pending, then approved or rejected five days later if resolved."""
        created = self.table("orders").selectExpr(
            "o_orderkey AS review_id",
            "o_orderpriority AS action",
            "'pending' AS status",
            "CAST(NULL AS string) AS reason",
            "o_orderdate AS at",
        )
        resolved = self.table("orders").where("o_orderstatus IN ('F', 'O')").selectExpr(
            "o_orderkey AS review_id",
            "o_orderpriority AS action",
            "CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status",
            "concat('by ', o_custkey) AS reason",
            "o_orderdate + INTERVAL 5 DAYS AS at",
        )
        return created.unionByName(resolved)

    def fetch_request(self) -> DataFrame:
        return self.table("pages").selectExpr(
            "url AS id",
            "url",
            "concat('B', page_id % 5) AS brand",
            "concat('M', page_id % 4) AS model",
            "element_at(array('EU', 'NA', NULL), cast(page_id % 3 AS int) + 1) AS region",
            "element_at(array('pending', 'fetched', 'failed'), cast(page_id % 3 AS int) + 1) AS status",
            "page_id AS seq",
        )

    def fetch_review(self) -> DataFrame:
        return self.table("pages").selectExpr(
            "url",
            "CASE WHEN page_id % 2 = 0 THEN 'oem_fetch' ELSE 'other' END AS action",
            "CASE WHEN page_id % 4 = 0 THEN 'pending' ELSE 'approved' END AS status",
        )

    def fetched_page(self) -> DataFrame:
        """Pages that arrived, for the brand and model they were asked for (some for another model)."""
        return self.table("pages").selectExpr(
            "CASE WHEN page_id % 6 <> 5 THEN url END AS url",
            "concat('B', page_id % 5) AS brand",
            "CASE WHEN page_id % 6 = 3 THEN 'M9' ELSE concat('M', page_id % 4) END AS model",
        )

    def oem_page(self) -> DataFrame:
        """Manufacturer pages composed from parts, and all raw web pages with a brand hint.

        A part's page is many times larger than its row, so parts are dealt out before: by its bytes a file of a million
        parts is one task.
        """
        made = self.table("part").repartition("p_partkey").selectExpr(
            "concat('part/', p_partkey) AS url",
            "element_at(array('samsung', 'lg', 'bosch', 'whirlpool', 'Other'), cast(p_partkey % 5 AS int) + 1) AS brand_hint",
            "concat(p_type, '-', p_size) AS model",
            "element_at(array('EU', 'NA', NULL), cast(p_partkey % 3 AS int) + 1) AS region",
            f"{_OEM_HTML} AS html",
        )
        raw = self.table("pages").selectExpr(
            "concat('page/', page_id) AS url",
            "element_at(array('Samsung', 'LG', 'bosch', 'whirlpool', NULL), cast(page_id % 5 AS int) + 1) AS brand_hint",
            "concat('M', page_id % 4) AS model",
            "element_at(array('EU', 'NA', NULL), cast(page_id % 3 AS int) + 1) AS region",
            "html",
        )
        return made.unionByName(raw)

    def ticket(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS id",
            "concat('wty_', o_custkey % 150, '_', o_orderkey % 12) AS warranty_id",
            "element_at(array('no_cooling', 'noise', 'power_failure', 'other'), cast(o_orderkey % 4 AS int) + 1) AS symptom",
        )

    def rule(self) -> DataFrame:
        """Stored recommendation rules, one per nation."""
        return self.table("nation").selectExpr(
            "n_nationkey AS id",
            "concat('SEG_', n_nationkey % 4) AS segment",
            """CASE n_nationkey % 6
                 WHEN 0 THEN concat('{"min_aqi_band": ', n_nationkey % 4, '}')
                 WHEN 1 THEN '{"min_risk_label": "high"}'
                 WHEN 2 THEN '{"min_risk_label": "MEDIUM", "max_behaviour_score": 0.6, "max_care_score": 0.5}'
                 WHEN 3 THEN '{"product_type_filter": ["fridge", "ac"]}'
                 WHEN 4 THEN '{"product_type_filter": "my ev car park", "max_care_score": 0.3}'
                 ELSE '{}' END AS condition_json""",
            "n_name AS title",
            "concat('Message of ', n_name) AS message",
            "cast(n_nationkey * 7 % 10 AS int) AS priority",
            "CASE WHEN n_nationkey % 5 = 4 THEN 0 ELSE 1 END AS active",
        )

    def audit(self) -> DataFrame:
        return self.table("documents").selectExpr("doc_id", "concat('upload_', source) AS action", "text AS content")


class StreamedTables(DomainTables):
    """The same views with one table read as a stream of files, a bounded number per batch."""

    def __init__(self, spark: SparkSession, folder: str, streamed: str, path: str | None = None, files_per_trigger: int = 64):
        super().__init__(spark, folder)
        self.streamed = streamed
        self.path = path
        self.files_per_trigger = files_per_trigger

    def table(self, name: str) -> DataFrame:
        if name != self.streamed:
            return super().table(name)
        reader = self.spark.readStream.schema(super().table(name).schema).option("maxFilesPerTrigger", self.files_per_trigger)
        if self.path:
            return reader.parquet(self.path)
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)
