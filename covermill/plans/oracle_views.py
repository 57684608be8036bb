"""The domain views in DuckDB SQL, as common table expressions for the check queries."""

from __future__ import annotations

import re

from covermill import constants as C

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
AS_OF_DAY = "DATE '2024-01-31'"
#: A day when the recent window starts within the log.
LATE = "TIMESTAMP '2024-02-12 00:00:00'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def _wid(p: str) -> str:
    return f"'wty_' || CAST(floor({p} / 12) AS BIGINT) || '_' || ({p} % 12)"


def _owner(p: str) -> str:
    return f"CAST(floor({p} / 12) AS BIGINT)"


_REGION = "CASE r_name WHEN 'AFRICA' THEN 'MEA' WHEN 'AMERICA' THEN 'NA' WHEN 'ASIA' THEN 'APAC' WHEN 'EUROPE' THEN 'EU' END"
_KIND = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'maintenance' WHEN 'purchase' THEN 'failure' ELSE 'usage' END"
SPACE = C.UNICODE_SPACE

VIEWS: dict[str, str] = {
    "v_event": """SELECT event_id, user_id, 'wty_' || user_id || '_' || (k % 13) AS warranty_id, k, event_type, value, ts
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "v_telemetry": f"""SELECT 'tel_' || event_id AS id, user_id, warranty_id, {_KIND} AS event_type,
      CASE event_type WHEN 'error' THEN '{{"code": "E' || (k % 7) || '"}}'
        WHEN 'purchase' THEN '{{"reason": "R' || (k % 5) || '"}}'
        WHEN 'signup' THEN '{{}}'
        ELSE '{{"hours": ' || CAST(floor(value * 8) AS BIGINT) || ', "errors": ' || (k % 4) || '}}' END AS payload,
      CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value * 8) AS BIGINT) END AS hours,
      CASE WHEN event_type IN ('view', 'click') THEN k % 4 END AS errors, ts
      FROM v_event""",
    "v_ev_payload": f"""SELECT 'tel_' || event_id AS id, user_id, warranty_id, {_KIND} AS event_type, k, ts,
      CASE WHEN k % 3 <> 0 AND event_type = 'purchase' THEN k % 6 END AS deep,
      CASE WHEN k % 3 <> 0 AND event_type = 'signup' THEN 20 + k % 30 END AS temp,
      CASE WHEN k % 3 <> 0 AND event_type IN ('view', 'click') THEN k END AS km
      FROM v_event""",
    "v_warranty": f"""SELECT *, CASE WHEN coverage_months <> 0 THEN CAST(purchase_date + to_months(coverage_months) AS DATE) END AS expiry_date FROM (
      SELECT {_wid('p_partkey')} AS warranty_id, {_owner('p_partkey')} AS user_id,
        CASE p_partkey % 8 WHEN 0 THEN 'Galaxy phone' WHEN 1 THEN 'Laptop 14' WHEN 2 THEN 'Fridge Max' WHEN 3 THEN 'Air cooler'
          WHEN 4 THEN 'EV scooter' WHEN 5 THEN 'Washer 900' WHEN 6 THEN p_name END AS product_name,
        CASE WHEN p_partkey % 29 <> 0 THEN p_brand END AS brand, p_type || '-' || p_size AS model_code,
        DATE '2022-01-01' + CAST(p_partkey * 37 % 900 AS INTEGER) AS purchase_date,
        CASE WHEN p_size % 10 <> 0 THEN 12 * (1 + p_size % 3) END AS coverage_months,
        {_REGION} AS region_code,
        CASE n_nationkey % 6 WHEN 0 THEN 'hot' WHEN 1 THEN 'humid' WHEN 2 THEN 'dry' WHEN 3 THEN 'cold' WHEN 4 THEN 'coastal' END AS climate_zone,
        CAST(p_size AS DOUBLE) / 100 AS oem_risk_factor, CAST(p_partkey % 10 AS DOUBLE) / 10 AS brand_reliability_score
      FROM part JOIN customer ON c_custkey = {_owner('p_partkey')} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "v_profile": f"""SELECT (l_orderkey * 8 + l_linenumber) * 4096 + l_suppkey % 64 * 64 + CAST(l_quantity AS BIGINT) AS id, {_owner('l_partkey')} AS user_id, {_wid('l_partkey')} AS warranty_id,
      CASE l_linenumber WHEN 7 THEN 'EV car' WHEN 1 THEN 'fridge' END AS product_type,
      CAST(trunc(l_quantity * 2) AS INTEGER) AS behaviour_h, CAST(round(l_discount * 1000) AS INTEGER) AS care_h,
      CAST(round(l_tax * 1250) AS INTEGER) AS resp_h, CAST(l_suppkey % 4 AS INTEGER) AS aqi_band,
      CASE WHEN l_suppkey % 3 <> 0 THEN TIMESTAMP '2024-01-20 00:00:00' + to_days(CAST(l_suppkey % 20 AS INTEGER)) END AS last_question_at
      FROM lineitem""",
    "v_latest_profile": """SELECT * FROM v_profile QUALIFY row_number() OVER (PARTITION BY user_id, warranty_id ORDER BY id DESC) = 1""",
    "v_ev_telemetry": f"""SELECT (l_orderkey * 8 + l_linenumber) * 4096 + l_suppkey % 64 * 64 + CAST(l_quantity AS BIGINT) AS id, {_owner('l_partkey')} AS user_id, {_wid('l_partkey')} AS warranty_id,
      l_quantity * 2 AS daily_km, l_linenumber * 2 AS fast_charge_sessions, CAST(round(l_discount * 50) AS INTEGER) AS deep_discharge_events,
      CASE WHEN l_suppkey % 7 <> 6 THEN 20.0 + round(l_tax * 400) END AS max_temp_seen,
      CASE WHEN l_suppkey % 5 <> 4 THEN CAST(l_suppkey % 3 AS INTEGER) END AS region_climate_band FROM lineitem""",
    "v_artifact": """SELECT p_partkey AS ref, 'invoice' AS type, 'upload' AS source, concat_ws(
      CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE chr(10) END,
      'Brand: ' || replace(p_brand, '#', '-'), 'Model: ' || p_type || '-' || p_size,
      CASE WHEN p_partkey % 5 <> 0 THEN 'Serial: SN' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') END,
      'Purchase: ' || CASE p_partkey % 4
        WHEN 0 THEN (1 + p_partkey % 28) || '-' || (1 + p_partkey % 12) || '-' || (2020 + p_partkey % 5)
        WHEN 1 THEN (1 + p_partkey % 28) || '/' || (1 + p_partkey % 12) || '/' || (10 + p_partkey % 90)
        WHEN 2 THEN '31/02/2023'
        ELSE (2020 + p_partkey % 5) || '-' || lpad(CAST(1 + p_partkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + p_partkey % 31 AS VARCHAR), 2, '0') END,
      CASE WHEN p_partkey % 6 <> 0 THEN (1 + p_size % 36) || ' months warranty' END) AS content FROM part
      UNION ALL SELECT doc_id, 'other', source, text FROM documents""",
    # every candidate date of a text, in order, parsed or null
    "v_artifact_fields": f"""SELECT ref, type, source, content, lo,
        CASE WHEN b <> '' THEN list_aggregate(list_transform(regexp_extract_all(trim(b, ' '), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') END AS brand,
        nullif(upper(m), '') AS model_code, nullif(upper(s), '') AS serial_no,
        list_filter(list_transform(cand, lambda x: CASE
          WHEN regexp_matches(x, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$') THEN CAST(try_strptime(x, '%d-%m-%Y') AS DATE)
          WHEN regexp_matches(x, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN CAST(try_strptime(x, '%d/%m/%Y') AS DATE)
          WHEN regexp_matches(x, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN CAST(try_strptime(x, '%Y-%m-%d') AS DATE)
          WHEN regexp_matches(x, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{2}}$') THEN CAST(try_strptime(x[:-3] || CASE WHEN CAST(x[-2:] AS INT) > 68 THEN '19' ELSE '20' END || x[-2:], '%d-%m-%Y') AS DATE)
          WHEN regexp_matches(x, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}$') THEN CAST(try_strptime(x[:-3] || CASE WHEN CAST(x[-2:] AS INT) > 68 THEN '19' ELSE '20' END || x[-2:], '%d/%m/%Y') AS DATE)
          END), lambda d: d IS NOT NULL)[1] AS purchase_date,
        CASE WHEN contains(lo, 'warranty') THEN TRY_CAST(nullif(c, '') AS INTEGER) END AS coverage_months
      FROM (SELECT *, regexp_extract(lo, '{C.ARTIFACT_PATTERNS["brand"]}', 1) AS b, regexp_extract(lo, '{C.ARTIFACT_PATTERNS["model"]}', 1) AS m,
          regexp_extract(lo, '{C.ARTIFACT_PATTERNS["serial"]}', 2) AS s, regexp_extract(lo, '{C.ARTIFACT_PATTERNS["months"]}', 1) AS c,
          regexp_extract_all(content, '{C.ARTIFACT_PATTERNS["date"]}', 1) AS cand
        FROM (SELECT *, lower(content) AS lo FROM v_artifact))""",
    "v_override": """SELECT p_partkey AS ref, 'invoice' AS type, CASE WHEN p_partkey % 9 = 0 THEN p_name END AS product_name,
      CASE WHEN p_partkey % 9 = 1 THEN p_brand END AS brand, CASE WHEN p_partkey % 9 = 2 THEN p_type END AS model_code,
      CASE WHEN p_partkey % 9 = 3 THEN 'C' || p_partkey END AS serial_no,
      CASE p_partkey % 9 WHEN 4 THEN '2023-' || lpad(CAST(1 + p_partkey % 12 AS VARCHAR), 2, '0') || '-15' WHEN 5 THEN 'last spring' END AS purchase_date,
      CASE p_partkey % 9 WHEN 0 THEN '24' WHEN 6 THEN 'two years' END AS coverage_months FROM part""",
    "v_canonical": f"""SELECT *, CASE WHEN coverage_months <> 0 THEN CAST(purchase_date + to_months(coverage_months) AS DATE) END AS expiry_date FROM (
      SELECT f.ref, f.type, 'wty_' || f.type || '_' || f.ref AS id, o.product_name, coalesce(o.brand, f.brand) AS brand, coalesce(o.model_code, f.model_code) AS model_code,
        coalesce(o.serial_no, f.serial_no) AS serial_no, CASE WHEN o.purchase_date IS NOT NULL THEN TRY_CAST(o.purchase_date AS DATE) ELSE f.purchase_date END AS purchase_date,
        CASE WHEN o.coverage_months IS NOT NULL THEN TRY_CAST(o.coverage_months AS INTEGER) ELSE f.coverage_months END AS coverage_months,
        'art_' || sha256(concat_ws(',', f.type, CAST(f.ref AS VARCHAR), f.source, f.content))[1:32] AS source_artifact_ids,
        concat_ws(',', CASE WHEN o.brand IS NOT NULL THEN 'brand=0.9' WHEN f.brand IS NOT NULL THEN 'brand=0.7' END,
          CASE WHEN o.coverage_months IS NOT NULL THEN 'coverage_months=0.9' WHEN f.coverage_months IS NOT NULL THEN 'coverage_months=0.6' END,
          CASE WHEN o.model_code IS NOT NULL THEN 'model_code=0.9' WHEN f.model_code IS NOT NULL THEN 'model_code=0.65' END, CASE WHEN o.product_name IS NOT NULL THEN 'product_name=0.9' END,
          CASE WHEN o.purchase_date IS NOT NULL THEN 'purchase_date=0.9' WHEN f.purchase_date IS NOT NULL THEN 'purchase_date=0.6' END,
          CASE WHEN o.serial_no IS NOT NULL THEN 'serial_no=0.9' WHEN f.serial_no IS NOT NULL THEN 'serial_no=0.6' END) AS confidence,
        CASE WHEN f.brand IS NULL AND f.model_code IS NULL AND f.serial_no IS NULL AND f.purchase_date IS NULL AND f.coverage_months IS NULL
          THEN 'No strong signals found; manual confirmation required.' END AS notes
      FROM v_artifact_fields f LEFT JOIN v_override o ON o.ref = f.ref AND o.type = f.type)""",
    "v_summary": f"""SELECT id, 'Brand: ' || coalesce(nullif(brand, ''), 'N/A') || ' Model: ' || coalesce(nullif(model_code, ''), 'N/A') || chr(10)
        || 'Expiry: ' || coalesce(CAST(expiry_date AS VARCHAR), 'N/A') || ' Coverage months: ' || coalesce(CAST(nullif(coverage_months, 0) AS VARCHAR), 'N/A') || chr(10)
        || {quoted('Terms: ' + '; '.join(C.WARRANTY_TERMS))} || chr(10) || {quoted('Exclusions: ' + '; '.join(C.WARRANTY_EXCLUSIONS))} || chr(10)
        || {quoted('Claim steps: ' + '; '.join(C.WARRANTY_CLAIM_STEPS))} AS summary FROM v_canonical""",
    "v_behaviour_event": """SELECT event_id, user_id, warranty_id, CASE event_type WHEN 'click' THEN 'nudge_dismissed' WHEN 'purchase' THEN 'task_completed'
      WHEN 'error' THEN 'issue_reported' ELSE 'other' END AS event_type, ts FROM v_event""",
    "v_raw_answer": f"""SELECT event_id AS id, user_id, warranty_id,
      CASE WHEN event_type IN ('view', 'click') THEN {text_list(q[0] for q in C.QUESTION_BANK)}[event_id % 6 + 1] ELSE 'oemq_' || (event_id % 100) END AS question_id,
      ['yes', 'no', '1', '2', '4', '5', 'Not sure', 'High'][k % 8 + 1] AS answer_value,
      CASE WHEN k % 3 = 0 THEN 'fridge' END AS product_type, ts AS created_at FROM v_event""",
    "v_answer": "SELECT * FROM v_raw_answer WHERE NOT starts_with(question_id, 'oemq_')",
    "v_oem_answer": "SELECT * FROM v_raw_answer WHERE starts_with(question_id, 'oemq_')",
    "v_scoped_answer": """SELECT user_id, warranty_id, CASE WHEN k % 3 = 0 THEN 'fridge' WHEN k % 3 = 1 THEN 'ac' END AS product_type, event_id % 50 AS question_id FROM v_event""",
    "v_scoped_question": """SELECT s_suppkey AS id, s_name AS text, 'choice' AS answer_type, CAST(s_nationkey AS DOUBLE) / 10 AS weight,
      CASE WHEN s_suppkey % 5 <> 0 THEN 1 ELSE 0 END AS is_active, CASE WHEN s_suppkey % 3 <> 0 THEN 'Brand#' || (1 + s_suppkey % 25) END AS brand,
      CASE WHEN s_suppkey % 10 = 9 THEN 'ECONOMY-' || (1 + s_suppkey % 50) END AS model_code,
      CASE s_suppkey % 4 WHEN 1 THEN 'fridge' WHEN 2 THEN 'ac' WHEN 3 THEN 'washer' END AS product_type FROM supplier""",
    "v_oem_question": """SELECT 'oemq_' || s_suppkey AS id, CASE WHEN s_suppkey % 7 <> 0 THEN 'Brand#' || (1 + s_suppkey % 25) END AS brand,
      CASE WHEN s_suppkey % 2 = 1 THEN 'ECONOMY-' || (1 + s_suppkey % 50) END AS model_code, CAST(NULL AS VARCHAR) AS product_type,
      CASE s_nationkey % 5 WHEN 0 THEN 'MEA' WHEN 1 THEN 'NA' WHEN 2 THEN 'APAC' WHEN 3 THEN 'EU' END AS region, s_name AS text,
      CASE s_suppkey % 3 WHEN 0 THEN 'choice' ELSE 'text' END AS answer_type, CASE WHEN s_suppkey % 3 = 0 THEN 'Yes|No' ELSE '' END AS options,
      CASE WHEN s_suppkey % 6 <> 0 THEN CAST(s_suppkey % 10 * 10 AS INTEGER) ELSE 50 END AS priority, s_suppkey % 4 <> 3 AS published,
      s_suppkey % 4 <> 3 AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey * 3 = s_suppkey) AS enabled,
      CASE WHEN s_suppkey % 2 = 0 THEN 'generated' ELSE 'manual' END AS source, s_suppkey AS seq FROM supplier""",
    "v_oem_rec": """SELECT 'oemr_' || s_suppkey AS id, CASE s_suppkey % 4 WHEN 1 THEN 'fridge' WHEN 2 THEN 'ac' WHEN 3 THEN '' END AS product_type,
      CASE WHEN s_suppkey % 7 <> 0 THEN 'Brand#' || (1 + s_suppkey % 25) END AS brand,
      CASE s_nationkey % 5 WHEN 0 THEN 'MEA' WHEN 1 THEN 'NA' WHEN 2 THEN 'APAC' WHEN 3 THEN 'EU' END AS region, s_name AS title,
      CASE WHEN s_suppkey % 2 = 0 THEN 'offer' ELSE '' END AS tags,
      CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey * 4 = s_suppkey) THEN 'disabled' WHEN s_suppkey % 9 = 3 THEN 'draft' ELSE 'active' END AS status,
      CASE WHEN s_suppkey % 2 = 0 THEN 'feed' ELSE 'oem_manual' END AS source FROM supplier""",
    "v_nudge_event": """SELECT event_id AS id, user_id, warranty_id, ['snapshot', 'care', 'expiry'][k % 3 + 1] AS nudge_type,
      CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS variant, ts AS shown_at, CASE WHEN event_type = 'purchase' THEN ts END AS acted_at,
      CASE WHEN event_type IN ('error', 'purchase') AND k % 4 <> 1 THEN ts END AS ignored_at FROM v_event""",
    "v_policy": f"""SELECT (l_orderkey * 8 + l_linenumber) * 4096 + l_suppkey % 64 * 64 + CAST(l_quantity AS BIGINT) AS id, {_owner('l_partkey')} AS user_id, {_wid('l_partkey')} AS warranty_id,
      CASE WHEN l_tax > 0.075 AND l_returnflag = 'A' THEN 'A' WHEN l_tax > 0.075 AND l_returnflag = 'R' THEN 'B' END AS variant FROM lineitem""",
    "v_sticky": """SELECT user_id, warranty_id, arg_min(variant, id) AS variant FROM v_policy WHERE variant IS NOT NULL GROUP BY ALL""",
    "v_interest": f"""SELECT event_id AS id, user_id, warranty_id, {text_list(p[0] for p in C.PRODUCT_CATALOG)}[event_id % 13 + 1] AS product_id,
      {_REGION} AS region, CASE k % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' END AS risk_band,
      CASE WHEN k % 3 <> 0 THEN 'Offer ' || (k % 5) END AS title, ts
      FROM v_event LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON c_custkey = user_id""",
    "v_symptom_search": """SELECT doc_id AS id, doc_id % 15 AS user_id, 'wty_' || (doc_id % 15) || '_' || (doc_id % 12) AS warranty_id, lang AS product_type,
      CASE WHEN doc_id % 3 = 0 THEN 'Brand#13' ELSE source END AS brand, CASE doc_id % 4 WHEN 0 THEN 'EU' WHEN 1 THEN 'NA' WHEN 2 THEN 'APAC' END AS region, text AS query_text, CASE doc_id % 7 WHEN 0 THEN 'motor' WHEN 1 THEN 'drum' WHEN 2 THEN 'bearing' WHEN 3 THEN 'pump' WHEN 4 THEN 'seal' WHEN 5 THEN '' END AS matched_component,
      TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at FROM documents""",
    "v_peer_signal": f"""SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN 'wty_' || (doc_id % 15) || '_' || (doc_id % 12) END AS warranty_id, lang AS product_type,
      CASE WHEN doc_id % 3 = 0 THEN 'Brand#13' ELSE source END AS brand, 'M' || (doc_id % 4) AS model, CASE WHEN doc_id % 5 <> 0 THEN 1 + 4 * quality END AS avg_rating,
      CASE WHEN doc_id % 7 <> 0 THEN quality - toxic END AS review_sentiment,
      CASE doc_id % 6 WHEN 0 THEN 'motor' WHEN 1 THEN 'drum' WHEN 2 THEN 'bearing' WHEN 3 THEN 'pump' WHEN 4 THEN '' END AS symptom_keyword,
      CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' END AS severity_hint,
      list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda t: t <> '') AS failure_keywords, source,
      TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS last_updated_at FROM labels JOIN documents USING (doc_id)""",
    "v_notification": """SELECT 'ntf_' || event_id AS id, user_id, event_type AS type, CASE WHEN k % 11 = 0 THEN 'oem' ELSE 'user' END AS audience,
      k % 5 = 0 AS is_read, ts AS created_at FROM v_event""",
    "v_read_mark": """SELECT 'ntf_' || event_id AS notification_id, CASE WHEN k % 8 = 5 THEN user_id + 1 ELSE user_id END AS user_id, k % 4 = 1 AS marked FROM v_event""",
    "v_pair_notification": """SELECT 'ntp_' || event_id AS id, user_id, warranty_id, CASE event_type WHEN 'error' THEN 'risk_medium' WHEN 'purchase' THEN 'risk_high'
      WHEN 'signup' THEN 'warranty_onboarded' WHEN 'view' THEN 'expiry_soon' ELSE 'ev_battery_risk' END AS type, k % 5 = 0 AS is_read, ts AS created_at FROM v_event""",
    "v_fetch_queue": """SELECT url, arg_max(brand, page_id) AS brand, arg_max(model, page_id) AS model, arg_max_null(region, page_id) AS region, arg_max(status, page_id) AS status FROM (
      SELECT *, ['EU', 'NA', NULL][page_id % 3 + 1] AS region, 'B' || (page_id % 5) AS brand, 'M' || (page_id % 4) AS model, ['pending', 'fetched', 'failed'][page_id % 3 + 1] AS status FROM pages) GROUP BY url""",
    "v_oem_page": """SELECT 'part/' || p_partkey AS url, ['samsung', 'lg', 'bosch', 'whirlpool', 'Other'][p_partkey % 5 + 1] AS brand_hint, p_type || '-' || p_size AS model,
      p_partkey AS p, p_size, p_name, CASE WHEN p_partkey % 7 = 0 THEN '<html><body><p>' || p_name || ' has no block</p></body></html>' ELSE
        '<html><body><h1>Brand: ' || replace(p_brand, '#', '-') || ' | Model: ' || p_type || '-' || p_size || ' |</h1><div class="'
        || CASE p_partkey % 5 WHEN 0 THEN 'box warranty-coverage' WHEN 1 THEN 'warranty-details' WHEN 2 THEN 'service-info wide' WHEN 3 THEN 'warranty' ELSE 'other' END
        || '"><b>' || (1 + p_size % 36) || ' months</b> cover for ' || p_name || '</div><p>exclusion: ' || p_name || ' misuse</p><p>Exclusion - rust, wear</p><section id="terms" class="'
        || CASE WHEN p_partkey % 2 = 0 THEN 'terms' ELSE 'conditions small' END || '"><i>Keep</i> the invoice.</section><p>motor:5 years compressor warranty:10 years  digital inverter:'
        || (1 + p_size % 9) || ' years drum:2 year</p></body></html>' END AS html, ['EU', 'NA', NULL][p_partkey % 3 + 1] AS region FROM part
      UNION ALL SELECT 'page/' || page_id, ['Samsung', 'LG', 'bosch', 'whirlpool', NULL][page_id % 5 + 1], 'M' || (page_id % 4), NULL, NULL, NULL, html, ['EU', 'NA', NULL][page_id % 3 + 1] FROM pages""",
    # telemetry risk, one row per pair
    "v_base_risk": """SELECT *, greatest(0, least(100, 20 + CASE WHEN usage_hours > 100 THEN 15 ELSE 0 END + least(5 * errors, 30) + least(20 * failures, 40) - least(3 * maintenance, 15))) AS base_h FROM (
      SELECT user_id, warranty_id, coalesce(sum(hours), 0) AS usage_hours, count(*) FILTER (event_type = 'usage') AS usage_events, count(*) FILTER (event_type = 'error') AS errors,
        count(*) FILTER (event_type = 'failure') AS failures, count(*) FILTER (event_type = 'maintenance') AS maintenance FROM v_telemetry GROUP BY ALL)""",
    "v_recent": f"""SELECT *, row_number() OVER (PARTITION BY user_id, warranty_id, event_type ORDER BY ts DESC, id DESC) AS kind_rank FROM (
      SELECT * FROM v_telemetry WHERE ts >= {AS_OF} - INTERVAL 30 DAY QUALIFY row_number() OVER (PARTITION BY user_id, warranty_id ORDER BY ts DESC, id DESC) <= 50)""",
    "v_signal": """SELECT *, greatest(-25, least(25, CASE intensity WHEN 'low' THEN -12 WHEN 'medium' THEN 5 ELSE 18 END
        + CASE WHEN burden = 0 THEN -2 WHEN burden <= 3 THEN 8 ELSE 20 END)) AS delta_h,
        list_filter([CASE intensity WHEN 'low' THEN 'Light recent usage (' || last_hours || ' hrs last event)'
            WHEN 'medium' THEN 'Moderate usage (' || CAST(floor(avg_hours) AS BIGINT) || ' hrs avg recent)' ELSE 'Heavy use (' || total_hours || ' hrs recent window)' END,
          CASE WHEN burden = 0 THEN NULL WHEN burden <= 3 THEN 'Some errors recorded (' || burden || ')' ELSE 'Multiple recent errors (' || burden || ')' END], lambda x: x IS NOT NULL) AS signal_reasons
      FROM (SELECT *, CASE WHEN last_hours < 10 THEN 'low' WHEN avg_hours < 500 THEN 'medium' ELSE 'high' END AS intensity FROM (
        SELECT user_id, warranty_id, coalesce(max(hours) FILTER (event_type = 'usage' AND kind_rank = 1), 0) AS last_hours,
          CAST(coalesce(sum(hours) FILTER (event_type = 'usage' AND kind_rank <= 10), 0) AS BIGINT) AS total_hours,
          coalesce(CAST(sum(hours) FILTER (event_type = 'usage' AND kind_rank <= 10) AS DOUBLE) / nullif(count(*) FILTER (event_type = 'usage' AND kind_rank <= 10), 0), 0) AS avg_hours,
          coalesce(max(errors) FILTER (event_type = 'usage' AND kind_rank = 1), 0) + count(*) FILTER (event_type = 'error' AND kind_rank <= 5) AS burden
        FROM (SELECT DISTINCT user_id, warranty_id FROM v_telemetry) LEFT JOIN v_recent USING (user_id, warranty_id) GROUP BY ALL))""",
    "v_score": """SELECT user_id, warranty_id, base_h, delta_h, score_h, CASE WHEN score_h > 66 THEN 'HIGH' WHEN score_h >= 33 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label,
        signal_reasons, CASE WHEN len(reasons) > 0 THEN reasons[1:4] ELSE ['Predictive engine not ready yet.'] END AS reasons, usage_hours, usage_events, errors, failures, maintenance FROM (
      SELECT *, greatest(0, least(100, base_h + delta_h)) AS score_h, CASE WHEN delta_h <> 0 THEN list_concat(signal_reasons, base_reasons) ELSE base_reasons END AS reasons FROM (
        SELECT b.*, s.delta_h, s.signal_reasons, CASE WHEN len(r) > 0 THEN r ELSE ['Predictive engine not ready yet.'] END AS base_reasons FROM (
          SELECT *, list_filter([CASE WHEN usage_hours > 100 THEN 'High usage hours' END, CASE WHEN errors > 0 THEN errors || ' error events' END,
            CASE WHEN failures > 0 THEN failures || ' recorded failures' END, CASE WHEN maintenance > 0 THEN 'Recent maintenance lowers risk' END], lambda x: x IS NOT NULL) AS r FROM v_base_risk) b
        JOIN v_signal s USING (user_id, warranty_id)))""",
    "v_profile_score": """SELECT p.*, w.warranty_id IS NOT NULL AS known, w.brand, w.model_code, w.region_code, w.product_name,
        coalesce(s.score_h, 20) AS score_h, coalesce(s.risk_label, 'LOW') AS risk_label
      FROM v_profile p LEFT JOIN v_warranty w USING (warranty_id) LEFT JOIN v_score s ON s.user_id = p.user_id AND s.warranty_id = p.warranty_id""",
    # behaviour risk of every pair with events or a warranty
    "v_behaviour_risk": """SELECT *, CASE WHEN value_h >= 75 THEN 'high' WHEN value_h >= 50 THEN 'medium' ELSE 'low' END AS band FROM (
      SELECT x.*, w.warranty_id IS NOT NULL AS known, w.expiry_date,
        greatest(0, least(100, 35 + least(5 * dismissed, 25) - least(3 * completed, 15) + least(10 * issues, 30) - CASE WHEN w.expiry_date IS NOT NULL THEN 5 ELSE 0 END)) AS value_h
      FROM (SELECT user_id, warranty_id, count(*) FILTER (event_type = 'nudge_dismissed') AS dismissed, count(*) FILTER (event_type = 'task_completed') AS completed,
          count(*) FILTER (event_type = 'issue_reported') AS issues
        FROM (SELECT user_id, warranty_id, event_type FROM v_behaviour_event UNION ALL SELECT user_id, warranty_id, 'owner' FROM v_warranty) GROUP BY ALL) x
      LEFT JOIN v_warranty w USING (warranty_id))""",
    "v_variant": """SELECT r.user_id, r.warranty_id, coalesce(s.variant, CASE WHEN CAST('0x' || md5('fogg_nudge:' || r.user_id || ':' || r.warranty_id)[1:2] AS INTEGER) % 2 = 0 THEN 'A' ELSE 'B' END) AS variant
      FROM v_behaviour_risk r LEFT JOIN v_sticky s USING (user_id, warranty_id)""",
    "v_nudge": f"""SELECT user_id, warranty_id, known, band, value_h, variant, n.kind AS kind, n.title AS title, n.message AS message FROM (SELECT *, unnest(CASE WHEN len(items) > 0 THEN items
        ELSE [{{'kind': 'all_good', 'title': 'All Good', 'message': 'No pressing actions. We will refresh advisories on schedule.'}}] END) AS n FROM (
      SELECT r.*, v.variant, list_filter([
        CASE WHEN known THEN {{'kind': 'snapshot', 'title': CASE variant WHEN 'B' THEN {quoted(C.NUDGE_COPY['B']['snapshot_title'])} ELSE {quoted(C.NUDGE_COPY['A']['snapshot_title'])} END,
          'message': CASE variant WHEN 'B' THEN {quoted(C.NUDGE_COPY['B']['snapshot_msg'])} ELSE {quoted(C.NUDGE_COPY['A']['snapshot_msg'])} END}} END,
        CASE WHEN band <> 'low' THEN {{'kind': 'care', 'title': CASE variant WHEN 'B' THEN {quoted(C.NUDGE_COPY['B']['care_title'])} ELSE {quoted(C.NUDGE_COPY['A']['care_title'])} END,
          'message': CASE variant WHEN 'B' THEN {quoted(C.NUDGE_COPY['B']['care_msg'])} ELSE {quoted(C.NUDGE_COPY['A']['care_msg'])} END}} END,
        CASE WHEN expiry_date - {AS_OF_DAY} < 60 THEN {{'kind': 'expiry', 'title': CASE variant WHEN 'B' THEN {quoted(C.NUDGE_COPY['B']['expiry_title'])} ELSE {quoted(C.NUDGE_COPY['A']['expiry_title'])} END,
          'message': 'Warranty ends in ' || (expiry_date - {AS_OF_DAY}) || ' days. Capture proofs and run checks now.'}} END], lambda x: x IS NOT NULL) AS items
      FROM v_behaviour_risk r JOIN v_variant v USING (user_id, warranty_id)))""",
}

VIEWS["v_recent_late"] = VIEWS["v_recent"].replace(AS_OF, LATE)
VIEWS["v_signal_late"] = VIEWS["v_signal"].replace("v_recent", "v_recent_late")


def with_views(body: str) -> str:
    """The query with the views it needs, in dependency order, as a WITH clause."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\bv_[a-z_0-9]+\b", text))):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    recursive = body.lstrip().upper().startswith("WITH RECURSIVE")
    rest = body.lstrip()
    if rest.upper().startswith("WITH"):
        rest = re.sub(r"^WITH( RECURSIVE)?\s+", ", ", rest, count=1, flags=re.I)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + rest
