"""Nudges, signals, statistics, workflow tables, readers and sinks."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.operators import ev as EV
from covermill.operators import nudges as N
from covermill.operators import oem as O
from covermill.operators import recommend as P
from covermill.operators import signals as G
from covermill.operators import warranty as W
from covermill.operators import workflow as K
from covermill.sources import readers

PAIR = "user_id BIGINT, warranty_id STRING"
NOW = "2024-01-31 00:00:00"


@pytest.mark.parametrize("days, kinds", [(59, ["snapshot", "expiry"]), (60, ["snapshot"]), (-1, ["snapshot", "expiry"])])
def test_nudge_expiry_window(spark, days, kinds):
    df = spark.createDataFrame([(1, "w", True, "low", "B")], f"{PAIR}, warranty_known BOOLEAN, band STRING, variant STRING")
    out = N.nudges(df.withColumn("expiry_date", F.date_add(F.lit("2024-01-31").cast("date"), days)), NOW).collect()
    assert [r["kind"] for r in out] == kinds
    assert out[0]["title"] == C.NUDGE_COPY["B"]["snapshot_title"]


def test_all_good_when_nothing_applies(spark):
    df = spark.createDataFrame([(1, "w", False, "low", "A", None)], f"{PAIR}, warranty_known BOOLEAN, band STRING, variant STRING, expiry_date DATE")
    assert [(r["kind"], r["actions"]) for r in N.nudges(df, NOW).collect()] == [("all_good", [])]


def test_variants_stick(spark):
    pairs = spark.createDataFrame([(u, "w") for u in range(200)], PAIR)
    log = spark.createDataFrame([(9, "fogg_nudge", 1, "w", "A"), (3, "fogg_nudge", 1, "w", "B"), (1, "other", 1, "w", "A"), (2, "fogg_nudge", 2, "w", None)],
                                f"id BIGINT, experiment STRING, {PAIR}, variant STRING")
    got = {r["user_id"]: r for r in N.assign_variants(pairs, log).collect()}
    assert (got[1]["variant"], got[1]["is_new"]) == ("B", False) and got[2]["is_new"]
    share = sum(r["variant"] == "A" for r in got.values())
    assert 70 < share < 130


def test_peer_upsert_ignores_order_and_absent_values(spark):
    schema = ("id BIGINT, warranty_id STRING, product_type STRING, brand STRING, model STRING, avg_rating DOUBLE, review_sentiment DOUBLE, "
              "symptom_keyword STRING, severity_hint STRING, failure_keywords ARRAY<STRING>, source STRING, last_updated_at TIMESTAMP")
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [
        (1, None, "ac", "b", "m", 4.0, None, "", None, ["k1"], "s1", t[0]),
        (2, "", None, "b", "m", None, 0.5, "noise", None, [], "", t[1]),
        (3, None, "", "b", "m", 0.0, None, "", None, None, None, t[2]),
        (4, "w", "", "b", "m", None, None, "", "high", None, None, t[0]),
    ]
    for order in (rows, rows[::-1]):
        got = {r["warranty_id"]: r for r in G.upsert_peer_signals(spark.createDataFrame(order, schema)).collect()}
        assert set(got) == {None, "w"}
        r = got[None]
        assert (r["product_type"], r["avg_rating"], r["review_sentiment"], r["symptom_keyword"], r["failure_keywords"], r["source"]) == (
            "ac", 0.0, 0.5, "noise", ["k1"], "s1")
        assert (got["w"]["product_type"], got["w"]["severity_hint"], got["w"]["failure_keywords"]) == ("", "high", [])


def test_interest_filters_and_titles(spark):
    rows = [(1, "p", "EU", "HIGH", None, 1), (2, "p", None, None, "T", 2), (3, "p", "NA", "HIGH", "T", 3), (4, "q", "EU", "", "Q", 4), (5, "", "EU", "HIGH", "Q", 5)]
    df = spark.createDataFrame(rows, "id BIGINT, product_id STRING, region STRING, risk_band STRING, title STRING, ts BIGINT")
    got = [(r["product_id"], r["n"], r["title"]) for r in G.interest_top(df, region="EU", risk_band="HIGH").collect()]
    assert got == [("p", 2, "p"), ("q", 1, "Q")]


def test_ties_break_by_item(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "matched_component STRING")
    assert [(r["component"], r["n"]) for r in G.symptom_top_components(df, 2).collect()] == [("c", 2), ("a", 1)]


def test_ev_score_edges(spark):
    rows = [(60.0, 8.0, 2.0, 40.0, 1.0, 40, 40), (60.5, 9.0, 3.0, 41.0, 0.0, 39, 50), (61.0, 8.0, 2.0, 30.0, 2.0, 50, 50), (None,) * 7]
    df = spark.createDataFrame(rows, "daily_km DOUBLE, fast_charge_sessions DOUBLE, deep_discharge_events DOUBLE, max_temp_seen DOUBLE, region_climate_band DOUBLE, behaviour_h INT, care_h INT")
    got = [(r["ev_score_h"], r["ev_label"]) for r in EV.battery_score(df).collect()]
    assert got == [(20, "LOW"), (105, "HIGH"), (55, "MEDIUM"), (20, "LOW")]
    assert EV.battery_score(df).first()["ev_reasons"] == ["Light usage so far."]


def test_missing_warranty_passes_the_brand_filter(spark):
    df = spark.createDataFrame([(1, True, "x"), (2, True, "y"), (3, True, None), (4, False, None)], "id INT, warranty_known BOOLEAN, brand STRING")
    assert sorted(r["id"] for r in O.for_brand(df, brand="x").collect()) == [1, 4]


@pytest.mark.parametrize("high, total, alert", [(10, 100, True), (9, 100, False), (3, 10, True), (2, 7, False)])
def test_cluster_thresholds(spark, high, total, alert):
    df = spark.range(total).select(F.lit(True).alias("warranty_known"), F.lit("b").alias("brand"), F.lit(None).cast("string").alias("region_code"),
                                   F.when(F.col("id") < high, "HIGH").otherwise("UNKNOWN").alias("risk_label"), F.lit(1).alias("n"))
    assert bool(O.high_risk_clusters(df).count()) == alert


def test_product_recommendations_for_a_high_phone(spark):
    df = spark.createDataFrame([(1, "w", "smartphone", "HIGH", "NA", [], ["a", "b", "c"]), (2, "w", "general", "LOW", None, ["x"], [])],
                               f"{PAIR}, category STRING, band STRING, region_code STRING, behaviour_reasons ARRAY<STRING>, reasons ARRAY<STRING>")
    got = P.product_recommendations(df).collect()
    assert [r["product_id"] for r in got if r["user_id"] == 1] == ["sp_ultra", "sp_case_bundle", "sp_extended", "gn_backup", "gn_inspect", "gn_cleaning"]
    assert [(r["product_id"], r["why"], r["action"]) for r in got if r["user_id"] == 2] == [("gn_cleaning", "x", "care")]
    assert got[0]["why"] == "a; b"


def test_review_transitions(spark):
    rows = [(1, "a", "pending", None, 1), (1, "a", "rejected", "r", 2), (1, "a", "approved", "ok", 3), (2, "a", "pending", None, 1), (3, "a", "approved", "x", 1), (3, "a", "pending", None, 1)]
    got = {r["review_id"]: (r["status"], r["reason"], r["resolved_at"]) for r in K.review_state(spark.createDataFrame(rows, "review_id INT, action STRING, status STRING, reason STRING, at INT")).collect()}
    assert got == {1: ("approved", "ok", 3), 2: ("pending", None, None), 3: ("approved", "x", 1)}


def test_answers_go_to_their_log(spark, tmp_path):
    path = str(tmp_path / "answers")
    df = spark.createDataFrame([(1, "oemq_1"), (2, "q1_usage_location"), (3, "x_oemq_")], "id INT, question_id STRING")
    K.write_answers(df, path)
    got = {r["id"]: r["sink"] for r in spark.read.parquet(path).collect()}
    assert got == {1: "oem", 2: "bank", 3: "bank"}


def test_json_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n{"a": 2\n{"b": "y", "c": 3}\n   \n[1]\n')
    rows = readers.read_json_lines(spark, str(path), "a BIGINT, b STRING").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, "x"), (None, "y")]
    counted = readers.count_bad_lines(spark.read.text(str(path)), "a BIGINT, b STRING").first()
    assert (counted["good"], counted["bad"]) == (2, 2)


def test_seed_lines(spark, tmp_path):
    path = tmp_path / "seeds.csv"
    path.write_text("0,4,1.5,0,0,2,0.9,0.9,0.9,0\n# note\n\n1,6,1,0,0,1,0.9,0.9,0.9,3,1,2,0\n 2,10,2.5,1,0,2,0.8,0.9,0.8,1,2\n1,x,1,0,0,1,0.9,0.9,0.9,3,2\n")
    got = [(r["product_type"], r["region_code"], r["climate_band"], r["power_quality_band"], r["label"]) for r in readers.read_seed_csv(spark, str(path)).collect()]
    assert got == [(1.0, 3.0, 1.0, 2.0, 0), (2.0, 1.0, 0.0, 0.0, 2)]


def test_older_files_miss_columns(spark, tmp_path):
    new, old = str(tmp_path / "t" / "v=2"), str(tmp_path / "t" / "v=1")
    spark.createDataFrame([(1, "x", "EU")], "id INT, name STRING, region STRING").write.parquet(new)
    spark.createDataFrame([(2, "y")], "id INT, name STRING").write.parquet(old)
    got = {r["id"]: r["region"] for r in readers.read_tables(spark, str(tmp_path / "t")).collect()}
    assert got == {1: "EU", 2: None}


def test_log_is_appended_by_day(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 23)), (2, datetime(2024, 1, 2, 1))], "id INT, ts TIMESTAMP")
    readers.append_log(df, path, "ts")
    readers.append_log(df.where("id = 2"), path, "ts")
    back = spark.read.parquet(path)
    assert back.count() == 3 and back.where("event_date = DATE'2024-01-02'").count() == 2


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "oemq_1", datetime(2024, 1, 1, 23)), (2, "b", datetime(2024, 1, 2, 1))], "id INT, question_id STRING, ts TIMESTAMP")
    for run in ("r1", "r2", "r2", "r1"):
        readers.append_log(df, str(tmp_path / "log"), "ts", run)
        K.write_answers(df, str(tmp_path / "answers"), run)
        W.export_summaries(df.select(F.lit("x").alias("summary")), str(tmp_path / "x"), "txt", run)
    assert spark.read.parquet(str(tmp_path / "log")).where("event_date = DATE'2024-01-02'").count() == 2
    assert spark.read.parquet(str(tmp_path / "answers")).groupBy("sink").count().collect().__len__() == 2
    assert spark.read.parquet(str(tmp_path / "answers")).count() == 4 and spark.read.text(str(tmp_path / "x")).count() == 4


def test_nudge_outcomes(spark):
    got = {r.outcome: (r.acted_at, r.ignored_at) for r in N.nudge_events(spark.createDataFrame([("acted", 5), ("ignored", 6), ("shown", 7), (None, 8)], "outcome STRING, shown_at INT")).collect()}
    assert got == {"acted": (5, None), "ignored": (None, 6), "shown": (None, None), None: (None, None)}


def test_exports(spark, tmp_path):
    arts = spark.createDataFrame([(1, "i", "Brand: Acme\n")], "ref BIGINT, type STRING, content STRING")
    over = spark.createDataFrame([], "ref BIGINT, type STRING, product_name STRING, coverage_months INT")
    out = W.warranty_summary(W.canonical_warranty(arts, over))
    for fmt in ("txt", "html"):
        W.export_summaries(out, str(tmp_path / "x"), fmt)
    html = spark.read.text(str(tmp_path / "x" / "format=html"), wholetext=True).first()["value"]
    assert html.startswith("<html><body><pre>Brand: Acme Model: N/A\nExpiry: N/A") and "</pre>" in html
    with pytest.raises(ValueError):
        W.export_summaries(out, str(tmp_path / "x"), "pdf")


def test_documents_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    r = readers.read_documents(spark, str(tmp_path / "a.txt")).first()
    assert r["content"] == "one\ntwo" and r["source"].endswith("a.txt")


def test_any_field_may_be_corrected(spark):
    text = "Brand: Acme\nModel: X1\nSerial: SN000123\nPurchase: 2023-01-02\n12 months warranty"
    artifacts = spark.createDataFrame([(1, "invoice", "upload", text), (2, "invoice", "upload", text), (3, "invoice", "upload", None)], "ref long, type string, source string, content string")
    names = ["product_name", "brand", "model_code", "serial_no", "purchase_date", "coverage_months"]
    fixes = [(1, "invoice", "Fan", "Other", "Y", "S9", "2024-02-29", " 24 "), (2, "invoice", None, None, None, None, "soon", "two")]
    o = spark.createDataFrame(fixes, "ref long, type string, " + ", ".join(f"{n} string" for n in names))
    one, two, three = [r for r in W.canonical_warranty(artifacts, o).orderBy("ref").collect()]
    assert (one.product_name, one.brand, one.model_code, one.serial_no, one.coverage_months) == ("Fan", "Other", "Y", "S9", 24)
    assert str(one.purchase_date) == "2024-02-29" and str(one.expiry_date) == "2026-02-28"
    assert one.confidence == dict.fromkeys(names, 0.9)
    # a correction that can't be read refutes what was extracted
    assert two.purchase_date is None and two.coverage_months is None and two.expiry_date is None
    assert two.confidence["purchase_date"] == two.confidence["coverage_months"] == 0.9 and two.confidence["serial_no"] == 0.6
    assert three.confidence == {} and three.brand is None and three.notes
    assert [len(r.source_artifact_ids) for r in (one, two, three)] == [1, 1, 1] and one.source_artifact_ids != two.source_artifact_ids
