"""Scoring on hand-worked events: thresholds, windows, missing data, hot keys."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from covermill.functions.topk import first_rows_per_key
from covermill.operators import risk as R
from covermill.operators import telemetry as T

NOW = datetime(2024, 1, 31)
SCHEMA = "id STRING, user_id BIGINT, warranty_id STRING, event_type STRING, payload STRING, ts TIMESTAMP"


def events(spark, rows):
    """Rows of (user, kind, payload, age in days)."""
    data = [
        (f"t{i:05d}", u, f"w{u}", kind, payload, NOW - timedelta(days=age)) for i, (u, kind, payload, age) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def by_user(df):
    return {r["user_id"]: r for r in df.collect()}


def test_base_score_thresholds(spark):
    use = '{"hours": %s}'
    rows = [(1, "usage", use % 100, 1), (2, "usage", use % 101, 1)]
    rows += [(3, "error", "{}", 1)] * 7 + [(4, "failure", "{}", 1)] * 3 + [(5, "maintenance", "{}", 1)] * 6
    rows += [(6, "usage", use % 2500, 1)] + [(6, "error", "{}", 1)] * 6 + [(6, "failure", "{}", 1)] * 2
    got = by_user(T.base_risk(T.telemetry_counts(events(spark, rows))))
    assert {u: r["base_h"] for u, r in got.items()} == {1: 20, 2: 35, 3: 50, 4: 60, 5: 5, 6: 100}
    assert got[6]["base_reasons"] == ["High usage hours", "6 error events", "2 recorded failures"]


@pytest.mark.parametrize(
    "hours, errors, intensity, delta",
    [(9, 0, "low", -14), (10, 0, "medium", 3), (499, 3, "medium", 13), (500, 4, "high", 25), (500, 0, "high", 16)],
)
def test_signal_thresholds(spark, hours, errors, intensity, delta):
    payload = f'{{"hours": {hours}, "errors": {errors}}}'
    row = T.behaviour_signal(events(spark, [(1, "usage", payload, 1)]), NOW).first()
    assert (row["usage_intensity"], row["delta_h"], row["error_burden"]) == (intensity, delta, errors)


def test_only_recent_events_count(spark):
    rows = [(1, "usage", '{"hours": 900}', 31), (2, "usage", '{"hours": 900}', 30), (3, "usage", "not json", 1), (4, "usage", None, 2)]
    got = by_user(T.behaviour_signal(events(spark, rows), NOW))
    assert got[1]["delta_h"] == -14 and got[1]["signal_reasons"] == ["Light recent usage (0 hrs last event)"]
    assert got[2]["usage_intensity"] == "high"
    assert got[3]["usage_intensity"] == got[4]["usage_intensity"] == "low"


def test_last_fifty_ten_and_five(spark):
    rows = [(1, "error", "{}", 20 + i * 0.01) for i in range(30)]
    rows += [(1, "usage", '{"hours": 100}', 10 + i * 0.01) for i in range(45)]
    rows += [(1, "usage", '{"hours": 600, "errors": 1}', 1 + i * 0.01) for i in range(10)]
    got = T.behaviour_signal(events(spark, rows), NOW).first()
    assert got["hours_window"] == 6000 and got["error_burden"] == 1, "the errors fall out of the last 50"


def test_more_use_and_errors_raise_the_score(spark):
    calm = [(1, "usage", '{"hours": 2, "errors": 0}', 1)]
    rough = [(2, "usage", '{"hours": 2500, "errors": 8}', 1)]
    got = by_user(R.risk_score(events(spark, calm + rough), NOW))
    assert got[2]["score_h"] > got[1]["score_h"] and got[2]["risk_label"] != got[1]["risk_label"]
    assert len(got[2]["reasons"]) <= 4


def test_hot_key_keeps_the_newest_rows(spark):
    hot = spark.range(60_000, numPartitions=12).selectExpr("if(id % 3 = 0, 0, id) AS k", "id AS v")
    got = first_rows_per_key(hot, ["k"], [F.desc("v")], 50, salts=4).where("k = 0").select("v").collect()
    assert sorted(r["v"] for r in got) == [59_997 - 3 * i for i in range(49, -1, -1)]


def test_events_counted_once(spark):
    df = events(spark, [(1, "usage", "{}", 1), (1, "error", "{}", 1)])
    assert T.unique_events(df, df, df).count() == 2


def test_failure_reasons(spark):
    rows = [(1, "error", '{"code": "E1"}', 1)] * 3 + [(1, "failure", '{"reason": ""}', 1), (1, "error", '{"code": "", "message": "m"}', 1)]
    got = [(r["reason"], r["weight"]) for r in T.top_failure_reasons(events(spark, rows)).collect()]
    assert got == [("E1", 3), ("unspecified_failure", 2), ("m", 1)]


def test_payload_numbers_as_text_or_with_a_fraction(spark):
    rows = [("usage", '{"hours": "12", "errors": 2.0}'), ("usage", '{"hours": 1.5, "errors": "3"}'), ("usage", '{"hours": "x", "errors": null}'), ("usage", "no json")]
    df = spark.createDataFrame(rows, "event_type STRING, payload STRING")
    for parse in (T.parse_payload, T.usage_payload):
        assert [(r.p.hours, r.p.errors) if r.p else (None, None) for r in parse(df).collect()] == [(12.0, 2), (1.5, 3), (None, None), (None, None)]
