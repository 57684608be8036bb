"""Model training and scoring on a table derived from the given ones."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from covermill import constants as C
from covermill.operators import ev as EV
from covermill.operators import ml as M
from covermill.plans.jobs_ml import risk_training
from covermill.sources.domain import DomainTables


@pytest.fixture(scope="module")
def table(spark):
    return risk_training(DomainTables(spark, SMALL)).checkpoint()


def test_train_and_score(spark, table):
    model, metrics = M.train_three_class(table, C.RISK_FEATURES, rounds=4, depth=2)
    assert metrics["accuracy"] > 0.6 and 0.5 < metrics["auc"] <= 1
    row = M.model_or_rule(model, table, F.lit(20)).first()
    assert set(row["proba"]) == set(C.RISK_LABELS) and abs(sum(row["proba"].values()) - 1) < 1e-9
    assert row["model_label"] == max(row["proba"], key=row["proba"].get)
    assert row["base_h"] == pytest.approx(100 * (0.5 * row["proba"]["MEDIUM"] + row["proba"]["HIGH"]), abs=0.51)


def test_without_a_model_the_rule_scores(table):
    assert {r["base_h"] for r in M.model_or_rule(None, table, F.lit(35)).select("base_h").collect()} == {35}


def test_split_is_stable_and_proportional(spark, table):
    a, b = M.split(table.repartition(7), ["user_id", "warranty_id"])
    c, _ = M.split(table.coalesce(1), ["user_id", "warranty_id"])
    assert a.count() + b.count() == table.count()
    assert a.exceptAll(c).count() == 0
    assert 0.1 < b.count() / table.count() < 0.3


def test_a_class_that_training_never_saw_has_no_probability(spark, table):
    model, _ = M.train_three_class(table.where("label < 2"), C.RISK_FEATURES, rounds=2, depth=2)
    row = M.score(model, table).first()
    assert row["proba"]["HIGH"] == 0 and abs(sum(row["proba"].values()) - 1) < 1e-9


def test_outcome_counts_only_failures_from_the_cutoff_on(spark):
    rows = [(1, "w", "failure", "2024-01-01 00:00:00"), (1, "w", "failure", "2024-01-16 00:00:00"), (1, "w", "error", "2024-01-20 00:00:00"),
            (2, "w", "failure", "2024-01-17 00:00:00"), (2, "w", "failure", "2024-01-18 00:00:00"), (2, "w", "failure", "2024-01-19 00:00:00")]
    log = spark.createDataFrame(rows, "user_id long, warranty_id string, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    pairs = spark.createDataFrame([(1, "w"), (2, "w"), (3, "w")], "user_id long, warranty_id string")
    found = {r.user_id: r.label for r in M.with_outcome(pairs, log, "2024-01-16 00:00:00").collect()}
    assert found == {1: 1.0, 2: 2.0, 3: 0.0}


def test_report_says_when_a_measure_is_missing(spark, table):
    one = M.report(table, {"accuracy": 0.5, "auc": None}).collect()
    assert not any(r.evaluated for r in one)
    assert sum(r.n for r in one) == sum(r.n_train + r.n_held for r in one) == table.count()


def test_texts_of_a_model_score(spark):
    rows = [(10.0, 1.0, 0.0, 20.0, 1.0, 50), (61.0, 9.0, 3.0, 41.0, 1.0, 39)]
    df = spark.createDataFrame(rows, "daily_km double, fast_charge_sessions double, deep_discharge_events double, max_temp_seen double, region_climate_band double, behaviour_h int")
    calm, hard = [r.ev_reasons for r in EV.model_texts(df).collect()]
    assert calm == [C.EV_MODEL_HEALTHY] and hard == C.EV_MODEL_REASONS[:4]


def test_a_stored_model_scores_as_the_trained_one(spark, table, tmp_path):
    folder = str(tmp_path / "risk")
    names = C.RISK_FEATURES
    assert M.stored_models(spark, folder).count() == 0
    missing = M.load_model(spark, folder, names)
    assert missing is None and {r.base_h for r in M.model_or_rule(missing, table, F.lit(35)).select("base_h").collect()} == {35}
    first, _ = M.train_three_class(table, names, rounds=2, depth=2)
    second, _ = M.train_three_class(table, names, rounds=1, depth=1)
    M.save_model(first, spark, folder, names, "2024-01-16", "a")
    M.save_model(second, spark, folder, names, "2024-01-17", "b")
    scores = lambda model: sorted((r.user_id, r.warranty_id, r.model_score) for r in M.score(model, table).collect())
    assert scores(M.load_model(spark, folder, names)) == scores(second) != scores(first)
    assert scores(M.load_model(spark, folder, names, "a")) == scores(first)
    # a model of other features, or of the same in another order, doesn't fit
    assert M.load_model(spark, folder, names[:-1]) is None and M.load_model(spark, folder, names[::-1]) is None
    assert M.load_model(spark, folder, names, "c") is None
    about = {r.version: r for r in M.stored_models(spark, folder).collect()}
    assert about["a"].features == names and about["b"].cutoff == "2024-01-17"


def test_a_planted_signal_is_learned(spark):
    u = lambda k: F.pmod(F.xxhash64("user_id", F.lit(k)), F.lit(1000)) / 1000
    made = spark.range(1500).select(F.col("id").alias("user_id"), F.lit("w").alias("warranty_id")).select("*", u(1).alias("a"), u(2).alias("b"), u(3).alias("noise"))
    three = made.withColumn("label", F.when(F.col("a") > 0.7, 2.0).when(F.col("b") > 0.5, 1.0).otherwise(0.0))
    _, metrics = M.train_three_class(three, ["a", "b", "noise"], rounds=5, depth=2)
    assert metrics["accuracy"] > 0.95 and metrics["auc"] > 0.97
    _, metrics = M.train_binary(three.withColumn("label", F.least("label", F.lit(1.0))), ["a", "b", "noise"], rounds=5, depth=2)
    assert metrics["auc"] > 0.95
    _, metrics = M.train_three_class(three, ["noise"], rounds=5, depth=2)
    assert abs(metrics["auc"] - 0.5) < 0.1


def test_equal_rows_are_trained_as_one(spark):
    """Work grows with the rows that differ: copies only weigh more, and the model and its measures are those of all rows."""
    u = lambda k: F.pmod(F.xxhash64("k", F.lit(k)), F.lit(8))
    made = spark.range(4000).select(F.col("id").alias("user_id"), F.lit("w").alias("warranty_id"), (F.col("id") % 200).alias("k")).select("*", u(1).alias("a"), u(2).alias("b"))
    table = made.withColumn("label", F.when(F.col("a") > 5, 2.0).when(F.col("b") > 3, 1.0).otherwise(0.0))
    train, held = M.distinct_rows(table, ["a", "b"])
    assert train.count() <= 64 and train.rdd.getNumPartitions() == 1
    assert {r.weight for r in train.agg(F.sum("weight").alias("weight")).collect()} == {table.where(~M.held_out(["user_id", "warranty_id"])).count()}
    assert held.agg(F.sum("weight")).first()[0] + train.agg(F.sum("weight")).first()[0] == 4000
    few = M.fit_three_class(train, ["a", "b"], 3, 2)
    whole = M.fit_three_class(table.where(~M.held_out(["user_id", "warranty_id"])).withColumn("weight", F.lit(1.0)), ["a", "b"], 3, 2)
    scores = [sorted((r.user_id, round(r.model_score, 9)) for r in M.score(m, table).collect()) for m in (few, whole)]
    assert scores[0] == scores[1]
