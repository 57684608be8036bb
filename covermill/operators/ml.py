"""Risk models on feature tables: training, evaluation, batch scoring.

Feature tables are written to the checkpoint folder once before training: every boosting round reads
its input again, and must not recompute the joins behind it. Rows of equal features and class are one
row there, with their number as its weight, so a round's work grows with the rows that differ.
"""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR
from covermill.session import ensure_checkpoint_dir

SEED = 42
# Boosting rounds and tree depth of the risk model, and of the other two.
RISK_ROUNDS, RISK_DEPTH = 80, 2
OTHER_ROUNDS, OTHER_DEPTH = 100, 3
#: Rows that a task of a boosting round takes at least; a round is too short to be split further.
TASK_ROWS = 1 << 16


def labelled(features: DataFrame, label: Column) -> DataFrame:
    """Adds the class number of a LOW / MEDIUM / HIGH label."""
    return features.withColumn("label", S.risk_rank(label).cast("double"))


def with_outcome(features: DataFrame, telemetry: DataFrame, cutoff) -> DataFrame:
    """Features known at a cutoff, with the class of what followed: no failure from then on, one, or more."""
    failed = (F.col("ts") >= S.ts_lit(cutoff)) & (F.col("event_type") == "failure")
    later = telemetry.where(failed).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("later"))
    label = F.least(F.coalesce("later", F.lit(0)), F.lit(2)).cast("double")
    return features.join(later, PAIR, "left").withColumn("label", label).drop("later")


def held_out(keys: list[str], share: float = 0.2, seed: int = SEED) -> Column:
    """Whether a row is for validation. A hash of the key decides, so a class is split in proportion and
    a retried task sees the same rows."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000 < int(share * 1000)


def split(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows."""
    held = held_out(keys, share, seed)
    return df.where(~held), df.where(held)


def class_balance(df: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Rows of each class, and how many of them train and validate."""
    held = held_out(keys)
    return df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), S.flag_count(~held).alias("n_train"), S.flag_count(held).alias("n_held")
    )


def written(table: DataFrame) -> DataFrame:
    """A table computed once for all that reads it."""
    ensure_checkpoint_dir(table.sparkSession)
    return table.checkpoint()


def distinct_rows(table: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of different features or class, with the number of rows they stand for as ``weight``."""
    held = held_out(PAIR).alias("held")
    rows = written(table.select(*names, "label", held).groupBy(*names, "label", "held").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    tasks = -(-rows.count() // TASK_ROWS)
    few = rows.coalesce(max(1, tasks))
    return few.where(~F.col("held")), few.where("held")


def _boosted(rounds: int, depth: int) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, seed=SEED, weightCol="weight")


def fit_three_class(train: DataFrame, names: list[str], rounds: int, depth: int):
    """One boosted binary model per class over an assembled feature vector; rows count by their ``weight``."""
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, OneVsRest(classifier=_boosted(rounds, depth), weightCol="weight", parallelism=3)]).fit(train)


def fit_binary(train: DataFrame, names: list[str], rounds: int, depth: int):
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, _boosted(rounds, depth)]).fit(train)


def score(model, features: DataFrame) -> DataFrame:
    """Class probabilities, label and the base score 0.5 P(MEDIUM) + P(HIGH) of each row.

    The per-class margins are squashed as the boosted model does and scaled to sum to 1. A class that
    training never saw has probability 0.
    """
    unseen = F.array_repeat(F.lit(-1e6), len(C.RISK_LABELS))
    margins = F.slice(F.concat(vector_to_array("rawPrediction"), unseen), 1, len(C.RISK_LABELS))
    squashed = F.transform(margins, lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)
    labels = S.text_array(C.RISK_LABELS)
    return (
        model.transform(features)
        .withColumn("_p", squashed)
        .withColumn("_t", total)
        .withColumn("p", F.transform("_p", lambda x: F.when(F.col("_t") > 0, x / F.col("_t")).otherwise(F.lit(1 / 3))))
        .withColumn("proba", F.map_from_arrays(labels, "p"))
        .withColumn("model_label", F.element_at(labels, F.array_position("p", F.array_max("p")).cast("int")))
        .withColumn("model_score", 0.5 * F.element_at("p", 2) + F.element_at("p", 3))
        .drop("_p", "_t", "rawPrediction", "prediction")
    )


def model_or_rule(model, features: DataFrame, rule_h: Column) -> DataFrame:
    """Base score in hundredths: the model's where there is a model, else the rule-based one."""
    if model is None:
        return features.withColumn("base_h", rule_h)
    return score(model, features).withColumn("base_h", F.round(F.col("model_score") * 100).cast("int"))


_ABOUT = "version string, features array<string>, cutoff string, trained_at timestamp, path string"


def save_model(model: PipelineModel, spark: SparkSession, folder: str, names: list[str], cutoff: str | None = None, version: str | None = None) -> str:
    """Stores a trained model under ``folder`` for scoring by other sessions; returns its version.

    A model is written to a place of its own and listed in ``about`` last, so a reader never meets half
    a model and a failed run leaves the one before in use.
    """
    version = version or uuid.uuid4().hex
    path = f"{folder}/models/{version}-{uuid.uuid4().hex}"
    model.save(path)
    about = spark.range(1).select(
        F.lit(version).alias("version"), S.text_array(names).alias("features"), F.lit(cutoff).cast("string").alias("cutoff"),
        F.current_timestamp().alias("trained_at"), F.lit(path).alias("path"),
    )
    about.write.mode("append").json(f"{folder}/about")
    return version


def stored_models(spark: SparkSession, folder: str) -> DataFrame:
    """The models stored under ``folder``, one row each; none if the folder isn't there."""
    try:
        return spark.read.schema(_ABOUT).json(f"{folder}/about")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ABOUT)


def load_model(spark: SparkSession, folder: str, names: list[str], version: str | None = None) -> PipelineModel | None:
    """The newest stored model that was trained on exactly these features in this order, or the newest of a version.

    None if there is none, and scoring falls back on the rules: a model of other features can't score these.
    """
    fit = stored_models(spark, folder).where(F.col("features") == S.text_array(names))
    if version is not None:
        fit = fit.where(F.col("version") == version)
    last = fit.orderBy(F.desc("trained_at"), "path").limit(1).collect()
    return PipelineModel.load(last[0].path) if last else None


def ovo_auc(scored: DataFrame) -> float | None:
    """Mean area under the ROC curve over all ordered pairs of classes present; rows count by their ``weight``."""
    present = {int(r["label"]) for r in scored.select("label").distinct().collect()}  # at most 3
    areas = []
    for a, b in combinations(sorted(present), 2):
        both = scored.where(F.col("label").isin(float(a), float(b)))
        for pos in (a, b):
            rows = both.select((F.col("label") == pos).cast("double").alias("y"), F.element_at("p", pos + 1).alias("s"), "weight")
            areas.append(BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", weightCol="weight", numBins=0).evaluate(rows))
    return sum(areas) / len(areas) if areas else None


def train_three_class(table: DataFrame, names: list[str], rounds: int, depth: int):
    """Fits on four fifths and evaluates on the rest: (model, metrics)."""
    train, held = distinct_rows(table, names)
    model = fit_three_class(train, names, rounds, depth)
    scored = score(model, held).withColumn("prediction", F.array_position("p", F.array_max("p")).cast("double") - 1).cache()
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy", weightCol="weight").evaluate(scored)
    auc = ovo_auc(scored)
    scored.unpersist()
    return model, {"accuracy": accuracy, "auc": auc}


def train_binary(table: DataFrame, names: list[str], rounds: int, depth: int):
    train, held = distinct_rows(table, names)
    model = fit_binary(train, names, rounds, depth)
    scored = model.transform(held).cache()
    both = scored.select("label").distinct().count() == 2
    auc = BinaryClassificationEvaluator(weightCol="weight", numBins=0).evaluate(scored) if both else None
    scored.unpersist()
    return model, {"auc": auc}


def report(table: DataFrame, metrics: dict[str, float | None]) -> DataFrame:
    """Class balance, and whether validation gave every metric: it can't where one class is left."""
    evaluated = all(value is not None and 0 <= value <= 1 for value in metrics.values())
    return class_balance(table).withColumn("evaluated", F.lit(evaluated))


def v2_features(
    counts: DataFrame,
    warranties: DataFrame,
    profiles: DataFrame,
    nudges: DataFrame,
    peers: DataFrame,
    searches: DataFrame,
    components: DataFrame,
    as_of,
) -> DataFrame:
    """The second model's table per pair: 20 numbers and three one-hot groups.

    Every input has one row per pair or per warranty, so the joins do not multiply rows. Those on
    the pair come first and share its partitioning; one join on the warranty follows. ``components`` counts searches per component; the most searched
    one is the pair's focus.
    """
    focus = components.groupBy(*PAIR).agg(F.max_by("component", F.struct("n", "component")).alias("focus"))
    w = warranties.select(
        "warranty_id", "purchase_date", "expiry_date", "region_code", "climate_zone", "oem_risk_factor", "brand_reliability_score"
    )
    left = S.days_left(F.col("expiry_date"), as_of)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    half = lambda c, name: (F.coalesce(c, F.lit(50)) / 100).alias(name)
    return (
        counts.join(profiles.select(*PAIR, "behaviour_h", "care_h", "resp_h"), PAIR, "left")
        .join(nudges.select(*PAIR, F.col("shown").alias("nudges_shown"), F.col("acted").alias("nudges_acted"), F.col("ignored").alias("nudges_ignored")), PAIR, "left")
        .join(searches.select(*PAIR, "search_count", F.col("unresolved").alias("unresolved_search_count")), PAIR, "left")
        .join(focus, PAIR, "left")
        .join(w.join(peers.drop("user_id"), "warranty_id", "left"), "warranty_id", "left")
        .select(
            *PAIR,
            F.col("usage_hours"),
            F.col("error_count").cast("double").alias("errors"),
            F.col("failure_count").cast("double").alias("failures"),
            F.col("maintenance_count").cast("double").alias("maintenance"),
            F.coalesce(S.age_months(F.col("purchase_date"), as_of), F.lit(0.0)).alias("months_used"),
            F.coalesce(left, F.lit(0)).cast("double").alias("days_to_expiry"),
            F.when(left < 0, 1.0).otherwise(0.0).alias("is_out_of_coverage"),
            half("behaviour_h", "behaviour_score"),
            half("care_h", "care_score"),
            half("resp_h", "response_speed_score"),
            *[zero(c) for c in ("nudges_shown", "nudges_acted", "nudges_ignored", "avg_rating", "review_sentiment")],
            *[zero(c) for c in ("failure_keyword_count", "search_count", "unresolved_search_count")],
            *[zero(c) for c in ("oem_risk_factor", "brand_reliability_score")],
            *S.one_hot(F.lower("region_code"), C.REGIONS, "region"),
            *S.one_hot(F.col("climate_zone"), C.CLIMATES, "climate"),
            *S.one_hot(F.col("focus"), C.COMPONENTS, "component"),
        )
    )


def v2_names() -> list[str]:
    groups = (("region", C.REGIONS), ("climate", C.CLIMATES), ("component", C.COMPONENTS))
    return [*C.V2_NUMERIC, *[f"{g}_{v}" for g, vocab in groups for v in vocab]]
