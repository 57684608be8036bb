"""Behaviour profiles from answers, and the next question to ask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR
from covermill.functions.topk import first_rows_per_key

PROFILE_KEY = ["user_id", "product_type", "warranty_id"]

# Answers by effect.
GOOD = ["yes", "y", "true", "1", "5"]
BAD = ["no", "n", "false", "0"]
WORST = ["1", "2"]
PROMPT = ["4", "5"]

# Answers per chunk and chunks per block of the ordered fold.
_CHUNK_BITS = 12


def _then(first: Column, second: Column) -> Column:
    """Composition of two clamped shifts x -> min(hi, max(lo, x + d)); the result has the same form."""
    fit = lambda v: F.least(second["hi"], F.greatest(second["lo"], v + second["d"]))
    return F.struct(fit(first["lo"]).alias("lo"), fit(first["hi"]).alias("hi"), (first["d"] + second["d"]).alias("d"))


def _shift(delta: Column) -> Column:
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(100), delta)).cast("int").alias("lo"),
                    F.greatest(F.lit(0), F.least(F.lit(100), delta + 100)).cast("int").alias("hi"),
                    delta.cast("int").alias("d"))


def _identity() -> Column:
    return F.struct(F.lit(0).alias("lo"), F.lit(100).alias("hi"), F.lit(0).alias("d"))


def _compose_groups(df: DataFrame, keys: list[str], bits: int | None) -> DataFrame:
    """Composes the shifts of each key in ``seq`` order, 2**bits consecutive ones at a time (or all)."""
    group = [*keys, "seq"] if bits else keys
    if bits:
        df = df.withColumn("pos", F.col("seq")).withColumn("seq", F.shiftright("seq", bits))
    else:
        df = df.withColumn("pos", F.col("seq"))
    listed = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "f"))).alias("fs"))
    whole = F.aggregate("fs", _identity(), lambda acc, x: _then(acc, x["f"]))
    return listed.select(*group, whole.alias("f"))


def composed_shifts(steps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The one clamped shift per key that equals its ordered steps, each clamped to 0..100.

    Clamped steps compose associatively, so a key's steps need not meet in one task: rows are range
    partitioned on key and order (a hot key spans many partitions), numbered within them, and folded
    4 096 at a time over three levels. Groups stay bounded by that number, the last one by the
    number of blocks of 16 million steps.
    """
    ranged = steps.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    first = _shift(F.col("step_a"))
    both = F.when(F.col("step_b").isNull(), first).otherwise(_then(first, _shift(F.col("step_b"))))
    numbered = ranged.select(*keys, F.monotonically_increasing_id().alias("seq"), both.alias("f"))
    for bits in (_CHUNK_BITS, _CHUNK_BITS, None):
        numbered = _compose_groups(numbered, keys, bits)
    return numbered


def apply_shift(f: Column, start: int = 50) -> Column:
    return F.least(f["hi"], F.greatest(f["lo"], F.lit(start) + f["d"]))


def with_product_type(rows: DataFrame, warranties: DataFrame) -> DataFrame:
    """Product type given with the row, else inferred from the warranty's name or model."""
    w = warranties.select("warranty_id", F.col("product_name").alias("w_name"), F.col("model_code").alias("w_model"))
    inferred = S.infer_product_type(F.col("product_type"), F.col("w_name"), F.col("w_model"))
    return rows.join(w, "warranty_id", "left").withColumn("product_type", inferred).drop("w_name", "w_model")


def answer_steps(answers: DataFrame, warranties: DataFrame) -> DataFrame:
    """What each answer does: whether it is good and prompt, and up to two steps of behaviour in order."""
    a = F.lower(F.coalesce("answer_value", F.lit("")))
    one = F.when(a.isin(GOOD), 1).when(a.isin(BAD), -2)
    two = F.when(a.isin(WORST), -5)
    return with_product_type(answers, warranties).select(
        *PROFILE_KEY, "created_at", "id",
        F.coalesce(one, two).alias("step_a"), F.when(one.isNotNull(), two).alias("step_b"),
        a.isin(GOOD).cast("int").alias("good"), a.isin(PROMPT).cast("int").alias("prompt"),
    )


def rises(answers: str, good: str, prompt: str) -> list[Column]:
    """What counts of answers add to care and responsiveness."""
    return [(3 * F.col(good)).alias("care_add"), (2 * F.col(answers) + 2 * F.col(prompt)).alias("resp_add")]


def answer_effects(answers: DataFrame, warranties: DataFrame) -> DataFrame:
    """What a batch of answers adds per profile: three sums, and the composed behaviour shift.

    Care and responsiveness only ever rise, so clamping at the end equals clamping at each step and
    plain sums suffice. Behaviour moves both ways and needs the ordered fold.
    """
    steps = answer_steps(answers, warranties)
    sums = steps.groupBy(*PROFILE_KEY).agg(
        F.count(F.lit(1)).alias("answers"),
        F.sum("good").alias("good"),
        F.sum("prompt").alias("prompt"),
        F.max("created_at").alias("last_question_at"),
    ).select(*PROFILE_KEY, "answers", *rises("answers", "good", "prompt"), "last_question_at")
    moving = steps.drop("good", "prompt").where(F.col("step_a").isNotNull())
    shifts = composed_shifts(moving, PROFILE_KEY, ["created_at", "id"])
    return (
        sums.alias("s")
        .join(shifts.alias("w"), S.same_key("s", "w", PROFILE_KEY), "left")
        .select("s.*", F.coalesce("w.f", _identity()).alias("f"))
    )


def profiles_from_effects(effects: DataFrame) -> DataFrame:
    """Profile scores in hundredths; every profile starts at 50."""
    return effects.select(
        *PROFILE_KEY,
        "answers",
        apply_shift(F.col("f")).alias("behaviour_h"),
        F.least(F.lit(100), F.lit(50) + F.col("care_add")).alias("care_h"),
        F.least(F.lit(100), F.lit(50) + F.col("resp_add")).alias("resp_h"),
        "last_question_at",
    )


def behaviour_profiles(answers: DataFrame, warranties: DataFrame) -> DataFrame:
    """Profile scores per user, product type and warranty from all answers."""
    return profiles_from_effects(answer_effects(answers, warranties))


# --- next question -------------------------------------------------------------------------------


def next_bank_question(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """First unanswered question of the fixed bank per pair, null when all are answered.

    One flag per bank question is merged per pair; the first false flag is the answer.
    """
    ids = [q[0] for q in C.QUESTION_BANK]
    flags = answers.groupBy(*PAIR).agg(*[F.max(F.col("question_id") == q).alias(q) for q in ids])
    joined = pairs.join(flags, PAIR, "left")
    first = F.coalesce(*[F.when(~F.coalesce(F.col(q), F.lit(False)), F.lit(q)) for q in ids])
    return joined.withColumn("bank_question_id", first).drop(*ids)


def _ranked_by_scope(questions: DataFrame, scopes: list[str], order: list[Column], places: int) -> DataFrame:
    """The first ``places`` questions under each scope a caller may ask with, ranked within the scope.

    A caller leaves out any subset of the scope columns; a left-out column matches every question.
    That makes 2**n entries per question, keyed for an equality join. A scope that many questions
    share sends ``places`` of them per input partition.
    """
    masks = F.array(*[F.lit(m) for m in range(2 ** len(scopes))])
    df = questions.withColumn("mask", F.explode(masks))
    for i, c in enumerate(scopes):
        used = F.col("mask").bitwiseAND(1 << i) != 0
        df = df.withColumn(f"k_{c}", F.when(used, F.col(c)).otherwise(F.lit("")))
    keyed = df.where(reduce(lambda x, y: x & y, [F.col(f"k_{c}").isNotNull() for c in scopes]))
    return first_rows_per_key(keyed, ["mask", *[f"k_{c}" for c in scopes]], order, places, rank="place")


def next_oem_question(pairs: DataFrame, questions: DataFrame, answers: DataFrame, scopes: list[str]) -> DataFrame:
    """First unanswered active manufacturer question per pair, by priority.

    ``pairs`` carries the scope columns it asks with: a non-null one must equal the question's. The
    work follows the answers given: answered places are counted per pair, and the first gap in them
    is the place to ask, looked up by equality. Pairs are never multiplied by questions. A pair of n
    answers asks for place n + 1 at most, so no place beyond the largest such number is ranked.
    """
    keys = ["mask", *[f"k_{c}" for c in scopes]]
    answered = answers.select(*PAIR, F.col("question_id").alias("id")).distinct()
    most = answered.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    ranked = _ranked_by_scope(questions, scopes, [F.col("priority"), F.col("seq")], most + 1)
    asked = pairs
    mask = F.lit(0)
    for i, c in enumerate(scopes):
        given = S.truthy(F.col(c))
        mask = mask + F.when(given.isNotNull(), 1 << i).otherwise(0)
        asked = asked.withColumn(f"k_{c}", F.coalesce(given, F.lit("")))
    asked = asked.withColumn("mask", mask)
    places = (
        answered.join(asked.select(*PAIR, *keys), PAIR)
        .join(ranked.select("id", *keys, "place"), ["id", *keys])
        .withColumn("nth", F.row_number().over(Window.partitionBy(*PAIR).orderBy("place")))
        .groupBy(*PAIR)
        .agg(S.flag_count(F.col("place") == F.col("nth")).alias("leading"))
    )
    wanted = asked.join(places, PAIR, "left").withColumn("place", F.coalesce("leading", F.lit(0)) + 1)
    found = ranked.select(*keys, "place", F.col("id").alias("oem_question_id"))
    return wanted.join(found, [*keys, "place"], "left").drop(*keys, "place", "leading")


def next_question(pairs: DataFrame, bank_answers: DataFrame, oem_questions: DataFrame, oem_answers: DataFrame) -> DataFrame:
    """Manufacturer question first, else the bank, else done."""
    df = next_bank_question(next_oem_question(pairs, oem_questions, oem_answers, ["brand", "model_code", "product_type"]), bank_answers)
    q = F.coalesce("oem_question_id", "bank_question_id")
    return df.withColumn("question_id", q).withColumn("done", q.isNull()).withColumn(
        "reason",
        F.when(F.col("oem_question_id").isNotNull(), "oem_question_available")
        .when(F.col("bank_question_id").isNotNull(), "question_available")
        .otherwise("no_question_available"),
    )


def scoped_question(
    asks: DataFrame, questions: DataFrame, answers: DataFrame, profiles: DataFrame, warranties: DataFrame, as_of
) -> DataFrame:
    """Next stored question per asking pair, by weight then id, outside the 7-day cooldown.

    The cooldown goes by the profile of the pair and the product type it asks for; of several, the newest.

    A question applies if each of its scope columns is null or equals the asker's. Its null columns
    form its mask; an asker probes every mask in use with one equality join, and in each the first
    gap in the answered places names its candidate.
    """
    scopes = ["brand", "model_code", "product_type"]
    keys = ["mask", *[f"k_{c}" for c in scopes]]
    active = questions.where(F.col("is_active") == 1)
    own = F.lit(0)
    for i, c in enumerate(scopes):
        own = own + F.when(F.col(c).isNotNull(), 1 << i).otherwise(0)
        active = active.withColumn(f"k_{c}", F.coalesce(c, F.lit("")))
    active = active.withColumn("mask", own)
    w = Window.partitionBy(*keys).orderBy(F.desc("weight"), F.asc("id"))
    ranked = active.withColumn("place", F.row_number().over(w))

    due = F.col("last_question_at").isNull() | (
        F.col("last_question_at") <= S.ts_lit(as_of) - F.expr(f"INTERVAL {C.QUESTION_COOLDOWN_DAYS} DAYS")
    )
    last = profiles.groupBy(*PROFILE_KEY).agg(F.max_by("last_question_at", "id").alias("last_question_at"))
    asked = with_product_type(asks, warranties).alias("a").join(last.alias("p"), S.same_key("a", "p", PROFILE_KEY), "left")
    asked = asked.select("a.*", "p.last_question_at").where(due)
    # Answers count per user and product type, so that is the unit a gap is looked for in.
    unit = ["user_id", "product_type", "brand", "model_code"]
    units = asked.select(*unit).distinct().withColumn("mask", F.explode(F.array(*[F.lit(m) for m in range(8)])))
    for i, c in enumerate(scopes):
        units = units.withColumn(f"k_{c}", F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(c)).otherwise(F.lit("")))
    units = units.where(reduce(lambda x, y: x & y, [F.col(f"k_{c}").isNotNull() for c in scopes]))

    answered = with_product_type(answers, warranties).select("user_id", "product_type", F.col("question_id").alias("id")).distinct()
    hits = (
        answered.join(ranked.select("id", *keys, "place", "weight"), "id")
        .withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "product_type", *keys).orderBy("place")))
        .groupBy("user_id", "product_type", *keys)
        .agg(S.flag_count(F.col("place") == F.col("nth")).alias("leading"))
    )
    u, h = units.alias("u"), hits.alias("h")
    same = F.col("u.user_id").eqNullSafe(F.col("h.user_id")) & F.col("u.product_type").eqNullSafe(F.col("h.product_type"))
    for k in keys:
        same = same & (F.col(f"u.{k}") == F.col(f"h.{k}"))
    wanted = u.join(h, same, "left").select("u.*", (F.coalesce("h.leading", F.lit(0)) + 1).alias("place"))
    best = (
        wanted.join(ranked.select(*keys, "place", "id", "weight"), [*keys, "place"])
        .groupBy(*unit)
        .agg(F.min(F.struct((-F.col("weight")).alias("neg"), "id")).alias("best"))
    )
    a, b = asked.alias("a"), best.alias("b")
    return a.join(b, S.same_key("a", "b", unit)).select("a.*", F.col("b.best.id").alias("question_id"))
