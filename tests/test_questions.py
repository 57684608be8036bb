"""Question selection against brute force."""

import json
import random

from pyspark.sql import functions as F

from covermill import constants as C
from covermill.operators import behaviour as B
from covermill.operators import oem as O
from covermill.operators import recommend as P

Q = "id STRING, brand STRING, model_code STRING, product_type STRING, priority INT, seq BIGINT"


def test_next_oem_question(spark):
    rng = random.Random(7)
    pick = lambda *v: rng.choice(v)
    questions = [(f"oemq_{i}", pick(None, "x", "y"), pick(None, "m"), pick(None, "ac"), pick(10, 20), i) for i in range(25)]
    pairs = [(u, f"w{u}", pick(None, "", "x", "y"), pick(None, "m"), pick(None, "ac")) for u in range(40)]
    answers = [(u, f"w{u}", f"oemq_{rng.randrange(28)}") for u in range(30) for _ in range(rng.choice([0, 3, 60]))]
    got = B.next_oem_question(
        spark.createDataFrame(pairs, "user_id BIGINT, warranty_id STRING, brand STRING, model_code STRING, product_type STRING"),
        spark.createDataFrame(questions, Q),
        spark.createDataFrame(answers, "user_id BIGINT, warranty_id STRING, question_id STRING"),
        ["brand", "model_code", "product_type"],
    ).collect()
    assert len(got) == len(pairs)
    done = {(a[0], a[2]) for a in answers}
    for r in got:
        open_ = [
            q for q in sorted(questions, key=lambda q: (q[4], q[5]))
            if all(not r[c] or q[i] == r[c] for i, c in ((1, "brand"), (2, "model_code"), (3, "product_type")))
            and (r["user_id"], q[0]) not in done
        ]
        assert r["oem_question_id"] == (open_[0][0] if open_ else None)


def test_bank_order_and_end(spark):
    ids = [q[0] for q in C.QUESTION_BANK]
    pairs = spark.createDataFrame([(1, "w"), (2, "w"), (3, "w")], "user_id BIGINT, warranty_id STRING")
    answers = [(1, "w", ids[0]), (1, "w", ids[2])] + [(2, "w", i) for i in ids]
    got = B.next_bank_question(pairs, spark.createDataFrame(answers, "user_id BIGINT, warranty_id STRING, question_id STRING"))
    assert {r["user_id"]: r["bank_question_id"] for r in got.collect()} == {1: ids[1], 2: None, 3: ids[0]}


def test_scoped_question(spark):
    rng = random.Random(3)
    pick = lambda *v: rng.choice(v)
    questions = [(i, pick(0.1, 0.5), pick(1, 1, 0), pick(None, "x", "y"), pick(None, "m1"), pick(None, "fridge", "ac")) for i in range(30)]
    asks = [(u, f"w{u}", pick(None, "x", "y"), pick("m1", "m2"), pick("fridge", "ac")) for u in range(25)]
    answers = [(pick(*range(25)), None, pick("fridge", "ac"), rng.randrange(30)) for _ in range(300)]
    pair = "user_id BIGINT, warranty_id STRING"
    none = spark.createDataFrame([], "warranty_id STRING, product_name STRING, model_code STRING")
    profiles = spark.createDataFrame([], f"id BIGINT, {pair}, product_type STRING, last_question_at TIMESTAMP_NTZ")
    got = B.scoped_question(
        spark.createDataFrame(asks, f"{pair}, brand STRING, model_code STRING, product_type STRING"),
        spark.createDataFrame(questions, "id BIGINT, weight DOUBLE, is_active INT, brand STRING, model_code STRING, product_type STRING"),
        spark.createDataFrame(answers, f"{pair}, product_type STRING, question_id BIGINT"),
        profiles, none, "2024-01-31 00:00:00",
    ).collect()
    found = {r["user_id"]: r["question_id"] for r in got}
    done = {(a[0], a[2], a[3]) for a in answers}
    for u, _, brand, model, kind in asks:
        fit = [
            q for q in sorted(questions, key=lambda q: (-q[1], q[0]))
            if q[2] == 1 and q[3] in (None, brand) and q[4] in (None, model) and q[5] in (None, kind) and (u, kind, q[0]) not in done
        ]
        fit = [q for q in fit if not (q[3] is not None and brand is None)]
        assert found.get(u) == (fit[0][0] if fit else None)


def test_cooldown(spark):
    pair = "user_id BIGINT, warranty_id STRING"
    asks = spark.createDataFrame([(u, "w", "x", "m", "ac") for u in (1, 2, 3, 4)], f"{pair}, brand STRING, model_code STRING, product_type STRING")
    q = spark.createDataFrame([(1, 0.5, 1, None, None, None)], "id BIGINT, weight DOUBLE, is_active INT, brand STRING, model_code STRING, product_type STRING")
    asked = [(1, 1, "w", "ac", "2024-01-24 00:00:00"), (2, 2, "w", "ac", "2024-01-24 00:00:01"), (3, 4, "w", "fridge", "2024-01-30 00:00:00"), (4, 4, "w", None, "2024-01-30 00:00:00")]
    last = spark.createDataFrame(asked, f"id BIGINT, {pair}, product_type STRING, t STRING")
    # a profile of another product type, or of none, doesn't count
    profiles = last.select("id", "user_id", "warranty_id", "product_type", F.col("t").cast("timestamp_ntz").alias("last_question_at"))
    got = B.scoped_question(
        asks, q, spark.createDataFrame([], f"{pair}, product_type STRING, question_id BIGINT"), profiles,
        spark.createDataFrame([], "warranty_id STRING, product_name STRING, model_code STRING"), "2024-01-31 00:00:00",
    )
    assert sorted(r["user_id"] for r in got.collect()) == [1, 3, 4]


def test_strict_and_wildcard_filters(spark):
    q = spark.createDataFrame([("a", "x", True, 2, 1), ("b", None, True, 1, 2), ("c", "x", False, 0, 3)], "id STRING, brand STRING, enabled BOOLEAN, priority INT, seq INT")
    assert [r["id"] for r in O.active_questions(q, brand="x").collect()] == ["a"]
    assert [r["id"] for r in O.active_questions(q, brand=None).collect()] == ["b", "a"]
    recs = spark.createDataFrame([("a", "x", "active"), ("b", None, "active"), ("c", "y", "active"), ("d", "x", "draft")], "id STRING, brand STRING, status STRING")
    assert sorted(r["id"] for r in O.active_recommendations(recs, brand="x").collect()) == ["a", "b"]


def test_rules_equal_brute_force(spark):
    rows = [(u, "w", u % 101, (u * 7) % 101, u % 4, ["", "fridge", "ev car"][u % 3], u % 3) for u in range(400)]
    context = spark.createDataFrame(rows, "user_id BIGINT, warranty_id STRING, behaviour_h INT, care_h INT, aqi_band INT, profile_type STRING, risk_rank INT")
    stored = [
        (1, "A", '{"min_aqi_band": 2}', "t", "m", 3, 1), (2, "B", '{"min_risk_label": "HIGH"}', "t", "m", 1, 1),
        (3, "C", '{"product_type_filter": ["fridge"], "max_care_score": 0.5}', "t", "m", 2, 1),
        (4, "D", '{"product_type_filter": "my ev car"}', "t", "m", 1, 1), (5, "E", "{}", "t", "m", 9, 0), (6, "F", None, "t", "m", 4, 1),
    ]
    # many more rules, most of them with conditions that repeat
    more = [(i, "G", '{"max_behaviour_score": %s}' % (i % 5 / 10), "t", "m", 2 + i % 7, 1) for i in range(100, 20100)]
    schema = "id BIGINT, segment STRING, condition_json STRING, title STRING, message STRING, priority INT, active INT"

    def holds(i, b, care, aqi, kind, rank):
        if i >= 100:
            return b <= i % 5 * 10
        return {1: aqi >= 2, 2: rank == 2, 3: kind in ("", "fridge") and care <= 50, 4: kind in "my ev car", 5: False, 6: True}[i]

    for rules in (stored, stored + more):
        got = sorted((r.user_id, r.place, r.rule_id) for r in P.rule_recommendations(context, spark.createDataFrame(rules, schema)).collect())
        order = sorted((r[5], r[0]) for r in rules if r[6])
        want = []
        for u, _, b, care, aqi, kind, rank in rows:
            first = [i for _, i in order if holds(i, b, care, aqi, kind, rank)][:3]
            want += [(u, n + 1, i) for n, i in enumerate(first)]
        assert got == sorted(want)
    none = spark.createDataFrame([r for r in stored if r[6] == 0], schema)
    fallback = sorted(map(tuple, P.rule_recommendations(context, none).collect()))
    assert fallback == sorted(map(tuple, P.rule_recommendations(context, P.default_rules(spark)).collect())) and fallback


def test_rules_of_all_kinds_of_limits_equal_brute_force(spark):
    rng = random.Random(11)
    pick = lambda *v: rng.choice(v)
    words = ["ac", "fridge", "ev car", "f", "ev", "küche", "washing machine"]
    stored, parsed = [], []
    for i in range(900):
        cond = {}
        if rng.random() < 0.7:
            cond["max_behaviour_score"] = rng.randrange(-2, 104) / 100
        if rng.random() < 0.7:
            cond["max_care_score"] = rng.randrange(-2, 104) / 100
        if rng.random() < 0.5:
            cond["min_aqi_band"] = rng.randrange(-1, 6)
        if rng.random() < 0.5:
            cond["min_risk_label"] = pick("LOW", "MEDIUM", "HIGH", "other", "")
        if rng.random() < 0.7:
            cond["product_type_filter"] = pick([], [pick(*words)], [pick(*words), pick(*words), "x"], pick(*words), "my " + pick(*words) + " place", "")
        stored.append((i, "S", json.dumps(cond), "t", "m", rng.randrange(40), 1))
        parsed.append((stored[-1][5], i, cond))
    parsed.sort(key=lambda r: r[:2])
    rows = [(u, "w", rng.randrange(101), rng.randrange(101), rng.randrange(5), pick("", "car", *words), rng.randrange(3)) for u in range(1500)]
    rows += [(u, "w", 0, 100, 4, "", 2) for u in range(1500, 2000)] + [(2000, "w", 50, 50, 0, None, 0), (2001, "w", None, 50, 0, "ac", 0)]
    context = spark.createDataFrame(rows, "user_id BIGINT, warranty_id STRING, behaviour_h INT, care_h INT, aqi_band INT, profile_type STRING, risk_rank INT")
    rules = spark.createDataFrame(stored, "id BIGINT, segment STRING, condition_json STRING, title STRING, message STRING, priority INT, active INT")

    def holds(cond, b, care, aqi, kind, rank):
        wanted = cond.get("product_type_filter")
        return (
            b <= round(cond.get("max_behaviour_score", 9) * 100)
            and care <= round(cond.get("max_care_score", 9) * 100)
            and aqi >= cond.get("min_aqi_band", -9)
            and rank >= {"MEDIUM": 1, "HIGH": 2}.get(cond.get("min_risk_label"), 0)
            and (kind == "" or not wanted or kind in wanted)
        )

    found = P.rule_recommendations(context, rules)
    got = sorted((r.user_id, r.place, r.rule_id) for r in found.collect())
    want = []
    for u, _, *facts in rows:
        if None not in facts:
            first = [i for _, i, cond in parsed if holds(cond, *facts)][:3]
            want += [(u, n + 1, i) for n, i in enumerate(first)]
    assert got == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_cover_exactly_the_scores_up_to_a_limit(spark):
    limits = spark.createDataFrame([(m,) for m in [None, *range(-3, 260)]], "m INT")
    scores = spark.range(256).select(F.col("id").cast("int").alias("x"), P.cells_of(F.col("id").cast("int")).alias("held")).collect()
    for r in limits.select("m", P.cells_up_to(F.col("m")).alias("cells")).collect():
        assert len(r.cells) <= 12 and len(set(r.cells)) == len(r.cells)
        for s in scores:
            assert len(set(r.cells) & set(s.held)) == (r.m is None or s.x <= r.m or r.m >= 255)
