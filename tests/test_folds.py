"""Ordered folds and de-duplication against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from covermill.operators import behaviour as B
from covermill.operators import notify as Y

START = datetime(2024, 1, 1)


def walk(steps, start=50):
    for a, b in steps:
        start = max(0, min(100, start + a))
        if b is not None:
            start = max(0, min(100, start + b))
    return start


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_composed_shifts_equal_the_walk(spark, monkeypatch, bits):
    monkeypatch.setattr(B, "_CHUNK_BITS", bits)
    rng = random.Random(bits)
    rows, want = [], {}
    for key in [None, "a", "b", "hot"]:
        n = 900 if key == "hot" else 40
        steps = [rng.choice([(1, None), (-2, None), (-5, None), (1, -5), (60, None), (-70, None)]) for _ in range(n)]
        want[key] = walk(steps)
        rows += [(key, i // 3, i, a, b) for i, (a, b) in enumerate(steps)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k STRING, t INT, id INT, step_a INT, step_b INT").repartition(5)
    got = B.composed_shifts(df, ["k"], ["t", "id"]).select("k", B.apply_shift(F.col("f")).alias("v")).collect()
    assert {r["k"]: r["v"] for r in got} == want


def brute_force_chain(rows, days=7):
    kept, anchors = set(), {}
    for key, at, nid, is_read in sorted(rows, key=lambda r: (r[1], r[2])):
        last = anchors.get(key)
        if last is not None and last >= at - timedelta(days=days):
            continue
        kept.add(nid)
        if not is_read:
            anchors[key] = at
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_dedupe_chain(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        key = rng.choice([None, "a", "a", "b", "c"])
        at = START + timedelta(hours=rng.choice([0, 6, 168, 336]) + rng.randrange(24 * (60 if key == "c" else 90)))
        rows.append((key, at, f"n{i:05d}", rng.random() < 0.3))
    # Sparse key with gaps of exactly seven days and of empty weeks.
    rows += [("gap", START + timedelta(days=d), f"g{d:03d}", False) for d in (0, 7, 8, 14, 15, 40, 47, 70)]
    want = brute_force_chain(rows)
    df = spark.createDataFrame(rows, "k STRING, created_at TIMESTAMP, id STRING, is_read BOOLEAN").withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz")
    )
    out = Y.dedupe_chain(df, ["k"])
    assert out.count() == len(rows)
    assert {r["id"] for r in out.where("kept").select("id").collect()} == want


@pytest.mark.parametrize("seed", [3, 4])
def test_receipts_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    hour = lambda h: START + timedelta(hours=h)
    notes = [(rng.choice([None, "a", "b"]), hour(rng.randrange(24 * 30)), f"n{i:04d}", rng.random() < 0.2) for i in range(400)]
    receipts = [(k, nid, at + timedelta(hours=rng.randrange(-5, 60))) for k, at, nid, _ in notes if rng.random() < 0.7]
    want, state = set(), {}
    steps = [(at, nid, 0, k, read) for k, at, nid, read in notes] + [(at, nid, 2, k, None) for k, nid, at in receipts]
    for at, nid, kind, k, read in sorted(steps, key=lambda x: x[:3]):
        last = state.get(k)
        if kind == 2:
            if last and last[0] == nid:
                del state[k]
        elif last is None or at - last[1] > timedelta(days=7):
            want.add(nid)
            if not read:
                state[k] = (nid, at)
    df = spark.createDataFrame(notes, "k STRING, created_at TIMESTAMP, id STRING, is_read BOOLEAN").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    read = spark.createDataFrame(receipts, "k STRING, notification_id STRING, read_at TIMESTAMP").withColumn("read_at", F.col("read_at").cast("timestamp_ntz"))
    out = Y.dedupe_chain(df, ["k"], receipts=read)
    assert out.count() == len(notes)
    assert {r["id"] for r in out.where("kept").collect()} == want


def test_chains_of_years_take_few_rounds(spark, monkeypatch):
    """Ten years of one hot key and a few more, ties included; rounds follow the logarithm of the chain."""
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), START + timedelta(hours=6 * rng.randrange(4 * 3650)), f"n{i:05d}", rng.random() < 0.2) for i in range(4000)]
    df = spark.createDataFrame(rows, "k STRING, created_at TIMESTAMP, id STRING, is_read BOOLEAN").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    folders = []
    reach = Y._reachable
    monkeypatch.setattr(Y, "_reachable", lambda nodes, folder: folders.append(folder) or reach(nodes, folder))
    kept = {r["id"] for r in Y.dedupe_chain(df, ["k"]).where("kept").collect()}
    assert kept == brute_force_chain(rows)
    rounds = spark.read.schema("node long, round int").parquet(f"{folders[0]}/met").agg(F.max("round")).first()[0]
    assert 400 < len([1 for r in rows if r[2] in kept and r[0] == "hot" and not r[3]]) and rounds <= 10


def test_dedupe_without_unread_keeps_all(spark):
    rows = [("a", START, "1", True), ("a", START, "2", True)]
    df = spark.createDataFrame(rows, "k STRING, created_at TIMESTAMP, id STRING, is_read BOOLEAN").withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz")
    )
    assert Y.dedupe_chain(df, ["k"]).where("kept").count() == 2


def test_stored_notifications_suppress(spark):
    note = "user_id BIGINT, warranty_id STRING, type STRING, audience STRING"
    found = spark.createDataFrame([(1, None, "x", "user"), (1, None, "y", "user"), (2, "w", "x", "user"), (3, "w", "x", "user")], note)
    stored = [
        (1, None, "x", "user", False, START - timedelta(days=7)),
        (1, None, "y", "user", False, START - timedelta(days=7, seconds=1)),
        (2, "w", "x", "user", True, START),
        (3, "w", "x", "oem", False, START),
    ]
    existing = spark.createDataFrame(stored, f"{note}, is_read BOOLEAN, created_at TIMESTAMP").withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz")
    )
    got = Y.new_against_existing(found, existing, START).collect()
    assert sorted((r["user_id"], r["type"]) for r in got) == [(1, "y"), (2, "x"), (3, "x")]
