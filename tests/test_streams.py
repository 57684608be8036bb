"""Streams over several files: equal to batch, stable under repeats, resets on receipts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from covermill.operators import behaviour as B
from covermill.operators import notify as Y
from covermill.operators import telemetry as T
from covermill.sources.domain import AS_OF, DomainTables, StreamedTables
from covermill.streaming import jobs as J
from covermill.streaming import sinks

PAIR = ["user_id", "warranty_id"]


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events in time order as four files, one file at a time to the stream."""
    path = tmp_path_factory.mktemp("events")
    df = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in range(4):
        part = df.where(F.expr(f"event_id >= {250 * i} AND event_id < {250 * (i + 1) if i < 3 else 10**9}"))
        part.coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def tables(spark, path):
    return StreamedTables(spark, SMALL, "events", path, files_per_trigger=1)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_ingest_counts_a_repeated_event_once(spark, split_events, tmp_path):
    d = tables(spark, split_events)
    stream = d.telemetry()
    J.ingest_telemetry(stream.unionByName(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    J.ingest_telemetry(stream.unionByName(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    out = spark.read.parquet(str(tmp_path / "o"))
    assert out.count() == out.select("id").distinct().count() == DomainTables(spark, SMALL).telemetry().count()


def test_signal_equals_batch(spark, split_events, tmp_path):
    J.follow_signal(tables(spark, split_events).telemetry(), str(tmp_path / "c"))
    cols = [*PAIR, "last_hours", "hours_window", "error_burden", "avg_hours"]
    batch = T.recent_signal(DomainTables(spark, SMALL).telemetry(), AS_OF)
    assert rows(J.current_signal(spark, str(tmp_path / "c"), AS_OF).select(*cols)) == rows(batch.select(*cols))


@pytest.fixture(scope="module")
def late_events(spark, tmp_path_factory):
    """The events as five files, the newest days first, the oldest last but one."""
    path = tmp_path_factory.mktemp("late")
    df = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in (3, 4, 1, 0, 2):
        part = df.where(F.expr(f"event_id >= {200 * i} AND event_id < {200 * (i + 1) if i < 4 else 10**9}"))
        part.coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


@pytest.mark.parametrize("files", [1, 3])
def test_late_rows_are_kept(spark, late_events, tmp_path, files):
    d, out = DomainTables(spark, SMALL), str(tmp_path)
    s = StreamedTables(spark, SMALL, "events", late_events, files_per_trigger=files)
    J.ingest_telemetry(s.telemetry(), f"{out}/t", f"{out}/tc")
    assert rows(spark.read.parquet(f"{out}/t").select("id", "ts")) == rows(d.telemetry().select("id", "ts"))
    J.count_by_day(s.interest(), "product_id", "ts", f"{out}/i", f"{out}/ic")
    batch = d.interest().groupBy(F.to_date("ts").alias("day"), F.col("product_id").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(J.current_counts(spark, f"{out}/i")) == rows(batch)
    J.follow_signal(s.telemetry(), f"{out}/sc")
    for as_of in (AS_OF, "2024-02-12 00:00:00"):
        # pairs without an event in the window stay, and lose their signal
        got = T.with_signal(J.current_pairs(spark, f"{out}/sc"), J.current_signal(spark, f"{out}/sc", as_of))
        want = T.with_signal(d.telemetry().select(*PAIR).distinct(), T.recent_signal(d.telemetry(), as_of))
        cols = [*PAIR, "usage_intensity", "error_burden", "delta_h", "hours_window"]
        assert rows(got.select(*cols)) == rows(want.select(*cols))


@pytest.mark.parametrize("files", [1, 3])
def test_late_notifications_and_answers_count(spark, late_events, tmp_path, files):
    d, out = DomainTables(spark, SMALL), str(tmp_path)
    s = StreamedTables(spark, SMALL, "events", late_events, files_per_trigger=files)
    J.keep_notifications(s.notification(), f"{out}/n", f"{out}/nc")
    batch = Y.dedupe_chain(d.notification(), Y.KEY).where("kept").select("id")
    assert rows(J.kept_notifications(spark, f"{out}/n").select("id")) == rows(batch)
    J.follow_profiles(s.answer(), d.warranty(), f"{out}/pc")
    cols = [*B.PROFILE_KEY, "answers", "behaviour_h", "care_h", "resp_h"]
    assert rows(J.current_profiles(spark, f"{out}/pc").select(*cols)) == rows(B.behaviour_profiles(d.answer(), d.warranty()).select(*cols))


def test_only_a_missing_folder_is_empty(spark, tmp_path):
    assert sinks.read_batches(spark, str(tmp_path / "none"), "a INT").count() == 0
    (tmp_path / "bad" / "batch_id=0").mkdir(parents=True)
    (tmp_path / "bad" / "batch_id=0" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        sinks.read_batches(spark, str(tmp_path / "bad"), "a INT").count()


def test_profiles_equal_batch(spark, split_events, tmp_path):
    d = DomainTables(spark, SMALL)
    J.follow_profiles(tables(spark, split_events).answer(), d.warranty(), str(tmp_path / "c"))
    cols = [*B.PROFILE_KEY, "answers", "behaviour_h", "care_h", "resp_h", "last_question_at"]
    batch = B.behaviour_profiles(d.answer(), d.warranty())
    assert rows(J.current_profiles(spark, str(tmp_path / "c")).select(*cols)) == rows(batch.select(*cols))


def test_profiles_from_slices_equal_the_walk(spark, tmp_path):
    """A hot profile over months, late answers, answers without a time, null keys, repeated times; the state after each batch."""
    rng = random.Random(5)
    schema = "user_id BIGINT, product_type STRING, warranty_id STRING, id BIGINT, answer_value STRING, created_at TIMESTAMP_NTZ"
    keys = [(1, "ac", "w1"), (2, "tv", "w2"), (None, "tv", None)]
    sent = []
    for i in range(600):
        key = keys[0] if i % 3 else rng.choice(keys)
        # steps of minutes and of weeks: many answers to a slice, many slices to a block, many blocks
        at = datetime(2023, 1, 1) + timedelta(minutes=rng.choice([rng.randrange(90), 60 * 24 * rng.randrange(200)]))
        sent.append((*key, i, rng.choice(["yes", "no", "NO", "1", "2", "2", "5", "4", "maybe", None]), None if i % 97 == 5 else at))
    rng.shuffle(sent)
    warranties = spark.createDataFrame([("w1", None, None)], "warranty_id STRING, product_name STRING, model_code STRING")
    path, checkpoint = str(tmp_path / "answers"), str(tmp_path / "c")
    for k in range(3):
        spark.createDataFrame(sent[k::3], schema).coalesce(2).write.mode("append").parquet(path)
        J.follow_profiles(spark.readStream.schema(schema).parquet(path), warranties, checkpoint)
        want = {}
        arrived = [r for j in range(k + 1) for r in sent[j::3]]
        for *key, _, value, at in sorted(arrived, key=lambda r: (r[5] is not None, r[5] or datetime.min, r[3])):
            p = want.setdefault(tuple(key), [0, 50, 50, 50, None])
            a = (value or "").lower()
            p[0] += 1
            if a in B.GOOD or a in B.BAD:
                p[1] = max(0, min(100, p[1] + (1 if a in B.GOOD else -2)))
            if a in B.WORST:
                p[1] = max(0, min(100, p[1] - 5))
            p[2] = min(100, p[2] + 3 * (a in B.GOOD))
            p[3] = min(100, p[3] + 2 + 2 * (a in B.PROMPT))
            p[4] = at if p[4] is None or (at and at > p[4]) else p[4]
        got = {tuple(r[:3]): list(r[3:]) for r in J.current_profiles(spark, checkpoint).select(*B.PROFILE_KEY, "answers", "behaviour_h", "care_h", "resp_h", "last_question_at").collect()}
        assert got == want


def test_notifications_equal_batch(spark, split_events, tmp_path):
    J.keep_notifications(tables(spark, split_events).notification(), str(tmp_path / "o"), str(tmp_path / "c"))
    batch = Y.dedupe_chain(DomainTables(spark, SMALL).notification(), Y.KEY).where("kept").select("id")
    assert rows(J.kept_notifications(spark, str(tmp_path / "o")).select("id")) == rows(batch)


def test_receipt_resets_the_seven_days(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda d: t0 + timedelta(days=d)
    schema = "kind STRING, user_id BIGINT, warranty_id STRING, type STRING, audience STRING, id STRING, is_read BOOLEAN, at TIMESTAMP"
    data = [
        ("note", 1, None, "x", "user", "a", False, at(0)),
        ("note", 1, None, "x", "user", "b", False, at(1)),
        ("read", 1, None, "x", "user", "a", None, at(2)),
        ("note", 1, None, "x", "user", "c", False, at(3)),
        ("read", 1, None, "x", "user", "a", None, at(4)),
        ("note", 1, None, "x", "user", "d", False, at(5)),
        ("note", 1, None, "x", "user", "e", False, at(10)),
        ("note", 1, None, "x", "user", "f", False, at(10.5)),
        ("note", 2, "w", "x", "user", "g", True, at(0)),
        ("note", 2, "w", "x", "user", "h", False, at(1)),
    ]
    src = str(tmp_path / "in")
    spark.createDataFrame(data, schema).withColumn("at", F.col("at").cast("timestamp_ntz")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    notes = stream.where("kind = 'note'").withColumnRenamed("at", "created_at")
    receipts = stream.where("kind = 'read'").withColumnsRenamed({"at": "read_at", "id": "notification_id"})
    J.keep_notifications(notes, str(tmp_path / "o"), str(tmp_path / "c"), receipts)
    got = sorted(r["id"] for r in J.kept_notifications(spark, str(tmp_path / "o")).collect())
    assert got == ["a", "c", "f", "g", "h"]


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_state_over_shuffled_files(spark, tmp_path, seed):
    """Notifications and receipts in any order of files equal the batch job, ties and late receipts included."""
    rng = random.Random(seed)
    hour = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    users = [None, 1, 1, 1, 2]
    notes = [(rng.choice(users), hour(rng.choice([0, 168, 336]) + 3 * rng.randrange(500)), f"n{i:04d}", rng.random() < 0.2) for i in range(500)]
    marks = [(u, nid, at + timedelta(hours=rng.randrange(-5, 80))) for u, at, nid, _ in notes if rng.random() < 0.5]
    data = [("note", u, nid, read, at) for u, at, nid, read in notes] + [("read", u, nid, None, at) for u, nid, at in marks] + [("note", 1, "timeless", False, None)]
    rng.shuffle(data)
    schema = "kind STRING, user_id BIGINT, id STRING, is_read BOOLEAN, at TIMESTAMP"
    src = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(data[k::4], schema).withColumn("at", F.col("at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)

    def parts(df):
        df = df.withColumns({"warranty_id": F.lit(None).cast("string"), "type": F.lit("x"), "audience": F.lit("user")})
        return df.where("kind = 'note'").withColumnRenamed("at", "created_at"), df.where("kind = 'read'").withColumnsRenamed({"at": "read_at", "id": "notification_id"})

    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    given, read = parts(stream)
    J.keep_notifications(given, str(tmp_path / "o"), str(tmp_path / "c"), read)
    given, read = parts(spark.read.parquet(src))
    want = Y.dedupe_chain(given, Y.KEY, receipts=read).where("kept").select("id", "user_id", "created_at")
    got = J.kept_notifications(spark, str(tmp_path / "o")).select("id", "user_id", "created_at")
    assert rows(got) == rows(want) and 40 < want.count() < 400
    # a batch writes decisions, not the log: the first batch's rows and what later ones changed
    log = spark.read.parquet(str(tmp_path / "o"))
    assert log.count() < 2 * len(notes)


def test_an_id_with_two_times_is_one_event(spark, tmp_path):
    src = str(tmp_path / "in")
    for k, ts in enumerate(("2024-01-05 00:00:00", "2024-01-01 00:00:00")):
        row = [("same", 1, "w", "usage", None, ts), (f"own{k}", 1, "w", "usage", None, ts)]
        spark.createDataFrame(row, "id STRING, user_id BIGINT, warranty_id STRING, event_type STRING, payload STRING, ts STRING").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    J.ingest_telemetry(stream, str(tmp_path / "o"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert sorted(r["id"] for r in got) == ["own0", "own1", "same"]


def test_daily_counts_equal_batch(spark, split_events, tmp_path):
    J.count_by_day(tables(spark, split_events).interest(), "product_id", "ts", str(tmp_path / "o"), str(tmp_path / "c"))
    batch = DomainTables(spark, SMALL).interest().groupBy(F.to_date("ts").alias("day"), F.col("product_id").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(J.current_counts(spark, str(tmp_path / "o"))) == rows(batch)


def test_alerts_are_sent_once(spark, tmp_path):
    schema = "user_id BIGINT, warranty_id STRING, id BIGINT, brand STRING, region_code STRING, risk_label STRING, warranty_known BOOLEAN"
    src = str(tmp_path / "in")
    make = lambda label, first, n, brand: [(1, "w", i, brand, None, label, True) for i in range(first, first + n)]
    for batch in (make("LOW", 0, 20, "a") + make("HIGH", 100, 1, "a"), make("HIGH", 0, 12, "a"), make("HIGH", 50, 5, "a") + make("HIGH", 0, 3, "b")):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    J.alert_clusters(stream, str(tmp_path / "o"), str(tmp_path / "c"), "2024-01-31 00:00:00")
    got = sorted((r["brand"], r["high"], r["total"], r["batch_id"]) for r in J.alerts(spark, str(tmp_path / "o")).collect())
    assert got == [("a", 13, 21, 1), ("b", 3, 3, 2)]
    # with a time for each batch the seven days pass
    J.alert_clusters(stream, str(tmp_path / "o2"), str(tmp_path / "c2"), lambda n: datetime(2024, 1, 1) + timedelta(days=8 * n))
    got = sorted((r["brand"], r["batch_id"]) for r in J.alerts(spark, str(tmp_path / "o2")).collect())
    assert got == [("a", 1), ("a", 2), ("b", 2)]


@pytest.mark.parametrize("compact", [2, 16])
def test_new_scores_take_back_old_ones(spark, tmp_path, compact):
    """Totals after each batch equal a count of the last scores, snapshots or not; profiles move between groups."""
    rng = random.Random(compact)
    schema = "user_id BIGINT, warranty_id STRING, id BIGINT, brand STRING, region_code STRING, risk_label STRING, warranty_known BOOLEAN"
    src, last, batches = str(tmp_path / "in"), {}, []
    for _ in range(5):
        chosen = rng.sample(range(60), 25)
        batch = [(1, "w", i, rng.choice(["a", "b"]), rng.choice([None, "r"]), rng.choice(["LOW", "HIGH"]), rng.random() < 0.8) for i in chosen]
        last.update({r[2]: r for r in batch})
        want = {}
        for r in last.values():
            if r[6]:
                total, high = want.get((r[3], r[4]), (0, 0))
                want[r[3], r[4]] = total + 1, high + (r[5] == "HIGH")
        batches.append(want)
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "o")
    J.alert_clusters(stream, out, str(tmp_path / "c"), "2024-01-31 00:00:00", compact)
    for n, want in enumerate(batches):
        got = {(r["brand"], r["region_code"]): (r["total"], r["high"]) for r in J._totals(spark, out, n).where("total > 0").collect()}
        assert got == want


def test_signal_of_a_hot_pair_from_bounded_state(spark, tmp_path):
    rng = random.Random(5)
    begin = datetime(2024, 1, 10)
    log = []
    for i in range(1500):
        pair = (1, "hot") if i % 3 else (rng.randrange(2, 9), None)
        ts = None if i % 97 == 0 else begin + timedelta(minutes=rng.randrange(25_000))
        log.append((None if i % 211 == 0 else f"e{i}", *pair, rng.choice(["usage", "error", "failure"]), '{"hours": %d, "errors": %d}' % (i, i % 4), ts))
    log.append(("only", 99, "w", "usage", None, None))
    rng.shuffle(log)
    schema = J.LOG_SCHEMA
    for k in range(4):
        spark.createDataFrame(log[k::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ckpt = str(tmp_path / "c")
    J.follow_signal(stream, ckpt)
    batch = spark.createDataFrame(log, schema)
    assert rows(J.current_pairs(spark, ckpt)) == rows(batch.select(*PAIR).distinct())
    for as_of in (AS_OF, "2024-02-20 00:00:00"):
        assert rows(J.current_signal(spark, ckpt, as_of)) == rows(T.recent_signal(batch, as_of))
    held = J.newest_events(spark, ckpt)
    assert held.where("warranty_id = 'hot'").count() == J.SIGNAL_EVENTS * J.SIGNAL_SLOTS < 1000
    # a restart without new files changes nothing
    J.follow_signal(stream, ckpt)
    assert rows(J.newest_events(spark, ckpt)) == rows(held)


def test_signal_state_before_any_event(spark, tmp_path):
    (tmp_path / "in").mkdir()
    J.follow_signal(spark.readStream.schema(J.LOG_SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "c"))
    assert J.current_pairs(spark, str(tmp_path / "c")).count() == J.current_signal(spark, str(tmp_path / "c"), AS_OF).count() == 0
