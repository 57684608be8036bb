"""Streaming forms of the event-driven jobs.

Each takes a streaming frame and folders for output and checkpoint, and runs until its input is
used up. Batches repeat without harm after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR
from covermill.operators import behaviour as B
from covermill.operators import notify as Y
from covermill.operators import oem as O
from covermill.operators import telemetry as T
from covermill.streaming import sinks
from covermill.streaming.chain_state import ChainState
from covermill.streaming.paged_state import by_page
from covermill.streaming.profile_state import SUM_SCHEMA, PartsState, SliceState
from covermill.streaming.score_state import ScoreState
from covermill.streaming.signal_state import EVENT_SCHEMA, NewestEvents

LOG_SCHEMA = "id STRING, user_id BIGINT, warranty_id STRING, event_type STRING, payload STRING, ts TIMESTAMP_NTZ"
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_LOG_COLUMNS = [c.split()[0] for c in LOG_SCHEMA.split(", ")]


def ingest_telemetry(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends telemetry to a log by day, each id once, whatever its time and however late it arrives.

    The ids seen so far are kept as state in RocksDB, spread by hash, so a batch looks up its own ids
    and reads none of the log. Of rows with one id the first to arrive stays; a null id is one id.
    """
    fresh = stream.select(*_LOG_COLUMNS).dropDuplicates(["id"])

    def job(batch: DataFrame, n: int) -> None:
        sinks.write_batch(batch.withColumn("event_date", F.to_date("ts")), out, n, "event_date")

    sinks.per_batch(fresh, checkpoint, job)


#: Newest events that the signal of a pair looks at, and slots that a pair's state is spread over.
SIGNAL_EVENTS, SIGNAL_SLOTS = 50, 8
_SIGNAL_KEY = "user_id BIGINT, warranty_id STRING, slot INT"


def follow_signal(stream: DataFrame, checkpoint: str) -> None:
    """Keeps each pair's newest events as state in RocksDB; ``current_signal`` reads the state.

    State is bounded by the number of pairs: a pair has ``SIGNAL_SLOTS`` slots by the event's id, so a
    pair that sends a third of all events is the work of several tasks, and each slot holds the newest
    ``SIGNAL_EVENTS``. No log is written or read.
    """
    events = T.signal_events(stream.select(*_LOG_COLUMNS))
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col("ts"))
    slot = F.pmod(F.hash("id"), F.lit(SIGNAL_SLOTS))
    keyed = by_page(events.withColumns({"at": micros, "slot": slot}).drop("ts"), *PAIR, "slot")
    kept = keyed.transformWithState(NewestEvents(SIGNAL_EVENTS), _SIGNAL_KEY, "Append", "None")
    sinks.per_batch(kept, checkpoint, lambda batch, n: batch.write.format("noop").mode("overwrite").save())


def newest_events(spark, checkpoint: str) -> DataFrame:
    """The events in state: those of each pair's slots that can count for a signal, on any day."""
    events = f"events ARRAY<STRUCT<{EVENT_SCHEMA}>>"
    state = sinks.read_pages(spark, checkpoint, NewestEvents.variable, f"{_SIGNAL_KEY}, {events}").select(*PAIR, F.inline("events"))
    at = F.expr(f"timestampadd(MICROSECOND, at, {_EPOCH})").alias("ts")
    return state.select(*PAIR, "event_type", at, "id", "hours", "errors")


def current_pairs(spark, checkpoint: str) -> DataFrame:
    """Every pair that ever sent an event."""
    return newest_events(spark, checkpoint).select(*PAIR).distinct()


def current_signal(spark, checkpoint: str, as_of, window_days: int = 30) -> DataFrame:
    """The signal of every pair with an event in the window before ``as_of``, from state alone."""
    begin = S.ts_lit(as_of) - F.expr(f"INTERVAL {window_days} DAYS")
    return T.signal_of(newest_events(spark, checkpoint).where(F.col("ts") >= begin), SIGNAL_EVENTS)


KEPT_SCHEMA = "user_id BIGINT, warranty_id STRING, type STRING, audience STRING, id STRING, at BIGINT, is_read BOOLEAN, kept BOOLEAN"


def keep_notifications(notes: DataFrame, out: str, checkpoint: str, receipts: DataFrame | None = None) -> None:
    """Decides on notifications under the chained 7-day rule as they arrive; reading one resets it.

    ``receipts`` carries the key columns, the notification id and the time of reading. A late
    notification or receipt changes what came after it, so the decisions of a batch are its own rows' and those
    it changes; ``kept_notifications`` takes each notification's latest. State holds a key's events by day, in
    RocksDB, and a batch loads the days that it can change only. A key's rows of one batch are
    one task's work, so the source's rows per batch bound it.
    """
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col("at"))
    rows = notes.select(*Y.KEY, "id", F.col("created_at").alias("at"), "is_read", F.lit(False).alias("receipt"))
    if receipts is not None:
        read = receipts.select(*Y.KEY, F.col("notification_id").alias("id"), F.col("read_at").alias("at"))
        rows = rows.unionByName(read.withColumns({"is_read": F.lit(None).cast("boolean"), "receipt": F.lit(True)}))
    keyed = by_page(rows.withColumn("at", micros), *Y.KEY)
    decided = keyed.transformWithState(ChainState(C.DEDUPE_DAYS), KEPT_SCHEMA, "Append", "None")
    sinks.per_batch(decided, checkpoint, lambda batch, n: sinks.write_batch(batch, out, n))


def kept_notifications(spark, out: str) -> DataFrame:
    """The notifications whose latest decision keeps them."""
    log = sinks.read_batches(spark, out, KEPT_SCHEMA)
    latest = log.groupBy(*Y.KEY, "id", "at").agg(F.max_by(F.struct("is_read", "kept"), "batch_id").alias("d")).where("d.kept")
    return latest.select(*Y.KEY, "id", F.expr(f"timestampadd(MICROSECOND, at, {_EPOCH})").alias("created_at"), "d.is_read")


#: Hours of a slice of a profile's answers, and slices of a block (32 days).
SLICE_HOURS, BLOCK_SLICES = 1, 768
_PROFILE_KEY = "user_id BIGINT, product_type STRING, warranty_id STRING"
_PART_SCHEMA = f"{_PROFILE_KEY}, part BIGINT, {SUM_SCHEMA}"
#: The part of answers without a time, which come before all others.
_NO_TIME = -(1 << 40)


def follow_profiles(answers: DataFrame, warranties: DataFrame, checkpoint: str) -> None:
    """Keeps each profile's scores as answers arrive, in any order; ``current_profiles`` reads them from state.

    State is a tree in RocksDB: the steps of a profile in one hour, the hours of a block, the blocks of a
    profile, each with the one clamped shift that its answers compose to. A batch redoes the slices of its
    answers and the block and profile above each, nothing else; no log is written or read. A
    profile that sends a third of all answers is spread over its hours; its block joins 768 sums at most, its
    root one a month. An answer's product type follows from its warranty as it is when the answer arrives. Answers without
    a time are one slice.
    """
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col("created_at"))
    steps = B.answer_steps(answers, warranties).withColumn("at", micros)
    part = F.coalesce(F.expr(f"floor(at / {SLICE_HOURS * 3_600_000_000})").cast("long"), F.lit(_NO_TIME))
    slices = by_page(steps.withColumn("part", part), *B.PROFILE_KEY, "part").transformWithState(SliceState(), _PART_SCHEMA, "Append", "None")
    block = F.expr(f"floor(part / {BLOCK_SLICES})").cast("long")
    blocks = by_page(slices.withColumn("block", block), *B.PROFILE_KEY, "block").transformWithState(PartsState("block"), _PART_SCHEMA, "Append", "None")
    whole = by_page(blocks, *B.PROFILE_KEY).transformWithState(PartsState(), _PART_SCHEMA, "Append", "None")
    sinks.per_batch(whole, checkpoint, lambda batch, n: batch.write.format("noop").mode("overwrite").save())


def current_profiles(spark, checkpoint: str) -> DataFrame:
    """The scores of every profile that ever answered, one row of state each."""
    whole = sinks.read_pages(spark, checkpoint, PartsState.variable, f"{_PROFILE_KEY}, {SUM_SCHEMA}", operator=sinks.LAST_OPERATOR)
    shift = F.struct("lo", "hi", "d").alias("f")
    last = F.expr(f"timestampadd(MICROSECOND, last_at, {_EPOCH})").alias("last_question_at")
    return B.profiles_from_effects(whole.select(*B.PROFILE_KEY, "answers", *B.rises("answers", "good", "prompt"), last, shift))


def count_by_day(stream: DataFrame, item: str, time: str, out: str, checkpoint: str) -> None:
    """Counts events per item and day; a late event adds to its day like any other.

    Each batch writes the counts of its own rows, and a repeated batch replaces them.
    """

    def job(batch: DataFrame, n: int) -> None:
        counts = batch.groupBy(F.to_date(time).alias("day"), F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
        sinks.write_batch(counts, out, n)

    sinks.per_batch(stream, checkpoint, job)


def current_counts(spark, out: str) -> DataFrame:
    df = sinks.read_batches(spark, out, "day DATE, item STRING, n BIGINT")
    return df.groupBy("day", "item").agg(F.sum("n").alias("n"))


ALERT_SCHEMA = (
    "brand STRING, region_code STRING, total BIGINT, high BIGINT, message STRING, user_id STRING, warranty_id STRING, "
    "type STRING, audience STRING, is_read BOOLEAN, created_at TIMESTAMP_NTZ"
)
_GROUP = ["brand", "region_code"]
_CHANGE_SCHEMA = "brand STRING, region_code STRING, total BIGINT, high BIGINT"
#: Batches after which the changes of groups are summed into a snapshot.
COMPACT_BATCHES = 16


def _totals(spark, out: str, n: int) -> DataFrame:
    """The groups' counts after batch ``n``: the newest snapshot before it and the changes since."""
    snapshots = sinks.read_batches(spark, f"{out}/snapshots", _CHANGE_SCHEMA, before=n)
    base = snapshots.agg(F.max("batch_id")).first()[0]
    changes = sinks.read_batches(spark, f"{out}/changes", _CHANGE_SCHEMA, before=n + 1)
    if base is not None:
        changes = snapshots.where(F.col("batch_id") == base).union(changes.where(F.col("batch_id") > base))
    return changes.groupBy(*_GROUP).agg(F.sum("total").alias("total"), F.sum("high").alias("high"))


def alert_clusters(scored: DataFrame, out: str, checkpoint: str, as_of, compact: int = COMPACT_BATCHES) -> None:
    """Alerts on brand and region groups with many HIGH profiles, at most one per group in 7 days.

    A new score of a profile takes back what its earlier one counted: the last score of each profile
    is state in RocksDB, and a batch writes the changes of the groups it touches. Their totals are the
    newest snapshot and the changes since, so a batch reads no scores and no more than ``compact`` batches of
    changes. The recipient of an alert is the group. ``as_of`` is the time of the alerts, or a function
    from a batch's number to it, so that the seven days pass in a stream that goes on; it must
    give a repeated batch the same time.
    """
    spark = scored.sparkSession
    changed = by_page(scored.select(*PAIR, "id", *_GROUP, "risk_label", "warranty_known"), *PAIR, "id").transformWithState(ScoreState(), _CHANGE_SCHEMA, "Append", "None")

    def job(batch: DataFrame, n: int) -> None:
        now = as_of(n) if callable(as_of) else as_of
        sinks.write_batch(batch.groupBy(*_GROUP).agg(F.sum("total").alias("total"), F.sum("high").alias("high")), f"{out}/changes", n)
        touched = sinks.read_batches(spark, f"{out}/changes", _CHANGE_SCHEMA, before=n + 1).where(F.col("batch_id") == n)
        totals = _totals(spark, out, n)
        if (n + 1) % compact == 0:
            sinks.write_batch(totals.select("brand", "region_code", "total", "high"), f"{out}/snapshots", n)
        mine = totals.alias("s").join(touched.select(*_GROUP).alias("t"), S.same_key("s", "t", _GROUP), "left_semi")
        found = (
            O.alarming_groups(mine)
            .withColumn("user_id", F.concat_ws("/", F.coalesce("brand", F.lit("")), F.coalesce("region_code", F.lit(""))))
            .withColumn("warranty_id", F.lit(None).cast("string"))
            .withColumn("type", F.lit("oem_high_risk_cluster"))
            .withColumn("audience", F.lit("oem"))
            .withColumn("is_read", F.lit(False))
            .withColumn("created_at", S.ts_lit(now))
        )
        earlier = sinks.read_batches(spark, f"{out}/alerts", ALERT_SCHEMA, before=n)
        sinks.write_batch(Y.new_against_existing(found, earlier, now), f"{out}/alerts", n)

    sinks.per_batch(changed, checkpoint, job)


def alerts(spark, out: str) -> DataFrame:
    return sinks.read_batches(spark, f"{out}/alerts", ALERT_SCHEMA)
