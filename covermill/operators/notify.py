"""Notifications: candidates, de-duplication, read state, listings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions.scalars import PAIR
from covermill.functions.topk import first_rows_per_key
from covermill.session import shared_dir

KEY = ["user_id", "warranty_id", "type", "audience"]
_EPOCH = "TIMESTAMP_NTZ'1970-01-05 00:00:00'"


def new_against_existing(candidates: DataFrame, existing: DataFrame, as_of, days: int = C.DEDUPE_DAYS) -> DataFrame:
    """Candidates without an unread stored notification of the same key in the last days.

    Keys match null-safely. The stored side is reduced to distinct recent keys first.
    """
    recent = existing.where(~F.col("is_read") & (F.col("created_at") >= S.ts_lit(as_of) - F.expr(f"INTERVAL {days} DAYS")))
    open_keys = recent.select(*KEY).distinct()
    return candidates.alias("c").join(open_keys.alias("e"), S.same_key("c", "e", KEY), "left_anti")


def _week(ts: Column, days: int) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.expr(_EPOCH), ts) / (days * 86400)).cast("int")


#: Events of a key that are looked through for a successor at once: those of one slot of time.
_SLOT_SECONDS = 3600


def _successors(nodes: DataFrame) -> DataFrame:
    """``node`` and ``to``: the first event of its key that an event would not suppress, if there is one.

    ``nodes`` has node, key, at, id, until, early. Events and the ends of suppressions are ordered together
    within a key and slot of time; where a slot holds no event after an end, it is the first event of the
    key's next slot with one. The second step handles a row per key and slot, which the time
    span bounds.
    """

    def slot(ts: Column) -> Column:
        return F.floor(F.timestamp_diff("SECOND", F.expr(_EPOCH), ts) / _SLOT_SECONDS)

    # an early end lets equal times with larger ids through, the others none of that time
    event = nodes.select("key", slot(F.col("at")).alias("slot"), F.col("at").alias("t"), F.lit(0).alias("after"), F.col("id").alias("i"), F.lit(False).alias("asks"), "node")
    late = F.when(F.col("early"), 0).otherwise(1)
    end = nodes.select("key", slot(F.col("until")).alias("slot"), F.col("until").alias("t"), late.alias("after"), F.when(F.col("early"), F.col("id")).alias("i"), F.lit(True).alias("asks"), "node")
    rows = event.unionByName(end)
    backwards = Window.partitionBy("key", "slot").orderBy(F.desc("t"), F.desc("after"), F.desc("i"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("to", F.last(F.when(~F.col("asks"), F.col("node")), ignorenulls=True).over(backwards)).where("asks")
    firsts = rows.groupBy("key", "slot").agg(F.min(F.when(~F.col("asks"), F.struct("t", "i", "node"))).alias("first"))
    later = Window.partitionBy("key").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    next_slot = firsts.select("key", "slot", F.last("first", ignorenulls=True).over(later)["node"].alias("far"))
    return near.join(next_slot, ["key", "slot"]).select("node", F.coalesce("to", "far").alias("to")).where(F.col("to").isNotNull())


def _reachable(nodes: DataFrame, folder: str) -> DataFrame:
    """The nodes met by following successors from the first of each key, with steps of doubled length."""
    spark = nodes.sparkSession
    pointers = "node long, to long"
    _successors(nodes).write.parquet(f"{folder}/to-0")
    nodes.groupBy("key").agg(F.min(F.struct("at", "id", "node")).alias("first")).select("first.node").write.parquet(f"{folder}/met/round=0")
    k = 0
    while True:
        met = spark.read.schema("node long, round int").parquet(f"{folder}/met")
        to = spark.read.schema(pointers).parquet(f"{folder}/to-{k}")
        met.select("node").join(to, "node").select(F.col("to").alias("node")).write.parquet(f"{folder}/met/round={k + 1}")
        if spark.read.schema("node long").parquet(f"{folder}/met/round={k + 1}").isEmpty():
            return met.select("node")
        twice = to.alias("a").join(to.alias("b"), F.col("a.to") == F.col("b.node")).select("a.node", "b.to")
        twice.write.parquet(f"{folder}/to-{k + 1}")
        k += 1


def dedupe_chain(events: DataFrame, keys: list[str], days: int = C.DEDUPE_DAYS, receipts: DataFrame | None = None) -> DataFrame:
    """Marks the events that are kept when a kept unread one suppresses its key for some days.

    Only kept unread events ("anchors") suppress. ``receipts`` (the keys, ``notification_id``, ``read_at``)
    end an anchor's suppression early: the first one at or after the anchor does. The order of rows
    that arrive doesn't matter, only their times; ties in time go by id, and a row without a time is kept.

    Each unread event points to the first one of its key that it would not suppress. The anchors are
    what those pointers reach from a key's first event. Pointers are doubled round by round, so the
    number of rounds is the logarithm of the longest chain of anchors, whatever the time span. All
    steps are joins by a number or windows of one key and hour, so a hot key is spread over time. Finally
    every event is compared with the anchors of its own and the previous period of ``days``.
    """
    spark = events.sparkSession
    gap = F.expr(f"INTERVAL {days} DAYS")
    dated = events.withColumn("week", _week(F.col("created_at"), days))
    unread = dated.where(~F.col("is_read") & F.col("created_at").isNotNull()).select(*keys, "week", "created_at", "id")
    if receipts is None:
        unread = unread.withColumn("read_at", F.lit(None).cast("timestamp_ntz"))
    else:
        read = receipts.select(*keys, F.col("notification_id").alias("id"), "read_at")
        same = S.same_key("u", "r", keys) & (F.col("u.id") == F.col("r.id")) & (F.col("r.read_at") >= F.col("u.created_at"))
        group = [F.col(f"u.{c}").alias(c) for c in unread.columns]
        unread = unread.alias("u").join(read.alias("r"), same, "left").groupBy(*group).agg(F.min("r.read_at").alias("read_at"))
    early = F.coalesce(F.col("read_at") <= F.col("created_at") + gap, F.lit(False))
    until = F.when(early, F.col("read_at")).otherwise(F.col("created_at") + gap)
    nodes = unread.select(F.monotonically_increasing_id().alias("node"), F.struct(*keys).alias("key"), "week", F.col("created_at").alias("at"), "id", until.alias("until"), early.alias("early"))
    folder = f"{shared_dir(spark).rstrip('/')}/unread-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{folder}/nodes")
    stored = spark.read.schema(nodes.schema).parquet(f"{folder}/nodes")
    anchors = stored.join(_reachable(stored, folder), "node").select("key.*", "week", "at", F.col("id").alias("anchor_id"), "until", "early")
    both = anchors.unionByName(anchors.withColumn("week", F.col("week") + 1))
    # the anchors of a key in two periods: two at most, and one more for each that was read
    bounds = both.groupBy(*keys, "week").agg(F.collect_list(F.struct("at", "anchor_id", "until", "early")).alias("marks"))

    def suppresses(m: Column) -> Column:
        at, nid = F.col("e.created_at"), F.col("e.id")
        after = (m["at"] < at) | ((m["at"] == at) & (m["anchor_id"] < nid))
        return after & ((at < m["until"]) | ((at == m["until"]) & (~m["early"] | (nid <= m["anchor_id"]))))

    return (
        dated.alias("e")
        .join(bounds.alias("b"), S.same_key("e", "b", [*keys, "week"]), "left")
        .select("e.*", (~F.coalesce(F.exists("b.marks", suppresses), F.lit(False))).alias("kept"))
        .drop("week")
    )


def with_read_state(notifications: DataFrame, marks: DataFrame) -> DataFrame:
    """Read state after applying receipts; only the owner's receipt counts."""
    seen = marks.where("marked").select(F.col("notification_id").alias("id"), "user_id").distinct().withColumn("seen", F.lit(True))
    return (
        notifications.join(seen, ["id", "user_id"], "left")
        .withColumn("is_read", F.col("is_read") | F.coalesce("seen", F.lit(False)))
        .drop("seen")
    )


def latest_notifications(notifications: DataFrame, audience: str, limit: int | None = 50, only_unread: bool = False) -> DataFrame:
    """Newest notifications of each user of an audience, ``limit`` per user or all of them."""
    df = notifications.where(F.col("audience") == audience)
    if only_unread:
        df = df.where(~F.col("is_read"))
    if limit is None:
        return df
    return first_rows_per_key(df, ["user_id"], [F.desc("created_at"), F.desc("id")], limit, rank="place")


def onboarding_candidates(warranties: DataFrame, scores: DataFrame, ev: DataFrame, as_of) -> DataFrame:
    """What the first check of each owned warranty would notify about, one row per notification."""
    left = S.days_left(F.col("expiry_date"), as_of)
    label = F.coalesce("risk_label", F.lit("LOW"))

    def note(kind, title, message, severity):
        return F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), message.alias("message"), severity.alias("severity"))

    device = F.coalesce(S.truthy(F.col("product_name")), F.lit("device"))
    items = F.array_compact(
        F.array(
            note(
                "warranty_onboarded",
                "Warranty onboarded",
                F.concat(F.lit("We’ve registered your "), device, F.lit(" and started health checks.")),
                F.lit("info"),
            ),
            F.when(
                label == "MEDIUM",
                note("risk_medium", "Medium risk detected", F.lit("Our checks suggest this device may need some care soon."), F.lit("warning")),
            ),
            F.when(
                label == "HIGH",
                note(
                    "risk_high",
                    "High risk detected",
                    F.lit("This device shows a high risk of issues. Consider backup or service."),
                    F.lit("critical"),
                ),
            ),
            F.when(
                (F.col("category") == "ev") & F.col("ev_label").isin("MEDIUM", "HIGH"),
                note(
                    "ev_battery_risk",
                    "EV battery health alert",
                    F.lit("We’ve detected potential stress on your EV battery. See EV tips in your dashboard."),
                    F.when(F.col("ev_label") == "MEDIUM", "warning").otherwise("critical"),
                ),
            ),
            F.when(
                left.between(0, 30),
                note(
                    "expiry_soon",
                    "Warranty expiring soon",
                    F.concat(
                        F.lit("Your warranty expires in "),
                        left.cast("string"),
                        F.lit(" days. Consider backing up receipts or buying extended cover."),
                    ),
                    F.lit("warning"),
                ),
            ),
        )
    )
    return (
        warranties.withColumn(
            "category", S.product_category(F.lit(None).cast("string"), F.col("product_name"), F.col("model_code"))
        )
        .join(scores.select(*PAIR, "risk_label"), PAIR, "left")
        .join(ev.select(*PAIR, "ev_label"), PAIR, "left")
        .withColumn("n", F.explode(items))
        .select(*PAIR, F.lit("user").alias("audience"), "n.*")
    )


def scoring_candidates(scores: DataFrame, warranties: DataFrame, as_of) -> DataFrame:
    """What a scoring of each pair notifies about: raised risk, and cover that ends within 30 days or has ended."""
    ends = warranties.select("warranty_id", S.days_left(F.col("expiry_date"), as_of).alias("left"))
    left, label = F.col("left"), F.col("risk_label")

    def note(kind, title, message, severity):
        return F.struct(kind.alias("type"), title.alias("title"), message.alias("message"), severity.alias("severity"))

    # The texts of the two notifications.
    risk = note(
        F.concat(F.lit("risk_"), F.lower(label)),
        F.concat(F.lit("Risk "), F.initcap(label), F.lit(" detected")),
        F.concat(F.lit("Predictive model flagged "), F.lower(label), F.lit(" risk for warranty "), "warranty_id", F.lit(".")),
        F.when(label == "MEDIUM", "warning").otherwise("critical"),
    )
    expiry = note(
        F.lit("expiry_soon"),
        F.lit("Warranty expiring soon"),
        F.concat(F.lit("Warranty "), "warranty_id", F.lit(" ends in "), F.greatest(left, F.lit(0)).cast("string"), F.lit(" days.")),
        F.when(left > 0, "warning").otherwise("critical"),
    )
    items = S.compact_texts(F.when(label.isin("MEDIUM", "HIGH"), risk), F.when(left < 30, expiry))
    return (
        scores.select(*PAIR, "risk_label")
        .join(ends, "warranty_id", "left")
        .withColumn("n", F.explode(items))
        .select(*PAIR, F.lit("user").alias("audience"), "n.*")
    )
