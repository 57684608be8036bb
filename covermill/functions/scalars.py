"""Column expressions shared by the jobs.

Scores are integer hundredths (``*_h`` columns) until the last projection: every increment is a
multiple of 0.01, so the arithmetic is exact and does not depend on the engine.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from covermill import constants as C

PAIR = ["user_id", "warranty_id"]


def ts_lit(value: datetime | str) -> Column:
    """A timestamp literal without zone, so that comparisons reach the scan."""
    return F.lit(str(value)).cast("timestamp_ntz")


def date_lit(value: datetime | str) -> Column:
    return F.lit(str(value)[:10]).cast("date")


def truthy(col: Column) -> Column:
    """Null for an empty string: both count as missing."""
    return F.nullif(col, F.lit(""))


def clamp(col: Column, lo: int, hi: int) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col))


def text_array(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def compact_texts(*items: Column) -> Column:
    """The non-null items, in order."""
    return F.array_compact(F.array(*items))


def same_key(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two aliased frames."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def flag_count(cond: Column) -> Column:
    """Rows meeting a condition; never null, unlike a sum over no rows."""
    return F.count(F.when(cond, F.lit(1)))


def label_of(score_h: Column) -> Column:
    """Final risk label of a score in hundredths."""
    return F.when(score_h > 66, "HIGH").when(score_h >= 33, "MEDIUM").otherwise("LOW")


def risk_rank(label: Column) -> Column:
    up = F.upper(label)
    return F.when(up == "HIGH", 2).when(up == "MEDIUM", 1).otherwise(0)


def band_of(label: Column, score_h: Column) -> Column:
    """Band from a known label, else from the score; MEDIUM without either."""
    return (
        F.when(F.upper(label).isin(*C.RISK_LABELS), F.upper(label))
        .when(score_h.isNull(), "MEDIUM")
        .when(score_h < 33, "LOW")
        .when(score_h < 66, "MEDIUM")
        .otherwise("HIGH")
    )


def severity_of(band: Column) -> Column:
    return F.when(band == "high", "critical").when(band == "medium", "warning").otherwise("info")


def infer_product_type(explicit: Column, name: Column, model: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(truthy(explicit).isNotNull(), explicit)
        .when(low.contains("fridge"), "fridge")
        .when(low.contains("ac") | low.contains("air"), "ac")
        .when(low.contains("wash"), "washer")
        .otherwise(truthy(model))
    )


def product_type_code(label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(low.isNull(), 0.0)
        .when(low.contains("fridge") | (low == "refrigerator"), 1.0)
        .when(low.contains("ac") | low.contains("air"), 2.0)
        .when(low.rlike("^[0-9]+$"), low.try_cast("double"))
        .otherwise(0.0)
    )


def vocabulary_code(value: Column, vocab: list[str] | None = None, default: int = 0) -> Column:
    """Integer code of a string: its number if all digits, its place in a vocabulary, else a default."""
    code = F.when(value.rlike("^[0-9]+$"), value.try_cast("int"))
    if vocab:
        place = F.array_position(text_array(vocab), value)
        code = code.when(place > 0, (place - 1).cast("int"))
    return F.coalesce(code, F.lit(default))


def product_category(product_type: Column, name: Column, model: Column) -> Column:
    pt, nm, md = (F.coalesce(F.lower(c), F.lit("")) for c in (product_type, name, model))
    return (
        F.when(
            nm.contains("phone") | pt.contains("phone") | nm.contains("galaxy") | nm.contains("iphone") | md.contains("sm-"),
            "smartphone",
        )
        .when(nm.contains("laptop") | nm.contains("notebook") | pt.contains("laptop"), "laptop")
        .when(nm.contains("ev") | pt.contains("ev") | nm.contains("battery"), "ev")
        .when(nm.rlike("fridge|washer|ac|dishwasher|appliance"), "appliance")
        .otherwise("general")
    )


def device_segment(name: Column, model: Column) -> Column:
    nm, md = (F.coalesce(F.lower(c), F.lit("")) for c in (name, model))
    return F.when(nm.rlike("phone|galaxy|iphone") | md.contains("sm-"), "smartphone").otherwise("generic_device")


def expiry_date(purchase: Column, months: Column) -> Column:
    """Purchase date plus coverage, day clipped to the month's end; null if either is missing or 0."""
    return F.when(months != 0, F.add_months(purchase, months))


def age_months(purchase: Column, as_of) -> Column:
    return F.greatest(F.lit(0.0), F.datediff(date_lit(as_of), purchase) / F.lit(30.0))


def days_left(expiry: Column, as_of) -> Column:
    return F.datediff(expiry, date_lit(as_of))


def one_hot(value: Column, vocab: list[str], prefix: str) -> list[Column]:
    return [F.coalesce((value == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in vocab]


def trim_detail(detail: Column) -> Column:
    """Audit detail, cut with a marker when over the limit."""
    return F.when(
        F.length(detail) > C.AUDIT_MAX_LEN,
        F.concat(F.substring(detail, 1, C.AUDIT_MAX_LEN), F.lit("...(truncated)")),
    ).otherwise(detail)


def redacted_detail(content: Column) -> Column:
    return trim_detail(
        F.concat(
            F.lit("len="),
            F.length(content).cast("string"),
            F.lit(" preview="),
            F.substring(content, 1, C.AUDIT_PREVIEW_LEN),
        )
    )
