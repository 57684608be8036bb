"""Text extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import html_blocks
from covermill.functions.scalars import truthy

# Unicode white space and the four ASCII separators. One property test per character: a class that
# lists the ranges takes four times as long.
WORD_SPLIT = r"(?U)[\s\x1c-\x1f]+"


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SPLIT), "")


def words(text: Column) -> Column:
    """Lower-cased words, split at any Unicode white space."""
    return split_words(F.lower(text))


def title_case(text: Column) -> Column:
    """First letter of each run of letters in upper case; for lower-case ASCII input."""
    runs = F.regexp_extract_all(text, F.lit("([a-z]+|[^a-z]+)"), 1)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))), ""
    )


def parse_day(raw: Column) -> Column:
    """A candidate as a date, or null: day first with '-' or '/', or ISO; two-digit years end in 2068."""
    short = F.coalesce(F.try_to_date(raw, "d-M-yy"), F.try_to_date(raw, "d/M/yy"))
    return F.coalesce(
        F.try_to_date(raw, "d-M-yyyy"),
        F.try_to_date(raw, "d/M/yyyy"),
        F.try_to_date(raw, "yyyy-MM-dd"),
        F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short),
    )


def first_date(text: Column) -> Column:
    candidates = F.regexp_extract_all(text, F.lit(C.ARTIFACT_PATTERNS["date"]), 1)
    return F.try_element_at(F.filter(F.transform(candidates, parse_day), lambda d: d.isNotNull()), F.lit(1))


def _mentions(low: Column, *needles: str) -> Column:
    """Whether a lower-cased text holds one of some words: a byte search that spares most texts a pattern."""
    found = low.contains(needles[0])
    for n in needles[1:]:
        found = found | low.contains(n)
    return found


def extract_artifact(df: DataFrame) -> DataFrame:
    """Adds brand, model, serial, purchase date and coverage read from ``content``; null where absent.

    A pattern runs only on texts that hold a word it needs.
    """
    p = C.ARTIFACT_PATTERNS
    low = F.col("_low")
    raw = lambda name, group, *needles: F.when(
        _mentions(low, *needles), F.regexp_extract(low, p[name], group)
    )
    return (
        df.withColumn("_low", F.lower("content"))
        .withColumns(
            {
                "_brand": raw("brand", 1, "brand"),
                "_model": raw("model", 1, "model"),
                "_serial": raw("serial", 2, "serial", "s/n", "sn"),
                "_months": F.when(low.contains("warranty"), F.regexp_extract(low, p["months"], 1)),
                "purchase_date": F.when(_mentions(low, "-", "/"), first_date(F.col("content"))),
            }
        )
        .withColumns(
            {
                "brand": title_case(F.trim(truthy(F.col("_brand")))),
                "model_code": F.upper(truthy(F.col("_model"))),
                "serial_no": F.upper(truthy(F.col("_serial"))),
                "coverage_months": F.col("_months").try_cast("int"),
            }
        )
        .drop("_low", "_brand", "_model", "_serial", "_months")
    )


def extract_oem_text(df: DataFrame) -> DataFrame:
    """Adds brand, model, coverage, exclusions and extended part warranties read from ``page_text``.

    A pattern runs only on pages that hold a word it needs; a part pattern's groups are read from
    its match, not from the page again.
    """
    text, low = F.col("page_text"), F.col("_low")
    i = lambda pattern: "(?i)" + pattern
    p = C.OEM_TEXT_PATTERNS
    raw = lambda name, needle: F.when(low.contains(needle), F.regexp_extract(text, i(p[name]), 1))
    hint = F.coalesce(F.lower("brand_hint"), F.lit(""))
    known = hint.isin(*sorted({b for b, _ in C.OEM_PART_PATTERNS}))
    hits = {
        f"_hit{n}": F.when((~known | (hint == brand)) & low.contains("year"), F.regexp_extract(text, i(pattern), 0))
        for n, (brand, pattern) in enumerate(C.OEM_PART_PATTERNS)
    }
    found = [
        F.when(
            F.col(f"_hit{n}") != "",
            F.struct(
                F.regexp_extract(f"_hit{n}", i(pattern), 1).alias("part"),
                F.concat(F.regexp_extract(f"_hit{n}", i(pattern), 2), F.lit(" years")).alias("cover"),
            ),
        )
        for n, (_, pattern) in enumerate(C.OEM_PART_PATTERNS)
    ]
    # A part named by two patterns keeps the later one.
    last = F.filter(
        "_parts",
        lambda q, k: ~F.exists(F.slice("_parts", k + 2, F.greatest(F.size("_parts"), F.lit(1))), lambda r: r["part"] == q["part"]),
    )
    return (
        df.withColumn("_low", F.lower("page_text"))
        .withColumns(
            {
                "_brand": raw("brand", "brand"),
                "_model": raw("model", "model"),
                "_months": raw("months", "mo"),
                "_years": raw("years", "year"),
                "exclusions": F.when(low.contains("exclusion"), F.regexp_extract_all(text, F.lit(i(p["exclusion"])), 1)),
                **hits,
            }
        )
        .withColumns(
            {
                "brand": F.trim(truthy(F.col("_brand"))),
                "model_code": F.trim(truthy(F.col("_model"))),
                "coverage_months": F.coalesce(F.col("_months").try_cast("int"), F.col("_years").try_cast("int") * 12),
                "exclusions": F.coalesce("exclusions", F.expr("cast(array() AS array<string>)")),
                "_parts": F.array_compact(F.array(*found)),
            }
        )
        .withColumn("extended_parts", F.map_from_entries(last))
        .drop("_low", "_brand", "_model", "_months", "_years", "_parts", *hits)
    )


def squeeze_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def page_blocks(html: Column, brand_hint: Column) -> Column:
    """Coverage and terms block of a page.

    Elements nest, so a pattern cannot find where a block ends; a tag parser in batches does. Pages
    of other brands reach it as nulls.
    """
    hint = F.lower(brand_hint)
    wanted = F.when(hint.isin(*C.OEM_BLOCK_SELECTORS), html)
    return html_blocks.block_udf(C.OEM_BLOCK_SELECTORS, ["coverage", "terms"])(wanted, hint)
