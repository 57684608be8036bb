"""Artifacts to canonical warranties, their summaries and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill import constants as C
from covermill.functions import scalars as S
from covermill.functions import text as X

# Confidence per extracted field, and the floor for a user's correction.
CONFIDENCE = {"brand": 0.7, "coverage_months": 0.6, "model_code": 0.65, "purchase_date": 0.6, "serial_no": 0.6}
OVERRIDE_CONFIDENCE = 0.9
CORRECTABLE = ["product_name", "brand", "model_code", "serial_no", "purchase_date", "coverage_months"]
NO_SIGNAL_NOTE = "No strong signals found; manual confirmation required."


def with_artifact_id(artifacts: DataFrame) -> DataFrame:
    """Adds an id that depends on the artifact alone, wide enough not to collide at scale."""
    parts = [F.col(c).cast("string") for c in ("type", "ref", "source", "content") if c in artifacts.columns]
    key = F.concat_ws(",", *parts)
    return artifacts.withColumn("artifact_id", F.concat(F.lit("art_"), F.substring(F.sha2(key, 256), 1, 32)))


def extract_fields(artifacts: DataFrame) -> DataFrame:
    """Warranty fields read from each artifact's whole text, with a confidence per field found."""
    df = X.extract_artifact(artifacts)
    entries = [
        F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("key"), F.lit(v).alias("value"))) for n, v in CONFIDENCE.items()
    ]
    return df.withColumn("confidence", F.map_from_entries(F.array_compact(F.array(*entries)))).withColumn(
        "notes", F.when(F.size("confidence") == 0, NO_SIGNAL_NOTE)
    )


def canonical_warranty(artifacts: DataFrame, overrides: DataFrame) -> DataFrame:
    """One warranty per artifact: corrections of any field win over extracted values and raise their confidence.

    Corrections come as text or values; a column that ``overrides`` lacks corrects nothing. A date that isn't an ISO date and months that aren't a number leave the
    field empty, since the user has refuted what was extracted.
    """
    has = lambda n: F.col(n) if n in overrides.columns else F.lit(None)
    o = overrides.select("ref", "type", *[has(n).cast("string").alias(f"o_{n}") for n in CORRECTABLE])
    given = {n: F.col(f"o_{n}") for n in CORRECTABLE}
    sure = [F.when(v.isNotNull(), F.struct(F.lit(n).alias("key"), F.lit(OVERRIDE_CONFIDENCE).alias("value"))) for n, v in given.items()]
    corrected = F.map_from_entries(F.array_compact(F.array(*sure)))
    iso_date = F.when(given["purchase_date"].rlike(r"^\d{4}-\d{2}-\d{2}$"), given["purchase_date"].try_cast("date"))
    months = F.trim(given["coverage_months"]).try_cast("int")
    return (
        extract_fields(with_artifact_id(artifacts))
        .join(o, ["ref", "type"], "left")
        .select(
            "ref",
            "type",
            F.concat(F.lit("wty_"), "type", F.lit("_"), F.col("ref").cast("string")).alias("id"),
            given["product_name"].alias("product_name"),
            *[F.coalesce(given[n], F.col(n)).alias(n) for n in ("brand", "model_code", "serial_no")],
            F.when(given["purchase_date"].isNotNull(), iso_date).otherwise(F.col("purchase_date")).alias("purchase_date"),
            F.when(given["coverage_months"].isNotNull(), months).otherwise(F.col("coverage_months")).alias("coverage_months"),
            F.map_zip_with("confidence", corrected, lambda _, a, b: F.greatest(a, b)).alias("confidence"),
            "notes",
            F.array("artifact_id").alias("source_artifact_ids"),
        )
        .withColumn("expiry_date", S.expiry_date(F.col("purchase_date"), F.col("coverage_months")))
        .withColumn("terms", S.text_array(C.WARRANTY_TERMS))
        .withColumn("exclusions", S.text_array(C.WARRANTY_EXCLUSIONS))
        .withColumn("claim_steps", S.text_array(C.WARRANTY_CLAIM_STEPS))
    )


def latest_by_id(warranties: DataFrame, key: str = "id", order: str = "created_at") -> DataFrame:
    """Last write wins per id."""
    rest = [c for c in warranties.columns if c != key]
    newest = warranties.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return newest.select(key, "row.*")


def warranty_summary(warranties: DataFrame) -> DataFrame:
    na = F.lit("N/A")
    line = lambda name, items: F.concat(F.lit(name + ": "), F.array_join(items, "; "))
    return warranties.withColumn(
        "summary",
        F.concat_ws(
            "\n",
            F.concat(
                F.lit("Brand: "),
                F.coalesce(S.truthy(F.col("brand")), na),
                F.lit(" Model: "),
                F.coalesce(S.truthy(F.col("model_code")), na),
            ),
            F.concat(
                F.lit("Expiry: "),
                F.coalesce(F.col("expiry_date").cast("string"), na),
                F.lit(" Coverage months: "),
                F.coalesce(F.nullif("coverage_months", F.lit(0)).cast("string"), na),
            ),
            line("Terms", F.col("terms")),
            line("Exclusions", F.col("exclusions")),
            line("Claim steps", F.col("claim_steps")),
        ),
    )


def summary_html(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn(
        "html", F.concat(F.lit("<html><body><pre>"), F.col("summary"), F.lit("</pre></body></html>"))
    )


def export_summaries(summaries: DataFrame, path: str, fmt: str = "html", run: str | None = None) -> None:
    """Writes one text line-block per warranty below ``path``; ``fmt`` is 'txt' or 'html'. A repeated ``run`` replaces its own."""
    if fmt not in ("txt", "html"):
        raise ValueError(f"unsupported format: {fmt}")
    col = "summary" if fmt == "txt" else "html"
    out = summaries if fmt == "txt" else summary_html(summaries)
    lines = out.select(F.col(col).alias("value"))
    if run is None:
        lines.withColumn("format", F.lit(fmt)).write.mode("append").partitionBy("format").text(path)
    else:
        lines.write.mode("overwrite").text(f"{path}/run={run}/format={fmt}")


def expiry_alerts(warranties: DataFrame, as_of) -> DataFrame:
    """The three expiry windows per warranty that has an expiry date."""
    left = S.days_left(F.col("expiry_date"), as_of)
    return (
        warranties.where(F.col("expiry_date").isNotNull())
        .withColumn("days_left", left)
        .withColumn("nudge_window", F.col("days_left") < 60)
        .withColumn("score_window", F.col("days_left") < 30)
        .withColumn("onboarding_window", F.col("days_left").between(0, 30))
        .withColumn("severity", F.when(F.col("days_left") > 0, "warning").otherwise("critical"))
        .withColumn("days_shown", F.greatest(F.col("days_left"), F.lit(0)))
    )


def oem_page_fields(pages: DataFrame) -> DataFrame:
    """Fields read from manufacturer pages' whole text."""
    text = X.squeeze_space(F.col("html"))
    return X.extract_oem_text(pages.withColumn("page_text", text))


def oem_page_blocks(pages: DataFrame) -> DataFrame:
    return pages.withColumn("b", X.page_blocks(F.col("html"), F.col("brand_hint"))).select("*", "b.*").drop("b")


def portal_artifacts(pages: DataFrame) -> DataFrame:
    """Fetched pages as artifact texts: what was asked for, what was read, then the page's text."""
    df = oem_page_blocks(oem_page_fields(pages))
    parsed = F.to_json(F.struct("brand", "model_code", "coverage_months", "exclusions", "extended_parts"))
    blocks = F.to_json(F.struct("coverage_block", "terms_block"))
    return df.withColumn(
        "content",
        F.concat(
            F.lit("Brand: "), F.coalesce("brand_hint", F.lit("")),
            F.lit("\nModel: "), F.coalesce("model", F.lit("")),
            F.lit("\nRegion: "), F.coalesce("region", F.lit("")),
            F.lit("\nParsed: "), parsed,
            F.lit("\nParsedHTML: "), blocks,
            F.lit("\n\n"), F.col("page_text"),
        ),
    )
