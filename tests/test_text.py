"""Text extraction and scalar rules on edge values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from covermill import constants as C
from covermill.functions import html_blocks, scalars as S, text as X
from covermill.operators import warranty as W
from covermill.operators import workflow as K
from covermill.sources.domain import DomainTables


def extract(spark, content):
    return W.extract_fields(spark.createDataFrame([(1, "invoice", content)], "ref BIGINT, type STRING, content STRING")).first()


def test_sample_invoice(spark):
    r = extract(spark, "Brand: AcmeCo Model: WM-900 Serial: SN123456 Purchase: 11-10-2025 24 months warranty")
    assert (r["brand"], r["model_code"], r["serial_no"]) == ("Acmeco Model", "WM-900", "SN123456")
    assert (r["purchase_date"], r["coverage_months"]) == (date(2025, 10, 11), 24)
    assert r["confidence"] == {"brand": 0.7, "model_code": 0.65, "serial_no": 0.6, "purchase_date": 0.6, "coverage_months": 0.6}


def test_no_signals(spark):
    r = extract(spark, "nothing to see, 12 months")
    assert r["confidence"] == {} and r["notes"] == W.NO_SIGNAL_NOTE and r["coverage_months"] is None


def test_quirks_kept(spark):
    assert extract(spark, "serial number 12")["serial_no"] == "NUMBER"
    assert extract(spark, "brand: x-ray 3m lg-ac\n")["brand"] == "X-Ray 3M Lg-Ac"


@pytest.mark.parametrize(
    "text, day",
    [
        ("1/2/2023", date(2023, 2, 1)), ("31/02/2023 then 2023-05-06", date(2023, 5, 6)), ("11-10-68", date(2068, 10, 11)),
        ("11-10-69", date(1969, 10, 11)), ("29-2-2024", date(2024, 2, 29)), ("29/02/23", None), ("1/2-2023", None), ("11-10-202", None), ("", None),
    ],
)
def test_dates(spark, text, day):
    assert spark.createDataFrame([(text,)], "t STRING").select(X.first_date(F.col("t"))).first()[0] == day


def test_expiry_clips_to_month_end(spark):
    rows = [(date(2025, 1, 31), 1), (date(2025, 2, 28), 1), (date(2024, 2, 29), 12), (date(2024, 1, 1), 0), (None, 3), (date(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "p DATE, m INT").select(S.expiry_date(F.col("p"), F.col("m")).alias("e"))
    assert [r["e"] for r in df.collect()] == [date(2025, 2, 28), date(2025, 3, 28), date(2025, 2, 28), None, None, None]


def test_overrides_win(spark):
    arts = spark.createDataFrame([(1, "i", "Brand: Acme\n6 months warranty 2024-01-31"), (2, "i", "Brand: Acme\n")], "ref BIGINT, type STRING, content STRING")
    over = spark.createDataFrame([(1, "i", "Washer", 1)], "ref BIGINT, type STRING, product_name STRING, coverage_months INT")
    got = {r["ref"]: r for r in W.canonical_warranty(arts, over).collect()}
    assert got[1]["product_name"] == "Washer" and got[1]["expiry_date"] == date(2024, 2, 29)
    assert got[1]["confidence"]["coverage_months"] == 0.9 and got[1]["confidence"]["brand"] == 0.7
    assert got[2]["product_name"] is None and got[2]["expiry_date"] is None


def test_product_types(spark):
    rows = [("x", "Fridge", None), ("", "My Machine", "m"), (None, "Airfryer wash", None), (None, "Washer", "m"), (None, "TV", "m"), (None, None, "")]
    df = spark.createDataFrame(rows, "e STRING, n STRING, m STRING").select(S.infer_product_type(F.col("e"), F.col("n"), F.col("m")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["x", "ac", "ac", "washer", "m", None]
    codes = spark.createDataFrame([("My FRIDGE",), ("refrigerator",), ("machine",), ("7",), ("tv",), (None,)], "n STRING").select(S.product_type_code(F.col("n")).alias("c"))
    assert [r["c"] for r in codes.collect()] == [1.0, 1.0, 2.0, 7.0, 0.0, 0.0]


def test_bands_differ_at_the_edge(spark):
    df = spark.createDataFrame([(32,), (33,), (65,), (66,), (67,), (None,)], "h INT")
    got = df.select(S.label_of(F.col("h")).alias("l"), S.band_of(F.lit(None).cast("string"), F.col("h")).alias("b")).collect()
    assert [r["b"] for r in got] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "MEDIUM"]
    assert [r["l"] for r in got][:5] == ["LOW", "MEDIUM", "MEDIUM", "MEDIUM", "HIGH"]


def test_words_split_at_all_white_space(spark):
    text = "A b C d\x1fE\n　 f​g"
    got = spark.createDataFrame([(text,)], "t STRING").select(X.words(F.col("t"))).first()[0]
    assert got == text.lower().split()


def test_page_text(spark):
    page = "Brand: Cool Co | Model: X 1 |  compressor:10 years motor: 5 years Exclusion: rust, wear. exclusion - dents"
    rows = [("samsung", page), ("LG", page), (None, page), ("lg", "2 year cover")]
    got = W.oem_page_fields(spark.createDataFrame(rows, "brand_hint STRING, html STRING")).collect()
    assert got[0]["brand"] == "Cool Co" and got[0]["model_code"] == "X 1"
    assert got[0]["coverage_months"] == 0, "the years pattern takes one digit, here the 0 of 10"
    assert got[0]["exclusions"] == ["rust, wear", "dents"] and got[0]["extended_parts"] == {}
    assert got[1]["extended_parts"] == {"compressor": "10 years"}
    assert got[2]["extended_parts"] == {"compressor": "10 years"}
    assert got[3]["coverage_months"] == 24 and got[3]["exclusions"] == []


def test_blocks_nest(spark):
    page = (
        '<div class="x"><div class="big warranty">A <div>b<br>c</div> <script>no</script>d</div>after</div>'
        '<p id="terms">T&amp;C</p><p class="conditions"/>'
    )
    assert html_blocks.block_text(page, [".warranty"]) == "A b c d"
    assert html_blocks.block_text(page, [".none", "#terms"]) == "T&C"
    assert html_blocks.block_text(page, [".warrant"]) is None
    # an attribute may be written with character references; all selectors are read in one pass
    assert html_blocks.block_texts('<p class="war&#114;anty">x</p><p id="t">y</p>', [[".warranty"], ["#t"], []]) == ["x", "y", None]
    df = spark.createDataFrame([("Bosch", page), ("acme", page), (None, page), ("bosch", None)], "brand_hint STRING, html STRING")
    got = [(r["coverage_block"], r["terms_block"]) for r in W.oem_page_blocks(df).collect()]
    assert got == [("A b c d", None), (None, None), (None, None), (None, None)]


def test_pages_without_a_wanted_name_are_not_parsed(spark, monkeypatch):
    fed = []
    feed = html_blocks._Blocks.feed
    monkeypatch.setattr(html_blocks._Blocks, "feed", lambda self, page: (fed.append(page), feed(self, page)))
    assert html_blocks.block_texts('<p class="a" title="x&amp;y">a&amp;b</p><p id=b>c</p>', [[".warranty"], ["#t2"], []]) == [None, None, None] and not fed
    for page in ('<p class="war&#114;anty">x</p>', "<p CLASS = 'war&#114;anty'>x</p>", "<p title='>' class=war&#114;anty>x</p>", '<p title="&lt;" class="a\nwarranty">x</p>'):
        assert html_blocks.block_texts(page, [[".none", ".warranty"], ["#warranty"]]) == ["x", None], page
    assert html_blocks.block_texts("<p>warranty <b id=terms>x</b></p>", [[".warranty", "#terms"]]) == ["x"] and len(fed) == 5


def test_parts_are_dealt_out_before_their_pages_are_made(spark):
    pages = DomainTables(spark, SMALL).oem_page()
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and pages.count() == spark.read.parquet(f"{SMALL}/part.parquet").count() + spark.read.parquet(f"{SMALL}/pages.parquet").count()


def test_portal_artifact_text(spark):
    df = spark.createDataFrame([("bosch", "M1", "EU", '<p class="warranty">Two\n years</p>')], "brand_hint STRING, model STRING, region STRING, html STRING")
    text = W.portal_artifacts(df).first()["content"]
    assert text.startswith("Brand: bosch\nModel: M1\nRegion: EU\nParsed: ") and '"coverage_block":"Two\\n years"' in text
    assert text.endswith('<p class="warranty">Two years</p>')


def test_audit_lengths(spark):
    df = spark.createDataFrame([("a" * 2000,), ("b" * 2001,)], "content STRING")
    full, cut = K.audit_rows(df).collect()
    assert full["detail"] == "a" * 2000 and cut["detail"] == "b" * 2000 + "...(truncated)"
    assert cut["redacted"] == "len=2001 preview=" + "b" * 128


def test_vocabulary_code(spark):
    rows = [("hot",), ("coastal",), ("12",), ("mars",), (None,)]
    got = spark.createDataFrame(rows, "v STRING").select(S.vocabulary_code(F.col("v"), C.CLIMATES)).collect()
    assert [r[0] for r in got] == [0, 4, 12, 0, 0]
