import math
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, StringType, StructField, StructType

from marginflow import catalog
from marginflow.functions import (
    coerce_or_zero,
    coerce_value,
    decimal_round,
    format_eur,
    level_code,
    level_number,
    normalize_measure,
    period_title,
    profit_status,
    quoted,
    row_slot,
    simple_norm,
)


def values(spark, column, rows, kind=StringType()):
    schema = StructType([StructField("i", StringType()), StructField("x", kind)])
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(rows)], schema)
    found = {r.i: r.y for r in df.select("i", column.alias("y")).collect()}
    return [found[str(i)] for i in range(len(rows))]


def test_normalize_measure(spark):
    cases = {
        "Umsatz_EUR": "umsatz eur",
        "Transfer-Price/EUR": "transfer price eur",
        " UmsatzEUR\t": "umsatzeur",
        "Umsatz €": "umsatz eur",
        "Umsatz\r\n EUR": "umsatz eur",
        "a..b__c--d//e": "a b c d e",
        "\x1cUmsatz\x1fEUR ": "umsatz eur",
        "-Commission-": "commission",
        "€": "eur",
        "": "",
        None: "",
    }
    assert values(spark, normalize_measure(F.col("x")), list(cases)) == list(cases.values())


def test_simple_norm_keeps_separators(spark):
    cases = {" Umsatz_EUR ": "umsatz_eur", "\tCommission ": "commission", None: None}
    assert values(spark, simple_norm(F.col("x")), list(cases)) == list(cases.values())


def test_coerce_value(spark):
    rows = ["n/a", "", " 12.5 ", "1e3", None, "-0.00004", "1.23456", "abc1"]
    want = [None, None, Decimal("12.5"), Decimal(1000), None, Decimal(0), Decimal("1.2346"), None]
    assert values(spark, coerce_value(F.col("x")), rows) == want
    zero = [Decimal(0) if w is None else w for w in want]
    assert values(spark, coerce_or_zero(F.col("x")), rows) == zero


def test_format_eur(spark):
    rows = [1234567.891, -0.001, 0.0, None, float("nan"), 999.995, 0.005, -1234.5]
    want = ["1.234.567,89 €", "-0,00 €", "0,00 €", "-", "-"]
    want += [
        f"{x:,.2f} €".replace(",", "_").replace(".", ",").replace("_", ".") for x in rows[5:]
    ]
    assert values(spark, format_eur(F.col("x")), rows, DoubleType()) == want
    dashed = values(spark, format_eur(F.col("x"), zero_as_dash=True), rows, DoubleType())
    assert dashed[2] == "-" and dashed[0] == want[0] and dashed[1] == want[1]


def test_format_eur_of_large_decimals_is_exact(spark):
    amount = Decimal("123456789012345678901.2345")
    got = values(spark, format_eur(F.col("x")), [amount], DecimalType(28, 4))
    assert got == ["123.456.789.012.345.678.901,23 €"]


def test_decimal_round_goes_away_from_zero(spark):
    rows = [Decimal("1.005"), Decimal("-1.005"), Decimal("1.0049")]
    got = values(spark, decimal_round(F.col("x")), rows, DecimalType(18, 4))
    assert got == [Decimal("1.01"), Decimal("-1.01"), Decimal("1.00")]


def test_level_codes(spark):
    cases = {" DB1 ": "E1", "DB2": "E2", "DB3\t": "E3", " DB9": "DB9", None: None, "E1": "E1"}
    assert values(spark, level_code(F.col("x")), list(cases)) == list(cases.values())


def test_level_number(spark):
    assert values(spark, level_number(F.col("x")), ["E1", "E3 | x", "F1"]) == [1, 3, 9]


def test_row_slots(spark):
    cases = {
        "E1 | UmsatzEUR": 1,
        "E1 | TransferPriceEUR": 2,
        "E3 | Commission in EUR": 1,
        "E2 | DiscountAufMaterialEUR": 2,
        "E2 | DiscountAufMaterialKategorieEUR": 3,
        "E3 | Additional Procurement Costs": 1,
        "E3 | Marketing Campaign": 2,
        "E3 | Monthly Rent": 3,
        "E3 | Monthly Salary": 4,
        "E3 | Monthly Social Costs": 5,
        "E1 | Umsatz EUR": catalog.OTHER_SLOT,
    }
    slot = row_slot(F.col("x"), F.lit(False))
    assert values(spark, slot, list(cases)) == list(cases.values())
    assert values(spark, row_slot(F.col("x"), F.lit(True)), ["E1 | E1 Total"]) == [99]


def test_profit_status(spark):
    rows = [0.01, 0.0, -1.0, None]
    got = values(spark, profit_status(F.col("x")), rows, DoubleType())
    assert got == [catalog.PROFITABLE] + [catalog.NOT_PROFITABLE] * 3


def test_period_title(spark):
    month = F.to_date(F.col("x"))
    year, quarter = F.lit(2025), F.lit("Q2")
    none = F.lit(None).cast("string")
    assert values(spark, period_title(year, quarter, month), ["2025-04-01"]) == ["2025-04-01"]
    assert values(spark, period_title(year, quarter, month), [None]) == ["Q2 2025"]
    assert values(spark, period_title(year, none, month), [None]) == ["Gesamtjahr 2025"]


def test_quoted_text(spark):
    for text in ("plain", "it's", "back\\slash", "\\'"):
        assert spark.sql(f"SELECT {quoted(text)} AS t").first().t == text


def test_nan_is_no_amount(spark):
    got = values(spark, coerce_value(F.col("x")), [math.nan, 1.5], DoubleType())
    assert got == [None, Decimal("1.5")]
