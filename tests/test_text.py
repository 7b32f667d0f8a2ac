import pytest
from pyspark.sql import functions as F

from arqueo.functions import identity
from arqueo.functions.text import amount, composed, data, identifier, order_number, trimmed


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_identifier(spark):
    got = apply(spark, identifier, ["p000 1", " P​0001\t", "Ｐ０００１", None, "", "\xa0", "b-1\xad2"])
    assert got == ["P0001", "P0001", "P0001", None, "", "", "B-12"]


def test_no_data_words(spark):
    words = [None, "", " ", "-", "--", "?", "N/D", "n/a", "null", "S/D", "sin_dato", "SIN_PLANTILLA", "​", "P1"]
    assert apply(spark, data, words) == [None] * 13 + ["P1"]


def test_order_number(spark):
    got = apply(spark, order_number, ["PO-2026-014180", "po 2026 014180", "PO - 2026–014180", "PO−2026−014180", "ＰＯ-２０２６-０１４１８０", "PO-20 26-01⁠4180", "PO-12-34", "PEDIDO 1", "", None])
    assert got == ["PO-2026-014180"] * 6 + [None] * 4


@pytest.mark.parametrize(
    ("text", "value"),
    [("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("121,00", "121"), ("21", "21"), ("0,00", "0"), ("1\xa0234,56", "1234.56"), ("EUR 12.5", "12.5"), ("12,50€", "12.5"), (" 7 eur ", "7"), ("-3,10", "-3.1"), ("1.234.567", "1234567"), ("12.345,6", "12345.6"),
     ("1,234", None), ("1.234", None), ("1,2,3", None), ("NaN", None), ("1,23.45", None), ("", None), (None, None), ("12O,50", None), ("pdte.", None), ("1 2 EUR EUR", None), ("9" * 60, None)],
)
def test_amount(spark, text, value):
    got = apply(spark, amount, [text])[0]
    assert (None if got is None else float(got)) == (None if value is None else float(value))


def test_very_long_text(spark):
    assert apply(spark, lambda c: F.length(identifier(c)), ["a b" * 500_000]) == [1_000_000]


def test_composed_and_folded(spark):
    assert apply(spark, composed, ["papelería", "a", None]) == ["papelería", "a", None]
    assert apply(spark, identity.fold, ["  Señalética  STRASSE ß’", None]) == ["senaletica strasse ss'", None]
    assert apply(spark, identity.header_key, ["Razón Social (€)"]) == ["razonsocial"]
    assert apply(spark, trimmed, ["​ a b \xa0"]) == ["a b"]


def test_accounts(spark):
    assert apply(spark, identity.iban, ["ES44 1465 0100 9517 0430 2211 sobra", "XX00123456789", "ES44", None]) == ["ES4414650100951704302211", None, None, None]
    assert apply(spark, identity.iban_valid, ["GB82WEST12345698765432", "ES4414650100951704302211"]) == [True, False]
    assert apply(spark, identity.masked, ["ES4414650100951704302211", "short", None]) == ["ES44…2211", "short", None]
    assert apply(spark, identity.currency, ["€", "eur", "R$", "$", None]) == ["EUR", "EUR", "BRL", None, None]
    assert apply(spark, identity.company_number_valid, ["A58818501", "A58818502", "x", None]) == [True, False, None, None]
