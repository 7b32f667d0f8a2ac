"""Checks and forms of bank accounts, tax numbers, currencies and names."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from arqueo.functions.text import composed, identifier

# Lengths of account numbers by country.
IBAN_LENGTHS = {"BE": 16, "BR": 29, "CH": 21, "DE": 22, "ES": 24, "FR": 27, "GB": 22, "IT": 27, "JP": 23, "NL": 18, "PT": 25}
# Currency signs and words.
CURRENCIES = {"EUR": "EUR", "€": "EUR", "EURO": "EUR", "EUROS": "EUR", "USD": "USD", "US$": "USD", "GBP": "GBP", "£": "GBP", "CHF": "CHF", "FR": "CHF", "JPY": "JPY", "¥": "JPY", "YEN": "JPY", "MXN": "MXN", "MX$": "MXN", "BRL": "BRL", "R$": "BRL"}


@cache
def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with accents, and the letters without."""
    a, b = "", ""
    for x in range(0xC0, 0x250):
        d = unicodedata.normalize("NFD", chr(x))
        if len(d) > 1 and chr(x) == chr(x).lower():
            a, b = a + chr(x), b + d[0]
    return a, b


def fold(c: Column) -> Column:
    """Lower case without accents; ß is ss, blanks count once, a curly apostrophe is a straight one."""
    x = F.replace(F.translate(F.lower(composed(c)), "’", "'"), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.translate(x, *_accents()), r"[\s\p{Z}]+", " "))


def header_key(c: Column) -> Column:
    """A column header by its letters a to z and digits only."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def iban(c: Column) -> Column:
    """The account number of a run of letters and digits, cut to its country's length; null for unknown countries or short runs."""
    x = identifier(c)
    lengths = F.expr("map(" + ",".join(f"'{k}',{n}" for k, n in IBAN_LENGTHS.items()) + ")")
    n = F.element_at(lengths, F.left(x, F.lit(2)))
    return F.when(x.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (F.length(x) >= n), F.substring(x, F.lit(1), n))


def iban_valid(c: Column) -> Column:
    """ISO 7064 mod 97-10, digit by digit, so no number grows long."""
    x = F.concat(F.substr(c, F.lit(5)), F.left(c, F.lit(4)))
    digits = F.transform(F.filter(F.split(x, ""), lambda ch: ch != ""), lambda ch: F.conv(ch, 36, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: F.when(d < 10, a * 10 + d).otherwise(a * 100 + d) % 97) == 1


def masked(c: Column) -> Column:
    """First and last four characters."""
    return F.when(F.length(c) > 8, F.concat(F.left(c, F.lit(4)), F.lit("…"), F.right(c, F.lit(4)))).otherwise(c)


def company_number_valid(c: Column) -> Column:
    """Control digit of a letter and eight digits; null where the shape differs."""
    d = [F.substr(c, F.lit(i + 2), F.lit(1)).cast("int") for i in range(8)]
    odd = [F.when(d[i] * 2 > 9, d[i] * 2 - 9).otherwise(d[i] * 2) for i in (0, 2, 4, 6)]
    total = odd[0] + odd[1] + odd[2] + odd[3] + d[1] + d[3] + d[5]
    return F.when(c.rlike("^[A-Z][0-9]{8}$"), (10 - total % 10) % 10 == d[7])


def currency(c: Column) -> Column:
    """ISO code of a sign or word; a bare dollar sign and unknown words give null."""
    return F.element_at(F.expr("map(" + ",".join(f"'{k}','{v}'" for k, v in CURRENCIES.items()) + ")"), identifier(c))


def spanish_number(c: Column) -> Column:
    return F.coalesce(F.translate(F.format_number(c, 2), ",.", ".,"), F.lit("—"))
