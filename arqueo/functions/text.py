"""Identifiers, order numbers, amounts and words that stand for no data."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms of ! to ~ stand 0xFEE0 above them.
WIDE = "".join(chr(x + 0xFEE0) for x in range(0x21, 0x7F))
NARROW = "".join(chr(x) for x in range(0x21, 0x7F))

#: Characters without a picture: formats, controls, variation selectors, fillers.
INVISIBLE = r"\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{2065}"
BLANK = r"\s\p{Z}\x{0085}"
DASHES = r"\p{Pd}\x{2212}\x{2043}\x{02D7}\x{30FC}"

# Words that stand for no data, after blanks are removed and letters are upper case.
NO_DATA = ["N/D", "N/A", "NULL", "S/D", "SIN_DATO", "SINDATO", "SIN_PLANTILLA", "SINPLANTILLA"]


def halfwidth(c: Column) -> Column:
    return F.translate(c, WIDE, NARROW)


@cache
def _pairs() -> list[tuple[str, str]]:
    """Decomposed and composed form of each Latin letter with one accent."""
    out = []
    for x in range(0xC0, 0x250):
        d = unicodedata.normalize("NFD", chr(x))
        if len(d) == 2:
            out.append((d, chr(x)))
    return out


def composed(c: Column) -> Column:
    """Latin letters with one combining accent in composed form; other text as it is."""
    table = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(p).alias("p")) for d, p in _pairs()])
    return F.when(c.rlike(r"\p{Mn}"), F.aggregate(table, c, lambda acc, x: F.replace(acc, x["d"], x["p"]))).otherwise(c)


def identifier(c: Column) -> Column:
    """Letter case, blanks, invisible characters and full-width forms don't count. Null stays null."""
    plain = c.rlike("^[!-~]*$")  # nothing to take out
    return F.when(plain, F.upper(c)).otherwise(F.upper(F.regexp_replace(halfwidth(c), f"[{INVISIBLE}{BLANK}\\p{{Cc}}]+", "")))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANK}{INVISIBLE}]+|[{BLANK}{INVISIBLE}]+$", "")


def no_data(cleaned: Column) -> Column:
    """Whether an ``identifier`` says that there is no data. Never null."""
    return F.coalesce(cleaned.rlike(r"^[\p{P}\p{S}]*$") | cleaned.isin(NO_DATA), F.lit(True))


def data(c: Column) -> Column:
    """The identifier, or null where it is a no-data word."""
    return data_of(identifier(c))


def data_of(cleaned: Column) -> Column:
    return F.when(~no_data(cleaned), cleaned)


def order_number(c: Column) -> Column:
    """PO-yyyy-dddddd, or null where the text is no order number."""
    return order_number_of(identifier(c))


def order_number_of(cleaned: Column) -> Column:
    x = F.regexp_replace(cleaned, f"^PO[{DASHES}]*([0-9]{{4}})[{DASHES}]*([0-9]{{6}})$", "PO-$1-$2")
    return F.when(x.rlike("^PO-[0-9]{4}-[0-9]{6}$"), x)


def amount(c: Column) -> Column:
    """The number as decimal(38,6), or null where the text is not one number with a clear decimal mark.

    A euro sign or EUR at either end doesn't count, nor do blanks. Of two marks the last is decimal and the
    other groups by threes; a mark that repeats groups by threes; a lone mark is decimal unless three digits follow.
    """
    return amount_of(identifier(c))


def amount_of(cleaned: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(cleaned, r"^(?:EUR|€)|(?:EUR|€)$", ""), r"^[\x{2212}\x{2013}]", "-")
    plain = (
        F.when(cleaned.rlike(r"^[0-9]+[.,][0-9]{1,2}$"), F.translate(cleaned, ",", "."))
        .when(x.rlike(r"^[+-]?[0-9]+[.,](?:[0-9]{1,2}|[0-9]{4,6})$"), F.translate(x, ",", "."))
        .when(x.rlike(r"^[+-]?[0-9]+$"), x)
        .when(x.rlike(r"^[+-]?[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]{1,6}$"), F.translate(F.translate(x, ".", ""), ",", "."))
        .when(x.rlike(r"^[+-]?[0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{1,6}$"), F.translate(x, ",", ""))
        .when(x.rlike(r"^[+-]?[0-9]{1,3}(?:\.[0-9]{3}){2,}$|^[+-]?[0-9]{1,3}(?:,[0-9]{3}){2,}$"), F.translate(x, ".,", ""))
    )
    return plain.try_cast("decimal(38,6)")
