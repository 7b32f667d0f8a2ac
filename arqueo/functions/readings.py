"""Readings of printed fields: a struct of value and error, of which one is null (both, where there is nothing to read)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo.functions.identity import CURRENCIES
from arqueo.functions.text import BLANK, DASHES, INVISIBLE, amount, halfwidth, identifier, trimmed
from arqueo.functions.times import barrier
from arqueo.functions.worddates import with_invoice_date

# Currency codes, and the signs that name one of them for certain.
CODES = ["EUR", "USD", "GBP", "CHF", "JPY", "BRL", "MXN"]
SIGNS = {"€": "EUR", "£": "GBP", "R$": "BRL", "MX$": "MXN"}
# Names of currencies in labels.
ALIASES = {**{c: c for c in CODES}, **SIGNS, "EURO": "EUR", "EUROS": "EUR", "US$": "USD", "DOLLAR": "USD", "DOLLARS": "USD", "DÓLAR": "USD", "DÓLARES": "USD", "¥": "JPY", "YEN": "JPY", "YENES": "JPY"}
# Control letters of personal and company tax numbers.
PERSON_LETTERS, COMPANY_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE", "JABCDEFGHI"


def reading(c: Column, value: Column, error: str | Column) -> Column:
    """value, or if that is null error, of a text that isn't null."""
    e = F.lit(error) if isinstance(error, str) else error
    return F.when(c.isNotNull(), F.struct(value.alias("value"), F.when(value.isNull(), e).alias("error")))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def clean(c: Column) -> Column:
    """Without full-width forms, invisible characters and blanks around."""
    return trimmed(F.regexp_replace(halfwidth(c), f"[{INVISIBLE}]+", ""))


_LABELS = "FECHA|DATE|IBAN|TOTAL|PEDIDO|NIF|CIF"


def invoice_number(c: Column, tolerant: bool = False) -> Column:
    """Letters, digits, slash, hyphen and underscore, from 3 to 80 with a digit among them, and no word of another label in it. The tolerant
    profile takes long dashes for hyphens and knows two labels more."""
    x = identifier(c)
    x = F.regexp_replace(x, "[–—]", "-") if tolerant else x
    ok = x.rlike(r"^[A-Z0-9][A-Z0-9/_\-]{2,79}$") & x.rlike("[0-9]") & ~x.rlike(_LABELS + ("|DATA|ORDER" if tolerant else ""))
    return reading(c, F.when(ok, x), "mixed_fields")


def order(c: Column) -> Column:
    """PO, year, and three to six digits with any blanks and dashes between, shown with hyphens."""
    x = F.regexp_replace(F.upper(clean(c)), rf"[{BLANK}{DASHES}]+", "-")
    return reading(c, F.when(x.rlike(r"^PO-[0-9]{4}-[0-9]{3,6}$"), x), "no_order")


def tax_id(c: Column) -> Column:
    """Shapes of several countries; only blanks are taken out, as the printed form may be that of the master."""
    x = identifier(c)
    shape = r"^(?:[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}|[A-Z][0-9]{7}[A-Z0-9]|[0-9]{8}[A-Z]|[A-Z]{2}[A-Z0-9]{7,14}|[0-9]{10,15})$"
    return reading(c, F.when(x.rlike(shape), x), "no_tax_id")


def spanish_tax_number_valid(c: Column) -> Column:
    """Control of personal (eight digits and a letter), foreigners' (X, Y or Z first) and company numbers; false for other shapes, null for null."""
    x = identifier(c)
    digits = F.when(x.rlike("^[XYZ]"), F.concat(F.translate(F.left(x, F.lit(1)), "XYZ", "012"), F.substr(x, F.lit(2), F.lit(7)))).otherwise(F.left(x, F.lit(8)))
    person = F.substr(F.lit(PERSON_LETTERS), (digits.try_cast("int") % 23 + 1), F.lit(1)) == F.right(x, F.lit(1))
    d = [F.substr(x, F.lit(i), F.lit(1)).try_cast("int") for i in range(2, 9)]
    doubled = [F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2) for v in d[::2]]
    control = (10 - (d[1] + d[3] + d[5] + doubled[0] + doubled[1] + doubled[2] + doubled[3]) % 10) % 10
    company = (F.right(x, F.lit(1)) == control.cast("string")) | (F.right(x, F.lit(1)) == F.substr(F.lit(COMPANY_LETTERS), control + 1, F.lit(1)))
    return F.when(x.rlike("^[0-9]{8}[A-Z]$|^[XYZ][0-9]{7}[A-Z]$"), person).when(x.rlike("^[A-HJ-NP-SUVW][0-9]{7}[0-9A-J]$"), company).when(c.isNotNull(), F.lit(False))


def currency(c: Column, profile: str = "standard") -> Column:
    """standard: signs and words, any other text as it is, but a bare dollar is an error. tolerant: only codes and signs that name one currency.
    label: codes, signs and names that people write."""
    x = F.upper(clean(c))
    if profile == "standard":
        known = {k: v for k, v in CURRENCIES.items() if k in ("€", "EURO", "EUROS", "£", "¥", "R$", "MX$", "FR")}
        return reading(c, F.when(x != "$", F.coalesce(F.try_element_at(_map(known), x), x)), "ambiguous_sign")
    known = {**{k: k for k in CODES}, **SIGNS} if profile == "tolerant" else ALIASES
    return reading(c, F.try_element_at(_map(known), x), F.when(x == "$", "ambiguous_sign").otherwise("no_currency"))


def line_amount(c: Column, line_currency: Column) -> Column:
    """An amount; of a line in yen also whole thousands with marks, which elsewhere are not clear."""
    x = F.regexp_replace(F.translate(identifier(c), "−", "-"), "^(?:EUR|€)|(?:EUR|€)$", "")
    yen = F.when((line_currency == "JPY") & x.rlike(r"^[+-]?[0-9]{1,3}(?:[,.][0-9]{3})+$"), F.translate(x, ",.", "").try_cast("decimal(38,6)"))
    return reading(c, F.coalesce(money(c), yen), "unclear_amount")


def money(c: Column) -> Column:
    """An amount as it is printed: both marks with groups of three and two decimals, or one mark with one or two decimals, or none."""
    x = F.regexp_replace(F.translate(identifier(c), "−", "-"), "^(?:EUR|€)|(?:EUR|€)$", "")
    ok = x.rlike(r"^[+-]?(?:[0-9]+(?:[.,][0-9]{1,2})?|[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]{2}|[0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{2})$")
    return F.when(ok, amount(c))


def cents(c: Column) -> Column:
    """``money`` rounded to cents, half up."""
    return F.round(money(c), 2).cast("decimal(38,2)")


def whole_rate(c: Column) -> Column:
    """A rate of one or two digits, with or without per cent."""
    x = F.regexp_replace(c, r"[%\s]", "")
    return F.when(x.rlike("^[0-9]{1,2}$"), x.try_cast("int"))


def permissive_amount(c: Column) -> Column:
    """The first number in a text; a comma is decimal, and a point before three digits groups thousands. Null without a number."""
    x = F.regexp_extract(F.regexp_replace(c, r"\s", ""), r"-?[0-9][0-9.,]*", 0)
    x = F.regexp_replace(x, "[.,]+$", "")
    both = x.contains(",") & x.contains(".")
    last_comma = F.length(F.substring_index(x, ",", -1)) < F.length(F.substring_index(x, ".", -1))
    plain = (
        F.when(both & last_comma, F.translate(F.translate(x, ".", ""), ",", "."))
        .when(both, F.translate(x, ",", ""))
        .when(x.contains(","), F.translate(x, ",", "."))
        .when(x.rlike(r"^-?[0-9]{1,3}(?:\.[0-9]{3})+$"), F.translate(x, ".", ""))
        .otherwise(x)
    )
    return plain.try_cast("decimal(38,6)")


def sanitised(c: Column, field: str) -> Column:
    """What of a free text has the shape of a Spanish tax number, a Spanish account or an order; null if nothing has."""
    pattern = {"supplier_nif": r"[A-Z][0-9]{7}[0-9A-Z]|[0-9]{8}[A-Z]", "iban": "ES[0-9]{22}", "order": "PO-[0-9]{4}-[0-9]{3,6}"}[field]
    return F.nullif(F.regexp_extract(F.regexp_replace(F.upper(c), r"[\s]", ""), pattern, 0), F.lit(""))


def safe_id(c: Column) -> Column:
    """A file id with an underscore for every run of characters but letters, digits, point, hyphen and underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._\-]+", "_")


def xml_escaped(c: Column) -> Column:
    x = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def fenced_json(c: Column) -> Column:
    """From the first brace to the last of a text that may stand in a code fence; null without braces or if that is no JSON."""
    x = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(x).isNotNull(), x)


def amount_in(evidence: Column, value: Column) -> Column:
    """Whether a text holds a number that is the value, in any notation that is clear."""
    found = F.transform(F.regexp_extract_all(evidence, F.lit(r"[0-9][0-9.,]*"), F.lit(0)), lambda t: money(F.regexp_replace(t, "[.,]+$", "")))
    return F.coalesce(F.exists(found, lambda v: v == value), F.lit(False))


_TEXTS, _AMOUNTS = ("invoice_number", "supplier_nif", "iban", "order"), ("base", "tax_rate", "tax_amount", "total")


def with_normal_value(df: DataFrame, field: Column, c: Column, prefix: str) -> DataFrame:
    """Adds ``{prefix}_value``, the form in which a field's readings are compared (identifiers, dates, amounts without trailing zeros, currencies),
    and ``{prefix}_error`` where a text can't be read as its field or the field is unknown."""
    x = with_invoice_date(df, F.when(field == "date", c), f"__{prefix}")
    number = F.regexp_replace(money(c).cast("string"), r"\.?0+$", "")
    value = F.when(field.isin(*_TEXTS), identifier(c)).when(field == "date", F.col(f"__{prefix}_date").cast("string")).when(field.isin(*_AMOUNTS), number).when(field == "currency", currency(c, "label")["value"])
    x = x.withColumn(f"{prefix}_value", barrier(value))
    error = F.when(field.isin(*_TEXTS, *_AMOUNTS, "date", "currency"), F.concat(F.lit("unreadable_"), field)).otherwise("unknown_field")
    return x.withColumn(f"{prefix}_error", F.when(c.isNotNull() & F.col(f"{prefix}_value").isNull(), error)).drop(f"__{prefix}_date", f"__{prefix}_language")


def cost_estimate(n: Column, external: Column, hours: Column, per_hour: Column, minutes: Column, per_minute: Column) -> Column:
    """External costs, machine hours and people's minutes at their prices; null for nothing at all, and for negative or infinite numbers."""
    parts = [c.cast("double") for c in (n, external, hours, per_hour, minutes, per_minute)]
    good = F.lit(True)
    for c in parts:
        good = good & (c >= 0) & (c < float("inf"))
    total = parts[1] + parts[2] * parts[3] + parts[4] * parts[5]
    return F.when(good & (parts[0] > 0) & (total < float("inf")), total)


def external_cost(neurons: Column, tokens_in: Column, tokens_out: Column, per_thousand_neurons: float | None, per_million_in: float | None, per_million_out: float | None) -> Column:
    """What a model's use costs, by neurons if there are any and else by tokens; null where its price is unknown."""
    dec = lambda x: F.lit(None if x is None else str(x)).cast("decimal(18,8)")
    by_tokens = (F.coalesce(tokens_in, F.lit(0)) * dec(per_million_in) + F.coalesce(tokens_out, F.lit(0)) * dec(per_million_out)) / 1_000_000
    return F.when(neurons > 0, neurons / 1000 * dec(per_thousand_neurons)).otherwise(by_tokens).cast("double")
