"""Queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Fixed values that the SQL has for itself: full-width forms and theirs, words for no data, dashes of an order number.
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
NO_DATA = ["N/D", "N/A", "NULL", "S/D", "SIN_DATO", "SINDATO", "SIN_PLANTILLA", "SINPLANTILLA"]
DASHES = r"\x{002D}\x{2010}-\x{2015}\x{2212}\x{2043}\x{02D7}\x{30FC}"

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql.strip()
            return f

        return add


def sql_identifier(c: str) -> str:
    quoted = NARROW.replace("'", "''")
    return rf"upper(regexp_replace(translate({c}, '{WIDE}', '{quoted}'), '[\p{{Cf}}\p{{Z}}\s\p{{Cc}}]+', '', 'g'))"


def sql_data(c: str) -> str:
    words = ",".join(f"'{w}'" for w in NO_DATA)
    x = sql_identifier(c)
    return rf"(CASE WHEN NOT regexp_matches({x}, '^[\p{{P}}\p{{S}}]*$') AND {x} NOT IN ({words}) THEN {x} END)"


def sql_order(c: str) -> str:
    d = DASHES
    return rf"(CASE WHEN regexp_matches({sql_identifier(c)}, '^PO[{d}]*[0-9]{{4}}[{d}]*[0-9]{{6}}$') THEN regexp_replace({sql_identifier(c)}, '^PO[{d}]*([0-9]{{4}})[{d}]*([0-9]{{6}})$', 'PO-\1-\2') END)"


def sql_amount(c: str) -> str:
    x = rf"regexp_replace({sql_identifier(c)}, '^(?:EUR|€)|(?:EUR|€)$', '', 'g')"
    return rf"""(CASE WHEN regexp_matches({x}, '^[+-]?[0-9]+$') THEN TRY_CAST({x} AS DECIMAL(38,6))
      WHEN regexp_matches({x}, '^[+-]?[0-9]+[.,](?:[0-9]{{1,2}}|[0-9]{{4,6}})$') THEN TRY_CAST(replace({x}, ',', '.') AS DECIMAL(38,6))
      WHEN regexp_matches({x}, '^[+-]?[0-9]{{1,3}}(?:\.[0-9]{{3}})+,[0-9]{{1,6}}$') THEN TRY_CAST(replace(replace({x}, '.', ''), ',', '.') AS DECIMAL(38,6))
      WHEN regexp_matches({x}, '^[+-]?[0-9]{{1,3}}(?:,[0-9]{{3}})+\.[0-9]{{1,6}}$') THEN TRY_CAST(replace({x}, ',', '') AS DECIMAL(38,6)) END)"""
