"""Dates and times of many formats in one form.

Every format is an alternative of one regular expression with named groups. It runs once for a value: the match is
replaced by its components in a fixed order, and each component stands in just one alternative. Calendar ranges are
checked and the instant is put together from them in integer arithmetic on days and microseconds.
"""

from __future__ import annotations

import re
import zoneinfo
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo.functions.text import BLANK, INVISIBLE, halfwidth

# Month names in es, ca, pt, it, fr, de and en, without accents, and their short forms.
MONTHS = {
    1: "enero gener janeiro gennaio janvier januar january janner ene gen jan janv",
    2: "febrero febrer fevereiro febbraio fevrier februar february feb fev fevr",
    3: "marzo marc marco mars marz march mar maerz mrz",
    4: "abril aprile avril april abr apr avr",
    5: "mayo maig maio maggio mai may mag",
    6: "junio juny junho giugno juin juni june jun giu",
    7: "julio juliol julho luglio juillet juli july jul lug juil",
    8: "agosto agost aout august ago ag aug",
    9: "septiembre setiembre setembre setembro settembre septembre september sep set sept",
    10: "octubre outubro ottobre octobre oktober october oct out ott okt",
    11: "noviembre novembre novembro november nov",
    12: "diciembre desembre dezembro dicembre decembre dezember december dic des dez dec",
}
# Hours that zone abbreviations lie east of UTC.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2, "EET": 2, "EEST": 3,
    "MSK": 3, "JST": 9, "BRT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}
#: Text without zone is local time here.
HOME = "Europe/Madrid"

_DE = r"(?:\s*de[l]?\s+|\s*d['’]\s*|\s+)"
# The formats; {n} numbers the groups of each alternative.
_DATES = [
    r"(?<y{n}>[0-9]{4})[-/.](?<m{n}>[0-9]{1,2})[-/.](?<d{n}>[0-9]{1,2})",
    r"(?<d{n}>[0-9]{1,2})/(?<m{n}>[0-9]{1,2})/(?<y{n}>[0-9]{4}|[0-9]{2})",
    r"(?<d{n}>[0-9]{1,2})-(?<m{n}>[0-9]{1,2})-(?<y{n}>[0-9]{4}|[0-9]{2})",
    r"(?<d{n}>[0-9]{1,2})\.(?<m{n}>[0-9]{1,2})\.(?<y{n}>[0-9]{4}|[0-9]{2})",
    r"(?:\p{L}{2,12}\.?,?\s+)?(?<d{n}>[0-9]{1,2})(?:\.|º|er|st|nd|rd|th)?" + _DE + r"(?<w{n}>\p{L}{2,12})\.?" + _DE + r"(?<y{n}>[0-9]{4})",
    r"(?:\p{L}{2,12}\.?,\s+)?(?<w{n}>\p{L}{3,12})\.?\s+(?<d{n}>[0-9]{1,2})(?:st|nd|rd|th)?,?\s+(?<y{n}>[0-9]{4})",
    r"(?<d{n}>[0-9]{1,2})[-/](?<w{n}>\p{L}{3,12})\.?[-/](?<y{n}>[0-9]{4})",
]
_TIME = r"(?:\s*[,T]\s*|\s+)(?<H{n}>[0-9]{1,2})[:.h](?<M{n}>[0-9]{2})(?:[:.](?<S{n}>[0-9]{2})(?:[.,](?<f{n}>[0-9]{1,9}))?)?h?(?:\s*(?<a{n}>[ap])\.?\s?m\.?(?!\p{L}))?"
_ZONE = r"(?:\s*(?<o{n}>[+\-−][0-9]{2}(?::?[0-9]{2})?)(?:\s*\[[A-Za-z_/+\-0-9]+\])?|\s*\[?(?<r{n}>[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)\]?|\s*(?<z{n}>[A-Za-z]{1,5}))?"
_RUNS = [
    r"(?<y{n}>[0-9]{4})(?<m{n}>[0-9]{2})(?<d{n}>[0-9]{2})",
    r"(?<y{n}>[0-9]{4})(?<m{n}>[0-9]{2})(?<d{n}>[0-9]{2})[T ]?(?<H{n}>[0-9]{2})(?<M{n}>[0-9]{2})(?<S{n}>[0-9]{2})(?:[.,](?<f{n}>[0-9]{1,9}))?" + _ZONE,
    r"(?<e{n}>[0-9]{10}|[0-9]{13}|[0-9]{16})",
]
_PARTS = "ymdwHMSfaorze"


def _compile() -> tuple[str, str]:
    alternatives = [
        *(x.replace("{n}", str(i)) for i, x in enumerate(_RUNS)),
        "(?:" + "|".join(x.replace("{n}", str(10 + i)) for i, x in enumerate(_DATES)) + ")(?:" + (_TIME + _ZONE).replace("{n}", "30") + ")?",
    ]
    pattern = r"(?iu)^\s*(?:" + "|".join(alternatives) + r")\s*$"
    groups = {k: [] for k in _PARTS}
    for name in re.findall(r"\(\?<([A-Za-z][0-9]+)>", pattern):
        groups[name[0]].append("${" + name + "}")
    return pattern, "\x01" + "\x02".join("".join(groups[k]) for k in _PARTS)


PATTERN, COMPONENTS = _compile()


DAY = 86_400_000_000


def whole(x: Column, n: int) -> Column:
    """x // n in integers, also for negative x."""
    x, n = x.cast("long"), F.lit(n).cast("long")
    return F.call_function("div", x - F.pmod(x, n), n)


def days_of(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date of the Gregorian calendar from year 1 on, in integers: months count from March."""
    div = lambda x, n: F.call_function("div", x, F.lit(n).cast("long"))
    y = y - F.when(m <= 2, 1).otherwise(0)
    return 365 * y + div(y, 4) - div(y, 100) + div(y, 400) + div(153 * F.pmod(m + 9, F.lit(12)) + 2, 5) + d - 719469


def barrier(c: Column) -> Column:
    """c, in an expression that the optimizer takes for nondeterministic: it neither copies it into filters nor merges it into
    later projections, which for steps that build on each other would grow exponentially. The lambda keeps the projection out of
    its neighbours' generated method, which would otherwise become too long for the JVM to compile."""
    return F.when(F.forall(F.array(F.monotonically_increasing_id()), lambda x: x >= 0), c)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC of a column of timestamps; those without zone are taken as UTC, whatever the session's zone."""
    c = F.col(name)
    if df.schema[name].dataType.simpleString() != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    seconds = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(F.to_date(c)).cast("long") * DAY + (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000 + seconds


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


@cache
def _zone_names() -> str:
    return ",".join(f"'{x}'" for x in sorted(zoneinfo.available_timezones()))


def with_time(df: DataFrame, c: Column, prefix: str, keep: list[str] | None = None) -> DataFrame:
    """Adds the columns ``{prefix}_date`` (date), ``{prefix}_at`` (long, microseconds since 1970 UTC) and
    ``{prefix}_norm`` (string) to df; with ``keep``, of df's own columns only those stay.

    A date alone gives date and norm; its ``_at`` is its start in Madrid. A date with a time gives at and norm, and date is
    the local date as written. Text that names no real date or time, empty text and null give nulls.
    """
    p = f"__{prefix}_"
    names = df.columns if keep is None else keep
    own = [F.col(f"`{x}`") for x in names]
    plain = F.octet_length(c) == F.length(c)
    clean = F.when(plain, F.trim(c)).otherwise(F.regexp_replace(halfwidth(c), f"^[{BLANK}{INVISIBLE}]+|[{BLANK}{INVISIBLE}]+$|[{INVISIBLE}]", ""))
    x = df.select(*own, F.regexp_replace(clean, PATTERN, COMPONENTS).alias(p + "m"))
    m = F.col(p + "m")
    x = x.select(*own, barrier(F.when(m.startswith("\x01"), F.split(F.substr(m, F.lit(2)), "\x02"))).alias(p + "s"))
    part = {k: F.get(F.col(p + "s"), F.lit(i)) for i, k in enumerate(_PARTS)}
    number = lambda k: F.when(part[k] != "", part[k].cast("long"))
    accents = "áàâäãçéèêëíìîïóòôöúùûü", "aaaaaceeeeiiiioooouuuu"
    word = F.translate(F.regexp_replace(F.lower(part["w"]), r"\p{Mn}", ""), *accents)
    months = F.expr("map(" + ",".join(f"'{w}',{n}" for n, words in MONTHS.items() for w in words.split()) + ")")
    zones = F.expr("map(" + ",".join(f"'{k}',{h}" for k, h in ZONES.items()) + ")")
    offset = F.regexp_replace(F.translate(part["o"], "−", "-"), ":", "")
    minutes = (F.substr(offset, F.lit(2), F.lit(2)).cast("long") * 60 + F.coalesce(F.nullif(F.substr(offset, F.lit(4), F.lit(2)), F.lit("")).cast("long"), F.lit(0))) * F.when(offset.startswith("-"), -1).otherwise(1)
    x = x.select(
        *own,
        barrier(number("y")).alias(p + "y0"),
        F.when(part["w"] != "", F.element_at(months, word)).otherwise(number("m")).alias(p + "mo"),
        number("d").alias(p + "d"),
        number("H").alias(p + "h0"),
        number("M").alias(p + "mi"),
        F.coalesce(number("S"), F.lit(0)).alias(p + "se"),
        F.substr(F.rpad(part["f"], 6, "0"), F.lit(1), F.lit(6)).cast("long").alias(p + "us"),
        F.lower(part["a"]).alias(p + "a"),
        F.when(part["o"] != "", minutes).when(part["z"] != "", F.element_at(zones, F.upper(part["z"])) * 60).alias(p + "off"),
        F.nullif(part["r"], F.lit("")).alias(p + "r"),
        (F.col(p + "s").isNotNull() & (part["z"] != "") & F.element_at(zones, F.upper(part["z"])).isNull()).alias(p + "badzone"),
        (F.length(part["y"]) == 2).alias(p + "short"),
        F.length(part["e"]).alias(p + "el"),
        number("e").alias(p + "e"),
    )
    v = lambda k: F.col(p + k)
    hour = F.when(v("a") == "", v("h0")).when(v("h0").between(1, 12), v("h0") % 12 + F.when(v("a") == "p", 12).otherwise(0))
    x = x.select(*own, *[v(k) for k in ("mo", "d", "mi", "se", "us", "off", "r", "badzone", "el", "e", "h0")], F.when(v("short"), v("y0") + 2000).otherwise(v("y0")).alias(p + "y"), barrier(hour).alias(p + "h"))
    real = (v("y") >= 1) & v("mo").between(1, 12) & (v("d") >= 1) & (v("d") <= days_in_month(v("y"), v("mo")))
    timed = v("h").between(0, 23) & v("mi").between(0, 59) & v("se").between(0, 59) & ~v("badzone") & (F.coalesce(F.abs(v("off")), F.lit(0)) <= 18 * 60)
    zone = F.coalesce(v("r"), F.lit(HOME))
    ok = real & (v("h0").isNull() | timed) & (v("r").isNull() | F.expr(f"`{p}r` IN ({_zone_names()})"))
    day = days_of(v("y"), v("mo"), v("d")).cast("long")
    clock = ((F.coalesce(v("h"), F.lit(0)) * 60 + F.coalesce(v("mi"), F.lit(0))) * 60 + v("se")) * 1_000_000 + F.coalesce(v("us"), F.lit(0))
    scale = F.when(v("el") == 10, 1_000_000).when(v("el") == 13, 1_000).otherwise(1)
    x = x.select(
        *own,
        barrier(F.when(ok, day)).alias(p + "day"),
        barrier(F.when(ok, day * DAY + clock)).alias(p + "local"),
        (v("e") * scale).cast("long").alias(p + "epoch"),
        v("off"),
        zone.alias(p + "zone"),
        v("h0").isNotNull().alias(p + "timed"),
    )
    home = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(v("local")), v("zone")))
    at = F.coalesce(v("epoch"), F.when(v("off").isNotNull(), v("local") - v("off") * 60_000_000).otherwise(home))
    x = x.select(
        *own,
        F.when(v("epoch").isNotNull(), F.date_add(F.lit("1970-01-01").cast("date"), whole(v("epoch"), DAY).cast("int"))).otherwise(F.date_add(F.lit("1970-01-01").cast("date"), v("day").cast("int"))).alias(f"{prefix}_date"),
        barrier(at).alias(f"{prefix}_at"),
        (v("epoch").isNotNull() | v("timed")).alias(p + "instant"),
    )
    norm = F.when(v("instant"), instant_text(F.col(f"{prefix}_at"))).otherwise(F.col(f"{prefix}_date").cast("string"))
    return x.select(*own, *[barrier(F.col(f"{prefix}_{k}")).alias(f"{prefix}_{k}") for k in ("date", "at")], barrier(norm).alias(f"{prefix}_norm"))


def instant_text(at: Column) -> Column:
    """yyyy-mm-ddThh:mm:ss.ffffffZ of microseconds since 1970 UTC, whatever the session's time zone."""
    day = whole(at, DAY)
    rest = at - day * DAY
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    second = whole(rest, 1_000_000)
    return F.concat(
        F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), F.lit("T"),
        two(whole(second, 3600)), F.lit(":"), two(whole(second, 60) % 60), F.lit(":"), two(second % 60), F.lit("."),
        F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )
