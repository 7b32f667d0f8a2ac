"""SQL that reads dates and times: an own way, with own lists, against which the column functions are checked."""

from __future__ import annotations

# Month names without accents in seven languages, January first.
_MONTHS = [
    "enero gener janeiro gennaio janvier januar january jan", "febrero febrer fevereiro febbraio fevrier februar february feb", "marzo marc marco mars marz march mar",
    "abril aprile avril april apr", "mayo maig maio maggio mai may", "junio juny junho giugno juin juni june jun", "julio juliol julho luglio juillet juli july jul",
    "agosto agost aout august aug", "septiembre setembre setembro settembre septembre september sep", "octubre outubro ottobre octobre oktober october oct",
    "noviembre novembre novembro november nov", "diciembre desembre dezembro dicembre decembre dezember december dec",
]
# Minutes east of UTC.
_ZONES = {"z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120}
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_TIME = r"(?:,? |[tT])(\d{1,2})[:.](\d\d)(?::(\d\d)(?:\.(\d{1,6}))?)?(?: ([aApP])\.? ?[mM]\.?)??(?: ?([+-]\d\d(?::?\d\d)?)| ?\[?([A-Za-z]+/[A-Za-z_/]+)\]?| ?([A-Za-z]{1,5}))?"
_GROUPS = "'h', 'mi', 's', 'f', 'ap', 'off', 'zone', 'abbr'"


def _shape(order: str, pattern: str) -> str:
    """A struct y, m, d and the parts of the time."""
    names = ", ".join(f"'{k}'" for k in order)
    return f"CASE WHEN regexp_full_match(s, '{pattern}(?:{_TIME})?') THEN regexp_extract(s, '^{pattern}(?:{_TIME})?$', [{names}, {_GROUPS}]) END"


def times(values: str) -> str:
    """CTEs that end in ``times``: v, norm, us (microseconds since 1970 UTC) and day (the date as written) of every distinct value of the
    column v of the relation ``values``; of what can't be read all are null."""
    months = "MAP {" + ", ".join(f"'{w}': {i + 1}" for i, ws in enumerate(_MONTHS) for w in ws.split()) + "}"
    zones = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in _ZONES.items()) + "}"
    shapes = [
        _shape("ymd", r"(\d{4})-(\d{1,2})-(\d{1,2})"),
        _shape("dmy", r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d\d)"),
        _shape("dmy", r"(?:[A-Za-z]{3}, )?(\d{1,2})\.? (?:(?i:de) |[dD][’''])?(\p{L}+) (?:(?i:de) )?(\d{4})"),
        _shape("mdy", r"(\p{L}+) (\d{1,2}), (\d{4})"),
    ]
    own = ", ".join(f"{k}: p.{k}" for k in ("y", "m", "d", "h", "mi", "s", "f", "off", "zone"))
    # am and pm look like a zone's letters.
    own += ", ap: CASE WHEN lower(p.abbr) IN ('am', 'pm') THEN p.abbr[1] ELSE p.ap END, abbr: CASE WHEN lower(p.abbr) IN ('am', 'pm') THEN '' ELSE p.abbr END"
    one = [f"CASE WHEN p IS NOT NULL THEN {{{own}}} END"] * 4
    picked = "coalesce(" + ", ".join(x.replace("p.", f"p{i}.").replace("p IS", f"p{i} IS") for i, x in enumerate(one)) + ")"
    n = lambda k: f"TRY_CAST(nullif(p.{k}, '') AS BIGINT)"
    return rf"""
t_names AS (SELECT name FROM pg_timezone_names()),
t_clean AS (SELECT v, trim(regexp_replace(regexp_replace(translate(v, '{_WIDE}', '{_NARROW}'), '\p{{Cf}}', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS s FROM (SELECT DISTINCT v FROM {values} WHERE v IS NOT NULL)),
t_run AS (SELECT v, CASE WHEN regexp_full_match(s, '\d{{8}}') THEN s[1:4] || '-' || s[5:6] || '-' || s[7:8]
    WHEN regexp_full_match(s, '\d{{8}}[tT]?\d{{6}}[zZ]?') THEN s[1:4] || '-' || s[5:6] || '-' || s[7:8] || regexp_replace(substr(s, 9), '^[tT]?(\d\d)(\d\d)(\d\d)', 'T\1:\2:\3') ELSE s END AS s,
    CASE WHEN regexp_full_match(s, '\d{{10}}|\d{{13}}|\d{{16}}') THEN CAST(s AS BIGINT) * CAST(power(10, 16 - length(s)) AS BIGINT) END AS epoch FROM t_clean),
t_parts AS (SELECT v, epoch, {', '.join(f'{x} AS p{i}' for i, x in enumerate(shapes))} FROM t_run),
t_one AS (SELECT v, epoch, {picked} AS p FROM t_parts),
t_numbers AS (SELECT v, epoch, p.h <> '' AS timed, CASE WHEN length(p.y) = 2 THEN 2000 ELSE 0 END + {n('y')} AS y, coalesce({months}[strip_accents(lower(p.m))], {n('m')}) AS mo, {n('d')} AS d,
    CASE WHEN p.ap = '' THEN {n('h')} WHEN {n('h')} BETWEEN 1 AND 12 THEN {n('h')} % 12 + CASE WHEN lower(p.ap) = 'p' THEN 12 ELSE 0 END END AS h, {n('mi')} AS mi, coalesce({n('s')}, 0) AS sec, rpad(p.f, 6, '0') AS f,
    CASE WHEN p.off <> '' THEN CASE WHEN p.off[1] = '-' THEN -1 ELSE 1 END * (CAST(p.off[2:3] AS BIGINT) * 60 + coalesce(TRY_CAST(nullif(replace(substr(p.off, 4), ':', ''), '') AS BIGINT), 0)) WHEN p.abbr <> '' THEN {zones}[lower(p.abbr)] END AS off,
    p.abbr <> '' AND {zones}[lower(p.abbr)] IS NULL AS odd, CASE WHEN p.zone <> '' THEN p.zone ELSE 'Europe/Madrid' END AS zone FROM t_one),
t_local AS (SELECT v, epoch, timed, off, zone, TRY_CAST(printf('%04d-%02d-%02d', y, mo, d) AS DATE) AS day,
    CASE WHEN NOT timed THEN TRY_CAST(printf('%04d-%02d-%02d 00:00:00', y, mo, d) AS TIMESTAMP) WHEN h < 24 AND mi < 60 AND sec < 60 AND NOT odd THEN TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d.', y, mo, d, h, mi, sec) || f AS TIMESTAMP) END AS local
    FROM t_numbers WHERE zone IS NULL OR zone IN (SELECT name FROM t_names)),
t_first AS (SELECT v, epoch, timed, off, zone, day, local, CASE WHEN local IS NOT NULL AND off IS NULL THEN epoch_us(timezone(zone, local)) END AS late FROM t_local),
t_at AS (SELECT v, timed, epoch, CASE WHEN off IS NOT NULL OR late IS NOT NULL THEN local END AS local, CASE WHEN epoch IS NOT NULL THEN CAST(make_timestamp(epoch) AS DATE) WHEN off IS NOT NULL OR late IS NOT NULL THEN day END AS day, CASE WHEN epoch IS NOT NULL THEN epoch WHEN off IS NOT NULL THEN epoch_us(local) - off * 60000000
    WHEN timezone(zone, timezone('UTC', make_timestamp(late - 3600000000))) = local THEN late - 3600000000 ELSE late END AS us FROM t_first),
times AS (SELECT v, us, day, CASE WHEN epoch IS NOT NULL OR (timed AND local IS NOT NULL) THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') WHEN local IS NOT NULL THEN CAST(day AS VARCHAR) END AS norm FROM t_at)"""
