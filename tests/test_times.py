import datetime as dt

import pytest
from pyspark.sql import functions as F

from arqueo.functions.times import with_time
from arqueo.operators.timestamps import normalised_times, not_normal

CASES = {
    "2026-04-03": "2026-04-03", "15/04/2025": "2025-04-15", "5/4/25": "2025-04-05", "27-05-2026": "2026-05-27", "07.03.2025": "2025-03-07", "20250330": "2025-03-30",
    "27 de noviembre de 2025": "2025-11-27", "22 d’abril de 2026": "2026-04-22", "26. August 2026": "2026-08-26", "20 août 2025": "2025-08-20", "NOVEMBER 14, 2025": "2025-11-14", "30 gennaio 2026": "2026-01-30", "25 de julho de 2025": "2025-07-25",
    "2025-12-03T08:37": "2025-12-03T07:37:00.000000Z", "02/07/2026 02:24:49": "2026-07-02T00:24:49.000000Z", "20250323T224028Z": "2025-03-23T22:40:28.000000Z", "20251016014125": "2025-10-15T23:41:25.000000Z",
    "2025-10-20T23:54:32.877968Z": None, "Thu, 01 Jan 2026 08:54:06 +0100": "2026-01-01T07:54:06.000000Z", "Sat, 28 Feb 2026 23:10:06 GMT": "2026-02-28T23:10:06.000000Z",
    "07/08/2026 3:15 AM": "2026-08-07T01:15:00.000000Z", "31/03/2025 5:23 p. m.": "2025-03-31T15:23:00.000000Z", "23/06/2026 12:10 a.m.": "2026-06-22T22:10:00.000000Z", "05/08/2026 12:00 PM": "2026-08-05T10:00:00.000000Z",
    "1742863128": "2025-03-25T00:38:48.000000Z", "1739078268062": "2025-02-09T05:17:48.062000Z", "1760532280000455": "2025-10-15T12:44:40.000455Z",
    "16/01/2026 15:52 CET": "2026-01-16T14:52:00.000000Z", "2025-10-18 09:32:09 WEST": "2025-10-18T08:32:09.000000Z", "2025-12-14 19:43:10.076 America/Sao_Paulo": "2025-12-14T22:43:10.076000Z", "2025-03-29T18:37:18[Europe/Madrid]": "2025-03-29T17:37:18.000000Z",
    "05-02-2025 19.26": "2025-02-05T18:26:00.000000Z", "03.09.2026, 17:51": "2026-09-03T15:51:00.000000Z", "27 de noviembre de 2025, 06:58": "2025-11-27T05:58:00.000000Z", "August 27, 2026 01:58": "2026-08-26T23:58:00.000000Z", "2026-01-27 12:25:32+00": "2026-01-27T12:25:32.000000Z", "2025-12-15 13:06:45.727885-05:00": "2025-12-15T18:06:45.727885Z",
    # the hour that occurs twice, first and as the text says; the hour that is skipped
    "2025-10-26 02:30:00": "2025-10-26T00:30:00.000000Z", "2025-10-26 02:30:00 CET": "2025-10-26T01:30:00.000000Z", "2026-03-29 02:30:00": "2026-03-29T01:30:00.000000Z",
    " 2026-04-03 ": "2026-04-03", "２０２６-０４-０３": "2026-04-03", "1900-01-01": None, "2024-02-29": None, "0099-12-31T00:00Z": "0099-12-31T00:00:00.000000Z",
}
UNREADABLE = ["29/02/2025", "00/00/0000", "31/02/2026 10:00", "2026-04-31T08:15:00Z", "pendiente", "", " ", "---", "n/d", "2026-13-01", "2026-01-01 25:00", "2026-01-01 10:61", "2026-01-01 13:00 PM", "12 foo 2026", "2026-01-01 10:00 XYZ", "2026-01-01 10:00 Nowhere/City", "123456789", "2026-01-01T10:00+25:00", "x" * 100_000]


def run(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return {r["i"]: r for r in with_time(df, F.col("v"), "t").collect()}


def test_formats(spark):
    got = run(spark, list(CASES))
    wrong = {k: (got[i]["t_norm"], v) for i, (k, v) in enumerate(CASES.items()) if got[i]["t_norm"] != (v or k)}
    assert not wrong


def test_unreadable(spark):
    got = run(spark, [*UNREADABLE, None])
    assert [r["v"] for r in got.values() if r["t_norm"] is not None or r["t_at"] is not None or r["t_date"] is not None] == []


def test_date_and_instant(spark):
    r = run(spark, ["2026-07-01", "2026-07-01T10:00:00Z"])
    assert r[0]["t_date"] == dt.date(2026, 7, 1) and r[0]["t_at"] == int(dt.datetime(2026, 6, 30, 22, tzinfo=dt.UTC).timestamp()) * 1_000_000
    assert r[1]["t_date"] == dt.date(2026, 7, 1) and r[1]["t_at"] == int(dt.datetime(2026, 7, 1, 10, tzinfo=dt.UTC).timestamp()) * 1_000_000


@pytest.mark.parametrize("rows", [[], [("k", None, None)]])
def test_nothing_to_read(spark, rows):
    df = spark.createDataFrame(rows, "key string, a string, b string")
    assert normalised_times(df, {"key": F.col("key")}, {"a": F.col("a"), "b": F.col("b")}).collect() == []


def test_long_form_with_clashing_names_and_repeats(spark):
    df = spark.createDataFrame([("k", "01/02/2026", "x", 1), ("k", "01/02/2026", "x", 1)], "rec_key string, raw string, norm string, field int")
    x = normalised_times(df, {"rec_key": F.col("rec_key")}, {"raw": F.col("raw"), "norm": F.col("norm")})
    assert x.count() == 4
    assert [tuple(r) for r in not_normal(x, ["rec_key"]).collect()] == [("k", "raw", "2026-02-01")]
