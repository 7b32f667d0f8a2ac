from pyspark.sql import functions as F

from arqueo.operators.snapshots import neighbours, snapshot_changes
from arqueo.plans.problems import row_meaning

ROWS = "snapshot_id string, row_id string, row_hash string, prev_id string"


def changes(spark, heads, rows):
    h = spark.createDataFrame(heads, "snapshot_id string, url string, created int")
    pairs = neighbours(h, "url", [F.col("created"), F.col("snapshot_id")])
    x = snapshot_changes(spark.createDataFrame([(*r, "clash") for r in rows], ROWS), pairs)
    return sorted((tuple(r) for r in x.collect()), key=str)


def test_changes(spark):
    heads = [("a", "u", 1), ("b", "u", 2), ("c", "u", 3), ("z", "v", 2)]
    rows = [("a", "1", "x"), ("a", "2", "x"), ("b", "1", "y"), ("b", "3", "x"), ("c", "1", "y"), ("c", "3", "x"), ("z", "9", "x")]
    assert changes(spark, heads, rows) == [("a", "b", "1", "changed"), ("a", "b", "2", "removed"), ("a", "b", "3", "added")]


def test_repeated_ids_and_nulls(spark):
    heads = [("a", None, 1), ("b", None, 1)]  # one series, a tie in time
    rows = [("a", "1", "x"), ("a", "1", "x"), ("b", "1", "x"), ("a", "2", "x"), ("b", "2", "x"), ("b", "2", "y"), ("a", None, "x")]
    assert changes(spark, heads, rows) == [("a", "b", "2", "changed"), ("a", "b", None, "removed")]


def test_empty(spark):
    assert changes(spark, [], []) == []
    assert changes(spark, [("a", "u", 1)], [("a", "1", "x")]) == []
    assert changes(spark, [("a", "u", 1), ("b", "u", 2)], [("b", "1", "x")]) == [("a", "b", "1", "added")]


def test_meaning_of_rows(spark):
    cols = "snapshot_id string, id string, fecha string, fecha_registro string, proveedor string, proveedor_id string, nif string, pedido string, importe string, importe_esperado string, estado string"
    same = [
        ("s", "1", "01/02/2026", None, "P1", None, None, "PO-2026-000001", "1.234,50", None, "PAGADA"),
        ("s", " 1", None, "2026-02-01", None, "p 1", " ", "PO 2026 000001", None, "1234.5 EUR", "ＰＡＧＡＤＡ"),
    ]
    other = [("s", "1", "02/02/2026", None, "P1", None, None, "PO-2026-000001", "1.234,50", None, "PAGADA"), ("s", "1", "01/02/2026", None, "P1", None, "B1", "PO-2026-000001", "1.234,50", None, "PAGADA")]
    got = [bytes(r["row_hash"]) for r in row_meaning(spark.createDataFrame(same + other, cols)).collect()]
    assert got[0] == got[1] and len(set(got)) == 3
