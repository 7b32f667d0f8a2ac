"""The pN_found queries against brute force on whole small tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from test_operators import check_overlaps  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from arqueo.plans import problems  # noqa: E402


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("name", "expected", "columns"),
    [("p1_found", brute.p1, ["file_id", "group_id"]), ("p2_found", brute.p2, ["id_a", "id_b"]), ("p5_found", brute.p5, ["pedido", "field", "snapshot_id", "idx"]), ("p6_found", brute.p6, ["tab", "rec_key", "item"]), ("p7_found", brute.p7, ["doc_id", "item_id"])],
)
def test_same_as_brute_force(spark, sf, name, expected, columns):
    df = entry.queries()[name](spark, sf)
    assert df.columns == columns
    got = rows(df)
    assert len(got) == len(set(got)) and set(got) == expected(sf)


def test_pieces(spark, sf):
    from arqueo.llm.tokens import encoding

    e = encoding()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in entry.queries()["p9_pieces"](spark, sf).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {k for k, t in text.items() if t and len(e.encode_ordinary(t)) > 2048}
    for k, ps in got.items():
        ps.sort(key=lambda r: r["piece"])
        assert "".join(p["text"][p["new_char"] - p["start_char"] :] for p in ps) == text[k]
        check_overlaps(e, text[k], ps, 128)
        assert all(p["n_tokens"] == len(e.encode_ordinary(p["text"])) <= 2048 for p in ps)
    assert {tuple(r) for r in entry.queries()["p9_found"](spark, sf).collect()} == {(k,) for k in got}


def test_shares(spark, sf):
    for r in entry.queries()["p8_shares"](spark, sf).collect():
        most = r["available_tokens"] * r["max_repeats"]
        assert r["tokens"] <= most and r["most_repeats"] <= r["max_repeats"]
        assert r["absent"] == (r["available_tokens"] == 0)
        if r["exhausted"]:
            assert r["tokens"] == most


@pytest.mark.parametrize("steps", [1, 4, 9])
def test_the_number_of_steps_changes_nothing(spark, sf, steps):
    from arqueo.llm.queries import p2_repeats

    got = {tuple(sorted((r["id"], r["kept_id"]))) for r in p2_repeats(spark, sf, steps).collect()}
    assert got == brute.p2(sf)


def test_current_survivors_same_as_brute_force(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = rows(entry.queries()["p5_current"](spark, sf).select("pedido", "field", "snapshot_id", "idx"))
    want = brute.p5_current(sf)
    assert len(got) == len(set(got)) and set(got) == want and want != brute.p5(sf)
    depth = {(r["field"], r["value"]): r["depth"] for r in entry.queries()["p5_precedence"](spark, sf).filter("field <> 'importe'").collect()}
    assert depth == {k: v for k, v in brute.learned(list(brute.p5_rows(sf))).items() if k[0] != "importe"}
