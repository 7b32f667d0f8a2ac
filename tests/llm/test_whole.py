"""Queries do the whole job, where they once did less."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from arqueo.llm import lookalike, splits, survivor


def missed(report):
    return sum(abs(r["actual_share"] - r["target_share"]) for r in report.collect())


def test_mix_meets_the_shares(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    report = entry.queries()["p8_shares"](spark, sf)
    assert report.filter("exhausted AND NOT absent").count() == 0
    assert missed(report) < 0.0201 < missed(entry.queries()["p8_shares_sized"](spark, sf))  # of which 0.02 are the absent source's
    docs = {r["source"]: r["count"] for r in entry.queries()["p8_mix"](spark, sf).groupBy("source").count().collect()}
    assert docs == {r["source"]: r["n_docs"] for r in report.collect() if r["n_docs"]}


def test_undated_rows_against_dated_ones(spark):
    data = [
        ("later", 1, "open"), ("later", None, "paid"), ("earlier", 1, "paid"), ("earlier", None, "open"), ("same", 1, "paid"), ("same", None, "paid"), ("unknown", 1, "other"), ("unknown", None, "paid"),
        ("news", 1, "paid"), ("news", 2, "open"), ("news", None, "held"), ("no depth", 1, "open"), ("no depth", None, "other"),
    ]
    df = spark.createDataFrame([(g, t, i, v, g == "later" and t == 1) for i, (g, t, v) in enumerate(data)], "g string, at int, i int, v string, sure boolean")
    order = spark.createDataFrame([("v", v, d) for d, v in enumerate(["open", "held", "paid"])], "field string, value string, depth int")
    got = lambda trust: {r["g"]: (r["value"], r["at"]) for r in survivor.survivors(df, "g", {"v": (F.col("v").isNotNull(), "v")}, trust, "at", ["i"], order).collect()}
    assert got([]) == {"later": ("paid", None), "earlier": ("paid", 1), "same": ("paid", 1), "unknown": ("other", 1), "news": ("held", None), "no depth": ("open", 1)}
    assert got(["sure"])["later"] == ("open", 1)


def test_groups_come_from_the_assignment(spark, sf, monkeypatch):
    calls, assign = [], splits.assign_splits
    monkeypatch.setattr(splits, "assign_splits", lambda *a: calls.append(a[2]) or assign(*a))
    found = entry.queries()["p1_found"](spark, sf)
    assert len(calls) == 2
    status = calls[-1].assignment().select(F.col("record").alias("file_id"), "split", "status")
    assert found.count() > 0 and found.join(status.filter("split IS NOT NULL AND status = 'quarantined'"), "file_id", "left_anti").count() == 0


def precedence(spark, data):
    df = spark.createDataFrame(data, "g string, at int, i int, v string")
    return {r["value"]: r["depth"] for r in survivor.learned_precedence(df, "g", "at", {"v": "v"}, ["i"]).collect()}


def test_a_row_without_the_field_breaks_no_chain(spark):
    got = precedence(spark, [(f"g{k}", t, t, v) for k in range(3) for t, v in enumerate(["a", None, "b"])])
    assert got == {"a": 0, "b": 1}


def test_only_transitions_on_circles_are_dropped(spark):
    chain = lambda name, n, a, b: [(f"{name}{k}", t, t, v) for k in range(n) for t, v in enumerate([a, b])]
    got = precedence(spark, chain("p", 30, "x", "a") + chain("q", 3, "a", "b") + chain("r", 30, "b", "y"))
    assert got["x"] < got["a"] < got["b"] < got["y"]
    got = precedence(spark, chain("p", 5, "a", "b") + chain("q", 4, "b", "c") + chain("r", 3, "c", "a") + chain("s", 3, "c", "d"))
    assert set(got) == {"a", "b", "c", "d"} and got["c"] < got["d"]


def test_on_circles(spark):
    edges = [("f", *e) for e in ["ab", "bc", "ca", "cd", "de", "ed", "ex", "xy", "zz", "pq"]] + [("g", "a", "b")]
    got = {tuple(r) for r in survivor.on_circles(spark.createDataFrame(edges, "field string, a string, b string")).collect()}
    assert got == {("f", *e) for e in ["ab", "bc", "ca", "de", "ed", "zz"]}


def test_late_invisible_characters_and_hangul(spark):
    texts = ["caf\u00e9", "caf\u00e9\U000e0101", "c\U000e0041af\u00e9", "\ud55c\uae00", "\u1112\u1161\u11ab\u1100\u1173\u11af", "\ud558\uae00"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    canon = {r[0]: r[1] for r in lookalike.canonical(spark, df, "text").collect()}
    got = [canon[t] for t in texts]
    assert got[0] == got[1] == got[2] == "caf\u00e9" and got[3] == got[4] == "\ud55c\uae00" != got[5]
