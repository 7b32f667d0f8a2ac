from pyspark.sql import functions as F

from arqueo.operators import relational as rel


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", None, "y"), (None, "9", "z")], "k string, v string, w string")
    new = spark.createDataFrame([("a", None, "x2"), ("b", None, "y"), ("c", "3", None)], "k string, v string, w string")
    assert rows(rel.upsert(old, new, "k", ["v", "w"]))[:3] == [("a", "1", "x2", "updated"), ("b", None, "y", "kept"), ("c", "3", None, "added")]


def test_interval_join_is_exact(spark):
    points = spark.createDataFrame([(i,) for i in range(-5, 40)], "at long")
    ranges = spark.createDataFrame([(1, 0, 10), (2, 9, 31), (3, -4, -1), (4, 5, 5), (5, 20, 10)], "r int, a long, z long")
    got = {(r["r"], r["at"]) for r in rel.interval_join(points, "at", ranges, "a", "z", 7).collect()}
    assert got == {(r, i) for r, a, z in [(1, 0, 10), (2, 9, 31), (3, -4, -1)] for i in range(a, z)}


def test_islands_latest_aliases(spark):
    x = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, "b")], "u int, t int, v string")
    assert rows(rel.islands(x, ["u"], ["t"], "v", "t")) == [(1, 1, "a", 1, 2, 2), (1, 2, None, 3, 4, 2), (1, 3, "a", 5, 5, 1), (2, 1, "b", 1, 1, 1)]
    assert rows(rel.latest(x, ["u"], ["t"])) == [(1, 5, "a"), (2, 1, "b")]
    y = rel.alias_agreement(spark.createDataFrame([("a", None), ("a", "b"), (None, None)], "p string, q string"), "s", [F.col("p"), F.col("q")])
    assert [(r["s"], r["s_state"]) for r in y.collect()] == [("a", "ok"), (None, "conflicting"), (None, "missing")]


def test_chain(spark):
    import hashlib

    chain, prev = [], "0" * 64
    for i in range(5):
        own = hashlib.sha256((prev + f"b{i}").encode()).hexdigest()
        chain.append((1, i, prev, own, f"b{i}"))
        prev = own
    bad = [*chain[:2], (1, 2, chain[2][2], chain[2][3], "changed"), *chain[3:]]
    make = lambda c: rel.chain_breaks(spark.createDataFrame(c, "s int, i int, prev string, own string, body string"), "s", "i", "prev", "own", F.col("body"))
    assert make(chain).count() == 0
    assert [(r["i"], r["bad_link"], r["bad_hash"]) for r in make(bad).collect()] == [(2, False, True)]
    assert make(chain[:1] + chain[2:]).select("i").collect()[0][0] == 2


def test_missing_only(spark):
    new = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, n int")
    assert rows(rel.missing_only(new, new.filter("k = 'b'"), ["k"])) == [("a", 1)]
    assert rel.missing_only(new.limit(0), new, ["k"]).count() == 0
