"""Edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from arqueo.llm import components, dedup, leakage, lookalike, mixture, pieces, splits, survivor, tokens
from arqueo.session import new_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- components and splits


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(20)] + [("s0", f"s{i}") for i in range(1, 200)] + [("x", "x")]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges + edges[:20], "a string, b string")).collect()}
    assert {got[f"c{i:03}"] for i in range(21)} == {"c000"} and {got[f"s{i}"] for i in range(200)} == {"s0"} and got["x"] == "x"
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


LABELS = "file string, k string, j string, split string"
TARGETS = [("train", 0.5), ("test", 0.5)]


def split_edges(spark, labels):
    return splits.edges_of(spark.createDataFrame([(*r, "clash") for r in labels], LABELS), "file", {"k": F.col("k"), "j": F.col("j")})


def new_store(spark):
    return splits.Store(spark, new_path(spark, "test"))


def assigned(spark, store, labels, targets, today=None, step=None):
    splits.assign_splits(split_edges(spark, labels), targets, store, today, step)
    return {r["record"]: (r["split"], r["status"]) for r in store.assignment(step).collect()}


def test_splits_are_kept_filled_and_quarantined(spark):
    targets = spark.createDataFrame(TARGETS, "split string, share double")
    first = [("a", "1", None), ("b", "1", None), ("c", "2", None), ("d", None, None), (None, "1", None), ("a", "1", None)]
    today = spark.createDataFrame([("a", "train"), ("c", "test"), ("c", "nonsense")], "record string, split string")
    store = new_store(spark)
    got = assigned(spark, store, first, targets, today)
    assert got["a"] == got["b"] == ("train", "kept") and got["c"] == ("test", "kept") and got["d"] == ("test", "new") and len(got) == 4
    # e joins the groups of a and c, which have different splits; f is new
    second = [("e", "1", "9"), ("c", "2", "9"), ("f", None, "8")]
    got = assigned(spark, store, second, targets)
    assert len({got[x][0] for x in "abce"}) == 1 and {got[x][1] for x in "abce"} == {"quarantined"} and got["f"][1] == "new" and got["d"] == ("test", "kept")
    assert {r["split"]: r["n"] for r in store.totals.read().groupBy("split").agg(F.sum("size").alias("n")).collect() if r["n"]} == {s: sum(v[0] == s for v in got.values()) for s in {v[0] for v in got.values()}}
    # a step that runs again changes nothing
    assert assigned(spark, store, second, targets, step=1) == got and store.next_step() == 2
    # and keep their one split from then on
    again = assigned(spark, store, [("g", "1", None)], targets)
    assert again["g"] == again["a"] == (got["a"][0], "quarantined") and len(again) == 7


def test_chains_of_merges(spark):
    targets = spark.createDataFrame(TARGETS, "split string, share double")
    store = new_store(spark)
    assigned(spark, store, [(f"f{i}", f"k{i}", None) for i in range(8)], targets)
    for step in (4, 2, 1):  # each step joins pairs of what the one before left
        assigned(spark, store, [(f"f{i}", None, f"j{i // (8 // step)}") for i in range(0, 8, 4 // step)], targets)
    nodes = {r["node"]: r["component"] for r in store.components().collect()}
    assert len({nodes[f"r:f{i}"] for i in range(8)}) == 1 and len({r[0] for r in store.assignment().select("split").collect()}) == 1


def test_a_small_step_reads_what_it_touches(spark, monkeypatch):
    targets = spark.createDataFrame(TARGETS, "split string, share double")
    store = splits.Store(spark, new_path(spark, "test"), rows=50)
    splits.assign_splits(split_edges(spark, [(f"f{i}", f"k{i // 2}", None) for i in range(2000)]), targets, store)
    seen, read = [], splits.Segments.read
    monkeypatch.setattr(splits.Segments, "read", lambda self, *a, **k: seen.append((self.folder.rsplit("/", 1)[1], read(self, *a, **k))) or seen[-1][1])
    got = splits.assign_splits(split_edges(spark, [("new", "k7", None)]), targets, store).collect()
    n = {name: x.count() for name, x in seen}
    assert n["members"] < 300 and n["splits"] < 150 and n["totals"] == 2 and [(r["size"], r["status"]) for r in got] == [(3, "kept")]


def test_shares_with_one_large_group(spark):
    labels = [(f"f{i}", "hot" if i < 400 else f"k{i // 3}", None) for i in range(1200)]
    targets = spark.createDataFrame([("train", 0.6), ("validation", 0.2), ("test", 0.2)], "split string, share double")
    store = new_store(spark)
    splits.assign_splits(split_edges(spark, labels), targets, store)
    got = store.assignment()
    n = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert abs(n["train"] - 720) < 15 and abs(n["validation"] - 240) < 15 and abs(n["test"] - 240) < 15
    assert got.groupBy("component").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0


def test_splits_of_nothing(spark):
    targets = spark.createDataFrame(TARGETS, "split string, share double")
    store = new_store(spark)
    assert assigned(spark, store, [], targets) == {}
    with pytest.raises(ValueError, match="share"):
        splits.fill_deficits(spark.createDataFrame([], "component string, size long"), spark.createDataFrame([], "split string, size long"), targets.limit(0))


# --- dedup

DOCS = "id string, created long, sha string, file string, bare boolean, r0 string, r1 string, r2 string, keys string"


def dedup_features(spark, docs):
    df = spark.createDataFrame([(*d, "clash") for d in docs], DOCS)
    return dedup.features(df, F.col("id"), F.col("created"), {"sha": F.col("sha")}, {"file": F.col("file")}, F.col("bare"), [F.col("r0"), F.col("r1"), F.col("r2")], 2)


def test_dedup_in_order_of_arrival(spark):
    docs = [
        ("a", 1, "s1", "f", False, "1", "2", "3"), ("b", 2, "s1", None, False, None, None, None), ("c", 3, None, None, False, "1", "2", "x"),
        ("d", 4, None, None, False, None, "y", "x"),  # two readings of none accepted
        ("e", 5, None, "f", True, None, None, None), ("g", 6, None, "f", False, "7", "8", "9"), ("h", None, None, "f", True, None, None, None),
        ("i", 4, None, None, False, None, "y", "x"), ("j", 9, None, None, None, None, None, None), (None, 1, "s1", None, False, None, None, None),
    ]
    want = [("b", "a"), ("c", "a"), ("e", "a"), ("h", "a"), ("h", "g"), ("i", "d")]
    fresh = lambda: dedup.key_index(spark, new_path(spark, "test"))
    won, repeats = dedup.dedup_batch(dedup_features(spark, docs), fresh(), 2, 0)
    assert rows(repeats) == want and sorted(r[0] for r in won.collect()) == ["a", "d", "g", "j"]
    # the same, one by one
    index, got = fresh(), []
    for i, part in enumerate([docs[:2], docs[2:4], docs[7:8], docs[4:7]]):
        got += rows(dedup.dedup_batch(dedup_features(spark, part), index, 2, i)[1])
    assert sorted(got) == want
    empty = dedup.dedup_batch(dedup_features(spark, []), index, 2, 4)
    assert empty[0].count() == empty[1].count() == 0


def test_a_batch_that_runs_again_gives_the_same(spark):
    docs = [("a", 1, "s1", "f", False, "1", "2", "3"), ("b", 2, "s1", None, False, None, None, None), ("c", 3, "s2", "f", True, None, None, None), ("d", 4, "s3", None, False, "1", "2", "9")]
    index = dedup.key_index(spark, new_path(spark, "test"))
    run = lambda part, step: [rows(x) for x in dedup.dedup_batch(dedup_features(spark, part), index, 2, step)]
    first, second = run(docs[:2], 0), run(docs[2:], 1)
    assert second == [[], [("c", "a"), ("d", "a")]] and first == [[("a",)], [("b", "a")]]
    assert run(docs[:2], 0) == first and run(docs[2:], 1) == second
    assert [(s.first, s.last) for s in index.segments()] == [(0, 0), (1, 1)]
    index.merge = 2
    index.write(2, index.read().limit(0))
    assert [(s.first, s.last) for s in index.segments()] == [(0, 1), (2, 2)]
    assert run(docs[:2], 0) == first and run(docs[2:], 1) == second and run(docs, 3) == [[], [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a")]]


def test_a_small_batch_reads_a_small_part_of_the_index(spark):
    index = dedup.key_index(spark, new_path(spark, "test"))
    index.rows = 100
    many = [(f"x{i:05}", i, f"s{i}", None, False, None, None, None) for i in range(20_000)]
    dedup.dedup_batch(dedup_features(spark, many), index, 2, 0)
    few = dedup_features(spark, [("y1", 1, "s7", None, False, None, None, None), ("y2", 2, "new", None, False, None, None, None)])
    probe = index.read(few.select(F.explode("keys.key").alias("key")).select(F.xxhash64("key").alias("hash")), before=1)
    assert len(index.buckets(index.segments()[0])) == 256 and len(probe.inputFiles()) <= 2 and probe.count() < 400
    assert rows(dedup.dedup_batch(few, index, 2, 1)[1]) == [("y1", "x00007")]


def test_dedup_hot_group_and_chain(spark):
    docs = [(f"h{i:03}", i, "hot", None, False, None, None, None) for i in range(300)]
    # each shares two readings with the next only: every second is accepted
    docs += [(f"z{i:03}", 1000 + i, None, None, False, f"a{i // 2}", f"b{(i + 1) // 2}", "c") for i in range(20)]
    won, repeats = dedup.dedup_batch(dedup_features(spark, docs), dedup.key_index(spark, new_path(spark, "test")), 2, 0)
    assert rows(repeats)[:299] == [(f"h{i:03}", "h000") for i in range(1, 300)]
    assert [r for r in sorted(x[0] for x in won.collect()) if r[0] == "z"] == [f"z{i:03}" for i in range(0, 20, 2)]


def test_file_names(spark):
    names = ["factura_1.pdf", "FACTURA 1.PDF", "Copia de factura_1 (2).pdf", "factura_1_copia.pdf", "factura_1 - copia.Pdf", "factura_1_v3.pdf", "Copia de Copia de factura_1 v2.pdf", "factura_1_copy.pdf"]
    other = ["papelería.pdf", "papelería.PDF", None, "", "factura_12.pdf", "recopia.pdf"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names + other)], "i int, n string").orderBy("i")
    got = [r[0] for r in df.select(dedup.file_name(F.col("n"))).collect()]
    assert set(got[: len(names)]) == {"factura1.pdf"} and got[8] == got[9] and got[10:] == [None, None, "factura12.pdf", "recopia.pdf"]


# --- survivors

ERP = "g string, at long, s string, i int, v string, w string, field string"


def test_survivors(spark):
    data = [
        ("a", 5, "s1", 1, "x", None, "clash"), ("a", 9, "s1", 2, None, None, ""), ("a", 7, "s1", 3, "y", "q", ""), ("a", 7, "s1", 3, "y", "q", ""),
        ("b", None, "s1", 1, "late", None, ""), ("b", None, "s2", 1, "early", None, ""), ("c", 1, "s1", 1, "x", "x", ""), (None, 1, "s1", 1, "x", "x", ""), (None, 2, "s1", 1, "x", "x", ""),
    ]
    df = spark.createDataFrame(data, ERP)
    fields = {"v": (F.col("v").isNotNull(), "v"), "w": (F.col("w").isNotNull(), "w")}
    got = rows(survivor.survivors(df, "g", fields, [], "at", ["s", "i"]).select("g", "field", "value", "s", "i"))
    assert got == [("a", "v", "y", "s1", 3), ("a", "w", "q", "s1", 3), ("b", "v", "early", "s2", 1)]
    order = spark.createDataFrame([("v", "early", 0), ("v", "late", 1)], "field string, value string, depth int")
    got = rows(survivor.survivors(df, "g", fields, [], "at", ["s", "i"], order).select("g", "field", "value"))
    assert ("b", "v", "late") in got and ("a", "v", "y") in got
    assert survivor.survivors(df.limit(0), "g", fields, [], "at", ["s", "i"]).count() == 0


def test_learned_precedence(spark):
    steps = ["open", "held", "paid"]
    data = [(f"g{k}", t, "s", t, v, None, "") for k in range(5) for t, v in enumerate(steps)] + [("odd", 1, "s", 1, "paid", None, ""), ("odd", 2, "s", 2, "open", None, ""), ("n", None, "s", 1, "zz", None, "")]
    got = {r["value"]: r["depth"] for r in survivor.learned_precedence(spark.createDataFrame(data, ERP), "g", "at", {"v": "v"}, ["s", "i"]).collect()}
    assert got["open"] < got["held"] < got["paid"] and "zz" not in got
    assert survivor.learned_precedence(spark.createDataFrame([], ERP), "g", "at", {"v": "v"}, ["s", "i"]).count() == 0


# --- look-alikes


def canon(spark, texts):
    df = spark.createDataFrame([(t, "clash", 1) for t in texts], "text string, canon string, pos int")
    return {r[0]: r[1] for r in lookalike.canonical(spark, df, "text").collect()}


def test_canonical(spark):
    same = {
        "Tοtal 125.09 ΕUR": "Total 125.09 EUR", "Ｔｏｔａｌ": "Total", "Impr⁠esión": "Impresión", "a\xa0b c　d\te": "a b c d e", "PO‐1−2–3": "PO-1-2-3", "й": "й", "​": "", "": "", "­x​": "x",
        "ế": "ế", "ế": "ế", "q̣̇": unicodedata.normalize("NFC", "q̣̇"), "q̣̇": unicodedata.normalize("NFC", "q̣̇"), "á": "á", "😀a️": "😀a", "plain text": "plain text", "line\nbreak": "line\nbreak", "́x": "́x",
    }
    got = canon(spark, [*same, None, *same])
    assert got == same
    different = ["Total", "total", "Tota1", "T0tal", "Tótal", "To tal", "x²", "x2", "nº", "no"]
    assert len(set(canon(spark, different).values())) == len(different)


def test_letters_of_other_scripts(spark):
    pairs = "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX ҮY ԚQ ԜW ԌG аa сc ԁd еe һh іi јj оo рp ѕs хx уy ԛq ԝw ѵv ѴV ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp ᎪA ꓐB ɡg ⅠI ⅼl 𝙰A 𝐀A օo հh ոn սu ՕO".split()
    got = canon(spark, [p[0] for p in pairs])
    assert [p for p in pairs if got[p[0]] != p[1]] == []
    stay = "ßжøıſçñدא가ﬁ²ªºÆ"
    assert [c for c in stay if canon(spark, [c])[c] != c] == []


def test_canonical_agrees_with_unicode_and_holds_long_text(spark):
    rng = random.Random(2)
    pool = "abcȩ̣́́̈ñŐ가힣A"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    got = canon(spark, texts)
    assert {t: c for t, c in got.items() if unicodedata.normalize("NFC", t) != c} == {}
    long = "Pаgo é" * 50_000
    assert canon(spark, [long])[long] == "Pago é" * 50_000


def test_same_look(spark):
    pairs = spark.createDataFrame([("1", "а", "a"), ("2", "a", "a"), ("3", None, "a"), ("4", "b", "a"), ("5", "", "​"), ("1", "а", "a")], "canon_a string, a string, b string")
    assert [r[0] for r in rows(lookalike.same_look(spark, pairs).select("canon_a"))] == ["1", "1", "5"]
    assert lookalike.same_look(spark, pairs.limit(0)).count() == 0


# --- leakage


def test_index_against_search():
    rng = np.random.default_rng(3)
    for n, alphabet in ((1, 3), (50, 2), (400, 5), (3000, 40)):
        s = rng.integers(1, alphabet + 1, n)
        index = leakage.FMIndex(s, alphabet)
        for length in (1, 2, 3):
            phrases = np.unique(rng.integers(1, alphabet + 1, (20, length)), axis=0)
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases, lo, hi, strict=True):
                want = [i for i in range(n - length + 1) if (s[i : i + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_leaked_spans(spark):
    item = "Uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece"
    docs = [
        (1, f"intro {item.upper().replace(' ', ', ')} fin"), (2, "x " + " ".join(item.split()[:11]) + " y"), (3, None), (4, ""), (5, "Ｕｎｏ dos tres cua​tro cinco seis siete ocho nuéve diez once doce"),
        (6, f"{item} relleno {item}"), (None, item), (7, "z " * 200_000 + item), (6, f"{item} relleno {item}"),
    ]
    corpus = spark.createDataFrame([(*d, 9) for d in docs], "id long, body string, item_id int")
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "corto"), (None, item)], "n int, t string")
    got = set(rows(leakage.leaked_spans(corpus, "id", "body", items, "n", "t")))
    assert got == {(d, i, a, b) for i in (1, 2) for d, a, b in ((1, 1, 13), (5, 0, 11), (6, 0, 12), (6, 14, 26), (7, 200_000, 200_012))}
    assert leakage.leaked_spans(corpus, "id", "body", items.limit(0), "n", "t").count() == 0
    assert leakage.leaked_spans(corpus.limit(0), "id", "body", items, "n", "t").count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_PHRASES", 1)
    built, build = [], leakage.shard_index
    monkeypatch.setattr(leakage, "shard_index", lambda *a: built.append(1) or build(*a))
    a, b = "a b c d", "e f g h"
    corpus = spark.createDataFrame([(1, f"{a} {b}")], "id long, body string")
    items = spark.createDataFrame([("x", a), ("y", b)], "n string, t string")
    assert rows(leakage.leaked_spans(corpus, "id", "body", items, "n", "t", n_words=4)) == [(1, "x", 0, 3), (1, "y", 4, 7)]
    assert built == [1]


def test_suffix_array():
    rng = np.random.default_rng(6)
    for n, alphabet in ((1, 1), (2, 1), (200, 1), (500, 2), (900, 70_000)):
        s = np.append(rng.integers(1, alphabet + 1, n), 0)
        assert leakage.suffix_array(s).tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
    s = np.append(np.tile(rng.integers(1, 9, 300), 3), 0)
    assert leakage.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


# --- mixing


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, "big", rng.randint(1, 300)) for i in range(4000)] + [(10_000 + i, "small", rng.randint(1, 50)) for i in range(50)] + [(20_000, None, 5), (20_001, "big", None), (20_002, "big", 0), (None, "big", 7), (20_003, "other", 9)]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "id long, source string, n_tokens int, copies double")
    targets = spark.createDataFrame([("big", 0.7, 2), ("small", 0.2, 4), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    selection, report = mixture.mixed(df, "id", targets, meet_all=True)
    r = {x["source"]: x for x in report.collect()}
    assert r["gone"]["absent"] and r["gone"]["tokens"] == 0
    assert abs(r["big"]["tokens"] / r["small"]["tokens"] - 3.5) < 0.02 and r["small"]["most_repeats"] == 4
    assert selection.filter("repeats < 1 OR id IS NULL").count() == 0 and selection.groupBy("id").count().filter("count > 1").count() == 0
    total = {x["source"]: x["t"] for x in selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).collect()}
    assert total == {k: v["tokens"] for k, v in r.items() if v["tokens"]}
    short = {x["source"]: x for x in mixture.mixed(df, "id", targets, 10_000_000)[1].collect()}
    assert short["big"]["exhausted"] and short["big"]["tokens"] == 2 * short["big"]["available_tokens"]
    assert mixture.mixed(df.limit(0), "id", targets)[0].count() == 0


def test_gaps_close_until_no_copy_helps(spark):
    rng = random.Random(5)
    docs = [(i, s, rng.choice([3, 7, 50, 120, 121, 400]), g, 3, rng.randint(0, 3)) for s, g in (("a", 20_011.0), ("b", 19_000.5), ("c", 60.0)) for i in range(ord(s) * 1000, ord(s) * 1000 + 60)]
    df = spark.createDataFrame(docs, "id long, source string, n_tokens int, goal_tokens double, max_repeats int, repeats int")
    for ladder in (mixture.LADDER, 10**12, 50):
        got = mixture.closed(df, "id", ladder).collect()
        assert len(got) == len(docs) and all(0 <= r["repeats"] <= 3 for r in got)
        for s in "abc":
            own = [r for r in got if r["source"] == s]
            gap = own[0]["goal_tokens"] - sum(r["n_tokens"] * r["repeats"] for r in own)
            assert not [r for r in own if gap > 0 and r["repeats"] < 3 and abs(gap - r["n_tokens"]) < gap or gap < 0 and r["repeats"] > 0 and abs(gap + r["n_tokens"]) < -gap]
    assert mixture.closed(df.limit(0), "id").count() == 0


# --- pieces


def check_overlaps(e, text, ps, overlap):
    """Each piece repeats so many tokens, or the fewest above that where no start gives just these."""
    count = lambda a, b: len(e.encode_ordinary(text[a:b]))
    for p in ps[1:]:
        n = count(p["start_char"], p["new_char"])
        if n != overlap and p["start_char"] > 0:
            assert n > overlap and all(count(k, p["new_char"]) != overlap for k in range(p["start_char"], p["start_char"] + 40))


def test_time_of_pieces_grows_with_the_text():
    import time

    def seconds(n):
        text, best = "Una frase con palabras, y otra. " * n, 9.0
        for _ in range(3):
            began = time.process_time()
            t = pieces._Text(text, tokens.encoding())
            pieces.overlapped(t, pieces.bisected(t, 1920), 2048, 128)
            t.characters()
            best = min(best, time.process_time() - began)
        return best

    assert seconds(40_000) < 3 * seconds(20_000)


def test_pieces_of_awkward_texts(spark):
    texts = ["", None, "corto", "palabra " * 3000, "x" * 9000, "é" * 6000, "漢字" * 3000, "😀" * 2000, ("Una frase. " * 30 + "\n\n") * 20, "\n" * 9000, "a, b; c! " * 1500]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, body string, text string")
    by = {}
    for r in pieces.pieces(df, "id", "body", limit=300, overlap=20).collect():
        by.setdefault(r["doc_id"], []).append(r)
    e = tokens.encoding()
    assert set(by) == {i for i, t in enumerate(texts) if t and len(e.encode_ordinary(t)) > 300}
    for i, ps in by.items():
        ps.sort(key=lambda r: r["piece"])
        assert "".join(p["text"][p["new_char"] - p["start_char"] :] for p in ps) == texts[i]
        for p in ps:
            assert p["text"] == texts[i][p["start_char"] : p["end_char"]] and len(e.encode_ordinary(p["text"])) == p["n_tokens"] <= 300
        check_overlaps(e, texts[i], ps, 20)
    ends = [p["text"][-2:] for p in by[8][:-1]]
    assert set(ends) <= {"\n\n", ". "} and "\n\n" in ends


def test_token_counts(spark):
    df = spark.createDataFrame([("a b", 1), ("", 2), (None, 3), ("<|endoftext|>", 4)], "t string, n int")
    got = [r["n_tokens"] for r in tokens.with_token_counts(df, "t").orderBy("n").collect()]
    assert got[0] == 2 and got[1] == 0 and got[2] is None and got[3] > 1
