"""Visually identical text in one form."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arqueo.session import written

#: Code points from the first to the last that can have a decomposition or a look-alike, or be invisible.
FIRST, LAST = 0x80, 0xE0200


@cache
def _shapes(spark: SparkSession) -> dict[str, str]:
    """Letters that have the shape of an ASCII letter, and that letter: by rule from the confusables table of Unicode Technical Standard 39.

    The ICU library that Spark ships holds that table and gives the prototype of each character; one call asks for all letters.
    A letter of another script than Latin (or a Latin one in script style) goes to the ASCII letter of the same prototype
    and letter case, or of the prototype's own case if it has none. Letters that run from right to left, modifiers, Hangul letters,
    which compose to syllables, and letters of which only another case looks alike stay.
    """
    of = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
    ascii_letters = [chr(i) for i in range(0x41, 0x7B) if chr(i).isalpha()]
    by_prototype: dict[str, list[str]] = {}
    for c, p in zip(ascii_letters, of("\n".join(ascii_letters)).split("\n"), strict=True):
        by_prototype.setdefault(p, []).append(c)
    others = []
    for i in range(FIRST, 0x20000):
        c = chr(i)
        name = unicodedata.name(c, "")
        if unicodedata.category(c) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c) and not name.startswith(("CJK", "HANGUL")) and unicodedata.bidirectional(c) == "L":
            if not name.startswith("LATIN") or " SCRIPT " in name:
                others.append(c)
    out = {"Ԛ": "Q"}  # whose small form alone is in the table
    for c, p in zip(others, of("\n".join(others)).split("\n"), strict=True):
        like = by_prototype.get(p, [])
        if unicodedata.category(c) == "Lo":
            like = [x for x in like if x == p] or like
        else:
            like = [x for x in like if x.isupper() == c.isupper()]
        if like:
            out[c] = like[0]
    return out


@cache
def mapping(spark: SparkSession) -> list[tuple[int, int, int, str]]:
    """(code point, place in its decomposition, combining class, character) of every code point that isn't itself.

    Made by rule from the Unicode data: canonical decompositions, full- and half-width, font and no-break forms, Roman numerals, spaces and
    dashes of all kinds, look-alike letters; invisible characters decompose into nothing (an empty string). Superscripts, ligatures and other
    compatibility forms look different and stay. Hangul is composed by rule elsewhere. Some thousand rows, as many as Unicode has.
    """
    shapes = _shapes(spark)
    spaces = {i for i in range(0x3100) if unicodedata.category(chr(i)) == "Zs" or chr(i) in "\t\x0b\x0c\x85"} | {0x2800}
    dashes = {0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2043, 0x2212, 0x02D7, 0xFE58, 0xFE63, 0xFF0D, 0x2796}
    fillers = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

    def expand(ch: str) -> str:
        i = ord(ch)
        if i in fillers or unicodedata.category(ch) == "Cf" or (unicodedata.category(ch) == "Cc" and ch not in "\t\n\r\x0b\x0c\x85"):
            return ""
        if i in spaces:
            return " "
        if i in dashes:
            return "-"
        if ch in shapes:
            return shapes[ch]
        d = unicodedata.decomposition(ch)
        if d.startswith(("<wide>", "<narrow>", "<noBreak>", "<font>")) or d.startswith("<compat>") and unicodedata.category(ch) == "Nl":
            return "".join(expand(chr(int(x, 16))) for x in d.split()[1:])
        if d and not d.startswith("<"):
            return "".join(expand(chr(int(x, 16))) for x in d.split())
        return ch

    out = []
    for i in range(FIRST, LAST):
        if 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4:
            continue
        e = expand(chr(i))
        if e != chr(i):
            out += [(i, j, unicodedata.combining(c), c) for j, c in enumerate(e)] or [(i, 0, 0, "")]
    out += [(i, 0, 0, "") for i in range(0x20) if chr(i) not in "\t\n\r\x0b\x0c"] + [(0x7F, 0, 0, "")] + [(ord(c), 0, 0, " ") for c in "\t\x0b\x0c"]
    # Marks that stand for themselves, for their class.
    mapped = {x[0] for x in out}
    return out + [(i, 0, unicodedata.combining(chr(i)), chr(i)) for i in range(0x300, 0x1E000) if unicodedata.combining(chr(i)) and i not in mapped]


@cache
def compositions() -> list[tuple[str, str]]:
    """Starter with one mark, and the character that they compose to; chains compose step by step."""
    out = []
    for i in range(0xA0, 0x3100):
        d = unicodedata.decomposition(chr(i))
        if d and not d.startswith("<") and len(d.split()) == 2 and unicodedata.normalize("NFC", chr(i)) == chr(i):
            a, b = (chr(int(x, 16)) for x in d.split())
            if unicodedata.combining(b):
                out.append((a + b, chr(i)))
    return out


#: Text of printable ASCII only, whose look is its own.
PLAIN = r"^[ -~\n\r]*$"


def canonical(spark: SparkSession, texts: DataFrame, column: str) -> DataFrame:
    """column and canon of each distinct text: texts that look the same have the same canon.

    Each text that isn't plain ASCII is exploded into positioned code points. A broadcast join maps each to its decomposition,
    look-alike letter, plain space or hyphen, or to nothing; marks are put in order of their class, stably, behind their base; base
    and marks are composed again; and the characters are joined. One shuffle: the distinct texts are partitioned by digest, and
    all that follows keeps that partitioning; a text of any length is rebuilt by one task. Null is no text and gives no row; the empty text is its own canon, as is text
    of invisible characters only. Letter case, missing accents, the number of blanks and digits for letters stay different.
    """
    table = F.broadcast(spark.createDataFrame(mapping(spark), "cp int, j int, ccc int, ch string"))
    x = texts.select(F.unhex(F.md5(F.col(column))).alias("key"), F.col(column).alias("text")).filter(F.col("text").isNotNull())
    x = x.groupBy("key").agg(F.first("text").alias("text"))
    # Splitting at every place keeps surrogate pairs together. Plain text stays one piece. The key stands for the text, of which
    # each code point would else carry a copy.
    pieces = F.when(F.col("text").rlike(PLAIN), F.array("text")).otherwise(F.split("text", ""))
    points = x.select("key", F.posexplode(pieces).alias("pos", "c"))
    mapped = points.join(table, (F.col("cp") == F.ascii("c")) & (F.length("c") == 1), "left")
    mapped = mapped.select("key", "pos", F.coalesce("j", F.lit(0)).alias("j"), F.coalesce("ccc", F.lit(0)).alias("ccc"), F.coalesce("ch", "c").alias("ch")).filter("ch <> ''")
    base = F.count_if(F.col("ccc") == 0).over(Window.partitionBy("key").orderBy("pos", "j"))
    clusters = mapped.select("key", base.alias("base"), "pos", "j", "ccc", "ch").groupBy("key", "base").agg(
        F.coalesce(F.max(F.when(F.col("ccc") == 0, F.col("ch"))), F.lit("")).alias("head"),
        F.sort_array(F.collect_list(F.when(F.col("ccc") > 0, F.struct("ccc", "pos", "j", "ch")))).alias("marks"),
    )
    whole = clusters.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("base", _recomposed().alias("s")))), lambda c: c["s"]), "").alias("canon"))
    return x.join(whole, "key", "left").select(F.col("text").alias(column), _syllables(F.coalesce("canon", F.lit(""))).alias("canon"))


def _syllables(c: Column) -> Column:
    """Letters of Hangul composed to syllables, by rule."""
    final = r"[\x{11A8}-\x{11C2}]"
    pieces = F.regexp_extract_all(c, F.lit(rf"[\x{{1100}}-\x{{1112}}][\x{{1161}}-\x{{1175}}]{final}?|[\x{{AC00}}-\x{{D7A3}}]{final}|(?s:.)"), F.lit(0))

    def one(p: Column) -> Column:
        at = lambda k: F.ascii(F.substring(p, k, 1))
        letters = 0xAC00 + ((at(1) - 0x1100) * 21 + at(2) - 0x1161) * 28 + F.when(F.length(p) == 3, at(3) - 0x11A7).otherwise(0)
        syllable = F.when(at(1) < 0xAC00, letters).when((at(1) - 0xAC00) % 28 == 0, at(1) + at(2) - 0x11A7)
        return F.when(F.length(p) == 1, p).otherwise(F.coalesce(F.decode(F.unhex(F.hex(syllable)), "UTF-16BE"), p))

    return F.when(c.rlike(r"[\x{1161}-\x{1175}\x{11A8}-\x{11C2}]"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def _recomposed() -> Column:
    """head with the marks that compose with it, in order, and behind it those that don't."""
    table = F.expr("map(" + ",".join(f"'{a}','{b}'" for a, b in compositions()) + ")")
    start = F.struct(F.col("head").alias("head"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc: Column, m: Column) -> Column:
        both = F.when((acc["rest"] == "") | (acc["last"] < m["ccc"]), F.element_at(table, F.concat(acc["head"], m["ch"])))
        return F.struct(F.coalesce(both, acc["head"]).alias("head"), F.when(both.isNull(), F.concat(acc["rest"], m["ch"])).otherwise(acc["rest"]).alias("rest"), F.when(both.isNull(), m["ccc"]).otherwise(acc["last"]).alias("last"))

    return F.when(F.size("marks") == 0, F.col("head")).otherwise(F.aggregate("marks", start, step, lambda acc: F.concat(acc["head"], acc["rest"])))


def same_look(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """The rows of pairs (columns a, b and any others) whose a and b differ as strings but look the same. Null is unlike all."""
    odd = pairs.filter("a <> b")
    distinct = written(odd.select("a", "b").distinct(), "pairs")
    canon = written(canonical(spark, distinct.select(F.col("a").alias("text")).union(distinct.select("b")), "text"), "canon")
    a, b = (canon.select(F.col("text").alias(k), F.col("canon").alias(f"canon_{k}")) for k in "ab")
    same = distinct.join(a, "a").join(b, "b").filter("canon_a = canon_b").select("a", "b")
    return odd.join(same, ["a", "b"], "left_semi")
