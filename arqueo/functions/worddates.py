"""Dates whose day, month or year is written in words, in seven languages, and the language that they are written in.

The words are made by each language's rules from its basic numbers, without accents, as text is folded before it is compared.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo.functions.identity import fold
from arqueo.functions.text import trimmed
from arqueo.functions.times import barrier

#: In order of preference, where a date's words belong to several.
LANGUAGES = ["es", "ca", "pt", "it", "fr", "de", "en"]
# Month names, January first.
MONTHS = {
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre|setiembre octubre noviembre diciembre",
    "ca": "gener febrer marc abril maig juny juliol agost setembre octubre novembre desembre",
    "pt": "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "fr": "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre",
    "de": "januar februar marz april mai juni juli august september oktober november dezember",
    "en": "january|jan february|feb march|mar april|apr may june|jun july|jul august|aug september|sep|sept october|oct november|nov december|dec",
}
# The numbers from one on that a language forms by no rule.
_BASIC = {
    "es": "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince",
    "ca": "un dos tres quatre cinc sis set vuit nou deu onze dotze tretze catorze quinze setze disset divuit dinou vint",
    "pt": "um dois tres quatro cinco seis sete oito nove dez onze doze treze catorze quinze",
    "it": "uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove venti",
    "fr": "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize",
    "de": "ein zwei drei vier funf sechs sieben acht neun zehn elf zwolf",
    "en": "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty",
}
_ORDINALS = {
    "es": "primero segundo tercero cuarto quinto sexto septimo octavo noveno decimo undecimo duodecimo",
    "pt": "primeiro segundo terceiro quarto quinto sexto setimo oitavo nono decimo",
    "it": "primo secondo terzo quarto quinto sesto settimo ottavo nono decimo",
}
#: Years that may be written in words.
YEARS = range(2024, 2028)


def _numbers(language: str) -> dict[int, list[str]]:
    """The cardinals from 1 to 31."""
    b = _BASIC[language].split()
    n = {i + 1: [w] for i, w in enumerate(b)}
    one = lambda k: b[k - 1]
    if language == "es":
        n |= {k: ["dieci" + one(k - 10)] for k in range(16, 20)} | {20: ["veinte"]} | {k: ["veinti" + one(k - 20)] for k in range(21, 30)} | {30: ["treinta"], 31: ["treinta y uno"]}
    elif language == "ca":
        n |= {k: ["vint-i-" + one(k - 20)] for k in range(21, 30)} | {30: ["trenta"], 31: ["trenta-un"]}
        n |= {k: [*n[k], n[k][0][:-1]] for k in (1, 21, 31)}
    elif language == "pt":
        n |= {16: ["dezesseis", "dezasseis"], 17: ["dezessete", "dezassete"], 18: ["dezoito"], 19: ["dezenove", "dezanove"], 20: ["vinte"], 30: ["trinta"], 31: ["trinta e um"]}
        n |= {14: ["catorze", "quatorze"]} | {k: ["vinte e " + one(k - 20)] for k in range(21, 30)}
    elif language == "it":
        n |= {k: [("vent" if k in (21, 28) else "venti") + one(k - 20)] for k in range(21, 30)} | {30: ["trenta"], 31: ["trentuno"]}
    elif language == "fr":
        n |= {k: ["dix-" + one(k - 10)] for k in range(17, 20)} | {20: ["vingt"]} | {k: ["vingt-" + one(k - 20)] for k in range(22, 30)} | {30: ["trente"]}
        n |= {k: [f"{n[k - 1][0]} et un", f"{n[k - 1][0]}-et-un"] for k in (21, 31)}
    elif language == "de":
        stem = {6: "sech", 7: "sieb"}
        n |= {k: [stem.get(k - 10, one(k - 10)) + "zehn"] for k in range(13, 20)} | {20: ["zwanzig"]} | {k: [one(k - 20) + "undzwanzig"] for k in range(21, 30)} | {30: ["dreissig"], 31: ["einunddreissig"]}
    else:
        n |= {k: ["twenty-" + one(k - 20)] for k in range(21, 30)} | {30: ["thirty"], 31: ["thirty-one"]}
    return n


def _ordinals(language: str, n: dict[int, list[str]]) -> dict[int, list[str]]:
    o = {i + 1: [w] for i, w in enumerate(_ORDINALS.get(language, "").split())}
    if language in ("es", "pt"):
        joint = "" if language == "es" else " "
        first = 13 if language == "es" else 11
        o |= {k: [f"decimo{joint}{o[k - 10][0]}"] for k in range(first, 20)} | {20: ["vigesimo"]} | {k: [f"vigesimo {o[k - 20][0]}"] for k in range(21, 30)} | {30: ["trigesimo"], 31: [f"trigesimo {o[1][0]}"]}
        if language == "es":
            o |= {1: ["primero", "primer"], 3: ["tercero", "tercer"]}
    elif language == "it":
        o |= {k: [(w if w.endswith(("tre", "sei")) else w[:-1]) + "esimo"] for k, (w, *_) in n.items() if k > 10}
    elif language == "ca":
        stems = {5: "cinqu", 9: "nov", 10: "des"}
        o |= {1: ["primer"], 2: ["segon"], 3: ["tercer"], 4: ["quart"]} | {k: [(w[: -len(n[k % 20][0])] + stems[k % 20] if k % 20 in stems and k < 30 else w.removesuffix("e").removesuffix("a") if k < 31 else w) + "e"] for k, (w, *_) in n.items() if k > 4}
    elif language == "fr":
        o |= {k: [w.removesuffix("e").removesuffix("f") + ("v" if w.endswith("neuf") else "u" if w.endswith("cinq") else "") + "ieme" for w in ws if "-et-" not in w] for k, ws in n.items()} | {1: ["premier"]}
        o[2].append("second")
    elif language == "de":
        special = {1: ["erst"], 3: ["dritt"], 7: ["siebt", "siebent"], 8: ["acht"]}
        o |= {k: [s + e for s in special.get(k, [w + ("t" if k < 20 else "st")]) for e in ("e", "en")] for k, (w, *_) in n.items()}
    else:
        special = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
        def ordinal(w: str) -> str:
            head, dash, tail = w.rpartition("-")
            return head + dash + (special.get(tail) or (tail[:-1] + "ieth" if tail.endswith("y") else tail + "th"))
        o |= {k: [ordinal(w)] for k, (w, *_) in n.items()}
    return o


def _years(language: str, n: dict[int, list[str]]) -> dict[int, list[str]]:
    lead = {"es": ["dos mil "], "ca": ["dos mil "], "pt": ["dois mil e ", "dois mil "], "it": ["duemila"], "fr": ["deux mille "], "de": ["zweitausend"], "en": ["two thousand ", "two thousand and "]}
    return {y: [a + w for a in lead[language] for w in n[y - 2000]] for y in YEARS}


@cache
def tables() -> tuple[dict[str, tuple[int, str]], ...]:
    """Words of days, months and years, each with its number and the languages that have it. A word of two numbers is an error."""
    out: list[dict[str, tuple[int, str]]] = [{}, {}, {}]
    for language in LANGUAGES:
        n = _numbers(language)
        days = {k: [*ws, *_ordinals(language, n).get(k, [])] for k, ws in n.items()}
        if language == "de":
            days[1].append("eins")
        months = {i + 1: ws.split("|") for i, ws in enumerate(MONTHS[language].split())}
        for table, source in zip(out, (days, months, _years(language, n)), strict=True):
            for number, ws in source.items():
                for w in ws:
                    if table.get(w, (number,))[0] != number:
                        raise ValueError(f"{w} is {number} and {table[w][0]}")
                    known = table.get(w, (number, ""))[1].split()
                    table[w] = (number, " ".join(dict.fromkeys([*known, language])))
    return tuple(out)


def _any(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


@cache
def _pattern() -> str:
    """Day, month and year in folded text, with articles and elisions before and between."""
    days, months, years = tables()
    article, between = r"(?:el|le|am|the|of|de|del|den)[\s,]+", r"(?:[\s,]+|[\s,]*(?=[dl]'))"
    lead = rf"(?:{article}|[dl]'[\s,]*)*"
    return rf"^{lead}({_any(days)}|\d{{1,2}}){between}{lead}({_any(months)}){between}{lead}({_any(years)}|\d{{4}})$"


def _lookup(table: dict[str, tuple[int, str]], i: int) -> Column:
    pairs = [F.lit(x) for w, v in table.items() for x in (w, str(v[i]))]
    return F.create_map(*pairs)


def _valid(y: Column, m: Column, d: Column) -> Column:
    """The date of three numbers, or null."""
    text = F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), text.try_cast("date"))


def with_invoice_date(df: DataFrame, c: Column, prefix: str) -> DataFrame:
    """Adds ``{prefix}_date`` and ``{prefix}_language`` (null for a date in digits) to df. Digits: yyyy-m-d, or d, m, yyyy parted by one of / - . everywhere; else
    words (day and year may be digits). Anything else, and days that don't exist, give a null date; null gives nulls."""
    p = f"__{prefix}_"
    v = lambda k: F.col(p + k)
    days, months, years = tables()
    iso, own = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$"
    x = df.withColumn(p + "s", barrier(trimmed(c)))
    x = x.withColumn(p + "f", barrier(F.when(v("s").rlike(r"\p{L}{3}") & v("s").rlike(r"[\s\p{Z},'’]"), fold(v("s")))))
    # The pattern runs once, where a month's name may stand.
    x = x.withColumn(p + "m", barrier(F.regexp_replace(v("f"), _pattern(), "\u0001$1\u0002$2\u0002$3")))
    x = x.withColumn(p + "w", barrier(F.when(v("m").startswith("\u0001"), F.split(F.substr(v("m"), F.lit(2)), "\u0002"))))
    x = x.withColumns({p + k: barrier(F.get(v("w"), F.lit(i))) for i, k in enumerate(("d", "mo", "y"))})
    number = lambda t, w: F.coalesce(F.try_element_at(_lookup(t, 0), w), F.when(w.rlike(r"^\d+$"), w))
    part = lambda pattern, i: F.nullif(F.regexp_extract(v("s"), pattern, i), F.lit(""))
    digits = F.when(v("s").rlike(iso), _valid(part(iso, 1), part(iso, 2), part(iso, 3))).when(v("s").rlike(own), _valid(part(own, 4), part(own, 3), part(own, 1)))
    x = x.withColumn(p + "words", barrier(_valid(number(years, v("y")), number(months, v("mo")), number(days, v("d")))))
    x = x.withColumns({p + "digits": barrier(digits), **{p + "l" + k: barrier(F.split(F.try_element_at(_lookup(t, 1), v(k)), " ")) for t, k in ((days, "d"), (months, "mo"), (years, "y"))}})
    # Other words narrow the month's languages down, unless they share none with it.
    for k in ("ld", "ly"):
        x = x.withColumn(p + "lmo", barrier(F.when(F.coalesce(F.arrays_overlap(v("lmo"), v(k)), F.lit(False)), F.array_intersect(v("lmo"), v(k))).otherwise(v("lmo"))))
    first = F.get(F.filter(F.array(*map(F.lit, LANGUAGES)), lambda l: F.array_contains(v("lmo"), l)), F.lit(0))
    x = x.withColumns({f"{prefix}_date": barrier(F.coalesce(v("digits"), v("words"))), f"{prefix}_language": barrier(F.when(v("words").isNotNull(), first))})
    return x.drop(*[n for n in x.columns if n.startswith(p)])


def with_tolerant_date(df: DataFrame, c: Column, prefix: str) -> DataFrame:
    """Adds ``{prefix}_date``, the date of a text with a month's name anywhere: that of ``with_invoice_date`` if it reads one; else the longest day in words within
    what stands before the first month, or digits there, and a year from 2000 on in digits or words behind it. Days that don't exist give null."""
    p = f"__{prefix}_"
    v = lambda k: F.col(p + k)
    days, months, years = tables()
    x = with_invoice_date(df, c, f"{p}i").drop(f"{p}i_language")
    names = F.create_map(*[F.lit(y) for w, n in months.items() for y in (w, n[0])])
    x = x.withColumn(p + "f", barrier(F.when(F.col(f"{p}i_date").isNull() & c.rlike(r"\p{L}{3}"), fold(c))))
    x = x.withColumn(p + "mo", barrier(F.get(F.filter(F.regexp_extract_all(v("f"), F.lit(r"\b([a-z]+)\b"), F.lit(1)), lambda w: F.map_contains_key(names, w)), F.lit(0))))
    x = x.withColumn(p + "at", barrier(F.regexp_instr(v("f"), F.concat(F.lit(r"\b"), v("mo"), F.lit(r"\b")))))
    x = x.withColumns({p + "before": barrier(F.substr(v("f"), F.lit(1), v("at") - 1)), p + "after": barrier(F.substr(v("f"), v("at") + F.length(v("mo"))))})

    def inside(k: str, table: dict[str, tuple[int, str]]) -> Column:
        flat = {"".join(ch for ch in w if ch.isalnum()): n[0] for w, n in table.items()}
        ws = sorted((w for w in flat if len(w) > 1), key=lambda w: (-len(w), w))
        # The longest word stands first in the alternation, so of those that begin at one place it is found; the longest of all found counts.
        found = F.regexp_extract_all(F.regexp_replace(v(k), "[^a-z0-9]", ""), F.lit(f"(?=({'|'.join(ws)}))"), F.lit(1))
        longest = F.get(F.array_sort(F.transform(found, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
        return F.try_element_at(F.create_map(*[F.lit(y) for w in ws for y in (w, flat[w])]), longest)

    digits = lambda k, pattern: F.nullif(F.regexp_extract(v(k), pattern, 1), F.lit("")).cast("int")
    x = x.withColumns({p + "day": barrier(F.coalesce(inside("before", days), digits("before", r"(\d{1,2})"))), p + "year": barrier(F.coalesce(digits("after", r"\b(20\d{2})\b"), inside("after", years)))})
    x = x.withColumn(f"{prefix}_date", barrier(F.coalesce(f"{p}i_date", F.when(v("mo").isNotNull(), _valid(v("year"), F.try_element_at(names, v("mo")), v("day"))))))
    return x.drop(*[n for n in x.columns if n.startswith(p)])
