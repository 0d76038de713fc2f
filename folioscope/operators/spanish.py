"""Spanish stems by the published Snowball algorithm, over distinct words and in the JVM.

A word has three regions: RV, R1 and R2, each from a place to its end. A step looks for the longest of its suffixes and
drops or replaces it where it lies in the region that the rule names. Fixed values: vowels and suffixes as published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_V, _C = "[aeiouáéíóúü]", "[^aeiouáéíóúü]"
_PRONOUNS = "me se sela selo selas selos la le lo las les los nos"
_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
_AGENT = "adora ador ación adoras adores aciones ante antes ancia ancias"
_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
_E_VERBS = "en es éis emos"
_VERBS = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré
aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis
ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"""
_REST = "os a o á í ó e é"
_STEP1 = {_PLAIN: "", _AGENT: "agent", "logía logías": "log", "ución uciones": "u", "encia encias": "ente", "amente": "amente", "mente": "mente", "idad idades": "idad", "iva ivo ivas ivos": "iva"}


def _longest(word: Column, *lists: str) -> Column:
    """The longest suffix of the lists that the word ends with, or an empty string: an anchored search finds the one that begins first."""
    return F.regexp_extract(word, "(" + "|".join(x for some in lists for x in some.split()) + ")$", 1)


def _after(pattern: str, word: Column) -> Column:
    """The place behind a match at the word's begin, or the word's length."""
    match = F.regexp_extract(word, f"^({pattern})", 1)
    return F.when(match == "", F.length(word)).otherwise(F.length(match))


def _is(suffix: Column, words: str) -> Column:
    return suffix.isin(*words.split())


def _cut(word: Column, suffix: Column) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - F.length(suffix))


def spanish_stems(words: DataFrame, word: str = "lexeme") -> DataFrame:
    """``words`` with ``stem``. Words are in lower case with their accents; other letters count as consonants. Null gives null. Give it distinct words: postings are joined to their stems by word."""
    w, s, size = F.col("_w"), F.col("_s"), F.length("_w")
    df = words.withColumn("_w", F.col(word))
    rv = F.when(w.rlike(f"^.{_C}"), _after(f".{_C}.*?{_V}", w)).when(w.rlike(f"^{_V}{_V}"), _after(f"{_V}{_V}.*?{_C}", w)).otherwise(F.least(F.lit(3), size))
    df = df.withColumns({"_rv": rv, "_r1": _after(f".*?{_V}{_C}", w), "_r2": _after(f".*?{_V}{_C}.*?{_V}{_C}", w)})
    inside = lambda region, n: size - n >= F.col(region)

    # Attached pronouns, behind a gerund or an infinitive; an accent that they caused goes.
    df = df.withColumn("_s", _longest(w, _PRONOUNS))
    bare = _cut(w, s)
    before = F.when(s != "", F.regexp_extract(bare, "(iéndo|ándo|ár|ér|ír|ando|iendo|ar|er|ir|yendo)$", 1)).otherwise("")
    df = df.withColumns({"_b": before, "_bare": bare})
    fits = (F.col("_b") != "") & (F.length("_bare") - F.length("_b") >= F.col("_rv")) & ((F.col("_b") != "yendo") | F.endswith(F.col("_bare"), F.lit("uyendo")))
    plain = F.concat(_cut(F.col("_bare"), F.col("_b")), F.translate(F.col("_b"), "áéí", "aei"))
    df = df.withColumn("_w", F.when(fits, plain).otherwise(w))

    # Standard suffixes.
    df = df.withColumn("_s", _longest(w, *_STEP1)).withColumn("_cut", _cut(w, s))
    n, cut = F.length("_s"), F.col("_cut")

    def further(stem: Column, pattern: str) -> Column:
        """Without a suffix that the pattern captures, where that lies in R2."""
        more = F.regexp_extract(stem, f"({pattern})$", 1)
        return F.when((more != "") & (F.length(stem) - F.length(more) >= F.col("_r2")), _cut(stem, more)).otherwise(stem)

    in2 = inside("_r2", n)
    ativ = F.when(F.endswith(cut, F.lit("iv")), F.when(F.length(cut) - 2 >= F.col("_r2"), further(_cut(cut, F.lit("iv")), "at")).otherwise(cut)).otherwise(further(cut, "os|ic|ad"))
    new = F.when(_is(s, "amente") & inside("_r1", n), ativ)
    for suffixes, what in _STEP1.items():
        if what != "amente":
            out = {"": cut, "agent": further(cut, "ic"), "mente": further(cut, "ante|able|ible"), "idad": further(cut, "abil|ic|iv"), "iva": further(cut, "at")}.get(what)
            new = new.when(_is(s, suffixes) & in2, F.concat(cut, F.lit(what)) if out is None else out)
    df = df.withColumn("_new", new)
    df = df.withColumns({"_w": F.coalesce("_new", "_w"), "_open": F.col("_new").isNull()})

    # Verbs, where no standard suffix went; suffixes are looked for in RV only.
    region = F.substr(w, F.col("_rv") + 1, F.greatest(size - F.col("_rv"), F.lit(0)))
    df = df.withColumn("_s", F.when(F.col("_open"), _longest(region, _Y_VERBS)).otherwise(""))
    df = df.withColumn("_cut", _cut(w, s))
    gone = (s != "") & F.endswith(cut, F.lit("u"))
    df = df.withColumns({"_w": F.when(gone, cut).otherwise(w), "_open": F.col("_open") & ~gone})
    df = df.withColumn("_s", F.when(F.col("_open"), _longest(region, _E_VERBS, _VERBS)).otherwise(""))
    df = df.withColumn("_cut", _cut(w, s))
    df = df.withColumn("_w", F.when(_is(s, _E_VERBS) & F.endswith(cut, F.lit("gu")), _cut(cut, F.lit("u"))).otherwise(cut))

    # What is left.
    df = df.withColumn("_s", _longest(region, _REST)).withColumn("_cut", _cut(w, s))
    drops = _is(s, "e é") & F.endswith(cut, F.lit("gu")) & (F.length(cut) - 1 >= F.col("_rv"))
    df = df.withColumn("_w", F.when(drops, _cut(cut, F.lit("u"))).otherwise(cut))
    return df.select(*words.columns, F.translate(w, "áéíóú", "aeiou").alias("stem"))
