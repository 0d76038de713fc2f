"""Text expressions on Spark columns: folding, tokens, counting, numbers, dates in words. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the letters they fold to, place by place (a length-preserving fold).
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

#: A word in the sense of the lexical operators: letters, digits, and a few joiners.
TOKEN = r"[\p{L}\p{N}_·'/-]+"


def fold(text) -> Column:
    """Lower case without accents; as long as the text."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def squeeze(text) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def clean_control(text) -> Column:
    """Control characters become spaces; white space is squeezed."""
    return squeeze(F.regexp_replace(text, r"\p{Cc}", " "))


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def keep_token(least: int = 4, allowed: tuple[str, ...] = ()):
    """Tokens that carry meaning: long enough, allowed, or with a digit."""
    return lambda t: (F.length(t) >= least) | t.isin(*allowed) | t.rlike("[0-9]")


def content_tokens(text, least: int = 4, stop: tuple[str, ...] = (), allowed: tuple[str, ...] = ()) -> Column:
    return F.filter(tokens(text), lambda t: keep_token(least, allowed)(t) & ~t.isin(*(stop or ("",))))


def occurrences(text, term: str) -> Column:
    """How often term stands in text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def coverage(text, terms: list[str]) -> Column:
    """How many of the terms are substrings of the text."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(t)).cast("long") for t in terms), F.lit(0).cast("long"))


def total_occurrences(text, terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (occurrences(text, t) for t in terms), F.lit(0).cast("long"))


def contains_any(text, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms), F.lit(False))


def first_line(text) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def shorten(text, most: int) -> Column:
    """At most ``most`` characters, cut at the last space before and marked."""
    cut = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r"\s+\S*$", ""), F.lit("…")))


def estimate_tokens(text) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def guess_language(text, markers: dict[str, list[str]], default: str) -> Column:
    """The language with the most markers among the tokens; ties go to the one named first."""
    have = tokens(text)
    scores = [F.size(F.array_intersect(have, F.array(*map(F.lit, m)))) for m in markers.values()]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.when(best == 0, F.lit(default))
    for name, score in zip(markers, scores, strict=True):
        out = out.when(score == best, F.lit(name))
    return out.otherwise(F.lit(default))


NUMBER = r"[0-9]+(?:\.[0-9]{3})*(?:,[0-9]+)?"


def canonical_number(raw) -> Column:
    """1.366,740 -> 1366.74: dots group, the comma is the point, two decimals at most, no trailing zeros. Any number of digits."""
    plain = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    whole = F.substring_index(plain, ".", 1)
    number = F.when(F.length(whole) <= 18, F.round(plain.cast("decimal(24,6)"), 2).cast("string")).otherwise(_long_number(plain, whole))
    return F.regexp_replace(F.regexp_replace(number, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _long_number(plain, whole) -> Column:
    """Digits too many for a decimal: the part after the point is rounded as above, its carry goes through the nines that end the part before."""
    part = F.round(F.concat(F.lit("0."), F.substring(F.concat(F.regexp_extract(plain, r"\.([0-9]+)", 1), F.lit("0")), 1, 30)).cast("decimal(38,30)").cast("decimal(24,6)"), 2)
    digits = F.concat(F.lit("0"), whole)
    more = F.concat(F.regexp_extract(digits, "^([0-9]*)[0-8]9*$", 1), (F.regexp_extract(digits, "([0-8])9*$", 1).cast("int") + 1).cast("string"), F.regexp_replace(F.regexp_extract(digits, "(9*)$", 1), "9", "0"))
    head = F.regexp_replace(F.when(part >= 1, more).otherwise(digits), "^0+(?=[0-9])", "")
    return F.concat(head, F.substring(part.cast("string"), 2, 30))


def numbers(text) -> Column:
    """Distinct canonical numbers, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), canonical_number))


def units_claimed(text, unit: str) -> Column:
    """Canonical numbers that stand right before a unit."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"({NUMBER})\s*(?:{unit})"), F.lit(1)), canonical_number))


def normal_code(raw) -> Column:
    """Codes in lower case, with one slash for any run of white space, slashes and dashes."""
    return F.lower(F.regexp_replace(F.trim(raw), r"[\s/\-]+", "/"))


def full_year(year) -> Column:
    """Two-digit years: below 80 in this century, else in the last."""
    return F.when(year < 80, year + 2000).when(year < 100, year + 1900).otherwise(year)


def list_like(text) -> Column:
    """Three or more lines begin like items, or five or more semicolons."""
    return (F.regexp_count(text, F.lit(r"(?m)^\s*(?:[-*•]|[0-9]+[.)]|[a-z]\))\s")) >= 3) | (F.regexp_count(text, F.lit(";")) >= 5)


def strip_artifacts(text) -> Column:
    """Without document markers such as [doc_12] or (doc 12, doc 13), and without the spaces they leave."""
    bare = F.regexp_replace(text, r"(?i)\s*[\[(]\s*doc[_ ]?[0-9]+(?:\s*,\s*doc[_ ]?[0-9]+)*\s*[\])]", "")
    return squeeze(F.regexp_replace(bare, r"\s+([.,;:])", "$1"))


def canonical_label(raw, names: dict[str, str], default: str) -> Column:
    """A classifier's label by its folded, squeezed form: the canonical name of it or of its alias, else ``default``."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(known, squeeze(fold(raw))), F.lit(default))


def sentence_parts(text, least_chars: int = 6, least_words: int = 2) -> Column:
    """Parts between ? ; . that are long enough; only if there are two at least, else none."""
    parts = F.filter(F.transform(F.split(text, r"[?;.]"), squeeze), lambda p: (F.length(p) >= least_chars) & (F.size(F.split(p, " ")) >= least_words))
    return F.when(F.size(parts) >= 2, parts).otherwise(F.slice(parts, 1, 0))
