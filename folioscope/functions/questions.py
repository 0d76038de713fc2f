"""What a question asks for: identifiers, references, phrases, terms, clauses, fields, windows. Expressions on columns that stay in the JVM; word lists are parameters. A null question is like an empty one, and the work grows with a text's length, so that whole documents may be asked as well."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import relative_range
from .text import TOKEN, fold, full_year, keep_token, normal_code, sentence_parts, squeeze

STOP = tuple("a al an and are as at by con d de del el els en es for from i in is la las les los o of on or para per por que s the to un una what which y".split())
CONNECTORS = tuple("de del d la les of the i y".split())

#: The norm types of references, by what names them in folded text.
TYPES = {
    "decreto ley": r"decreto[\s-]*ley|decret[\s-]*llei",
    "ley": r"ley(?:es)?|lleis?",
    "decreto": r"decretos?|decrets?",
    "orden": r"orden(?:es)?|ordres?",
    "resolucion": r"resolucion(?:es)?|resolucio(?:ns)?",
    "acuerdo": r"acuerdos?|acords?",
}
#: Words that open a question of its own after a conjunction, in folded text.
INTERROGATIVES = "que quin quina quins quines qui quien quienes cual cuales cuanto cuanta cuantos cuantas quant quanta quants quantes how what when which".split()

NUMBERED = r"\b([0-9]{1,4})/([0-9]{2,4})\b"
_YEAR = "^(?:19|20)[0-9]{2}$"
#: Characters before and after a number between which its type is named.
_BEFORE, _AFTER = 30, 5


def _let(value, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _text(question) -> Column:
    return F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))


def words(question) -> Column:
    """The words of a question as they are written."""
    return F.regexp_extract_all(_text(question), F.lit(TOKEN), F.lit(0))


def _runs(many, kept: Callable[[Column], Column]) -> Column:
    """The stretches of words between those for which ``kept`` is null; its values stand for the others."""
    line = F.array_join(F.transform(many, lambda w: F.coalesce(kept(w), F.lit("\n"))), " ")
    return F.filter(F.transform(F.split(line, "\n"), lambda s: F.filter(F.split(s, " "), lambda w: w != "")), lambda s: F.size(s) > 0)


# -- identifiers and references ----------------------------------------------------------------------------------------


def references(question, types: dict[str, str] = TYPES) -> Column:
    """Distinct struct(ref_type, number, year) of the N/YYYY in a question, in order. The type is the one that ends last in the 30 characters before and 5 after a number, the longer one of two that end together, null if none is named; years outside 1980-2100 are no references."""

    def found(x):
        between, at = x["between"], x["at"]
        # Between and number in turn: sixteen pieces before a number hold 30 characters at least, as a number has four.
        both = F.flatten(F.transform(between, lambda b, i: F.array(b, F.coalesce(F.get(at, i), F.lit("")))))

        def one(raw, i):
            before = F.right(F.array_join(F.slice(both, F.greatest(2 * i - 14, F.lit(1)), F.least(2 * i + 1, F.lit(16))), ""), F.lit(_BEFORE))
            after = F.left(F.array_join(F.slice(both, 2 * i + 3, 4), ""), F.lit(_AFTER))
            near = F.concat(before, raw, after)
            named = [F.struct(F.length(F.regexp_extract(near, rf"(?s)^.*\b(?:{p})\b", 0)).alias("end"), F.lit(len(t)).alias("size"), F.lit(t).alias("type")) for t, p in types.items()]
            best = F.array_max(F.array(*named))
            year = full_year(F.split_part(raw, F.lit("/"), F.lit(2)).cast("long"))
            return F.struct(F.when(best["end"] > 0, best["type"]).alias("ref_type"), F.split_part(raw, F.lit("/"), F.lit(1)).cast("long").alias("number"), year.alias("year"))

        return F.array_distinct(F.filter(F.transform(at, one), lambda r: r["year"].between(1980, 2100)))

    low = fold(_text(question))
    return _let(F.struct(F.split(low, NUMBERED).alias("between"), F.regexp_extract_all(low, F.lit(NUMBERED), F.lit(0)).alias("at")), found)


def identifiers(question, most_groups: int = 5, types: dict[str, str] = TYPES) -> Column:
    """Distinct struct(kind, key) that a question may name: code, from every acronym of three letters or more on, with up to ``most_groups`` groups after it, a year among them; bdns; norm, a reference with its type; ref, a year and a number. Keys are those of the kept identifiers, whose exact match is what decides."""

    def windows(parts):
        def of(p, i):
            ends = F.filter(F.array(*map(F.lit, range(2, most_groups + 2))), lambda n: i + n <= F.size(parts))
            return F.when(p.rlike("^[A-Za-z]{3,}$"), F.transform(ends, lambda n: F.slice(parts, i + 1, n))).otherwise(F.array().cast("array<array<string>>"))

        coded = lambda w: F.exists(w, lambda s: s.rlike(_YEAR)) & F.forall(w, lambda s: s.rlike("^[A-Za-z0-9]+$"))
        return F.transform(F.filter(F.flatten(F.transform(parts, of)), coded), lambda w: F.lower(F.array_join(w, "/")))

    text = _text(question)
    pieces = F.split(text, r"[^\p{L}\p{N}_\s/-]+")
    codes = F.flatten(F.transform(pieces, lambda r: _let(F.filter(F.split(r, r"[\s/-]+"), lambda p: p != ""), windows)))
    norms = F.transform(F.filter(references(text, types), lambda r: r["ref_type"].isNotNull()), lambda r: F.concat_ws("/", r["ref_type"], r["number"].cast("string"), r["year"].cast("string")))
    named = {
        "code": F.concat(codes, F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{2}[Ii][0-9]{3,4})\b"), F.lit(1)), normal_code)),
        "bdns": F.regexp_extract_all(text, F.lit(r"(?i)\bbdns\b[^0-9]{0,20}?([0-9]{5,7})\b"), F.lit(1)),
        "norm": norms,
        "ref": F.regexp_extract_all(text, F.lit(r"\b(20[0-9]{2}/[0-9]{3,5})\b"), F.lit(1)),
    }
    of = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    return F.array_distinct(F.concat(*(F.transform(keys, of(kind)) for kind, keys in named.items())))


# -- phrases and terms ----------------------------------------------------------------------------------------------------


def content_words(question, stop: tuple[str, ...] = STOP, least: int = 4) -> Column:
    """Distinct words in lower case that carry meaning, in order."""
    low = F.transform(words(question), lambda w: F.lower(F.regexp_replace(w, r"^['/-]+|['/-]+$", "")))
    return F.array_distinct(F.filter(low, lambda w: keep_token(least)(w) & (w != "") & ~w.isin(*stop)))


def _capital(w) -> Column:
    return w.rlike(r"^\p{Lu}|^[dDlL]'\p{Lu}")


def _named_runs(many, named, connectors: tuple[str, ...]) -> Column:
    """Stretches that begin at a ``named`` word and go on over those and connectors."""
    runs = _runs(many, lambda w: F.when(named(w) | F.lower(w).isin(*connectors), w))
    return F.filter(F.transform(runs, lambda r: _let(F.array_position(F.transform(r, named), True).cast("int"), lambda k: F.when(k > 0, F.slice(r, k, F.size(r))))), lambda r: r.isNotNull())


def _content_phrases(many, stop: tuple[str, ...], connectors: tuple[str, ...], most: int) -> Column:
    """Within stretches without stop words, cut after five content words: from each content word to the next one and the one after, connectors between them."""
    runs = _runs(many, lambda w: _let(F.lower(w), lambda v: F.when(v.isin(*connectors) | keep_token()(v) & ~v.isin(*stop), v)))

    def of(run):
        def pairs(at):
            def after(p, i):
                last = F.least(F.floor(i / 5) * 5 + 4, F.size(at) - 1)
                return F.transform(F.filter(F.array(i + 1, i + 2), lambda j: j <= last), lambda j: F.array_join(F.slice(run, p, F.get(at, j) - p + 1), " "))

            return F.flatten(F.transform(at, after))

        # The first phrases end well within twice as many content words.
        return _let(F.slice(F.filter(F.transform(run, lambda w, i: F.when(~w.isin(*connectors), i + 1)), lambda k: k.isNotNull()), 1, 2 * most), pairs)

    # Every run of two content words or more has a phrase, so that no later runs are needed.
    several = F.filter(runs, lambda r: F.size(F.filter(r, lambda w: ~w.isin(*connectors))) >= 2)
    return F.slice(F.flatten(F.transform(F.slice(several, 1, most), of)), 1, most)


def phrases(question, keywords=None, stop: tuple[str, ...] = STOP, connectors: tuple[str, ...] = CONNECTORS, weak: tuple[str, ...] = (), most_content: int = 8) -> Column:
    """Distinct phrases in lower case: keywords of several words, quoted parts, runs of words with a capital or a digit (connectors may follow inside), at most ``most_content`` phrases of content words. A phrase has two words and six characters at least, no single letters, and a digit or a word that is neither connector nor ``weak``."""
    text = _text(question)
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    runs = F.transform(_named_runs(words(text), lambda w: w.rlike(r"^\p{Lu}|[0-9]"), connectors), lambda r: F.array_join(r, " "))
    given = F.array().cast("array<string>") if keywords is None else F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.contains(k, F.lit(" ")))
    every = F.transform(F.concat(given, quoted, runs, _content_phrases(words(text), stop, connectors, most_content)), lambda p: squeeze(F.lower(p)))

    def good(p):
        useful = lambda ws: F.exists(ws, lambda w: ~w.isin(*connectors, *weak))
        fits = lambda ws: (F.size(ws) >= 2) & ~F.exists(ws, lambda w: (F.length(w) == 1) & ~w.rlike("[0-9]"))
        return (F.length(p) >= 6) & _let(F.split(p, " "), lambda ws: fits(ws) & (p.rlike("[0-9]") | useful(ws)))

    return F.array_distinct(F.filter(every, lambda p: p.isNotNull() & good(p)))


def frequent(many, most: int) -> Column:
    """The ``most`` frequent words of an array, longer ones first, then in alphabetical order. Counted over the sorted array, so the work grows no faster than a sort."""

    def ranked(x):
        starts = F.filter(F.transform(x, lambda w, i: F.when((i == 0) | (F.get(x, i - 1) != w), i)), lambda i: i.isNotNull())

        def counted(at):
            rated = lambda p, k: F.struct((p - F.coalesce(F.get(at, k + 1), F.size(x))).alias("n"), (-F.length(F.get(x, p))).alias("size"), F.get(x, p).alias("word"))
            return F.transform(F.slice(F.sort_array(F.transform(at, rated)), 1, most), lambda r: r["word"])

        return _let(starts, counted)

    return _let(F.sort_array(many), ranked)


def entities(question, most: int = 6, stop: tuple[str, ...] = STOP, connectors: tuple[str, ...] = CONNECTORS) -> Column:
    """The first distinct runs with two capitalised words or more, connectors inside and after them, in lower case. A stop word opens none."""
    opens = lambda w: _capital(w) & ~F.lower(w).isin(*stop)
    runs = _runs(words(question), lambda w: F.when(_capital(w) | F.lower(w).isin(*connectors), w))
    begun = F.transform(runs, lambda r: _let(F.array_position(F.transform(r, opens), True).cast("int"), lambda k: F.when(k > 0, F.slice(r, k, F.size(r)))))
    named = F.filter(begun, lambda r: r.isNotNull() & (F.size(F.filter(r, _capital)) >= 2))
    return F.slice(F.array_distinct(F.transform(named, lambda r: F.lower(F.array_join(r, " ")))), 1, most)


def anchor_terms(question, keywords=None, within=None, most: int = 3, stop: tuple[str, ...] = STOP, generic: tuple[str, ...] = (), weak: tuple[str, ...] = (), short: tuple[str, ...] = ()) -> Column:
    """The most telling words of a question and of keywords of one word: long ones; less one if generic, else two more; two more with a digit, and if among ``within`` (an array of phrases' words); one more for known short words. Ties in alphabetical order; ``weak`` words don't count."""
    none = F.array().cast("array<string>")
    single = none if keywords is None else F.filter(F.coalesce(keywords, none), lambda k: ~F.contains(k, F.lit(" ")))
    low = F.transform(F.concat(words(question), F.transform(single, F.trim)), F.lower)
    own = F.array_distinct(F.filter(low, lambda w: keep_token(allowed=short)(w) & ~w.isin(*stop, *weak)))
    inside = none if within is None else within

    def rated(more: int):
        def of(w):
            value = F.length(w) + F.when(w.isin(*generic), -1).otherwise(2) + F.when(w.rlike("[0-9]"), 2).otherwise(0) + F.when(w.isin(*short), 1).otherwise(0)
            return F.struct((-value - more).alias("at"), w.alias("word"))

        return of

    both = _let(F.struct(own.alias("own"), inside.alias("inside")), lambda x: F.concat(F.transform(F.array_intersect(x["own"], x["inside"]), rated(2)), F.transform(F.array_except(x["own"], x["inside"]), rated(0))))
    return F.transform(F.slice(F.sort_array(both), 1, most), lambda r: r["word"])


def broad_terms(question, found, keywords=None, most: int = 8, stop: tuple[str, ...] = STOP, generic: tuple[str, ...] = (), weak: tuple[str, ...] = ()) -> Column:
    """Terms of which any may match: the phrases ``found``, quoted; words that aren't generic; then two generic ones (four, where nothing else is), those that aren't ``weak`` and long ones first. Empty if the question has none."""
    none = F.array().cast("array<string>")
    single = none if keywords is None else F.filter(F.coalesce(keywords, none), lambda k: ~F.contains(F.trim(k), F.lit(" ")))
    low = F.transform(F.concat(words(question), F.transform(single, F.trim)), F.lower)

    def chosen(own):
        specific = F.concat(F.transform(found, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), F.filter(own, lambda w: ~w.isin(*generic)))
        rated = F.transform(own, lambda w, i: F.struct(w.isin(*(weak or ("",))).alias("weak"), (-F.length(w)).alias("size"), i.alias("at"), w.alias("word")))
        dull = F.transform(F.sort_array(F.filter(rated, lambda r: r["word"].isin(*generic))), lambda r: r["word"])
        return F.slice(F.concat(specific, F.slice(dull, 1, F.when(F.size(specific) > 0, 2).otherwise(4))), 1, most)

    return _let(F.array_distinct(F.filter(low, lambda w: keep_token()(w) & ~w.isin(*stop))), chosen)


def expansion_terms(question, keywords, proposed, most_keywords: int = 6, most_phrases: int = 4, budget: int = 8, stop: tuple[str, ...] = STOP, generic: tuple[str, ...] = (), weak: tuple[str, ...] = ()) -> Column:
    """struct(phrases, keywords): what proposed terms add to a question within a budget of words. Phrases come first, each if it still fits; they have two to five words, aren't part of the question, and have a word that isn't in it and one that says something. Keywords are single, not in the question and not generic."""
    none = F.array().cast("array<string>")
    clean = lambda many: F.array_distinct(F.filter(F.transform(F.coalesce(many, none), lambda k: squeeze(F.lower(k))), lambda k: k.isNotNull() & (k != "")))
    low = F.lower(_text(question))

    def chosen(have):
        new = lambda k: ~F.contains(k, F.lit(" ")) & ~F.array_contains(have, k) & keep_token()(k) & ~k.isin(*stop, *generic)
        told = lambda ws: F.exists(ws, lambda w: ~w.isin(*stop, *generic, *weak)) & F.exists(ws, lambda w: ~F.array_contains(have, w))
        adds = lambda p: ~F.contains(low, p) & _let(F.split(p, " "), lambda ws: F.size(ws).between(2, 5) & told(ws))
        singles = F.slice(F.filter(clean(keywords), new), 1, most_keywords)
        several = F.slice(F.filter(clean(proposed), adds), 1, most_phrases)
        begin = F.struct(F.lit(budget).alias("left"), none.alias("out"))
        fit = lambda at, p: _let(F.size(F.split(p, " ")), lambda n: F.when(n <= at["left"], F.struct((at["left"] - n).alias("left"), F.concat(at["out"], F.array(p)).alias("out"))).otherwise(at))
        return _let(F.aggregate(several, begin, fit), lambda at: F.struct(at["out"].alias("phrases"), F.slice(singles, 1, at["left"]).alias("keywords")))

    return _let(F.transform(words(question), F.lower), chosen)


# -- clauses and fields ---------------------------------------------------------------------------------------------------


def clauses(question, conjunctions: tuple[str, ...] = ("y", "i", "and"), interrogatives: list[str] = INTERROGATIVES, stop: tuple[str, ...] = STOP) -> Column:
    """The two halves of a compound question: at the first conjunction that an interrogative follows, else at the last one; each as far as its first sentence end. Empty unless both have two content words and the second names something: a digit, or a capital after its first word."""
    parted = F.split(F.regexp_replace(F.trim(F.translate(_text(question), "\x01", " ")), rf"(?i)(\s(?:{'|'.join(conjunctions)})\s)", "\x01$1\x01"), "\x01")
    opens = rf"^[\s¿¡]*(?:{'|'.join(interrogatives)})\b"
    cut = lambda h: F.regexp_replace(F.get(F.split(F.regexp_replace(h, r"^[\s¿?¡!.,;:]+|[\s¿?¡!.,;:]+$", ""), "[?;.]"), F.lit(0)), r"^[\s¿?¡!.,;:]+|[\s¿?¡!.,;:]+$", "")

    def halves(x):
        at = F.filter(F.transform(x, lambda p, i: F.when((i > 0) & (i % 2 == 0), F.struct(i.alias("i"), fold(p).rlike(opens).alias("asks")))), lambda p: p.isNotNull())
        k = F.coalesce(F.get(F.filter(at, lambda p: p["asks"]), F.lit(0)), F.try_element_at(at, F.lit(-1)))["i"]
        return F.when(F.size(at) > 0, _let(k, lambda k: F.transform(F.array(F.array_join(F.slice(x, 1, k - 1), ""), F.array_join(F.slice(x, k + 1, F.size(x)), "")), cut)))

    def told(h):
        second = F.get(h, F.lit(1))
        named = second.rlike(r"[0-9]") | second.rlike(r"\s\p{Lu}")
        return F.when(F.forall(h, lambda p: F.size(content_words(p, stop)) >= 2) & named, h)

    return F.coalesce(_let(_let(parted, halves), told), F.array().cast("array<string>"))


def asked_fields(question, cues: dict[str, str]) -> Column:
    """The fields whose cue (a pattern on folded text) a question has, in the order of ``cues``."""
    return _let(fold(_text(question)), lambda low: F.filter(F.array(*(F.when(low.rlike(p), F.lit(f)) for f, p in cues.items())), lambda f: f.isNotNull()))


def multi_field(question, cues: dict[str, str], subject: str, least: int = 2, enumerates: str | None = None) -> Column:
    """Asks ``least`` fields of one subject (a pattern on folded text), and neither enumerates nor compares two references."""
    low = fold(_text(question))
    one = low.rlike(subject) & (F.size(asked_fields(question, cues)) >= least) & (F.size(references(question)) < 2)
    return one & ~low.rlike(enumerates) if enumerates else one


def identity_query(question, cues: dict[str, str], subject: str, markers: str, least: int = 15) -> Column:
    """The question without numbered items and without the clauses that only ask fields; empty if little is left. A clause asks if it has two fields, or one with a marker and no subject."""
    bare = F.regexp_replace(_text(question), r"\b[0-9]{1,2}\)\s*[^,.;:?()]*", " ")
    parts = F.filter(F.transform(F.split(bare, "[.?!;:]"), lambda c: F.regexp_replace(c, "^[ ,¿¡«»\"'\n]+|[ ,¿¡«»\"'\n]+$", "")), lambda c: fold(c) != "")

    def asks(c):
        low = fold(c)
        hits = reduce(lambda a, b: a + b, (low.rlike(p).cast("int") for p in cues.values()))
        return (hits >= 2) | (hits == 1) & low.rlike(markers) & ~low.rlike(subject)

    kept = F.trim(F.array_join(F.filter(parts, lambda c: ~asks(c)), " "))
    return _let(kept, lambda k: F.when(F.length(k) >= least, k).otherwise(""))


def facets(question, cues: dict[str, str], subject: str, markers: str, most: int = 3, enumerates: str | None = None) -> Column:
    """The question, then what it is searched by as well: of a question for several fields its identity alone, else its sentence parts; distinct but for case, ``most`` in all."""
    text = _text(question)
    low = F.lower(text)
    compound = (F.regexp_count(text, F.lit(r"\?")) > 1) | F.contains(text, F.lit(";")) | low.rlike(" [yi] ")
    none = F.array().cast("array<string>")
    several = F.when(multi_field(text, cues, subject, enumerates=enumerates), F.array(identity_query(text, cues, subject, markers))).when(compound, sentence_parts(text)).otherwise(none)
    keyed = lambda many: F.transform(many, lambda c: F.lower(F.trim(c)))
    fresh = lambda all_: F.filter(F.transform(all_["text"], lambda c, i: F.when((i == 0) | (F.get(all_["key"], i) != "") & (F.array_position(all_["key"], F.get(all_["key"], i)) == i + 1), c)), lambda c: c.isNotNull())
    return _let(F.concat(F.array(text), several), lambda x: F.slice(_let(F.struct(x.alias("text"), keyed(x).alias("key")), fresh), 1, most))


#: The norm types that a question can name without a number, and the words that introduce them, in folded text.
NAMED_TYPES = {"decreto ley": "decreto?[ -]ley|decret llei", "decreto": "decreto?", "orden": "orden|ordre", "ley": "ley|llei"}


def named_norm(question, types: dict[str, str] = NAMED_TYPES, stop: tuple[str, ...] = STOP) -> Column:
    """struct(ref_type, topic) of a question that names a norm by its type and folded topic words and has no number; else null."""
    low = fold(_text(question))
    head = lambda p: rf"\b(?:el|la|l'|del|de la|the)\s*(?:{p})\b"
    pair_of = lambda t: lambda w: F.when(F.size(w) > 0, F.struct(F.lit(t).alias("ref_type"), w.alias("topic")))
    out = None
    for t, p in types.items():
        hit = low.rlike(head(p))
        pair = _let(content_words(F.regexp_replace(low, rf"(?s)^(.*?){head(p)}", "$1 "), stop), pair_of(t))
        out = F.when(hit, pair) if out is None else out.when(hit, pair)
    return F.when(~low.rlike(r"\b[0-9]{1,4}/[0-9]{2,4}\b"), out)


# -- windows and hints ------------------------------------------------------------------------------------------------------

_RELATIVE = r"\b(today|yesterday|tomorrow|this week|last week|this month|last month|this year|last year|last [0-9]+ days|recent)(?:ly)?\b"


def relative_phrase(question) -> Column:
    """The first phrase that names a window relative to today, in lower case; null without one, or with an ISO date, which overrides."""
    low = F.lower(_text(question))
    return F.when(~low.rlike(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b") & low.rlike(_RELATIVE), F.regexp_extract(low, _RELATIVE, 1))


def has_hint(question, hint: str) -> Column:
    """Single words match as words, phrases anywhere."""
    low = F.lower(_text(question))
    return F.contains(low, F.lit(hint.lower())) if " " in hint else low.rlike(rf"\b\Q{hint.lower()}\E\b")


def window(question, since, until, as_of) -> Column:
    """struct(since, until): the question's relative window where it names one, else the given bounds; inverted bounds change places."""
    span = relative_range(relative_phrase(question), as_of)

    def ordered(w):
        swap = w["since"] > w["until"]  # null where a bound is missing
        return F.struct(F.when(swap, w["until"]).otherwise(w["since"]).alias("since"), F.when(swap, w["since"]).otherwise(w["until"]).alias("until"))

    return _let(_let(span, lambda s: F.struct(F.when(s.isNotNull(), s["start"]).otherwise(since).alias("since"), F.when(s.isNotNull(), s["end"]).otherwise(until).alias("until"))), ordered)
