"""From raw documents to chunks, identifiers and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_label, fold, normal_code, squeeze
from ..workers import ship
from .references import MONTHS


def words(text) -> Column:
    """What stands between spaces and control characters; one pass over the text."""
    return F.filter(F.split(text, r"[\p{Cc} ]+"), lambda w: w != "")


def chunk_windows(docs: DataFrame, most: int = 500, overlap: int = 80, least: int = 300, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chunk_index, n_words, text, and the columns ``more`` of the document): windows of ``most`` words that overlap; a last window shorter than ``least`` joins the one before, overlap included."""
    step = most - max(0, min(overlap, most - 1))
    w = docs.select("doc_id", *more, words("text").alias("w"))
    n = F.size("w")
    many = F.when(n <= most, 1).otherwise(1 + F.ceil((n - most) / step)).cast("int")
    w = w.withColumn("many", many).withColumn("tail", n - step * (F.col("many") - 1))
    joins = (F.col("many") > 1) & (F.col("tail") < least)
    w = w.withColumn("last", F.when(joins, F.col("many") - 2).otherwise(F.col("many") - 1)).withColumn("joins", joins)
    part = lambda i: F.slice(F.col("w"), i * step + 1, most)
    text = lambda i: F.when((i == F.col("last")) & F.col("joins"), F.concat(part(i), part(i + 1))).otherwise(part(i))
    # Outer, and texts without words dropped afterwards: else Spark filters by the size of a list first and splits the text again for that.
    out = w.select("doc_id", *more, F.posexplode_outer(F.transform(F.sequence(F.lit(0), F.col("last")), text)).alias("chunk_index", "c")).where(F.size("c") > 0)
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("c").cast("long").alias("n_words"), F.array_join("c", " ").alias("text"), *more)


#: Elements whose content isn't text.
DROPPED = ("script", "style", "noscript", "header", "footer", "nav", "aside", "svg")


def html_text(html) -> Column:
    """Text of a well-formed page: dropped elements go with their content, tags become line ends, entities are resolved, lines shorter than 3 go."""
    bare = reduce(lambda c, tag: F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}\s*>", "\n"), DROPPED, html)
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", "\n"), r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return normal_lines(bare)


def normal_lines(text, least: int = 3) -> Column:
    lines = F.transform(F.split(text, "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: F.length(x) >= least), "\n")


def html_tree_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) by a real parser, for pages that nest dropped elements or mark them by class or id (menu, header, footer, nav)."""
    def run(batches):
        import pandas as pd

        from .html import page_text

        for b in batches:
            yield pd.DataFrame({"page_id": b.page_id, "text": [page_text(h or "") for h in b.html]})

    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


def source_choice(html: Column, pdf: Column, usable: int = 200, ratio: float = 0.6) -> Column:
    """html if it has enough text of its own and against pdf's, else pdf if usable, else what there is."""
    h, p = (F.coalesce(F.length(squeeze(c)), F.lit(0)) for c in (html, pdf))
    return F.when((h > usable) & ((p == 0) | (h >= p * ratio)), "html").when(p > usable, "pdf").when(h > 0, "html").when(p > 0, "pdf")


def summary(text, most_words: int = 120, most_chars: int = 1200) -> Column:
    """The first words, cut at a word where too long."""
    s = F.array_join(F.slice(words(text), 1, most_words), " ")
    return F.when(F.length(s) <= most_chars, s).otherwise(F.regexp_replace(F.substring(s, 1, most_chars), r"\s+\S*$", ""))


def embedding_text(title, language, kind, text) -> Column:
    """Labelled lines; missing parts are left out."""
    line = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(name + ": "), c))
    return F.concat_ws("\n", line("title", title), line("language", language), line("kind", kind), line("summary", summary(text)))


#: Codes such as ABC/2024/17, with a year among their parts; compact codes; six-digit register numbers after their name.
CODE_PATTERNS = {
    "code": (r"(?i)\b([a-z]{2,10}(?:[/\-][a-z0-9]{1,10})*[/\-](?:19|20)[0-9]{2}(?:[/\-][0-9]{1,6})?)\b", 1),
    "compact": (r"(?i)\b([0-9]{2}i[0-9]{3,4})\b", 1),
    "bdns": (r"(?i)bdns[^0-9]{0,12}([0-9]{6})\b", 1),
}


def identifiers(docs: DataFrame, head: int = 3000) -> DataFrame:
    """(doc_id, id_kind, id_key, raw, source): identifiers of the title, then of the first ``head`` characters of the text; the first of each key stays."""
    found = []
    for source, rank, text in (("title", 0, F.col("title")), ("body", 1, F.substring("text", 1, head))):
        for kind, (pattern, group) in CODE_PATTERNS.items():
            hits = F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("pos", "raw")
            found.append(docs.select("doc_id", F.lit("code" if kind == "compact" else kind).alias("id_kind"), F.lit(source).alias("source"), F.lit(rank).alias("rank"), hits))
    every = reduce(DataFrame.unionByName, found).withColumn("id_key", normal_code(F.col("raw")))
    first = Window.partitionBy("doc_id", "id_kind", "id_key").orderBy("rank", "pos", "raw")
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("doc_id", "id_kind", "id_key", "raw", "source")


def identifier_pins(asked: DataFrame, table: DataFrame, docs: DataFrame, most: int = 6) -> DataFrame:
    """(qid, doc_id, rank): documents of the asked (qid, id_kind, id_key), newest first; keys of more than ``most`` documents pin nothing."""
    # Keys of too many documents go before the questions meet them.
    keys = ["id_kind", "id_key"]
    table = table.select(*keys, "doc_id").distinct()
    few = table.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") <= most).select(*keys)
    hits = asked.select("qid", *keys).distinct().join(few, keys).join(table, keys)
    dated = hits.select("qid", "doc_id").distinct().join(docs.select("doc_id", "issue_date"), "doc_id")
    return dated.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("issue_date"), "doc_id")).cast("long")).drop("issue_date")


def ingested(raw: DataFrame, labels: dict[str, str], default: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents with label, chunks, references with their targets, identifiers) of raw (doc_id, title, text, raw label): the ingest's steps in their order, as one plan."""
    documents = raw.withColumn("label", canonical_label(F.col("raw"), labels, default)).drop("raw")
    return documents, chunk_windows(documents), resolve_references(references(documents), documents), identifiers(documents)


#: Verb stems that tell what a document does to the one it names, first match first.
REFERENCE_KINDS = {"modif": "modifica", "derog": "deroga", "correg": "corrige", "correc": "corrige", "conv": "convoca", "resuel": "resuelve", "resol": "resuelve"}
NORM_TYPES = ("decreto ley", "decreto", "orden", "ley", "resolucion", "acuerdo")


_FOUND = "doc_id long, ref_type string, number long, year long, ref_kind string, day long, month long, issuer string"


def references(docs: DataFrame, around: int = 120, before: int = 40, most: int | None = None) -> DataFrame:
    """(doc_id, ref_type, number, year, ref_kind, day, month, issuer): what the title and text of each document refer to: N/YYYY with the norm type that governs it, or a resolution by its date and issuer, and the kind of act around it.

    Matches need their offsets, which Spark's expressions don't give, so a vectorised function finds them.
    """
    types, kinds = NORM_TYPES, REFERENCE_KINDS

    def run(batches):
        import pandas as pd

        from .references import find_references

        for b in batches:
            rows = [(d, *r) for d, title, text in zip(b.doc_id, b.title, b.text, strict=True) for r in find_references(title or "", text or "", types, kinds, around, before, most)]
            out = pd.DataFrame(rows, columns=["doc_id", "ref_type", "number", "year", "ref_kind", "day", "month", "issuer"])
            yield out.astype({c: "Int64" for c in ("number", "year", "day", "month")})

    ship(docs.sparkSession)
    return docs.select("doc_id", "title", "text").mapInPandas(run, _FOUND)


_TYPE = r"^\s*(" + "|".join(NORM_TYPES) + ")"


def title_key(title) -> Column:
    """type|number|year or, of resolutions, type|day|month|year at the head of a title: the equi-key that references resolve by."""
    t = fold(title)
    number = _TYPE + r"\s+([0-9]{1,4})/([0-9]{4})"
    date = _TYPE + r"\s+(?:de\s+|d')([0-9]{1,2})\s+(?:de\s+|d')([a-z]+)\s+de\s+([0-9]{4})"
    part = lambda p, i: F.regexp_extract(t, p, i)
    month = reduce(lambda c, m: c.when(part(date, 3).isin(*m[1]), F.lit(str(m[0]))), enumerate(zip(*MONTHS, strict=True), 1), F.when(F.lit(False), F.lit("")))
    return F.when(t.rlike(number), F.concat_ws("|", part(number, 1), part(number, 2), part(number, 3))).when(t.rlike(date) & month.isNotNull(), F.concat_ws("|", part(date, 1), part(date, 2).cast("int").cast("string"), month, part(date, 4)))


def _reference_key() -> Column:
    text = lambda c: F.col(c).cast("string")
    return F.when(F.col("number").isNotNull(), F.concat_ws("|", "ref_type", text("number"), text("year"))).when(F.col("year").isNotNull(), F.concat_ws("|", "ref_type", text("day"), text("month"), text("year")))


def topic_words(title) -> Column:
    """Distinct words of five letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}]{5,}"), F.lit(0)))


def resolve_references(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """refs with target: the document, other than the source, whose title has the reference's key.

    Where several have it, the reference's issuer narrows them (``docs`` then has an issuer column); of several that are
    left, the one whose title shares the most words of five letters or more with the source's title, if it is alone in
    that. Otherwise null: better none than a guess.
    """
    issuer = F.col("issuer") if "issuer" in docs.columns else F.lit(None).cast("string")
    keyed = docs.select(F.col("doc_id").alias("target"), title_key("title").alias("key"), F.lower(issuer).alias("by"), topic_words("title").alias("words")).where("key is not null")
    per = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("target").alias("a"), F.max("target").alias("b"))
    rows = refs.withColumn("key", _reference_key()).distinct().join(per, "key", "left")
    own = F.col("doc_id")
    alone = F.when((F.col("n") == 1) & (F.col("a") != own), F.col("a")).when((F.col("n") == 2) & (F.col("a") == own), F.col("b")).when((F.col("n") == 2) & (F.col("b") == own), F.col("a"))
    rows = rows.withColumn("alone", alone)
    some = rows.where("alone is null and n > 1 and issuer is not null").select("doc_id", "key", F.lower("issuer").alias("issuer")).distinct()
    # Many share a key, so documents of the same issuer and words are one row, as are sources that ask alike; what is left
    # of each number of shared words is how many have it, and the smallest and largest of them, less the source itself.
    keyed = keyed.withColumn("words", F.array_sort("words"))
    mine = F.coalesce(F.array_sort(topic_words("title")), F.array().cast("array<string>"))
    some = some.join(docs.select("doc_id", mine.alias("mine")), "doc_id")
    common = F.size(F.array_intersect("words", "mine")).alias("common")
    alike = keyed.groupBy("key", "by", "words").agg(F.count("*").alias("n"), F.min("target").alias("a"), F.max("target").alias("b"))
    asks = some.select("key", "issuer", "mine").distinct().join(alike, "key").where(F.contains("by", F.col("issuer")))
    levels = asks.groupBy("key", "issuer", "mine", common).agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    self = some.join(keyed.withColumnRenamed("target", "doc_id"), ["doc_id", "key"]).where(F.contains("by", F.col("issuer")))
    self = self.groupBy("doc_id", "key", "issuer", common).agg(F.count("*").alias("self"))
    left = some.join(levels, ["key", "issuer", "mine"]).join(self, ["doc_id", "key", "issuer", "common"], "left")
    left = left.withColumn("n", F.col("n") - F.coalesce("self", F.lit(0))).where("n > 0")
    best = F.max(F.struct("common", "n", F.when(F.col("a") != own, F.col("a")).otherwise(F.col("b")).alias("target"))).alias("best")
    picked = left.groupBy("doc_id", "key", F.col("issuer").alias("low")).agg(F.sum("n").alias("many"), best)
    picked = picked.where("many = 1 or (best.n = 1 and best.common > 0)").select("doc_id", "key", "low", F.col("best.target").alias("picked"))
    out = rows.withColumn("low", F.lower("issuer")).join(picked, ["doc_id", "key", "low"], "left")
    return out.select(*refs.columns, F.coalesce("alone", "picked").alias("target"))


def reference_lookup(asked: DataFrame, docs: DataFrame, most: int = 4) -> DataFrame:
    """(qid, doc_id, pinned) of asked (qid, ref_type, number, year, day, month): the first ``most`` documents by id whose title begins with the reference (any type, where none is named), and has the date where one is stated. Pinned: the only one, or found by its date."""
    t = fold("title")
    first = F.regexp_extract_all(t, F.lit(r"([0-9]{1,4}/[0-9]{4})"), F.lit(1))
    day = F.regexp_extract(t, r"\b([0-9]{1,2})\s+(?:de\s+|d')([a-z]+)", 1)
    name = F.regexp_extract(t, r"\b([0-9]{1,2})\s+(?:de\s+|d')([a-z]+)", 2)
    names = lambda i: F.array(*(F.lit(x) for x in MONTHS[i]))
    docs = docs.select("doc_id", title_key("title").alias("key"), F.get(first, F.lit(0)).alias("number_year"), day.try_cast("int").alias("day"), name.alias("name"))
    months = F.filter(F.array_distinct(F.array(F.array_position(names(0), F.col("name")), F.array_position(names(1), F.col("name")))), lambda x: x > 0)
    docs = docs.select("doc_id", "key", "number_year", "day", F.when(F.col("day").isNotNull(), months).alias("months"))
    look = lambda kind, value, day, month: F.struct(F.lit(kind).alias("kind"), value.alias("value"), day.cast("long").alias("d"), month.cast("long").alias("m"))
    none = F.lit(0)
    keys = [("typed", F.col("key")), ("bare", F.col("number_year"))]
    undated = F.array(*(look(kind, value, none, none) for kind, value in keys))
    dates = F.flatten(F.transform("months", lambda x: F.array(*(look(kind, value, F.col("day"), x) for kind, value in keys))))
    looks = F.concat(undated, F.coalesce(dates, F.slice(undated, 1, 0)))
    by = ["kind", "value", "d", "m"]
    rows = docs.select("doc_id", F.inline_outer(looks)).where("value is not null")
    # What a reference finds is counted, and its first documents kept, before questions meet it: questions and documents of one reference would make the product of their numbers.
    place = F.row_number().over(Window.partitionBy(*by).orderBy("doc_id"))
    some = rows.withColumn("n", place).where(F.col("n") <= most).groupBy(*by).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))  # most at most
    found = some.join(rows.groupBy(*by).agg(F.count("*").alias("hits")), by)
    number = F.col("number").cast("string"), F.col("year").cast("string")
    value = F.when(F.col("ref_type").isNotNull(), F.concat_ws("|", "ref_type", *number)).otherwise(F.concat_ws("/", *number))
    dated, month = F.col("day").isNotNull(), F.col("month").cast("int")
    asks = asked.where("day is null or month between 1 and 12").select("qid", "day", F.when(F.col("ref_type").isNotNull(), "typed").otherwise("bare").alias("kind"), value.alias("value"), F.when(dated, F.col("day")).otherwise(0).cast("long").alias("d"), F.when(dated, month).otherwise(0).cast("long").alias("m"))
    hits = asks.join(found, by).select("qid", "day", "hits", F.posexplode("ids").alias("i", "doc_id"))
    own = Window.partitionBy("qid")
    hits = hits.withColumn("n", F.row_number().over(own.orderBy("doc_id"))).withColumn("many", F.sum(F.when(F.col("i") == 0, F.col("hits"))).over(own))
    return hits.where(F.col("n") <= most).select("qid", "doc_id", ((F.col("many") == 1) | F.col("day").isNotNull()).alias("pinned"))
