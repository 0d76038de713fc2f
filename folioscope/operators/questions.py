"""Batches of questions: what each is searched by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import questions as ask


def lexical_queries(asked: DataFrame, generic: tuple[str, ...] = (), weak: tuple[str, ...] = (), short: tuple[str, ...] = (), stop: tuple[str, ...] = ask.STOP, connectors: tuple[str, ...] = ask.CONNECTORS) -> DataFrame:
    """(qid, broad, strict) of asked (qid, text, keywords).

    broad: any of eight phrases and words, joined by OR; the question itself if it has none. strict: all of the four words
    that most phrases have, longer ones first, then in alphabetical order; with fewer than two, two phrases with two
    anchors; without phrases three anchors, if there are two; null where that is nothing more than broad. Null texts are
    empty; keywords may be null. Every row is its own question; nothing is shuffled.
    """
    lists = {"stop": stop, "generic": generic, "weak": weak}
    rows = asked.select("qid", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    rows = rows.withColumn("phrases", ask.phrases(F.col("text"), F.col("keywords"), stop, connectors, weak))
    within = F.filter(F.flatten(F.transform("phrases", lambda p: F.split(p, " "))), lambda w: ~w.isin(*connectors))
    rows = rows.withColumn("said", within).withColumns({"within": F.array_distinct("said"), "ranked": ask.frequent(F.col("said"), 4)})
    rows = rows.withColumn("anchors", ask.anchor_terms(F.col("text"), F.col("keywords"), F.col("within"), short=short, **lists))
    rows = rows.withColumn("terms", ask.broad_terms(F.col("text"), F.col("phrases"), F.col("keywords"), **lists))
    join = lambda c, n, by=" ": F.array_join(F.slice(c, 1, n), by)
    quoted = F.transform("phrases", lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    pair = F.concat(F.lit("("), join(quoted, 2, " OR "), F.lit(")"), F.when(F.size("anchors") > 0, F.concat(F.lit(" ("), join("anchors", 2, " OR "), F.lit(")"))).otherwise(""))
    strict = F.when(F.size("phrases") == 0, F.when(F.size("anchors") >= 2, join("anchors", 3))).when(F.size("ranked") >= 2, F.array_join("ranked", " ")).otherwise(pair)
    out = rows.select("qid", F.when(F.size("terms") > 0, F.array_join("terms", " OR ")).otherwise(F.col("text")).alias("broad"), strict.alias("strict"))
    return out.withColumn("strict", F.when(F.col("strict") != F.col("broad"), F.col("strict")))
