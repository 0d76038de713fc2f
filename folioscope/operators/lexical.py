"""Full-text search over a postings table: match, cover-density rank, fallback ladder, relevance feedback."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, tokens

#: Endings that the light stemmer drops, longest first, where three letters or more stay.
ENDINGS = ("amientos", "amiento", "aciones", "idades", "mente", "acion", "iones", "idad", "cions", "ando", "endo", "ados", "adas", "idos", "idas", "ing", "ion", "ado", "ada", "ido", "ida", "es", "os", "as", "ed", "s", "a", "o", "e")


def stem(token) -> Column:
    return F.regexp_replace(token, "(?<=.{3})(?:" + "|".join(ENDINGS) + ")$", "")


def postings(docs: DataFrame, text: str = "text", weight: float = 1.0, stemmed: bool = False, offset: Column | int = 0, stop: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lexeme, pos, weight): one row for each token, folded, without stop words (which keep their places); ``offset`` places a field after another."""
    t = docs.select("doc_id", F.posexplode(tokens(fold(F.col(text)))).alias("pos", "token"), *([offset.alias("_o")] if isinstance(offset, Column) else []))
    t = t.where(~F.col("token").isin(*stop)) if stop else t
    lexeme = stem(F.col("token")) if stemmed else F.col("token")
    shift = F.col("_o") if isinstance(offset, Column) else F.lit(offset)
    return t.select("doc_id", lexeme.alias("lexeme"), (F.col("pos") + shift).cast("long").alias("pos"), F.lit(weight).alias("weight"))


@dataclass(frozen=True)
class Query:
    """Every word of ``all``, every phrase, one of each ``any`` group, none of ``none``."""

    all: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()
    any: tuple[tuple[str, ...], ...] = ()
    none: tuple[str, ...] = field(default=())

    @property
    def words(self) -> list[str]:
        return sorted({*self.all, *(w for p in self.phrases for w in p), *(w for g in self.any for w in g), *self.none})


def parse_query(text: str) -> Query:
    """Web-search syntax: words are joined by and, "..." is a phrase, or joins its neighbours, - negates."""
    parts = re.findall(r'-?"[^"]*"|\S+', text.lower())
    every, phrases, groups, none, join = [], [], [], [], False
    for part in parts:
        if part == "or":
            join = bool(every or groups)
            continue
        negative, bare = part.startswith("-"), part.lstrip("-")
        words = tuple(re.findall(r"[^\W_]+", bare))
        if not words:
            continue
        if negative:
            none += words
        elif len(words) > 1 and bare.startswith('"'):
            phrases.append(words)
        elif join:
            last = groups.pop() if groups and not every else (every.pop(),)
            groups.append((*last, words[0]))
        else:
            every += words
        join = False
    return Query(tuple(every), tuple(phrases), tuple(groups), tuple(none))


def match(table: DataFrame, query: Query) -> DataFrame:
    """(doc_id) of the documents that match. Postings are cut to the query's words before anything is grouped."""
    few = table.where(F.col("lexeme").isin(*query.words))
    has = few.groupBy("doc_id").agg(F.collect_set("lexeme").alias("have"))
    ok = [F.array_contains("have", w) for w in query.all] + [reduce(lambda a, b: a | b, (F.array_contains("have", w) for w in g)) for g in query.any] + [~F.array_contains("have", w) for w in query.none]
    out = has.where(reduce(lambda a, b: a & b, ok, F.lit(True))).select("doc_id")
    for phrase in query.phrases:
        starts = reduce(DataFrame.unionByName, (few.where(F.col("lexeme") == w).select("doc_id", (F.col("pos") - i).alias("at"), F.lit(i).alias("i")) for i, w in enumerate(phrase)))
        whole = starts.groupBy("doc_id", "at").agg(F.countDistinct("i").alias("n")).where(F.col("n") == len(phrase)).select("doc_id").distinct()
        out = out.join(whole, "doc_id", "left_semi")
    return out


def cover_rank(table: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, score): cover density (Clarke, Cormack and Tudhope): each minimal interval that holds all the words adds its mean weight over its length.

    For each place the last place so far of each word is a running maximum, so the intervals come from one window; no
    document's postings are collected.
    """
    few = table.where(F.col("lexeme").isin(*words))
    w = Window.partitionBy("doc_id").orderBy("pos")
    for i, word in enumerate(words):
        few = few.withColumn(f"_l{i}", F.last(F.when(F.col("lexeme") == word, F.col("pos")), ignorenulls=True).over(w))
    lasts = [F.col(f"_l{i}") for i in range(len(words))]
    start = F.least(*lasts) if len(lasts) > 1 else lasts[0]
    full = reduce(lambda a, b: a & b, (c.isNotNull() for c in lasts))
    spans = few.where(full).select("doc_id", start.alias("lo"), F.col("pos").alias("hi"), "weight")
    # Of the intervals with one start, the shortest is minimal.
    minimal = spans.groupBy("doc_id", "lo").agg(F.min("hi").alias("hi"), F.min_by("weight", "hi").alias("weight"))
    return minimal.groupBy("doc_id").agg(F.sum(F.col("weight") / (F.col("hi") - F.col("lo") + 1)).alias("score"))


def or_terms(query: str, most: int = 8, least: int = 4) -> list[str]:
    """The words of a query for a search by any of them: split at apostrophes, ``least`` letters or more, the first ``most``."""
    words = (part.strip("-") for token in re.findall(r"[\w·'’-]+", query.lower()) for part in re.split("['’]", token))
    return [w for w in words if len(w) >= least][:most]


def fallback_search(ladder: list[tuple[DataFrame, list[str], bool]]) -> DataFrame:
    """(doc_id, rung): what the first rung finds that finds anything. A rung is (postings, words, every): documents with all of the words, or with any. One job serves all rungs: each tags its hits, and the smallest rung present wins."""
    hits = []
    for i, (table, words, every) in enumerate(ladder):
        n = table.where(F.col("lexeme").isin(*words)).groupBy("doc_id").agg(F.countDistinct("lexeme").alias("n"))
        hits.append(n.where(F.col("n") >= (len(set(words)) if every else 1)).select("doc_id", F.lit(i).cast("long").alias("rung")))
    found = reduce(DataFrame.unionByName, hits)
    best = found.agg(F.min("rung").alias("best"))  # one row
    return found.join(F.broadcast(best), F.col("rung") == F.col("best")).select("doc_id", "rung")


def feedback_terms(hits: DataFrame, terms: Column, base: list[str], top: int = 5, least: int = 2, most: int = 6) -> DataFrame:
    """(qid, term, df, tf, rank): terms of each question's first hits that at least ``least`` of them have, the most frequent first, without the question's own."""
    t = hits.where(F.col("rank") <= top).select("qid", "doc_id", F.explode(terms).alias("term")).where(~F.col("term").isin(*(base or [""])))
    stats = t.groupBy("qid", "term").agg(F.countDistinct("doc_id").alias("df"), F.count("*").alias("tf")).where(F.col("df") >= least)
    w = Window.partitionBy("qid").orderBy(F.desc("df"), F.desc("tf"), "term")
    return stats.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)
