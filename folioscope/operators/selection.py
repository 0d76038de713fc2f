"""What stands between a fused pool and an answer: rerank order, snippets, read set, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import coverage, fold


def presort(pool: DataFrame, sims: DataFrame, limit: int) -> DataFrame:
    """The pool by similarity (documents without one last), then by fused score, then id."""
    rows = pool.join(sims, ["qid", "doc_id"], "left").withColumn("sim", F.coalesce("sim", F.lit(-1.0)))
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def merge_order(candidates: DataFrame, order: DataFrame) -> DataFrame:
    """Candidates in a given order (qid, doc_id, place): its valid ids once each, then the others as they stood."""
    first = order.groupBy("qid", "doc_id").agg(F.min("place").alias("place"))
    w = Window.partitionBy("qid").orderBy(F.col("place").asc_nulls_last(), "rank")
    return candidates.join(first, ["qid", "doc_id"], "left").withColumn("rank", F.row_number().over(w).cast("long")).select("qid", "doc_id", "rank")


def promote(ranked: DataFrame, keep: Column, top: int, order: list) -> DataFrame:
    """The first ``top`` documents that pass ``keep``, by ``order``, before the rest."""
    w = Window.partitionBy("qid", "keep").orderBy(*order, "rank")
    marked = ranked.withColumn("keep", F.coalesce(keep, F.lit(False))).withColumn("k", F.row_number().over(w))
    head = F.col("keep") & (F.col("k") <= top)
    w2 = Window.partitionBy("qid").orderBy(F.desc("head"), F.when(F.col("head"), F.col("k")), "rank")
    return marked.withColumn("head", head).withColumn("rank", F.row_number().over(w2).cast("long")).drop("keep", "k", "head")


def snippet_chain(*choices: Column) -> Column:
    """The first choice that has text."""
    return F.coalesce(*(F.when(F.length(F.trim(c)) > 0, c) for c in choices))


def enumerate_documents(docs: DataFrame, month: Column, year: Column, terms: list[str], existing: DataFrame, cap: int) -> DataFrame:
    """(doc_id, overlap, rank): documents of a month that match any term, by folded overlap, without those at hand."""
    rows = docs.where((F.month("issue_date") == month) & (F.year("issue_date") == year)).withColumn("overlap", coverage(fold("title"), terms)).where("overlap > 0")
    rows = rows.join(existing, "doc_id", "left_anti")
    top = rows.orderBy(F.desc("overlap"), "doc_id").limit(cap)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("overlap"), "doc_id")).cast("long")).select("doc_id", "overlap", "rank")


def citation_floor(read: DataFrame, evidence: DataFrame, chunks: DataFrame, score: Column, most: int) -> DataFrame:
    """(doc_id, chunk_index): the best chunk of each read document without evidence, the first ``most`` documents by rank."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_index")
    bare = read.join(evidence.select("doc_id").distinct(), "doc_id", "left_anti").orderBy("rank").limit(most)
    best = chunks.join(bare.select("doc_id", "rank"), "doc_id").withColumn("score", score).withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select("doc_id", "chunk_index", "score")


def principal_reference(titles: DataFrame, terms: list[str], pattern: str, window: int = 90) -> DataFrame:
    """(ref, score): the reference number that the titles about the terms name most tellingly, if one stands alone.

    A title votes for each number it holds with the weights ln(1 + n / df) of the terms among the ``window`` characters
    before the number; a number's score is its best title's.
    """
    flags = [F.contains(fold("title"), F.lit(t)).cast("long").alias(f"t{i}") for i, t in enumerate(terms)]
    stats = titles.agg(F.count("*").alias("n"), *(F.sum(F.contains(fold("title"), F.lit(t)).cast("long")).alias(f"d{i}") for i, t in enumerate(terms)))
    rows = titles.select("title", *flags).withColumn("ref", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(pattern), F.lit(0)))))
    head = fold(F.split_part("title", F.col("ref"), F.lit(1)))
    near = F.when(F.length(head) > window, F.substring(head, -window, window)).otherwise(head)
    rows = rows.crossJoin(F.broadcast(stats))  # one row
    weight = sum((F.when((F.col(f"d{i}") > 0) & F.contains(near, F.lit(t)), F.log(1 + F.col("n") / F.col(f"d{i}"))).otherwise(0.0) for i, t in enumerate(terms)), F.lit(0.0))
    best = rows.groupBy("ref").agg(F.round(F.max(weight), 6).alias("score")).where("score > 0")
    top = best.agg(F.max("score").alias("top"))
    first = best.join(F.broadcast(top), F.col("score") == F.col("top")).select("ref", "score")
    return first.withColumn("n", F.count("*").over(Window.partitionBy("score"))).where("n = 1").drop("n")
