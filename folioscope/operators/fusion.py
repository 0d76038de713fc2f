"""The algebra of ranked lists. A list is a DataFrame (qid, doc_id, rank, ...): one plan serves a batch of questions.

Everything is windows, aggregates and anti-joins partitioned by qid; nothing is collected. Order is always a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(*order) -> Window:
    return Window.partitionBy("qid").orderBy(*order)


def ranked(df: DataFrame, *order, limit: int | None = None) -> DataFrame:
    """Adds rank from 1 within qid; ``order`` must be total. A limit prunes before the shuffle (window group limit)."""
    out = df.withColumn("rank", F.row_number().over(_by(*order)).cast("long"))
    return out.where(F.col("rank") <= limit) if limit else out


def first_seen(df: DataFrame) -> DataFrame:
    """The best-ranked row of each document, ranks closed up."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rank"))).where("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(_by("rank", "doc_id")).cast("long"))


def rrf(sources: list[DataFrame], weights: list[float] | None = None, k: int = 60, limit: int | None = 20) -> DataFrame:
    """(qid, doc_id, score, rank): the sum of weight / (k + rank) over sources, ties to the smaller doc_id. Sources of weight 0 or less are skipped. One source alone is only deduplicated, whatever the limit."""
    weights = weights or [1.0] * len(sources)
    if len(sources) == 1:
        return first_seen(sources[0]).select("qid", "doc_id", (F.lit(weights[0]) / (F.lit(k) + F.col("rank"))).alias("score"), "rank")
    parts = [s.select("qid", "doc_id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("vote")) for s, w in zip(sources, weights, strict=True) if w > 0]
    votes = reduce(DataFrame.unionByName, parts).groupBy("qid", "doc_id").agg(F.sum("vote").alias("score"))
    # Sums of the same votes in another order differ in the last bits; rounding keeps the order total and stable.
    return ranked(votes.withColumn("score", F.round("score", 12)), F.desc("score"), "doc_id", limit=limit)


def budgeted(rows: DataFrame, limit: int, ratio: float = 0.3) -> DataFrame:
    """(qid, doc_id, phase, rank) of rows (qid, doc_id, p, s), places in a primary and a secondary list or null: primary's head, then at most max(5, limit * ratio) of secondary, then primary's overflow.

    Where a question has one side only, that side's first ``limit`` rows come out as they are. Everything is windows over
    qid, so a question's rows move once.
    """
    budget = max(5, int(limit * ratio))
    keep, w = max(1, limit - budget), Window.partitionBy("qid")
    rows = rows.withColumn("two", (F.count("p").over(w) > 0) & (F.count("s").over(w) > 0))
    rows = rows.withColumn("head", F.coalesce(F.col("p") <= keep, F.lit(False)))
    # The budget counts what primary's head leaves of secondary.
    rows = rows.withColumn("open", F.col("two") & ~F.col("head") & F.col("s").isNotNull())
    rows = rows.withColumn("k", F.row_number().over(w.orderBy(F.desc("open"), "s")))
    taken = F.col("open") & (F.col("k") <= budget)
    phase = F.when(~F.col("two") | F.col("head"), 1).when(taken, 2).when(F.col("p").isNotNull(), 3)
    place = F.when(~F.col("two"), F.coalesce("p", "s")).when(taken, F.col("s")).otherwise(F.col("p"))
    rows = rows.withColumns({"phase": phase, "at": place}).where(F.col("phase").isNotNull() & (F.col("two") | (F.col("at") <= limit)))
    return rows.withColumn("rank", F.row_number().over(w.orderBy("phase", "at")).cast("long")).where(F.col("rank") <= limit).select("qid", "doc_id", "phase", "rank")


def budget_merge(primary: DataFrame, secondary: DataFrame, limit: int, ratio: float = 0.3) -> DataFrame:
    """(qid, doc_id, phase, rank): two lists merged as ``budgeted`` does; repeats count at their first place, but where a question has one list only it stays as it is."""
    both = primary.select("qid", "doc_id", F.col("rank").alias("p"), F.lit(None).cast("long").alias("s")).unionByName(secondary.select("qid", "doc_id", F.lit(None).cast("long").alias("p"), F.col("rank").alias("s")))
    w = Window.partitionBy("qid")
    both = both.withColumn("each", F.when((F.count("p").over(w) == 0) | (F.count("s").over(w) == 0), F.coalesce("p", "s")))
    return budgeted(both.groupBy("qid", "doc_id", "each").agg(F.min("p").alias("p"), F.min("s").alias("s")), limit, ratio)


def margin_ratio(fused: DataFrame, probe: int = 5) -> DataFrame:
    """(qid, n, margin): how far the score falls from the first to the probe-th document, as a share of the first."""
    stats = fused.groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    pivot = F.least(F.col("n"), F.lit(max(2, probe)))
    at = fused.join(stats, "qid").where(F.col("rank") == pivot).select("qid", "n", "top", F.col("score").alias("pivot"))
    return at.select("qid", F.col("n").cast("long"), F.when(F.col("top") > 0, (F.col("top") - F.col("pivot")) / F.col("top")).otherwise(0.0).alias("margin"))


def expand_on_flat_margin(fused_wide: DataFrame, small: int, threshold: float, probe: int = 5) -> DataFrame:
    """The first ``small`` documents of each question, or all of them where the margin among those is below the threshold."""
    flat = margin_ratio(fused_wide.where(F.col("rank") <= small), probe).withColumn("flat", F.col("margin") < threshold)
    return fused_wide.join(flat.select("qid", "flat"), "qid").where(F.col("flat") | (F.col("rank") <= small))


def semantic_anchors(fused: DataFrame, full: DataFrame, lanes: list[DataFrame], top: int = 3) -> DataFrame:
    """fused, with the first ``top`` documents of each lane that it lacks appended in lane order under their score in the full fusion."""
    wanted = reduce(DataFrame.unionByName, (x.where(F.col("rank") <= top).select("qid", "doc_id", F.struct(F.lit(i).alias("lane"), "rank").alias("at")) for i, x in enumerate(lanes)))
    wanted = wanted.groupBy("qid", "doc_id").agg(F.min("at").alias("at"))
    missing = wanted.join(fused.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").join(fused.select("qid").distinct(), "qid", "left_semi")
    late = missing.join(full.select("qid", "doc_id", "score"), ["qid", "doc_id"])
    size = fused.groupBy("qid").agg(F.max("rank").alias("last"))
    late = late.join(size, "qid").withColumn("rank", F.col("last") + F.row_number().over(_by("at")))
    cols = ["qid", "doc_id", "score", "rank"]
    return fused.select(*cols, F.lit(False).alias("anchor")).unionByName(late.select(*cols, F.lit(True).alias("anchor")))


def relaxation_ladder(rows: DataFrame, queries: DataFrame, filters: list[str], rungs: list[tuple[str, tuple[str, ...]]], least: int, limit: int) -> DataFrame:
    """(qid, rung, doc_id, rank): each question's documents under the first rung that gives ``least`` of them, or the last.

    ``filters`` are columns that both sides have; a null on the question's side doesn't filter. A rung names the filters
    it drops. One scan and one equi-join serve all rungs: a row counts on each rung whose kept filters it passes.
    """
    q = queries.select("qid", *(F.col(f).alias(f"want_{f}") for f in filters))
    pairs = rows.crossJoin(F.broadcast(q))  # the questions are a literal batch
    ok = {f: F.col(f"want_{f}").isNull() | F.coalesce(F.col(f) == F.col(f"want_{f}"), F.lit(False)) for f in filters}
    fits = [reduce(lambda a, b: a & b, (ok[f] for f in filters if f not in drop), F.lit(True)) for _, drop in rungs]
    level = F.explode(F.filter(F.array(*(F.when(c, F.lit(i)) for i, c in enumerate(fits))), lambda x: x.isNotNull())).alias("level")
    hits = pairs.where(reduce(lambda a, b: a | b, fits)).select("qid", "doc_id", "score", level)
    counts = hits.groupBy("qid", "level").agg(F.count("*").alias("n"))
    chosen = counts.groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("level"))), F.lit(len(rungs) - 1)).alias("level"))
    out = ranked(hits.join(chosen, ["qid", "level"]), F.desc("score"), "doc_id", limit=limit)
    name = reduce(lambda a, x: a.when(F.col("level") == x[0], F.lit(x[1][0])), enumerate(rungs), F.when(F.lit(False), F.lit("")))
    return out.select("qid", name.alias("rung"), "doc_id", "rank")


def quota_merge(sources: list[tuple[DataFrame, int | None]], cap: int) -> DataFrame:
    """(qid, doc_id, source, rank): a reserved quota of each source's first new documents in turn, then their overflow in turn, ``cap`` at most.

    A source's quota counts only what earlier sources' quotas left. Each document is one row with its place in every
    source, so the quotas are windows over qid, one after the other, and a question's rows move once.
    """
    lists = [df.select("qid", "doc_id", F.lit(i).alias("source"), "rank") for i, (df, _) in enumerate(sources)]
    place = lambda i: F.col(f"_r{i}")
    rows = reduce(DataFrame.unionByName, lists).groupBy("qid", "doc_id").agg(*(F.min(F.when(F.col("source") == i, F.col("rank"))).alias(f"_r{i}") for i in range(len(sources))))
    rows = rows.withColumn("got", F.lit(None).cast("int"))
    for i, (_, quota) in enumerate(sources):
        rows = rows.withColumn("open", F.col("got").isNull() & place(i).isNotNull())
        rows = rows.withColumn("k", F.row_number().over(_by(F.desc("open"), place(i))))
        mine = F.col("open") if quota is None else F.col("open") & (F.col("k") <= quota)
        rows = rows.withColumn("got", F.when(mine, F.lit(i)).otherwise(F.col("got")))
    first = F.coalesce(*(F.when(place(i).isNotNull(), F.lit(i)) for i in range(len(sources))))
    rows = rows.withColumns({"late": F.col("got").isNull(), "source": F.coalesce("got", first)})
    at = F.coalesce(*(F.when(F.col("source") == i, place(i)) for i in range(len(sources))))
    rows = rows.withColumn("at", at)
    return rows.withColumn("rank", F.row_number().over(_by("late", "source", "at")).cast("long")).where(F.col("rank") <= cap).select("qid", "doc_id", "source", "rank")


def union_ids(lists: list[DataFrame]) -> DataFrame:
    """(qid, doc_id, rank): ordered union of id lists; earlier lists first, repeats at their first place."""
    every = reduce(DataFrame.unionByName, (x.select("qid", "doc_id", F.struct(F.lit(i).alias("list"), "rank").alias("at")) for i, x in enumerate(lists)))
    return every.groupBy("qid", "doc_id").agg(F.min("at").alias("at")).withColumn("rank", F.row_number().over(_by("at")).cast("long")).drop("at")


def strict_winner(df: DataFrame, score: str | Column = "score") -> DataFrame:
    """Each question's best document, where no other ties with it."""
    w = _by(F.desc(score), "doc_id")
    return df.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).where("_n = 1").where(F.col("_next").isNull() | (F.col("_next") < F.col(score))).drop("_n", "_next")


def read_set(df: DataFrame, size: str, most_chars: int, budget: int, limit: int) -> DataFrame:
    """Documents in rank order whose size fits: oversized ones are skipped, the first that overflows the budget ends the set."""
    fit = df.where(F.col(size) <= most_chars)
    total = F.sum(size).over(_by("rank").rowsBetween(Window.unboundedPreceding, 0))
    return fit.withColumn("total", total).where(F.col("total") <= budget).withColumn("rank", F.row_number().over(_by("rank")).cast("long")).where(F.col("rank") <= limit)
