"""Retrieval and answer quality: recall, reciprocal rank, nDCG, gated scores, latency, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_at(ranked, gold_sets, k: int) -> Column:
    """1 if all of some gold set is among the first k."""
    return F.exists(gold_sets, lambda g: F.size(F.array_except(g, F.slice(ranked, 1, k))) == 0).cast("long")


def satisfying_rank(ranked, gold_sets) -> Column:
    """The smallest rank by which some gold set is complete; null if none is."""
    whole = F.filter(gold_sets, lambda g: F.size(F.array_except(g, ranked)) == 0)
    return F.array_min(F.transform(whole, lambda g: F.array_max(F.transform(g, lambda d: F.array_position(ranked, d))))).cast("long")


def ndcg_at(ranked, relevant, k: int) -> Column:
    gain = lambda i: F.lit(1.0) / F.log2(i + F.lit(1.0))
    places = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: F.array_contains(relevant, F.get(ranked, i - 1)))
    dcg = F.aggregate(places, F.lit(0.0), lambda s, i: s + gain(i))
    ideal = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(k)), 1, F.least(F.size(relevant), F.lit(k))), F.lit(0.0), lambda s, i: s + gain(i))
    return F.when(F.size(relevant) > 0, dcg / ideal).otherwise(0.0)


def groups(*named) -> Column:
    """Group labels of a row, to explode: ALL and name:value for each (name, column)."""
    return F.array(F.lit("ALL"), *(F.concat(F.lit(f"{n}:"), c.cast("string")) for n, c in named))


def floor_percentile(values, p: int) -> Column:
    """The value at place floor((n - 1) * p / 100) of the sorted values."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, (F.floor((F.size(values) - 1) * p / 100) + 1).cast("int"))


def latency_summary(df: DataFrame, stage: str, value: str) -> DataFrame:
    """Count, mean, p50, p95 and maximum of a value by stage. Percentiles come from ranks within the stage, so no list of a stage's values is built."""
    w = Window.partitionBy(stage)
    placed = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w.orderBy(value))).withColumn("_m", F.count("*").over(w))
    at = lambda p: F.max(F.when(F.col("_n") == F.floor((F.col("_m") - 1) * p / 100) + 1, F.col(value)))
    return placed.groupBy(stage).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), at(50).alias("p50"), at(95).alias("p95"), F.max(value).alias("max"))


#: Size of a quantile sketch: a quantile's rank is off by less than RANK_ERROR of the values, with probability 0.99.
SKETCH_K, RANK_ERROR = 400, 0.0075


def latency_sketches(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, total, top, sketch): what summaries over any groups of the keys (a stage and a day, say) can be made of without the values. A sketch is a few kilobytes, whatever it covers; nulls and NaN don't count."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_v").alias("total"), F.max("_v").alias("top"), F.kll_sketch_agg_double("_v", F.lit(SKETCH_K)).alias("sketch"))


def merged_latency(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, p50, p95, max): the sketches merged over what isn't in keys; count, mean and maximum are exact, percentiles within RANK_ERROR of the rank."""
    rows = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("max"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return rows.select(*keys, "n", (F.col("total") / F.col("n")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), "max")


def sliding_latency(sketches: DataFrame, stage: str, day: str, days: int) -> DataFrame:
    """``merged_latency`` by stage for each day and the ``days`` - 1 before it: a day's sketches count in ``days`` windows, so no value is read again."""
    shifted = sketches.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn("_until", F.date_add(day, F.col("_d")))
    known = sketches.select(F.col(day).alias("_until")).distinct()
    return merged_latency(shifted.drop(day).join(known, "_until", "left_semi"), [stage, "_until"]).withColumnRenamed("_until", day)


def gated(abstain, abstained, critical, correctness) -> Column:
    """Score of an answer: questions to abstain from want abstention; a critical error scores 0; else correctness out of 2."""
    return F.when(abstain, abstained.cast("double")).when(critical, 0.0).otherwise(correctness / 2.0)


def run_diff(new: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): better, worse, same, added, missing."""
    a, b = new.select(key, F.col(value).alias("n"), F.lit(1).alias("_a")), base.select(key, F.col(value).alias("o"), F.lit(1).alias("_b"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "added").when(F.col("n") > F.col("o"), "better").when(F.col("n") < F.col("o"), "worse").otherwise("same")
    return both.select(key, status.alias("status"))


def holdout(key) -> Column:
    """A content-blind quarter: sha1 of the key, modulo 4."""
    return F.substring(F.sha1(key.cast("string").cast("binary")), -1, 1).isin("0", "4", "8", "c")
