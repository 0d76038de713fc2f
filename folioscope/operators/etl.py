"""Keyed upserts, reconciliation, retention, retry state. Tables are plain DataFrames; each function returns the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; both have the same columns."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def not_in(rows: DataFrame, column: str, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` is in no row of ``listed``, as SQL's NOT IN has it: a null in the list leaves nothing, a null in ``column`` goes unless the list is empty."""
    some = listed.agg(F.count("*").alias("_n"), F.count_if(F.col(key).isNull()).alias("_nulls"))  # one row
    rest = rows.join(listed.select(F.col(key).alias("_k")).where("_k is not null").distinct(), F.col(column) == F.col("_k"), "left_anti")
    return rest.crossJoin(F.broadcast(some)).where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).drop("_n", "_nulls")


def upsert_counter(state: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """State (keys, attempts, last_error, resolved): failures (keys, at, error) add to attempts, reopen, and set the last error."""
    new = failures.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("error", F.struct("at", "error")).alias("error"))
    both = state.join(new, keys, "full_outer")
    seen = F.col("n").isNotNull()
    return both.select(*keys, (F.coalesce("attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("attempts"), F.when(seen, F.col("error")).otherwise(F.col("last_error")).alias("last_error"), F.when(seen, F.lit(False)).otherwise(F.col("resolved")).alias("resolved"))


def mark_resolved(state: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Sets resolved and clears attempts of the keys that were seen again."""
    marked = state.join(seen.select(*keys).distinct().withColumn("_s", F.lit(True)), keys, "left")
    return marked.withColumn("resolved", F.coalesce("_s", "resolved")).withColumn("attempts", F.when(F.col("_s"), F.lit(0).cast("long")).otherwise(F.col("attempts"))).drop("_s")


def due(state: DataFrame, now: Column, limit: int) -> DataFrame:
    """Unresolved rows whose next retry has come, longest due first."""
    ready = state.where(~F.col("resolved") & (F.col("next_retry").isNull() | (F.col("next_retry") <= now)))
    return ready.orderBy(F.coalesce("next_retry", F.lit("1970-01-01").cast("timestamp")), "id").limit(limit)


def merge_tags(old: Column, new: Column) -> Column:
    """Map merge in which new values win."""
    return F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))


def match_key(html: Column, pdf: Column, ref: Column, title: Column, kind: Column, section: Column, raw: Column) -> Column:
    """The identity of a row: its html address, else pdf address, else reference and title, else title, kind and section, else the digest of its raw form."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    h, p, r, t = map(some, (html, pdf, ref, title))
    return F.when(h.isNotNull(), F.concat(F.lit("html:"), h)).when(p.isNotNull(), F.concat(F.lit("pdf:"), p)).when(r.isNotNull() & t.isNotNull(), F.concat_ws("|", F.lit("ref"), r, t)).when(t.isNotNull(), F.concat_ws("|", F.lit("title"), t, some(kind), some(section))).otherwise(F.concat(F.lit("raw:"), F.sha1(raw)))


def reconcile(old: DataFrame, new: DataFrame, keys: list[str], value: str, order: str, keep_removed: Column | None = None) -> DataFrame:
    """(keys, n, status): multiset match of two snapshots. The n-th row of a key on one side meets the n-th on the other.

    status: insert, update (the value differs), unchanged, remove; where ``keep_removed`` (over old's columns) holds, unchanged instead of remove.
    """
    def numbered(df: DataFrame, extra: list) -> DataFrame:
        return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")).select(*keys, "n", F.col(value).alias("v"), *extra)

    keep = (F.lit(False) if keep_removed is None else keep_removed).alias("keep")
    a, b = numbered(old, [keep, F.lit(True).alias("was")]), numbered(new, [F.lit(True).alias("is")]).withColumnRenamed("v", "w")
    both = a.join(b, [*keys, "n"], "full_outer")
    status = F.when(F.col("was").isNull(), "insert").when(F.col("is").isNull(), F.when(F.coalesce("keep", F.lit(False)), "unchanged").otherwise("remove")).when(F.col("v").eqNullSafe(F.col("w")), "unchanged").otherwise("update")
    return both.select(*keys, "n", status.alias("status"))


def canonical_signature(**fields: Column) -> Column:
    """SHA-1 of a row's JSON with its keys in order, nulls included: equal rows have equal signatures however they were laid out."""
    return F.sha1(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}).cast("binary"))


def invalidated(derived: DataFrame, statuses: DataFrame, keys: list[str]) -> DataFrame:
    """Derived rows that still hold: those of rows that a reconciliation updated or removed go."""
    return derived.join(statuses.where(F.col("status").isin("update", "remove")).select(*keys).distinct(), keys, "left_anti")


def purge(parents: DataFrame, children: list[tuple[DataFrame, str]], key: str, expired: Column, pinned: Column) -> tuple[DataFrame, list[DataFrame]]:
    """Drops expired parents that aren't pinned, and every child of a dropped parent."""
    gone = parents.where(expired & ~pinned).select(key)
    return parents.where(~(expired & ~pinned)), [c.join(gone.withColumnRenamed(key, k), k, "left_anti") for c, k in children]


def best_match(new: DataFrame, old: DataFrame, rules: list[Column], new_id: str, old_id: str, on: Column, order: list) -> DataFrame:
    """(new_id, old_id?): each new row with the old row that the earliest rule picks; ``on`` is the equi-join that all rules share."""
    rank = F.coalesce(*(F.when(r, F.lit(i)) for i, r in enumerate(rules)))
    pairs = new.join(old, on).withColumn("_rule", rank).where("_rule is not null")
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(new_id).orderBy("_rule", *order))).where("_n = 1").select(new_id, old_id, F.col("_rule").cast("long").alias("rule"))
    return new.select(new_id).join(best, new_id, "left")
