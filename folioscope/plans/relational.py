"""Filters, joins, aggregates, windows and sets that the application issues as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import freshness_lag, relative_range
from ..functions.text import fold
from ..operators import etl
from . import query


@query("select doc_id, lang, n_chars from documents where lang in ('en', 'fr') and source = 'src3' and n_chars >= 800")
def conjunctive_filters(t):
    return t("documents").where(F.col("lang").isin("en", "fr") & (F.col("source") == "src3") & (F.col("n_chars") >= 800)).select("doc_id", "lang", "n_chars")


@query("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')")
def anti_not_exists(t):
    urgent = t("orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return t("customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select distinct o_custkey from orders where o_orderpriority = '2-HIGH')")
def anti_not_in(t):
    keys = t("orders").where("o_orderpriority = '2-HIGH'").select("o_custkey")
    return etl.not_in(t("customer").select("c_custkey"), "c_custkey", keys, "o_custkey")


@query("select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') then 'some' else 'none' end partial from customer where nullif(c_custkey % 5, 0) not in (select nullif(s_suppkey % 3, 0) from supplier where s_suppkey % 3 <> 0)")
def anti_not_in_nulls(t):
    """A null on the outer side is in no result; one in the list would empty it."""
    keys = t("supplier").select(F.nullif(F.pmod("s_suppkey", F.lit(3)), F.lit(0)).alias("k")).where("k is not null")
    kept = etl.not_in(t("customer").select("c_custkey", F.nullif(F.pmod("c_custkey", F.lit(5)), F.lit(0)).alias("m")), "m", keys, "k")
    some = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("partial", F.lit("some"))
    return kept.join(some, "c_custkey", "left").select("c_custkey", F.coalesce("partial", F.lit("none")).alias("partial"))


@query("select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity >= 49)")
def semi_join(t):
    return t("supplier").join(t("lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("select c_custkey, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by 1")
def zero_child_counts(t):
    counts = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t("customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("select l_orderkey, l_linenumber::bigint line, c_mktsegment, o_orderpriority from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where l_quantity = 50 and o_orderstatus = 'F'")
def snowflake_join(t):
    o = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = t("customer").select("c_custkey", "c_mktsegment")
    li = t("lineitem").where("l_quantity = 50").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "line", "c_mktsegment", "o_orderpriority")


@query("select min(cast(o_orderdate as date)) lo, max(cast(o_orderdate as date)) hi, count(*) n, count(distinct o_custkey) customers from orders")
def date_bounds(t):
    return t("orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"), F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("select cast(ts as date) \"day\", event_type, count(*) n, count(distinct user_id) users, round(sum(value), 4) total from events group by 1, 2")
def grouped_counts(t):
    return t("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) n from orders")
def correlated_count(t):
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t("orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("select doc_id, case when lang = 'en' then 0 when source like 'src1%' then 1 else 2 end::bigint as \"class\", row_number() over (order by case when lang = 'en' then 0 when source like 'src1%' then 1 else 2 end, n_chars desc, doc_id) as place from documents order by place limit 50")
def case_ranked_order(t):
    kind = F.when(F.col("lang") == "en", 0).when(F.col("source").startswith("src1"), 1).otherwise(2).cast("long")
    top = t("documents").select("doc_id", "n_chars", kind.alias("class")).orderBy("class", F.desc("n_chars"), "doc_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("class", F.desc("n_chars"), "doc_id")).cast("long")).drop("n_chars")


@query("select doc_id from documents where upper(split_part(text, chr(10), 1)) like 'THE%' or strip_accents(lower(split_part(text, chr(10), 1))) like '%cion%' or regexp_matches(split_part(text, chr(10), 1), '(?i)^in\\s')")
def title_patterns(t):
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return t("documents").where(F.upper(title).startswith("THE") | F.contains(fold(title), F.lit("cion")) | title.rlike(r"(?i)^in\s")).select("doc_id")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events where cast(json_extract_string(props, '$.k') as bigint) > 90")
def json_predicate(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").select("event_id", k.alias("k")).where("k > 90")


@query("select event_id, user_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n = 1")
def newest_per_key(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t("events").withColumn("n", F.row_number().over(w)).where("n = 1").select("event_id", "user_id", "ts")


@query("with k as (select o_orderkey, o_custkey, count(*) over (partition by o_custkey) n from orders) select o_orderkey, n from k where n <= 12")
def degree_filter(t):
    return t("orders").withColumn("n", F.count("*").over(Window.partitionBy("o_custkey"))).where("n <= 12").select("o_orderkey", "n")


@query("select coalesce(event_type, 'ALL') event_type, coalesce(cast(\"day\" as varchar), 'ALL') \"day\", count(*) n from (select event_type, cast(ts as date) \"day\" from events) group by rollup (event_type, \"day\")")
def rollup_counts(t):
    d = t("events").select("event_type", F.to_date("ts").cast("string").alias("day"))
    return d.rollup("event_type", "day").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("ALL")).alias("event_type"), F.coalesce("day", F.lit("ALL")).alias("day"), "n")


@query("select c_custkey from customer where c_acctbal > 0 intersect select o_custkey from orders where o_orderpriority = '1-URGENT'")
def set_intersection(t):
    return t("customer").where("c_acctbal > 0").select("c_custkey").intersect(t("orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("select c_custkey from customer except select o_custkey from orders where o_orderstatus = 'P'")
def set_difference(t):
    return t("customer").select("c_custkey").exceptAll(t("orders").where("o_orderstatus = 'P'").select("o_custkey")).distinct()


@query("select conv_id, turn::bigint turn, role, substring(text, 1, 600) text from (select *, row_number() over (partition by conv_id order by turn desc) n from conversations) where n <= 6")
def history_window(t):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t("conversations").withColumn("n", F.row_number().over(w)).where("n <= 6").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.substring("text", 1, 600).alias("text"))


@query("select conv_id, array_to_string(list(role || ': ' || substring(text, 1, 600) order by turn), ' / ') history from conversations group by 1")
def history_format(t):
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, 600)).alias("s"))))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["s"]), " / ").alias("history"))


PHRASES = ["today", "yesterday", "tomorrow", "this week", "last week", "this month", "last month", "this year", "last year", "last 10 days", "last 999 days", "recent", "someday"]


@query(f"""with p(phrase) as (values {', '.join(f"('{p}')" for p in PHRASES)}), d as (select phrase, a from p, (select distinct o_orderdate::date a from orders)), w as (select *, date_trunc('week', a)::date wk, date_trunc('month', a)::date mo, date_trunc('year', a)::date yr from d)
select phrase, a as_of, case phrase when 'today' then a when 'yesterday' then a - 1 when 'tomorrow' then a + 1 when 'this week' then wk when 'last week' then wk - 7 when 'this month' then mo when 'last month' then (mo - interval 1 month)::date when 'this year' then yr when 'last year' then (yr - interval 1 year)::date when 'last 10 days' then a - 9 when 'last 999 days' then a - 179 when 'recent' then a - 6 end as "start",
case phrase when 'today' then a when 'yesterday' then a - 1 when 'tomorrow' then a + 1 when 'this week' then a when 'last week' then wk - 1 when 'this month' then a when 'last month' then mo - 1 when 'this year' then a when 'last year' then yr - 1 when 'last 10 days' then a when 'last 999 days' then a when 'recent' then a end as "end" from w""")
def relative_dates(t):
    """Every phrase as of every day on which there is an order."""
    days = t("orders").select(F.col("o_orderdate").cast("date").alias("as_of")).distinct()
    rows = days.withColumn("phrase", F.explode(F.array(*map(F.lit, PHRASES))))
    return rows.withColumn("r", relative_range(F.col("phrase"), F.col("as_of"))).select("phrase", "as_of", "r.start", "r.end")


@query("select event_type, greatest(date '2024-01-20' - max(cast(ts as date)), 0)::bigint lag from events group by 1")
def freshness(t):
    return t("events").groupBy("event_type").agg(freshness_lag(F.to_date(F.max("ts")), F.lit("2024-01-20").cast("date")).alias("lag"))


@query("select o_orderstatus, o_orderpriority, count(*) n, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_quantity), 4) quantity from lineitem join orders on o_orderkey = l_orderkey group by 1, 2")
def revenue_by_status(t):
    li = t("lineitem").select("l_orderkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("r"), 2).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("quantity"))


@query("select n_name, r_name, count(*) suppliers, round(sum(s_acctbal), 2) balance from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by 1, 2")
def suppliers_by_nation(t):
    return t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
