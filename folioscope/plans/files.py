"""Files that the library writes and reads again, from whole tables: what comes back is what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..workers import Shared
from . import query

TURNS = "conv_id long, turn long, role string, text string"


def _folder(df, name: str):
    """(session, folder) for one run's files, in the shared folder."""
    return df.sparkSession, Shared(df.sparkSession, name).base


@query("""select conv_id, turn::bigint turn, role, md5(case turn % 4 when 0 then 'he said "no", ' || text || chr(10) || '"' when 1 then nullif(text, text) when 2 then '' else ' ' || text || ', ' end) digest from conversations""")
def csv_round_trip(t):
    """Turns as CSV and back, with quotes, commas and ends of lines in a quarter of them, nulls, empty strings, and spaces at the ends in the others."""
    k = F.col("turn") % 4
    odd = F.concat(F.lit('he said "no", '), "text", F.lit('\n"'))
    text = F.when(k == 0, odd).when(k == 2, F.lit("")).when(k == 3, F.concat(F.lit(" "), "text", F.lit(", ")))
    rows = t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text.alias("text"))
    spark, base = _folder(rows, "csv")
    sources.write_csv(rows, base)
    return sources.read_csv(spark, base, TURNS).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""select doc_id, nullif(lang, 'de') lang, case when doc_id % 3 = 0 then source when doc_id % 3 = 1 then lang end publisher, n_chars::bigint n_chars, md5(text) digest from documents""")
def json_feed_round_trip(t):
    """Documents as a landed feed of JSON lines, one object each, read with the feed's schema; the publisher has two places, of which one may be empty or missing."""
    k = F.pmod("doc_id", F.lit(3))
    issuer = F.struct(F.when(k == 0, F.col("source")).when(k == 1, F.lit("")).alias("name"), F.when(k == 1, F.col("lang")).alias("code"))
    rows = t("documents").select("doc_id", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"), issuer.alias("issuer"), F.col("n_chars").cast("long").alias("n_chars"), "text")
    spark, base = _folder(rows, "feed")
    sources.write_report(rows, base)
    back = sources.json_feed(spark, base, rows.schema)
    publisher = sources.fields("issuer", publisher=("$.name", "$.code"))
    return back.withColumn("issuer", F.to_json("issuer")).select("doc_id", "lang", *publisher, "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""select page_id, url, page_id % 2 = 0 annex, md5(html) body from pages""")
def json_details(t):
    """Details of pages, an object each with body and annex flag, landed as text and read by their paths."""
    detail = F.struct("page_id", "url", F.struct(F.col("html").alias("body"), (F.col("page_id") % 2 == 0).alias("annex")).alias("content"))
    rows = t("pages").select(F.to_json(detail).alias("value"))
    spark, base = _folder(rows, "details")
    rows.write.text(base)
    got = spark.read.schema("value string").text(base).select(F.get_json_object("value", "$.page_id").cast("long").alias("page_id"), *sources.fields("value", url=("$.url",), annex=("$.content.annex",), body=("$.content.body",)))
    return got.select("page_id", "url", (F.col("annex") == "true").alias("annex"), F.md5(F.col("body").cast("binary")).alias("body"))


@query("""select conv_id, count(*) traced, sum(case when turn % 2 = 0 then length(text) end)::bigint n_chars, bool_or(role = 'system') prompted from conversations group by 1""")
def trace_log(t):
    """Traces of turns appended to one log, those of even turns with their text, then the others without; read back as one table and summed."""
    rows = t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    spark, base = _folder(rows, "log")
    even = F.col("turn") % 2 == 0
    sources.append_log(rows.where(even), base)
    sources.append_log(rows.where(~even).drop("text"), base)
    back = sources.json_feed(spark, base, TURNS)
    return back.groupBy("conv_id").agg(F.count("*").alias("traced"), F.sum(F.length("text").cast("long")).alias("n_chars"), F.bool_or(F.col("role") == "system").alias("prompted"))
