"""Date ranges in words, resolved against an explicit day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_range(phrase, as_of) -> Column:
    """struct(start, end) of a phrase: today, yesterday, tomorrow; this or last week, month, year; last N days (at most 180); recent (7 days). Null for anything else."""
    p = F.lower(phrase)
    week, month, year = (F.trunc(as_of, u).cast("date") for u in ("week", "month", "year"))
    n = F.least(F.regexp_extract(p, r"last ([0-9]+) days", 1).try_cast("int"), F.lit(180))
    rules = [
        (p == "today", as_of, as_of),
        (p == "yesterday", F.date_sub(as_of, 1), F.date_sub(as_of, 1)),
        (p == "tomorrow", F.date_add(as_of, 1), F.date_add(as_of, 1)),
        (p == "this week", week, as_of),
        (p == "last week", F.date_sub(week, 7), F.date_sub(week, 1)),
        (p == "this month", month, as_of),
        (p == "last month", F.add_months(month, -1), F.date_sub(month, 1)),
        (p == "this year", year, as_of),
        (p == "last year", F.add_months(year, -12), F.date_sub(year, 1)),
        (p.rlike(r"^last [0-9]+ days$") & (n > 0), F.date_sub(as_of, n - 1), as_of),
        (p == "recent", F.date_sub(as_of, 6), as_of),
    ]
    out = None
    for when, start, end in rules:
        pair = F.struct(start.alias("start"), end.alias("end"))
        out = F.when(when, pair) if out is None else out.when(when, pair)
    return out


def freshness_lag(last, as_of) -> Column:
    """Days since the last date, never below 0."""
    return F.greatest(F.datediff(as_of, last), F.lit(0)).cast("long")
