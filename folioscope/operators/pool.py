"""Assembly of a question's candidate pool from its lanes, and what is done to the pool before documents are read.

Lists are (qid, doc_id, rank), as in ``fusion``; one plan serves a batch of questions, and every gate is a join on qid.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .fusion import budgeted, margin_ratio, quota_merge
from .graph import families, similar_pairs, stale_members


@dataclass(frozen=True)
class Lane:
    """hits: a ranked list. anchor: its first documents are sure of a place in the pool. only_below: the lane counts only for questions for which the lane named there has fewer than the pool's least documents."""

    name: str
    hits: DataFrame
    weight: float = 1.0
    anchor: bool = False
    only_below: str | None = None


def _votes(rows: DataFrame, scores: Column, name: str) -> DataFrame:
    """rows with the place of each document by a summed vote, rounded so that sums of the same votes in another order tie; null where it has none."""
    rows = rows.withColumn("_v", F.round(scores, 12))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("_v").desc_nulls_last(), "doc_id"))
    return rows.withColumn(name, F.when(F.col("_v").isNotNull(), place.cast("long"))).drop("_v")


def _placed(lists: list[DataFrame]) -> DataFrame:
    """(qid, doc_id, r0, r1, ...): each document's first place in every list, or null."""
    rows = reduce(DataFrame.unionByName, (x.select("qid", "doc_id", F.lit(i).alias("lane"), "rank") for i, x in enumerate(lists)))
    return rows.groupBy("qid", "doc_id").agg(*(F.min(F.when(F.col("lane") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(lists))))


def _sum(*votes: Column) -> Column:
    """Of the votes that aren't null; null where all are."""
    return F.when(F.coalesce(*votes).isNotNull(), reduce(lambda a, b: a + b, (F.coalesce(v, F.lit(0.0)) for v in votes)))


def _vote(rank: Column, weight: float = 1.0, k: int = 60) -> Column:
    return F.lit(float(weight)) / (F.lit(k) + rank)


def lexical_lane(broad: DataFrame, strict: DataFrame, title: DataFrame, limit: int, least: int = 10, weights: tuple[float, float, float] = (1.0, 1.2, 0.9)) -> DataFrame:
    """(qid, doc_id, phase, rank) of three word searches: the strict one leads where it has ``least`` documents, else the broad one; the others are fused and merged in within the budget of ``fusion.budgeted``."""
    rows = _placed([broad, strict, title])
    leads = F.count("r1").over(Window.partitionBy("qid")) >= least
    rows = rows.withColumn("leads", leads)
    other = F.when(F.col("leads"), _vote(F.col("r0"), weights[0])).otherwise(_vote(F.col("r1"), weights[1]))
    rows = _votes(rows.withColumn("p", F.when(F.col("leads"), F.col("r1")).otherwise(F.col("r0"))), _sum(other, _vote(F.col("r2"), weights[2])), "s")
    return budgeted(rows.withColumn("s", F.when(F.col("s") <= limit, F.col("s"))), limit)


def facet_lane(runs: list[DataFrame], limit: int) -> DataFrame:
    """(qid, doc_id, phase, rank): the first run (the question itself) leads; those of its facets and of feedback terms are fused and merged in."""
    rows = _placed(runs).withColumnRenamed("r0", "p")
    votes = [_vote(F.col(f"r{i}")) for i in range(1, len(runs))]
    rows = _votes(rows, _sum(*votes), "s") if votes else rows.withColumn("s", F.lit(None).cast("long"))
    return budgeted(rows.withColumn("s", F.when(F.col("s") <= limit, F.col("s"))), limit)


def gated(hits: DataFrame, margins: DataFrame, ratio: float, barred: DataFrame) -> DataFrame:
    """A lane for the questions whose pool without it has a margin (qid, margin) below ``ratio``; never for the ``barred`` ones (qid)."""
    return hits.join(margins.where(F.col("margin") < ratio).select("qid"), "qid", "left_semi").join(barred.select("qid"), "qid", "left_anti")


def assemble(lanes: list[Lane], relaxed: list[Lane], questions: DataFrame, least: int, ratio: float = 0.12, probe: int = 5, small: int = 20, more: int = 20, anchors: int = 3) -> DataFrame:
    """(qid, doc_id, score, rank, anchor): the lanes' weighted fusion, in four steps.

    A question (qid, language) that filters by language and whose pool is thin or flat also counts the ``relaxed`` lanes,
    which ignore the language; a pool still flat grows by ``more`` documents; the first documents of the anchor lanes that
    are missing are appended. Lanes are lists without repeats. A document is one row with its votes and seats, and all
    steps are windows over qid, so a question's rows move once.
    """
    every = [(lane, False) for lane in lanes] + [(lane, True) for lane in relaxed]
    rows = reduce(DataFrame.unionByName, (lane.hits.select("qid", "doc_id", F.lit(i).alias("lane"), "rank", _vote(F.col("rank"), lane.weight).alias("vote")) for i, (lane, _) in enumerate(every)))
    w = Window.partitionBy("qid")
    number = {(lane.name, soft): i for i, (lane, soft) in enumerate(every)}
    for i, (lane, soft) in enumerate(every):
        if lane.only_below:
            full = F.sum((F.col("lane") == number[lane.only_below, soft]).cast("int")).over(w)
            rows = rows.withColumn("_full", full).where((F.col("lane") != i) | (F.col("_full") < least)).drop("_full")
    soft, sure = F.col("lane") >= len(lanes), F.col("lane").isin(*(i for i, (lane, _) in enumerate(every) if lane.anchor)) & (F.col("rank") <= anchors)
    seat = lambda when: F.min(F.when(when & sure, F.struct("lane", "rank")))
    docs = rows.groupBy("qid", "doc_id").agg(F.sum(F.when(~soft, F.col("vote"))).alias("own"), F.sum(F.when(soft, F.col("vote"))).alias("soft"), seat(~soft).alias("seat"), seat(soft).alias("soft_seat"))

    def margin(df: DataFrame, score: Column) -> DataFrame:
        """With score, place, many (documents, ``small`` at most) and margin."""
        df = df.withColumn("score", F.round(score, 12))
        df = df.withColumns({"place": F.row_number().over(w.orderBy(F.col("score").desc_nulls_last(), "doc_id")).cast("long"), "many": F.least(F.count("score").over(w), F.lit(small)), "top": F.max("score").over(w)})
        pivot = F.max(F.when(F.col("place") == F.least("many", F.lit(max(2, probe))), F.col("score"))).over(w)
        return df.withColumn("margin", F.coalesce(F.when(F.col("top") > 0, (F.col("top") - pivot) / F.col("top")), F.lit(0.0)))

    asked = questions.select("qid", F.col("language").isNotNull().alias("filters")).distinct()
    docs = margin(docs, F.col("own")).join(asked, "qid", "left")
    docs = docs.withColumn("thin", F.coalesce("filters", F.lit(False)) & ((F.col("many") < least) | (F.col("margin") < ratio)))
    docs = margin(docs, _sum(F.col("own"), F.when(F.col("thin"), F.col("soft")))).where("score is not null")
    docs = docs.withColumn("seat", F.coalesce("seat", F.when(F.col("thin"), F.col("soft_seat"))))
    docs = docs.withColumn("inside", F.col("place") <= F.when(F.col("margin") < ratio, small + more).otherwise(small)).where(F.col("inside") | F.col("seat").isNotNull())
    late = F.max(F.when(F.col("inside"), F.col("place"))).over(w) + F.row_number().over(w.orderBy("inside", "seat"))
    return docs.select("qid", "doc_id", "score", F.when(F.col("inside"), F.col("place")).otherwise(late).alias("rank"), (~F.col("inside")).alias("anchor"))


def hop(pool: DataFrame, hops: list[tuple], top: int = 5, most: int = 2, keep: int = 3, pin: int = 2) -> tuple[DataFrame, DataFrame]:
    """Further searches for what a question names beside its main matter: (qid, doc_id, rank, added, pinned), and the protected (qid, doc_id).

    ``hops`` are (kind, list without repeats) or (kind, list, direct), in order; a kind is "reference", "identity" or
    "facet", and ``direct`` is a list of title hits that is searched behind the first ``top``. Each hop appends those of its first ``top``
    documents that the pool lacks; at most ``most`` of them do so for a question. An identity, the question without what it asks
    about a matter, is only tried where no reference added anything; its first ``pin`` documents are pinned though the pool has them. Facets
    are only tried where neither did anything; a facet whose first document is in the pool is covered. The pool's own
    order stays. Pinned are all documents that were added, and an identity's. Of every hop
    tried, the first ``keep`` documents that were in the pool are protected from being dropped as old editions.

    Each hop depends on those before, so a question's few documents are arrays, over which an aggregation runs.
    """
    ids = lambda: F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    own = pool.groupBy("qid").agg(ids().alias("have"))
    lists = []
    for i, (kind, x, *direct) in enumerate(hops):
        rows = [(x.where(F.col("rank") <= top), 0), *((d, 1) for d in direct)]
        lists += [d.select("qid", F.lit(i).alias("hop"), F.lit(kind).alias("kind"), F.lit(side).alias("side"), "rank", "doc_id") for d, side in rows]
    found = reduce(DataFrame.unionByName, lists).groupBy("qid", "hop", "kind")
    of = lambda side: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "doc_id")))), lambda x: x["doc_id"])
    found = found.agg(of(0).alias("docs"), of(1).alias("direct"))
    found = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("hop", "kind", "docs", "direct"))).alias("hops"))
    none = F.array().cast("array<bigint>")

    def step(state, h):
        facet, identity = h["kind"] == "facet", h["kind"] == "identity"
        tried = (state["fired"] < most) & ~((facet | identity) & state["named"]) & (F.size(h["docs"]) > 0)
        direct = (state["fired"] < most) & ~facet & ~identity
        seen = F.filter(F.slice(h["docs"], 1, min(keep, top)), lambda d: F.array_contains(state["have"], d))
        open_ = (tried | direct) & ~(facet & F.array_contains(state["have"], F.get(h["docs"], 0)))
        new = F.when(F.coalesce(open_, F.lit(False)), F.array_except(F.concat(h["docs"], h["direct"]), state["have"])).otherwise(none)
        some = F.size(new) > 0
        anchors = F.when(identity & tried, F.slice(h["docs"], 1, pin)).otherwise(none)
        fires = some | (identity & tried)
        return F.struct(F.concat(state["have"], new).alias("have"), (state["fired"] + fires.cast("int")).alias("fired"), (state["named"] | (fires & ~facet)).alias("named"), F.concat(state["shield"], F.when(tried, seen).otherwise(none)).alias("shield"), F.concat(state["pins"], new, anchors).alias("pins"))

    start = F.struct(F.col("have").alias("have"), F.lit(0).alias("fired"), F.lit(False).alias("named"), none.alias("shield"), none.alias("pins"))
    empty = F.array().cast(dict(found.dtypes)["hops"])
    rows = own.join(found, "qid", "left").select("qid", F.size("have").alias("n"), F.aggregate(F.coalesce("hops", empty), start, step).alias("s"))
    out = rows.select("qid", "n", "s.pins", F.posexplode("s.have").alias("pos", "doc_id"))
    out = out.select("qid", "doc_id", (F.col("pos") + 1).cast("long").alias("rank"), (F.col("pos") >= F.col("n")).alias("added"), F.array_contains("pins", F.col("doc_id")).alias("pinned"))
    return out, rows.select("qid", F.explode(F.array_distinct("s.shield")).alias("doc_id"))


def fresh_hits(hits: DataFrame, vectors: DataFrame, dates: DataFrame, tau: float = 0.86, scan: int = 8, most: int = 3) -> DataFrame:
    """A hop's hits without the old editions among its first ``scan``: families are formed inside the hop's own pool, by vectors (id, embedding) and dates (id, date), before anything is pinned; a family that would lose more than ``most`` loses none."""
    head = hits.where(F.col("rank") <= scan).select("qid", F.col("doc_id").alias("id"))
    pairs = similar_pairs(head.join(vectors, "id"), "qid", tau)
    stale = stale_members(families(pairs, "qid"), dates, "qid", most=most).select("qid", F.col("id").alias("doc_id"))
    kept = hits.join(stale, ["qid", "doc_id"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("long"))


def current_editions(pool: DataFrame, stale: DataFrame, questions: DataFrame, protected: DataFrame) -> DataFrame:
    """The pool without its stale documents (qid, doc_id), ranks closed up.

    A question (qid, enumerates, windowed) that asks for a whole series or for a stated period keeps all, as does a pool
    of one document; protected (qid, doc_id) stay.
    """
    free = questions.where(~F.coalesce("enumerates", F.lit(False)) & ~F.coalesce("windowed", F.lit(False))).select("qid")
    free = free.join(pool.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").select("qid"), "qid", "left_semi")
    gone = stale.join(free, "qid", "left_semi").join(protected, ["qid", "doc_id"], "left_anti").select("qid", "doc_id")
    kept = pool.join(gone, ["qid", "doc_id"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("long"))


def read_budget(selected: DataFrame, pool: DataFrame, questions: DataFrame, least: int = 3, cap: int = 12, series_cap: int = 40, ratio: float = 0.12, more: int = 2) -> DataFrame:
    """The selected documents (qid, doc_id, rank) that are read: up to the cap, which is wider for a question (qid, enumerates) that asks for a series, and ``more`` where the pool is flat."""
    many = selected.groupBy("qid").agg(F.count("*").alias("n"))
    flat = margin_ratio(pool).select("qid", (F.col("margin") < ratio).alias("flat"))
    plan = many.join(questions.select("qid", "enumerates"), "qid", "left").join(flat, "qid", "left")
    room = F.greatest(F.lit(least), F.least(F.col("n"), F.when(F.col("enumerates"), series_cap).otherwise(cap))) + F.when(F.col("flat"), more).otherwise(0)
    return selected.join(plan.select("qid", room.alias("room")), "qid").where(F.col("rank") <= F.col("room")).drop("room")


def _grams(text: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substr(text, i, size))


#: Counters of how common grams are, by hash; broadcast.
COUNTERS = 1 << 18


def _shuffled(df: DataFrame) -> DataFrame:
    """df for a join that doesn't broadcast it: Spark takes what it makes of a table for as large as the compressed file, however many rows come of one, and would gather it on the driver."""
    return df.hint("merge")


def _rung(length: Column, size: int) -> Column:
    """The size of a token's grams: the largest of 1, ..., size, 2 size, 4 size and 8 size that it has."""
    out = F.least(length, F.lit(size))
    for n in (2 * size, 4 * size, 8 * size):
        out = F.when(length >= n, F.lit(n)).otherwise(out)
    return out


def holding(tokens: DataFrame, texts: DataFrame, size: int = 3) -> DataFrame:
    """(token, doc_id): candidates for the texts (doc_id, text) that hold a token (token): all that do, and some that don't.

    A token is looked up by the rarest of its grams, so this is an equi-join, and a token with a gram that no text has
    costs nothing. Grams have ``size`` letters (fewer, if the token is shorter) up to eight times as many, as long as the
    token allows: with short ones alone, of which there are only so many, a gram's texts would grow with the texts, and
    the candidates of as many tokens with their square. How rare a gram is comes from COUNTERS counters by hash; shared
    counters only cost candidates. Of the texts' grams only those are shuffled whose counters the tokens' rarest grams
    share. Empty tokens and nulls find nothing.
    """
    tokens = tokens.select("token").where("token <> ''").distinct()
    rung = _rung(F.length("token"), size)
    sizes = tokens.agg(F.collect_set(rung).alias("sizes"))  # one row of ``size`` + 3 numbers at most
    hashed = lambda grams: F.transform(grams, lambda g: F.xxhash64(g))
    every = F.array_distinct(F.flatten(F.transform("sizes", lambda n: hashed(_grams(F.col("text"), n)))))
    # A compressed table of short texts is one or two tasks' input; their grams are a hundred times as many rows.
    spread = texts.where("text is not null").repartition(texts.sparkSession.sparkContext.defaultParallelism, "doc_id")
    own = spread.crossJoin(F.broadcast(sizes)).select("doc_id", F.explode(every).alias("gram"))
    counter = lambda: F.pmod("gram", F.lit(COUNTERS)).cast("int")
    common = F.broadcast(own.groupBy(counter().alias("counter")).agg(F.count("*").alias("n")))  # COUNTERS rows at most
    parts = tokens.select("token", F.explode(F.array_distinct(hashed(_grams(F.col("token"), rung)))).alias("gram"))
    parts = parts.withColumn("counter", counter()).join(common, "counter", "left")
    rarest = parts.groupBy("token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0")
    rarest = rarest.select("token", F.col("x.gram").alias("gram"))
    wanted = F.broadcast(rarest.select(counter().alias("counter")).distinct())  # COUNTERS rows at most
    few = own.withColumn("counter", counter()).join(wanted, "counter", "left_semi").drop("counter")
    return rarest.join(_shuffled(few), "gram").select("token", "doc_id").distinct()


def reference_hits(asked: DataFrame, docs: DataFrame, questions: DataFrame, per_token: int = 5) -> DataFrame:
    """(qid, doc_id, score, rank): documents whose ref or title holds a token (qid, place, token) that a question names.

    For each token: the exact ref first, then refs that hold it, then titles, newest first, ``per_token`` at most, in the
    question's language if there are any, else in all. A document counts for the first token that finds it. ``questions``
    has qid and language, ``docs`` doc_id, ref, title, language and issue_date. Each token is searched once for each language that asks
    for it, whatever the number of questions, by ``holding``; nothing else is broadcast. A token's documents are cut to the
    first ``per_token`` of each language before they meet the questions' languages: no others come first in any of them.
    """
    batch = asked.join(_shuffled(questions), "qid", "left").select("qid", "place", F.upper("token").alias("token"), F.col("language").alias("want"))
    ref, title = F.upper("ref"), F.upper("title")
    texts = docs.select("doc_id", ref.alias("text")).unionByName(docs.select("doc_id", title.alias("text")))
    kind = F.when(ref == F.col("token"), 0).when(F.contains(ref, F.col("token")), 1).when(F.contains(title, F.col("token")), 2)
    found = holding(batch, texts).join(_shuffled(docs.select("doc_id", "ref", "title", "language", "issue_date")), "doc_id").withColumn("kind", kind).where("kind is not null")
    found = found.select("token", "language", "kind", "issue_date", "doc_id")
    within = Window.partitionBy("token", "language").orderBy("kind", F.desc("issue_date"), F.desc("doc_id"))
    found = found.withColumn("at", F.row_number().over(within)).where(F.col("at") <= per_token).drop("at")
    hits = found.join(batch.select("token", "want").distinct(), "token")
    hits = hits.withColumn("own", F.coalesce(F.col("want").isNull() | (F.col("language") == F.col("want")), F.lit(False)))
    order = Window.partitionBy("token", "want").orderBy(F.desc("own"), "kind", F.desc("issue_date"), F.desc("doc_id"))
    top = hits.select("token", "want", "own", "kind", "issue_date", "doc_id").withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_token)
    top = top.withColumn("some", F.max("own").over(Window.partitionBy("token", "want"))).where(F.col("own") | ~F.col("some"))
    top = top.select(F.col("token").alias("_token"), F.col("want").alias("_want"), "doc_id", "at")
    first = batch.join(top, (F.col("token") == F.col("_token")) & F.col("want").eqNullSafe(F.col("_want"))).groupBy("qid", "doc_id").agg(F.min(F.struct("place", "at")).alias("x"))
    scored = first.select("qid", "doc_id", F.greatest(F.lit(1.0), 5.0 - F.col("x.at") * 0.1).alias("score"), "x")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("x")).cast("long")).drop("x")


def ahead(first: DataFrame, rest: DataFrame) -> DataFrame:
    """(qid, doc_id, rank): one list before the other, each document once."""
    both = first.select("qid", "doc_id", F.lit(0).alias("side"), "rank").unionByName(rest.select("qid", "doc_id", F.lit(1).alias("side"), "rank"))
    once = both.groupBy("qid", "doc_id").agg(F.min(F.struct("side", "rank")).alias("x"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("x")).cast("long")).drop("x")


def snippets(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, score: Column) -> DataFrame:
    """(qid, doc_id, chunk_index, score): each candidate's best chunk over a question's several vectors (qid, place, vector); ties go to the earlier vector, then the earlier chunk. ``score`` is over chunks' and queries' columns; the vectors are a literal batch, broadcast."""
    pairs = candidates.select("qid", "doc_id").join(chunks, "doc_id").join(F.broadcast(queries), "qid").withColumn("score", score)
    order = F.struct("score", (-F.col("place")).alias("p"), (-F.col("chunk_index")).alias("c"))
    best = pairs.groupBy("qid", "doc_id").agg(F.max_by("chunk_index", order).alias("chunk_index"), F.max("score").alias("score"))
    return best


def payload(targets: DataFrame, meta: DataFrame, lists: list[tuple[DataFrame, int | None]], texts: DataFrame, cap: int, whole_chars: int = 12000, chunks: int = 6) -> DataFrame:
    """(rank, doc_id, title, chunks): what is read of each target (doc_id, rank): up to ``chunks`` chunks by the quotas of ``quota_merge`` over lists (doc_id, chunk_index, rank), each cut to ``cap`` characters; a document without chunks gives the head of its text. ``meta`` has doc_id, title and text, ``texts`` doc_id, chunk_index and text."""
    own = [(x.join(targets.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("qid"), F.col("chunk_index").alias("doc_id"), "rank"), n) for x, n in lists]
    chosen = quota_merge(own, chunks).select(F.col("qid").alias("doc_id"), F.col("doc_id").alias("chunk_index"), F.col("rank").alias("place"))
    cut = chosen.join(texts, ["doc_id", "chunk_index"]).select("doc_id", F.struct("place", F.substring("text", 1, cap).alias("text")).alias("c"))
    rows = cut.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["text"]).alias("chunks"))
    head = F.when(F.length("text") > 0, F.array(F.substring("text", 1, whole_chars))).otherwise(F.array().cast("array<string>"))
    return targets.select("doc_id", "rank").join(meta.select("doc_id", "title", "text"), "doc_id").join(rows, "doc_id", "left").select("rank", "doc_id", "title", F.coalesce("chunks", head).alias("chunks"))


def named_target(topic: Column, title: Column, folded: bool = False) -> Column:
    """struct(hits, ratio): how many of the topic's terms (folded, an array) the title holds, and which share that is. A title that is ``folded`` already isn't folded again for every term."""
    low = title if folded else fold(title)
    hits = F.size(F.filter(topic, lambda x: F.contains(low, x)))
    return F.struct(hits.cast("long").alias("hits"), F.when(F.size(topic) > 0, hits / F.size(topic)).otherwise(0.0).alias("ratio"))


def forced_target(pairs: DataFrame, least: int = 2, ratio: float = 0.5) -> DataFrame:
    """(qid, doc_id): the document that a question names by type and topic, of rows (qid, doc_id, target): enough of the topic's terms in its title, more than any other; an ambiguous question has none."""
    fit = pairs.where((F.col("target.hits") >= least) & (F.col("target.ratio") >= ratio))
    best = fit.withColumn("top", F.max("target.hits").over(Window.partitionBy("qid"))).where(F.col("target.hits") == F.col("top"))
    return best.withColumn("n", F.count("*").over(Window.partitionBy("qid"))).where("n = 1").select("qid", "doc_id")


def best_portal_hit(exact: DataFrame) -> DataFrame:
    """(qid, hit): of a portal's hits (qid, hit, place, topic, same_language) whose title is the reference's, the one with the most of the topic, then in the question's language, then the first."""
    order = Window.partitionBy("qid").orderBy(F.desc("topic"), F.desc("same_language"), "place")
    return exact.withColumn("n", F.row_number().over(order)).where("n = 1").select("qid", "hit")
