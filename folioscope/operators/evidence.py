"""Evidence for answers, and the checks of answers against it."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUMBER, canonical_number, coverage, numbers, squeeze, total_occurrences
from ..workers import ship


def best_per_document(chunks: DataFrame, score: Column, limit: int, least: Column) -> DataFrame:
    """(doc_id, chunk_index, text, score): each document's best chunk, the best ``limit`` documents; ties to the earlier chunk and smaller document."""
    # A filter on the score would be pushed below it and count everything twice; a document's maximum needs none.
    rows = chunks.select("doc_id", "text", F.struct(F.when(least, score).alias("score"), (-F.col("chunk_index")).alias("first")).alias("key"))
    best = rows.groupBy("doc_id").agg(F.max("key").alias("key"), F.max_by("text", "key").alias("text")).where("key.score > 0")
    return best.select("doc_id", (-F.col("key.first")).alias("chunk_index"), "text", F.col("key.score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def lexical_evidence(chunks: DataFrame, terms: list[str], least: int = 2, limit: int = 3) -> DataFrame:
    low = F.lower("text")
    return best_per_document(chunks, total_occurrences(low, terms), limit, coverage(low, terms) >= least)


def density_evidence(chunks: DataFrame, pattern: str, limit: int = 2) -> DataFrame:
    return best_per_document(chunks, F.regexp_count("text", F.lit(pattern)).cast("long"), limit, F.lit(True))


def coverage_ranking(evidence: DataFrame, phrases: list[str], entities: list[str], terms: list[str], limit: int = 8) -> DataFrame:
    """Evidence by phrases, entities, terms covered, and occurrences."""
    low = F.lower("text")
    keys = {"phrases": coverage(low, phrases), "entities": coverage(low, entities), "terms": coverage(low, terms), "hits": total_occurrences(low, terms)}
    rows = evidence.withColumns(keys)
    return rows.orderBy(*(F.desc(k) for k in keys), "doc_id", "chunk_index").limit(limit)


def diverse_chunks(chunks: DataFrame, targets: list[str], most: int) -> DataFrame:
    """(doc_id, chunk_index, pick): greedy cover of the targets by each document's chunks: most new targets, then most targets, then most occurrences, then the earlier chunk.

    Each pick depends on those before, so a document's match table (a few counts a chunk, no text) is one array, over
    which an aggregation in the JVM picks ``most`` times.
    """
    low = F.lower("text")
    hits = F.array(*(((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int") for t in targets))
    table = chunks.select("doc_id", "chunk_index", hits.alias("hits"))
    rows = table.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_index", F.transform("hits", lambda h: h > 0).alias("has"), F.size(F.filter("hits", lambda h: h > 0)).alias("kinds"), F.aggregate("hits", F.lit(0), lambda s, h: s + h).alias("total"))).alias("rows"))
    count = lambda flags: F.size(F.filter(flags, lambda x: x))

    def step(state, _):
        key = lambda r: F.struct(count(F.zip_with(state["left"], r["has"], lambda a, b: a & b)).alias("new"), r["kinds"].alias("kinds"), r["total"].alias("total"), (-r["chunk_index"]).alias("first"), r["has"].alias("has"))
        best = F.array_max(F.transform(F.filter("rows", lambda r: ~F.array_contains(state["picks"], r["chunk_index"])), key))
        after = F.struct(F.zip_with(state["left"], best["has"], lambda a, b: a & ~b).alias("left"), F.concat(state["picks"], F.array(-best["first"])).alias("picks"))
        return F.when(F.coalesce(best["new"], F.lit(0)) > 0, after).otherwise(state)

    start = F.struct(F.array(*[F.lit(True)] * len(targets)).alias("left"), F.array().cast("array<bigint>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["picks"]
    return rows.select("doc_id", F.posexplode(picks).alias("n", "chunk_index")).select("doc_id", "chunk_index", (F.col("n") + 1).cast("long").alias("pick"))


def keyword_window(chunks: DataFrame, terms: list[str], cap: int) -> DataFrame:
    """(doc_id, chunk_index, text): chunks of at most ``cap`` characters; of a longer one its first half and the window with the most new terms, or its head where no window adds any."""
    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "chunk_index": b.chunk_index, "text": [windowed(t, terms, cap) for t in b.text]})

    ship(chunks.sparkSession)
    return chunks.select("doc_id", "chunk_index", "text").mapInPandas(run, "doc_id long, chunk_index long, text string")


JOIN = " … "


def windowed(text: str, terms: list[str], cap: int) -> str:
    if len(text) <= cap:
        return text
    low = text.lower()
    head, room = cap // 2, cap - cap // 2 - len(JOIN)
    places = sorted({m.start() for t in terms for m in re.finditer(re.escape(t), low) if m.start() >= head}) if len(low) == len(text) and room > 0 else []
    known = {t for t in terms if t in low[:head]}

    def value(start: int) -> tuple:
        part = low[start : start + room]
        kinds = {t for t in terms if t in part}
        return len(kinds - known), len(kinds), sum(part.count(t) for t in terms), -start

    lead = min(150, room // 2)
    starts = {max(head, min(p - lead, len(text) - room)) for p in places}
    best = max(starts, key=value, default=None)
    if best is None or not value(best)[0]:
        return text[:cap]
    return text[: _word_start(text, head, head - 30)] + JOIN + text[(at := _word_start(text, best, max(head, best - 30))) : at + room]


def _word_start(text: str, at: int, least: int) -> int:
    """The first place at or before ``at`` that follows white space, ``least`` at the lowest."""
    while at > least and not text[at - 1].isspace():
        at -= 1
    return at


def unsupported_numbers(answer: Column, source: Column) -> Column:
    """Canonical numbers of the answer that the source doesn't have."""
    return F.array_except(numbers(answer), numbers(source))


def valid_citations(cited: Column, scope: Column, evidence: Column) -> Column:
    """Citations within the scope, each once; where none is left, the evidence's."""
    own = F.array_intersect(F.array_distinct(cited), scope)
    return F.when(F.size(own) > 0, own).otherwise(F.array_intersect(F.array_distinct(evidence), scope))


def citation_id(raw: Column) -> Column:
    """12, "12" or "doc_12" -> 12; null for anything else."""
    return F.coalesce(raw.try_cast("long"), F.nullif(F.regexp_extract(raw, r"(?i)^\s*doc[_ ]?([0-9]+)\s*$", 1), F.lit("")).try_cast("long"))


def case_scores(answer: Column, must: Column, must_not: Column, required: Column, found: Column) -> Column:
    """struct(recall, faithful, passed, failure) of an answer case."""
    low = F.lower(answer)
    has = lambda terms: F.filter(terms, lambda t: F.contains(low, F.lower(t)))
    hit, bad = F.size(has(must)), F.size(has(must_not))
    recall = F.when(F.size(must) > 0, hit / F.size(must)).otherwise(1.0)
    cited = F.when(required <= 0, 1.0).otherwise(F.least(F.lit(1.0), found / required))
    faithful = F.when(bad > 0, 0.0).otherwise(cited)
    failure = F.when(faithful >= 0.85, F.lit(None).cast("string")).when(required > found, "citation_gap").when((bad == 0) & (hit < F.size(must)) & (hit > 0), "lexical_mismatch").otherwise("content_failure")
    return F.struct(recall.alias("recall"), faithful.alias("faithful"), (faithful >= 0.85).alias("passed"), failure.alias("failure"))


def first_json(text: str | None) -> str | None:
    """The first balanced JSON object in a text, past code fences and <think> blocks; null if there is none."""
    text = re.sub(r"(?s)<think>.*?</think>", "", text or "")
    for m in re.finditer(r"\{", text):
        try:
            value, _ = json.JSONDecoder().raw_decode(text, m.start())
        except (ValueError, RecursionError):
            continue
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return None


def json_objects(df: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({key: b[key], "json": [first_json(t) for t in b[text]]})

    ship(df.sparkSession)
    return df.select(key, text).mapInPandas(run, f"{key} long, json string")


def dedupe(evidence: DataFrame) -> DataFrame:
    """The first row of each document and squeezed quote; empty quotes go."""
    key = F.lower(squeeze("quote"))
    w = Window.partitionBy("doc_id", "key").orderBy("ord")
    return evidence.withColumn("key", key).where("key <> ''").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "key")


def reground(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, ord, status, chunk_index): verbatim where a chunk holds the quote, stitched where one holds all its parts between ellipses, else nearest, the chunk with the most of its words.

    Texts and quotes are folded once, before they meet. Whole quotes and parts are looked for first; word by word only
    for the quotes that no chunk holds. A chunk that holds a quote or its parts has all words without an ellipsis, so only the others are looked for there.
    """
    folded = chunks.select("doc_id", "chunk_index", F.lower("text").alias("low"))
    parts = F.filter(F.transform(F.split(F.lower("quote"), "…|\\.\\.\\."), squeeze), lambda p: F.length(p) > 0)
    words = F.array_distinct(F.split(F.lower(squeeze("quote")), " "))
    quotes = evidence.select("doc_id", "ord", F.lower("quote").alias("whole"), parts.alias("parts"), words.alias("words"))
    loose = F.filter("words", lambda x: F.contains(x, F.lit("…")) | F.contains(x, F.lit("...")))
    grade = F.when(F.contains("low", "whole"), 2).when((F.size("parts") > 1) & F.forall("parts", lambda p: F.contains("low", p)), 1)
    common = lambda some: F.size(F.filter(some, lambda x: F.contains("low", x)))
    best = F.max_by(F.struct("grade", "chunk_index"), F.struct("grade", "common", -F.col("chunk_index"))).alias("b")
    held = quotes.join(folded, "doc_id").withColumn("grade", grade).where("grade is not null").withColumn("common", common(loose)).groupBy("doc_id", "ord").agg(best)
    rest = quotes.join(held.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti").join(folded, "doc_id")
    near = rest.withColumns({"grade": F.lit(0), "common": common("words")}).groupBy("doc_id", "ord").agg(best)
    name = F.when(F.col("b.grade") == 2, "verbatim").when(F.col("b.grade") == 1, "stitched").otherwise("nearest")
    return held.unionByName(near).select("doc_id", "ord", name.alias("status"), F.col("b.chunk_index").alias("chunk_index"))


def validation(answer: Column, cited: Column, scope: Column, source: Column) -> Column:
    """struct(empty, uncited, out_of_scope, unsupported, valid) of an answer."""
    empty, bare = F.length(F.trim(answer)) == 0, F.size(cited) == 0
    outside, loose = F.size(F.array_except(cited, scope)) > 0, F.size(unsupported_numbers(answer, source)) > 0
    return F.struct(empty.alias("empty"), bare.alias("uncited"), outside.alias("out_of_scope"), loose.alias("unsupported"), (~(empty | bare | outside | loose)).alias("valid"))


def fallback_summary(titles: Column, most: int, lead: str) -> Column:
    """The lead and the first titles as lines."""
    return F.concat(F.lit(lead), F.array_join(F.transform(F.slice(titles, 1, most), lambda t: F.concat(F.lit("\n- "), t)), ""))


def facts(chunks: DataFrame, pattern: str, most: int = 6) -> DataFrame:
    """(doc_id, chunk_index): each document's first chunks that match, or its first chunk where none does."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("hit"), "chunk_index")
    rows = chunks.withColumn("hit", F.col("text").rlike(pattern)).withColumn("n", F.row_number().over(w))
    return rows.where((F.col("hit") & (F.col("n") <= most)) | (F.col("n") == 1)).select("doc_id", "chunk_index", "hit")


def extras(candidates: DataFrame, chosen: DataFrame, score: Column, most: int) -> DataFrame:
    """(qid, doc_id, rank): the best-scored candidates that aren't chosen yet."""
    w = Window.partitionBy("qid").orderBy(F.desc("value"), "rank")
    rest = candidates.join(chosen.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").withColumn("value", score).where("value > 0")
    return rest.withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= most).select("qid", "doc_id", F.col("k").alias("rank"))


def needs_review(error: Column, abstained: Column, grounded: Column, cited: Column) -> Column:
    """A run's answer went wrong: an error, an abstention that nothing grounds, or the norm isn't cited."""
    return F.coalesce(error, F.lit(False)) | (abstained & ~grounded) | ~cited


ABSTAIN = r"(?i)\b(no consta|not stated|no information|no se indica|no s'indica)\b"


def abstains(answer: Column) -> Column:
    return answer.rlike(ABSTAIN) & (F.length(answer) <= 200)


def best_for_questions(rows: DataFrame, score: Column, most: int) -> DataFrame:
    """(qid, doc_id, chunk_index, score, quote): of rows (qid, doc_id, chunk_index, text) the best chunk of each document, the best ``most`` documents of each question; ties to the earlier chunk and smaller document. Scores of 0 or less don't count."""
    chunk = Window.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "chunk_index")
    document = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    one = rows.withColumn("score", score).where("score > 0").withColumn("_n", F.row_number().over(chunk)).where("_n = 1")
    top = one.withColumn("_m", F.row_number().over(document)).where(F.col("_m") <= most)
    return top.select("qid", "doc_id", "chunk_index", "score", F.substring(F.trim("text"), 1, 800).alias("quote"))


#: A number that is a word of its own.
AMOUNT = r"(?:^|[^\p{L}\p{N}_])[0-9][0-9.,]*(?:$|[^\p{L}\p{N}_])"


def program_totals(read: DataFrame, chunks: DataFrame, kinds: list[str], cue: str, most: int = 2) -> DataFrame:
    """The total that calls and rules state: of the read documents (qid, doc_id, rank, subkind) of the given kinds, the chunk with a cue and a number, first by the document's place, then by how many cues it has."""
    size = read.groupBy("qid").agg(F.count("*").alias("size"))
    rows = read.where(F.lower(F.trim("subkind")).isin(*kinds)).join(size, "qid").join(chunks.select("doc_id", "chunk_index", "text"), "doc_id")
    rows = rows.where(F.col("text").rlike(cue) & F.col("text").rlike(AMOUNT))
    money = (F.contains("text", F.lit("€")) | F.contains(F.lower("text"), F.lit("euro"))).cast("int")
    return best_for_questions(rows, ((F.col("size") - F.col("rank") + 1) * 100 + F.regexp_count("text", F.lit(cue)) + money).cast("long"), most)


def ranked_evidence(evidence: DataFrame, chunks: DataFrame, phrases: list[str], entities: list[str], terms: list[str], most: int = 8, extra: int = 4) -> DataFrame:
    """(qid, doc_id, quote, pinned, rank) of evidence (qid, ord, doc_id, quote, pinned) and of chunks (qid, doc_id, chunk_index, text).

    Order: phrases, entities and terms covered, occurrences, then as it came. A quote that covers nothing takes the score
    of its document's best chunk. Best chunks of documents without evidence join it, ``extra`` at most, two more where
    there are phrases or entities, which they must then cover. If an unpinned quote covers an entity, unpinned ones that
    don't go; else the same with phrases. Beyond ``most`` rows, pinned ones stay first.
    """
    def keys(text: str) -> list[Column]:
        low = F.lower(text)
        return [coverage(low, phrases).alias("p"), coverage(low, entities).alias("e"), coverage(low, terms).alias("t"), total_occurrences(low, terms).alias("h")]

    w = Window.partitionBy("qid", "doc_id").orderBy(F.desc("key"), "chunk_index")
    best = chunks.select("qid", "doc_id", "chunk_index", "text", F.struct(*keys("text")).alias("key")).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("qid", "doc_id", F.substring("text", 1, 800).alias("chunk"), F.col("key").alias("own"))
    rows = evidence.withColumn("key", F.struct(*keys("quote"))).join(best.select("qid", "doc_id", "own"), ["qid", "doc_id"], "left")
    bare = (F.col("key.p") == 0) & (F.col("key.e") == 0) & (F.col("key.t") == 0)
    rows = rows.select("qid", "doc_id", "quote", "pinned", "ord", F.when(bare, F.coalesce("own", "key")).otherwise(F.col("key")).alias("key"))
    new = best.join(evidence.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").where((F.col("own.p") > 0) | (F.col("own.e") > 0) | (F.col("own.t") > 0))
    new = new.where(F.col("own.e") > 0) if entities else new
    new = new.where((F.col("own.p") > 0) | (F.col("own.e") > 0)) if phrases else new
    order = Window.partitionBy("qid").orderBy(F.desc("own"), "doc_id")
    new = new.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= extra + (2 if phrases or entities else 0))
    new = new.join(evidence.select("qid").distinct(), "qid", "left_semi").select("qid", "doc_id", F.col("chunk").alias("quote"), F.lit(False).alias("pinned"), (F.col("_n") + (1 << 20)).cast("long").alias("ord"), F.struct(*keys("chunk")).alias("key"))
    both = rows.unionByName(new)
    some = lambda k: F.max((~F.col("pinned") & (F.col(f"key.{k}") > 0)).cast("int")).over(Window.partitionBy("qid")) == 1
    both = both.withColumns({"by_e": some("e"), "by_p": some("p")})
    both = both.where(F.col("pinned") | F.when(F.col("by_e"), F.col("key.e") > 0).when(F.col("by_p"), F.col("key.p") > 0).otherwise(True))
    place = Window.partitionBy("qid").orderBy(F.desc("key"), "ord")
    first = Window.partitionBy("qid", "doc_id", F.lower(squeeze("quote"))).orderBy("place")
    both = both.withColumn("place", F.row_number().over(place)).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    both = both.withColumn("many", F.count("*").over(Window.partitionBy("qid")))
    final = Window.partitionBy("qid").orderBy(F.when(F.col("many") > most, ~F.col("pinned")).otherwise(False), "place")
    return both.withColumn("rank", F.row_number().over(final).cast("long")).where(F.col("rank") <= most).select("qid", "doc_id", "quote", "pinned", "rank")


def unit_claims(text: Column, units: dict[str, str], reach: int = 16) -> Column:
    """struct of arrays, one for each unit: the canonical numbers with the unit's pattern within ``reach`` characters; a number claims the first unit that fits. Numbers right before a closing bracket are list marks."""
    number = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    # The text as gaps and numbers in turn; of these, the ``reach`` numbers before or behind another hold ``reach`` characters at least.
    turns = F.flatten(F.transform(F.arrays_zip(F.split(text, NUMBER, -1).alias("g"), number.alias("n")), lambda x: F.array(x["g"], F.coalesce(x["n"], F.lit("")))))

    def context(s: Column, n: Column, i: Column) -> Column:
        lo = F.greatest(2 * i + 2 - 2 * reach, F.lit(1))
        before = F.array_join(F.slice(s["t"], lo, 2 * i + 2 - lo), "")
        after = F.substring(F.array_join(F.slice(s["t"], 2 * i + 3, 2 * reach + 1), ""), 1, reach)
        return F.struct(n.alias("n"), F.lower(F.concat(F.right(before, F.lit(reach)), n, after)).alias("near"), F.startswith(after, F.lit(")")).alias("mark"))

    def claims(rows: Column, name: str, pattern: str, before: list[str]) -> Column:
        fits = lambda r: ~r["mark"] & r["near"].rlike(pattern) & ~reduce(lambda a, p: a | r["near"].rlike(p), before, F.lit(False))
        return F.array_distinct(F.transform(F.filter(rows, fits), lambda r: canonical_number(r["n"]))).alias(name)

    patterns = list(units.values())
    # Arrays of one element bind what is used more than once, so that the text is searched once.
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    rows = once(F.struct(turns.alias("t"), number.alias("n")), lambda s: F.transform(s["n"], lambda n, i: context(s, n, i)))
    return once(rows, lambda r: F.struct(*(claims(r, name, pattern, patterns[:i]) for i, (name, pattern) in enumerate(units.items()))))


def cited_text(answers: DataFrame, evidence: DataFrame, full: DataFrame) -> DataFrame:
    """(qid, source): what an answer (qid, cited) is held against: the quotes (qid, doc_id, ord, text), then whole texts, of the documents it cites; all of them where it cites none or nothing that has text."""
    rows = evidence.select("qid", "doc_id", F.lit(0).alias("side"), "ord", F.trim("text").alias("text")).unionByName(full.select("qid", "doc_id", F.lit(1).alias("side"), "ord", F.trim("text").alias("text"))).where("text <> ''")
    parts = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("side", "ord", "doc_id", "text"))).alias("parts"))
    own = F.filter("parts", lambda p: F.array_contains("cited", p["doc_id"]))
    used = F.when(F.size(own) > 0, own).otherwise(F.col("parts"))
    return answers.join(parts, "qid", "left").select("qid", F.coalesce(F.array_join(F.transform(used, lambda p: p["text"]), "\n"), F.lit("")).alias("source"))


def errors(answer: Column, cited: Column, scope: Column, source: Column) -> Column:
    """The names of what is wrong: empty, uncited, out_of_scope, unsupported."""
    v = validation(answer, cited, scope, source)
    return F.array_compact(F.array(*(F.when(v[k], F.lit(k)) for k in ("empty", "uncited", "out_of_scope", "unsupported"))))


def settled(rows: DataFrame) -> DataFrame:
    """rows (answer, cited, scope, evidence, source, and repaired, repaired_cited or nulls) with answer and cited as they end, initial, fixed, final and outcome: validate, mend citations, validate again, take a repair, fall back.

    Citations are mended without a model: those outside the scope go, and where none is left the evidence's stand in. What
    is still wrong after that needs a repair: a second answer from outside, judged the same way. outcome: valid, fixed,
    repaired or fallback.
    """
    c = F.col
    rows = rows.withColumn("initial", errors(c("answer"), c("cited"), c("scope"), c("source")))
    broken = F.arrays_overlap("initial", F.array(F.lit("uncited"), F.lit("out_of_scope")))
    rows = rows.withColumn("mended", F.when(broken, valid_citations(c("cited"), c("scope"), c("evidence"))).otherwise(c("cited")))
    rows = rows.withColumn("again", valid_citations(c("repaired_cited"), c("scope"), c("evidence")))
    rows = rows.withColumns({"left": errors(c("answer"), c("mended"), c("scope"), c("source")), "wrong": errors(c("repaired"), c("again"), c("scope"), c("source"))})
    rows = rows.withColumn("fixed", F.size(F.array_except("mended", "cited")) + F.size(F.array_except("cited", "mended")) > 0)
    rows = rows.withColumn("good", (F.size("left") > 0) & c("repaired").isNotNull() & (F.size("wrong") == 0))
    outcome = F.when(c("good"), "repaired").when(F.size("left") > 0, "fallback").when(c("fixed"), "fixed").otherwise("valid")
    rows = rows.withColumns({"outcome": outcome, "final": F.when(c("good"), F.array().cast("array<string>")).otherwise(c("left"))})
    rows = rows.withColumns({"answer": F.when(c("good"), c("repaired")).otherwise(c("answer")), "cited": F.when(c("good"), c("again")).otherwise(c("mended"))})
    return rows.drop("mended", "again", "left", "wrong", "good")


def signals(text: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns that a text matches."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items())))


def augmented(required: Column, gold: Column, candidates: Column) -> Column:
    """The gold ids (sorted) with candidates (array of struct(doc_id, signals), in order) added until the required signals are covered: each time the one with the most that is missing, the earlier of equals, as long as one adds something."""
    sets = F.transform(F.filter(candidates, lambda c: F.array_contains(gold, c["doc_id"])), lambda c: c["signals"])
    missing = F.array_except(required, F.flatten(sets))
    rest = F.filter(candidates, lambda c: ~F.array_contains(gold, c["doc_id"]))

    def step(state, _):
        key = lambda c, i: F.struct(F.size(F.array_intersect(c["signals"], state["missing"])).alias("new"), (-i).alias("first"), c["doc_id"].alias("doc_id"), c["signals"].alias("signals"))
        best = F.array_max(F.transform(rest, key))
        after = F.struct(F.array_except(state["missing"], best["signals"]).alias("missing"), F.concat(state["picks"], F.array(best["doc_id"])).alias("picks"))
        return F.when(F.coalesce(best["new"], F.lit(0)) > 0, after).otherwise(state)

    start = F.struct(missing.alias("missing"), F.array().cast("array<bigint>").alias("picks"))
    picks = F.aggregate(F.coalesce(required, F.array().cast("array<string>")), start, step)["picks"]
    return F.array_sort(F.array_distinct(F.concat(gold, picks)))
