"""An inverted index that is kept: postings in blocks with block maxima, in segments that merge geometrically.

A block holds the postings of one lexeme in one range of ``span`` doc_ids: documents, term frequencies, lengths; beside them stand
how many they are, the largest frequency and the smallest length. From these a search bounds what any document of a
range can score. It scores each question's best ranges first, and then only those whose bound reaches the kth score.

    <path>/segments/seg=<name>/bucket=<hash of the lexeme>/...   blocks, sorted by lexeme and range
    <path>/docs/seg=<name>/...                                   doc_id, len
    <path>/manifest/<version>/...                                the segments that count: name, docs, tokens

Only what the last manifest names counts, so a writer that dies leaves nothing behind that a reader sees.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold, tokens
from ..workers import Shared, children, remove, ship

_K1, _B = 1.2, 0.75
#: Tokens of a task that writes a segment, about, and tokens that become blocks at once.
TASK, HELD = 2_000_000, 4_000_000


@dataclass(frozen=True)
class TextIndexConfig:
    """span: doc_ids of a block. buckets: partitions by lexeme, each a file a task; tasks are dealt by range, so a common lexeme is spread. slices: not used any more. growth: segments merge where two have as many documents, to a factor of this."""

    span: int = 128
    buckets: int = 16
    slices: int = 4
    growth: int = 4


def _manifest(spark: SparkSession, path: str) -> tuple[int, list[tuple[str, int, int]]]:
    """(version, segments as (name, documents, tokens)) of the last manifest; version 0 where there is none. One row a segment, of which there are as many as the logarithm of the documents."""
    versions = [int(v) for v in children(spark, f"{path}/manifest") if v.isdigit() and "_SUCCESS" in children(spark, f"{path}/manifest/{v}")]
    if not versions:
        return 0, []
    rows = spark.read.parquet(f"{path}/manifest/{max(versions)}").collect()
    return max(versions), [(r["name"], r["docs"], r["tokens"]) for r in rows]


def _part(spark: SparkSession, path: str, kind: str, names: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{kind}").parquet(*(f"{path}/{kind}/seg={n}" for n in names))


def _dealt(rows: DataFrame, tokens_: int) -> DataFrame:
    """Rows of a range in one task, about TASK tokens in each, so that what follows groups by range and lexeme without another shuffle and in memory."""
    return rows.repartition(1 + tokens_ // TASK, "range")


_BLOCK = "lexeme string, range long, part string, n int, most int, short long, docs array<long>, tfs array<int>, lens array<long>"


def run_starts(rows: pa.Table, names: Iterable[str]) -> np.ndarray:
    """Where runs of the same values of some columns begin; the first row is one."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for name in names:
        col = rows.column(name).combine_chunks()
        a, b = col.slice(1), col.slice(0, len(col) - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _runs(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
    """A block of every run."""
    rows = rows.combine_chunks()
    col = lambda name: rows.column(name).combine_chunks()
    ends = pa.array(np.append(first, rows.num_rows).astype(np.int32))
    keys = [col(k).take(pa.array(first)) for k in ("lexeme", "range", "part")]
    counts = [np.diff(np.append(first, rows.num_rows)).astype(np.int32), np.maximum.reduceat(col("tf").to_numpy(), first), np.minimum.reduceat(col("len").to_numpy(), first)]
    lists = [pa.ListArray.from_arrays(ends, col(k)) for k in ("doc_id", "tf", "len")]
    return pa.RecordBatch.from_arrays([*keys, *map(pa.array, counts), *lists], names=["lexeme", "range", "part", "n", "most", "short", "docs", "tfs", "lens"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings as blocks; a batch's last run waits for the next batch."""
    held = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            first = run_starts(rows, ("lexeme", "range", "part"))
            if len(first) > 1:
                yield _runs(rows.slice(0, first[-1]), first[:-1])
            held = rows.slice(first[-1])
    if held is not None:
        yield _runs(held, np.zeros(1, dtype=np.int64))


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words between single spaces, and the place of the text that each is of."""
    listed = pc.split_pattern(pc.fill_null(texts, ""), " ")
    words, of = listed.flatten(), np.repeat(np.arange(len(listed)), pc.list_value_length(listed).to_numpy())
    some = pc.not_equal(words, "")
    return words.filter(some).dictionary_encode(), of[some.to_numpy(zero_copy_only=False)]


def _counted(rows: pa.Table) -> pa.RecordBatch:
    """Documents (range, doc_id, part, words), each once, as blocks; the blocks without a lexeme hold the documents themselves, with frequencies of 0."""
    col = lambda name: rows.column(name).combine_chunks()
    span, part = col("range").to_numpy(), col("part").dictionary_encode()
    code, of = words_of(col("words"))
    order = pc.array_sort_indices(code.dictionary).to_numpy().astype(np.int64)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    named = pc.fill_null(part.indices, -1).to_numpy()
    row = np.lexsort((col("doc_id").to_numpy(), named, span))  # the documents by range, part and doc_id
    at = np.empty(len(row), dtype=np.int64)
    at[row] = np.arange(len(row))
    size = np.bincount(of, minlength=len(row))
    # A posting is a number, its lexeme's place times the documents plus its document's; how often it comes is its frequency.
    key, tf = np.unique(place[code.indices.to_numpy()] * len(row) + at[of], return_counts=True)
    lexeme, doc = np.divmod(key, len(row))
    other = np.append(True, (np.diff(span[row]) != 0) | (np.diff(named[row]) != 0))
    first = np.flatnonzero(np.append(True, (np.diff(lexeme) != 0) | (np.diff(np.cumsum(other)[doc]) != 0))[: len(key)])
    keys = pa.concat_arrays([code.dictionary.take(pa.array(order[lexeme[first]])), pa.nulls(int(other.sum()), code.dictionary.type)])
    first, doc, tf = np.append(first, len(key) + np.flatnonzero(other)), np.append(doc, np.arange(len(row))), np.append(tf, np.zeros(len(row), dtype=np.int64)).astype(np.int32)
    docs, lens, head = col("doc_id").to_numpy()[row][doc], size[row][doc], pa.array(row[doc[first]])
    ends = np.append(first, len(doc)).astype(np.int32)
    counts = [np.diff(ends), np.maximum.reduceat(tf, first), np.minimum.reduceat(lens, first)]
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (docs, tf, lens)]
    return pa.RecordBatch.from_arrays([keys, col("range").take(head), col("part").take(head), *map(pa.array, counts), *lists], names=["lexeme", "range", "part", "n", "most", "short", "docs", "tfs", "lens"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("words").nbytes // 6
            if size >= HELD:
                yield _counted(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield _counted(pa.Table.from_batches(held))


def _blocks(postings: DataFrame) -> DataFrame:
    """Postings (range, part, lexeme, doc_id, tf, len), dealt by range, as blocks."""
    rows = postings.select("lexeme", "range", "part", "doc_id", F.col("tf").cast("int").alias("tf"), "len").sortWithinPartitions("lexeme", "range", "part", "doc_id")
    return rows.mapInArrow(_cut, _BLOCK)


def _write(blocks: DataFrame, path: str, cfg: TextIndexConfig, docs: DataFrame | None = None) -> tuple[str, int, int]:
    """A segment of blocks. Without ``docs`` (doc_id, len) the blocks without a lexeme hold them."""
    name, spark = uuid.uuid4().hex, blocks.sparkSession
    bucket = F.when(F.col("lexeme").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("lexeme"), F.lit(cfg.buckets))).cast("int")
    blocks.withColumn("bucket", bucket).sortWithinPartitions("bucket", "lexeme", "range").write.partitionBy("bucket").parquet(f"{path}/segments/seg={name}")
    if docs is None:
        empty = "bucket=-1" not in children(spark, f"{path}/segments/seg={name}")
        docs = spark.createDataFrame([], "doc_id long, len long") if empty else spark.read.parquet(f"{path}/segments/seg={name}/bucket=-1").select(F.inline(F.arrays_zip("docs", "lens"))).toDF("doc_id", "len")
    docs.write.parquet(f"{path}/docs/seg={name}")
    n, size = spark.read.parquet(f"{path}/docs/seg={name}").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    return name, n, size


def _merged(spark: SparkSession, path: str, some: list[tuple[str, int, int]], cfg: TextIndexConfig) -> tuple[str, int, int]:
    """Segments as one: blocks of the same lexeme and range are put together."""
    names = [s[0] for s in some]
    postings = _part(spark, path, "segments", names).where("lexeme is not null").select("range", "part", "lexeme", F.inline_outer(F.arrays_zip("docs", "tfs", "lens"))).toDF("range", "part", "lexeme", "doc_id", "tf", "len")
    ship(spark)
    return _write(_blocks(_dealt(postings, sum(s[2] for s in some))), path, cfg, _part(spark, path, "docs", names).select("doc_id", "len"))


def joined(text: str) -> Column:
    """The folded tokens of a text, which hold no spaces, in one string with spaces between."""
    return F.array_join(tokens(fold(text)), " ")


def add(docs: DataFrame, path: str, cfg: TextIndexConfig | None = None) -> None:
    """Adds documents (doc_id, text and, if searches are to be kept to a part of them, part) to the index at ``path``, which the first call makes.

    Tokens are folded. A part is a string, such as a language; null is a part that no question names. Documents that the index has already, and rows without a doc_id, are left out; of rows that share
    one, the smallest text counts, with its part. Null texts are empty; documents without tokens count in the statistics only. A batch without new documents changes nothing.
    Documents may have words, as ``joined`` makes them, instead of a text. One writer at a time.
    """
    cfg = cfg or TextIndexConfig()
    spark = docs.sparkSession
    ship(spark)
    version, segments = _manifest(spark, path)
    part = F.col("part").cast("string") if "part" in docs.columns else F.lit(None).cast("string")
    given = "words" in docs.columns
    text = F.col("words" if given else "text")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), part.alias("part"), F.lit(False).alias("known"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if segments:
        known = _part(spark, path, "docs", [s[0] for s in segments])
        rows = rows.unionByName(known.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("part"), F.lit(True).alias("known")))
    rows = _dealt(rows.withColumn("range", F.floor(F.col("doc_id") / cfg.span).cast("long")), size // 6)
    new = rows.groupBy("range", "doc_id").agg(F.min(F.struct("text", "part")).alias("x"), F.max("known").alias("known")).where("not known").select("range", "doc_id", "x.*")
    words = F.col("text") if given else joined("text")
    segment = _write(new.select("range", "doc_id", "part", words.alias("words")).mapInArrow(_posted, _BLOCK), path, cfg)
    gone = []
    if segment[1]:
        segments = [*segments, segment]
    else:
        gone.append(segment[0])
    level = lambda s: int(math.log(s[1], cfg.growth) + 1e-9)
    while same := next((group for s in segments if len(group := [x for x in segments if level(x) == level(s)]) > 1), None):
        gone += [s[0] for s in same]
        segments = [s for s in segments if s not in same] + [_merged(spark, path, same, cfg)]
    if segments:
        spark.createDataFrame(segments, "name string, docs long, tokens long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{version + 1}")
    for name in gone:  # readers of the manifest before must start anew
        remove(spark, f"{path}/segments/seg={name}")
        remove(spark, f"{path}/docs/seg={name}")


def _impact(tf, length, average: float) -> Column:
    return tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * length / average))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, questions: DataFrame, k: int, first: int = 4, every: bool = False, cfg: TextIndexConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """((qid, doc_id, score, rank), (qid, blocks, read)): each question's k documents with the highest BM25 score over its words, and how many blocks its words have and how many were scored.

    ``questions`` has qid, words (folded; repeats count once, null or none find nothing) and, if it likes, part: only documents of that part are
    found, null for any; the statistics are those of all. With ``every`` a document must have all the words. Scores are rounded to six
    digits, ties go to the smaller doc_id; the result is that of a scan. ``cfg`` is the one that the index was made with. The ``first`` ranges of each question, by bound, give the kth score that the others' bounds must reach.
    """
    cfg = cfg or TextIndexConfig()
    scratch = Shared(spark, "textsearch")
    _, segments = _manifest(spark, path)
    total, size = (sum(s[i] for s in segments) for i in (1, 2))
    only = F.col("part").cast("string") if "part" in questions.columns else F.lit(None).cast("string")
    distinct = F.array_distinct(F.filter("words", lambda w: w.isNotNull()))
    words = questions.select("qid", only.alias("only"), F.size(distinct).alias("asked"), F.explode(distinct).alias("lexeme"))
    if not segments or not size:
        none = questions.select("qid").limit(0)
        return none.select("qid", F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")), none.select("qid", F.lit(0).cast("long").alias("blocks"), F.lit(0).cast("long").alias("read"))
    average = size / total
    blocks = _part(spark, path, "segments", [s[0] for s in segments])
    words = scratch.keep(words.distinct(), "words")
    # With the bucket in the join, partitions that no question needs are pruned at run time.
    asked = words.select("lexeme", F.pmod(F.xxhash64("lexeme"), F.lit(cfg.buckets)).cast("int").alias("bucket")).distinct()
    # Whole blocks: what the questions' words have is a small part of the index, which is read once for it.
    heads = scratch.keep(blocks.join(asked, ["bucket", "lexeme"], "left_semi").drop("bucket", "seg"), "heads")
    rare = heads.groupBy("lexeme").agg(F.sum("n").alias("df")).select("lexeme", F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    words = words.join(rare, "lexeme")
    bound = F.col("idf") * _impact(F.col("most"), F.col("short"), average)
    # A document is in one block of a word, so a range's bound is the sum over words of the largest bound of its blocks.
    cells = heads.join(words, "lexeme").where("only is null or only = part").groupBy("qid", "only", "asked", "range", "lexeme", "idf").agg(F.max(bound).alias("bound"), F.count("*").alias("held"))
    ranges = cells.groupBy("qid", "only", "asked", "range").agg(F.sum("bound").alias("bound"), F.sum("held").alias("held"), F.collect_list(F.struct("lexeme", "idf")).alias("w"))
    ranges = scratch.keep(ranges.where(F.size("w") == F.col("asked")) if every else ranges, "ranges")
    ranges = ranges.withColumn("turn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "range")))

    def scored(some: DataFrame) -> DataFrame:
        want = some.select("qid", "only", "asked", "range", F.explode("w").alias("w")).select("qid", "only", "asked", "range", "w.lexeme", "w.idf")
        full = heads.join(want, ["lexeme", "range"]).where("only is null or only = part").select("qid", "asked", "idf", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("x"))
        impact = F.sum(F.col("idf") * _impact(F.col("x.tfs"), F.col("x.lens"), average))
        out = full.groupBy("qid", "asked", F.col("x.docs").alias("doc_id")).agg(F.round(impact, 6).alias("score"), F.count("*").alias("n"))
        return (out.where("n = asked") if every else out).select("qid", "doc_id", "score")

    start = scratch.keep(_ranked(scored(ranges.where(F.col("turn") <= first)), k), "start")
    kth = start.where(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
    marked = scratch.keep(ranges.join(kth, "qid", "left").withColumn("go", (F.col("turn") > first) & (F.col("kth").isNull() | (F.col("bound") + 1e-5 >= F.col("kth")))), "marked")
    rest = scored(marked.where("go"))
    read = marked.groupBy("qid").agg(F.sum("held").alias("blocks"), F.sum(F.when(F.col("go") | (F.col("turn") <= first), F.col("held"))).alias("read"))
    return _ranked(start.drop("rank").unionByName(rest), k).select("qid", "doc_id", "score", "rank"), read
