"""Quality classifier: a byte-level convolutional network in NumPy.

Bytes are embedded; learned filters, 8 bytes wide, move over the text 4 bytes at a time; their activations are averaged
in chunks of 256 bytes that overlap by half and cover the whole document; a second learned layer reads each chunk; its
outputs are max-pooled over the chunks and combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, text_steps

BLOCK, HALF = 4, 32  #: bytes in a block, blocks in half a chunk
_HALF_BYTES = BLOCK * HALF
#: Documents longer than this are scored as pieces that overlap by half a chunk; the maximum runs over all pieces.
PIECE_BYTES = 1 << 19


@dataclass(frozen=True)
class ConvConfig:
    """sample: labelled rows that the fit reads at most, of those with at most sample_bytes bytes of text; rows with longer texts aren't fitted on (they are scored whole)."""

    embed: int = 6
    filters: int = 32
    units: int = 24
    sample: int = 4000
    sample_bytes: int = 16384
    steps: int = 500
    batch: int = 48
    rate: float = 4e-3
    decay: float = 1e-4
    seed: int = 11
    threshold: float = 0.3


@dataclass
class Net:
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(cfg: ConvConfig) -> Net:
        rng = np.random.default_rng(cfg.seed)
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        wide = BLOCK * cfg.embed
        return Net({"table": normal(256, cfg.embed) * 0.5, "conv": normal(wide, 2 * cfg.filters) / np.sqrt(2 * wide, dtype=np.float32), "conv_bias": np.zeros(cfg.filters, np.float32), "chunk": normal(cfg.filters, cfg.units) / np.sqrt(cfg.filters, dtype=np.float32), "chunk_bias": np.zeros(cfg.units, np.float32), "out": normal(cfg.units) / np.sqrt(cfg.units, dtype=np.float32), "out_bias": np.zeros(1, np.float32)})

    def forward(self, laid: Laid, keep: bool = False):
        w = self.weights
        e = w["table"][laid.bytes].reshape(len(laid.valid), -1)
        both = e @ w["conv"]
        n = both.shape[1] // 2
        pre = both[:, :n] + w["conv_bias"]
        pre[:-1] += both[1:, n:] * laid.joined[:-1, None]
        act = np.maximum(pre, 0) * laid.valid[:, None]
        halves = act.reshape(-1, HALF, n).sum(axis=1)
        mean = (halves[laid.left] + halves[laid.right] * laid.two[:, None]) / laid.count[:, None]
        unit = np.maximum(mean @ w["chunk"] + w["chunk_bias"], 0)
        pooled = np.maximum.reduceat(unit, laid.first, axis=0)
        logit = pooled @ w["out"] + w["out_bias"][0]
        return (logit, (e, pre, mean, unit, pooled)) if keep else logit

    def gradient(self, laid: Laid, want: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        w = self.weights
        logit, (e, pre, mean, unit, pooled) = self.forward(laid, keep=True)
        d_logit = ((_sigmoid(logit) - want) / len(want)).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
        many = np.diff(np.append(laid.first, len(unit)))
        top = unit >= np.repeat(pooled, many, axis=0)
        share = top / np.repeat(np.add.reduceat(top.astype(np.float32), laid.first, axis=0), many, axis=0)
        d_unit = np.repeat(d_logit[:, None] * w["out"], many, axis=0) * share * (unit > 0)
        g |= {"chunk": mean.T @ d_unit, "chunk_bias": d_unit.sum(axis=0)}
        d_mean = (d_unit @ w["chunk"].T) / laid.count[:, None]
        d_half = np.zeros((len(laid.valid) // HALF, d_mean.shape[1]), np.float32)
        np.add.at(d_half, laid.left, d_mean)
        np.add.at(d_half, laid.right, d_mean * laid.two[:, None])
        d_pre = np.repeat(d_half, HALF, axis=0) * laid.valid[:, None] * (pre > 0)
        d_next = np.zeros_like(d_pre)
        d_next[1:] = d_pre[:-1] * laid.joined[:-1, None]
        d_both = np.concatenate([d_pre, d_next], axis=1)
        g |= {"conv": e.T @ d_both, "conv_bias": d_pre.sum(axis=0)}
        d_e = (d_both @ w["conv"].T).reshape(-1, w["table"].shape[1])
        g["table"] = np.stack([np.bincount(laid.bytes, weights=d_e[:, k], minlength=256) for k in range(d_e.shape[1])], axis=1).astype(np.float32)
        return g


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


@dataclass
class Laid:
    """Texts laid out in whole half chunks: bytes; per block whether it starts inside the text and whether the next block is the same text's; per chunk its halves and count of blocks; each text's first chunk."""

    bytes: np.ndarray
    valid: np.ndarray
    joined: np.ndarray
    left: np.ndarray
    right: np.ndarray
    two: np.ndarray
    count: np.ndarray
    first: np.ndarray


def lay(buf: np.ndarray, offs: np.ndarray) -> Laid:
    size = np.diff(offs)
    halves = np.maximum(-(-size // _HALF_BYTES), 1)
    at = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(int(at[-1]) * _HALF_BYTES, dtype=np.uint8)
    out[np.repeat(at[:-1] * _HALF_BYTES - offs[:-1], size) + np.arange(offs[0], offs[-1])] = buf[offs[0] : offs[-1]]
    block = np.arange(int(at[-1]) * HALF)
    text = np.repeat(np.arange(len(size)), halves * HALF)
    inside = block - at[:-1][text] * HALF
    blocks = np.maximum(-(-size // BLOCK), 1)
    valid = (inside < blocks[text]).astype(np.float32)
    joined = (inside + 1 < (halves * HALF)[text]).astype(np.float32)
    chunks = np.maximum(halves - 1, 1)
    first = np.concatenate([[0], np.cumsum(chunks)])[:-1]
    left = np.repeat(at[:-1], chunks) + np.arange(int(chunks.sum())) - np.repeat(first, chunks)
    two = np.repeat(halves > 1, chunks).astype(np.float32)
    right = np.where(two > 0, left + 1, left)
    per_half = valid.reshape(-1, HALF).sum(axis=1)
    return Laid(out, valid, joined, left, right, two, per_half[left] + per_half[right] * two, first)


def fit(texts: list[bytes], want: np.ndarray, cfg: ConvConfig) -> Net:
    """Adam on minibatches; the same rows give the same network. No rows give probability one half; one class gives that class."""
    net = Net.fresh(cfg)
    if not len(texts):
        net.weights["out"][:] = 0
        return net
    rng = np.random.default_rng(cfg.seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.weights.items()} for _ in range(2))
    order = np.zeros(0, dtype=np.int64)
    for t in range(1, cfg.steps + 1):
        if len(order) < cfg.batch:
            order = np.concatenate([order, rng.permutation(len(texts))])
        pick, order = order[: cfg.batch], order[cfg.batch :]
        some = [texts[i] for i in pick]
        laid = lay(np.frombuffer(b"".join(some), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in some])]))
        rate = cfg.rate * min(1, t / 20) * (1 + np.cos(np.pi * t / cfg.steps)) / 2
        for k, g in net.gradient(laid, want[pick]).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.weights[k] = (net.weights[k] * (1 - cfg.decay) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def _pieces(size: int) -> list[tuple[int, int]]:
    step = PIECE_BYTES - _HALF_BYTES
    return [(i, min(i + PIECE_BYTES, size)) for i in range(0, max(size - _HALF_BYTES, 1), step)]


def probabilities(net: Net, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of each text. A text's score doesn't depend on the texts beside it."""
    if len(offs) == 2 and offs[1] - offs[0] > PIECE_BYTES:
        text = buf[offs[0] : offs[1]]
        pooled = [net.forward(lay(text[a:b], np.array([0, b - a])), keep=True)[1][-1] for a, b in _pieces(len(text))]
        return _sigmoid(np.max(pooled, axis=0) @ net.weights["out"] + net.weights["out_bias"][0])
    return _sigmoid(net.forward(lay(buf, offs)))


def held_out() -> F.Column:
    """Rows that no label is learned from: crc32 of the doc_id as text divides by 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, cfg: ConvConfig | None = None) -> Net:
    """Fits on at most cfg.sample labelled rows that aren't held out: of those with a short enough text, the ones with the smallest hash of doc_id. Only that bounded sample reaches the driver; its ids are the only thing broadcast."""
    cfg = cfg or ConvConfig()
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= cfg.sample_bytes)
    some = known.join(short.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.sample)
    rows = short.join(F.broadcast(some), "doc_id").collect()
    rows = sorted({(r["doc_id"], r["text"], r["quality"]) for r in rows})
    return fit([r[1].encode() for r in rows], np.array([r[2] for r in rows], dtype=np.float64), cfg)


def score(docs: DataFrame, net: Net, cfg: ConvConfig | None = None) -> DataFrame:
    """All columns of ``docs`` that aren't named score or predicted, with score double (0 to 1) and predicted int (score >= cfg.threshold).

    Every row is scored over its whole text; null and empty texts get the score of a blank chunk. An empty table gives no rows.
    """
    cfg = cfg or ConvConfig()
    spark = docs.sparkSession
    prepare(spark)
    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    docs = docs.select(*rest)
    weights = spark.sparkContext.broadcast(net.weights)
    threshold = cfg.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(weights.value)
        for rows, buf, offs in text_steps(batches, step=PIECE_BYTES):
            p = probabilities(net, buf, offs)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*rows.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)
