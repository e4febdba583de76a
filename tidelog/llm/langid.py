"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_remainder, per_batch, sampled_rows, text_bytes

#: Buckets of hashed n-grams; row BUCKETS of a weight table is zero and stands for no n-gram.
BUCKETS = 1 << 14
#: Learning takes about this many texts of each language, and this many in all.
SAMPLE_EACH, SAMPLE_ALL = 400, 4000
#: Bytes looked up at once.
BLOCK = 1 << 19
#: A prediction is ambiguous if the runner-up's loss is less than this share above the winner's.
CLEAR = 0.1

_PLAIN = np.arange(256, dtype=np.uint32)
_PLAIN[65:91] += 32
_PLAIN[48:58] = 48
_PLAIN[[9, 10, 11, 12, 13]] = 32


def grams(data: np.ndarray, bounds: np.ndarray, start: int, stop: int) -> list[np.ndarray]:
    """Buckets of the 2- and 3-byte sequences that begin at start..stop and do not leave their text."""
    out = []
    seen = _PLAIN[data[start : stop + 2]]
    for n in (2, 3):
        code = np.zeros(stop - start, np.uint32)
        for k in range(n):
            part = seen[k : k + stop - start]
            code[: len(part)] |= part << np.uint32(8 * k)
        bucket = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(32 - 14)
        ends = bounds[np.searchsorted(bounds, start, "right") : np.searchsorted(bounds, stop + n, "left")]
        for k in range(1, n):  # begins less than n bytes before the end of its text
            at = ends - k - start
            bucket[at[(at >= 0) & (at < stop - start)]] = BUCKETS
        out.append(bucket)
    return out


def blocks(bounds: np.ndarray):
    """(start, stop, rows, offsets): BLOCK bytes at a time, the rows with bytes there and where each begins."""
    total = int(bounds[-1])
    for start in range(0, total, BLOCK):
        stop = min(total, start + BLOCK)
        first = int(np.searchsorted(bounds, start, "right")) - 1
        last = int(np.searchsorted(bounds, stop, "left"))
        begin = np.maximum(bounds[first:last], start) - start
        end = np.minimum(bounds[first + 1 : last + 1], stop) - start
        full = np.flatnonzero(end > begin)
        yield start, stop, first + full, begin[full]


def code_matrix(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of ``n`` languages.

    Up to five languages: every way to part them in two. More: of 64 seeded random codes of 10 log2(n)
    bits, the one whose closest codewords are furthest apart.
    """
    if n <= 5:
        bits = [[1 if i == 0 or (k >> (i - 1)) & 1 == 0 else -1 for i in range(n)] for k in range(1, 1 << max(0, n - 1))]
        return np.array(bits, np.float32).reshape(-1, n).T
    rng, width, best = np.random.default_rng(7), ceil(10 * log2(n)), (-1, None)
    for _ in range(64):
        code = rng.choice(np.float32([-1, 1]), (n, width))
        gap = ((width - code @ code.T) / 2 + np.eye(n) * width).min()
        if gap > best[0] and (np.abs(code.sum(0)) < n).all():
            best = (gap, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS + 1 x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit's classifier, from its errors on the sample

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.zeros((len(bounds) - 1, self.code.shape[1]), np.float64)
        for start, stop, rows, begin in blocks(bounds):
            for bucket in grams(data, bounds, start, stop):
                total[rows] += np.add.reduceat(self.weights[bucket], begin, axis=0)
        return total / np.maximum(np.diff(bounds), 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the codeword of least weighted squared-hinge loss, its share as score, and ambiguity."""
        slack = np.maximum(0, 1 - margins[:, None, :] * self.code[None])
        loss = (slack**2 * self.trust).sum(2)
        share = np.exp(-2 * (loss - loss.min(1, keepdims=True)))
        best = loss.argmin(1)
        two = np.sort(loss, 1)[:, :2]
        unclear = two[:, 1] <= (1 + CLEAR) * two[:, 0] if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, 1 / share.sum(1), unclear


def fit(texts: list[bytes], labels: list[str], ridge: float = 0.1) -> Model | None:
    """One ridge classifier for each bit, over n-gram shares scaled by their spread. None without texts."""
    if not texts:
        return None
    languages = sorted(set(labels))
    code = code_matrix(len(languages))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    x = np.zeros((len(texts), BUCKETS + 1), np.float32)
    row_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for start, stop, _, _ in blocks(bounds):
        for bucket in grams(data, bounds, start, stop):
            np.add.at(x, (row_of[start:stop], bucket), 1)
    x[:, BUCKETS] = 0
    x /= np.maximum(np.diff(bounds), 1)[:, None]
    scale = 1 / np.sqrt(x.mean(0) + 1e-6)
    x *= scale
    mean = x.mean(0)
    x -= mean
    y = code[[languages.index(v) for v in labels]]
    centre = y.mean(0) if len(y) else 0
    kernel = (x @ x.T).astype(np.float64)
    kernel[np.diag_indices(len(texts))] += ridge * max(np.trace(kernel) / len(texts), 1e-9)
    alpha = np.linalg.solve(kernel, (y - centre).astype(np.float64))
    w = (x.T @ alpha.astype(np.float32)).astype(np.float64)
    bias = centre - mean @ w
    wrong = ((x @ w.astype(np.float32) + centre) * y <= 0).mean(0) if code.shape[1] else np.zeros(0)
    weights = (w * scale[:, None]).astype(np.float32)
    weights[BUCKETS] = 0
    return Model(languages, code, weights, bias, 1 - 2 * np.minimum(wrong, 0.45))


def sample(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    """The bounded sample that a model learns from: rows of ``docs`` (doc_id, text, lang) with a lang."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = max(1, labelled.select("lang").distinct().count())
    rows = sampled_rows(labelled, "lang", max(1, min(SAMPLE_EACH, SAMPLE_ALL // n))).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["text"]))
    return [r["text"].encode() for r in rows], [r["lang"] for r in rows]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row of ``docs``, from its whole text alone.

    A text that is null or has no letter is ``und`` with score 0; so is every text if nothing was learned.
    Repeated rows stay; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x bits floats, whatever the tables' size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
        unclear = np.zeros(batch.num_rows, bool)
        if model is not None:
            best, share, open_ = model.decode(model.margins(*text_bytes(batch.column(1))))
            names[lettered] = np.array(model.languages, object)[best[lettered]]
            score[lettered], unclear[lettered] = share[lettered], open_[lettered]
        return pa.record_batch(
            [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(unclear)],
            ["doc_id", "lang_pred", "score", "ambiguous"],
        )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return per_batch(
        docs.select(F.col("doc_id").cast("long"), "text", letter.alias("lettered")),
        run,
        "doc_id long, lang_pred string, score double, ambiguous boolean",
    )


def identify(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 4 is not 2, predict every row; adds held_out."""
    model = fit(*sample(docs.where(crc_remainder("doc_id", 4) != 2)))
    return predict(docs, model).withColumn("held_out", crc_remainder("doc_id", 4) == 2)
