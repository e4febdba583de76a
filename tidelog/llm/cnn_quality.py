"""A byte-level convolutional network in numpy that scores the quality of whole texts."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_remainder, per_batch, sampled_rows, sized_slices, text_bytes

#: A filter sees WIDTH bytes, every STRIDE bytes; a chunk is two half chunks, and chunks overlap by one.
WIDTH, STRIDE, HALF = 8, 4, 256
EMBED, FILTERS = 6, 16
#: Learning takes about this many texts of each label. It makes at least UPDATES steps of BATCH texts, and at
#: least EPOCHS passes; a small sample is passed over more often.
SAMPLE_EACH, UPDATES, EPOCHS, BATCH, RATE = 1200, 600, 12, 64, 0.01
#: Bytes held in one forward pass.
BLOCK = 1 << 18


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    shift: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS: mean and maximum over chunks
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))

    @staticmethod
    def fresh(seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *s: rng.standard_normal(s).astype(np.float32)
        return Network(
            normal(256, EMBED) * 0.5,
            normal(WIDTH * EMBED, FILTERS) / np.float32(np.sqrt(WIDTH * EMBED)) * 2,
            np.zeros(FILTERS, np.float32),
            normal(2 * FILTERS) * np.float32(0.1),
        )


def halves_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as rows of HALF bytes padded with zeros, at least two each and the last one all padding
    or overhang, and the first row of each text (n + 1 offsets)."""
    sizes = np.diff(bounds)
    rows = np.maximum(2, -(-sizes // HALF))
    first = np.concatenate([[0], np.cumsum(rows)])
    flat = np.zeros(int(first[-1]) * HALF, np.uint8)
    for to, a, b in zip((first[:-1] * HALF).tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        flat[to : to + b - a] = data[a:b]
    return flat.reshape(-1, HALF), first


def convolve(net: Network, halves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The response of every filter at every place: rows x HALF / STRIDE x FILTERS. A filter that starts in
    the last bytes of a row ends in the next row of the same text, or in zeros after the last."""
    x = net.embed.take(halves.ravel(), axis=0).reshape(-1, STRIDE * EMBED)
    after = np.empty_like(x)
    after[:-1] = x[1:]
    per_row = HALF // STRIDE
    after[first[1:] * per_row - 1] = np.tile(net.embed[0], STRIDE)
    half = STRIDE * EMBED
    return (x @ net.filters[:half] + after @ net.filters[half:]).reshape(len(halves), per_row, -1)


def pooled(net: Network, peaks: np.ndarray, first: np.ndarray):
    """From each row's maxima: the chunks' activations, the chunk offsets, mean and maximum by text."""
    chunk_rows = np.ones(len(peaks), bool)
    chunk_rows[first[1:] - 1] = False  # a chunk starts at every row but a text's last
    at = np.flatnonzero(chunk_rows)
    top = np.maximum(peaks[at], peaks[at + 1])
    active = np.maximum(0, top + net.shift)
    begin = first[:-1] - np.arange(len(first) - 1)
    count = np.diff(first) - 1
    mean = np.add.reduceat(active, begin, axis=0) / count[:, None]
    most = np.maximum.reduceat(active, begin, axis=0)
    return at, top, active, begin, count, mean, most


def score(net: Network, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each text, over all its chunks."""
    out = np.empty(len(bounds) - 1)
    for a, b in sized_slices(bounds, BLOCK):
        halves, first = halves_of(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        peaks = np.empty((len(halves), FILTERS), np.float32)
        step = 4 * BLOCK // HALF
        for s in range(0, len(halves), step):  # one very long text, part by part with a row of overlap
            part = halves[s : s + step + 1]
            ends = first[(first > s) & (first <= s + len(part))] - s
            ends = ends if len(ends) and ends[-1] == len(part) else np.append(ends, len(part))
            found = convolve(net, part, np.concatenate([[0], ends])).max(1)
            peaks[s : s + step] = found[:step]
        *_, mean, most = pooled(net, peaks, first)
        logit = np.concatenate([mean, most], 1) @ net.out + net.bias
        out[a:b] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return out


def gradients(net: Network, halves: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray):
    response = convolve(net, halves, first)
    place = response.argmax(1)
    peaks = np.take_along_axis(response, place[:, None], 1)[:, 0]
    at, top, active, begin, count, mean, most = pooled(net, peaks, first)
    features = np.concatenate([mean, most], 1)
    p = 1 / (1 + np.exp(-np.clip(features @ net.out + net.bias, -30, 30)))
    d = ((p - y) * weight / weight.sum()).astype(np.float32)
    d_features = d[:, None] * net.out[None]
    owner = np.repeat(np.arange(len(y)), count)
    d_active = d_features[owner, :FILTERS] / count[owner][:, None]
    is_most = active == most[owner]
    d_active += d_features[owner, FILTERS:] * is_most / np.maximum(1, np.add.reduceat(is_most, begin, axis=0))[owner]
    d_top = np.where(active > 0, d_active, 0)
    second = peaks[at + 1] > peaks[at]
    row = at[:, None] + second
    column = np.arange(FILTERS)[None]
    start = row * HALF + place[row, column] * STRIDE
    flat = np.concatenate([halves.ravel(), np.zeros(WIDTH, np.uint8)])
    seen = flat[start[..., None] + np.arange(WIDTH)]
    windows = net.embed[seen].reshape(*start.shape, -1)
    d_filters = np.einsum("cf,cfk->kf", d_top, windows, optimize=True)
    d_embed = np.zeros_like(net.embed)
    by_filter = net.filters.T.reshape(FILTERS, WIDTH, EMBED)
    for k in range(WIDTH):
        moved = (d_top[..., None] * by_filter[None, :, k]).reshape(-1, EMBED)
        for e in range(EMBED):
            d_embed[:, e] += np.bincount(seen[..., k].ravel(), moved[:, e], 256)
    return [d_embed, d_filters, d_top.sum(0), features.T @ d, d.sum(keepdims=True)]


def fit(texts: list[bytes], labels: list[int], weights: list[float]) -> Network:
    """Adam over minibatches of whole texts. Without two labels, the network answers the only one."""
    net = Network.fresh()
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.bias[:] = 0 if not labels else (4 if labels[0] else -4)
        return net
    rng = np.random.default_rng(5)
    params = [net.embed, net.filters, net.shift, net.out, net.bias]
    m, v, step = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
    y, w = np.array(labels, np.float32), np.array(weights, np.float32)
    sizes = np.array([len(t) for t in texts])
    epochs = max(EPOCHS, ceil(UPDATES * BATCH / len(texts)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        order = order[np.argsort(sizes[order] // 2048, kind="stable")]  # texts of like length together
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for g in (groups[i] for i in rng.permutation(len(groups))):
            bounds = np.concatenate([[0], np.cumsum(sizes[g])])
            halves, first = halves_of(np.frombuffer(b"".join(texts[i] for i in g), np.uint8), bounds)
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for x, a, b, grad in zip(params, m, v, gradients(net, halves, first, y[g], w[g])):
                a += 0.1 * (grad - a)
                b += 0.01 * (grad * grad - b)
                x -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(x.dtype)
    return net


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on a bounded sample: about SAMPLE_EACH whole texts of each quality, weighted back to their shares.

    Labels count only where crc32(doc_id) mod 4 is not 2; rows with a null text, id or quality are left out.
    """
    known = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .where(crc_remainder("doc_id", 4) != 2)
        .select(F.col("doc_id").alias("_labelled"), "quality")
    )
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = sampled_rows(known, "quality", SAMPLE_EACH)
    rows = (
        docs.where("text is not null")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))  # at most 3 x SAMPLE_EACH rows
        .select("doc_id", "text", "quality")
        .orderBy(F.xxhash64("text", "doc_id"))
        .limit(4 * SAMPLE_EACH)  # for ids that repeat
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["text"]))
    got = {q: sum(r["quality"] == q for r in rows) for q in shares}
    weights = [shares[r["quality"]] / got[r["quality"]] for r in rows]
    return fit([r["text"].encode() for r in rows], [r["quality"] for r in rows], weights)


def apply(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) for every row; null and empty texts are scored as an empty chunk, repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few kilobytes

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = score(shared.value, *text_bytes(batch.column(1)))
        return pa.record_batch([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def with_scores(docs: DataFrame, net: Network, column: str) -> DataFrame:
    """``docs`` with all its columns and one more, the score; for stages that pass documents on."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = score(shared.value, *text_bytes(batch.column(place)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, column])

    return per_batch(docs, run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = apply(docs, learn(docs, labels))
    return scored.select(
        "doc_id",
        (crc_remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
