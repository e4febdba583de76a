"""Scoring of texts by a probabilistic suffix tree over bytes, with a word-unigram base beside it.

The tree is never in one place. Counts of every byte with its DEPTH bytes of context are kept in parts, by the three
nearest bytes, so that a part holds whole subtrees; only contexts of up to TOP bytes, of which there are at most
256 ** TOP, are broadcast. Texts are dealt to blocks; a block asks each part for its own distinct keys, packed as one
sorted array, and gets their probabilities back. No count is left out at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, bounded_batches, crc_remainder, dealt, frugal, frugal_group, pack, packed_size, planes, raw_texts, starts, text_bytes, unpack, unplaned
from .words import word_codes

#: Longest context in bytes: a symbol and its context are one 64-bit key.
DEPTH = 7
#: Contexts of up to this many bytes are always in the tree, and are broadcast.
TOP = 2
#: A longer context stays if it explains its training bytes by this many nats better than its suffix does.
GAIN = 3.0
#: Weight of a context's suffix: so many times its distinct next bytes, against its count. Both were chosen on held-out
#: texts; with a weight of 1, as in Witten-Bell, contexts met a few times are trusted too much.
SUFFIX = 6
#: Bytes turned into keys together, and bytes of the texts of one block.
SLICE, BLOCK_TEXT = 1 << 20, 12 << 20
#: Bytes of text for each part of the contexts and of the words, and most parts of either.
PART_TEXT, WORD_TEXT, PARTS = 16 << 20, 64 << 20, 4096
#: Different keys, and words, that a worker counts before it hands them on.
KEYS = 3 << 19

_COUNTED = "part int, kind int, block int, keys binary, counts binary"


def normalised(text: bytes) -> bytes:
    """A-Z lowered, words with one space between, and the end symbol; before it, DEPTH end symbols as context. The
    end is a line feed, which cannot be inside."""
    return b"\n" * DEPTH + b" ".join(text.lower().split()) + b"\n"


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of the normalised texts: it in the low byte, its context above, the nearest highest, so that
    sorted keys are sorted by every shorter context too. And where each text's symbols begin (n + 1 offsets)."""
    packed = [normalised(t) for t in texts]
    size = np.array([len(p) for p in packed], np.int64)
    raw = b"\n" * (8 - DEPTH) + b"".join(packed)
    # eight bytes read as a little-endian number have the last one highest: what stands before each byte from DEPTH on
    before = np.ndarray(max(0, len(raw) - 8), "<u8", raw, strides=(1,))
    key = before >> np.uint64(8 * (7 - DEPTH))
    key &= ~np.uint64(255)
    key |= np.frombuffer(raw, np.uint8)[8:]
    begin = np.cumsum(size) - size
    symbol = np.ones(len(key), bool)
    for k in range(DEPTH):  # of the texts after the first, whose context is not in key
        symbol[begin[1:] + k - DEPTH] = False
    return key[symbol], np.concatenate([[0], np.cumsum(size - DEPTH)])


def sliced(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts of about SLICE bytes together; a longer one is alone."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        if part and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their ``n``."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = starts(keys)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _spread(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """A value for each of runs that begin at ``first``, for all ``n`` places."""
    return np.repeat(values, np.diff(np.append(first, n)))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is there."""
    keys = np.sort(keys)
    first = starts(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def _at(values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each of ``asked`` in sorted ``values``."""
    if not len(values):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    return place, values[place] == asked


@dataclass(frozen=True)
class Parts:
    """How keys are dealt: contexts by a hash of their three nearest bytes, words by their own hash, and one part for
    the counts of the shortest contexts."""

    contexts: int
    words: int

    @staticmethod
    def of(size: int) -> Parts:
        return Parts(min(PARTS, ceil(size / PART_TEXT) or 1), min(PARTS, ceil(size / WORD_TEXT) or 1))

    @property
    def top(self) -> int:
        return self.contexts + self.words

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        near = (keys >> np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15)
        return ((near >> np.uint64(40)) % np.uint64(self.contexts)).astype(np.uint16)

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.words) + np.uint64(self.contexts)).astype(np.uint16)


# -- counting


class _Counter:
    """Counts by key of several arrays, merged as they come."""

    def __init__(self):
        self.keys, self.n, self.size = [], [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys), self.n.append(n)
        self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            k, n = _summed(np.concatenate(self.keys), np.concatenate(self.n))
            self.keys, self.n, self.size = [k], [n], len(k)
        return (self.keys[0], self.n[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "kind", "block", "keys", "counts"])


def _count(parts: Parts):
    """Packed counts of the contexts and words of texts, a row for each part whenever a worker holds enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, words = _Counter(), _Counter()

        def flush():
            keys, n = contexts.merged()
            rows = [(parts.top, 0, 0, pack(k), planes(v)) for k, v in [_summed(short_of(keys, TOP), n)]]
            for counter, deal in ((contexts, parts.of_keys), (words, parts.of_words)):
                keys, n = counter.merged()
                rows += [(p, 0, 0, pack(keys[at]), planes(n[at])) for p, at in dealt(keys, deal(keys))]
                counter.__init__()
            return _rows(rows)

        for batch in batches:
            words.add(*_distinct(word_codes(*text_bytes(batch.column(0)))[0]))
            for texts in sliced(raw_texts(batch.column(0))):
                contexts.add(*_distinct(keys_of(texts)[0]))
                if contexts.size > 2 * KEYS or words.size > 2 * KEYS:
                    contexts.merged(), words.merged()
                    if contexts.size > KEYS or words.size > KEYS:
                        yield flush()
        yield flush()

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of _COUNTED one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(k)[i].as_py() for k in range(5))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part, from rows sorted by part; a part's rows are merged as they come."""
    part, held, distinct = None, _Counter(), 0

    def done():
        keys, n = held.merged()
        return _rows([(part, 0, 0, pack(keys), planes(n))])

    for p, _, _, keys, counts in _streamed(batches):
        if p != part:
            if part is not None:
                yield done()
            part, held, distinct = p, _Counter(), 0
        got = unpack(keys)
        held.add(got, unplaned(counts, len(got), np.int64))
        if held.size > max(KEYS, 2 * distinct):
            distinct = len(held.merged()[0])
    if part is not None:
        yield done()


def counts(train: DataFrame, parts: Parts) -> DataFrame:
    """One packed row for each part: all keys of ``train`` there, with how often they occur."""
    bounded_batches(train.sparkSession)
    rows = train.select("text").mapInArrow(frugal(_count(parts)), _COUNTED)
    return rows.repartition(parts.top + 1, "part").sortWithinPartitions("part").mapInArrow(frugal(_merge), _COUNTED)


# -- the tree


def short_of(keys: np.ndarray, depth: int, deep: int = DEPTH) -> np.ndarray:
    """The pair of a context of ``depth`` bytes and the symbol, from pairs of ``deep`` bytes."""
    return keys >> np.uint64(8 * (deep + 1 - depth)) << np.uint64(8) | keys & np.uint64(255)


@dataclass
class Level:
    """Contexts of one depth with their counts and numbers of distinct next bytes; pairs with their counts."""

    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(pairs: np.ndarray, counts: np.ndarray) -> Level:
        """From sorted distinct pairs."""
        context = pairs >> np.uint64(8)
        first = starts(context)
        total = np.add.reduceat(counts, first) if len(first) else counts
        return Level(context[first], total, np.diff(np.append(first, len(pairs))), pairs, counts)

    def mixed(self, pairs: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, which contexts are here): a context's counts are mixed with the probabilities ``p`` of its
        suffix in the share of SUFFIX times its distinct next bytes to its count."""
        if not len(self.contexts):
            return p, np.zeros(len(pairs), bool)
        context = pairs >> np.uint64(8)
        first = starts(context)  # equal contexts are mostly side by side
        at, inside = (_spread(x, first, len(pairs)) for x in _at(self.contexts, context[first]))
        to, there = _at(self.pairs, pairs)
        n = np.where(there, self.counts[to], 0) if len(self.counts) else 0
        weight = SUFFIX * self.kinds[at]
        return np.where(inside, (n + weight * p) / (self.totals[at] + weight), p), inside

    def only(self, keep: np.ndarray) -> Level:
        mine = keep[np.searchsorted(self.contexts, self.pairs >> np.uint64(8))] if len(self.pairs) else np.zeros(0, bool)
        return Level(self.contexts[keep], self.totals[keep], self.kinds[keep], self.pairs[mine], self.counts[mine])


def levels(keys: np.ndarray, n: np.ndarray, deep: int, shallow: int) -> list[Level]:
    """The levels from ``shallow`` to ``deep`` bytes, of pairs of ``deep`` bytes."""
    out = [Level.of(keys, n)]
    for d in range(deep - 1, shallow - 1, -1):
        keys, n = _summed(short_of(keys, d, d + 1), n)
        out.insert(0, Level.of(keys, n))
    return out


def prune(found: list[Level], above: Level) -> list[Level]:
    """The contexts whose next bytes diverge from their suffix's by GAIN nats, and all suffixes of such contexts, so
    that the longest state of any history is one walk. ``above`` is the level before the first."""
    keep = []
    for level, up in zip(found, [above, *found]):
        if not len(level.pairs):
            keep.append(np.zeros(0, bool))
            continue
        context = np.repeat(np.arange(len(level.contexts)), level.kinds)
        short = level.pairs >> np.uint64(16) << np.uint64(8) | level.pairs & np.uint64(255)
        to, _ = _at(up.pairs, short)  # it is there: a pair's own bytes are counted for its suffix too
        parent, _ = _at(up.contexts, level.contexts >> np.uint64(8))
        p_up = up.counts[to] / (up.totals[parent] + up.kinds[parent])[context]
        gain = np.bincount(context, level.counts * np.log(level.counts / level.totals[context] / p_up), len(level.contexts))
        keep.append(gain >= GAIN)
    for d in range(len(found) - 1, 0, -1):
        at, inside = _at(found[d - 1].contexts, np.unique(found[d].contexts[keep[d]] >> np.uint64(8)))
        keep[d - 1][at[inside]] = True
    return [level.only(k) for level, k in zip(found, keep)]


def log10_of(top: list[Level], tree: list[Level], keys: np.ndarray) -> np.ndarray:
    """log10 P(symbol | longest context in the tree) of each of the sorted ``keys``, down to the uniform distribution.
    ``top``: the levels of 0 to TOP bytes; ``tree``: the kept ones after them."""
    short, back = np.unique(short_of(keys, TOP), return_inverse=True)
    p = np.full(len(short), 1 / 256)
    for d, level in enumerate(top):
        p, _ = level.mixed(short_of(short, d, TOP), p)
    p = p[back]
    going = np.arange(len(keys))
    for d, level in enumerate(tree, TOP + 1):
        value, inside = level.mixed(short_of(keys[going], d), p[going])
        p[going] = value
        going = going[inside]  # a context outside has no longer one inside
    return np.log10(p)


def _answer(parts: Parts, shared):
    """Answers to packed questions (kind 1), from rows sorted by part with its counts (kind 0) first: log10
    probabilities of contexts, counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, words = None, [], (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for p, kind, block, keys, counts in _streamed(batches):
            if p != part:
                part, tree, words = p, [], (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            asked = unpack(keys)
            if kind == 0:
                n = unplaned(counts, len(asked), np.int64)
                if p < parts.contexts:
                    tree = prune(levels(asked, n, DEPTH, TOP + 1), shared.value[TOP])
                else:
                    words = asked, n
            elif p < parts.contexts:
                yield _rows([(p, 0, block, None, planes(log10_of(shared.value, tree, asked).astype(np.float32)))])
            else:
                at, there = _at(words[0], asked)
                yield _rows([(p, 0, block, None, planes(np.where(there, words[1][at], 0) if len(words[1]) else np.zeros(len(asked), np.int64)))])

    return run


# -- scoring


def distinct(arrays: Iterator[np.ndarray]) -> np.ndarray:
    """The distinct values of all arrays, sorted; they are merged as they come."""
    held, more, size = np.zeros(0, np.uint64), [], 0
    for keys in arrays:
        more.append(_distinct(keys)[0])
        size += len(more[-1])
        if size > max(KEYS, len(held)):
            held, more, size = _distinct(np.concatenate([held, *more]))[0], [], 0
    return _distinct(np.concatenate([held, *more]))[0] if more else held


def distinct_keys(texts: list[bytes]) -> np.ndarray:
    return distinct(keys_of(part)[0] for part in sliced(texts))


def _ask(parts: Parts):
    def run(group: pa.Table) -> pa.Table:
        column = group["text"].combine_chunks()
        block = group["block"][0].as_py()
        keys, words = distinct_keys(raw_texts(column)), _distinct(word_codes(*text_bytes(column))[0])[0]
        rows = [(p, 1, block, pack(k[at]), None) for k, deal in ((keys, parts.of_keys), (words, parts.of_words)) for p, at in dealt(k, deal(k))]
        return pa.Table.from_batches([_rows(rows)])

    return run


def valued(asked: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each of ``asked``; ``keys`` are sorted and hold all of them. Each distinct one is looked up once."""
    order = np.argsort(asked)
    ranked = asked[order]
    first = starts(ranked)
    found = np.empty(len(asked), values.dtype)
    found[order] = np.repeat(values[np.searchsorted(keys, ranked[first])], np.diff(np.append(first, len(asked))))
    return found


def sums_of(texts: list[bytes], keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each text the sum of the values of its keys."""
    out = []
    for part in sliced(texts):
        own, begin = keys_of(part)
        out.append(np.add.reduceat(valued(own, keys, values), begin[:-1], dtype=np.float64))
    return np.concatenate(out) if out else np.zeros(0)


def _finish(parts: Parts, ends: int, n_all: int, v_all: int):
    denominator = n_all + 0.5 * (v_all + 1)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        column = texts["text"].combine_chunks()
        given = dict(zip(answers["part"].to_pylist(), answers["counts"].to_pylist()))

        def answered(keys, deal, kind):
            out = np.zeros(len(keys), kind)
            for p, at in dealt(keys, deal(keys)):
                out[at] = unplaned(given[p], len(at), kind)
            return out

        codes, first = word_codes(*text_bytes(column))
        words = _distinct(codes)[0]
        count = valued(codes, words, answered(words, parts.of_words, np.int64))
        end = np.log10((ends + 0.5) / denominator)
        sums = lambda x: np.diff(np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])[first])
        tokens, seen = np.diff(first) + 1, sums((count > 0).astype(np.int64)) + (ends > 0)
        base = np.array([math.fsum(x.tolist()) for x in np.split(np.log10((count + 0.5) / denominator), first[1:-1])]) + end
        del codes, words, count  # before the keys, which take more room
        raw = raw_texts(column)
        keys = distinct_keys(raw)
        score = sums_of(raw, keys, answered(keys, parts.of_keys, np.float32))
        longs = [pa.array(np.asarray(x, np.int64)) for x in (tokens, seen, np.full(len(raw), n_all))]
        return pa.table(
            [texts["doc_id"].combine_chunks(), *longs, pa.array(base), pa.array(score)],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` by models of all rows of
    ``train``. Tokens are words and one end; words go by 64-bit hashes.

    Texts are dealt to blocks evenly, equal rows too. Null and empty texts have the end token only. Without training
    texts the base knows nothing and the tree is the uniform distribution. Repeated rows stay; other columns are
    not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    stored = Stored(spark)
    size = F.sum(F.octet_length("text"))
    learnt = train.agg(size.alias("size"), F.count(F.lit(1)).alias("n")).first()
    parts, ends = Parts.of(learnt["size"] or 0), learnt["n"]
    model = stored(counts(train, parts))  # read by the result, so it stays
    stored.release()
    top, n_words, v_words = levels(np.zeros(0, np.uint64), np.zeros(0, np.int64), TOP, 0), 0, 0
    for row in model.where(F.col("part") == parts.top).toLocalIterator():  # one, of at most 256 ** (TOP + 1) keys
        keys = unpack(row["keys"])
        top = levels(keys, unplaned(row["counts"], len(keys), np.int64), TOP, 0)
    tally = model.where(F.col("part").between(parts.contexts, parts.top - 1)).select("keys", "counts").mapInArrow(_tally, "n long, v long")
    known = tally.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_words, v_words = known["n"] or 0, known["v"] or 0
    shared = spark.sparkContext.broadcast(top)
    total = docs.agg(size).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, ceil(total / BLOCK_TEXT), min(2 * cores, ceil(total / SLICE)))
    block = F.pmod(F.monotonically_increasing_id() + F.xxhash64("text"), F.lit(blocks)).cast("int")
    blocked = docs.select(F.col("doc_id").cast("long"), "text").withColumn("block", block).repartition(blocks, "block")
    asked = blocked.groupBy("block").applyInArrow(frugal_group(_ask(parts)), _COUNTED)
    both = model.where(F.col("part") < parts.top).unionByName(asked)
    answers = both.repartition(parts.top, "part").sortWithinPartitions("part", "kind").mapInArrow(frugal(_answer(parts, shared)), _COUNTED)
    return (
        blocked.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            frugal_group(_finish(parts, ends, n_words + ends, v_words + (ends > 0))),
            "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(occurrences, distinct keys) of each packed row."""
    for batch in batches:
        for keys, counts in zip(batch.column(0), batch.column(1)):
            v = packed_size(keys.as_py())
            yield pa.record_batch([pa.array([int(unplaned(counts.as_py(), v, np.int64).sum())]), pa.array([v])], ["n", "v"])


def held_out(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 5 is not 1, score every row; adds held_out."""
    return score(docs, docs.where(crc_remainder("doc_id", 5) != 1)).withColumn("held_out", crc_remainder("doc_id", 5) == 1)
