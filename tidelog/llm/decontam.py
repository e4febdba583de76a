"""Benchmark decontamination: BM25 over test items by block-max WAND, then question and answer overlap."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, per_batch

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: A passage is retrieved for an item if it scores this share of what the item scores on itself.
RETRIEVE = 0.6
#: A retrieved item is a leak if a share of its question and of its answer's words is there. Of the question that is
#: QUESTION of its five-word shingles or, as one changed word takes five of those, PAIRS of its two-word ones; of the
#: answer ANSWER of its words, or all but one of at least three.
QUESTION, PAIRS, ANSWER, SHINGLE = 0.8, 0.6, 0.8, 5
#: Bytes of the items of one index; more make more indexes, each with a pass of its own.
ITEM_BYTES = 16 << 20
#: Items that share one bound, and most such blocks of an index: more items make larger blocks.
GROUP, BLOCKS = 8, 4096
#: Bounds of passages by block that are summed together.
BOUNDS = 1 << 22
#: Characters of texts looked up together.
TOGETHER = 1 << 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence or line is the answer; of a single one, the last quarter of its words."""
    body = text.strip()
    cut = max(body.rstrip(".!? \n").rfind(x) for x in (". ", ".\n", "? ", "?\n", "! ", "!\n", "\n"))
    question, answer = words_of(body[: cut + 1]), words_of(body[cut + 1 :])
    if not question or not answer:
        words = question + answer
        keep = len(words) - max(1, len(words) // 4)
        question, answer = words[:keep], words[keep:]
    return question, answer


def shingles(words: list, size: int = SHINGLE) -> set[tuple]:
    """Runs of ``size`` items; fewer make one run, none make none."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@dataclass
class Index:
    """An inverted index with normalised BM25 weights: an item scores 1 on its own text.

    A term's postings are in the order of items. ``width`` items side by side are a block; each term has the blocks
    that it is in, with its largest weight there and the first of its postings there.
    """

    ids: list[int | None]
    terms: dict[str, int]
    longest: int  # words of the longest item
    width: int
    top: np.ndarray  # each term's largest weight in any item
    items: np.ndarray
    weights: np.ndarray
    block_begin: np.ndarray  # of each term's blocks, n + 1
    block: np.ndarray
    block_top: np.ndarray
    block_first: np.ndarray  # of the postings of each term and block, and the end of all
    questions: list[list[int]]
    answers: list[set[int]]


def build(items: list[tuple[int | None, str]], frequency: dict[str, int], n_items: int, mean_words: float) -> Index:
    split = [(i, *question_and_answer(t)) for i, t in items]
    # items with like words are near each other if sorted by their rarest word, which sharpens the bounds of blocks
    rare = lambda ws: min(ws, key=lambda w: (frequency[w], w), default="")
    split.sort(key=lambda x: (rare(x[1] + x[2]), x[0] is None, x[0] or 0, x[1:]))
    terms: dict[str, int] = {}
    term_of, item_of, weight_of = [], [], []
    for k, (_, q, a) in enumerate(split):
        counts = Counter(q + a)
        long = K1 * (1 - B + B * (len(q) + len(a)) / mean_words)
        own = {
            terms.setdefault(w, len(terms)): log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1) / (n + long)
            for w, n in counts.items()
        }
        total = sum(own.values()) or 1
        term_of += own
        item_of += [k] * len(own)
        weight_of += [w / total for w in own.values()]
    term, item, weight = np.array(term_of, np.int64), np.array(item_of, np.int32), np.array(weight_of, np.float64)
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    width = max(GROUP, ceil(len(split) / BLOCKS))
    block = item // width
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
    block_begin = np.searchsorted(term[first], np.arange(len(terms) + 1))
    code = lambda ws: [terms[w] for w in ws]
    return Index(
        [i for i, _, _ in split],
        terms,
        max((len(q) + len(a) for _, q, a in split), default=1),
        width,
        np.maximum.reduceat(most, block_begin[:-1]) if len(first) else np.zeros(0),
        item,
        weight,
        block_begin,
        block[first],
        most,
        np.append(first, len(term)),
        [code(q) for _, q, _ in split],
        [set(code(a)) for _, _, a in split],
    )


def live_blocks(index: Index, passage: np.ndarray, term: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(passage, its terms' entries in one block) wherever the largest weights that the passage's terms have in the
    block sum to ``least`` or more. ``passage`` is sorted, its terms are distinct. No other block can hold an item to
    retrieve. An entry is a place in block, block_top and block_first."""
    n = index.block_begin[term + 1] - index.block_begin[term]
    blocks = -(-len(index.ids) // index.width)
    upto = np.cumsum(n)
    at = 0
    while at < len(term):
        # whole passages, of about BOUNDS bounds
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BOUNDS, "right"))
        stop = int(np.searchsorted(passage, passage[min(stop, len(term) - 1)])) if stop < len(term) else len(term)
        if stop <= at:
            stop = int(np.searchsorted(passage, passage[at], "right"))
        count = n[at:stop]
        entry = np.repeat(index.block_begin[term[at:stop]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        names, place = np.unique(passage[at:stop], return_inverse=True)
        key = np.repeat(place, count) * blocks + index.block[entry]
        live = np.bincount(key, index.block_top[entry], len(names) * blocks) >= least - 1e-9
        mine = np.flatnonzero(live[key])
        mine = mine[np.argsort(key[mine], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], key[mine][1:] != key[mine][:-1]])) if len(mine) else mine
        for a, b in zip(first.tolist(), np.append(first[1:], len(mine)).tolist()):
            yield int(names[key[mine[a]] // blocks]), entry[mine[a:b]]
        at = stop


def wand(index: Index, entries: np.ndarray, least: float) -> Iterator[tuple[int, float]]:
    """(item, score) of every item of a block that scores ``least`` or more on the terms with these entries there.

    One cursor for each term, ordered by the item it is at. The pivot is the first cursor up to which the terms' largest
    weights in the block reach ``least``: no item before the pivot's can, so the cursors before it skip to it. An item
    that they all stand at is scored.
    """
    begin, end = index.block_first[entries].tolist(), index.block_first[entries + 1].tolist()
    cursors = []  # [item, place, items, weights, largest weight]
    for a, b, most in zip(begin, end, index.block_top[entries].tolist()):
        items = index.items[a:b].tolist()
        cursors.append([items[0], 0, items, index.weights[a:b].tolist(), most])
    bound = least - 1e-9
    while cursors:
        cursors.sort(key=_item_of)
        reach, p = 0.0, -1
        for k, c in enumerate(cursors):
            reach += c[4]
            if reach >= bound:
                p = k
                break
        if p < 0:
            return
        item, score = cursors[p][0], 0.0
        if cursors[0][0] == item:
            for c in cursors:
                if c[0] != item:
                    break
                score += c[3][c[1]]
                c[1] += 1
            if score >= bound:
                yield item, score
        else:
            for c in cursors[:p]:
                while c[1] < len(c[2]) and c[2][c[1]] < item:
                    c[1] += 1
        for c in cursors[: p + 1] if not score else cursors:
            c[0] = c[2][c[1]] if c[1] < len(c[2]) else -1
        cursors = [c for c in cursors if c[0] >= 0]


def _item_of(cursor: list) -> int:
    return cursor[0]


def retrieve(index: Index, words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(begin, end, item, score) for all items at RETRIEVE or more of their own score, by passage.

    ``words`` are term numbers, -1 for others. Where the sum of all terms' largest weights is below the threshold, no
    pivot can be found; nor in blocks where the sum of their largest weights in the block is. Both are decided for many
    passages at once; the cursors walk the blocks that are left.
    """
    known = np.flatnonzero(words >= 0)
    if not len(known) or not len(starts):
        return
    # words repeated inside one half passage count once: sort (half passage, term), keep the first of each
    half_first = np.searchsorted(starts, known, "right") - 1
    key = _distinct(half_first.astype(np.int64) << 32 | words[known])
    mass = np.bincount(key >> 32, index.top[key & 0xFFFFFFFF], len(starts))
    after = np.zeros(len(starts))
    same = np.append(starts[1:] == ends[:-1], False)  # the next half belongs to the same text
    after[:-1][same[:-1]] = mass[1:][same[:-1]]
    hopeful = mass + after >= RETRIEVE - 1e-6
    half = key >> 32
    second = key[(half > 0) & same[half - 1]] - (1 << 32)  # a half's terms belong to the passage before, too
    key = np.concatenate([key[hopeful[half]], second[hopeful[second >> 32]]])
    key = _distinct(key)
    for p, entries in live_blocks(index, key >> 32, key & 0xFFFFFFFF, RETRIEVE):
        for k, score in wand(index, entries, RETRIEVE):
            yield int(starts[p]), int(ends[p + 1] if same[p] else ends[p]), k, score


def _distinct(key: np.ndarray) -> np.ndarray:
    key = np.sort(key)
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def overlaps(question: list[int], answer: set[int], passage: list[int]) -> tuple[float, float, bool]:
    """(share of the question's five-word shingles, share of the answer's words, whether that is a leak)."""
    def share(size: int) -> float:
        wanted = shingles(question, size)
        size = len(next(iter(wanted), ()))
        return len(wanted & shingles(passage, max(1, size))) / len(wanted) if wanted else 1.0

    asked = share(SHINGLE)
    there = len(answer & set(passage))
    told = there / len(answer) if answer else 1.0
    answered = told >= ANSWER or len(answer) >= 3 and there >= len(answer) - 1
    return asked, told, answered and (asked >= QUESTION or share(2) >= PAIRS)


def leaks_in(index: Index, texts: list[str]) -> list[tuple[int, int, float, float, float]]:
    """(row, item_id, score, question overlap, answer overlap) of the leaks in each text, best passage only."""
    get = index.terms.get
    out: list[tuple[int, int, float, float, float]] = []
    at = 0
    while at < len(texts):
        first, size, flat, starts, ends, rows = at, 0, [], [], [], []
        while at < len(texts) and (at == first or size + len(texts[at]) <= TOGETHER):
            words = [get(w, -1) for w in words_of(texts[at])]
            for s in range(0, len(words), index.longest):
                starts.append(len(flat) + s)
                ends.append(len(flat) + min(s + index.longest, len(words)))
                rows.append(at)
            # a gap of one word keeps the last passage of a text apart from the next text
            flat += words
            flat.append(-1)
            size += len(texts[at])
            at += 1
        codes, begin, end = np.array(flat, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)
        row_of = dict(zip(starts, rows))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for s, e, k, score in retrieve(index, codes, begin, end):
            question, answer, leak = overlaps(index.questions[k], index.answers[k], codes[s:e].tolist())
            if leak:
                found = (score, question, answer)
                place = (row_of[s], k)
                best[place] = max(best.get(place, found), found)
        out += [(row, index.ids[k], *v) for (row, k), v in sorted(best.items())]
    return out


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # of ITEM_BYTES of items
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = leaks_in(shared.value, pc.fill_null(batch.column(1), "").to_pylist())
            columns = list(zip(*((ids[r], *rest) for r, *rest in found))) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        frugal(run), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    )


def _split(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_text, words): the distinct words of each item that has any, as passages are cut into words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [sorted(set(words_of(t or ""))) for t in batch.column(1).to_pylist()]
        n = [len(words_of(t or "")) for t in batch.column(1).to_pylist()]
        return pa.record_batch([*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array(n, pa.int64())], ["item_id", "item_text", "words", "n"])

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").alias("item_text"))
    return per_batch(items, run, "item_id long, item_text string, words array<string>, n long").where("n > 0")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every benchmark item found in a text.

    Every passage of every text is a query: runs of twice as many words as the longest item, each half
    overlapping the next, so an item in a text lies whole in one passage. score is BM25 as a share of
    the item's score on itself; passages are words without case or punctuation.

    Null and empty texts have no leaks; items without a word match nothing; an item repeated in a text is
    one row; repeated rows of ``docs`` or ``benchmark`` give rows each; a null doc_id or item_id stays null. Other
    columns are not read. Empty tables give no rows. Items of more than ITEM_BYTES are cut into indexes of about
    that size; each is one pass over ``docs``.
    """
    split = _split(benchmark)
    totals = split.agg(
        F.count(F.lit(1)).alias("n"), F.sum("n").alias("words"), F.sum(F.octet_length("item_text")).alias("bytes")
    ).first()
    if not totals["n"]:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
        )
    parts = ceil(totals["bytes"] / ITEM_BYTES * 1.2) if totals["bytes"] > ITEM_BYTES else 1
    part = F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts))
    words = split.select(part.alias("part"), F.explode("words").alias("w"))
    # how many items have each word, beside each part that has it: a part's share is bounded as its items are
    frequency = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.collect_set("part").alias("parts"))
    found = []
    for k in range(parts):
        listed = [(r["item_id"], r["item_text"]) for r in split.where(part == k).select("item_id", "item_text").collect()]
        if not listed:
            continue
        counts = {r["w"]: r["n"] for r in frequency.where(F.array_contains("parts", F.lit(k).cast("long"))).select("w", "n").collect()}
        found.append(_scan(docs, build(listed, counts, totals["n"], totals["words"] / totals["n"])))
    return reduce(DataFrame.unionByName, found)
