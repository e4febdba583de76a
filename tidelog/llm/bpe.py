"""Byte-level BPE by a minimal acyclic transducer of frequent words, and exact merges for the rest.

The automaton shares suffixes: states with equal futures are one state. Each transition knows how many
words lie before its branch, so the sum along a path is the word's place in sorted order (a
minimal perfect hash), and a table at that place holds the word's ids. It is one file that every
worker maps into memory.
"""

from __future__ import annotations

import atexit
import functools
import heapq
import json
import mmap
import os
import shutil
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, bounded_batches, frugal

#: How the byte-level tokenizer cuts texts before any merge.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LETTERS = regex.compile(r"\p{L}+")
#: Words in the lexicon.
LEXICON = 1 << 16
#: Words a worker counts before it hands them on, and remembers before it forgets them.
HELD, REMEMBERED = 200_000, 400_000
#: Characters of texts whose unseen words are looked up together.
TOGETHER = 1 << 20
#: Above every rank.
NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _must_be_plain(spec: dict) -> None:
    """A file that asks for what is not done here would be encoded otherwise than the library does, so it is refused."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = {
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": cut.get("type") != "ByteLevel" or bool(cut.get("add_prefix_space")) or not cut.get("use_regex", True),
        "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if any(odd.values()):
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(k for k, v in odd.items() if v)}")


class Vocabulary:
    """Ids, merges and added tokens of a tokenizer file: byte-level BPE with the library's own cut into words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _must_be_plain(spec)
        to_byte = byte_alphabet()
        ids = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = token.encode() if token in added else bytes(to_byte[c] for c in token)
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.of_byte = [ids[c] for c in sorted(to_byte, key=to_byte.get)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[ids[a], ids[b]] = (rank, ids[a + b])
        self.packed = {p: rank << 24 | new for p, (rank, new) in self.pairs.items()}
        self.added = added
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None

    def merge(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.packed.get
        ranks = [get(p, NONE) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            ids[i] = new = least & 0xFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), NONE)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        n, pairs = len(ids), self.pairs
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heap = [(rank, i, a, b, new) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (p := (ids[k], ids[right[k]])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], k, *p, pairs[p][1]))
        return [x for x in ids if x >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The transducer's file for ``words`` and their ids."""
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    ordered = sorted(words)
    path: list[list] = [[False, [], -1]]  # on the way to the last word: final, arcs, label that leads there

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs, label = path.pop()
            path[-1][1].append((label, freeze(final, arcs)))

    last = b""
    for word in ordered:
        shared = os.path.commonprefix([last, word])
        close(len(shared))
        for b in word[len(shared) :]:
            path.append([False, [], b])
        path[-1][0] = True
        last = word
    close(0)
    root = freeze(path[0][0], path[0][1])

    below = [0] * len(frozen)  # words from each state; children are frozen before their parents
    arc, target, before = [], [], []
    for s, (final, arcs) in enumerate(frozen):
        n = int(final)
        for b, to in arcs:
            arc.append(s << 8 | b)
            target.append(to)
            before.append(n)
            n += below[to]
        below[s] = n
    flat = [i for w in ordered for i in words[w]]
    starts = np.concatenate([[0], np.cumsum([len(words[w]) for w in ordered])])
    parts = [
        np.array(arc, "<i8").tobytes(),
        np.array(target, "<i4").tobytes(),
        np.array(before, "<i4").tobytes(),
        starts.astype("<i4").tobytes(),
        np.array(flat, "<u4").tobytes(),
        bytes(f for f, _ in frozen),
    ]
    return struct.pack("<5q", len(frozen), len(target), len(ordered), len(flat), root) + b"".join(parts)


class Lexicon:
    """A compiled transducer, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, words, ids, self.root = struct.unpack_from("<5q", self.map)
        at = 40

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(self.map, kind, n, at)
            at += part.nbytes
            return part

        self.arcs, self.target, self.before = take(arcs, "<i8"), take(arcs, "<i4"), take(arcs, "<i4")
        self.starts, self.ids, self.final = take(words + 1, "<i4"), take(ids, "<u4"), take(states, "u1")

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the lexicon's, -1 for those it hasn't. All words walk together,
        a byte at a time; an arc is found by binary search over (state, label)."""
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(words), np.uint8)
        state, place = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        if not len(self.arcs):
            return np.where(size == 0, 0, -1) if self.final[self.root] else np.full(len(words), -1)
        going = np.flatnonzero(size > 0)
        k = 0
        while len(going):
            key = state[going] << 8 | raw[begin[going] + k]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            found = self.arcs[at] == key
            place[going[~found]] = -1
            state[going[~found]] = -1
            going, at = going[found], at[found]
            place[going] += self.before[at]
            state[going] = self.target[at]
            k += 1
            going = going[size[going] > k]
        return np.where((state >= 0) & (self.final[state] > 0), place, -1)

    def get(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian 32-bit numbers, None if it isn't in the lexicon."""
        starts, ids = self.starts, self.ids
        return [ids[starts[p] : starts[p + 1]].tobytes() if p >= 0 else None for p in self.places(words)]


class Known(dict):
    """Ids by word: remembered, else from the lexicon, else merged. It forgets all after REMEMBERED words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        super().__init__()
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def learn(self, words: set[str]) -> None:
        new = list(words)
        raw = [w.encode() for w in new]
        merge = self.vocabulary.merge
        for word, b, found in zip(new, raw, self.lexicon.get(raw)):
            self[word] = np.array(merge(b), "<u4").tobytes() if found is None else found

    def cut(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of added tokens whose strings are in it."""
        cut = self.vocabulary.cut
        if cut is None or not any(t in text for t in self.vocabulary.added):
            return WORDS.findall(text)
        out: list[str | int] = []
        for part in cut.split(text):
            added = self.vocabulary.added.get(part)
            out += WORDS.findall(part) if added is None else [added]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        out, at = [], 0
        while at < len(texts):
            cuts, size = [], 0
            while at < len(texts) and (not cuts or size + len(texts[at]) <= TOGETHER):
                size += len(texts[at])
                cuts.append(self.cut(texts[at]))
                at += 1
            new = set().union(*cuts).difference(self)
            if len(new) + len(self) > REMEMBERED:
                self.clear()
                new = set().union(*cuts)
            for token in [w for w in new if isinstance(w, int)]:
                self[token] = struct.pack("<I", token)
                new.remove(token)
            self.learn(new)
            out += [b"".join([self[w] for w in words]) for words in cuts]
        return out

    def decode(self, ids: bytes) -> str:
        table = self.vocabulary.bytes
        return b"".join([table[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, words between white space; counted in part by each task, summed by Spark."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            for text in pc.fill_null(batch.column(0), "").to_pylist():
                counts.update(text.split())
                if len(counts) > HELD:
                    yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(frugal(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, size: int = LEXICON) -> bytes:
    """Compile the most frequent words of all texts, each with the space before it. ``size`` bounds the file.

    Counts fall into steps of a sixteenth of a power of two; the words of the highest steps that are ``size``
    or fewer together come to the driver, so what is sent does not grow with the number of partitions.
    """
    stored = Stored(docs.sparkSession)
    counts = stored(word_counts(docs.where("text is not null")).where(F.length("word") < 64))
    step = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        total += row["words"]
        if total > size:
            break
        least = row["step"]
    frequent = counts.where(step >= least).select("word").collect() if least is not None else []
    stored.drop(counts)
    words = {f" {r['word']}".encode() for r in frequent if LETTERS.fullmatch(r["word"])}
    return compile_lexicon({w: vocabulary.merge(w) for w in words})


@functools.cache
def _folder() -> str:
    """Where the driver keeps the files that it serves, until it ends."""
    folder = tempfile.mkdtemp(prefix="lexicon-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


_OPEN: dict[str, Known] = {}


def _opened(tokenizer: str, name: str) -> Known:
    """The tokenizer and the mapped lexicon, once for each worker process."""
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Known(Vocabulary(tokenizer), Lexicon(SparkFiles.get(name)))
    return _OPEN[name]


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids binary, decoded string) for every row: encoded, then decoded from the ids.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read. A null or empty text
    has no ids. Strings of added tokens inside a text become those tokens, as in the library's
    default. Repeated rows stay, other columns are not read, an empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(_folder(), name)  # on the driver only; Spark serves it to the executors
    with open(path, "wb") as f:
        f.write(build_lexicon(docs, Vocabulary(tokenizer)))
    context.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _opened(tokenizer, name)
        for batch in batches:
            ids = known.encode(pc.fill_null(batch.column(1), "").to_pylist())
            back = [known.decode(x) for x in ids]
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"]
            )
        known.clear()  # the worker may next do something else

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(frugal(run), "doc_id long, ids binary, decoded string")
