"""Removal of long byte strings that occur twice, by suffix arrays over shards.

A string of ``least`` bytes has a lowest anchor: of the hashes of all its short runs (ANCHOR bytes), the
smallest. Equal strings have equal anchors, so a string can only repeat where its anchor does. The
strings that begin side by side and share one anchor form a region. Regions equal to another are
repeats as a whole and are settled by a count. What is left, different regions around one
anchor, goes to shards by anchor, where a suffix array finds which of their strings are equal. An
anchor with very many regions is cut into several shards; these exchange sorted digests of their strings,
which are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Stored, bounded_batches, checkpointed, frugal_group, per_batch, powers, raw_texts

ANCHOR = 64
#: Bytes hashed together; longer texts are taken in parts, whose strings begin in different parts only.
BLOCK = 1 << 20
#: Bytes of regions in a shard, and regions of one anchor in a shard.
SHARD_BYTES, HOT = 1 << 20, 1000
#: Strings that sub-shards exchange are dealt to ranges of digests of about this many.
RANGE = 1 << 19

def run_hashes(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """A hash of every run of ``size`` bytes, which depends on those bytes alone."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * down[: len(data)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * up[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values side by side, from block-wise running minima."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def regions(data: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first begin, begins, anchor hash) of every region of the texts in ``data``."""
    width = least - ANCHOR + 1
    h = run_hashes(data)
    place = np.arange(len(h), dtype=np.uint64)
    low = lowest((h & ~np.uint64((1 << 24) - 1)) | place, width)  # equal hashes: the first is taken
    stop = bounds[1:] - least + 1  # behind a text's last begin
    texts = np.flatnonzero(stop > bounds[:-1])
    if not len(texts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    turn = np.flatnonzero(low[1:] != low[:-1]) + 1
    of = np.searchsorted(bounds, turn, "right") - 1
    inner = (turn > bounds[of]) & (turn < stop[of])
    of, at = np.concatenate([texts, of[inner]]), np.concatenate([bounds[texts], turn[inner]])
    order = np.argsort(at)
    of, at = of[order], at[order]
    last = np.append(of[1:] != of[:-1], True)
    anchor = (low[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return of, at, np.where(last, stop[of], np.append(at[1:], 0)) - at, h[anchor]


def _parts(texts: list[bytes], least: int):
    """(row numbers, offset in its text, data, bounds) of about BLOCK bytes; parts of a long text overlap by
    ``least`` - 1 bytes, so each string begins in one part."""
    rows, at, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - least + 1), BLOCK):
            piece = t[s : s + BLOCK + least - 1]
            if held and size + len(piece) > 2 * BLOCK:
                yield rows, at, np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in held])])
                rows, at, held, size = [], [], [], 0
            rows.append(i), at.append(s), held.append(piece)
            size += len(piece)
    if held:
        yield rows, at, np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in held])])


def text_key(text: Column) -> list[Column]:
    """128 bits of hash, by which equal texts are one."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def _all_regions(texts: DataFrame, least: int) -> DataFrame:
    """(h1, h2, first, begins, anchor, r): the regions of every text, once for equal texts. Equal regions have
    equal anchors, so a region's name is the 128 bits of anchor and r."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        chosen = np.unique(np.stack([h1, h2], 1), axis=0, return_index=True)[1]
        raw = raw_texts(batch.column(2).take(pa.array(chosen)))
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for rows, offset, data, bounds in _parts(raw, least):
            of, first, begins, anchor = regions(data, bounds, least)
            view = memoryview(data)
            digest = xxhash.xxh3_64_digest
            both = b"".join([digest(view[a : a + n + least - 1]) for a, n in zip(first.tolist(), begins.tolist())])
            r = np.frombuffer(both, "<i8")
            row = chosen[np.array(rows)[of]] if len(of) else of
            start = first - bounds[of] + np.array(offset)[of] if len(of) else first
            for c, v in zip(columns, (h1[row], h2[row], start, begins, anchor.astype(np.int64), r)):
                c.append(v)
        arrays = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in columns]
        return pa.record_batch(arrays, ["h1", "h2", "first", "begins", "anchor", "r"])

    schema = "h1 long, h2 long, first long, begins long, anchor long, r long"
    return per_batch(texts.select("h1", "h2", "text"), run, schema).distinct()


_OCCURRENCES = "anchor long, r long, n long, h1 long, h2 long, first long, begins long, occ binary"


def _packed(found: DataFrame) -> DataFrame:
    """One row for each region of a batch: how many occurrences it has there, one of them, and all of them as
    32 bytes each in occ (null for one). A region that very many texts share is a few rows, bounded by a batch's
    size, wherever it goes from here."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = {c: batch.column(c).to_numpy() for c in ("anchor", "r", "h1", "h2", "first", "begins")}
        order = np.lexsort((column["first"], column["h2"], column["h1"], column["r"], column["anchor"]))
        c = {k: v[order] for k, v in column.items()}
        new = np.flatnonzero(np.concatenate([[True], (c["anchor"][1:] != c["anchor"][:-1]) | (c["r"][1:] != c["r"][:-1])]))
        ends = np.append(new[1:], len(order))
        rows = np.stack([c["h1"], c["h2"], c["first"], c["begins"]], 1)
        occ = [rows[a:b].tobytes() if b - a > 1 else None for a, b in zip(new.tolist(), ends.tolist())]
        one = [pa.array(c[k][new]) for k in ("h1", "h2", "first", "begins")]
        return pa.record_batch(
            [pa.array(c["anchor"][new]), pa.array(c["r"][new]), pa.array(ends - new), *one, pa.array(occ, pa.binary())],
            ["anchor", "r", "n", "h1", "h2", "first", "begins", "occ"],
        )

    return per_batch(found.select("anchor", "r", "h1", "h2", "first", "begins"), run, _OCCURRENCES)


def _joined_spans(h1: np.ndarray, h2: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Spans of one text that meet become one."""
    order = np.lexsort((lo, h2, h1))
    h1, h2, lo, hi = h1[order], h2[order], lo[order], hi[order]
    new = np.ones(len(lo), bool)
    if len(lo) > 1:
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        text = np.concatenate([[0], np.cumsum(~same)])
        reach = np.maximum.accumulate(hi + text * (1 << 40)) - text * (1 << 40)  # the farthest end so far in this text
        new[1:] = ~same | (lo[1:] > reach[:-1])
    at = np.flatnonzero(new)
    ends = np.maximum.reduceat(hi, at) if len(at) else hi
    return pa.record_batch([pa.array(x.astype(np.int64)) for x in (h1[at], h2[at], lo[at], ends)], ["h1", "h2", "lo", "hi"])


def _whole(rows: DataFrame, least: int) -> DataFrame:
    """(h1, h2, lo, hi) of all occurrences in packed ``rows``; those of one batch that meet are one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = batch.column("occ").to_pylist()
        alone = np.array([x is None for x in packed])
        plain = np.stack([batch.column(c).to_numpy()[alone] for c in ("h1", "h2", "first", "begins")], 1)
        every = np.concatenate([plain, np.frombuffer(b"".join(x for x in packed if x is not None), np.int64).reshape(-1, 4)])
        return _joined_spans(every[:, 0], every[:, 1], every[:, 2], every[:, 2] + every[:, 3] - 1 + least)

    return per_batch(rows.select("h1", "h2", "first", "begins", "occ"), run, "h1 long, h2 long, lo long, hi long")


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by Larsson-Sadakane refinement: sorted by the first symbols, then groups of equal suffixes
    are sorted by the rank of what follows, over twice the length each time, until no group is left."""
    n = len(symbols)
    wide = max(1, n.bit_length())
    fits = 3 * wide <= 63
    depth = 4
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = symbols[k:]
        part[: max(0, n - k)] += np.uint64(1)  # zero is the end
        key = key << np.uint64(9) | part

    def sort(key: np.ndarray, bits: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if bits + wide <= 64:
            mixed = np.sort(key << np.uint64(wide) | of.astype(np.uint64))
            return (mixed & np.uint64((1 << wide) - 1)).astype(np.int64), mixed >> np.uint64(wide)
        order = np.argsort(key, kind="stable")
        return of[order], key[order]

    order, sorted_key = sort(key, 36, np.arange(n))
    rank = np.empty(n, np.int64)
    starts = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    number = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank[order] = number
    sa = order
    single = starts & np.append(starts[1:], True)
    todo = np.flatnonzero(~single)  # places of the suffix array still in groups
    while len(todo):
        of = sa[todo]
        after = of + depth
        follow = np.zeros(len(of), np.int64)
        inside = after < n
        follow[inside] = rank[after[inside]] + 1
        if fits:
            key = rank[of].astype(np.uint64) << np.uint64(wide) | follow.astype(np.uint64)
            got, sorted_key = sort(key, 2 * wide, of)
            new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        else:
            by = np.lexsort((follow, rank[of]))
            got, a, b = of[by], rank[of][by], follow[by]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        sa[todo] = got
        rank[got] = todo[np.maximum.accumulate(np.where(new, np.arange(len(got)), 0))]
        alone = new & np.append(new[1:], True)
        todo = todo[~alone]
        depth *= 2
    return sa


def common_prefixes(symbols: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place but the first, how many symbols its suffix shares with the one before (Kasai's lemma).

    In text order the length falls by one at most, and just so where the symbols before both suffixes are
    equal. Only the other places are compared, eight symbols at a time, all at once.
    """
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    index = np.arange(n)
    ruled = np.zeros(n, bool)
    ok = (index[1:] > 0) & (before[1:] > 0)
    ruled[1:][ok] = symbols[:-1][ok] == symbols[before[1:][ok] - 1]
    own = np.flatnonzero(~ruled & (before >= 0))
    length = np.zeros(n, np.int64)
    i, j = own.copy(), before[own]
    padded = np.concatenate([symbols, np.zeros(8, symbols.dtype)])
    going = np.arange(len(own))
    while len(going):
        a, b = i[going], j[going]
        equal = np.ones(len(going), bool)
        gone = np.zeros(len(going), np.int64)
        for k in range(8):
            equal &= (padded[np.minimum(a + k, n)] == padded[np.minimum(b + k, n)]) & (np.maximum(a, b) + k < n)
            gone += equal
        length[own[going]] += gone
        i[going] += gone
        j[going] += gone
        going = going[equal]
    reach = np.where(ruled, -1, length + index)
    reach = np.maximum.accumulate(reach)
    by_text = np.maximum(0, np.where(before >= 0, reach - index, 0))
    return by_text[sa[1:]]


def repeated_begins(parts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For the concatenated ``parts`` (with a separator after each): which places begin a string of ``least``
    bytes that also begins elsewhere, and which of those are not the first of their equals."""
    size = np.array([len(p) + 1 for p in parts])
    symbols = np.zeros(size.sum(), np.uint16)
    begin = np.cumsum(size) - size
    for b, p in zip(begin.tolist(), parts):
        symbols[b : b + len(p)] = np.frombuffer(p, np.uint8)
        symbols[b : b + len(p)] += 1
    sa = suffix_array(symbols)
    long = common_prefixes(symbols, sa) >= least
    # equal separators may be shared too, but a string inside its part has none
    last = np.repeat(begin + size - 1, size)  # the separator of each place's part
    inside = np.arange(len(symbols)) + least <= last
    repeated, later = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
    repeated[sa[1:][long]] = True
    repeated[sa[:-1][long]] = True
    later[sa[1:][long]] = True
    return repeated & inside, later & inside


def _shared(anchors: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, reach: int) -> np.ndarray:
    """For each of several pieces of ``data``, how many of its ``size`` bytes from ``start`` on, ``reach`` at most, the
    piece with the same anchor most like it shares; -1 if no other piece has the anchor."""
    if len(anchors) < 2:
        return np.full(len(anchors), -1)
    step = np.arange(reach)
    rows = np.zeros((len(anchors), 8 + reach), np.uint8)
    rows[:, :8] = anchors.astype(">i8").view(np.uint8).reshape(-1, 8)
    rows[:, 8:] = np.where(step < size[:, None], data[np.minimum(start[:, None] + step, len(data) - 1)], 0)
    order = np.argsort(rows.view(f"S{8 + reach}").ravel())
    rows = rows[order]
    unlike = rows[1:] != rows[:-1]
    like = np.where(unlike.any(axis=1), unlike.argmax(axis=1), 8 + reach) - 8  # in order, the most alike are side by side
    most = np.empty(len(anchors), np.int64)
    most[order] = np.maximum(np.append(like, -1), np.append(-1, like))
    return np.where(most < 0, -1, np.minimum(most, size))


def trimmed(anchors: np.ndarray, pieces: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each region's piece, the stretch outside which no string occurs in another piece; empty if none can.

    Equal strings have their common anchor at the same place. So a string occurs in another piece only if the bytes
    before the anchor agree with those of a piece of the same anchor, and so do those after it.
    """
    size = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(size) - size
    # a piece's anchor is the first run of its hash, as of equal runs the first is taken
    h = np.append(run_hashes(data), np.zeros(ANCHOR - 1, np.uint64))
    found = np.flatnonzero(h == np.repeat(anchors.view(np.uint64), size))
    place = found[np.searchsorted(found, begin)]
    reach = least - ANCHOR
    after = _shared(anchors, data, place + ANCHOR, begin + size - place - ANCHOR, reach)
    before = _shared(anchors, data[::-1], len(data) - place, place - begin, reach)
    ok = (after >= 0) & (before + ANCHOR + after >= least)
    lo = place - begin - before
    return np.where(ok, lo, 0), np.where(ok, lo + before + ANCHOR + after, 0)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


_SHARD_OUT = "h1 long, h2 long, lo long, hi long, range int, digests binary, refs binary"


def _in_shard(least: int, ranges: int):
    """The suffix array of one shard: spans repeated in it, and digests of strings of anchors that were cut."""
    cuts = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64) if ranges > 1 else np.zeros(0, np.uint64)

    digest = xxhash.xxh3_128_digest

    def run(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group[c].to_pylist() for c in ("h1", "h2", "first", "begins", "occurs", "cut", "piece"))))
        spans, hashes, refs = [], [], []
        here = [i for i, r in enumerate(rows) if not r[5]]  # all regions of their anchors are in this shard
        if here:
            anchors = group["anchor"].to_numpy()[here]
            lo, hi = trimmed(anchors, [rows[i][6] for i in here], least)
            like: dict[bytes, list[tuple]] = {}
            for i, anchor, a, b in zip(here, anchors.tolist(), lo.tolist(), hi.tolist()):
                if b > a:
                    h1, h2, first, _, occurs, _, piece = rows[i]
                    like.setdefault(piece[a:b], []).append((anchor, h1, h2, first + a, occurs))
            kinds = Counter(found[0][0] for found in like.values())
            rows = [r for r in rows if r[5]]
            for piece, found in like.items():
                if len(found) > 1:  # equal stretches are repeats as a whole
                    spans += [(h1, h2, first, first + len(piece)) for _, h1, h2, first, occurs in found if occurs == 1]
                anchor, h1, h2, first, occurs = found[0]
                if kinds[anchor] > 1:  # others may share a part
                    rows.append((h1, h2, first, len(piece) - least + 1, max(occurs, len(found)), False, piece))
        repeated, later = repeated_begins([r[6] for r in rows], least) if rows else (None, None)
        at = 0
        for h1, h2, first, begins, occurs, cut, piece in rows:
            own = repeated[at : at + begins]
            if occurs == 1:  # a region that occurs again is removed as a whole
                spans += [(h1, h2, first + a, first + b - 1 + least) for a, b in zip(*(x.tolist() for x in _runs(own)))]
            if cut:
                view = memoryview(piece)
                k = np.flatnonzero(~later[at : at + begins])
                hashes += [digest(view[i : i + least]) for i in k.tolist()]
                ref = np.empty((len(k), 3), np.int64)
                ref[:, 0], ref[:, 1], ref[:, 2] = h1, h2, np.where(own[k], -1, first + k) if occurs == 1 else -1
                refs.append(ref)
            at += len(piece) + 1
        out = {c: [x[i] for x in spans] for i, c in enumerate(("h1", "h2", "lo", "hi"))}
        n = len(spans)
        slices = []
        if hashes:
            high = np.frombuffer(b"".join(hashes), ">u8").reshape(-1, 2).astype(np.uint64)
            order = np.lexsort((high[:, 1], high[:, 0]))
            high, ref = high[order], np.concatenate(refs)[order]
            edge = [0, *np.searchsorted(high[:, 0], cuts).tolist(), len(high)]
            slices = [
                (k, high[a:b].tobytes(), ref[a:b].tobytes()) for k, (a, b) in enumerate(zip(edge, edge[1:])) if b > a
            ]
        none = [None] * len(slices)
        return pa.table(
            {
                **{c: pa.array(v + none, pa.int64()) for c, v in out.items()},
                "range": pa.array([None] * n + [s[0] for s in slices], pa.int32()),
                "digests": pa.array([None] * n + [s[1] for s in slices], pa.binary()),
                "refs": pa.array([None] * n + [s[2] for s in slices], pa.binary()),
            }
        )

    return run


def _there(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are in ``sorted_values``, by binary search."""
    if not len(sorted_values):
        return np.zeros(len(asked), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)] == asked


def _merge(least: int):
    """Slices of sorted digests, one from each shard: a digest in two slices is a string in two shards."""

    def run(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(d, np.uint64).reshape(-1, 2) for d in group["digests"].to_pylist()]
        refs = [np.frombuffer(r, np.int64).reshape(-1, 3) for r in group["refs"].to_pylist()]
        every = np.sort(np.concatenate([p[:, 0] for p in parts]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])  # first words that occur again; only these need the second
        like = [np.flatnonzero(_there(twice, p[:, 0])) for p in parts]
        pairs = np.concatenate([p[i] for p, i in zip(parts, like)])
        name = np.unique(pairs, axis=0, return_inverse=True)[1].ravel() if len(pairs) else np.zeros(0, np.int64)
        again = np.bincount(name)[name] > 1 if len(pairs) else np.zeros(0, bool)
        ref = np.concatenate([r[i] for r, i in zip(refs, like)])
        got = ref[again & (ref[:, 2] >= 0)]
        return pa.table({"h1": got[:, 0], "h2": got[:, 1], "lo": got[:, 2], "hi": got[:, 2] + least})

    return run


def repeated_spans(docs: DataFrame, least: int) -> DataFrame:
    """(h1, h2, copies, spans): for every text, how many rows have it and the byte spans to remove.

    A text of ``least`` bytes or more that several rows have is removed whole; its spans may be null.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(bytearray()))
    keyed = docs.select(*text_key(text), text.alias("text"), "doc_id").where(F.octet_length("text") >= least)
    rows = keyed.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    classes = checkpointed(
        rows.groupBy("h1", "h2").agg(F.sum("n").alias("copies"), F.min(F.struct("doc_id", "n")).alias("one"))
        .select("h1", "h2", "copies", F.col("one.doc_id").alias("one"), F.col("one.n").alias("ties"))
    )
    stored = Stored(spark)
    found = stored(_all_regions(keyed, least))
    # counts are stored before they are joined: then Spark may split a hot anchor's rows over several tasks,
    # which it can't while one stage both counts and joins them
    twice = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    repeated = stored(_packed(found.join(twice, "anchor", "left_semi")))
    stored.drop(found, twice)
    by_region = stored(
        repeated.groupBy("anchor", "r")
        .agg(F.sum("n").alias("occurs"), F.min(F.struct("h1", "h2", "first", "begins")).alias("one"))
        .select("anchor", "r", "occurs", "one.*")
    )
    whole = _whole(repeated.join(by_region.where("occurs > 1").select("anchor", "r"), ["anchor", "r"], "left_semi"), least)
    several = stored(by_region.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    mixed = stored(by_region.join(several, "anchor"))
    totals = mixed.agg(
        F.sum(F.col("begins") + least).alias("bytes"), F.sum(F.when(F.col("n") > HOT, F.col("begins"))).alias("cut")
    ).first()
    shards = max(1, ceil((totals["bytes"] or 0) / SHARD_BYTES))
    ranges = max(1, ceil((totals["cut"] or 0) / RANGE))
    salt = F.pmod(F.xxhash64("r"), F.ceil(F.col("n") / HOT))
    dealt = mixed.select(
        "h1", "h2", "first", "begins", "occurs", "anchor", "r", (F.col("n") > HOT).alias("cut"),
        F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).cast("int").alias("shard"),
    )
    # bytes come from one row of each text: that of its least id; where equal rows share that id, from any
    wanted = keyed.join(classes.select("h1", "h2", "one", "ties"), ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("one")))
    texts = wanted.where("ties = 1").select("h1", "h2", "text")
    if classes.where("ties > 1").limit(1).count():
        texts = texts.unionByName(wanted.where("ties > 1").select("h1", "h2", "text").dropDuplicates(["h1", "h2"]))
    pieces = dealt.join(texts, ["h1", "h2"]).select(
        *dealt.columns, F.substring("text", F.col("first").cast("int") + 1, (F.col("begins") + least - 1).cast("int")).alias("piece")
    )
    shard_out = stored(pieces.groupBy("shard").applyInArrow(frugal_group(_in_shard(least, ranges)), _SHARD_OUT))
    merged = (
        shard_out.where("range is not null")
        .groupBy("range")
        .applyInArrow(frugal_group(_merge(least)), "h1 long, h2 long, lo long, hi long")
    )
    spans = checkpointed(
        whole.unionByName(shard_out.where("lo is not null").select("h1", "h2", "lo", "hi"))
        .unionByName(merged)
        .groupBy("h1", "h2")
        .agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    )
    stored.drop(repeated, by_region, several, mixed, shard_out)
    stored.release()
    return classes.select("h1", "h2", "copies").join(spans, ["h1", "h2"], "left")


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


#: The span of a text that several rows have: all of it.
_ALL = [0, -1]


def _flat(copies: Column, spans: Column) -> Column:
    """Spans as (lo, hi, lo, hi, ...), _ALL for a text that has copies."""
    return F.when(copies > 1, F.array(*(F.lit(x).cast("long") for x in _ALL))).otherwise(
        F.flatten(F.transform(spans, lambda s: F.array(s["lo"], s["hi"])))
    )


def _spans_of(raw: bytes, flat: list[int] | None) -> list[tuple[int, int]]:
    if not flat:
        return []
    if flat == _ALL:
        return [(0, len(raw))]
    return _union(list(zip(flat[::2], flat[1::2])))


def _keyed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``found`` beside its _h1 and _h2, by the hash of text; without a match they are null."""
    key = [k.alias(f"_{n}") for k, n in zip(text_key(F.coalesce("text", F.lit(""))), ("h1", "h2"))]
    return docs.select("*", *key).join(found, ["_h1", "_h2"], "left")


def _with_spans(docs: DataFrame, least: int) -> DataFrame:
    """``docs`` with the flat array _spans of their repeated strings."""
    spans = repeated_spans(docs, least)
    ready = spans.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), _flat(F.col("copies"), F.col("spans")).alias("_spans"))
    return _keyed(docs, ready.where("_spans is not null")).drop("_h1", "_h2")


def _with_nested_spans(docs: DataFrame, least: int, lower: int) -> DataFrame:
    """``docs`` (doc_id, text) with the flat arrays _low, of strings of ``lower`` bytes that repeat, and _spans, of
    ``least`` bytes, which is more.

    A string of ``least`` bytes that repeats lies within a run of shorter ones, here and there. So only the runs of
    ``least`` bytes or more are searched for it, as texts of their own.
    """
    stored = Stored(docs.sparkSession)
    low = stored(
        repeated_spans(docs, lower).select("h1", "h2", _flat(F.col("copies"), F.col("spans")).alias("_low")).where("_low is not null")
    )

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for i, (raw, flat) in enumerate(zip(raw_texts(batch.column(3)), batch.column(4).to_pylist())):
            for a, b in _spans_of(raw, flat):
                if b - a >= least:
                    for column, value in zip(out, (i, a, raw[a:b])):
                        column.append(value)
        at = pa.array(out[0], pa.int64())
        return pa.record_batch(
            [*(batch.column(k).take(at) for k in range(3)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
            ["_h1", "_h2", "doc_id", "lo", "text"],
        )

    ready = low.withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    long = _keyed(docs.where(F.octet_length("text") >= least), ready).where("_low is not null").select("_h1", "_h2", "doc_id", "text", "_low")
    pieces = stored(per_batch(long, runs, "_h1 long, _h2 long, doc_id long, lo long, text binary"))
    exact = repeated_spans(pieces, least)
    named = pieces.select("_h1", "_h2", "lo", F.octet_length("text").alias("size"), *text_key(F.col("text"))).dropDuplicates(["_h1", "_h2", "lo"])
    moved = F.when(F.col("copies") > 1, F.array(F.col("lo"), F.col("lo") + F.col("size"))).otherwise(
        F.transform(F.flatten(F.transform("spans", lambda s: F.array(s["lo"], s["hi"]))), lambda x: x + F.col("lo"))
    )
    found = stored(
        named.join(exact, ["h1", "h2"]).select("_h1", "_h2", moved.alias("moved")).where("moved is not null")
        .groupBy("_h1", "_h2").agg(F.flatten(F.sort_array(F.collect_list("moved"))).alias("_spans"))
    )
    stored.drop(pieces)
    return _keyed(docs, ready.join(found, ["_h1", "_h2"], "left")).drop("_h1", "_h2")


def _long_runs(raw: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Those with more than ``words`` words."""
    return [(a, b) for a, b in spans if len(raw[a:b].split()) > words]


def digest(docs: DataFrame, least: int = 400, passage: int = 200, words: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes) for every row of ``docs``.

    Removed is each byte inside a string of ``least`` bytes that begins anywhere else too, in the same text or
    another; texts do not join. Passages are runs of strings of ``passage`` bytes, at most ``least``, that begin
    elsewhere too, of more than ``words`` words; they are counted, and removed only as far as the above says. Null
    and empty texts have no bytes; rows with equal texts count as two occurrences; null or repeated ids are no
    matter. Other columns are not read; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, count, kept, passages, inside = [], [], [], [], [], []
        for raw, flat, low in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            spans = _spans_of(raw, flat)
            long = _long_runs(raw, _spans_of(raw, low), words)
            sizes.append(len(raw))
            removed.append(sum(b - a for a, b in spans))
            count.append(len(spans))
            kept.append(hashlib.sha256(_cut(raw, spans) if spans else raw).hexdigest())
            passages.append(len(long))
            inside.append(sum(b - a for a, b in long))
        numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, count, passages, inside)]
        return pa.record_batch(
            [batch.column(0), *numbers[:3], pa.array(kept), *numbers[3:]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"],
        )

    joined = _with_nested_spans(docs.select(F.col("doc_id").cast("long"), "text"), least, passage)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long"
    return per_batch(joined.select("doc_id", "text", "_spans", "_low"), run, schema)


def _inside(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, least: int, words: int = 0) -> DataFrame:
    """``docs`` with all its columns; runs of repeated strings of more than ``words`` words are cut out of text, at
    whole characters. A null text stays."""
    names = docs.columns
    place = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(place)
        texts = []
        for raw, null, flat in zip(raw_texts(column), pc.is_null(column).to_pylist(), batch.column(len(names)).to_pylist()):
            spans = _inside(raw, _long_runs(raw, _spans_of(raw, flat), words))
            texts.append(None if null else (_cut(raw, spans) if spans else raw).decode())
        columns = list(batch.columns[:-1])
        columns[place] = pa.array(texts, column.type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return per_batch(_with_spans(docs, least).select(*names, "_spans"), run, docs.schema)
