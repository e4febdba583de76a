"""SimHash fingerprints, links by pigeonhole blocks, and their connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, bounded_batches, checkpointed, dealt, frugal, pack, per_batch, planes, raw_texts, text_bytes, unpack, unplaned
from .words import mixed, word_codes

#: Members of one block compared in one task; larger blocks are cut into tiles of two such parts.
TILE = 512
#: Texts sampled to tell common shingles, about, and shingles listed; both change costs, never results.
SAMPLE, COMMON = 20_000, 1 << 16
#: Texts, and bytes of their shingle sets, in one part of a cluster of candidates.
PART, PART_BYTES = 2048, 2 << 20
#: Shingles that a worker holds before it hands them on; bytes of text for each part of them, and most parts.
PAIRS, PART_TEXT, PARTS = 1 << 20, 16 << 20, 1 << 16
#: Odd multipliers that stretch one 64-bit hash to several words of a long fingerprint.
STRETCH = (np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, repeats included, as unsigned 64-bit numbers.

    A text of fewer words is one shingle, a text of none has no shingle.
    """
    words = text.lower().split()  # bytes: A-Z only, and splits at x20 and x09-x0D only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return np.frombuffer(digest(b" ".join(words), 42), ">u8").astype(np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.frombuffer(b"".join([digest(x, 42) for x in runs]), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """A bit is 1 if it is set in over half of the hashes. Big-endian; no hashes give zero.

    Words after the first come from the hash times an odd constant, mixed down.
    """
    out = []
    for word in range(bits // 64):
        h = hashes
        if word:
            h = h * STRETCH[word]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
        ones = np.zeros(64, np.int64)
        for start in range(0, len(h), 1 << 16):
            part = np.ascontiguousarray(h[start : start + (1 << 16)].astype(">u8")).view(np.uint8)
            ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
        out.append(np.packbits(2 * ones > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, fp binary) for every row of ``docs``; null and empty texts have a fingerprint of zeros."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(shingle_hashes(t, shingle), bits) for t in raw_texts(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "fp"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp binary")


def pigeonhole_masks(distance: int, free: int = 2) -> list[int]:
    """Masks over 64 bits: two fingerprints at ``distance`` or less agree under at least one.

    The 64 bits are cut into ``distance + free`` blocks; ``distance`` errors leave ``free`` of them whole,
    so every choice of ``free`` blocks is one mask.
    """
    n = distance + free
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(blocks, free)]


def free_blocks(n: int) -> int:
    """Blocks that agree under a mask: more, and so longer masks, for more fingerprints, so that a mask tells apart at
    least as many as there are."""
    return next((free for free, most in ((2, 1 << 24), (3, 1 << 30)) if n <= most), 4)


def _exact_blocks(classes: DataFrame, distance: int, free: int = 2) -> DataFrame:
    """(node, block): one row for every pigeonhole mask, natively."""
    value = F.conv(F.hex("fp"), 16, -10).cast("long")
    keys = F.array(*(
        F.xxhash64(F.lit(i), F.col("value").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))))
        for i, m in enumerate(pigeonhole_masks(distance, free))
    ))
    return classes.withColumn("value", value).select("node", F.explode(keys).alias("block"))


def _tile_links(distance: int):
    """Compare the members of each tile; give a spanning forest of what links, not every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            fps_all = batch.column(1)
            for row in range(batch.num_rows):
                nodes = batch.column(0)[row].values.to_numpy()
                fps = np.frombuffer(b"".join(fps_all[row].values.to_pylist()), ">u8").reshape(len(nodes), -1)
                order = np.argsort(nodes)
                nodes, fps = nodes[order], np.ascontiguousarray(fps[order].astype(np.uint64))
                n = len(nodes)
                gap = np.zeros((n, n), np.int32)
                for w in range(fps.shape[1]):
                    gap += np.bitwise_count(fps[:, w, None] ^ fps[None, :, w])
                near = gap <= distance
                label = np.arange(n)
                while True:
                    new = np.where(near, label[None, :], n).min(1)
                    if (new == label).all():
                        break
                    label = new
                moved = np.flatnonzero(label != np.arange(n))
                left.append(nodes[moved])
                right.append(nodes[label[moved]])
            if left:
                yield pa.record_batch(
                    [pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())],
                    ["u", "v"],
                )

    return run


def tiles(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, block, a, b) for ``blocks`` of (node, block): each block of ``sizes`` (block, parts) is cut into
    parts by a hash, and a member goes to the tile of its part with every part of the block."""
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    return (
        blocks.join(sizes, "block")
        .withColumn("own", own)
        .select("node", "block", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("node", "block", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    )


def links(classes: DataFrame, blocks: DataFrame, distance: int) -> DataFrame:
    """(u, v), u > v: edges whose components are those of all pairs at ``distance`` or less in a block.

    Blocks with one member go first. A block of more than TILE members is cut into parts by a hash, and
    each pair of parts is a tile of its own, so that no task holds a whole block; a tile returns fewer
    edges than it has members, so rows do not grow with the square of a block.
    """
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("block", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    grouped = (
        tiles(blocks, sizes).join(classes.select("node", "fp"), "node")
        .groupBy("block", "a", "b")
        .agg(F.collect_list(F.struct("node", "fp")).alias("m"))
        .where(F.size("m") > 1)
        .select(F.col("m.node").alias("nodes"), F.col("m.fp").alias("fps"))
    )
    return grouped.mapInArrow(frugal(_tile_links(distance)), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over (u, v), for every node of an edge but the roots.

    Alternating large-star and small-star rounds: each replaces edges by edges to the smallest
    neighbour, until none changes. All is joins and aggregates on the executors; a round ends in a
    reliable checkpoint.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def star(near: DataFrame, keep: str) -> DataFrame:
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        return near.join(least, "u").withColumn("m", F.least("m", "u")).where(keep)

    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, "v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = star(large, "v <= u").select("u", "v", "m")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        new = checkpointed(small)
        changed = new.exceptAll(edges).limit(1).count() or edges.exceptAll(new).limit(1).count()
        edges = new
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Equal fingerprints form one class, named by the fingerprint. Classes at ``distance`` bits or less of 64 link
    exactly (pigeonhole masks). component_id is the smallest doc_id reachable over links.

    Null and empty texts have a fingerprint of zeros and link like any other. Rows with a null doc_id
    take part, and classes without an id link others; only a component without any id is null.
    Repeated rows stay, one result each. Other columns of ``docs`` are not read. An empty table gives
    an empty result.
    """
    fps = checkpointed(fingerprints(docs, shingle))
    name = F.conv(F.hex("fp"), 16, -10).cast("long")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", name)
    blocks = _exact_blocks(classes, distance, free_blocks(fps.select("fp").distinct().count()))
    roots = components(links(classes, blocks, distance))
    rooted = classes.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(named, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


#: Odd numbers by which the words of a shingle are told apart by place.
_PLACES = np.random.default_rng(17).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes. Fewer than ``size`` words are one shingle, none
    have none."""
    words, first = word_codes(data, bounds)
    runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        runs += words[k : k + len(runs)] * _PLACES[k]
    runs = mixed(runs)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _name(hashes: np.ndarray) -> int:
    """One 64-bit name for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a set, the rarest first by ``counts``: two sets of that Jaccard similarity or more
    have one in common. They share ``ceil(similarity * n)`` of the larger's n, so leaving out all but one of so
    many cannot leave the two prefixes apart, whatever the counts, if all sets are ordered by the same ones."""
    n = len(hashes)
    return hashes[np.lexsort((hashes, counts))][: n - ceil(similarity * n - 1e-9) + 1] if n else hashes


def _common(docs: DataFrame, shingle: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that occur in several texts of a bounded sample, and in how many."""
    sampled = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0).distinct()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shingle_sets(*text_bytes(batch.column(0)), shingle)
        return pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    counts = per_batch(sampled, run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    got = counts.orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    h, c = got["h"].to_numpy().astype(np.int64).view(np.uint64), got["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


_LISTED = "doc_id long, text_hash long, node long, fp binary, part int, keys binary, nodes binary"


def _listed(docs: DataFrame, shingle: int, similarity: float, bits: int, parts: int, common) -> DataFrame:
    """Two kinds of rows from one pass over (doc_id, text_hash, text): each document's node, which is the name of its
    shingle set, with a fingerprint of the set where a task first meets it; and in packed arrays the shingles of every
    set's prefix with its node, dealt to ``parts`` by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, often = common.value
        names = ["doc_id", "text_hash", "node", "fp", "part", "keys", "nodes"]
        done: set[int] = set()  # copies in one task are given once, as far as it remembers
        keys, nodes, held = [], [], 0

        def packed():
            h, node = np.concatenate(keys), np.concatenate(nodes)
            keys.clear(), nodes.clear()
            order = np.argsort(h)
            h, node = h[order], node[order]
            part = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.uint16)
            rows = [(p, pack(h[at]), planes(node[at])) for p, at in dealt(h, part)]
            none = [None] * len(rows)
            columns = [pa.array(none, pa.int64())] * 3 + [pa.array(none, pa.binary())]
            columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
            return pa.record_batch(columns, names)

        for batch in batches:
            sets = shingle_sets(*text_bytes(batch.column(2)), shingle)
            nodes_here = [_name(s) for s in sets]
            prints: list[bytes | None] = [None] * len(sets)
            for row, (own, node) in enumerate(zip(sets, nodes_here)):
                if node in done:
                    continue
                done.add(node)
                prints[row] = fingerprint(own, bits)
                if not len(own):
                    continue
                counts = np.zeros(len(own), np.int64)
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
                    counts = np.where(listed[at] == own, often[at], 0)
                first = prefix(own, counts, similarity) >> np.uint64(16)  # 48 bits; a clash is one candidate more
                keys.append(first)
                nodes.append(np.full(len(first), node, np.int64))
                held += len(first)
            none = pa.nulls(len(sets), pa.binary())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(nodes_here, pa.int64()), pa.array(prints, pa.binary()), pa.nulls(len(sets), pa.int32()), none, none],
                names,
            )
            if held > PAIRS:
                yield packed()
                held = 0
            if len(done) > PAIRS:
                done.clear()
        if keys:
            yield packed()

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text_hash", "text").mapInArrow(frugal(run), _LISTED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, nodes) from packed rows (part, keys, nodes) sorted by part: every different set of nodes that share a
    shingle. A set of more than TILE nodes is cut into parts, and each two parts are a block of their own."""
    part, keys, nodes = None, [], []

    def found():
        h, node = np.concatenate(keys), np.concatenate(nodes)
        keys.clear(), nodes.clear()
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
        h, node = h[new], node[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        sets = np.unique(np.stack([node[first[size == 2]], node[first[size == 2] + 1]], 1), axis=0)
        out = {s.tobytes() for s in sets} | {node[a : a + n].tobytes() for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist())}
        for raw in list(out):
            if len(raw) > 8 * TILE:
                out.remove(raw)
                cut = np.array_split(np.frombuffer(raw, np.int64), ceil(len(raw) / 8 / TILE))
                out |= {np.concatenate([a, b]).tobytes() for i, a in enumerate(cut) for b in cut[i + 1 :]}
        rows = sorted(out)
        for a in range(0, len(rows), 1000):
            own = rows[a : a + 1000]
            names = [int(np.uint64(xxhash.xxh64_intdigest(x, 9)).view(np.int64)) for x in own]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 8 for x in own])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(own), np.int64)))
            yield pa.record_batch([pa.array(names, pa.int64()), lists], ["block", "nodes"])

    for batch in batches:
        for i in range(batch.num_rows):
            p, k, v = (batch.column(c)[i].as_py() for c in range(3))
            if p != part and keys:
                yield from found()
            part = p
            keys.append(unpack(k))
            nodes.append(unplaned(v, len(keys[-1]), np.int64))
    if keys:
        yield from found()


def similar_forest(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float, distance: int, verify: bool = True):
    """(u, v): a spanning forest of the pairs with fingerprints at ``distance`` or less and, if ``verify``, a Jaccard
    similarity of ``similarity`` or more. Sets are sorted; a pair is left out only where other links join it already."""
    size = np.array([len(s) for s in sets])
    left, right = [], []
    alone = np.arange(len(nodes))
    queue: list[int] = []
    while len(alone):
        if not queue:
            queue, alone = [int(alone[0])], alone[1:]
        i = queue.pop()
        near = np.bitwise_count(fps[alone] ^ fps[i]).sum(1, dtype=np.int32) <= distance
        if verify:
            near &= np.minimum(size[alone], size[i]) >= similarity * np.maximum(size[alone], size[i]) - 1e-9
            near &= size[alone] > 0
        found = alone[near]
        if verify and len(found):
            joined = np.concatenate([sets[j] for j in found])
            at = np.minimum(np.searchsorted(sets[i], joined), size[i] - 1)
            begin = np.cumsum(size[found]) - size[found]
            both = np.add.reduceat((sets[i][at] == joined).astype(np.int64), begin)
            found = found[both >= similarity * (size[found] + size[i] - both) - 1e-9]
        if not len(found):
            continue
        left.append(np.maximum(nodes[found], nodes[i]))
        right.append(np.minimum(nodes[found], nodes[i]))
        alone = np.setdiff1d(alone, found, assume_unique=True)
        queue += found.tolist()
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _forests(similarity: float, distance: int, verify: bool):
    """Edges of each row's nodes, from (nodes, fps) and, to verify, sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in range(batch.num_rows):
                own = [batch.column(k)[row].values for k in range(batch.num_columns)]
                nodes = own[0].to_numpy()
                fps = np.frombuffer(b"".join(own[1].to_pylist()), np.uint64).reshape(len(nodes), -1)
                sets = [np.frombuffer(x, np.uint64) for x in own[2].to_pylist()] if verify else [fps[0]] * len(nodes)
                u, v = similar_forest(nodes, fps, sets, similarity, distance, verify)
                left.append(u), right.append(v)
            yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["u", "v"])

    return run


def similar_texts(docs: DataFrame, shingle: int, similarity: float, bits: int, distance: int) -> DataFrame:
    """(doc_id, text_hash, component_id) for every row of ``docs``: components of all pairs whose shingle sets have
    a Jaccard similarity of ``similarity`` or more.

    Candidates share a shingle of their prefixes, which all such pairs do, and have SimHash fingerprints of distinct
    shingles at ``distance`` or less, which is to be set so wide that no such pair is farther. In each cluster
    of candidates, every pair that links do not join already is verified by its shingle sets. Large blocks
    and clusters are cut into tiles, so no task holds a whole one. Sets and shingles go by 64-bit hashes.

    component_id is the smallest doc_id of the component, null if it has none. text_hash is Spark's xxhash64.
    Texts without words are copies of each other. Repeated rows stay; other columns are not read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    stored = Stored(spark)
    hashed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = min(PARTS, ceil((total["bytes"] or 0) / PART_TEXT) or 1)
    common = spark.sparkContext.broadcast(_common(docs, shingle, total["n"]))  # at most COMMON shingles
    listed = stored(_listed(hashed, shingle, similarity, bits, parts, common))
    rows = stored(listed.where("part is null").select("doc_id", "text_hash", "node", "fp"))
    packed = listed.where("part is not null").select("part", "keys", "nodes").repartition(parts, "part").sortWithinPartitions("part")
    blocks = stored(
        packed.mapInArrow(frugal(_blocks), "block long, nodes array<long>").groupBy("block").agg(F.first("nodes").alias("nodes"))
    )
    del packed
    stored.drop(listed)
    stored.release()
    prints = rows.where("fp is not null").groupBy("node").agg(F.first("fp").alias("fp"))
    grouped = (
        blocks.select("block", F.explode("nodes").alias("node")).join(prints, "node")
        .groupBy("block").agg(F.collect_list(F.struct("node", "fp")).alias("m"))
        .select(F.col("m.node").alias("nodes"), F.col("m.fp").alias("fps"))
    )
    near = components(grouped.mapInArrow(frugal(_forests(0.0, distance, False)), "u long, v long").distinct())
    near = near.union(near.select("root", "root").distinct()).withColumnRenamed("root", "block")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shingle_sets(*text_bytes(batch.column(2)), shingle)
        mine = np.flatnonzero(np.array([_name(s) for s in found], np.int64) == batch.column(0).to_numpy())  # but for texts that share a hash
        own = [found[i] for i in mine]
        at = pa.array(mine)
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array([fingerprint(s, bits) for s in own], pa.binary())]
        return pa.record_batch([*columns, pa.array([s.tobytes() for s in own], pa.binary())], ["node", "block", "fp", "hashes"])

    del grouped
    stored.release()
    # sets are made again for the clusters alone, from one row's text for each node: of its least id, or from any
    one = rows.join(near, "node").groupBy("node", "block").agg(F.min(F.struct("text_hash", "doc_id")).alias("one"))
    one = one.select("node", "block", F.col("one.text_hash").alias("text_hash"), F.col("one.doc_id").alias("one"))
    texts = hashed.join(one, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("one"))).select("node", "block", "text")
    own = stored(per_batch(texts, sets, "node long, block long, fp binary, hashes binary").dropDuplicates(["node"]))
    stored.drop(blocks)
    stored.release()
    sizes = own.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("hashes")).alias("bytes"))
    sizes = sizes.select("block", F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("bytes") / PART_BYTES)).cast("int").alias("parts"))
    clusters = (
        tiles(own.select("node", "block"), sizes).join(own.select("node", "fp", "hashes"), "node")
        .groupBy("block", "a", "b")
        .agg(F.collect_list(F.struct("node", "fp", "hashes")).alias("m"))
        .select(F.col("m.node").alias("nodes"), F.col("m.fp").alias("fps"), F.col("m.hashes").alias("sets"))
    )
    roots = components(clusters.mapInArrow(frugal(_forests(similarity, distance, True)), "u long, v long").distinct())
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = checkpointed(named.join(least, "root").select("doc_id", "text_hash", "component_id"))
    stored.drop(rows, own)
    return out


__all__ = ["fingerprint", "fingerprints", "near_duplicates", "pigeonhole_masks", "shingle_hashes", "shingle_sets", "similar_texts"]
