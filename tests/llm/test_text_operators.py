"""Operators on texts against brute force, on texts with every odd case."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tidelog.llm import bpe, chat, decontam, pst_lm, queries, rules, sharding, simhash, suffix_dedup
from tokenizers import Tokenizer

from .conftest import rows

SPACE = re.compile(rb"[^\x20\x09-\x0d]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


# -- chat


def test_chat_reads_back_all_turns(spark):
    given = [
        (1, 2, "assistant", "b <|im_end|>\n<|im_start|>user\nx"), (1, 1, "user", "a\\<|\\|"), (1, 3, "assistant", None),
        (1, None, "system", ""), (2, 1, None, "x"), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"),
        (None, 1, "user", "é🙂"), (3, 1, "ro\nle<|im_sep|>\\", "\n"), (3, 2, "assistant", "<|im_sep|>" * 3),
    ]
    df = spark.createDataFrame([(*r, 9) for r in given], "conv_id long, turn long, role string, text string, turns int").repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, 3, None):
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in given if x[0] == conv), key=key)]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == want
        assert got[conv]["loss_text"] == "".join(t for r, t in want if r == "assistant")
    # two roles in a row share a block
    assert got[1]["formatted"].count("<|im_start|>") == 3
    assert chat.format_chats(df.where("false")).count() == 0


# -- rules


def brute_rules(text):
    words = [w.decode() for w in SPACE.findall((text or "").encode())]
    lines = [x for x in (text or "").split("\n") if SPACE.search(x.encode())]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    places = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places), failed)


def test_rules(docs, listed, empty):
    got = rules.apply_rules(docs)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(got, *columns) == sorted(((i, *brute_rules(t)) for i, t in listed), key=repr)
    # order changes no verdict, and a filter above is not pushed into the work
    other = rules.apply_rules(docs, list(reversed(rules.default_rules())), order=False)
    assert rows(got, "doc_id", "kept") == rows(other, "doc_id", "kept")
    assert got.where("kept").count() == sum(r[1] for r in rows(got, "doc_id", "kept"))
    assert all(not k for f, k in rows(got, "base_failed", "kept") if f)
    assert rules.apply_rules(empty).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- sharding


def test_sharding_fills_evenly_and_moves_little(docs, empty):
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill(names, 1009)
    assert set(table) == set(range(10)) and max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill(names[:9], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.25 * 1009
    # every slot belongs to the first shard, in turns, whose order reaches it
    placed = sharding.place(docs, "doc_id", names, 1009)
    assert placed.count() == docs.count() and set(placed.columns) == set(docs.columns)
    for i, slot, shard in rows(placed, "doc_id", "slot", "shard"):
        assert slot == int(hashlib.md5(str(i if i is not None else "").encode()).hexdigest()[:8], 16) % 1009 and shard == names[table[slot]]
    assert sharding.place(empty, "doc_id", names, 1009).count() == 0
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_written_shards(docs, tmp_path, spark):
    names = ["a", "b", "c"]
    sharding.write_shards(sharding.place(docs, "doc_id", names, 101).select("doc_id", "shard"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# -- SimHash


def brute_print(text, size=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, near):
    root = {i: i for i in ids}
    while True:
        before = dict(root)
        for a in ids:
            for b in ids:
                if near(a, b):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


@pytest.mark.parametrize("tile", [512, 2])
def test_simhash(docs, listed, empty, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)  # small: blocks are cut into tiles
    got = rows(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")
    prints = [(i, brute_print(t)) for i, t in listed]
    distinct = sorted({p for _, p in prints})
    first = {p: min((i for i, q in prints if q == p and i is not None), default=None) for p in distinct}
    named = [p for p in distinct if first[p] is not None]
    root = brute_components([first[p] for p in named], lambda a, b: (dict((first[p], p) for p in named)[a] ^ dict((first[p], p) for p in named)[b]).bit_count() <= 3)
    want = sorted(((i, p.to_bytes(8, "big"), root.get(first[p])) for i, p in prints), key=repr)
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_classes_without_an_id_link(spark, monkeypatch):
    """Two texts over 3 bits apart are joined through one between them that has no id."""
    given = [(5, 0), (None, 0b111), (9, 0b111111), (None, 1 << 63 | 0xFFFF), (None, 1 << 63 | 0xFFFE)]
    prints = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in given], "doc_id long, fp binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: prints)
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(prints).collect()]
    assert sorted(got, key=repr) == sorted([(5, 5), (None, 5), (9, 5), (None, None), (None, None)], key=repr)


def test_large_clusters_keep_their_links(spark):
    """Chains of fingerprints three bits apart, whose ends are far apart, in one block of many members."""
    rng = np.random.default_rng(1)
    prints, p = [], 0
    for _ in range(900):
        prints.append(p)
        for b in rng.choice(24, rng.choice([1, 2, 3]), replace=False):
            p ^= 1 << int(b)
    far = [int(x) << 40 | 0xABC for x in rng.integers(1, 1 << 23, 50)]
    distinct = sorted(set(prints + far))
    df = spark.createDataFrame([(bytearray(p.to_bytes(8, "big")), i) for i, p in enumerate(distinct)], "fp binary, node long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, simhash._exact_blocks(df, 3), 3)).collect()}
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(distinct, np.uint64)
    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    assert all(roots.get(i, i) == find(i) for i in range(len(distinct)))


def test_pigeonhole_masks_miss_nothing():
    rng = np.random.default_rng(2)
    assert [simhash.free_blocks(n) for n in (0, 1 << 24, 1 << 25, 1 << 31)] == [2, 2, 3, 4]
    for free in (2, 3, 4):
        masks = simhash.pigeonhole_masks(3, free)
        assert min(m.bit_count() for m in masks) >= (24, 30, 36)[free - 2]
        for _ in range(2000):
            flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(not flips & m for m in masks)


# -- suffix arrays


def brute_repeats(texts, least):
    n = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - least + 1):
            if n[t[i : i + least]] > 1:
                gone[i] += 1
                gone[i + least] -= 1
        out.append(np.cumsum(gone)[:-1] > 0 if t else np.zeros(0, bool))
    return out


def flagged_runs(flags):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


@pytest.mark.parametrize("hot,block", [(1000, 1 << 20), (1, 700)])
def test_suffix_dedup(docs, listed, empty, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 1: anchors are cut over shards, which then merge
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)  # small: long texts are taken in parts
    raw = [(t or "").encode() for _, t in listed]
    want = []
    for (i, _), b, gone, low in zip(listed, raw, brute_repeats(raw, 400), brute_repeats(raw, 200)):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        long = [b[x:y] for x, y in flagged_runs(low) if len(b[x:y].split()) > 50]
        want.append((i, len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone])), len(long), sum(map(len, long))))
    got = rows(suffix_dedup.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")
    assert got == sorted(want, key=repr)
    assert any(0 < w[2] < w[1] for w in want) and any(w[5] and not w[2] for w in want)
    if hot > 1:
        assert suffix_dedup.digest(empty).count() == 0


def test_texts_without_repeats_keep_columns_and_characters(docs):
    out = suffix_dedup.without_repeats(docs, 256)
    assert out.columns == docs.columns and out.count() == docs.count()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        assert (r["text"] is None) == (before[r["doc_id"]] is None)
        assert r["text"] is None or len(r["text"]) <= len(before[r["doc_id"]])


def test_suffix_array_and_prefixes():
    import os.path

    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 5, 50, 400]:
        s = rng.integers(0, 3, n).astype(np.uint16)
        b = bytes(s.tolist())
        sa = suffix_dedup.suffix_array(s)
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
        want = [len(os.path.commonprefix([b[x:], b[y:]])) for x, y in zip(sa, sa[1:])]
        assert suffix_dedup.common_prefixes(s, sa).tolist() == want


def test_a_shard_sorts_only_what_others_may_share(monkeypatch):
    rng = np.random.default_rng(8)
    some = lambda n: rng.choice([0, 1, 32, 255], n).astype(np.uint8).tobytes()
    runs = [some(n) for n in (70, 150, 199, 200, 260, 700)]
    texts = [b"".join(some(int(rng.integers(20, 300))) + runs[k][int(rng.integers(0, 9)) :] for k in rng.permutation(6)) for _ in range(12)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    of, at, begins, anchor = suffix_dedup.regions(np.frombuffer(b"".join(texts), np.uint8), bounds, 200)
    by_anchor, first = {}, {}
    for t, lo, n, a in zip(of.tolist(), (at - bounds[of]).tolist(), begins.tolist(), anchor.view(np.int64).tolist()):
        by_anchor.setdefault(a, {}).setdefault(texts[t][lo : lo + n + 199], []).append((t, lo, n))
    shard, gone = [], [np.zeros(len(t), bool) for t in texts]
    for a, found in by_anchor.items():
        for piece, where in found.items():
            for t, lo, _ in where if len(where) > 1 else []:  # a region that occurs again
                gone[t][lo : lo + len(piece)] = True
            if len(found) > 1:
                t, lo, n = where[0]
                shard.append({"h1": t, "h2": 0, "first": lo, "begins": n, "occurs": len(where), "cut": False, "anchor": a, "piece": piece})
    sorted_bytes = []
    known = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda s: sorted_bytes.append(len(s)) or known(s))
    for r in suffix_dedup._in_shard(200, 1)(pa.Table.from_pylist(shard)).to_pylist():
        gone[r["h1"]][r["lo"] : r["hi"]] = True
    assert all((a == b).all() for a, b in zip(gone, brute_repeats(texts, 200)))
    assert any(g.any() and not g.all() for g in gone)
    assert 0 < sum(sorted_bytes) < sum(len(r["piece"]) for r in shard) / 2


# -- benchmark


def test_leaks(spark, docs, empty, listed):
    items = [(1, "What is the river of the north that runs east? The long Erthing river."), (2, "one two"), (3, None), (4, "?!"), (1, "Another question about a stone, asked twice for good measure. It was a blue stone with a hole in it.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = listed[20][1]
    given = [
        (100, text + " " + items[0][1].upper().replace(" ", "\n") + " " + text),
        (101, "What is the river of the north that runs east?" + " pad" * 60),  # no answer
        (102, items[4][1]), (102, items[4][1]), (103, None), (104, ""), (None, "ein " * 300 + items[4][1] + " zwei" * 3000),
        (105, "the of is that north east river runs what long erthing " * 5),  # the words, not the question
    ]
    leaky = spark.createDataFrame(given, "doc_id long, text string").repartition(2)
    assert rows(decontam.find_leaks(leaky, bench), "doc_id", "item_id") == sorted([(100, 1), (102, 1), (102, 1), (None, 1)], key=repr)
    found = rows(decontam.find_leaks(docs, bench), "doc_id", "item_id")
    assert all(i in {d for d, t in listed if t and "one two" in t} and k == 2 for i, k in found)
    assert decontam.find_leaks(empty, bench).count() == 0
    assert decontam.find_leaks(docs, bench.where("false")).count() == 0


def search(index, own, least):
    """All blocks that may hold an item, each by its cursors."""
    blocks = decontam.live_blocks(index, np.zeros(len(own), np.int64), own, least)
    return [x for _, entries in blocks for x in decontam.wand(index, entries, least)]


@pytest.mark.parametrize("group", [1, 2, 8, 100])
def test_wand_finds_all_that_brute_force_bm25_does(monkeypatch, group):
    import random
    from math import log

    from .conftest import prose

    monkeypatch.setattr(decontam, "GROUP", group)
    monkeypatch.setattr(decontam, "BOUNDS", 50)
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(8, 40))) for i in range(60)]
    split = {i: decontam.words_of(t) for i, t in items}
    df = Counter(w for own in split.values() for w in set(own))
    index = decontam.build(items, df, 60, 24.0)

    def weights(own):
        n, long = Counter(own), 1.2 * (0.25 + 0.75 * len(own) / 24.0)
        w = {x: log(1 + (60 - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + long) for x, c in n.items()}
        return {x: v / sum(w.values()) for x, v in w.items()}

    weight = {i: weights(own) for i, own in split.items()}
    texts = [prose(rng, 100) + " " + " ".join(t.split()[: rng.randint(5, 40)]) + " " + prose(rng, 70) for _, t in items]
    hits = 0
    for least in (0.6, 0.3, 0.05):
        for text in texts:
            own = {w for w in decontam.words_of(text) if w in index.terms}
            got = {index.ids[k]: v for k, v in search(index, np.array(sorted(index.terms[w] for w in own), np.int64), least)}
            for i in weight:
                v = sum(x for w, x in weight[i].items() if w in own)
                hits += v >= least
                if v >= least + 1e-6:
                    assert got[i] == pytest.approx(v)
                elif v < least - 1e-6:
                    assert i not in got
    assert hits > 500
    for text in texts:  # and the passages that no pivot can be in are those without any item
        codes = np.array([index.terms.get(w, -1) for w in decontam.words_of(text)] + [-1])
        starts = np.arange(0, len(codes) - 1, index.longest)
        ends = np.minimum(starts + index.longest, len(codes) - 1)
        got = {(s, k) for s, _, k, _ in decontam.retrieve(index, codes, starts, ends)}
        for s in starts.tolist():
            own = np.array(sorted({c for c in codes[s : s + 2 * index.longest].tolist() if c >= 0}), np.int64)
            assert {k for x, k in got if x == s} == {k for k, _ in search(index, own, decontam.RETRIEVE)}


def test_altered_items_are_found_and_others_are_not(spark):
    """Recall on items with a share of their words changed, inside other text."""
    import random

    from .conftest import prose

    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(20, 60)) + ". " + prose(rng, rng.randint(4, 8)) + ".") for i in range(80)]
    bench = spark.createDataFrame([*items, (None, items[0][1]), (-1, items[1][1])], "item_id long, text string")
    for share, least in ((0.0, 1.0), (0.05, 0.95), (0.1, 0.8), (0.2, 0.3)):
        given = []
        for i, t in items:
            words = t.split()
            for k in rng.sample(range(len(words)), round(share * len(words))):
                words[k] = "changed" + str(rng.randrange(10**6)) + ("." if words[k].endswith(".") else "")
            given.append((i, prose(rng, 200) + " " + " ".join(words) + " " + prose(rng, 150)))
        given.append((999, prose(rng, 3000)))
        found = decontam.find_leaks(spark.createDataFrame(given, "doc_id long, text string"), bench).collect()
        pairs = {(r["doc_id"], r["item_id"]) for r in found}
        assert {(i, k) for i, k in pairs if i != k} <= {(0, None), (1, -1)}
        assert sum((i, i) in pairs for i, _ in items) / len(items) >= least, share
        if not share:
            assert {(0, None), (1, -1)} <= pairs


# -- BPE


def test_bpe_equals_the_library(docs, listed, empty):
    library = Tokenizer.from_file(queries.TOKENIZER)
    want = []
    for i, t in listed:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert rows(bpe.encode_decode(docs, queries.TOKENIZER), "doc_id", "ids", "decoded") == sorted(want, key=repr)
    assert bpe.encode_decode(empty, queries.TOKENIZER).count() == 0


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    spec = json.loads(open(queries.TOKENIZER, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "x.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match=next(iter(change))):
            bpe.Vocabulary(str(tmp_path / "x.json"))


def test_transducer_and_long_words(tmp_path):
    import random

    rng = random.Random(4)
    vocabulary = bpe.Vocabulary(queries.TOKENIZER)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(500)}
    (tmp_path / "x").write_bytes(bpe.compile_lexicon({w: vocabulary.merge(w) for w in words}))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    asked = [*words, b"", b"abcabcabc", b"d", b"aad"]
    assert lexicon.get(asked) == [np.array(vocabulary.merge(w), "<u4").tobytes() if w in words else None for w in asked]
    (tmp_path / "none").write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(tmp_path / "none")).get([b"a", b""]) == [None, None]
    library = Tokenizer.from_file(queries.TOKENIZER)
    known = bpe.Known(vocabulary, lexicon)
    for t in ["a" * 3000, "thethe" * 500, " " * 999, "é" * 200, "".join(rng.choice("abcdefgh") for _ in range(2000))]:
        assert known.encode([t])[0] == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    alphabet = ["a", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "你", "🙂", "1", "²", "'s", "!", "<|endoftext|>", "<|", "\x00", "T", "ing"]
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert known.encode([t])[0] == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


# -- LM


def brute_tree(texts):
    """(counts by context, kept contexts) straight from the definition."""
    counts = {}
    for t in texts:
        x = pst_lm.normalised(t)
        for i in range(pst_lm.DEPTH, len(x)):
            for d in range(pst_lm.DEPTH + 1):
                own = counts.setdefault(x[i - d : i], {})
                own[x[i]] = own.get(x[i], 0) + 1
    kept = {c for c in counts if len(c) <= pst_lm.TOP}
    for c, own in counts.items():
        if len(c) > pst_lm.TOP:
            up, total = counts[c[1:]], sum(own.values())
            smooth = sum(up.values()) + len(up)
            if sum(n * np.log(n / total / (up[s] / smooth)) for s, n in own.items()) >= pst_lm.GAIN:
                kept |= {c[k:] for k in range(len(c))}
    return counts, kept


def brute_log10(counts, kept, text):
    x, total = pst_lm.normalised(text), 0.0
    for i in range(pst_lm.DEPTH, len(x)):
        p = 1 / 256
        for d in range(pst_lm.DEPTH + 1):
            own = counts.get(x[i - d : i], {})
            if x[i - d : i] not in kept:
                break
            weight = pst_lm.SUFFIX * len(own)
            p = (own.get(x[i], 0) + weight * p) / (sum(own.values()) + weight)
        total += np.log10(p)
    return total


def test_keys_hold_each_symbol_and_what_is_before_it():
    texts = [b"", b" A\xc3\xa9 b\x00 ", b"\xff" * 20, b"", b"x"]
    keys, begin = pst_lm.keys_of(texts)
    want = []
    for t in texts:
        x = pst_lm.normalised(t)
        want.append([int.from_bytes(x[i - pst_lm.DEPTH : i][::-1] + x[i : i + 1], "big") for i in range(pst_lm.DEPTH, len(x))])
    assert [keys[a:b].tolist() for a, b in zip(begin, begin[1:])] == want and begin[-1] == len(keys)
    assert [len(x) for x in pst_lm.keys_of([])] == [0, 1]


def test_a_context_is_searched_once_for_all_its_symbols(monkeypatch):
    pairs = np.sort(np.concatenate([c << 8 | np.arange(200) for c in (3, 5, 9)]).astype(np.uint64))
    level = pst_lm.Level.of(pairs, np.arange(1, 601))
    asked = np.concatenate([pairs, np.uint64(7) << np.uint64(8) | np.arange(200, dtype=np.uint64)])
    known, searched = pst_lm._at, []
    monkeypatch.setattr(pst_lm, "_at", lambda values, x: searched.append(len(x)) or known(values, x))
    p, inside = level.mixed(asked, np.full(800, 0.25))
    assert sum(searched) == 800 + 4
    assert inside.tolist() == [True] * 600 + [False] * 200 and (p[600:] == 0.25).all()
    weight = pst_lm.SUFFIX * 200
    assert np.allclose(p[:200], (np.arange(1, 201) + weight * 0.25) / (200 * 201 / 2 + weight))


def test_packed_keys():
    rng = np.random.default_rng(8)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (pst_lm.unpack(pst_lm.pack(keys)) == keys).all()


@pytest.mark.parametrize("small", [False, True])
def test_lm(spark, docs, listed, empty, monkeypatch, small):
    import zlib

    if small:  # many parts and blocks, counts handed on early: the scores are the same
        for name, value in (("PART_TEXT", 1 << 12), ("WORD_TEXT", 1 << 13), ("BLOCK_TEXT", 1 << 13), ("SLICE", 1 << 11), ("KEYS", 500)):
            monkeypatch.setattr(pst_lm, name, value)
    train = [(t or "").encode() for i, t in listed if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in t.lower().split())
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    got = pst_lm.held_out(docs).collect()
    text = {}
    for i, t in listed:
        text.setdefault(i, t)
    assert len(got) == len(listed)
    tree = brute_tree(train)
    assert {len(c) for c in tree[1]} == set(range(pst_lm.DEPTH + 1)) and len(tree[1]) < len(tree[0])
    known = {}
    for r in got:
        w = (text[r["doc_id"]] or "").encode().lower().split()
        base = sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + np.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(x in counts for x in w) + 1, n)
        assert r["base_score"] == pytest.approx(base)
        if r["doc_id"] is not None:
            known[r["doc_id"]] = r["score"]
    for i in list(known)[:: 1 if not small else 3]:
        assert known[i] == pytest.approx(brute_log10(*tree, (text[i] or "").encode()), rel=1e-5)
    if small:
        assert pst_lm.held_out(empty).count() == 0
        alone = pst_lm.score(docs.limit(3), empty).collect()
        assert len(alone) == 3 and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in alone)
