"""The pipeline's stages, each on its own input, and the queries with SQL."""

import glob
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from tidelog.llm import queries, simhash, suffix_dedup

from .conftest import rows
from .test_text_operators import flagged_runs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    assert rows(df, *order) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k < 4:
            assert out.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert set(after) <= set(before) and after
        if name == "SimHash near-dedup":
            ids = sorted(before)
            for i in ids:
                like = [(j, jaccard(before[i], before[j])) for j in ids if j != i]
                if i not in after:  # dropped for a like one
                    assert max(s for _, s in like) > 0.65
                else:
                    assert not [j for j, s in like if s >= 0.8 and j in after]
        if name == "suffix-array dedup":
            texts = [(before[i] or "").encode() for i in sorted(before)]
            # strings that overlap their own copy, as in "word word word", begin twice too
            strings = [[t[a : a + cp.PASSAGE_BYTES] for a in range(len(t) - cp.PASSAGE_BYTES + 1)] for t in texts]
            begins = Counter(x for own in strings for x in own)
            for i, t, own in zip(sorted(before), texts, strings):
                gone = np.zeros(len(t), bool)
                for a, x in enumerate(own):
                    gone[a : a + cp.PASSAGE_BYTES] |= begins[x] > 1
                long = [t[a:b] for a, b in flagged_runs(gone) if len(t[a:b].split()) > cp.PASSAGE_WORDS]
                assert (after[i] != before[i]) == bool(long)
        docs = out
    assert rows(docs, "doc_id")


def test_stages_take_odd_and_empty_tables(spark, docs, empty, tmp_path):
    for f in glob.glob(f"{SF}/*.parquet"):
        os.symlink(f, tmp_path / os.path.basename(f))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in cp.STAGES:
        assert stage(spark, docs.select(*columns), SF).count() >= 0
        assert stage(spark, empty.select(*columns), SF).count() == 0


def test_fingerprints_of_similar_sets_are_near():
    """No pair at the similarity of the pipeline is farther than its distance, whatever the sets' sizes."""
    rng = np.random.default_rng(1)
    most = 0
    for size in [5, 9, 10, 18, 45, 90, 400] * 120:
        apart = size // 5  # the smaller set is within the larger one
        whole = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size, dtype=np.uint64)
        other = whole[apart:]
        if rng.random() < 0.5:  # or both have as many of their own
            own = size // 10
            other = np.concatenate([whole[own + own // 9 :], rng.integers(0, 1 << 63, own, dtype=np.uint64)]) if own else other
        common = len(np.intersect1d(whole, other))
        assert common >= cp.SIMILARITY * (len(whole) + len(other) - common) - 1e-9
        a, b = (np.frombuffer(simhash.fingerprint(x, cp.BITS), np.uint8) for x in (whole, other))
        most = max(most, int(np.bitwise_count(a ^ b).sum()))
    assert 40 < most <= cp.DISTANCE
    assert suffix_dedup.ANCHOR < cp.PASSAGE_BYTES


def test_near_copies_are_those_at_the_similarity(spark, monkeypatch):
    """Every pair at 0.8 or more is linked and no pair below, for short and long texts; in tiles too."""
    rng = random.Random(4)
    texts = []
    for k in range(60):
        n = rng.choice([8, 12, 24, 104, 404])
        base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        other = list(base)
        gone = rng.choice([(n - 4) // 9, (n - 4) // 9, max(1, (n - 4) // 5), (n - 4) // 8])  # shingles changed of n - 4, about 0.8
        other[n - gone :] = [f"x{rng.randrange(10**9)}" for _ in range(gone)]
        texts += [" ".join(base), " ".join(other)]
    texts += ["a b c d e f g h", "a b c d e f g h i", "b c d e f g h i", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    like = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i] or "", texts[j] or "") >= 0.8]
    assert 10 < len(like) < 60
    roots = {i: i for i in range(len(texts))}
    for i, j in like:
        a, b = sorted((roots[i], roots[j]))
        roots = {k: a if v == b else v for k, v in roots.items()}
    for part, tile in ((2048, 512), (1, 2)):
        monkeypatch.setattr(simhash, "PART", part)
        monkeypatch.setattr(simhash, "TILE", tile)
        found = simhash.similar_texts(df, cp.SHINGLE, cp.SIMILARITY, cp.BITS, cp.DISTANCE).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == roots


def test_rows_go_by_their_text(spark):
    """A leaked or repeated text goes without an id too; another text with its id stays."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    clean = "nothing of it is in this text of a few words"
    listed = [(None, item), (1, item), (1, clean), (None, clean), (2, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in listed], columns)
    assert rows(cp.decontaminate(spark, df, SF), "doc_id", "text") == sorted([(1, clean), (None, clean), (2, None)], key=repr)
    base = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(1, base), (2, base), (2, clean)]], columns)
    assert rows(cp.near_duplicates(spark, df, SF), "doc_id", "text") == sorted([(1, base), (2, clean)], key=repr)
    rest = [(None, "x", 1), ("x", None, 1), ("x", "y", 1), ("x", "y", 1)]  # rows differ in where the null is
    df = spark.createDataFrame([(1, base, *r) for r in rest], columns)
    assert rows(cp.near_duplicates(spark, df, SF), "lang", "source") == sorted({r[:2] for r in rest}, key=repr)
