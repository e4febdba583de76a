"""Learned operators: held-out accuracy on the driver's tables, and odd rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import cnn_quality, common, langid, queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_language_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_language_id(spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert len(got) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(docs, empty):
    model = langid.fit([b"the thing of the east", b"der die das und nicht", b"le la les et pour"], ["en", "de", "fr"])
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect()}
    odd = {r["doc_id"] for r in docs.where("text is null or not text rlike '\\\\p{L}'").collect()}
    assert odd == {i for i, lang in got if lang == "und"}
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"en", "und"}  # one language learned
    assert langid.identify(empty).count() == 0


def test_decoding_equals_one_by_hand():
    """Sequences counted, codewords compared and the nearest chosen in plain loops."""
    rng = np.random.default_rng(5)
    train = [b"the thing of the east and the west", b"der die das und nicht ist", b"le la les et pour dans", b"el los las que por con", b"il lo gli che per con", b"de het een van en niet"]
    model = langid.fit(train, list("abcdef"))
    texts = [*train, b"", b"x", b"Das ist 12 der\tWest", bytes(rng.integers(97, 110, 400).tolist())]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    best, share, unclear = model.decode(model.margins(data, bounds))
    for i, t in enumerate(texts):
        plain = bytes(32 if c in b"\t\n\x0b\x0c\r" else 48 if 48 <= c < 58 else c for c in t.lower())
        total = [0.0] * model.code.shape[1]
        for n in (2, 3):
            for at in range(len(plain) - n + 1):
                code = int.from_bytes(plain[at : at + n], "little") + (n << 24)
                bucket = (code * 2654435761 & 0xFFFFFFFF) >> 18
                total = [x + float(w) for x, w in zip(total, model.weights[bucket])]
        margin = [x / max(len(t), 1) + float(b) for x, b in zip(total, model.bias)]
        loss = [sum(float(w) * max(0, 1 - m * float(c)) ** 2 for m, c, w in zip(margin, word, model.trust)) for word in model.code]
        order = sorted(range(len(loss)), key=lambda k: loss[k])
        assert loss[best[i]] == pytest.approx(loss[order[0]], abs=1e-4)
        assert share[i] == pytest.approx(1 / sum(np.exp(-2 * (x - loss[order[0]])) for x in loss), abs=1e-3)
        if abs(loss[order[1]] - 1.1 * loss[order[0]]) > 1e-3:
            assert unclear[i] == (loss[order[1]] <= 1.1 * loss[order[0]])


def test_samples_are_bounded_whatever_repeats(spark):
    """Equal rows and null ids all share a hash; still no more than the bound comes."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"))
    assert common.sampled_rows(rows, "lang", 100).count() <= 150
    mixed = rows.unionByName(spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("de").alias("lang")))
    got = {r["lang"]: r["count"] for r in common.sampled_rows(mixed, "lang", 100).groupBy("lang").count().collect()}
    assert sum(got.values()) <= 300 and 60 < got["de"] < 140
    assert len(langid.sample(rows)[0]) <= 1.5 * langid.SAMPLE_EACH


def test_code_matrix():
    for n in (2, 3, 4, 5, 9, 20):
        code = langid.code_matrix(n)
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert gap >= (1 if n == 2 else 2)


def test_long_texts_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 110, n).tolist()) for n in (0, 1, 2, 700, 0, 3000, 5)]
    model = langid.fit([b"abc abd", b"klm lmk"], ["a", "k"])
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole = model.margins(data, bounds)
    for i, t in enumerate(texts):
        own = model.margins(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(own[0], whole[i], atol=1e-5)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert np.allclose(model.margins(data, bounds), whole, atol=1e-5)


def test_quality_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op8_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good = [r for r in got if r["quality"] == 1]
    bad = [r for r in got if r["quality"] == 0]
    assert np.mean([r["predicted"] == 1 for r in good]) > 0.95 and np.mean([r["predicted"] == 0 for r in bad]) > 0.6


def test_quality_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(30)] + [(None, 1, 0, "x"), (5, None, 0, "x"), (5, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = cnn_quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert cnn_quality.classify(empty, labels).count() == 0
    assert cnn_quality.classify(docs, labels.where("false")).count() == docs.count()
    scored = cnn_quality.with_scores(docs, cnn_quality.Network.fresh(), "_s")
    assert scored.columns == [*docs.columns, "_s"] and scored.where(F.col("_s").isNull()).count() == 0


def test_parts_of_a_long_text_score_as_a_whole(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 120, n).tolist()) for n in (0, 3, 256, 257, 9000, 512, 513)]
    net = cnn_quality.Network.fresh()
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole = cnn_quality.score(net, data, bounds)
    for i, t in enumerate(texts):
        assert cnn_quality.score(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] == pytest.approx(whole[i], abs=1e-5)
    monkeypatch.setattr(cnn_quality, "BLOCK", 512)
    assert np.allclose(cnn_quality.score(net, data, bounds), whole, atol=1e-5)


def test_scores_equal_a_forward_pass_by_hand():
    """Every filter at every place of every chunk, in plain loops."""
    net = cnn_quality.Network.fresh()
    half, width, stride = cnn_quality.HALF, cnn_quality.WIDTH, cnn_quality.STRIDE
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(32, 120, n).tolist()) for n in (0, 5, 300, 515, 800)]
    got = cnn_quality.score(net, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for t, value in zip(texts, got):
        rows = max(2, -(-len(t) // half))
        padded = list(t) + [0] * (rows * half - len(t) + width)
        peaks = []
        for r in range(rows):
            best = np.full(cnn_quality.FILTERS, -np.inf)
            for at in range(r * half, (r + 1) * half, stride):
                seen = np.concatenate([net.embed[c] for c in padded[at : at + width]]).astype(np.float64)
                best = np.maximum(best, seen @ net.filters)
            peaks.append(best)
        chunks = [np.maximum(0, np.maximum(a, b) + net.shift) for a, b in zip(peaks, peaks[1:])]
        z = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)]) @ net.out + net.bias[0]
        assert value == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = cnn_quality.Network(*(x.astype(np.float64) for x in vars(cnn_quality.Network.fresh()).values()))
    texts = [bytes(rng.integers(97, 122, n).tolist()) for n in (300, 900)]
    halves, first = cnn_quality.halves_of(np.frombuffer(b"".join(texts), np.uint8), np.array([0, 300, 1200]))
    y, w = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        peaks = cnn_quality.convolve(net, halves, first).max(1)
        *_, mean, most = cnn_quality.pooled(net, peaks, first)
        z = np.concatenate([mean, most], 1) @ net.out + net.bias
        return (w * (np.logaddexp(0, z) - y * z)).sum() / w.sum()

    for x, g in zip((net.embed, net.filters, net.shift, net.out, net.bias), cnn_quality.gradients(net, halves, first, y, w)):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in x.shape)
            at = (rng.integers(97, 122), at[1]) if x is net.embed else at
            old, step = x[at], 1e-5
            x[at] = old + step
            up = loss()
            x[at] = old - step
            down = loss()
            x[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-5)
