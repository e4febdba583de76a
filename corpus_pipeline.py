"""A corpus pipeline of five stages, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, cnn_quality, decontam, simhash, suffix_dedup
from tidelog.llm.common import table
from tidelog.llm.queries import TOKENIZER

#: A text that the classifier gives less is rejected.
QUALITY = 0.7
#: Near duplicates: sets of five-word shingles of a Jaccard similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of candidates, and bits in which they differ at most. At 0.8, 15 % of the bits differ, or 19 % for sets
#: of 4 and 5 shingles: 36 with a deviation of 5.4, so that 70 is six deviations above.
BITS, DISTANCE = 192, 70
#: Repeated passages: runs of strings of this many bytes that repeat, if they have over so many words. 51 words take
#: 200 bytes unless they have 2.9 letters on average or less, as runs of junk words may.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier scores at QUALITY or more. Null and empty texts are scored too;
    repeated rows are scored alike; ids may be null. An empty table stays empty."""
    net = cnn_quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = cnn_quality.with_scores(docs, net, "_quality_score")
    return scored.where(F.col("_quality_score") >= QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document of the smallest id; of repeated rows, one. A row without
    an id stays unless it equals a kept one in all columns. Near copies are verified by their shingle sets."""
    found = simhash.similar_texts(docs, SHINGLE, SIMILARITY, BITS, DISTANCE)
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id", F.col("text_hash").alias("_hash")).distinct()
    # one shuffle of the texts serves both: by id and text, as ids may repeat with other texts; then equal rows by hashes
    row = F.xxhash64(F.lit("row"), *docs.columns, *(F.col(c).isNull() for c in docs.columns))
    keyed = docs.withColumns({"_hash": F.xxhash64("text"), "_row": row})
    kept = keyed.join(dropped, ["doc_id", "_hash"], "left_anti")
    return kept.dropDuplicates(["doc_id", "_hash", "_row"]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs, of over PASSAGE_WORDS words, of strings of PASSAGE_BYTES bytes that begin twice among
    them; n_chars follows. A null text stays null; rows with equal texts are two occurrences, so neither keeps a text
    of so many words; ids are not read. An empty table stays empty."""
    cut = suffix_dedup.without_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Rows go by their text, as ids may be null or repeat: of equal
    texts all go or none. Null and empty texts stay; an empty table stays empty, and without items nothing goes."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")  # never null
    leaked = decontam.find_leaks(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_hash")).distinct()
    return docs.join(leaked, F.xxhash64("text") == F.col("_hash"), "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_sha256) of every document left. A null or empty text has no ids; repeated rows
    stay, a null doc_id stays null; an empty table gives no rows."""
    done = bpe.encode_decode(docs, TOKENIZER)
    return done.select(
        "doc_id",
        "ids",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: Learned scores, sampled fingerprint bits and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

