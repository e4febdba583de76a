"""Quality rules over whole texts as native expressions, run as a short-circuit cascade.

Every rule is a Spark expression. A sample gives each rule's share of rejected texts and its cost; the
rules are then tried in the order of rejection per cost, and a text that one rule rejects is not shown
to the rest. The verdict is the same in any order, only the work differs.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SPACES = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = "[^#*$%&|<>]+"
#: Texts in the sample that orders the rules.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a text to reject. It may use the column t (the text) and the base counts."""

    name: str
    fails: Column


def _left(text: Column, pattern: str) -> Column:
    """How many code points are left when all that matches ``pattern`` goes."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _packed(words: Column) -> Column:
    """Sorted longs, one for every 3-word window: 32 bits of its hash, then 32 bits of its place."""
    high = F.lit(-(1 << 32))
    return F.when(
        F.size(words) >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
                .bitwiseAND(high)
                .bitwiseOR(i.cast("long")),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _same_as_neighbour(items: Column, key) -> Column:
    """Those of a sorted array whose key is that of the item before or after."""
    return F.filter(
        items,
        lambda x, j: F.coalesce((j > 0) & (key(F.get(items, j - 1)) == key(x)), F.lit(False))
        | F.coalesce(key(F.get(items, j + 1)) == key(x), F.lit(False)),
    )


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) per row.

    Windows are first matched by 32 bits of a hash; those that match are compared as strings, so the count
    is exact. A null text has no words; empty texts give zeros; repeated rows give a row each.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split("t", SPACES), "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    high = F.lit(-(1 << 32))
    first = docs.select("doc_id", t.alias("t")).withColumn("words", words).withColumn("lines", lines)
    second = first.withColumn("packed", _packed(F.col("words")))
    third = second.withColumn("like", _same_as_neighbour(F.col("packed"), lambda x: x.bitwiseAND(high)))
    fourth = third.withColumn(
        "windows",
        F.sort_array(
            F.transform(
                "like",
                lambda x: F.struct(
                    F.concat_ws(" ", *(F.get("words", (x.bitwiseAND(F.lit((1 << 32) - 1)) + k).cast("int")) for k in range(3))).alias("w"),
                    x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("p"),
                ),
            )
        ),
    )
    places = F.transform(_same_as_neighbour(F.col("windows"), lambda x: x["w"]), lambda x: x["p"])
    repeated = F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))
    # A filter on these columns must not be pushed below this projection, where it would repeat the work for
    # every item of an array; the optimizer leaves filters above an expression that is not deterministic. This
    # one is always zero, which the optimizer cannot tell.
    barrier = F.floor(F.rand(0)).cast("int")
    return fourth.select(
        "doc_id",
        "t",
        (F.size("words") + barrier).cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _left(F.col("t"), NOT_SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules after the base: each takes a text away for one kind of junk."""
    t = F.col("t")
    capitals = _left(t, r"[^\p{Lu}]+")
    letters = _left(t, r"[^\p{L}]+")
    gone = lambda x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("dup_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        Rule("long_words", F.col("word_chars") > 20 * F.col("n_words")),
        Rule("capitals", 2 * capitals > letters),
        Rule("letters", 10 * letters < 6 * F.col("word_chars")),
        Rule("ellipses", 3 * F.col("n_words") < 10 * gone("...") + 30 * gone("…")),
    ]


def ordered(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, both measured on a sample of about ``rows`` rows.

    The sample is a share of the rows' hashes, so its size does not grow with the table. Cost is the time
    that one pass of the rule takes over the sample. An empty table keeps the given order.
    """
    total = docs.count()
    if not total:
        return rules
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.where(spread < min(1.0, rows / total)).limit(2 * rows)  # equal rows share a hash
    sample = checkpointed(base_counts(chosen)).where(~base_failed())

    def pass_of(fails: Column) -> tuple[float, int]:
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(fails).alias("n")).first()["n"]
        return time.perf_counter() - began, rejected

    pass_of(F.lit(False))
    idle = min(pass_of(F.lit(False))[0] for _ in range(2))
    rank = []
    for i, rule in enumerate(rules):
        cost, rejected = pass_of(rule.fails)
        rank.append((-rejected / max(cost - idle, 1e-3), i))
    return [rules[i] for _, i in sorted(rank)]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects a text, null if none does; later rules are not evaluated."""
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        verdict = verdict.when(rule.fails, F.lit(rule.name))
    return verdict


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, order: bool = True) -> DataFrame:
    """Base counts, base_failed, kept and rejected_by for every row of ``docs``.

    Null and empty texts have no words, so the base rejects them. Extra columns are not read. Filters on doc_id belong
    on ``docs``: those on the result are not pushed below the counts, as they would repeat them. With ``order``, short
    jobs over the sample run here.
    """
    rules = default_rules() if rules is None else rules
    counted = base_counts(docs)
    if order:
        rules = ordered(docs, rules)
    return (
        counted.withColumn("rejected_by", cascade(rules))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("t")
    )
