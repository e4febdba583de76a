import random

import pytest

CLASHES = {"t": "x", "h1": 1, "h2": 2, "fp": "f", "node": 3, "block": 4, "slot": 5, "shard": "s", "copies": 6, "spans": "p", "value": 7, "n": 8, "words": "w", "score": 0.5, "key": "k"}


def word(rng):
    return "".join(rng.choice(["tha", "er", "ing", "on", "ßu", "é", "st", "re", "You", "b"]) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, odd white space, nulls, empties and a very long one."""
    rng = random.Random(5)
    shared = prose(rng, 120)
    out = [prose(rng, rng.choice([1, 2, 5, 60, 150, 300])) for _ in range(60)]
    out += [prose(rng, 40) + "\n" + shared + "\n" + prose(rng, 50) for _ in range(8)]
    short = " ".join("of the or an it" for _ in range(15))[:300]  # over 50 words in under 400 bytes
    out += [prose(rng, 30) + " " + short + f" {i} " + prose(rng, 30) for i in range(3)]
    out += [out[3], out[3], out[60], None, None, "", "", " \t\n\x0b\x0c\r ", "one", "one two", "   x\x1cy \x00"]
    base = prose(rng, 200).split(" ")
    for i in range(6):
        near = list(base)
        near[10 * i] = "changed"
        out.append(" ".join(near))
    out.append("same words again " * 4000)
    out.append("a\na\nb\n\n \na\n" * 40)
    out.append(prose(rng, 9000))
    out.append("<|endoftext|> in a text <|im_end|> \\ <| <\\| " + prose(rng, 20))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents: an id is null, one is repeated with its text, and there are clashing columns."""
    rows = [(None if i == 7 else i, t, "en", "src0", None if t is None else len(t), *CLASHES.values()) for i, t in enumerate(texts)]
    rows.append(rows[12])
    schema = "doc_id long, text string, lang string, source string, n_chars long, t string, h1 int, h2 int, fp string, node int, block int, slot int, shard string, copies int, spans string, value int, n int, words string, score double, key string"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def listed(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


def plain(v):
    return bytes(v) if isinstance(v, (bytearray, memoryview)) else v


def rows(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
