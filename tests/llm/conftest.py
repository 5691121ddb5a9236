import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    parts = ["the", "of", "and", "ing", "tion", "er", "re", "an", "st", "le", "qu", "é", "ü"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def odd_rows(rng: random.Random) -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and shared passages."""
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(12)]
    passage = prose(rng, 70)
    rows = [(k, t, "en" if k % 3 else None, f"src{k % 4}", len(t)) for k, t in enumerate(base)]
    for k, t in enumerate(base[:4]):
        words = t.split()
        words[len(words) // 2] = "changed"
        rows.append((100 + k, " ".join(words), "en", "src1", 0))
        rows.append((200 + k, t, "fr", None, 0))
    rows += [(300 + k, f"{prose(rng, 30)} {passage}\n{prose(rng, 30)}", "en", "src2", 0) for k in range(5)]
    rows += [(400, None, "en", "src0", None), (401, "", None, "src0", 0), (402, " \n\t", "en", "src3", 3), (403, "one two", "en", "src3", 7), (404, "ONE two", "de", "src3", 7)]
    rows += [(405, "a b c d e", "en", "", 9), (None, "no id but some words in here today", "en", "src1", 3), (None, None, None, None, None)]
    rows += [(406, "  x " * 900, "en", "src1", 0), (407, prose(rng, 6000), "en", "src1", 0), (408, "<|endoftext|>don't  stop  now　 日本語 \t\tx'll ", "en", "src1", 0)]
    return [*rows, rows[3], rows[3], rows[20], (500, "y" * 700, "en", "src2", 700), (-5, base[5], "en", "src9", 1)]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return odd_rows(random.Random(7))


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns, named as operators might name their own."""
    from pyspark.sql import functions as F

    extra = ["n", "size", "key", "shard", "slot", "count", "data", "root", "cid", "kept", "k1", "gram", "target", "values", "length", "_n", "_cell", "_key", "_text"]
    return docs.select("*", *(F.lit("x").alias(c) for c in extra))


@pytest.fixture(scope="session")
def labels(spark):
    good = [(k, 1, 0) for k in range(12)] + [(k, 1, 0) for k in range(300, 305)]
    return spark.createDataFrame([*good, (406, 0, 0), (407, 1, 1), (None, 1, 0), (3, 1, 0), (500, None, None)], "doc_id long, quality int, toxic int")


def same_rows(df, other) -> bool:
    return sorted(map(repr, df.collect())) == sorted(map(repr, other.collect()))
