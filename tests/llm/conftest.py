"""Small tables with the awkward cases that every operator must take."""

import random

import pytest

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside; as extra input columns they must not matter.
CLASHES = ["kept", "n_tokens", "class_id", "sid", "key", "rk", "tkey", "size", "target", "rank", "block", "pos", "u", "grp", "h", "spans"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = ["".join(rng.choice("abcdefgilmnorstu") for _ in range(rng.randint(1, 9))) for _ in range(words)]
    for k in range(6, words, rng.randint(5, 11)):
        out[k] += rng.choice([".", ".", ",", "!"])
    return " ".join(out).replace("! ", "!\n")


def awkward() -> list[tuple]:
    """Nulls, empty, very long, repeated and tied rows, copies and near copies."""
    a, b = prose(1, 400), prose(2, 300)
    near = a.split(" ")
    near[200] = "changed"
    rows = [(1, a, "en", "s1", len(a)), (2, b, "en", "s1", len(b)), (3, " ".join(near), None, "s2", None), (4, a, "en", None, 1),
            (4, a, "en", None, 1), (5, None, "en", "s2", 0), (6, "", "en", "s2", 0), (7, " \n\t ", "en", "", 4), (None, b, "en", "s1", 0),
            (None, prose(3, 60), None, None, None), (8, prose(4, 60000), "fr", "s3", 0), (9, "one two", "en", "s3", 7), (10, "one two", "de", "s4", 7),
            (11, "x" * 30000, "en", "s4", 0), (12, "mail a@b.org, +1 (269) 555-3296 4524132264652876 or 10.0.0.1 été 😀", "fr", "s4", 0),
            (13, prose(5, 200) + " " + b[:900] + " " + prose(6, 90), "en", "s5", 0), (14, "<|endoftext|> the <| cat", "en", "s5", 0)]
    rows += [(20 + k, prose(40 + k, 80 + 10 * k), "en", f"s{k % 3}", 0) for k in range(12)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(awkward(), DOCS)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
