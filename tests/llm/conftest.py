import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long_ = " ".join(f"x{i % 977}y{i % 31}" for i in range(60_000))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "some text here", "en", "b", 14), (None, None, None, None, None),
        (5, "same row again and again", "en", "b", 24), (5, "same row again and again", "en", "b", 24), (5, "another text with that id", "de", None, 25),
        (6, long_, "en", "a", len(long_)), (7, "0", "en", "a", 1), (8, "\U0001f600 éß !", "fr", "c", 6),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    """The rows, with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, SCHEMA).withColumns({c: F.lit("kept") for c in ("score", "node", "size", "spans", "n_words", "mix_size", "bucket")})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """Near copies, copies, shared passages and lines, benchmark passages and secrets, all seeded."""
    r = random.Random(9)
    rows, passage, line = [], words(r, 60), " ".join(words(r, 8))
    for i in range(120):
        t = words(r, r.randint(3, 150))
        if i % 6 == 1:
            t = rows[-1][1].split(" ")
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = f"e{r.randrange(99)}"
        if i % 10 == 3:
            at = r.randrange(len(t))
            t[at:at] = passage[r.randint(0, 8) :]
        s = " ".join(t)
        if i % 4 == 2:
            s += "\n" + line
        if i % 9 == 4:
            s += ' password: "' + "".join(r.choice("abcXYZ0189+/") for _ in range(24)) + '"'
        rows.append((i, s, "en", f"src{i % 5}" if i % 17 else None, len(s)))
    rows += [(200 + i, rows[0][1], "en", "src0", 1) for i in range(15)]
    return spark.createDataFrame(rows, SCHEMA).cache()
