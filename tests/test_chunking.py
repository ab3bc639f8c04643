"""The fold against a state machine written from the property list."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import chunking


def machine(text, limit):
    if len(text) <= limit:
        return [text]
    done, held = [], ""
    for p in text.split("\n\n"):
        if len(held) + len(p) + 2 <= limit:
            held += p + "\n\n"
        elif held:
            done.append(held.strip())
            held = p
        else:
            for s in p.split(". "):
                if len(held) + len(s) + 2 <= limit:
                    held += s + ". "
                elif held:
                    done.append(held.strip())
                    held = s
                else:
                    done.append(s[:limit])
    return done + ([held.strip()] if held.strip() else [])


def folded(spark, cases):
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, t string, n int")
    return [r[1] for r in sorted(df.select("i", chunking.chunks(F.col("t"), F.col("n"))).collect())]


def test_edges(spark):
    cases = [("", 5), ("abcde", 5), ("abcdef", 5), ("\n\n\n\n\n\n\n\n", 4), ("a. b. " * 20, 10), ("x" * 30 + "\n\nyy\n\nzz", 10), ("aa\n\n" + "b" * 40 + "\n\ncc", 12)]
    assert folded(spark, cases) == [machine(t, n) for t, n in cases]


def test_random(spark):
    rng = random.Random(3)
    cases = [("".join(rng.choice(["word", " ", ". ", "\n\n", "\n", "long" * 6]) for _ in range(rng.randint(0, 60))), rng.randint(4, 60)) for _ in range(400)]
    assert folded(spark, cases) == [machine(t, n) for t, n in cases]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab. \n", max_size=80), st.integers(2, 30)), min_size=1, max_size=30))
def test_property(spark, cases):
    assert folded(spark, cases) == [machine(t, n) for t, n in cases]


def test_null_and_marks(spark):
    df = spark.createDataFrame([(None, 5), ("abcdefgh", 5)], "t string, n int")
    assert df.select(chunking.truncated(F.col("t"), F.col("n")).alias("x")).collect()[1].x == "abcde" + chunking.TRUNCATED
    assert chunking.chunk_rows(df.withColumn("doc_id", F.lit(1)), text_col="t", limit_col="n").filter("chunk is null").count() == 0
