import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import splitting as S


def check(text, limit, overlap):
    got = S.pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 <= b - a <= limit for a, b in got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert c > a and d > b
        assert b - c >= min(overlap, b - a - 1)
    return got


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n।#1", max_size=300), st.integers(10, 60), st.integers(0, 4))
def test_property(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_places():
    rng = random.Random(2)
    para = lambda: " ".join("The order was kept by the board." for _ in range(rng.randrange(2, 9)))
    text = "\n\n".join(f"{k}. Title.—{para()}\n\n{para()}" for k in range(1, 30))
    core = S.pack(text, 1000)
    assert "".join(text[a:b] for a, b in core) == text
    assert all(text[:a].endswith("\n\n") for a, b in core[1:])
    for a, b in check(text, 1000, 100):
        assert text[a].isupper() or text[a].isdigit()
        assert text[:b].rstrip().endswith(".")


def test_edges():
    assert S.pieces("", 10, 2) == [(0, 0)] and S.pieces("x" * 10, 10, 2) == [(0, 10)]
    check("x" * 1000, 50, 10)
    with pytest.raises(ValueError):
        S.pieces("x" * 100, 10, 5)


def test_table(spark):
    rows = [(1, "f", 0, "a. " * 30), (1, "f", 0, "a. " * 30), (2, "f", 0, None), (3, "f", 1, ""), (4, "f", 0, "x" * 20), (5, "other", 0, "x" * 99), (None, "f", 0, "y" * 21), (6, None, 0, "x" * 99)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id bigint, field string, pos int, text string, piece string")
    got = S.oversized(df, {"f": (20, 3)}).collect()
    assert {r.id for r in got} == {1, None} and sum(r.id == 1 and r.piece_no == 0 for r in got) == 2
    assert S.oversized(df.limit(0), {"f": (20, 3)}).count() == 0


def test_ranks_of_headings():
    section = lambda k, n: f"{k}. Title.\n" + "The officer keeps it. " * n + "\n"
    text = "PART A\n" + section(1, 10) + section(2, 10) + "PART B\n" + section(3, 30) + section(4, 2) + "(a) one\n(b) two\n" + "PART C\n" + section(5, 2)
    got = [text[a:b] for a, b in S.pack(text, 520)]
    assert "".join(got) == text and all(len(x) <= 520 for x in got)
    assert got[0].startswith("PART A") and got[0].endswith("2. Title.\n" + "The officer keeps it. " * 10 + "\n")
    assert got[1].startswith("PART B") and [x for x in got if "PART C" in x] == ["PART C\n" + section(5, 2)]  # no piece crosses from part B to part C
    marked = "<h1>A</h1><p>" + "x " * 100 + "</p>\n<h1>B</h1>\n<li>" + "y " * 60 + "\n<li>" + "z " * 60
    parts = [marked[a:b] for a, b in S.pack(marked, 230)]
    assert "".join(parts) == marked and parts[0].startswith("<h1>A") and any(x.startswith("<h1>B") for x in parts) and any(x.lstrip().startswith("<li>z") for x in parts)
