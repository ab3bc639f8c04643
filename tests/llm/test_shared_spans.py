import random
from collections import defaultdict

import pytest

from quillspark.llm import shared_spans as S


def brute(rows, length=200):
    where = defaultdict(set)
    texts = {i: t for i, t, *_ in rows if i is not None and t}
    for i, t in texts.items():
        for k in range(len(t) - length + 1):
            where[t[k : k + length]].add(i)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    shared = {}
    for i, t in texts.items():
        marks = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if len(where[t[k : k + length]]) > 1:
                marks[k : k + length] = b"\1" * length
        if any(marks):
            shared[i] = sum(marks)
    return pairs, shared


def noise(rng, n):
    return "".join(rng.choice("abcdefgh ಕक\n") for _ in range(n))


def rows_of(rng):
    passages = [noise(rng, n) for n in (199, 200, 201, 260, 900)] + ["ab" * 150, "-" * 230, "-" * 400]
    rows = []
    for i in range(70):
        t = noise(rng, rng.randrange(0, 300))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            t += p[rng.randrange(0, 3) :] + noise(rng, rng.randrange(0, 200))
        rows.append((i, t, "s", "en"))
    twice = noise(rng, 250)
    rows += [(100, twice + "x" + twice, "s", "en"), (101, rows[3][1], "s", "en"), (102, None, "s", "en"), (103, "", None, None), (None, rows[5][1], "s", "en"), (104, "y" * 5000, "s", "en"), (5, rows[5][1], "s", "en")]
    return rows


@pytest.mark.parametrize("hot,small", [(2048, 8192), (2, 64)])
def test_against_brute_force(records, monkeypatch, hot, small):
    monkeypatch.setattr(S, "GROUP", hot)
    monkeypatch.setattr(S, "BLOCK", small)
    rows = rows_of(random.Random(hot + small))
    pairs, shared = brute(rows)
    df = records(rows)
    assert {tuple(r) for r in S.sharing_pairs(df, "rec_id", "text").collect()} == pairs and pairs
    report = S.shared_report(df, "rec_id", "text").collect()
    assert {r.id: r.shared_chars for r in report if r.shared_chars} == shared
    assert {r.id for r in report} == {i for i, *_ in rows if i is not None}


def periodic_rows(rng):
    """Rules, leaders, equal table rows and blank forms, of equal and of unequal lengths in two texts and in any phase."""
    rows = [(i, noise(rng, 90) + str(i) + "-" * 1000 + str(i) + noise(rng, 90), "s", "en") for i in (1, 2)]
    row = noise(rng, 37)
    rows += [(i, noise(rng, 50) + str(i) + row * 40 + str(i) + noise(rng, 50), "s", "en") for i in (3, 4)]
    for k, period in enumerate([1, 2, 3, 5, 7, 12, 24, 31, 40, 47, 55, 60, 60, 60, 60, 61, 62, 63, 64, 65, 71, 72, 73, 74, 90]):
        unit = noise(rng, period)
        for j, n in enumerate((1000, rng.randrange(400, 900), rng.randrange(200, 260), rng.randrange(200, 260))):
            at = rng.randrange(period)
            rows.append((100 + 4 * k + j, noise(rng, rng.randrange(0, 150)) + (unit * 1100)[at : at + n] + noise(rng, rng.randrange(0, 150)), "s", "en"))
    return rows


@pytest.mark.parametrize("hot,small,segment", [(2048, 8192, 1_000_000), (2, 64, 400)])
def test_periodic_stretches(records, monkeypatch, hot, small, segment):
    monkeypatch.setattr(S, "GROUP", hot)
    monkeypatch.setattr(S, "BLOCK", small)
    monkeypatch.setattr(S, "SEGMENT", segment)
    rows = periodic_rows(random.Random(hot + small + segment))
    pairs, shared = brute(rows)
    assert shared[1] == shared[2] == 1000 and shared[3] == 37 * 40
    df = records(rows)
    assert {tuple(r) for r in S.sharing_pairs(df, "rec_id", "text").collect()} == pairs
    report = {r.id: r for r in S.shared_report(df, "rec_id", "text").collect()}
    assert {i: r.shared_chars for i, r in report.items() if r.shared_chars} == shared
    assert [report[i].n_passages for i in (1, 2, 3, 4)] == [1] * 4


def test_long_stretches_are_few_suffixes():
    assert len(S.chosen(["-" * 100_000])[0]) < 200


def test_segments(records, monkeypatch):
    rows = rows_of(random.Random(77))
    want = {tuple(r) for r in S.sharing_pairs(records(rows), "rec_id", "text").collect()}
    monkeypatch.setattr(S, "SEGMENT", 150)
    assert {tuple(r) for r in S.sharing_pairs(records(rows), "rec_id", "text").collect()} == want == brute(rows)[0]


def test_empty(records):
    df = records([])
    assert S.sharing_pairs(df, "rec_id", "text").count() == 0
    assert S.shared_report(df, "rec_id", "text").count() == 0


@pytest.mark.parametrize("hot", [2048, 2])
def test_long_periodic_passages(records, monkeypatch, hot):
    monkeypatch.setattr(S, "GROUP", hot)
    rng = random.Random(5)
    rows = []
    for k, (period, n) in enumerate([(1, 3000), (37, 3000), (64, 3000), (70, 3000), (1, 50_000), (90, 50_000)]):
        unit = chr(0x4E00 + k) + noise(rng, period - 1)
        passage = (unit * (n // period + 1))[:n]
        rows += [(2 * k + j, noise(rng, 90) + str(j) + passage + str(j) + noise(rng, 90), "s", "en") for j in (0, 1)]
    report = {r.id: r for r in S.shared_report(records(rows), "rec_id", "text").collect()}
    for k, n in enumerate([3000, 3000, 3000, 3000, 50_000, 50_000]):
        for j in (0, 1):
            assert (report[2 * k + j].n_passages, report[2 * k + j].shared_chars) == (1, n)


def test_equal_hashes_of_different_texts(records, spark):
    """Where the first hash of two texts is equal the second tells them apart."""
    from unittest import mock

    from pyspark.sql import functions as F

    from quillspark.llm import _digest

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "id bigint, text string")
    real = F.xxhash64
    with mock.patch.object(_digest.F, "xxhash64", lambda *c: F.lit(7).cast("bigint") if len(c) == 1 and isinstance(c[0], str) else real(*c)):
        got = {r.id: r.digest for r in _digest.with_digest(df).collect()}
    assert got[2] == got[3] and len(set(got.values())) == 3
