import itertools
import random

from quillspark.llm import near_duplicates as N


def words(rng, n, pool=4000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def brute(rows, threshold, least):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        if i is not None and len(w) >= least:
            sets[i] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_pairs_against_brute_force(records):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = words(rng, rng.choice([50, 60, 90, 150, 300, 700, 1500]))
        rows.append((k * 10, " ".join(base), "s", "en"))
        for j in range(1, 4):
            w = list(base)
            for _ in range(max(1, int(len(w) * rng.choice([0.01, 0.03, 0.05])))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w += words(rng, len(w) // 8)
            if rng.random() < 0.3:
                h = len(w) // 2
                w = w[h:] + w[:h]
            rows.append((k * 10 + j, "  ".join(w).upper() if rng.random() < 0.2 else "\n".join(w), "s", "en"))
    got = {tuple(r) for r in N.similar_pairs(records(rows), "rec_id", "text").collect()}
    want = brute(rows, 0.6, 50)
    clear = brute(rows, 0.7, 50)
    assert got <= want
    assert clear <= got and len(clear) > 100


def near_threshold(rng):
    """Pairs of texts of 24 to 400 features between 0.56 and 0.72 similar."""
    rows, k = [], 0
    for n in (24, 30, 47, 64, 90, 128, 200, 256, 300, 400):
        for _ in range(12):
            base = [f"p{k}_{i}" for i in range(n + 2)]
            other = list(base)
            # an own stretch of d words in place of as many takes d + 2 runs from both
            d = max(1, round(n * (1 - rng.uniform(0.56, 0.72)) / (1 + rng.uniform(0.56, 0.72))) - 2)
            at = rng.randrange(0, len(other) - d)
            other[at : at + d] = [f"q{k}_{i}" for i in range(d)]
            rows += [(2 * k, " ".join(base), "s", "en"), (2 * k + 1, " ".join(other), "s", "en")]
            k += 1
    return rows


def test_recall_near_the_threshold(records):
    rows = near_threshold(random.Random(7))
    want = brute(rows, 0.6, 20)
    assert 50 < len(want) < 110
    got = {tuple(r) for r in N.similar_pairs(records(rows), "rec_id", "text", 0.6, 20).collect()}
    assert got <= want and len(want - got) <= 1  # 0.01 expected
    exact = {tuple(r) for r in N.similar_pairs(records(rows), "rec_id", "text", 0.6, 20, exact=True).collect()}
    assert exact == want


def test_one_id_with_two_texts(records):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a, "s", "en"), (1, b, "s", "en"), (2, a + " tail", "s", "en"), (3, b + " tail", "s", "en")]
    for exact in (False, True):
        assert {tuple(r) for r in N.similar_pairs(records(rows), "rec_id", "text", exact=exact).collect()} == {(1, 2), (1, 3)}


def test_edges(records):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, None, None), (1, text, None, None), (2, text, "s", "x"), (3, None, "s", "x"), (4, "", "s", "x"), (None, text, "s", "x"), (5, " ".join(text.split()[:49]), "s", "x"), (6, "a " * 200, "s", "x"), (7, "a " * 300, "s", "x"), (8, text + " " + "tail " * 3, "s", "x")]
    got = {tuple(r) for r in N.similar_pairs(records(rows), "rec_id", "text").collect()}
    assert got == {(1, 2), (1, 8), (2, 8), (6, 7)}
    groups = {r.id: (r.group_id, r.n_links) for r in N.similar_groups(records(rows), "rec_id", "text").collect()}
    assert groups == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 1), 7: (6, 1), 8: (1, 1)}


def test_pairs_at_the_threshold_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, m in [(24, 30), (44, 44), (52, 52), (127, 127), (190, 260), (256, 256), (300, 300), (1024, 1020)]:
        common = -(-6 * (n + m) // 16)
        f, own = [], []
        for k in range(400):
            x = rng.integers(0, 2**64, n + m - common, dtype=np.uint64)
            f += [np.sort(x[:n]), np.sort(x[n - common :])]
            own += [np.full(n, 2 * k), np.full(m, 2 * k + 1)]
        sig, whose = N.signatures(np.concatenate(f), np.concatenate(own), 800, 0.6)
        seen = [set() for _ in range(800)]
        for s, w in zip(sig.tolist(), whose.tolist()):
            seen[w].add(s)
        missed = sum(not seen[2 * k] & seen[2 * k + 1] for k in range(400))
        assert missed <= 1, (n, m, missed)  # 0.04 expected at most


def test_bitmaps_bound_the_common_features(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for n, m, common in [(1024, 1020, 767), (1024, 1020, 800), (2050, 2040, 1534), (1100, 700, 675), (900, 800, 640), (60, 50, 42)] * 8:
        f = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = f[:n], f[n - common : n - common + m]
        pair = [(N._bits(x).view(np.int64).tolist(), int(np.bitwise_count(N._bits(x)).sum()), len(x)) for x in (a, b)]
        for one, two in (pair, pair[::-1]):
            rows.append((common, *one, *two))
    df = spark.createDataFrame(rows, "common int, bits_a array<bigint>, taken_a bigint, n_a int, bits_b array<bigint>, taken_b bigint, n_b int")
    assert df.filter(N._most_common("a", "b") < df["common"]).count() == 0


def test_empty(records):
    assert N.similar_pairs(records([]), "rec_id", "text").count() == 0
    assert N.similar_groups(records([]), "rec_id", "text").count() == 0


def test_hot_bucket(spark):
    from quillspark.llm import _buckets

    n = _buckets.BLOCK * 2 + 7
    rows = spark.range(n).selectExpr("1L as bucket", "id", "cast(if(id % 2 = 0, 100, 10) as int) as size")
    got = _buckets.bucket_pairs(rows, 0.6).count()
    even, odd = (n + 1) // 2, n // 2
    assert got == even * (even - 1) // 2 + odd * (odd - 1) // 2


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.root for r in N.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_words_in_segments(monkeypatch):
    from quillspark.llm import _hashing as H

    texts = ["one two\u3000three", "", "  lead and trail ", "x" * 50 + " y"]
    whole = [x.tolist() for x in H.words(texts)]
    monkeypatch.setattr(H, "SEGMENT", 5)
    assert [x.tolist() for x in H.words(texts)] == whole
