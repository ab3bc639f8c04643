import pytest
from pyspark.sql import functions as F

from quillspark.llm import truncation as T

WHOLE = [
    None, "", "  \n", "The sum is due.", "The sum is due.)", 'The record calls it "Hostel Kitchens."', "धारा लागू होगा।", "It ends.\n\nBy order,\nA. Name\nRent Controller", "It ends.\n\nSd/-\nUnder Secretary to Government",
    "It ends.\n\nChetonwadi, 15th day of September, 1966", "It ends.\n\nKatte, 14-March-2003", "It ends.\n\nTotal fees: Rs. 27,000/-", "It ends.\n\nTotal fees: rupees seven thousand/-", "It ends.\n\n(F. No. AHV/59/2006)", "It concerns wells, carts, sheds, etc.", "{See section 1 and Table 2.}", "The sum is due.\n- 4 -", "The sum is due....",
]
CUT = ["The sum is d", "The sum is due and", "The sum is due to the ...", "The sum is due to the…", "The sum is due [more", "The sum is due (contd", "The sum is due and\n", "The sum is du�", "The sum of Rs.", "It ends. (See section 4.", "It ends.\n\n3.", "The sum,", "It ends.\n\nTotal fees: Rs. 2"]


RARE = ["The sum is due....", "It ends.\n\nSd/-\nUnder Secretary to Government", "It ends. (See section 4.", "It ends.\n\nTotal fees: Rs. 2"]


def cases(texts):
    """The model knows only forms that the table has a few times."""
    return [pytest.param(t, marks=pytest.mark.xfail(strict=False, reason="a form that the table hardly has")) if t in RARE else t for t in texts]


@pytest.fixture(scope="module")
def weights(spark):
    records = spark.read.parquet("/root/testdata/sf0.1/aiscript.parquet")
    return T.fit_endings(records, {"full_text_content": "full_text_content", "summary": "main_content.summary"})


def is_cut(text, weights):
    return T.log_odds(text, weights) + T.np.log(T.BASE / (1 - T.BASE)) > 0


@pytest.mark.parametrize("text", cases(WHOLE))
def test_whole(text, weights):
    assert not is_cut(text, weights)


@pytest.mark.parametrize("text", cases(CUT))
def test_cut(text, weights):
    assert is_cut(text, weights)


def test_held_out_cuts(spark, weights):
    """Texts of other rows, cut inside a word, against the same texts where sentences end."""
    import random

    rng = random.Random(8)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/aiscript.parquet").select("full_text_content").filter("length(full_text_content) > 800").orderBy("rec_id").limit(1500).collect()]
    inside = [t[:k] for t in texts for k in [rng.randrange(300, len(t) - 1)] if t[k].isalpha() and t[k - 1].isalpha()]
    found = sum(is_cut(t, weights) for t in inside) / len(inside)
    whole = [t[: m.end() - 2] for t in texts for m in list(T.re.finditer(r"[a-z]{4,}\.\n\n", t))[:1]]
    kept = sum(not is_cut(t, weights) for t in whole) / len(whole)
    print(found, kept, len(inside), len(whole))
    assert found > 0.97 and kept > 0.97


def test_lengths():
    text = 'a"ಕ😀\n&<\\'
    import html
    import json

    got = dict(zip(T.MEASURES, T.lengths(text)))
    assert got["chars"] == len(text) and got["utf8"] == len(text.encode()) and got["utf16"] == len(text.encode("utf-16-le")) // 2
    assert got["entities"] == len(html.escape(text, quote=True)) and got["json"] == len(json.dumps(text, ensure_ascii=False)) - 2
    assert got["json_ascii"] == len(json.dumps(text)) - 2 and got["crlf"] == len(text.replace("\n", "\r\n"))


NAMES = ("seen", "register", "officer", "vessel", "award", "market", "section", "enquiry")


def sentence(i):
    return f"The {NAMES[i % 8]} of ward {i} shall keep a {NAMES[i * 5 % 8]} and a {NAMES[i * 3 % 7]} in the {NAMES[i * 11 % 5]}."


def prose(i, n):
    """Whole sentences, ``n`` characters at least."""
    out = ""
    while len(out) < n:
        out += sentence(i + len(out)) + " "
    return out[:-1]


def test_hidden_limits_and_report(records):
    """Cut at a number of bytes in one source only; others end as they do."""
    rows = [(i, ("ಅ" * (i % 37) + " " + prose(i, 300))[: 200 - 2 * (i % 37)], f" S{i % 2} ", "en") for i in range(40)]
    rows += [(100 + i, prose(i, 60 + 13 * i), "s0", "en") for i in range(400)] + [(900, None, None, None)]
    seen = T.inspect(records(rows), "rec_id", {"t": "text"}, "source").cache()
    limits = {tuple(r)[:4] for r in T.hidden_limits(seen).collect()}
    assert ("t", T.ALL, "utf8", 200) in limits and ("t", "s1", "utf8", 200) in limits
    found = {r.id for r in T.find_truncated(seen).collect()}
    assert len(found & set(range(40))) >= 38 and len(found - set(range(40))) <= 2
    report = {r.source: r for r in T.truncation_report(seen).collect()}
    assert {s: (r.n_values, r.n_cut) for s, r in report.items()} == {s: (n, sum(1 for i in found if (i >= 100) * 2 + i % 2 in c)) for s, n, c in (("s0", 420, {0, 2, 3}), ("s1", 20, {1}))}


def test_limits_find_what_endings_leave_open(records):
    """The same ending counts as cut at a hidden limit and as whole elsewhere; without limits it is never a case."""
    rows = [(i, prose(i, 60 + 7 * i), "a", "en") for i in range(900)]
    rows += [(2000 + i, prose(i, 380)[:330], "b", "en") for i in range(200)]
    seen = T.inspect(records(rows), "rec_id", {"t": "text"}, "source").cache()
    base = T.np.log(T.BASE / (1 - T.BASE))
    judged = {r.id: r for r in T.judged(seen).collect()}
    none = {r.id: r.cut for r in T.judged(seen, T.hidden_limits(seen).limit(0)).collect()}
    odds = {r.id: r.odds for r in seen.collect()}
    limited = {i for i, r in judged.items() if r.by_limit}
    assert all(judged[i].cut and not none[i] and -T.LIMIT_ODDS < odds[i] <= -base for i in limited)
    forced = seen.withColumn("odds", F.when(F.col("id") >= 1900, F.lit(0.0)).when(F.col("id") >= 880, F.lit(0.0)).otherwise(F.col("odds"))).cache()
    assert {r.id for r in T.judged(forced).collect() if r.by_limit and r.id >= 880} == {2000 + i for i in range(200)}
    assert sum(r.n_by_limit for r in T.truncation_report(forced).collect()) >= 200
    assert {r.id for r in T.find_truncated(forced).collect()} >= {2000 + i for i in range(200)}


def test_limits_at_the_seam(spark):
    """A limit at 4096, the end of a stretch of lengths, has its neighbours on both sides."""
    lengths = [4096] * 60 + [4096 + d for d in range(-24, 25) for _ in range(3) if d] + [9000 + 4 * k for k in range(40)]
    rows = [(i, "t", "s", 0.0, False, *[n] * len(T.MEASURES)) for i, n in enumerate(lengths)]
    seen = spark.createDataFrame(rows, "id bigint, field string, source string, odds double, residue boolean, " + ", ".join(f"{m} bigint" for m in T.MEASURES))
    found = [r for r in T.hidden_limits(seen).collect() if r.measure == "chars" and r.scope == T.ALL]
    assert [(r.length, r.n_values) for r in found] == [(4096, 60)] and abs(found[0].excess - (1 - 2.88 / 60)) < 1e-9


def test_empty(records):
    seen = T.inspect(records([]), "rec_id", {"t": "text"}, "source")
    assert T.find_truncated(seen).count() == 0 and T.truncation_report(seen).count() == 0
