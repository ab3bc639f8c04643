from quillspark.llm import scan_noise as S

PROSE = "The licensing officer shall keep a copy of the award and return an extract of it without delay. Objections received from any person were considered by the board and then waived in the presence of two witnesses. "
COUNTS = {w: 500 for w in S._WORD.findall((PROSE + "department section tenancy sub-lessee co-owner register under shall the").lower())}


def scanned(number, header=None):
    lines = []
    import textwrap

    body = textwrap.wrap(PROSE * 4, 60, break_on_hyphens=False)
    for page in range(3):
        if header:
            lines.append(header)
        lines += body[page * 4 : page * 4 + 4]
        if number:
            lines.append(number(page + 3))
    return "\n".join(lines)


def found(text):
    return set(S.kinds(text, S.Judge(COUNTS)))


def test_page_numbers():
    for form in (lambda n: f"- {n} -", lambda n: str(n), lambda n: f"Page {n} of 9", lambda n: f"[{n}]", lambda n: ["i", "ii", "iii", "iv", "v", "vi"][n - 1], lambda n: f"          {n}"):
        assert found(scanned(form)) == {"page_number"}, form(3)


def test_headers():
    assert found(scanned(None, "THE STATE GAZETTE, PART 12")) == {"running_header"}
    lines = scanned(None).split("\n")
    assert found("\n".join(lines)) == set()
    on_line = "\n".join(x if x != "H" else "" for x in scanned(None, "H").split("\n"))
    assert "running_header" not in found(on_line)
    numbered, n = [], 6
    for x in scanned(None, "H").split("\n"):
        if x == "H":
            n += 1
            x = f"State Bulletin of Laws   2001   [{n}]"
        numbered.append(x)
    assert found("\n".join(numbered)) == {"running_header", "page_number"}


def test_broken_words():
    assert found("It was receiv-\ned by the board.") == {"broken_word"}
    assert found("It was receiv­\ned by the board.") == {"broken_word"}
    assert found("The order binds the co-\nowner and the board.") == set()
    assert found("It was received\nby the board.") == set()
    assert found("ಅರ್ಜಿ ಸಮಿ‐\nತಿ ಮತ್ತು") == {"broken_word"}


def test_misread_characters():
    judge = S.Judge(COUNTS)
    for wrong, right in (("rcgister", "register"), ("secfion", "section"), ("tbe", "the"), ("un1ess", ""), ("dep4rtment", None), ("departrnent", "department"), ("sball", "shall"), ("5ection", "section"), ("4th", None), ("HFW", None)):
        assert judge.reading(wrong) == right, wrong
    assert found("Oops! The board shall register it.") == set()


def test_repair():
    judge = S.Judge(COUNTS)
    text = scanned(lambda n: f"- {n} -", "THE STATE GAZETTE, PART 12").replace("officer shall", "offi‐\ncer sball", 1)
    got = S.repair(text, judge)
    assert "GAZETTE" not in got and "- 4 -" not in got and "\n" not in got.strip()
    assert got.startswith("The licensing officer shall keep")
    assert S.repair(None, judge) is None and S.repair("", judge) == ""
    assert S.repair("one\n\ntwo", judge) == "one\n\ntwo"


def test_table(records):
    rows = [(1, scanned(lambda n: f"- {n} -"), None, None), (1, scanned(lambda n: f"- {n} -"), None, None), (2, None, "s", "en"), (3, "", "s", "en"), (4, PROSE * 4000, "s", "en")]
    assert [tuple(r) for r in S.find_noise(records(rows), "rec_id", "text").collect()] == [(1, "page_number")]
    assert S.repaired(records(rows), "rec_id", "text").count() == 5
    assert S.find_noise(records([]), "rec_id", "text").count() == 0


def test_near_shapes_by_index():
    import random

    rng = random.Random(9)
    base = ["".join(rng.choice("ABCDE ") for _ in range(rng.randrange(5, 91))) for _ in range(60)]
    shapes = {"".join(rng.choice("ABCDE ") if rng.random() < 0.08 else c for c in b)[: rng.choice([None, -1, -2])] for b in base for _ in range(12)} | {b + "XY" for b in base}
    small = sorted(b for b in shapes if len(b) > 6)
    alike = S._index(small)
    for a in base + small:
        assert [b for b in alike(a) if S._near(a, b)] == [b for b in small if S._near(a, b)]


def test_near_headers_of_long_texts():
    import random

    head = "THE STATE GAZETTE EXTRAORDINARY"
    for pages in (6, 60):  # 72 and 720 different short lines
        rng, lines = random.Random(2), []
        for page in range(pages):
            k = page % 30
            lines.append(head[:k] + "QZ"[page // 30] + head[k + 1 :])  # each misread in another way
            lines += ["".join(rng.choice("abcdefghijklmnop ") for _ in range(50)).strip() for _ in range(12)]
            lines.append(f"- {page + 1} -")
        labels, headers, _ = S.label(lines)
        assert headers and [labels[i] for i in range(0, len(lines), 14)] == [S.HEADER] * pages


def test_judging_does_not_fade_with_size():
    """The same text in tables of any size: counts scale, verdicts stay."""
    for scale in (1, 1000, 10**7):
        counts = {w: n * scale for w, n in COUNTS.items()} | {"rcgister": 3 * scale, "sball": 2 * scale} | {"": 20 * scale, " ": 500 * scale}
        judge = S.Judge(counts)
        assert judge.reading("rcgister") == "register" and judge.reading("sball") == "shall" and judge.reading("departrnent") == "department"
        assert judge.reading("register") is None and judge.reading("shall") is None
    assert sorted(S._unsigned("1!5")) == sorted(a + b + "s" for a in "li" for b in "li") and len(S._unsigned("1" * 8)) == 256


def test_vocabulary_by_rate(records):
    rows = [(i, "common " * 50 + ("usual " if i % 2 else "") + f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}", "s", "en") for i in range(200)]
    small = S.word_counts(records(rows), "text")
    assert small["common"] == 10_000 and small["usual"] == 100 and small[""] == S.KNOWN and small[" "] == 10_000
    large = S.word_counts(records(rows), "text", 0.02)
    assert set(large) == {"common", "", " "} and large[""] == S.DOMINANCE * 206


def test_verdicts_do_not_depend_on_the_size_of_the_table(spark):
    """beside 17 million other words a reading once had to be nine times as frequent."""
    rows = [(1, "Copies of the award " * 40 + "go to tbe board at once.", "s")]
    judged = spark.createDataFrame(rows, "rec_id bigint, text string, source string")
    other = spark.range(1000, 1017).selectExpr("id rec_id", "repeat('common ', 1000000) text", "'s' source")
    for table in (judged, judged.union(other)):
        assert [tuple(r) for r in S.find_noise(table, "rec_id", "text").collect()] == [(1, "bad_char")]


def test_copies_of_all_rows_change_no_verdict(spark):
    """counts are compared with each other, not with fixed numbers."""
    texts = ["A f0rm is no form. " + "The form is filed. " * 9 + "End of it.", "The co-owner signs; the co-\nowner pays and receiv-\ned it; received.", "Either bostel. " + "The hostel stays. " * 50 + "End."]
    for copies in (1, 7):
        table = spark.createDataFrame([(i, t) for i, t in enumerate(texts) for _ in range(copies)], "rec_id bigint, text string")
        assert {tuple(r) for r in S.find_noise(table, "rec_id", "text").collect()} == {(1, "broken_word"), (2, "bad_char")}
        fixed = {r["id"]: r["text"] for r in S.repaired(table, "rec_id", "text").collect()}
        assert fixed[0] == texts[0] and fixed[1] == "The co-owner signs; the co- owner pays and received it; received." and fixed[2].startswith("Either hostel.")


def test_joined_runs_of_open_hyphens():
    text, at, pairs = S.assembled("It is a-\nb-\nc and\nends.")
    assert (text, pairs) == ("It is abc and ends.", [("a", "b-"), ("b", "c")])
    assert {"a", "b", "c", "ab", "bc", "abc"} <= set(S._fixable(text, at))
    assert S.resolved(text, at, pairs, S.Verdicts([(S._pair(("b", "c")), "-")])) == "It is ab- c and ends."
