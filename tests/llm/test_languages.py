import random

from pyspark.sql import functions as F

from quillspark.llm import languages as L

CODES = {"en": "English", "hi": "Hindi", "kn": "Kannada", "mr": "Marathi", "ta": "Tamil"}
SAY = {
    "en": ["The officer shall keep a copy of the award.", "No permit may be issued without the approval of the board.", "It is due to the department from the vendor."],
    "hi": ["अधिकारी के द्वारा प्रति जमा की जाएगी।", "समिति की ओर से सूचना जारी की गई है।", "शुल्क के बाद आवेदन मान्य नहीं होगा।", "samiti ke dwara soochna jari kiya gaya hai.", "shulk ke baad aavedan manya nahin hoga."],
    "kn": ["ಅಧಿಕಾರಿಗಳು ಪ್ರತಿಯನ್ನು ಇಟ್ಟುಕೊಳ್ಳಬೇಕು.", "ಸಮಿತಿ ಮೂಲಕ ಸೂಚನೆ ಹೊರಡಿಸಲಾಗಿದೆ.", "ಶುಲ್ಕ ಮತ್ತು ಅರ್ಜಿ ನಂತರ ಮಾನ್ಯವಾಗುವುದಿಲ್ಲ."],
    "mr": ["अधिकारी यांच्या वतीने प्रत जमा करावी लागेल.", "समिती आणि बाजार यांच्यासाठी सूचना जारी करण्यात आली आहे.", "अर्ज च्या आत शुल्क ग्राह्य धरले जाणार नाही."],
    "ta": ["அதிகாரி மூலம் பிரதி சமர்ப்பிக்கப்பட வேண்டும்.", "குழு மற்றும் துறை குறித்து அறிவிப்பு வெளியிடப்படும்.", "கட்டணம் மீது விண்ணப்பம் செல்லாது படி."],
}


def sample():
    rng = random.Random(1)
    return [(" ".join(rng.choice(SAY[c]) for _ in range(6)), c) for c in CODES for _ in range(30)]


FIELD = L.fit(sample(), sorted(CODES))


def test_held_out_sentences():
    for c, said in SAY.items():
        for s in said:
            assert [x[2] for x in L.stretches([s], FIELD)[0]] == [c], s


def test_stretches_and_confidence():
    text = f"{SAY['en'][0]} {SAY['en'][1]} {SAY['kn'][1]}\n\n{SAY['hi'][3]} {SAY['hi'][0]} {SAY['mr'][1]}"
    got = L.stretches([text, None, "", "12 34"], FIELD)
    assert [x[2] for x in got[0]] == ["en", "kn", "hi", "mr"]
    assert all(0.5 < x[3] <= 1 for x in got[0]) and text[got[0][1][0] : got[0][1][1]] == SAY["kn"][1]
    assert got[1:] == [[], [], []]


def test_single_words_and_layout_make_no_stretch():
    assert [x[2] for x in L.stretches(["The permit known as Josupura (ಅರ್ಜಿ) shall be kept by the board. " + SAY["en"][0]], FIELD)[0]] == ["en"]
    assert [x[2] for x in L.stretches([SAY["kn"][1] + " " + SAY["kn"][2] + "\n\nSd/-\nUnder Secretary to Government"], FIELD)[0]] == ["kn"]
    page = "\n".join(["THE STATE GAZETTE", SAY["kn"][1], SAY["kn"][2], "- 4 -"] * 3)
    assert {x[2] for x in L.stretches([page], FIELD)[0]} == {"kn"}


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en", "EN", "en-IN", "eng", "English ", "hi_IN", "hin", "xx", "", "-", None, "und")], "lang string")
    assert [r[0] for r in df.select(L.named(F.col("lang"), CODES)).collect()] == ["en"] * 5 + ["hi"] * 2 + [None] * 5


def test_table(records):
    long_ = " ".join(SAY["en"]) * 300
    rows = [(i, t, "s", c) for i, (t, c) in enumerate(sample())] + [(900, None, "s", "en"), (901, "", "s", None), (902, long_, "s", "kn"), (902, long_, "s", "kn")]
    got = L.language_stretches(records(rows), "rec_id", "text", "lang", CODES)
    seen = {r.id: r for r in got.collect()}
    assert 900 not in seen and 901 not in seen and seen[902].doc_lang == "en" and seen[902].label == "kn"
    assert sum(seen[i].doc_lang == c for i, (_, c) in enumerate(sample())) == len(sample())
    assert L.language_stretches(records([]), "rec_id", "text", "lang", CODES).count() == 0


def mixed(rng, labels, n):
    """Sentences of two languages that have three of four words in common."""
    both = [f"का{chr(0x915 + i)}{chr(0x915 + j)}" for i in range(12) for j in range(6)]
    own = {"hi": [f"है{chr(0x915 + i)}" for i in range(20)], "mr": [f"आहे{chr(0x915 + i)}" for i in range(20)]}
    out = []
    for _ in range(n):
        k = rng.choice(labels)
        s = [rng.choice(both) for _ in range(9)] + [rng.choice(own[k]) for _ in range(3)]
        rng.shuffle(s)
        out.append((s, k))
    return out


def test_transitions_carry_the_language():
    import numpy as np

    rng = random.Random(3)
    field = L.fit([(" ".join(s) + ".", k) for s, k in mixed(rng, ["hi", "mr"], 300)], ["hi", "mr"])
    still = L.Field(field.labels, field.weights, np.zeros_like(field.moves))
    held = [mixed(rng, ["hi", "mr"], 2) for _ in range(100)]
    gold = [[k for s, k in parts for _ in s] for parts in held]

    def right(f):
        got = f.posteriors([[w for s, _ in parts for w in s] for parts in held])
        return sum(f.labels[i].partition("-")[0] == k for p, ks in zip(got, gold) for i, k in zip(p.argmax(axis=1), ks)) / sum(map(len, gold))

    assert right(field) > 0.93 and right(still) < 0.8
    assert all(field.moves[i, i] > field.moves[i, j] for i in range(3) for j in range(3) if i != j and {i, j} <= {field.labels.index("hi"), field.labels.index("mr")})


def test_gradients_are_those_of_the_likelihood():
    """Expected changes and posteriors against all paths of a short sequence."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    p, changes = L.forward_backward(scores, np.array([5]), moves)
    want_p, want_c, total = np.zeros((5, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=5):
        m = np.exp(sum(scores[i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total += m
        for i, k in enumerate(path):
            want_p[i, k] += m
        for a, b in itertools.pairwise(path):
            want_c[a, b] += m
    assert np.allclose(p, want_p / total) and np.allclose(changes, want_c / total)
