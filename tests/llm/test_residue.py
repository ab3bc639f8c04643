import random

import numpy as np
import pytest

from quillspark.llm import residue as R

PROSE = ["The Licensing Officer shall keep a copy of the award. [Omitted by order FD/1/2 with effect from 1 May 1990.] {See section 4 and Table 2.} Name: ____________ Rs. 5% of 10% (KLB) The template of the form shall enable script in any language. Access is denied to a vessel after sunset. Survey number 404 is not found in the register."] * 40
MODEL = R.fit(PROSE)


def spans(text):
    return R.localise([text], MODEL)[0][0]


@pytest.mark.parametrize("text", ["{{name}}", "The {{ place }} Act", "[[ACT_TITLE]]", "<<date>>", "@@amount@@", "${ref_no}", "%ACT_TITLE%", "%(section)s", "#PLACE#", "XX-SECTION-XX", "[INSERT DATE]", "<AMOUNT here>", "{DATE}", "[ref_no to be filled]", "Untitled Document", "Lorem ipsum dolor sit amet", "404 Not Found", "Please enable JavaScript to view this document.", "Error establishing a database connection"])
def test_residue(text):
    assert spans(text)
    if len(text) > 24 or not text[0].isalnum():  # within prose a notice is a sentence, a placeholder has its marks
        assert spans(f"{PROSE[0]} {text} {PROSE[0]}")


@pytest.mark.parametrize("text", [None, "", "abc", PROSE[0], PROSE[0].upper(), "[12]", "{See clause (b).}", "(etc.)", "$5 and $6", "Item #4 and #5", "a < b and c > d"])
def test_content(text):
    assert not spans(text)


def test_place_and_coverage():
    text = PROSE[0] + " Please enable JavaScript to view this document. " + PROSE[0]
    (a, b), *rest = spans(text)
    assert not rest and abs(a - len(PROSE[0])) < 12 and abs(b - a - 48) < 20
    _, coverage = R.localise(["Please enable JavaScript to view this document.", text, None], MODEL)
    assert coverage[0] > 0.9 and 0 < coverage[1] < 0.2 and coverage[2] == 0


def test_neighbours_do_not_mix():
    got, _ = R.localise(["A copy of the award", "Lorem ipsum dolor sit amet", "x", "", None, "A copy of the award"], MODEL)
    assert [bool(g) for g in got] == [False, True, False, False, False, False]


def test_table(records):
    rows = [(1, "Untitled Document", None, None), (1, "Untitled Document", None, None), (2, None, "s", "en"), (3, "", "s", "en"), (4, PROSE[0] * 500, "s", "en")]
    assert [(r.id, r.field) for r in R.find_residue(records(rows), "rec_id", {"text": "text", "lang": "lang"}).collect()] == [(1, "text")] * 2
    assert R.find_residue(records([]), "rec_id", {"text": "text"}).count() == 0


def test_copies_of_a_page_are_no_prose(records):
    page = "The page you are looking for does not exist or has been moved. Please enable JavaScript and try again later or go back to the home page."
    prose = [f"Order {i}: the Licensing Officer of ward {i * 7} shall keep a copy of the award and enter the vessel in the register after sunset." for i in range(100)]
    own = [(i, t, "s", "en") for i, t in enumerate(prose)]
    many = [(1000 + i, page, "s", "en") for i in range(3000)]
    want = R.fit_on(records([*own, many[0]]), {"text": "text"})
    got = R.fit_on(records(many + own), {"text": "text"})
    same = lambda a, b: np.array_equal(a, b, equal_nan=True)
    assert same(got, want) and same(got, R.fit_on(records(own + many), {"text": "text"}))
    assert {r.id for r in R.find_residue(records(many + own), "rec_id", {"text": "text"}).collect()} == {i for i, *_ in many}


#: Notices and filler that no phrase of the model was written from.
HELD_OUT = [
    'This page is gone for good',
    'Your connection is not private',
    'TODO: write this section',
    'Verify you are human by completing the action below.',
    'This webpage is not available at the moment, kindly retry afterwards.',
    "We couldn't find what you were looking for.",
    'Hmm, that page has gone missing.',
    'The portal is undergoing routine upkeep and will return shortly.',
    'Sorry, we are having trouble loading this content right now.',
    'To continue, switch on JavaScript in the options of your web browser.',
    "This feature won't run unless scripts are permitted.",
    'Cookies are switched off; turn them on to sign in.',
    'Our systems detected too much traffic from your computer.',
    'The download link you followed is dead.',
    'You must be signed in to open this document.',
    'An unhandled exception was thrown while processing your request.',
    'Unable to establish connection to the remote host.',
    'Reached the maximum number of retries, giving up.',
    'Server returned an empty response.',
    'The token provided has expired, please authenticate again.',
    'This is some dummy copy to fill the layout.',
    'Put a short description of the item here.',
    'Enter your heading and body copy in this box.',
    'Insert paragraph text at this point.',
    'Lorem ipsum sit amet magna consectetur quis nostrud tempor.',
    'This space reserved for future content.',
    'Page under development, come back later.',
    'Nothing has been published on this page yet.',
    'Add the introduction here before publishing.',
    'example example example heading',
    'The video player requires a newer browser version.',
    'If you are not redirected automatically, follow this link.',
    'Please disable your ad blocker and reload.',
    'We use cookies to improve your browsing experience.',
    'Error loading data from the API endpoint.',
    'Sorry, an internal problem stopped the page from being shown.',
    'Timed out waiting for the database server to reply.',
    'Your login attempt failed, check the password and retry.',
    "404 - we can't seem to find that file",
    'Failed to fetch resource: network unreachable',
    'पृष्ठ लोड नहीं हो सका, कृपया दोबारा प्रयास करें',
    'यह वेबसाइट अभी उपलब्ध नहीं है',
    'ಪುಟವನ್ನು ತೆರೆಯಲು ಸಾಧ್ಯವಾಗಲಿಲ್ಲ, ದಯವಿಟ್ಟು ಮತ್ತೆ ಪ್ರಯತ್ನಿಸಿ',
    'பக்கத்தை ஏற்ற முடியவில்லை, மீண்டும் முயற்சிக்கவும்',
    'पान लोड होऊ शकले नाही, कृपया पुन्हा प्रयत्न करा',
]


def test_held_out_notices(spark):
    assert not {h.lower().rstrip(".") for h in HELD_OUT} & {x.lower().rstrip(".") for x in R.seeds()}
    records = spark.read.parquet("/root/testdata/sf0.01/aiscript.parquet")
    model = R.fit_on(records, {"text": "full_text_content"})
    alone = sum(bool(x) for x in R.localise(HELD_OUT, model)[0]) / len(HELD_OUT)
    texts = [r[0] for r in records.select("full_text_content").filter("length(full_text_content) > 1500").orderBy("rec_id").collect()]
    clean = [t for t, s in zip(texts, R.localise(texts, model)[0]) if not s]
    assert len(clean) > 0.8 * len(texts)
    around = random.Random(3).sample(clean, len(HELD_OUT))
    inside = sum(bool(x) for x in R.localise([f"{t[:700]} {h} {t[700:1400]}" for t, h in zip(around, HELD_OUT)], model)[0]) / len(HELD_OUT)
    print(alone, inside)
    assert alone >= 0.8 and inside >= 0.7
