"""Template residue and error-page text: placeholders, filler, error pages, script notices.

Two character n-gram models are fitted. That of residue is fitted on ``seeds``: general phrases of
error pages, script notices and filler, combined from short parts and from the standard HTTP
statuses and system errors; none is taken from a table. That of natural prose is fitted on all of
the table's own texts: 4-grams and 3-grams are counted into ``2 ** BITS`` buckets by partial
aggregates, texts that are equal once, and without what a first pass with the seeds alone marks as
residue (stretches of ``STRETCH`` characters, and the whole text where ``MOSTLY`` of it is marked; a single window of
prose may by chance hold the seeds' 4-grams only). The log-likelihood ratio of each 4-gram (of its
3-gram where residue does not have it) is summed over sliding windows of two lengths; windows above
their threshold localise residue, and their union over the
text's length is its coverage. Unfilled placeholders are too short for a window: text within
a pair of placeholder marks is a candidate, and a candidate with marks that prose uses too
(brackets, braces, angles) counts if its own n-grams are likelier under the model of field
names than under that of prose notes.

A value is residue if it has a window or a placeholder.

Defined results
    null and empty values have no residue; texts of fewer than four characters have no
    4-gram and none either; a repeated row is judged each time; extra columns stay as they
    are; an empty table fits on the seeds alone and gives an empty result.
"""

from __future__ import annotations

import errno
import os
import re
from collections.abc import Iterator
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._arrow import blocks, map_blocks
from quillspark.llm._buckets import BROADCAST_ROWS
from quillspark.llm._hashing import U, codes, mix
from quillspark.session import cut, spread

GRAM = 4
BITS = 18
#: Characters of the windows, and the nats that each of their 4-grams must give on average.
WINDOWS = ((28, 1.1), (44, 0.6))
#: The same in the first pass, where a 4-gram of residue gives about two nats.
FIRST_WINDOWS = ((28, 2.4),)
PAD = max(w for w, _ in WINDOWS)
#: A text that the first pass covers to this part is no prose, nor is a stretch of so many characters that it marks.
MOSTLY, STRETCH = 0.5, 56
#: Most that a 3-gram counts for a 4-gram that residue does not have, what it loses for that, and the most that an unseen 3-gram counts.
BACKED, BACK_OFF, UNSEEN = 1.5, 0.5, -1.0

#: General language of error pages, script notices and filler: parts that ``seeds`` combines.
THINGS = "page,document,file,link,resource,site,website,address,URL,item,viewer,service,server,database,application,request,session,content".split(",")
FAULTS = (
    "could not be found,was not found,cannot be displayed,cannot be opened,is not available,is temporarily unavailable,is currently unavailable,does not exist,no longer exists,has been removed,has been deleted,has moved,"
    "failed to load,did not load,has expired,is down for maintenance,did not respond,took too long to respond,is blocked,is broken,is invalid,was rejected,was refused,could not be reached,is overloaded"
).split(",")
REMEDIES = (
    "Please try again later.|Please retry in a few minutes.|Please wait and try again.|Refresh the page.|Reload this page.|Go back to the previous page.|Return to the home page.|Go to the homepage.|Contact the administrator.|Contact the webmaster.|Contact support if the problem continues."
    "|Check the address and try again.|Check your internet connection.|Log in to continue.|Please log in again.|Sign in to your account.|Use the search box.|Click here to go back.|Report this problem.|We apologise for the inconvenience.|Sorry for the inconvenience."
).split("|")
TROUBLE = (
    "An error occurred.|An unexpected error has occurred.|Something went wrong.|Sorry, something has gone wrong.|Oops!|Whoops!|Fatal error|Unknown error|Internal error|Network error|Runtime error|Server error in application|Application error|Database connection failed|Unable to connect to the database|Error connecting to the server"
    "|Connection timed out|Connection refused|Connection reset|The request timed out.|Upstream timeout while waiting for a response|Proxy error|DNS lookup failed|Too many requests|Rate limit exceeded|Your session has timed out.|Session expired|You have been logged out.|Login required|Access denied|Access is restricted"
    "|You do not have permission to view this page.|You are not authorized to view this resource.|Permission denied|Your IP address has been blocked.|Unusual traffic from your network|Request ID:|Reference number of this error:|Incident ID:|Error code:|Trace ID:|Stack trace|Exception in thread|File not found|No such file or directory"
    "|Directory listing denied|Bad request|Invalid request|Invalid URL|The certificate is not trusted|Your connection is not secure|The page isn't redirecting properly|Site under maintenance|We will be back soon|Down for scheduled maintenance"
).split("|")
SCRIPTS = (
    "JavaScript is disabled in your browser.|Please enable JavaScript|Please enable JavaScript in your browser settings.|Enable JavaScript and reload the page.|JavaScript must be enabled|This website requires JavaScript.|This app works best with JavaScript enabled.|JavaScript required|Turn on JavaScript to use this site.|Scripts are disabled|Scripting is turned off|Allow scripts to run"
    "|Active scripting must be allowed.|Please allow scripts and cookies.|Cookies are disabled|Cookies must be enabled|Accept all cookies|Your browser is not supported.|Your browser is out of date.|Please update your browser.|Please upgrade your browser|Unsupported browser|Your browser does not support frames.|Your browser does not support video.|<noscript></noscript>"
    "|Loading...|Loading, please wait|Please wait while the page loads|Please wait...|Redirecting|You are being redirected|One moment please|Checking that you are human|Verify you are not a robot|Complete the security check|Solve the captcha|Security check of your browser|Plugin is required to view this content|Install the viewer to open this document"
).split("|")
FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat."
    " Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
    "|Lorem ipsum|The quick brown fox jumps over the lazy dog.|asdf asdf asdf|asdf qwerty|qwerty qwerty|asdfghjkl|xxxx xxxx xxxxx|xxxxxxxxxx|test test test|testing testing|test document|this is a test|foo bar baz|abc abc abc|blah blah blah|123 test"
    "|Sample text|Sample title|Sample document|Dummy text|Dummy content|Placeholder text|Placeholder|Example text|Filler text|Default title|Your text here|Your title here|Your content here|Add text here|Add a title|Add your text|Click to add title|Click to edit|Double click to edit|Enter text here|Enter your text|Enter a title|Type here|Type your text here"
    "|Insert text here|Insert title|Insert name here|Replace this text|Edit this text|Put your text here|Write something|Title goes here|Text goes here|Content goes here|Content to be added|To be added|To be completed|To be filled|To be announced|To be updated|TBD|TBA|TODO|Coming soon|Content will be available soon|This page is being prepared"
    "|Under construction|This page is under construction|Work in progress|Page intentionally left blank|No content|No title|Untitled|Untitled document|Untitled page|New document|New page|Blank page|Title of the document|Document title|Page title|Heading|Subheading|Draft text"
).split("|")
#: The same in other languages.
FOREIGN = (
    "पेज नहीं मिला|पृष्ठ नहीं मिला|यह पृष्ठ उपलब्ध नहीं है|पृष्ठ मौजूद नहीं है|दस्तावेज़ नहीं खुल सका|त्रुटि हुई|सर्वर त्रुटि|कुछ गड़बड़ हो गई|कृपया बाद में पुनः प्रयास करें|कृपया फिर से प्रयास करें|कृपया पता जाँच लें|कृपया प्रतीक्षा करें|लोड हो रहा है|पहुँच अस्वीकृत|सत्र समाप्त|फिर से लॉग इन करें|जावास्क्रिप्ट चालू करें|कृपया जावास्क्रिप्ट सक्षम करें|इस साइट के लिए जावास्क्रिप्ट आवश्यक है|अपना ब्राउज़र अपडेट करें|ब्राउज़र समर्थित नहीं है|यहाँ पाठ लिखें|नमूना पाठ|जल्द आ रहा है"
    "|पान सापडले नाही|पृष्ठ सापडले नाही|हे पृष्ठ उपलब्ध नाही|दस्तऐवज उघडता आला नाही|त्रुटी आली|सर्व्हर त्रुटी|काहीतरी चूक झाली|कृपया नंतर पुन्हा प्रयत्न करा|कृपया पुन्हा प्रयत्न करा|कृपया प्रतीक्षा करा|लोड होत आहे|प्रवेश नाकारला|सत्र संपले|पुन्हा लॉग इन करा|जावास्क्रिप्ट सुरू करा|कृपया जावास्क्रिप्ट सक्षम करा|या साइटसाठी जावास्क्रिप्ट आवश्यक आहे|ब्राउझर समर्थित नाही|येथे मजकूर लिहा|नमुना मजकूर|लवकरच येत आहे"
    "|ಪುಟ ಸಿಗಲಿಲ್ಲ|ಪುಟ ಕಂಡುಬಂದಿಲ್ಲ|ಈ ಪುಟ ಲಭ್ಯವಿಲ್ಲ|ದಾಖಲೆ ತೆರೆಯಲಾಗಲಿಲ್ಲ|ದೋಷ ಸಂಭವಿಸಿದೆ|ಸರ್ವರ್ ದೋಷ|ಏನೋ ತಪ್ಪಾಗಿದೆ|ದಯವಿಟ್ಟು ನಂತರ ಪ್ರಯತ್ನಿಸಿ|ದಯವಿಟ್ಟು ಮತ್ತೊಮ್ಮೆ ಪ್ರಯತ್ನಿಸಿ|ದಯವಿಟ್ಟು ನಿರೀಕ್ಷಿಸಿ|ಲೋಡ್ ಆಗುತ್ತಿದೆ|ಪ್ರವೇಶ ನಿರಾಕರಿಸಲಾಗಿದೆ|ಅವಧಿ ಮುಗಿದಿದೆ|ಮತ್ತೆ ಲಾಗಿನ್ ಮಾಡಿ|ಜಾವಾಸ್ಕ್ರಿಪ್ಟ್ ಆನ್ ಮಾಡಿ|ದಯವಿಟ್ಟು ಜಾವಾಸ್ಕ್ರಿಪ್ಟ್ ಸಕ್ರಿಯಗೊಳಿಸಿ|ಈ ತಾಣಕ್ಕೆ ಜಾವಾಸ್ಕ್ರಿಪ್ಟ್ ಅಗತ್ಯವಿದೆ|ಬ್ರೌಸರ್ ಬೆಂಬಲಿತವಾಗಿಲ್ಲ|ಇಲ್ಲಿ ಪಠ್ಯ ಬರೆಯಿರಿ|ಮಾದರಿ ಪಠ್ಯ|ಶೀಘ್ರದಲ್ಲೇ ಬರಲಿದೆ"
    "|பக்கம் கிடைக்கவில்லை|பக்கம் காணப்படவில்லை|இந்தப் பக்கம் கிடைக்கவில்லை|ஆவணத்தைத் திறக்க முடியவில்லை|பிழை ஏற்பட்டது|சேவையகப் பிழை|ஏதோ தவறு நடந்துவிட்டது|பின்னர் மீண்டும் முயற்சிக்கவும்|தயவுசெய்து மீண்டும் முயலவும்|காத்திருக்கவும்|ஏற்றப்படுகிறது|அணுகல் மறுக்கப்பட்டது|அமர்வு முடிந்தது|மீண்டும் உள்நுழையவும்|ஜாவாஸ்கிரிப்டை இயக்கவும்|ஜாவாஸ்கிரிப்ட் தேவை|இந்தத் தளத்திற்கு ஜாவாஸ்கிரிப்ட் தேவை|உலாவி ஆதரிக்கப்படவில்லை|இங்கே உரையை எழுதவும்|மாதிரி உரை|விரைவில் வருகிறது"
).split("|")


#: Names of template fields.
FIELDS = ("name", "title", "date", "place", "amount", "section", "year", "number", "address", "act title", "title of the act", "ref no", "reference number", "officer name", "officer.name", "department name", "issuing authority", "year of act", "your name here", "signature", "value", "text", "type", "field")


def seeds() -> list[str]:
    """Phrases of filler, error pages and script notices, combined from the parts above and from the standard statuses and system errors."""
    out = [*TROUBLE, *SCRIPTS, *REMEDIES, *FILLER, *FOREIGN]
    for f in FIELDS:
        out += [f"Sample {f}", f"Sample {f.title()}", f"Enter {f} here", f"Enter your {f}", f"{f.capitalize()} goes here", f"Insert {f}"]
    for k, fault in enumerate(FAULTS):
        for j in range(3):
            thing = THINGS[(k * 3 + j) % len(THINGS)]
            lead = (f"The {thing}", f"This {thing}", f"The requested {thing}", f"The {thing} you requested", f"The {thing} you are looking for", f"Sorry, the {thing}")[(k + j) % 6]
            out.append(f"{lead} {fault}. {REMEDIES[(k + j) % len(REMEDIES)]}")
    for h in HTTPStatus:
        if h >= 400:
            out += [f"{h.value} {h.phrase}", f"Error {h.value}: {h.phrase}", f"HTTP {h.value} {h.phrase}", f"HTTP status {h.value}", f"{h.phrase}. {h.description}" if h.description else h.phrase]
    out += sorted({os.strerror(e) for e in (errno.ENOENT, errno.EACCES, errno.EPERM, errno.ECONNREFUSED, errno.ECONNRESET, errno.ETIMEDOUT, errno.EHOSTUNREACH, errno.ENETUNREACH, errno.EPIPE, errno.EIO)})
    return out


#: Marks that only templates use, then marks that prose uses too.
_STRONG = re.compile(
    r"\{\{\s*[^\W\d][\w. -]{0,48}\s*\}\}|\[\[\s*[^\W\d][\w. -]{0,48}\s*\]\]|<<\s*[^\W\d][\w. -]{0,48}\s*>>|@@[^\W\d][\w. -]{0,48}@@"
    r"|\$\{[^\W\d][\w. -]{0,48}\}|%\([^\W\d][\w. -]{0,48}\)s|%[A-Za-z][A-Za-z_.]*(?: [A-Za-z_.]+){0,3}%|#[A-Za-z][A-Za-z_.]*(?: [A-Za-z_.]+){0,3}#|\bXX-[A-Za-z][\w. ]{0,48}-XX\b|__[A-Za-z][A-Za-z.]*(?:[_ ][A-Za-z.]+){0,4}__"
)
_WEAK = re.compile(r"\[([^\W\d][\w. ]{1,48})\]|\{([^\W\d][\w. ]{1,48})\}|<([^\W\d/][\w. ]{1,48})>")


def _grams(c: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Bucket of each run of ``n`` code points; letters' case is kept."""
    c = c.astype(U)
    m = len(c) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    acc = np.zeros(m, U)
    for k in range(n):
        acc = acc * U(0x9E3779B97F4A7C15) + c[k : k + m] + U(1)
    return (mix(acc) >> U(64 - BITS)).astype(np.int64)


def _counts(texts: list[str]) -> np.ndarray:
    """4-gram and 3-gram counts; digits are one symbol."""
    out = np.zeros((2, 1 << BITS))
    for t in texts:
        c = _plain(codes(t))
        for k in (0, 1):
            out[k] += np.bincount(_grams(c, GRAM - k), minlength=1 << BITS)
    return out


def _plain(c: np.ndarray) -> np.ndarray:
    """Digits as one symbol."""
    return np.where((c >= 48) & (c <= 57), np.uint32(48), c)


def fit(prose: list[str]) -> np.ndarray:
    """The model against some prose."""
    return _ratio(_counts(["\n".join(prose[i : i + 256]) for i in range(0, len(prose), 256)]))


def _ratio(natural: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios, residue against prose: of 4-grams (NaN where residue has none) and of 3-grams, to which those fall back."""
    own = _counts(seeds())
    part = [np.log(np.maximum(own[k], 0.02) / max(own[k].sum(), 1)) - np.log((natural[k] + 0.5) / max(natural[k].sum(), 20_000)) for k in (0, 1)]
    four = np.where(own[0] > 0, np.clip(part[0], -6, 6), np.nan)
    three = np.where(own[1] > 0, np.clip(part[1], -6, BACKED) - BACK_OFF, np.minimum(part[1], UNSEEN))
    return np.stack([four, np.clip(three, -6, 6)]).astype(np.float32)


def scores(c: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The ratio of the 4-gram at each place."""
    out = model[0][_grams(c)]
    back = np.flatnonzero(np.isnan(out))
    if len(back):
        out[back] = model[1][_grams(c, GRAM - 1)[back]]
    return out


def _field_grams(texts: list[str]) -> dict[str, float]:
    out: dict[str, float] = {}
    for t in texts:
        t = f"^{t.lower()}$"
        for i in range(len(t) - 2):
            out[t[i : i + 3]] = out.get(t[i : i + 3], 0) + 1
    return out


_NAMES = _field_grams([f.replace(" ", x) for f in FIELDS for x in (" ", "_")] + [f"insert {f}" for f in FIELDS] + [f"{f} here" for f in FIELDS] + [f"{f} to be filled" for f in FIELDS])
_NAMES_TOTAL = sum(_NAMES.values())


def _is_field(inner: str) -> bool:
    """Whether most 3-grams are those of field names rather than of notes."""
    inner = inner.strip()
    if re.search(r"(?i)^(insert|enter|your) |[\w ]+ (here|to be filled)$", inner) or "_" in inner or re.fullmatch(r"[A-Za-z]+\.[A-Za-z]+", inner):
        return True
    t = f"^{inner.lower()}$"
    grams = [t[i : i + 3] for i in range(len(t) - 2)]
    score = sum(np.log((_NAMES.get(g, 0) + 0.01) / _NAMES_TOTAL) - np.log(1 / 8000) for g in grams)
    return bool(grams) and score > 0


def placeholders(text: str) -> list[tuple[int, int]]:
    """Spans of unfilled placeholders."""
    out = [m.span() for m in _STRONG.finditer(text)]
    out += [m.span() for m in _WEAK.finditer(text) if _is_field(next(g for g in m.groups() if g is not None))]
    return out


_MARKS = re.compile(r"[\[{<@$%#]|XX-|__[A-Za-z]")


def localise(texts: list[str | None], model: np.ndarray, windows: tuple[tuple[int, float], ...] = WINDOWS) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """The residue spans of each text and the part of the text that they cover."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    coverage = np.zeros(len(texts))
    have = [i for i, t in enumerate(texts) if t]
    if not have:
        return spans, coverage
    pad = "\0" * PAD
    c = codes(pad.join(texts[i] for i in have) + pad)
    sizes = np.array([len(texts[i]) for i in have], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + PAD)])[:-1]
    score = scores(_plain(c), model)
    empty = c == 0
    score[empty[: len(score)] | empty[1 : len(score) + 1] | empty[2 : len(score) + 2] | empty[3 : len(score) + 3]] = 0
    total = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    gaps = np.repeat(starts + sizes, PAD) + np.tile(np.arange(PAD), len(sizes))
    for width, level in windows:
        w = min(width - GRAM + 1, len(score))
        window = total[w:] - total[:-w]
        own = np.minimum(sizes - GRAM + 1, w)  # a text shorter than a window is one window
        bar = np.repeat(level * np.maximum(own, 1), sizes + PAD)
        bar[gaps] = np.inf  # no window starts between texts
        hits = np.flatnonzero(window > bar[: len(window)])
        if len(hits):
            which = np.searchsorted(starts, hits, side="right") - 1
            new = np.concatenate([[True], (hits[1:] > hits[:-1] + w) | (which[1:] != which[:-1])])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(hits)]]) - 1
            for a, b, k in zip(hits[first], hits[last], which[first]):
                # the outer windows' ends go where the sum is largest
                a_, b_ = a + int(total[a : a + w].argmin()), b + 1 + int(total[b + 1 : b + 1 + w].argmax())
                spans[have[k]].append((int(a_ - starts[k]), int(min(max(b_, a_ + 1) + GRAM - 1 - starts[k], sizes[k]))))
    for i in have:
        if _MARKS.search(texts[i]):
            spans[i] += placeholders(texts[i])
        if spans[i]:
            merged: list[tuple[int, int]] = []
            for a, b in sorted(spans[i]):
                if merged and a <= merged[-1][1]:
                    merged[-1] = merged[-1][0], max(b, merged[-1][1])
                else:
                    merged.append((a, b))
            spans[i] = merged
            coverage[i] = sum(b - a for a, b in merged) / len(texts[i])
    return spans, coverage


def _prose(texts: list[str], seeds_only: np.ndarray) -> list[str]:
    """What the first pass leaves of texts as prose."""
    out: list[str] = []
    for t, spans, part in zip(texts, *localise(texts, seeds_only, FIRST_WINDOWS)):
        if part >= MOSTLY:
            continue
        at = 0
        for a, b in sorted(spans):
            if b - a < STRETCH:
                continue
            if a > at:
                out.append(t[at:a])
            at = max(at, b)
        out.append(t[at:])
    return out


def fit_on(records: DataFrame, text_cols: dict[str, str]) -> np.ndarray:
    """The model fitted on all different values of the columns."""
    seeds_only = fit([])
    values = spread(records.select(*[F.col(p).cast("string").alias(f"f{k}") for k, p in enumerate(text_cols.values())]))
    texts = values.select(F.explode(F.array(*values.columns)).alias("text")).filter(F.length("text") >= GRAM).withColumn("digest", F.xxhash64("text"))
    # only texts that have copies are shuffled, one of each task
    copied = cut(texts.groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1").select("digest"))
    if copied.count() <= BROADCAST_ROWS:
        copied = F.broadcast(copied)
    once = texts.join(copied, "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("text"))
    different = texts.join(copied, "digest", "left_anti").select("text").union(once.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << BITS, dtype=np.int64)
        for (block,) in blocks(batches, 0):
            total += _counts(["\n".join(_prose(block, seeds_only))]).astype(np.int64).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = different.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    natural = np.zeros(2 << BITS)
    natural[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return _ratio(natural.reshape(2, -1))


_FOUND = pa.schema([("id", pa.int64()), ("field", pa.string()), ("coverage", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def find_residue(records: DataFrame, id_col: str, text_cols: dict[str, str]) -> DataFrame:
    """``id, field, coverage, spans`` of the values with residue. ``text_cols``: field name to column path."""
    model = fit_on(records, text_cols)
    names = list(text_cols)
    rows = spread(records.select(F.col(id_col).cast("bigint").alias("id"), *[F.col(p).cast("string").alias(f"f{k}") for k, p in enumerate(text_cols.values())]))

    def kernel(ids: list, *columns: list) -> list:
        out: list[tuple] = []
        for name, texts in zip(names, columns[:-1]):
            spans, coverage = localise(texts, model)
            out += [(i, name, float(p), [{"start": a, "stop": b} for a, b in sorted(s)]) for i, s, p in zip(ids, spans, coverage) if s]
        return [list(x) for x in zip(*out)] if out else [[], [], [], []]

    rows = rows.withColumn("all", F.concat(*[F.coalesce(f"f{k}", F.lit("")) for k in range(len(names))]))  # blocks are cut by its length
    return map_blocks(rows, "all", kernel, "id bigint, field string, coverage double, spans array<struct<start:int,stop:int>>", _FOUND)
