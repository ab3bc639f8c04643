"""Noise of scanned pages: line labelling, broken words, misread characters, paragraphs.

Lines are labelled header, page number, body or break by a linear-chain conditional model of
layout features (``layout``), decoded by Viterbi over the lines of a text. Its weights are fitted by
forward-backward gradients on pages made of texts of the table, drawn by hash, whose labels are known
as they are made (``made_pages``); they start from ``PRIOR`` and are drawn to it. Page numbers are candidates in a run (the next page has the next
number); headers are title lines that return at page tops, digits and misread letters aside.

Misread characters are judged against exact counts of all words of all texts, by ratios alone: a word is misread if
undoing a confusion of ``CONFUSIONS`` gives a word that is ``DOMINANCE`` times as frequent (two of them:
``TWICE`` times), or if a word of letters holds one digit or sign in place of a letter. Nothing depends on how
large the table is: rows that all come k times give the same verdicts. The counts stay a table; words that texts
ask about are judged once each by joins with it, and only hits of a bitmap of fixed size are joined back.

``repair`` reassembles paragraphs: headers and page numbers go, broken words are joined,
misread words are restored where one frequent word fits, wrapped lines are joined.

Defined results
    null and empty texts have no noise and are repaired to themselves; a text of one line can
    only have misread characters; repeated rows are judged each time; an empty table gives an
    empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
import re
import textwrap
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._arrow import blocks, map_blocks
from quillspark.llm._buckets import _filter_words, _place
from quillspark.llm._chain import forward_backward
from quillspark.llm._digest import with_digest
from quillspark.session import cut, spread

BODY, HEADER, NUMBER, BREAK = range(4)
#: Part of all words that a word of ``word_counts`` is at least, so that it has at most ``1 / RATE`` words.
RATE = 3e-7
#: How many times as frequent as a misreading its reading is: with one place undone, with two, and with a sign in place of a letter.
DOMINANCE, TWICE, KNOWN = 30, 200, 20

#: What a misread spelling may stand for.
CONFUSIONS = (("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("b", "h"), ("h", "b"), ("ii", "u"), ("u", "ii"), ("n", "u"), ("u", "n"), ("li", "h"), ("ri", "n"))
SIGNS = {"0": "o", "1": "li", "5": "s", "6": "b", "8": "b", "9": "g", "|": "li", "!": "li", "$": "s", "@": "a", "ä": "a", "á": "a", "à": "a", "ö": "o", "ó": "o", "ü": "u", "ú": "u", "é": "e", "è": "e", "ë": "e", "í": "i", "ï": "i", "¢": "c", "€": "e", "£": "e"}
HYPHENS = "-‐‑­¬"

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_TOKEN_EDGE = ".,;:()[]{}\"'“”‘’।—–…?!"
_ODD = re.compile(r"^[A-Za-z]{0,24}[015689|!$@äáàöóüúéèëíï¢€£][A-Za-z]{1,24}$|^[A-Za-z]{2,24}[015689|!$@äáàöóüúéèëíï¢€£][A-Za-z]{0,24}$|^[A-Za-z]+[015689|!$äáöóüúéë][A-Za-z]+[015689|!$äáöóüúéë][A-Za-z]*$")
_ORDINAL = re.compile(r"^\d+(st|nd|rd|th|s)$|^[A-Za-z]+\d+$", re.I)
_BROKEN = re.compile(rf"[{HYPHENS}][ \t]*$")
_ENDS = re.compile(r"[.।?!:;][\"'”’)\]}]*\s*$")
_PAGE = re.compile(
    r"^(?P<lead>[-–—\[(|<*.\s]*)(?:(?P<word>page|pg|p|folio|पृष्ठ|पान|ಪುಟ|பக்கம்)\s*(?:no|number|सं|ಸಂ)?\s*[.:]?\s*)?(?P<no>\d{1,5}|[ivxlc]{1,7}|[IVXLC]{1,7})(?P<of>\s*(?:of|/|से|ರಲ್ಲಿ)\s*\d{1,5})?(?P<tail>[-–—\])|>*\s]*)$",
    re.I,
)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _roman(s: str) -> int:
    total, last = 0, 0
    for ch in reversed(s.lower()):
        v = _ROMAN[ch]
        total += v if v >= last else -v
        last = max(last, v)
    return total


def page_number(line: str) -> tuple[str, int] | None:
    """The form and the number of a line that can be a page number."""
    s = line.strip()
    if not s or len(s) > 32:
        return None
    m = _PAGE.match(s)
    if not m:
        return None
    no = m["no"]
    digits = no.isdecimal()
    value = int(no) if digits else _roman(no)
    form = f"{m['lead'].strip()}|{(m['word'] or '').lower()}|{'of' if m['of'] else ''}|{m['tail'].strip()}|{'d' if digits else 'r'}"
    return form, value


def _explicit(form: str) -> bool:
    lead, word, of, tail, _ = form.split("|") if form.count("|") == 4 else ("x", "", "", "", "")
    return bool(word or of or lead or tail)


def _shape(line: str) -> str:
    """A line with digits as one sign and letters that are often confused made equal."""
    parts = re.split(r"\s{2,}|\t", line.strip().lower())
    s = re.sub(r"\s+", " ", " ".join("#" if len(parts) > 1 and page_number(x) else x for x in parts))
    s = s.replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("ii", "u")
    return re.sub(r"[\d]+", "#", s.translate(_ALIKE))


_ALIKE = str.maketrans({"c": "e", "f": "t", "h": "b", "|": "i", "!": "i", "l": "i", "$": "s", "ä": "a", "ö": "o", "ü": "u"})


def _near(a: str, b: str) -> bool:
    """Whether two shapes differ in an eighth of their places at most."""
    if abs(len(a) - len(b)) > 2:
        return False
    return sum(x != y for x, y in zip(a, b)) <= max(1, len(a) // 8)


def _index(shapes: list[str]) -> Callable[[str], list[str]]:
    """For a shape those of ``shapes``, in their order, that can be near it.

    Of one piece more than the places that may differ one is equal, at its place.
    """
    lengths: dict[int, list[int]] = defaultdict(list)
    for i, b in enumerate(shapes):
        lengths[len(b)].append(i)
    pieces: dict[int, list[slice]] = {}
    index: dict[tuple[int, int, str], list[int]] = defaultdict(list)

    def alike(a: str) -> list[str]:
        n = len(a)
        if n not in pieces:
            parts, compared = max(1, n // 8) + 1, max(n - 2, 0)  # of a shorter shape the last two places are not compared
            pieces[n] = [slice(compared * k // parts, compared * (k + 1) // parts) for k in range(parts)]
            for size in range(n - 2, n + 3):
                for i in lengths.get(size, ()):
                    for k, piece in enumerate(pieces[n]):
                        index[n, k, shapes[i][piece]].append(i)
        return [shapes[i] for i in sorted({i for k, piece in enumerate(pieces[n]) for i in index.get((n, k, a[piece]), ())})]

    return alike


def _open(line: str) -> bool:
    """Whether a body line leaves its sentence unfinished."""
    return bool(line.strip()) and not _ENDS.search(line)


def _goes_on(line: str) -> bool:
    s = line.strip()
    return bool(s) and (s[0].islower() or s[0].isdigit() or s[0] in "(,;" or unicodedata.category(s[0]) in ("Lo", "Mn", "Mc"))


@dataclass(frozen=True)
class Weights:
    """What the linear conditional model of lines has learned: weights of the features of page numbers and of headers, the bias of body lines, and of label changes (rows from, columns to)."""

    number: np.ndarray
    header: np.ndarray
    body: float
    moves: np.ndarray


#: The weights that the fit starts from and is drawn to: number candidates (always; next numbers, 0 to 2; marks of their own; within a sentence; first or last line; from 1000 on without marks; roman without marks or next numbers),
#: headers (always; returns, 0 to 3; at a page top or near a number; within a sentence; capitals; ends like a sentence; over 80 signs; returns at all; shorter than wrapping explains, or not; titled; beside a blank line; ruled like a table row; returns never),
#: body lines, and changes between body, header, page number and break.
PRIOR = Weights(
    np.array([-1.5, 2.5, 2.0, 1.0, 1.0, -3.0, -3.0]),
    np.array([-3.0, 1.6, 1.2, 0.8, 0.8, -2.5, -1.5, 0.6, 2.0, -1.0, 0.8, 0.8, -4.0, -9.0]),
    0.5,
    np.array([[0.0, -1.0, -1.0, 0.0], [0.0, -2.0, 0.5, -0.5], [0.0, 0.5, -4.0, 0.0], [0.0, -0.5, -0.5, 0.0]]),
)
#: What a label scores where a line cannot have it: blank lines are breaks, and only lines that read as a number are page numbers.
NEVER = -12.0


@dataclass
class Layout:
    """The features of a text's lines; rows of lines that are no candidates are 0."""

    blank: np.ndarray
    is_number: np.ndarray
    number: np.ndarray
    header: np.ndarray
    plain: bool

    def scores(self, w: Weights) -> np.ndarray:
        out = np.full((len(self.blank), 4), NEVER)
        out[self.blank, BREAK] = 2.0
        out[~self.blank, BODY] = w.body
        out[self.is_number, NUMBER] = self.number[self.is_number] @ w.number
        titles = ~self.blank & ~self.is_number
        out[titles, HEADER] = self.header[titles] @ w.header
        return out


def layout(lines: list[str]) -> Layout:
    """The layout features of the lines of a text."""
    n = len(lines)
    full = [i for i in range(n) if lines[i].strip()]
    numbers = {i: p for i in full if (p := page_number(lines[i]))}
    groups: dict[str, list[int]] = defaultdict(list)
    for i in full:
        if i not in numbers and len(lines[i].strip()) <= 90:
            groups[_shape(lines[i])].append(i)
    # runs of page numbers: the next candidate of a form has the next number
    forms: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, (form, value) in numbers.items():
        forms[form].append((i, value))
    in_run: dict[int, int] = {}
    for seq in forms.values():
        for (i, v), (j, u) in zip(seq, seq[1:]):
            if 1 <= u - v <= 2:
                in_run[i] = in_run.get(i, 0) + 1
                in_run[j] = in_run.get(j, 0) + 1
    near_number = {i + k for i in numbers for k in (-2, -1, 1, 2)}
    repeated: dict[int, int] = {}
    keys = [k for k, v in groups.items() if not _ENDS.search(lines[v[0]])]
    small = [k for k in keys if len(groups[k]) <= 2 and len(k) > 6]
    merged: dict[str, int] = {k: len(groups[k]) for k in keys}
    tops = [k for k in keys if len(groups[k]) >= 2 or any(i in near_number for i in groups[k])]
    alike = _index(small)
    for a in tops:
        for b in alike(a):
            if a != b and _near(a, b):
                merged[a] += len(groups[b])
                merged[b] = max(merged[b], merged[a])
    for k in keys:
        for i in groups[k]:
            repeated[i] = merged[k]
    plain = not in_run and not any(v > 1 for v in repeated.values()) and not any(_explicit(f) for f in forms)
    made = Layout(np.array([not x.strip() for x in lines]), np.zeros(n, bool), np.zeros((n, 7)), np.zeros((n, 14)), plain)
    if plain:
        return made
    first = full[0] if full else 0
    before = {i: p for p, i in zip(full, full[1:])}
    after = {p: i for p, i in zip(full, full[1:])}

    def body_before(i: int) -> int | None:
        j = before.get(i)
        while j is not None and (j in numbers or repeated.get(j, 0) > 1):
            j = before.get(j)
        return j

    def body_after(i: int) -> int | None:
        j = after.get(i)
        while j is not None and (j in numbers or repeated.get(j, 0) > 1):
            j = after.get(j)
        return j

    width = sorted(len(lines[i].rstrip()) for i in full)[len(full) * 9 // 10]
    ruled = sum("|" in lines[i] for i in full)
    for i in full:
        s = lines[i].strip()
        b, a = body_before(i), body_after(i)
        splits = b is not None and a is not None and _open(lines[b]) and _goes_on(lines[a])
        if i in numbers:
            form, value = numbers[i]
            explicit = _explicit(form)
            made.is_number[i] = True
            made.number[i] = (1, min(in_run.get(i, 0), 2), explicit, splits, i == first or i == full[-1], value >= 1000 and not explicit, not explicit and form.endswith("r") and not in_run.get(i))
            continue
        again = repeated.get(i, 0)
        caps = sum(c.isupper() for c in s) > 0.6 * sum(c.isalpha() for c in s) > 0
        more = (0, 0, 0, 0, 0, 0)
        if again > 1:
            named = [w for w in re.findall(r"[A-Za-z]{3,}", s) if w not in ("and", "the", "for")]
            titled = len(named) > 1 and sum(w[0].isupper() for w in named) >= 0.8 * len(named)
            # a wrapped line is short only where the next word does not fit
            follows = re.split(r"\s", lines[after[i]].strip())[0] if i in after and after[i] == i + 1 else ""
            short = len(lines[i].rstrip()) + 1 + len(follows) < width if follows else True
            edge = i + 1 >= n or not lines[i + 1].strip() or i == 0 or not lines[i - 1].strip()
            more = (1, short, not short, titled, edge, s.count("|") > 1 and ruled > 2 * again)
        made.header[i] = (1, max(min(again - 1, 3), -1), i == first or i in near_number, splits, caps, bool(_ENDS.search(s)), len(s) > 80, *more, again < 2)
    return made


def label(lines: list[str], weights: Weights = PRIOR) -> tuple[list[int], bool, bool]:
    """The label of each line; whether there are running headers; whether page numbers run."""
    n = len(lines)
    made = layout(lines)
    if made.plain:
        return [BREAK if x else BODY for x in made.blank.tolist()], False, False
    scores, moves = made.scores(weights).tolist(), weights.moves.tolist()
    first = next(i for i in range(n) if lines[i].strip())
    best = list(scores[0])
    back: list[list[int]] = []
    for e in scores[1:]:
        step, came = [], []
        for t in range(4):
            s_, f = max((best[x] + moves[x][t], x) for x in range(4))
            step.append(s_ + e[t])
            came.append(f)
        best = step
        back.append(came)
    out = [max(range(4), key=lambda t: best[t])]
    for came in reversed(back):
        out.append(came[out[-1]])
    out.reverse()
    heads = [i for i in range(n) if out[i] == HEADER]
    inside = any(i != first for i in heads)
    runs = any(x == NUMBER for x in out)
    if not runs and len(heads) > 1:
        # numbers on the header lines, set apart by wide space
        for end in (0, -1):
            seen: dict[str, int] = {}
            last: int | None = None
            for i in heads:
                parts = re.split(r"\s{2,}|\t", lines[i].strip())
                p = page_number(parts[end]) if len(parts) > 1 else None
                if p is None:
                    continue
                form, value = p
                if (last is not None and value - last == 1) or 1 <= value - seen.get(form, value) <= 2:
                    runs = True
                seen[form] = last = value
    return out, inside, runs


#: Texts that pages are made of to fit the weights on, and their least and largest number of characters.
SAMPLE, SHORTEST, LARGEST = 240, 800, 8000
#: Steps of the fit, their size, and how strongly weights are drawn to those before.
STEPS, STEP, DRAWN = 60, 0.15, 20.0
_NUMBERS: tuple[Callable[[int], str], ...] = (str, lambda n: f"- {n} -", lambda n: f"Page {n}", lambda n: f"[{n}]", lambda n: f"{n} of 400", lambda n: f"p. {n}", lambda n: " " * 30 + str(n), lambda n: f"Page No. {n}")


def made_pages(text: str, rng: random.Random) -> tuple[list[str], list[int]]:
    """Lines as if ``text`` had been scanned, and the label of each: wrapped, with a running header, with page numbers, with either or neither."""
    labels, *_ = label(text.split("\n"))
    body: list[str] = []
    width = rng.randrange(50, 95)
    for line, k in zip(text.split("\n"), labels):
        if k == BREAK:
            body += [""] if rng.random() < 0.6 else []
        elif k == BODY:
            body += textwrap.wrap(line.strip(), width, break_long_words=False, break_on_hyphens=False)
    words = re.findall(r"[^\W\d_]{3,}", text)
    k = rng.randrange(max(len(words), 1))
    title = " ".join(w.capitalize() for w in words[k : k + rng.randrange(3, 7)])
    title = title.upper() if rng.random() < 0.4 else title
    header = rng.random() < 0.6 and len(title) > 6
    number = rng.choice(_NUMBERS) if rng.random() < 0.6 else None
    on_top, gap, height, no = rng.random() < 0.3, rng.random() < 0.4, rng.randrange(8, 40), rng.randrange(1, 300)
    lines: list[str] = []
    out: list[int] = []

    def put(line: str, k: int) -> None:
        lines.append(line)
        out.append(k if line.strip() else BREAK)

    for at in range(0, len(body), height):
        if number and on_top:
            put(number(no), NUMBER)
        if header:
            shown = title
            if rng.random() < 0.15:  # headers are misread too
                wrong, right = rng.choice(CONFUSIONS)
                shown = shown.replace(right, wrong, 1)
            put(shown, HEADER)
        if gap and (header or number and on_top):
            put("", BREAK)
        for line in body[at : at + height]:
            put(line, BODY)
        if number and not on_top:
            if gap:
                put("", BREAK)
            put(number(no), NUMBER)
        no += 1
    return lines, out


def fit_labels(texts: list[str], steps: int = STEPS) -> Weights:
    """The weights that make the labels of pages made of ``texts`` likeliest, drawn to ``PRIOR``: gradients of forward-backward over whole texts."""
    made, gold = [], []
    for k, t in enumerate(sorted(texts)):
        lines, labels = made_pages(t, random.Random(k))
        if len(lines) > 1 and not (x := layout(lines)).plain:
            made.append(x)
            gold += labels
    if not made:
        return PRIOR
    y = np.eye(4)[gold]
    lens = np.array([len(x.blank) for x in made])
    number, header = np.concatenate([x.number for x in made]), np.concatenate([x.header for x in made])
    plain_body = ~np.concatenate([x.blank for x in made])
    starts = np.cumsum(lens)[:-1]
    inner = np.ones(len(y) - 1, dtype=bool)
    inner[starts - 1] = False
    observed = y[:-1][inner].T @ y[1:][inner]
    w = PRIOR
    seen = [np.full(7, 1e-6), np.full(14, 1e-6), 1e-6, np.full((4, 4), 1e-6)]
    for _ in range(steps):
        p, changes = forward_backward(np.concatenate([x.scores(w) for x in made]), lens, w.moves)
        off = p - y
        grads = [
            number.T @ off[:, NUMBER] + DRAWN * (w.number - PRIOR.number),
            header.T @ off[:, HEADER] + DRAWN * (w.header - PRIOR.header),
            float(off[plain_body, BODY].sum()) + DRAWN * (w.body - PRIOR.body),
            changes - observed + DRAWN * (w.moves - PRIOR.moves),
        ]
        seen = [s + g**2 for s, g in zip(seen, grads)]
        now = [x - STEP * g / np.sqrt(s) for x, g, s in zip((w.number, w.header, w.body, w.moves), grads, seen)]
        w = Weights(*now)
    return w


def fit_on(records: DataFrame, text_col: str, sample: int = SAMPLE) -> Weights:
    """Weights fitted on pages made of about ``sample`` texts drawn by hash."""
    texts = records.select(F.col(text_col).cast("string").alias("text")).filter(F.length("text").between(SHORTEST, LARGEST))
    n = texts.count()
    drawn = texts.filter(F.pmod(F.xxhash64("text"), F.lit(max(n, 1))) < sample).distinct()
    return fit_labels([r["text"] for r in drawn.collect()])  # about ``sample`` texts of bounded length


def broken(lines: list[str], labels: list[int]) -> list[tuple[int, int, tuple[str, str] | None]]:
    """``line, next body line, parts`` of each word that is divided by a hyphen-like mark at a line end.

    With ``parts`` it may be a compound with its own hyphen, which the counts decide.
    """
    out = []
    for i, line in enumerate(lines):
        m = _BROKEN.search(line)
        if not m or labels[i] != BODY or m.start() == 0:
            continue
        c = line[m.start() - 1]
        if not (c.isalpha() or unicodedata.category(c)[0] == "M"):
            continue
        j = i + 1
        passed = False
        while j < len(lines) and labels[j] != BODY:
            passed = passed or labels[j] in (HEADER, NUMBER)
            j += 1
        if j >= len(lines) or (j > i + 1 and not passed):
            continue
        nxt = lines[j].lstrip()
        if not nxt or not (nxt[0].islower() or unicodedata.category(nxt[0]) in ("Lo", "Mn", "Mc") or nxt[0] in SIGNS):
            continue
        parts = None
        if line[m.start()] == "-":
            parts = re.split(r"\s", line[: m.start()])[-1].lower().lstrip(_TOKEN_EDGE), re.split(r"\s", nxt)[0].lower().rstrip(_TOKEN_EDGE)
        out.append((i, j, parts))
    return out


def _variants(w: str) -> Iterator[str]:
    """Words that ``w`` may be a misreading of, one or two places undone."""
    for wrong, right in CONFUSIONS:
        at = w.find(wrong)
        while at >= 0:
            yield w[:at] + right + w[at + len(wrong) :]
            at = w.find(wrong, at + 1)


def _unsigned(w: str) -> list[str]:
    """All readings of a word with signs in place of letters."""
    return ["".join(x) for x in itertools.product(*[SIGNS.get(ch) or ch for ch in w])]


def readings(w: str) -> tuple[Iterable[str], Iterable[str]]:
    """What ``w`` may be a misreading of, with one place undone and with two; signs are undone as well as a place."""
    if any(ch in SIGNS for ch in w):
        if not _ODD.match(w) or _ORDINAL.match(w) or sum(ch.isalpha() and ch.isascii() for ch in w) < 3:
            return (), ()
        plain = _unsigned(w)
        return itertools.chain(plain, (x for v in plain for x in _variants(v))), ()
    if len(w) < 3:
        return (), ()
    return _variants(w), (x for u in _variants(w) for x in _variants(u) if x != w) if len(w) >= 6 else ()


def verdict(w: str, own: int, one: tuple[int, str], two: tuple[int, str]) -> str | None:
    """The word that ``w``, seen ``own`` times, is a misreading of; ``""`` if it is one of no known word; None if it is none.

    ``one`` and ``two`` are the most frequent of its ``readings`` and their counts.
    """
    signs = [ch for ch in w if ch in SIGNS]
    if signs:
        if one[0] >= KNOWN * own:
            return one[1]
        # letters with marks may be another language's
        return "" if len(w) >= 5 and (one[0] > own or not all(ch.isalpha() for ch in signs)) else None
    if one[0] >= DOMINANCE * own:
        return one[1]
    return two[1] if two[0] >= TWICE * own else None


def _spoils(w: str) -> bool:
    """Whether ``w`` can be a misreading of no known word."""
    return len(w) >= 5 and any(ch in SIGNS for ch in w) and any(True for _ in readings(w)[0])


def misread(token: str, counts: dict[str, int]) -> str | None:
    """The verdict on ``token`` by counts at hand; a word that ``word_counts`` left out counts as often as it can have been seen."""
    w = token.lower()
    own = max(counts.get(w) or counts.get("", 0) // DOMINANCE, 1)
    one, two = (max(((counts.get(v, 0), v) for v in x), default=(0, "")) for x in readings(w))
    return verdict(w, own, one, two) if one[0] or two[0] or _spoils(w) else None


def _tallied(texts: DataFrame, of: Callable[..., Counter]) -> DataFrame:
    """``word, n``: the sums of what ``of`` counts in the columns of ``texts``, of which ``text`` is the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for columns in blocks(batches, 0):
            held.update(of(*columns))
            if len(held) > 400_000:
                yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                held = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    rows = spread(texts.filter(F.length("text") > 0)).mapInArrow(run, "word string, n bigint")
    return cut(rows.groupBy("word").agg(F.sum("n").alias("n")))


def _words(texts: list[str]) -> Counter:
    return Counter(_WORD.findall("\n".join(texts).lower()))


@functools.lru_cache(300_000)
def _parts(token: str) -> tuple[str, ...]:
    """The words, as they stand, that a token between blanks is judged by."""
    t = token.strip(_TOKEN_EDGE)
    if not _LATIN.search(t):
        return ()
    parts = (p.strip(_TOKEN_EDGE) for part in t.split("—") for p in part.split("-"))
    return tuple(p for p in parts if _LATIN.search(p))


def _asked(texts: list[str]) -> Counter:
    """How often each word comes that ``marks`` may ask about."""
    out: Counter = Counter()
    for t, n in Counter("\n".join(texts).split()).items():
        for p in _parts(t):
            out[p.lower()] += n
    return out


def word_counts(texts: DataFrame, text_col: str, rate: float = RATE) -> dict[str, int]:
    """Counts over all texts of the lower-cased words, hyphened ones included, that are at least ``rate`` of all, to judge single texts by.

    ``""`` has the count that a reading needs if the word is left out, ``" "`` the largest count of a word.
    """
    counted = _tallied(texts.select(F.col(text_col).cast("string").alias("text")), _words)
    total = counted.agg(F.sum("n")).first()[0] or 0
    floor = max(1, math.ceil(total * rate))
    out = {r["word"]: r["n"] for r in counted.filter(F.col("n") >= floor).collect()}  # at most 1 / rate words
    return out | {"": DOMINANCE * floor if floor > 1 else KNOWN, " ": max(out.values(), default=0)}


class Bitmap:
    """Which strings may be in a column: a few others pass, none of its own is missed; of one size whatever the data."""

    def __init__(self, keys: DataFrame, column: str):
        hashed = keys.select(F.crc32(F.col(column).cast("binary")).alias("key"))
        self.words = keys.sparkSession.sparkContext.broadcast(_filter_words(hashed))
        self.known: dict[str, bool] = {}

    def may_hold(self, keys: list[str]) -> list[bool]:
        place = _place(np.array([zlib.crc32(k.encode()) for k in keys], dtype=np.int64))
        return ((self.words.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1).tolist()

    def hits(self, keys: Iterable[str]) -> set[str]:
        """Those of ``keys`` that may be in the column; answers are remembered."""
        keys = set(keys)
        if len(self.known) > 300_000:
            self.known.clear()
        new = [k for k in keys if k not in self.known]
        self.known.update(zip(new, self.may_hold(new)))
        return {k for k in keys if self.known[k]}


def misread_words(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, reading`` of the words of ``asked`` that are misread, by ``counted`` (both ``word, n``)."""
    most, longest = counted.agg(F.max("n"), F.max(F.when(F.col("n") >= DOMINANCE, F.length("word")))).first()
    most, longest = most or 0, longest or 0
    known = counted.filter("n > 1")  # a reading is more frequent than what was seen once
    bitmap = Bitmap(known, "word")
    own = asked.join(counted.withColumnRenamed("n", "counted"), "word", "left").select("word", F.greatest("n", F.coalesce("counted", F.lit(0))).alias("own"))

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                out: list[tuple[str, int, int, str]] = []
                for w, n in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns)):
                    if _spoils(w):
                        out.append((w, n, 0, w))
                    elif n * DOMINANCE > most or len(w) > longest + 2:  # no reading is so frequent, or so long
                        if not any(ch in SIGNS for ch in w):
                            continue
                    one, two = readings(w)
                    out += [(w, n, 1, v) for v in set(one)]
                    if n * TWICE <= most:
                        out += [(w, n, 2, v) for v in set(two)]
                out = [x for x, ok in zip(out, bitmap.may_hold([x[3] for x in out])) if ok or not x[2]]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], f.type) for c, f in enumerate(_TRIES)], schema=_TRIES)

    met = spread(own).mapInArrow(tries, "word string, own bigint, step int, reading string").join(known.withColumnRenamed("word", "reading"), "reading", "left")
    best = (F.max(F.when((F.col("step") == k) & F.col("n").isNotNull(), F.struct("n", "reading"))) for k in (1, 2))
    judged = met.groupBy("word", "own").agg(*(x.alias(name) for x, name in zip(best, ("one", "two")))).select("word", "own", "one.n", "one.reading", F.col("two.n").alias("n2"), F.col("two.reading").alias("reading2"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            out = [(w, v) for w, n, a, x, b, y in rows if (v := verdict(w, n, (a or 0, x or ""), (b or 0, y or ""))) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.string()) for c in (0, 1)], names=["key", "reading"])

    return judged.mapInArrow(decide, "key string, reading string")


def own_hyphens(counted: DataFrame) -> DataFrame:
    """``key`` of the compounds that are more often written with a hyphen than without it, as their two parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(_pair((w[:i], w[i + 1 :])), w[:i] + w[i + 1 :], n) for w, n in zip(*(c.to_pylist() for c in batch.columns)) for i, ch in enumerate(w) if ch == "-"]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], names=["key", "word", "hyphened"])

    pairs = counted.filter(F.col("word").contains("-")).mapInArrow(run, "key string, word string, hyphened bigint")
    return pairs.join(counted, "word", "left").filter(F.col("hyphened") > F.coalesce("n", F.lit(0))).select("key")


def _pair(parts: tuple[str, str]) -> str:
    """The key of a compound: words have no tabs."""
    return "\t".join(parts)


_LATIN = re.compile(r"[A-Za-z]{2}")
_TRIES = pa.schema([("word", pa.string()), ("own", pa.int64()), ("step", pa.int32()), ("reading", pa.string())])


class Judge:
    """Verdicts on the words of single texts, by counts at hand."""

    def __init__(self, counts: dict[str, int], weights: Weights = PRIOR):
        self.counts, self.weights = counts, weights
        self.seen: dict[str, str | None] = {}

    def reading(self, token: str) -> str | None:
        w = token.lower()
        if w not in self.seen:
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[w] = misread(w, self.counts)
        return self.seen[w]

    def joined(self, parts: tuple[str, str] | None) -> bool:
        """Whether a divided word is written without a hyphen."""
        return parts is None or self.counts.get("-".join(parts), 0) <= self.counts.get("".join(parts), 0)


class Verdicts:
    """The verdicts that concern a text."""

    def __init__(self, found: Iterable[tuple[str, str]]):
        self.found = dict(found)

    def reading(self, token: str) -> str | None:
        return self.found.get(token.lower())

    def joined(self, parts: tuple[str, str] | None) -> bool:
        return parts is None or _pair(parts) not in self.found


def marks(text: str | None, weights: Weights = PRIOR) -> tuple[list[str], list[tuple[str, str] | None], set[str]]:
    """The kinds of scan noise that the lines of a text show, its divided words, and the words, as they stand, that may be misread."""
    if not text:
        return [], [], set()
    lines = text.split("\n")
    out = []
    cut: list[tuple[str, str] | None] = []
    if len(lines) > 1:
        labels, header, number = label(lines, weights)
        cut = [parts for *_, parts in broken(lines, labels)]
        if header:
            out.append("running_header")
        if number:
            out.append("page_number")
    skip = set()
    for i, line in enumerate(lines):
        if _BROKEN.search(line):
            skip |= {x.strip(_TOKEN_EDGE + HYPHENS) for x in line.split()[-2:]} | {x.strip(_TOKEN_EDGE) for x in (lines[j] for j in range(i + 1, min(i + 5, len(lines)))) for x in x.split()[:1]}
    tail = text.split()[-1:] if text.strip() else []
    skip |= {x.strip(_TOKEN_EDGE) for x in tail}
    return out, cut, {p for t in set(text.split()) if t.strip(_TOKEN_EDGE) not in skip for p in _parts(t) if p not in skip}


def kinds(text: str | None, judge: Judge) -> list[str]:
    """The kinds of scan noise in a text."""
    out, cut, words = marks(text, judge.weights)
    if any(judge.joined(parts) for parts in cut):
        out.append("broken_word")
    if any(judge.reading(w) is not None for w in words):
        out.append("bad_char")
    return out


_FIXED = re.compile(r"[\w|$!]*[A-Za-z][\w|$!]*")
_HEAD, _TAIL = re.compile(r"[\w|$!]*"), re.compile(r"[\w|$!]*$")


def assembled(text: str, weights: Weights = PRIOR) -> tuple[str, list[int], list[tuple[str, str]]]:
    """The text as continuous paragraphs, without headers, page numbers, breaks and hyphens that divide words; where hyphens went that may be a compound's own, and its parts."""
    lines = text.split("\n")
    labels, *_ = label(lines, weights) if len(lines) > 1 else ([BODY], False, False)
    joins = {i: parts for i, _, parts in broken(lines, labels)}
    paragraphs: list[str] = []
    open_: list[tuple[int, int]] = []
    new, glue = True, ""
    for i, line in enumerate(lines):
        if labels[i] == BREAK:
            around = [labels[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
            if not paragraphs or not (any(x in (HEADER, NUMBER) for x in around) and _open(paragraphs[-1])):
                new = True
            continue
        if labels[i] != BODY:
            continue
        s = line.strip()
        if i in joins:
            s = _BROKEN.sub("", s)
        if new or not paragraphs:
            paragraphs.append(s)
        else:
            paragraphs[-1] += glue + s
        if joins.get(i):
            open_.append((len(paragraphs) - 1, len(paragraphs[-1])))
        new, glue = False, "" if i in joins else " "
    starts = [0, *itertools.accumulate(len(p) + 2 for p in paragraphs)]
    return "\n\n".join(paragraphs), [starts[k] + at for k, at in open_], [parts for parts in joins.values() if parts]


def _pieces(text: str, at: list[int]) -> list[str]:
    return [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]


def _fixable(text: str, at: list[int]) -> list[str]:
    """The words, as they stand, that may come into a text, whichever of its open hyphens stay."""
    pieces = _pieces(text, at)
    out = [w for p in pieces for w in _FIXED.findall(p)]
    for k, piece in enumerate(pieces[:-1]):
        run = _TAIL.search(piece).group()
        for p in pieces[k + 1 :]:
            head = _HEAD.match(p).group()
            run += head
            out += _FIXED.findall(run)
            if head != p:
                break
    return out


def resolved(text: str, at: list[int], pairs: list[tuple[str, str]], judge: Judge | Verdicts) -> str:
    """An ``assembled`` text with the hyphens of compounds and without misreadings."""
    first, *rest = _pieces(text, at)
    for parts, piece in zip(pairs, rest):
        first += piece if judge.joined(parts) else ("-" if piece.startswith("\n\n") else "- ") + piece

    def fixed(m: re.Match) -> str:
        t = m.group()
        v = judge.reading(t)
        if not v:
            return t
        return v.upper() if t.isupper() else v.capitalize() if t[:1].isupper() else v

    return _FIXED.sub(fixed, first)


def repair(text: str | None, judge: Judge) -> str | None:
    """The text as continuous paragraphs, without headers, page numbers, breaks and misreadings."""
    return resolved(*assembled(text, judge.weights), judge) if text else text


_HITS = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("key", pa.string())])
_ASSEMBLED = pa.schema([("id", pa.int64()), ("text", pa.string()), ("at", pa.list_(pa.int32())), ("pairs", pa.list_(pa.list_(pa.string())))])
_KEYS = pa.schema([("digest", pa.int64()), ("key", pa.string())])
_REPAIRED = pa.schema([("id", pa.int64()), ("text", pa.string())])


def _rows(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return records.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("bigint").alias("id"))


def find_noise(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, kind`` of each kind of scan noise in a text."""
    rows, weights = _rows(records, id_col, text_col), fit_on(records, text_col)
    counted = _tallied(rows.select("text"), _words)
    wrong, kept = cut(misread_words(counted, _tallied(rows.select("text"), _asked)).select("key")), cut(own_hyphens(counted))
    bitmap = Bitmap(wrong.union(kept), "key")

    def kernel(texts: list, ids: list) -> list:
        out = []
        for i, t in zip(ids, texts):
            found, divided, words = marks(t, weights)
            keys = {parts and _pair(parts) for parts in divided}
            open_ = bitmap.hits(keys - {None})
            out += [(i, k, None) for k in (found if keys == open_ else [*found, "broken_word"])]
            out += [(i, "broken_word", k) for k in open_ if keys == open_]
            out += [(i, "bad_char", k) for k in bitmap.hits(w.lower() for w in words)]
        return [[x[c] for x in out] for c in range(3)]

    hits = cut(map_blocks(spread(rows), "text", kernel, "id bigint, kind string, key string", _HITS))
    sure, of = hits.filter("key is null"), lambda kind: hits.filter((F.col("kind") == kind) & F.col("key").isNotNull())
    return sure.union(of("bad_char").join(wrong, "key", "left_semi").select(*hits.columns)).union(of("broken_word").join(kept, "key", "left_anti").select(*hits.columns)).select("id", "kind").distinct()


def repaired(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` of all records, the texts repaired."""
    rows, weights = _rows(records, id_col, text_col), fit_on(records, text_col)

    def assemble(texts: list, ids: list) -> list:
        out = [assembled(t, weights) if t else (t, [], []) for t in texts]
        return [ids, *([x[c] for x in out] for c in range(3))]

    made = cut(map_blocks(spread(rows), "text", assemble, "id bigint, text string, at array<int>, pairs array<array<string>>", _ASSEMBLED))
    counted = _tallied(rows.select("text"), _words)
    asked = _tallied(made.select("text", "at"), lambda texts, at: Counter(w.lower() for x in zip(texts, at) for w in _fixable(*x)))
    found = cut(misread_words(counted, asked).union(own_hyphens(counted).select("key", F.lit("-").alias("reading"))))
    bitmap = Bitmap(found, "key")
    texts = with_digest(made)

    def ask(texts: list, at: list, pairs: list, digests: list) -> list:
        out = [(d, k) for t, a, p, d in zip(texts, at, pairs, digests) if t for k in bitmap.hits([*map(_pair, p), *(w.lower() for w in _fixable(t, a))])]
        return [[x[c] for x in out] for c in range(2)]

    keys = map_blocks(texts.select("text", "at", "pairs", "digest"), "text", ask, "digest bigint, key string", _KEYS).distinct()
    held = keys.join(found, "key").groupBy("digest").agg(F.collect_list(F.struct("key", "reading")).alias("found"))  # at most a text's words

    def kernel(ids: list, texts: list, at: list, pairs: list, found: list) -> list:
        return [ids, [resolved(t, a, p, Verdicts((x["key"], x["reading"]) for x in f or ())) if t else t for t, a, p, f in zip(texts, at, pairs, found)]]

    out = texts.join(held, "digest", "left").select("id", "text", "at", "pairs", "found")
    return map_blocks(out, "text", kernel, "id bigint, text string", _REPAIRED)
