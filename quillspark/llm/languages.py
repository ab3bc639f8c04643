"""Languages of documents and of their stretches, by a linear-chain conditional random field.

Words are labelled with a language (Hindi in Latin script is a label of its own and counted
as Hindi): the emission of a word is the sum of learned weights of its script, itself, its
affixes, its character 3-grams and the lexicons it stands in; transitions between labels are
learned too. Posteriors come from forward-backward over chains of neighbouring sentences, all chains of a block at
once, so that a sentence with little evidence of its own follows its neighbours. A sentence has the language with the largest summed posterior, or its neighbour's where that is under ``SURE`` of its words; neighbouring sentences
of one language are a stretch, whose confidence is the mean posterior of its words.

All weights are fitted together on about ``sample_rows`` labelled records of each language, drawn by
hash, whose label agrees with the lexicons below: on their sentences and on sequences joined from
parts of these, by gradients of forward-backward.

Defined results
    null texts and texts without words have no stretch and a null language; text that is no
    sentence (titles, signatures, headers, page numbers) makes no stretch unless the text has
    nothing else; ties go to the first of ``labels``; repeated rows are judged each time;
    an empty table is fitted on the lexicons alone and gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._arrow import map_blocks
from quillspark.llm._chain import forward_backward
from quillspark.llm.residue import localise
from quillspark.llm.scan_noise import HEADER, NUMBER, label
from quillspark.session import spread

#: Records of each language, sentences of each record and words of each sentence that the field is fitted on.
SAMPLE_ROWS, SENTENCES, LONGEST = 250, 12, 60
#: Steps of the fit and their size.
STEPS, RATE = 60, 0.3
WIDTH = 1 << 16
#: Mean posterior below which a sentence follows its neighbours.
SURE = 0.65
#: Words after which a chain of sentences ends with its sentence.
CHAIN = 120
#: Words that a stretch needs, so that a single foreign word is none.
LEAST_WORDS = 3

#: Frequent function words of each label.
LEXICONS = {
    "en": "the of and to in is are be by for or shall may not with any on as at from under that which this has have been no every such where if it an".split(),
    "hi": "है हैं के की का को में और से पर ने नहीं होगा होगी किया गया जाएगा जाएगी जा सकता चाहिए तथा लिए द्वारा था यह इस कि एवं ओर बाद करना".split(),
    "hi-Latn": "hai hain ke ki ka ko mein aur se par ne nahin hoga hogi kiya gaya jayega jayegi ja sakta chahiye tatha liye dwara tha yah is or baad karna".split(),
    "kn": "ಮತ್ತು ಹಾಗೂ ಮೂಲಕ ನಂತರ ಮೇಲೆ ಇದು ಈ ಆಗಿದೆ ಇಲ್ಲ ಪ್ರಕಾರ".split(),
    "mr": "आहे आहेत च्या आणि व यांच्या नाही करण्यात येईल जाईल आला होता केले लागेल तसेच यांच्यासाठी शी मध्ये नंतर हा ही हे पासून".split(),
    "ta": "மற்றும் மீது படி இது இந்த முதல் மூலம் வேண்டும் இல்லை குறித்து".split(),
}
#: Three-letter codes.
THREE = {"eng": "en", "hin": "hi", "kan": "kn", "mar": "mr", "tam": "ta", "tel": "te", "ben": "bn", "urd": "ur", "guj": "gu", "mal": "ml", "pan": "pa", "san": "sa"}

_WORDS = re.compile(r"[^\s\d_!-/:-@\[-`{-~।॥—–…“”‘’‐¬­|]+")
_STOP = re.compile(r"(?<=[.।!?])[\"'”’)\]}]*\s+|\n[ \t]*\n\s*")
_TERMINATED = re.compile(r"[.।!?][\"'”’)\]}]*$")


def named(lang: Column, codes: dict[str, str]) -> Column:
    """The code that a label names, however it is spelt; null if it names none of ``codes``."""
    first = F.element_at(F.split(F.lower(F.trim(lang)), "[-_ ]"), 1)
    known = {c.lower(): c for c in codes} | {n.lower(): c for c, n in codes.items()} | {k: c for k, c in THREE.items() if c in codes}
    spelt = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.when(lang.isNotNull(), F.element_at(spelt, first))


def _script(w: str) -> str:
    c = ord(w[0])
    for name, lo, hi in (("deva", 0x900, 0x97F), ("knda", 0xC80, 0xCFF), ("taml", 0xB80, 0xBFF)):
        if lo <= c <= hi:
            return name
    return "latn" if c < 0x250 else "other"


_IN_LEXICON: dict[str, list[str]] = {}
for _label, _list in LEXICONS.items():
    for _w in _list:
        _IN_LEXICON.setdefault(_w, []).append(_label)


def features(w: str) -> list[int]:
    """Hashed features of a lower-cased word."""
    f = [f"script {_script(w)}", f"word {w}"]
    f += [f"prefix {w[:k]}" for k in (1, 2, 3) if len(w) >= k] + [f"suffix {w[-k:]}" for k in (1, 2, 3) if len(w) >= k]
    padded = f"^{w[:24]}$"
    f += [f"gram {padded[i : i + 3]}" for i in range(len(padded) - 2)]
    f += [f"lexicon {x}" for x in _IN_LEXICON.get(w, ())]
    return [zlib.crc32(x.encode()) % WIDTH for x in f]


class Field:
    """Weights of words (``WIDTH`` x labels) and of transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.weights, self.moves = labels, weights, moves
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((4096, len(labels)), np.float32)

    def __getstate__(self):
        return self.labels, self.weights, self.moves

    def __setstate__(self, state):
        self.__init__(*state)

    def ids(self, words: list[str]) -> list[int]:
        """Rows of the words' emissions; new words are scored once."""
        seen = self.seen
        out = [seen.get(w, -1) for w in words]
        if -1 in out:
            for k, i in enumerate(out):
                if i < 0:
                    w = words[k]
                    if w not in seen:
                        if len(seen) >= len(self.rows):
                            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                        self.rows[len(seen)] = self.weights[features(w)].sum(axis=0)
                        seen[w] = len(seen)
                    out[k] = seen[w]
        return out

    def posteriors(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """Word posteriors of each sentence, by forward-backward over all sentences of a length class."""
        if len(self.seen) > 500_000:
            self.seen.clear()
        flat = np.array(self.ids([w for s in sentences for w in s]), dtype=np.int64)
        lens = np.array([len(s) for s in sentences])
        out, _ = forward_backward(self.rows[flat], lens, self.moves)
        at = np.concatenate([[0], np.cumsum(lens)])
        return [out[i:j] for i, j in zip(at[:-1], at[1:])]


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; blank lines end one too."""
    out, at = [], 0
    for m in _STOP.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.end() if not m.group().startswith("\n") else m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def _lexicon_votes(tokens: list[str], labels: list[str]) -> np.ndarray:
    votes = np.zeros(len(labels))
    for w in tokens:
        for x in _IN_LEXICON.get(w, ()):
            if x in labels:
                votes[labels.index(x)] += 1
    return votes


def _sequences(spoken: list[tuple[list[str], int]], n: int, rng: np.random.Generator) -> list[list[tuple[list[str], int]]]:
    """Every sentence, and ``n`` sequences of two to four parts of sentences of any languages, so that changes are learned."""
    out = [[s] for s in spoken]
    by_label: dict[int, list[list[str]]] = {}
    for words_, k in spoken:
        by_label.setdefault(k, []).append(words_)
    labels = sorted(by_label)
    for _ in range(n if labels else 0):
        parts = []
        for k in rng.choice(labels, size=rng.integers(2, 5)):
            s = by_label[int(k)][rng.integers(len(by_label[int(k)]))]
            parts.append((s[: rng.integers(3, len(s) + 1)], int(k)))
        out.append(parts)
    return out


def fit(sample: list[tuple[str, str]], codes: list[str], steps: int = STEPS) -> Field:
    """A field fitted on ``(text, code)`` pairs.

    The weights of the words' features and of the transitions are fitted together: each step is a
    gradient of the likelihood of the labels of whole sequences, what is observed less what
    forward-backward expects, for features and changes alike. The lexicons' words are examples too.
    """
    labels = sorted(set(codes) | ({"hi-Latn"} if "hi" in codes else set()))
    place = {x: i for i, x in enumerate(labels)}
    spoken: list[tuple[list[str], int]] = []
    for text, code in sample:
        y = place.get("hi-Latn" if code == "hi" and _latin(words(text)) else code)
        if y is not None:
            spoken += [(s, y) for a, b in sentences(text) if 3 <= len(s := words(text[a:b])[:LONGEST])]
    rng = np.random.default_rng(7)
    sequences = _sequences(spoken, len(spoken) // 4 + 200, rng)
    known: dict[str, int] = {}
    flat, gold, lens = [], [], []
    for parts in sequences:
        for s, k in parts:
            flat += [known.setdefault(w, len(known)) for w in s]
            gold += [k] * len(s)
        lens.append(sum(len(s) for s, _ in parts))
    lexicon = [(known.setdefault(w, len(known)), place[x]) for x in labels for w in LEXICONS.get(x, ())]
    flat_, gold_, lens_ = np.array(flat, dtype=np.int64), np.array(gold, dtype=np.int64), np.array(lens, dtype=np.int64)
    n_labels, n_words = len(labels), len(known)
    x = [features(w) for w in known]
    longest = max((len(f) for f in x), default=1)
    ids = np.array([f + [WIDTH] * (longest - len(f)) for f in x], dtype=np.int64).reshape(len(x), longest)
    # each language weighs the same, whatever its part of the sample
    size = np.bincount(gold_, minlength=n_labels).astype(float)
    weight = np.where(size > 0, size.sum() / np.maximum(size * (size > 0).sum(), 1), 0.0)[gold_] if len(gold_) else np.zeros(0)
    starts = np.concatenate([[0], np.cumsum(lens_)])[:-1].astype(np.int64)
    inner = np.ones(max(len(flat_) - 1, 0), dtype=bool)
    inner[starts[1:] - 1] = False
    observed = np.zeros((n_labels, n_labels))
    if len(flat_) > 1:
        np.add.at(observed, (gold_[:-1][inner], gold_[1:][inner]), 1.0)
    scale = 1000.0 / max(len(flat_), 1000)
    w, moves = np.zeros((WIDTH + 1, n_labels)), np.zeros((n_labels, n_labels))
    w_seen, m_seen = np.full(w.shape, 1e-6), np.full(moves.shape, 1e-6)
    lex_word, lex_label = np.array([i for i, _ in lexicon], dtype=np.int64), np.array([k for _, k in lexicon], dtype=np.int64)
    for _ in range(steps):
        score = w[ids].sum(axis=1) if n_words else np.zeros((0, n_labels))
        p, expected = forward_backward(score[flat_], lens_, moves) if len(flat_) else (np.zeros((0, n_labels)), observed)
        p[np.arange(len(flat_)), gold_] -= 1
        p *= (weight * scale)[:, None]
        g = np.stack([np.bincount(flat_, p[:, k], minlength=n_words) for k in range(n_labels)], axis=1)
        if len(lex_word):
            q = np.exp(score[lex_word] - score[lex_word].max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(q)), lex_label] -= 1
            np.add.at(g, lex_word, q)
        grad = np.stack([np.bincount(ids.ravel(), np.repeat(g[:, k], longest), minlength=WIDTH + 1) for k in range(n_labels)], axis=1) + 1e-3 * w
        grad[WIDTH] = 0
        w_seen += grad**2
        w -= RATE * grad / np.sqrt(w_seen)
        change = (expected - observed) * scale + 1e-3 * moves
        m_seen += change**2
        moves -= RATE * change / np.sqrt(m_seen)
    return Field(labels, w[:WIDTH].astype(np.float32), moves)


def _latin(tokens: list[str]) -> bool:
    return sum(_script(w) == "latn" for w in tokens) * 2 > len(tokens)


_DRAWN = pa.schema([("text", pa.string()), ("code", pa.string())])


def fit_on(records: DataFrame, text_col: str, lang_col: str, codes: dict[str, str], sample_rows: int = SAMPLE_ROWS) -> Field:
    """The field fitted on about ``sample_rows`` labelled records of each language, drawn by hash, whose label agrees with the lexicons.

    Of each ``SENTENCES`` sentences of at most ``LONGEST`` words go to the driver, drawn by hash.
    """
    known = sorted(codes)
    labels = sorted(set(known) | ({"hi-Latn"} if "hi" in known else set()))
    labelled = records.select(F.col(text_col).cast("string").alias("text"), named(F.col(lang_col), codes).alias("code")).filter((F.length("text") > 0) & F.col("code").isNotNull())
    counts = labelled.groupBy("code").agg(F.count("*").alias("n"))
    joined = labelled.join(F.broadcast(counts), "code")  # one row for each code
    drawn = joined.filter(F.pmod(F.xxhash64("text"), F.greatest(F.col("n"), F.lit(1))) < sample_rows).select("text", "code").distinct()

    def kernel(texts: list, own: list) -> list:
        out = []
        for t, code in zip(texts, own):
            tokens = words(t)
            if not tokens:
                continue
            y = "hi-Latn" if code == "hi" and _latin(tokens) else code
            votes = _lexicon_votes(tokens, labels)
            if votes.sum() and labels[int(votes.argmax())] != y:
                continue
            spans = sorted(sentences(t), key=lambda s: zlib.crc32(t[s[0] : s[1]].encode("utf-8", "surrogatepass")))[:SENTENCES]
            out.append(("\n\n".join(" ".join(t[a:b].split()[: LONGEST * 2]) for a, b in sorted(spans)), code))
        return [[x[0] for x in out], [x[1] for x in out]]

    rows = map_blocks(drawn, "text", kernel, "text string, code string", _DRAWN).toArrow().to_pylist()
    return fit(sorted((r["text"], r["code"]) for r in rows), known)


def _layout(text: str) -> str:
    """The text with the lines of headers and page numbers blanked; positions are kept."""
    if text.count("\n") < 6:
        return text
    lines = text.split("\n")
    labels, header, number = label(lines)
    if not (header or number):
        return text
    return "\n".join(" " * len(x) if k in (HEADER, NUMBER) else x for x, k in zip(lines, labels))


def stretches(texts: list[str | None], field: Field) -> list[list[tuple[int, int, str, float, int]]]:
    """``start, stop, language, confidence, words`` of the stretches of each text."""
    parts: list[tuple[int, int, int, bool]] = []
    spoken: list[list[str]] = []
    chains: list[list[str]] = []  # neighbouring sentences of a text are one chain, of about CHAIN words
    for k, t in enumerate(texts):
        if t and t.strip():
            plain = _layout(t)
            new = True
            for a, b in sentences(plain):
                s = plain[a:b].rstrip()
                parts.append((k, a, a + len(s), bool(_TERMINATED.search(s))))
                spoken.append(words(s))
                if new:
                    chains.append([])
                chains[-1] += spoken[-1]
                new = len(chains[-1]) >= CHAIN
    together = np.concatenate([np.zeros((0, len(field.labels))), *field.posteriors(chains)])
    ends = np.concatenate([[0], np.cumsum([len(s) for s in spoken])]).astype(np.int64)
    posteriors = [together[i:j] for i, j in zip(ends[:-1], ends[1:])]
    fold = [x.partition("-")[0] for x in field.labels]
    langs = sorted(set(fold))
    merge = np.zeros((len(fold), len(langs)))
    for i, x in enumerate(fold):
        merge[i, langs.index(x)] = 1
    own: list[list[tuple[int, int, np.ndarray, int, bool]]] = [[] for _ in texts]
    for (k, a, b, whole), p, s in zip(parts, posteriors, spoken):
        own[k].append((a, b, p.sum(axis=0) @ merge if len(s) else np.zeros(len(langs)), len(s), whole))
    out = []
    for pieces in own:
        strong = [x for x in pieces if x[4] and x[3] >= LEAST_WORDS] or [x for x in pieces if x[3] >= LEAST_WORDS] or [x for x in pieces if x[3]]
        runs: list[list] = []
        sure = [int(p.argmax()) if p.max() >= SURE * n else -1 for _, _, p, n, _ in strong]
        for k, (a, b, p, n, _) in enumerate(strong):
            # an unsure sentence goes with the one before, at the start with the next sure one
            lang = sure[k] if sure[k] >= 0 else runs[-1][2] if runs else next((x for x in sure[k:] if x >= 0), int(p.argmax()))
            if runs and runs[-1][2] == lang:
                runs[-1][1] = b
                runs[-1][3] += p[lang]
                runs[-1][4] += n
            else:
                runs.append([a, b, lang, p[lang], n])
        out.append([(a, b, langs[x], float(c / max(n, 1)), n) for a, b, x, c, n in runs])
    return out


_STRETCHES = pa.schema([("id", pa.int64()), ("label", pa.string()), ("seg_no", pa.int32()), ("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("confidence", pa.float64()), ("doc_lang", pa.string()), ("doc_confidence", pa.float64()), ("n_segments", pa.int32())])


def language_stretches(records: DataFrame, id_col: str, text_col: str, lang_col: str, codes: dict[str, str], residue_model=None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each stretch, with the record's own language.

    ``label`` is the code that the record's label names, null if it names none. With a
    ``residue_model`` texts that hold residue are left out.
    """
    field = fit_on(records, text_col, lang_col, codes, sample_rows)
    rows = spread(records.select(F.col(id_col).cast("bigint").alias("id"), named(F.col(lang_col), codes).alias("label"), F.col(text_col).cast("string").alias("text")).filter("text is not null"))

    def kernel(ids: list, labels: list, texts: list) -> list:
        if residue_model is not None:
            spans, _ = localise(texts, residue_model)
            texts = [None if s else t for t, s in zip(texts, spans)]
        out: list[tuple] = []
        for i, named_, runs in zip(ids, labels, stretches(texts, field)):
            sizes: dict[str, float] = {}
            for a, b, lang, _, _ in runs:
                sizes[lang] = sizes.get(lang, 0) + b - a
            if not runs:
                continue
            most = max(sizes, key=sizes.get)
            sure = sum(c * (b - a) for a, b, lang, c, _ in runs if lang == most) / max(sum(b - a for a, b, *_ in runs), 1)
            out += [(i, named_, k, lang, a, b, c, most, sure, len(runs)) for k, (a, b, lang, c, _) in enumerate(runs)]
        return [list(x) for x in zip(*out)] if out else [[] for _ in _STRETCHES]

    schema = "id bigint, label string, seg_no int, lang string, start int, stop int, confidence double, doc_lang string, doc_confidence double, n_segments int"
    return map_blocks(rows, "text", kernel, schema, _STRETCHES)
