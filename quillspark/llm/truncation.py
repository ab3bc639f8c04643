"""Texts that were cut off, and the storage limits that cut them.

Each value's length is recomputed as it would be stored in other ways (``MEASURES``): code
points, UTF-8 bytes, UTF-16 units, with entities, JSON escapes or ``\\r\\n``. Values are
grouped by each length, in all sources and in each; a length that holds many more values than the
lengths around it is a hidden limit, and the part of its values that is more than those around
it is the prior chance that one of them was cut there. Elsewhere the prior is ``BASE``.

Then endings are inspected by a log-linear model of how texts end against how they look where
they are cut. It is fitted on the table itself: a bounded sample of values gives endings as they
are, and as many places inside those same values, drawn by hash, show what a cut looks like;
endings that look more like cuts are left out and it is fitted again. Its features are the
last sign, the last word, open brackets and quotations, and the shape (letters and digits folded)
of the last lines, so abbreviations, signatures, places and dates, totals and file numbers are
learned and not listed. Marks of omission and white space are taken off first and count as a
cut's; trailing page numbers and headers are passed over.

A value is cut if the odds of its ending times its prior odds are above one.

Defined results
    null, empty and blank values are whole; a value that is repeated under one id counts once
    in ``find_truncated`` and as often as it stands in the report; a null source is reported
    as such; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._arrow import map_blocks
from quillspark.llm._buckets import BROADCAST_ROWS
from quillspark.llm.residue import localise
from quillspark.llm.scan_noise import BODY, HEADER, NUMBER, label, page_number
from quillspark.session import spread

MEASURES = ("chars", "utf8", "utf16", "entities", "json", "json_ascii", "crlf")
#: A limit holds at least so many values, and so many times the mean of the lengths around it.
LEAST, RATIO, AROUND = 8, 8.0, 25
#: Prior chance of a cut away from limits, and the most that a limit gives.
BASE, SUREST = 0.1, 0.98
#: Log-odds that a mark of omission adds.
MARKED = 1.5
#: Values that the model of endings is fitted on, and places of each that stand for cuts.
SAMPLE, PLACES = 6000, 4
WIDTH = 1 << 14
#: Endings that a feature must have.
COMMON = 5
#: Fits of the model of endings, each without the endings that look like cuts in the one before.
REFITS = 3
ALL = "*"

_OMITTED = re.compile(r"(?:\s*(?:\.\.\.+|…+|\[(?:more|\.\.\.|…|contd?|continued|truncated|cut)[^\]\n]{0,24}\]?|\((?:contd?|continued|more|truncated)[^)\n]{0,24}\)?|<(?:more|cut|truncated)>?|→|>>+|\ufffd+))+\s*$", re.I)
_CLOSERS = "\"'”’»)]}"
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“"}


def _kind(c: str) -> str:
    if c.isalpha() or unicodedata.category(c)[0] == "M":
        return "a" if c.islower() or not c.isupper() else "A"
    return "0" if c.isdigit() else c


_RUNS = re.compile(r"(a+|A+|0+)+|\s+")


def shape(line: str) -> str:
    """A line with words and numbers folded: ``Mysuru, 4th day of May, 1966`` is ``w, 0w w w w, 0``."""
    s = "".join(map(_kind, line))
    s = re.sub(r"[aA]+", "w", s)
    return re.sub(r"\s+", " ", re.sub(r"0+", "0", s))


def _open_marks(text: str) -> tuple[bool, bool]:
    """Whether a bracket and whether a quotation is left open in the last paragraph."""
    stack: list[str] = []
    for ch in re.findall(r"[(\[{“)\]}”]", text):
        if ch in "([{“":
            stack.append(ch)
        elif stack and stack[-1] == _PAIRS[ch]:
            stack.pop()
    return bool(stack), text.count('"') % 2 == 1


def _hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % WIDTH for x in names]


def features(body: str) -> list[int]:
    """Hashed features of how a text ends; white space and marks of omission are off."""
    end = body.rstrip(_CLOSERS)
    paragraph = body[body.rfind("\n\n") + 1 :].strip("\n")
    lines = paragraph.split("\n")
    last = lines[-1].strip()
    token = re.sub(r"\d", "0", re.split(r"\s", end[-48:])[-1].lower().lstrip("([{\"'“‘"))[-16:]
    c = _kind(end[-1]) if end else ""
    closed = body[len(end) :][:1]
    bracket, quotation = _open_marks(paragraph)
    few = "1" if len(lines) == 1 else "few" if len(lines) <= 6 else "many"
    f = ["bias", f"sign {c}", f"sign {c}{closed}", f"open {bracket} {quotation}", f"sign {c} open {bracket or quotation}"]
    if c not in ("a", "A", "0"):
        f += [f"word {token}", f"form {c} {shape(token)}", f"size {c} {min(len(token), 6)}"]
    words = min(len(last.split()), 12)
    f += [f"line {c} {words} {few}", f"line {c}{closed} {shape(last[:1])} {words < 8} {'blank' if paragraph != body else ''}"]
    tail = shape(last[-24:])
    f += [f"tail {shape(last[-6:])}", f"tail {tail}"]
    if len(last) <= 80:
        f.append(f"shape {shape(last)}")
    if few != "many" and all(len(x) < 100 for x in lines):
        f += [f"block {shape(lines[0])} {len(lines)} {c}", f"block {lines[0].strip().lower()[:16]} {len(lines) > 1} {shape(last[:1])}"]
        if len(lines) > 1:
            f.append(f"block {shape(lines[-2])} {shape(last)}")
    return _hashed(f)


def parts(text: str) -> tuple[str, bool]:
    """A text without white space and marks of omission at its end, and whether it had a mark."""
    body = text.rstrip()
    marked = False
    while m := _OMITTED.search(body, max(0, len(body) - 96)):
        kept = body[: m.start()].rstrip()
        body = kept + "." if body[m.start() :].startswith("....") else kept  # four dots are a full stop and a mark
        marked = True
        if not body:
            break
    return body, marked


def endings(body: str) -> list[str]:
    """The text, and the text without trailing page numbers and headers, where it has any."""
    out = [body]
    if body.count("\n") > 5:
        lines = body.split("\n")
        labels, header, number = label(lines)
        last = len(lines)
        while last and labels[last - 1] != BODY:
            last -= 1
        if (header or number) and 0 < last < len(lines):
            out.append("\n".join(x for x, k in zip(lines[:last], labels) if k not in (HEADER, NUMBER)).rstrip())
    if "\n" in body:
        rest, _, line = body.rpartition("\n")
        if page_number(line) and rest and not rest.endswith("\n"):
            out.append(rest.rstrip())
    return out


def _fit(x: np.ndarray, y: np.ndarray, steps: int) -> np.ndarray:
    """Weights of the log-odds of ``y``, both values weighing the same."""
    share = y.mean() if len(y) else 0.5
    each = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    weights, seen = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(weights[x].sum(axis=1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat((p - y) * each, x.shape[1]), minlength=WIDTH + 1) + 0.05 * weights
        g[WIDTH] = 0
        seen += g**2
        weights -= 0.5 * g / np.sqrt(seen)
    return weights


def fit_weights(real: list[list[int]], cuts: list[list[int]], steps: int = 100) -> np.ndarray:
    """Weights of the log-odds of a cut.

    Endings that look more like cuts, by a model that has not seen them (two halves judge each
    other), are left out of the next fit; features that fewer than ``COMMON`` endings have are not used.
    """
    longest = max((len(f) for f in (*real, *cuts)), default=1)

    def padded(rows: list[list[int]]) -> np.ndarray:
        return np.array([f + [WIDTH] * (longest - len(f)) for f in rows], dtype=np.int64).reshape(len(rows), longest)

    own, made = padded(real), padded(cuts)
    common = np.bincount(np.concatenate([own, made]).ravel(), minlength=WIDTH + 1) >= COMMON
    own, made = np.where(common[own], own, WIDTH), np.where(common[made], made, WIDTH)
    keep = np.ones(len(own), dtype=bool)
    half = np.arange(len(own)) % 2
    y = lambda k: np.concatenate([np.zeros(int(k.sum())), np.ones(len(made))])
    for _ in range(REFITS):
        out = np.zeros(len(own))
        for h in (0, 1):
            known = keep & (half == h)
            out[half != h] = _fit(np.concatenate([own[known], made]), y(known), steps)[own[half != h]].sum(axis=1)
        keep = out <= 0
    return _fit(np.concatenate([own[keep], made]), y(keep), steps).astype(np.float32)


_FEATURES = pa.schema([("real", pa.list_(pa.int32())), ("cuts", pa.list_(pa.list_(pa.int32())))])


def fit_endings(records: DataFrame, text_cols: dict[str, str], sample: int = SAMPLE) -> np.ndarray:
    """The model of endings, fitted on about ``sample`` values drawn by hash; features alone go to the driver."""
    values = records.select(F.explode(F.array(*[F.col(p).cast("string") for p in text_cols.values()])).alias("text")).filter(F.length("text") > 0)
    n = values.count()
    drawn = values.filter(F.pmod(F.xxhash64("text"), F.lit(max(n, 1))) < sample) if n > sample else values

    def kernel(texts: list) -> list:
        real, cuts = [], []
        for t in texts:
            body, marked = parts(t)
            inside = []
            for k in range(PLACES if len(t) > 40 else 0):
                at = 20 + zlib.crc32(f"{k} {len(t)} {t[:64]}".encode("utf-8", "surrogatepass")) % (len(t) - 20)
                if piece := t[:at].rstrip():
                    inside.append(features(piece))
            real.append(features(body) if body and not marked else None)
            cuts.append(inside)
        return [real, cuts]

    # copies of a text are one example
    rows = map_blocks(spread(drawn.distinct()), "text", kernel, "real array<int>, cuts array<array<int>>", _FEATURES).toArrow().to_pydict()
    return fit_weights([f for f in rows["real"] if f], [f for c in rows["cuts"] for f in c])


def log_odds(text: str | None, weights: np.ndarray) -> float:
    """Of a cut against a whole text, without any prior; null and blank texts are whole."""
    if text is None or not text.strip():
        return -100.0
    body, marked = parts(text)
    if not body or body.endswith("\ufffd"):
        return 100.0
    score = lambda t: float(weights[features(t)].sum()) if t else 0.0
    own = score(body)
    if own > -LIMIT_ODDS:  # what may be cut is looked at again without what stands behind the text
        own = min(map(score, endings(body)))
    return own + (MARKED if marked else 0.0)


LIMIT_ODDS = float(np.log(SUREST / (1 - SUREST)))


def lengths(text: str) -> list[int]:
    """The length of a text by each of ``MEASURES``."""
    n = len(text)
    utf8 = len(text.encode("utf-8", "surrogatepass"))
    wide = len(text.encode("utf-16-le", "surrogatepass")) // 2
    lines, tabs, quotes, slashes = text.count("\n"), text.count("\t"), text.count('"'), text.count("\\")
    entities = n + 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * quotes + 4 * text.count("'")
    json = n + lines + tabs + quotes + slashes + text.count("\r")
    ascii_ = n if utf8 == n else len(text.encode("ascii", "ignore"))
    return [n, utf8, wide, entities, json, json + 5 * (n - ascii_) + 6 * (wide - n), n + lines]


_INSPECTED = pa.schema([("id", pa.int64()), ("field", pa.string()), ("source", pa.string()), ("odds", pa.float64()), ("residue", pa.bool_()), *[(m, pa.int64()) for m in MEASURES]])


def inspect(records: DataFrame, id_col: str, text_cols: dict[str, str], source_col: str, residue_model=None, residue_fields: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """One row for each value that is not null: its source, the log-odds of its ending, lengths, and whether it holds residue."""
    weights = fit_endings(records, text_cols, sample)
    names = list(text_cols)
    columns = [F.col(p).cast("string").alias(f"f{k}") for k, p in enumerate(text_cols.values())]
    rows = spread(records.select(F.col(id_col).cast("bigint").alias("id"), F.lower(F.trim(F.col(source_col).cast("string"))).alias("source"), *columns))
    rows = rows.withColumn("all", F.concat(*[F.coalesce(f"f{k}", F.lit("")) for k in range(len(names))]))

    def kernel(ids: list, sources: list, *values: list) -> list:
        out: list[tuple] = []
        for name, texts in zip(names, values[:-1]):
            spans = localise(texts, residue_model)[0] if residue_model is not None and name in residue_fields else [()] * len(texts)
            out += [(i, name, s, log_odds(t, weights), bool(r), *lengths(t)) for i, s, t, r in zip(ids, sources, texts, spans) if t is not None]
        return [list(x) for x in zip(*out)] if out else [[] for _ in _INSPECTED]

    schema = "id bigint, field string, source string, odds double, residue boolean, " + ", ".join(f"{m} bigint" for m in MEASURES)
    return map_blocks(rows, "all", kernel, schema, _INSPECTED)


def _measured(values: DataFrame, *keep: str) -> DataFrame:
    """A row for each way of counting, for all sources and for the value's own."""
    ways = F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in MEASURES]), F.array(*MEASURES))).alias("measure", "length")
    scopes = F.explode(F.array(F.lit(ALL), F.coalesce("source", F.lit("")))).alias("scope")
    return values.select(*keep, "field", "source", ways).select(*keep, "field", scopes, "measure", "length")


def hidden_limits(inspected: DataFrame) -> DataFrame:
    """``field, scope, measure, length, n_values, excess``: lengths with many more values than those around them.

    ``scope`` is a source or ``ALL``; ``excess`` the part of the values that is more than around. Values are counted by length before anything is compared; a window over
    stretches of the distinct lengths then looks at counts only. A stretch also has the lengths near its ends, so that no
    length lacks neighbours.
    """
    counts = _measured(inspected).groupBy("field", "scope", "measure", "length").agg(F.count("*").alias("n_values"))
    near = F.array_distinct(F.array(*[F.floor((F.col("length") + k) / 4096) for k in (-AROUND, 0, AROUND)]))
    placed = counts.withColumn("stretch", F.explode(near))
    around = Window.partitionBy("field", "scope", "measure", "stretch").orderBy("length").rangeBetween(-AROUND, AROUND)
    mean = (F.sum("n_values").over(around) - F.col("n_values")) / (2.0 * AROUND)
    seen = placed.withColumn("mean", mean).filter(F.col("stretch") == F.floor(F.col("length") / 4096))
    found = seen.filter((F.col("n_values") >= LEAST) & (F.col("n_values") >= RATIO * F.greatest("mean", F.lit(0.5))))
    return found.select("field", "scope", "measure", "length", "n_values", (1 - F.col("mean") / F.col("n_values")).alias("excess"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def judged(inspected: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """The values without residue with ``cut`` and ``by_limit``, whether it takes the prior of a hidden limit to say so.

    ``inspected`` must be a fixed table. Only values whose ending leaves room for a limit's prior
    are joined with the limits.
    """
    base = float(np.log(BASE / (1 - BASE)))
    values = inspected.filter("not residue").withColumn("row", F.monotonically_increasing_id())
    sure = F.col("odds") + base > 0
    plain = values.select("id", "field", "source", sure.alias("cut"), F.lit(False).alias("by_limit"), "row")
    open_ = values.filter(~sure & (F.col("odds") + LIMIT_ODDS > 0))
    prior = (hidden_limits(inspected) if limits is None else limits).select("field", "scope", "measure", "length", _logit(F.least("excess", F.lit(SUREST))).alias("prior"))
    if prior.count() <= BROADCAST_ROWS:
        prior = F.broadcast(prior)
    met = _measured(open_, "row", "odds").join(prior, ["field", "scope", "measure", "length"]).groupBy("row").agg((F.max("prior") + F.first("odds") > 0).alias("limit")).filter("limit")
    out = plain.join(met, "row", "left")
    by_limit = F.coalesce("limit", F.lit(False))
    return out.select("id", "field", "source", (F.col("cut") | by_limit).alias("cut"), by_limit.alias("by_limit"))


def find_truncated(inspected: DataFrame) -> DataFrame:
    """``id, field``: the values that end inside a word or a sentence, residue left out."""
    return judged(inspected).filter("cut").select("id", "field").distinct()


def truncation_report(inspected: DataFrame) -> DataFrame:
    """``source, field, n_values, n_cut, share_cut, n_by_limit``, by the verdict of ``find_truncated``."""
    return (
        judged(inspected)
        .groupBy("source", "field")
        .agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"), F.count_if("by_limit").alias("n_by_limit"))
        .withColumn("share_cut", F.col("n_cut") / F.col("n_values"))
    )
