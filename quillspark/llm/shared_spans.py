"""Long spans that stand word for word in more than one text, by prefix-partitioned suffix trees.

A span of ``LENGTH`` characters is a node of string depth ``LENGTH`` in the suffix tree of all
texts that has suffixes of two texts below it. The tree is built in parts that fit in memory:

* Suffixes are split by prefixes of variable length. The prefix of a suffix ends where the
  ``ANCHOR`` characters with the least hash of its first ``LENGTH`` characters end, so it has
  ``ANCHOR`` to ``LENGTH`` characters and equal paths have equal prefixes. No suffix is left out.
  Suffixes whose prefixes end with the same anchor are one group: neighbouring suffixes of a text
  share their anchor and travel as one slice of text, where prefixes of a fixed length would
  scatter them over as many groups and send every character ``LENGTH`` times.
* Suffixes are counted by anchor (partial aggregates before the exchange). An anchor that only one
  text has cannot be above a shared node; its suffixes are not sent. A group of more than
  ``GROUP`` anchors is split by longer prefixes, the whole ``LENGTH`` characters of each suffix,
  so that no group holds a hot passage in one task; nothing is capped.
* A group's subtree is a suffix array with longest common prefixes: the slices are sorted by what
  follows the anchor and by what stands before it (read backwards), and neighbours are compared
  character by character. A suffix that starts ``o`` characters before its anchor has
  its node at depth ``LENGTH`` where the following characters agree for ``LENGTH - o`` and the
  preceding ones for ``o``; the nodes of all ``o`` are read off the two arrays.

In a stretch of short period the same anchor comes once a period. Those suffixes whose slices all
lie inside the stretch have equal slices, so the first stands for them and carries the position
of the last (``until``); those nearer to an end are all kept. This is a run-length code, not a cap.

Texts that are equal are one class from the start (128 bits of hash decide); classes become pairs
of documents at the end.

Defined results
    null texts and texts shorter than ``LENGTH`` share nothing; a passage that is repeated in
    one text only is no case; equal texts share all of their length; rows repeated under one id
    count once; empty tables give empty results; further columns are ignored; rows with a
    null id are left out. Spans are compared as code points, case and white space included.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._arrow import map_blocks
from quillspark.llm._buckets import BROADCAST_ROWS, bucket_pairs, shared_rows
from quillspark.llm._digest import with_digest
from quillspark.llm._hashing import U, codes, mix, runs, window_min
from quillspark.session import cut, spread

LENGTH = 200
#: Characters of an anchor, the least length of a prefix.
ANCHOR = 128
#: Anchors that a group's subtree holds; larger groups are split by longer prefixes.
GROUP = 2048
#: Anchors whose subtrees are built at a time.
BLOCK = 8192
#: Characters of a text that are hashed at a time.
SEGMENT = 1_000_000
#: Equal anchors this close together are one periodic stretch (run-length code); at most half of ``ANCHOR``, so that all have one period.
PERIOD = 64

_CHOSEN = pa.schema([("prefix", pa.int64()), ("digest", pa.int64()), ("pos", pa.int32()), ("until", pa.int32())])
_SLICES = pa.schema(
    [("prefix", pa.int64()), ("hot", pa.bool_()), ("digest", pa.int64()), ("pos", pa.int32()), ("until", pa.int32()), ("left", pa.string()), ("right", pa.string()), ("paths", pa.list_(pa.int64())), ("checks", pa.list_(pa.int32()))]
)


def chosen(texts: list[str], length: int = LENGTH, prefix: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position, last position that it stands for, and key of the chosen suffixes of texts of at least ``length`` characters."""
    c = codes("".join(texts))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    stops = np.cumsum(sizes)
    key = runs(c, prefix)
    w = length - prefix + 1
    low = window_min(key, w)
    whole = np.zeros(len(low) + 1, dtype=np.int8)  # windows that leave their text choose nothing
    np.add.at(whole, stops - sizes, 1)
    np.add.at(whole, stops - length + 1, -1)
    high = np.where(np.cumsum(whole[:-1]) > 0, ~low, np.iinfo(np.uint64).max)
    pad = np.full(w - 1, np.iinfo(np.uint64).max, dtype=U)
    # a suffix is chosen if it is the least of some window: the largest of its windows' minima
    top = ~window_min(np.concatenate([pad, high, pad]), w)
    pos = np.flatnonzero((top == key) & (top != 0))
    key = key[pos]
    order = np.lexsort((pos, key))
    p, k = pos[order], key[order]
    far = np.flatnonzero((k[1:] != k[:-1]) | (p[1:] - p[:-1] > min(PERIOD, prefix // 2))) + 1
    first = np.concatenate([[0], far]).astype(np.int64)[: len(p)]
    last = np.concatenate([far, [len(p)]]).astype(np.int64)[: len(p)] - 1
    stretch = np.repeat(np.arange(len(first)), last - first + 1)
    # all paths of these lie inside the stretch: they are the same paths
    inner = (p - p[first][stretch] >= length - prefix) & (p[last][stretch] - p >= length - prefix)
    until = p.copy()
    at = np.flatnonzero(inner)
    keep = ~inner
    if len(at):
        new = np.flatnonzero(np.concatenate([[True], stretch[at[1:]] != stretch[at[:-1]]]))
        keep[at[new]] = True
        until[at[new]] = p[at[np.concatenate([new[1:], [len(at)]]) - 1]]
    p, k, until = p[keep], k[keep], until[keep]
    own = np.searchsorted(stops, p, side="right")
    return own, p - (stops - sizes)[own], until - (stops - sizes)[own], k


def _paths(text: str, pos: np.ndarray, length: int, prefix: int) -> np.ndarray:
    """For each anchor the hashes of the paths of ``length`` that start up to ``length - prefix`` before it; 0 where the text has none."""
    width = length - prefix + 1
    out = np.zeros((len(pos), width), dtype=U)
    for k in range(0, max(len(text) - length + 1, 0), SEGMENT):
        h = runs(codes(text[k : k + SEGMENT + length - 1]), length)
        at = pos[:, None] - np.arange(width)[None, :] - k
        ok = (at >= 0) & (at < len(h))
        out[ok] = h[at[ok]] | U(1)
    return out


def _checks(text: str, pos: np.ndarray, length: int, prefix: int) -> np.ndarray:
    """A second hash of the same paths, independent of the first."""
    out = np.zeros((len(pos), length - prefix + 1), dtype=np.int32)
    for i, p in enumerate(pos):
        for o in range(out.shape[1]):
            if p >= o:
                out[i, o] = zlib.crc32(text[p - o : p - o + length].encode("utf-8", "surrogatepass")) & 0x7FFFFFFF
    return out


def _base(documents: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter((F.length("text") >= length) & F.col("id").isNotNull())
    return with_digest(rows)


def _slices(base: DataFrame, length: int, prefix: int) -> DataFrame:
    """The slices around anchors that two texts have: ``left`` and ``right`` of the anchor's place, or, in groups too large, the paths of its suffixes."""

    def choose(digests: list, texts: list) -> list:
        # very long texts are read in overlapping segments; every path is whole in one of them
        segments = [(d, k, t[k : k + SEGMENT + length - 1]) for d, t in zip(digests, texts) for k in range(0, max(len(t) - length + 1, 1), SEGMENT)]
        own, pos, until, key = chosen([t for *_, t in segments], length, prefix)
        start = np.array([k for _, k, _ in segments], dtype=np.int64)
        return [key.view(np.int64), np.array([d for d, *_ in segments], np.int64)[own], (pos + start[own]).astype(np.int32), (until + start[own]).astype(np.int32)]

    keys = map_blocks(spread(base.select("digest", "text")), "text", choose, "prefix bigint, digest bigint, pos int, until int", _CHOSEN, once="digest")
    shared = (
        shared_rows(keys, "prefix", "digest")
        .groupBy("digest")
        .agg(F.collect_set(F.struct("pos", "until", "prefix", (F.col("members") > GROUP).alias("hot"))).alias("anchors"))
    )
    ids = base.groupBy("digest").agg(F.min("id").alias("id"))
    wanted = cut(shared.join(ids, "digest"))
    own = wanted.select("id").distinct()
    if own.count() <= BROADCAST_ROWS:  # then only those texts are moved
        own = F.broadcast(own)
    texts = base.select("id", F.col("digest").alias("own"), "text").join(own, "id", "left_semi").join(wanted, "id").filter("own = digest").dropDuplicates(["digest"])

    def expand(digests: list, anchors: list, texts: list) -> list:
        out: list[tuple] = []
        for d, s, t in zip(digests, anchors, texts):
            hot = [x for x in s if x["hot"]]
            for x in s:
                p = x["pos"]
                if not x["hot"]:
                    out.append((x["prefix"], False, d, p, x["until"], t[max(p - length + prefix, 0) : p], t[p : p + length], None, None))
            pos = np.array([x["pos"] for x in hot], dtype=np.int64)
            for x, path, check in zip(hot, _paths(t, pos, length, prefix), _checks(t, pos, length, prefix)):
                out.append((x["prefix"], True, d, x["pos"], x["until"], None, None, path.view(np.int64), check))
        return [list(x) for x in zip(*out)] if out else [[] for _ in _SLICES]

    schema = "prefix bigint, hot boolean, digest bigint, pos int, until int, left string, right string, paths array<bigint>, checks array<int>"
    return map_blocks(texts.select("digest", "anchors", "text"), "text", expand, schema, _SLICES)


def _matrix(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts of at most ``width`` characters, one a row, and their numbers."""
    have = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), width), 0xFFFFFFFF, dtype=np.uint32)
    out[np.arange(width)[None, :] < have[:, None]] = codes("".join(texts))
    return out, have


def _array(group: np.ndarray, chars: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of each group, one behind the other, and how far each suffix agrees with the one before it (-1 between groups)."""
    wide = np.concatenate([group.astype(">u4")[:, None], chars.astype(">u4")], axis=1)
    order = np.argsort(np.ascontiguousarray(wide).view(f"S{wide.shape[1] * 4}").ravel(), kind="stable")
    a, h, g = chars[order], have[order], group[order]
    differ = a[1:] != a[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), chars.shape[1])
    common = np.minimum(common, np.minimum(h[1:], h[:-1]))
    return order, np.concatenate([[-1], np.where(g[1:] == g[:-1], common, -1)])


def subtree_nodes(group: np.ndarray, left: list[str], right: list[str], length: int, prefix: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each ``o`` the number of the node of depth ``length`` that each anchor's suffix starting ``o`` before it has.

    ``left`` is what stands before an anchor's place, ``right`` what follows from it on; ``group``
    does not fall.
    """
    n, most = len(group), length - prefix
    after, common_after = _array(group, *_matrix(right, length))
    before, common_before = _array(group, *_matrix([t[::-1] for t in left], most))
    follows, precedes = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(most + 1):
        follows[after] = np.cumsum(common_after < length - o)
        precedes[before] = np.cumsum(common_before < o)
        yield o, follows * (n + 1) + precedes


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list, list]]:
    """``group, digest, pos, until, left, right`` of whole groups of rows sorted by prefix, about ``BLOCK`` rows at a time."""
    held: list[pa.RecordBatch] = []

    def columns(t: pa.Table) -> tuple:
        prefix, digest, pos, until = (t.column(i).to_numpy() for i in range(4))
        group = np.cumsum(np.concatenate([[0], prefix[1:] != prefix[:-1]]))
        return group, digest, pos.astype(np.int64), until.astype(np.int64), t.column(4).to_pylist(), t.column(5).to_pylist()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            t = pa.Table.from_batches(held)
            prefix = t.column(0).to_numpy()
            new = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
            if len(new):
                yield columns(t.slice(0, int(new[-1])))
                held = t.slice(int(new[-1])).to_batches()
    if held:
        yield columns(pa.Table.from_batches(held))


def _sorted_groups(slices: DataFrame) -> DataFrame:
    n = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slices.filter("not hot").select("prefix", "digest", "pos", "until", "left", "right").repartition(n, "prefix").sortWithinPartitions("prefix")


def _hot_nodes(slices: DataFrame) -> DataFrame:
    """Nodes of groups split by whole paths: ``path, check, digest, start, reach``."""
    both = F.arrays_zip("paths", "checks")
    one = slices.filter("hot").select("digest", "pos", (F.col("until") - F.col("pos")).alias("reach"), F.posexplode(both).alias("back", "node")).filter("node.paths <> 0")
    return one.select(F.col("node.paths").alias("path"), F.col("node.checks").alias("check"), "digest", (F.col("pos") - F.col("back")).alias("start"), "reach").distinct()


def _links(slices: DataFrame, length: int, prefix: int) -> DataFrame:
    """``a < b``: digests of texts that share a span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, digest, _, _, left, right in _groups(batches):
            seen: tuple | None = None
            for _, node in subtree_nodes(group, left, right, length, prefix):
                order = np.argsort(node, kind="stable")
                sorted_ = node[order]
                edges = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(order)]])
                sizes = np.diff(edges)
                first, own = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
                first[order], own[order] = np.repeat(order[edges[:-1]], sizes), np.repeat(sizes, sizes)
                # a node with the members that it had one character further on says nothing new
                new = np.ones(len(order), bool) if seen is None else (first != seen[0]) | (own != seen[1])
                seen = first, own
                changed = np.logical_or.reduceat(new[order], edges[:-1])
                for size in np.unique(sizes[changed & (sizes > 1)]):
                    starts = edges[:-1][changed & (sizes == size)]
                    p, q = np.triu_indices(size, 1)
                    step = max(1, 1_000_000 // len(p))
                    for k in range(0, len(starts), step):
                        i, j = order[(starts[k : k + step, None] + p).ravel()], order[(starts[k : k + step, None] + q).ravel()]
                        ok = digest[i] != digest[j]
                        if ok.any():
                            pairs = np.unique(np.sort(np.stack([digest[i[ok]], digest[j[ok]]], axis=1), axis=1), axis=0)
                            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    cold = _sorted_groups(slices).mapInArrow(run, "a bigint, b bigint")
    # a node's second hash stands where sizes are compared, which must then be equal
    hot = bucket_pairs(_hot_nodes(slices).select(F.col("path").alias("bucket"), F.col("digest").alias("id"), F.col("check").alias("size")), 1.0)
    return cold.union(hot).distinct()


def _spans(slices: DataFrame, length: int, prefix: int) -> DataFrame:
    """``digest, start, stop``: stretches of texts that stand in another text, not yet merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, digest, pos, until, left, right in _groups(batches):
            most, least = np.full(len(pos), -1), np.full(len(pos), length)
            for o, node in subtree_nodes(group, left, right, length, prefix):
                order = np.argsort(node, kind="stable")
                sorted_ = node[order]
                edges = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1])
                d = digest[order]
                two = np.minimum.reduceat(d, edges) != np.maximum.reduceat(d, edges)
                ok = order[np.repeat(two, np.diff(np.append(edges, len(order))))]
                most[ok] = o
                least[ok] = np.minimum(least[ok], o)
            ok = most >= 0
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(digest[ok]), pa.array((pos - most)[ok].astype(np.int32)), pa.array((until - least + length)[ok].astype(np.int32))], names=["digest", "start", "stop"])

    cold = _sorted_groups(slices).mapInArrow(run, "digest bigint, start int, stop int")
    nodes = _hot_nodes(slices).select(F.struct("path", "check").alias("node"), "digest", "start", "reach")
    hot = shared_rows(nodes, "node", "digest").select("digest", F.col("start").cast("int"), (F.col("start") + F.col("reach") + length).cast("int").alias("stop"))
    return cold.union(hot)


def sharing_pairs(documents: DataFrame, id_col: str, text_col: str, length: int = LENGTH, prefix: int = ANCHOR) -> DataFrame:
    """Every pair ``id_a < id_b`` of documents with ``length`` consecutive characters in common."""
    base = _base(documents, id_col, text_col, length)
    links = _links(cut(_slices(base, length, prefix)), length, prefix)
    ids = base.select("id", "digest").distinct()
    left = ids.select(F.col("id").alias("x"), F.col("digest").alias("a"))
    right = ids.select(F.col("id").alias("y"), F.col("digest").alias("b"))
    linked = links.join(left, "a").join(right, "b").select("x", "y")
    copies = left.join(right, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    return linked.union(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).filter("id_a < id_b").distinct()


def shared_passages(documents: DataFrame, id_col: str, text_col: str, length: int = LENGTH, prefix: int = ANCHOR) -> DataFrame:
    """``id, start, stop``: the longest stretches of each document that stand elsewhere.

    Overlapping stretches are merged; a document with copies stands elsewhere as a whole.
    """
    base = _base(documents, id_col, text_col, length)
    classes = base.groupBy("digest").agg(F.countDistinct("id").alias("copies"), F.max(F.length("text")).alias("n"))
    whole = classes.filter("copies > 1").select("digest", F.lit(0).alias("start"), F.col("n").alias("stop"))
    spans = _spans(cut(_slices(base, length, prefix)), length, prefix).union(whole)
    order = Window.partitionBy("digest").orderBy("start", "stop")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    merged = (
        spans.distinct()
        .withColumn("new", (F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("int"))
        .withColumn("run", F.sum("new").over(order))
        .groupBy("digest", "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    ids = base.select("id", "digest").distinct()
    return merged.join(ids, "digest").select("id", "start", "stop")


def shared_report(documents: DataFrame, id_col: str, text_col: str, length: int = LENGTH, prefix: int = ANCHOR) -> DataFrame:
    """One row for each document: ``id, n_chars, n_passages, shared_chars, shared_part``."""
    spans = shared_passages(documents, id_col, text_col, length, prefix)
    own = spans.groupBy("id").agg(F.count("*").alias("n_passages"), F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
    everyone = documents.select(F.col(id_col).cast("bigint").alias("id"), F.length(text_col).alias("n_chars")).filter("id is not null").groupBy("id").agg(F.max("n_chars").alias("n_chars"))
    return everyone.join(own, "id", "left").select(
        "id",
        F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
        F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0).alias("shared_part"),
    )
