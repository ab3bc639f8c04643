"""Near-duplicate texts by PartEnum signatures.

The features of a text are the hashes of its distinct runs of ``SHINGLE`` lower-cased words.
Sets are put into size bands of ratio two; as similar sets differ in size by a factor of at
most 1/threshold < 2, a set whose size reaches into the next band signs there too. In a band
the feature domain (the hash range) is partitioned into parts, and the signatures are

* for sets under 24 features (texts that repeat themselves) and those they can be similar to:
  every feature;
* for larger sets: the parts of several independent partitions that hold ``LEAST`` features.

Two sets share a signature if a part holds the same features. With parts this large that is
not certain by the pigeonhole; instead the number of partitions of each band is counted so
that a pair at the threshold itself is missed with a chance of about ``MISS``, for each size
of the band, and more similar pairs more rarely; ``exact=True`` takes signatures that miss nothing instead. Subsets with too few features would tie unrelated texts and are not
signatures. Candidates are then compared exactly.

Texts that are equal are one class from the start (128 bits decide), so that a text copied a
million times signs as one set; copies become pairs only where the result's form asks for it.

Defined results
    null texts and texts under ``min_words`` words are in no pair; equal texts have similarity
    1; a row that is repeated under one id is no pair with itself; empty tables give empty
    results; further columns are ignored. A null id is dropped from pairs, as it names nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._arrow import map_blocks
from quillspark.llm._buckets import bucket_pairs
from quillspark.llm._digest import with_digest
from quillspark.llm._hashing import U, mix, shingles
from quillspark.session import cut, spread

SHINGLE = 3
#: Common features that a part must hold to be a signature.
LEAST = 4
#: Common features of a part, on average, of the smallest sets of a band.
PER_PART = 1.9
#: Chance of no common signature that a pair at the threshold may have.
MISS = 1e-4
#: Sets up to this size sign every feature.
TINY = 24

_SIGNED = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("size", pa.int32())])
_SETS = pa.schema([("digest", pa.int64()), ("n_words", pa.int64()), ("features", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("taken", pa.int64())])


def _ranges(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def partitions(band: int, threshold: float) -> tuple[int, int]:
    """Parts of a partition for sets of a band, and how many partitions keep the miss chance to ``MISS``.

    Two sets of the band at the threshold have ``c`` common features, ``threshold * 2 ** band``
    at least and ``4 * threshold / (1 + threshold) * 2 ** band`` at most, and ``c * (1 -
    threshold) / threshold`` that differ. A part is a shared signature if it has none of the
    latter and ``LEAST`` of the former; the rarest case over the band is counted.
    """
    low, high = threshold * 2**band, 4 * threshold / (1 + threshold) * 2**band
    parts = max(2, round(low / PER_PART))

    def shared(c: float) -> float:
        x = c / parts
        few = sum(math.comb(math.ceil(c), k) * (1 / parts) ** k * (1 - 1 / parts) ** (math.ceil(c) - k) for k in range(LEAST)) if c < 100 else math.exp(-x) * sum(x**k / math.factorial(k) for k in range(LEAST))
        return (1 - 1 / parts) ** (c * (1 - threshold) / threshold) * (1 - few)

    return parts, math.ceil(math.log(MISS) / math.log1p(-min(shared(low), shared(high))) / parts)


def signatures(features: np.ndarray, own: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``n`` sets (features sorted within each) and the set of each signature."""
    size = np.bincount(own, minlength=n)
    at = _ranges(size)
    band = np.zeros(n, dtype=np.int64)
    some = size > 0
    band[some] = np.floor(np.log2(size[some])).astype(np.int64)
    out, whose = [], []
    # two sets of which one has under TINY features share a feature: each is a signature
    tiny = size[own] * threshold < TINY
    out.append(mix(features[tiny] + U(0x8EBC6AF09C88C6E3)))
    whose.append(own[tiny])
    some &= size >= TINY
    for up in (0, 1):
        for b in np.unique(band[some] + up) if some.any() else []:
            sets = np.flatnonzero(some & (band + up == b) & ((up == 0) | (size >= threshold * 2.0**b)))
            if not len(sets):
                continue
            parts, repeats = partitions(int(b), threshold)
            lens = size[sets]
            starts = _ranges(lens)
            f = features[np.repeat(at[sets] - starts[:-1], lens) + np.arange(starts[-1])]
            row = np.repeat(np.arange(len(sets)), lens)
            value = mix(f)
            for k in range(repeats):
                own_part = ((mix(f + U(k * 0xD6E8FEB86659FD93 % 2**64)) >> U(40)) * U(parts)) >> U(24)
                cell = row * parts + own_part.astype(np.int64)
                total = np.zeros(len(sets) * parts, U)
                np.add.at(total, cell, value)
                keep = np.flatnonzero(np.bincount(cell, minlength=len(total)) >= LEAST)
                out.append(mix(total[keep] * U(0xA0761D6478BD642F) + (keep % parts + k * parts).astype(U) * U(0x8EBC6AF09C88C6E3) + U(b)))
                whose.append(sets[keep // parts])
    return np.concatenate(out), np.concatenate(whose)


def _keyed(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return with_digest(records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null"))


def _sign(base: DataFrame, min_words: int, threshold: float) -> DataFrame:
    def kernel(digests: list, texts: list) -> list:
        f, own, n_words = shingles(texts, SHINGLE)
        ok = n_words[own] >= max(min_words, SHINGLE)
        f, own = f[ok], own[ok]
        sig, whose = signatures(f, own, len(texts), threshold)
        size = np.bincount(own, minlength=len(texts)).astype(np.int32)
        return [pa.array(sig.view(np.int64)), pa.array(np.array(digests, dtype=np.int64)[whose]), pa.array(size[whose])]

    return map_blocks(base.select("digest", "text"), "text", kernel, "bucket bigint, id bigint, size int", _SIGNED, once="digest")


def _feature_sets(base: DataFrame) -> DataFrame:
    def kernel(digests: list, texts: list) -> list:
        f, own, n_words = shingles(texts, SHINGLE)
        at = _ranges(np.bincount(own, minlength=len(texts))).astype(np.int32)
        bits = [_bits(f[i:j]) for i, j in zip(at[:-1], at[1:])]
        taken = [int(np.bitwise_count(x).sum()) for x in bits]
        bits_at = _ranges(np.array([len(x) for x in bits], dtype=np.int64)).astype(np.int32)
        lists = (pa.ListArray.from_arrays(pa.array(a), pa.array(x.view(np.int64))) for a, x in ((at, f), (bits_at, np.concatenate(bits))))
        return [digests, n_words, *lists, taken]

    return map_blocks(base.select("digest", "text"), "text", kernel, "digest bigint, n_words bigint, features array<bigint>, bits array<bigint>, taken bigint", _SETS)


def _bits(features: np.ndarray) -> np.ndarray:
    """A bitmap of the features with two to four bits for each, 2048 at least."""
    n = max(2048, 4 << (len(features).bit_length() - 1)) if len(features) else 2048
    flags = np.zeros(n, dtype=np.uint8)
    flags[(features % U(n)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(U)


def _most_common(a: str, b: str) -> Column:
    """An upper bound of the number of common features, from the bitmaps.

    Common features fall on common bits, one a bit but for the features beyond the first on
    a bit, of which the set with fewer of them bounds the number. A bitmap of twice the
    length folds onto the other by OR; its set has more such features then than ``taken``
    says, so only the other set bounds them.
    """
    def folded(x: str, y: str) -> Column:
        n = F.size(y)
        halves = F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseOR(q))
        return F.when(F.size(x) > n, halves).otherwise(F.col(x))

    met = F.zip_with(folded(f"bits_{a}", f"bits_{b}"), folded(f"bits_{b}", f"bits_{a}"), lambda p, q: p.bitwiseAND(q))
    extra_a, extra_b = (F.col(f"n_{x}") - F.col(f"taken_{x}") for x in (a, b))
    size_a, size_b = F.size(f"bits_{a}"), F.size(f"bits_{b}")
    extra = F.when(size_a > size_b, extra_b).when(size_b > size_a, extra_a).otherwise(F.least(extra_a, extra_b))
    return F.aggregate(met, F.lit(0).cast("bigint"), lambda n, x: n + F.bit_count(x)) + extra


def _rarest(base: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """Signatures that miss nothing: the rarest features of each set.

    Two sets at the threshold have all but ``size - ceil(threshold * size)`` features of either in
    common; put in one order, one more than so many first features of each share one. The order is
    by the number of sets that have a feature, rarest first, so buckets stay small.
    """
    sets = cut(_feature_sets(base.select("digest", "text").dropDuplicates(["digest"])).filter(F.col("n_words") >= max(min_words, SHINGLE)).select("digest", "features"))
    rows = sets.select("digest", F.size("features").alias("size"), F.explode("features").alias("feature"))
    counts = rows.groupBy("feature").agg(F.count("*").alias("n")).filter("n > 1")
    # features of one set only come first in the order and need no bucket
    shared = rows.join(counts, "feature").groupBy("digest", "size").agg(F.sort_array(F.collect_list(F.struct("n", "feature"))).alias("known"))
    first = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("known"))
    kept = shared.filter(first > 0).select("digest", "size", F.explode(F.slice("known", F.lit(1), first.cast("int"))).alias("x"))
    return kept.select(F.col("x.feature").alias("bucket"), F.col("digest").alias("id"), "size")


def similar_classes(records: DataFrame, id_col: str, text_col: str, threshold: float = 0.6, min_words: int = 50, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``. With ``exact`` candidates come from signatures that miss nothing, at the cost of a join of all features.

    ``links``: ``a, b`` digests of different texts at least ``threshold`` similar.
    ``members``: ``id, digest`` of the records whose text is in a link or has copies, and
    has ``min_words`` words.
    """
    base = _keyed(records, id_col, text_col)
    signed = _rarest(spread(base), min_words, threshold) if exact else _sign(spread(base), min_words, threshold)
    candidates = cut(bucket_pairs(signed, threshold))
    ids = base.select("id", "digest").distinct()
    classes = ids.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    touched = candidates.select(F.explode(F.array("a", "b")).alias("digest")).distinct().withColumn("linked", F.lit(True))
    wanted = classes.join(touched, "digest", "left").filter("copies > 1 or linked").select("id", "digest")
    # an id may hold several texts: the digest says which one is meant
    texts = base.select("id", "digest", "text").join(wanted, ["id", "digest"]).groupBy("digest").agg(F.first("text").alias("text"))
    sets = cut(_feature_sets(texts).filter(F.col("n_words") >= max(min_words, SHINGLE)))
    one = lambda side, *what: sets.withColumn("n", F.size("features")).select(F.col("digest").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in what])
    bound = F.lit(threshold) * (F.col("n_a") + F.col("n_b")) / (1 + threshold)
    likely = candidates.join(one("a", "bits", "taken", "n"), "a").join(one("b", "bits", "taken", "n"), "b").filter(_most_common("a", "b") >= F.floor(bound)).select("a", "b")
    common = F.size(F.array_intersect("features_a", "features_b"))
    both = F.size("features_a") + F.size("features_b")
    links = (
        likely.join(one("a", "features"), "a")
        .join(one("b", "features"), "b")
        .select("a", "b", common.alias("common"), both.alias("both"))
        .filter(F.col("common") >= F.lit(threshold) * (F.col("both") - F.col("common")))
        .select("a", "b")
    )
    return links, ids.join(sets.select("digest"), "digest", "left_semi")


def similar_pairs(records: DataFrame, id_col: str, text_col: str, threshold: float = 0.6, min_words: int = 50, exact: bool = False) -> DataFrame:
    """Every pair ``id_a < id_b`` of records at least ``threshold`` similar, copies included."""
    links, members = similar_classes(records, id_col, text_col, threshold, min_words, exact)
    left = members.select(F.col("id").alias("x"), F.col("digest").alias("a"))
    right = members.select(F.col("id").alias("y"), F.col("digest").alias("b"))
    linked = links.join(left, "a").join(right, "b").select("x", "y")
    copies = left.join(right, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    return linked.union(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).filter("id_a < id_b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component, by alternating stars.

    Large-star and small-star steps in turn until nothing changes; each halves long chains, and
    every step's edges are written to the shared checkpoint folder.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        sides = edges.union(edges.select(F.col("v"), F.col("u")))
        low = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = cut(small)
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def similar_groups(records: DataFrame, id_col: str, text_col: str, threshold: float = 0.6, min_words: int = 50) -> DataFrame:
    """One row for each record: ``id, group_id, n_links``.

    ``group_id`` is the smallest id of the records that are joined by links, the record's own
    id where it has none; ``n_links`` counts the links of its text to different texts.
    """
    links, members = similar_classes(records, id_col, text_col, threshold, min_words)
    links, members = cut(links), cut(members)
    degree = links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n_links"))
    placed = members.join(components(links).withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    first = placed.groupBy("root").agg(F.min("id").alias("group_id"))
    grouped = placed.join(first, "root").join(degree, "digest", "left").select("id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    everyone = records.select(F.col(id_col).cast("bigint").alias("id")).filter("id is not null").distinct()
    return everyone.join(grouped, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
