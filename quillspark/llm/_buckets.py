"""Rows that share a key, and pairs of items that share a bucket, without holding an unbounded group.

``maybe_shared`` counts keys and lets only rows of shared ones (and a few more) be moved, by a bitmap of fixed size.
``shared_rows`` counts keys first, with partial aggregates before the exchange, and joins the
shared ones back: by broadcast while they are fewer than ``BROADCAST_ROWS`` (counted, not
guessed), else by a join that adaptive execution can split where a key is hot.

``bucket_pairs`` cuts buckets into blocks of about ``BLOCK`` items by a hash of the item, as
many as the bucket's count asks for. A bucket of one block is compared in place; one of
several gives a group for each two of its blocks, so that a hot bucket's work is spread over
as many tasks as it has block pairs. Buckets that hold the same items (equal counts and two sums
of 40 bits of the items' hashes) are compared once. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._hashing import U, mix
from quillspark.session import cut

BLOCK = 512
BROADCAST_ROWS = 500_000
#: Bits of the bitmap of shared keys.
FILTER_BITS = 1 << 26

_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shared_rows(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of keys that have two values, with ``members``, the number of the key's rows.

    ``rows`` is computed twice, which costs less than writing it.
    """
    counts = rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("members"))
    shared = cut(counts.filter("lo < hi").select(key, "members"))
    small = shared.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(shared) if small else shared, key)


def _filter_words(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits with those of the keys set, made of partial bitmaps; its size does not depend on the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for b in batches:
            at = _place(b.column(0).to_numpy())
            np.bitwise_or.at(flags, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        words = flags.view(np.int64)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(words[some])], names=["word", "bits"])

    rows = keys.mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _place(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U)) >> U(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def maybe_shared(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose key no other row has, but for a few.

    Keys alone are counted; a bitmap of those that come twice, of one size whatever the data, goes
    to all tasks, and ``rows`` is made again and only what the bitmap lets through is moved. A
    full bitmap lets everything through, so nothing is ever lost.
    """
    twice = rows.select(key).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    words = rows.sparkSession.sparkContext.broadcast(_filter_words(twice))
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = words.value
        for b in batches:
            place = _place(b.column(at).to_numpy())
            yield b.filter(pa.array((flags[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))

    return rows.mapInArrow(run, rows.schema)


def bucket_pairs(rows: DataFrame, ratio: float) -> DataFrame:
    """Distinct ``a < b`` of ``id`` values that share a ``bucket`` with sizes at least ``ratio`` alike.

    ``rows`` has ``bucket BIGINT, id BIGINT, size INT``; repeated rows count once.
    """
    met = cut(maybe_shared(rows, "bucket").select("bucket", "id", "size").distinct())
    h = F.xxhash64("id")
    # buckets of the same items say the same: one of them is enough
    sums = met.groupBy("bucket").agg(F.count("*").alias("n"), F.try_sum(h.bitwiseAND((1 << 40) - 1)).alias("low_sum"), F.try_sum(F.shiftrightunsigned(h, 24)).alias("high_sum"))
    alone = F.when(F.col("low_sum").isNull() | F.col("high_sum").isNull(), F.col("bucket"))
    kept = sums.filter("n > 1").groupBy("n", "low_sum", "high_sum", alone.alias("alone")).agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.col("n") / BLOCK)
    shared = met.join(kept.select("bucket", "n"), "bucket").select("bucket", "id", "size", blocks.cast("int").alias("blocks"), F.pmod(h, blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    grouped = shared.select("bucket", "id", "size", "block", other).select("bucket", F.least("other", "block").alias("low"), F.greatest("other", "block").alias("high"), "block", "id", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)], axis=1))
            rows_ = np.concatenate(held)
            new = np.flatnonzero((rows_[1:, :3] != rows_[:-1, :3]).any(axis=1)) + 1
            if not len(new):
                held = [rows_]
                continue
            yield _pairs(rows_[: new[-1]], ratio)
            held = [rows_[new[-1] :]]
        if held:
            yield _pairs(np.concatenate(held), ratio)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = grouped.repartition(n, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return placed.mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(rows: np.ndarray, ratio: float) -> pa.RecordBatch:
    """The pairs of whole groups; a group has at most two blocks."""
    edges = np.concatenate([[0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1, [len(rows)]])
    left, right = [], []
    sizes = np.diff(edges)
    for size in np.unique(sizes):
        starts = edges[:-1][sizes == size]
        if size < 2:
            continue
        step = max(1, 4_000_000 // int(size * size))
        p, q = np.triu_indices(size, 1)
        for k in range(0, len(starts), step):
            at = starts[k : k + step, None]
            i, j = (at + p).ravel(), (at + q).ravel()
            own = rows[i, 1] == rows[i, 2]  # one block with itself
            ok = own | (rows[i, 3] != rows[j, 3])
            a, b, m, n = rows[i, 4], rows[j, 4], rows[i, 5], rows[j, 5]
            ok &= (a != b) & (np.minimum(m, n) >= ratio * np.maximum(m, n))
            left.append(np.minimum(a, b)[ok])
            right.append(np.maximum(a, b)[ok])
    if not left:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, schema=_PAIRS)
    both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=_PAIRS)
