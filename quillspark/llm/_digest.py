"""Classes of equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._buckets import BROADCAST_ROWS
from quillspark.session import cut


def with_digest(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``digest``, a number that two different texts of ``rows`` do not share.

    It is the text's 64-bit hash. Texts are first grouped by it; where one value has two values
    of a second hash, which is seeded differently, the second one (marked) is used instead, so
    that 128 bits decide what is equal. Such values are counted before they are broadcast.
    """
    first, second = F.xxhash64(text), F.xxhash64(F.lit(0x5BD1E995), F.col(text))
    two = rows.groupBy(first.alias("digest")).agg((F.min(second) < F.max(second)).alias("two")).filter("two").select("digest", F.lit(True).alias("two_"))
    shared = cut(two)
    n = shared.count()
    out = rows.withColumn("digest", first)
    if not n:
        return out
    marked = out.join(F.broadcast(shared) if n <= BROADCAST_ROWS else shared, "digest", "left")
    return marked.withColumn("digest", F.when(F.col("two_"), F.xxhash64("digest", second)).otherwise(F.col("digest"))).drop("two_").select(*rows.columns, "digest")
