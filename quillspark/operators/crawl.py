"""Next-page chains and bounded crawls over tables of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut


def next_page_closure(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """``start, url, depth``: the pages on the chain from each start, the whole chain or at most ``most`` steps.

    ``edges`` has ``url, next``; a chain that comes back to a page ends there. Jumps of twice the
    length join what has been reached in each round, so a chain of n pages takes log2(n) rounds,
    each written to the shared checkpoint folder.
    """
    jump = cut(edges.filter("next is not null").select("url", F.col("next").alias("to")).distinct())
    seen = cut(starts.select(F.col("url").alias("start"), "url", F.lit(0).alias("depth")).distinct())
    n, length = seen.count(), 1
    while most is None or length <= most:
        further = seen.join(jump, "url").select("start", F.col("to").alias("url"), (F.col("depth") + length).alias("depth"))
        seen = cut(seen.union(further).groupBy("start", "url").agg(F.min("depth").alias("depth")))
        now = seen.count()
        if now == n:
            break
        n, length = now, length * 2
        onward = jump.withColumnRenamed("to", "middle").join(jump.select(F.col("url").alias("middle"), "to"), "middle")
        jump = cut(onward.select("url", "to").distinct())
    return seen if most is None else seen.filter(F.col("depth") <= most)


def bounded_crawl(links: DataFrame, starts: DataFrame, budget: int, per_page: int = 3) -> DataFrame:
    """``url, depth, rank``: breadth-first pages within a budget, a few new links from each page.

    ``links`` has ``url, pos, target``. Ties go to the earlier page, then to the earlier link.
    """
    visited = cut(starts.select("url").distinct().withColumn("depth", F.lit(0)).withColumn("rank", F.row_number().over(Window.partitionBy("depth").orderBy("url")) - 1))
    front, n = visited, visited.count()
    depth = 0
    while n < budget:
        depth += 1
        own = front.join(links, "url").select(F.col("url").alias("origin"), F.col("rank").alias("by"), "pos", F.col("target").alias("url")).filter("url is not null")
        new = own.join(visited.select("url"), "url", "left_anti")
        few = new.withColumn("k", F.row_number().over(Window.partitionBy("origin").orderBy("pos", "url"))).filter(F.col("k") <= per_page)
        first = few.groupBy("url").agg(F.min(F.struct("by", "pos")).alias("o"))
        # at most budget - n rows are kept, found by a top-k, not by a global sort
        best = first.orderBy("o", "url").limit(budget - n)
        numbered = best.withColumn("depth", F.lit(depth)).withColumn("rank", F.row_number().over(Window.partitionBy("depth").orderBy("o", "url")) - 1 + n)
        front = cut(numbered.select("url", "depth", "rank"))
        got = front.count()
        if not got:
            break
        visited, n = cut(visited.union(front)), n + got
    return visited
