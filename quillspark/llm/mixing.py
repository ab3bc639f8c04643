"""Mixing sources to target shares of the total tokens, by pivotal dependent rounding.

The total is ``total`` tokens, or, if that is not given, the largest that all shares allow: a
source gives at most ``max_repeats`` times its tokens, so the source that is shortest of its
share sets the total, and the rest of the others stays unused. Every record of a source has the
same fractional number of copies; its whole part
is taken, and the fractions are rounded in pairs: of two fractions mass is moved at random, so
that each keeps its expectation and their tokens keep their sum, until one is whole; the
other meets the next record. A partition leaves at most one fraction for each source; these
meet in a tree of ``FAN`` partitions each until one is left, which is rounded by chance.

The last fraction may be a long record's, whose rounding moves its source by as many tokens. A
correcting pass makes up for it: records of up to ``SHORT`` tokens, counted by their exact
length, get or give a copy each, longest first while they fit, so that a source's tokens differ
from its share by less than its shortest such record, whatever the size of the data. Only as many
records change as that one record's tokens ask for.

Defined results
    records without tokens or of a source without target have no uses; a null source has no
    target; a repeated row is a record of its own; targets are scaled to sum to one, those of
    sources without tokens are left out of the mix and stand in ``shares`` with nothing; without
    any target nothing is used; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._hashing import U, mix
from quillspark.session import cut

FAN = 32
#: Longest records that the correcting pass changes; bounds its counts at so many rows for each source.
SHORT = 4096

_STATE = pa.schema([("row", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64()), ("copies", pa.int64()), ("mass", pa.float64()), ("id", pa.int64())])
_STATE_SQL = "row bigint, source string, n_tokens bigint, copies bigint, mass double, id bigint"


def _chance(ids: np.ndarray, seed: int) -> np.ndarray:
    salt = U(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix(ids.astype(np.int64).view(U) + salt) >> U(11)).astype(np.float64) / float(1 << 53)


def pivot(tokens: list[int], mass: list[float], chance: list[float]) -> tuple[list[float], int]:
    """Rounded masses and the place of the one that may still be a fraction (-1 if none)."""
    tiny = 1e-9
    out = list(mass)
    held = -1
    for k in range(len(out)):
        if out[k] <= tiny or out[k] >= 1 - tiny:
            out[k] = float(round(out[k]))
            continue
        if held < 0:
            held = k
            continue
        w, v, x, y = tokens[held], tokens[k], out[held], out[k]
        up = min(1 - x, y * v / w)
        down = min(x, (1 - y) * v / w)
        if chance[k] * (up + down) < down:
            x, y = x + up, y - up * w / v
        else:
            x, y = x - down, y + down * w / v
        out[held], out[k] = x, y
        open_ = [i for i in (held, k) if tiny < out[i] < 1 - tiny]
        for i in (held, k):
            if i not in open_:
                out[i] = float(round(out[i]))
        held = open_[0] if open_ else -1
    return out, held


def _round(rows: DataFrame, seed: int) -> DataFrame:
    """One pass over each partition: masses become whole but for one of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            chance = _chance(b.column(0).to_numpy(), seed)
            by: dict[str, list[int]] = {}
            for k, s in enumerate(cols[1]):
                by.setdefault(s, []).append(k)
            done: list[tuple] = []
            for s, places in by.items():
                rows_ = [tuple(c[k] for c in cols) for k in places]
                luck = [chance[k] for k in places]
                if s in held:
                    rows_, luck = [held.pop(s), *rows_], [0.5, *luck]
                whole, left = pivot([r[2] for r in rows_], [r[4] for r in rows_], luck)
                for k, (r, m) in enumerate(zip(rows_, whole)):
                    if k == left:
                        held[s] = (*r[:4], m, r[5])
                    else:
                        done.append((*r[:3], r[3] + int(m), 0.0, r[5]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), _STATE)], schema=_STATE)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held.values()), _STATE)], schema=_STATE)

    return rows.select(*_STATE.names).mapInArrow(run, _STATE_SQL)


def rates(totals: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Copies of each record of a source, for ``total`` tokens or the largest total that all shares allow."""
    live = {s: t for s, t in targets.items() if totals.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    whole = sum(t[0] for t in live.values())
    if not live:
        return {}
    largest = min(totals[s] * most / (share / whole) for s, (share, most) in live.items())
    wanted = largest if total is None else min(total, largest)
    return {s: min(share / whole * wanted / totals[s], most) for s, (share, most) in live.items()}


def _corrections(state: DataFrame, copies: dict[str, float], totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[tuple[str, int], int]:
    """For a source and a length how many records of it get a copy (above 0) or give one."""
    most = state.sparkSession.createDataFrame([(s, int(targets[s][1])) for s in copies], "source string, most bigint")
    own = state.join(F.broadcast(most), "source")  # one row for each target
    used = {r["source"]: r["n"] for r in own.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
    short = own.filter(F.col("n_tokens").between(1, SHORT)).groupBy("source", "n_tokens").agg(F.count_if(F.col("copies") < F.col("most")).alias("more"), F.count_if(F.col("copies") > 0).alias("less"))
    stock: dict[str, list] = {}
    for r in short.collect():  # at most SHORT rows for each target
        stock.setdefault(r["source"], []).append((r["n_tokens"], r["more"], r["less"]))
    out: dict[tuple[str, int], int] = {}
    for s, rows in stock.items():
        off = copies[s] * totals[s] - used.get(s, 0)
        for n, more, less in sorted(rows, reverse=True):
            k = min(int(abs(off) // n), more if off > 0 else less)
            if k:
                out[s, n] = k if off > 0 else -k
                off -= n * k * (1 if off > 0 else -1)
        # the rest is less than the shortest record; take one more where that is nearer
        n = min(r[0] for r in rows)
        left = next(r for r in rows if r[0] == n)[1 if off > 0 else 2] - abs(out.get((s, n), 0))
        if abs(off) * 2 > n and left > 0:
            out[s, n] = out.get((s, n), 0) + (1 if off > 0 else -1)
    return out


def _corrected(state: DataFrame, changes: dict[tuple[str, int], int], targets: dict[str, tuple[float, int]], seed: int) -> DataFrame:
    """``state`` with the changes made, to the records of least hash."""
    if not changes:
        return state
    spark = state.sparkSession
    plan = spark.createDataFrame([(s, n, k, int(targets[s][1])) for (s, n), k in changes.items()], "source string, n_tokens bigint, k bigint, most bigint")
    may = state.join(F.broadcast(plan), ["source", "n_tokens"]).filter(F.when(F.col("k") > 0, F.col("copies") < F.col("most")).otherwise(F.col("copies") > 0))
    order = Window.partitionBy("source", "n_tokens").orderBy(F.xxhash64("row", F.lit(seed)), "row")
    largest = max(abs(k) for k in changes.values())
    # the limit by a constant keeps each task to as many rows of a length before they are moved
    picked = may.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= largest).filter(F.col("rank") <= F.abs("k"))
    step = picked.select("row", F.signum("k").cast("bigint").alias("step"))  # as many rows as the changes add up to
    return state.join(F.broadcast(step), "row", "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step")


def mix_sources(counted: DataFrame, targets: dict[str, tuple[float, int]], seed: int = 11, total: float | None = None) -> DataFrame:
    """``id, source, n_tokens, n_uses`` of every record. ``targets``: source to share and most copies.

    ``counted`` must be a fixed table (read or checkpointed), as each pass reads it.
    """
    spark = counted.sparkSession
    named = counted.join(F.broadcast(spark.createDataFrame([(s,) for s in targets], "source string")), "source", "left_semi")
    totals = {r["source"]: r["n"] for r in named.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each target
    copies = rates(totals, targets, total)
    rate = spark.createDataFrame([(s, float(x)) for s, x in copies.items()], "source string, rate double")
    own = counted.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(rate), "source", "left").withColumn("rate", F.when(F.col("n_tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0))
    first = own.select("row", "source", "n_tokens", F.floor(F.col("rate") + 1e-9).cast("bigint").alias("copies"), F.greatest(F.col("rate") - F.floor(F.col("rate") + 1e-9), F.lit(0.0)).alias("mass"), "id")
    state = cut(_round(first.sortWithinPartitions("source", F.desc("n_tokens"), "row"), seed))
    done = state.filter("mass = 0")
    left = state.filter("mass > 0")
    partitions = state.rdd.getNumPartitions()
    level = 0
    while partitions > 1:
        partitions = -(-partitions // FAN)
        level += 1
        # the few fractions left; sorted so that the result does not depend on their arrival
        state = cut(_round(left.repartition(partitions, F.pmod(F.xxhash64("row"), F.lit(partitions))).sortWithinPartitions("source", F.desc("n_tokens"), "row"), seed + level))
        done = done.union(state.filter("mass = 0"))
        left = state.filter("mass > 0")
    luck = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    last = left.withColumn("copies", F.col("copies") + (luck < F.col("mass")).cast("bigint"))
    rounded = done.union(last)
    changes = _corrections(rounded, copies, totals, targets) if copies else {}
    return _corrected(rounded, changes, targets, seed).select("id", "source", "n_tokens", F.col("copies").alias("n_uses"))


def shares(mixed: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """``source, target_share, actual_share, used_tokens, n_records, most_uses`` of every target."""
    used = mixed.filter("n_uses > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("used_tokens"), F.count("*").alias("n_records"), F.max("n_uses").alias("most_uses"))
    got = {r["source"]: r for r in used.collect()}  # a row for each target
    total = sum(r["used_tokens"] for r in got.values())
    rows = [(s, float(share), got[s]["used_tokens"] / total, got[s]["used_tokens"], got[s]["n_records"], got[s]["most_uses"]) if s in got else (s, float(share), 0.0, 0, 0, 0) for s, (share, _) in sorted(targets.items())]
    return mixed.sparkSession.createDataFrame(rows, "source string, target_share double, actual_share double, used_tokens bigint, n_records bigint, most_uses bigint")
