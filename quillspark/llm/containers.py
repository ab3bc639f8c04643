"""Filling containers of fixed capacity with texts, little space unused.

A text within the capacity is one item; a longer one is cut into full parts and a rest. The
configuration linear program has a variable for each way to fill a container and a constraint
for each size: cover all items with as few containers as possible. It is solved over the
histogram of sizes:

* Sizes are put into ``GROUPS`` classes of equal volume (every size its own class where there are
  no more); in the program an item counts with the largest size of its class.
* Multiplicative weights: each round prices the classes by their weights and finds the best
  filling by a knapsack dynamic program, which joins the fillings found before. Then ``STEPS``
  times the filling of largest weighted cover is taken a little more often, and the weights of
  what it covers fall by its cover's exponential. The prices bound the program from below, the fillings
  taken, scaled until they cover everything, from above; rounds end when the two are
  within ``GAP`` or after ``ROUNDS``, whatever the capacity. The bound for the sizes as they are
  comes from one more dynamic program over all sizes (``Solution.bound``).
* Rounding: the fractional fillings are taken in whole containers, each slot of a class by the
  largest size of it that is left, and room that is left goes to the largest sizes that fit;
  what remains is filled largest first. The plan is kept unless filling everything largest first
  needs fewer containers.

A plan is run-length coded (filling, repeats): a row either ends a filling's share or uses up a
size, so its length is bounded by the capacity and the rounds, not by the number of texts, and so
are the histogram that goes to the driver and the plan that comes back. Memory on the driver is
linear in the capacity.

Items get their container by their rank among items of their size; ranks are counted in
``SALTS`` salted groups of a size and offset by the groups before, so a size that a third of
all texts have is not ranked in one task.

Defined results
    null and empty texts are items of size 0 and stand in the first container; a repeated row
    is an item of its own (``copy_no`` tells them apart); a null id is an item too; an empty
    table gives an empty plan; capacities must be positive.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut

SALTS = 64
#: Classes of sizes in the program.
GROUPS = 40
#: Rounds at most, and the gap between value and bound at which they end.
ROUNDS, GAP = 400, 0.01
#: Steps of a round over the fillings found, the cover that a step adds at most, and what a round keeps of the steps before it.
STEPS, RATE, FADE = 300, 0.01, 0.9

Plan = list[tuple[dict[int, int], int]]


@dataclass(frozen=True)
class Solution:
    """A plan, the fractional optimum's bounds, and what filling largest first needs."""

    plan: Plan
    #: No packing has fewer containers.
    bound: float
    #: Containers of the fractional solution, items at the largest size of their class, and its lower bound.
    fractional: float
    fractional_bound: float
    greedy_bins: int
    rounds: int

    @property
    def bins(self) -> int:
        return sum(r for _, r in self.plan)


def best_filling(prices: np.ndarray, sizes: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The numbers of items of the filling of largest price, at most ``most`` of each size: knapsack over capacities.

    Copies of a size go in bundles of 1, 2, 4, ..., a row of flags for each.
    """
    best = np.zeros(capacity + 1)
    rows: list[tuple[int, int, np.ndarray]] = []
    for k in np.argsort(prices / sizes):
        left, bundle = min(int(most[k]), capacity // int(sizes[k])), 1
        while left > 0:
            n = min(bundle, left)
            left, bundle = left - n, bundle * 2
            s = n * int(sizes[k])
            better = best[: capacity + 1 - s] + n * prices[k]
            took = better > best[s:]
            np.copyto(best[s:], better, where=took)
            rows.append((int(k), n, np.packbits(took)))
    out = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    for k, n, took in reversed(rows):
        s = n * int(sizes[k])
        at = c - s
        if at >= 0 and (took[at >> 3] >> (7 - (at & 7))) & 1:
            out[k] += n
            c = at
    return out, float(best[capacity])


def _highest(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """The largest price of any filling, copies unlimited; ``prices`` of all ``sizes``."""
    best = np.zeros(capacity + 1)
    for c in range(int(sizes[0]), capacity + 1):
        n = int(np.searchsorted(sizes, c, side="right"))
        best[c] = max(best[c - 1], float((best[c - sizes[:n]] + prices[:n]).max()))
    return float(best[capacity])


def classes(counts: dict[int, int], groups: int = GROUPS) -> list[list[int]]:
    """Sizes in ascending classes of about equal volume."""
    sizes = sorted(counts)
    if len(sizes) <= groups:
        return [[s] for s in sizes]
    volume = np.cumsum([s * counts[s] for s in sizes])
    number = np.minimum((volume - 1) * groups // volume[-1], groups - 1)
    return [[sizes[i] for i in np.flatnonzero(number == g)] for g in np.unique(number)]


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> tuple[list[tuple[np.ndarray, float]], np.ndarray, float, float, int]:
    """Fillings and how often each is taken, the prices that bound best, the value and its bound, the rounds taken."""
    pool = [np.where(np.arange(len(sizes)) == k, np.minimum(capacity // sizes, counts), 0) for k in range(len(sizes))]
    known = {f.tobytes() for f in pool}
    covers = np.array(pool) / counts
    times, cover = np.zeros(len(pool)), np.zeros(len(sizes))
    weight = sizes / capacity * counts
    best_bound, best_prices, value, best, k = 0.0, sizes / capacity, np.inf, times, 0
    for k in range(1, rounds + 1):
        weight /= weight.sum()
        prices = weight / counts
        filling, worth = best_filling(prices, sizes, counts, capacity)
        bound = float(prices @ counts) / worth
        if bound > best_bound:
            best_bound, best_prices = bound, prices
        if filling.tobytes() not in known:
            known.add(filling.tobytes())
            pool.append(filling)
            covers, times = np.vstack([covers, filling / counts]), np.append(times, 0.0)
        for _ in range(STEPS):
            j = int((covers @ weight).argmax())
            step = RATE / covers[j].max()
            times[j] += step
            cover += step * covers[j]
            weight = weight * np.exp(-step * covers[j])
            weight = np.maximum(weight / weight.sum(), 1e-200)
        if cover.min() > 0 and times.sum() / cover.min() < value:
            value, best = float(times.sum() / cover.min()), times / cover.min()
        if value <= best_bound * (1 + gap):
            break
        times, cover = times * FADE, cover * FADE
    return [(f, float(x)) for f, x in zip(pool, best) if x > 0], best_prices, value, best_bound, k


def largest_first(counts: dict[int, int], capacity: int) -> Plan:
    """Each container takes the largest item that fits, again and again; equal containers at once."""
    left = {s: n for s, n in counts.items() if n > 0}
    order = sorted(left)
    plan: Plan = []
    while order:
        filling: dict[int, int] = {}
        room = capacity
        k = len(order) - 1
        while k >= 0:
            k = bisect_right(order, room, 0, k + 1) - 1
            if k < 0:
                break
            s = order[k]
            n = min(left[s], room // s)
            filling[s] = n
            room -= n * s
            k -= 1
        repeats = min(left[s] // n for s, n in filling.items())
        plan.append((filling, repeats))
        for s, n in filling.items():
            left[s] -= n * repeats
        order = [s for s in order if left[s]]
    return plan


def _whole(fillings: list[tuple[np.ndarray, float]], groups: list[list[int]], counts: dict[int, int], capacity: int) -> Plan:
    """The fractional fillings in whole containers, and the rest largest first."""
    left = dict(counts)
    plan: Plan = []
    alive = [list(g) for g in groups]
    everything = sorted(left)
    for filling, x in sorted(fillings, key=lambda f: -f[1]):
        want = int(x)
        while want > 0:
            row: dict[int, int] = {}
            room = capacity
            for g in np.flatnonzero(filling)[::-1]:
                need = int(filling[g])
                for s in reversed(alive[g]):
                    n = min(need, left[s])
                    if n:
                        row[s] = n
                        need -= n
                        room -= n * s
                    if not need:
                        break
                if need:
                    break
            if need or not row:
                break  # a class is used up: the rest of this filling is left to the end
            k = len(everything)
            while room and (k := bisect_right(everything, room, 0, k)):
                s = everything[k - 1]
                n = min(left[s] - row.get(s, 0), room // s)
                if n > 0:
                    row[s] = row.get(s, 0) + n
                    room -= n * s
                k -= 1
            repeats = min(want, min(left[s] // n for s, n in row.items()))
            plan.append((row, repeats))
            want -= repeats
            for s, n in row.items():
                left[s] -= n * repeats
                if not left[s]:
                    everything.remove(s)
            alive = [[s for s in g if left[s]] if any(not left[s] for s in g) else g for g in alive]
    return plan + largest_first(left, capacity)


def solve(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Solution:
    """Fillings and their repeats for ``counts`` items of each size, 1 to ``capacity``."""
    counts = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    if not counts:
        return Solution([], 0.0, 0.0, 0.0, 0, 0)
    greedy = largest_first(counts, capacity)
    groups = classes(counts)
    sizes, stock = np.array([g[-1] for g in groups]), np.array([sum(counts[s] for s in g) for g in groups])
    fillings, prices, value, below, done = fractional(sizes, stock, capacity, rounds)
    plan = _whole(fillings, groups, counts, capacity)
    # prices of the classes' fillings, at the sizes as they are
    every = np.array(sorted(counts))
    each = np.concatenate([np.full(len(g), p / g[-1]) for g, p in zip(groups, prices)]) * every
    n = np.array([counts[s] for s in every])
    bound = max(float(every @ n) / capacity, float(each @ n) / _highest(each, every, capacity))
    fewer = min(plan, greedy, key=lambda p: sum(r for _, r in p))
    return Solution(fewer, bound, value, below, sum(r for _, r in greedy), done)


def places(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size the first ranks of the plan's rows that hold it, their first containers, and items a container."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for filling, repeats in plan:
        for s, k in filling.items():
            rows.setdefault(s, []).append((used.get(s, 0), base, k))
            used[s] = used.get(s, 0) + k * repeats
        base += repeats
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for s, r in rows.items()}


def items(counted: DataFrame, specs: dict[str, int]) -> DataFrame:
    """``container, id, copy_no, part_no, tokens`` for each container kind: texts, or their parts."""
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).alias("capacity")) for c, n in sorted(specs.items())]))
    # rows without an id are told apart by a number of their own: they are no copies of one another
    unnamed = counted.filter("id is null").withColumn("copy_no", F.monotonically_increasing_id())
    copies = Window.partitionBy("id").orderBy("n_tokens")
    parts = F.greatest(F.ceil(F.col("n_tokens") / F.col("k.capacity")).cast("int"), F.lit(1))
    return (
        counted.filter("id is not null")
        .withColumn("copy_no", (F.row_number().over(copies) - 1).cast("bigint"))
        .unionByName(unnamed)
        .select("id", "copy_no", "n_tokens", kinds.alias("k"))
        .select("id", "copy_no", "n_tokens", "k.container", "k.capacity", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no"))
        .withColumn("tokens", F.least(F.col("n_tokens") - F.col("part_no") * F.col("capacity"), F.col("capacity").cast("bigint")).cast("int"))
        .drop("n_tokens", "capacity")
    )


_PLACED = pa.schema([("container", pa.string()), ("bin_no", pa.int64()), ("id", pa.int64()), ("copy_no", pa.int64()), ("part_no", pa.int32()), ("tokens", pa.int32())])


def salted(counted: DataFrame, specs: dict[str, int]) -> DataFrame:
    """The items, written once, in ``SALTS`` groups of each size."""
    return cut(items(counted, specs).withColumn("salt", F.pmod(F.xxhash64("id", "copy_no", "part_no"), F.lit(SALTS)).cast("int")))


def solutions(parts: DataFrame, specs: dict[str, int], rounds: int = ROUNDS) -> dict[str, Solution]:
    """The solution for each container kind."""
    histogram: dict[str, dict[int, int]] = {c: {} for c in specs}
    for r in parts.groupBy("container", "tokens").agg(F.count("*").alias("n")).collect():  # at most a row for each size up to each capacity
        histogram[r["container"]][r["tokens"]] = r["n"]
    return {c: solve(histogram[c], capacity, rounds) for c, capacity in specs.items()}


def fill(parts: DataFrame, specs: dict[str, int], solved: dict[str, Solution]) -> DataFrame:
    """``container, bin_no, id, copy_no, part_no, tokens``: the container of every item of ``salted``."""
    groups = parts.groupBy("container", "tokens", "salt").agg(F.count("*").alias("n"))
    spots = {c: places(solved[c].plan) for c in specs}
    before = Window.partitionBy("container", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("container", "tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("container", "tokens", "salt").orderBy("id", "copy_no", "part_no")
    ranked = parts.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["container", "tokens", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, sizes = np.array(b.column(0).to_pylist(), dtype=object), b.column(4).to_numpy()
            ranks = b.column(5).to_numpy()
            bins = np.zeros(len(sizes), dtype=np.int64)
            for c in specs:
                mine = np.flatnonzero((kinds == c) & (sizes > 0))
                order = mine[np.argsort(sizes[mine], kind="stable")]
                edges = np.flatnonzero(np.concatenate([[True], sizes[order][1:] != sizes[order][:-1]])) if len(order) else []
                for a, z in zip(edges, [*edges[1:], len(order)]):
                    rows = order[a:z]
                    first, base, each = spots[c][int(sizes[rows[0]])]
                    k = np.searchsorted(first, ranks[rows], side="right") - 1
                    bins[rows] = base[k] + (ranks[rows] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins), b.column(1), b.column(2), b.column(3), b.column(4)], schema=_PLACED)

    placed = ranked.select("container", "id", "copy_no", "part_no", "tokens", (F.col("rank") + F.col("offset")).alias("rank"))
    return placed.mapInArrow(place, "container string, bin_no bigint, id bigint, copy_no bigint, part_no int, tokens int")


def report(filled: DataFrame, specs: dict[str, int], solved: dict[str, Solution]) -> DataFrame:
    """One row for each container kind.

    ``n_bins, tokens, fullest, filled`` (the part of all containers' space that is used),
    ``lp_bound`` (no packing has fewer containers), ``lp_value`` and ``lp_gap`` of the fractional
    solution over classes, ``greedy_bins`` (largest first).
    """
    spark = filled.sparkSession
    rows = [(c, n, float(s.bound), float(s.fractional), float(s.fractional / s.fractional_bound - 1) if s.fractional_bound else 0.0, s.greedy_bins) for (c, n), s in ((x, solved[x[0]]) for x in sorted(specs.items()))]
    known = spark.createDataFrame(rows, "container string, capacity bigint, lp_bound double, lp_value double, lp_gap double, greedy_bins bigint")
    bins = filled.groupBy("container", "bin_no").agg(F.sum("tokens").alias("tokens"))
    own = bins.groupBy("container").agg(F.count("*").alias("n_bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    out = known.join(own, "container", "left")  # one row for each kind on both sides
    return out.select("container", F.coalesce("n_bins", F.lit(0)).alias("n_bins"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("fullest", F.lit(0)).alias("fullest"), F.coalesce(F.col("tokens") / (F.col("n_bins") * F.col("capacity")), F.lit(0.0)).alias("filled"), "lp_bound", "lp_value", "lp_gap", "greedy_bins")
