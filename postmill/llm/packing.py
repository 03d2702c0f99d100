"""Filling containers of one capacity by bin completion.

Items are spread over groups by hash; in a group, best fit gives a first solution and a branch and
bound over completions of the largest item improves it. What stays open in the groups' last
containers is packed once more together.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.session import spill

GROUP = 2000  # items that are packed together, about
NODES = 1000  # containers that the branch and bound may open in a group
STEPS = 500  # fillings it looks through for one container beside the fullest, which is found exactly
FULL = 0.995  # a container at least this full is not opened again


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: containers as lists of indices."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space left, container), in order
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left = (capacity - sizes[i], len(bins) - 1)
        else:
            space, b = room.pop(at)
            bins[b].append(i)
            left = (space - sizes[i], b)
        room.insert(bisect_left(room, left), left)
    return bins


def least_containers(sizes: list[int], capacity: int) -> int:
    """A lower bound: the volume, and for every k how far the items of at least k fit beside those over half of the capacity."""
    z = np.sort(np.array([s for s in sizes if s], dtype=np.int64))
    if not len(z):
        return 0
    upto = np.r_[0, np.cumsum(z)]
    half = np.searchsorted(z, capacity / 2, side="right")  # larger ones never share with each other
    k = np.unique(np.r_[1, z[:half]])
    alone = np.searchsorted(z, capacity - k, side="right")  # larger ones share with none of at least k
    small = np.searchsorted(z, k, side="left")
    alone = np.maximum(alone, half)
    room = (alone - half) * capacity - (upto[alone] - upto[half])
    over = np.maximum(0, -(-(upto[half] - upto[np.minimum(small, half)] - room) // capacity))
    return int(max(-(-upto[-1] // capacity), (len(z) - half + over).max()))


def fullest(values: list[int], counts: Counter, space: int) -> tuple[int, ...]:
    """A filling of ``space`` that leaves least of it, by the sums that can be reached, as bits of one number."""
    mask, reached, steps = (1 << (space + 1)) - 1, 1, []
    for v in values:
        # Powers of two of one value reach every number of it.
        n, k = min(counts[v], space // v if v else 0), 1
        while n > 0:
            k = min(k, n)
            steps.append((v, k, reached))
            reached |= reached << (v * k) & mask
            n, k = n - k, 2 * k
    left, out = reached.bit_length() - 1, []
    for v, k, before in reversed(steps):
        if not before >> left & 1:
            out += [v] * k
            left -= v * k
    return tuple(sorted(out, reverse=True))


def completions(values: list[int], counts: Counter, space: int, steps: int = STEPS) -> list[tuple[int, ...]]:
    """Undominated fillings of ``space`` with items of the ascending ``values``, fullest first.

    A filling that has room for another item, or in which an item could be exchanged for a larger
    one, is dominated: whatever follows it can follow the better one. The fullest is always among
    them; all others are while no more than ``steps`` have to be looked through.
    """
    free = [v for v in values if counts[v]]
    found = {fullest(free, counts, space)}
    budget = steps

    def extend(at: int, left: int, chosen: list[int]) -> None:
        nonlocal budget
        at = min(at, bisect_right(free, left) - 1)
        if at < 0 or budget <= 0:
            found.add(tuple(chosen))
            return
        v = free[at]
        for n in range(min(counts[v], left // v), -1, -1):
            budget -= 1
            extend(at - 1, left - n * v, chosen + [v] * n)
            if budget <= 0:
                return

    extend(len(free) - 1, space, [])
    out = []
    for chosen in sorted(found, key=lambda f: (-sum(f), f)):
        left, used = space - sum(chosen), Counter(chosen)
        spare = lambda v, used=used: counts[v] > used[v]
        if any(spare(w) for w in free[: bisect_right(free, left)]):
            continue
        if not any(spare(w) for v in used for w in free[bisect_right(free, v) : bisect_right(free, v + left)]):
            out.append(chosen)
    return out


def pack(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Containers as lists of indices; every size is at least 0 and at most the capacity.

    Best fit is the first incumbent. Every better packing that the branch and bound meets takes its
    place, until the lower bound is met, nothing is left to try or ``nodes`` containers were opened.
    """
    best = best_fit(sizes, capacity)
    least = least_containers(sizes, capacity)
    if len(best) <= least or nodes <= 0:
        return best
    total, fewest = sum(sizes), len(best)
    counts = Counter(s for s in sizes if s)
    values = sorted(counts)
    bins: list[tuple[int, ...]] = []
    waste, opened, solution = 0, 0, None

    def options() -> Iterator[tuple[int, ...]]:
        at = len(values) - 1
        while at >= 0 and not counts[values[at]]:
            at -= 1
        if at < 0:
            return iter(())
        v = values[at]
        counts[v] -= 1
        fills = completions(values[: at + 1], counts, capacity - v)
        counts[v] += 1
        return iter([(v, *f) for f in fills])

    stack = [options()]
    while stack and opened < nodes:
        f = next(stack[-1], None)
        # More waste than a packing with a container less than the incumbent may have; fuller ones come first.
        if f is None or waste + capacity - sum(f) > (fewest - 1) * capacity - total:
            stack.pop()
            if bins:
                last = bins.pop()
                waste -= capacity - sum(last)
                counts.update(last)
            continue
        opened += 1
        bins.append(f)
        waste += capacity - sum(f)
        counts.subtract(f)
        if any(counts.values()):
            stack.append(options())
            continue
        solution, fewest = list(bins), len(bins)
        if fewest <= least:
            break
        last = bins.pop()
        waste -= capacity - sum(last)
        counts.update(last)
    if solution is None:
        return best
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    out = [[by_size[v].pop() for v in f] for f in solution]
    if by_size.get(0):
        out[0].extend(by_size[0])
    return out


def fill_containers(items: DataFrame, capacity: int, *, key: str = "doc_id", size: str = "n_tokens", group: int = GROUP) -> DataFrame:
    """One row per piece: (key, piece, size, container, filled).

    An item larger than the capacity is cut into full pieces and a rest, which is packed like an
    item; nothing else is split. ``filled`` is the total of the container, whose number is unique.

    * Items of size 0 and null sizes take no room and go along with others. A null key is kept;
      rows with the same key are items of their own, told apart by their place in the result only.
      An empty table gives no rows. Other columns are left out.

    Groups are of about ``group`` items at any number of rows and drawn by a hash of the row's number,
    so no source or key can fill one; the containers that are not full at the end of a group (a few per group) are packed
    a second time, again in groups.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    pieces = rows.select(
        "k",
        F.posexplode(
            F.when(F.col("n") <= capacity, F.array(F.col("n"))).otherwise(
                F.filter(
                    F.concat(F.array_repeat(F.lit(capacity).cast("bigint"), F.floor(F.col("n") / capacity).cast("int")), F.array(F.col("n") % capacity)), lambda x: x > 0
                )
            )
        ).alias("piece", "n"),
    )
    # The written table keeps its numbers.
    pieces = spill(pieces.withColumn("row", F.monotonically_increasing_id()))
    schema = f"row bigint, k {kind}, piece int, n bigint, container bigint, filled bigint"

    def packed(df: DataFrame, rounds: int) -> DataFrame:
        groups = max(1, df.count() // group)
        salt = F.pmod(F.xxhash64("row", F.lit(rounds)), F.lit(groups))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["n", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
            n = [int(x) for x in pdf["n"]]
            bins = pack(n, capacity)
            where = np.zeros(len(n), dtype=np.int64)
            full = np.zeros(len(n), dtype=np.int64)
            for b, members in enumerate(bins):
                where[members] = b
                full[members] = sum(n[i] for i in members)
            number = (rounds << 60) + (int(pdf["g"][0]) << 24) + where
            return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "piece": pdf["piece"], "n": pdf["n"], "container": number, "filled": full})

        return df.withColumn("g", salt).groupBy("g").applyInPandas(one, schema)

    # Whole pieces of full capacity need no packing; rows of the written table number their containers.
    whole = pieces.where(F.col("n") == capacity).select("row", "k", "piece", "n", (F.lit(3 << 60) + F.monotonically_increasing_id()).alias("container"), F.col("n").alias("filled"))
    first = spill(packed(pieces.where(F.col("n") < capacity), 0))
    done = first.where(F.col("filled") >= FULL * capacity)
    again = spill(packed(first.where(F.col("filled") < FULL * capacity).select("row", "k", "piece", "n"), 1))
    out = whole.unionByName(done).unionByName(again)
    return out.select(F.col("k").alias(key), "piece", F.col("n").alias(size), "container", "filled")


def report(filled: DataFrame, capacity: int, *, size: str = "n_tokens") -> DataFrame:
    """One row: containers, tokens, the fewest containers that the volume allows, and the share of unused room."""
    t = filled.agg(F.count_distinct("container").alias("containers"), F.coalesce(F.sum(size), F.lit(0)).alias("tokens"))
    return t.select(
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / capacity).alias("least"),
        F.try_divide(F.col("containers") * capacity - F.col("tokens"), F.col("containers") * capacity).alias("unused"),
    )
