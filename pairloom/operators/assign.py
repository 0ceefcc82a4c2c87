"""Which partitions are compared with which, what that costs, and a balanced choice.

Partition tables have at most layers * (layers + 1) / 2 rows, whatever the number of vectors.
"""

from __future__ import annotations

import heapq
from statistics import pstdev

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = tuple[int, int]


def is_candidate(b: str, t: str, ob: str, ot: str) -> Column:
    """Whether two partitions (layer, tied) must be compared: the higher layer must not skip the lower one."""
    layer, tied, other, other_tied = map(F.col, (b, t, ob, ot))
    return (
        F.when(layer == other, tied >= other_tied)
        .when(layer > other, (tied == layer) | (tied < other))
        .otherwise((other_tied == other) | (other_tied < layer))
    )


def circular(b: str, ob: str, layers: int) -> Column:
    """Each unordered pair of layers once: a layer meets the half of the circle after it."""
    ahead = F.pmod(F.col(ob) - F.col(b), F.lit(layers))
    if layers % 2:
        return ahead <= (layers - 1) // 2
    return (ahead < layers // 2) | ((ahead == layers // 2) & (F.col(b) < layers // 2))


def assignment(parts: DataFrame, layers: int) -> DataFrame:
    """(layer, tied, o_layer, o_tied) of parts (layer, tied)."""
    other = parts.select(F.col("layer").alias("o_layer"), F.col("tied").alias("o_tied"))
    pairs = parts.select("layer", "tied").join(F.broadcast(other), circular("layer", "o_layer", layers))
    return pairs.where(is_candidate("layer", "tied", "o_layer", "o_tied"))


def partition_costs(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(layer, tied, cost): size squared, and size times the size of each partition it is compared with."""
    other = sizes.select(F.col("layer").alias("o_layer"), F.col("tied").alias("o_tied"), F.col("size").alias("o_size"))
    work = pairs.join(F.broadcast(sizes), ["layer", "tied"]).join(F.broadcast(other), ["o_layer", "o_tied"])
    return work.groupBy("layer", "tied", "size").agg(F.sum(F.col("size") * F.col("o_size")).alias("work")).select("layer", "tied", (F.col("size") * F.col("size") + F.col("work")).cast("long").alias("cost"))


def cost(key: Key, others: set[Key], sizes: dict[Key, int]) -> int:
    return sizes[key] ** 2 + sum(sizes[key] * sizes[o] for o in others)


def take_over(held: dict[Key, set[Key]], sizes: dict[Key, int]) -> dict[Key, set[Key]]:
    """Stage 1: the cheapest partition left takes over every comparison that others still hold against it."""
    held = {k: set(v) for k, v in held.items()}
    left = set(held)
    while left:
        cheap = min(left, key=lambda k: (cost(k, held[k], sizes), k))
        left.remove(cheap)
        for k in left:
            if cheap in held[k]:
                held[k].remove(cheap)
                held[cheap].add(k)
    return held


def refine(held: dict[Key, set[Key]], sizes: dict[Key, int], steps: int = 50_000) -> dict[Key, set[Key]]:
    """Stage 2: the costliest partition hands a comparison over while the other one stays cheaper by it, small ones first.

    A partition that can hand over nothing is done: it takes no more comparisons, either.
    """
    held = {k: set(v) for k, v in held.items()}
    frozen: set[Key] = set()
    for _ in range(steps):
        costs = {k: cost(k, v, sizes) for k, v in held.items()}
        open_ = [k for k in held if k not in frozen]
        if not open_:
            break
        top = max(open_, key=lambda k: (costs[k], k))
        for o in sorted(held[top] - {top}, key=lambda o: (sizes[top] * sizes[o], o)):
            if o in held and o not in frozen and costs[o] + sizes[top] * sizes[o] < costs[top]:
                held[top].remove(o)
                held[o].add(top)
                break
        else:
            frozen.add(top)
    return held


def balance(held: dict[Key, set[Key]], sizes: dict[Key, int], stage1: bool = True, stage2: bool = True) -> dict[Key, set[Key]]:
    held = take_over(held, sizes) if stage1 else held
    return refine(held, sizes) if stage2 else held


def deviation(values: list[int]) -> float:
    """Standard deviation of all values, not of a sample."""
    return pstdev(values) if values else 0.0


def balance_deviations(held: dict[Key, set[Key]], sizes: dict[Key, int]) -> dict[str, float]:
    """Standard deviations of the partitions' costs before balancing, after stage 1 and after stage 2."""
    one = take_over(held, sizes)
    steps = {"before": held, "stage1": one, "stage2": refine(one, sizes)}
    return {name: deviation([cost(k, v, sizes) for k, v in state.items()]) for name, state in steps.items()}


def longest_first(costs: dict[Key, int], slots: int) -> dict[Key, int]:
    """Partitions to slots: the costliest first, each to the slot with the least work so far."""
    heap, placed = [(0, s) for s in range(slots)], {}
    for key in sorted(costs, key=lambda k: (-costs[k], k)):
        work, s = heapq.heappop(heap)
        placed[key] = s
        heapq.heappush(heap, (work + costs[key], s))
    return placed


def pair_weights(pairs: DataFrame, sizes: DataFrame, chunk: int = 100) -> DataFrame:
    """(layer, tied, chunks, weight): size times the sizes of the partitions that one is compared with, once for each index of `chunk` vectors."""
    other = sizes.select(F.col("layer").alias("o_layer"), F.col("tied").alias("o_tied"), F.col("size").alias("o_size"))
    met = pairs.join(F.broadcast(sizes), ["layer", "tied"]).join(F.broadcast(other), ["o_layer", "o_tied"])
    chunks = F.ceil(F.col("size") / chunk).cast("long")
    return met.groupBy("layer", "tied", "size").agg(F.sum(F.col("size") * F.col("o_size")).alias("once")).select("layer", "tied", chunks.alias("chunks"), (chunks * F.col("once")).cast("long").alias("weight"))


def slot_deviations(weights: dict[Key, int], costs: dict[Key, int], slots: int) -> dict[str, float]:
    """Standard deviations of the slots' weights: partitions dealt by number, and the costliest first."""
    dealt, placed = [0] * slots, [0] * slots
    where = longest_first(costs, slots)
    for (layer, tied), w in weights.items():
        dealt[(layer * (layer + 1) // 2 + tied) % slots] += w
        placed[where[layer, tied]] += w
    return {"unbalanced": deviation([w for w in dealt if w]), "balanced": deviation([w for w in placed if w])}


def _tables(pairs: DataFrame, sizes: DataFrame) -> tuple[dict[Key, set[Key]], dict[Key, int]]:
    size = {(r["layer"], r["tied"]): r["size"] for r in sizes.collect()}
    held: dict[Key, set[Key]] = {k: set() for k in size}
    for r in pairs.collect():
        held[r["layer"], r["tied"]].add((r["o_layer"], r["o_tied"]))
    return held, size


def balanced_assignment(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(layer, tied, o_layer, o_tied) after both stages; the tables have a row a partition or pair of them."""
    held, size = _tables(pairs, sizes)
    rows = [(*k, *o) for k, v in balance(held, size).items() for o in sorted(v)]
    return pairs.sparkSession.createDataFrame(rows, "layer int, tied int, o_layer int, o_tied int")


def balance_report(pairs: DataFrame, sizes: DataFrame, slots: int, chunk: int = 100) -> DataFrame:
    """One row: deviations of costs before balancing and after its stages, and of the weights of slots without and with it."""
    held, size = _tables(pairs, sizes)
    balanced = balance(held, size)
    costs = {k: cost(k, v, size) for k, v in balanced.items()}
    weights = {k: -(-size[k] // chunk) * sum(size[k] * size[o] for o in v) for k, v in balanced.items()}
    row = balance_deviations(held, size) | slot_deviations(weights, costs, slots)
    return pairs.sparkSession.createDataFrame([tuple(map(float, row.values()))], ", ".join(f"{k} double" for k in row))
