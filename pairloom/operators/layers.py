"""Layers by L1 norm, what a layer can skip, and numbers for (layer, tied) partitions."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.vector import norms
from pairloom.operators.place import numbered, numbered_within


def ranked(stats: DataFrame) -> DataFrame:
    """stats with rk, the 0-based place in order of (l1, id)."""
    return numbered(stats.withColumn("_l1", F.round("l1", 9)), "_l1", "id").drop("_l1")


def layer_cuts(n: int, layers: int) -> list[float]:
    """Ranks above which the next layer begins: layers hold layers, layers - 1, ... 1 shares of the n vectors."""
    share = n / (layers * (layers + 1) / 2)
    return [share * c for c in accumulate(range(layers, 0, -1))]


def layered(postings: DataFrame, layers: int, uniform: bool = False) -> DataFrame:
    """(id, l1, linf, l2, layer)."""
    stats = ranked(norms(postings))
    n = stats.count()
    if uniform:
        return stats.withColumn("layer", F.least(F.floor(F.col("rk") * layers / F.lit(max(n, 1))), F.lit(layers - 1)).cast("int")).drop("rk")
    cuts = F.array(*[F.lit(c) for c in layer_cuts(n, layers)[:-1]]).cast("array<double>")
    return stats.withColumn("layer", F.size(F.filter(cuts, lambda c: F.col("rk") > c)).cast("int")).drop("rk")


def layer_sizes(stats: DataFrame) -> DataFrame:
    return stats.groupBy("layer").agg(F.count("*").alias("size"))


def layer_leaders(stats: DataFrame) -> DataFrame:
    """(layer, max_l1, max_linf)."""
    return stats.groupBy("layer").agg(F.max("l1").alias("max_l1"), F.max("linf").alias("max_linf"))


def ideal_vectors(stats: DataFrame, postings: DataFrame) -> DataFrame:
    """(layer, feature, weight): the largest weight of each feature in a layer."""
    return postings.join(stats.select("id", "layer"), "id").groupBy("layer", "feature").agg(F.max("weight").alias("weight"))


def ideal_similarity(stats: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, sim): cosine of each vector and the ideal vector of its layer."""
    ideal = ideal_vectors(stats, postings).withColumnRenamed("weight", "top")
    length = ideal.groupBy("layer").agg(F.sqrt(F.sum(F.col("top") * F.col("top"))).alias("length"))
    both = postings.join(stats.select("id", "layer", "l2"), "id").join(ideal, ["layer", "feature"]).groupBy("id", "layer", "l2").agg(F.sum(F.col("weight") * F.col("top")).alias("dot"))
    return both.join(length, "layer").select("id", (F.col("dot") / (F.col("l2") * F.col("length"))).alias("sim"))


def static_tie(stats: DataFrame, threshold: float) -> DataFrame:
    """Adds first_needed and tied. A vector of layer b skips layers 0 to tied, by Hölder's inequality; tied = b skips none.

    A layer is skipped if L-inf times its largest L1, or L1 times its largest L-inf, is below the
    threshold. The table of leaders has a row a layer.
    """
    t = threshold * (1 - 1e-12)
    table = layer_leaders(stats).agg(F.sort_array(F.collect_list(F.struct("layer", "max_l1", "max_linf"))).alias("leaders"))

    def needed(x: Column) -> Column:
        return (x["layer"] < F.col("layer")) & ~((F.col("linf") * x["max_l1"] < t) | (F.col("l1") * x["max_linf"] < t))

    first = F.coalesce(F.array_min(F.transform(F.filter("leaders", needed), lambda x: x["layer"])), F.col("layer"))
    tied = F.when(F.col("first_needed") == 0, F.col("layer")).otherwise(F.col("first_needed") - 1)
    return stats.crossJoin(F.broadcast(table)).withColumn("first_needed", first).withColumn("tied", tied).drop("leaders")


def partition_sizes(tied: DataFrame) -> DataFrame:
    return tied.groupBy("layer", "tied").agg(F.count("*").alias("size"))


def triangular_hash(layer: Column, tied: Column) -> Column:
    return (layer * (layer + 1) / 2).cast("long") + tied


def triangular_unhash(h: Column) -> tuple[Column, Column]:
    layer = F.floor((F.sqrt(8.0 * h + 1) - 1) / 2).cast("long")
    return layer, h - (layer * (layer + 1) / 2).cast("long")


def compartments(rows: DataFrame, size: int) -> DataFrame:
    """(layer, tied, chunk, ids): a partition's vectors in lists of at most `size`, in order of id."""
    placed = numbered_within(rows.select("layer", "tied", "id"), ["layer", "tied"], "id", "place")
    chunked = placed.withColumn("chunk", F.floor(F.col("place") / size).cast("int"))
    return chunked.groupBy("layer", "tied", "chunk").agg(F.sort_array(F.collect_list("id")).alias("ids"))
