"""Reports on how much work pruning saves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pairloom.functions.vector import l2_normalize
from pairloom.operators.assign import assignment
from pairloom.operators.join import similar_pairs
from pairloom.operators.layers import layer_sizes, layered, partition_sizes, static_tie


def pair_budget(sizes: DataFrame, layers: int) -> DataFrame:
    """One row: vectors, all comparisons, those left by static pruning, and what it saves."""
    pairs = assignment(sizes, layers)
    other = sizes.toDF("o_layer", "o_tied", "o_size")
    work = pairs.join(sizes, ["layer", "tied"]).join(other, ["o_layer", "o_tied"])
    own = (F.col("layer") == F.col("o_layer")) & (F.col("tied") == F.col("o_tied"))
    left = work.agg(F.coalesce(F.sum(F.when(own, F.col("size") * (F.col("size") - 1) / 2).otherwise(F.col("size") * F.col("o_size"))), F.lit(0)).cast("long").alias("unbalanced"))
    n = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n"))
    total = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return n.crossJoin(left).select(F.col("n").alias("num_vectors"), total.alias("num_comparisons"), "unbalanced", (total - F.col("unbalanced")).alias("static_reduction"), (F.col("n") * F.col("n") / 2).cast("long").alias("legacy_total"))


def skipped_and_calculated(sizes: DataFrame) -> DataFrame:
    """One row of two sums over partitions: pairs with layers that are skipped, and with those that are not."""
    layers = sizes.groupBy(F.col("layer").alias("i")).agg(F.sum("size").alias("layer_size"))
    met = sizes.join(F.broadcast(layers), F.col("i") <= F.col("layer"))
    skip = (F.col("i") <= F.col("tied")) & (F.col("layer") != F.col("tied"))
    do = (F.col("i") > F.col("tied")) | (F.col("layer") == F.col("tied"))
    return met.agg(F.coalesce(F.sum(F.when(skip, F.col("size") * F.col("layer_size"))), F.lit(0)).cast("long").alias("skipped"), F.coalesce(F.sum(F.when(do, F.col("size") * F.col("layer_size"))), F.lit(0)).cast("long").alias("calculated"))


def sweep(postings: DataFrame, thresholds: Sequence[float], layers: int = 21, uniform: bool = False, scored: DataFrame | None = None) -> DataFrame:
    """A row a threshold: pairs returned, pairs scored and below it, and reductions.

    Pairs are scored once, for the lowest threshold; `scored` (sim) may bring them, above that. All pairs that
    static pruning leaves count as scored. actual_reduction is what the scored ones leave of half the
    square of the vectors, d_par_reduction what dynamic pruning leaves out, d_par what it has looked at.
    """
    unit = l2_normalize(postings)
    stats = layered(unit, layers, uniform)
    scored = similar_pairs(unit, min(thresholds), assume_normalized=True) if scored is None else scored
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    counts = scored.select("sim", levels).groupBy("threshold").agg(F.sum(F.when(F.col("sim") > F.col("threshold"), 1).otherwise(0)).alias("returned"))
    out = None
    for t in thresholds:
        row = pair_budget(partition_sizes(static_tie(stats, t)), layers).withColumn("threshold", F.lit(float(t)))
        out = row if out is None else out.unionByName(row)
    joined = out.join(counts, "threshold", "left").withColumn("returned", F.coalesce("returned", F.lit(0)).cast("long"))
    below = F.col("unbalanced") - F.col("returned")
    return joined.select("threshold", "num_vectors", "num_comparisons", F.col("unbalanced").alias("scored"), "returned", below.alias("below"), "static_reduction", (F.col("legacy_total") - F.col("unbalanced")).alias("actual_reduction"), below.alias("d_par_reduction"), F.col("unbalanced").alias("d_par"))


def observed(pairs: DataFrame, name: str = "pairs") -> tuple[DataFrame, Observation]:
    """pairs (i, j, sim), and counters that an action on them fills: how many, and the least and largest cosine."""
    seen = Observation(name)
    return pairs.observe(seen, F.count(F.lit(1)).alias("returned"), F.min("sim").alias("least"), F.max("sim").alias("largest")), seen


def layer_sums(sizes: DataFrame, stats: DataFrame) -> DataFrame:
    """Layers whose partitions do not add up to them: no rows."""
    return sizes.groupBy("layer").agg(F.sum("size").alias("parts")).join(layer_sizes(stats), "layer", "full").where(~F.col("parts").eqNullSafe(F.col("size")))
