"""Buckets by similarity to anchors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.vector import l2_normalize
from pairloom.operators import blocks


def choose_anchors(postings: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(pos, id) of k vectors, drawn by a seeded hash of the id."""
    drawn = postings.select("id").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(k)
    packed = drawn.agg(F.collect_list("id").alias("ids"))
    return packed.select(F.posexplode("ids").alias("pos", "id"))


def signatures(postings: DataFrame, anchors: DataFrame, level: float = 0.5) -> DataFrame:
    """(id, key): a character an anchor (pos, feature, weight), in order: 1 if the cosine is at least `level`."""
    unit = l2_normalize(postings)
    units = l2_normalize(anchors.select(F.col("pos").alias("id"), "feature", "weight")).select(F.col("id").alias("pos"), "feature", F.col("weight").alias("wa"))
    near = unit.join(F.broadcast(units), "feature").groupBy("id", "pos").agg(F.sum(F.col("weight") * F.col("wa")).alias("sim"))
    places = anchors.select("pos").distinct().agg(F.sort_array(F.collect_list("pos")).alias("places"))
    hits = near.where(F.round("sim", 12) >= level).groupBy("id").agg(F.collect_set("pos").alias("hits"))
    keys = unit.select("id").distinct().join(hits, "id", "left").crossJoin(F.broadcast(places))
    bit = F.transform("places", lambda p: F.when(F.array_contains(F.coalesce("hits", F.array().cast("array<int>")), p), "1").otherwise("0"))
    return keys.select("id", F.array_join(bit, "").alias("key"))


def bucket_pairs(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, i, j, sim) of vectors with equal keys that share a feature, i > j."""
    return blocks.bucketed(postings, keys).drop("place")


def bucket_best(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, i, j, sim): each bucket's most similar pair; ties go to the smallest ids."""
    best = F.min_by(F.struct("i", "j", "sim"), F.struct(-F.col("place"), "i", "j")).alias("b")
    return blocks.bucketed(postings, keys, best=True).groupBy("key").agg(best).select("key", "b.i", "b.j", "b.sim")


def closest_pair(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, i, j, sim): the most similar pair of any bucket; no row where no bucket has two vectors."""
    return blocks.closest(postings, keys).orderBy(F.desc("place"), "i", "j", "key").limit(1).drop("place")


def best_pair(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """closest_pair of the buckets by these anchors."""
    return closest_pair(postings, signatures(postings, anchors))


def best_of_attempts(postings: DataFrame, k: int, attempts: int = 21) -> DataFrame:
    """best_pair over fresh anchors for each seed from 0; all attempts are buckets of one join."""
    drawn = reduce(DataFrame.unionByName, (choose_anchors(postings, k, s).withColumn("pos", F.col("pos") + s * k) for s in range(attempts)))
    all_keys = signatures(postings, F.broadcast(drawn).join(postings, "id").select("pos", "feature", "weight"))
    # Fewer vectors than anchors leave keys that are shorter than k, in the order of seeds.
    width = F.greatest(F.length("key") / F.lit(attempts), F.lit(1)).cast("int")
    seeds = F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("seed")
    keys = all_keys.select("id", "key", seeds).select("id", F.concat_ws(":", F.col("seed").cast("string"), F.substring("key", F.col("seed") * width + 1, width)).alias("key"))
    found = blocks.closest(postings, keys).select(F.substring_index("key", ":", -1).alias("key"), "i", "j", "sim", F.substring_index("key", ":", 1).cast("int").alias("seed"), "place")
    return found.orderBy(F.desc("place"), "i", "j", "seed").limit(1).drop("place")


def row_summaries(postings: DataFrame, threshold: float) -> DataFrame:
    """(id, tmax, colsum): threshold over the largest weight, and the sum of weights, by absolute value."""
    w = F.abs(F.col("weight"))
    return postings.groupBy("id").agg((threshold / F.max(w)).alias("tmax"), F.sum(w).alias("colsum"))


def row_pruned_pairs(postings: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """(i, j, value) of bucket pairs where tmax of one is below colsum of the other."""
    rows = row_summaries(l2_normalize(postings), threshold)
    return blocks.bucketed(postings, keys, rows=rows).select("i", "j", F.col("sim").alias("value"))
