"""Inverted indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.place import numbered_within

def _list():
    return F.sort_array(F.collect_list(F.struct("id", "weight"))).alias("postings")


def inverted_index(postings: DataFrame) -> DataFrame:
    """(feature, postings array<struct<id, weight>>), sorted by id."""
    return postings.groupBy("feature").agg(_list())


def blocked_index(postings: DataFrame, size: int = 100_000) -> DataFrame:
    """(feature, block, postings): the same with lists of about `size` at most, for features that very many vectors have."""
    long = postings.groupBy("feature").agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    blocks = F.coalesce(F.ceil(F.col("_n") / size), F.lit(1)).cast("long")
    dealt = postings.join(long, "feature", "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    return dealt.groupBy("feature", "block").agg(_list())


def index_chunks(postings: DataFrame, parts: DataFrame, size: int = 100) -> DataFrame:
    """(layer, tied, chunk, feature, postings): an index for each `size` vectors of a partition, in order of id."""
    slots = slot_map(parts).select("id", "layer", "tied", F.floor(F.col("slot") / size).cast("int").alias("chunk"))
    return postings.join(slots, "id").groupBy("layer", "tied", "chunk", "feature").agg(_list())


def merge_indexes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One index of two: lists of equal features are joined."""
    return a.union(b).groupBy("feature").agg(F.sort_array(F.flatten(F.collect_list("postings"))).alias("postings"))


def slot_map(parts: DataFrame) -> DataFrame:
    """(layer, tied, id, slot): dense numbers of a partition's vectors from 0, in order of id."""
    placed = numbered_within(parts.select("layer", "tied", "id").distinct(), ["layer", "tied"], "id", "slot")
    return placed.select("layer", "tied", "id", F.col("slot").cast("int").alias("slot"))
