"""Norms, normalisation and cosines of sparse and dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def l2_normalize(postings: DataFrame) -> DataFrame:
    """Unit length by id; zero vectors are dropped."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    return postings.withColumn("_norm", norm).where("_norm > 0").select("id", "feature", (F.col("weight") / F.col("_norm")).alias("weight"))


def norms(postings: DataFrame) -> DataFrame:
    """(id, l1, linf, l2)."""
    w = F.abs(F.col("weight"))
    return postings.groupBy("id").agg(F.sum(w).alias("l1"), F.max(w).alias("linf"), F.sqrt(F.sum(w * w)).alias("l2"))


def truncate_at(x: Column, places: int) -> Column:
    """Cut to so many decimal places, toward minus infinity."""
    return F.floor(x * 10**places) / F.lit(float(10**places))


def dense_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where one is zero."""
    length = F.sqrt(dense_dot(a, a)) * F.sqrt(dense_dot(b, b))
    return F.when(length > 0, dense_dot(a, b) / length)


def pack(postings: DataFrame) -> DataFrame:
    """(id, vector array<struct<feature, weight>>), sorted by feature."""
    return postings.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("feature", "weight"))).alias("vector"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("id", F.explode("vector").alias("x")).select("id", "x.feature", "x.weight")


def dense_postings(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """Arrays to postings by position; zeros and nulls are left out."""
    wide = rows.select(F.col(ident).alias("id"), F.posexplode(vector).alias("feature", "weight"))
    return wide.select("id", "feature", F.col("weight").cast("double").alias("weight")).where("weight <> 0")


def ml_postings(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """A column of ML vectors to postings."""
    from pyspark.ml.functions import vector_to_array

    return dense_postings(rows.select(ident, vector_to_array(F.col(vector)).alias("_v")), ident, "_v")
