"""Column similarities and transposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_similarities(cells: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(i, j, value), i < j: cosines of the columns of cells (id, feature, weight)."""
    length = cells.groupBy("feature").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    scaled = cells.join(length, "feature").select("id", "feature", (F.col("weight") / F.col("length")).alias("w"))
    a, b = scaled.toDF("id", "i", "wi"), scaled.toDF("id", "j", "wj")
    return a.join(b, "id").where("i < j").groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("value")).where(F.col("value") > threshold)


def sampled_column_similarities(cells: DataFrame, n_columns: int, threshold: float = 0.1) -> DataFrame:
    """The same by sampling, from MLlib's row matrix; an estimate above the threshold."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("v"))
    entries = RowMatrix(rows.rdd.map(lambda r: Vectors.sparse(n_columns, r["v"]))).columnSimilarities(threshold).entries
    return cells.sparkSession.createDataFrame(entries.map(lambda e: (e.i, e.j, float(e.value))), "i long, j long, value double")


def transpose(rows: DataFrame) -> DataFrame:
    """(row, values array) to the same of its columns; cells that are missing in short rows are left out."""
    cells = rows.select("row", F.posexplode("values").alias("col", "value"))
    turned = cells.groupBy("col").agg(F.sort_array(F.collect_list(F.struct("row", "value"))).alias("v"))
    return turned.select(F.col("col").cast("long").alias("row"), F.transform("v", lambda x: x["value"]).alias("values"))
