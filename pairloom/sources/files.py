"""Text files of documents, bags, matrices and pairs; partitioned vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): a document a line, numbered from 0 in order of file and line.

    Blocks of files are counted, and a line's number follows from the blocks before its own.
    """
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    lines = spark.read.text(path).select(F.col("value").alias("text"), *block, F.monotonically_increasing_id().alias("_at"))
    counts = lines.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # A row a block.
    before = F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    blocks = counts.select("_file", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = lines.join(F.broadcast(blocks), ["_file", "_start"])
    return numbered.select((F.col("_before") + F.col("_at") - F.col("_first")).alias("id"), "text")


def read_bags(spark: SparkSession, path: str) -> DataFrame:
    """Postings of lines of integers."""
    from pairloom.functions.text import bow_counts

    return bow_counts(read_lines(spark, path))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, values array<int>) of lines of integers."""
    return read_lines(spark, path).select(F.col("id").alias("row"), F.transform(F.split(F.trim("text"), " +"), lambda x: x.cast("int")).alias("values"))


def write_pairs(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines i,j,sim."""
    pairs.select("i", "j", "sim").write.mode(mode).csv(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("i long, j long, sim double").csv(path)


def write_partitions(postings: DataFrame, parts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vectors by (layer, tied), so that reading one partition reads its files only."""
    postings.join(parts.select("id", "layer", "tied"), "id").write.mode(mode).partitionBy("layer", "tied").parquet(path)


def read_partition(spark: SparkSession, path: str, layer: int, tied: int) -> DataFrame:
    return spark.read.parquet(path).where((F.col("layer") == layer) & (F.col("tied") == tied)).select("id", "feature", "weight")


def write_index(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Inverted indexes (layer, tied, chunk, feature, postings) by (layer, tied); see index_chunks()."""
    chunks.write.mode(mode).partitionBy("layer", "tied").parquet(path)


def read_index(spark: SparkSession, path: str, layer: int, tied: int) -> DataFrame:
    """(chunk, feature, postings) of one partition; only its files are read."""
    return spark.read.parquet(path).where((F.col("layer") == layer) & (F.col("tied") == tied)).select("chunk", "feature", "postings")


def write_matrix(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines of the values of rows (row, values array), in order of row, for read_matrix()."""
    line = F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("value")
    rows.repartitionByRange("row").sortWithinPartitions("row").select(line).write.mode(mode).text(path)


def write_cells(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines i,j,value of a similarity matrix or of column similarities."""
    cells.select("i", "j", "value").write.mode(mode).csv(path)
