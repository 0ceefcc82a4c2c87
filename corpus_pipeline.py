"""From raw documents to packed token ids: five stages, each written as Parquet and read by the next.

All stages but the last return whole rows of their input, with all of its columns, whatever these are
named. Rows are told apart by a key of their own, never by doc_id: a null or repeated id loses nothing.
An empty table gives an empty table at each stage. What a stage does with nulls, repeated rows and ties
is stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import Scratch, table
from pairloom.llm.contamination import contaminated
from pairloom.llm.jaccard import jaccard_components
from pairloom.llm.language import UNKNOWN, identify_languages, learn_languages
from pairloom.llm.mixing import mixed_documents
from pairloom.llm.packing import pack_documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without any letters, null and empty texts among them, go.

    Where nothing can be learned, as no row has a lang, no document has a language and all go. Repeated
    rows get the same answer; ties between languages go to the first by name.
    """
    found = identify_languages(docs, learn_languages(docs))
    return found.where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def _keyed(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The documents with a unique row key, as a written table; and (doc_id, text) of them with the key for an id."""
    keyed = Scratch(spark, "pipeline-rows").save(docs.withColumn("_row", F.monotonically_increasing_id()), name)
    return keyed, keyed.select(F.col("_row").alias("doc_id"), "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id; rows of one id, or without any, go by their content.

    A row without id stays only if its group has none with one. Of repeated rows one stays; texts
    without words are in no group, and stay. Columns that a group's rows differ in come from the row kept.
    """
    keyed, texts = _keyed(spark, docs, "near")
    groups = jaccard_components(texts).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    # Rows with equal content are interchangeable, so that reruns keep the same one whatever its key is.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), "_row")
    ranked = keyed.select("_row", order.alias("_order")).join(groups, "_row")
    kept = ranked.groupBy("_group").agg(F.min("_order").alias("_least")).select(F.col("_least._row").alias("_row"))
    return keyed.join(kept, "_row", "left_semi").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item. Null texts stay; repeated rows go or stay together; an empty benchmark drops none."""
    keyed, texts = _keyed(spark, docs, "benchmark")
    found = contaminated(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(found, "_row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, or up to three times.

    Null sources are one source, the last. Each of repeated rows has a draw of its own; rows without
    words are taken like others but add nothing to a target. Documents without a label weigh 1.
    """
    return mixed_documents(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of packed token ids; null and empty texts bring none, repeated rows are packed as often as they occur."""
    return pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("mix", mix),
    ("pack", pack),
]

#: A learned classifier and a tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each one's rows are a written table before the next begins."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
