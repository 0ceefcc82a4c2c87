"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import WORD, Scratch, table

#: Sources in code-point order weigh these, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
CAP = 3.0
#: Ranges of the exponential key within a source; only the range at a budget's end is sorted.
RANGES = 1024


#: Copies of one row that are spelled out at a time.
COPIES = 10_000


def _drawn(docs: DataFrame, seed: int) -> DataFrame:
    """Adds _src, which orders sources with null last, and _class, a hash of id and text: reruns and retries agree."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return docs.withColumn("_src", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source")))).withColumn("_class", draw)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (_src, _class, _part, ...) with _draw, which tells rows that repeat apart: the class itself for the first, a hash of it and the number for others.

    Rows of a class are numbered within the task that read them, from where the tasks before it end; so
    a class of any size is spread over as many tasks as have read it.
    """
    alike = ["_src", "_class", "_part"]
    parts = rows.groupBy(*alike).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_src", "_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    later = parts.withColumn("_before", before).where("_before > 0").drop("_n")
    number = F.row_number().over(Window.partitionBy(*alike).orderBy("_size")) - 1 + F.coalesce("_before", F.lit(0))
    numbered = rows.join(later, alike, "left").withColumn("_number", number)
    return numbered.withColumn("_draw", F.when(F.col("_number") == 0, F.col("_class")).otherwise(F.md5(F.concat_ws(":", "_class", F.col("_number").cast("string"))))).drop("_part", "_before", "_number")


def _weighed(docs: DataFrame, labels: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """(doc_id, _src, _class, _size, _draw, _key, _range): the exponential key over the quality weight, and its range; a written table.

    A document labelled good weighs 2, one labelled bad 0.5, one without a label 1.
    """
    q = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    weight = F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)
    u = (F.conv(F.substring("_draw", 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    drawn = _drawn(docs.select("doc_id", "text", "source"), seed).withColumn("_size", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long"))
    rows = scratch.save(drawn.select("doc_id", "_src", "_class", "_size", F.spark_partition_id().alias("_part")), "rows")
    keyed = _numbered(rows).join(q, "doc_id", "left").withColumn("_key", -F.log(u) / weight).drop("_quality")
    keyed = scratch.save(keyed.withColumn("_range", F.least(F.floor((1 - F.exp(-F.col("_key"))) * RANGES), F.lit(RANGES - 1)).cast("int")), "keyed")
    scratch.drop("rows")
    return keyed


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """(src, source_size) to target words: shares by weight, at most cap times the size, the excess reshared.

    Resharing until no source is above its cap gives min(cap * size, level * weight); the level is
    found on sources in the order in which they reach their caps. One row a source.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(every.orderBy("src")) - 1, F.lit(len(weights))) + 1).cast("int")))
    filled = ranked.withColumn("_full", F.col("source_size") * cap / F.col("_w"))
    order = every.orderBy("_full", "src")
    before = F.coalesce(F.sum(F.col("source_size") * cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(every) * share - before) / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = filled.withColumn("_level", level)
    best = F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(every)
    return levels.withColumn("_best", best).select("src", "source_size", F.least(F.col("source_size") * cap, F.coalesce("_best", F.lit(float("inf"))) * F.col("_w")).alias("target"))


def mix_plan(keyed: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, cap: float = CAP, share: float = 1.0, ranges: int = RANGES) -> DataFrame:
    """One row a source: how many whole epochs, and the key up to which documents come once more.

    keyed: (_src, _size, _draw, _key, _range). The budget left after the epochs is spent along the
    keys; a document belongs to it while that brings the sum nearer. Sizes are summed by range of
    keys first, so no source is ever sorted as a whole.
    """
    by_range = scratch.save(keyed.groupBy(F.col("_src").alias("src"), "_range").agg(F.sum("_size").alias("words")), "ranges")
    targets = source_targets(by_range.groupBy("src").agg(F.sum("words").alias("source_size")), weights, cap, share)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0).cast("int"))
    targets = scratch.save(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    along = Window.partitionBy("src").orderBy("_range")
    ends = by_range.withColumn("upto", F.sum("words").over(along)).join(targets.select("src", "rest"), "src")
    cut = ends.where(F.col("upto") > F.col("rest")).groupBy("src").agg(F.min_by(F.struct("_range", (F.col("upto") - F.col("words")).alias("spent"), "rest"), "_range").alias("c")).select("src", "c.*")
    row = Window.partitionBy("src", "_range").orderBy("_key", "_draw").rowsBetween(Window.unboundedPreceding, 0)
    edge = keyed.select(F.col("_src").alias("src"), "_range", "_key", "_draw", "_size").join(cut, ["src", "_range"])
    edge = edge.withColumn("_mid", F.col("spent") + F.sum("_size").over(row) - F.col("_size") / 2).where(F.col("_mid") <= F.col("rest"))
    last = edge.groupBy("src").agg(F.max(F.struct("_key", "_draw")).alias("last"))
    return scratch.save(targets.join(cut.select("src", F.col("_range").alias("cut")), "src", "left").join(last, "src", "left").select("src", "source_size", "target", "epochs", F.coalesce("cut", F.lit(ranges)).alias("cut"), "last"), "plan")


def _taken(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan's columns and copies, the times that the mix takes a document."""
    once_more = (F.col("_range") < F.col("cut")) | ((F.col("_range") == F.col("cut")) & F.coalesce(F.struct("_key", "_draw") <= F.col("last"), F.lit(False)))
    return keyed.join(plan.withColumnRenamed("src", "_src"), "_src").withColumn("copies", F.col("epochs") + F.when(once_more & (F.col("epochs") < CAP), 1).otherwise(0))


def mix_sources(docs: DataFrame, labels: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, share: float = 1.0, seed: int = 8) -> DataFrame:
    """What the mix takes of each document of docs (doc_id, text, source).

    labels (doc_id, quality) weigh documents: keys are -ln(u) / weight, and small keys come first.
    Null text or text without words has size 0 and takes 0 words; null sources form one source, the
    last; rows that repeat are documents of their own, each with its own draw; an empty table gives no
    rows. Other columns of docs are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    keyed = _weighed(docs, labels, seed, scratch)
    return _taken(keyed, mix_plan(keyed, scratch, weights, cap, share)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, share: float = 1.0, seed: int = 8) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken. Only the plan, a row a source, meets the texts.

    Of rows that repeat, some may be taken once more than the others; as they are alike in id, text and
    source, the one that a hash of all columns chooses stands for these.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    columns, alike = docs.columns, ["_class", "_src"]
    narrow = _weighed(docs, labels, seed, scratch)
    plan = mix_plan(narrow, scratch, weights, cap, share)
    times = _taken(narrow, plan).groupBy(*alike).agg(F.count("*").alias("_n"), F.sum("copies").alias("_all"))
    times = times.withColumn("_each", F.floor(F.col("_all") / F.col("_n")).cast("int")).withColumn("_more", F.col("_all") - F.col("_each") * F.col("_n"))
    times = scratch.save(times.drop("_n", "_all"), "times")
    drawn = _drawn(docs, seed)
    out = drawn.join(times.where("_each > 0").drop("_more"), alike).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_each")))).select(*columns)
    some = times.where("_more > 0").select(*alike, "_more")
    if some.isEmpty():
        return out
    one = drawn.join(some.drop("_more"), alike).groupBy(*alike).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row"))
    ends = some.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_more") - 1, F.lit(COPIES).cast("long")))).repartition(*alike, "_from")
    each = ends.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, F.col("_more")) - 1)))
    return out.unionByName(each.join(one, alike).select("_row.*"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("copies")


OP8_SQL = rf"""
WITH labelled AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('8:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))) AS class
  FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY src, class) - 1 AS number FROM d),
r AS (SELECT *, CASE WHEN number = 0 THEN class ELSE md5(class || ':' || number) END AS draw FROM o),
k AS (
  SELECT r.*, -ln((CAST('0x' || substr(draw, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM r LEFT JOIN labelled USING (doc_id)),
s AS (SELECT src, sum(size)::DOUBLE AS source_size FROM k GROUP BY src),
w AS (SELECT src, source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3) + 1]::DOUBLE AS w FROM s),
f AS (SELECT *, source_size * 3 / w AS fill FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY fill, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY fill, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT src, source_size, least(source_size * 3, (SELECT max(level) FROM l WHERE level <= fill) * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.*, sum(size) OVER (PARTITION BY src ORDER BY key, draw ROWS UNBOUNDED PRECEDING) - size / 2 AS mid FROM k JOIN e USING (src))
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (size * (epochs + CASE WHEN epochs < 3 AND mid <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
