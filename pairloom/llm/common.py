"""Shared plumbing of the training-data operators: scratch tables, components, texts as Arrow batches."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, shared by driver and executors. Only a local session, where all is one machine, may go without."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pairloom-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables of one operator call, written as Parquet below the checkpoint folder; they cut the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read again: what is read no longer depends on executors that may be lost."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Free the disk of a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def string_column(df: DataFrame, name: str) -> DataFrame:
    """Null texts become empty ones."""
    return df.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_path(name: str) -> str:
    """A tokenizer file by name; public_tokenizers is installed on driver and executors alike."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class UnionFind:
    """Disjoint sets over dense indices; the root is the smallest index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning(i: np.ndarray, j: np.ndarray, sets: UnionFind) -> list[tuple[int, int]]:
    """Pairs of (i, j) that connect what all of them connect, and that `sets` does not connect yet; joins them there."""
    kept: list[tuple[int, int]] = []
    n = len(sets.up)
    while True:
        root = np.fromiter((sets.find(x) for x in range(n)), np.int64, n)
        apart = np.flatnonzero(root[i] != root[j])
        if not len(apart):
            return kept
        i, j = i[apart], j[apart]
        one = np.full(n, -1)
        one[root[i]] = np.arange(len(i))
        one[root[j]] = np.arange(len(j))
        for k in np.unique(one[one >= 0]).tolist():
            if sets.union(int(i[k]), int(j[k])):
                kept.append((int(i[k]), int(j[k])))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shrink each block of edges to a spanning forest of stars; connectivity stays the same."""
    for batch in batches:
        a, b = (np.asarray(batch.column(k)) for k in (0, 1))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        sets = UnionFind(len(ids))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            sets.union(x, y)
        root = np.fromiter((sets.find(x) for x in range(len(ids))), np.int64, len(ids))
        out = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[root[out]])], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 200) -> DataFrame:
    """(id, component) of every id in edges (a, b: long): the smallest id that links reach.

    Each round takes the smallest label among the neighbours and then the label's own label, so that
    paths halve; a round's labels are a written table. Groups of any size only meet in partial
    aggregations and in joins that adaptive execution can split.
    """
    spark = scratch.spark
    forest = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_forest, "a long, b long")
    both = forest.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    links = scratch.save(both, f"{name}-links")
    labels = scratch.save(links.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")).withColumn("old", F.col("id")), f"{name}-0")
    for k in range(1, rounds):
        if labels.where("label <> old").isEmpty():
            break
        now = labels.select("id", "label")
        near = links.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("label"))
        least = now.withColumn("old", F.col("label")).unionByName(near.withColumn("old", F.lit(None).cast("long"))).groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = now.select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = scratch.save(least.join(jump, "label").select("id", F.least("label", "further").alias("label"), "old"), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError("components did not settle")
    return labels.select("id", F.col("label").alias("component"))


def split_blocks(rows: DataFrame, keys: list[str], ident: str, block: int, scratch: Scratch, name: str = "blocks", counts: DataFrame | None = None) -> DataFrame:
    """Deal the rows of each key to units of two blocks, for joins of a key's rows with one another.

    Adds unit_i <= unit_j, the unit, and in_block, the row's own block of about `block` rows. Each
    unordered pair of a key's rows meets in exactly one unit, both in its only block or one in each; a
    key with few rows is a single unit. `counts` has the keys' rows as _rows, if they are known. Rows come sorted by key and unit, a unit in one partition.
    """
    large = scratch.save((rows.groupBy(*keys).agg(F.count("*").alias("_rows")) if counts is None else counts).where(F.col("_rows") > block), name)
    sized = rows.join(large, keys, "left").withColumn("_rows", F.coalesce(F.ceil(F.col("_rows") / block), F.lit(1)).cast("int"))
    own = sized.withColumn("in_block", F.pmod(F.xxhash64(F.lit("block"), ident), F.col("_rows")).cast("int"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    dealt = other.withColumn("unit_i", F.least("in_block", "_other")).withColumn("unit_j", F.greatest("in_block", "_other")).drop("_other", "_rows")
    unit = [*keys, "unit_i", "unit_j"]
    return dealt.repartition(*unit).sortWithinPartitions(*unit)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Of sorted batches: tables, and the bounds of the runs of two or more equal keys in them; no run is cut."""
    held: pa.Table | None = None

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    def long(at: np.ndarray) -> list[tuple[int, int]]:
        keep = np.diff(at) > 1
        return list(zip(at[:-1][keep].tolist(), at[1:][keep].tolist(), strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        at = bounds(t)
        if len(at) > 2:
            yield t, long(at[:-1])
        held = t.slice(int(at[-2]))
    if held is not None:
        yield held, long(np.array([0, held.num_rows]))


#: Bits of a filter for each hash, log2 of the least and most bits (8 MB, 64 MB), and bytes that travel in a row.
FILTER_SHARE, FILTER_BITS, FILTER_CHUNK = 128, (26, 29), 1 << 13


def filter_slots(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a filter of `size` bytes."""
    shift = np.uint64(64 - (8 * size).bit_length() + 1)
    return hashes >> shift, (hashes * np.uint64(0x9E3779B97F4A7C15)) >> shift


def _filter_bytes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(size, np.uint8)
        for batch in batches:
            for at in filter_slots(np.asarray(batch.column(0)).view(np.uint64), size):
                np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for k in range(0, size, FILTER_CHUNK):
            if field[k : k + FILTER_CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([field[k : k + FILTER_CHUNK].tobytes()], pa.binary())], names=["place", "bits"])

    return run


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each chunk of a partition, with the bits of all."""
    fields: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("place").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            bits = np.frombuffer(raw, np.uint8)
            fields[k] = fields[k] | bits if k in fields else bits
    yield pa.RecordBatch.from_arrays([pa.array(list(fields), pa.int32()), pa.array([v.tobytes() for v in fields.values()], pa.binary())], names=["place", "bits"])


def build_filter(hashes: DataFrame):
    """A broadcast filter of the one column of 64-bit hashes: no false negatives, and a size that follows from their number, up to a bound."""
    spark = hashes.sparkSession
    bits = min(max((FILTER_SHARE * hashes.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    field = np.zeros(1 << (bits - 3), np.uint8)
    # As many tasks build a filter of their own as the whole is worth.
    tasks = max(1, min(shuffle_partitions(spark), (1 << 31) // len(field)))
    parts = hashes.coalesce(tasks).mapInArrow(_filter_bytes(len(field)), "place int, bits binary").repartition(tasks, "place")
    for r in parts.mapInArrow(_either, "place int, bits binary").collect():
        field[r["place"] : r["place"] + FILTER_CHUNK] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(field)


def passes_filter(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for at in filter_slots(hashes, len(field)):
        hit &= (field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def worker_state() -> dict:
    """What a Python worker keeps from task to task: loaded tokenizers and caches of words."""
    import sys
    import types

    return sys.modules.setdefault("_pairloom_worker_state", types.ModuleType("_pairloom_worker_state")).__dict__


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow whose task leaves no memory behind: Spark keeps idle workers, and each would keep its caches and free heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            import ctypes

            for cache in list(worker_state().values()):
                if isinstance(cache, dict):
                    cache.clear()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run
