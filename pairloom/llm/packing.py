"""Packing token ids into rows of one length by best-fit decreasing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import string_column, table, tidy
from pairloom.llm.tokens import TokenIds, loaded

SEQ_LEN = 2048
#: Bytes of text whose ids one task packs at a time; ids of so much text fit a worker's memory.
SHARD_BYTES = 24 << 20
PACKED = (
    "shard int, row long, n_tokens int, n_segments int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"
)


class CapacityTree:
    """Open rows by free capacity, in a segment tree: the tightest row that still holds a piece, in log(capacity) steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = self.leaves + free
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of the least free capacity of at least `need`, taken out."""
        at, count = self.leaves + need, self.count
        while not count[at]:
            while at & 1:  # a right child: everything at this level is done
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        free = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Rows of indices into lengths; no row exceeds the capacity. lengths must not ascend."""
    tree, rows = CapacityTree(capacity), []
    for k, n in enumerate(lengths):
        if found := tree.take(n):
            free, row = found
            rows[row].append(k)
        else:
            free, row = capacity, len(rows)
            rows.append([k])
        if free > n:
            tree.add(free - n, row)
    return rows


def _encode(tokenizer: str, seq_len: int, shards: int):
    """(shard, doc_id, start, ids) of the pieces of a task's texts.

    A piece goes to a shard by a hash of what it is, of the task, and of how many like it the task has
    met: rows that repeat, or that all lack an id, spread as others do, and a task that runs again
    deals its pieces alike, in whatever order it reads them.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = loaded(TokenIds, tokenizer)
        step, task, met = seq_len * ids.dtype.itemsize, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packed = ids.ids(text.as_py()).tobytes()
                for at in range(0, len(packed), step):
                    piece = packed[at : at + step]
                    like = xxhash.xxh3_64_intdigest(f"{doc}:{at}:".encode() + piece)
                    met[like] += 1
                    shard = xxhash.xxh3_64_intdigest(f"{like}:{task}:{met[like]}") % shards
                    for held, x in zip(out, (shard, doc, at // ids.dtype.itemsize, piece), strict=True):
                        held.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)], names=["shard", "doc_id", "start", "ids"])

    return run


def _shards(pack):
    """Pack the shard that a partition is."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            yield from pack(pa.Table.from_batches(held)).to_batches(max_chunksize=1024)

    return run


def _pack(tokenizer: str, seq_len: int):
    def run(group: pa.Table) -> pa.Table:
        coder = loaded(TokenIds, tokenizer)
        wide = coder.dtype.itemsize
        pieces = sorted(zip(group.column("ids").to_pylist(), group.column("doc_id").to_pylist(), group.column("start").to_pylist(), strict=True), key=lambda p: (-len(p[0]), p[1] is None, p[1] or 0, p[2], p[0]))
        shard = group.column("shard")[0].as_py()
        pad = np.array([coder.pad_id], coder.dtype).tobytes()
        out: dict[str, list] = {k.split()[0]: [] for k in PACKED.split(", ")}
        for row, held in enumerate(best_fit_decreasing([len(p[0]) // wide for p in pieces], seq_len)):
            ids = b"".join(pieces[k][0] for k in held)
            lengths = [len(pieces[k][0]) // wide for k in held]
            ends = np.cumsum([0, *lengths])
            at = np.zeros(seq_len, "<u4")
            at[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)
            n = int(ends[-1])
            for k, x in {"shard": shard, "row": row, "n_tokens": n, "n_segments": len(held), "doc_ids": [pieces[k][1] for k in held], "starts": [pieces[k][2] for k in held], "cu_seqlens": ends.tolist(), "input_ids": ids + pad * (seq_len - n), "position_ids": at.astype("<u2" if seq_len <= 1 << 16 else "<u4").tobytes()}.items():
                out[k].append(x)
        kinds = {"shard": pa.int32(), "row": pa.int64(), "n_tokens": pa.int32(), "n_segments": pa.int32(), "doc_ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()), "cu_seqlens": pa.list_(pa.int32()), "input_ids": pa.binary(), "position_ids": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return run


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", seq_len: int = SEQ_LEN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of seq_len token ids of docs (doc_id, text), packed best-fit decreasing; the id matrix, a row each.

    input_ids and position_ids are little-endian unsigned integers of 2 bytes (4 where ids or
    positions need them); input_ids is padded with the first free id, and positions start again at
    every segment. Segment k of a row is tokens cu_seqlens[k] to cu_seqlens[k + 1], and these are the
    tokens of doc_ids[k] from starts[k] on. Longer documents are cut every seq_len tokens, none is
    lost. Texts are encoded where they are read; their ids are dealt to shards of about shard_bytes of
    text, a partition each, and each shard is packed for itself, so a task's memory does not grow with
    the table, with a hot source, or with rows that share an id or have none. Null or empty texts have no tokens and no
    segment; repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    docs = string_column(docs.select("doc_id", "text"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_bytes))
    dealt = docs.mapInArrow(_encode(tokenizer, seq_len, shards), "shard int, doc_id long, start long, ids binary")
    # A shard a partition: a hash of the shard would put several into one.
    return dealt.repartitionById(shards, "shard").mapInArrow(_shards(_pack(tokenizer, seq_len)), PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrices as Parquet, a shard's rows together."""
    packed.write.mode("overwrite").parquet(path)


def unpacked(packed: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, start, ids): the segments again, for round trips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = loaded(TokenIds, tokenizer).dtype
        for batch in batches:
            rows = [(d, s, np.frombuffer(r["input_ids"], dtype)[a:b].tolist()) for r in batch.to_pylist() for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return packed.mapInArrow(run, "doc_id long, start long, ids array<int>")


def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
