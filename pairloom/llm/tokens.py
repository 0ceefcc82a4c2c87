"""Token counts through a cache of content digests, and fast exact encoding for byte-level BPE."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import Scratch, string_column, table, tidy, worker_path, worker_state

#: White space for some version of Unicode or other; libraries differ about it.
_DOUBTFUL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: Bytes of text that one task encodes.
TASK_BYTES = 16 << 20
OVER = 512


def _ranks(spec: dict):
    """The encoding of a byte-level BPE file by ranks; None if its merges don't follow its ids."""
    import public_tokenizers
    import tiktoken

    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    # Bytes without a printable character of their own are written as the characters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    if [vocab.get(p) for p in pairs] != list(range(256, 256 + len(pairs))):
        return None
    ranks = {bytes(byte_of[c] for c in token): k for token, k in vocab.items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class TokenCounter:
    """Exact token counts of a .json (tokenizers) or .model (sentencepiece) file.

    Byte-level BPE without a normaliser is counted by ranks that the file's own vocabulary and merges
    give, which is the same encoding and several times as fast; texts with white space that libraries
    differ about, and other tokenizers, are left to the library.
    """

    def __init__(self, path: str):
        self.model, self.ranks = None, None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec.get("pre_tokenizer") or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(map(str.isspace, t["content"])) for t in spec.get("added_tokens", []))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True) and not spec.get("normalizer") and plain:
            self.ranks = _ranks(spec)

    def _count(self, text: str) -> int:
        if self.model:
            return len(self.model.encode(text, num_threads=1))
        if self.ranks is None or _DOUBTFUL.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if any(x in text for x in self.special):
            return len(self.ranks.encode(text, allowed_special="all"))
        return len(self.ranks.encode_ordinary(text))

    def count(self, texts: list[str]) -> list[int]:
        return [self._count(t) for t in texts]


class TokenIds:
    """Token ids of a .tiktoken file of ranks, as little-endian bytes; no special tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_vocab = max(ranks.values()) + 1
        #: The free id after the ranks pads rows.
        self.pad_id = self.n_vocab
        self.dtype = np.dtype("<u2" if self.n_vocab < 1 << 16 else "<u4")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), self.dtype)


def loaded(kind: type, name: str):
    """A tokenizer that the worker keeps, with its cache, for its next tasks."""
    state, path = worker_state(), worker_path(name)
    if (kind.__name__, path) not in state:
        state[kind.__name__, path] = kind(path)
    return state[kind.__name__, path]


def tokenizer_version(name: str) -> str:
    """Digest of a tokenizer's file: a cache never serves counts of another one."""
    with open(worker_path(name), "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each digest that a task meets: copies are dropped before they are moved."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column("digest").to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _encoder(name: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(TokenCounter, name)
        for batch in _first_of_task(batches):
            n = counter.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest").cast(pa.binary()), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


CACHE_SCHEMA = "digest binary, n_tokens long, version string"


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache: str | None = None, over: int = OVER) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_tokens, over_limit.

    cache: folder of a Parquet table (digest, n_tokens, version), read first and appended to; without
    one, a fresh cache serves this call. Content is normalised by null to empty only, as anything
    more would change counts; its SHA-256 and the tokenizer's are the key. Of the contents that the
    cache lacks, one row each meets the encoder, whatever their ids. A digest that two runs have
    appended at a time counts once. Null ids, repeated rows and other columns are fine; an empty
    table gives no rows.

    Each text moves at most once, by its digest; a task drops the copies that it meets before that,
    so that copies of one text, be they a third of all rows, are a row a task. The join to stored
    counts is an outer one, as the optimizer would move a semi or anti join below the exchange and
    exchange the texts for it, too.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    cache = cache or f"{scratch.path}/cache"
    version = tokenizer_version(tokenizer)
    texts = string_column(docs.select("doc_id", "text"), "text").withColumn("digest", F.unhex(F.sha2("text", 256)))
    seen = scratch.save(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")

    def stored() -> DataFrame:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache)
        return known.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    tasks = int(max(spark.sparkContext.defaultParallelism, (seen.agg(F.sum("n_bytes")).first()[0] or 0) // TASK_BYTES))
    once = texts.select("digest", "text").mapInArrow(_first_of_task, "digest binary, text string").repartition(tasks, "digest")
    if _exists(spark, cache):
        once = once.join(stored().hint("merge"), "digest", "left").where("n_tokens is null").select("digest", "text")
    fresh = once.mapInArrow(_encoder(tokenizer), "digest binary, n_tokens long").dropDuplicates(["digest"]).withColumn("version", F.lit(version))
    fresh.write.mode("append").parquet(cache)
    counts = seen.join(stored(), "digest")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))


def op10_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
