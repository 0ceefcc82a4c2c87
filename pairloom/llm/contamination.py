"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import Scratch, build_filter, passes_filter, string_column, table, tidy, worker_state
from pairloom.llm.words import PlainWordHashes, blocks, hash_array, window_hashes

#: Words of the shortest tile; seeds are runs of so many words.
MIN_TILE = 5
#: Share of a benchmark item's words that tiles must cover.
COVERAGE = 0.6
_BASE = 1_000_003


def plain_words(text: str) -> np.ndarray:
    """Hashes of the text's words in lower case, letters and digits only; words without any are left out."""
    cache = worker_state().setdefault("plain words", PlainWordHashes())
    h = hash_array(text.lower().split(), cache)
    return h[h != 0]


def _prefix_hashes(s: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all prefixes, modulo 2**64; those of windows follow from two of them."""
    out = np.zeros(len(s) + 1, np.uint64)
    h, mask = 0, (1 << 64) - 1
    for k, x in enumerate(s.tolist()):
        h = (h * _BASE + x + 1) & mask
        out[k + 1] = h
    return out


class _Sequence:
    """Words of one side, the windows of unmarked words, and their hashes."""

    def __init__(self, words: np.ndarray, apart: np.ndarray):
        """apart: words that no tile may hold."""
        self.words, self.hashes, self.marked = words, _prefix_hashes(words), apart.copy()

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of n unmarked words, in order."""
        if n > len(self.words):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        blocked = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(blocked[n:] == blocked[:-n])
        return at, self.hashes[at + n] - self.hashes[at] * np.uint64(pow(_BASE, n, 1 << 64))

    def longest_run(self) -> int:
        gaps = np.flatnonzero(np.concatenate([[True], self.marked, [True]]))
        return int(np.diff(gaps).max()) - 1


def tile(a: np.ndarray, b: np.ndarray, shortest: int = MIN_TILE, apart: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of greedy string tiling of two arrays of words; apart marks words of b that no tile may hold.

    The longest length at which the two still share a window of unmarked words is found by halving, as
    a shared window holds shared windows of every lesser length. All windows of that length are hashed
    by running Karp-Rabin, and those of b, from left to right, are marked with the first window of a of
    the same hash that is still free and has the same words. After that no two free windows of the length match, so the
    next one is less: there are at most as many rounds as lengths of tiles that fit side by side, and a
    round looks at each word a few times, however often words are repeated.
    """
    left = _Sequence(np.asarray(a, np.uint64), np.zeros(len(a), bool))
    right = _Sequence(np.asarray(b, np.uint64), np.zeros(len(b), bool) if apart is None else apart)
    tiles: list[tuple[int, int, int]] = []
    longest = min(left.longest_run(), right.longest_run()) if len(a) and len(b) else 0

    def shared(n: int) -> bool:
        return bool(np.isin(left.windows(n)[1], right.windows(n)[1]).any())

    while longest >= shortest and shared(shortest):
        low, high = shortest, longest
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if shared(n) else (low, n - 1)
        places: dict[int, deque[int]] = {}
        at, hashes = left.windows(low)
        both = np.isin(hashes, right.windows(low)[1])
        for i, h in zip(at[both].tolist(), hashes[both].tolist(), strict=True):
            places.setdefault(h, deque()).append(i)
        at, hashes = right.windows(low)
        both = np.isin(hashes, np.fromiter(places, np.uint64, len(places)))
        end = 0
        for j, h in zip(at[both].tolist(), hashes[both].tolist(), strict=True):
            if j < end:
                continue
            free = places[h]
            # A window that lost a word to a tile is gone for good. All marks of this round are of one length, so its ends tell.
            while free and (left.marked[free[0]] or left.marked[free[0] + low - 1]):
                free.popleft()
            if free and (left.words[free[0] : free[0] + low] == right.words[j : j + low]).all():
                i = free.popleft()
                tiles.append((i, j, low))
                left.marked[i : i + low] = right.marked[j : j + low] = True
                end = j + low
        longest = low - 1
    return sorted(tiles)


def _items(shortest: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [plain_words(t) for t in batch.column("text").to_pylist()]
            seeds = [np.unique(window_hashes(w, shortest), return_counts=True) if len(w) >= shortest else (np.empty(0, np.uint64), np.empty(0, np.int64)) for w in words]
            lists = [[w.view(np.int64) for w in words], [h.view(np.int64) for h, _ in seeds], [n for _, n in seeds]]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("item"), *(pa.array(v, pa.list_(pa.int64())) for v in lists)], names=["item_id", "item", "words", "seeds", "places"])

    return run


def _runs(shared, shortest: int):
    """Of each document, the runs of words whose seeds may all be seeds of items; nothing else can be in a tile."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])  # document, words, place of the document in the batch
            seen = 0
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for held in blocks(rows, lambda r: len(r[1]), 1_000_000):
                first, seen = seen, seen + len(held)
                words = [plain_words(t) for _, t in held]
                lengths = np.array([len(w) for w in words])
                every = np.concatenate(words) if words else np.empty(0, np.uint64)
                seeds = window_hashes(every, shortest)
                hits = np.flatnonzero(passes_filter(field, seeds))
                ends = np.cumsum(lengths)
                owner = np.searchsorted(ends, hits, "right")
                inside = hits + shortest <= ends[owner] if len(hits) else np.empty(0, bool)
                hits, owner = hits[inside], owner[inside]
                if not len(hits):
                    continue
                new = np.flatnonzero((np.diff(hits, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
                for a, b in zip(new.tolist(), [*new[1:].tolist(), len(hits)], strict=True):
                    out[0].append(held[owner[a]][0])
                    out[1].append(every[hits[a] : hits[b - 1] + shortest].view(np.int64))
                    out[2].append(first + int(owner[a]))
            docs, runs, last = [], [], None
            for doc, words_, own in zip(*out, strict=True):
                if last != own:
                    docs.append(doc)
                    runs.append([])
                runs[-1].append(words_)
                last = own
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([[r.tolist() for r in d] for d in runs], pa.list_(pa.list_(pa.int64())))], names=["doc_id", "runs"])

    return run


def _seeds_of_runs(shortest: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seeds = [], []
            for row, runs in zip(batch.column("row").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                s = np.unique(np.concatenate([window_hashes(np.array(r, np.int64).view(np.uint64), shortest) for r in runs]))
                rows += [row] * len(s)
                seeds.append(s)
            every = np.concatenate(seeds).view(np.int64) if seeds else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(every)], names=["row", "seed"])

    return run


def _cover(shortest: int, coverage: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "item", "n_tiles", "covered", "n_words")}
            for r in batch.to_pylist():
                words, joined, apart = np.array(r["words"], np.int64).view(np.uint64), [], []
                for part in r["runs"]:  # no tile runs across two parts
                    joined += [0, *part]
                    apart += [True] + [False] * len(part)
                tiles = tile(words, np.array(joined, np.int64).view(np.uint64), shortest, np.array(apart, bool))
                covered = sum(n for _, _, n in tiles)
                if covered >= coverage * len(words):
                    for k, v in zip(out, (r["doc_id"], r["item_id"], r["item"], len(tiles), covered, len(words)), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item, n_tiles, covered, n_words, coverage): rows of docs whose tiles cover a benchmark item.

    Words are compared in lower case without punctuation. Tiles may come in any order and anywhere in
    the document, so moved sentences count. docs (doc_id, text), benchmark (item_id, text). Null or
    empty texts, and items shorter than a tile, match nothing; repeated rows of docs are reported as
    often as they occur, equal items each; other columns are ignored; an empty table on either side
    gives no rows.

    A filter of fixed size with the seeds of all items goes to the tasks that read documents; only
    runs of words that pass it leave them. These meet the items by an exact join of seeds, and pairs
    whose shared seeds cannot cover enough are dropped before they are tiled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "contamination")
    items = string_column(benchmark.select("item_id", "text"), "text").withColumn("item", F.monotonically_increasing_id())
    items = scratch.save(items.mapInArrow(_items(shortest), "item_id long, item long, words array<long>, seeds array<long>, places array<long>").where(F.size("words") >= shortest), "items")
    shared = build_filter(items.select(F.explode("seeds").alias("seed")))
    docs = string_column(docs.select("doc_id", "text"), "text")
    runs = scratch.save(docs.mapInArrow(_runs(shared, shortest), "doc_id long, runs array<array<long>>").withColumn("row", F.monotonically_increasing_id()), "runs")
    seeds = runs.select("row", "runs").mapInArrow(_seeds_of_runs(shortest), "row long, seed long")
    of_items = items.select("item", F.size("words").alias("n"), F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("item", "n", F.col("s.seeds").alias("seed"), F.col("s.places").alias("places"))
    pairs = seeds.join(of_items, "seed").groupBy("row", "item").agg(F.sum("places").alias("shared"), F.first("n").alias("n"))
    # shared counts places of the item; each tile of n words has n - shortest + 1 of them, so no more than shared * shortest words are covered.
    pairs = pairs.where(F.col("shared") * shortest >= F.col("n") * coverage).select("row", "item")
    both = pairs.join(items.select("item", "item_id", "words"), "item").join(runs, "row").select("doc_id", "item_id", "item", "runs", "words")
    found = both.mapInArrow(_cover(shortest, coverage), "doc_id long, item_id long, item long, n_tiles long, covered long, n_words long")
    return found.withColumn("coverage", F.col("covered") / F.col("n_words"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item")
