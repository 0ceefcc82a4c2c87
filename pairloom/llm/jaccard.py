"""N-gram Jaccard join: shingle sets as points of group counts in R-trees, and exact verification.

Stages, each over all documents:

1. A set's 64-bit fingerprint makes equal sets one class; a sketch counts all shingles.
2. Each class files its first shingles in order of sketched frequency under a key each. Of a set of n,
   n - ceil(0.75 n) + 1 are enough: two sets that link share one of them, whatever the order is. The
   order keeps lines and passages that many documents share out of the keys. Sets that link overlap by
   no more than what either has from their first common shingle on, so a late key only serves pairs
   for which that is enough.
3. The classes of a key are points of an R-tree over the counts of shingles by group; the sum of
   coordinate minima bounds the overlap of two. A first search pairs what lies together in the tree,
   and each class with its size's hub, and keeps pairs that the bound leaves and that connect what all
   of them connect: fewer than a list has classes, so that a group of near copies brings no square of
   its size. It looks under some keys of each class. A second search finds all pairs, under any key, that the bound leaves and that the first
   one's links have not joined.
4. What either search leaves is verified on whole sets, which are read again from one text of each
   class; pairs of the second one are bounded by finer counts before. Components follow from the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import Scratch, UnionFind, build_filter, components, passes_filter, runs_of, spanning, split_blocks, string_column, table, tidy, worker_state
from pairloom.llm.words import WordHashes, blocks, shingle_sets

SHINGLE = 5
#: Similarity as a fraction: intersection * OF >= union * SIMILAR.
SIMILAR, OF = 75, 100
#: Coordinates of a point: shingles fall into so many groups by hash. The tree merges them by fours.
GROUPS, MERGED = 256, 64
#: log2 of the slots of the frequency sketch, 4 bytes each; CHUNK of them travel in a row.
SKETCH_BITS = 20
CHUNK = 1 << 14
#: Keys that one task gathers, in expectation: 28 bytes each.
TASK_KEYS = 1_000_000
#: A key that more shingles than these fall into, by the sketch, is dealt out as several lists of about so many.
LIST_KEYS = 1 << 16
#: Classes of a key that a task compares at a time with as many others.
BLOCK = 1024
LEAF = 16
#: Keys of a class under which the first search looks; the second one takes all.
FIRST_KEYS = 8


def _classes(batch: pa.RecordBatch, limit: int = 2_000_000) -> Iterator[list[tuple[np.ndarray, int | None]]]:
    """Blocks of (set, fingerprint) of a batch's texts, in order."""
    cache = worker_state().setdefault("words", WordHashes())
    for held in blocks(((t.as_py(),) for t in batch.column("text")), lambda r: len(r[0]), limit):
        yield [(s, fingerprint(s) if len(s) else None) for s in shingle_sets([t for (t,) in held], SHINGLE, cache)]


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def point(s: np.ndarray) -> bytes:
    """Counts of the shingles by group: a byte each, or four where one needs them."""
    counts = np.bincount((s >> np.uint64(32)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes()


def points_of(raw: list[bytes], groups: int = GROUPS) -> np.ndarray:
    if all(len(r) == groups for r in raw):
        return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), groups)
    return np.stack([np.frombuffer(r, np.uint8 if len(r) == groups else np.int32).astype(np.int32) for r in raw])


def merged(points: np.ndarray) -> np.ndarray:
    """Points of MERGED groups, which bound less but are a quarter as large."""
    return points.reshape(len(points), MERGED, -1).sum(2, dtype=np.int32)


def most_overlap(p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sums of the coordinate minima of pairs of points of p: their sets share no more."""
    out = np.zeros(len(i), np.int64)
    for a in range(0, len(i), 16_384):
        out[a : a + 16_384] = np.minimum(p[i[a : a + 16_384]], p[j[a : a + 16_384]]).sum(1, dtype=np.int64)
    return out


def may_link(p: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of points of p, with sums n, have minima that add up to the overlap that linked sets need."""
    return most_overlap(p, i, j) >= _needed(n[i], n[j])


def _needed(n: np.ndarray | int, m: np.ndarray | int):
    """Least overlap of linked sets of n and m: SIMILAR / (OF + SIMILAR) of their sum, rounded up."""
    return -(-(n + m) * SIMILAR // (OF + SIMILAR))


def _rest(at: np.ndarray) -> np.ndarray:
    """Of `at` (the set's size, then how many of its shingles come from the key on): the latter."""
    return at & 0xFFFFFFFF


@tidy
def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its point where the task meets its class first; then the task's sketch in chunks."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    names = ["doc_id", "tid", "n_shingles", "cid", "point", "chunk", "counts"]
    seen: set[int] = set()
    for batch in batches:
        sizes, cids, points = [], [], []
        for held in _classes(batch):
            slots = []
            for s, cid in held:
                sizes.append(len(s))
                cids.append(cid)
                points.append(None if cid is None or cid in seen else point(s))
                if points[-1] is not None:
                    seen.add(cid)
                    slots.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
            if slots:
                sketch += np.bincount(np.concatenate(slots), minlength=1 << SKETCH_BITS)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()), pa.array(points, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    chunks = [k for k in range(0, len(sketch), CHUNK) if sketch[k : k + CHUNK].any()]
    packed = [np.minimum(sketch[k : k + CHUNK], 2**31 - 1).astype(np.int32).tobytes() for k in chunks]
    n = len(chunks)
    yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(4)), pa.nulls(n, pa.binary()), pa.array([k // CHUNK for k in chunks], pa.int32()), pa.array(packed, pa.binary())], names=names)


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])


def _keys(shared):
    """(key, part, cid, at): the rarest shingles of each class that a task meets, once a task. Part is 0 for keys that are one list."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = shared.value, set()
        for batch in batches:
            for held in _classes(batch):
                keys, parts, cids, sizes, at = [], [], [], [], []
                for s, cid in held:
                    if cid is None or cid in seen:
                        continue
                    seen.add(cid)
                    take = len(s) + (-len(s) * SIMILAR // OF) + 1
                    often = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.argsort(often, kind="stable")
                    keys.append(s[order[:take]])
                    lists = often[order[:take]].astype(np.int64) // LIST_KEYS + 1
                    parts.append(np.where(lists > 1, cid % lists + 1, 0).astype(np.int32))
                    cids.append(cid)
                    sizes.append(take)
                    at.append((len(s) << 32) + len(s) - np.arange(take))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(parts)), pa.array(np.repeat(np.array(cids, np.int64), sizes)), pa.array(np.concatenate(at))], names=["key", "part", "cid", "at"])

    return run


@tidy
def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, cid, at): a partition's keys that two or more classes share, with their classes.

    A class stays out of the list of a key so late in its order that no other class of the list could
    link with it by it. Of a key that is dealt out as several lists, each keeps all of its classes, as
    the others may have those that they link with.
    """
    got = [tuple(np.asarray(b.column(k)) for k in ("key", "part", "cid", "at")) for b in batches if b.num_rows]
    if not got:
        return
    key, part, cid, at = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    order = np.lexsort((part, key))
    key, part, cid, at = key[order], part[order], cid[order], at[order]
    same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
    twin = part > 0
    twin[1:] |= same
    twin[:-1] |= same
    key, part, cid, at = key[twin], part[twin], cid[twin], at[twin]
    order = np.lexsort((cid, part, key))
    key, part, cid, at = key[order], part[order], cid[order], at[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])  # a class comes once from each task that met it
    key, part, cid, at = key[new], part[new], cid[new], at[new]
    if not len(key):
        return
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
    n = at >> 32
    least = np.repeat(np.minimum.reduceat(n, first), np.diff(np.append(first, len(key))))
    useful = (part > 0) | (_rest(at) >= _needed(n, np.maximum(least, -(-n * SIMILAR // OF))))
    key, part, cid, at = key[useful], part[useful], cid[useful], at[useful]
    same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
    keep = part > 0
    keep[1:] |= same
    keep[:-1] |= same
    key, part, cid, at = key[keep], part[keep], cid[keep], at[keep]
    for a in range(0, len(key), 500_000):
        some = slice(a, a + 500_000)
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(part[some]), pa.array(cid[some]), pa.array(at[some])], names=["key", "part", "cid", "at"])


def _sets(shared):
    """(cid, items) of the texts (tid, text) that pass the filter; no others are cut into shingles."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, seen = shared.value, set()
        for batch in batches:
            tids = np.asarray(batch.column("tid"))
            keep = passes_filter(field, tids.view(np.uint64))
            for k in np.flatnonzero(keep).tolist():
                if int(tids[k]) in seen:
                    keep[k] = False
                seen.add(int(tids[k]))
            for held in _classes(batch.filter(pa.array(keep)), 1_000_000):
                out = {cid: s for s, cid in held if cid is not None}
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([s.tobytes() for s in out.values()], pa.binary())], names=["cid", "items"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each cid of a partition that holds all of its rows."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for c in batch.column("cid").to_pylist():
            keep.append(c not in seen)
            seen.add(c)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each cid, as _once() has it, and the point of merged groups."""
    for batch in _once(batches):
        small = [m.astype(np.uint8 if m.max() < 256 else np.int32).tobytes() for m in merged(points_of(batch.column("point").to_pylist()))] if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(small, pa.binary())], names=["cid", "n", "point", "small"])


class CountTree:
    """R-tree over points of group counts, packed by halving along the coordinate of the widest spread.

    A node has the largest count of each group and the least and largest sum below it.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.sums = points, points.sum(1)
        #: Points of each leaf; leaves that follow each other lie side by side in the tree.
        self.leaves: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.least: list[int] = []
        self.most: list[int] = []
        self.below: list[tuple[int, int] | np.ndarray] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray) -> int:
        if len(at) <= LEAF:
            below: tuple[int, int] | np.ndarray = at
            self.leaves.append(at)
        else:
            every = np.column_stack([self.points[at], self.sums[at]])
            wide = int((every.max(0) - every.min(0)).argmax())
            order = at[np.argsort(every[:, wide], kind="stable")]
            below = (self._build(order[: len(at) // 2]), self._build(order[len(at) // 2 :]))
        self.high.append(self.points[at].max(0))
        self.least.append(int(self.sums[at].min()))
        self.most.append(int(self.sums[at].max()))
        self.below.append(below)
        return len(self.below) - 1


def tree_pairs(a: CountTree, b: CountTree) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i of a, j of b) of points whose sum of coordinate minima reaches the overlap that linked sets need; i < j if a is b."""
    out_i, out_j, open_ = [], [], [(a.root, b.root)]
    while open_:
        x, y = open_.pop()
        # The bound of two nodes: no pair below them overlaps more, and every pair needs at least this.
        low = max(a.least[x], b.least[y] * SIMILAR / OF) + max(b.least[y], a.least[x] * SIMILAR / OF)
        if a.least[x] * SIMILAR > b.most[y] * OF or b.least[y] * SIMILAR > a.most[x] * OF or np.minimum(a.high[x], b.high[y]).sum() < low * SIMILAR / (OF + SIMILAR):
            continue
        p, q = a.below[x], b.below[y]
        if isinstance(p, tuple) and (not isinstance(q, tuple) or a.most[x] >= b.most[y]):
            if a is b and x == y:
                open_ += [(p[0], p[0]), (p[0], p[1]), (p[1], p[1])]
            else:
                open_ += [(p[0], y), (p[1], y)]
        elif isinstance(q, tuple):
            open_ += [(x, q[0]), (x, q[1])]
        else:
            least = np.minimum(a.points[p][:, None, :], b.points[q][None, :, :]).sum(2)
            i, j = np.nonzero(least >= _needed(a.sums[p][:, None], b.sums[q][None, :]))
            i, j = p[i], q[j]
            if a is b:
                i, j = np.minimum(i, j), np.maximum(i, j)
                keep = i < j
                if x == y:
                    i, j = np.unique(np.stack([i[keep], j[keep]]), axis=1) if keep.any() else (i[:0], j[:0])
                else:
                    i, j = i[keep], j[keep]
            out_i.append(i)
            out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def _leaf_pairs(tree: CountTree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points that share a leaf of the tree, or lie in leaves that follow each other."""
    left, right = [], []
    for k, leaf in enumerate(tree.leaves):
        x, y = np.triu_indices(len(leaf), 1)
        left.append(leaf[x])
        right.append(leaf[y])
        if k:
            before = tree.leaves[k - 1]
            left.append(np.repeat(before, len(leaf)))
            right.append(np.tile(leaf, len(before)))
    return np.concatenate(left), np.concatenate(right)


def _pairs_of_short(lo: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All pairs of lists that would be trees of one leaf: where they begin, and how long they are."""
    left, right = [], []
    for m in np.unique(size[size <= LEAF]).tolist():
        i, j = np.triu_indices(m, 1)
        at = lo[size == m][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    return left, right


def _hub_pairs(n: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each place of a list with its size's hub, and of these with the hub of the size before.

    The hub of a size has the fewest rare shingles of its own before the key, so it links with more of
    its near copies than they do with one another.
    """
    order = np.lexsort((-rest, n))
    lead = np.append(True, n[order[1:]] != n[order[:-1]])
    first = np.maximum.accumulate(np.where(lead, np.arange(len(n)), 0))
    other = np.where(lead, first[np.maximum(np.arange(len(n)) - 1, 0)], first)
    keep = other != np.arange(len(n))
    return order[other[keep]], order[keep]


@tidy
def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), a < b: of each list, pairs that may link and connect what lies together in the list's R-tree.

    Besides neighbours in the tree, classes are paired with the hub of their size. Of the pairs that
    the bound leaves, those of the most overlap stay that connect what all of them connect.
    """
    for t, runs in runs_of(batches, ["key", "part"]):
        if not runs:
            continue
        cid, p = t.column("cid").to_numpy(), points_of(t.column("small").to_pylist(), MERGED)
        n, rest = p.sum(1, dtype=np.int64), _rest(t.column("at").to_numpy())
        lo, size = np.array(runs)[:, 0], np.diff(np.array(runs), axis=1)[:, 0]
        left, right = _pairs_of_short(lo, size)
        for a, m in zip(lo[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
            i, j = _leaf_pairs(CountTree(p[a : a + m].astype(np.int32)))
            hubs, others = _hub_pairs(n[a : a + m], rest[a : a + m])
            left += [a + i, a + hubs]
            right += [a + j, a + others]
        i, j = np.concatenate(left), np.concatenate(right)
        fit = (n[i] * OF >= n[j] * SIMILAR) & (n[j] * OF >= n[i] * SIMILAR) & (np.minimum(rest[i], rest[j]) >= _needed(n[i], n[j]))
        i, j = i[fit], j[fit]
        most = most_overlap(p, i, j)
        keep = most >= _needed(n[i], n[j])
        i, j, most = i[keep], j[keep], most[keep]
        if len(i):
            order = np.argsort(most / (n[i] + n[j]), kind="stable")  # of pairs that connect the same, the last one stays
            i, j = np.array(spanning(i[order], j[order], UnionFind(len(n)))).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[i], cid[j])), pa.array(np.maximum(cid[i], cid[j]))], names=["a", "b"])


@tidy
def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs of a key's classes in different components that the bounds leave, a < b.

    Short lists would be trees of one leaf; their pairs are bounded together. Of the pairs that a tree
    leaves on merged groups, the bound on all groups leaves fewer.
    """
    for t, runs in runs_of(batches, ["key", "unit_i", "unit_j"]):
        if not runs:
            continue
        cid, comp, units, other, block = (t.column(k).to_numpy() for k in ("cid", "component", "unit_i", "unit_j", "in_block"))
        p = points_of(t.column("point").to_pylist())
        n, rest = p.sum(1, dtype=np.int64), _rest(t.column("at").to_numpy())
        lo, size = np.array(runs)[:, 0], np.diff(np.array(runs), axis=1)[:, 0]
        one = units[lo] == other[lo]
        left, right = _pairs_of_short(lo[one], size[one])
        for a, m, single in zip(lo.tolist(), size.tolist(), one.tolist(), strict=True):
            if single and m <= LEAF:
                continue
            at, small = np.arange(a, a + m), merged(p[a : a + m])
            if single:
                tree = CountTree(small)
                i, j = tree_pairs(tree, tree)
                i, j = at[i], at[j]
            else:
                x, y = block[at] == units[a], block[at] == other[a]
                if not (x.any() and y.any()):
                    continue
                i, j = tree_pairs(CountTree(small[x]), CountTree(small[y]))
                i, j = at[x][i], at[y][j]
            left.append(i)
            right.append(j)
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        apart = (comp[i] != comp[j]) & (n[i] * OF >= n[j] * SIMILAR) & (n[j] * OF >= n[i] * SIMILAR) & (np.minimum(rest[i], rest[j]) >= _needed(n[i], n[j]))
        i, j = i[apart], j[apart]
        ends = np.unique(np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j]), i, j])[:2], axis=1, return_index=True)[1] if len(i) else i
        i, j = i[ends], j[ends]
        keep = may_link(p, n, i, j)
        i, j = i[keep], j[keep]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[i], cid[j])), pa.array(np.maximum(cid[i], cid[j]))], names=["a", "b"])


@tidy
def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.num_rows
        p = points_of(batch.column("point_a").to_pylist() + batch.column("point_b").to_pylist())
        keep = may_link(p, p.sum(1, dtype=np.int64), np.arange(k), np.arange(k, 2 * k)) if k else np.empty(0, bool)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def fine_point(s: np.ndarray) -> bytes:
    """Counts of a sorted set by the leading bits of its shingles, in about as many groups as it has shingles; empty where a byte is too small."""
    bits = max(8, (len(s) - 1).bit_length())
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def fine_overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Sum of the coordinate minima of two fine points; the one of more groups is merged to those of the other."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(1, dtype=np.int64)
    return int(np.minimum(x, y).sum(dtype=np.int64))


@tidy
def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fine = [fine_point(np.frombuffer(raw, np.uint64)) for raw in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(fine, pa.binary())], names=["cid", "fine"])


@tidy
def _fine_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose fine points leave the overlap that linked sets need, and those with a set that has none."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("fine_a").to_pylist(), batch.column("fine_b").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            keep.append(not x or not y or fine_overlap(p, q) >= _needed(int(p.sum(dtype=np.int64)), int(q.sum(dtype=np.int64))))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


@tidy
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * OF >= (len(x) + len(y) - both) * SIMILAR)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, and component_id, the smallest doc_id that links reach.

    Exact up to collisions of 64-bit hashes: no pair of different sets with a similarity of 0.75 or
    more is missed. Null or empty texts and texts without words link with nothing; shorter texts than a
    shingle are one shingle; repeated rows and equal sets are one class; a null doc_id is nobody's
    component unless all are null; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = string_column(docs.select("doc_id", "text"), "text")
    docs = docs.withColumn("tid", F.xxhash64("text"))
    texts = docs.select("text")
    first = scratch.save(docs.mapInArrow(_first_pass, "doc_id long, tid long, n_shingles long, cid long, point binary, chunk int, counts binary"), "first")
    parts = (1 << SKETCH_BITS) // CHUNK
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in first.where("chunk is not null").select("chunk", "counts").repartition(parts, "chunk").mapInArrow(_sum_chunks, "chunk int, counts binary").collect():
        sketch[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    # What every slot has says nothing of its shingles; the rest tells frequent ones apart in any number of them.
    sketch = np.minimum(sketch - sketch.min(), 2**31 - 1).astype(np.int32)
    rows = first.where("chunk is null").select("doc_id", "n_shingles", "cid")
    # A text of each class, by hash: what it takes to find the class's set again.
    of_texts = first.where("cid is not null").groupBy("cid").agg(F.min("tid").alias("tid"))
    n_keys = (rows.agg(F.sum("n_shingles")).first()[0] or 0) // 4
    tasks = max(spark.sparkContext.defaultParallelism, n_keys // TASK_KEYS)

    keys = texts.mapInArrow(_keys(spark.sparkContext.broadcast(sketch)), "key long, part int, cid long, at long").repartition(tasks, "key", "part")
    met = scratch.save(keys.mapInArrow(_meetings, "key long, part int, cid long, at long"), "met")
    points = first.where("point is not null").select("cid", F.col("n_shingles").alias("n"), "point").repartition(tasks, "cid")
    points = scratch.save(points.mapInArrow(_points, "cid long, n long, point binary, small binary"), "points")

    def gathered(ids: DataFrame, name: str) -> DataFrame:
        """Whole sets of the classes to be verified, from one text of each, which is read again."""
        wanted = scratch.save(ids.join(of_texts, "cid").select("tid"), f"{name}-texts")
        sets = docs.select("tid", "text").mapInArrow(_sets(build_filter(wanted)), "cid long, items binary").repartition(tasks, "cid")
        return scratch.save(sets.mapInArrow(_once, "cid long, items binary"), name)

    def verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        both = pairs.join(sets.toDF("a", "items_a"), "a").join(sets.toDF("b", "items_b"), "b")
        return scratch.save(both.mapInArrow(_verify, "a long, b long"), name)

    def ends(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), name)

    # The first search takes, of the keys that a class shares, those of the least hashes: near copies mostly take the same.
    some = met.withColumn("_nth", F.row_number().over(Window.partitionBy("cid").orderBy(F.xxhash64("key")))).where(F.col("_nth") <= FIRST_KEYS).drop("_nth")
    lists = some.join(points.select("cid", "small"), "cid").repartition(tasks, "key", "part").sortWithinPartitions("key", "part")
    near = lists.select("key", "part", "cid", "at", "small").mapInArrow(_nearest, "a long, b long").distinct()
    whole = points.select("cid", "n", "point")
    near = near.join(whole.toDF("a", "n_a", "point_a"), "a").join(whole.toDF("b", "n_b", "point_b"), "b").mapInArrow(_bound, "a long, b long")
    near = scratch.save(near, "near")
    sets = gathered(ends(near, "ends"), "sets")
    links = verified(near, sets, "links-1")
    comp = components(links, scratch, "cc-1")
    placed = met.select("key", "cid", "at").join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = scratch.save(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("_rows")).where("lo <> hi").select("key", "_rows"), "mixed")
    lists = placed.join(mixed, "key", "left_semi").join(points.select("cid", "point"), "cid")
    pairs = split_blocks(lists, ["key"], "cid", BLOCK, scratch, counts=mixed).mapInArrow(_search, "a long, b long").distinct().join(near, ["a", "b"], "left_anti")
    pairs = scratch.save(pairs, "pairs")
    wanted = ends(pairs, "more-ends")
    missing = scratch.save(wanted.join(sets.select("cid"), "cid", "left_anti"), "missing")
    sets = sets.join(wanted, "cid", "left_semi")
    if not missing.isEmpty():
        sets = sets.unionByName(gathered(missing, "more-sets").join(missing, "cid", "left_semi"))
    # Few of these pairs link, and sets are large: fine points, an eighth of their size, meet before sets do.
    fine = scratch.save(sets.mapInArrow(_fine, "cid long, fine binary"), "fine")
    close = pairs.join(fine.toDF("a", "fine_a"), "a").join(fine.toDF("b", "fine_b"), "b").mapInArrow(_fine_bound, "a long, b long")
    close = scratch.save(close, "close")
    more = verified(close, sets.join(ends(close, "close-ends"), "cid", "left_semi"), "links-2")
    comp = components(links.unionByName(more), scratch, "cc-2")

    least = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least")).join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = scratch.save(least, "least")
    of_component = least.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = scratch.save(least.join(of_component, "component").select("cid", "component_id"), "answers")
    for name in ("ends", "more-ends", "met", "points", "near", "sets", "missing", "more-sets", "pairs", "mixed", "fine", "close", "close-ends"):
        scratch.drop(name)
    linked = rows.join(answers, "cid").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("cid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingle
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
