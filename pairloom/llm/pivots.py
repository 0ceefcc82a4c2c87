"""Near-duplicate embeddings through an index of pivot permutations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import Scratch, UnionFind, components, runs_of, spanning, split_blocks, table

COSINE = 0.93
#: Nearest pivots, in order, that describe a vector, and how many of them two vectors must share to be compared.
NEAREST, SHARED = 8, 2
#: One of so many first pivots of either must be among the nearest of the other.
HEAD = 3
#: Bounds of the number of pivots, a sample of the vectors.
PIVOTS = (64, 4096)
#: Pivots are further apart than this cosine; a pivot with another drawn vector within it has a cell, searched exactly.
CELL = 0.8
#: Vectors of one list, and of one cell, that a task compares at a time with as many others.
BLOCK, CELL_BLOCK = 1024, 4096


def n_pivots(largest: int) -> int:
    """Pivots for four vectors, on average, that share a given pair of nearest pivots, if the largest label has `largest` vectors."""
    keys = NEAREST * (NEAREST - 1) // 2
    return int(min(max(np.ceil(np.sqrt(2 * keys * largest / 4)), PIVOTS[0]), PIVOTS[1]))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, k: int = NEAREST) -> np.ndarray:
    """Indices of the k pivots nearest to each vector by angle, the nearest first: the head of its permutation."""
    near = vectors @ pivots.T
    k = min(k, len(pivots))
    some = np.argpartition(-near, k - 1, 1)[:, :k] if k < len(pivots) else np.tile(np.arange(len(pivots)), (len(vectors), 1))
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), 1, kind="stable"), 1)


def thin_pivots(drawn: np.ndarray, cosine: float = CELL) -> tuple[np.ndarray, np.ndarray]:
    """Of drawn unit vectors, those with no earlier one of the result within `cosine`; and the indices of those that stand for others, too."""
    kept, stands = np.empty_like(drawn), np.zeros(len(drawn), bool)
    n = 0
    for v in drawn:
        near = kept[:n] @ v
        if n and near.max() >= cosine:
            stands[near.argmax()] = True
        else:
            kept[n] = v
            n += 1
    return kept[:n], np.flatnonzero(stands[:n])


def visiting_cosine(cosine: float) -> float:
    """Cosine to a pivot that all vectors reach which are linked with one within CELL of the pivot."""
    angle = np.arccos(CELL) + np.arccos(cosine)
    return float(np.cos(angle)) - 1e-9 if angle < np.pi else -2.0


def _unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _lists(shared, visiting: float, cells: bool):
    """Entries of the inverted lists. Of cells: one for each cell that a vector is in or visits, under -1 - pivot.

    Else, for each vector in no cell, one for each of its nearest pivots, with all of them in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = shared.value
        for batch in batches:
            # Components stay as they are stored; lists hold no wider copies.
            kind = np.float32 if pa.types.is_float32(batch.column("embedding").type.value_type) else np.float64
            labels, ids, sizes, vectors = (batch.column(k).to_pylist() for k in ("label", "cid", "n", "embedding"))
            for dim in {len(v) for v in vectors}:
                pivots, dense = by_size[dim]
                at = [k for k, v in enumerate(vectors) if len(v) == dim]
                for lo in range(0, len(at), 2048):
                    some = np.array(at[lo : lo + 2048])
                    x = _unit([vectors[k] for k in some])
                    home = np.full(len(x), -1)
                    if len(dense):
                        near_cells = x @ pivots[dense].T
                        home = np.where(near_cells.max(1) >= CELL, dense[near_cells.argmax(1)], -1)
                    if cells:
                        rows, cell = np.nonzero(near_cells >= visiting) if len(dense) else (np.empty(0, int), np.empty(0, int))
                        key, own = -1 - dense[cell], home[rows].astype(np.int16)[:, None]
                    else:
                        outside = np.flatnonzero(home < 0)
                        some, x = some[outside], x[outside]
                        if not len(x):
                            continue
                        near = nearest_pivots(x, pivots).astype(np.int16)
                        key, rows = near.astype(np.int64).ravel(), np.repeat(np.arange(len(some)), near.shape[1])
                        own = near[rows]
                    if not len(rows):
                        continue
                    take = some[rows]
                    raw = [np.array(vectors[k], kind).tobytes() for k in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(labels, np.int64)[take]),
                            pa.array(np.full(len(take), dim, np.int32)),
                            pa.array(key.astype(np.int64)),
                            pa.array(np.array(ids, np.int64)[take]),
                            pa.array(np.array(sizes, np.int64)[take]),
                            pa.array([raw[r] for r in rows], pa.binary()),
                            pa.array([v.tobytes() for v in own], pa.binary()),
                        ],
                        names=["label", "dim", "key", "cid", "n", "vec", "near"],
                    )

    return run


def _one_hot(p: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Which of the pivots (ascending) are among each row's nearest ones."""
    at = np.searchsorted(pivots, p)
    out = np.zeros((len(p), len(pivots) + 1), np.float32)
    out[np.arange(len(p))[:, None], np.where(pivots[np.minimum(at, len(pivots) - 1)] == p, at, len(pivots))] = 1
    return out[:, :-1]


def shared_pivots(a: np.ndarray, b: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of a pivot's list that share SHARED of their nearest pivots, by counts, and have this pivot as the lowest of these.

    Of the order, the head counts most: one of the first HEAD pivots of either must be among the nearest of the other.
    """
    pivots = np.unique(np.concatenate([a.ravel(), b.ravel()]))
    one, two = _one_hot(a, pivots), _one_hot(b, pivots)
    low = int(np.searchsorted(pivots, key))
    least = min(SHARED, a.shape[1])
    found = (one @ two.T >= least) & (one[:, :low] @ two[:, :low].T == 0)
    found &= (_one_hot(a[:, :HEAD], pivots) @ two.T > 0) | (one @ _one_hot(b[:, :HEAD], pivots).T > 0)
    return np.nonzero(found)


def _of_cell(home: np.ndarray, i: np.ndarray, j: np.ndarray, cell: int) -> np.ndarray:
    """Which pairs belong to this cell: the lower one of the cells that the two are in, and no pair of visitors."""
    a, b = home[i], home[j]
    return np.where((a < 0) | (b < 0), np.maximum(a, b), np.minimum(a, b)) == cell


def _compare(cosine: float):
    """Links within a list or cell, each counted only in one that its two vectors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in runs_of(batches, ["label", "dim", "key", "unit_i", "unit_j"]):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if not runs:
                continue
            cids, sizes, keys, dims, units, other, block = (t.column(k).to_numpy() for k in ("cid", "n", "key", "dim", "unit_i", "unit_j", "in_block"))
            vec, near = t.column("vec").to_pylist(), t.column("near").to_pylist()
            for lo, hi in runs:
                raw = b"".join(vec[lo:hi])
                x = _unit(np.frombuffer(raw, np.float32 if len(raw) == 4 * (hi - lo) * int(dims[lo]) else np.float64).reshape(hi - lo, -1))
                p = np.frombuffer(b"".join(near[lo:hi]), np.int16).reshape(hi - lo, -1)
                one = two = np.arange(hi - lo)
                same = units[lo] == other[lo]
                if not same:
                    one, two = one[block[lo:hi] == units[lo]], two[block[lo:hi] == other[lo]]
                right, key = x[two].T, int(keys[lo])
                c, n = cids[lo:hi], sizes[lo:hi]
                links, sets, kept = np.zeros(hi - lo), UnionFind(hi - lo), []
                for strip in range(0, len(one), 512):
                    some = one[strip : strip + 512]
                    if key < 0:
                        i, j = np.nonzero(x[some] @ right >= cosine)
                    else:
                        i, j = shared_pivots(p[some], p[two], key)
                    i, j = some[i], two[j]
                    if same:
                        i, j = i[i < j], j[i < j]
                    if key < 0:
                        mine = _of_cell(p[:, 0], i, j, -1 - key)
                    else:
                        mine = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 100_000]], x[j[a : a + 100_000]]) >= cosine for a in range(0, max(len(i), 1), 100_000)])
                    i, j = i[mine], j[mine]
                    if len(i):
                        links += np.bincount(i, n[j], hi - lo) + np.bincount(j, n[i], hi - lo)
                        kept += spanning(i, j, sets)
                got = np.flatnonzero(links)
                if not len(got):
                    continue
                out.append((c[got], c[got], links[got].astype(np.int64)))
                a, b = np.array(kept).T
                out.append((c[a], c[b], np.zeros(len(a), np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b", "links"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of vectors (vec_id, label, embedding): links to rows of the same label with a cosine of `cosine` or more.

    n_links counts other rows linked directly, component_id is the smallest vec_id that links reach,
    kept says whether it is the row's own. Rows without a label or a vector, and vectors that are
    zero or hold null or non-finite components, link with nothing. Equal vectors of a label are one
    class of any size and are never compared; of other columns nothing is read. Repeated rows link
    with one another; a null vec_id is nobody's component unless all are null; an empty table gives no
    rows.

    Pivots are drawn vectors no two of which are within CELL. Where several drawn vectors were, a
    group is dense, and all links of a vector within CELL of that pivot are found: by the triangle
    inequality they end at vectors that visit the cell. The other vectors are described by their eight
    nearest pivots, in order, and filed under each. Two of a list are compared if they share two of
    these pivots, one of them among the first three of either. Of pairs of random vectors at the cosine
    itself this finds 0.99975 with 2,000 vectors of a label, 0.9977 with 20,000, 0.9934 with 200,000
    and 0.985 with 1.2 million; at 0.95, 0.9957 or more (a simulation over 20,000 pairs each). Vectors travel with their entries, as
    they are stored: to fetch them for each pair that a list retrieves would move more.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # 128 bits name a vector, so that rows meet their class without it.
    valid = rows.where(usable).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("second"), "embedding")})
    alike = ["label", "h1", "h2"]
    classes = valid.groupBy(*alike).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    sized = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    pivots = {}
    for r in sized:
        of_dim = classes.where(F.size("embedding") == r["dim"])
        drawn = of_dim.orderBy(F.xxhash64(F.lit("pivot"), "embedding", "label"), "cid").limit(n_pivots(r["n"])).select("embedding").collect()
        pivots[r["dim"]] = thin_pivots(_unit([d["embedding"] for d in drawn]))
    shared = spark.sparkContext.broadcast(pivots)
    found = None
    for name, cells, block in (("lists", False, BLOCK), ("cells", True, CELL_BLOCK)):
        if cells and not any(len(dense) for _, dense in pivots.values()):
            continue
        lists = classes.select("label", "cid", "n", "embedding").mapInArrow(_lists(shared, visiting_cosine(cosine), cells), "label long, dim int, key long, cid long, n long, vec binary, near binary")
        units = split_blocks(lists, ["label", "dim", "key"], "cid", block, scratch, name)
        part = scratch.save(units.mapInArrow(_compare(cosine), "a long, b long, links long"), f"found-{name}")
        found = part if found is None else found.unionByName(part)
    links = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    comp = components(found.where("a <> b").select("a", "b"), scratch)
    known = classes.drop("embedding").join(comp.withColumnRenamed("id", "cid"), "cid", "left").join(links, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    known = scratch.save(known, "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = scratch.save(known.join(least, "component").select(*alike, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "answers")
    for done in ("found-lists", "found-cells", "known", "classes"):
        scratch.drop(done)
    linked = valid.select("vec_id", *alike).join(answers, alike).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
