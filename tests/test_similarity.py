import os
import pathlib
import random
import shutil
import subprocess
import sys
from statistics import pstdev

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as X
from pairloom.functions import vector as V
from pairloom.operators import assign, index, join, layers, lsh, matrix, place, stats
from pairloom.plans import cli
from pairloom.sources import files

# Letters, fruit, loads and hash keys below are the published examples of these operators.
LETTERS = ["a a a a", "a a b b", "a b f g ", "b b b b"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def pairs(df):
    return {(r["i"], r["j"]): round(r["sim"], 8) for r in df.collect()}


def test_letters(spark):
    want = {(1, 0): 0.70710678, (2, 0): 0.5, (3, 1): 0.70710678, (2, 1): 0.70710678, (3, 2): 0.5}
    vectors = X.token_counts(X.tokenize(docs(spark, LETTERS)))
    assert pairs(join.similar_pairs(vectors, 0.4)) == want
    assert pairs(join.similar_pairs(vectors, 0.5)) == {k: v for k, v in want.items() if v > 0.5}


@pytest.mark.parametrize("n", [1, 2, 3, 8])
def test_strategies_agree(spark, n):
    rng = random.Random(n)
    rows = [(i, f, rng.choice([-2.0, -1.0, 1.0, 3.0])) for i in range(25) for f in rng.sample(range(12), 4)]
    vectors = spark.createDataFrame(rows, "id long, feature int, weight double")
    for t in (0.3, 0.7):
        want = pairs(join.similar_pairs(vectors, t, "brute"))
        assert pairs(join.similar_pairs(vectors, t)) == want
        assert pairs(join.similar_pairs(vectors, t, "layered", n)) == want
        assert pairs(join.similar_pairs(vectors, t, "prefix")) == want
        assert pairs(join.prefix_pairs(V.l2_normalize(vectors), t, 3)) == want


def test_tokens_and_hash(spark):
    got = spark.createDataFrame([("",), ("a  b ",), (" a",), ("   ",)], "t string").select(X.tokens(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [[""], ["a", "", "b"], ["", "a"], []]
    hashes = spark.createDataFrame([("hello",), ("é",), ("polygenelubricants",), ("😀",), ("a😀b",)], "t string").select(X.java_hash(F.col("t")).alias("h")).collect()
    units = lambda t: [int.from_bytes(t.encode("utf-16-be")[k : k + 2], "big") for k in range(0, len(t.encode("utf-16-be")), 2)]
    h = 0
    for u in units("a😀b"):
        h = (h * 31 + u) & 0xFFFFFFFF
    assert [r["h"] for r in hashes] == [99162322, 233, -2147483648, 1772899, h - (1 << 32) if h >> 31 else h]
    assert len(X.STOP_WORDS) == len(set(X.STOP_WORDS)) == 174


def test_bags(spark):
    bag = X.bow_counts(docs(spark, ["1 2 3 4", "", "5 5 7"]))
    assert {(r["id"], r["feature"]): r["weight"] for r in bag.collect()} == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 1, (2, 5): 2, (2, 7): 1}
    assert {r["id"]: r["text"] for r in X.bow_revert(bag).collect()} == {0: "1 2 3 4", 2: "5 5 7"}


def test_norms_and_hash(spark):
    rows = [(i, f, w) for i, ws in enumerate([(0.1, 0.3, 0.4), (0.1, 0.5, 0.4)]) for f, w in zip((0, 2, 3), ws, strict=True)]
    got = V.norms(spark.createDataFrame(rows, "id long, feature int, weight double")).orderBy("id").collect()
    assert [round(r["l1"], 9) for r in got] == [0.8, 1.0]
    keys = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (7, 0), (7, 7)], "b long, t long")
    hashed = keys.select("b", "t", layers.triangular_hash(F.col("b"), F.col("t")).alias("h"))
    assert [r["h"] for r in hashed.collect()] == [0, 2, 4, 28, 35]
    back = layers.triangular_unhash(F.col("h"))
    assert all((r["b"], r["t"]) == (r["x"], r["y"]) for r in hashed.select("b", "t", back[0].alias("x"), back[1].alias("y")).collect())


def test_assignment_and_balance(spark):
    parts = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 1), (4, 2)], "layer int, tied int")
    assert assign.assignment(parts, 5).count() == 16
    for n in range(1, 12):
        got = spark.range(n).select(F.col("id").alias("layer")).crossJoin(spark.range(n).select(F.col("id").alias("o"))).where(assign.circular("layer", "o", n)).collect()
        assert sorted(tuple(sorted((r["layer"], r["o"]))) for r in got) == [(a, b) for a in range(n) for b in range(a, n)]
    sizes = {(k, 0): s for k, s in {1: 10, 2: 30, 3: 41, 4: 40}.items()}
    held = {(k, 0): {(o, 0) for o in v} for k, v in {1: set(), 2: set(), 3: {2}, 4: {1, 2, 3}}.items()}
    one = assign.take_over(held, sizes)
    assert {k[0]: {o[0] for o in v} for k, v in one.items()} == {1: {4}, 2: {3, 4}, 3: {4}, 4: set()}
    two = assign.refine(one, sizes)
    assert {k[0]: {o[0] for o in v} for k, v in two.items()} == {1: {4}, 2: {3}, 3: {4}, 4: {2}}
    assert sorted(assign.longest_first({(k, 0): k for k in range(6)}, 2).values()) == [0, 0, 0, 1, 1, 1]


def test_signatures(spark):
    anchors = ["banana banana banana", "grape grape grape", "onion onion onion"]
    texts = ["banana banana grape grape", "banana banana onion onion", "grape grape grape", "grape onion onion"]
    a = X.token_counts(X.tokenize(docs(spark, anchors))).withColumn("pos", F.col("id").cast("int"))
    got = lsh.signatures(X.token_counts(X.tokenize(docs(spark, texts))), a)
    keys = {r["id"]: r["key"] for r in got.collect()}
    assert [keys[k] for k in range(3)] == ["110", "101", "010"] and keys[3] == "001"


def test_index_and_transpose(spark):
    postings = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 2.0)], "id long, feature int, weight double")
    assert {r["feature"]: [p["id"] for p in r["postings"]] for r in index.inverted_index(postings).collect()} == {1: [0], 2: [0, 1]}
    rows = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6])], "row long, values array<int>")
    assert {r["row"]: r["values"] for r in matrix.transpose(rows).collect()} == {0: [1, 4], 1: [2, 5], 2: [3, 6]}


def test_files(spark, tmp_path):
    (tmp_path / "bags.txt").write_text("1 2 2\n3\n")
    assert files.read_bags(spark, str(tmp_path / "bags.txt")).count() == 3
    assert files.read_matrix(spark, str(tmp_path / "bags.txt")).collect()[1]["values"] == [3]
    out = spark.createDataFrame([(1, 0, 0.5)], "i long, j long, sim double")
    files.write_pairs(out, str(tmp_path / "pairs"))
    assert files.read_pairs(spark, str(tmp_path / "pairs")).collect() == out.collect()


def test_entry_without_training_data(tmp_path):
    """The rest imports and has its queries when the training-data subpackage and the pipeline are deleted."""
    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "pairloom", tmp_path / "pairloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'apss_documents' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_places_over_all_partitions(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0.5, 0.5, rng.random()]), rng.randrange(3)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, x double, g int").repartition(7)
    got = {r["id"]: r["rk"] for r in place.numbered(df, "x", "id").collect()}
    assert got == {k: n for n, (_, k) in enumerate(sorted((x, k) for k, x, _ in rows))}
    within = {r["id"]: r["at"] for r in place.numbered_within(df, ["g"], "id", "at").collect()}
    assert within == {k: sum(g == o and j < k for j, _, o in rows) for k, _, g in rows}


def test_lines_of_several_files_and_blocks(spark, tmp_path):
    lines = [[f"{name} {k}" for k in range(n)] for name, n in (("a", 400), ("b", 3), ("c", 700))]
    for name, held in zip("abc", lines, strict=True):
        (tmp_path / f"{name}.txt").write_text("".join(f"{x}\n" for x in held))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted((r["id"], r["text"]) for r in files.read_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate(x for held in lines for x in held))


def test_frozen_partitions_take_nothing():
    # The dearest partition can hand nothing over and is done; the next one may not hand to it, however cheap that would be.
    sizes = {(k, 0): s for k, s in enumerate((10, 1, 9))}
    held = {(0, 0): set(), (1, 0): {(2, 0)}, (2, 0): {(0, 0)}}
    got = assign.refine(held, sizes)
    assert got == held
    rng = random.Random(2)
    for _ in range(50):
        sizes = {(k, 0): rng.randrange(1, 30) for k in range(6)}
        held = {k: {o for o in sizes if o < k and rng.random() < 0.7} for k in sizes}
        done = assign.balance(held, sizes)
        pairs_of = lambda h: sorted(tuple(sorted((k, o))) for k, v in h.items() for o in v)
        assert pairs_of(done) == pairs_of(held)


def test_reports_of_balancing(spark):
    sizes = {(k, 0): s for k, s in {1: 10, 2: 30, 3: 41, 4: 40}.items()}
    held = {(k, 0): {(o, 0) for o in v} for k, v in {1: set(), 2: set(), 3: {2}, 4: {1, 2, 3}}.items()}
    got = assign.balance_deviations(held, sizes)
    costs = lambda h: [s * s + sum(s * sizes[o] for o in h[k]) for k, s in sizes.items()]
    one = assign.take_over(held, sizes)
    assert got == {"before": pstdev(costs(held)), "stage1": pstdev(costs(one)), "stage2": pstdev(costs(assign.refine(one, sizes)))}
    assert got["before"] > got["stage2"]
    slots = assign.slot_deviations({k: 10 * s for k, s in sizes.items()}, sizes, 2)
    assert slots["balanced"] <= slots["unbalanced"]
    frame = spark.createDataFrame([(*k, s) for k, s in sizes.items()], "layer int, tied int, size long")
    pairs_ = spark.createDataFrame([(*k, *o) for k, v in held.items() for o in v], "layer int, tied int, o_layer int, o_tied int")
    row = assign.balance_report(pairs_, frame, 2, 20).collect()[0].asDict()
    assert {k: row[k] for k in got} == got and set(row) == {"before", "stage1", "stage2", "unbalanced", "balanced"}
    weights = {(r["layer"], r["tied"]): (r["chunks"], r["weight"]) for r in assign.pair_weights(pairs_, frame, 20).collect()}
    assert weights == {(3, 0): (3, 3 * 41 * 30), (4, 0): (2, 2 * 40 * (10 + 30 + 41))}


def test_indexes_and_vectors_by_partition(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f, 1.0 + i) for i in range(30) for f in rng.sample(range(6), 3)]
    postings = spark.createDataFrame(rows, "id long, feature int, weight double")
    parts = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "id long, layer int, tied int")
    files.write_index(index.index_chunks(postings, parts, 4), str(tmp_path / "inv"))
    got = files.read_index(spark, str(tmp_path / "inv"), 1, 0).collect()
    assert {(r["chunk"], r["feature"], p["id"]) for r in got for p in r["postings"]} == {(i // 2 // 4, f, i) for i, f, _ in rows if i % 2}
    files.write_partitions(postings, parts, str(tmp_path / "vec"))
    assert {(r["id"], r["feature"], r["weight"]) for r in files.read_partition(spark, str(tmp_path / "vec"), 0, 0).collect()} == {r for r in rows if r[0] % 2 == 0}
    halves = [index.inverted_index(postings.where(F.col("id") % 2 == k)) for k in (0, 1)]
    assert sorted(index.merge_indexes(*halves).collect()) == sorted(index.inverted_index(postings).collect())
    blocks = index.blocked_index(postings, 5).collect()
    assert sorted((p["id"], r["feature"]) for r in blocks for p in r["postings"]) == sorted((i, f) for i, f, _ in rows) and len(blocks) > 6


def test_matrices_as_text(spark, tmp_path):
    rows = spark.createDataFrame([(k, [k, 2 * k, 3 * k]) for k in range(20)], "row long, values array<int>")
    files.write_matrix(matrix.transpose(rows), str(tmp_path / "m"))
    back = {r["row"]: r["values"] for r in files.read_matrix(spark, str(tmp_path / "m")).collect()}
    assert back == {k: [(k + 1) * n for n in range(20)] for k in range(3)}
    files.write_cells(spark.createDataFrame([(0, 1, 0.5)], "i long, j long, value double"), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).collect()[0][0] == "0,1,0.5"


def test_sampled_columns_are_exact_where_all_is_drawn(spark):
    rng = random.Random(3)
    cells = spark.createDataFrame([(i, f, rng.random()) for i in range(20) for f in range(5)], "id long, feature int, weight double")
    sampled = {(r["i"], r["j"]): r["value"] for r in matrix.sampled_column_similarities(cells, 5, 1e-6).collect()}
    exact = {(r["i"], r["j"]): r["value"] for r in matrix.column_similarities(cells).collect()}
    assert sampled.keys() == exact.keys() and all(abs(sampled[k] - v) < 1e-9 for k, v in exact.items())


def test_ml_vectors(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(0, Vectors.dense([1.0, 0.0])), (1, Vectors.sparse(2, {0: 2.0})), (2, Vectors.dense([0.0, 1.0]))], ["id", "vector"])
    got = join.cosine_pairs(rows, 3, 0.5).collect()
    assert [tuple(r["similarity"]) for r in got] == [(1, 0, 1.0)]


def test_layers_add_up_and_reports(spark):
    vectors = spark.createDataFrame([(i, f, float(1 + (i * f) % 5)) for i in range(40) for f in range(1 + i % 6)], "id long, feature int, weight double")
    unit = V.l2_normalize(vectors)
    tied = layers.static_tie(layers.layered(unit, 5), 0.9)
    assert stats.layer_sums(layers.partition_sizes(tied), tied).count() == 0
    returned = join.similar_pairs(unit, 0.9, "plain", assume_normalized=True).count()
    row = stats.sweep(vectors, (0.9,), 5).collect()[0]
    assert row["returned"] == returned and row["d_par"] == row["scored"] == row["returned"] + row["d_par_reduction"]
    assert row["actual_reduction"] == 40 * 40 // 2 - row["scored"] and row["static_reduction"] == 780 - row["scored"]
    pairs_, seen = stats.observed(join.similar_pairs(unit, 0.9, assume_normalized=True))
    assert pairs_.count() == seen.get["returned"] == returned and seen.get["least"] > 0.9


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("a a a a\na a b b\na b f g \nb b b b\n   \n")
    cli.main(["-i", str(tmp_path / "in.txt"), "-t", "0.4,0.6", "-n", "3", "-s", "2", "-u", "-d", "-h", "Letters", "-o", str(tmp_path / "out")])
    said = capsys.readouterr().out
    assert "Letters" in said and "unbalanced" in said and "threshold 0.6: 3 pairs" in said
    assert files.read_pairs(spark, str(tmp_path / "out" / "pairs-0.4")).count() == 5


def test_best_of_attempts_query_tries_all_seeds(spark, tmp_path, monkeypatch):
    from pairloom import queries

    spark.createDataFrame([(k, [float(k), 1.0, 2.0]) for k in range(8)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    seeds, choose = [], lsh.choose_anchors
    monkeypatch.setattr(lsh, "choose_anchors", lambda postings, k, seed=0: seeds.append(seed) or choose(postings, k, seed))
    queries.QUERIES["lsh_best_of_attempts"](spark, str(tmp_path))
    assert seeds == list(range(21))
