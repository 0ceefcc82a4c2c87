"""Queries over the test tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text as X
from pairloom.functions import vector as V
from pairloom.operators import assign, index, join, layers, lsh, matrix, stats

LAYERS = 7
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf: str, table: str = "documents", ident: str = "doc_id") -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(ident).alias("id"), "text")


def _counts(spark: SparkSession, sf: str, stop_words: bool = False) -> DataFrame:
    return X.token_counts(X.tokenize(_docs(spark, sf), stop_words=stop_words))


def _dealt(spark: SparkSession, sf: str, ranges: bool = True) -> DataFrame:
    """Counts of documents that are dealt out by id as texts, so that their postings need not be; by ranges of ids, half of all blocks need not meet."""
    docs = _docs(spark, sf)
    return X.token_counts(X.tokenize(docs.repartitionByRange("id") if ranges else docs.repartition("id")))


def _unit(spark: SparkSession, sf: str) -> DataFrame:
    return V.l2_normalize(_counts(spark, sf))


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    return V.dense_postings(spark.read.parquet(f"{sf}/embeddings.parquet").repartition("vec_id"), "vec_id", "embedding")


def _supplied(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """dealt: the items are dealt out by supplier, so that their sums need not be."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    items = items.select("l_suppkey", "l_partkey", "l_quantity").repartition("l_suppkey") if dealt else items
    return items.groupBy(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("weight"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


TF = """tok AS (SELECT doc_id AS id, unnest(CASE WHEN text <> '' AND rtrim(text, ' ') = '' THEN [] ELSE string_split(rtrim(text, ' '), ' ') END) AS token FROM documents WHERE text IS NOT NULL),
tf AS (SELECT id, token AS feature, count(*)::DOUBLE AS weight FROM tok GROUP BY ALL)"""
UNIT = TF + """,
unit AS (SELECT id, feature, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS weight FROM tf)"""
UNITS = "flatten(list_transform(string_split(token, ''), lambda x: CASE WHEN ord(x) >= 65536 THEN [55296 + ((ord(x) - 65536) >> 10), 56320 + ((ord(x) - 65536) & 1023)] ELSE [ord(x)] END))"
SLOT = f"(list_reduce(list_prepend(0::BIGINT, list_transform({UNITS}, lambda x: x::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296))"
HASHED = f"""{TF},
h AS (SELECT feature, {SLOT.replace('token', 'feature')} AS h FROM (SELECT DISTINCT feature FROM tf)),
hs AS (SELECT feature, (((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 10000 + 10000) % 10000)::INTEGER AS slot FROM h),
htf AS (SELECT id, slot AS feature, sum(weight) AS weight FROM tf JOIN hs USING (feature) GROUP BY ALL)"""
EMBED = """unit AS (SELECT vec_id AS id, i - 1 AS feature, embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS weight
  FROM embeddings, unnest(range(1, 65)) AS u(i) WHERE embedding[i] <> 0)"""
NORMS = "norms AS (SELECT id, sum(abs(weight)) AS l1, max(abs(weight)) AS linf, sqrt(sum(weight * weight)) AS l2 FROM unit GROUP BY id)"
LAYERED = f"""{NORMS},
rk AS (SELECT *, row_number() OVER (ORDER BY round(l1, 9), id) - 1 AS rk, count(*) OVER () AS n FROM norms),
layered AS (SELECT id, l1, linf, l2, (SELECT count(*) FROM range(1, {LAYERS}) AS c(k) WHERE rk > n / ({LAYERS} * ({LAYERS} + 1) / 2) * (k * {LAYERS} - k * (k - 1) / 2))::INTEGER AS layer FROM rk)"""
TIED = LAYERED + """,
leaders AS (SELECT layer AS r, max(l1) AS max_l1, max(linf) AS max_linf FROM layered GROUP BY layer),
need AS (SELECT id, min(r) AS r FROM layered JOIN leaders ON r < layer WHERE NOT (linf * max_l1 < {t} * (1 - 1e-12) OR l1 * max_linf < {t} * (1 - 1e-12)) GROUP BY id),
tied AS (SELECT layered.*, coalesce(r, layer)::INTEGER AS first_needed, (CASE WHEN coalesce(r, layer) = 0 THEN layer ELSE coalesce(r, layer) - 1 END)::INTEGER AS tied FROM layered LEFT JOIN need USING (id)),
parts AS (SELECT layer, tied, count(*) AS size FROM tied GROUP BY ALL)"""
ASSIGNED = f"""pairs AS (
  SELECT p.layer, p.tied, p.size, o.layer AS o_layer, o.tied AS o_tied, o.size AS o_size FROM parts p, parts o
  WHERE ((o.layer - p.layer) % {LAYERS} + {LAYERS}) % {LAYERS} <= {(LAYERS - 1) // 2}
    AND CASE WHEN p.layer = o.layer THEN p.tied >= o.tied WHEN p.layer > o.layer THEN p.tied = p.layer OR p.tied < o.layer ELSE o.tied = o.layer OR o.tied < p.layer END)"""
APSS = "SELECT a.id AS i, b.id AS j, round(sum(a.weight * b.weight), 6) AS sim FROM unit a JOIN unit b ON a.feature = b.feature AND a.id > b.id GROUP BY ALL HAVING sum(a.weight * b.weight) > {t}"


@query(f"WITH {TF} SELECT * FROM tf")
def tokenize_tf(spark, sf):
    return _counts(spark, sf)


@query(f"WITH {HASHED} SELECT * FROM htf")
def hashing_tf(spark, sf):
    return X.hashing_tf(X.tokenize(_docs(spark, sf)))


@query(f"WITH {TF} SELECT * FROM tf WHERE feature NOT IN ({', '.join(repr(w) if chr(39) not in w else chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in X.STOP_WORDS)})")
def stopword_tf(spark, sf):
    return _counts(spark, sf, stop_words=True)


@query(f"WITH {TF} SELECT * FROM tf WHERE weight <= 5")
def max_weight_tf(spark, sf):
    return X.max_weight(_counts(spark, sf), 5)


@query(f"WITH {TF} SELECT feature, count(*) AS df FROM tf GROUP BY feature ORDER BY df DESC, feature LIMIT 500")
def top_df_features(spark, sf):
    return X.top_features(_counts(spark, sf))


FILTERED = """top AS (SELECT feature FROM tf GROUP BY feature ORDER BY count(*) DESC, feature LIMIT 500),
dropped AS (SELECT feature FROM tf GROUP BY feature HAVING sum(weight) > 100 UNION SELECT feature FROM top)"""


@query(f"WITH {TF}, {FILTERED} SELECT feature FROM dropped")
def corpus_filter(spark, sf):
    return X.corpus_filter(_counts(spark, sf), 100)


@query(f"WITH {TF}, {FILTERED} SELECT id, feature, weight FROM tf WHERE feature NOT IN (FROM dropped)")
def filtered_tf(spark, sf):
    tf = _counts(spark, sf)
    return X.without_features(tf, X.corpus_filter(tf, 100))


BASKETS = "b AS (SELECT l_orderkey AS id, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_partkey) AS text FROM lineitem GROUP BY l_orderkey)"


def _baskets(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    return items.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_partkey")), lambda x: x.cast("string")), " ").alias("text"))


@query("SELECT l_orderkey AS id, l_partkey::INTEGER AS feature, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL")
def bow_counts(spark, sf):
    return X.bow_counts(_baskets(spark, sf))


@query(f"WITH {BASKETS} SELECT id, text FROM b")
def bow_revert(spark, sf):
    return X.bow_revert(X.bow_counts(_baskets(spark, sf)))


@query(f"WITH {UNIT} SELECT id, feature, round(weight, 6) AS weight FROM unit")
def l2_normalize(spark, sf):
    return _rounded(_unit(spark, sf), "weight")


@query(f"WITH {TF}, unit AS (FROM tf), {NORMS} SELECT id, round(l1, 6) AS l1, round(linf, 6) AS linf, round(l2, 6) AS l2 FROM norms")
def vector_norms(spark, sf):
    return _rounded(V.norms(_counts(spark, sf)), "l1", "linf", "l2")


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 7 * 100) / 100 AS cut FROM lineitem")
def truncate_at(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", V.truncate_at(F.col("l_extendedprice") / 7, 2).alias("cut"))


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1")
def cosine_of_neighbours(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    a, b = e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("j"), F.col("embedding").alias("y"))
    return a.join(b, F.col("i") == F.col("j") + 1).select("i", "j", F.round(V.cosine_similarity(F.col("x"), F.col("y")), 6).alias("sim"))


@query(f"WITH {UNIT}, {LAYERED} SELECT id, layer FROM layered")
def layers_geometric(spark, sf):
    return layers.layered(_unit(spark, sf), LAYERS).select("id", "layer")


@query(f"WITH {UNIT}, {LAYERED} SELECT id, least(floor(rk * {LAYERS} / n), {LAYERS - 1})::INTEGER AS layer FROM rk")
def layers_uniform(spark, sf):
    return layers.layered(_unit(spark, sf), LAYERS, uniform=True).select("id", "layer")


@query(f"WITH {UNIT}, {LAYERED} SELECT layer, count(*) AS size FROM layered GROUP BY layer")
def layer_sizes(spark, sf):
    return layers.layer_sizes(layers.layered(_unit(spark, sf), LAYERS))


@query(f"WITH {UNIT}, {LAYERED} SELECT layer, round(max(l1), 6) AS max_l1, round(max(linf), 6) AS max_linf FROM layered GROUP BY layer")
def layer_leaders(spark, sf):
    return _rounded(layers.layer_leaders(layers.layered(_unit(spark, sf), LAYERS)), "max_l1", "max_linf")


@query(f"WITH {UNIT}, {LAYERED} SELECT layer, feature, round(max(weight), 6) AS weight FROM unit JOIN layered USING (id) GROUP BY ALL")
def ideal_vectors(spark, sf):
    unit = _unit(spark, sf)
    return _rounded(layers.ideal_vectors(layers.layered(unit, LAYERS), unit), "weight")


@query(
    f"""WITH {UNIT}, {LAYERED}, ideal AS (SELECT layer, feature, max(weight) AS top FROM unit JOIN layered USING (id) GROUP BY ALL),
len AS (SELECT layer, sqrt(sum(top * top)) AS len FROM ideal GROUP BY layer)
SELECT id, round(sum(weight * top) / (any_value(l2) * any_value(len)), 6) AS sim FROM unit JOIN layered USING (id) JOIN ideal USING (layer, feature) JOIN len USING (layer) GROUP BY id"""
)
def ideal_similarity(spark, sf):
    unit = _unit(spark, sf)
    return _rounded(layers.ideal_similarity(layers.layered(unit, LAYERS), unit), "sim")


def _tied(spark: SparkSession, sf: str, t: float = 0.9) -> DataFrame:
    return layers.static_tie(layers.layered(V.l2_normalize(_embedded(spark, sf)), LAYERS), t)


@query(f"WITH {EMBED}, {TIED.format(t=0.9)} SELECT id, layer, first_needed, tied FROM tied")
def static_tie(spark, sf):
    return _tied(spark, sf).select("id", "layer", "first_needed", "tied")


@query(f"WITH {EMBED}, {TIED.format(t=0.9)} SELECT * FROM parts")
def partition_sizes(spark, sf):
    return layers.partition_sizes(_tied(spark, sf))


@query(f"WITH {EMBED}, {TIED.format(t=0.9)}, {ASSIGNED} SELECT layer, tied, o_layer, o_tied FROM pairs")
def candidate_partition_pairs(spark, sf):
    return assign.assignment(layers.partition_sizes(_tied(spark, sf)), LAYERS)


EVEN = 8
_EVEN_AHEAD = f"((o.layer - p.layer) % {EVEN} + {EVEN}) % {EVEN}"


def _tied_even(spark: SparkSession, sf: str) -> DataFrame:
    return layers.static_tie(layers.layered(V.l2_normalize(_embedded(spark, sf)), EVEN), 0.9)


@query(
    f"""WITH {EMBED}, {TIED.format(t=0.9).replace(f"range(1, {LAYERS})", f"range(1, {EVEN})").replace(f"({LAYERS} * ({LAYERS} + 1) / 2)", f"({EVEN} * ({EVEN} + 1) / 2)").replace(f"k * {LAYERS} ", f"k * {EVEN} ")}
SELECT p.layer, p.tied, o.layer AS o_layer, o.tied AS o_tied FROM parts p, parts o
WHERE ({_EVEN_AHEAD} < {EVEN // 2} OR ({_EVEN_AHEAD} = {EVEN // 2} AND p.layer < {EVEN // 2}))
  AND CASE WHEN p.layer = o.layer THEN p.tied >= o.tied WHEN p.layer > o.layer THEN p.tied = p.layer OR p.tied < o.layer ELSE o.tied = o.layer OR o.tied < p.layer END"""
)
def candidate_partition_pairs_even(spark, sf):
    return assign.assignment(layers.partition_sizes(_tied_even(spark, sf)), EVEN)


@query(f"WITH {EMBED}, {TIED.format(t=0.9)} SELECT layer, sum(size)::BIGINT AS parts, (SELECT count(*) FROM layered l WHERE l.layer = p.layer) AS size FROM parts p GROUP BY layer")
def layer_sums(spark, sf):
    tied = _tied(spark, sf)
    return layers.partition_sizes(tied).groupBy("layer").agg(F.sum("size").alias("parts")).join(layers.layer_sizes(tied), "layer")


@query(f"WITH {EMBED}, {TIED.format(t=0.9)}, {ASSIGNED} SELECT layer, tied, ceil(any_value(size) / 20)::BIGINT AS chunks, (ceil(any_value(size) / 20) * sum(size * o_size))::BIGINT AS weight FROM pairs GROUP BY layer, tied")
def pair_weights(spark, sf):
    sizes = layers.partition_sizes(_tied(spark, sf))
    return assign.pair_weights(assign.assignment(sizes, LAYERS), sizes, 20)


COSTS = "costs AS (SELECT layer, tied, (any_value(size) * any_value(size) + sum(size * o_size))::BIGINT AS cost FROM pairs GROUP BY layer, tied)"


@query(f"WITH {EMBED}, {TIED.format(t=0.9)}, {ASSIGNED}, {COSTS} SELECT * FROM costs")
def partition_cost(spark, sf):
    sizes = layers.partition_sizes(_tied(spark, sf))
    return assign.partition_costs(assign.assignment(sizes, LAYERS), sizes)


@query(f"WITH {EMBED}, {TIED.format(t=0.9)}, {ASSIGNED}, {COSTS} SELECT round(stddev_pop(cost), 6) AS deviation FROM costs")
def cost_stddev(spark, sf):
    return partition_cost(spark, sf).agg(F.round(F.stddev_pop("cost"), 6).alias("deviation"))


@query(None)
def balanced_assignment(spark, sf):
    sizes = layers.partition_sizes(_tied(spark, sf))
    return assign.balanced_assignment(assign.assignment(sizes, LAYERS), sizes)


@query(None)
def balance_report(spark, sf):
    sizes = layers.partition_sizes(_tied(spark, sf))
    return _rounded(assign.balance_report(assign.assignment(sizes, LAYERS), sizes, 4, 20), "before", "stage1", "stage2", "unbalanced", "balanced")


@query(
    f"""WITH RECURSIVE {EMBED}, {TIED.format(t=0.9)}, {ASSIGNED}, {COSTS},
ordered AS (SELECT *, row_number() OVER (ORDER BY cost DESC, layer, tied) AS step FROM costs),
placed AS (
  SELECT 0::BIGINT AS step, -1 AS layer, -1 AS tied, 0 AS slot, [0::BIGINT, 0, 0, 0] AS loads
  UNION ALL
  SELECT o.step, o.layer, o.tied, (list_position(p.loads, list_min(p.loads)) - 1)::INTEGER,
    list_transform(p.loads, lambda x, i: CASE WHEN i = list_position(p.loads, list_min(p.loads)) THEN x + o.cost ELSE x END)
  FROM placed p JOIN ordered o ON o.step = p.step + 1)
SELECT layer, tied, slot FROM placed WHERE step > 0"""
)
def lpt_slots(spark, sf):
    costs = {(r["layer"], r["tied"]): r["cost"] for r in partition_cost(spark, sf).collect()}
    return spark.createDataFrame([(*k, s) for k, s in assign.longest_first(costs, 4).items()], "layer int, tied int, slot int")


@query("SELECT b AS layer, t AS tied, (b * (b + 1)) // 2 + t AS hash, b AS layer_back, t AS tied_back FROM range(0, 60) AS x(b), range(0, 60) AS y(t) WHERE t <= b")
def partition_hash_roundtrip(spark, sf):
    keys = spark.range(60).toDF("layer").join(spark.range(60).toDF("tied"), F.col("tied") <= F.col("layer"))
    hashed = keys.withColumn("hash", layers.triangular_hash(F.col("layer"), F.col("tied")))
    layer, tied = layers.triangular_unhash(F.col("hash"))
    return hashed.withColumn("layer_back", layer).withColumn("tied_back", tied)


@query(f"WITH {UNIT} {APSS.format(t=0.9)}")
def apss_documents(spark, sf):
    return _rounded(join.similar_pairs(_dealt(spark, sf), 0.9), "sim")


@query(f"WITH {UNIT} {APSS.format(t=0.7)}")
def apss_prefix(spark, sf):
    return _rounded(join.similar_pairs(_dealt(spark, sf), 0.7, "prefix"), "sim")


@query(f"WITH {UNIT} {APSS.format(t=0.9)}")
def apss_plain(spark, sf):
    return _rounded(join.similar_pairs(_dealt(spark, sf), 0.9, "plain"), "sim")


@query(f"WITH {EMBED} {APSS.format(t=0.3)}")
def apss_ml_vectors(spark, sf):
    """Pairs of a DataFrame with a column of ML vectors."""
    from pyspark.ml.functions import array_to_vector

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").repartition("vec_id").select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))
    found = join.cosine_pairs(rows, LAYERS, 0.3).select("similarity.*").toDF("i", "j", "sim")
    return _rounded(found, "sim")


@query(f"WITH {HASHED}, unit AS (SELECT id, feature, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS weight FROM htf) {APSS.format(t=0.9)}")
def apss_hashed(spark, sf):
    return _rounded(join.similar_pairs(X.text_vectors(_docs(spark, sf).repartitionByRange("id")), 0.9, assume_normalized=True), "sim")


@query(f"WITH {UNIT} {APSS.format(t=0.9)}")
def apss_layered(spark, sf):
    return _rounded(join.similar_pairs(_dealt(spark, sf, ranges=False), 0.9, "layered", LAYERS), "sim")


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id > b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3")
def apss_embeddings(spark, sf):
    return _rounded(join.dense_pairs(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 0.3), "sim")


SUPPLIED = """m AS (SELECT l_suppkey AS id, l_partkey AS feature, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL),
unit AS (SELECT id, feature, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS weight FROM m)"""


@query(f"WITH {SUPPLIED} {APSS.format(t=0.2)}")
def apss_supplier_parts(spark, sf):
    return _rounded(join.similar_pairs(_supplied(spark, sf), 0.2), "sim")


@query(f"WITH {SUPPLIED} SELECT a.id AS i, b.id AS j, round(coalesce(s, 0), 6) AS value FROM (SELECT DISTINCT id FROM unit) a, (SELECT DISTINCT id FROM unit) b LEFT JOIN (SELECT x.id AS p, y.id AS q, sum(x.weight * y.weight) AS s FROM unit x JOIN unit y USING (feature) GROUP BY ALL) ON p = a.id AND q = b.id")
def brute_force_matrix(spark, sf):
    # Sums are cheaper to keep than weights of unit vectors; most cosines are 0, which need no rounding.
    found = join.brute_force(_supplied(spark, sf, dealt=True).where("weight is not null"), assume_normalized=False)
    return found.withColumn("value", F.when(F.col("value") != 0, F.round("value", 6)).otherwise(F.col("value")))


@query(f"WITH {SUPPLIED}, p AS ({APSS.format(t=0.1)}) SELECT * FROM p ORDER BY sim DESC, i, j LIMIT 50")
def topk_pairs(spark, sf):
    return join.top_pairs(_rounded(join.similar_pairs(_supplied(spark, sf), 0.1), "sim"), 50)


@query(
    f"""WITH {SUPPLIED}, p AS ({APSS.format(t=0.1)}), b AS (SELECT i AS id, j AS other, sim FROM p UNION ALL SELECT j, i, sim FROM p)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other)::INTEGER AS rank FROM b) WHERE rank <= 3"""
)
def topk_per_row(spark, sf):
    return join.top_per_row(_rounded(join.similar_pairs(_supplied(spark, sf), 0.1), "sim"), 3)


@query(f"WITH {UNIT} SELECT feature, count(*) AS n, min(id) AS first_id, round(sum(weight), 6) AS total FROM unit GROUP BY feature")
def inverted_index(spark, sf):
    lists = index.inverted_index(_unit(spark, sf))
    total = F.aggregate("postings", F.lit(0.0), lambda s, x: s + x["weight"])
    return lists.select("feature", F.size("postings").cast("long").alias("n"), F.element_at("postings", 1)["id"].alias("first_id"), F.round(total, 6).alias("total"))


@query(f"WITH {UNIT} SELECT feature, count(*) AS n, min(id) AS first_id, round(sum(weight), 6) AS total FROM unit GROUP BY feature")
def blocked_index(spark, sf):
    """Lists of very frequent features in blocks; what they add up to."""
    blocks = index.blocked_index(_unit(spark, sf), 200)
    total = F.aggregate("postings", F.lit(0.0), lambda s, x: s + x["weight"])
    sums = blocks.select("feature", F.size("postings").alias("n"), F.element_at("postings", 1)["id"].alias("first_id"), total.alias("total"))
    return _rounded(sums.groupBy("feature").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.sum("total").alias("total")), "total")


@query(f"WITH {UNIT} SELECT feature, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM unit GROUP BY feature")
def merged_index(spark, sf):
    """The index of two halves of the documents, merged."""
    unit = _unit(spark, sf)
    merged = index.merge_indexes(*(index.inverted_index(unit.where(F.col("id") % 2 == k)) for k in (0, 1)))
    return merged.select("feature", F.array_join(F.transform("postings", lambda p: p["id"].cast("string")), " ").alias("ids"))


@query(
    f"""WITH {EMBED}, {TIED.format(t=0.9)}, c AS (SELECT id, layer, tied, ((row_number() OVER (PARTITION BY layer, tied ORDER BY id) - 1) // 20)::INTEGER AS chunk FROM tied)
SELECT layer, tied, chunk, feature::INTEGER AS feature, count(*) AS n FROM unit JOIN c USING (id) GROUP BY ALL"""
)
def index_chunks(spark, sf):
    got = index.index_chunks(V.l2_normalize(_embedded(spark, sf)), _tied(spark, sf), 20)
    return got.select("layer", "tied", "chunk", "feature", F.size("postings").cast("long").alias("n"))


@query(f"WITH {EMBED}, {TIED.format(t=0.9)} SELECT layer, tied, id, (row_number() OVER (PARTITION BY layer, tied ORDER BY id) - 1)::INTEGER AS slot FROM tied")
def slot_map(spark, sf):
    return index.slot_map(_tied(spark, sf))


@query(
    f"""WITH {EMBED}, {TIED.format(t=0.9)}, c AS (SELECT id, layer, tied, ((row_number() OVER (PARTITION BY layer, tied ORDER BY id) - 1) // 16)::INTEGER AS chunk FROM tied)
SELECT layer, tied, chunk, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM c GROUP BY ALL"""
)
def compartments(spark, sf):
    return layers.compartments(_tied(spark, sf), 16).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), " "))


ANCHORED = f"""{EMBED}, anchors AS (SELECT id AS pos, feature, weight FROM unit WHERE id < 4),
near AS (SELECT u.id, pos, sum(u.weight * a.weight) AS sim FROM unit u JOIN anchors a USING (feature) GROUP BY ALL),
keys AS (SELECT id, string_agg(CASE WHEN round(sim, 12) >= 0.1 THEN '1' ELSE '0' END, '' ORDER BY pos) AS key FROM near GROUP BY id),
pairs AS (SELECT k.key, a.id AS i, b.id AS j, sum(a.weight * b.weight) AS sim FROM unit a JOIN keys k ON k.id = a.id JOIN keys l ON l.key = k.key AND l.id < k.id JOIN unit b ON b.id = l.id AND b.feature = a.feature GROUP BY ALL)"""


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    v = V.l2_normalize(_embedded(spark, sf))
    return lsh.signatures(v, v.where("id < 4").select(F.col("id").cast("int").alias("pos"), "feature", "weight"), 0.1)


@query(f"WITH {ANCHORED} SELECT id, key FROM keys")
def lsh_signature(spark, sf):
    return _keys(spark, sf)


@query(f"WITH {ANCHORED} SELECT key, i, j, round(sim, 6) AS sim FROM pairs QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(sim, 9) DESC, i, j) = 1")
def lsh_bucket_best(spark, sf):
    return _rounded(lsh.bucket_best(_embedded(spark, sf), _keys(spark, sf)), "sim")


@query(f"WITH {ANCHORED} SELECT key, i, j, round(sim, 6) AS sim FROM pairs ORDER BY round(pairs.sim, 9) DESC, i, j LIMIT 1")
def lsh_best_pair(spark, sf):
    return _rounded(lsh.closest_pair(_embedded(spark, sf), _keys(spark, sf)), "sim")


@query(
    f"""WITH {EMBED}, seeds AS (SELECT s::INTEGER AS seed FROM range(21) AS r(s)),
anchors AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed::VARCHAR || ':' || id::VARCHAR), id) AS pos FROM seeds, (SELECT DISTINCT id FROM unit) QUALIFY pos <= 4),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
keys AS (
  SELECT seed, v.id, string_agg(CASE WHEN round(list_cosine_similarity(v.e, a.e), 12) >= 0.5 THEN '1' ELSE '0' END, '' ORDER BY pos) AS key
  FROM anchors JOIN v a ON a.id = anchors.id, v GROUP BY seed, v.id),
scored AS (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.id > b.id)
SELECT k.key, i, j, round(sim, 6) AS sim, k.seed FROM scored JOIN keys k ON k.id = i JOIN keys l ON l.id = j AND l.seed = k.seed AND l.key = k.key
ORDER BY round(scored.sim, 9) DESC, i, j, k.seed LIMIT 1"""
)
def lsh_best_of_attempts(spark, sf):
    return _rounded(lsh.best_of_attempts(_embedded(spark, sf), 4), "sim")


@query(
    f"""WITH {ANCHORED}, r AS (SELECT id, 0.6 / max(abs(weight)) AS tmax, sum(abs(weight)) AS colsum FROM unit GROUP BY id)
SELECT i, j, round(sim, 6) AS value FROM pairs JOIN r a ON a.id = i JOIN r b ON b.id = j WHERE b.tmax < a.colsum AND a.tmax < b.colsum"""
)
def row_pruned_pairs(spark, sf):
    return _rounded(lsh.row_pruned_pairs(_embedded(spark, sf), _keys(spark, sf), 0.6), "value")


@query(
    """WITH m AS (SELECT l_orderkey AS id, l_suppkey AS feature, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL),
s AS (SELECT id, feature, weight / sqrt(sum(weight * weight) OVER (PARTITION BY feature)) AS w FROM m)
SELECT a.feature AS i, b.feature AS j, round(sum(a.w * b.w), 6) AS value FROM s a JOIN s b ON a.id = b.id AND a.feature < b.feature GROUP BY ALL HAVING sum(a.w * b.w) > 0.01"""
)
def column_similarities(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    cells = items.groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("feature")).agg(F.sum("l_quantity").alias("weight"))
    return _rounded(matrix.column_similarities(cells, 0.01), "value")


@query(
    """WITH c AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS row FROM lineitem)
SELECT row, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_orderkey) AS values FROM c GROUP BY row"""
)
def transpose(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = items.groupBy(F.col("l_orderkey").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("values"))
    return matrix.transpose(rows).withColumn("values", F.array_join(F.transform("values", lambda x: x.cast("string")), " "))


BUDGET = """SELECT sum(size)::BIGINT AS num_vectors, (sum(size) * (sum(size) - 1) // 2)::BIGINT AS num_comparisons, any_value(u)::BIGINT AS unbalanced,
  (sum(size) * (sum(size) - 1) // 2 - any_value(u))::BIGINT AS static_reduction, (sum(size) * sum(size) // 2)::BIGINT AS legacy_total
FROM parts, (SELECT sum(CASE WHEN layer = o_layer AND tied = o_tied THEN size * (size - 1) // 2 ELSE size * o_size END) AS u FROM pairs)"""


@query(f"WITH {EMBED}, {TIED.format(t=0.9)}, {ASSIGNED} {BUDGET}")
def pair_budget(spark, sf):
    return stats.pair_budget(layers.partition_sizes(_tied(spark, sf)), LAYERS)


@query(
    f"""WITH {EMBED}, {TIED.format(t=0.9)}, l AS (SELECT layer AS i, sum(size) AS s FROM parts GROUP BY layer)
SELECT coalesce(sum(CASE WHEN i <= tied AND layer <> tied THEN size * s END), 0)::BIGINT AS skipped, coalesce(sum(CASE WHEN i > tied OR layer = tied THEN size * s END), 0)::BIGINT AS calculated FROM parts JOIN l ON i <= layer"""
)
def skipped_and_calculated(spark, sf):
    return stats.skipped_and_calculated(layers.partition_sizes(_tied(spark, sf)))


def _sweep_sql(t: float) -> str:
    return f"""SELECT {t}::DOUBLE AS threshold, num_vectors, num_comparisons, unbalanced AS scored, returned, unbalanced - returned AS below, static_reduction,
  legacy_total - unbalanced AS actual_reduction, unbalanced - returned AS d_par_reduction, unbalanced AS d_par
FROM (WITH {EMBED}, {TIED.format(t=t)}, {ASSIGNED} {BUDGET}), (WITH {EMBED} SELECT count(*) AS returned FROM ({APSS.format(t=t)}))"""


@query(" UNION ALL ".join(_sweep_sql(t) for t in (0.2, 0.3)))
def sweep_report(spark, sf):
    # Every vector has every feature here, so pairs are scored as arrays, not by postings.
    scored = join.dense_pairs(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 0.2)
    return stats.sweep(_embedded(spark, sf), (0.2, 0.3), LAYERS, scored=scored)


@query(
    f"""WITH {UNIT}, bt AS (SELECT item_id AS id, unnest(CASE WHEN text <> '' AND rtrim(text, ' ') = '' THEN [] ELSE string_split(rtrim(text, ' '), ' ') END) AS feature FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT id, feature, count(*) AS weight FROM bt GROUP BY ALL), b AS (SELECT id, feature, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS weight FROM bw)
SELECT unit.id AS i, b.id AS j, round(sum(unit.weight * b.weight), 6) AS sim FROM unit JOIN b USING (feature) GROUP BY ALL HAVING sum(unit.weight * b.weight) > 0.5"""
)
def benchmark_similarity(spark, sf):
    items = X.token_counts(X.tokenize(_docs(spark, sf, "benchmark", "item_id")))
    return _rounded(join.similar_across(_counts(spark, sf), items, 0.5), "sim")
