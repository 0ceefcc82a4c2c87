"""Texts to sparse vectors: tokens, hashing, bags of words, stop words and corpus filters.

Vectors are postings, rows of (id, feature, weight); vectors without features have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_FEATURES = 10_000
#: Slots that the corpus filter removes for being in the most documents.
TOP_FEATURES = 500

# The English stop words, matched with their case.
STOP_WORDS = tuple(
    """a about above after again against all am an and any are aren't as at be because been before being below between
    both but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further
    had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i
    i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once
    only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such
    than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this
    those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's
    where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours
    yourself yourselves""".split()
)


def tokens(text: Column) -> Column:
    """Split at each single space; empty tokens stay but at the end. An empty text is one empty token, one of spaces alone none."""
    bare = F.rtrim(text)
    return F.when((bare == "") & (text != ""), F.array().cast("array<string>")).otherwise(F.split(bare, " ", -1))


def java_hash(token: Column) -> Column:
    """String.hashCode of a token, as a signed 32-bit number; it counts UTF-16 units, of which code points from 0x10000 on have two."""

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c)
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
        return F.when(code < 0x10000, h * 31 + code).otherwise((h * 31 + high) * 31 + low) % F.lit(1 << 32)

    unsigned = F.aggregate(F.split(token, ""), F.lit(0).cast("long"), step)
    return F.when(unsigned >= 1 << 31, unsigned - F.lit(1 << 32)).otherwise(unsigned)


def slot(token: Column, n: int = N_FEATURES) -> Column:
    return F.pmod(java_hash(token), F.lit(n)).cast("int")


def tokenize(docs: DataFrame, ident: str = "id", text: str = "text", stop_words: bool = False) -> DataFrame:
    """(id, token) with a row for each token; null texts have none."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.explode(tokens(F.col(text))).alias("token"))
    return rows.where(~F.col("token").isin(*STOP_WORDS)) if stop_words else rows


def token_counts(rows: DataFrame) -> DataFrame:
    """(id, feature, weight): how often each token occurs."""
    return rows.groupBy("id", F.col("token").alias("feature")).agg(F.count("*").cast("double").alias("weight"))


def hashing_tf(rows: DataFrame, n: int = N_FEATURES) -> DataFrame:
    """Counts by hashed slot. Tokens are counted before they are hashed, so each is hashed once a document."""
    return token_counts(rows).groupBy("id", slot(F.col("feature"), n).alias("feature")).agg(F.sum("weight").alias("weight"))


def max_weight(postings: DataFrame, limit: float) -> DataFrame:
    return postings.where(F.col("weight") <= limit)


def without_features(postings: DataFrame, features: DataFrame) -> DataFrame:
    return postings.join(features.select("feature"), "feature", "left_anti").select("id", "feature", "weight")


def top_features(postings: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """(feature, df) of the k features in the most vectors; ties go to the smaller feature."""
    return postings.groupBy("feature").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "feature").limit(k)


def corpus_filter(postings: DataFrame, max_total: float | None = None, k: int = TOP_FEATURES) -> DataFrame:
    """(feature) to leave out: summed weight above max_total, or among the k in the most vectors."""
    top = top_features(postings, k).select("feature")
    if max_total is None:
        return top
    heavy = postings.groupBy("feature").agg(F.sum("weight").alias("total")).where(F.col("total") > max_total).select("feature")
    return heavy.union(top).distinct()


def bow_counts(docs: DataFrame, ident: str = "id", text: str = "text") -> DataFrame:
    """Bags of integers, separated by spaces, to postings; an empty text has none."""
    rows = docs.where(F.col(text) != "").select(F.col(ident).alias("id"), F.explode(tokens(F.col(text))).alias("token"))
    return rows.groupBy("id", F.col("token").cast("int").alias("feature")).agg(F.count("*").cast("double").alias("weight"))


def bow_revert(postings: DataFrame) -> DataFrame:
    """(id, text): the bag again, features in order, each as often as its weight says."""
    packed = postings.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("feature", "weight"))).alias("v"))
    return packed.select("id", F.array_join(F.flatten(F.transform("v", lambda x: F.array_repeat(x["feature"].cast("string"), x["weight"].cast("int")))), " ").alias("text"))


def text_vectors(docs: DataFrame, ident: str = "id", text: str = "text", hashed: bool = True, stop_words: bool = False, limit: float | None = None, dropped: DataFrame | None = None) -> DataFrame:
    """Texts to unit vectors: tokens, stop words, counts, weight limit, feature filter, L2."""
    from pairloom.functions.vector import l2_normalize

    rows = tokenize(docs, ident, text, stop_words)
    counts = hashing_tf(rows) if hashed else token_counts(rows)
    counts = counts if limit is None else max_weight(counts, limit)
    return l2_normalize(counts if dropped is None else without_features(counts, dropped))
