"""Language identification by error-correcting output codes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import table, tidy, worker_state
from pairloom.llm.words import mix

#: Slots that hashed n-grams of letters fall into, and the n.
SLOT_BITS = 15
NGRAMS = (1, 2, 3)
#: Rows a language that the classifiers learn from, in expectation.
SAMPLE_ROWS = 1500
#: A lead over the next codeword below this, as a share of the loss, is flagged as ambiguous.
AMBIGUOUS = 0.02
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1. Up to 7 languages: every split of them into two groups, once. Beyond: fixed random columns, distinct and not constant."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([(1.0, *x) for x in itertools.product((1.0, -1.0), repeat=n - 1) if -1.0 in x]).T
    rng, columns = np.random.default_rng(n), {}
    while len(columns) < int(np.ceil(15 * np.log2(n))):
        c = rng.choice([-1.0, 1.0], n)
        c *= c[0]
        if abs(c.sum()) < n:
            columns[c.tobytes()] = c
    return np.array(list(columns.values())).T


def _letters() -> np.ndarray:
    """Which code points are letters."""
    state = worker_state()
    if "letters" not in state:
        state["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return state["letters"]


def _slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of all texts, and for each its text; runs of other characters than letters count as one space."""
    joined = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t.lower()) + 2 for t in texts])
    code = np.where(_letters()[joined], joined, 32).astype(np.uint64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    slots, owners, h = [], [], np.zeros(len(code), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in NGRAMS:
            whole = owner[:m] == owner[n - 1 :]
            if n == 1:
                whole = whole & (code != 32)
            slots.append((mix(h + np.uint64(n))[whole] >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
            owners.append(owner[:m][whole])
    return (np.concatenate(slots), np.concatenate(owners)) if slots else (np.empty(0, np.int32), np.empty(0, np.int32))


def _blocks(texts: list[str], limit: int = 400_000) -> Iterator[tuple[int, int]]:
    start, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= limit or k == len(texts) - 1:
            yield start, k + 1
            start, n = k + 1, 0


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and slot of a task's sample; each text weighs the same."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for a, b in _blocks(texts):
            slots, owner = _slots(texts[a:b])
            weight = 1.0 / np.maximum(np.bincount(owner, minlength=b - a), 1)
            names = np.array(langs[a:b], object)
            for lang in set(langs[a:b]):
                mine = (names == lang)[owner]
                sums[lang] = sums.get(lang, 0) + np.bincount(slots[mine], weight[owner[mine]], 1 << SLOT_BITS)
    for lang, s in sums.items():
        at = np.flatnonzero(s)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["lang", "slot", "n"])


class Codes:
    """One linear classifier of n-gram frequencies for each bit of the codewords."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: languages by slots."""
        self.langs, self.words = langs, codewords(len(langs))
        if len(langs) < 2:
            return
        p = (counts + 1e-4) / (counts + 1e-4).sum(1, keepdims=True)
        logs = []
        for bit in self.words.T:
            logs.append(np.log(p[bit > 0].mean(0)) - np.log(p[bit < 0].mean(0)))
        self.weights = np.array(logs).T
        # Each bit's margin is scaled so that the languages of its two groups lie at -1 and 1 on average.
        means = p @ self.weights
        high = np.array([means[b > 0, k].mean() for k, b in enumerate(self.words.T)])
        low = np.array([means[b < 0, k].mean() for k, b in enumerate(self.words.T)])
        self.middle, self.half = (high + low) / 2, np.maximum((high - low) / 2, 1e-9)
        # Loss weights: how surely a bit tells this language, which sum to 1 over the bits.
        sure = np.maximum(self.words * (means - self.middle) / self.half, 1e-3)
        self.loss_weights = sure / sure.sum(1, keepdims=True)

    def losses(self, texts: list[str]) -> np.ndarray:
        """Loss of each text's bit margins against each codeword: exponential, weighted by language and bit."""
        slots, owner = _slots(texts)
        n = len(texts)
        total = np.maximum(np.bincount(owner, minlength=n), 1)
        margins = np.stack([np.bincount(owner, w[slots], n) for w in self.weights.T], 1) / total[:, None]
        scaled = np.clip((margins - self.middle) / self.half, -3, 3)
        return np.stack([(np.exp(-scaled * word) * w).sum(1) for word, w in zip(self.words, self.loss_weights, strict=True)], 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous). The score is the chosen codeword's share of the likelihoods exp(-4 loss)."""
        has = [t is not None and any(map(str.isalpha, t)) for t in texts]
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        if not self.langs:
            return out
        if len(self.langs) == 1:
            return [(self.langs[0], 1.0, False) if h else (UNKNOWN, 0.0, True) for h in has]
        known = [k for k, h in enumerate(has) if h]
        chosen = [texts[k] for k in known]
        for a, b in _blocks(chosen):
            loss = self.losses(chosen[a:b])
            order = np.sort(loss, 1)
            likely = np.exp(-4 * (loss - order[:, :1]))
            score = 1 / likely.sum(1)
            unsure = (order[:, 1] - order[:, 0]) < AMBIGUOUS * (order[:, 1] + order[:, 0])
            for k, best, s, u in zip(known[a:b], loss.argmin(1).tolist(), score.tolist(), unsure.tolist(), strict=True):
                out[k] = (self.langs[best], s, u)
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from: CRC-32 of the id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn_languages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Codes:
    """Classifiers from text and lang of docs (doc_id, text, lang), without held-out rows and null langs.

    About sample_rows rows of each language are drawn by a hash of the id (null ids are not drawn),
    and only their n-gram counts by language and slot come to the driver.
    """
    spark = docs.sparkSession
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null").where(~held_out())
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return Codes([], np.zeros((0, 1 << SLOT_BITS)))
    share = spark.createDataFrame([(k, min(1.0, sample_rows / n)) for k, n in rows.items()], "lang string, share double")
    drawn = labelled.where("text is not null").withColumn("u", F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    sample = drawn.join(F.broadcast(share), "lang").where("u < share").select("lang", "text")
    got = sample.mapInArrow(_count, "lang string, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(got["lang"]))
    counts = np.zeros((len(langs), 1 << SLOT_BITS))
    counts[got["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(int), got["slot"].to_numpy(int)] = got["n"]
    return Codes(langs, counts)


def identify_languages(docs: DataFrame, model: Codes) -> DataFrame:
    """docs with lang_pred, score and ambiguous instead of columns of these names; only text is looked at.

    A null text or one without a letter is "und" with score 0, as is any text where nothing could be
    learned. Repeated rows get the same answer; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    kept = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(at).to_pylist())
            more = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*kept, "lang_pred", "score", "ambiguous"])

    fields = T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())))])
    return docs.mapInArrow(run, fields)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs.select("doc_id", "text"), learn_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
