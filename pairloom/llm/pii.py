"""Personal data: patterns, and terms that disclose it by how they co-occur with it in the corpus."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import Scratch, string_column, table
from pairloom.llm.words import blocks

#: Kinds in the order of the contract; term marks what the statistics add.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so no run is scanned twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{2,}")

#: Words to either side of personal data that count as its context.
CONTEXT_WORDS = 8
#: Chance, over all terms tested, that a term is said to disclose something which it meets by accident.
CHANCE = 0.01
#: Shares of the kind's information that a term may disclose before it is generalised, or removed.
GENERALISE, REMOVE = 0.5, 0.8


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the contract's patterns, leftmost and without overlap within a kind; in linear time."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(text: str, kind: int, start: int, end: int) -> int:
    """A 64-bit name of one address or number; digits alone tell cards and phones apart."""
    data = text[start:end].lower()
    if kind >= 2:
        data = "".join(filter(str.isdigit, data))
    return xxhash.xxh3_64_intdigest(f"{kind}:{data}") - (1 << 63)


def words_outside(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, word in lower case) of the words that touch no data."""
    out = []
    at = sorted((s, e) for s, _, e in base)
    ends = k = 0
    for m in _WORD.finditer(text):
        while k < len(at) and at[k][0] < m.end():
            ends = max(ends, at[k][1])
            k += 1
        if m.start() >= ends:
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def context_terms(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, kind, entity) of each term within CONTEXT_WORDS of data, outside of all data."""
    words = words_outside(text, base)
    starts = [a for a, _, _ in words]
    met: set[tuple[str, int, int]] = set()
    for start, kind, end in base:
        left, right = bisect_left(starts, start), bisect_left(starts, end)
        entity = _entity(text, kind, start, end)
        met.update((w, kind, entity) for _, _, w in words[max(0, left - CONTEXT_WORDS) : left] + words[right : right + CONTEXT_WORDS])
    return sorted(met)


_TERMS = "array<struct<term:string,kind:int,entity:long>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Data, terms beside it, entities; and the text where it has data."""
    for batch in batches:
        spans, terms, entities, texts = [], [], [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            entities.append(sorted({_entity(text, k, s, e) for s, k, e in base}))
            terms.append([{"term": t, "kind": k, "entity": e} for t, k, e in context_terms(text, base)] if base else [])
            texts.append(text if base else None)
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        term = pa.list_(pa.struct([("term", pa.string()), ("kind", pa.int32()), ("entity", pa.int64())]))
        arrays = [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, span), pa.array(terms, term), pa.array(entities, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "base", "terms", "entities"])


def _words_of_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, term, kind): the distinct words outside of data of each text, with each kind of data that it has."""
    for batch in batches:
        for r in batch.to_pylist():
            base = [(s["start"], s["kind"], s["end"]) for s in r["base"]]
            met = [(w, k) for w in sorted({w for _, _, w in words_outside(r["text"], base)}) for k in sorted({k for _, k, _ in base})]
            yield pa.RecordBatch.from_arrays([pa.array([r["row"]] * len(met), pa.int64()), pa.array([w for w, _ in met], pa.string()), pa.array([k for _, k in met], pa.int32())], names=["row", "term", "kind"])


def _frequencies(shared):
    """In how many of a task's texts each of the shared terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = dict.fromkeys(shared.value, 0)
        for batch in batches:
            for held in blocks(((t,) for t in batch.column("text").to_pylist()), lambda r: len(r[0]), 1_000_000):
                for (text,) in held:
                    for t in names.keys() & set(_WORD.findall(text.lower())):
                        names[t] += 1
        kept = [(t, n) for t, n in names.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["term", "n"])

    return run


def _all_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, texts) of a task, in blocks of bounded size."""
    for batch in batches:
        for held in blocks(((t,) for t in batch.column("text").to_pylist()), lambda r: len(r[0]), 8_000_000):
            names: dict[str, int] = {}
            for (text,) in held:
                for t in set(_WORD.findall(text.lower())):
                    names[t] = names.get(t, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(list(names.values()), pa.int64())], names=["term", "n"])


#: Candidate terms up to this many travel to the tasks as one set (some 10 MB); more are counted by a join.
SHARED_TERMS = 200_000


def disclosing_terms(docs: DataFrame, found: DataFrame, chance: float = CHANCE) -> DataFrame:
    """(term, kind, entity, disclosed): pointwise mutual information of a term and what it discloses over the latter's information.

    found: rows with terms and entities as _find() gives them, one for each row of docs (text). A term
    may disclose one entity, an address or number, or a kind of them; then the entity is null. With n
    documents, c with the entity or kind, f with the term and j with the term beside it, PMI is
    log2(j * n / (f * c)) and the information log2(n / c): 1 means that the term never occurs without
    such data, 0 that it says nothing about it. All counts are over all documents. By chance, f * c / n
    documents would have both; terms stay whose j has, by Chernoff's bound on the tail of that, a
    probability below `chance` over the number of pairs tested.
    """
    spark = docs.sparkSession
    n = found.count()
    kinds = found.select(F.explode(F.array_distinct(F.transform("base", lambda s: s["kind"]))).alias("kind")).groupBy("kind").agg(F.count("*").alias("c"))
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("c"))
    alike = F.array_distinct(F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["kind"].alias("kind"), F.lit(None).cast("long").alias("entity"))))
    pairs = found.select(F.explode(F.concat(alike, "terms")).alias("t")).groupBy("t.term", "t.kind", "t.entity").agg(F.count("*").alias("j"))
    pairs = Scratch(spark, "pii-pairs").save(pairs, "pairs")
    bound = math.log(max(pairs.count(), 1) / chance)
    # As f >= j and c >= j, no pair of so few documents passes the bound: j * n / (f * c) <= n / j.
    least = next((j for j in range(1, n + 1) if j * math.log(n / j) - j + j * j / n >= bound), n + 1)
    pairs = pairs.where(F.col("j") >= least)
    terms = pairs.select("term").distinct()
    some = [r["term"] for r in terms.limit(SHARED_TERMS + 1).collect()]
    texts = docs.select("text")
    if len(some) <= SHARED_TERMS:
        counted = texts.mapInArrow(_frequencies(spark.sparkContext.broadcast(some)), "term string, n long")
    else:
        counted = texts.mapInArrow(_all_frequencies, "term string, n long").join(terms, "term", "left_semi")
    f = counted.groupBy("term").agg(F.sum("n").alias("f")) if some else spark.createDataFrame([], "term string, f long")
    of_kinds = pairs.where("entity is null").join(F.broadcast(kinds), "kind").select("term", "kind", "entity", "j", "c")
    of_entities = pairs.where("entity is not null").join(entities, "entity").select("term", "kind", "entity", "j", "c")
    mean = F.col("f") * F.col("c") / F.lit(float(n))
    beyond = F.col("j") * F.log(F.col("j") / mean) - F.col("j") + mean
    share = F.log2(F.col("j") / mean) / F.log2(F.lit(float(n)) / F.col("c"))
    met = of_kinds.unionByName(of_entities).join(f, "term").where(F.col("c") < n)
    return met.where((F.col("j") > mean) & (beyond >= bound)).withColumn("disclosed", share).select("term", "kind", "entity", "disclosed")


def _digest(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (s["start"], s["kind"], s["end"])))


def _written(shared):
    """The contract's columns, and the sanitised text. shared has (share disclosed, kind) of terms for each kind, and rows bring those of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_kinds = shared.value
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_term", "base_sha256", "spans", "sanitised")}
            for r in batch.to_pylist():
                base, more = r["base"], []
                if base:
                    own = {t["term"]: (t["disclosed"], t["kind"]) for t in r["risky"] or []}
                    tables = [own, *(of_kinds[k] for k in {s["kind"] for s in base} if k in of_kinds)]
                    for a, b, word in words_outside(r["text"], [(s["start"], s["kind"], s["end"]) for s in base]):
                        if said := [t[word] for t in tables if word in t]:
                            disclosed, of = max(said)
                            more.append({"kind": 4, "start": a, "end": b, "disclosed": disclosed, "of": of})
                out["doc_id"].append(r["doc_id"])
                for k, name in enumerate(KINDS[:4]):
                    out[f"n_{name}"].append(sum(s["kind"] == k for s in base))
                out["n_term"].append(len(more))
                out["base_sha256"].append(hashlib.sha256(_digest(base).encode()).hexdigest())
                out["spans"].append(_digest(base + more))
                out["sanitised"].append(sanitise(r["text"], base + more) if base else None)
            kinds = {"doc_id": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "sanitised": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    return run


def sanitise(text: str, spans: list[dict]) -> str:
    """Data becomes its kind in brackets; a disclosing term the kind of data that it belongs to, or nothing where its share is REMOVE or more."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"], s["end"])):
        if s["end"] <= done:
            continue
        out.append(text[done : max(done, s["start"])])
        if s["kind"] < 4:
            out.append(f"[{KINDS[s['kind']].upper()}]")
        elif s["disclosed"] < REMOVE:
            out.append(f"[WORD OF {KINDS[s['of']].upper()}]")
        done = s["end"]
    return "".join(out) + text[done:]


def find_personal_data(docs: DataFrame, chance: float = CHANCE, generalise: float = GENERALISE) -> DataFrame:
    """Per row of docs (doc_id, text): personal data, and terms that disclose an address or number or its kind.

    A term that discloses an entity or kind is marked wherever it occurs in the texts that hold the
    entity or data of the kind beside it. Positions count code points, ends are exclusive. sanitised is
    the text without what was found: data becomes its kind, a term the kind it belongs to or, from
    REMOVE on, nothing; it is null for a text without data, which stays as it is and so is not moved. A
    null or empty text has no spans; repeated rows each get their answer and each count in the
    statistics; other columns are ignored; an empty table gives no rows.

    Up to SHARED_TERMS terms that disclose a kind are handed to every task; more are joined to the
    distinct words of the texts that have data.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    docs = string_column(docs.select("doc_id", "text"), "text")
    found = scratch.save(docs.mapInArrow(_find, f"doc_id long, text string, base array<struct<start:int,kind:int,end:int>>, terms {_TERMS}, entities array<long>").withColumn("row", F.monotonically_increasing_id()), "found")
    risky = scratch.save(disclosing_terms(docs, found, chance).where(F.col("disclosed") >= generalise), "risky")
    alike = risky.where("entity is null").select("term", "kind", "disclosed")
    held = found.select("row", F.explode("entities").alias("entity")).join(risky.where("entity is not null").select("entity", "term", "kind", "disclosed"), "entity").drop("entity")
    of_kinds: dict[int, dict[str, tuple[float, int]]] = {}
    if alike.count() <= SHARED_TERMS:
        for r in alike.collect():
            of_kinds.setdefault(r["kind"], {})[r["term"]] = r["disclosed"], r["kind"]
    else:
        words = found.where(F.size("base") > 0).select("row", "text", "base").mapInArrow(_words_of_kinds, "row long, term string, kind int")
        held = held.unionByName(words.join(alike, ["term", "kind"]))
    own = held.groupBy("row", "term").agg(F.max(F.struct("disclosed", "kind")).alias("d"))
    own = own.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("term", "d.disclosed", "d.kind"))).alias("risky"))
    rows = found.select("row", "doc_id", "text", "base")
    rows = rows.where(F.size("base") > 0).join(own, "row", "left").unionByName(rows.where(F.size("base") == 0), allowMissingColumns=True).drop("row")
    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_term long, base_sha256 string, spans string, sanitised string"
    return rows.mapInArrow(_written(spark.sparkContext.broadcast(of_kinds)), out)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
