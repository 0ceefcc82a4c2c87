"""Secret scans with built-in functions only: patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import string_column, table

#: Fixed patterns of the contract. A hex run or key of enough characters is found as such, which is the
#: same as finding runs and dropping short ones, as a run's first position gives its longest match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LENGTH = 8

#: Strings whose entropy is looked at, and the width of the window.
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: (class, what its strings must match, bits of some window from which on a string is a secret).
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.6),
    ("lower", r"^(?=.*[0-9])(?=.*[A-Za-z]).+$", 3.5),
)
#: Strings that are never secrets: UUIDs, placeholders, runs of one character, runs of the alphabet or the digits.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|changeme|your[-_]?(key|token|secret)",
    r"(.)\1{7,}",
    r"(?i)abcdefgh|01234567|12345678",
)
KINDS = ("assign", "access", "hex", "entropy")
#: Characters of a candidate that one running sum covers; pieces overlap by a window.
_PIECE = 256
#: Characters of candidates lie between these codes.
_FIRST, _SLOTS = ord("+"), ord("z") - ord("+") + 1
#: Matches whose lengths are summed up at a time.
_CHUNK = 128


def _with(value: Column, then) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _running_sums(steps: Column) -> Column:
    """Sums of array<int> up to each entry: within chunks, then of the chunks, so that no array grows entry by entry for long."""

    def within(chunk: Column) -> Column:
        return F.aggregate(chunk, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))

    def joined(sums: Column) -> Column:
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0)))))
        return F.flatten(F.zip_with(sums, F.slice(starts, 1, F.size(sums)), lambda c, at: F.transform(c, lambda e: e + at)))

    return _with(steps, lambda s: _with(F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(_CHUNK)), lambda at: within(F.slice(s, at + 1, F.lit(_CHUNK)))), joined))


def _matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start, rank, kind, end>> of leftmost non-overlapping matches, in code points.

    Spark has no match positions; those follow from the lengths of the matches and of the gaps
    between them, which are what split() leaves. keep: a condition on (match, index).
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    ends = _running_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))
    spans = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), e.alias("end")))
    return spans if keep is None else F.transform(F.filter(F.zip_with(spans, found, lambda s, m: F.struct(s.alias("s"), m.alias("m"))), lambda z: keep(z["m"])), lambda z: z["s"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")


def window_entropy(s: Column, width: int = WINDOW) -> Column:
    """The most bits a character that some window of `width` characters of s has; s is a candidate of at least `width`.

    The window moves by one character. Carried along are its counts by character and the sum of
    n * log2(n) over them: the character that leaves lowers one count, the one that comes raises one,
    and the sum changes by the terms of these two.
    """
    term = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)])

    def slot(ch: Column) -> Column:
        return F.ascii(ch) - (_FIRST - 1)

    def put(counts: Column, k: Column, n: Column) -> Column:
        return F.concat(F.slice(counts, F.lit(1), k - 1), F.array(n), F.slice(counts, k + 1, F.lit(_SLOTS)))

    def grown(n: Column) -> Column:
        return F.get(term, n + 1) - F.get(term, n)

    def moved(acc: Column, i: Column, total: Column, counts: Column) -> Column:
        bits = F.when(i >= width, math.log2(width) - total / width).otherwise(0.0)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

    def step(piece: Column):
        def run(acc: Column, i: Column) -> Column:
            comes, leaves = slot(F.substring(piece, i, F.lit(1))), slot(F.substring(piece, F.greatest(i - width, F.lit(1)), F.lit(1)))
            n, m = F.element_at(acc["counts"], comes), F.element_at(acc["counts"], leaves)
            first = moved(acc, i, acc["sum"] + grown(n), put(acc["counts"], comes, n + 1))
            later = moved(acc, i, acc["sum"] + grown(n) - grown(m - 1), put(put(acc["counts"], leaves, m - 1), comes, n + 1))
            return F.when(i <= width, first).when(comes == leaves, acc).otherwise(later)

        return run

    none = F.struct(F.array_repeat(F.lit(0), _SLOTS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - width + 1, F.lit(1)), F.lit(_PIECE)), lambda at: F.substring(s, at, F.lit(_PIECE + width - 1)))
    best = F.transform(pieces, lambda p: F.aggregate(F.sequence(F.lit(1), F.length(p)), none, step(p), lambda acc: acc["best"]))
    return F.array_max(best)


def is_random(s: Column) -> Column:
    """Whether a candidate has a window of enough entropy for its class, and no allow-list entry covers it."""
    need = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        need = F.when(s.rlike(pattern), F.lit(bits)).otherwise(need)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | s.rlike(pattern)
    return need.isNotNull() & ~allowed & (F.when(need.isNotNull() & ~allowed, window_entropy(s)) >= need)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): base spans by kind, and all spans with those of high entropy.

    Positions count code points, ends are exclusive, kinds may overlap. A null or empty text has no
    spans, counts 0 and the hash of an empty string. Repeated rows get the same answer, other columns
    are ignored, an empty table gives no rows.
    """
    text = F.col("text")
    assign = F.zip_with(
        _matches(text, ASSIGN, "assign"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), lambda s, v: F.struct(s.alias("s"), F.length(v).alias("n"))
    )
    found = string_column(docs.select("doc_id", "text"), "text").select(
        "doc_id",
        F.when(F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), F.transform(F.filter(assign, lambda z: z["n"] >= ASSIGN_LENGTH), lambda z: z["s"])).otherwise(_none()).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, "access")).otherwise(_none()).alias("access"),
        F.when(text.rlike(HEX), _matches(text, HEX, "hex")).otherwise(_none()).alias("hex"),
        F.when(text.rlike(CANDIDATE), _matches(text, CANDIDATE, "entropy", is_random)).otherwise(_none()).alias("entropy"),
    )
    base = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return base.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "entropy")],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _sql_matches(kind: str, pattern: str, group: int = 0) -> str:
    """(rid, kind, rank, start, end, m): places follow from the gaps that splitting leaves."""
    text = "text, '" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, '{kind}' AS kind, {KINDS.index(kind)} AS rank, "end" - len(m) AS start, "end", v AS m FROM (
    SELECT rid, m, v, sum(len(m) + len(g)) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM (
      SELECT rid, unnest(found) AS m, unnest(groups) AS v, unnest(gaps[1:len(found)]) AS g, unnest(range(len(found))) AS i FROM (
        SELECT rid, regexp_extract_all({text}) AS found, regexp_extract_all({text}, {group}) AS groups, string_split_regex({text}) AS gaps FROM t WHERE regexp_matches({text}))))"""


_LOOK = re.compile(r"\(\?=\.\*(\[[^]]+\])\)")


def _sql_class(pattern: str) -> str:
    """The same without lookahead, which DuckDB lacks."""
    whole = "^" + _LOOK.sub("", pattern.removeprefix("^"))
    return " AND ".join([f"regexp_matches(m, '{p}')" for p in _LOOK.findall(pattern)] + [f"regexp_matches(m, '{whole}')"])


def _sql_allowed(pattern: str) -> str:
    """The same without references to groups, which DuckDB lacks."""
    if pattern == r"(.)\1{7,}":
        pattern = "|".join(f"[{c}]{{8,}}" if c != "-" else "-{8,}" for c in sorted(set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")))
    return f"regexp_matches(m, '{pattern}')"


OP6_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
assign AS ({_sql_matches("assign", ASSIGN, 1)}),
access AS ({_sql_matches("access", ACCESS)}),
hex AS ({_sql_matches("hex", HEX)}),
candidate AS ({_sql_matches("entropy", CANDIDATE)}),
classed AS (
  SELECT *, CASE {" ".join(f"WHEN {_sql_class(p)} THEN {bits}" for _, p, bits in CLASSES)} END AS need
  FROM candidate WHERE NOT ({" OR ".join(map(_sql_allowed, ALLOWED))})),
windowed AS (SELECT DISTINCT m, unnest(list_transform(range(1, len(m) - {WINDOW - 2}), lambda i: m[i:i + {WINDOW - 1}])) AS w FROM classed WHERE need IS NOT NULL),
bits AS (
  SELECT m, max(log2({WINDOW}) - list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: (len(w) - len(replace(w, c, ''))) * log2(len(w) - len(replace(w, c, ''))))) / {WINDOW}) AS bits
  FROM windowed GROUP BY m),
base AS (SELECT * FROM assign WHERE len(m) >= {ASSIGN_LENGTH} UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
every AS (SELECT * FROM base UNION ALL SELECT rid, kind, rank, start, "end", m FROM classed JOIN bits USING (m) WHERE bits >= need),
said AS (
  SELECT rid, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end") AS spans,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end") FILTER (WHERE kind <> 'entropy') AS base,
    count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'entropy') AS n_entropy
  FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  coalesce(n_entropy, 0)::BIGINT AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN said USING (rid)
"""
