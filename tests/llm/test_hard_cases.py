"""Repeated rows, missing ids, long inputs and plain versions of the training-data operators."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import contamination, html, jaccard, mixing, packing, pii, pivots, secrets, tokens
from pairloom.llm.common import build_filter, checkpoint_root, passes_filter, worker_path

RNG = random.Random(7)
WORDS = [f"v{k}" for k in range(300)]
DOCS = "doc_id long, text string"


def _text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_packing_spreads_rows_without_id(spark):
    rows = [(None, _text(40)) for _ in range(200)] + [(None, "the same text in very many rows " * 8)] * 200 + [(5, "one id for all " * 10)] * 200
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    total = sum(len(t) for _, t in rows)
    packed = packing.pack_documents(docs, seq_len=128, shard_bytes=total // 12).collect()
    by_shard = Counter()
    for r in packed:
        by_shard[r["shard"]] += r["n_tokens"]
    assert len(by_shard) >= 11 and max(by_shard.values()) <= 2 * sum(by_shard.values()) / len(by_shard)
    coder = tokens.TokenIds(worker_path("byte_bpe_50k.tiktoken"))
    want = Counter((d, coder.ids(t)[k : k + 128].tobytes()) for d, t in rows for k in range(0, len(coder.ids(t)), 128))
    got = Counter((d, r["input_ids"][2 * a : 2 * b]) for r in packed for d, a, b in zip(r["doc_ids"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False))
    assert got == want


def test_tokens_of_copies_meet_the_encoder_once(spark, tmp_path):
    rows = [(k % 7, "a text that hundreds of rows have") for k in range(400)] + [(k, _text(20)) for k in range(50)]
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    first = sorted(map(tuple, tokens.count_tokens(docs, cache=cache).collect()))
    written = spark.read.parquet(cache)
    assert written.count() == 51
    # Another run that had appended the same digests at a time changes no answer, and nothing is encoded again.
    spark.createDataFrame(written.collect(), tokens.CACHE_SCHEMA).write.mode("append").parquet(cache)
    more = docs.unionByName(spark.createDataFrame([(99, "one more text")], DOCS))
    again = sorted(map(tuple, tokens.count_tokens(more, cache=cache).collect()))
    assert len(again) == len(first) + 1 and Counter(first) == Counter(r for r in again if r[0] != 99)
    assert spark.read.parquet(cache).count() == 103


def test_mix_of_rows_that_repeat(spark):
    # 1,000 equal rows of 10 words, next to a source of which all is taken: the target is met by rows, not by all or none.
    rows = [(1, "one two three four five six seven eight nine ten", "a")] * 1000 + [(k, _text(50), "b") for k in range(10, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = mixing.mix_sources(docs, labels).collect()
    assert len(got) == len(rows)
    for source, size in (("a", 10), ("b", 50)):
        mine = [r for r in got if r["size"] == size]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= size
    mixed = Counter(r["source"] for r in mixing.mixed_documents(docs, labels).collect())
    assert mixed["a"] * 10 == sum(r["taken"] for r in got if r["size"] == 10) and mixed["b"] * 50 == sum(r["taken"] for r in got if r["size"] == 50)
    again = mixing.mix_sources(docs.repartition(2), labels).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_against_its_sql(spark, tmp_path):
    import duckdb

    rows = [(RNG.choice([None, *range(6)]), RNG.choice([None, "", _text(5, random.Random(3)), _text(9)]), RNG.choice([None, "a", "b", "c"])) for _ in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = Counter((d, n, s, round(t, 6), k) for d, n, s, t, k in db.execute(mixing.OP8_SQL).fetchall())
    got = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.op8_mix_sources(spark, str(tmp_path)).collect())
    assert got == want


def _plain_tiles(a, b, shortest):
    """Greedy string tiling as first published: all longest matches of a round, then marked where still free."""
    free_a, free_b, lengths = [True] * len(a), [True] * len(b), []
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((i, j))
        if best < shortest:
            return lengths
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                lengths.append(best)
                free_a[i : i + best] = free_b[j : j + best] = [False] * best


def test_tiles_against_the_plain_form():
    for letters in (3, 6, 40):
        for _ in range(150):
            a, b = ([RNG.randrange(letters) for _ in range(RNG.randrange(40))] for _ in range(2))
            tiles = contamination.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
            plain = _plain_tiles(a, b, 3)
            assert max((n for *_, n in tiles), default=0) == max(plain, default=0)
            if letters == 40:  # no ties in which the order of marking matters
                assert sorted(n for *_, n in tiles) == sorted(plain)
            assert all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)


def test_tiles_of_repeated_words_take_no_time():
    start = time.perf_counter()
    for words in (np.zeros(20_000, np.uint64), np.arange(20_000, dtype=np.uint64) % 3, np.random.default_rng(0).integers(0, 2, 20_000).astype(np.uint64)):
        assert sum(n for *_, n in contamination.tile(words, words.copy())) == 20_000
    assert time.perf_counter() - start < 20


def test_contamination_against_brute_force(spark):
    items = [_text(RNG.randrange(5, 60)) for _ in range(12)]
    docs = []
    for k in range(60):
        words = RNG.choice(items).split()
        cut = RNG.randrange(len(words) + 1)
        parts = [words[cut:], words[: RNG.choice([cut, cut // 2])]]
        docs.append(f"{_text(RNG.randrange(30))} {' '.join(parts[0])} {_text(RNG.randrange(5))} {' '.join(parts[1])}")
    want = set()
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            if 5 * sum(_plain_tiles(item.split(), text.split(), 5)) >= 3 * len(item.split()):
                want.add((d, i))
    found = contamination.contaminated(spark.createDataFrame(list(enumerate(docs)), DOCS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 20


_BASE = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE), 1, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def _secret_spans(text):
    """Plain version of op6: patterns of the contract, and entropy of every window counted anew."""
    out = [(m.start(), rank, kind, m.end()) for rank, (kind, p, g, least) in enumerate(_BASE) for m in p.finditer(text) if len(m[g]) >= least]
    base = sorted(out)
    for m in re.finditer(r"[A-Za-z0-9+/=_-]{20,}", text):
        s = m[0]
        need = next((bits for _, p, bits in secrets.CLASSES if re.search(p, s)), None)
        if need is None or any(re.search(p, s) for p in secrets.ALLOWED):
            continue
        if max(-sum(n / 20 * math.log2(n / 20) for n in Counter(s[k : k + 20]).values()) for k in range(len(s) - 19)) >= need:
            out.append((m.start(), 3, "entropy", m.end()))
    return base, sorted(out)


def test_secrets_against_a_plain_version(spark):
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"

    def piece():
        kind = RNG.randrange(10)
        run = lambda letters, lo, hi: "".join(RNG.choice(letters) for _ in range(RNG.randrange(lo, hi)))
        return [
            lambda: run(hexes, 10, 60), lambda: run(mixed, 15, 50), lambda: "AKIA" + run(mixed[:26] + "0123456789", 8, 20), lambda: run("ab1", 20, 60),
            lambda: f"{RNG.choice(['Password', 'api_key', 'APIKEY', 'token'])}{RNG.choice([': ', ' = ', chr(34) + ':'])}{run(mixed, 5, 14)}",
            lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "aaaaaaaaaa" + run(mixed, 15, 30), lambda: "naïve 😀 words", lambda: run(mixed, 250, 700), lambda: "your-token-" + run(mixed, 20, 30),
        ][kind]()

    texts = [RNG.choice([" ", "\n", ", "]).join(piece() for _ in range(RNG.randrange(9))) for _ in range(150)] + ["", " ".join("password=abcdefgh1" for _ in range(1500))]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame([*enumerate(texts), (-1, None)], DOCS)).collect()}
    said = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
    for k, text in enumerate(texts):
        base, every = _secret_spans(text)
        assert got[k]["spans"] == said(every) and got[k]["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest(), text
    assert sum(r["n_entropy"] for r in got.values()) > 50 and got[-1]["spans"] == ""


def test_secrets_in_a_very_long_text_and_a_very_long_candidate(spark):
    long = "password=abcdefgh1 " * 30_000
    candidate = "".join(RNG.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789") for _ in range(30_000))
    start = time.perf_counter()
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame([(1, long), (2, candidate)], DOCS)).collect()}
    assert got[1]["n_assign"] == 30_000 and got[1]["spans"].endswith(f"assign:{19 * 29_999}:{19 * 29_999 + 18}") and got[2]["spans"] == "entropy:0:30000"
    assert time.perf_counter() - start < 60


def _length_of_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


@pytest.mark.parametrize("rows", [1, 3, 256])
def test_alignment_is_a_longest_common_subsequence(rows, monkeypatch):
    monkeypatch.setattr(html, "_ROWS", rows)
    for _ in range(400):
        a, b = ([RNG.randrange(6) for _ in range(RNG.randrange(40))] for _ in range(2))
        got = html.shared_lines(a, b)
        rest = iter(b)
        assert len(got) == _length_of_common(a, b) and sorted(set(got)) == got and all(a[k] in rest for k in got)


def test_alignment_of_very_long_pages():
    a, b = ([RNG.randrange(3000) for _ in range(40_000)] for _ in range(2))
    assert len(html.shared_lines(a, b)) > 1000 and len(html.shared_lines(a, a)) == 40_000


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><body><p>A head may lack its end", "A head may lack its end"),
        ("<html><head><meta charset=utf-8><p>And a body its start", "And a body its start"),
        ("<p>before <svg/> after</p><p>next", "before after\nnext"),
        ("<p>x<svg><text>no</text></svg>y</p>", "xy"),
        ("<p title='the hidden truth'>shown</p><p hidden>not</p><p hidden=''>nor</p>", "shown"),
        ("<header><p>Site</p></header><p>Text</p>", "Text"),
        ("<header>Site</header><article><header><h1>Title</h1></header><p>Text</p></article>", "Title\nText"),
        ("<p class=share-price>Up 3 %</p><h2 id='form-of-government'>Republic</h2>", "Up 3 %\nRepublic"),
        ("<div class='share buttons'>no</div><div class='ad-slot-3'>no</div><div id='left-sidebar'>no</div><p>yes", "yes"),
        ("<div class=comments-area>no</div><div role=navigation>no</div><p>a &lt;b&gt; &amp; c&nbsp;d</p>", "a <b> & c d"),
        ("<article>in<p>it</article>out", "in\nit"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ],
)
def test_structure_of_pages(page, text):
    assert "\n".join(html.main_lines(page)[0]) == text


def test_pages_that_repeat_and_clash(spark):
    page = "<article><p>Share this page</p><p>{}</p><p>{}</p></article>"
    said = [page.format(_text(30), _text(30)) for _ in range(6)]
    rows = [(k, f"http://h.example/{k}", p) for k, p in enumerate(said)] + [(2, "http://h.example/2", said[2])] * 30 + [(50, "http://h.example/50", None), (51, "http://h.example/51", "")]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, key string, cut string, path long").repartition(4)
    got = html.extract_text(pages).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] in (50, 51)} == {""}
    for r in got:
        if r["page_id"] < 50:
            assert r["text"] == "\n".join(html.main_lines(said[r["page_id"]])[0][1:]) and r["n_shared"] == 1 and r["n_chars"] == len(r["text"])


def test_cuts_that_are_too_many_for_every_task_are_joined(spark, monkeypatch):
    page = "<article><p>Share this page</p><p>{}</p><p>{}</p></article>"
    pages = spark.createDataFrame([(k, f"http://h.example/{k}", page.format(_text(30), _text(30))) for k in range(20)], "page_id long, url string, html string")
    want = sorted(map(tuple, html.extract_text(pages).collect()))
    monkeypatch.setattr(html, "SHARED_BYTES", -1)
    assert sorted(map(tuple, html.extract_text(pages).collect())) == want and all(r[4] == 1 for r in want)


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        checkpoint_root(Session())
    Session.conf["spark.checkpoint.dir"] = "file:///shared"
    assert checkpoint_root(Session()) == "file:///shared"


# The patterns of the contract, as they stand there.
_DATA = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= sum(map(str.isdigit, m)) <= 19 and _luhn(m)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= sum(map(str.isdigit, m)) <= 15),
)


def _luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def _data_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, keep) in enumerate(_DATA) for m in p.finditer(text) if keep(m[0]))


def test_data_against_the_patterns(spark):
    pieces = ["10.0.0.1", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0123", "+49.30.1234567", "+1", "a.b@c.de", "x@y", "@", "q@@r.s", "12", " ", "-", ".", "é", "😀", "word"]
    texts = ["".join(RNG.choice(pieces) + RNG.choice(["", " ", "", "."]) for _ in range(RNG.randrange(14))) for _ in range(1500)]
    texts += ["".join(RNG.choice("0123456789 .-+()@a") for _ in range(RNG.randrange(60))) for _ in range(1500)]
    for t in texts:
        assert pii.base_spans(t) == _data_spans(t), t
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame([*enumerate(texts), (-1, None)], DOCS)).collect()}
    for k, t in enumerate(texts):
        spans = _data_spans(t)
        said = ",".join(f"{_DATA[kind][0]}:{a}:{b}" for a, kind, b in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [got[k][f"n_{name}"] for name, *_ in _DATA] == [sum(kind == n for _, kind, _ in spans) for n in range(4)]
        assert (got[k]["sanitised"] is None) == (not spans)
    assert got[-1]["spans"] == "" and got[-1]["sanitised"] is None


def test_very_many_addresses_in_one_text(spark):
    text = " ".join(f"write to user{k}@mail.example now" for k in range(40_000))
    start = time.perf_counter()
    row = pii.find_personal_data(spark.createDataFrame([(1, text), (2, None), (2, None), (3, "x" * 100_000)], DOCS)).where("doc_id = 1").collect()[0]
    assert row["n_email"] == 40_000 and "@" not in row["sanitised"] and time.perf_counter() - start < 60


def _disclosing_rows():
    with_data = [(k, f"customer hotline zyxw +1 (212) 555-01{k:02d} please") for k in range(60)]
    return with_data + [(100 + k, f"customer please {'hotline' if k < 28 else 'nothing'} here") for k in range(140)]


def test_terms_are_generalised_or_removed_by_their_share(spark, monkeypatch):
    docs = spark.createDataFrame(_disclosing_rows(), DOCS)
    got = {r["doc_id"]: r["sanitised"] for r in pii.find_personal_data(docs).collect()}
    # Each zyxw stands beside a number and goes; hotline does so in 60 of 88 documents and names the kind only.
    assert got[3] == "customer [WORD OF PHONE]  [PHONE] please" and got[100] is None
    monkeypatch.setattr(pii, "SHARED_TERMS", 0)
    assert {r["doc_id"]: r["sanitised"] for r in pii.find_personal_data(docs).collect()} == got


def test_terms_against_plain_counts(spark):
    """PMI and the bound of chance, counted document by document."""
    rows = _disclosing_rows()
    n, words = len(rows), [set(re.findall(r"[a-z]{2,}", t)) for _, t in rows]
    has = [bool(_data_spans(t)) for _, t in rows]
    risky = {r["term"]: r["disclosed"] for r in pii.disclosing_terms(*_found(spark, rows)).where("entity is null").collect()}
    c = sum(has)
    for term in {w for held in words for w in held}:
        f, j = sum(term in held for held in words), sum(term in held and h for held, h in zip(words, has, strict=True))
        share = math.log2(j * n / (f * c)) / math.log2(n / c) if j else 0
        assert risky.get(term, 0) == pytest.approx(share) or (term not in risky and (share <= 0 or j * math.log(j * n / (f * c)) - j + f * c / n < 12))


def _found(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    kinds = f"doc_id long, text string, base array<struct<start:int,kind:int,end:int>>, terms {pii._TERMS}, entities array<long>"
    return docs, docs.mapInArrow(pii._find, kinds)


def _jaccard_labels(texts):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_jaccard_keys_that_are_dealt_out_as_several_lists(spark, monkeypatch):
    base = [_text(40) for _ in range(6)]
    texts = []
    for _ in range(160):
        words = RNG.choice(base).split()
        for _ in range(RNG.randrange(4)):
            words[RNG.randrange(len(words))] = RNG.choice(WORDS)
        texts.append(" ".join(words) + " a passage that all of these texts have at their end")
    want = _jaccard_labels(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    for keys in (jaccard.LIST_KEYS, 4):
        monkeypatch.setattr(jaccard, "LIST_KEYS", keys)
        assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == dict(enumerate(want))
    assert len(set(want)) < 150


def test_filters_have_no_false_negatives(spark):
    rng = np.random.default_rng(3)
    inside, outside = (rng.integers(-(1 << 63), (1 << 63) - 1, 20_000) for _ in range(2))
    field = build_filter(spark.createDataFrame([(int(x),) for x in inside], "h long").repartition(3)).value
    assert passes_filter(field, inside.view(np.uint64)).all() and passes_filter(field, outside.view(np.uint64)).mean() < 0.05
    assert not build_filter(spark.createDataFrame([], "h long")).value.any()


def test_embeddings_that_repeat_clash_and_tie(spark):
    x = np.random.default_rng(5).standard_normal((40, 8)).astype(np.float64)
    rows = [(k, k % 2, x[k].tolist(), "h", 1, 2) for k in range(40)] + [(5, 1, x[5].tolist(), "h", 1, 2)] * 9 + [(None, 1, x[5].tolist(), "h", 1, 2), (60, None, x[5].tolist(), "h", 1, 2), (61, 1, None, "h", 1, 2), (62, 1, [], "h", 1, 2)]
    rows += [(70 + k, 0, [float(k + 1), 0.0], "h", 1, 2) for k in range(3)]  # one direction, other lengths and another dimension
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, h1 string, cid long, n long").repartition(3)
    got = pivots.near_duplicates(frame).collect()
    assert len(got) == len(rows) and pivots.near_duplicates(frame.limit(0)).count() == 0
    by_id = {r["vec_id"]: r for r in got}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = {k: [j for j in range(40) if j % 2 == k % 2 and j != k and unit[j] @ unit[k] >= 0.93] for k in range(40)}
    copies = lambda js: sum(11 if j == 5 else 1 for j in js)
    assert all(by_id[k]["n_links"] == copies(near[k]) + (10 if k == 5 else 0) for k in range(40))
    assert by_id[None]["component_id"] == by_id[5]["component_id"] and not by_id[None]["kept"]
    assert all((by_id[k]["n_links"], by_id[k]["component_id"]) == (0, k) for k in (60, 61, 62))
    assert all((by_id[70 + k]["n_links"], by_id[70 + k]["component_id"]) == (2, 70) for k in range(3))


def test_shared_pivots_against_counting():
    rng = np.random.default_rng(6)
    for _ in range(40):
        p = np.array([rng.permutation(30)[:8] for _ in range(60)], np.int16)
        key = int(p[0, rng.integers(8)])
        mine = p[(p == key).any(1)]
        i, j = pivots.shared_pivots(mine, mine, key)
        want = {
            (a, b) for a in range(len(mine)) for b in range(len(mine))
            if len(both := set(mine[a]) & set(mine[b])) >= 2 and min(both) == key and (set(mine[a][:3]) & set(mine[b]) or set(mine[b][:3]) & set(mine[a]))
        }
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
