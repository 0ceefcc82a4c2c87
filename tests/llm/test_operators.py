import random
import re

import numpy as np
import pytest

from pairloom.llm import contamination, html, jaccard, language, mixing, packing, pii, pivots, secrets, tokens
from pairloom.llm.common import Scratch, components, worker_path

RNG = random.Random(4)
WORDS = [f"w{k}" for k in range(400)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(20_000))
BASE = " ".join(RNG.choice(WORDS) for _ in range(120))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cid long, n long, row long, key string, digest string, score double"
EDGE = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "   \n\t ", "en", "a"),
    (4, LONG, "en", "b"),
    (5, "one two", "en", "b"),
    (6, "one two", "en", "b"),
    (6, "one two", "en", "b"),
    (None, "one two", None, None),
    (7, BASE, "de", "c"),
    (8, BASE + " more", "de", "c"),
    (9, "x <|endoftext|> y  z\n\n naïve 😀 token = \"abcDEF12345678\" a.b@c.example.org", "de", "c"),
    (10, "12345 ... 678", "de", "c"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, 0, 1, 2, 3, "k", "d", 0.5) for r in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def _labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, None, 1), (None, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")


def test_components_are_connected_components(spark):
    edges = [(a, b) for a, b in ((RNG.randrange(200), RNG.randrange(200)) for _ in range(150))] + [(k, k + 1) for k in range(300, 360)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_jaccard_edges(spark, edge, empty):
    rows = jaccard.jaccard_components(edge).collect()
    assert len(rows) == len(EDGE) and jaccard.jaccard_components(empty).count() == 0
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows]
    assert (1, 0, 1) in got and (2, 0, 2) in got and (5, 1, 5) in got and got.count((6, 1, 5)) == 2 and (None, 1, 5) in got and (7, 116, 7) in got and (8, 117, 7) in got


def test_jaccard_against_all_pairs(spark):
    base = [[RNG.choice(WORDS[:60]) for _ in range(RNG.randrange(4, 60))] for _ in range(12)]
    texts = []
    for _ in range(120):
        words = list(RNG.choice(base))
        for _ in range(RNG.randrange(5)):
            words[RNG.randrange(len(words))] = RNG.choice(WORDS)
        texts.append(" ".join(words) + " common passage that stands in each of these texts here")
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))


def test_tree_finds_what_the_bound_leaves():
    rng = np.random.default_rng(0)
    for _ in range(20):
        m, base = int(rng.integers(2, 90)), rng.integers(0, 6, (8, jaccard.MERGED))
        p = np.maximum(base[rng.integers(0, 8, m)] + rng.integers(-1, 2, (m, jaccard.MERGED)), 0).astype(np.int32)
        p[:, 0] += 1
        tree, n = jaccard.CountTree(p), p.sum(1)
        i, j = jaccard.tree_pairs(tree, tree)
        want = {(x, y) for x in range(m) for y in range(x + 1, m) if np.minimum(p[x], p[y]).sum() >= jaccard._needed(n[x], n[y])}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x[100:200] = x[:100] + 0.12 * rng.standard_normal((100, 16))
    x[200:230] = x[0]
    rows = [(k, k % 2 if k < 290 else None, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    rows += [(900, 1, None), (901, 1, [0.0] * 16), (902, 1, [float("nan")] * 16), (903, 1, [None] * 16)]
    got = {r["vec_id"]: r for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    unit = {k: np.array(v, float) / np.linalg.norm(np.array(v, float)) for k, _, v in rows[:290]}
    want = {(a, b) for a in unit for b in unit if a != b and a % 2 == b % 2 and unit[a] @ unit[b] >= 0.93}
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * len(want) and len(want) > 100
    assert all(got[k]["n_links"] <= sum(a == k for a, _ in want) for k in unit)
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in (900, 901, 902, 903, 295))


@pytest.mark.parametrize("cosine", [0.94, 0.96])
def test_embeddings_of_a_dense_group(spark, cosine):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    x[:1000] = rng.standard_normal(64) + np.sqrt(1 / cosine - 1) * rng.standard_normal((1000, 64))
    x[1000:1100] = x[1100:1200] + 0.2 * rng.standard_normal((100, 64))
    rows = [(k, 0, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    got = {r["vec_id"]: r for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    unit = np.array([r[2] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    n_links = np.array([got[k]["n_links"] for k in range(3000)])
    assert want[:1000].sum() > 400_000 and (n_links[:1000] == want[:1000]).all()
    assert (n_links <= want).all() and n_links[1000:].sum() >= 0.98 * want[1000:].sum()
    assert all(got[k]["component_id"] == 0 for k in range(1000) if want[k] > 500)


def test_tokens(spark, edge, empty, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(worker_path("byte_bpe_50k.json"))
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        rows = tokens.count_tokens(edge, cache=cache).collect()
        assert len(rows) == len(EDGE)
        by_id = {r[0]: r[1] or "" for r in EDGE}
        assert all(r["n_tokens"] == len(whole.encode(by_id[r["doc_id"]], add_special_tokens=False).ids) for r in rows)
        assert all(r["n_bytes"] == len(by_id[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in EDGE}) and tokens.count_tokens(empty).count() == 0
    counter = tokens.TokenCounter(worker_path("byte_bpe_50k.json"))
    odd = ["".join(RNG.choice("ab .,'\n\t\r ​　é1😀<|endoftext|>") for _ in range(RNG.randrange(30))) for _ in range(3000)] + ["a<|endoftext|> b", "it's\nI'll"]
    assert counter.count(odd) == [len(e.ids) for e in whole.encode_batch(odd, add_special_tokens=False)]


def test_packing_round_trip(spark, edge, empty):
    packed = packing.pack_documents(edge, seq_len=64, shard_bytes=50_000)
    rows = packed.collect()
    assert all(len(r["input_ids"]) == 128 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64 and len(r["doc_ids"]) == r["n_segments"] for r in rows)
    for r in rows[:20]:
        at = np.frombuffer(r["position_ids"], "<u2")
        assert all(at[a:b].tolist() == list(range(b - a)) for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False))
    coder = tokens.TokenIds(worker_path("byte_bpe_50k.tiktoken"))
    want = sorted((d or 0, k, coder.ids(t)[k : k + 64].tolist()) for d, t, *_ in EDGE if t for k in range(0, len(coder.ids(t)), 64))
    assert sorted((r["doc_id"] or 0, r["start"], r["ids"]) for r in packing.unpacked(packed).collect()) == want
    assert packing.pack_documents(empty).count() == 0


def test_best_fit():
    lengths = sorted((RNG.randrange(1, 65) for _ in range(500)), reverse=True)
    rows = packing.best_fit_decreasing(lengths, 64)
    assert sorted(k for r in rows for k in r) == list(range(500)) and all(sum(lengths[k] for k in r) <= 64 for r in rows)
    free: list[int] = []
    for n in lengths:  # the plain form
        fit = min((f for f in free if f >= n), default=None)
        if fit is None:
            free.append(64 - n)
        else:
            free[free.index(fit)] -= n
    assert len(rows) == len(free)


def test_tiles_and_contamination(spark, edge, empty):
    for _ in range(500):
        a, b = ([RNG.randrange(3) for _ in range(RNG.randrange(n))] for n in (30, 40))
        t = contamination.tile(a, b, 3)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in t)
        assert all(len(set(x)) == len(x) for x in ([k for i, _, n in t for k in range(i, i + n)], [k for _, j, n in t for k in range(j, j + n)]))
    words = BASE.split()
    moved = " ".join(words[60:] + words[:60])
    items = spark.createDataFrame([(1, moved), (2, None), (3, "one two"), (4, "nothing of this occurs in any document at all")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in contamination.contaminated(edge, items).collect())
    assert got == [(7, 1), (8, 1)]
    assert contamination.contaminated(empty, items).count() == 0 and contamination.contaminated(edge, items.limit(0)).count() == 0


def test_repetitive_items_are_found(spark):
    line = "la li lo lu le ly lö "
    docs = spark.createDataFrame([(1, "before it " + line * 12 + "after it"), (2, "la li lo lu le ly other words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, line * 12), (2, "never seen in any of them")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["covered"]) for r in contamination.contaminated(docs, items).collect()] == [(1, 1, 84)]


def test_mixing(spark, edge, empty):
    labels = _labels(spark)
    first, again = (sorted(map(tuple, mixing.mix_sources(edge, labels).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(EDGE)
    rows = mixing.mix_sources(edge, labels).collect()
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in rows)
    assert mixing.mixed_documents(edge, labels).columns == edge.columns and mixing.mix_sources(empty, labels).count() == 0


def test_secrets_and_personal_data(edge, empty):
    found = {r["doc_id"]: r for r in secrets.scan_secrets(edge).collect()}
    assert found[9]["n_assign"] == 1 and found[1]["spans"] == "" and secrets.scan_secrets(empty).count() == 0
    data = {r["doc_id"]: r for r in pii.find_personal_data(edge).collect()}
    assert data[9]["n_email"] == 1 and data[9]["sanitised"].endswith("[EMAIL]") and pii.find_personal_data(empty).count() == 0
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(3000):
        t = "".join(RNG.choice("a1.@+- 9()%255") for _ in range(RNG.randrange(30)))
        assert [(m.start(), m.end()) for m in plain.finditer(t)] == [(s, e) for s, k, e in pii.base_spans(t) if k == 0]
    assert pii.base_spans("1" * 50_000 + "@" * 50_000) == []


def test_disclosing_terms(spark):
    rows = [(k, f"customer hotline zyxw +1 (212) 555-01{k:02d} please") for k in range(30)] + [(100 + k, "customer please nothing here") for k in range(70)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:9:16" in got[0] and "term:17:21" in got[0] and "term:0:8" not in got[0] and got[100] == ""


def test_terms_that_disclose_one_address(spark):
    filler = lambda k: " ".join(RNG.choice(WORDS) for _ in range(k))
    rows = [(k, f"zanzibar {'x' * 500} {filler(3)} bob@mail.example quorvath {filler(30)} Quorvath") for k in range(6)]
    rows += [(100 + k, f"{filler(5)} user{k}@mail.example {filler(5)}") for k in range(200)] + [(400 + k, filler(20)) for k in range(2000)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(6):
        assert "quorvath" not in got[k]["sanitised"].lower() and "zanzibar" not in got[k]["sanitised"] and "term:0:8" in got[k]["spans"]
    assert sum(got[100 + k]["n_term"] for k in range(200)) == 0 and all(got[400 + k]["spans"] == "" for k in range(2000))


def test_pages(spark):
    page = "<html><body><nav>Menu</nav><div class='top'>Site name</div><div><p>Text {0} &amp; more<p>Second   {0}</div><div class=comments>Me too</div></body></html>"
    rows = [(k, f"http://h.example/a/{k}", page.format(k)) for k in range(4)] + [(9, None, None), (10, "x", "<article><h1>T</h1>b<br>c<aside>no</aside></article>rest"), (11, "http://[bad", "<p>a")]
    got = {r["page_id"]: r for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Text 1 & more\nSecond 1" and got[9]["text"] == "" and got[10]["text"] == "T\nb c" and got[11]["text"] == "a"
    assert html.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_with_notices_inside_the_article(spark):
    page = "<html><body><nav>Menu</nav><article><h1>Title {0}</h1><p>Share this page with a friend</p><p>{1}</p><p>{2}</p></article></body></html>"
    rows = [(k, f"http://h.example/a/{k}", page.format(k, *(" ".join(RNG.choice(WORDS) for _ in range(30)) for _ in range(2)))) for k in range(4)]
    rows += [(10 + k, f"http://copies.example/a/{k}", f"<article><p>{BASE}</p><p>{BASE} more</p></article><p>Visitor {k}</p>") for k in range(3)]
    got = {r["page_id"]: r["text"].split("\n") for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k][0] == f"Title {k}" and len(got[k]) == 3 and "Share this page with a friend" not in got[k] for k in range(4))
    assert all(got[10 + k] == [BASE, BASE + " more"] for k in range(3))


def test_pages_of_templates_and_copies(spark):
    def said(k):
        rng = random.Random(k)
        return "".join(f"<p>{' '.join(rng.choice(WORDS) for _ in range(25))}</p>" for _ in range(3))

    frame = "<body>" + "".join(f"<div>Offer {k} of this site</div>" for k in range(40)) + "{}</body>"
    rows = [(k, f"http://t.example/a/{k}", frame.format(said(k))) for k in range(4)]
    rows += [(100 + k, f"http://r.example/a?page={k:03d}", "<div>Site name</div>" + said(k // 50)) for k in range(100)]
    rows += [(300 + k, f"http://c.example/a/{k}", f"{said(1) * 5}<p>Visitor {k}</p>") for k in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"].split("\n") for r in html.extract_text(pages).collect()}
    assert all(len(got[k]) == 3 and not any("Offer" in x for x in got[k]) for k in range(4))
    assert all(len(got[100 + k]) == 3 and "Site name" not in got[100 + k] for k in range(100))
    assert all(len(got[300 + k]) == 16 for k in range(3))


def test_language(spark, edge, empty):
    rows = [(k, " ".join(RNG.choice(v) for _ in range(20)), lang) for k in range(400) for lang, v in [RNG.choice([("en", ["the", "and", "thing"]), ("de", ["der", "und", "ding"]), ("fr", ["le", "et", "chose"])])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn_languages(docs)
    got = {r["doc_id"]: r for r in language.identify_languages(docs.drop("lang"), model).collect()}
    assert all(got[k]["lang_pred"] == lang and 0 <= got[k]["score"] <= 1 for k, _, lang in rows)
    marked = {(r["doc_id"], r["lang_pred"]) for r in language.identify_languages(edge, model).collect()}
    assert {(1, "und"), (2, "und"), (10, "und")} <= marked
    assert language.identify_languages(edge, language.learn_languages(empty)).where("lang_pred <> 'und'").count() == 0
    assert np.array_equal(np.sort(np.abs(language.codewords(4)[0] - language.codewords(4)[1]))[-4:], [2, 2, 2, 2])


def test_pipeline_keeps_columns(spark, edge, tmp_path):
    import corpus_pipeline

    _labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "of no document")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sizes = edge.select("doc_id", "text", "lang", "source", "n_chars"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = Scratch(spark, "t").save(out, name.replace(" ", "-"))
        sizes.append(docs.count())
    assert sizes[0] == 8 and sizes[1] == sizes[2] == 4


def test_pipeline_rows_without_ids(spark, tmp_path):
    import corpus_pipeline

    texts = [" ".join(RNG.choice(WORDS) for _ in range(60)) for _ in range(12)]
    rows = [(None if k < 6 else 7 if k < 9 else k, t, "en", "a", len(t)) for k, t in enumerate(texts)] + [(None, texts[11] + " more", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r["text"] for r in kept.collect()) == sorted(texts)
    spark.createDataFrame([(1, texts[0]), (2, texts[7])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.drop_benchmark(spark, kept, str(tmp_path))
    assert sorted(r["text"] for r in clean.collect()) == sorted(t for k, t in enumerate(texts) if k not in (0, 7))


def test_fine_points_bound_the_overlap():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 255, 256, 257, 1000, 5000, 40_000):
        shared = rng.integers(0, 2**64, n, np.uint64)
        for more in (0, 1, n // 4, n // 3):
            x, y = np.unique(shared), np.unique(np.concatenate([shared, rng.integers(0, 2**64, more, np.uint64)]))
            p, q = (np.frombuffer(jaccard.fine_point(s), np.uint8) for s in (x, y))
            assert p.sum(dtype=np.int64) == len(x) and q.sum(dtype=np.int64) == len(y)
            assert jaccard.fine_overlap(p, q) == jaccard.fine_overlap(q, p) >= len(np.intersect1d(x, y))
        other = np.unique(rng.integers(0, 2**64, n, np.uint64))
        if n >= 1000:
            assert jaccard.fine_overlap(np.frombuffer(jaccard.fine_point(x), np.uint8), np.frombuffer(jaccard.fine_point(other), np.uint8)) < jaccard._needed(len(x), n)
    assert jaccard.fine_point(np.arange(256, dtype=np.uint64)) == b""
