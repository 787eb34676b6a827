import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import language as module
from tidewright.llm.language import Model, _scores, document_languages, fit, grams, identify, in_known_language, page_languages


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    fold = docs.where("doc_id % 2 = 0")
    model = fit(fold, sample=100)
    none = F.lit(None).cast("string")
    rest = docs.where("doc_id % 2 = 1")
    got = identify(rest, model, ["doc_id", "lang"], F.col("text"), none, none, F.col("source"), none).collect()
    right = [r for r in got if r.language == r.lang]
    assert len(got) == rest.count() and len(right) > 0.97 * len(got)
    assert sum(r.kept for r in got) > 0.99 * len(got)


def test_scores_are_sums_over_grams(spark):
    rng = np.random.default_rng(1)
    model = Model(["a", "b"], rng.integers(0, 9, (2, 1 << 16)))
    texts = ["", "ab", "abc", "Hello, World! 123 été", None, "x" * 5000, " \n ", "the end of it all " * 400]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "text"])
    for step in (1 << 20, 64):
        out = next(_scores(iter([batch]), model, step))
        for t, n, like in zip(texts, out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True):
            g = grams(np.frombuffer((t or "").encode(), np.uint8))
            assert np.allclose(like, model.table[g].astype(float).sum(axis=0), atol=1e-3)
            assert n == (model.table[g] != 0).any(axis=1).sum()


def test_evidence_decides_where_the_text_is_even(spark):
    en, fr = "the house of the king is on the hill with the old tree ", "la maison du roi est sur la colline avec le vieil arbre "
    rows = [(i, en * 3, "en", "e.org") for i in range(30)] + [(100 + i, fr * 3, "fr", "f.org") for i in range(30)]
    rows += [(200, "taxi", "en", "e.org"), (201, "taxi", "fr", "f.org"), (202, "taxi", None, "f.org"), (203, "taxi", None, "e.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.language for r in document_languages(docs).collect()}
    assert [got[i] for i in (200, 201, 202, 203, 0, 100)] == ["en", "fr", "fr", "en", "en", "fr"]


def test_edge_cases(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en", "s") for i in range(8)]
    rows += [(20, None, "en", "s"), (21, "", None, None), (22, "1234 !!", "en", None), (None, "the cat and the dog", None, None), (24, "the " * 50_000, "xx", "s"), (24, "the cat", "en", "s"), (25, "A.", "en", "s")]
    docs = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, lang string, source string, kept string, n int")
    got = document_languages(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if not r.kept} == {20, 21, 22} and all(r.language == (None if r.declared == "xx" else "en") for r in got if r.kept)
    left = in_known_language(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - 3
    assert document_languages(docs.limit(0)).collect() == [] and in_known_language(docs.limit(0)).collect() == []
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert not any(r.kept for r in document_languages(bare).collect())


def test_pages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    got = page_languages(pages, docs).collect()
    assert len(got) == pages.count() and sum(r.language == r.declared for r in got) > 0.9 * len(got)
    odd = spark.createDataFrame([(None, None, None), (1, "", ""), (2, "x", "<html lang=fr><p>la maison"), (3, "http://h/", "<html>")], "page_id long, url string, html string")
    assert len(page_languages(odd, docs).collect()) == 4


def plain_fusion(rows, model):
    """rows: key, text, declared, suffix, host, domain -> key: language, posterior, kept; dictionaries and sums, one document at a time."""
    import math

    k = len(model.languages)

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    likes, counts, soft = {}, {}, {}
    for key, text, *_ in rows:
        own = [g for g in grams(np.frombuffer(b" " + (text or "").encode() + b" ", np.uint8)).tolist() if g != module._blank()]
        likes[key], counts[key] = [math.fsum(float(model.table[g][j]) for g in own) for j in range(k)], len(own)
        soft[key] = softmax([v * module.TEMPER for v in likes[key]]) if own else [0.0] * k
    total = lambda of: [math.fsum(c) for c in zip(*(soft[x] for x in of), strict=True)] or [0.0] * k
    whole = [v + module.EVEN for v in total(likes)]
    out = {}
    for key, _, declared, suffix, host, domain in rows:
        if not counts[key]:
            out[key] = (None, None, False)
            continue
        score = [v * module.TEMPER for v in likes[key]]
        prior = [v / sum(whole) for v in whole]
        for value, at, strength in ((domain, lambda r: r[5] == domain, module.DOMAIN), (host, lambda r: r[4] == host and r[5] == domain, module.HOST)):
            rest = [0.0] * k if value is None else [max(0.0, a - b) for a, b in zip(total(r[0] for r in rows if at(r)), soft[key], strict=True)]
            prior = [(c + strength * p) / (sum(rest) + strength) for c, p in zip(rest, prior, strict=True)]
        score = [a + math.log(p) for a, p in zip(score, prior, strict=True)]
        for value, place in ((declared, 2), (suffix, 3)):
            if value is not None:
                held = total(r[0] for r in rows if r[place] == value)
                score = [a + math.log((c + 0.1 * module.EVEN) / w) for a, c, w in zip(score, held, whole, strict=True)]
        post = softmax(score)
        likely = max(likes[key]) > counts[key] * -math.log(1 << module.BITS)
        out[key] = (model.languages[post.index(max(post))], max(post), likely and max(post) >= module.SURE)
    return out


def test_fusion_of_all_evidence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 = 0 or doc_id < 20")
    hosts = ["a.news.de", "b.news.de", "shop.com", "http://www.blog.fr/es/12", "plain", None]
    rows = [(r.doc_id, r.text[: 40 if r.doc_id % 2 else 4000], r.lang if r.doc_id % 5 else None, hosts[r.doc_id % 6], 1) for r in docs.collect()]
    rows += [(10_000, "xyz", None, "shop.com", 2), (10_001, "", "en", "a.news.de", 3), (10_002, None, None, None, 4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, suffix int")
    model = module.fit(table)
    places = {"a.news.de": ("de", "a.news.de", "news.de"), "b.news.de": ("de", "b.news.de", "news.de"), "shop.com": ("com", "shop.com", "shop.com"), "http://www.blog.fr/es/12": ("es", "www.blog.fr", "blog.fr"), "plain": (None, "plain", None), None: (None, None, None)}
    want = plain_fusion([(d, t, lang, *places[s]) for d, t, lang, s, _ in rows], model)
    got = {r.doc_id: r for r in module.document_languages(table).collect()}
    assert got.keys() == want.keys()
    for d, (language, posterior, kept) in want.items():
        assert (got[d].language, got[d].kept) == (language, kept), d
        assert language is None or got[d].posterior == pytest.approx(posterior, abs=1e-6)


def test_pages_fuse_the_same(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(60)
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, rows = module.fit(labelled), []
    for r in pages.collect():
        text = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>|<[^>]*>", " ", r.html or "")
        m, u = re.search(r"(?i)<html[^>]*?\blang=[\"']?([a-z]{2})", r.html or ""), re.match(r"[a-z]+://([^/:?#]+)(?::\d+)?(?:/([A-Za-z]{2})(?=/|$))?", r.url or "")
        host = u[1].lower() if u else None
        rows.append((r.page_id, text, m and m[1].lower(), (u[2] or host.rsplit(".", 1)[1]).lower() if u else None, host, ".".join(host.split(".")[-2:]) if u else None))
    want = plain_fusion(rows, model)
    got = {r.page_id: r for r in module.page_languages(pages, labelled).collect()}
    assert {i: (r.language, r.kept) for i, r in got.items()} == {i: (w[0], w[2]) for i, w in want.items()}
    assert all(got[i].posterior == pytest.approx(w[1], abs=1e-6) for i, w in want.items() if w[0])


def test_odd_pages(spark, sf_dir):
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    page = "<html lang=en><body>" + labelled.where("lang = 'en'").first().text[:300] + "</body></html>"
    rows = [(1, "http://x.com/en/1", page), (1, "http://x.com/en/1", page), (None, None, page), (3, "not an address", None), (4, "http://", ""), (5, "https://y.de:80/a", "<br>" * 50_000)]
    pages = spark.createDataFrame([(*r, "z", 0.1) for r in rows], "page_id long, url string, html string, declared string, posterior double")
    got = module.page_languages(pages, labelled).collect()
    assert sorted((r.page_id or 0, r.language or "", r.kept) for r in got) == [(0, "en", True), (1, "en", True), (1, "en", True), (3, "", False), (4, "", False), (5, "", False)]
    assert module.page_languages(pages.limit(0), labelled).collect() == []
    assert {r.kept for r in module.page_languages(pages, labelled.limit(0)).collect()} == {False}


def test_rare_and_countless_languages(spark, monkeypatch):
    rng = np.random.default_rng(4)
    letters = {lang: "".join(rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:9]) for lang in ("aa", "bb", "cc", "dd")}
    text = lambda lang: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(60))
    rows = [(i, text(lang), lang, "s") for i, lang in enumerate(["aa"] * 30 + ["bb"] * 20 + ["cc"] * 10 + ["dd"] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for most, known in ((256, "aa bb cc"), (2, "aa bb")):
        monkeypatch.setattr(module, "LANGUAGES", most)
        got = module.document_languages(docs).collect()
        assert all(r.kept and r.language == (r.declared if r.declared in known else None) for r in got)
