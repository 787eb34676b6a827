import numpy as np

from tidewright.llm.leaks import leak_pairs, weighted_lcs, without_leaks, words_of


def test_planted_passages_are_found(spark, sf_dir):
    """Every item of which a document has all words in order, and no other pair without a third of its 5-grams."""
    base = sf_dir.replace("0.001", "0.01")
    docs, bench = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet")
    items = {r.item_id: words_of(r.text) for r in bench.collect()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    item_grams = {i: grams(w) for i, w in items.items()}
    whole, some = set(), set()
    for r in docs.collect():
        own = grams(words_of(r.text or ""))
        for i, g in item_grams.items():
            if g <= own:
                whole.add((r.doc_id, i))
            if len(g & own) > len(g) / 3:
                some.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in leak_pairs(docs, bench).collect()}
    assert whole and whole <= got <= some
    left = {r.doc_id for r in without_leaks(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_paraphrase_and_edge_cases(spark):
    item = "which planet of the solar system has the largest storm known as the great red spot answer jupiter the giant"
    changed = "tell me which planet in the solar system has a largest storm that is known as the great red spot the answer is jupiter the giant okay"
    filler = [(100 + i, " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(200))) for i in range(60)]
    rows = [(1, item), (2, changed), (3, None), (4, ""), (5, "... !!"), (6, "planet storm jupiter"), (None, item), (7, "x " * 30_000 + item + " y" * 500), (7, "x"), *filler]
    docs = spark.createDataFrame([(*r, 0, "t") for r in rows], "doc_id long, text string, item_id int, t string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, ""), (None, "x y"), (12, "red green blue " * 400)], "item_id long, text string")
    assert sorted((r.doc_id or -1, r.item_id) for r in leak_pairs(docs, bench).collect()) == [(-1, 9), (1, 9), (2, 9), (7, 9)]
    assert sorted((r.doc_id, r.text) for r in without_leaks(docs, bench).where("doc_id < 100").collect() if r.text) == [(5, "... !!"), (6, "planet storm jupiter"), (7, "x")]
    assert leak_pairs(docs.limit(0), bench).collect() == [] and leak_pairs(docs, bench.limit(0)).collect() == []
    assert without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_blocks_and_chunks_give_the_same(spark, sf_dir, monkeypatch):
    from tidewright.llm import leaks

    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(r.doc_id, r.item_id) for r in leak_pairs(docs, bench).collect()}
    monkeypatch.setattr(leaks, "BLOCK", 7)
    monkeypatch.setattr(leaks, "CHUNK", 2)
    assert {(r.doc_id, r.item_id) for r in leak_pairs(docs, bench).collect()} == want and want


def test_weighted_lcs():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b, w = rng.integers(0, 5, 12), rng.integers(0, 5, 15), rng.random(5)
        t = np.zeros((13, 16))
        for i in range(12):
            for j in range(15):
                t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + w[a[i]] if a[i] == b[j] else 0)
        assert abs(weighted_lcs(a, b, w) - t[-1, -1]) < 1e-12


def test_all_windows_that_pass_the_checks_are_found(spark):
    """Short items put whole or with words dropped into documents, beside one long item that makes windows wide; each window is checked in plain Python."""
    from tidewright.llm import leaks

    rng = np.random.default_rng(5)
    draw = lambda n: [f"v{int(x)}" for x in rng.integers(0, 1500, n)]
    items = {i: draw(15) for i in range(239)} | {239: draw(256)}
    texts = {}
    for d in range(300):
        texts[d] = draw(700)
        if d < 239:
            texts[d][300:300] = [w for w in items[d] if d % 2 or rng.random() > 0.2]
    n, df = len(texts), {}
    for own in texts.values():
        for w in set(own):
            df[w] = df.get(w, 0) + 1
    code = {w: k for k, w in enumerate(dict.fromkeys(w for x in items.values() for w in x))}
    idf = np.array([np.log((1 + n) / (1 + df.get(w, 0))) + 0.05 for w in code])
    coded = {i: np.array([code[w] for w in words]) for i, words in items.items()}
    want = set()
    for d, own in texts.items():
        seq = np.array([code.get(w, -1) for w in own])
        for at in range(-256, len(own), 256):
            window = seq[max(0, at) : at + 512]
            window = window[window >= 0]
            some = np.zeros(len(code), bool)
            some[window] = True
            for i, a in coded.items():
                whole, tail = idf[a].sum(), a[-(len(a) // 3) :]
                if idf[a][some[a]].sum() < leaks.SHARE * whole or (share := weighted_lcs(a, window, idf) / whole) < leaks.SHARE:
                    continue
                if share >= leaks.PLAIN or weighted_lcs(tail, window, idf) / idf[tail].sum() >= leaks.ANSWER:
                    want.add((d, i))
    assert {(d, d) for d in range(1, 239, 2)} <= want
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leak_pairs(docs, bench).collect()}
    assert got == want, f"{len(want - got)} of {len(want)} lost, {len(got - want)} more"


def test_long_items_are_judged_whole(spark):
    """An item of 257 words, whose last word stands in many documents, and one of 700; documents with all, most or one part of them."""
    rng = np.random.default_rng(8)
    draw = lambda n, a: [f"{a}{int(x)}" for x in rng.integers(0, 400, n)]
    short, long = [*draw(256, "s"), "plain"], draw(700, "l")
    most = [w for w in long if rng.random() > 0.25]
    texts = {1: short, 2: long, 3: most, 4: long[:256], 5: long[444:], 6: short[:100], 7: [*short[:128], *short[129:]]}
    texts = {d: [*draw(300, "f"), *x, *draw(300, "f")] for d, x in texts.items()} | {100 + d: [*draw(150, "f"), "plain", *draw(150, "f")] for d in range(80)}
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id long, text string")
    got = leak_pairs(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2), (3, 2), (7, 1)]
    assert all(abs(r.share - 1) < 1e-9 and abs(r.answer - 1) < 1e-9 for r in got if r.doc_id < 3)


def test_recall_of_paraphrases(spark):
    """Items whose last third stands as it is, while up to half of the words before it are other ones or exchanged; documents of the same words otherwise."""
    rng = np.random.default_rng(12)
    draw = lambda n: [f"c{int(x)}" if x < 20 else f"v{int(y)}" for x, y in zip(rng.integers(0, 50, n), rng.integers(0, 3000, n), strict=True)]
    items, texts = {i: draw(36) for i in range(120)}, {}
    for d in range(400):
        texts[d] = draw(500)
        if d < 120:
            words = list(items[d])
            for k in rng.choice(24, 10, replace=False):
                words[k] = draw(1)[0]
            words[3], words[4] = words[4], words[3]
            texts[d][200:200] = words
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = leak_pairs(docs, bench).collect()
    assert len({(r.doc_id, r.item_id) for r in got if r.doc_id == r.item_id}) >= 0.9 * 120
    assert sum(r.doc_id != r.item_id for r in got) == 0
    assert sum(r.share < 0.6 for r in got) > 0  # some by their cosine alone
