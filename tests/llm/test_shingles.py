import itertools

import numpy as np

import corpus_pipeline
from tidewright.llm.shingles import like, without_near_duplicates


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute_firsts(rows):
    """The smallest id of each group that pairs with a similarity of 0.8 or more connect."""
    sets = {d: shingles(x) for d, x in rows}
    up = {d: d for d in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if 5 * small < 4 * large:
            continue
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (small + large - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return sorted({find(d) for d in sets})


def test_stage_drops_all_pairs_at_four_fifths(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng, base = np.random.default_rng(4), 10_000_000
    for k, (_, text) in enumerate(x for x in rows[:400] if 60 <= len((x[1] or "").split()) <= 600):
        words = text.split()
        for at in rng.choice(len(words), max(1, len(words) // 50), replace=False):  # similarities on both sides of 0.8
            words[at] = f"z{k}"
        rows.append((base + k, " ".join(words)))
    docs = spark.createDataFrame([(d, x, "en", "s", 0) for d, x in rows], docs.schema)
    got = corpus_pipeline.STAGES[1][1](spark, docs, sf_dir)
    assert got.columns == docs.columns
    got, want = sorted(r.doc_id for r in got.collect()), brute_firsts(rows)
    assert got == want, f"{len(set(got) - set(want))} more, {len(set(want) - set(got))} fewer of {len(want)}"


def test_edge_cases(spark):
    rows = [(1, "a b c d", 0), (1, "a b c d", 0), (2, "A b  c d", 0), (3, None, 0), (4, "", 0), (None, "x y z", 0), (None, "x y z", 1), (None, "A b c d", 0), (5, "a b c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d int")
    got = without_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == [(-1, "x y z"), (1, "a b c d"), (3, ""), (5, "a b c")]
    assert without_near_duplicates(docs.limit(0)).collect() == []


def test_like_spans_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(24, rng.integers(14, 23), replace=False).astype(np.uint64)) for _ in range(200)]
    pairs = [(i, j) for i, j in itertools.combinations(range(200), 2) if 5 * len(b := np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - len(b))]

    def roots(links):
        label = np.arange(200)
        for i, j in links:
            label[label == label[j]] = label[i]
        return {tuple(np.flatnonzero(label == x)) for x in label}

    assert roots(like(sets)) == roots(pairs) and set(like(sets)) <= set(pairs)


def test_fingerprints_within_the_radius_share_a_covering_key():
    rng = np.random.default_rng(2)
    from tidewright.llm import shingles
    from tidewright.llm.simhash import masks

    for _ in range(200):
        fp = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        other = fp ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64))
        keys = [shingles.covering_keys([[int(x[0])]])[0] for x in (fp, other)]
        assert len(keys[0]) == len(masks()) and (keys[0] == keys[1]).any()
