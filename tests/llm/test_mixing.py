import re

import pytest

from tidewright.llm.mixing import mix, mix_sizes

SCHEMA = "doc_id long, text string, source string, size int, copies string, target double"


def filled(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * (left - sum(full.values())) / total > 2 * sizes[s]]
        if not over:
            return {**full, **{s: w[s] * (left - sum(full.values())) / total for s in open_}}
        full |= {s: 2.0 * sizes[s] for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_words_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    got = mix_sizes(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sizes(docs.repartition(13)).collect()))
    text = {r.doc_id: r for r in docs.collect()}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = text[r.doc_id].source
        assert r["size"] == words(text[r.doc_id].text) and r.taken in (0, r["size"], 2 * r["size"])
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r.taken, r.target
    want = filled(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(30, 0.01 * target[s])
    rows = mix(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {r.doc_id: r.taken // r["size"] for r in got if r.taken}


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y z", "b"), (None, "x y", "b"), (4, "one\x0btwo\x1cthree", None), (5, "w " * 40_000, "b"), (6, "p q", "c"), (6, "p q", "c")]
    docs = spark.createDataFrame([(*r, 9, "k", 0.5) for r in rows], SCHEMA)
    got = mix_sizes(docs).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 2, 2, 3, 40_000]
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert mix(docs).columns == docs.columns
    assert mix_sizes(docs.limit(0)).collect() == [] and mix(docs.limit(0)).collect() == []


def test_whole_copies_when_the_share_is_two(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", 1, "", 0.0) for i in range(50)], SCHEMA)
    assert {r.taken for r in mix_sizes(docs, share=2.0).collect()} == {6}
    assert {r.taken for r in mix_sizes(docs, share=1.0).collect()} == {3}
    assert sum(r.taken for r in mix_sizes(docs, share=0.5).collect()) == 75


def test_certain_documents_are_taken_out_before_the_rest_is_scaled(spark):
    # One document of 3,000 words is worth far more than what its share of the rest leaves; the others share what it leaves.
    rows = [(0, "w " * 3000, "a")] + [(i, "w " * 3, "a") for i in range(1, 1001)]
    docs = spark.createDataFrame([(*r, 0, "", 0.0) for r in rows], SCHEMA)
    for share in (0.6, 0.75, 0.9):
        got = {r.doc_id: (r.taken, r["size"]) for r in mix_sizes(docs, share=share).collect()}
        assert got[0][0] == 3000
        assert abs(sum(t for t, _ in got.values()) - share * 6000) <= 3


def test_one_source_with_rows_at_one_place(spark):
    rows = [(None, "same text of six words here", "a")] * 400 + [(i, "w " * (i % 40 + 1), "a") for i in range(300)] + [(7, "again", None)] * 9
    docs = spark.createDataFrame([(*r, 0, "", 0.0) for r in rows], SCHEMA)
    got = mix_sizes(docs.repartition(5), share=1.0).collect()
    assert len(got) == len(rows) and len({r.taken for r in got if r.doc_id is None}) == 1
    taken = sum(r.taken for r in got if r["source_size"] > 100)
    target = next(r.target for r in got if r["source_size"] > 100)
    assert taken <= target + 1e-6 and target - taken <= 2400  # equal rows go together


def test_larger_documents_are_taken_more_often(spark):
    rows = [(i, "w " * (5 if i % 2 else 80), "a", 0, "", 0.0) for i in range(4000)]
    got = mix_sizes(spark.createDataFrame(rows, SCHEMA), share=0.5).collect()
    odds = [sum(r.taken > 0 for r in got if r["size"] == n) / 2000 for n in (5, 80)]
    # worth 47 and 444: in proportion, and half of all words in all
    assert odds[1] / odds[0] == pytest.approx(444 / 47, rel=0.2) and sum(r.taken for r in got) == pytest.approx(85_000, abs=80)
