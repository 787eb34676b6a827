import itertools
import random

import numpy as np
import xxhash

from tidewright.llm.simhash import _Forest, _link_run, fingerprint_texts, masks, simhash_components

SCHEMA = "doc_id long, text string, fp int, rep string"


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
            a, b = sorted((find(i), find(j)))
            up[b] = a
    low = {}
    for i, (d, _) in enumerate(prints):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, f"{f:016x}", low[find(i)]) for i, (d, f) in enumerate(prints))


def test_same_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in simhash_components(docs).collect())
    assert got == brute_components(rows)


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "one"), (8, "One"), (7, "one two"), (7, "one two"), (2, "ÀB cd ef gh ij"), (1, "x " * 50_000)]
    docs = spark.createDataFrame([(*r, 0, "r") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in simhash_components(docs).collect()) == brute_components(rows)
    assert simhash_components(docs.limit(0)).collect() == []
    nulls = simhash_components(spark.createDataFrame([(None, "a", 0, "r"), (6, "a", 0, "r"), (None, "b c", 0, "r")], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in nulls) == [(-1, -1), (-1, 6), (6, 6)]


def test_masks_cover_every_pair_of_positions():
    table = [int(m) for m in masks()]
    assert len(table) == 15
    for bits in itertools.chain.from_iterable(itertools.combinations(range(64), k) for k in (1, 2, 3)):
        x = sum(1 << b for b in bits)
        assert any(m & x == 0 for m in table)


def test_dense_run_finds_all_links():
    rng = random.Random(3)
    fp = list({sum(1 << b for b in rng.sample(range(14), rng.randint(0, 14))) for _ in range(9000)})
    fp = np.array(fp, np.uint64)
    whole = _Forest(len(fp))
    _link_run(fp, np.arange(len(fp)), list(range(64)), whole)
    plain = _Forest(len(fp))
    for d in range(1, len(fp)):
        near = np.flatnonzero(np.bitwise_count(fp[d:] ^ fp[:-d]) <= 3)
        plain.join(near, near + d)
    assert (whole.roots() == plain.roots()).all()


def test_long_chain_of_links(spark):
    from tidewright.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(400, 401), (401, 400), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, 400: 400, 401: 400}


def test_bit_needs_more_than_half():
    assert fingerprint_texts([b"", b"a"]).tolist() == [0, xxhash.xxh64_intdigest(b"a", 42)]
