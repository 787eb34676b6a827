import hashlib
import random

import numpy as np

from tidewright.llm.anchors import all_anchors
from tidewright.llm.repeats import LENGTH, longest_previous_factors, repeat_digests, suffix_order, without_repeats


def brute(rows, length=LENGTH):
    texts = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in texts:
        for i in range(len(t) - length + 1):
            k = t[i : i + length]
            n = (d is None, d or 0)
            least[k] = min(n, least.get(k, n))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < (d is None, d or 0):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_same_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in repeat_digests(docs).collect()), key=repr)
    assert got == brute(rows) and sum(r[2] for r in got) > 1000
    kept = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in without_repeats(docs).collect()}
    assert kept == {r[0]: r[4] for r in got}


def test_edge_cases(spark):
    rng = random.Random(2)
    p = "".join(rng.choice("abcdé ") for _ in range(400))
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 300), (5, "x" * 300), (6, "y" + "x" * 50 + "y"), (8, p), (8, p), (8, p[:100]), (9, "q" + p[50:] + "é" * 100),
            (None, p), (None, p + "z"), (10, p[:60] + p[61:]), (11, p + p), (12, "ab" * 3000), (13, "ba" * 3000), (7, "ab" * 40)]
    docs = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, d int, ranges binary")
    assert sorted((tuple(r) for r in repeat_digests(docs).collect()), key=repr) == brute(rows)
    assert repeat_digests(docs.limit(0)).collect() == []


def test_random_strings_of_few_letters(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("ab") for _ in range(3000))
    rows = []
    for d in range(60):
        t = ""
        for _ in range(rng.randint(0, 8)):
            a = rng.randrange(2900)
            t += base[a : a + rng.randint(1, 120)] + rng.choice(["", "c", "ab"])
        rows.append((rng.randrange(40), t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in repeat_digests(docs).collect()), key=repr) == brute(rows)


def test_anchors_cover_each_window_once():
    rng = np.random.default_rng(1)
    lens = [0, 10, 50, 51, 3000, 49, 200]
    data = rng.integers(97, 99, sum(lens)).astype(np.uint8)
    ends = np.r_[0, np.cumsum(lens)]
    place, h, first, count = all_anchors(data, ends, 50)
    own = np.concatenate([np.arange(a, a + c) for a, c in zip(first, count, strict=True)])
    assert sorted(own) == [i for a, n in zip(ends, lens, strict=False) for i in range(a, a + n - 49)]
    assert (place >= first + count - 1).all() and (place + 16 <= first + 50).all()
    windows = {}
    for a, c, p, x in zip(first, count, place, h, strict=True):
        for i in range(a, a + c):
            assert windows.setdefault(data[i : i + 50].tobytes(), (p - i, x)) == (p - i, x)


def test_long_documents_are_taken_in_pieces():
    rng = np.random.default_rng(2)
    lens = [700, 0, 49, 50, 1300, 51, 260, 261]
    data, ends = rng.integers(97, 103, sum(lens)).astype(np.uint8), np.r_[0, np.cumsum(lens)]

    def windows(limit):
        place, h, first, count = all_anchors(data, ends, 50, limit)
        return sorted((int(i), int(p), int(x)) for p, x, a, c in zip(place, h, first, count, strict=True) for i in range(a, a + c))

    whole = windows(1 << 22)
    assert whole == windows(256) == windows(100) and len(whole) == sum(max(0, n - 49) for n in lens)


def strings(seed, letters, n, most):
    """Strings of few letters, an end behind each: text, places, bytes left at each."""
    rng = random.Random(seed)
    own = [bytes(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n)]
    text = np.frombuffer(b"".join(x + b"\xff" for x in own), np.uint8)
    places = np.flatnonzero(text != 255)
    ends = np.flatnonzero(text == 255)
    return text, places, ends[np.searchsorted(ends, places)] - places, np.searchsorted(ends, places)


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_suffix_order():
    for seed in range(40):
        text, places, left, _ = strings(seed, b"ab" if seed % 2 else b"abcdef", 6, 90)
        order, same = suffix_order(text, places, left)
        raw = [text[p : p + n].tobytes() for p, n in zip(places[order].tolist(), left[order].tolist(), strict=True)]
        assert [x + b"\xff" for x in raw] == sorted(x + b"\xff" for x in raw)
        assert same.tolist() == [0, *(common(a, b) for a, b in zip(raw, raw[1:], strict=False))]


def test_longest_previous_factors():
    rng = np.random.default_rng(3)
    for seed in range(40):
        text, places, left, of = strings(seed, b"ab" if seed % 2 else b"abc", 8, 60)
        doc = rng.permutation(8)[of] if seed % 3 else rng.integers(0, 3, 8)[of]
        raw = [text[p : p + n].tobytes() for p, n in zip(places.tolist(), left.tolist(), strict=True)]
        want = [max((common(raw[i], raw[j]) for j in np.flatnonzero(doc < doc[i])), default=0) for i in range(len(places))]
        for length in (1, 5, 12):
            got = longest_previous_factors(text, places, left, doc, length)
            assert got.tolist() == [w if w >= length else 0 for w in want]
    assert len(longest_previous_factors(text, places[:0], left[:0], places[:0], 5)) == 0


def test_factors_of_steps():
    # Documents that rise, and then fall below all of them: what points on one by one must end too.
    text = np.frombuffer(b"abcdefghij\xff" * 3000, np.uint8)
    places = np.arange(3000) * 11
    doc = np.r_[np.arange(1, 2001), np.zeros(1000, int)]
    got = longest_previous_factors(text, places, np.full(3000, 10), doc, 5)
    assert got.tolist() == [10 if d else 0 for d in doc.tolist()]
