import random

import public_tokenizers as P
import pytest

from tidewright.llm.counts import count_batch, count_spliced, token_counts
from tidewright.llm.encoding import count_tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


def texts(seed):
    rng = random.Random(seed)
    parts = ["the", " ", "\n", "  \n", "don't", "naïve", "été", "<|endoftext|>", "日本語", "😀😀", " ", "\t", "a" * 300, "1234567", "!!!", "é", " x", "...", "\x1c"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 300))) for _ in range(12)]


@pytest.mark.parametrize("file", FILES)
def test_chunks_give_the_counts_of_whole_texts(file):
    path = P.path(file)
    for seed in range(2):
        own = texts(seed)
        want = count_tokens(path, own)
        for chunk, overlap in ((200, 20), (900, 64)):
            assert [count_spliced(path, t, chunk, overlap) for t in own] == want
            assert count_batch(path, own, chunk, overlap).tolist() == want


@pytest.mark.parametrize("file", FILES[:2])
def test_no_boundary_at_all_widens_to_the_whole(file):
    path = P.path(file)
    for text in ("ab" * 5000, "é" * 3000, " " * 4000, "\n" * 999 + "x" * 999, "!" * 5000):
        assert count_spliced(path, text, 300, 16) == count_tokens(path, [text])[0]


SCRIPTS = ["the ", "don't ", "été", ", ", "\n", "  ", "한국어", "क्षि", "「x」", "...", "👍🏽", "12 ", "'s", "e\u0301", "ß)", "日本。", "語、", "ไทย", "\u200d", "«da»", "۱۲۳", "_a_", "x’s"]


@pytest.mark.parametrize("file", FILES)
def test_many_scripts(file):
    path, rng = P.path(file), random.Random(8)
    own = ["".join(rng.choices(SCRIPTS, k=rng.randint(50, 900))) for _ in range(60)]
    for chunk, overlap in ((64, 16), (300, 16)):
        assert [count_spliced(path, t, chunk, overlap) for t in own] == count_tokens(path, own)


def test_long_runs_are_encoded_about_once(monkeypatch):
    from tidewright.llm import counts

    path, rng, seen = P.path(FILES[0]), random.Random(9), []
    made = counts._Json.__init__
    monkeypatch.setattr(counts._Json, "__init__", lambda self, path, text: (seen.append(len(text)), made(self, path, text))[1])
    ideographs = [chr(0x4E00 + i) for i in range(2000)]
    for draw in (lambda: rng.choice(ideographs), lambda: rng.choice("abcdefgh0123"), lambda: rng.choice(ideographs) + rng.choice(["", "", "", "。"])):
        text = "".join(draw() for _ in range(1_000_000))
        seen.clear()
        assert count_spliced(path, text) == count_tokens(path, [text])[0]
        assert sum(seen) < 3 * len(text)


def test_rows(spark, sf_dir):
    rows = [(1, None), (None, ""), (2, "Hello <|endoftext|> été"), (2, "Hello <|endoftext|> été"), (3, "word " * 30_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    path = P.path(FILES[0])
    want = [(d, len((t or "").encode()), n, n > 512) for (d, t), n in zip(rows, count_tokens(path, [t or "" for _, t in rows]), strict=True)]
    assert sorted(map(repr, (tuple(r) for r in token_counts(docs, path).collect()))) == sorted(map(repr, want))
    assert token_counts(docs.limit(0), path).collect() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, path, chunk=3000, overlap=64).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], count_tokens(path, [r.text or "" for r in rows]), strict=True))
