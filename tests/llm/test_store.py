import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidewright.llm.encoding import WordEncoder
from tidewright.llm.store import MOST, crc_behind, cuts, merkle, read_store, token_store, write_store

PATH = P.path("word_bpe_49k.json")


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def want(rows):
    out, start = [], 0
    for d, t in rows:
        ids = np.array(ids_of(t), "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_same_as_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in token_store(docs, PATH, lower=True).collect()) == want(rows)


def test_edge_cases(spark):
    rows = [(-3, None), (1, ""), (2, "x " * 40_000), (7, "Été <|endoftext|> <|ENDOFTEXT|>"), (8, "same"), (8, "same"), (9, "a" * 5000)]
    docs = spark.createDataFrame([(t, d, 0, "p") for d, t in rows], "text string, doc_id long, row int, part string")
    assert sorted(tuple(r) for r in token_store(docs, PATH, lower=True).collect()) == want(rows)
    assert sorted(tuple(r) for r in token_store(docs, PATH, wide=True).collect()) == want(rows)
    assert token_store(docs.limit(0), PATH).collect() == []
    null = spark.createDataFrame([("b", None), ("a", 5)], "text string, doc_id long")
    assert [tuple(r)[:2] for r in token_store(null, PATH).collect()] == [(5, 0), (None, 2)]


def test_wrong_chunk_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five")], "doc_id long, text string")
    store = write_store(docs, str(tmp_path / "s"), PATH)
    packs = spark.read.parquet(f"{store}/packs")
    bad = packs.collect()
    spark.createDataFrame([(r.doc_id, r.n_tokens, r.digest, bytes(r.body[:-1]) + b"\x01" if r.kind == "chunk" else bytes(r.body), r.kind) for r in bad], packs.schema).write.mode("overwrite").partitionBy("kind").parquet(str(tmp_path / "t" / "packs"))
    for part in ("recipes", "manifest", "head"):
        spark.read.parquet(f"{store}/{part}").write.parquet(str(tmp_path / "t" / part))
    with pytest.raises(Exception, match="does not hold"):
        read_store(spark, str(tmp_path / "t")).collect()


@pytest.mark.parametrize("what", ["dropped", "swapped", "repeated", "renumbered", "part", "roots", "head"])
def test_changed_recipes_and_manifests_are_found(spark, tmp_path, what):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 5)) for i in range(40)], "doc_id long, text string")
    store, bad = write_store(docs, str(tmp_path / "s"), PATH), str(tmp_path / "t")
    tables = {t: spark.read.parquet(f"{store}/{t}") for t in ("packs", "recipes", "manifest", "head")}
    rows = {t: [r.asDict() for r in tables[t].collect()] for t in ("recipes", "manifest", "head")}
    recipes = sorted(rows["recipes"], key=lambda r: r["doc_id"])
    if what == "dropped":
        recipes.pop(17)
    elif what == "swapped":
        for key in ("recipe", "root", "n_tokens"):
            recipes[3][key], recipes[5][key] = recipes[5][key], recipes[3][key]
    elif what == "repeated":
        recipes.append(dict(recipes[9]))
    elif what == "renumbered":
        recipes[4]["doc_id"] = 400
    elif what == "part":
        recipes = [r for r in recipes if r["part"] != recipes[0]["part"]]
        rows["manifest"] = [r for r in rows["manifest"] if r["part"] != 0]
    elif what == "roots":
        for r in rows["manifest"]:
            r["root"] = b"0" * 16
    else:
        rows["head"][0]["tokens"] += 1
    rows["recipes"] = recipes
    for name, table in tables.items():
        out = spark.createDataFrame([tuple(r[c] for c in table.columns) for r in rows[name]], table.schema) if name in rows else table
        (out.write.partitionBy("kind") if name == "packs" else out.write).parquet(f"{bad}/{name}")
    assert read_store(spark, store).count() == 40
    with pytest.raises(ValueError, match="Merkle root|head|start"):
        read_store(spark, bad)


def test_words_of_many_scripts():
    blocks = [(0x20, 0x7F), (0x80, 0x250), (0x300, 0x370), (0x370, 0x530), (0x530, 0x800), (0x900, 0x1200), (0x1200, 0x2100), (0x2100, 0x3100), (0x3100, 0x5200), (0xA000, 0xAE00), (0xF900, 0x10000), (0x10000, 0x10400), (0x1D400, 0x1D800), (0x1F000, 0x1FB00), (0xE0000, 0xE01F0)]
    between, whole = [" ", "\n", "'s", "'", "<|startoftext|>", "A.", "é,", "\u0301", "\u200b", "x\u2019", "\u00a0"], Tokenizer.from_file(PATH)
    for seed in range(25):
        rng, texts = random.Random(seed), []
        for _ in range(60):
            own = [*rng.sample(blocks, rng.randint(1, 4)), (0x61, 0x7B), (0x61, 0x7B), (0x20, 0x40)]
            texts.append("".join(chr(rng.randrange(*rng.choice(own))) + (rng.choice(between) if rng.random() < 0.15 else "") for _ in range(rng.randint(1, 150))))
        for lower in (False, True):
            ids, counts = WordEncoder(PATH, lower, words=300)([t.encode() for t in texts])
            ends = np.r_[0, np.cumsum(counts)]
            for k, t in enumerate(texts):
                assert ids[ends[k] : ends[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(5)
    parts = ["the", " ", "\n", "don't", "I'LL", "naïve", "Été", "́", "<|endoftext|>", "日本", "😀", " ", "\t", "1234", "!!!", "a.", "b, ", "...", "\x1c", "\x85", "ΣΑΣ", "İ", "ß", "''s"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", ". ", ", "]) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    whole = Tokenizer.from_file(PATH)
    for lower in (False, True):
        ids, counts = WordEncoder(PATH, lower, words=50)([t.encode() for t in texts])
        ends = np.r_[0, np.cumsum(counts)]
        for k, t in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 49_000, 9000)
    a, b = np.r_[rng.integers(0, 49_000, 500), shared], np.r_[rng.integers(0, 49_000, 77), shared]
    parts = []
    for x in (a, b, np.zeros(9000, int)):
        own = cuts(x.astype(np.uint32), np.array([0, len(x)]))[0]
        assert own[-1] == len(x) and max(np.diff([0, *own])) <= MOST
        parts.append({x[s:e].tobytes() for s, e in zip([0, *own], own, strict=False)})
    assert len(parts[0] & parts[1]) > 20
    assert cuts(np.r_[a, b].astype(np.uint32), np.array([0, len(a), len(a) + len(b)]))[1] == cuts(b.astype(np.uint32), np.array([0, len(b)]))[0]


def test_crc_of_joined_parts():
    parts = [b"abc", b"", b"x" * 1000, b"12345"]
    behind = np.array([1005, 1005, 5, 0])
    crcs = np.array([zlib.crc32(p) for p in parts], np.int64)
    assert np.bitwise_xor.reduce(crc_behind(crcs, behind)) == zlib.crc32(b"".join(parts))


def test_merkle():
    assert len({merkle([]), merkle([b"a" * 16]), merkle([b"a" * 16, b"b" * 16]), merkle([b"b" * 16, b"a" * 16])}) == 4
