import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidewright.llm.language import document_languages  # noqa: E402
from tidewright.llm.leaks import leak_pairs  # noqa: E402
from tidewright.llm.mixing import mix_sizes  # noqa: E402
from tidewright.llm.simhash import one_of_each  # noqa: E402

from tests.llm.test_shingles import brute_firsts  # noqa: E402, I001


def test_stages_follow_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in document_languages(docs).collect() if r.kept}
    now = [f for _, f in corpus_pipeline.STAGES]
    a = now[0](spark, docs, sf_dir).cache()
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == kept and len(kept) >= 0.98 * len(rows)
    firsts = set(brute_firsts([(i, rows[i].text) for i in kept]))
    b = now[1](spark, a, sf_dir).cache()
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == sorted(firsts)
    leaked = {r.doc_id for r in leak_pairs(b, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    c = now[2](spark, b, sf_dir).cache()
    assert sorted(r.doc_id for r in c.collect()) == sorted(firsts - leaked)
    copies = {r.doc_id: r.taken // r["size"] for r in mix_sizes(c).collect() if r.taken}
    d = now[3](spark, c, sf_dir).cache()
    got = [r.doc_id for r in d.collect()]
    assert d.columns == docs.columns and sorted(got) == sorted(i for i, n in copies.items() for _ in range(n))
    tok, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    want = []
    for i in sorted(got):
        ids = np.array([*tok.encode(rows[i].text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in now[4](spark, d, sf_dir).collect()) == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_one_of_each(spark):
    rows = [(1, "a b c d", 0), (1, "a b c d", 0), (2, "a b c d", 0), (3, None, 0), (4, "", 0), (None, "x y z", 0), (None, "x y z", 1), (None, "A b c d", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d int")
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in got.select("doc_id", "text").collect() if r.text) == [(-1, "x y z"), (1, "a b c d")]
    assert got.count() == 3 and one_of_each(docs.limit(0)).collect() == []


def test_empty_and_odd_documents_pass_all_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(30).unionByName(spark.createDataFrame([(None, None, None, None, None), (5_000_000, "", "en", None, 0), (5_000_001, "word " * 40_000, "en", "src0", 1)], docs.schema))
    for own in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            own = stage(spark, own, sf_dir)
            assert own.columns == docs.columns
            own = spark.createDataFrame(own.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, own, sf_dir).count() == own.count()
