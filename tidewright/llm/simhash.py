"""SimHash near-duplicates, linked by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, lean, settle
from .components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Runs of equal masked keys that are longer than this are split once more by their free bits.
DENSE_RUN = 2048
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> np.ndarray:
    """2^(radius+1) - 1 bit masks such that any radius bits are all hidden by at least one mask.

    Each bit position gets a non-zero vector of radius + 1 bits, dealt evenly; mask v keeps the
    positions whose vector has an odd product with v. Any radius vectors have a common
    orthogonal v, whose mask hides all of them.
    """
    n = 1 << (radius + 1)
    dealt = np.resize(np.random.default_rng(seed).permutation(np.arange(1, n)), bits)
    odd = np.array([[bin(int(x) & v).count("1") & 1 for x in dealt] for v in range(1, n)], np.uint64)
    return (odd << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # ASCII letters and ASCII white space only, as these are bytes
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-size])]
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :], strict=False)]


def _majority(hashes: list[int], counts: list[int]) -> np.ndarray:
    """The fingerprint of each document from the hashes of all of them, one after another."""
    n = np.asarray(counts, np.int64)
    h = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    base = np.repeat(np.arange(len(n)) * 256, n)
    out = np.zeros(len(n), np.uint64)
    for k in range(8):
        ones = np.bincount(base + h[:, k], minlength=256 * len(n)).reshape(len(n), 256) @ _BITS
        out |= ((2 * ones > n[:, None]).astype(np.uint64) << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint_hashes(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each of the lists of hashes."""
    return _majority([x for own in hashes for x in own], [len(own) for own in hashes])


def fingerprint_texts(texts: Iterable[bytes]) -> np.ndarray:
    out, hashes, counts = [], [], []
    for text in texts:
        own = shingle_hashes(text)
        hashes += own
        counts.append(len(own))
        if len(hashes) > 200_000 or len(counts) >= 256:
            out.append(_majority(hashes, counts))
            hashes, counts = [], []
    if counts:
        out.append(_majority(hashes, counts))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fingerprint_texts(each_text(batch.column(2))).view(np.int64))], ["doc_id", "t", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t, fp: a hash of each text and the SimHash of its three-word shingles, as signed longs."""
    own = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(own, F.lit(""))).alias("t"), own.alias("text"))
    return rows.mapInArrow(lean(_fingerprint_batches), "doc_id long, t long, fp long")


def _spread_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = masks()
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for v, mask in enumerate(table):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), v, np.int8)), pa.array((fp & mask).view(np.int64)), batch.column(0), batch.column(1)], ["tab", "key", "fp", "rep"])


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            far = up[up]
            if np.array_equal(far, up):
                self.up = up
                return up
            up = far

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.roots()
        apart = root[i] != root[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def _link_run(fp: np.ndarray, node: np.ndarray, free: list[int], forest: _Forest) -> None:
    """Joins all pairs within the radius in one run; free: the bits in which its members may differ."""
    n = len(fp)
    if n > DENSE_RUN and len(free) > RADIUS:
        # Any two within the radius agree in at least one of radius + 1 groups of the free bits.
        for part in np.array_split(np.array(free), RADIUS + 1):
            key = fp & np.bitwise_or.reduce(np.uint64(1) << part.astype(np.uint64))
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order])) + 1
            left = [b for b in free if b not in set(part.tolist())]
            for run in np.split(order, cut):
                if len(run) > 1:
                    _link_run(fp[run], node[run], left, forest)
        return
    for d in range(1, n):
        near = np.flatnonzero(np.bitwise_count(fp[d:] ^ fp[:-d]) <= RADIUS)
        if len(near):
            forest.join(node[near], node[near + d])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    tab, key, fp, rep = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in range(4))
    order = np.lexsort((key, tab))
    tab, key, fp, rep = tab[order], key[order], fp[order].view(np.uint64), rep[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(tab) != 0) | (np.diff(key) != 0)])
    ends = np.r_[starts[1:], len(tab)]
    shared = np.flatnonzero(ends - starts > 1)
    if not len(shared):
        return
    ids, node = np.unique(rep, return_inverse=True)
    forest, table = _Forest(len(ids)), masks()
    two = shared[ends[shared] - starts[shared] == 2]
    near = starts[two][np.bitwise_count(fp[starts[two]] ^ fp[starts[two] + 1]) <= RADIUS]
    forest.join(node[near], node[near + 1])
    for r in shared[ends[shared] - starts[shared] > 2]:
        s, e = starts[r], ends[r]
        mask = int(table[tab[s]])
        _link_run(fp[s:e], node[s:e], [b for b in range(64) if not mask >> b & 1], forest)
    root = forest.roots()
    away = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(ids[root[away]])], ["a", "b"])


def near_links(classes: DataFrame) -> DataFrame:
    """a, b: links that span, within each task, the pairs of fingerprints at RADIUS bits or fewer.

    classes: fp, rep, one row for each different fingerprint. Each is dealt to 15 tables by its
    masked bits; a task gets whole keys and gives back a spanning forest, never all pairs.
    """
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = classes.select("fp", "rep").mapInArrow(lean(_spread_batches), "tab byte, key long, fp long, rep long")
    return spread.repartition(width, "tab", "key").mapInArrow(lean(_link_batches), "a long, b long")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, t, fp, component_id of every row."""
    prints = settle(fingerprints(docs, doc_id, text))
    classes = settle(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    ends = settle(connected_components(near_links(classes), "a", "b"))
    named = classes.join(ends, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs.

    Texts: A-Z in lower case, words split at ASCII white space, three-word shingles with repeats
    (shorter texts: one shingle of all words). Null, empty or blank texts have fingerprint zero and
    link like any other. Repeated rows are repeated in the result. A null doc_id stays null; its
    component is that of the numbered documents with its fingerprint, null where there are none.
    Other columns of docs are not read. An empty table gives an empty result.
    """
    return _grouped(docs, doc_id, text).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the one with the smallest doc_id.

    Of rows with that doc_id the one whose text has the smallest hash stays, and of equal ones any.
    Rows without a doc_id are grouped by fingerprint where it has no numbered document.
    """
    last = F.lit((1 << 63) - 1)
    rows = _grouped(docs, doc_id, text).withColumn("d", F.coalesce("doc_id", last))
    group = F.struct(F.col("component_id").alias("c"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
    firsts = rows.groupBy(group.alias("g")).agg(F.min(F.struct("d", "t")).alias("r")).select("r.d", "r.t")
    own = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(doc_id).cast("long"), last).alias("d"), own.alias("t"))
    return keyed.join(firsts, ["d", "t"], "left_semi").dropDuplicates(["d", "t"]).select("_row.*")
