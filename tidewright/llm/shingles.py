"""Near-duplicates by a similarity of their shingles: the covering tables of SimHash with bands beside them, and exact similarity for links.

Fingerprints at RADIUS bits always meet in a covering table. Texts at a similarity of 0.8 have
fingerprints some ten bits apart, and covering those takes thousands of tables; what lies beyond the
radius is found by bands of least hashes instead. Either only proposes pairs to be compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, each_text, lean, settle, shuffle_width
from .components import connected_components
from .simhash import SEED, fingerprint_hashes, masks, shingle_hashes

#: Words in a shingle; texts are linked from OF / PARTS of their joint shingles in common, 0.8.
SHINGLE, OF, PARTS = 5, 4, 5
#: Bands, and minima in each: a pair at 0.8 shares none with probability (1 - 0.8^4)^24, 3 in a million, and less above.
BANDS, ROWS = 24, 4
#: Hashes that are compared with a set at a time.
COMPARED = 1 << 20
#: Documents without an id come after all others.
LAST = (1 << 63) - 1
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set, none of which may be empty."""
    out = np.empty((len(sets), BANDS), np.uint64)
    hashes, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for factor in _FACTORS[b]:
            key = (key ^ np.minimum.reduceat(hashes * factor, starts)) * _MIX
            key ^= key >> np.uint64(32)
        out[:, b] = key
    return out


def covering_keys(hashes: list[list[int]]) -> np.ndarray:
    """A row for each text, from its shingles' hashes: the masked SimHash fingerprint of each covering table, told apart by table."""
    fp = fingerprint_hashes(hashes)
    table = masks()
    key = (fp[:, None] & table) ^ (np.arange(1, len(table) + 1, dtype=np.uint64) * _MIX)
    key *= np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(29))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, t, text -> d, t, a hash of the text's set of shingles and the keys under which it is looked for (none where the set is empty)."""
    n_keys = BANDS + len(masks())
    for batch in batches:
        k, ends, keys, held, lists, size = [], [0], [], [], [], 0

        def put(keys=keys, held=held, lists=lists) -> None:
            if held:
                keys.append(np.concatenate([bands(held), covering_keys(lists)], axis=1).ravel())
                held.clear(), lists.clear()

        for text in each_text(batch.column(2)):
            every = shingle_hashes(text, SHINGLE)
            own = np.unique(np.array(every, np.uint64))
            k.append(xxhash.xxh3_64_intdigest(own.tobytes(), SEED))
            ends.append(ends[-1] + n_keys * bool(len(own)))
            if len(own):
                held.append(own), lists.append(every)
                size += len(every)
            if size > 50_000:
                put()
                size = 0
        put()
        keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(k, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64)))], ["d", "t", "k", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """k, text -> k and the text's shingles, about limit hashes at a time."""

    def packed(k: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), binary(np.concatenate(sets).view(np.uint8), np.cumsum([0, *(8 * len(s) for s in sets)])).cast(pa.binary())], ["k", "shingles"])

    for batch in batches:
        k, sets, size = [], [], 0
        for one, text in zip(batch.column(0).to_pylist(), each_text(batch.column(1)), strict=True):
            own = shingle_set(text)
            k.append(one), sets.append(own)
            size += len(own)
            if size > limit:
                yield packed(k, sets)
                k, sets, size = [], [], 0
        if sets:
            yield packed(k, sets)


def like(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the pairs of sets with a similarity of OF / PARTS or more; only pairs that are connected already aren't compared."""
    n, label, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        more = np.arange(i + 1, len(sets))
        more = more[(label[more] != label[i]) & (PARTS * np.minimum(n[more], n[i]) >= OF * np.maximum(n[more], n[i]))]
        if not len(more):
            continue
        # Some at a time, so that what is compared is not held a second time.
        both, upto = np.empty(len(more), np.int64), np.cumsum(n[more])
        at = 0
        while at < len(more):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COMPARED, "right")))
            every = np.concatenate([sets[j] for j in more[at:to]])
            place = np.minimum(np.searchsorted(sets[i], every), n[i] - 1)
            both[at:to] = np.add.reduceat((sets[i][place] == every).astype(np.int64), np.cumsum([0, *n[more[at:to]]])[:-1])
            at = to
        near = more[PARTS * both >= OF * (n[more] + n[i] - both)]
        found, first = np.unique(label[near], return_index=True)
        out += [(i, j) for j in near[first].tolist()]
        label[np.isin(label, found)] = label[i]
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, k, shingles, by key -> links between the k of a key."""
    now, ks, sets = None, [], []

    def links() -> pa.RecordBatch:
        pairs = like(sets)
        return pa.RecordBatch.from_arrays([pa.array([ks[p[x]] for p in pairs], pa.int64()) for x in (0, 1)], ["a", "b"])

    for batch in batches:
        for key, k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if key != now:
                if len(ks) > 1:
                    yield links()
                now, ks, sets = key, [], []
            ks.append(k)
            sets.append(np.frombuffer(own.as_py(), np.uint64))
    if len(ks) > 1:
        yield links()


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, of each group of near-duplicates the one with the smallest doc_id.

    Two texts are linked if their sets of five-word shingles (shorter texts: one shingle of all
    words; A-Z in lower case, words split at ASCII white space) have a Jaccard similarity of 0.8 or
    more; groups are what links connect. Equal sets are one class. Classes that share a covering
    table's key or a band are compared exactly, and each set of classes that share one only once:
    rows grow with the classes, not with their pairs. Texts without words are one group. Of rows with the smallest
    doc_id the one whose text has the smallest hash stays, and of equal ones any; rows without a
    doc_id come last.
    """
    own = F.col(text).cast("string")
    d, t = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.coalesce(own, F.lit(""))).alias("t")
    rows = docs.select(d, t, own.alias("text"))
    prints = rows.mapInArrow(lean(_banded), "d long, t long, k long, bands array<long>")
    classes = settle(prints.groupBy("k").agg(F.min(F.struct("d", "t", "bands")).alias("r")).select("k", "r.*"))
    keys = classes.select("k", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b"), F.bit_xor(F.xxhash64("k")).alias("x")).where("n > 1")
    members = settle(keys.join(shared.groupBy("n", "a", "b", "x").agg(F.min("key").alias("key")), "key", "left_semi"))
    some = classes.join(members.select("k").distinct(), "k", "left_semi").select("k", "d", "t")
    sets = settle(rows.join(some, ["d", "t"]).dropDuplicates(["k"]).select("k", "text").mapInArrow(lean(_sets), "k long, shingles binary"))
    dealt = members.join(sets, "k").select("key", "k", "shingles").repartition(shuffle_width(docs.sparkSession), "key").sortWithinPartitions("key")
    ends = settle(connected_components(dealt.mapInArrow(lean(_linked), "a long, b long"), "a", "b"))
    named = classes.join(ends, F.col("k") == F.col("node"), "left").select(F.coalesce("component", "k").alias("c"), F.struct("d", "t").alias("r"))
    firsts = named.groupBy("c").agg(F.min("r").alias("r")).select("r.d", "r.t")
    keyed = docs.select(F.struct("*").alias("_row"), d, t)
    return keyed.join(firsts, ["d", "t"], "left_semi").dropDuplicates(["d", "t"]).select("_row.*")
