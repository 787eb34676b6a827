"""Repeated strings across documents, removed from all but the first, by longest previous factors.

All suffixes of a large corpus cannot be sorted in one place. Every string of LENGTH bytes has one
anchor, a short gram that its content alone picks, so equal strings have equal anchors:

1. anchors that only one document has are left out, by their hashes alone;
2. the bytes around the others go to the task of their anchor, which sorts the suffixes there and
   finds, for each, the nearest ones before and behind it in that order that have a smaller
   document; the longer common prefix with either is the longest previous factor;
3. factors of LENGTH bytes or more come back to the documents as byte ranges.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, all_anchors
from .common import each_text, flat, lean, settle, shuffle_width

LENGTH = 50
#: Documents without an id come after all others.
LAST = (1 << 63) - 1
_HASH_BITS = 48
_SLICES = 4


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 3)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(blob))


def smallest(column: np.ndarray) -> np.ndarray:
    """The column in the fewest bytes that hold its values, none of which is negative."""
    return column.astype(np.min_scalar_type(int(column.max()))) if len(column) else column


# --- suffix order -----------------------------------------------------------------------------


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    up = np.empty(len(key), np.int64)
    up[0] = 0
    ordered = key[order]
    np.cumsum(ordered[1:] != ordered[:-1], out=up[1:])
    out = np.empty(len(key), np.uint32)
    out[order] = up
    return out


#: Bytes by which suffixes are ordered at a time, and a byte that no text has.
_SPAN, _END = 32, 255


def suffix_order(text: np.ndarray, places: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their suffixes, and the common prefix of each with the one before it.

    left: bytes from each place to the end of its string, behind which text has an _END. Ranks of
    all _SPAN bytes come from doubling; suffixes are ordered by as many of them as the longest has.
    """
    most = int(left.max())
    text = np.r_[text, np.full(most + 2 * _SPAN, _END, np.uint8)]
    key = text.astype(np.uint64)
    for span in (1, 2, 4):
        key = (key[:-span] << np.uint64(8 * span)) | key[span:]
    span, ranks = 8, [_ranks(key)]
    del key
    while span < _SPAN:
        rank = ranks[-1]
        ranks.append(_ranks((rank[:-span].astype(np.uint64) << np.uint64(32)) | rank[span:]))
        span *= 2
    own, upto = ranks[-1][places], _SPAN
    while upto < most:
        own = _ranks((own.astype(np.uint64) << np.uint64(32)) | ranks[-1][places + upto])
        upto += _SPAN
    order = np.argsort(own, kind="stable")
    a, b = places[order[:-1]], places[order[1:]]
    same, at = np.zeros(len(a), np.int64), np.arange(len(a))  # at: equal so far
    for _ in range(upto // _SPAN):
        at = at[ranks[-1][a[at] + same[at]] == ranks[-1][b[at] + same[at]]]
        same[at] += _SPAN
    at = np.flatnonzero(same < upto)
    for rank, span in zip(ranks[-2::-1], (16, 8), strict=True):
        some = at[rank[a[at] + same[at]] == rank[b[at] + same[at]]]
        same[some] += span
    for _ in range(7):
        at = at[text[a[at] + same[at]] == text[b[at] + same[at]]]
        same[at] += 1
    return order, np.r_[0, np.minimum(same, left[order[1:]])]


def _smaller_before(doc: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it that has a smaller document; 0: less than length.

    Every suffix points at one before it such that all between have no smaller document; where that
    one has none either, it points on to where that one points, all at once.
    """
    to, held = np.arange(-1, len(doc) - 1), common.copy()
    to[common < length] = -1
    at = np.flatnonzero(to >= 0)
    at = at[doc[to[at]] >= doc[at]]
    while len(at):
        via = to[at]
        further, low = to[via], np.minimum(held[at], held[via])
        low[further < 0] = 0
        to[at], held[at] = further, low
        at = at[further >= 0]
        at = at[doc[to[at]] >= doc[at]]
    held[to < 0] = 0
    return held


def longest_previous_factors(text: np.ndarray, places: np.ndarray, left: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each place the length of the longest string from it that also starts at a place with a smaller document.

    Strings shorter than length count as none. Of all suffixes with a smaller document the nearest
    before and the nearest behind in suffix order have the longest common prefixes.
    """
    out = np.zeros(len(places), np.int64)
    if not len(places):
        return out
    order, common = suffix_order(text, places, left)
    # Only suffixes that share length bytes with a neighbour can have a factor.
    near = common >= length
    near[:-1] |= common[1:] >= length
    order, common = order[near], common[near]
    own = doc[order]
    before = _smaller_before(own, common, length)
    behind = _smaller_before(own[::-1], np.r_[0, common[:0:-1]], length)[::-1] if len(own) else before
    out[order] = np.maximum(before, behind)
    return out


# --- step 1: anchors of more than one document ------------------------------------------------


def _ask(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """doc_id, th, text -> for each batch one row that lists its documents and rows of anchor hashes by slice."""
    task = TaskContext.get()
    group = (task.partitionId() if task else 0) << 32
    n = _SLICES * width
    for batch in batches:
        data, ends = flat(batch.column(2))
        place, h, first, count = all_anchors(data, ends, length)
        of = np.searchsorted(ends, place, "right") - 1
        per_doc = np.bincount(of, minlength=batch.num_rows)
        docs = pack(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), smallest(per_doc), smallest(first - ends[of]), smallest(count))
        key, rows = (h % np.uint64(n)).astype(np.int64), [(-1 - group, group, docs)]
        short = h >> np.uint64(64 - _HASH_BITS)
        order = np.argsort(key, kind="stable")
        cut = np.searchsorted(key[order], np.arange(n + 1))
        for k in range(n):
            own = order[cut[k] : cut[k + 1]]
            if len(own):
                own = own[np.argsort(short[own], kind="stable")]
                step = np.diff(short[own], prepend=np.uint64(0))
                rows.append((k, group, pack(*_split(step), smallest(own), smallest(of[own]))))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["key", "grp", "blob"])
        group += 1


def _split(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Low and high halves apart, which compress better."""
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), smallest(x >> np.uint64(32))


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes documents on; of the hashes of a task, says to each batch which more than one document has."""
    groups, hashes, places, docs, lens = [], [], [], [], []
    for batch in batches:
        key = batch.column(0).to_numpy()
        yield batch.filter(pa.array(key < 0))
        for k, g, blob in zip(key.tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k >= 0:
                low, high, own, of = unpack(blob)
                hashes.append(np.cumsum(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)) | np.uint64(k) << np.uint64(_HASH_BITS))
                groups.append(g), places.append(own), docs.append(of), lens.append(len(own))
    if not groups:
        return
    h = np.concatenate(hashes)
    hashes.clear()
    part = np.repeat(np.arange(len(groups), dtype=np.uint64), lens)
    # One number for each document of a task; repeated rows of one document are told apart later.
    doc = part << np.uint64(32) | np.concatenate(docs).astype(np.uint64)
    order = np.argsort(h)
    new = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
    low, high = np.minimum.reduceat(doc[order], new), np.maximum.reduceat(doc[order], new)
    shared = np.empty(len(h), bool)
    shared[order] = np.repeat(low != high, np.diff(np.r_[new, len(h)]))
    at = np.r_[0, np.cumsum(lens)]
    out = [(0, g, pack(np.sort(places[i][shared[at[i] : at[i + 1]]]))) for i, g in enumerate(groups) if shared[at[i] : at[i + 1]].any()]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["key", "grp", "blob"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' rows and answers, whole groups, to doc_id, th and the windows whose anchors are shared."""
    docs, answers = {}, {}
    for batch in batches:
        for k, g, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k < 0:
                docs[g] = blob
            else:
                answers.setdefault(g, []).append(blob)
    for g, blobs in answers.items():
        doc_id, th, per_doc, first, count = unpack(docs.pop(g))
        own = np.sort(np.concatenate([unpack(b)[0].astype(np.int64) for b in blobs]))
        of = np.repeat(np.arange(len(per_doc)), per_doc)[own]
        new = np.flatnonzero(np.r_[True, np.diff(of) != 0])
        cut = np.r_[new, len(of)]
        own_blobs = [pack(smallest(first[own[a:b]]), count[own[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc_id[of[new]].astype(np.int64)), pa.array(th[of[new]]), pa.array(own_blobs, pa.binary())], ["d", "t", "windows"])


# --- step 2: suffixes around shared anchors ---------------------------------------------------


def _contexts(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """doc_id, th, text, windows -> the bytes of all windows of each shared anchor, to the anchor's task."""
    task = TaskContext.get()
    group = (task.partitionId() if task else 0) << 32
    for batch in batches:
        data, ends = flat(batch.column(2))
        firsts, counts, of = [], [], []
        for i, blob in enumerate(batch.column(3).to_pylist()):
            first, count = unpack(blob)
            firsts.append(first.astype(np.int64)), counts.append(count.astype(np.int64)), of.append(np.full(len(first), i))
        if not firsts:
            continue
        first, count, of = np.concatenate(firsts), np.concatenate(counts), np.concatenate(of)
        at = ends[of] + first
        key = _anchor_keys(data, at, count, length) % np.uint64(width)
        order = np.argsort(key, kind="stable")
        cut = np.searchsorted(key[order], np.arange(width + 1, dtype=np.uint64))
        doc_id = batch.column(0).to_numpy(zero_copy_only=False)
        keys, blobs = [-1 - group], [pack(doc_id, batch.column(1).to_numpy())]
        for k in range(width):
            own = order[cut[k] : cut[k + 1]]
            if not len(own):
                continue
            size = count[own] + length - 1
            upto = np.r_[0, np.cumsum(size)]
            text = data[np.repeat(at[own] - upto[:-1], size) + np.arange(upto[-1])]
            there, local = np.unique(of[own], return_inverse=True)
            keys.append(k), blobs.append(pack(text, smallest(first[own]), smallest(count[own]), smallest(local), smallest(there), doc_id[there]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.full(len(keys), group)), pa.array(blobs, pa.binary())], ["key", "grp", "blob"])
        group += 1


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same hash as gram_hashes, at some places only."""
    h = data[at[:, None] + np.arange(GRAM)].astype(np.uint64) + np.uint64(1)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while h.shape[1] > 1:
            h = h[:, ::2] * base + h[:, 1::2]
            base *= base
        h = h[:, 0]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def _anchor_keys(data: np.ndarray, at: np.ndarray, count: np.ndarray, length: int, step: int = 1 << 16) -> np.ndarray:
    """Hash of the least gram that all windows from at to at + count share: the anchor's."""
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(at), step):
        a, c = at[lo : lo + step], count[lo : lo + step]
        # All of an anchor's windows hold it: it begins no earlier than the last and ends within the first.
        n = length - GRAM + 1 - (c - 1)
        upto = np.r_[0, np.cumsum(n)]
        h = _grams(data, np.repeat(a + c - 1 - upto[:-1], n) + np.arange(upto[-1]))
        out[lo : lo + step] = np.minimum.reduceat(h, upto[:-1])
    return out


def _earlier(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts of whole anchors -> for each batch the windows that a smaller document has; lists of documents pass."""
    text, first, count, of, doc_ids, rows, groups, n_docs = [], [], [], [], [], [], [], 0
    for batch in batches:
        key = batch.column(0).to_numpy()
        yield batch.filter(pa.array(key < 0))
        for k, g, blob in zip(key.tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k >= 0:
                t, f, c, local, there, d = unpack(blob)
                text.append(t), first.append(f.astype(np.int64)), count.append(c.astype(np.int64)), of.append(local.astype(np.int64) + n_docs)
                doc_ids.append(d.astype(np.int64)), rows.append(there.astype(np.int64)), groups.append(np.full(len(d), g))
                n_docs += len(d)
    if not text:
        return
    text, first, count, of = np.concatenate(text), np.concatenate(first), np.concatenate(count), np.concatenate(of)
    doc_ids, rows, groups = np.concatenate(doc_ids), np.concatenate(rows), np.concatenate(groups)
    doc = doc_ids[of]
    ends = np.r_[0, np.cumsum(count + length - 1)]
    raw = text.tobytes()
    # Equal contexts are one class, which stands for its smallest document.
    seen: dict[bytes, int] = {}
    cls = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), np.int64, len(count))
    del raw, seen
    one = np.unique(cls, return_index=True)[1]
    least = np.full(len(one), LAST, np.int64)
    np.minimum.at(least, cls, doc)
    # An anchor with one class of contexts has nothing else to be compared with.
    gram = _anchor_keys(text, ends[:-1][one], count[one], length)
    _, alike, times = np.unique(gram, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(times[alike] > 1)
    hit = np.zeros(int(count[one].sum()), bool)
    hit_at = np.r_[0, np.cumsum(count[one])]
    for part in _whole_anchors(rest, alike, count[one] + length - 1):
        size = count[one[part]] + length - 1
        upto = np.r_[0, np.cumsum(size)]
        # A byte that no text has ends each context.
        sub, begin = np.full(upto[-1] + len(part), _END, np.uint8), upto[:-1] + np.arange(len(part))
        each = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
        sub[np.repeat(begin, size) + each] = text[np.repeat(ends[:-1][one[part]], size) + each]
        n = count[one[part]]
        inner = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        factors = longest_previous_factors(sub, np.repeat(begin, n) + inner, np.repeat(size, n) - inner, np.repeat(least[part], n), length)
        hit[np.repeat(hit_at[part], n) + inner] = factors >= length
    # Later documents of a class have all its windows earlier, the first one those found above.
    later = doc > least[cls]
    start, size = [first[later]], [count[later]]
    owner = [of[later]]
    firsts = np.flatnonzero(~later)
    n = count[firsts]
    inner = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    at = np.flatnonzero(hit[np.repeat(hit_at[cls[firsts]], n) + inner])
    start.append((np.repeat(first[firsts], n) + inner)[at]), size.append(np.ones(len(at), np.int64)), owner.append(np.repeat(of[firsts], n)[at])
    start, size, owner = np.concatenate(start), np.concatenate(size), np.concatenate(owner)
    group, row = groups[owner], rows[owner]
    order = np.lexsort((start, row, group))
    start, size, row, group = start[order], size[order], row[order], group[order]
    if not len(start):
        return
    # Neighbouring windows become one range.
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1]) | (start[1:] > start[:-1] + size[:-1])])
    last = np.r_[new[1:], len(start)] - 1
    start, stop, row, group = start[new], start[last] + size[last], row[new], group[new]
    cut = np.flatnonzero(np.r_[True, np.diff(group) != 0, True])
    blobs = [pack(smallest(row[a:b]), smallest(start[a:b]), smallest(stop[a:b] - start[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(blobs), np.int64)), pa.array(group[cut[:-1]]), pa.array(blobs, pa.binary())], ["key", "grp", "blob"])


def _whole_anchors(rest: np.ndarray, alike: np.ndarray, size: np.ndarray, limit: int = 1 << 22) -> Iterator[np.ndarray]:
    """Classes in parts of about limit bytes that do not divide an anchor's."""
    rest = rest[np.argsort(alike[rest], kind="stable")]
    new = np.flatnonzero(np.r_[True, np.diff(alike[rest]) != 0, True])[: len(rest) + 1] if len(rest) else np.empty(0, np.int64)
    at, total = 0, 0
    for a, b in zip(new[:-1], new[1:], strict=False):
        total += int(size[rest[a:b]].sum())
        if total > limit:
            yield rest[at:b]
            at, total = b, 0
    if at < len(rest):
        yield rest[at:]


def _ranges(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows of whole batches -> doc_id, th and the removed byte ranges, joined where they touch."""
    docs, found = {}, {}
    for batch in batches:
        for k, g, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k < 0:
                docs[g] = blob
            else:
                found.setdefault(g, []).append(blob)
    for g, blobs in found.items():
        doc_id, th = unpack(docs.pop(g))
        of, start, size = (np.concatenate(x).astype(np.int64) for x in zip(*map(unpack, blobs), strict=True))
        stop = start + size - 1 + length
        order = np.lexsort((start, of))
        of, start, stop = of[order], start[order], stop[order]
        # Ends of earlier ranges of the same document, as one running maximum over shifted values.
        shift = of * (int(stop.max()) + 1)
        reach = np.maximum.accumulate(stop + shift) - shift
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (start[1:] > reach[:-1])])
        last = np.r_[new[1:], len(of)] - 1
        of, start, stop = of[new], start[new], reach[last]
        cut = np.flatnonzero(np.r_[True, np.diff(of) != 0, True])
        ranges = [np.stack((start[a:b], stop[a:b])).astype("<i8").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        who = of[cut[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(doc_id[who].astype(np.int64)), pa.array(th[who]), pa.array(ranges, pa.binary())], ["d", "t", "ranges"])


# --- the operator -----------------------------------------------------------------------------


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d, t: what tells documents apart, the id (null: the last) and a hash of the text."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(raw).alias("t"), raw.cast("binary").alias("text"))


def repeated_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """d, t, ranges of each document that has something to remove (see _keyed); a settled table.

    ranges: byte offsets as little-endian longs, all starts, then all ends. Exact: anchors only
    choose what is compared, and bytes decide. A task holds the anchors of its slices; equal
    contexts are held once for each batch and sorted once.
    """
    if not GRAM <= length:
        raise ValueError(f"length must be {GRAM} or more")
    width = shuffle_width(docs.sparkSession)
    rows = _keyed(docs, doc_id, text).where(F.length("text") >= length)
    kinds = "key long, grp long, blob binary"
    asked = rows.select("d", "t", "text").mapInArrow(lean(lambda b: _ask(b, width, length)), kinds)
    answered = asked.repartition(width, "key").mapInArrow(lean(_answer), kinds)
    shared = settle(answered.repartition(width, "grp").mapInArrow(lean(_by_document), "d long, t long, windows binary").groupBy("d", "t").agg(F.first("windows").alias("windows")))
    both = rows.select("d", "t", "text").join(shared, ["d", "t"])
    # Several slices to a task, so that tasks get about as many.
    around = both.select("d", "t", "text", "windows").mapInArrow(lean(lambda b: _contexts(b, _SLICES * width, length)), kinds)
    found = around.repartition(width, "key").mapInArrow(lean(lambda b: _earlier(b, length)), kinds)
    # Repeated rows of a document have the same ranges.
    out = settle(found.repartition(width, "grp").mapInArrow(lean(lambda b: _ranges(b, length)), "d long, t long, ranges binary").groupBy("d", "t").agg(F.first("ranges").alias("ranges")))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, spans, kept = [], [], [], []
        for raw, ranges in zip(each_text(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            start, stop = np.frombuffer(ranges, "<i8").reshape(2, -1) if ranges else np.zeros((2, 0), np.int64)
            keep = hashlib.sha256()
            at = 0
            for a, b in zip(start.tolist(), stop.tolist(), strict=True):
                keep.update(raw[at:a])
                at = b
            keep.update(raw[at:])
            n.append(len(raw)), gone.append(int((stop - start).sum())), spans.append(len(start)), kept.append(keep.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, ranges in zip(each_text(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            start, stop = np.frombuffer(ranges, "<i8").reshape(2, -1) if ranges else np.zeros((2, 0), np.int64)
            out.append(b"".join(raw[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(raw)], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "kept"])


def _with_ranges(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    ranges = repeated_ranges(docs, doc_id, text, length)
    return _keyed(docs, doc_id, text).join(ranges, ["d", "t"], "left").select("doc_id", "text", "ranges")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, kept: the remaining bytes of each document (binary, as a cut may fall inside a character)."""
    return _with_ranges(docs, doc_id, text, length).mapInArrow(lean(_kept), "doc_id long, kept binary")


def repeat_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    A byte is removed if a string of length bytes covers it that also starts in a document with a
    smaller doc_id. Null texts are empty; texts shorter than length keep all. Rows with the same
    doc_id are not earlier than each other; a null doc_id is later than any other and no two nulls
    are earlier than each other. Other columns are not read; an empty table gives an empty result.
    """
    return _with_ranges(docs, doc_id, text, length).mapInArrow(lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The same by plain windows of LENGTH bytes in hexadecimal; for tables of some megabytes.
SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(x, 2 * i - 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, x, unnest(range(1, n - {LENGTH - 2})) AS i FROM d WHERE n >= {LENGTH})
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS hit FROM w
), o AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, true)::INTEGER AS opens FROM m WHERE hit
), r AS (
  SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH - 1} AS z FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) GROUP BY 1, 2
), p AS (
  SELECT doc_id, coalesce(lag(z) OVER v, 0) + 1 AS a, a - 1 AS z FROM r WINDOW v AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT d.doc_id, coalesce((SELECT max(z) FROM r WHERE r.doc_id = d.doc_id), 0) + 1, n FROM d
), k AS (
  SELECT p.doc_id, string_agg(substr(x, 2 * p.a - 1, 2 * (p.z - p.a + 1)), '' ORDER BY p.a) AS x FROM p JOIN d USING (doc_id) GROUP BY 1
), g AS (
  SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY 1
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.x)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)
"""
