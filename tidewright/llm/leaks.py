"""Benchmark decontamination: latent semantic candidates, then subsequence and answer checks; what has most of an item's words is checked in any case."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, each_text, flat, lean, settle

#: Blocks for which texts are read once, items searched together, and latent dimensions with their surplus.
CHUNK, BLOCK, RANK, SURPLUS = 32, 256, 256, 32
#: Terms in more than this share of documents take no part in the vectors, but for the RAREST of each item, and as many more as carry all but LOOSE of its weight.
COMMON, RAREST = 0.1, 8
#: Least share of an item's weight found in order; that of its answer; share beyond which the answer isn't asked for.
SHARE, ANSWER, PLAIN = 0.6, 0.5, 0.8
#: The same for paraphrases: share, answer, and the latent cosine of the item with the words around what is shared.
LOOSE, RECALLED, COSINE = 0.4, 0.9, 0.7
#: Longest item in words that is searched in one piece; longer ones are searched in even pieces, so that windows stay short, and judged whole.
LONGEST = 256
SEED = 11
LAST = (1 << 63) - 1
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def cuts(n: int) -> list[tuple[int, int]]:
    """Starts and stops of the pieces of n words: as few as LONGEST allows, of lengths that differ by one at most.

    A common subsequence with a share of the whole's weight has that share of some piece's too, so
    pieces need not overlap to find all items that are then judged whole.
    """
    k = -(-n // LONGEST)
    return [(n * j // k, n * (j + 1) // k) for j in range(k)]


class Chunk:
    """Benchmark passages that share one vocabulary, so that the corpus is read once for all of them."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in rows for w in words))}
        wholes = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in rows]
        #: Id of the item, its words, and where in it the piece starts and stops.
        self.pieces = [(i, whole, a, b) for (i, _), whole in zip(rows, wholes, strict=True) for a, b in cuts(len(whole))]

    def blocks(self, df: np.ndarray, n: int) -> Iterator[Items]:
        idf = np.log((1 + n) / (1 + df)) + 0.05
        for k in range(0, len(self.pieces), BLOCK):
            yield Items(self.pieces[k : k + BLOCK], df, n, idf)


class Items:
    """A block of passages that are searched together.

    wholes: the items of which the passages are pieces, and where these start and stop in them;
    idf: inverse document frequencies of the chunk's terms; weight: the same for the block's terms
    that take part in the vectors, else 0; local: their places in the block's own vocabulary.
    """

    def __init__(self, pieces: list[tuple[int, np.ndarray, int, int]], df: np.ndarray, n: int, idf: np.ndarray):
        self.ids, self.wholes, self.idf = np.array([p[0] for p in pieces], np.int64), [p[1:] for p in pieces], idf
        self.words = words = [whole[a:b] for _, whole, a, b in pieces]
        self.window = 2 * max(len(w) for w in words)
        own = np.unique(np.concatenate(words))
        self.size = len(own)
        self.local = np.full(len(df), -1, np.int64)
        self.local[own] = np.arange(len(own))
        taking = np.zeros(len(df), bool)
        taking[own[df[own] <= COMMON * n]] = True
        for w in words:
            each, times = np.unique(w, return_counts=True)
            order = np.argsort(df[each], kind="stable")
            heavy = np.cumsum((times * idf[each])[order])
            taking[each[order[: max(RAREST, 1 + int(np.searchsorted(heavy, (1 - LOOSE) * heavy[-1], "right")))]]] = True
        self.weight = np.where(taking, idf, 0.0).astype(np.float32)
        # For each term that takes part, the items that have it and what it weighs in them; for each item, the least such weight of a window that has LOOSE of the item.
        parts = [np.unique(w[taking[w]], return_counts=True) for w in words]
        term, times = (np.concatenate([p[k] for p in parts]) for k in range(2))
        order = np.argsort(self.local[term], kind="stable")
        self.item = np.repeat(np.arange(len(words)), [len(p[0]) for p in parts])[order]
        self.share = (times * idf[term])[order]
        self.first = np.searchsorted(self.local[term][order], np.arange(self.size + 1))
        whole = np.array([idf[w].sum() for w in words])
        self.least = LOOSE * whole - (whole - np.bincount(self.item, self.share, len(words))) - 1e-9 * whole

    def reached(self, term: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages and items, by passage, where the passage may have LOOSE of the item's weight in any order; no other pair has."""
        passage = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(term)]))
        start, n = self.first[self.local[term]], np.diff(self.first)[self.local[term]]
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        held = np.bincount(np.repeat(passage, n) * len(self.words) + self.item[at], self.share[at], len(new) * len(self.words))
        return np.nonzero(held.reshape(len(new), -1) >= self.least)

    def vectors(self) -> np.ndarray:
        out = np.zeros((len(self.words), self.size), np.float32)
        weight = np.zeros(self.size, np.float32)
        for k, w in enumerate(self.words):
            np.add.at(out[k], self.local[w], 1)
            weight[self.local[w]] = self.weight[w]
        out = np.sqrt(out) * weight
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-30)


def _terms(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """d, t, text -> d, t and the places and terms of the text's words that are in the vocabulary."""
    look, size = vocabulary.get, len(vocabulary)
    for batch in batches:
        places, terms = [], []
        for text in each_text(batch.column(2)):
            found = words_of(text.decode())
            term = np.fromiter(map(look, found, repeat(size)), np.int32, len(found))
            at = np.flatnonzero(term < size)
            places.append(at.astype("<i4").tobytes()), terms.append(term[at].astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary()), pa.array(terms, pa.binary())], ["d", "t", "place", "term"])


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and the offsets of its rows."""
    data, ends = flat(column)
    return np.frombuffer(data.tobytes(), "<i4"), ends // 4


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(size, np.int64)
    for batch in batches:
        term, ends = _ints(batch.column(0))
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        df += np.bincount(np.unique(doc * size + term) % size, minlength=size)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "n"])


def _passages(place: pa.Array, term: pa.Array, weight: np.ndarray, span: int, limit: int = 10_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Sparse passages, some at a time: document, window, term, value (unit length), and where each passage starts.

    Windows step by half their span, so each place lies in two; only terms with weight count.
    """
    at, ends = _ints(place)
    term = _ints(term)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    some = np.flatnonzero(weight[term] > 0)
    doc, half, term = doc[some], at[some].astype(np.int64) // (span // 2), term[some]
    if not len(term):
        return
    size, most = len(weight), int(half.max()) + 2
    key = (doc * most + half + 1) * size + term
    key, times = np.unique(np.r_[key, key - size], return_counts=True)
    passage, term = key // size, key % size
    value = np.sqrt(times).astype(np.float32) * weight[term]
    new = np.flatnonzero(np.r_[True, np.diff(passage) != 0])
    value /= np.repeat(np.sqrt(np.add.reduceat(value * value, new)), np.diff(np.r_[new, len(term)]))
    doc, window = passage // most, passage % most - 1
    lo = 0
    while lo < len(new):
        hi = max(lo + 1, int(np.searchsorted(new, new[lo] + limit)))
        a, b = new[lo], new[hi] if hi < len(new) else len(term)
        yield doc[a:b], window[a:b], term[a:b], value[a:b], new[lo:hi] - a
        lo = hi


def _sketch(batches: Iterator[pa.RecordBatch], weight: np.ndarray, local: np.ndarray, span: int, omega: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Sum of a (a omega) over passages a, in parts of rows, and the number of passages."""
    total, n = np.zeros(omega.shape, np.float32), 0
    for _, _, term, value, new in (p for b in batches for p in _passages(b.column(0), b.column(1), weight, span)):
        term = local[term]
        y = np.add.reduceat(omega[term] * value[:, None], new, axis=0)
        spread = np.repeat(y, np.diff(np.r_[new, len(term)]), axis=0) * value[:, None]
        order = np.argsort(term, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(term[order]) != 0])
        total[term[order][first]] += np.add.reduceat(spread[order], first, axis=0)
        n += len(new)
    if n:
        cut = np.array_split(total, parts)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([n] * parts, pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())], ["part", "n", "rows"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each part of a task, one row at a time."""
    total: dict[int, list] = {}
    for batch in batches:
        for part, n, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            x = np.frombuffer(rows, np.float32).astype(np.float64)
            if part in total:
                total[part][0] += n
                total[part][1] += x
            else:
                total[part] = [n, x]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1].tobytes() for x in total.values()], pa.binary())], ["part", "n", "rows"])


def latent_basis(terms: DataFrame, items: Items, rank: int = RANK, surplus: int = SURPLUS) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages of all documents and of the benchmark, by a randomised sketch.

    The sketch C omega of the passages' second moments C is summed over all tasks, and the leading
    eigenvectors of C follow from it alone (Nystroem). Documents and benchmark weigh the same, so
    that the benchmark's passages are represented. What reaches the driver is terms x (rank +
    surplus) numbers, bounded by the block whatever the size of the corpus.
    """
    size, width = items.size, min(rank + surplus, items.size)
    omega = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, width)))[0].astype(np.float32)
    weight, local, span, parts = items.weight, items.local, items.window, 16
    sums = terms.select("place", "term").mapInArrow(lean(lambda b: _sketch(b, weight, local, span, omega, parts)), "part int, n long, rows binary")
    sums = sums.repartition(parts, "part").mapInArrow(lean(_added), "part int, n long, rows binary").collect()
    total = np.zeros((size, width))
    at = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(size), parts))])
    n = 0
    for r in sums:
        total[at[r.part] : at[r.part + 1]] = np.frombuffer(r.rows).reshape(-1, width)
        n = r.n
    b = items.vectors().astype(float)
    z = total / max(1, n) + b.T @ (b @ omega) / len(b)
    shift = 1e-7 * np.linalg.norm(z)
    z += shift * omega
    core = omega.T @ z
    low = np.linalg.cholesky((core + core.T) / 2 + 1e-12 * np.eye(width) * np.trace(core))
    u, s, _ = np.linalg.svd(np.linalg.solve(low, z.T).T, full_matrices=False)
    return u[:, : min(rank, int((s * s > 2 * shift).sum()) or 1)].astype(np.float32)


def weighted_lcs(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """Largest total weight of a common subsequence of two term sequences."""
    row = np.zeros(len(b) + 1)
    for term in a:
        hit = np.where(b == term, row[:-1] + weight[term], 0.0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], hit))
    return float(row[-1])


def around(at: np.ndarray, worth: np.ndarray, span: int) -> slice:
    """The span words that hold the most worth, as a slice of at (their places, ascending)."""
    upto = np.r_[0.0, np.cumsum(worth)]
    stop = np.searchsorted(at, at + span)
    best = int((upto[stop] - upto[:-1]).argmax())
    return slice(best, int(stop[best]))


def _verified(batches: Iterator[pa.RecordBatch], items: Items, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """d, t, place, term -> the items that a document has, with its best window's cosine and shares."""
    look = items.vectors() @ basis
    look /= np.maximum(np.sqrt((look * look).sum(axis=1, keepdims=True)), 1e-30)
    answers = [w[-max(1, len(w) // 3) :] for w, _, _ in items.wholes]
    whole, ends = [items.idf[w].sum() for w in items.words], [items.idf[w].sum() for w in answers]
    has = [np.unique(w) for w in items.words]
    half = items.window // 2
    held = np.zeros(len(items.idf), bool)

    def shared(words: np.ndarray, seq: np.ndarray) -> float:
        """Weight of the item's words that occur in seq, in any order; bounds what is there in order."""
        held[seq] = True
        weight = items.idf[words][held[words]].sum()
        held[seq] = False
        return weight

    def cosine(c: int, lo: int, hi: int) -> float:
        """Latent cosine of item and the half as many words again around what they share between two places."""
        worth = np.where(np.isin(term[lo:hi], has[c], kind="table"), items.idf[term[lo:hi]], 0.0)
        own, times = np.unique(term[lo:hi][around(at[lo:hi], worth, 3 * len(items.words[c]) // 2 + 1)], return_counts=True)
        taking = items.weight[own] > 0
        own, times = own[taking], times[taking]
        y = (np.sqrt(times) * items.weight[own]) @ basis[items.local[own]]
        return float(y @ look[c] / max(np.sqrt(y @ y), 1e-30))

    def judged(c: int, d: int, w: int) -> tuple[float, float]:
        """Shares of the whole item and of its answer around a window that has enough of a piece, twice as many words to either side as the item has there."""
        words, a, b = items.wholes[c]
        own = at[offsets[d] : offsets[d + 1]]
        lo, hi = offsets[d] + np.searchsorted(own, [w * half - 2 * a, w * half + items.window + 2 * (len(words) - b)])
        seq, total = term[lo:hi], items.idf[words].sum()
        if shared(words, seq) < LOOSE * total:
            return 0.0, 0.0
        return weighted_lcs(words, seq, items.idf) / total, weighted_lcs(answers[c], seq, items.idf) / ends[c]

    for batch in batches:
        best: dict[tuple[int, int], tuple] = {}
        known: dict[tuple[int, int], tuple[float, float]] = {}  # by document and item: long ones that have been found by another piece
        (at, offsets), (term, _) = _ints(batch.column(2)), _ints(batch.column(3))
        for doc, window, own, _, new in _passages(batch.column(2), batch.column(3), items.weight, items.window):
            rows, cols = items.reached(own, new)
            part = None
            for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
                d, w = int(doc[new[r]]), int(window[new[r]])
                if part != r:
                    lo, hi = offsets[d] + np.searchsorted(at[offsets[d] : offsets[d + 1]], [w * half, w * half + items.window])
                    part, seq = r, term[lo:hi]
                words = items.words[c]
                there = shared(words, seq)
                if there < LOOSE * whole[c]:
                    continue
                near = cosine(c, lo, hi)
                if there < SHARE * whole[c] and near < COSINE:
                    continue
                share = weighted_lcs(words, seq, items.idf) / whole[c]
                if share < LOOSE or (share < SHARE and near < COSINE):
                    continue
                if len(words) < len(items.wholes[c][0]):
                    share, answer = known.get((d, int(items.ids[c]))) or judged(c, d, w)
                else:
                    answer = weighted_lcs(answers[c], seq, items.idf) / ends[c]
                if share >= PLAIN or (share >= SHARE and answer >= ANSWER) or (share >= LOOSE and answer >= RECALLED and near >= COSINE):
                    known[d, int(items.ids[c])] = share, answer
                    best[d, c] = max(best.get((d, c), (0.0, 0.0, -1.0)), (share, answer, near))
        if best:
            rows = pa.array([d for d, _ in best])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(items.ids[[c for _, c in best]]), *(pa.array([x[k] for x in best.values()]) for k in (2, 0, 1))], ["d", "t", "item_id", "cosine", "share", "answer"])


def _chunks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Chunk]:
    """Items by length, a chunk at a time; the benchmark itself is read in the order of its length. No item is in two chunks."""
    rows, n = [], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("x")).where("i is not null and x is not null").orderBy(F.length("x"), "i").toLocalIterator():
        words = words_of(r.x)
        more = len(cuts(len(words)))
        if rows and n + more > CHUNK * BLOCK:
            yield Chunk(rows)
            rows, n = [], 0
        if more:
            rows.append((r.i, words))
            n += more
    if rows:
        yield Chunk(rows)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = F.col(text).cast("string")
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.coalesce(own, F.lit(""))).alias("t"), own.alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """d, t, item_id, cosine, share, answer: the benchmark passages that documents hold.

    Passages are overlapping windows of twice the longest item's words. Those that can have LOOSE of
    an item's weight (inverse document frequencies over all documents) in any order are looked at;
    inverted lists of the items' terms give all of them. A candidate's latent cosine with the item,
    over the words around what both share, is COSINE or more; windows that have SHARE of the weight
    in any order are candidates whatever their cosine. An item is held if a common subsequence of
    both carries SHARE of its weight and one of its last third, the answer, ANSWER of that, or PLAIN
    of the whole; as a paraphrase, if it is a candidate by its cosine and LOOSE of the whole and
    RECALLED of the answer are there. Items of more than LONGEST words are searched in even pieces;
    around a piece that is found the whole item is judged so.
    Texts are read once for CHUNK blocks of BLOCK items, which bound what is sent to the tasks; each
    block then has its own latent space and reads the places of its terms only.
    Null, empty and wordless texts and items hold nothing; items without an id are left out; an
    empty table on either side gives an empty result.
    """
    rows = _keyed(docs, doc_id, text).where("text is not null")
    out = None
    for chunk in _chunks(benchmark, item_id, item_text):
        vocabulary, size = chunk.vocabulary, len(chunk.vocabulary)
        terms = settle(rows.mapInArrow(lean(lambda b, v=vocabulary: _terms(b, v)), "d long, t long, place binary, term binary"))
        df = np.zeros(size, np.int64)
        counted = terms.select("term").mapInArrow(lean(lambda b, n=size: _frequencies(b, n)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        for r in counted.collect():  # one row for each term of the chunk
            df[r.term] = r.n
        n = terms.count()
        if not n:
            break
        for items in chunk.blocks(df, n):
            basis = latent_basis(terms, items)
            found = terms.where(F.length("term") > 0).mapInArrow(lean(lambda b, i=items, v=basis: _verified(b, i, v)), "d long, t long, item_id long, cosine double, share double, answer double")
            found = settle(found)
            out = found if out is None else out.union(found)
        discard(terms)
    if out is None:
        return rows.select("d", "t", F.lit(0).cast("long").alias("item_id"), *(F.lit(0.0).alias(c) for c in ("cosine", "share", "answer"))).where("false")
    best = out.groupBy("d", "t", "item_id").agg(F.max(F.struct("share", "answer", "cosine")).alias("b"))
    return best.select("d", "t", "item_id", "b.cosine", "b.share", "b.answer")


def leak_pairs(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """doc_id, item_id, cosine, share, answer: see leaks.

    One row for each document and item, the best window's; equal rows of docs give one row, rows
    with one doc_id and different texts one each. A null doc_id stays null. Null, empty and wordless
    texts and items give none, nor do empty tables; other columns are not read, whatever their names.
    """
    found = leaks(docs, benchmark, **names)
    return found.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "item_id", "cosine", "share", "answer")


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of docs that hold no benchmark passage, with all their columns.

    Repeated rows stay or go together; rows without an id, and rows with one id and different texts,
    are judged one by one. Null and empty texts stay; an empty benchmark removes nothing.
    """
    found = leaks(docs, benchmark, doc_id, text, **names).select("d", "t").distinct()
    own = F.col(text).cast("string")
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.coalesce(own, F.lit(""))).alias("t"))
    return keyed.join(found, ["d", "t"], "left_anti").select("_row.*")
