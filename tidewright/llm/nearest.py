"""Nearest neighbours by cosine: stable projections indexed by kd-trees, searched until a chi-square test holds."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, settle, shuffle_width

#: Projected dimensions, and the probability with which a vector that was left out would not have been nearer.
DIMENSIONS, CERTAINTY = 24, 0.97
SEED = 5
#: Vectors that the splits of the index are fitted on, at most, and for each cell at least; vectors in a leaf, and about as many in a part of a cell at most.
SAMPLE, FITTED, LEAF, CELL = 20_000, 8, 64, 8_192


def chi2_cdf(x: np.ndarray, k: int) -> np.ndarray:
    """Probability that a chi-square variable of k degrees of freedom is at most x, by its series."""
    h = np.minimum(np.asarray(x, float) / 2, 400.0)
    term = np.exp(np.where(h > 0, k / 2 * np.log(np.maximum(h, 1e-300)) - h, -np.inf) - lgamma(k / 2 + 1))
    total = term.copy()
    for n in range(1, 2000):
        term = term * h / (k / 2 + n)
        total += term
        if not (term > 1e-14 * total).any():
            break
    return np.minimum(total, 1.0)


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 10.0 * k + 100.0
    while hi - lo > 1e-9 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(np.array([mid]), k)[0] < p else (lo, mid)
    return hi


def projection(size: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Normal entries: the squared length of a projected difference is the true one times a chi-square."""
    return np.random.default_rng([seed, size]).standard_normal((size, dimensions))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of y with each row of x, in double precision, on the vectors as they are."""
    return (x @ y) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum()))


class Cells:
    """The upper levels of a kd-tree, fitted on a sample: cells that hold about as many vectors each."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.axis, self.at = depth, np.zeros(max(1, 1 << depth), np.int64), np.zeros(max(1, 1 << depth))
        self._split(points, 1, 0)

    def _split(self, points: np.ndarray, node: int, level: int) -> None:
        if level == self.depth:
            return
        if len(points):
            spread = points.max(axis=0) - points.min(axis=0)
            self.axis[node], self.at[node] = spread.argmax(), np.median(points[:, spread.argmax()])
        right = points[:, self.axis[node]] > self.at[node]
        self._split(points[~right], 2 * node, level + 1)
        self._split(points[right], 2 * node + 1, level + 1)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - (1 << self.depth)

    def reached(self, points: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of point and cell whose squared distance is at most the point's limit, by descent from the root.

        off holds, for each way down, how far the point lies beyond the cell in each dimension.
        """
        q, node, off = np.arange(len(points)), np.ones(len(points), np.int64), np.zeros(points.shape)
        for _ in range(self.depth):
            axis = self.axis[node]
            over = points[q, axis] - self.at[node]
            near = 2 * node + (over > 0)
            far = off.copy()
            rows = np.arange(len(q))
            far[rows, axis] = np.maximum(far[rows, axis], np.abs(over))
            go = (far * far).sum(axis=1) <= most[q]
            q, node, off = np.r_[q, q[go]], np.r_[near, near[go] ^ 1], np.concatenate([off, far[go]])
        return q, node - (1 << self.depth)


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """The leaves of a kd-tree over points, as index arrays of at most size."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        p = points[own]
        axis = (p.max(axis=0) - p.min(axis=0)).argmax()
        half = len(own) // 2
        order = np.argpartition(p[:, axis], half)
        todo += [own[order[:half]], own[order[half:]]]
    return out


class Index:
    """A kd-tree over the projections of one cell's vectors, which are held as they are."""

    def __init__(self, vectors: np.ndarray, spread: np.ndarray):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        points = unit(vectors) @ spread
        self.points, self.leaves = points, leaves(points)
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])

    def search(self, query: np.ndarray, point: np.ndarray, k: int, bound: float, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and cosines of vectors among which each of the k nearest is with CERTAINTY, and how many were verified.

        Vectors are met leaf by leaf and within a few leaves by their projected distance, and
        verified until the test holds: if an unseen vector were nearer than the k-th found, at
        squared distance d, its squared projected distance over d would be chi-square, and that of
        all others is beyond the law's quantile (limit). bound: the k-th squared distance already
        known from elsewhere.
        """
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        near = (gap * gap).sum(axis=1)
        order = np.argsort(near)
        length = np.sqrt((query * query).sum())
        best, places, scores, at, step, n = bound, [], [], 0, 4, 0
        held = np.empty(0)
        while at < len(order) and near[order[at]] <= limit * best:
            part = order[at : at + step]
            own = np.concatenate([self.leaves[j] for j in part[near[part] <= limit * best]])
            away = self.points[own] - point
            away = (away * away).sum(axis=1)
            sorted_ = np.argsort(away)
            own, away = own[sorted_], away[sorted_]
            lo = 0
            while lo < len(own) and away[lo] <= limit * best:
                some = own[lo : lo + 64][away[lo : lo + 64] <= limit * best]
                cos = (self.vectors[some] @ query) / (self.norms[some] * length)
                places.append(some), scores.append(cos)
                held = np.sort(np.r_[held, cos])[-k:]
                if len(held) == k:
                    best = min(best, max(0.0, 2 - 2 * held[0]) + 1e-12)
                lo, n = lo + 64, n + len(some)
            at, step = at + step, min(64, 2 * step)
        if not places:
            return np.empty(0, np.int64), np.empty(0), 0
        places, scores = np.concatenate(places), np.concatenate(scores)
        keep = scores >= (held[0] if len(held) == k else -2)
        return places[keep], scores[keep], n


def usable(vector: str = "vector") -> Column:
    """Vectors with at least one component, none null or non-finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, itself apart, by cosine.

    table and queries both have vec_id and vector. Ties go to the smaller vec_id. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do rows without a vec_id;
    vectors are compared with those of the same size only. Equal vectors are searched as one, with
    the k + 1 smallest ids that they have, which no result can exceed. Repeated vec_ids count as
    they stand, each different vector of a query's id is a query, and none finds its own id. An empty table gives an empty result.

    Vectors are dealt to the cells of a kd-tree over DIMENSIONS normal projections; its splits are
    fitted on SAMPLE vectors at most, all vectors are indexed. Cells that hold more than CELL
    vectors, as a bounded sample cannot split without end, are dealt in parts. A query is searched
    in a part of its own cell first; what it found there decides to which others it must go at all.
    A task holds the vectors of one part and reads queries as they come.
    """
    width = shuffle_width(table.sparkSession)
    cols = [F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")]
    fit = usable()
    rows = table.select(*cols).where(fit & F.col("id").isNotNull())
    alike = Window.partitionBy("vector").orderBy("id")
    firsts = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1)
    classes = settle(firsts.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = settle(queries.select(*cols).where(fit & F.col("id").isNotNull()).dropDuplicates(["id", "vector"]))
    sizes = [r[0] for r in classes.select(F.size("vector")).distinct().collect()]
    out = None
    for size in sizes:
        part = _nearest_of(classes.where(F.size("vector") == size), asked.where(F.size("vector") == size), size, k, width)
        out = part if out is None else out.union(part)
    if out is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    return out


_FOUND = "query_id long, q long, score double, vec_id long"


def _searched(spread: np.ndarray, limit: float, k: int):
    """part, kind, vector, ids, query_id, q, bound, by part and kind: the part's vectors (0) before its queries (1)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, ids, index = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(kind) != 0), True])
            found: list[tuple] = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if part[a] != now:
                    now, vectors, ids, index = part[a], [], [], None
                own = _matrix(batch.column(2).slice(a, b - a))
                if kind[a] == 0:
                    vectors.append(own)
                    ids += batch.column(3).slice(a, b - a).to_pylist()
                    continue
                if not vectors:
                    continue
                index = index or Index(np.concatenate(vectors), spread)
                points = unit(own) @ spread
                for x, p, r in zip(own, points, range(a, b), strict=True):
                    query_id, q = batch.column(4)[r].as_py(), batch.column(5)[r].as_py()
                    # One more than asked: the query's own vector may be among them.
                    places, scores, _ = index.search(x, p, k + 1, batch.column(6)[r].as_py(), limit)
                    hits = sorted((-c, i) for at, c in zip(places.tolist(), scores.tolist(), strict=True) for i in ids[at] if i != query_id)[:k]
                    found += [(query_id, q, -c, i) for c, i in hits]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", "q", "score", "vec_id"])

    return look


def _nearest_of(classes: DataFrame, asked: DataFrame, size: int, k: int, width: int) -> DataFrame:
    spread = projection(size)
    limit = chi2_quantile(CERTAINTY, DIMENSIONS)
    total = classes.count()
    sample = classes.select("vector").sample(False, min(1.0, 1.2 * SAMPLE / max(1, total)), SEED).limit(SAMPLE).toPandas()
    depth = min(int(np.ceil(np.log2(max(1, total / CELL)))), int(np.log2(max(1, len(sample) / FITTED)))) if len(sample) else 0
    points = unit(np.array(sample["vector"].tolist(), float)) @ spread if len(sample) else np.zeros((0, DIMENSIONS))
    cells = Cells(points, depth)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = cells.of(unit(_matrix(batch.column(0))) @ spread)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0), batch.column(1)], ["cell", "vector", "ids"])

    of_cell = "cell long, vector array<double>, ids array<long>"
    placed = settle(classes.select("vector", "ids").mapInArrow(lean(dealt), of_cell))
    # One row for each cell, of which there are SAMPLE / FITTED at most.
    counts = np.zeros(1 << depth, np.int64)
    for r in placed.groupBy("cell").count().collect():
        counts[r.cell] = r["count"]
    parts = np.maximum(1, -(-counts // CELL))
    first = np.cumsum(parts) - parts

    def to_part(cell: np.ndarray, by: np.ndarray) -> np.ndarray:
        return first[cell] + by % parts[cell]

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(to_part(batch.column(0).to_numpy(), batch.column(1).to_numpy() >> 16)), batch.column(2), batch.column(3)], ["part", "vector", "ids"])

    held = placed.select("cell", F.xxhash64("vector").alias("by"), "vector", "ids").mapInArrow(lean(spread_out), "part long, vector array<double>, ids array<long>")
    none = [F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("double").alias("bound")]
    held = held.select("part", F.lit(0).alias("kind"), "vector", "ids", *none)
    queries = settle(asked.select("vector", F.array("id").alias("ids")).mapInArrow(lean(dealt), of_cell).select("cell", "vector", F.col("ids")[0].alias("query_id"), F.xxhash64(F.col("ids")[0], "vector").alias("q")))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """cell, vector, query_id, q, bound -> a row for each part to search: at home one (bound null), then all others that are reached."""
        for batch in batches:
            if not batch.num_rows:
                continue
            home = to_part(batch.column(0).to_numpy(), batch.column(3).to_numpy() >> 16)
            if batch.column(4).null_count:
                go, part, most = np.arange(len(home)), home, np.full(len(home), 8.0)
            else:
                most = batch.column(4).to_numpy()
                go, cell = cells.reached(unit(_matrix(batch.column(1))) @ spread, limit * most)
                n = parts[cell]
                go, part = np.repeat(go, n), np.repeat(first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                go, part = go[part != home[go]], part[part != home[go]]
            for lo in range(0, len(go), 4096):
                own = batch.take(pa.array(go[lo : lo + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(part[lo : lo + 4096]), own.column(1), own.column(2), own.column(3), pa.array(most[go[lo : lo + 4096]])], ["part", "vector", "query_id", "q", "bound"])

    def search(coming: DataFrame) -> DataFrame:
        rows = coming.select("cell", "vector", "query_id", "q", "bound").mapInArrow(lean(sent), "part long, vector array<double>, query_id long, q long, bound double")
        rows = held.union(rows.select("part", F.lit(1).alias("kind"), "vector", F.lit(None).cast("array<long>").alias("ids"), "query_id", "q", "bound"))
        return rows.repartition(width, "part").sortWithinPartitions("part", "kind").mapInArrow(lean(_searched(spread, limit, k)), _FOUND)

    at_home = settle(search(queries.withColumn("bound", F.lit(None).cast("double"))))
    # The distance of the k-th found at home; a query with fewer must go everywhere.
    bound = at_home.groupBy("query_id", "q").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    bound = queries.join(bound, ["query_id", "q"], "left").withColumn("bound", F.when(F.col("n") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.col("low")) + 1e-9).otherwise(8.0))
    ranked = at_home.union(search(bound)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
