"""Token ids in a content-addressed store: chunks stored once, document recipes, Merkle manifests.

Layout of a store (Parquet, so that any file system Spark reads will do):

    packs/kind=chunk   digest, body    each different chunk once; body: its ids, little-endian
    recipes            part, doc_id, row, n_tokens, recipe, root
                       ascending doc_id (null last) within and over parts; recipe: the digests of
                       the document's chunks, 16 bytes each; root: their Merkle root
    manifest           part, docs, tokens, start, width, root
                       start: ids of all earlier parts; root: Merkle root of the part's documents,
                       whose leaves are digests of doc_id, n_tokens and recipe root
    head               parts, docs, tokens, root of the whole store; root: of the parts' roots
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, each_text, flat, lean, settling, shuffle_width, work_dir
from .encoding import WordEncoder

#: Ids under the rolling hash, and chunk lengths: 1 in MEAN places is a cut.
WINDOW, LEAST, MEAN, MOST = 16, 32, 256, 2048
#: Text encoded at a time, and words that the encoder holds: what a worker needs is about 90 MB and 30 bytes for each of the one and 250 for each of the other.
GROUP_BYTES, WORDS = 4_000_000, 400_000
#: Digests that a task remembers to have sent.
SENT = 200_000
DIGEST = 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of digests; a last odd one moves up. No leaf: the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        pairs = [digest(a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[2 * len(pairs) :]
    return leaves[0]


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each id a hash of the WINDOW ids that end there (fewer at the beginning)."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    base, span = np.uint64(0xD6E8FEB86659FD93), 1
    with np.errstate(over="ignore"):
        while span < WINDOW:
            h[span:] = h[span:] + h[:-span] * base
            base *= base
            span *= 2
    return h


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, relative to its first id; ends: n + 1 offsets into ids."""
    marks = np.flatnonzero((rolling(ids) >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1
    first = np.searchsorted(marks, ends, "right")
    out = []
    for k in range(len(ends) - 1):
        lo, n, at, own = int(ends[k]), int(ends[k + 1] - ends[k]), 0, []
        # The first WINDOW - 1 places of a document see ids of the one before it, but LEAST rules them out.
        for m in (marks[first[k] : first[k + 1]] - lo).tolist():
            while m - at > MOST:
                at += MOST
                own.append(at)
            if m - at >= LEAST and m < n:
                at = m
                own.append(at)
        while n - at > MOST:
            at += MOST
            own.append(at)
        out.append([*own, n])
    return out


_ENCODERS: dict[tuple, WordEncoder] = {}


def _encoder(path: str, lower: bool, words: int) -> WordEncoder:
    if (path, lower, words) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, lower, words] = WordEncoder(path, lower, words, 8 * words)
    return _ENCODERS[path, lower, words]


def _groups(ids: list, texts: Iterator[bytes], most: int) -> Iterator[tuple[list, list[bytes]]]:
    at, size, held = 0, 0, []
    for text in texts:
        held.append(text)
        size += len(text)
        if size > most:
            yield ids[at : at + len(held)], held
            at, size, held = at + len(held), 0, []
    if held:
        yield ids[at:], held


def _chunker(path: str, lower: bool, end_id: int, wide: bool, words: int = WORDS, at_once: int = GROUP_BYTES):
    form = np.dtype("<u4" if wide else "<u2")

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sent = _encoder(path, lower, words), set()
        task = TaskContext.get()
        uid = (task.partitionId() if task else 0) << 40
        for batch in batches:
            for doc_ids, texts in _groups(batch.column(0).to_pylist(), each_text(batch.column(1)), at_once):
                got, counts = encode(texts)
                counts = counts + 1
                ends = np.r_[0, np.cumsum(counts)]
                ids = np.full(ends[-1], end_id, np.uint32)
                body = np.ones(len(ids), bool)
                body[ends[1:] - 1] = False
                ids[body] = got
                raw, step = ids.astype(form).tobytes(), form.itemsize
                kind, doc, n, key, data, row = [], [], [], [], [], []
                for i, own in enumerate(cuts(ids, ends)):
                    lo, at, recipe = int(ends[i]), 0, []
                    for e in own:
                        piece = raw[(lo + at) * step : (lo + e) * step]
                        d = digest(piece)
                        recipe.append(d)
                        if d not in sent:
                            if len(sent) > SENT:
                                sent.clear()
                            sent.add(d)
                            kind.append("chunk"), doc.append(None), n.append(e - at), key.append(d), data.append(piece), row.append(None)
                        at = e
                    kind.append("doc"), doc.append(doc_ids[i]), n.append(int(counts[i])), key.append(merkle(recipe)), data.append(b"".join(recipe)), row.append(uid)
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(data, pa.binary()), pa.array(row, pa.int64())], ["kind", "doc_id", "n_tokens", "digest", "body", "uid"])

    return chunk


def _part_root(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table[c].to_pylist() for c in ("row", "root", "n_tokens", "doc_id")), strict=True), key=lambda r: r[:3])
    leaves = [digest(b"%s:%s:" % (str(d).encode(), str(n).encode()) + (root or b"")) for _, root, n, d in rows]
    return pa.table({"part": table["part"][:1], "docs": pa.array([len(rows)], pa.int64()), "tokens": pa.array([sum(r[2] or 0 for r in rows)], pa.int64()), "root": pa.array([merkle(leaves)], pa.binary())})


def _part_roots(recipes: DataFrame) -> DataFrame:
    """part, docs, tokens, root of each part; a task holds one part's roots, not its recipes."""
    return recipes.select("part", "row", "doc_id", "root", "n_tokens").groupBy("part").applyInArrow(_part_root, "part int, docs long, tokens long, root binary")


def _head(parts: list) -> tuple[int, int, int, bytes]:
    return len(parts), sum(r.docs for r in parts), sum(r.tokens for r in parts), merkle([bytes(r.root) for r in parts])


def check_manifest(spark: SparkSession, store: str) -> list:
    """The manifest's rows by part, if recipes, manifest and head agree; raises ValueError otherwise.

    Roots, documents and tokens of each part are worked out anew from its recipes, so a recipe that
    was lost, exchanged, repeated or renumbered is found, and a lost part by the head. One row for
    each part reaches the driver: as many as the store was written with shuffle partitions.
    """
    said = spark.read.schema("part int, docs long, tokens long, root binary, start long, width int").parquet(f"{store}/manifest").orderBy("part").collect()
    heads = spark.read.schema("parts int, docs long, tokens long, root binary").parquet(f"{store}/head").collect()
    if len(heads) != 1 or (heads[0].parts, heads[0].docs, heads[0].tokens, bytes(heads[0].root)) != _head(said):
        raise ValueError("the manifest's parts are not those of the store's head")
    at = 0
    for r in said:
        if r.start != at:
            raise ValueError(f"part {r.part} does not start where the one before it ends")
        at += r.tokens
    found = {r.part: (r.docs, r.tokens, bytes(r.root)) for r in _part_roots(_recipes(spark, store)).collect()}
    for part in sorted({r.part for r in said} | found.keys()):
        if found.get(part) != next(((r.docs, r.tokens, bytes(r.root)) for r in said if r.part == part), None):
            raise ValueError(f"part {part} of the recipes does not match its Merkle root")
    return said


def write_store(docs: DataFrame, store: str, path: str, end_id: int = 2, lower: bool = False, wide: bool = False, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, at_once: int = GROUP_BYTES) -> str:
    """Encodes every text, appends end_id and writes the store; returns its path.

    Null and empty texts are documents of end_id alone; columns other than doc_id and text are not
    read, whatever their names; an empty table gives a store without parts. Documents stand in ascending doc_id order,
    null last; rows with the same doc_id are documents of their own, in the order of their roots.
    wide: ids of 4 bytes, for vocabularies of over 65,536. lower: see WordEncoder. Payloads are
    shuffled once, by digest; a task sends a chunk that it meets again only once, so a chunk that
    very many documents share does not fill one task.
    """
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(lean(_chunker(path, lower, end_id, wide, words, at_once)), "kind string, doc_id long, n_tokens long, digest binary, body binary, uid long")
    # Chunks have no uid and go by their digest, of which one row stays; documents are dealt evenly and all stay.
    once = made.repartition(width, "kind", "digest", "uid").dropDuplicates(["kind", "digest", "uid"]).drop("uid")
    with settling(spark):
        once.write.partitionBy("kind").option("compression", "snappy").parquet(f"{store}/packs")
    found = spark.read.schema(once.schema).parquet(f"{store}/packs").where("kind = 'doc'")
    ordered = found.select("doc_id", "n_tokens", F.col("digest").alias("root"), F.col("body").alias("recipe"), F.col("doc_id").isNull().alias("last"))
    ordered = ordered.repartitionByRange(width, "last", "doc_id", "root").sortWithinPartitions("last", "doc_id", "root")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", F.monotonically_increasing_id().alias("row"), "n_tokens", "recipe", "root")
    with settling(spark):
        ordered.write.parquet(f"{store}/recipes")
    parts = sorted(_part_roots(_recipes(spark, store)).collect(), key=lambda r: r.part)  # one row for each part
    starts = np.cumsum([0, *(r.tokens for r in parts)]).tolist()
    rows = [(r.part, r.docs, r.tokens, bytes(r.root), at, 4 if wide else 2) for r, at in zip(parts, starts, strict=False)]
    spark.createDataFrame(rows, "part int, docs long, tokens long, root binary, start long, width int").coalesce(1).write.parquet(f"{store}/manifest")
    spark.createDataFrame([_head(parts)], "parts int, docs long, tokens long, root binary").coalesce(1).write.parquet(f"{store}/head")
    return store


def _recipes(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, row long, n_tokens long, recipe binary, root binary").parquet(f"{store}/recipes")


def _crc_facts(wide: bool):
    import zlib

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = np.dtype("<u4" if wide else "<u2")
        for batch in batches:
            names, crcs, n = batch.column(0), [], []
            data, ends = flat(batch.column(1))
            raw = data.tobytes()
            wide_ids = data.view(form).astype("<u4").tobytes() if form.itemsize == 2 else raw
            grow = 4 // form.itemsize
            for d, s, e in zip(names.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if digest(raw[s:e]) != d:
                    raise ValueError(f"chunk {d.hex()} does not hold what its name says")
                crcs.append(zlib.crc32(wide_ids[s * grow : e * grow]))
                n.append((e - s) // form.itemsize)
            yield pa.RecordBatch.from_arrays([names.cast(pa.binary()), pa.array(crcs, pa.int64()), pa.array(n, pa.int64())], ["digest", "crc", "n"])

    return facts


def _refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        recipes, roots = as_bytes(batch.column(1)), as_bytes(batch.column(2))
        row, seq, name = [], [], []
        for r, recipe, root in zip(batch.column(0).to_pylist(), recipes, roots, strict=True):
            own = [recipe[i : i + DIGEST] for i in range(0, len(recipe), DIGEST)]
            if merkle(own) != root:
                raise ValueError(f"recipe {r} does not match its Merkle root")
            row += [r] * len(own)
            seq += range(len(own))
            name += own
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(seq, pa.int32()), pa.array(name, pa.binary())], ["row", "seq", "digest"])


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC-32 polynomial, in its reflected form."""
    out, b = np.zeros(len(b), np.uint32), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def crc_behind(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each crc gives to the crc of its bytes followed by so many more bytes."""
    crc, power = crc.astype(np.uint32), np.full(1, 0x00800000, np.uint32)  # x^8
    left = zeros.astype(np.int64)
    while left.any():
        odd = np.flatnonzero(left & 1)
        crc[odd] = _times(np.broadcast_to(power, len(odd)), crc[odd])
        power, left = _times(power, power), left >> 1
    return crc


def _join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, seq, crc, n sorted by row and seq; a task has whole rows."""
    held: list[np.ndarray] | None = None

    def done(row: np.ndarray, seq: np.ndarray, crc: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.r_[True, np.diff(row) != 0])
        upto = np.cumsum(n)
        last = np.r_[new[1:], len(row)] - 1
        behind = np.repeat(upto[last], np.diff(np.r_[new, len(row)])) - upto
        whole = np.bitwise_xor.reduceat(crc_behind(crc, 4 * behind), new)
        return pa.RecordBatch.from_arrays([pa.array(row[new]), pa.array(np.add.reduceat(n, new)), pa.array(whole.astype(np.int64))], ["row", "read", "ids_crc32"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy() for k in range(4)]
        now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield done(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
    if held:
        yield done(*held)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of the store.

    The manifest is checked first (see check_manifest). Each chunk's ids are read, checked against its name and summed; each document's sum comes from
    those of its chunks in the order of its recipe, so payloads are not shuffled again. A wrong
    chunk, recipe or count fails the job.
    """
    said = check_manifest(spark, store)
    wide = bool(said) and said[0].width == 4
    width = shuffle_width(spark)
    packs = spark.read.schema("digest binary, body binary, kind string").parquet(f"{store}/packs").where("kind = 'chunk'")
    facts = packs.select("digest", "body").mapInArrow(lean(_crc_facts(wide)), "digest binary, crc long, n long")
    recipes = _recipes(spark, store)
    refs = recipes.select("row", "recipe", "root").mapInArrow(lean(_refs), "row long, seq int, digest binary")
    joined = refs.join(facts, "digest").select("row", "seq", "crc", "n").repartition(width, "row").sortWithinPartitions("row", "seq")
    sums = joined.mapInArrow(lean(_join_crcs), "row long, read long, ids_crc32 long")
    manifest = spark.read.parquet(f"{store}/manifest").select("part", F.col("start").alias("base"))
    own = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("part", "row", "doc_id", "n_tokens").withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    out = placed.join(manifest, "part").join(sums, "row", "left")
    whole = F.when(F.col("read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's chunks do not give its ids")))
    return out.select("doc_id", (F.col("base") + F.col("own")).alias("start"), whole.cast("long").alias("n_tokens"), "ids_crc32")


def token_store(docs: DataFrame, path: str, end_id: int = 2, lower: bool = False, wide: bool = False, store: str | None = None, words: int = WORDS, at_once: int = GROUP_BYTES) -> DataFrame:
    """Writes the store in a shared folder and returns what read_store finds there.

    words and at_once bound what a worker holds, see WORDS; the ids are the same. Empty input: an
    empty store and no rows. Other columns of docs are not read.
    """
    store = store or work_dir(docs.sparkSession)
    return read_store(docs.sparkSession, write_store(docs, store, path, end_id, lower, wide, words=words, at_once=at_once))
