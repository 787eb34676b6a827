"""Language identification: text likelihoods fused with declared language, address and host priors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, lean, settle

#: Labelled texts that the likelihoods are fitted on, for each language; languages at most, so that the model's size is bounded; texts that make one.
SAMPLE, LANGUAGES, LEAST = 400, 256, 5
BITS = 16
#: Neighbouring grams say much the same: their evidence counts by this share.
TEMPER = 0.2
#: Pseudo-counts of a host's prior (of its domain), of a domain's (of all), and of the evidence tables.
HOST, DOMAIN, EVEN = 5.0, 20.0, 1.0
#: Rejected below this posterior, or where the text is no likelier than letters at random.
SURE = 0.5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the three-byte grams of folded text: ASCII letters small, all else in ASCII a space."""
    x = _FOLD[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    with np.errstate(over="ignore"):
        return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _blank() -> int:
    return int(grams(np.full(3, 32, np.uint8))[0])


def _histograms(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    """lang, text -> for each language the non-zero counts of its grams."""
    total = np.zeros((len(languages), 1 << BITS), np.int64)
    at = {x: k for k, x in enumerate(languages)}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            total[at[lang]] += np.bincount(grams(np.frombuffer(b" " + text + b" ", np.uint8)), minlength=1 << BITS)
    lang, gram = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(gram.astype(np.int32)), pa.array(total[lang, gram])], ["lang", "gram", "n"])


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        counts = counts.astype(float)
        counts[:, _blank()] = 0
        smooth = 0.5
        table = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * (1 << BITS)))
        table[:, _blank()] = 0
        self.table = np.ascontiguousarray(table.T, np.float32)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Gram frequencies of each language from at most sample different labelled texts, those with the least hashes.

    Labels with fewer than LEAST texts make no language, and of more than LANGUAGES the
    most frequent ones do; see document_languages for what is declared to be in another. Only
    whole texts are counted; rows without text or label are not. A language's texts are thinned by
    their hashes to a few times sample before any are ordered, so a language that most rows have
    costs no more than another.
    """
    place = F.xxhash64("text", F.lit(3))
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and length(trim(text)) > 0")
    different = settle(rows.groupBy("lang", place.alias("place")).agg(F.count("*").alias("texts")))
    found = different.groupBy("lang").agg(F.sum("texts").alias("texts"), F.count("*").alias("different")).where(F.col("texts") >= LEAST).orderBy(F.desc("texts"), "lang").limit(LANGUAGES)
    found = settle(found).collect()
    languages = sorted(r.lang for r in found)
    counts = np.zeros((len(languages), 1 << BITS), np.int64)
    if languages:
        # One row for each language; four times as many texts as are wanted stay on average.
        share = labelled.sparkSession.createDataFrame([(r.lang, min(1.0, 4.0 * sample / r.different)) for r in found], "lang string, share double")
        thin = different.join(F.broadcast(share), "lang").where((F.col("place") / F.lit(float(1 << 64)) + 0.5) <= F.col("share"))
        chosen = thin.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("n") <= sample).select("lang", "place")
        # At most sample x LANGUAGES rows of two columns.
        own = rows.withColumn("place", place).join(F.broadcast(chosen), ["lang", "place"], "left_semi").dropDuplicates(["lang", "place"])
        for r in own.select("lang", "text").mapInArrow(lean(lambda b: _histograms(b, languages)), "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r.lang, r.gram] = r.n
    return Model(languages, counts)


def _scores(batches: Iterator[pa.RecordBatch], model: Model, step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """..., text -> the other columns, the number of grams and the text's log-likelihood in each language."""
    table, blank, k = model.table, _blank(), len(model.languages)
    for batch in batches:
        data, ends = flat(batch.column(batch.num_columns - 1))
        n, like = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, k))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + step, "right")) - 1)
            for lo in range(int(ends[at]), max(int(ends[to]), int(ends[at]) + 1), 4 * step):  # more than one part only for one long text
                hi = min(int(ends[to]), lo + 4 * step + 2) if to == at + 1 else int(ends[to])
                g = grams(data[lo:hi])
                if not len(g):
                    continue
                here = table[g]
                seen = g != blank
                starts, stops = np.clip(ends[at:to] - lo, 0, len(g)), np.clip(ends[at + 1 : to + 1] - 2 - lo, 0, len(g))
                sums = np.zeros((len(g) + 1, k))
                np.cumsum(here, axis=0, out=sums[1:], dtype=float)
                count = np.r_[0, np.cumsum(seen)]
                stops = np.maximum(starts, stops)
                like[at:to] += sums[stops] - sums[starts]
                n[at:to] += count[stops] - count[starts]
                if to > at + 1:
                    break
            at = to
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * batch.num_rows + 1, k), pa.int32()), pa.array(like.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), lists], [*batch.schema.names[:-1], "n", "like"])


def _softmax(scores: Column) -> Column:
    shifted = F.transform(F.array(F.struct(scores.alias("s"), F.array_max(scores).alias("m"))), lambda x: F.transform(x["s"], lambda v: F.exp(v - x["m"])))[0]
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def _plus(*terms: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), terms)


def _sums(rows: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """Soft counts of the languages for each key, summed before they are shuffled."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("by_text")[i]) for i in range(k)]).alias(name))


def identify(docs: DataFrame, model: Model, keep: list[str], text: Column, declared: Column, suffix: Column, host: Column, domain: Column, sure: float = SURE) -> DataFrame:
    """keep, declared, n, language, posterior, kept of every row of docs.

    The text's likelihood alone gives each document soft counts of the languages. Summed by
    declared language and by address suffix they say how either goes with the languages; summed by
    host, its domain and overall they are priors, each smoothed towards the next. A document's own
    counts are taken out of its host's. The posterior fuses all four; what is null says nothing.
    Texts are read between spaces, so one letter is enough.
    kept: the text has grams, is likelier than letters at random, and the posterior is sure or more.
    """
    k, names = len(model.languages), model.languages
    pairs = [F.col(c) for c in keep]
    rows = docs.select(*pairs, declared.cast("string").alias("declared"), suffix.cast("string").alias("suffix"), host.cast("string").alias("host"), domain.cast("string").alias("domain"), F.concat(F.lit(" "), F.coalesce(text.cast("string"), F.lit("")), F.lit(" ")).alias("text"))
    if not k:
        return rows.select(*keep, "declared", F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("kept"))
    held = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    rows = rows.mapInArrow(lean(lambda b: _scores(b, model)), f"{held}, n long, like array<double>")
    none = F.array_repeat(F.lit(0.0), k)
    rows = settle(rows.withColumn("by_text", F.when(F.col("n") > 0, _softmax(F.transform("like", lambda x: x * TEMPER))).otherwise(none)))
    overall = rows.agg(*[F.sum(F.col("by_text")[i]).alias(f"c{i}") for i in range(k)]).first()
    whole = np.array([x or 0.0 for x in overall]) + EVEN
    base = whole / whole.sum()
    lit = lambda x: F.array(*[F.lit(float(v)) for v in x])

    def evidence(keys: str, name: str) -> DataFrame:
        """Log of the share of each language's documents that have this value, up to a factor for all languages."""
        sums = _sums(rows.where(F.col(keys).isNotNull()), [keys], k, "c")
        return sums.select(F.col(keys), F.zip_with("c", lit(whole), lambda c, w: F.log((c + EVEN * 0.1) / w)).alias(name))

    domains = _sums(rows.where("domain is not null"), ["domain"], k, "dc")
    hosts = _sums(rows.where("host is not null"), ["domain", "host"], k, "hc")
    out = rows.join(evidence("declared", "said"), "declared", "left").join(evidence("suffix", "placed"), "suffix", "left")
    out = out.join(domains, "domain", "left")
    hosts = hosts.select(F.col("domain").alias("domain_"), F.col("host").alias("host_"), "hc")
    out = out.join(hosts, F.col("host").eqNullSafe(F.col("host_")) & F.col("domain").eqNullSafe(F.col("domain_")), "left")

    def smoothed(counts: Column, own: Column, prior: Column, strength: float) -> Column:
        rest = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
        return F.transform(F.array(rest), lambda r: F.zip_with(r, prior, lambda c, p: (c + strength * p) / (F.aggregate(r, F.lit(0.0), lambda a, b: a + b) + strength)))[0]

    out = out.withColumn("prior", smoothed(F.coalesce("dc", none), F.when(F.col("dc").isNotNull(), F.col("by_text")).otherwise(none), lit(base), DOMAIN))
    out = out.withColumn("prior", smoothed(F.coalesce("hc", none), F.when(F.col("hc").isNotNull(), F.col("by_text")).otherwise(none), F.col("prior"), HOST))
    fused = _plus(F.transform("like", lambda x: x * TEMPER), F.transform("prior", lambda p: F.log(p)), F.coalesce("said", none), F.coalesce("placed", none))
    out = out.withColumn("all", _softmax(fused)).withColumn("posterior", F.array_max("all"))
    language = F.get(lit_names(names), (F.array_position("all", F.col("posterior")) - 1).cast("int"))
    random = -float(np.log(1 << BITS))
    likely = F.array_max("like") > F.col("n") * random
    kept = (F.col("n") > 0) & likely & (F.col("posterior") >= sure)
    return out.select(*keep, "declared", "n", F.when(F.col("n") > 0, language).alias("language"), "posterior", kept.alias("kept"))


def lit_names(names: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in names])


def document_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", extra: list[Column] | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, declared, language, posterior, kept of every row of docs.

    The column lang is both the label of the bounded sample that the likelihoods are fitted on and
    the declared language of each document. Its source is its host, and where that is the name of
    one (labels parted by dots, or an address that has it) also has a suffix and a domain.
    A declared language without a model cannot be told: language is null, and what has letters is
    kept. Null, empty or letterless texts have language null and are not kept; a null lang or source
    gives no evidence; repeated rows are judged alike. Without any labelled text nothing is kept;
    an empty table gives an empty result. Other columns are not read.
    """
    model = fit(docs, text, lang, sample)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_host"), *(extra or []))
    more = rows.columns[4:]
    suffix, host, domain = address_parts(F.col("_host"))
    out = identify(rows, model, ["doc_id", *more], F.col("_text"), F.col("_lang"), suffix, F.coalesce(host, F.col("_host")), domain)
    strange = F.col("declared").isNotNull() & ~F.coalesce(F.col("declared").isin(model.languages), F.lit(False))
    language = F.when(~strange | F.lit(not model.languages), F.col("language")).alias("language")
    return out.select("doc_id", *more, "declared", language, "posterior", (F.col("kept") | (strange & (F.col("n") > 0) & F.lit(bool(model.languages)))).alias("kept"))


def address_parts(address: Column) -> tuple[Column, Column, Column]:
    """Suffix, host and domain of an address or of the bare name of a host; null where there is none.

    Suffix: the first part of the path if it has two letters, else the last label of the host's
    name; domain: its last two labels.
    """
    bare = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?((?:[\w-]+\.)+[A-Za-z][\w-]*)(?::\d+)?(?:[/?#]|$)", 1))
    host = F.nullif(bare, F.lit(""))
    path = F.nullif(F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([A-Za-z]{2})(?:/|$)", 1)), F.lit(""))
    suffix = F.coalesce(path, F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")))
    return suffix, host, F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))


def in_known_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of docs that document_languages keeps, with all their columns."""
    last = F.lit((1 << 63) - 1)
    t = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    judged = document_languages(docs, doc_id, text, extra=[t.alias("_t")], **names)
    dropped = judged.where(~F.col("kept")).select(F.coalesce("doc_id", last).alias("d"), "_t").distinct()
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(doc_id).cast("long"), last).alias("d"), t.alias("_t"))
    return keyed.join(dropped, ["d", "_t"], "left_anti").select("_row.*")


def page_languages(pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, declared, language, posterior, kept of web pages.

    Text: what is left without scripts, styles, comments and tags. Declared: the html tag's lang;
    suffix, host and domain: see address_parts. Null pages and addresses give no evidence, and null,
    empty or letterless pages have language null and are not kept; repeated rows, and rows with one
    page_id, are judged one by one. An empty table gives an empty result, and without any labelled
    text nothing is kept. Other columns are not read, whatever their names.
    """
    model = fit(labelled)
    body = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>|<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract(F.col(html), r"(?i)<html[^>]*?\blang=[\"']?([a-z]{2})", 1)), F.lit(""))
    suffix, host, domain = address_parts(F.col(url))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), body.alias("_text"), declared.alias("_lang"), suffix.alias("_suffix"), host.alias("_host"), domain.alias("_domain"))
    out = identify(rows, model, ["page_id"], *(F.col(c) for c in ("_text", "_lang", "_suffix", "_host", "_domain")))
    return out.select("page_id", "declared", "language", "posterior", "kept")
