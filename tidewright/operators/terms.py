"""Domain terms: extraction from text, grounding with capped confidence, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word ends where letters of all scripts, digits and _ are words, as \b is not everywhere.
_A, _Z = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Acronyms, words with digits, up to three capitalised words; in this order.
PATTERNS = tuple(_A + p + _Z for p in (r"[A-Z]{2,}", r"[A-Za-z]+\d+[A-Za-z\d]*", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"))
#: Source of a definition, default confidence, highest confidence.
CONFIDENCE = (("library", 1.0, 1.0), ("analyst", 0.70, 0.80), ("llm_parametric", 0.50, 0.60), ("inference_chain", 0.75, 0.90))


def extract(docs: DataFrame, registered: DataFrame | None = None, text: str = "text", order: str = "doc_id") -> DataFrame:
    """text, frequency, rank of candidate terms, counted however they are cased; the first casing met is kept.

    First: by pattern, then document, then place. Terms that registered (text) has are left out.
    rank: more frequent first, then by spelling.
    """
    hits = F.array(*[F.struct(F.lit(i).alias("pass"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("found")) for i, p in enumerate(PATTERNS)])
    rows = docs.select(F.col(order).alias("doc"), F.inline(hits)).select("doc", "pass", F.posexplode("found").alias("place", "term"))
    rows = rows.select("doc", "pass", "place", F.trim("term").alias("term")).where("term <> ''")
    out = rows.groupBy(F.lower("term").alias("key")).agg(F.count("*").alias("frequency"), F.min(F.struct("pass", "doc", "place", "term")).alias("first"))
    if registered is not None:
        out = out.join(registered.select(F.lower("text").alias("key")).distinct(), "key", "left_anti")
    return out.select("key", F.col("first.term").alias("text"), "frequency")


def ranked(terms: DataFrame, top: int) -> DataFrame:
    """The top most frequent terms."""
    return terms.orderBy(F.desc("frequency"), "key").limit(top)


def ground(terms: DataFrame) -> DataFrame:
    """terms (text, definition, source, confidence or null) with confidence by its source's default and cap, and error.

    library is 1 whatever is given. Of terms that are the same but for case the second is in error.
    """
    source, given = F.col("source"), F.col("confidence")
    default = F.coalesce(*[F.when(source == s, F.lit(d)) for s, d, _ in CONFIDENCE])
    cap = F.coalesce(*[F.when(source == s, F.lit(c)) for s, _, c in CONFIDENCE])
    value = F.when(source == "library", 1.0).otherwise(F.coalesce(given, default))
    error = F.when(cap.isNull(), "source").when((given < 0) | (given > 1), "confidence").when(value > cap, "cap").when(F.trim("definition") == "", "definition")
    return terms.withColumn("error", error).withColumn("confidence", value)


def metric_errors(metrics: DataFrame) -> Column:
    """Why a metric may not be registered: four plausibility values, and a URL unless an analyst vouches."""
    return F.when(F.size("plausibility") != 4, "plausibility").when((F.col("source") != "analyst") & (F.coalesce(F.trim("url"), F.lit("")) == ""), "url")


def unique_metrics(metrics: DataFrame) -> DataFrame:
    """The first by seq of each name and stored domain."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.lower("name"), "domain").orderBy("seq"))
    return metrics.withColumn("_n", n).where("_n = 1").drop("_n")


def alias_map(aliases: DataFrame, grounded: DataFrame) -> DataFrame:
    """aliases (canonical, aliases, region) of grounded terms, exploded; others are left out."""
    g = grounded.select(F.lower("text").alias("k"), "text").distinct()
    return aliases.withColumn("k", F.lower(F.trim("canonical"))).join(g, "k").select(F.col("text").alias("canonical"), F.explode("aliases").alias("alias"), "region")


def verified(sources: DataFrame) -> DataFrame:
    """sources with verified: answered with 200, or cited."""
    return sources.withColumn("verified", F.coalesce(F.col("http_status") == 200, F.lit(False)) | (F.coalesce(F.trim("citation"), F.lit("")) != ""))


def promotable(items: DataFrame) -> DataFrame:
    """Metrics and sources that may be promoted: kind, source, verified decide."""
    return items.where(~((F.col("kind") == "metric") & (F.col("source") == "llm_parametric")) & ~((F.col("kind") == "source") & ~F.coalesce("verified", F.lit(False))))


def metrics_document(metrics: DataFrame) -> DataFrame:
    """domain, metrics: promoted metrics of each domain as a map of name to plausibility."""
    own = metrics.where("promoted")
    return own.groupBy("domain").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "plausibility")))).alias("metrics"))


def gate(state: DataFrame, tier: Column | str = "STANDARD") -> DataFrame:
    """state (grounded, library, metrics_promoted, aliases, verified, candidates) with failures and pass.

    STANDARD needs 10 terms, 3 metrics and an alias, LITE 5 terms; both need 30 % of terms from the
    library, 2 verified sources, and an extraction that was run.
    """
    tier = F.lit(tier) if isinstance(tier, str) else tier
    lite = tier == "LITE"
    share = F.col("library") / F.nullif(F.col("grounded"), F.lit(0))
    rules = {
        "extract": F.col("grounded") + F.col("candidates") > 0,
        "terms": F.col("grounded") >= F.when(lite, 5).otherwise(10),
        "library": F.coalesce(share >= 0.30, F.lit(True)),
        "metrics": lite | (F.col("metrics_promoted") >= 3),
        "sources": F.col("verified") >= 2,
        "aliases": lite | (F.col("aliases") > 0),
    }
    failures = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return state.withColumn("failures", failures).withColumn("pass", F.size("failures") == 0)
