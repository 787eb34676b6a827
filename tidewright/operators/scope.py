"""Scope and abduction: candidate causes, what they explain, and the gates they must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, pearson_p, tokens
from .stats import pearson

#: Own small defaults; users read theirs from JSON with read_catalog.
ARCHETYPES = (
    ("thin_market", "capital from abroad", "money arrives for reasons outside the market", 0.15, "prices move without local demand"),
    ("thin_market", "store of value", "buyers hold rather than use", 0.2, "volume falls while prices rise"),
    ("hosted_service", "upstream provider", "an external service sets the pace", 0.25, "latency steps at provider changes"),
    ("hosted_service", "cache tiers", "answers depend on what was asked before", 0.2, "repeat calls are faster"),
    ("organisation", "incentive scheme", "reported numbers drive pay", 0.2, "results cluster at targets"),
    ("control_loop", "operator override", "people step in at limits", 0.15, "corrections at round values"),
)
TRACES = (
    ("generic", "unrecorded input", "a channel outside the record drives the output", 0.2, 1.0),
    ("generic", "measurement artefact", "the way of measuring makes the effect", 0.15, 1.0),
    ("timing", "contention", "requests wait for a shared resource", 0.25, 1.0),
    ("timing", "schedule", "a job runs at fixed times", 0.2, 1.0),
    ("failure", "resource limit", "a limit is reached under load", 0.25, 1.5),
    ("output_anomaly", "state left over", "earlier work changes the answer", 0.2, 1.5),
)
#: Provenances, and the highest prior and ratio of what a language model proposes alone.
SOURCES = ("library", "analyst", "llm_parametric", "inference_chain")
MODEL_PRIOR, MODEL_RATIO = 0.30, 2.0


def archetypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARCHETYPES, "archetype_id string, domain string, mechanism string, prior double, signature string")


def traces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRACES, "category string, cause string, mechanism string, prior double, complexity double")


def read_catalog(spark: SparkSession, path: str, item: str) -> DataFrame:
    """key, value: a JSON object of entries as rows, keys that start with _ left out; item is the entries' type in DDL."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{item}>", {"mode": "FAILFAST"}).alias("m"))
    return raw.select(F.explode("m").alias("key", "value")).where(~F.col("key").startswith("_"))


def dedupe(candidates: DataFrame) -> DataFrame:
    """The first by seq of each domain, however it is spelled."""
    key = F.lower(F.trim("domain"))
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where("_n = 1").drop("_n")


def enumerate_archetype(queries: DataFrame, library: DataFrame) -> DataFrame:
    """queries (audit, archetype_id) with the library's accomplices as candidates; a missing prior is 0.15."""
    return queries.join(library, "archetype_id").select("audit", "archetype_id", "domain", "mechanism", F.coalesce("prior", F.lit(0.15)).alias("prior"))


def trace_flows(audits: DataFrame) -> DataFrame:
    """audit, direction, channel: one row for each input and output, none in scope yet. audits: audit, inputs, outputs."""
    side = lambda c: audits.select("audit", F.lit(c[:-1]).alias("direction"), F.explode(c).alias("channel"), F.lit(False).alias("in_scope"))
    return side("inputs").union(side("outputs"))


#: Who may speak against a scope, and the prior of what they name.
PERSONAS = ("outsider", "journalist", "regulator")
STEELMAN_PRIOR = 0.15


def steelman(critiques: DataFrame) -> DataFrame:
    """audit, domain, mechanism, prior, source: a candidate for each critique (audit, persona, domain, mechanism); an unknown persona is an error."""
    persona = F.when(F.col("persona").isin(*PERSONAS), F.col("persona")).otherwise(F.raise_error(F.concat(F.lit("no such persona: "), F.coalesce("persona", F.lit("null")))).cast("string"))
    return critiques.select("audit", "domain", "mechanism", F.lit(STEELMAN_PRIOR).alias("prior"), F.concat(F.lit("M4:steelman:"), persona).alias("source"))


def glossary_alignment(library: DataFrame, terms: DataFrame) -> DataFrame:
    """archetype_id, n_terms, n_matched, alignment, advisory: how many grounded terms (text) an archetype's accomplices name.

    A term matches where it stands, in any case, in a domain or mechanism; one null or empty counts
    as none. Under 0.30 the archetype may be too generic. Each archetype meets each term of one
    glossary: both are small tables.
    """
    own = terms.select(F.lower("text").alias("term")).where("length(term) > 0").agg(F.collect_list("term").alias("terms"))
    said = F.lower(F.concat_ws(" ", F.collect_list(F.concat_ws(" ", F.coalesce("domain", F.lit("")), F.coalesce("mechanism", F.lit(""))))))
    out = library.groupBy("archetype_id").agg(said.alias("said")).join(F.broadcast(own))  # own is one row
    out = out.withColumn("n_terms", F.size("terms")).withColumn("n_matched", F.size(F.filter("terms", lambda t: F.col("said").contains(t))))
    share = F.when(F.col("n_terms") > 0, F.col("n_matched") / F.nullif(F.col("n_terms"), F.lit(0)))
    advisory = F.when(share.isNull(), "no grounded terms").when(share >= 0.30, "good match").otherwise("low alignment")
    return out.select("archetype_id", "n_terms", "n_matched", share.alias("alignment"), advisory.alias("advisory"))


def add_observations(known: DataFrame, new: DataFrame) -> DataFrame:
    """known and the new observations (id, seq, text, category) whose id is not among them, the first by seq of each id; a null category is generic."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where("_n = 1").drop("_n")
    fresh = first.join(known.select("id"), "id", "left_anti").withColumn("category", F.coalesce("category", F.lit("generic")))
    return known.unionByName(fresh.select(known.columns))


def residual_match(residuals: DataFrame, indices: DataFrame, r_at_least: float = 0.3, p_below: float = 0.05) -> DataFrame:
    """index, n, r, p, flagged, prior: residuals (t, value) against each index (name, t, value), joined on t.

    Fewer than three common points give no correlation. A flagged index becomes a candidate whose
    prior is the size of r between 0.10 and 0.30.
    """
    both = indices.select("name", "t", F.col("value").alias("y")).join(residuals.select("t", F.col("value").alias("x")), "t")
    m = both.groupBy("name").agg(F.count("*").alias("n"), pearson("x", "y").alias("r0"))
    m = m.select(F.col("name").alias("index"), "n", F.when(F.col("n") >= 3, F.col("r0")).otherwise(0.0).alias("r"))
    m = m.withColumn("p", pearson_p("r", "n"))
    flagged = (F.col("n") >= 3) & (F.abs("r") >= r_at_least) & (F.col("p") < p_below)
    return m.withColumn("flagged", flagged).withColumn("prior", F.when(flagged, F.greatest(F.lit(0.10), F.least(F.lit(0.30), F.abs("r")))))


def scope_gate(candidates: DataFrame, queried: DataFrame) -> DataFrame:
    """candidates_unique, archetypes_queried, pass, failures: three domains and one query are needed."""
    c = candidates.agg(F.count_distinct(F.lower(F.trim("domain"))).alias("candidates_unique"))
    out = c.join(queried.agg(F.count_distinct("archetype_id").alias("archetypes_queried")))  # one row each
    return _gate(out, {"candidates_unique under 3": F.col("candidates_unique") >= 3, "no archetype queried": F.col("archetypes_queried") >= 1})


def _gate(row: DataFrame, rules: dict[str, Column]) -> DataFrame:
    failures = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return row.withColumn("failures", failures).withColumn("pass", F.size("failures") == 0)


def admissible(candidates: DataFrame) -> DataFrame:
    """candidates with error: null, or why one may not be staged (source, prior, cap, complexity)."""
    p = F.col("prior")
    e = F.when(~F.col("source").isin(*SOURCES), "source").when((p <= 0) | (p >= 1), "prior").when((F.col("source") == "llm_parametric") & (p > MODEL_PRIOR), "cap")
    return candidates.withColumn("error", e.when(F.col("complexity") <= 0, "complexity"))


def invert(observations: DataFrame, catalog: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """obs_id, cause, prior, source, complexity: the catalog's causes of each observation's category, else the generic ones.

    proposed (obs_id, cause, prior): causes from a language model, their priors capped.
    """
    known = catalog.select("category").distinct().withColumn("known", F.lit(True))
    of = observations.join(known, "category", "left").select("obs_id", F.when(F.col("known"), F.col("category")).otherwise("generic").alias("category"))
    out = of.join(catalog, "category").select("obs_id", "cause", "prior", F.lit("library").alias("source"), "complexity")
    if proposed is not None:
        capped = proposed.select("obs_id", "cause", F.least(F.lit(MODEL_PRIOR), "prior").alias("prior"), F.lit("llm_parametric").alias("source"), F.lit(1.0).alias("complexity"))
        out = out.union(capped)
    return out


def close_predictions(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """predictions (id, ...) with status: observed or absent by outcomes (id, seen), else pending."""
    out = predictions.join(outcomes, "id", "left")
    return out.withColumn("status", F.when(F.col("seen").isNull(), "pending").when(F.col("seen"), "observed").otherwise("absent")).drop("seen")


def surplus(observations: DataFrame, explains: DataFrame) -> DataFrame:
    """Observations that no candidate explains; explains: cand_id, obs_id."""
    return observations.join(explains.select("obs_id").distinct(), "obs_id", "left_anti")


def analogize(queries: DataFrame, library: DataFrame) -> DataFrame:
    """query_id, archetype_id, signature, score, rank: of each archetype its best signature by shared words, above 0.

    queries: query_id, text. Only archetypes that share a word with a query are compared with it.
    """
    q = queries.select("query_id", tokens(F.col("text")).alias("a"))
    s = library.where("signature is not null").select("archetype_id", "signature", tokens(F.col("signature")).alias("b")).distinct()
    pairs = q.select("query_id", F.explode("a").alias("w")).join(s.select("archetype_id", "signature", F.explode("b").alias("w")), "w").select("query_id", "archetype_id", "signature").distinct()
    scored = pairs.join(q, "query_id").join(s, ["archetype_id", "signature"]).withColumn("score", jaccard(F.col("a"), F.col("b")))
    best = scored.groupBy("query_id", "archetype_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "signature")).alias("b")).select("query_id", "archetype_id", "b.signature", (-F.col("b.less")).alias("score")).where("score > 0")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "archetype_id")))


def coverage(candidates: DataFrame, explains: DataFrame, observations: DataFrame) -> DataFrame:
    """candidates (cand_id, complexity, ...) with coverage_score: share of observations explained over complexity."""
    n = explains.groupBy("cand_id").agg(F.count_distinct("obs_id").alias("explained"))
    total = observations.agg(F.greatest(F.lit(1), F.count("*")).alias("total"))
    out = candidates.join(n, "cand_id", "left").join(F.broadcast(total))  # total is one row
    score = F.coalesce("explained", F.lit(0)) / F.col("total") / F.greatest(F.lit(0.001), "complexity")
    return out.select(*candidates.columns, score.alias("coverage_score"))


def promote(scored: DataFrame, threshold: float = 0.30) -> DataFrame:
    """New hypotheses from unpromoted candidates that reach threshold; a model's prior must still be within its cap."""
    fit = (F.col("coverage_score") >= threshold) & ~F.coalesce("promoted", F.lit(False)) & ~((F.col("source") == "llm_parametric") & (F.col("prior") > MODEL_PRIOR))
    return scored.where(fit).select("cand_id", F.col("cause").alias("statement"), "prior", F.lit("P1_5").alias("phase"))


def abduction_gate(observations: DataFrame, explains: DataFrame, surplus_log: DataFrame) -> DataFrame:
    """observations_inverted, surplus_audit_run, pass, failures: three explained, and the audit or any explanation."""
    row = observations.join(explains.select("obs_id").distinct(), "obs_id", "left_semi").agg(F.count("*").alias("observations_inverted"))
    row = row.join(surplus_log.agg(F.count("*").alias("logged")))  # one row each
    row = row.withColumn("surplus_audit_run", (F.col("logged") > 0) | (F.col("observations_inverted") > 0)).drop("logged")
    return _gate(row, {"observations_inverted under 3": F.col("observations_inverted") >= 3, "surplus audit not run": F.col("surplus_audit_run")})
