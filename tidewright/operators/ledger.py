"""Evidence ledgers: ordered folds of likelihood ratios into posteriors, statuses and verdicts.

Evidence is an append-only table of hid, seq, likelihood_ratio; everything else follows from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EPS, odds_update

#: Likelihood ratios of the named kinds of evidence about hypotheses and about traits.
HYPOTHESIS_PRESETS = {"strong_confirm": 5.0, "moderate_confirm": 3.0, "weak_confirm": 1.5, "neutral": 1.0, "weak_disconfirm": 0.67, "moderate_disconfirm": 0.33, "strong_disconfirm": 0.1, "falsify": 0.0}
TRAIT_PRESETS = {"smoking_gun": 20.0, "strong_indicator": 5.0, "indicator": 2.0, "weak_indicator": 1.5, "neutral": 1.0, "weak_counter": 0.67, "counter_indicator": 0.5, "strong_counter": 0.2, "disconfirm": 0.1, "falsify": 0.0}
#: Confirmed from, refuted up to, weakened up to.
HYPOTHESIS_BANDS = (0.90, 0.05, 0.20)
TRAIT_BANDS = (0.90, 0.10, 0.30)
#: What marks a profile's categories.
OCEAN = ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism")
DARK_TRIAD = {"narcissism": 0.3, "machiavellianism": 0.4, "psychopathy": 0.3}
MICE = ("money", "ideology", "coercion", "ego")


def with_presets(evidence: DataFrame, presets: dict[str, float]) -> DataFrame:
    """likelihood_ratio from the column preset where that is given; an unknown name is an error."""
    known = F.create_map(*[F.lit(x) for kv in presets.items() for x in kv])
    named = F.coalesce(F.try_element_at(known, F.col("preset")), F.raise_error(F.concat(F.lit("no such preset: "), "preset")).cast("double"))
    return evidence.withColumn("likelihood_ratio", F.when(F.col("preset").isNotNull(), named).otherwise(F.col("likelihood_ratio")))


def status(p: Column, bands: tuple[float, float, float] = HYPOTHESIS_BANDS) -> Column:
    up, down, weak = bands
    return F.when(p >= up, "CONFIRMED").when(p <= down, "REFUTED").when(p <= weak, "WEAKENED").otherwise("ACTIVE")


def fold(evidence: DataFrame, prior: Column | float = 0.5, bands: tuple[float, float, float] = HYPOTHESIS_BANDS) -> DataFrame:
    """hid, n, applied_n, rejected_n, prior, posterior, status, history of each hypothesis.

    Ratios are applied in the order of seq, with clamping at each step, so order matters. Once
    refuted a hypothesis is closed: later evidence is counted as rejected and changes nothing. A
    ratio of 0 refutes. history has prior_before and posterior_after of each applied item. Negative
    ratios are errors. One hypothesis' evidence is held as one array.
    """
    prior = F.lit(float(prior)) if isinstance(prior, int | float) else prior
    item = F.struct("seq", F.col("likelihood_ratio").cast("double").alias("lr"))
    own = evidence.groupBy("hid").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max(prior).alias("prior"))
    own = own.withColumn("items", F.when(F.exists("items", lambda x: x["lr"] < 0), F.raise_error(F.lit("a likelihood ratio must not be negative")).cast("array<struct<seq:int,lr:double>>")).otherwise(F.col("items")))
    _, down, _ = bands

    def step(a: Column, x: Column) -> Column:
        p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), a["p"]))
        odds = p / (1 - p) * x["lr"]
        after = F.when(x["lr"] == 0, EPS).otherwise(F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), odds / (1 + odds))))
        done = F.struct(x["seq"].cast("long").alias("seq"), x["lr"].alias("lr"), a["p"].alias("prior_before"), after.alias("posterior_after"))
        return F.when(a["closed"], a).otherwise(F.struct(after.alias("p"), (after <= down).alias("closed"), F.concat(a["history"], F.array(done)).alias("history")))

    begin = F.struct(F.col("prior").alias("p"), F.lit(False).alias("closed"), F.array().cast("array<struct<seq:bigint,lr:double,prior_before:double,posterior_after:double>>").alias("history"))
    out = own.withColumn("end", F.aggregate("items", begin, step))
    return out.select("hid", F.size("items").alias("n"), F.size("end.history").alias("applied_n"), (F.size("items") - F.size("end.history")).alias("rejected_n"), "prior", F.col("end.p").alias("posterior"), status(F.col("end.p"), bands).alias("status"), F.col("end.history").alias("history"))


def rule_audit(folded: DataFrame, caps: dict[str, float], phase: Column) -> DataFrame:
    """hid and what breaks the protocol's rules: ratios over the phase's cap, and 0.80 reached without counter-evidence."""
    cap = F.coalesce(*[F.when(phase == k, F.lit(v)) for k, v in caps.items()], F.lit(float("inf")))
    over = F.size(F.filter("history", lambda x: x["lr"] > cap))
    alone = (F.col("posterior") >= 0.8) & ~F.exists("history", lambda x: x["lr"] < 1)
    return folded.select("hid", over.alias("over_cap"), alone.alias("unopposed"))


def compare(folded: DataFrame) -> DataFrame:
    """h1, h2, posterior_ratio, log10_ratio, interpretation of all pairs h1 < h2 with the same group (column grp).

    Pairs are only made within a group; an analysis has few hypotheses.
    """
    a = folded.select("grp", F.col("hid").alias("h1"), F.col("posterior").alias("p1"))
    b = folded.select("grp", F.col("hid").alias("h2"), F.col("posterior").alias("p2"))
    both = a.join(b, "grp").where("h1 < h2")
    p1, p2 = F.col("p1"), F.col("p2")
    k = F.when((p1 == 0) & (p2 == 0), 1.0).when(p2 == 0, 1e6).when(p1 == 0, 1e-6).otherwise(p1 / F.nullif(p2, F.lit(0.0)))
    x = F.log10(k)
    label = F.when(x > 2, "decisive for h1").when(x > 1, "strong for h1").when(x > 0.5, "substantial for h1").when(x > -0.5, "barely worth mentioning").when(x > -1, "substantial for h2").when(x > -2, "strong for h2").otherwise("decisive for h2")
    return both.select("grp", "h1", "h2", k.alias("posterior_ratio"), x.alias("log10_ratio"), label.alias("interpretation"))


def profile(traits: DataFrame, categories: tuple[str, ...], *keys: str) -> DataFrame:
    """One row for each category (and key): the unrefuted trait with the highest posterior, or why there is none.

    traits: category, id, polarity, posterior, status. Of equal ones the first by id counts.
    """
    dim = traits.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    dim = dim.crossJoin(traits.select(*keys).distinct()) if keys else dim  # one row for each subject and category
    open_ = F.col("status") != "REFUTED"
    best = traits.groupBy("category", *keys).agg(F.count("*").alias("n"), F.min(F.when(open_, F.struct((-F.col("posterior")).alias("less"), "id", "polarity", "status"))).alias("b"))
    out = dim.join(best, ["category", *keys], "left")
    level = F.coalesce("b.polarity", F.lit("unknown"))
    state = F.when(F.col("n").isNull(), "UNASSESSED").when(F.col("b").isNull(), "REFUTED").otherwise(F.col("b.status"))
    return out.select(*keys, "category", level.alias("level"), F.coalesce(-F.col("b.less"), F.lit(0.0)).alias("confidence"), state.alias("status"))


def dark_triad_risk(profiles: DataFrame, *keys: str) -> DataFrame:
    """Weighted sum of the three categories; low polarity counts as 1 - p, what is unknown as 0."""
    weight = F.coalesce(*[F.when(F.col("category") == c, F.lit(w)) for c, w in DARK_TRIAD.items()], F.lit(0.0))
    part = F.when(F.col("level") == "unknown", 0.0).when(F.col("level") == "high", F.col("confidence")).otherwise(1 - F.col("confidence"))
    return profiles.groupBy(*keys).agg(F.sum(weight * part).alias("risk"))


def overall_confidence(traits: DataFrame, *keys: str) -> DataFrame:
    """How far posteriors lie from even, on average, and in words."""
    c = F.avg(F.abs(F.col("posterior") - 0.5) * 2)
    out = traits.groupBy(*keys).agg(c.alias("confidence"))
    return out.withColumn("label", F.when(F.col("confidence") > 0.7, "High").when(F.col("confidence") > 0.4, "Medium").otherwise("Low"))


def rename(ledger: DataFrame, names: DataFrame, key: str = "hid") -> DataFrame:
    """The ledger under new names (old, new); what has none keeps its own, and a name that is taken is an error."""
    own = names.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    taken = own.join(ledger.select(F.col(key).alias("_have")).distinct(), F.col("_new") == F.col("_have"), "left")
    said = F.when(F.col("_have").isNotNull() & (F.col("_have") != F.col("_old")), F.raise_error(F.concat(F.lit("name is taken: "), "_new")).cast("string")).otherwise(F.col("_new"))
    out = ledger.join(taken.select("_old", said.alias("_new")), F.col(key) == F.col("_old"), "left")
    return out.withColumn(key, F.coalesce("_new", key)).select(ledger.columns)


def remove(ledger: DataFrame, names: DataFrame, key: str = "hid") -> DataFrame:
    """The ledger without the rows of names (one column of the key's name)."""
    return ledger.join(names.select(key).distinct(), key, "left_anti")


def numbered(entries: DataFrame, prefix: str, last: int = 0, key: str = "subject") -> DataFrame:
    """entries (key, seq, ...) with id: prefix and a number that rises with seq within each key, from last + 1 on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("seq")) + last
    return entries.withColumn("id", F.concat(F.lit(prefix), n.cast("string")))


def deviations(entries: DataFrame, baselines: DataFrame, last: int = 0) -> DataFrame:
    """entries (subject, seq, description, baseline, context, significance) with id, baseline_category and baseline_value.

    significance is minor, moderate (also where it is null) or major; anything else is an error.
    baseline names one of the subject's baselines (subject, id, category, value); it may be unknown.
    """
    grade = F.coalesce("significance", F.lit("moderate"))
    grade = F.when(grade.isin("minor", "moderate", "major"), grade).otherwise(F.raise_error(F.concat(F.lit("no such significance: "), grade)).cast("string"))
    known = baselines.select("subject", F.col("id").alias("baseline"), F.col("category").alias("baseline_category"), F.col("value").alias("baseline_value"))
    return numbered(entries, "D", last).withColumn("significance", grade).join(known, ["subject", "baseline"], "left")


def chain_steps(steps: DataFrame, new: DataFrame, chains: DataFrame, sources: tuple[str, ...], model_ratio: float) -> DataFrame:
    """steps and the new ones behind them: chain_id, idx, claim, lr, source, refs.

    new: chain_id, pos, claim, lr, source, refs, appended in the order of pos; idx goes on from the
    chain's last. It is an error to append to a chain that is unknown or not open, to use a ratio
    below 0 or an unknown source, and to let a language model alone claim more than model_ratio.
    """
    last = steps.groupBy("chain_id").agg(F.max("idx").alias("last"))
    rows = new.join(chains.select("chain_id", F.col("status").alias("_status")), "chain_id", "left").join(last, "chain_id", "left")
    wrong = (
        F.when(F.col("_status").isNull(), "no such chain").when(F.col("_status") != "open", "the chain is not open")
        .when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "no such source").when(F.col("lr").isNull() | (F.col("lr") < 0), "a likelihood ratio must not be negative")
        .when((F.col("source") == "llm_parametric") & (F.col("lr") > model_ratio), f"a model alone may claim {model_ratio:g} at most")
    )
    lr = F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(": ", wrong, F.col("chain_id").cast("string"))).cast("double")).otherwise(F.col("lr").cast("double"))
    idx = (F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("chain_id").orderBy("pos"))).cast("int")
    cols = ["chain_id", "idx", "claim", "lr", "source", "refs"]
    return steps.select(cols).unionByName(rows.select("chain_id", idx.alias("idx"), "claim", lr.alias("lr"), "source", F.coalesce("refs", F.array().cast("array<string>")).alias("refs")))


def chain_close(steps: DataFrame, seed_prior: float = 0.5) -> DataFrame:
    """chain_id, n_steps, final_posterior of chains with at least one step; steps: chain_id, idx, lr. seed_prior: between 0 and 1."""
    if not 0 < seed_prior < 1:
        raise ValueError("seed_prior must lie between 0 and 1")
    own = steps.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("lr").cast("double").alias("lr")))).alias("s"))
    return own.select("chain_id", F.size("s").alias("n_steps"), F.aggregate("s", F.lit(float(seed_prior)), lambda p, x: odds_update(p, x["lr"])).alias("final_posterior"))


def chain_audit(steps: DataFrame, chains: DataFrame) -> DataFrame:
    """chain_id, gap: what is missing or out of place; steps: chain_id, pos, idx, lr, refs, chains: chain_id, status."""
    w = Window.partitionBy("chain_id").orderBy("pos")
    rows = steps.withColumn("place", F.row_number().over(w)).withColumn("more", F.lead("pos").over(w).isNotNull())
    gaps = F.array(
        F.when(F.col("idx") != F.col("place"), F.concat(F.lit("order:"), F.col("place").cast("string"))),
        F.when(F.col("refs").isNull(), F.concat(F.lit("references:"), F.col("place").cast("string"))),
        F.when((F.col("lr") == 0) & F.col("more"), F.concat(F.lit("falsified:"), F.col("place").cast("string"))),
    )
    found = rows.select("chain_id", F.explode(F.filter(gaps, lambda g: g.isNotNull())).alias("gap"))
    counts = steps.groupBy("chain_id").agg(F.count("*").alias("n"))
    short = chains.join(counts, "chain_id", "left").where((F.col("status") == "closed") & (F.coalesce("n", F.lit(0)) < 2)).select("chain_id", F.lit("short").alias("gap"))
    return found.union(short)
