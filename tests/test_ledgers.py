"""Ledgers, screening, scope, terms, and live evidence against the batch fold."""

import math

import pytest
from pyspark.sql import functions as F

from tidewright.operators import ledger, scope, screen, terms
from tidewright.streaming import ledger_stream


def evidence(spark, rows):
    return spark.createDataFrame([(h, i, float(r)) for h, own in rows.items() for i, r in enumerate(own)], "hid long, seq long, likelihood_ratio double")


def test_fold(spark):
    got = {r.hid: r for r in ledger.fold(evidence(spark, {1: [3, 3], 2: [0, 5], 3: [0.1, 0.1, 9], 4: [100, 100, 0.01], 5: [1]})).collect()}
    assert got[1].posterior == pytest.approx(0.9) and got[1].status == "CONFIRMED" and got[1].history[1].prior_before == pytest.approx(0.75)
    assert got[2].posterior == 0.001 and got[2].status == "REFUTED" and got[2].rejected_n == 1
    assert got[3].rejected_n == 1 and got[3].posterior < 0.05
    assert got[4].posterior == pytest.approx(0.999 / 0.001 * 0.01 / (1 + 0.999 / 0.001 * 0.01)) and got[5].status == "ACTIVE"
    assert {r.hid: r.status for r in ledger.fold(evidence(spark, {1: [0.11]}), 0.5, ledger.TRAIT_BANDS).collect()} == {1: "REFUTED"}
    with pytest.raises(Exception, match="negative"):
        ledger.fold(evidence(spark, {1: [-1]})).collect()
    assert ledger.fold(evidence(spark, {})).collect() == []


def test_order_matters(spark):
    up = ledger.fold(evidence(spark, {1: [1000, 0.5]})).first().posterior
    down = ledger.fold(evidence(spark, {1: [0.5, 1000]})).first().posterior
    assert up != pytest.approx(down)


def test_presets_and_rules(spark):
    rows = spark.createDataFrame([(1, 0, "weak_confirm", None), (1, 1, None, 2.0)], "hid long, seq long, preset string, likelihood_ratio double")
    assert [r.likelihood_ratio for r in ledger.with_presets(rows, ledger.HYPOTHESIS_PRESETS).orderBy("seq").collect()] == [1.5, 2.0]
    with pytest.raises(Exception, match="no such preset"):
        ledger.with_presets(rows.withColumn("preset", F.lit("x")), ledger.HYPOTHESIS_PRESETS).collect()
    audit = ledger.rule_audit(ledger.fold(evidence(spark, {1: [9, 2]})), {"P0": 3.0}, F.lit("P0")).first()
    assert audit.over_cap == 1 and audit.unopposed


def test_profiles(spark):
    t = spark.createDataFrame([("openness", 1, "high", 0.7, "ACTIVE"), ("openness", 2, "low", 0.7, "ACTIVE"), ("neuroticism", 3, "high", 0.05, "REFUTED"), ("narcissism", 4, "low", 0.2, "WEAKENED")], "category string, id long, polarity string, posterior double, status string")
    p = {r.category: (r.level, r.confidence, r.status) for r in ledger.profile(t, ledger.OCEAN).collect()}
    assert p["openness"] == ("high", 0.7, "ACTIVE") and p["neuroticism"] == ("unknown", 0, "REFUTED") and p["extraversion"] == ("unknown", 0, "UNASSESSED")
    risk = ledger.dark_triad_risk(ledger.profile(t, tuple(ledger.DARK_TRIAD))).first().risk
    assert risk == pytest.approx(0.3 * 0.8)


def test_chains(spark):
    steps = spark.createDataFrame([("c", 1, 1, 2.0, ["x"]), ("c", 2, 3, 0.0, None), ("c", 3, 4, 2.0, []), ("d", 1, 1, 1.0, [])], "chain_id string, pos long, idx long, lr double, refs array<string>")
    closed = {r.chain_id: r.final_posterior for r in ledger.chain_close(steps).collect()}
    assert closed["c"] == pytest.approx(0.002 / (0.999 + 0.002)) and closed["d"] == 0.5
    chains = spark.createDataFrame([("c", "closed"), ("d", "closed"), ("e", "closed"), ("f", "open")], "chain_id string, status string")
    gaps = {(r.chain_id, r.gap) for r in ledger.chain_audit(steps, chains).collect()}
    assert gaps == {("c", "order:2"), ("c", "order:3"), ("c", "references:2"), ("c", "falsified:2"), ("d", "short"), ("e", "short")}


def test_calibration(spark):
    rows = [("ml_classification", "accuracy", v) for v in (0.995, 0.98, 0.9, 0.75, 0.5)] + [("time_series", "mape", v) for v in (0.001, 0.02, 0.1, 0.2, 0.5)] + [("x", "y", 1.0)]
    got = [r.assessment for r in screen.calibrate(spark.createDataFrame(rows, "domain string, metric string, value double").coalesce(1)).collect()]
    assert got == ["suspicious", "excellent", "plausible", "plausible_poor", "implausible"] * 2 + ["unknown"]


def test_verdicts(spark):
    subjects = spark.createDataFrame([(s,) for s in "abcdef"], "subject string")
    flags = spark.createDataFrame([("a", "claims", "critical"), *[("b", "claims", "minor")] * 2, *[("c", "claims", "minor")] * 4, *[("d", "data", "minor")] * 6], "subject string, category string, severity string")
    checks = spark.createDataFrame([("e", "x", 1, "FAIL"), ("f", "x", 1, "FAIL"), ("f", "x", 2, "PASS")], "subject string, check_type string, seq long, status string")
    got = {r.subject: r.verdict for r in screen.verdict(subjects, flags, checks).collect()}
    assert got == {"a": "REJECT", "b": "SKEPTICAL", "c": "DOUBTFUL", "d": "REJECT", "e": "REJECT", "f": "CREDIBLE"}
    counts = {(r.kind, r.name): r.n for r in screen.flag_counts(flags, screen.FLAG_CATEGORIES).collect()}
    assert counts["category", "claims"] == 7 and counts["category", "results"] == 0 and counts["total", "all"] == 13 and counts["severity", "critical"] == 1


def test_scope(spark, tmp_path):
    c = spark.createDataFrame([(1, " Tax "), (2, "tax"), (3, "law")], "seq long, domain string")
    assert sorted(r.seq for r in scope.dedupe(c).collect()) == [1, 3]
    q = spark.createDataFrame([("x", "thin_market")], "audit string, archetype_id string")
    assert scope.enumerate_archetype(q, scope.archetypes(spark)).count() == 2
    g = scope.scope_gate(c, q).first()
    assert not g["pass"] and g.failures == ["candidates_unique under 3"]
    (tmp_path / "c.json").write_text('{"_note": {"name": "n"}, "one": {"name": "first"}}')
    assert [(r.key, r.value.name) for r in scope.read_catalog(spark, str(tmp_path / "c.json"), "struct<name:string>").collect()] == [("one", "first")]
    res = spark.createDataFrame([(i, float(i)) for i in range(30)], "t long, value double")
    ix = res.select(F.lit("twice").alias("name"), "t", (F.col("value") * 2).alias("value")).union(res.select(F.lit("flat"), "t", F.lit(1.0))).union(res.limit(2).select(F.lit("short"), "t", "value"))
    m = {r["index"]: (r.r, r.flagged, r.prior) for r in scope.residual_match(res, ix).collect()}
    assert m["twice"] == (pytest.approx(1.0), True, 0.3) and m["flat"] == (0.0, False, None) and m["short"] == (0.0, False, None)
    staged = scope.admissible(spark.createDataFrame([("library", 0.5, 1.0), ("llm_parametric", 0.5, 1.0), ("x", 0.5, 1.0), ("analyst", 1.0, 1.0), ("analyst", 0.5, 0.0)], "source string, prior double, complexity double")).collect()
    assert [r.error for r in staged] == [None, "cap", "source", "prior", "complexity"]


def test_abduction(spark):
    obs = spark.createDataFrame([(1, "timing"), (2, "nothing known"), (3, "failure"), (4, "timing")], "obs_id long, category string")
    inv = scope.invert(obs, scope.traces(spark), spark.createDataFrame([(1, "guess", 0.9)], "obs_id long, cause string, prior double")).collect()
    assert sum(r.obs_id == 2 for r in inv) == 2 and [r.prior for r in inv if r.source == "llm_parametric"] == [0.3]
    ex = spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "cand_id long, obs_id long")
    assert sorted(r.obs_id for r in scope.surplus(obs, ex).collect()) == [3, 4]
    cand = spark.createDataFrame([(7, "a", 1.0, 0.2, "library", False), (8, "b", 0.5, 0.4, "llm_parametric", False), (9, "c", 1.0, 0.2, "library", False)], "cand_id long, cause string, complexity double, prior double, source string, promoted boolean")
    scored = scope.coverage(cand, ex, obs)
    assert {r.cand_id: r.coverage_score for r in scored.collect()} == {7: 0.5, 8: 0.5, 9: 0.0}
    assert [r.cand_id for r in scope.promote(scored).collect()] == [7]
    gate = scope.abduction_gate(obs, ex, obs.limit(0)).first()
    assert not gate["pass"] and gate.observations_inverted == 2
    a = scope.analogize(spark.createDataFrame([(1, "prices move"), (2, "")], "query_id long, text string"), scope.archetypes(spark)).collect()
    assert a[0].archetype_id == "thin_market" and {r.query_id for r in a} == {1}
    p = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    o = spark.createDataFrame([(1, True), (2, False)], "id long, seen boolean")
    assert {r.id: r.status for r in scope.close_predictions(p, o).collect()} == {1: "observed", 2: "absent", 3: "pending"}


def test_terms(spark):
    docs = spark.createDataFrame([(1, "OD600 measured OD600 repeated od600 again"), (2, "NASA and Nasa Ames Research Center; ÉCOLE été")], "doc_id long, text string")
    got = {r.key: (r.text, r.frequency) for r in terms.extract(docs).collect()}
    assert got["od600"] == ("OD600", 3) and got["nasa"] == ("NASA", 1) and got["nasa ames research"] == ("Nasa Ames Research", 1) and "cole" not in got
    left = terms.extract(docs, spark.createDataFrame([("od600",)], "text string"))
    assert "od600" not in {r.key for r in left.collect()}
    rows = spark.createDataFrame([("a", "d", "library", 0.2), ("b", "d", "analyst", None), ("c", "d", "llm_parametric", 0.7), ("d", " ", "analyst", 0.5), ("e", "d", "x", 0.5)], "text string, definition string, source string, confidence double")
    assert [(r.confidence, r.error) for r in terms.ground(rows).collect()] == [(1.0, None), (0.7, None), (0.7, "cap"), (0.5, "definition"), (0.5, "source")]
    state = spark.createDataFrame([(10, 3, 3, 1, 2, 0), (5, 2, 0, 0, 2, 0), (0, 0, 0, 0, 0, 0)], "grounded long, library long, metrics_promoted long, aliases long, verified long, candidates long")
    assert [r["pass"] for r in terms.gate(state).collect()] == [True, False, False]
    assert [r["pass"] for r in terms.gate(state, "LITE").collect()] == [True, True, False]


def test_live_ledger_equals_the_batch(spark, sf_dir, tmp_path):
    from tidewright.sources.tables import v_evid

    rows = v_evid(spark, sf_dir).withColumn("hid", F.col("hid").cast("long")).withColumn("seq", F.col("seq").cast("long"))
    limit = rows.agg(F.max("seq")).first()[0] // 2
    for k, part in enumerate((rows.where(F.col("seq") <= limit), rows.where(F.col("seq") > limit))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = ledger_stream.replay(spark, str(tmp_path / "in"), "hid long, seq long, likelihood_ratio double", ledger_stream.fold_stream, "live_ledger", str(tmp_path / "ck"))
    live = {r.hid: (r.applied_n, r.status, r.posterior) for r in out.groupBy("hid").agg(F.max_by(F.struct("applied_n", "status", "posterior"), "n").alias("l")).select("hid", "l.*").collect()}
    batch = {r.hid: (r.applied_n, r.status, r.posterior) for r in ledger.fold(rows).collect()}
    assert live.keys() == batch.keys()
    for h, (n, s, p) in batch.items():
        assert live[h][:2] == (n, s) and math.isclose(live[h][2], p, rel_tol=1e-12)


def test_windows_over_a_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    ddl = ", ".join(f"{f.name} {'timestamp' if f.name == 'ts' else f.dataType.simpleString()}" for f in schema)
    out = ledger_stream.replay(spark, str(tmp_path / "e"), ddl, lambda s: ledger_stream.windowed_values(s, "60 days"), "live_windows", str(tmp_path / "ck2"))
    want = events.groupBy("event_type", F.window("ts", "1 hour")).count().count()
    assert out.select("event_type", "start").distinct().count() == want


def test_chain_steps_keep_their_rules(spark):
    from tidewright.operators import ledger, scope

    cols = "chain_id string, idx int, claim string, lr double, source string, refs array<string>"
    steps = spark.createDataFrame([("a", 1, "x", 1.5, "analyst", ["r"])], cols)
    chains = spark.createDataFrame([("a", "open"), ("b", "open"), ("c", "closed")], "chain_id string, status string")
    more = "chain_id string, pos int, claim string, lr double, source string, refs array<string>"

    def append(*rows):
        return ledger.chain_steps(steps, spark.createDataFrame(rows, more), chains, scope.SOURCES, scope.MODEL_RATIO)

    got = append(("a", 9, "z", 0.0, "library", None), ("a", 4, "y", 2.0, "llm_parametric", ["s"]), ("b", 1, "w", 3.0, "analyst", None))
    assert sorted((r.chain_id, r.idx, r.claim, r.lr, r.refs) for r in got.collect()) == [("a", 1, "x", 1.5, ["r"]), ("a", 2, "y", 2.0, ["s"]), ("a", 3, "z", 0.0, []), ("b", 1, "w", 3.0, [])]
    wrong = [("a", 1, "x", -0.1, "analyst", None), ("a", 1, "x", None, "analyst", None), ("a", 1, "x", 2.1, "llm_parametric", None), ("a", 1, "x", 1.0, "hearsay", None), ("c", 1, "x", 1.0, "analyst", None), ("d", 1, "x", 1.0, "analyst", None)]
    for row in wrong:
        with pytest.raises(Exception, match="chain|ratio|source|alone"):
            append(row).collect()
    for prior in (0.0, 1.0):
        with pytest.raises(ValueError, match="seed_prior"):
            ledger.chain_close(steps, prior)


def test_names_baselines_and_deviations(spark):
    from tidewright.operators import ledger

    traits = spark.createDataFrame([("T1", 1, 2.0), ("T1", 2, 3.0), ("T2", 1, 0.5)], "hid string, seq int, likelihood_ratio double")
    names = lambda *rows: spark.createDataFrame(rows, "old string, new string")
    assert sorted(r.hid for r in ledger.rename(traits, names(("T1", "T9"), ("T7", "T8"))).collect()) == ["T2", "T9", "T9"]
    assert sorted(r.hid for r in ledger.rename(traits, names(("T1", "T1"))).collect()) == ["T1", "T1", "T2"]
    with pytest.raises(Exception, match="taken"):
        ledger.rename(traits, names(("T1", "T2"))).collect()
    assert [r.hid for r in ledger.remove(traits, spark.createDataFrame([("T1",)], "hid string")).collect()] == ["T2"]
    base = ledger.numbered(spark.createDataFrame([("s", 5, "speech", "slow"), ("s", 2, "gaze", "low"), ("u", 1, "gaze", "high")], "subject string, seq int, category string, value string"), "B")
    assert sorted((r.subject, r.id, r.category) for r in base.collect()) == [("s", "B1", "gaze"), ("s", "B2", "speech"), ("u", "B1", "gaze")]
    cols = "subject string, seq int, description string, baseline string, context string, significance string"
    got = ledger.deviations(spark.createDataFrame([("s", 1, "fast", "B2", "call", None), ("s", 2, "calm", "B7", "call", "major")], cols), base)
    assert sorted((r.id, r.significance, r.baseline_category, r.baseline_value) for r in got.collect()) == [("D1", "moderate", "speech", "slow"), ("D2", "major", None, None)]
    with pytest.raises(Exception, match="no such significance"):
        ledger.deviations(spark.createDataFrame([("s", 1, "fast", "B2", "call", "huge")], cols), base).collect()


def test_steelman_glossary_and_observations(spark):
    from tidewright.operators import scope

    cols = "audit int, persona string, domain string, mechanism string"
    assert [tuple(r) for r in scope.steelman(spark.createDataFrame([(1, "journalist", "press", "leaks")], cols)).collect()] == [(1, "press", "leaks", 0.15, "M4:steelman:journalist")]
    with pytest.raises(Exception, match="no such persona"):
        scope.steelman(spark.createDataFrame([(1, "friend", "press", "leaks")], cols)).collect()
    library = spark.createDataFrame([("m", "Capital flows", "Money from abroad"), ("m", "storage", None), ("n", "x", "y")], "archetype_id string, domain string, mechanism string")
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    got = {r.archetype_id: tuple(r)[1:] for r in scope.glossary_alignment(library, terms("capital", "ABROAD", "yield", "", None)).collect()}
    assert got["m"] == (3, 2, pytest.approx(2 / 3), "good match") and got["n"] == (3, 0, 0.0, "low alignment")
    assert {r.advisory for r in scope.glossary_alignment(library, terms("")).collect()} == {"no grounded terms"}
    known = spark.createDataFrame([("O1", "seen", "timing")], "id string, text string, category string")
    new = spark.createDataFrame([("O1", 1, "again", "x"), ("O2", 3, "late", None), ("O2", 2, "first", None)], "id string, seq int, text string, category string")
    once = scope.add_observations(known, new)
    assert sorted(map(tuple, once.collect())) == [("O1", "seen", "timing"), ("O2", "first", "generic")] == sorted(map(tuple, scope.add_observations(once, new).collect()))
