import pytest

from tidewright.functions import reports
from tidewright.operators import ledger, review, screen, terms
from tidewright.sources.session import Session


def test_reports(spark):
    s = spark.createDataFrame([("a", i, 5.0) for i in range(40)] + [("b", i, float(i % 7)) for i in range(80)], "series_id string, t long, value double")
    found = review.full_review(s).cache()
    text = reports.findings_report(found, "a")
    assert text.startswith("# a: REJECT") and "constant_series" in text and "min_length" not in text
    assert "min_length" in reports.findings_report(found, "a", verbose=True) and "No findings" in reports.findings_report(found, "z")
    folded = ledger.fold(spark.createDataFrame([(1, 0, 3.0), (2, 0, 0.0)], "hid long, seq long, likelihood_ratio double"))
    lines = reports.ledger_report(folded).splitlines()
    assert lines[4].startswith("| 1 | ACTIVE") and lines[5].startswith("| 2 | REFUTED")
    subjects = spark.createDataFrame([("x",)], "subject string")
    flags = spark.createDataFrame([("x", "claims", "critical")], "subject string, category string, severity string")
    assert "| x | REJECT | 1 |" in reports.verdict_report(screen.verdict(subjects, flags))
    state = spark.createDataFrame([(1, 1, 0, 0, 0, 0)], "grounded long, library long, metrics_promoted long, aliases long, verified long, candidates long")
    assert "FAIL" in reports.gate_report(terms.gate(state), "Domain") and "- terms" in reports.gate_report(terms.gate(state), "Domain")
    g = spark.createDataFrame([("b|c", "two", "library"), ("A", "one", "library"), ("z", "three", "analyst")], "text string, definition string, source string")
    assert reports.glossary(g).splitlines()[0] == "## analyst" and reports.glossary(g).index("**A**") < reports.glossary(g).index("b\\|c")
    assert "left out" in reports.table(s, most=3)


def test_sessions(tmp_path):
    s = Session(str(tmp_path / "work"))
    assert s.current() is None
    with pytest.raises(FileNotFoundError):
        s.status()
    s.new("one")
    with pytest.raises(FileExistsError):
        s.new("one")
    s.write("notes/a.md", "first")
    assert s.read("notes/a.md") == "first" and s.current() == "one"
    for bad in ("../x", "/etc/passwd", "."):
        with pytest.raises(ValueError):
            s.path(bad)
    with pytest.raises(ValueError):
        s.skip("p3", " ")
    assert s.skip("p3", "no data")["skipped"][0]["phase"] == "p3"
    with pytest.raises(ValueError):
        s.reopen("one")
    s.close("found one thing")
    s.new("two")
    summary = s.close("found another").read_text()
    assert summary.index("found another") < summary.index("found one thing") and s.names() == ["one", "two"]
    for k in (2, 3):
        assert s.reopen("one")["passes"] == k
        s.write("b.md", str(k))
        s.close("again")
    with pytest.raises(ValueError, match="passes"):
        s.reopen("one")
    assert (tmp_path / "work" / "one" / "pass_1" / "notes" / "a.md").read_text() == "first" and s.resume("two")["status"] == "closed"
