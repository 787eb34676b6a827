"""Small tables as Markdown: for results that a person reads, a row at a time and never the data itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.4g}"
    if isinstance(value, list | tuple):
        return ", ".join(map(cell, value))
    return str(value).replace("|", "\\|").replace("\n", " ")


def table(df: DataFrame, title: str = "", columns: Iterable[str] | None = None, most: int = 1000) -> str:
    """A Markdown table of at most most rows, in the order of df; says how many are left out."""
    names = list(columns or df.columns)
    rows = df.select(*names).limit(most + 1).collect()
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    lines += ["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"\nMore than {most} rows; the others are left out.")
    return "\n".join(lines)


def findings_report(findings: DataFrame, series_id: str, verbose: bool = False) -> str:
    """The findings of one series by phase, worst verdict first said; without verbose those that passed are only counted."""
    from ..operators.findings import rollup

    own = findings.where(F.col("series_id") == series_id)
    total = rollup(own).collect()
    if not total:
        return f"# {series_id}\n\nNo findings."
    head = f"# {series_id}: {total[0].verdict}\n\n{total[0].red_flags} red flags, {total[0].warnings} warnings, {total[0].n_findings} findings.\n"
    shown = own if verbose else own.where("verdict not in ('PASS', 'SKIP')")
    return head + "\n" + table(shown.orderBy("phase_no", "check"), "", ("phase", "check", "verdict", "severity", "value"))


def ledger_report(folded: DataFrame) -> str:
    """Hypotheses or traits, likeliest first."""
    return table(folded.orderBy(F.desc("posterior"), "hid"), "Ledger", ("hid", "status", "prior", "posterior", "applied_n", "rejected_n"))


def verdict_report(verdicts: DataFrame) -> str:
    """Subjects with their verdict and what it rests on."""
    return table(verdicts.orderBy("subject"), "Verdicts", ("subject", "verdict", "total_flags", "categories", "critical", "failed", "suspicious"))


def gate_report(gate: DataFrame, name: str) -> str:
    """Whether a gate is passed, and what is missing."""
    r = gate.first()
    return f"## {name}: {'PASS' if r['pass'] else 'FAIL'}\n" + "".join(f"\n- {f}" for f in r["failures"])


def glossary(terms: DataFrame, by: str = "source") -> str:
    """Grounded terms under a heading for each source."""
    out, last = [], None
    for r in terms.orderBy(by, F.lower("text")).toLocalIterator():
        if r[by] != last:
            last = r[by]
            out += ["", f"## {cell(last)}", ""]
        out.append(f"- **{cell(r['text'])}**: {cell(r['definition'])}")
    return "\n".join(out).strip()
