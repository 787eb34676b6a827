"""Registered queries and their SQL."""

from . import ledger_queries, numeric_queries, probe_queries, review_queries


def without_negative_zero(sql: str) -> str:
    """Adds 0 to each rounded number: small negative ones become -0 in some engines and 0 in others."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 0, start + len("round")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        inner = without_negative_zero(sql[start + len("round(") : end - 1])
        out.append(f"{sql[at:start]}(round({inner}) + 0)")
        at = end
    return "".join(out) + sql[at:]


_MODULES = (review_queries, ledger_queries, numeric_queries, probe_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: without_negative_zero(v) for m in _MODULES for k, v in m.SQL.items()}
