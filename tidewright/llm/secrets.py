"""Secret scan: fixed patterns and sliding-window entropy of candidate strings; DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, running_sums

#: Fixed by the contract: kinds in their order, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: A run of these is a candidate if it has a letter and a digit.
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
#: All characters of a candidate; where each stands here is its place among the counts.
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"
#: Character class, pattern of the whole candidate (first that fits), window, least bits per character.
CLASSES = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 2.95),
    ("lower", r"^[0-9a-z_=-]+$", 20, 3.65),
    ("base64", r"^", 20, 3.75),
)
#: Candidates that hold one of these are no secrets: UUIDs, runs of the digits or the alphabet, words for examples.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:0123456789|1234567890|abcdefghij|example|placeholder|changeme|dummy|xxxx)",
)
_SPAN = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _found(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the matches whose group has least characters; places from the pieces between matches."""
    hits, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    inner = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.zip_with(hits, pieces, lambda h, p: F.struct(F.length(h).cast("long").alias("n"), F.length(p).cast("long").alias("before")))
    # The last piece has no match behind it.
    rows = F.zip_with(F.slice(both, F.lit(1), F.size(hits)), inner, lambda b, v: F.struct(b["n"].alias("n"), b["before"].alias("before"), F.length(v).alias("inner")))

    def spans(r: Column) -> Column:
        def one(x: Column, at: Column) -> Column:
            start = at + x["before"]
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + x["n"]).alias("end"), x["inner"].alias("inner"), x["n"].alias("n"))

        placed = F.zip_with(r, running_sums(F.transform(r, lambda x: x["n"] + x["before"])), one)
        return F.filter(placed, lambda x: x["inner"] >= least)

    return let(rows, spans)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))


def _hot(s: Column, window: int, least: float) -> Column:
    """struct(first, upto): where, from 1, the first window of at least that entropy starts and the last ends.

    The entropy of a window is log2(w) - sum(c log2 c) / w over the counts c of its characters. The
    counts of all characters that a candidate can have are carried along: a step to the right takes
    one character out and one in, and the sum changes by those two counts. Each character costs the
    same however long the candidate is.
    """
    f = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(window + 2)])
    # All windows at least this even; a margin far below the next possible value takes up rounding.
    most = window * (log2(window) - least) + 1e-9

    def over(codes: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            new, gone = F.get(codes, i - 1), F.when(i > window, F.get(codes, i - window - 1)).otherwise(-1)
            # What leaves goes first, so that a character that leaves and comes back is seen once less in between.
            left, came = F.get(a["counts"], gone), F.get(a["counts"], new) - (gone == new).cast("int")
            out = F.when(gone >= 0, F.get(f, left - 1) - F.get(f, left)).otherwise(0.0)
            total = a["total"] + out + F.get(f, came + 1) - F.get(f, came)
            counts = F.when(gone == new, a["counts"]).otherwise(F.transform(a["counts"], lambda c, k: c + (k == new).cast("int") - (k == gone).cast("int")))
            hot = (i >= window) & (total <= most)
            start = i - window + 1
            return F.struct(total.alias("total"), F.when(hot, F.coalesce(a["first"], start)).otherwise(a["first"]).alias("first"), F.when(hot, start).otherwise(a["last"]).alias("last"), counts.alias("counts"))

        none = F.lit(None).cast("int")
        begin = F.struct(F.lit(0.0).alias("total"), none.alias("first"), none.alias("last"), F.array_repeat(F.lit(0), len(LETTERS)).alias("counts"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), begin, step, lambda a: F.struct(a["first"].cast("long").alias("first"), (a["last"] + window - 1).cast("long").alias("upto")))

    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(LETTERS), c) - 1)
    return F.when(F.length(s) >= window, let(codes, over))


def _entropy(text: Column, rank: int) -> Column:
    """Of each candidate that is not allowed, the span from its first to its last window of high entropy."""
    hits, pieces = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    rows = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(F.length(p).cast("long").alias("before"), h.alias("s")))

    def judged(s: Column) -> Column:
        harmless = reduce(lambda a, b: a | b, [s.rlike(p) for p in ALLOWED])
        plain = ~(s.rlike("[0-9]") & s.rlike("[A-Za-z]"))
        out = F.when(harmless | plain, F.lit(None))
        for _, pattern, window, least in CLASSES:
            out = out.when(s.rlike(pattern), _hot(s, window, least))
        return out

    def spans(r: Column) -> Column:
        at = running_sums(F.transform(r, lambda x: F.length(x["s"]) + x["before"]))

        def one(x: Column, a: Column) -> Column:
            return let(judged(x["s"]), lambda h: F.struct((a + x["before"] + h["first"] - 1).alias("start"), F.lit(rank).alias("rank"), F.lit("entropy").alias("kind"), (a + x["before"] + h["upto"]).alias("end")))

        return F.filter(F.zip_with(r, at, one), lambda x: x["start"].isNotNull())

    return let(rows, spans)


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base, found: the spans (start, rank, kind, end; code points, end exclusive) of each text.

    base: the fixed patterns, leftmost and not overlapping for each kind, by start, then kind.
    found: base and the entropy spans that no base span covers, likewise sorted. Null and empty
    texts have none; rows of docs stay apart and other columns are not read. No shuffle.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    none = F.array().cast(_SPAN)
    kinds = [F.when(F.col("text").rlike(p), _bare(_found(F.col("text"), k, i, p, g, n))).otherwise(none).alias(k) for i, (k, p, g, n) in enumerate(BASE)]
    high = F.when(F.col("text").rlike(CANDIDATE), _entropy(F.col("text"), len(BASE))).otherwise(none)
    rows = rows.select("doc_id", *kinds, high.cast(_SPAN).alias("high"))
    rows = rows.select("doc_id", F.array_sort(F.concat(*[k for k, *_ in BASE])).alias("base"), "high")
    more = F.filter("high", lambda h: ~F.exists("base", lambda b: (b["start"] <= h["start"]) & (h["end"] <= b["end"])))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("found"))


def _of(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def secret_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the numbers of base spans by kind, the SHA-256 of the base spans' list, and all spans as text."""
    found = secret_spans(docs, doc_id, text)
    counts = [F.size(_of("base", k)).cast("long").alias(f"n_{k}") for k, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("found")).alias("spans"))


def _sql() -> str:
    """The same with every window's entropy worked out anew."""
    any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    assign = "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key"))) + BASE[0][1][BASE[0][1].index("))") + 1 :].replace("'", "''")
    patterns = [assign, *(p for _, p, *_ in BASE[1:])]
    hits = " UNION ALL ".join(
        f"SELECT id, {i} AS rank, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', 0)) AS hit, unnest(regexp_extract_all(text, '{p}', {g})) AS val, unnest(string_split_regex(text, '{p}')[:-2]) AS piece, unnest(range(len(regexp_extract_all(text, '{p}', 0)))) AS i FROM d"
        for i, ((k, _, g, _), p) in enumerate(zip(BASE, patterns, strict=True))
    )
    least = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, _, _, n in BASE) + " END"
    window = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN {w}" for _, p, w, _ in CLASSES) + " END"
    limit = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN {b}::DOUBLE" for _, p, _, b in CLASSES) + " END"
    allowed = " OR ".join(f"regexp_matches(s, '{p}')" for p in ALLOWED)
    listed = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents), h AS ({hits}
), b AS (
  SELECT id, rank, kind, CAST(upto - length(hit) AS BIGINT) AS a, CAST(upto AS BIGINT) AS z
  FROM (SELECT *, sum(length(piece) + length(hit)) OVER (PARTITION BY id, rank ORDER BY i) AS upto FROM h) WHERE length(val) >= {least}
), c0 AS (
  SELECT id, unnest(regexp_extract_all(text, '{CANDIDATE}', 0)) AS s, unnest(string_split_regex(text, '{CANDIDATE}')[:-2]) AS piece, unnest(range(len(regexp_extract_all(text, '{CANDIDATE}', 0)))) AS i FROM d
), c AS (
  SELECT id, s, i, sum(length(piece) + length(s)) OVER (PARTITION BY id ORDER BY i) - length(s) AS a, {window} AS w, {limit} AS bits FROM c0
), v AS (
  SELECT id, i, a, w, bits, unnest(range(1, length(s) - w + 2)) AS k, s FROM c WHERE NOT ({allowed}) AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')
), e AS (
  SELECT id, {len(BASE)} AS rank, 'entropy' AS kind, CAST(a + min(k) - 1 AS BIGINT) AS a, CAST(a + max(k) - 1 + w AS BIGINT) AS z
  FROM (SELECT *, list_aggregate(string_split(substr(s, k, w), ''), 'entropy') AS h FROM v) t WHERE h >= bits - 1e-9 GROUP BY id, i, t.a, w
), f AS (
  SELECT * FROM b UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = e.id AND b.a <= e.a AND e.z <= b.z)
), gb AS (
  SELECT id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in BASE)}, {listed} AS said FROM b GROUP BY 1
), gf AS (SELECT id, {listed} AS said FROM f GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in BASE)}, sha256(coalesce(gb.said, '')) AS base_sha256, coalesce(gf.said, '') AS spans
FROM d LEFT JOIN gb USING (id) LEFT JOIN gf USING (id)
"""


SQL = _sql()
