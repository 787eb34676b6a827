"""Line dedup by winnowing over line hashes, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .native import let, running_sums

#: Least bytes, line ends included, of a repeated run of lines that is removed; also what a winnowing window spans.
LENGTH = 40
#: Documents without an id come after all others.
LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.coalesce(own, F.lit(""))).alias("t"), own.alias("text"))


def _measured(text: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """body(lines, begin, end) with where, in bytes, each line begins and ends; each worked out once."""

    def ends(lines: Column, begin: Column) -> Column:
        return F.zip_with(begin, lines, lambda a, x: a + F.octet_length(x) + 1)

    def measured(lines: Column) -> Column:
        begins = running_sums(F.transform(lines, lambda x: (F.octet_length(x) + 1).cast("long")))
        return let(begins, lambda begin: let(ends(lines, begin), lambda end: body(lines, begin, end)))

    return let(_lines(text), measured)


def _last(begin: Column, end: Column, i: Column, length: int) -> Column:
    """The line in which the first length bytes from line i on end; beyond all lines if there are fewer. No line is shorter than a byte."""
    return i + F.size(F.filter(F.slice(end, i + 1, F.lit(length)), lambda e: e - F.get(begin, i) < length))


def _first(begin: Column, end: Column, j: Column, length: int) -> Column:
    """The line in which the last length bytes up to line j begin."""
    at = F.greatest(j - length + 2, F.lit(1))
    return j - F.size(F.filter(F.slice(begin, at, j - at + 2), lambda b: F.get(end, j) - b < length))


def fingerprints(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """d, t, print, at, low, high: the winnowed lines of each document.

    A window is the shortest run of lines from some line on that has length bytes; of each window
    the line with the least hash is selected, the first of equals. at: a selected line, print: its
    hash; low, high: the first and last line from which windows begin that selected it. Every run
    of length bytes holds a window, so equal runs share a selected line at the same place in them.
    """

    def selected(lines: Column, begin: Column, end: Column) -> Column:
        def least(h: Column, i: Column) -> Column:
            own = lambda j: F.when(j < F.size(h), let(F.slice(h, i + 1, j - i + 1), lambda w: (i + F.array_position(w, F.array_min(w)) - 1).cast("int")))
            return let(_last(begin, end, i, length), own)

        def turns(h: Column, own: Column) -> Column:
            # Windows that select the same line follow one another.
            firsts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i) != F.get(own, i - 1)))
            said = lambda k, i, f: F.struct(F.get(h, F.get(own, i)).alias("print"), F.get(own, i).alias("at"), i.alias("low"), (F.coalesce(F.get(f, k + 1), F.size(own)) - 1).alias("high"))
            return F.when(F.size(own) > 0, let(firsts, lambda f: F.transform(f, lambda i, k: said(k, i, f))))

        def windows(h: Column) -> Column:
            picked = F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: least(h, i)), lambda p: p.isNotNull())
            return let(picked, lambda own: turns(h, own))

        return let(F.transform(lines, lambda x: F.xxhash64(x)), windows)

    return rows.where("text is not null").select("d", "t", F.inline(_measured(F.col("text"), selected)))


def _grown(rows: DataFrame, spots: DataFrame, length: int) -> DataFrame:
    """d, t, at, last, run: from each spot the runs of lines around it, grown line by line to length bytes, and a hash of their text.

    Matches grow to the right from each line whose window selected the spot, and to the left from
    each line where such a run can end; longer matches are unions of these.
    """

    def grown(lines: Column, begin: Column, end: Column) -> Column:
        n = F.size(lines)

        def run(i: Column, j: Column) -> Column:
            text = F.array_join(F.slice(lines, i + 1, j - i + 1), "\n")
            return F.struct(i.alias("at"), j.alias("last"), F.unhex(F.sha2(text, 256)).alias("run"))

        def rightwards(s: Column) -> Column:
            return F.transform(F.sequence(s["low"], s["high"]), lambda i: let(_last(begin, end, i, length), lambda j: run(i, j)))

        def leftwards(s: Column) -> Column:
            # Up to where runs from the next spot's first line on can end; those that begin with a window are there already.
            stop = F.when(s["high"] + 1 < n, F.least(_last(begin, end, s["high"] + 1, length), n)).otherwise(n) - 1
            lasts = let(F.struct(_last(begin, end, s["low"], length).alias("j"), stop.alias("k")), lambda x: F.when(x["j"] <= x["k"], F.sequence(x["j"], x["k"])).otherwise(F.array().cast("array<int>")))
            known = lambda i, j: _last(begin, end, i, length) == j
            return F.filter(F.transform(lasts, lambda j: let(_first(begin, end, j, length), lambda i: F.when(~known(i, j), run(i, j)))), lambda r: r.isNotNull())

        return F.flatten(F.transform("spots", lambda s: F.concat(rightwards(s), leftwards(s))))

    both = rows.where("text is not null").join(spots, ["d", "t"])
    return both.select("d", "t", F.inline(_measured(F.col("text"), grown)))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """d, t, runs: the lines of each document that lie in a run of length bytes or more that occurs earlier.

    Selected fingerprints are joined by their hash, and one that occurs once goes no further. From
    the others matches are extended both ways, compared by 256 bits of their text, and of equal ones
    the first by doc_id and line stays. Nothing is paired with anything but the first of its kind,
    so a line that a third of all documents share costs a row for each.
    """
    rows = _keyed(docs, doc_id, text)
    prints = settle(fingerprints(rows.select("d", "t", "text"), length))
    place = F.struct("d", "t", "at")
    shared = prints.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("print")
    spots = prints.join(shared, "print", "left_semi").groupBy("d", "t").agg(F.collect_set(F.struct("low", "high")).alias("spots"))
    grown = settle(_grown(rows, spots, length))
    first = grown.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("end")).where("first <> end").drop("end")
    later = grown.join(first, "run").where(place > F.col("first"))
    lines = later.select("d", "t", F.explode(F.sequence("at", "last")).alias("line"))
    gone = lines.groupBy("d", "t").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return gone.select("d", "t", _joined(F.col("lines")).alias("runs"))


def _joined(lines: Column) -> Column:
    """Neighbouring lines as runs: struct(start, stop) of each, by start."""
    firsts = F.filter(lines, lambda x, i: (i == 0) | (x - F.get(lines, i - 1) > 1))
    lasts = F.filter(lines, lambda x, i: (i == F.size(lines) - 1) | (F.get(lines, i + 1) - x > 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept of every row of docs.

    Lines are parted by \\n and as long as their UTF-8 with the line end, which the last one has
    too. A line is removed if it lies in a run of one or more whole lines, of length bytes or more
    in all, that occurs, line by line, at an earlier place, earlier meaning a smaller doc_id or the
    same document further up. n_runs counts maximal removed runs; kept is the text of the other
    lines. A null text has no lines and stays null, an empty one has one empty line. Rows with the
    same doc_id and text are one document and share its result; with other texts they are ordered
    by a hash of it. A null doc_id is later than any other. Other columns are not read; an empty
    table gives an empty result.
    """
    return _without(_keyed(docs, doc_id, text), repeated_lines(docs, doc_id, text, length))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """keyed and d, t, runs -> the rows without the lines of their runs, and counts of both."""
    out = keyed.join(gone, ["d", "t"], "left")
    runs = F.coalesce("runs", F.array().cast("array<struct<start:int,stop:int>>"))
    out = out.select("doc_id", _lines(F.col("text")).alias("lines"), runs.alias("runs"), F.col("text").isNull().alias("none"))

    def between(r: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(r, i)["start"], F.size("lines"))
        start = F.when(i == 0, 0).otherwise(F.get(r, i - 1)["stop"])
        return F.slice("lines", start + 1, stop - start)

    kept = F.when(F.size("runs") == 0, F.col("lines")).otherwise(let(F.col("runs"), lambda r: F.flatten(F.transform(F.sequence(F.lit(0), F.size(r)), lambda i: between(r, i)))))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), removed.alias("n_removed"), F.size("runs").cast("long").alias("n_runs"), F.when(~F.col("none"), F.array_join(kept, "\n")).alias("kept"))


def line_digests(docs: DataFrame, **how) -> DataFrame:
    """dedup_lines with the MD5 of the kept text (null: of nothing) in place of it."""
    return dedup_lines(docs, **how).withColumn("kept_md5", F.md5(F.coalesce("kept", F.lit("")))).drop("kept")


SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents
), n AS (
  SELECT doc_id, unnest(lines) AS text, unnest(range(len(lines))) AS line FROM d
), l AS (
  SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS stop FROM n
), r AS (
  SELECT a.doc_id, a.line AS pos, min(b.line) AS last FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.line BETWEEN a.line AND a.line + {LENGTH}
  WHERE b.stop - a.stop + strlen(a.text) + 1 >= {LENGTH} GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.line) AS pos, b.line AS last FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.line BETWEEN b.line - {LENGTH} AND b.line
  WHERE b.stop - a.stop + strlen(a.text) + 1 >= {LENGTH} GROUP BY 1, 3
), m AS (
  SELECT doc_id, pos, last, row_number() OVER (PARTITION BY array_to_string(lines[pos + 1 : last + 1], chr(10)) ORDER BY doc_id, pos) > 1 AS later FROM r JOIN d USING (doc_id)
), x AS (
  SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS line FROM m WHERE later
), j AS (
  SELECT n.doc_id, n.line, n.text, x.line IS NOT NULL AS gone FROM n LEFT JOIN x ON n.doc_id = x.doc_id AND n.line = x.line
), k AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line), false) AS opens FROM j
), g AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs,
         string_agg(text, chr(10) ORDER BY line) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       md5(coalesce(kept, '')) AS kept_md5
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
