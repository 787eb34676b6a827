"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .native import WORD

#: Fixed by the contract: weights by the place of the source's name, share of all sizes, most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = 17
#: Half of this many words: a document of so many words has half the largest inclusion weight.
SHORT = 100
WORTH = f"1000 * size div (size + {SHORT})"
#: Parts of the order, and of the part of it in which a source is filled, whose words are summed before any row is sorted.
BINS = 4096
#: How often the order is gone through: once for all documents, then for those that still fit.
PASSES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds weight and target to source, source_size, one row for each source.

    Sources are sorted by the level at which they fill up; a source is full if the level reached by
    those after it is no lower, and the rest share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    out = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))).cast("long"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spare = F.lit(float(share)) * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    out = out.withColumn("level", spare / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    open_ = most * F.col("source_size") > F.col("level") * F.col("weight")
    out = out.withColumn("level", F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("source_size") / F.col("weight"))).over(everything))
    return out.withColumn("target", F.least(F.lit(1.0 * most) * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), F.lit(1.0 * most) * F.col("source_size"))))


def _certain(worths: DataFrame) -> DataFrame:
    """source, surely, open_rest, open_weight of each source, from source, worth, words, rest (a row for each worth).

    Inclusion odds are in proportion to worth. Where those of the largest would be 1 or more they
    are certain: their words are taken out and the rest is scaled anew, down to the first worth
    whose odds are below 1. surely: the least certain worth; null: none is.
    """
    down = Window.partitionBy("source").orderBy(F.desc("worth"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("words") * F.col("worth")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = worths.withColumn("sure", (F.col("worth") > 0) & ((F.col("rest") - above) * F.col("worth") >= below))
    none = F.lit(0).cast("long")
    return out.groupBy(F.col("source").alias("of")).agg(
        F.min(F.when(F.col("sure"), F.col("worth"))).alias("surely"),
        (F.max("rest") - F.sum(F.when(F.col("sure"), F.col("words")).otherwise(none))).alias("open_rest"),
        F.sum(F.when(~F.col("sure"), F.col("words") * F.col("worth")).otherwise(none)).alias("open_weight"),
    )


def _with_order(rows: DataFrame, seed: int) -> DataFrame:
    """Adds order from 0 (certain) to 1 (never), which rises with the random odds divided by the inclusion odds."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "name")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    chance = F.when(F.col("worth") >= F.col("surely"), 1.0).when(F.col("open_weight") > 0, F.col("open_rest") * F.col("worth") / F.col("open_weight")).otherwise(0.0)
    odds = u / (1 - u) * (1 - F.col("chance")) / F.col("chance")
    rows = rows.withColumn("chance", chance)
    return rows.withColumn("order", F.when(F.col("chance") >= 1, 0.0).when(F.col("chance") <= 0, 1.0).otherwise(odds / (1 + odds)))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _reached(rows: DataFrame, part: Column, base: str) -> tuple[DataFrame, DataFrame]:
    """source, limit, order, size, base -> rows in the part of the order in which the limit is passed, with its base."""
    rows = rows.withColumn("part", part)
    words = rows.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("limit").alias("limit"), F.first(base).alias("base"))
    words = words.withColumn("base", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words"))
    ends = words.groupBy("source").agg(F.max(F.col("base") + F.col("words")).alias("all"), F.min(F.when(F.col("base") + F.col("words") > F.col("limit"), F.struct("part", "base"))).alias("at"))
    ends = ends.select(F.col("source").alias("of"), "all", F.col("at.part").alias("reached"), F.col("at.base").alias("before"))
    return rows.drop(base).join(ends, _same("source", "of") & (F.col("part") == F.col("reached"))).drop("of", "all", "reached", "part"), ends


def _cut(open_: DataFrame) -> DataFrame:
    """of, cut, words of each source: the place in the order at which the next document no longer fits, and the words before it.

    open_: source, order, size, limit. Words are summed by BINS parts of the order, then by BINS
    parts of the one part in which the limit is passed; only what shares that is sorted, after rows
    at one place have been added up. cut is null where everything fits.
    """
    inside, ends = _reached(open_.withColumn("none", F.lit(0).cast("long")), F.least(F.floor(F.col("order") * BINS), F.lit(BINS - 1)), "none")
    inner, _ = _reached(inside, F.least(F.floor(F.col("order") * BINS * BINS), F.lit(BINS * BINS - 1)), "before")
    spots = inner.groupBy("source", "order").agg(F.sum("size").alias("size"), F.first("limit").alias("limit"), F.first("before").alias("base"))
    spots = spots.withColumn("upto", F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("order")))
    cut = spots.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("limit"), F.col("order"))).alias("cut"), F.max(F.when(F.col("upto") <= F.col("limit"), F.col("upto"))).alias("fit"), F.max("base").alias("base"))
    out = ends.join(cut, _same("of", "source"), "left")
    return out.select("of", "cut", F.coalesce("fit", "base", "all").alias("words"))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and places in the order, and for each source its target, whole copies and where the order is cut.

    Whole copies that all documents of a source get are allocated first. For the rest of its target
    each document has an inclusion chance that rises with its size (short ones are repeated less),
    scaled so that the expected words are the rest, documents that are certain apart. Documents are
    taken in Pareto order up to the first that no longer fits, then, from there on, in the same
    order those that still fit, PASSES times in all; what is left open is less than the document
    that ended the last pass. A third of all rows may belong to one source: see _cut.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), _name(F.col(doc_id), F.col(text)).alias("name"))
    rows = settle(own.withColumn("worth", F.expr(WORTH)))
    worths = settle(rows.groupBy("source", "worth").agg(F.sum("size").alias("words")))
    plan = source_targets(worths.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = settle(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("level"))
    rests = plan.select(F.col("source").alias("of"), "rest")
    plan = settle(plan.join(_certain(worths.join(rests, _same("source", "of")).drop("of")), _same("source", "of")).drop("of"))
    rows = settle(_with_order(rows.join(plan.select(F.col("source").alias("of"), "surely", "open_rest", "open_weight"), _same("source", "of")), seed).select("source", "doc_id", "name", "size", "order"))
    after, gap = F.lit(0.0), F.col("open_rest")
    for k in range(1, PASSES + 1):
        known = plan.select(F.col("source").alias("of"), after.alias("after"), gap.alias("limit"))
        open_ = rows.where("order > 0 and size > 0").join(known, _same("source", "of")).where("order >= after")
        if k > 1:
            open_ = open_.where("size <= limit")
        cut = _cut(open_.select("source", "order", "size", "limit")).withColumnsRenamed({"cut": f"cut{k}", "words": "fit"})
        plan = settle(plan.join(cut, _same("source", "of"), "left").drop("of").withColumn(f"gap{k}", gap - F.coalesce("fit", F.lit(0))).drop("fit"))
        after, gap = F.col(f"cut{k}"), F.col(f"gap{k}")
    return rows, plan


def _name(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds copies to rows that have source, size and order."""
    cuts = [c for k in range(1, PASSES + 1) for c in (f"cut{k}", f"gap{k}")]
    out = rows.join(plan.select(F.col("source").alias("of"), "source_size", "target", "whole", F.col("open_rest").alias("left_"), *cuts), _same("source", "of"))
    # A cut is null where all that still fits is taken.
    extra = (F.col("order") == 0) | ((F.col("left_") > 0) & (F.col("order") < F.coalesce("cut1", F.lit(1.0))))
    for k in range(2, PASSES + 1):
        extra |= (F.col("order") >= F.col(f"cut{k - 1}")) & (F.col("size") > 0) & (F.col("size") <= F.col(f"gap{k - 1}")) & F.coalesce(F.col("order") < F.col(f"cut{k}"), F.lit(True))
    return out.withColumn("copies", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long"))


def mix_sizes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs.

    Null texts have size 0; a null source is a source of its own, last by name. A document's draw
    follows from its doc_id alone (null: from its text), so reruns agree; equal rows get the same
    number of copies. Sources without words have target 0. Other
    columns are not read; an empty table gives an empty result.
    """
    rows, plan = mix_plan(docs, **how)
    out = _copies(rows, plan)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; texts are not shuffled.

    A source's plan is a few numbers, so the copies of a row follow from the row itself.
    """
    rows, plan = mix_plan(docs, doc_id, text, source, seed, **how)
    own = docs.select(F.struct("*").alias("_row"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), _name(F.col(doc_id), F.col(text)).alias("name"))
    own = own.withColumn("worth", F.expr(WORTH))
    own = _with_order(own.join(plan.select(F.col("source").alias("at"), "surely", "open_rest", "open_weight"), _same("source", "at")), seed)
    kept = _copies(own, plan).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return kept.select("_row.*")


def _sql() -> str:
    passes, takes = "", ["o.place = 0", "(q.open_rest > 0 AND o.place < coalesce(cut1, 1.0))"]
    for k in range(1, PASSES + 1):
        known, after, limit = ("q", "0.0", "open_rest") if k == 1 else (f"k{k - 1}", f"x.cut{k - 1}", f"gap{k - 1}")
        fits = "" if k == 1 else f"AND o.size <= x.{limit}"
        passes += f"""
, w{k} AS (
  SELECT o.source, o.place, x.{limit} AS room, sum(o.size) OVER (PARTITION BY o.source ORDER BY o.place) AS upto
  FROM o JOIN {known} x ON o.source IS NOT DISTINCT FROM x.source WHERE o.place > 0 AND o.size > 0 AND o.place >= {after} {fits}
), c{k} AS (
  SELECT source, min(place) FILTER (upto > room) AS cut{k}, coalesce(max(upto) FILTER (upto <= room), 0) AS fit FROM w{k} GROUP BY source
), k{k} AS (
  SELECT x.*, c.cut{k}, x.{limit} - coalesce(c.fit, 0) AS gap{k} FROM {known} x LEFT JOIN c{k} c ON x.source IS NOT DISTINCT FROM c.source
)"""
        if k > 1:
            takes.append(f"(o.place >= cut{k - 1} AND o.size > 0 AND o.size <= gap{k - 1} AND coalesce(o.place < cut{k}, true))")
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST(doc_id AS VARCHAR) AS name FROM documents
), s AS (
  SELECT *, 1000 * size // (size + {SHORT}) AS worth FROM d
), g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM s GROUP BY source
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM g WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (SELECT arg_min(level, source_size / weight) FROM l WHERE 2 * source_size > level * weight)) AS target FROM l
), p AS (
  SELECT *, CAST(floor(target / source_size) AS BIGINT) AS whole, target - floor(target / source_size) * source_size AS rest FROM t
), v AS (
  SELECT s.source, s.worth, sum(s.size) AS words, any_value(p.rest) AS rest FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source GROUP BY s.source, s.worth
), y AS (
  SELECT *, worth > 0 AND (rest - coalesce(sum(words) OVER (n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * worth
            >= sum(words * worth) OVER (n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sure
  FROM v WINDOW n AS (PARTITION BY source ORDER BY worth DESC)
), z AS (
  SELECT source, min(worth) FILTER (sure) AS surely, max(rest) - coalesce(sum(words) FILTER (sure), 0) AS open_rest,
         coalesce(sum(words * worth) FILTER (NOT sure), 0) AS open_weight FROM y GROUP BY source
), q AS (
  SELECT p.*, z.surely, z.open_rest, z.open_weight FROM p JOIN z ON p.source IS NOT DISTINCT FROM z.source
), c AS (
  SELECT s.*, CASE WHEN s.worth >= q.surely THEN 1.0::DOUBLE WHEN q.open_weight > 0 THEN q.open_rest * s.worth / q.open_weight ELSE 0.0::DOUBLE END AS chance,
         (CAST('0x' || substr(md5('{SEED}:' || name), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source
), o AS (
  SELECT *, CASE WHEN chance >= 1 THEN 0.0 WHEN chance <= 0 THEN 1.0 ELSE (u / (1 - u) * (1 - chance) / chance) / (1 + u / (1 - u) * (1 - chance) / chance) END AS place FROM c
){passes}
SELECT o.doc_id, o.size, q.source_size, q.target, o.size * (q.whole + CASE WHEN {" OR ".join(takes)} THEN 1 ELSE 0 END) AS taken
FROM o JOIN k{PASSES} q ON o.source IS NOT DISTINCT FROM q.source
"""


SQL = _sql()
