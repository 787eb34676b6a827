"""Live evidence: posteriors kept as state of a stream, equal to the batch fold of the same items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import EPS
from ..operators.ledger import HYPOTHESIS_BANDS

OUTPUT = "hid long, n long, applied_n long, rejected_n long, posterior double, status string"
STATE = "p double, closed boolean, applied long, rejected long"


def update(p: float, ratio: float) -> float:
    if ratio < 0:
        raise ValueError("a likelihood ratio must not be negative")
    if ratio == 0:
        return EPS
    p = min(1 - EPS, max(EPS, p))
    odds = p / (1 - p) * ratio
    return min(1 - EPS, max(EPS, odds / (1 + odds)))


def status_of(p: float, bands: tuple[float, float, float]) -> str:
    up, down, weak = bands
    return "CONFIRMED" if p >= up else "REFUTED" if p <= down else "WEAKENED" if p <= weak else "ACTIVE"


def fold_stream(evidence: DataFrame, prior: float = 0.5, bands: tuple[float, float, float] = HYPOTHESIS_BANDS) -> DataFrame:
    """hid, n, applied_n, rejected_n, posterior, status whenever evidence (hid, seq, likelihood_ratio) comes in.

    Items of a micro-batch are applied in the order of seq; an older one that comes later is
    applied when it comes, as the state holds no history. Refuted hypotheses are closed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, closed, applied, rejected = state.get if state.exists else (prior, False, 0, 0)
        for _, ratio in sorted((s, r) for b in batches for s, r in zip(b["seq"], b["likelihood_ratio"], strict=True)):
            if closed:
                rejected += 1
                continue
            p, applied = update(p, float(ratio)), applied + 1
            closed = p <= bands[1]
        state.update((float(p), bool(closed), int(applied), int(rejected)))
        yield pd.DataFrame([(key[0], applied + rejected, applied, rejected, p, status_of(p, bands))], columns=["hid", "n", "applied_n", "rejected_n", "posterior", "status"])

    own = evidence.select(F.col("hid").cast("long"), F.col("seq").cast("long"), F.col("likelihood_ratio").cast("double"))
    return own.groupBy("hid").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_values(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """event_type, start, n, mean of event-time windows; events later than late are not counted."""
    w = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", size)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return w.select("event_type", F.col("window.start").alias("start"), "n", "mean")


def replay(spark: SparkSession, source: str, schema: str, fold, name: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Runs a stream over the Parquet files that are there now and returns all it gave out."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = fold(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
