"""Gates after a load and before its rows count as current: what is wrong, for all chains at once.

A chain with a problem keeps its rows of the day before: a stale price beats a wrong one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of prices outside their item's band, and of promotions that are over when they come, at most.
MAX_OUTSIDE, MAX_EXPIRED = "0.001", "0.05"
#: How far a day's rows may be from the mean of the week before.
MAX_CHANGE = "0.3"
#: Ranks of the sketches are off by one in so many rows.
ACCURACY = 10_000


def price_bands(history: DataFrame, keys: tuple[str, ...] = ("product_id",), accuracy: int = ACCURACY) -> DataFrame:
    """``keys, low, high, seen``: the first and the last percentile of what each item has cost.

    Quantile sketches are merged, so that an item that everyone sells is summed up where
    its rows are; up to ``accuracy`` rows of an item its percentiles are exact.
    """
    band = F.percentile_approx("price", [0.01, 0.99], accuracy)
    each = history.filter("price is not null").groupBy(*keys).agg(band.alias("band"), F.count("*").alias("seen"))
    return each.select(*keys, F.col("band")[0].alias("low"), F.col("band")[1].alias("high"), "seen")


def outside_bands(load: DataFrame, bands: DataFrame) -> DataFrame:
    """``chain_id, prices, outside, ok``: prices of a load that their item's band does not hold; an item without a past is no fault."""
    rows = load.join(bands, [c for c in bands.columns if c not in ("low", "high", "seen")], "left")
    out = (F.col("price") < F.col("low")) | (F.col("price") > F.col("high"))
    each = rows.groupBy("chain_id").agg(F.count("*").alias("prices"), F.count_if(out).alias("outside"))
    return each.withColumn("ok", F.col("outside") <= F.col("prices") * F.lit(MAX_OUTSIDE).cast("decimal(4,3)"))


def daily_volume(log: DataFrame) -> DataFrame:
    """``chain_id, day, rows, stores`` of a log with ``chain_id, day, store_id``."""
    return log.groupBy("chain_id", "day").agg(F.count("*").alias("rows"), F.countDistinct("store_id").alias("stores"))


def volume_gate(daily: DataFrame) -> DataFrame:
    """Days with ``week_rows`` over the ``week_days`` loads of the seven days before, ``stores_before`` (the load before) and ``problems``.

    A day is compared with the mean load of that week; the first load after a silent week has nothing to differ from.
    """
    chain = Window.partitionBy("chain_id").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date")))
    week = chain.rangeBetween(-7, -1)
    rows = daily.withColumns({"week_rows": F.coalesce(F.sum("rows").over(week), F.lit(0)), "week_days": F.count("*").over(week), "stores_before": F.lag("stores").over(chain)})
    away = F.abs(F.col("rows") * F.col("week_days") - F.col("week_rows")) > F.col("week_rows") * F.lit(MAX_CHANGE).cast("decimal(3,1)")
    problems = F.concat_ws(",", F.when((F.col("week_days") > 0) & away, "volume"), F.when(F.col("stores") < F.col("stores_before"), "stores"))
    return rows.withColumn("problems", problems)


def freshness_gate(log: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """``chain_id, newest, ok``: whether a chain's newest price (``seen``) is from the last hours; without any it is not."""
    each = log.groupBy("chain_id").agg(F.max("seen").cast("timestamp_ntz").alias("newest"))
    return each.withColumn("ok", F.coalesce(F.col("newest") >= now - F.make_dt_interval(hours=F.lit(hours)), F.lit(False)))


def promotion_gate(promotions: DataFrame, now: Column) -> DataFrame:
    """``chain_id, promotions, backwards, expired, ok``: promotions that end before they start, or that are over when they come."""
    backwards, expired = F.col("ends_at") <= F.col("starts_at"), F.col("ends_at") < now
    each = promotions.groupBy("chain_id").agg(F.count("*").alias("promotions"), F.count_if(backwards).alias("backwards"), F.count_if(expired).alias("expired"))
    return each.withColumn("ok", (F.col("backwards") == 0) & (F.col("expired") <= F.col("promotions") * F.lit(MAX_EXPIRED).cast("decimal(3,2)")))


def load_gate(chains: DataFrame, **verdicts: DataFrame) -> DataFrame:
    """``chain_id, problems, ok`` of all ``chains``: names of the verdicts (``chain_id, ok``) that a chain fails; a chain that a verdict does not know fails it."""
    rows = chains.select("chain_id").distinct()
    for name, verdict in verdicts.items():
        rows = rows.join(verdict.select("chain_id", F.col("ok").alias(f"__{name}")), "chain_id", "left")
    problems = F.concat_ws(",", *(F.when(~F.coalesce(F.col(f"__{name}"), F.lit(False)), name) for name in verdicts))
    return rows.select("chain_id", problems.alias("problems"), (problems == "").alias("ok"))


def promote(current: DataFrame, load: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of ``load`` for chains that pass, those of ``current`` for all others; ``chain_id`` null never passes."""
    good = gate.filter("ok").select("chain_id")
    return load.join(good, "chain_id", "left_semi").unionByName(current.join(good, "chain_id", "left_anti").select(*load.columns))
