"""Data-quality gates, audits and repair reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_STORES, MIN_PRICES, MAX_NAMED_BY_CODE, MAX_BAD_PRICES = 1, 100, 0.25, 0.001
#: Names of packs of several.
PACK = r"\d+\s*[*xX]\s*\d+"


def chain_profile(prices: DataFrame, stores: DataFrame) -> DataFrame:
    """Prices, branches, products and share of all prices of each chain."""
    rows = prices.join(stores.select("store_id", "chain_name"), "store_id")
    each = rows.groupBy("chain_name").agg(F.count("*").alias("prices"), F.countDistinct("store_id").alias("stores"), F.countDistinct("product_id").alias("products"))
    total = rows.agg(F.count("*").alias("all"))
    return each.crossJoin(F.broadcast(total)).select("chain_name", "prices", "stores", "products", F.round(F.col("prices") * 100.0 / F.col("all"), 2).alias("share"))  # the total is one row


def dq_chains(prices: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Counts and problems of all chains at once; a chain without prices is a row too."""
    named = products.select("product_id", (F.col("name") == F.col("barcode")).cast("double").alias("by_code"))
    rows = prices.join(named, "product_id").join(stores.select("store_id", "chain_id"), "store_id")
    priced = rows.groupBy("chain_id").agg(F.count("*").alias("prices"))
    share = rows.select("chain_id", "product_id", "by_code").distinct().groupBy("chain_id").agg(F.avg("by_code").alias("named_by_code"))
    each = stores.groupBy("chain_id").agg(F.count("*").alias("stores")).join(priced, "chain_id", "left").join(share, "chain_id", "left").fillna(0, ["prices"])
    problems = F.concat_ws(",", F.when(F.col("stores") < MIN_STORES, "stores"), F.when(F.col("prices") < MIN_PRICES, "prices"), F.when(F.col("named_by_code") > MAX_NAMED_BY_CODE, "names"))
    return each.select("chain_id", "stores", "prices", "named_by_code", problems.alias("problems"))


def orphan_prices(prices: DataFrame, stores: DataFrame) -> DataFrame:
    return prices.join(stores, "store_id", "left_anti")


def dq_all(prices: DataFrame, stores: DataFrame) -> DataFrame:
    """One row: prices, orphans, share of prices of 0 or less, and whether the gate holds."""
    known = stores.select("store_id", F.lit(1).alias("known"))
    one = prices.join(known, "store_id", "left").agg(F.count("*").alias("prices"), F.count_if(F.col("known").isNull()).alias("orphans"), F.count_if(F.col("price") <= 0).alias("bad"))
    return one.withColumn("ok", (F.col("prices") > 0) & (F.col("orphans") == 0) & (F.col("bad") <= MAX_BAD_PRICES * F.col("prices")))


def outcome_gate(records: DataFrame, planned: int, require_promos: bool = True) -> DataFrame:
    """``problem`` rows over the outcomes of chains (``chain, job_status, skipped, price_loader, promotion_loader``)."""
    one = records.agg(
        F.countDistinct("chain").alias("chains"),
        F.count("*").alias("n"),
        F.count_if("skipped").alias("skipped"),
        F.count_if(F.col("price_loader") == "success").alias("prices"),
        F.count_if(F.col("promotion_loader") == "success").alias("promos"),
    )
    c = F.col
    found = [F.when(c("chains") < planned, "missing chains"), F.when((c("n") > 0) & (c("skipped") == c("n")), "all skipped"), F.when(c("prices") == 0, "no price load")]
    if require_promos:
        found.append(F.when(c("promos") == 0, "no promotion load"))
    return one.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("problem"))


def audit_promotions(promotions: DataFrame, items: DataFrame, prices: DataFrame, now: Column, top: int = 25) -> DataFrame:
    """Single-unit fixed prices below 60 % of the cheapest shelf price, by description; a report of the most common."""
    from basketlens.functions.promo_rules import is_conditional

    rows = promotions.filter((F.col("reward_kind") == "FIXED_PRICE") & (F.col("min_qty") <= 1) & (F.col("ends_at").isNull() | (F.col("ends_at") >= now)) & ~is_conditional(F.col("description")))
    rows = rows.join(items, "promotion_id").join(prices.select("store_id", F.col("product_id").alias("canonical_id"), "price"), ["store_id", "canonical_id"])
    each = rows.groupBy("description", "discounted_price").agg(F.countDistinct("store_id").alias("branches"), F.min("price").alias("shelf"))
    return each.filter(F.col("discounted_price") < F.col("shelf") * 0.6).orderBy(F.desc("branches"), "description", "discounted_price").limit(top)


def audit_mixed_packs(products: DataFrame, mapped: DataFrame) -> DataFrame:
    """Canonical items that hold packs and single items."""
    rows = mapped.join(products.select("product_id", "name"), "product_id").withColumn("pack", F.col("name").rlike(PACK))
    each = rows.groupBy("canonical_id").agg(F.count_if("pack").alias("packs"), F.count("*").alias("members"), F.slice(F.array_sort(F.collect_set("name")), 1, 8).alias("examples"))
    return each.filter("packs > 0 and packs < members")


def drift(df: DataFrame, column: str, fresh: Column) -> DataFrame:
    """Stored values that cleaning would change now: ``old, new, rows``, and how many rows have the new value already."""
    rows = df.select(F.col(column).alias("old"), fresh.alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))
    there = df.groupBy(F.col(column).alias("new")).agg(F.count("*").alias("already"))
    return rows.groupBy("old", "new").agg(F.count("*").alias("rows")).join(there, "new", "left").select("old", "new", "rows", F.coalesce("already", F.lit(0)).alias("already"))


def legacy_keys(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Products with keys that are too short, and how many prices go with each."""
    old = products.filter(F.char_length("barcode") < 8).select("product_id", "barcode")
    return old.join(prices.groupBy("product_id").agg(F.count("*").alias("n")), "product_id", "left").select("product_id", "barcode", F.coalesce("n", F.lit(0)).alias("prices"))


def price_changes(log: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a price log whose price differs from the one before of the same item and branch."""
    before = F.lag("price").over(Window.partitionBy("product_id", "store_id").orderBy(*order))
    return log.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col("price")))
