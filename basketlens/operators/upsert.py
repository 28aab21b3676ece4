"""Keyed tables: upserts, merges of sightings, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last in ``order``: one aggregation with partial results."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("__last")).select(*keys, *(F.col("__last")[c].alias(c) for c in rest)).select(*df.columns)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last writer wins; rows of the target that are not in the updates stay."""
    new = last_per_key(updates, keys, order).select(*target.columns)
    return target.join(new, list(keys), "left_anti").select(*target.columns).unionByName(new)


def upsert_coalesce(target: DataFrame, updates: DataFrame, keys: Sequence[str], overwrite: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """New values of ``overwrite`` replace old ones; those of ``keep`` only where they are not null."""
    old = target.select(*keys, *(F.col(c).alias(f"__old_{c}") for c in (*overwrite, *keep)), F.lit(True).alias("__was"))
    new = updates.select(*keys, *overwrite, *keep, F.lit(True).alias("__is"))
    joined = old.join(new, list(keys), "full_outer")
    fresh = F.col("__is").isNotNull()
    values = [F.when(fresh, F.col(c)).otherwise(F.col(f"__old_{c}")).alias(c) for c in overwrite]
    values += [F.coalesce(F.col(c), F.col(f"__old_{c}")).alias(c) for c in keep]
    return joined.select(*keys, *values)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is new are added once."""
    fresh = rows.select(*target.columns).dropDuplicates(list(keys))
    return target.unionByName(fresh.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def merge_sightings(df: DataFrame, key: str, order: Column, fields: Sequence[str]) -> DataFrame:
    """For each key and field the last value that is not blank; false and 0 are values."""
    kinds = dict(df.dtypes)

    def last(c: str) -> Column:
        blank = F.col(c).isNull() | ((F.trim(F.col(c)) == "") if kinds[c] == "string" else F.lit(False))
        return F.max_by(F.col(c), F.when(~blank, order)).alias(c)

    return df.groupBy(key).agg(*(last(c) for c in fields))


def row_cap(df: DataFrame, file: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each file, for smoke runs."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(file).orderBy(order))
    return df.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def cascade_delete(tables: dict[str, DataFrame], roots: DataFrame, steps: Sequence[tuple[str, str]]) -> dict[str, DataFrame]:
    """Remove ``roots`` (one id column) from each ``(table, column)`` of ``steps``."""
    root = roots.columns[0]
    out = dict(tables)
    for name, column in steps:
        ids = roots.select(F.col(root).alias(column)).distinct()
        out[name] = out[name].join(ids, column, "left_anti").select(*out[name].columns)
    return out


def refresh_availability(prices: DataFrame, products: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``product_id, availability`` of products whose number of distinct stores changed.

    A product that lost all its prices keeps its number.
    """
    rows = prices if touched is None else prices.join(touched.select("product_id").distinct(), "product_id", "left_semi")
    counts = rows.groupBy("product_id").agg(F.countDistinct("store_id").alias("availability"))
    old = products.select("product_id", F.col("availability").alias("__old"))
    return counts.join(old, "product_id").filter(~F.col("availability").eqNullSafe(F.col("__old"))).drop("__old")
