"""Repairs of stored rows: a plan says what cleaning would change now, a report sums it up, applying it changes these rows and no others.

A plan has the key of each row with ``old`` and ``new``.  Where a row no longer has its
``old`` value when the plan is applied, it stays as it is.  Applied to a stored table a plan
rewrites the partitions of its rows in one commit, so that a run that dies changes nothing
and a second run finds nothing to do.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.cleaning import clean_address
from basketlens.operators.cities import canonical_city

if TYPE_CHECKING:
    from basketlens.sinks.versioned import VersionedTable

#: Keys of products that are shorter are a chain's own codes without its name space.
GTIN_LENGTH = 8


class RepairFailed(RuntimeError):
    """Rows that a repair should have removed are still there."""


def plan(df: DataFrame, keys: Sequence[str], column: str, fresh: Column) -> DataFrame:
    """``keys, old, new`` of the rows whose ``column`` would become another value."""
    return df.select(*keys, F.col(column).alias("old"), fresh.alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))


def city_plan(stores: DataFrame, merges: list[tuple[str, str]], by_address: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Branches under a spelling that is merged; each by its own address where a rule reads it.  Branches without a city are left alone."""
    rows = stores.filter("city <> ''").withColumn("__old", F.col("city"))
    merged = canonical_city(rows, merges, list(by_address))
    return merged.select("store_id", F.col("__old").alias("old"), F.col("city").alias("new")).filter("old <> new")


def address_plan(stores: DataFrame) -> DataFrame:
    """Addresses that are no place (``new`` is null) or that cleaning writes in another way."""
    return plan(stores.filter("address is not null"), ["store_id"], "address", clean_address(F.col("address")))


def display_name_plan(stores: DataFrame, display_names: DataFrame) -> DataFrame:
    """Branches of chains that have a name for display (``chain_id, display_name``) and carry another one."""
    names = display_names.select("chain_id", "display_name").dropDuplicates(["chain_id"])
    return plan(stores.join(names, "chain_id"), ["store_id"], "chain_name", F.col("display_name"))


def summary(planned: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """``old, new, rows, already, effect``: what a plan does, by pair of values.

    ``already`` rows have the new value now.  The effect is ``clear`` (no value is left), ``heal``
    (rows of one thing that stood under two values meet) or ``rename``.
    """
    there = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("new")).agg(F.count("*").alias("already"))
    pairs = planned.groupBy("old", "new").agg(F.count("*").alias("rows")).join(there, "new", "left")
    already = F.coalesce("already", F.lit(0))
    effect = F.when(F.col("new").isNull(), "clear").when(already > 0, "heal").otherwise("rename")
    return pairs.select("old", "new", "rows", already.alias("already"), effect.alias("effect"))


def apply_plan(df: DataFrame, planned: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``df`` with the new values of the plan; all other rows and columns as they are."""
    change = planned.select(*keys, F.struct(F.col("old").alias("old"), F.col("new").alias("new")).alias("__change"))
    due = F.col("__change").isNotNull() & F.col(column).eqNullSafe(F.col("__change.old"))
    return df.join(change, list(keys), "left").withColumn(column, F.when(due, F.col("__change.new")).otherwise(F.col(column))).select(*df.columns)


def values_after(df: DataFrame, planned: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row: ``rows`` to change, distinct values ``before`` and ``after``."""
    change = planned.select(*keys, F.lit(1).alias("__due"), F.col("new").alias("__new"))
    rows = df.join(change, list(keys), "left")
    then = F.when(F.col("__due").isNotNull(), F.col("__new")).otherwise(F.col(column))
    return rows.agg(F.count("__due").alias("rows"), F.countDistinct(column).alias("before"), F.countDistinct(then).alias("after"))


def repair(table: VersionedTable, planned: DataFrame, column: str, batch: tuple[str, int] | None = None) -> int:
    """Apply a plan (with the table's key) to a stored table in one commit; how many rows the plan names."""
    fixed = {*table.keys, *table.partition}
    if column in fixed:
        raise ValueError(f"{column} says where rows of {table.path} are stored")
    rows = table.read().join(planned.select(*table.keys), table.keys, "left_semi")
    n = rows.count()
    if n:
        table.commit(rows, lambda old, new: apply_plan(old, planned, table.keys, column), batch)
    return n


def cascade(root: VersionedTable, gone: DataFrame, children: Sequence[tuple[VersionedTable, str]]) -> dict[str, int]:
    """Remove rows of ``root`` (``gone``: its one key column) and what refers to them; rows removed by the tables' folders.

    What refers to them goes first: a run that dies in between finds the same rows again.
    """
    key = root.keys[0]
    removed = {}
    for table, column in children:
        own = table.read().join(gone.select(F.col(key).alias(column)), column, "left_semi")
        removed[table.path] = own.count()
        if removed[table.path]:
            table.delete(own)
    own = root.read().join(gone.select(key), key, "left_semi")
    removed[root.path] = own.count()
    if removed[root.path]:
        root.delete(own)
    return removed


def legacy_products(products: DataFrame) -> DataFrame:
    """Products whose barcode is too short to be global and is in no chain's name space."""
    return products.filter(F.char_length("barcode") < GTIN_LENGTH)


def purge_report(products: DataFrame, prices: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row: products with such keys, and how many prices and mapped rows go with them."""
    old = legacy_products(products).select("product_id").distinct()
    parts = [df.join(old, "product_id", "left_semi").select(F.lit(name).alias("what")) for name, df in (("products", products), ("prices", prices), ("mapped", mapped))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(*(F.count_if(F.col("what") == name).alias(name) for name in ("products", "prices", "mapped")))


def purge_legacy(products: VersionedTable, prices: VersionedTable, mapped: VersionedTable) -> dict[str, int]:
    """Remove products with such keys, their prices and mappings."""
    removed = cascade(products, legacy_products(products.read()).select("product_id"), [(prices, "product_id"), (mapped, "product_id")])
    if not legacy_products(products.read()).isEmpty():
        raise RepairFailed("products with short keys are left")
    return removed


def orphaned(canonical: DataFrame, mapped: DataFrame) -> DataFrame:
    """Canonical items that no product is mapped to."""
    return canonical.join(mapped.filter("canonical_id is not null"), "canonical_id", "left_anti")


def prune_orphans(canonical: VersionedTable, mapped: DataFrame, links: VersionedTable) -> dict[str, int]:
    """Remove canonical items without a product and the promotion links to them."""
    removed = cascade(canonical, orphaned(canonical.read(), mapped).select("canonical_id"), [(links, "canonical_id")])
    if not orphaned(canonical.read(), mapped).isEmpty():
        raise RepairFailed("canonical items without a product are left")
    return removed
