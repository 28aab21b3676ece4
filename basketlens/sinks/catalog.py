"""The cleaned tables of all chains, loaded feed by feed: stores, products with availability, prices, promotions and their items.

Every load takes a ``batch`` (a number that grows for each source): each table
remembers which batches it has taken in, so that a load that died between two tables and is
run again only does what is left, and a replay does nothing.

Surrogate ids are hashes of natural keys.  What a feed touches is shuffled; what it does not
stays where it is stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.cleaning import clean_str, column_or_null
from basketlens.operators import cities, feeds, promo_feed
from basketlens.operators import upsert as up
from basketlens.sinks.versioned import VersionedTable
from basketlens.sources.feeds import IDENTITY, forward_fill, read_chains

PRODUCT_FIELDS = ["name", "manufacturer", "unit_qty", "quantity", "unit_of_measure", "is_weighted"]
PRICE_FIELDS = ["price", "unit_price", "allow_discount", "item_status", "price_update_time"]


@dataclass(frozen=True)
class Spellings:
    """The tables that say how cities are written, for :func:`cities.resolve_city` and :func:`cities.canonical_city`."""

    codes: DataFrame
    aliases: DataFrame
    cities: DataFrame
    localities: DataFrame | None = None
    reviewed: DataFrame | None = None
    blocked: DataFrame | None = None
    neighbourhoods: DataFrame | None = None
    merges: tuple[tuple[str, str], ...] = ()
    by_address: tuple[tuple[str, str, str], ...] = ()

    def __call__(self, stores: DataFrame) -> DataFrame:
        """Stores (one row for each id) with the city that all chains call the same."""
        told = cities.resolve_city(stores, self.codes, self.aliases, self.cities, self.localities, self.reviewed, self.blocked, self.neighbourhoods)
        return cities.canonical_city(told, list(self.merges), list(self.by_address)) if self.merges else told


class Catalog:
    """Versioned tables under one folder.  ``buckets`` splits the products, and the prices of each chain."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8):
        self.spark = spark
        table = lambda name, keys, partition=(), n=1: VersionedTable(spark, f"{folder.rstrip('/')}/{name}", keys, partition, n)
        self.stores = table("stores", ["store_id"], ["chain_id"])
        self.products = table("products", ["product_id"], n=buckets)
        self.prices = table("prices", ["product_id", "store_id"], ["chain_id"], buckets)
        self.promotions = table("promotions", ["promotion_id"], ["chain_id"], buckets)
        self.promotion_items = table("promotion_items", ["promotion_id", "canonical_id", "is_gift"], ["chain_id"], buckets)

    def load_stores(self, raw: DataFrame, batch: tuple[str, int] | None = None, display_names: DataFrame | None = None, spell: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Stores of a raw feed with ``ord``: the last row of each replaces what was known.  ``spell`` (:class:`Spellings`) says their cities."""
        rows = feeds.normalize_stores(raw, display_names).drop("file")
        rows = rows.withColumn("store_id", feeds.store_id(F.col("chain_id"), F.col("sub_chain_id"), F.col("store_code")))
        if spell is not None:
            rows = spell(up.last_per_key(rows, ["store_id"], ["ord"])).select(*rows.columns)
        self.stores.upsert(rows, ["ord"], batch)

    def load_prices(self, raw: DataFrame, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Products, prices and availability of a raw price feed with ``ord``; what was counted on the way.

        A product's fields are the last ones that were not blank, over all feeds; its name is its
        barcode only while no feed names it.  Prices of branches that no store feed has are counted and left out.
        """
        rows = feeds.normalize_prices(raw).withColumn("product_id", F.xxhash64("barcode")).drop("file")
        rows = rows.join(feeds.store_lookup(self.stores.read()), ["chain_id", "store_code"], "left").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            seen = rows.withColumn("name", F.when(~F.col("name_is_code"), F.col("name")))
            # barcode goes with its id: the id is its hash
            sightings = up.merge_sightings(seen, "product_id", F.col("ord"), ["barcode", *PRODUCT_FIELDS]).withColumn("availability", F.lit(None).cast("long"))
            self.products.commit(sightings, self._merge_products, batch)
            found = rows.filter("store_id is not null").select("product_id", "store_id", "chain_id", *PRICE_FIELDS, "ord")
            self.prices.upsert(found, ["ord"], batch)
            touched = found.select("product_id").distinct().persist(StorageLevel.MEMORY_AND_DISK)
            changed = up.refresh_availability(self.prices.read(), self.products.read(), touched)
            self.products.commit(self.products.read().drop("availability").join(changed, "product_id"), lambda old, new: old.join(new.select("product_id"), "product_id", "left_anti").unionByName(new), batch and (f"{batch[0]} availability", batch[1]))
            touched.unpersist()
            counts = rows.agg(F.count("*").alias("rows"), F.countDistinct("product_id").alias("products"), F.count("store_id").alias("prices"), F.count_if(F.col("store_id").isNull()).alias("no_store")).first().asDict()
            read = raw.count()
            return {"rows_read": read, "rows_bad": read - counts.pop("rows"), **counts}
        finally:
            rows.unpersist()

    @staticmethod
    def _merge_products(old: DataFrame, new: DataFrame) -> DataFrame:
        merged = up.upsert_coalesce(old, new, ["product_id"], [], [c for c in new.columns if c != "product_id"])
        # a name that is a barcode gives way to any other
        known = old.select("product_id", F.nullif(F.col("name"), F.col("barcode")).alias("__name"))
        told = new.select("product_id", F.col("name").alias("__new"))
        named = merged.drop("name").join(known, "product_id", "left").join(told, "product_id", "left")
        return named.withColumn("name", F.coalesce("__new", "__name", "barcode")).drop("__new", "__name").withColumn("availability", F.coalesce("availability", F.lit(0)))

    def load_promotions(self, raw: DataFrame, canonical_of: DataFrame, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Promotions and item links of a raw promotion feed of any family with ``ord``; what was counted.

        ``canonical_of`` has ``barcode, canonical_id``.  Headers are replaced, links are added to those known.
        """
        headers = promo_feed.extract(raw).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            new, links, _ = feeds.load_promotions(headers, self.stores.read(), canonical_of)
            self.promotions.commit(new, lambda old, new: old.join(new.select("promotion_id"), "promotion_id", "left_anti").unionByName(new), batch)
            self.promotion_items.insert_ignore(links.join(new.select("promotion_id", "chain_id"), "promotion_id"), batch)
            return feeds.promotion_counters(headers, self.stores.read(), canonical_of).first().asDict()
        finally:
            headers.unpersist()

    def load_folder(self, folder: str, config: DataFrame, number: int | None = None, full: bool = False, display_names: DataFrame | None = None, spell: Callable[[DataFrame], DataFrame] | None = None, canonical_of: DataFrame | None = None) -> dict[str, dict[str, int]]:
        """All feeds of a folder of the chains that ``config`` enables: stores first, then prices, then promotions (if ``canonical_of`` is given).

        ``number`` is that of the folder's batch: each kind of feed is taken in once.  What was counted
        is returned by kind; a kind that no chain has a file of is left out.
        """
        counts: dict[str, dict[str, int]] = {}
        batch = lambda kind: None if number is None else (f"{kind} of folders", number)
        for kind in ("stores", "prices", "promotions"):
            raw = read_chains(self.spark, folder, config, kind, full)
            if raw is None or (kind == "promotions" and canonical_of is None):
                continue
            raw = in_order(raw)
            if kind == "stores":
                self.load_stores(raw.withColumn("chainname", F.coalesce(clean_str(column_or_null(raw, "chainname")), "chain_label")), batch(kind), display_names, spell)
                counts[kind] = {"stores": self.stores.read().count()}
            elif kind == "prices":
                counts[kind] = self.load_prices(raw, batch(kind))
            else:
                counts[kind] = self.load_promotions(raw, canonical_of, batch(kind))
        return counts


def in_order(raw: DataFrame) -> DataFrame:
    """Feeds of :func:`read_chains` with the identity of each block of rows filled in; ``ord`` is the same in every run, whichever file is read first."""
    block = F.struct("ord.block", F.shiftright("ord.row", 16))
    filled = forward_fill(raw, [c for c in IDENTITY if c in raw.columns and c != "file_name"], "file", "ord", block)
    return filled.withColumn("ord", F.struct("slug", "ord.block", "ord.row"))
