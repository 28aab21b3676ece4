"""Entity resolution: products of equal normal name and size are one canonical item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_id(name_norm: Column, signature: Column) -> Column:
    """A key that needs no coordination: the hash of the blocking key."""
    return F.xxhash64(name_norm, signature)


def confidence(name_norm: Column, signature: Column) -> Column:
    """1.000 for at least three words and a size, 0.850 for either, else 0.600."""
    wordy = F.size(F.filter(F.split(name_norm, " "), lambda w: F.char_length(w) > 1)) >= 3
    sized = signature != ""
    return F.when(wordy & sized, 1.0).when(wordy | sized, 0.85).otherwise(0.6).cast("decimal(4,3)")


def build_canonical(products: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``canonical_id, name_norm, size_signature, canonical_name, brand, net_qty, unit, is_weighted, member_count``.

    The display name is the longest; brand, quantity and unit are those of its row, else
    of any row, and null where ``products`` has no such column.  Of ``existing`` items the
    longer name wins, and other values are filled where they are null, never overwritten.
    """
    have = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    named = products.filter(F.col("name_norm") != "").withColumns({"__net_qty": have(products, "quantity", "decimal(12,3)"), "__unit": have(products, "unit_qty", "string"), "__weighted": F.coalesce(have(products, "is_weighted", "boolean"), F.lit(False))})
    key = F.struct(F.char_length("name"), -F.col("product_id"))
    filled = lambda c: F.coalesce(F.max_by(c, key), F.min(c))
    found = named.groupBy("name_norm", "size_signature").agg(
        F.max_by("name", key).alias("canonical_name"),
        filled("manufacturer").alias("brand"),
        filled("__net_qty").alias("net_qty"),
        filled("__unit").alias("unit"),
        F.max_by("__weighted", key).alias("is_weighted"),
        F.count("*").alias("member_count"),
    )
    found = found.select(canonical_id(F.col("name_norm"), F.col("size_signature")).alias("canonical_id"), "*")
    if existing is None:
        return found
    old = existing.select("canonical_id", *(have(existing, c, kind).alias(f"__{c}") for c, kind in found.dtypes[1:]))
    joined = found.join(old, "canonical_id", "full_outer")
    kept = {c: F.coalesce(f"__{c}", c) for c in found.columns[1:]}
    kept["canonical_name"] = F.when(F.char_length("canonical_name") > F.char_length("__canonical_name"), F.col("canonical_name")).otherwise(kept["canonical_name"])
    kept["member_count"] = F.coalesce("member_count", "__member_count")
    return joined.select("canonical_id", *(v.alias(c) for c, v in kept.items()))


def map_products(products: DataFrame) -> DataFrame:
    """``product_id, canonical_id, match_method, confidence, needs_review`` of every named product."""
    n, s = F.col("name_norm"), F.col("size_signature")
    return products.filter(n != "").select("product_id", canonical_id(n, s).alias("canonical_id"), F.when(s != "", "exact_name").otherwise("name_only").alias("match_method"), confidence(n, s).alias("confidence"), (confidence(n, s) < 0.7).alias("needs_review"))


def products_for_chains(products: DataFrame, prices: DataFrame, stores: DataFrame, chains: list[str]) -> DataFrame:
    """Products that one of the chains prices."""
    own = prices.join(stores.filter(F.col("chain_id").isin(*chains)), "store_id").select("product_id")
    return products.join(own, "product_id", "left_semi")


def resolve(products: DataFrame, existing: DataFrame | None = None, mapped: DataFrame | None = None, chains: list[str] | None = None, prices: DataFrame | None = None, stores: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run of entity resolution: canonical items, the map of products, and a row of counters.

    ``chains`` limits the run to what these chains price (``prices`` and ``stores`` say
    what that is).  Identity is shared all the same: ids are hashes of the blocking key,
    so that runs of different chains meet in one item.  Items and maps of earlier runs
    (``existing, mapped``) are carried on, named products of this run are mapped anew,
    and members are counted over the whole map, so that a run can be repeated.  Products
    without a name are counted as skipped; what they were mapped to stays.
    """
    scoped = products if chains is None else products_for_chains(products, prices, stores, chains)
    links = map_products(scoped)
    n, s = F.col("name_norm"), F.col("size_signature")
    unnamed = F.coalesce(n, F.lit("")) == ""
    counters = scoped.agg(
        F.count_if(~unnamed).alias("products"), F.countDistinct(F.when(~unnamed, canonical_id(n, s))).alias("canonical"), F.count_if(~unnamed & (confidence(n, s) < 0.7)).alias("review"), F.count_if(unnamed).alias("skipped")
    )
    if mapped is not None:
        links = links.unionByName(mapped.join(links.select("product_id"), "product_id", "left_anti"))
    items = build_canonical(scoped, existing).drop("member_count")
    return items.join(member_counts(items, links), "canonical_id"), links, counters


def resolve_codes(codes: DataFrame, products: DataFrame, mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codes of feed rows (``barcode``) with the canonical item of their product, and the codes that have none, once each.

    Rows keep their other columns; a null code is no miss and has no item.
    """
    known = products.select("barcode", "product_id").join(mapped.select("product_id", "canonical_id"), "product_id").select("barcode", "canonical_id")
    found = codes.join(known, "barcode", "left")
    return found, found.filter(F.col("canonical_id").isNull() & F.col("barcode").isNotNull()).select("barcode").distinct()


def member_counts(canonical: DataFrame, mapped: DataFrame) -> DataFrame:
    counts = mapped.groupBy("canonical_id").agg(F.count("*").alias("n"))
    return canonical.select("canonical_id").join(counts, "canonical_id", "left").select("canonical_id", F.coalesce("n", F.lit(0)).alias("member_count"))


def review_queue(mapped: DataFrame) -> DataFrame:
    """Mapped products that need a look, least certain first."""
    return mapped.filter("needs_review").orderBy("confidence", "product_id")


def orphans(canonical: DataFrame, mapped: DataFrame) -> DataFrame:
    """Canonical items without a product."""
    return canonical.join(mapped, "canonical_id", "left_anti")


def dead_links(links: DataFrame, canonical: DataFrame) -> DataFrame:
    """Promotion links to canonical items that do not exist."""
    return links.join(canonical, "canonical_id", "left_anti")


def prune_report(canonical: DataFrame, mapped: DataFrame, links: DataFrame) -> DataFrame:
    """One row: orphans, canonical items, dead links once the orphans are gone, links."""
    gone = orphans(canonical, mapped)
    left = canonical.join(gone.select("canonical_id"), "canonical_id", "left_anti")
    counts = [gone.agg(F.count("*").alias("orphans")), canonical.agg(F.count("*").alias("canonicals")), dead_links(links, left).agg(F.count("*").alias("dead_links")), links.agg(F.count("*").alias("links"))]
    one = counts[0]
    for c in counts[1:]:
        one = one.crossJoin(c)  # one row each
    return one
