"""Repairs: plans, what they report, what applying them changes in frames and stored tables."""

import pytest
from pyspark.sql import functions as F

from basketlens.operators import repair
from basketlens.sinks.versioned import VersionedTable

MERGES = [("Tel-Aviv", "Tel Aviv"), ("Oldtown", "Newtown"), ("Twin", "Twin North")]
BY_ADDRESS = [("Twin", "south", "Twin South")]
STORES = [(1, "1", "Corp", "Tel-Aviv", "a street 0"), (2, "1", "Corp", "Tel Aviv", "-"), (3, "2", "Two", "Oldtown", None), (4, "2", "Two", "Twin", "1 south road"), (5, None, None, "Twin", "1 north road"), (6, "2", "Two", None, "x street"), (7, "1", "Brand", "", "y street"), (8, "1", None, "Tel-Aviv", "")]


def stores(spark):
    return spark.createDataFrame(STORES, "store_id long, chain_id string, chain_name string, city string, address string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def stored(spark, path, df, keys, partition=(), buckets=1):
    table = VersionedTable(spark, str(path), keys, partition, buckets)
    table.upsert(df.withColumn("ord", F.lit(0)), ["ord"])
    return table


def test_city_plan_reads_each_address(spark):
    found = repair.city_plan(stores(spark), MERGES, BY_ADDRESS)
    assert rows(found) == [(1, "Tel-Aviv", "Tel Aviv"), (3, "Oldtown", "Newtown"), (4, "Twin", "Twin South"), (5, "Twin", "Twin North"), (8, "Tel-Aviv", "Tel Aviv")]
    told = rows(repair.summary(found, stores(spark), "city"))
    assert ("Tel-Aviv", "Tel Aviv", 2, 1, "heal") in told and ("Oldtown", "Newtown", 1, 0, "rename") in told and len(told) == 4
    assert rows(repair.values_after(stores(spark), found, ["store_id"], "city")) == [(5, 5, 5)]


def test_addresses_and_names(spark):
    found = repair.address_plan(stores(spark))
    assert rows(found) == [(1, "a street 0", "a street"), (2, "-", None), (8, "", None)]
    assert {r["effect"] for r in repair.summary(found, stores(spark), "address").collect()} == {"clear", "rename"}
    names = spark.createDataFrame([("1", "Brand"), ("9", "None such")], "chain_id string, display_name string")
    assert rows(repair.display_name_plan(stores(spark), names)) == [(1, "Corp", "Brand"), (2, "Corp", "Brand"), (8, None, "Brand")]


def test_applied_plan_leaves_nothing_to_do(spark, tmp_path):
    table = stored(spark, tmp_path / "stores", stores(spark), ["store_id"], ["chain_id"])
    before = table.manifest()["partitions"]
    assert repair.repair(table, repair.city_plan(table.read(), MERGES[:1]), "city") == 2
    now = table.manifest()["partitions"]
    assert sum(now[k] != before[k] for k in before) == 1  # only the chain of these branches
    repair.repair(table, repair.address_plan(table.read()), "address")
    assert repair.city_plan(table.read(), MERGES[:1]).isEmpty() and repair.address_plan(table.read()).isEmpty()
    version = table.manifest()["version"]
    assert repair.repair(table, repair.address_plan(table.read()), "address") == 0 and table.manifest()["version"] == version
    got = {r["store_id"]: (r["city"], r["address"], r["chain_name"]) for r in table.read().collect()}
    assert len(got) == 8 and got[1] == ("Tel Aviv", "a street", "Corp") and got[2] == ("Tel Aviv", None, "Corp") and got[5] == ("Twin", "1 north road", None)
    with pytest.raises(ValueError, match="chain_id"):
        repair.repair(table, repair.address_plan(stores(spark)), "chain_id")


def test_rows_that_changed_since_the_plan_stay(spark):
    planned = spark.createDataFrame([(1, "something else", "new"), (6, None, "known")], "store_id long, old string, new string")
    got = {r["store_id"]: r["city"] for r in repair.apply_plan(stores(spark), planned, ["store_id"], "city").collect()}
    assert got[1] == "Tel-Aviv" and got[6] == "known" and len(got) == 8


def tables(spark, path):
    products = spark.createDataFrame([(1, "123"), (2, "7290000000001"), (3, "1_22"), (4, None)], "product_id long, barcode string")
    prices = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "b", 1.0), (2, 1, "a", 1.0), (3, 3, "c", 1.0)], "product_id long, store_id long, chain_id string, price double")
    mapped = spark.createDataFrame([(1, 10), (2, 10), (3, 30), (4, None)], "product_id long, canonical_id long")
    canonical = spark.createDataFrame([(10, "x"), (20, "y"), (30, "z")], "canonical_id long, name string")
    links = spark.createDataFrame([(5, 10, "a"), (5, 20, "a"), (6, 20, "b"), (6, 30, "b")], "promotion_id long, canonical_id long, chain_id string")
    return (
        stored(spark, path / "products", products, ["product_id"], buckets=2),
        stored(spark, path / "prices", prices, ["product_id", "store_id"], ["chain_id"], 2),
        stored(spark, path / "mapped", mapped, ["product_id"]),
        stored(spark, path / "canonical", canonical, ["canonical_id"]),
        stored(spark, path / "links", links, ["promotion_id", "canonical_id"], ["chain_id"]),
    )


def test_purge_and_prune(spark, tmp_path):
    products, prices, mapped, canonical, links = tables(spark, tmp_path)
    assert rows(repair.purge_report(products.read(), prices.read(), mapped.read())) == [(2, 3, 2)]
    removed = repair.purge_legacy(products, prices, mapped)
    assert sorted(removed.values()) == [2, 2, 3]
    assert rows(products.read().select("product_id")) == [(2,), (4,)] and rows(prices.read().select("product_id", "store_id")) == [(2, 1)]
    assert rows(repair.purge_report(products.read(), prices.read(), mapped.read())) == [(0, 0, 0)]
    removed = repair.prune_orphans(canonical, mapped.read(), links)  # 20 had none, 30 lost its own
    assert sorted(removed.values()) == [2, 3]
    assert rows(canonical.read()) == [(10, "x")] and rows(links.read().select("promotion_id", "canonical_id")) == [(5, 10)]
    assert set(repair.prune_orphans(canonical, mapped.read(), links).values()) == {0}


def test_a_purge_that_died_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    products, prices, mapped, *_ = tables(spark, tmp_path)
    with monkeypatch.context() as m:
        m.setattr(mapped, "delete", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            repair.purge_legacy(products, prices, mapped)
    assert products.read().count() == 4
    repair.purge_legacy(products, prices, mapped)
    assert rows(products.read().select("product_id")) == [(2,), (4,)] and rows(mapped.read().select("product_id")) == [(2,), (4,)]
