"""Gates of loads, and the list of chains that drives a read."""

import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from basketlens.operators import gates
from basketlens.sources import feeds

now = lambda: F.lit("2026-06-15 12:00:00").cast("timestamp_ntz")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_bands_and_prices_outside(spark):
    past = spark.range(1, 1001).select(F.lit(1).cast("long").alias("product_id"), (F.col("id") / 100).cast("decimal(10,2)").alias("price"))
    past = past.unionByName(spark.createDataFrame([(2, Decimal("3.00")), (3, None)], "product_id long, price decimal(10,2)"))
    bands = gates.price_bands(past)
    assert rows(bands) == [(1, Decimal("0.10"), Decimal("9.90"), 1000), (2, Decimal("3.00"), Decimal("3.00"), 1)]
    load = spark.createDataFrame([("a", 1, Decimal("9.90")), ("a", 2, Decimal("3.00")), ("b", 1, Decimal("9.91")), ("b", 1, Decimal("0.09")), ("b", 4, Decimal("99.00")), ("b", 2, None)], "chain_id string, product_id long, price decimal(10,2)")
    assert rows(gates.outside_bands(load, bands)) == [("a", 2, 0, True), ("b", 4, 2, False)]
    many = spark.range(999).select(F.lit("c").alias("chain_id"), F.lit(2).cast("long").alias("product_id"), F.lit(3).cast("decimal(10,2)").alias("price")).unionByName(spark.createDataFrame([("c", 2, Decimal("4.00"))], load.schema))
    assert rows(gates.outside_bands(many, bands)) == [("c", 1000, 1, True)]  # a thousandth is allowed


def test_volume_against_the_week_before(spark):
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(n)
    daily = [("a", day(0), 100, 3), ("a", day(1), 130, 3), ("a", day(2), 150, 3), ("a", day(3), 80, 2), ("a", day(10), 5, 2), ("a", day(18), 999, 2), ("b", day(0), 1, 1)]
    got = {(r["chain_id"], r["day"]): (r["week_rows"], r["week_days"], r["problems"]) for r in gates.volume_gate(spark.createDataFrame(daily, "chain_id string, day date, rows long, stores long")).collect()}
    assert got["a", day(0)] == (0, 0, "") and got["a", day(1)] == (100, 1, "")  # 30 % are allowed
    assert got["a", day(2)] == (230, 2, "volume") and got["a", day(3)] == (380, 3, "volume,stores")
    assert got["a", day(10)] == (80, 1, "volume")  # of that week only its last day counts
    assert got["a", day(18)] == (0, 0, "") and got["b", day(0)] == (0, 0, "")
    log = spark.createDataFrame([("a", day(0), 1), ("a", day(0), 1), ("a", day(0), 2)], "chain_id string, day date, store_id long")
    assert rows(gates.daily_volume(log)) == [("a", day(0), 3, 2)]


def test_freshness_promotions_and_the_whole_gate(spark):
    at = lambda s: dt.datetime.fromisoformat(s)
    log = spark.createDataFrame([("a", at("2026-06-13 12:00:00")), ("b", at("2026-06-13 11:59:59")), ("c", None)], "chain_id string, seen timestamp_ntz")
    fresh = gates.freshness_gate(log, now())
    assert [(r[0], r[2]) for r in rows(fresh)] == [("a", True), ("b", False), ("c", False)]
    promos = spark.createDataFrame([("a", at("2026-01-01 00:00:00"), None)] * 19 + [("a", at("2026-01-01 00:00:00"), at("2026-02-01 00:00:00")), ("b", at("2026-07-01 00:00:00"), at("2026-07-01 00:00:00"))], "chain_id string, starts_at timestamp_ntz, ends_at timestamp_ntz")
    judged = gates.promotion_gate(promos, now())
    assert rows(judged) == [("a", 20, 0, 1, True), ("b", 1, 1, 0, False)]
    chains = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "chain_id string")
    gate = gates.load_gate(chains, freshness=fresh, promotions=judged)
    assert rows(gate) == [("a", "", True), ("b", "freshness,promotions", False), ("c", "freshness,promotions", False)]
    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "chain_id string, price int")
    new = spark.createDataFrame([("a", 2), ("b", 2), ("d", 2), (None, 2)], "chain_id string, price int")
    assert rows(gates.promote(old, new, gate)) == [("a", 2), ("b", 1), (None, 1)]
    assert gates.promote(old, new, gate.limit(0)).count() == 3 and gates.load_gate(chains.limit(0), freshness=fresh).isEmpty()


def made(folder):
    files = {"store_file_on.csv": "chainid,storeid\n1,1\n", "store_file_off.csv": "chainid,storeid\n2,1\n", "store_file_late.csv": "StoreId,ChainId,City\n9,3,x\n", "promo_file_on.csv": "chainid,promotionid\n1,5\n", "promo_file_late.csv": "chainid,promotionid\n3,6\n", "promo_full_file_late.csv": "chainid,promotionid\n3,7\n"}
    for name, text in files.items():
        (folder / name).write_text(text)
    chains = [{"slug": "on", "name": "On", "enabled": True}, {"slug": "off", "name": "Off", "enabled": False}, {"slug": "late"}, {"slug": "nowhere"}, {"name": "no slug"}]
    (folder / "chains.json").write_text(json.dumps({"display_names": {"1": "One"}, "chains": chains}, indent=1))


def test_configured_chains_are_read(spark, tmp_path):
    made(tmp_path)
    config = feeds.chain_config(spark, str(tmp_path / "chains.json"))
    assert rows(config) == [("late", "late", True, None), ("nowhere", "nowhere", True, None), ("off", "Off", False, None), ("on", "On", True, None)]
    assert rows(feeds.chain_problems(config)) == [("off", "no reason")]
    assert rows(feeds.chain_problems(config.union(config.filter("slug = 'on'")))) == [("off", "no reason"), ("on", "twice")]
    stores = feeds.read_chains(spark, str(tmp_path), config, "stores")
    assert rows(stores.select("slug", "chain_label", "chainid", "storeid")) == [("late", "late", "3", "9"), ("on", "On", "1", "1")]
    assert feeds.read_chains(spark, str(tmp_path), config, "prices") is None
    full = feeds.read_chains(spark, str(tmp_path), config, "promotions", full=True)  # one has a full file, one a snapshot only
    assert rows(full.select("slug", "promotionid")) == [("late", "7"), ("on", "5")]
    assert rows(feeds.read_chains(spark, str(tmp_path), config, "promotions").select("slug", "promotionid")) == [("late", "6"), ("on", "5")]


def test_missing_or_broken_configuration(spark, tmp_path):
    (tmp_path / "broken.json").write_text("{ not json")
    (tmp_path / "other.json").write_text('{"chains": null}')
    for name in ("none.json", "broken.json", "other.json"):
        assert rows(feeds.chain_config(spark, str(tmp_path / name), ["a", "b"])) == [("a", "a", True, None), ("b", "b", True, None)]
        assert feeds.chain_config(spark, str(tmp_path / name)).isEmpty()
