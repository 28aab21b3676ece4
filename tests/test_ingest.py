"""Loads of the catalogue, in one go, feed by feed and as streams; history of prices by state."""

import os
import random

import pytest
from pyspark.sql import functions as F

from basketlens.operators import quality
from basketlens.sinks.catalog import Catalog
from basketlens.streaming import history, ingest

STORES = ["chainid", "chainname", "subchainid", "storeid", "storename", "address", "city"]
PRICES = ["chainid", "storeid", "itemcode", "itemname", "manufacturername", "itemprice", "priceupdatetime"]


def feeds_of(seed):
    """Three price feeds of two chains: grouped identity, missing names and makers, unknown branches, rows without a price."""
    rng = random.Random(seed)
    out = []
    for feed in range(3):
        lines = [",".join(PRICES)]
        for chain in ("11", "22"):
            for store in ("001", "002", "099"):
                for k in range(12):
                    ident = f"{chain},{store}" if k == 0 else ","
                    code = rng.choice([f"729000000{rng.randrange(10):04d}", str(rng.randrange(20, 25))])
                    name = rng.choice([f"item {code}", "", f"Item {code} v{feed}"])
                    lines.append(f"{ident},{code},{name},{rng.choice(['', 'maker'])},{rng.choice(['', *map(str, range(1, 9))])}.50,2026-01-0{feed + 1} 10:00:00".replace(",.50", ","))
        out.append("\n".join(lines) + "\n")
    return out


def write(folder, name, text, when):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (when, when))


def content(catalog):
    take = lambda t, *c: sorted(tuple(str(x) for x in r) for r in t.read().select(*c).collect())
    return (
        take(catalog.stores, "store_id", "store_name", "city"),
        take(catalog.products, "product_id", "barcode", "name", "manufacturer", "availability"),
        take(catalog.prices, "product_id", "store_id", "chain_id", "price", "price_update_time"),
    )


STORE_FEED = ",".join(STORES) + "\n" + "\n".join(f"{c},chain {c},1,{s},branch {s},street {s},town" for c in ("11", "22") for s in ("001", "002")) + "\n"


def plain(texts):
    """The tables by a plain loop over the rows of all feeds."""
    products, prices = {}, {}
    for text in texts:
        chain = store = None
        for line in text.splitlines()[1:]:
            c, s, code, name, maker, price, when = line.split(",")
            chain, store = c or chain, s or store
            if not price:
                continue
            barcode = code if len(code) >= 8 else f"{chain}_{code}"
            p = products.setdefault(barcode, {"name": None, "maker": None})
            p["name"], p["maker"] = name.strip() or p["name"], maker or p["maker"]
            if store != "099":
                prices[barcode, chain, str(int(store))] = (price, when)
    return {b: (p["name"] or b, str(p["maker"]), str(len({k[1:] for k in prices if k[0] == b}))) for b, p in products.items()}, prices


def test_streamed_feeds_equal_plain_and_batch_loads(spark, tmp_path):
    texts = feeds_of(3)
    streamed, batch = Catalog(spark, str(tmp_path / "streamed"), 2), Catalog(spark, str(tmp_path / "batch"), 2)
    write(tmp_path / "stores", "s.csv", STORE_FEED, 1000)
    for k, text in enumerate(texts):
        write(tmp_path / "prices", f"p{2 - k}.csv", text, 2000 + k)  # their times order files, not their names
    for _ in range(2):  # the second time there is nothing new
        ingest.ingest_stores(spark, str(tmp_path / "stores"), STORES, streamed, str(tmp_path / "cs")).awaitTermination()
        ingest.ingest_prices(spark, str(tmp_path / "prices"), PRICES, streamed, str(tmp_path / "cp"), files_at_once=1).awaitTermination()
    assert len(streamed.prices.versions()) == 3
    from basketlens.sources.feeds import forward_fill

    read = lambda path, names: spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).csv(path).select("*", F.col("_metadata.file_modification_time").alias("made"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    shape = lambda df: forward_fill(df, ["chainid", "storeid"], "file", "row").withColumn("ord", F.struct("made", "row")).drop("made", "row")
    batch.load_stores(shape(read(str(tmp_path / "stores"), STORES)))
    counts = batch.load_prices(shape(read(str(tmp_path / "prices"), PRICES)))
    assert content(streamed) == content(batch)
    products, prices = plain(texts)
    assert {r[1]: r[2:] for r in content(streamed)[1]} == products
    assert len(content(streamed)[2]) == len(prices)
    rows = [x for t in texts for x in t.splitlines()[1:]]
    assert counts["rows_read"] == len(rows) and counts["rows_bad"] == sum(not x.split(",")[5] for x in rows) and counts["rows_read"] == counts["rows_bad"] + counts["prices"] + counts["no_store"]


def test_a_load_that_died_between_tables_is_finished(spark, tmp_path, monkeypatch):
    texts = feeds_of(4)
    catalog, whole = Catalog(spark, str(tmp_path / "a"), 1), Catalog(spark, str(tmp_path / "b"), 1)
    write(tmp_path / "stores", "s.csv", STORE_FEED, 1000)
    write(tmp_path / "prices", "p.csv", texts[0], 2000)
    for c, at in ((catalog, "1"), (whole, "2")):
        ingest.ingest_stores(spark, str(tmp_path / "stores"), STORES, c, str(tmp_path / f"s{at}")).awaitTermination()
    with monkeypatch.context() as m:
        m.setattr(catalog.prices, "upsert", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            ingest.ingest_prices(spark, str(tmp_path / "prices"), PRICES, catalog, str(tmp_path / "p1")).awaitTermination()
    assert catalog.products.exists() and not catalog.prices.exists()
    ingest.ingest_prices(spark, str(tmp_path / "prices"), PRICES, catalog, str(tmp_path / "p1")).awaitTermination()
    ingest.ingest_prices(spark, str(tmp_path / "prices"), PRICES, whole, str(tmp_path / "p2")).awaitTermination()
    assert content(catalog) == content(whole) and len(catalog.products.versions()) == len(whole.products.versions())


def test_promotions_of_several_rows_keep_all_links(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"), 1)
    catalog.load_stores(spark.createDataFrame([("1", "one", "0", "7", "s", "a", "t", 0)], "chainid string, chainname string, subchainid string, storeid string, storename string, address string, city string, ord int"))
    raw = lambda rows: spark.createDataFrame(rows, "chainid string, storeid string, promotionid string, itemcode string, discountedprice string, isgiftitem string, ord int")
    known = spark.createDataFrame([("1_11", 11), ("1_12", 12), ("1_13", 13)], "barcode string, canonical_id long")
    counts = catalog.load_promotions(raw([("1", "007", "p", "11", "5", "0", 0), ("1", "007", "p", "12", "5", "0", 1), ("1", "007", "p", "13", "4.5", "0", 2), ("1", "007", "p", "13", "4.5", "0", 2), ("1", "007", "p", "14", "4.5", "0", 2), ("1", "009", "p", "11", "5", "0", 3)]), known, ("promos", 1))
    assert counts == {"rows": 6, "no_store": 1, "promotions": 1, "items": 4, "items_unresolved": 1}
    assert sorted(r["canonical_id"] for r in catalog.promotion_items.read().collect()) == [11, 12, 13]
    assert [float(r["discounted_price"]) for r in catalog.promotions.read().collect()] == [4.5]
    catalog.load_promotions(raw([("1", "007", "p", "11", "3", "0", 0), ("1", "007", "q", "12", "2", "1", 1)]), known, ("promos", 2))
    assert sorted((float(r["discounted_price"]), r["promo_id_src"]) for r in catalog.promotions.read().collect()) == [(2.0, "q"), (3.0, "p")]
    assert catalog.promotion_items.read().count() == 4


@pytest.fixture
def stateful(spark):
    before = spark.conf.get(history.STATE_STORE[0], None)
    spark.conf.set(*history.STATE_STORE)
    yield spark
    spark.conf.unset(history.STATE_STORE[0]) if before is None else spark.conf.set(history.STATE_STORE[0], before)


def test_history_by_state_equals_the_whole_log(stateful, tmp_path):
    spark = stateful
    rng = random.Random(9)
    log = [(rng.randrange(4), rng.randrange(2), f"{rng.choice([1, 1, 2, 3])}.50", f"2026-01-{1 + n // 20:02d} 0{rng.randrange(10)}:00:00", n) for n in range(120)]
    log.sort(key=lambda r: (r[3], r[4]))
    schema = "product_id long, store_id long, price decimal(10,2), seen timestamp_ntz, seq long"
    folder = tmp_path / "in"
    folder.mkdir()
    changes = lambda: history.write_history(history.price_history(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).csv(str(folder))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    parts = [log[:40], log[40:80], log[80:]]
    for k, part in enumerate(parts):
        (folder / f"{k}.csv").write_text("\n".join(",".join(map(str, r)) for r in part) + "\n")
        changes()  # each time a new query from the checkpoint: a restart
    got = lambda: sorted(tuple(map(str, r)) for r in spark.read.schema(history.CHANGES).parquet(str(tmp_path / "out")).collect())
    whole = spark.createDataFrame(log, "product_id long, store_id long, price string, seen string, seq long").select("product_id", "store_id", F.col("price").cast("decimal(10,2)").alias("price"), F.col("seen").cast("timestamp_ntz").alias("seen"), "seq")
    want = sorted(tuple(map(str, r)) for r in quality.price_changes(whole, ["seen", "seq"]).select("product_id", "store_id", "price", "seen", "seq", "before").collect())
    assert got() == want and len(want) > 30
    (folder / "late.csv").write_text("0,0,99.00,2025-01-01 00:00:00,500\n0,0,,2027-01-01 00:00:00,501\n")
    changes()
    assert got() == want
