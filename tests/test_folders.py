"""Whole folders of feeds into the catalogue: chains by configuration, cities by their tables, replays."""

import json

import pytest

from basketlens.sinks.catalog import Catalog, Spellings
from basketlens.sources import feeds

FILES = {
    "store_file_a.csv": "ChainId,ChainName,SubChainId,StoreId,StoreName,Address,City\n11,Corp,1,001,first,road 1,7\n,,,002,second,road 2,Tel-Aviv\n,,,003,Haifa port,south 3,\n",
    "store_file_b.csv": "StoreId,ChainId,StoreName,City,Address\n5,22,fifth,Twin,south 5\n6,22,sixth,Twin,north 6\n5,22,fifth again,Twin,south 5\n",
    "store_file_off.csv": "ChainId,StoreId,City\n33,1,x\n",
    "price_file_a.csv": "ChainId,StoreId,ItemCode,ItemName,ItemPrice\n11,1,7290000000001,milk,5.00\n,,7290000000002,bread,6.00\n,2,7290000000001,,4.00\n11,99,7290000000001,milk,1.00\n11,1,7290000000003,eggs,\n",
    "price_file_off.csv": "ChainId,StoreId,ItemCode,ItemName,ItemPrice\n33,1,7290000000001,milk,5.00\n",
    "promo_file_b.csv": "ChainId,StoreId,PromotionId,ItemCode,DiscountedPrice,IsGiftItem\n22,5,p,7290000000001,3,0\n22,5,p,7290000000002,3,0\n22,5,q,12,3,0\n",
}
CHAINS = [{"slug": "a", "name": "Chain A"}, {"slug": "b", "name": "Chain B"}, {"slug": "off", "enabled": False, "reason": "no prices"}, {"slug": "gone"}]


@pytest.fixture
def loaded(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in FILES.items():
        (folder / name).write_text(text)
    (folder / "chains.json").write_text(json.dumps({"chains": CHAINS}))
    frame = spark.createDataFrame
    spell = Spellings(
        frame([("7", "Jaffa")], "code string, city string"),
        frame([("Tel-Aviv", "Tel Aviv")], "alias string, city string"),
        frame([("Haifa",), ("Tel Aviv",)], "city string"),
        merges=(("Twin", "Twin North"), ("Jaffa", "Tel Aviv")),
        by_address=(("Twin", "south", "Twin South"),),
    )
    known = frame([("7290000000001", 1), ("7290000000002", 2)], "barcode string, canonical_id long")
    names = frame([("11", "Shown")], "chain_id string, display_name string")
    catalog = Catalog(spark, str(tmp_path / "out"), 1)
    load = lambda number=None: catalog.load_folder(str(folder), feeds.chain_config(spark, str(folder / "chains.json")), number, True, names, spell, known)
    return catalog, load, folder


def content(catalog):
    take = lambda t, *c: sorted(tuple(str(x) for x in r) for r in t.read().select(*c).collect())
    return take(catalog.stores, "chain_id", "store_code", "chain_name", "store_name", "city"), take(catalog.prices, "chain_id", "product_id", "price"), take(catalog.promotion_items, "chain_id", "canonical_id")


def test_a_folder_of_chains(loaded):
    catalog, load, folder = loaded
    with pytest.raises(FileNotFoundError):
        catalog.prices.read()
    (folder / "price_full_file_a.csv").write_text(FILES["price_file_a.csv"])
    counts = load(2)  # full feeds are asked for: prices have one, promotions fall back to the others
    assert set(counts) == {"stores", "prices", "promotions"}
    stores, prices, links = content(catalog)
    assert stores == [("11", "1", "Shown", "first", "Tel Aviv"), ("11", "2", "Shown", "second", "Tel Aviv"), ("11", "3", "Shown", "Haifa port", "Haifa"), ("22", "5", "Chain B", "fifth again", "Twin South"), ("22", "6", "Chain B", "sixth", "Twin North")]
    assert sorted(p[2] for p in prices) == ["4.00", "5.00", "6.00"]
    assert links == [("22", "1"), ("22", "2")]
    assert counts["stores"] == {"stores": 5}
    assert counts["prices"] == {"rows_read": 5, "rows_bad": 1, "products": 2, "prices": 3, "no_store": 1}
    assert counts["promotions"]["items_unresolved"] == 1
    versions = [t.manifest()["version"] for t in (catalog.stores, catalog.products, catalog.prices, catalog.promotions)]
    load(2)  # the same folder again
    assert [t.manifest()["version"] for t in (catalog.stores, catalog.products, catalog.prices, catalog.promotions)] == versions
    assert content(catalog) == (stores, prices, links)
