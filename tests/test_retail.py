"""Cleaning, feeds, promotions and comparison on small fixtures, and properties of the operators."""

import itertools
import os
import pathlib
import random
import shutil
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basketlens.functions import cleaning as cl
from basketlens.functions import promo_rules as rules
from basketlens.functions import tokens
from basketlens.operators import canonical, cities, compare, feeds, pricing, promo_feed, quality, search, upsert
from basketlens.sources import feeds as sources
from basketlens.streaming import jobs


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (cl.clean_str, "  'abc' ", "abc"), (cl.clean_str, "Unknown", None), (cl.clean_str, "{}", None), (cl.clean_str, "לא ידוע", None), (cl.clean_str, "0", "0"),
        (cl.clean_address, "Main 5614 0", "Main 5614"), (cl.clean_address, "הרצל 20", "הרצל 20"), (cl.clean_address, "0", None), (cl.clean_address, "12", None), (cl.clean_address, "h", None),
        (cl.norm_code, "001", "1"), (cl.norm_code, "000", "0"), (cl.norm_code, "A01", "A01"),
        (lambda c: cl.to_decimal(c).cast("string"), "1,234.5", "1234.50"), (cl.to_decimal, "x", None),
        (cl.to_bool, "Yes", True), (cl.to_bool, "0", False), (cl.to_bool, "", None),
        (lambda c: cl.parse_dt(c).cast("string"), "2024-01-02T03:04:05.25", "2024-01-02 03:04:05.25"), (lambda c: cl.parse_dt(c).cast("string"), "2024-01-02", "2024-01-02 00:00:00"), (cl.parse_dt, "02/01/2024", None),
        (lambda c: cl.product_key(c, F.lit("729")), "12", "729_12"), (lambda c: cl.product_key(c, F.lit("729")), "7290000000012", "7290000000012"),
        (tokens.prominent_tokens, "קוקה קולה שישיה 1.5 ליטר", ["קוקה", "קולה"]), (tokens.size_tokens, "מארז במבה 10*25 גרם", ["10", "25"]), (tokens.size_tokens, "bag 4*55g", ["4", "55"]), (tokens.size_tokens, "חלב 3% 1 ליטר", []),
        (lambda c: tokens.head_ok(tokens.head(c), tokens.head(F.lit("מגבון"))), "מגבוני לחות", True), (lambda c: tokens.head_ok(tokens.head(c), tokens.head(F.lit("קוקוס"))), "שמן קוקוס", False),
        (rules.is_conditional, "/ במבה 80ג ב3AR", True), (rules.is_conditional, "CARLSBERG", False), (rules.is_conditional, "קופון 5", True), (rules.is_conditional, None, False),
        (rules.open_to_all, " 0 ", True), (rules.open_to_all, "7", False), (rules.open_to_all, None, True),
    ],
)
def test_scalars(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_read_feed(spark, tmp_path):
    (tmp_path / "price_file_a.csv").write_text('﻿chainid,storeid,itemcode\n1,001,"a\nb"\n,,x\n1,2,3,4\n\'\',"",y\n', encoding="utf-8")
    rows = sources.read_feed(spark, str(tmp_path / "price_file_a.csv"), ["chainid", "storeid", "itemcode"])
    filled = sources.forward_fill(rows, ["chainid", "storeid"], "file", "ord")
    assert [(r["chainid"], r["storeid"], r["itemcode"]) for r in filled.orderBy("ord").collect()] == [("1", "001", "a\nb"), ("1", "001", "x"), ("1", "001", "y")]
    assert sources.chain_files(spark, str(tmp_path), ["a", "b"]) == {"a": {"prices": f"{tmp_path}/price_file_a.csv"}}


def test_forward_fill_in_blocks(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(f"f{i % 2}", i, rng.choice([None, "", f"v{i}"])) for i in range(400)], "file string, ord long, v string")
    whole = sources.forward_fill(df, ["v"], "file", "ord")
    parts = sources.forward_fill(df.repartition(7), ["v"], "file", "ord", F.floor(F.col("ord") / 30))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)


def test_load_prices(spark):
    raw = spark.createDataFrame(
        [(1, "729", "01", "12", "Tomato", "5.90", None), (2, "729", "1", "12", None, "6.10", "x"), (3, "729", "1", "99", "No price", None, None), (4, "729", "9", "7290000000099", "Milk", "4", None)],
        "ord long, chainid string, storeid string, itemcode string, itemnm string, itemprice string, manufacturename string",
    )
    stores = spark.createDataFrame([("729", "1", 77)], "chain_id string, store_code string, store_id long")
    products, prices, watched = feeds.load_prices(raw, stores)
    assert {r["barcode"]: (r["name"], r["manufacturer"]) for r in products.collect()} == {"729_12": ("Tomato", "x"), "7290000000099": ("Milk", None)}
    assert [(r["barcode"], r["store_id"], r["price"]) for r in prices.collect()] == [("729_12", 77, Decimal("6.10"))]
    feeds.dry_run(prices)
    assert watched.get["no_store"] == 1
    shops = feeds.load_stores(feeds.normalize_stores(spark.createDataFrame([(1, "729", "Feed", "001", "Old", "0"), (2, "729", "Feed", "1", "New", "Main 3")], "ord long, chainid string, chainname string, storeid string, storename string, address string"), spark.createDataFrame([("729", "Shown")], "chain_id string, display_name string")))
    assert [(r["chain_name"], r["store_name"], r["address"]) for r in shops.collect()] == [("Shown", "New", "Main 3")]


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, o long")
    first = upsert.upsert(target, new, ["k"], ["o"])
    again = upsert.upsert(first, new, ["k"], ["o"])
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) == [(1, "a"), (2, "d"), (3, "e")]


PROMO = "chainid string, storeid string, promotionid string, allowmultiplediscounts string"


def test_promo_families(spark):
    items = spark.createDataFrame([("1", "01", "p1", "1", '{"item": {"itemcode": "111"}}', '{"item": [{"itemcode": "222"}]}', "9.90", "2024-01-01", "10:00:00"), ("1", "1", "p2", "0", '{"item": [{"itemcode": "111"}, 5, {"itemcode": "NO_BODY"}]}', "junk", None, "2024-01-01", None)], PROMO + ", promotionitems string, giftsitems string, discountedprice string, promotionstartdate string, promotionstarthour string")
    got = {r["promo_id_src"]: r for r in promo_feed.extract(items).collect()}
    assert [(i["itemcode"], i["is_gift"]) for i in got["p1"]["items"]] == [("111", False), ("222", True)] and got["p1"]["reward_kind"] == "NTH_FREE" and got["p1"]["allow_stacking"]
    assert [i["itemcode"] for i in got["p2"]["items"]] == ["111"] and got["p2"]["reward_kind"] == "UNKNOWN" and str(got["p1"]["starts_at"]) == "2024-01-01 10:00:00"
    groups = spark.createDataFrame([("1", "1", "g", "0", '{"group": [{"groupid": "7", "promotionitems": {"promotionitem": {"itemcode": "1", "discountrate": "30.50"}}}, {"promotionitems": {}}, {"promotionitems": {"promotionitem": [{"itemcode": "2", "discountedprice": "17", "minqty": "3"}]}}]}'), ("1", "1", "h", "0", '{"group": {"promotionitems": {"promotionitem": [{"itemcode": "3", "discountrate": "-94400"}]}}}')], PROMO + ", groups string")
    got = {r["promo_id_src"]: r for r in promo_feed.extract(groups).collect()}
    assert set(got) == {"g#7", "g#3", "h"} and got["g#7"]["discount_rate"] == Decimal("0.305") and got["g#7"]["reward_kind"] == "PCT_OFF"
    assert got["g#3"]["reward_kind"] == "BUNDLE_PRICE" and got["h"]["discount_rate"] is None
    flat = spark.createDataFrame([("1", "1", "f", "0", "12", "1")], PROMO + ", itemcode string, isgiftitem string")
    head = promo_feed.extract(flat)
    links = promo_feed.promo_links(head, spark.createDataFrame([("1_12", 5)], "barcode string, canonical_id long")).collect()
    assert [(r["canonical_id"], r["is_gift"]) for r in links] == [(5, True)]


P = "promotion_id long, store_id long, chain_id string, reward_kind string, discounted_price decimal(10,2), discount_rate decimal(6,3), discount_amount decimal(10,2), min_basket_amount decimal(10,2), min_qty decimal(10,3), max_qty decimal(10,3), allow_stacking boolean, description string"


def promo(i, kind, items, price=None, rate=None, amount=None, basket=None, least=1, most=None, stacks=False, chain="1", gifts=()):
    d = lambda x: None if x is None else Decimal(str(x))
    return (i, 1, chain, kind, d(price), d(rate), d(amount), d(basket), d(least), d(most), stacks, "offer"), [(i, c, False) for c in items] + [(i, c, True) for c in gifts]


def priced(spark, lines, promos):
    rows = spark.createDataFrame([(1, 1, c, Decimal(str(q)), Decimal(str(p))) for c, q, p in lines], "basket_id long, store_id long, canonical_id long, quantity decimal(12,3), unit_price decimal(10,2)")
    heads = spark.createDataFrame([h for h, _ in promos], P)
    items = spark.createDataFrame([i for _, own in promos for i in own], "promotion_id long, canonical_id long, is_gift boolean")
    applied = pricing.resolve_conflicts(pricing.evaluate(rows, heads, items))
    return float(sum({r["promotion_id"]: r["saving"] for r in applied.collect()}.values()))


@pytest.mark.parametrize(
    ("lines", "promos", "saved"),
    [
        ([(1, 3, 12)], [promo(1, "FIXED_PRICE", [1], 9)], 9),
        ([(1, 7, 9.90)], [promo(1, "BUNDLE_PRICE", [1], 17, least=3)], 69.30 - 43.90),
        ([(1, 2, 9.90)], [promo(1, "BUNDLE_PRICE", [1], 17, least=3)], 0),
        ([(1, 2, 100)], [promo(1, "NTH_FREE", [1], least=2), promo(2, "PCT_OFF", [1], rate=0.3)], 100),
        ([(1, 1, 200)], [promo(1, "PCT_OFF", [1], rate=0.1, stacks=True), promo(2, "PCT_OFF", [1], rate=0.2, stacks=True)], 60),
        ([(1, 1, 100)], [promo(1, "PCT_OFF", [1], rate=0.5), promo(2, "PCT_OFF", [1], rate=0.1, stacks=True)], 50),
        ([(1, 1, 100), (2, 1, 100)], [promo(1, "PCT_OFF", [1], rate=0.4), promo(2, "PCT_OFF", [2], rate=0.4), promo(3, "PCT_OFF", [1, 2], rate=0.3)], 80),
        ([(1, 1, 100)], [promo(1, "AMOUNT_OFF", [1], amount=20, basket=50), promo(2, "PCT_OFF", [1], rate=0.1)], 30),
        ([(1, 1, 9.90)], [promo(1, "FIXED_PRICE", [1], 3.95, chain="7290644700005")], 0),
        ([(1, 1, 9.90)], [promo(1, "FIXED_PRICE", [1], 3.97, chain="7290644700005")], 5.93),
        ([(1, 1, 10), (2, 2, 4)], [promo(1, "NTH_FREE", [1], least=1, gifts=[2])], 4),
        ([(1, 1, 10)], [promo(1, "NTH_FREE", [1], least=1, gifts=[2])], 0),
        ([(1, 5, 10), (2, 5, 8)], [promo(1, "PCT_OFF", [1, 2], rate=0.5, most=6)], 29),
    ],
)
def test_pricing(spark, lines, promos, saved):
    assert priced(spark, lines, promos) == pytest.approx(saved)


def test_best_subset_is_best():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 9)
        saving = {i: rng.randrange(1, 20) for i in range(n)}
        items = {i: set(rng.sample(range(6), rng.randrange(1, 4))) for i in range(n)}
        stacks = {i: rng.random() < 0.5 for i in range(n)}
        bad = {i: {j for j in range(n) if j != i and items[i] & items[j] and not (stacks[i] and stacks[j])} for i in range(n)}
        best = max(sum(saving[i] for i in s) for k in range(n + 1) for s in itertools.combinations(range(n), k) if all(b not in bad[a] for a, b in itertools.combinations(s, 2)))
        own = pricing.best_subset(list(range(n)), saving, stacks, items)
        assert sum(saving[i] for i in own) == best and all(b not in bad[a] for a, b in itertools.combinations(own, 2))


def test_promotions_of_one_item_are_settled_like_the_others(spark):
    """The shortcut for promotions that take one item agrees with the search."""
    rng = random.Random(6)
    rows, want = [], set()
    for basket in range(60):
        n = rng.choice([1, 2, 3, 5, 16])
        own = {basket * 100 + i: (Decimal(rng.randrange(1, 9)), rng.random() < 0.5) for i in range(n)}
        rows += [(basket, 1, i, 7, Decimal(1), saving, stacks, 1) for i, (saving, stacks) in own.items()]
        want |= set(pricing.best_subset(sorted(own), {i: x[0] for i, x in own.items()}, {i: x[1] for i, x in own.items()}, {i: {7} for i in own}))
    found = spark.createDataFrame(rows, "basket_id long, store_id long, promotion_id long, canonical_id long, used decimal(12,3), saving decimal(10,2), allow_stacking boolean, items long")
    assert {r["promotion_id"] for r in pricing.resolve_conflicts(found).collect()} == want


def test_compare(spark):
    stores = spark.createDataFrame([(10, "1", "A", "x", "s10", "a"), (20, "2", "B", "x", "s20", "b"), (30, "3", "C", "x", "s30", "c"), (31, "3", "C", "x", "s30", "")], "store_id long, chain_id string, chain_name string, city string, store_name string, address string")
    products = spark.createDataFrame([(i, f"p{i}", f"p{i}") for i in (1, 2, 3)], "product_id long, name string, name_norm string")
    prices = spark.createDataFrame([(p, s, Decimal(str(v))) for s, own in ((10, (5, 3, 10)), (20, (6, 2, 8)), (30, (5, 1, None)), (31, (4, None, None))) for p, v in zip((1, 2, 3), own, strict=True) if v], "product_id long, store_id long, price decimal(10,2)")
    baskets = spark.createDataFrame([(1, "x", 1, Decimal(1)), (1, "x", 2, Decimal(2)), (1, "x", 3, Decimal(1)), (2, "y", 1, Decimal(1))], "basket_id long, city string, product_id long, quantity decimal(10,3)")
    ranked = compare.compare(baskets, products, prices, stores).orderBy("pos").collect()
    assert [(r["store_id"], float(r["total"]), r["rank"], r["pct_above_cheapest"]) for r in ranked] == [(20, 18.0, 1, 0.0), (10, 21.0, 2, 16.7), (30, 7.0, None, None)]
    shown = compare.select_branches(compare.compare(baskets, products, prices, stores), 2).orderBy("pos").collect()
    assert [r["store_id"] for r in shown] == [20, 10]
    header = {r["basket_id"]: (r["winner_store_id"], r["message"]) for r in compare.compare_header(baskets, compare.compare(baskets, products, prices, stores)).collect()}
    assert header == {1: (20, "ok"), 2: (None, "no branch")}
    rejects = compare.validate_baskets(baskets.withColumn("quantity", F.lit(0)), spark.createDataFrame([(1,), (2,), (3,)], "basket_id long"))[1]
    assert sorted(map(tuple, rejects.collect())) == [(1, "quantity"), (2, "quantity"), (3, "empty")]


def test_fuzzy_names(spark):
    from basketlens.operators.matching import fuzzy_names

    names = ["bamba snack 80 g", "bamba snack family 80 g", "oil bamba snack 80 g", "bamba snack 25 g", "bambani snack 80 g"]
    got = {tuple(r) for r in fuzzy_names(spark.createDataFrame([(n,) for n in names], "name_norm string")).collect()}
    assert {c for q, c in got if q == names[0]} == {names[0], names[1], names[4]}


def test_registered_queries_have_all_three_tiers(spark):
    from basketlens.plans import basket_queries as bq

    t = bq.Tables(spark, "")
    t.products = spark.createDataFrame([(1, "bamba snack 5 g"), (2, "bamba snack 5 g"), (3, "bamba snack 7 g"), (4, "milk 5 g"), (5, "bamba snack 25 g")], "product_id long, name_norm string")
    t.stores = spark.createDataFrame([(10, "x"), (20, "x"), (30, "x")], "store_id long, city string")
    t.prices = spark.createDataFrame([(1, 10, Decimal(5)), (2, 20, Decimal(6)), (3, 20, Decimal(1)), (3, 30, Decimal(4)), (4, 30, Decimal(2))], "product_id long, store_id long, price decimal(10,2)")
    t.baskets = spark.createDataFrame([(1, "x", 1, Decimal(2)), (1, "x", 4, Decimal(1))], "basket_id long, city string, product_id long, quantity decimal(10,3)")
    run = lambda name: sorted(tuple(r) for r in bq.QUERIES[name][0](t).collect())
    assert run("i2_candidates") == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 5, 3), (4, 4, 1)]
    assert run("i3_best_offers") == [(1, "x", 10, 1, 5.0), (1, "x", 20, 2, 6.0), (1, "x", 30, 3, 4.0), (4, "x", 30, 1, 2.0)]
    assert (1, 30, 2, 0, True, 10.0) in run("i4_store_totals")


def test_cities(spark):
    stores = spark.createDataFrame([(1, "'Tel-Aviv'", "s", None), (2, "0070", "s", None), (3, None, "Shop North Haifa", None), (4, "Old", "s", "Oak 1")], "store_id long, city string, store_name string, address string")
    known = spark.createDataFrame([("Haifa",), ("Tel Aviv",)], "city string")
    out = cities.resolve_city(stores, spark.createDataFrame([("70", "Ashdod")], "code string, city string"), spark.createDataFrame([("Tel-Aviv", "Tel Aviv")], "alias string, city string"), known)
    out = cities.canonical_city(out, [("Old", "Older"), ("Older", "Oldest")], [("Ashdod", "zzz", "no")])
    assert {r["store_id"]: r["city"] for r in out.collect()} == {1: "Tel Aviv", 2: "Ashdod", 3: "Haifa", 4: "Oldest"}
    assert cities.merge_closure([("a", "b"), ("b", "a")])["a"] in ("a", "b")
    good, bad = cities.validate_aliases(spark.createDataFrame([("x", "Haifa"), ("y", "Nowhere")], "alias string, city string"), known)
    assert good.count() == bad.count() == 1
    assert cities.unmapped_cities(out, known).first()["stores"] == 1


def test_canonical_and_quality(spark):
    products = spark.createDataFrame([(1, "milk", "milk", "", "m"), (2, "bamba snack big 80", "bamba snack big 80", "80", None), (3, "bamba snack big 80", "bamba snack big 80", "80", "o")], "product_id long, name string, name_norm string, size_signature string, manufacturer string")
    built = canonical.build_canonical(products)
    assert {r["name_norm"]: (r["member_count"], r["brand"]) for r in built.collect()} == {"milk": (1, "m"), "bamba snack big 80": (2, "o")}
    assert {r["product_id"]: float(r["confidence"]) for r in canonical.map_products(products).collect()} == {1: 0.6, 2: 1.0, 3: 1.0}
    links = spark.createDataFrame([(1, 12345)], "promotion_id long, canonical_id long")
    assert canonical.prune_report(built, canonical.map_products(products.limit(1)), links).count() == 1
    gate = quality.outcome_gate(spark.createDataFrame([("a", "ok", False, "success", "failed")], "chain string, job_status string, skipped boolean, price_loader string, promotion_loader string"), 2)
    assert [r["problem"] for r in gate.collect()] == ["missing chains", "no promotion load"]


def test_search(spark):
    products = spark.createDataFrame([(1, "7290001", "red apple juice", "acme", 5), (2, "7290002", "apple pie", "acme", 9), (3, "111", "orange", "zest", 1)], "product_id long, barcode string, name_norm string, manufacturer string, availability long")
    queries = spark.createDataFrame([(1, "app"), (2, "7290"), (3, "cme"), (4, "jui app")], "query_id long, query string")
    found = search.word_search(products, queries)
    assert [(r["query_id"], r["product_id"]) for r in found.orderBy("query_id", "place").collect()] == [(1, 2), (1, 1), (4, 1)]
    assert [r["product_id"] for r in search.barcode_search(products, queries).orderBy("place").collect()] == [2, 1]  # the one in more shops first
    rest = search.substring_search(products, queries.filter("query_id = 3"), found)
    assert [r["product_id"] for r in rest.orderBy("place").collect()] == [2, 1]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n1,2\n")
    seen = []
    for _ in range(2):
        jobs.stream_files(spark, str(tmp_path / "in"), "k long, v long", str(tmp_path / "cp"), lambda df, i: seen.extend(df.collect())).awaitTermination()
    assert len(seen) == 1
    log = spark.createDataFrame([(1, 1, 5.0, 2), (1, 1, 4.0, 1)], "product_id long, store_id long, price double, seen long")
    assert jobs.latest_prices(log).first()["price"] == 5.0


def test_entry_without_the_training_data_operators(tmp_path):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    root = pathlib.Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "basketlens", tmp_path / "basketlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n >= set(e.oracle_sql()) and len(n) > 100 and not any(x.startswith('op') for x in n) and 'pipeline' not in n"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_feeds_of_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ChainId,ItemCode,ItemName\n1,11,x\n1,12,y,extra\n")
    (tmp_path / "b.csv").write_text("itemcode,chainid\n21,2\n")
    from basketlens.sources import feeds as src

    got = src.read_feeds(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["chainid"], r["itemcode"], r["itemname"]) for r in got.collect()) == [("1", "11", "x"), ("2", "21", None)]


def test_strict_localities(spark):
    rows = [(1, "Be Akko", None), (2, "Akko - north", "Akko 12"), (3, "Akko", "Haifa, x"), (4, "Old Akko", None), (5, "online - Haifa", "Haifa"), (6, "Haifa (new)", None), (7, "Akko", "קניון Akko"), (8, None, None)]
    stores = spark.createDataFrame(rows, "store_id long, store_name string, address string")
    known = spark.createDataFrame([("Akko",), ("Haifa",)], "name string")
    assert {r["store_id"]: r["named_city"] for r in cities.strict_locality(stores, known).collect()} == {1: "Akko", 5: "Haifa"}  # brackets in a name hide a locality, in an address they do not


def test_short_search_and_null_codes(spark):
    products = spark.createDataFrame([(1, "7290001", "red tea", "acme", 5), (2, "7290002", "pie", "zest", 9)], "product_id long, barcode string, name_norm string, manufacturer string, availability long")
    queries = spark.createDataFrame([(1, "e"), (2, "ea"), (3, "zz")], "query_id long, query string")
    found = search.substring_search(products, queries, queries.limit(0)).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["product_id"]) for r in found] == [(1, 2), (1, 1), (2, 1)]
    assert spark.range(1).select(cl.product_key(F.lit(None).cast("string"), F.lit("729")).alias("k")).first()["k"] is None
