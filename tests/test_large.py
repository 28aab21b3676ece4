"""What odd inputs and larger tables showed: registered queries and operators against their SQL or a plain version."""

import pathlib
import random
from decimal import Decimal

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from basketlens.operators import branches, compare, matching, pricing, search
from basketlens.plans import basket_queries


def differs(spark, name, folder):
    """Rows of a registered query that its SQL does not have, and the other way round."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = con.sql(__spark_entry__.oracle_sql()[name])
    mine, theirs = ({tuple(r): None for r in rows} for rows in (got.select(*want.columns).collect(), want.fetchall()))
    return [r for r in mine if r not in theirs], [r for r in theirs if r not in mine]


def largest(df, metric="numOutputRows"):
    """The most rows that any step of a plan made (or shuffled: ``shuffleRecordsWritten``)."""
    df.write.format("noop").mode("overwrite").save()
    made = []

    def walk(plan):
        for child in [plan.children().apply(i) for i in range(plan.children().size())] + ([plan.executedPlan()] if "AdaptiveSparkPlan" in plan.nodeName() else []) + ([plan.plan()] if "QueryStage" in plan.nodeName() else []):
            walk(child)
        if plan.metrics().contains(metric):
            made.append(plan.metrics().apply(metric).value())

    run = df._jdf.queryExecution()
    df._jdf.collectToPython()
    walk(run.executedPlan())
    return max(made)


def test_clamped_texts_are_those_of_the_sql(spark, tmp_path):
    texts = ["unknown", "None", "", " ", " padded　", " ", "'n/a'", "{}", None, "a" * 254, "b" * 255, "c" * 256, "é😀" * 300, "d" * 254 + " ", "null and more"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert differs(spark, "b22_clamp", tmp_path) == ([], [])


def test_barcodes_that_begin_alike_make_no_pairs(spark):
    products = spark.range(4000).select(F.col("id").alias("product_id"), F.concat(F.lit("name "), (F.col("id") % 50).cast("string")).alias("name_norm"), F.lpad(F.col("id").cast("string"), 13, "0").alias("barcode"), F.lit(1).alias("availability"))
    asked = [(i, f"{i:013}"[: 13 - i % 3]) for i in range(0, 4000, 7)] + [(5000, "0000"), (5001, "0000"), (5002, "00000000000001"), (5003, "12")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    got = search.barcode_search(products, queries, 3)
    want = []
    for i, q in asked:
        names = {}
        for p in range(4000):
            if len(q) >= 4 and f"{p:013}".startswith(q):
                names.setdefault(f"name {p % 50}", []).append(p)
        best = sorted(names.items(), key=lambda x: (-len(x[1]), len(x[0]), min(x[1])))[:3]
        want += [(i, k + 1, name, min(own), len(own)) for k, (name, own) in enumerate(best)]
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want)
    assert largest(got) < 20_000  # pairs by the first four letters were 573 * 4000


def test_substrings_are_looked_up_by_names_and_makers(spark):
    products = spark.range(20_000).select(F.col("id").alias("product_id"), F.concat(F.lit("green Tea "), (F.col("id") % 4).cast("string")).alias("name_norm"), F.concat(F.lit("Teamaker "), (F.col("id") % 3).cast("string")).alias("manufacturer"), F.lit(1).alias("availability"))
    queries = spark.createDataFrame([(1, "eama"), (2, "reen"), (3, "ea"), (4, "maker 2")], "query_id long, query string")
    got = search.substring_search(products, queries, queries.limit(0), 2)
    kept = [tuple(r)[:5] for r in got.orderBy("query_id", "place").collect()]
    assert kept == [(q, k + 1, f"green Tea {k}", k, 5000) for q in (1, 2, 3) for k in (0, 1)] + [(4, 1, "green Tea 2", 2, 1667), (4, 2, "green Tea 1", 5, 1667)]
    assert largest(got) < 50_000  # 40,000 fields; fields of single products that match made 86,666


def test_searches_are_those_of_the_sql(spark):
    assert differs(spark, "h_search_products", pathlib.Path("/root/testdata/sf0.001")) == ([], [])


def test_names_of_many_products_are_cut_before_they_meet(spark):
    products = spark.range(600).select(F.col("id").alias("product_id"), F.concat(F.element_at(F.array(F.lit("bamba snack"), F.lit("bamba snacks"), F.lit("milk")), (F.col("id") % 3 + 1).cast("int")), F.lit(" 80 g")).alias("name_norm"))
    reps = products.filter("product_id % 2 = 0").select(F.col("product_id").alias("rep_id"))
    own = {k: list(range(k, 600, 3))[:80] for k in range(3)}
    want = {(r, p): 2 for r in range(0, 600, 2) for p in own[r % 3]}
    assert sorted(map(tuple, matching.same_name(products, reps).collect())) == sorted(want)
    assert largest(matching.same_name(products, reps)) == len(want)  # products of equal names made 60,000 pairs
    third = {0: [p for p in range(600) if p % 3 < 2][:80], 1: own[1], 2: own[2]}
    want = {(r, p): 3 for r in range(0, 600, 2) for p in third[r % 3]} | want | {(r, r): 1 for r in range(0, 600, 2)}
    found = matching.candidates(products, reps)
    assert sorted(map(tuple, found.collect())) == sorted((*k, tier) for k, tier in want.items())
    assert largest(found) <= len(want)
    prices = products.crossJoin(spark.range(9).select(F.col("id").alias("store_id"))).filter("product_id % 7 <> store_id % 7").select(F.concat(F.lit("c"), (F.col("store_id") % 2).cast("string")).alias("city"), "store_id", "product_id", ((F.col("product_id") * 37 + F.col("store_id")) % 101 + 1).cast("decimal(10,2)").alias("price"))
    offers = compare.item_offers(products, reps, prices)
    plain = compare.best_offers(found, prices).select(offers.columns)
    assert sorted(map(tuple, offers.collect())) == sorted(map(tuple, plain.collect()))
    assert largest(offers) < largest(plain) / 5


def shops(spark, chains=4):
    """Tables of two cities, with namesakes with and without addresses, names of several products and a basket of great amounts."""
    rng = random.Random(5)
    t = basket_queries.Tables(spark, "")
    names = ["bamba snack", "bamba snack 80 g", "milk 1", "bread", ""]
    t.products = spark.createDataFrame([(i, names[i % 5]) for i in range(40)], "product_id long, name_norm string")
    t.stores = spark.createDataFrame([(i, str(i % chains), f"chain {i % chains}", "xy"[i % 3 == 0], "twin" if i % 5 < 2 else f"s{i}", rng.choice(["", None, "a", "b", f"street {i}"])) for i in range(60)], "store_id long, chain_id string, chain_name string, city string, store_name string, address string")
    t.prices = spark.createDataFrame([(p, s, Decimal(rng.choice([0, 5, 100, 105, 99_999_999]) if p == 7 else rng.randint(1, 30)) / 10) for p in range(40) for s in rng.sample(range(60), 12)], "product_id long, store_id long, price decimal(10,2)")
    t.baskets = spark.createDataFrame([(b, "xyz"[b % 3], rng.randint(0, 41), Decimal(rng.choice([1, 2, 3])) / 4) for b in range(120) for _ in range(rng.randint(1, 6))] + [(9, "x", 7, Decimal(9_999_999) / 4)], "basket_id long, city string, product_id long, quantity decimal(10,3)")
    return t


def same(got, want):
    columns = [c for c in want.columns if c in got.columns]
    rows = lambda df: sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    assert rows(got) == rows(want)
    return columns


def test_totals_in_blocks_are_those_of_the_plain_functions(spark, monkeypatch):
    t = shops(spark)
    for tiers, cells in ((3, 3_000_000), (1, 50)):
        monkeypatch.setattr(branches, "CELLS", cells)
        prices = compare.city_prices(t.prices, t.stores)
        offered = compare.offered_lines(t.lines, compare.item_offers(t.products, t.reps, prices, tiers)).localCheckpoint()
        rows = branches.dealt(t.lines, t.products, prices, t.stores, tiers).localCheckpoint()
        plain = compare.store_totals(offered).localCheckpoint()
        assert plain.filter("total is null").count() > 0
        assert "total" in same(branches.totals(rows, "all"), plain)
        single = compare.dedup_twins(plain, t.stores)
        assert 0 < single.count() < plain.count()
        same(branches.totals(rows, "single"), single)
        ranked = compare.rank_stores(single).localCheckpoint()
        assert {"pos", "rank", "pct_above_cheapest"} < set(same(branches.totals(rows, "ranked"), ranked))
        same(branches.totals(rows, "shown"), compare.select_branches(ranked))
        same(branches.missing_items(rows), compare.missing_items(plain, t.lines, offered))


def test_offered_lines_are_not_shuffled_for_totals(spark):
    t = shops(spark)
    t.stores = spark.range(400).select(F.col("id").alias("store_id"), F.lit("1").alias("chain_id"), F.lit("one").alias("chain_name"), F.lit("x").alias("city"), F.col("id").cast("string").alias("store_name"), F.lit("a").alias("address"))
    t.prices = t.products.crossJoin(t.stores.select("store_id")).select("product_id", "store_id", (F.col("product_id") + 1).cast("decimal(10,2)").alias("price"))
    t.baskets = t.baskets.withColumn("city", F.lit("x"))
    for name in ("i4_store_totals", "i5_dedup_twins", "i6_rank_stores", "i7_pct_above_cheapest", "i9_select_branches", "i10_compare_header", "d12_missing_items"):
        assert largest(basket_queries.QUERIES[name][0](t), "shuffleRecordsWritten") <= 40 * 400, name  # prices; lines meet offers 133,000 times


def test_only_lines_with_promotions_are_shuffled_for_them(spark):
    t = shops(spark)
    rows = branches.with_marks(t.dealt, t.prices.filter("store_id % 7 = 0").select("store_id", "product_id"), t.stores)
    offered = compare.offered_lines(t.lines, compare.item_offers(t.products, t.reps, compare.city_prices(t.prices, t.stores)))
    single = compare.dedup_twins(compare.store_totals(offered), t.stores).select("basket_id", "store_id", F.col("total").alias("basket_total"))
    lines = offered.join(single, ["basket_id", "store_id"]).select("basket_id", "store_id", F.col("product_id").alias("canonical_id"), "quantity", F.col("price").alias("unit_price"), "basket_total").localCheckpoint()
    same(branches.sold(rows).drop("marked"), lines)
    some = lines.join(t.prices.filter("store_id % 7 = 0").select("store_id", F.col("product_id").alias("canonical_id")), ["store_id", "canonical_id"], "left_semi")
    assert 0 < some.count() < lines.count() / 5
    same(branches.sold(rows, marked=True).drop("marked"), some)
    savings = single.filter("store_id % 2 = 0").select("basket_id", "store_id", ((F.col("store_id") + 1) / 4).cast("decimal(10,2)").alias("saving"))
    applied = savings.select("*", F.col("basket_id").alias("promotion_id"))
    plain = pricing.reprice(compare.dedup_twins(compare.store_totals(offered), t.stores), applied).localCheckpoint()
    lowered = branches.with_savings(t.dealt, savings, t.stores)
    assert {"total", "base_total", "total_savings", "promotions_applied"} < set(same(branches.repriced(branches.totals(lowered, "single")), plain))
    ranked = compare.rank_stores(plain)
    same(branches.repriced(branches.totals(lowered, "ranked")), ranked)
    same(branches.repriced(branches.totals(lowered, "shown")), compare.select_branches(ranked))


def test_coverage_shuffles_lines_and_not_their_chains(spark):
    t = shops(spark, 30)
    t.stores = t.stores.withColumn("chain_name", F.when(F.col("chain_id") != "4", F.col("chain_name")))
    got = compare.basket_coverage(t.baskets, t.products, t.prices, t.stores)
    name = {r["product_id"]: r["name_norm"] for r in t.products.collect()}
    chain = {r["store_id"]: r["chain_name"] for r in t.stores.collect()}
    carried = {(name[r["product_id"]], chain[r["store_id"]]) for r in t.prices.collect()}
    want = {}
    for basket, item in {(r["basket_id"], r["product_id"]) for r in t.baskets.collect() if r["product_id"] in name}:
        for c in {c for n, c in carried if n == name[item]}:
            want[basket, c] = want.get((basket, c), 0) + 1
    assert {(r["basket_id"], r["chain_name"]): r["items"] for r in got.collect()} == want
    assert largest(got, "shuffleRecordsWritten") <= max(t.prices.count(), t.baskets.count())  # chains of lines are thousands
