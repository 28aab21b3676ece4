"""Search as a whole, and entity resolution over several runs, on small tables worked out by hand."""

from basketlens.operators import canonical, search

PRODUCTS = "product_id long, barcode string, name_norm string, manufacturer string, unit_qty string, unit_of_measure string, quantity double, is_weighted boolean, availability long"
ROWS = [
    (1, "7290001", "red apple juice", "acme", "litre", "per 100", 1.5, False, 5),
    (2, "7290002", "apple pie", "acme", None, None, None, True, 9),
    (3, "7290003", "apple pie", "abel", "gram", "per kilo", 0.5, False, None),
    (4, "111", "orange", "apple & sons", "unit", None, None, None, 1),
    (5, "7299", "applesauce", None, None, None, None, None, 14),
    (6, None, "", None, None, None, None, None, None),
]


def _asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def _got(df):
    return {(r["query_id"], r["way"]): [] for r in df.collect()} | {k: [r["product_id"] for r in v] for k, v in _grouped(df).items()}


def _grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["place"])):
        out.setdefault((r["query_id"], r["way"]), []).append(r)
    return out


def test_one_search_for_all_kinds_of_queries(spark):
    found = search.search_products(spark.createDataFrame(ROWS, PRODUCTS), _asked(spark, "7290", "8888", "apple", " APP  ju ", "sons", "range", "", None, "729", "zzz", "apples", "+apple* pie"))
    got = _got(found)
    assert got[0, "barcode"] == [2, 1]  # one row for the two pies
    assert not any(k[0] in (1, 6, 7, 9) for k in got)  # a barcode without an answer is not searched otherwise
    assert got[2, "words"] == [5, 2, 1]  # names that start so first, then those in more shops; the maker does not count
    assert got[3, "words"] == [1]
    assert got[4, "substring"] == [4] and got[5, "substring"] == [4]
    assert (8, "words") not in got and (8, "substring") not in got
    assert got[10, "words"] == [5]
    assert got[11, "words"] == [2]


def test_details_of_a_name_are_those_of_its_rows(spark):
    products = spark.createDataFrame(ROWS, PRODUCTS)
    pie = search.search_products(products, _asked(spark, "pie")).first()
    assert (pie["product_id"], pie["availability"], pie["barcode"], pie["manufacturer"], pie["unit_qty"], pie["quantity"], pie["is_weighted"]) == (2, 9, "7290002", "abel", "gram", 0.5, True)
    one = search.search_products(products, _asked(spark, "7290003")).first()  # of the rows that match, not of the whole name
    assert (one["product_id"], one["availability"], one["is_weighted"]) == (3, 0, False)


def test_limits_ties_and_other_columns(spark):
    rows = [(i, f"999{i}", f"tea {i}", "same", 3) for i in range(10, 40)]
    products = spark.createDataFrame(rows, "product_id long, barcode string, name_norm string, manufacturer string, availability long")
    asked = _asked(spark, "tea", "9991", "sam").selectExpr("*", "'x' AS name_norm")
    got = _got(search.search_products(products, asked, 4))
    assert got == {(0, "words"): [10, 11, 12, 13], (1, "barcode"): [10, 11, 12, 13], (2, "substring"): [10, 11, 12, 13]}
    assert search.search_products(products.limit(0), asked).count() == search.search_products(products, asked.limit(0)).count() == 0


ITEMS = "product_id long, name string, name_norm string, size_signature string, manufacturer string, quantity double, unit_qty string, is_weighted boolean"


def test_runs_of_chains_share_items(spark):
    rows = [(1, "big red tea 80", "big red tea 80", "80", None, 80.0, None, True), (2, "big red tea  80", "big red tea 80", "80", "m", None, "gram", False), (3, "tea", "tea", "", "z", None, None, None), (4, "", "", "", None, None, None, None)]
    products = spark.createDataFrame(rows, ITEMS)
    stores = spark.createDataFrame([(10, "a"), (20, "b")], "store_id long, chain_id string")
    prices = spark.createDataFrame([(1, 10), (1, 20), (2, 20), (4, 20)], "product_id long, store_id long")
    items, links, counters = canonical.resolve(products, chains=["a"], prices=prices, stores=stores)
    assert [tuple(r)[1:] for r in items.collect()] == [("big red tea 80", "80", "big red tea 80", None, 80, None, True, 1)]
    assert counters.first().asDict() == {"products": 1, "canonical": 1, "review": 0, "skipped": 0}
    old = spark.createDataFrame([(4, 7, "exact_name", 1.0, False)], "product_id long, canonical_id long, match_method string, confidence double, needs_review boolean")
    for _ in range(2):  # a run may be repeated
        items, links, counters = canonical.resolve(products, items, links.unionByName(old) if links.filter("product_id = 4").count() == 0 else links, ["b"], prices, stores)
    assert [tuple(r)[1:] for r in items.collect()] == [("big red tea 80", "80", "big red tea  80", "m", 80, "gram", True, 2)]  # the longer name, filled nulls, what was there stays
    assert sorted(r["product_id"] for r in links.collect()) == [1, 2, 4]
    assert counters.first().asDict() == {"products": 2, "canonical": 1, "review": 0, "skipped": 1}
    whole = canonical.resolve(products, items, links)
    assert sorted((r["name_norm"], r["member_count"]) for r in whole[0].collect()) == [("big red tea 80", 2), ("tea", 1)]
    assert whole[2].first()["review"] == 1


def test_codes_are_missed_once(spark):
    products = spark.createDataFrame([(1, "11"), (2, "12")], "product_id long, barcode string")
    mapped = spark.createDataFrame([(1, 5)], "product_id long, canonical_id long")
    codes = spark.createDataFrame([("11", 0), ("12", 1), ("12", 2), ("13", 3), (None, 4)], "barcode string, row long")
    found, missed = canonical.resolve_codes(codes, products, mapped)
    assert {r["row"]: r["canonical_id"] for r in found.collect()} == {0: 5, 1: None, 2: None, 3: None, 4: None}
    assert sorted(r["barcode"] for r in missed.collect()) == ["12", "13"]
