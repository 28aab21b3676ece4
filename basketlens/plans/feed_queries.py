"""Registered queries of feeds, loads, promotion feeds, cities and gates, with their SQL.

Raw feeds are derived from the test tables row by row, as strings with the oddities
of real feeds: padded codes, other column names, quotes, blanks and nested JSON.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import cleaning as cl
from basketlens.functions import promo_rules as rules
from basketlens.functions import tokens
from basketlens.operators import branches, canonical, cities, feeds, pricing, promo_feed, quality, search
from basketlens.plans import binding as b
from basketlens.plans.basket_queries import ADVERTISED, Tables, dbl
from basketlens.sinks.folders import shared_folder
from basketlens.sinks.versioned import VersionedTable

CTES, PROMO = b.CTES, b.CTES + b.PROMO_CTES


def _part(t: Tables) -> DataFrame:
    return b.table(t.spark, t.folder, "part")


def raw_prices(t: Tables) -> DataFrame:
    """A price feed: every fifth item has a short code, every seventh row no price, names come under two columns."""
    rows = b.table(t.spark, t.folder, "lineitem").join(_part(t).select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    key, line = F.col("l_partkey"), F.col("l_linenumber")
    return rows.select(
        F.when(key % 5 == 0, key.cast("string")).otherwise(F.concat(F.lit("9"), F.lpad(key.cast("string"), 12, "0"))).alias("itemcode"),
        F.when(line % 2 == 0, F.concat(F.lit("'"), "p_name", F.lit("' "))).alias("itemname"),
        F.when(line % 2 == 1, F.col("p_name")).otherwise("unknown").alias("itemnm"),
        F.when(key % 3 == 0, "NULL").otherwise(F.col("p_brand")).alias("manufacturename"),
        F.concat(F.lit(" "), (F.col("l_suppkey") % 7).cast("string")).alias("chainid"),
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("storeid"),
        F.when(line % 7 == 0, "").otherwise(F.format_number(F.col("l_extendedprice").cast("decimal(12,2)"), 2)).alias("itemprice"),
        F.when(line % 3 == 0, "0").when(line % 3 == 1, "YES").alias("allowdiscount"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("priceupdatetime"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("ord"),
    )


RAW_PRICES = """raw AS (
  SELECT CASE WHEN l_partkey % 5 = 0 THEN (l_suppkey % 7) || '_' || l_partkey ELSE '9' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') END AS barcode, p_name AS name, CASE WHEN l_partkey % 3 <> 0 THEN p_brand END AS manufacturer,
    CAST(l_suppkey % 7 AS VARCHAR) AS chain_id, CAST(l_suppkey AS VARCHAR) AS store_code, CAST(l_extendedprice AS DECIMAL(10,2)) AS price, l_linenumber % 3 <> 0 AS allow_discount, CAST(l_shipdate AS TIMESTAMP) AS updated,
    l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 7 <> 0
)"""


def raw_stores(t: Tables) -> DataFrame:
    """A store feed: padded codes, quoted names, addresses that are placeholders; some stores come twice."""
    s = b.table(t.spark, t.folder, "supplier").withColumn("again", F.explode(F.when(F.col("s_suppkey") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    key = F.col("s_suppkey")
    return s.select(
        (key % 7).cast("string").alias("chainid"),
        F.when(key % 5 == 0, "unknown").otherwise(F.concat(F.lit("chain "), (key % 7).cast("string"))).alias("chainname"),
        F.lit("00").alias("subchainid"),
        F.lpad(key.cast("string"), 6, "0").alias("storeid"),
        F.concat(F.lit(' "'), "s_name", F.lit('" '), F.when(F.col("again") == 1, "new").otherwise("")).alias("storename"),
        F.when(key % 3 == 0, "0.0").otherwise(F.concat(F.lit("street "), key.cast("string"), F.lit(", 0"))).alias("address"),
        F.concat(F.lit("-'City  "), (key % 10).cast("string"), F.lit("'")).alias("city"),
        F.col("again").alias("ord"),
    )


STORES = """SELECT CAST(s_suppkey % 7 AS VARCHAR) AS chain_id, CASE WHEN s_suppkey % 5 <> 0 THEN 'chain ' || (s_suppkey % 7) END AS chain_name, '0' AS sub_chain_id, CAST(s_suppkey AS VARCHAR) AS store_code,
  CASE WHEN s_suppkey % 4 = 0 THEN s_name || '" new' ELSE s_name END AS store_name, CASE WHEN s_suppkey % 3 <> 0 THEN 'street ' || s_suppkey END AS address FROM supplier"""


def clean_stores(t: Tables) -> DataFrame:
    return feeds.load_stores(feeds.normalize_stores(raw_stores(t)))


def raw_promotions(t: Tables, family: str) -> DataFrame:
    """Promotion feeds of three families, from orders and their lines."""
    li = b.table(t.spark, t.folder, "lineitem")
    n, key = F.col("l_linenumber"), F.col("l_partkey")
    code = F.concat(F.lit("9"), F.lpad(key.cast("string"), 12, "0"))
    rows = li.select("*", code.alias("code"), F.col("l_orderkey").cast("string").alias("promotionid"), F.lit("3").alias("chainid"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 3, "0").alias("storeid"), F.when(n % 2 == 0, "1").otherwise("0").alias("allowmultiplediscounts"), F.lit("deal").alias("promotiondescription"), F.lit("2026-01-02").alias("promotionstartdate"), F.when(n % 2 == 0, "08:30:00").alias("promotionstarthour"))
    if family == "flat":
        return rows.withColumns({"itemcode": F.when(n % 5 == 0, "NO_BODY").otherwise(F.col("code")), "isgiftitem": F.when(n == 3, "1").otherwise("0"), "discountedprice": F.when(n % 2 == 0, F.lit("1,009.90")), "minqty": F.when(n == 2, "2").otherwise("0"), "promotionid": F.concat("promotionid", F.lit("-"), n.cast("string"))})
    grouped = rows.groupBy("promotionid", "chainid", "storeid").agg(F.first("promotiondescription").alias("promotiondescription"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "code"))).alias("own"))
    if family == "items":
        one = F.to_json(F.struct(F.struct(F.element_at("own", 1)["code"].alias("itemcode")).alias("item")))
        many = F.to_json(F.struct(F.transform("own", lambda x: F.struct(x["code"].alias("itemcode"))).alias("item")))
        gift = F.when(F.size("own") > 3, F.to_json(F.struct(F.struct(F.element_at("own", 1)["code"].alias("itemcode")).alias("item")))).otherwise("NO_BODY")
        return grouped.select("promotionid", "chainid", "storeid", "promotiondescription", F.when(F.size("own") == 1, one).otherwise(many).alias("promotionitems"), gift.alias("giftsitems"), F.lit("30.50").alias("discountrate"), F.lit("0.5").alias("minqty"))
    entry = F.transform("own", lambda x: F.struct(x["l_linenumber"].cast("string").alias("groupid"), F.struct(F.struct(x["code"].alias("itemcode"), F.when(x["l_partkey"] % 2 == 0, "30.50").otherwise("-94400").alias("discountrate")).alias("promotionitem")).alias("promotionitems")))
    return grouped.select("promotionid", "chainid", "storeid", "promotiondescription", F.to_json(F.struct(entry.alias("group"))).alias("groups"))


LINES = "SELECT *, '9' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS code FROM lineitem"
GROUPED = f"own AS (SELECT l_orderkey, CAST(l_suppkey % 20 AS VARCHAR) AS store_code, count(*) AS n, list(struct_pack(l := l_linenumber, p := l_partkey, code := code) ORDER BY l_linenumber, l_partkey) AS own FROM ({LINES}) GROUP BY 1, 2)"


def _headers(t: Tables, family: str) -> DataFrame:
    return promo_feed.extract(raw_promotions(t, family).withColumn("ord", F.lit(0)))  # a row for each promotion


def _runs(t: Tables) -> DataFrame:
    """Outcomes of chains: what became of each nation's orders."""
    o = b.table(t.spark, t.folder, "nation")
    k = F.col("n_nationkey")
    return o.select(F.col("n_name").alias("chain"), F.lit("ok").alias("job_status"), (k % 3 == 0).alias("skipped"), F.when(k % 3 == 1, "success").otherwise("failed").alias("price_loader"), F.lit("failed").alias("promotion_loader"))


def _named_stores(t: Tables) -> DataFrame:
    """Branches whose names hold a nation's name in some way."""
    s = b.table(t.spark, t.folder, "supplier").join(b.table(t.spark, t.folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("שלי "), "n_name")).when(key % 4 == 1, F.concat(F.lit("BE "), "n_name", F.lit("- north"))).when(key % 4 == 2, F.concat("n_name", F.lit(" mall"))).otherwise(F.col("n_name"))
    address = F.when(key % 5 == 0, F.concat("n_name", F.lit(" 12"))).when(key % 5 == 1, "NATION_3, main street").when(key % 5 == 2, F.concat(F.lit("קניון "), "n_name")).otherwise("somewhere")
    return s.select(key.alias("store_id"), name.alias("store_name"), address.alias("address"), F.lit(None).cast("string").alias("city"))


def _localities(t: Tables) -> DataFrame:
    return b.table(t.spark, t.folder, "nation").select(F.col("n_name").alias("name"))


def _cut_names(t: Tables) -> DataFrame:
    """Branches whose names hold localities cut by separators: two of them, joined ones, venues, reviewed and blocked names, streets."""
    n = b.table(t.spark, t.folder, "nation")
    other = n.select(((F.col("n_nationkey") + 24) % 25).alias("before"), F.col("n_name").alias("other"))
    s = b.table(t.spark, t.folder, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(other, F.col("n_nationkey") == F.col("before"))
    key, name = F.col("s_suppkey"), F.col("n_name")
    made = [F.concat(name, F.lit(" - "), "other"), F.concat(F.lit("NEW - "), name), F.concat(F.lit("מתחם "), name), F.concat(F.lit("x - קניון "), name), F.lit("Depot"), F.concat(F.lit("online - "), name)]
    address = F.when(key % 4 == 0, F.concat(name, F.lit(" 12"))).otherwise("somewhere")
    return s.select(key.alias("store_id"), F.element_at(F.array(*made), (key % 6 + 1).cast("int")).alias("store_name"), address.alias("address"), name.alias("n_name"))


def _strict(t: Tables) -> DataFrame:
    names = _localities(t)
    known = names.unionByName(names.select(F.concat(F.lit("NEW "), "name").alias("name")))
    reviewed = names.select(F.concat(F.lit("מתחם "), "name").alias("alias"), F.col("name").alias("city"))
    return cities.strict_locality(_cut_names(t), known, None, reviewed, t.spark.createDataFrame([("depot",)], "name string"))


def _resolved(t: Tables) -> DataFrame:
    """Cities from codes, aliases, names of branches and as they are, then merged."""
    n = b.table(t.spark, t.folder, "nation")
    s = b.table(t.spark, t.folder, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    key, name = F.col("s_suppkey"), F.col("n_name")
    code = F.lpad((1000 + F.col("n_nationkey")).cast("string"), 6, "0")
    city = F.element_at(F.array(code, F.concat(F.lit("'"), name, F.lit("-Yafo'")), F.lit(None).cast("string"), F.lit("99999"), F.concat(F.lit("Upper  "), name), F.lit("unknown")), (key % 6 + 1).cast("int"))
    own = F.when(key % 6 == 2, F.concat(F.lit("BE "), name)).when(key % 6 == 3, F.concat(F.lit("Old "), name)).otherwise("no place")
    rows = s.select(key.alias("store_id"), city.alias("city"), own.alias("store_name"), F.when(key % 2 == 0, "the south road").otherwise("x").alias("address"))
    named = n.select(F.col("n_name").alias("name"))
    half = n.filter("n_nationkey % 2 = 0").select((1000 + F.col("n_nationkey")).cast("string").alias("code"), F.col("n_name").alias("city"))
    rest = n.select((1000 + F.col("n_nationkey")).cast("string").alias("code"), F.concat("n_name", F.lit(" (code)")).alias("name")).unionByName(named.select(F.lit("-").alias("code"), "name"))
    aliases = n.select(F.concat("n_name", F.lit("-Yafo")).alias("alias"), F.col("n_name").alias("city"))
    found = cities.resolve_city(rows, half, aliases, named.select(F.col("name").alias("city")), rest)
    return cities.canonical_city(found, [("NATION_3", "Third"), ("Third", "The Third")], [("Third", "south", "South Third")])


def _products_by_code(t: Tables, share: str = "true") -> DataFrame:
    return t.products.filter(share).select(F.concat(F.lit("9"), F.lpad(F.col("product_id").cast("string"), 12, "0")).alias("barcode"), F.col("product_id").alias("canonical_id"))


def _repeated(t: Tables) -> DataFrame:
    """A flat feed in which an order is one promotion of several rows."""
    order = F.struct("l_linenumber", "l_partkey", "l_extendedprice")
    return promo_feed.extract(raw_promotions(t, "flat").withColumns({"promotionid": F.col("l_orderkey").cast("string"), "ord": order}))


def _flat_load(t: Tables) -> DataFrame:
    promotions, links, _ = feeds.load_promotions(_repeated(t), clean_stores(t), _products_by_code(t))
    told = links.groupBy("promotion_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("canonical_id").cast("string"), 9, "0"), F.col("is_gift").cast("int").cast("string")))), ",").alias("links"))
    return promotions.join(told, "promotion_id", "left").join(clean_stores(t).select("store_id", "store_code"), "store_id").select("store_code", "promo_id_src", "reward_kind", F.coalesce("links", F.lit("")).alias("links"), *dbl("discounted_price", "min_qty"))


def _repriced_lines(t: Tables) -> DataFrame:
    """All lines after promotions; those of items without a live promotion at the branch need not meet any saving."""
    plain = branches.sold(t.marked).filter(~F.col("marked"))
    rows = pricing.repriced_lines(t.promo_lines, t.attributed).unionByName(pricing.unchanged_lines(plain).select(*t.promo_lines.columns, "promotion_id", "original", "saved", "final"))
    return rows.select("basket_id", "store_id", "canonical_id", "promotion_id", *dbl("original", "saved", "final"))


def _versioned(t: Tables) -> DataFrame:
    """The price log in three feeds by time, the second one twice, through a versioned table of the shared folder."""
    log = t.price_log.join(t.stores.select("store_id", "chain_id"), "store_id")
    kept = VersionedTable(t.spark, f"{shared_folder(t.spark)}/prices-{uuid.uuid4()}", ["product_id", "store_id"], ["chain_id"], 2)
    year = F.year("seen")
    for part, number in ((year < 1994, 0), ((year >= 1994) & (year < 1996), 1), ((year >= 1994) & (year < 1996), 1), (year >= 1996, 2)):
        kept.upsert(log.filter(part), b.ORDER, ("log", number))
    return kept.read().select("chain_id", "product_id", "store_id", *dbl("price"))


PRICE_COLUMNS = "barcode, chain_id, store_code, CAST(price AS DOUBLE) AS price, allow_discount, manufacturer"
STRINGS = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'main st ' || p_size || ' , 0' WHEN 1 THEN '0' WHEN 2 THEN '12 - 4' WHEN 3 THEN '\"n/a\"' WHEN 4 THEN 'a' ELSE '''oak road''' END AS raw FROM part"


def _strings(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.when(k % 6 == 0, F.concat(F.lit("main st "), size, F.lit(" , 0"))).when(k % 6 == 1, "0").when(k % 6 == 2, "12 - 4").when(k % 6 == 3, '"n/a"').when(k % 6 == 4, "a").otherwise("'oak road'")
    return _part(t).select("p_partkey", raw.alias("raw"))


def _search(t: Tables) -> DataFrame:
    """Searches by beginnings of barcodes, of words and sizes, and by pieces of names and makers; one is blank."""
    p = _part(t)
    words = F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 3))
    asked = [t.products.select(F.substring("barcode", 1, 12).alias("query")), p.select(F.concat_ws("  ", F.array_join(words, " "), F.col("p_size").cast("string"))), p.select(F.substring("p_name", 2, 4)), p.select(F.expr("substring(p_brand, 2)")), p.select(F.lit(" "))]
    q = asked[0].union(asked[1]).union(asked[2]).union(asked[3]).union(asked[4]).select(tokens.norm_name(F.col("query")).alias("query")).distinct().withColumn("query_id", F.xxhash64("query"))
    found = search.search_products(t.listed, q).join(q, "query_id")
    return found.select("query", "way", "place", "name_norm", "product_id", "availability", "barcode", "manufacturer", "unit_qty", "unit_of_measure", "is_weighted", *dbl("quantity"))


_SHOWN = "min(product_id) AS product_id, CAST(sum(availability) AS BIGINT) AS availability, min(barcode) AS barcode, min(manufacturer) AS manufacturer, min(unit_qty) AS unit_qty, min(unit_of_measure) AS unit_of_measure, bool_or(is_weighted) AS is_weighted, CAST(min(quantity) AS DOUBLE) AS quantity"
SEARCHED = rf"""{CTES}, {b.LISTED}, q AS (SELECT DISTINCT trim(regexp_replace(query, '\s+', ' ', 'g')) AS query, regexp_matches(trim(query), '^[0-9]{{4,}}$') AS code FROM (
    SELECT substring(barcode, 1, 12) AS query FROM products UNION ALL SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: substring(w, 1, 3)), ' ') || ' ' || p_size FROM part
    UNION ALL SELECT substring(p_name, 2, 4) FROM part UNION ALL SELECT substring(p_brand, 2) FROM part) WHERE trim(query) <> ''),
  bycode AS (SELECT query, 'barcode' AS way, name_norm, {_SHOWN} FROM q JOIN listed ON code AND starts_with(barcode, query) GROUP BY ALL),
  names AS (SELECT name_norm, list_distinct(list_filter(string_split_regex(lower(name_norm), '[\s\-/,]+'), lambda w: w <> '')) AS words, {_SHOWN} FROM listed GROUP BY 1),
  t AS (SELECT query, list_distinct(string_split(lower(query), ' ')) AS ts FROM q WHERE NOT code),
  byword AS (SELECT query, 'words' AS way, names.*, len(list_filter(words, lambda w: list_contains(ts, w))) AS whole FROM t JOIN names ON len(list_filter(ts, lambda t: len(list_filter(words, lambda w: starts_with(w, t))) = 0)) = 0),
  inside AS (SELECT query, 'substring' AS way, name_norm, {_SHOWN} FROM q JOIN listed ON NOT code AND query NOT IN (SELECT query FROM byword) AND (contains(lower(name_norm), lower(query)) OR contains(lower(manufacturer), lower(query))) GROUP BY ALL),
  every AS (SELECT *, 0 AS whole FROM bycode UNION ALL SELECT * EXCLUDE (words) FROM byword UNION ALL BY NAME SELECT *, 0 AS whole FROM inside),
  placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY way <> 'barcode' AND starts_with(lower(name_norm), lower(query)) DESC, availability DESC, whole DESC, length(name_norm), product_id) AS place FROM every)
  SELECT * EXCLUDE (whole) FROM placed WHERE place <= 10"""


def _two_runs(t: Tables):
    """A run for two chains, then one for three others over what it left; names get longer before the second run."""
    first = canonical.resolve(t.listed, chains=["1", "2"], prices=t.prices, stores=t.stores)
    longer = t.listed.withColumn("name_norm", F.when(F.col("product_id") % 17 == 0, "").otherwise(F.col("name_norm"))).withColumn("name", F.when(F.col("product_id") % 2 == 0, F.concat("name", F.lit("  "))).otherwise(F.col("name")))
    return canonical.resolve(longer, first[0], first[1], ["2", "3", "4"], t.prices, t.stores)


_FILLED = ", ".join(f"coalesce(arg_max_null({c}, (length(name), -product_id)), min({c})) AS {a}" for c, a in (("manufacturer", "brand"), ("quantity", "net_qty"), ("unit_qty", "unit"))) + ", arg_max(is_weighted, (length(name), -product_id)) AS is_weighted"
TWO_RUNS = f"""{CTES}, {b.LISTED}, runs AS (
  SELECT 1 AS run, * FROM listed WHERE product_id IN (SELECT product_id FROM prices JOIN stores USING (store_id) WHERE chain_id IN ('1', '2'))
  UNION ALL SELECT 2, * REPLACE (CASE WHEN product_id % 2 = 0 THEN name || '  ' ELSE name END AS name, CASE WHEN product_id % 17 = 0 THEN '' ELSE name_norm END AS name_norm) FROM listed WHERE product_id IN (SELECT product_id FROM prices JOIN stores USING (store_id) WHERE chain_id IN ('2', '3', '4')))"""


def _codes(t: Tables):
    """Codes of a feed: a seventh of its items is unknown, an eleventh of the known ones has no canonical item."""
    rows = t.price_log.select(F.when(F.col("product_id") % 7 == 0, F.concat(F.lit("x"), F.col("product_id").cast("string"))).otherwise(F.lpad(F.col("product_id").cast("string"), 13, "0")).alias("barcode"))
    return canonical.resolve_codes(rows, t.products, canonical.map_products(t.products.filter("product_id % 11 <> 0")))


CODES = f"""{CTES}, codes AS (SELECT x.barcode, p.product_id FROM (SELECT CASE WHEN product_id % 7 = 0 THEN 'x' || product_id ELSE lpad(CAST(product_id AS VARCHAR), 13, '0') END AS barcode FROM price_log) x
  LEFT JOIN (SELECT * FROM products WHERE product_id % 11 <> 0) p USING (barcode))"""


QUERIES = {
    "a9_load_stores": (lambda t: clean_stores(t).select("chain_id", "chain_name", "sub_chain_id", "store_code", "store_name", "address"), STORES),
    "a10_load_prices": (
        lambda t: feeds.load_prices(raw_prices(t), clean_stores(t))[1].join(clean_stores(t).select("store_id", "store_code"), "store_id").select("barcode", "store_code", "allow_discount", F.date_format("price_update_time", "yyyy-MM-dd").alias("day"), *dbl("price")),
        f"WITH {RAW_PRICES} SELECT barcode, store_code, allow_discount, strftime(updated, '%Y-%m-%d') AS day, CAST(price AS DOUBLE) AS price FROM raw QUALIFY row_number() OVER (PARTITION BY barcode, store_code ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1",
    ),
    "a10_load_products": (
        lambda t: feeds.load_prices(raw_prices(t), clean_stores(t))[0].select("barcode", "name", "manufacturer"),
        f"WITH {RAW_PRICES} SELECT barcode, any_value(name) AS name, any_value(manufacturer) AS manufacturer FROM raw GROUP BY 1",
    ),
    "a11_load_promotions": (
        lambda t: feeds.load_promotions(_headers(t, "items"), clean_stores(t), t.products.select(F.concat(F.lit("9"), F.lpad(F.col("product_id").cast("string"), 12, "0")).alias("barcode"), F.col("product_id").alias("canonical_id")))[0].join(clean_stores(t).select("store_id", "store_code"), "store_id").select("chain_id", "store_code", "promo_id_src", "reward_kind", *dbl("discount_rate", "min_qty")),
        f"WITH {GROUPED} SELECT '3' AS chain_id, store_code, CAST(l_orderkey AS VARCHAR) AS promo_id_src, CASE WHEN n > 3 THEN 'NTH_FREE' ELSE 'UNKNOWN' END AS reward_kind, 30.5::DOUBLE AS discount_rate, 0.5::DOUBLE AS min_qty FROM own WHERE store_code IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 7 = 3)",
    ),
    "a6_versioned_prices": (_versioned, f"{CTES} SELECT chain_id, product_id, store_id, CAST(price AS DOUBLE) AS price FROM prices JOIN stores USING (store_id)"),
    "a11_flat_promotions": (
        _flat_load,
        """WITH x AS (
          SELECT *, CAST(l_suppkey % 20 AS VARCHAR) AS store_code, l_linenumber AS n FROM lineitem WHERE l_suppkey % 20 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 3)
        ), h AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey, store_code ORDER BY n DESC, l_partkey DESC, l_extendedprice DESC) = 1),
        k AS (SELECT DISTINCT l_orderkey, store_code, lpad(CAST(l_partkey AS VARCHAR), 9, '0') || ':' || CASE WHEN n = 3 THEN 1 ELSE 0 END AS link FROM x WHERE n % 5 <> 0 AND l_partkey IN (SELECT p_partkey FROM part)),
        g AS (SELECT l_orderkey, store_code, string_agg(link, ',' ORDER BY link) AS links FROM k GROUP BY 1, 2)
        SELECT store_code, CAST(l_orderkey AS VARCHAR) AS promo_id_src, CASE WHEN n = 3 THEN 'NTH_FREE' WHEN n = 2 THEN 'BUNDLE_PRICE' WHEN n % 2 = 0 THEN 'FIXED_PRICE' ELSE 'UNKNOWN' END AS reward_kind, coalesce(links, '') AS links,
          CASE WHEN n % 2 = 0 THEN 1009.9::DOUBLE END AS discounted_price, CASE WHEN n = 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS min_qty FROM h LEFT JOIN g USING (l_orderkey, store_code)""",
    ),
    "d4_promotion_counters": (
        lambda t: feeds.promotion_counters(_repeated(t), clean_stores(t), _products_by_code(t, "product_id % 3 <> 0")),
        """WITH x AS (SELECT *, CAST(l_suppkey % 20 AS VARCHAR) AS store_code, l_suppkey % 20 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 3) AS known FROM lineitem),
        c AS (SELECT DISTINCT l_partkey FROM x WHERE known AND l_linenumber % 5 <> 0)
        SELECT (SELECT count(*) FROM x) AS rows, (SELECT count(*) FROM x WHERE NOT known) AS no_store, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, store_code FROM x WHERE known)) AS promotions,
          (SELECT count(*) FROM c) AS items, (SELECT count(*) FROM c WHERE l_partkey % 3 = 0 OR l_partkey NOT IN (SELECT p_partkey FROM part)) AS items_unresolved""",
    ),
    "a12_dry_run": (
        lambda t: _dry_counts(t),
        f"WITH {RAW_PRICES} SELECT count(*) AS rows, count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS no_store FROM raw",
    ),
    "b2_clean_address": (lambda t: _strings(t).select("p_partkey", cl.clean_address(F.col("raw")).alias("address")), f"SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN regexp_replace(raw, ' , 0$', '') WHEN p_partkey % 6 = 5 THEN 'oak road' END AS address FROM ({STRINGS})"),
    "b4_to_bool": (lambda t: _strings(t).select("p_partkey", cl.to_bool(F.when(F.col("p_partkey") % 3 == 0, " TRUE ").when(F.col("p_partkey") % 3 == 1, "no")).alias("flag")), "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM part"),
    "b6_normalize_price": (lambda t: feeds.normalize_prices(raw_prices(t)).select("barcode", "chain_id", "store_code", "allow_discount", "manufacturer", *dbl("price")), f"WITH {RAW_PRICES} SELECT {PRICE_COLUMNS} FROM raw"),
    "b7_first_alias": (lambda t: raw_prices(t).select(cl.first_alias(raw_prices(t), "itemname", "nothing", "itemnm").alias("name")).groupBy("name").agg(F.count("*").alias("n")), "SELECT p_name AS name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "b9_normalize_store": (lambda t: feeds.normalize_stores(raw_stores(t), t.spark.createDataFrame([("3", "Three")], "chain_id string, display_name string"), "slug").select("store_code", "chain_name", "city", "ord"), "SELECT CAST(s_suppkey AS VARCHAR) AS store_code, CASE WHEN s_suppkey % 7 = 3 THEN 'Three' WHEN s_suppkey % 5 = 0 THEN 'slug' ELSE 'chain ' || (s_suppkey % 7) END AS chain_name, '''City ' || (s_suppkey % 10) AS city, ord FROM supplier, (SELECT unnest([0, 1]) AS ord) WHERE ord = 0 OR s_suppkey % 4 = 0"),
    "b14_head_predicate": (
        lambda t: t.products.select("product_id", tokens.head_ok(F.lower(tokens.head(F.col("name"))), F.lit("bl")).alias("ok")),
        f"{CTES} SELECT product_id, starts_with(name_norm, 'bl') OR starts_with('bl', split_part(name_norm, ' ', 1)) AS ok FROM products",
    ),
    "b15_size_predicate": (lambda t: t.products.select("product_id", tokens.size_ok(tokens.size_tokens(F.col("name")), F.array(F.lit("12"))).alias("ok")), f"{CTES} SELECT product_id, size_signature = '12' AS ok FROM products"),
    "b17_conditional": (lambda t: t.promotions.select("promotion_id", rules.is_conditional(F.col("description")).alias("conditional")), f"{PROMO} SELECT promotion_id, description = 'offer AR' AS conditional FROM promos"),
    "b18_open_club": (lambda t: t.promotions.select("promotion_id", rules.open_to_all(F.col("club_id")).alias("everybody")), f"{PROMO} SELECT promotion_id, club_id IS NULL AS everybody FROM promos"),
    "c2_product_ids": (lambda t: feeds.product_ids(t.products, raw_prices(t).select(F.regexp_replace("itemcode", "^9(?=.{12}$)", "0").alias("barcode"))), f"{CTES} SELECT DISTINCT barcode, product_id FROM products WHERE barcode IN (SELECT CASE WHEN l_partkey % 5 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE lpad(CAST(l_partkey AS VARCHAR), 13, '0') END FROM lineitem)"),
    "c9_dead_links": (
        lambda t: canonical.dead_links(t.promotion_items, t.products.filter("product_id % 3 = 0").select(F.col("product_id").alias("canonical_id"))).groupBy("canonical_id").agg(F.count("*").alias("links")),
        f"{PROMO} SELECT canonical_id, count(*) AS links FROM promo_items WHERE canonical_id % 3 <> 0 GROUP BY 1",
    ),
    "d4_load_counters": (lambda t: _counters(t), f"WITH {RAW_PRICES} SELECT chain_id, count(*) AS rows, count(DISTINCT barcode) AS products, count(*) FILTER (s_suppkey IS NULL) AS no_store FROM raw LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 2 = 0 GROUP BY 1"),
    "d5_outcome_gate": (
        lambda t: quality.outcome_gate(_runs(t), 26),
        "SELECT unnest(list_filter([CASE WHEN count(DISTINCT n_name) < 26 THEN 'missing chains' END, CASE WHEN count(*) FILTER (n_nationkey % 3 = 0) = count(*) THEN 'all skipped' END, CASE WHEN count(*) FILTER (n_nationkey % 3 = 1) = 0 THEN 'no price load' END, 'no promotion load'], lambda x: x IS NOT NULL)) AS problem FROM nation",
    ),
    "d15_unmapped_cities": (
        lambda t: cities.unmapped_cities(t.stores, b.table(t.spark, t.folder, "region").filter("r_regionkey < 2").select(F.col("r_name").alias("city"))).select("review_key", "stores"),
        f"{CTES} SELECT trim(city) AS review_key, count(*) AS stores FROM stores WHERE city NOT IN (SELECT r_name FROM region WHERE r_regionkey < 2) GROUP BY 1",
    ),
    "d19_prune_report": (
        lambda t: canonical.prune_report(t.products.select(F.col("product_id").alias("canonical_id")), t.products.filter("product_id % 3 = 0").select("product_id", F.col("product_id").alias("canonical_id")), t.promotion_items),
        f"{PROMO} SELECT (SELECT count(*) FROM products WHERE product_id % 3 <> 0) AS orphans, (SELECT count(*) FROM products) AS canonicals, (SELECT count(*) FROM promo_items WHERE canonical_id % 3 <> 0) AS dead_links, (SELECT count(*) FROM promo_items) AS links",
    ),
    "e1_clean_city": (lambda t: raw_stores(t).select("storeid", cl.clean_city(F.col("city")).alias("city")), "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS storeid, '''City ' || (s_suppkey % 10) AS city FROM supplier, (SELECT unnest([0, 1]) AS ord) WHERE ord = 0 OR s_suppkey % 4 = 0"),
    "e3_city_from_name": (lambda t: cities.city_from_name(_named_stores(t), _localities(t).withColumnRenamed("name", "city")), "SELECT s_suppkey AS store_id, n_name AS named_city FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "e4_strict_locality": (
        lambda t: cities.strict_locality(_named_stores(t), _localities(t)),
        "SELECT s_suppkey AS store_id, n_name AS named_city FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 2 AND s_suppkey % 5 NOT IN (0, 2) AND (s_suppkey % 5 <> 1 OR n_name = 'NATION_3')",
    ),
    "e4_locality_runs": (
        _strict,
        """SELECT * FROM (SELECT s_suppkey AS store_id, CASE WHEN s_suppkey % 6 = 2 THEN n.n_name WHEN s_suppkey % 6 IN (3, 4) THEN NULL WHEN s_suppkey % 6 = 0 AND length(n.n_name) = length(o.n_name) THEN NULL
          WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 6 = 1 THEN 'NEW ' || n.n_name ELSE n.n_name END AS named_city
        FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey JOIN nation o ON o.n_nationkey = (n.n_nationkey + 1) % 25) WHERE named_city IS NOT NULL""",
    ),
    "e2_resolve_city": (
        lambda t: _resolved(t).select("store_id", "city"),
        """SELECT store_id, CASE WHEN city = 'NATION_3' THEN CASE WHEN store_id % 2 = 0 THEN 'South Third' ELSE 'The Third' END ELSE city END AS city FROM (
          SELECT s_suppkey AS store_id, CASE s_suppkey % 6 WHEN 0 THEN n_name || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ' (code)' END WHEN 1 THEN n_name WHEN 2 THEN n_name WHEN 3 THEN n_name WHEN 4 THEN 'Upper ' || n_name END AS city
          FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    ),
    "e7_validate_aliases": (lambda t: cities.validate_aliases(t.stores.select(F.col("store_name").alias("alias"), "city"), b.table(t.spark, t.folder, "region").filter("r_regionkey % 2 = 0").select(F.col("r_name").alias("city")))[1], f"{CTES} SELECT store_name AS alias, city FROM stores WHERE city NOT IN (SELECT r_name FROM region WHERE r_regionkey % 2 = 0)"),
    "e8_norm_locality": (lambda t: _part(t).select("p_partkey", cl.norm_locality(F.concat("p_name", F.lit('-"x"  –y'))).alias("name")), "SELECT p_partkey, p_name || ' x y' AS name FROM part"),
    "f1_object_or_array": (
        lambda t: raw_promotions(t, "items").select(F.col("promotionid").alias("promo_id_src"), F.col("storeid"), F.size(promo_feed.as_list(F.col("promotionitems"), "item", promo_feed.ITEM)).alias("items")),
        f"WITH {GROUPED} SELECT CAST(l_orderkey AS VARCHAR) AS promo_id_src, lpad(store_code, 3, '0') AS storeid, CAST(n AS INTEGER) AS items FROM own",
    ),
    "f2_items_family": (
        lambda t: _headers(t, "items").select("promo_id_src", "store_code", "reward_kind", F.size("items").alias("items"), F.size(F.filter("items", lambda x: x["is_gift"])).alias("gifts"), *dbl("discount_rate", "min_qty")),
        f"WITH {GROUPED} SELECT CAST(l_orderkey AS VARCHAR) AS promo_id_src, store_code, CASE WHEN n > 3 THEN 'NTH_FREE' ELSE 'UNKNOWN' END AS reward_kind, CAST(n + CASE WHEN n > 3 THEN 1 ELSE 0 END AS INTEGER) AS items, CASE WHEN n > 3 THEN 1 ELSE 0 END AS gifts, 30.5::DOUBLE AS discount_rate, 0.5::DOUBLE AS min_qty FROM own",
    ),
    "f3_groups_family": (
        lambda t: _headers(t, "groups").select("promo_id_src", "store_code", "reward_kind", *dbl("discount_rate")),
        f"WITH {GROUPED} SELECT CASE WHEN n = 1 THEN CAST(l_orderkey AS VARCHAR) ELSE l_orderkey || '#' || x.l END AS promo_id_src, store_code, CASE WHEN x.p % 2 = 0 THEN 'PCT_OFF' ELSE 'UNKNOWN' END AS reward_kind, CASE WHEN x.p % 2 = 0 THEN 0.305::DOUBLE END AS discount_rate FROM (SELECT l_orderkey, store_code, n, unnest(own) AS x FROM own)",
    ),
    "f4_flat_family": (
        lambda t: _headers(t, "flat").select("promo_id_src", "store_code", "reward_kind", "allow_stacking", F.size("items").alias("items"), F.date_format("starts_at", "yyyy-MM-dd HH:mm").alias("starts_at"), *dbl("discounted_price", "min_qty")),
        """SELECT l_orderkey || '-' || l_linenumber AS promo_id_src, CAST(l_suppkey % 20 AS VARCHAR) AS store_code, CASE WHEN l_linenumber = 3 THEN 'NTH_FREE' WHEN l_linenumber = 2 THEN 'BUNDLE_PRICE' WHEN l_linenumber % 2 = 0 THEN 'FIXED_PRICE' ELSE 'UNKNOWN' END AS reward_kind, l_linenumber % 2 = 0 AS allow_stacking,
        CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE 1 END AS items, CASE WHEN l_linenumber % 2 = 0 THEN '2026-01-02 08:30' ELSE '2026-01-02 00:00' END AS starts_at, CASE WHEN l_linenumber % 2 = 0 THEN 1009.9::DOUBLE END AS discounted_price, CASE WHEN l_linenumber = 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS min_qty FROM lineitem""",
    ),
    "f8_validity": (
        lambda t: raw_promotions(t, "flat").select("promotionid", F.date_format(promo_feed.validity(F.lit(None).cast("string"), F.col("promotionstartdate"), F.col("promotionstarthour")), "yyyy-MM-dd HH:mm:ss").alias("starts_at")),
        "SELECT l_orderkey || '-' || l_linenumber AS promotionid, CASE WHEN l_linenumber % 2 = 0 THEN '2026-01-02 08:30:00' ELSE '2026-01-02 00:00:00' END AS starts_at FROM lineitem",
    ),
    "f11_promo_links": (
        lambda t: promo_feed.promo_links(_headers(t, "items"), t.products.select(F.concat(F.lit("9"), F.lpad(F.col("product_id").cast("string"), 12, "0")).alias("barcode"), F.col("product_id").alias("canonical_id"))),
        f"WITH {GROUPED}, x AS (SELECT l_orderkey, store_code, own[1].p AS first, n, unnest(own) AS x FROM own) SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS promo_id_src, '3' AS chain_id, store_code, x.p AS canonical_id, false AS is_gift FROM x UNION SELECT CAST(l_orderkey AS VARCHAR), '3', store_code, first, true FROM x WHERE n > 3",
    ),
    "g4_resolve_for_chains": (
        lambda t: canonical.map_products(canonical.products_for_chains(t.products, t.prices, t.stores, ["4", "5"])).select("product_id", "match_method"),
        f"{CTES} SELECT product_id, CASE WHEN size_signature <> '' THEN 'exact_name' ELSE 'name_only' END AS match_method FROM products WHERE name_norm <> '' AND product_id IN (SELECT product_id FROM prices JOIN stores USING (store_id) WHERE chain_id IN ('4', '5'))",
    ),
    "g6_chain_ids": (
        lambda t: _chain_ids(t),
        "SELECT 'file ' || (s_suppkey % 9) AS file, arg_min(CASE WHEN s_suppkey % 5 = 1 THEN s_suppkey % 7 ELSE s_suppkey % 7 END, s_suppkey) FILTER (s_suppkey % 5 > 1)::VARCHAR AS chain_id FROM supplier GROUP BY 1 HAVING count(*) FILTER (s_suppkey % 5 > 1) > 0",
    ),
    "h3_substring_search": (
        lambda t: _substring(t),
        f"{CTES}, q AS (SELECT DISTINCT substring(p_name, 2, 2) AS query FROM part UNION SELECT DISTINCT substring(p_name, 3, 4) FROM part UNION SELECT DISTINCT substring(p_brand, 4, 4) FROM part), f AS (SELECT name_norm, min(product_id) AS product_id, lower(name_norm) AS n, list_distinct(list(lower(manufacturer))) AS makers FROM products GROUP BY name_norm), m AS (SELECT query, name_norm, n, p.product_id FROM q JOIN (SELECT name_norm, lower(name_norm) AS n, lower(manufacturer) AS maker, product_id FROM products) p ON contains(n, trim(lower(query))) OR contains(maker, trim(lower(query))) WHERE trim(query) <> ''), g AS (SELECT query, name_norm, n, min(product_id) AS product_id FROM m GROUP BY ALL) SELECT query, row_number() OVER (PARTITION BY query ORDER BY starts_with(n, trim(lower(query))) DESC, length(name_norm), product_id) AS place, name_norm, product_id FROM g QUALIFY place <= 5",
    ),
    "h_search_products": (_search, SEARCHED),
    "h3_after_words": (
        lambda t: _search(t).filter("way = 'substring'").groupBy("query").agg(F.count("*").alias("names"), F.min("product_id").alias("product_id")),
        f"WITH found AS ({SEARCHED}) SELECT query, count(*) AS names, min(product_id) AS product_id FROM found WHERE way = 'substring' GROUP BY 1",
    ),
    "g4_two_runs": (
        lambda t: _two_runs(t)[0].select("name_norm", "size_signature", "canonical_name", "brand", "unit", "is_weighted", "member_count", *dbl("net_qty")),
        f"""{TWO_RUNS}, g AS (SELECT name_norm, size_signature, run, arg_max(name, (length(name), -product_id)) AS canonical_name, {_FILLED} FROM runs WHERE name_norm <> '' GROUP BY ALL),
        a AS (SELECT * FROM g WHERE run = 1), z AS (SELECT * FROM g WHERE run = 2)
        SELECT name_norm, size_signature, CASE WHEN a.canonical_name IS NULL OR length(z.canonical_name) > length(a.canonical_name) THEN z.canonical_name ELSE a.canonical_name END AS canonical_name, coalesce(a.brand, z.brand) AS brand, coalesce(a.unit, z.unit) AS unit,
          coalesce(a.is_weighted, z.is_weighted) AS is_weighted, CAST(coalesce(a.net_qty, z.net_qty) AS DOUBLE) AS net_qty, (SELECT count(DISTINCT product_id) FROM runs r WHERE r.name_norm = coalesce(a.name_norm, z.name_norm) AND r.size_signature = coalesce(a.size_signature, z.size_signature)) AS member_count
        FROM a FULL JOIN z USING (name_norm, size_signature)""",
    ),
    "g4_run_counters": (
        lambda t: _two_runs(t)[2],
        f"{TWO_RUNS} SELECT count(*) FILTER (name_norm <> '') AS products, count(DISTINCT (name_norm, size_signature)) FILTER (name_norm <> '') AS canonical, count(*) FILTER (name_norm <> '' AND size_signature = '' AND len(list_filter(string_split(name_norm, ' '), lambda w: length(w) > 1)) < 3) AS review, count(*) FILTER (name_norm = '') AS skipped FROM runs WHERE run = 2",
    ),
    "c1_prices_of_stores": (
        lambda t: feeds.resolve_store(feeds.normalize_prices(raw_prices(t)), _two_sub_chains(t))[0].join(_two_sub_chains(t).select("store_id", "sub_chain_id"), "store_id").groupBy("chain_id", "store_code").agg(F.count("*").alias("n"), F.countDistinct("sub_chain_id").alias("sub_chains")),
        f"WITH {RAW_PRICES} SELECT chain_id, store_code, count(*) AS n, 1 AS sub_chains FROM raw WHERE l_suppkey % 2 = 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2",
    ),
    "d4_observed_load": (lambda t: _dry_counts(t, _two_sub_chains(t)), f"WITH {RAW_PRICES} SELECT count(*) AS rows, count(*) FILTER (l_suppkey % 2 <> 0 OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS no_store FROM raw"),
    "c3_codes_of_items": (
        lambda t: _codes(t)[0].groupBy("barcode").agg(F.count("*").alias("rows"), F.count("canonical_id").alias("resolved")),
        f"{CODES} SELECT barcode, count(*) AS rows, count(product_id) AS resolved FROM codes GROUP BY 1",
    ),
    "c3_missed_codes": (lambda t: _codes(t)[1], f"{CODES} SELECT DISTINCT barcode FROM codes WHERE product_id IS NULL"),
    "j1_eligible_promotions": (
        lambda t: pricing.covered_lines(t.promo_lines, t.live, t.items).select("basket_id", "store_id", "promotion_id", "canonical_id", "is_gift"),
        f"{PROMO} SELECT basket_id, store_id, promotion_id, canonical_id, is_gift FROM touched",
    ),
    "j8_promotions_that_save": (
        lambda t: t.found.select("basket_id", "store_id", "promotion_id", "canonical_id", *dbl("used", "saving")),
        f"{PROMO} SELECT basket_id, store_id, promotion_id, canonical_id, CAST(used AS DOUBLE) AS used, CAST(saving AS DOUBLE) AS saving FROM found",
    ),
    "j10_bound_promotions": (
        lambda t: t.found.join(t.found.filter("items > 1 and canonical_id is not null").select("basket_id", "store_id", "canonical_id").distinct(), ["basket_id", "store_id", "canonical_id"], "left_semi").select("basket_id", "store_id", "promotion_id").distinct(),
        f"{PROMO} SELECT basket_id, store_id, promotion_id FROM heads",
    ),
    "j14_worth_advertising": (
        lambda t: t.promo_lines.join(t.items.filter("not is_gift").join(t.live, "promotion_id"), ["store_id", "canonical_id"]).filter(pricing.worth_advertising(*(F.col(c) for c in ("reward_kind", "discounted_price", "discount_rate", "min_qty", "unit_price", "chain_id", "description")))).select("basket_id", "store_id", "canonical_id", "promotion_id"),
        f"{PROMO} SELECT l.basket_id, l.store_id, l.canonical_id, v.promotion_id FROM plines l JOIN promo_items i ON i.canonical_id = l.canonical_id AND NOT is_gift JOIN live v ON v.store_id = l.store_id AND v.promotion_id = i.promotion_id WHERE {ADVERTISED}",
    ),
    "j13_repriced_lines": (
        _repriced_lines,
        f"{PROMO} SELECT * REPLACE (CAST(original AS DOUBLE) AS original, CAST(saved AS DOUBLE) AS saved), CAST(original - saved AS DOUBLE) AS final FROM (SELECT l.basket_id, l.store_id, l.canonical_id, a.promotion_id, CAST(round(unit_price * quantity, 2) AS DECIMAL(18,2)) AS original, CAST(least(round(coalesce(saved, 0), 2), round(unit_price * quantity, 2)) AS DECIMAL(18,2)) AS saved FROM plines l LEFT JOIN attributed a ON a.basket_id = l.basket_id AND a.store_id = l.store_id AND a.canonical_id = l.canonical_id)",
    ),
    "j13_applied_list": (
        lambda t: pricing.applied_list(t.applied, t.live).select("basket_id", "store_id", F.array_join(F.transform("applied", lambda x: x["promotion_id"].cast("string")), ",").alias("applied")),
        f"{PROMO} SELECT basket_id, store_id, string_agg(promotion_id, ',' ORDER BY saving DESC, promotion_id) AS applied FROM (SELECT DISTINCT basket_id, store_id, promotion_id, saving FROM applied) GROUP BY 1, 2",
    ),
}


def _two_sub_chains(t: Tables) -> DataFrame:
    """The branches with even codes, each under two sub-chains; prices name no sub-chain."""
    even = clean_stores(t).filter(F.col("store_code").cast("int") % 2 == 0)
    again = even.withColumn("sub_chain_id", F.lit("9")).withColumn("store_id", feeds.store_id(F.col("chain_id"), F.col("sub_chain_id"), F.col("store_code")))
    return even.unionByName(again)


def _dry_counts(t: Tables, stores: DataFrame | None = None) -> DataFrame:
    """The counters of a load of which nothing is written."""
    _, prices, watched = feeds.load_prices(raw_prices(t), clean_stores(t) if stores is None else stores)
    feeds.dry_run(prices)
    got = watched.get
    return t.spark.createDataFrame([(got["rows"], got["no_store"])], "rows long, no_store long")


def _counters(t: Tables) -> DataFrame:
    stores = clean_stores(t).filter(F.col("store_code").cast("int") % 2 == 0).select("chain_id", "store_code", F.lit(1).alias("known"))
    rows = feeds.normalize_prices(raw_prices(t)).join(stores, ["chain_id", "store_code"], "left")
    return rows.groupBy("chain_id").agg(F.count("*").alias("rows"), F.countDistinct("barcode").alias("products"), F.count_if(F.col("known").isNull()).alias("no_store"))


def _chain_ids(t: Tables) -> DataFrame:
    from basketlens.sources.feeds import chain_ids

    key = F.col("s_suppkey")
    raw = b.table(t.spark, t.folder, "supplier").select(F.concat(F.lit("file "), (key % 9).cast("string")).alias("file"), key.alias("ord"), F.when(key % 5 == 0, "None").when(key % 5 == 1, " ").otherwise(F.concat(F.lit(" "), (key % 7).cast("string"))).alias("chainid"))
    return chain_ids(raw)


def _substring(t: Tables) -> DataFrame:
    p = _part(t)
    q = p.select(F.substring("p_name", 2, 2).alias("query")).union(p.select(F.substring("p_name", 3, 4))).union(p.select(F.substring("p_brand", 4, 4))).distinct().withColumn("query_id", F.xxhash64("query"))
    found = search.substring_search(t.products, q, q.limit(0), 5)
    return found.join(q, "query_id").select("query", "place", "name_norm", "product_id")


def queries():
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, (f, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
