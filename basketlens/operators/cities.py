"""One spelling for each city.  Codes, aliases, localities and merges are tables, not code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.cleaning import clean_city, norm_locality


# How chains mark their branches' names, and words after which a locality names a venue.
CHAIN_PREFIXES = (
    "אקספרס", "יש חסד", "יש בשכונה", "שופרסל דיל", "שופרסל שלי", "שופרסל אונליין", "שופרסל", "נטו חיסכון", "וולט מרקט",
    "סיטי מרקט", "דור אלון", "סופר יודה", "טיב טעם", "יוחננוף", "קרפור", "דיל", "שלי", "BE", "Be", "be",
)
VENUE_WORDS = ("קניון", "חוצות", "מתחם", "פנינת", "מרכז מסחרי", "מרכז", "סי סנטר", "פארק")
# What separates the segments of a name or an address, the mark of online branches, and what is stripped behind a chain's mark.
SEPARATORS = r"[-–—|,/*]+"
ONLINE = r"(?i)^(אונליין|online)\s*[-|]\s*"
AROUND = r"^[ \-|,.*]+|[ \-|,.*]+$"


#: Words of a city's name, at most; no locality has as many.
LONGEST = 8


def merge_closure(merges: list[tuple[str, str]]) -> dict[str, str]:
    """Where each alias ends when merges are followed; a cycle ends where it is met again."""
    step = dict(merges)
    out = {}
    for start in step:
        seen, at = {start}, step[start]
        while at in step and at not in seen:
            seen.add(at)
            at = step[at]
        out[start] = at
    return out


def canonical_city(stores: DataFrame, merges: list[tuple[str, str]], by_address: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Merged cities.  ``by_address`` rules (city, text in the address, city) come before the merge of a city, wherever in a chain of merges it is met."""
    ends, step = merge_closure(merges), dict(merges)
    rules: dict[str, list[tuple[str, str]]] = {}
    for old, text, new in by_address:
        rules.setdefault(old, []).append((text, ends.get(new, new)))
    table = []
    for start in dict.fromkeys([*step, *rules]):
        seen, at, own = set(), start, []
        while at not in seen:
            seen.add(at)
            own += rules.get(at, [])
            at = step.get(at, at)
        table.append((start, own, ends.get(start, start)))
    merged = stores.sparkSession.createDataFrame(table, "__from string, __rules array<struct<text: string, city: string>>, __to string")
    address = F.coalesce(clean_city(F.col("address")), F.lit(""))
    rows = stores.join(merged, F.col("city") == F.col("__from"), "left")
    told = F.get(F.filter("__rules", lambda r: F.contains(address, r["text"])), 0)["city"]
    return rows.withColumn("city", F.coalesce(told, "__to", "city")).drop("__from", "__rules", "__to")


def city_from_name(stores: DataFrame, cities: DataFrame) -> DataFrame:
    """``store_id, named_city``: the longest known city in the store's name, as whole words.

    Runs of up to ``LONGEST`` words are looked up, so that this is an equi-join.
    """
    words = F.split(norm_locality(F.col("store_name")), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size(words))), lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    named = stores.filter("store_name is not null").select("store_id", F.explode(F.array_distinct(runs)).alias("run"))
    known = cities.select(F.col("city").alias("named_city"), norm_locality(F.col("city")).alias("run")).distinct()
    rows = named.join(known, "run")
    best = F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc(F.char_length("run")), "named_city"))
    return rows.withColumn("__best", best).filter("__best = 1").select("store_id", "named_city")


def _literal(words: tuple[str, ...]) -> str:
    """A pattern for any of some words, longer ones first."""
    return "(?:" + "|".join(rf"\Q{w}\E" for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def _segments(c: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(clean_city(c), F.lit("")), r"\([^)]*\)", " ")
    return F.filter(F.transform(F.split(plain, SEPARATORS), norm_locality), lambda x: x != "")


def corroborated(locality: Column, store_name: Column, address: Column, elsewhere: Column) -> Column:
    """False where a locality is part of a venue's name or of a street with a number, or where the address names others only.

    ``elsewhere`` is the array of localities that the address names.
    """
    quoted = F.concat(F.lit(r"\Q"), locality, F.lit(r"\E"))
    text = lambda c: norm_locality(F.coalesce(clean_city(c), F.lit("")))
    venue = F.lit(False)
    for field in (store_name, address):
        venue = venue | F.rlike(text(field), F.concat(F.lit(_literal(VENUE_WORDS) + r"\s+"), quoted))
    street = F.rlike(text(address), F.concat(quoted, F.lit(r"\s+\d")))
    other = (F.size(elsewhere) > 0) & ~F.array_contains(elsewhere, locality)
    return ~(venue | street | other)


def locality_index(localities: DataFrame, aliases: DataFrame | None = None, reviewed: DataFrame | None = None) -> DataFrame:
    """``key, locality, reviewed``: what a text names.  Reviewed aliases go before localities (``name``), these before other aliases (``alias, city``)."""
    parts = [localities.select(F.col("name").alias("text"), F.col("name").alias("locality"), F.lit(1).alias("place"))]
    for table, place in ((reviewed, 0), (aliases, 2)):
        if table is not None:
            parts.append(table.select(F.col("alias").alias("text"), F.col("city").alias("locality"), F.lit(place).alias("place")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("key", norm_locality(F.col("text"))).filter("key <> ''")
    return rows.groupBy("key").agg(F.min_by("locality", F.struct("place", "locality")).alias("locality"), (F.min("place") == 0).alias("reviewed"))


def _runs(segments: Column) -> Column:
    """Neighbouring segments joined by a blank, longer runs first, from left to right."""
    n = F.size(segments)
    lengths = F.reverse(F.sequence(F.lit(1), n))
    each = F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(segments, i, k), " ")))
    return F.when(n >= 2, F.flatten(each)).otherwise(F.array().cast("array<string>"))


def strict_locality(stores: DataFrame, localities: DataFrame, aliases: DataFrame | None = None, reviewed: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """``store_id, named_city``: the locality that a branch's name consists of once the chain's mark is gone; never a guess.

    In this order: the name as it is, without the chain's mark, without the mark of online
    branches - each as a whole, and a name that ``blocked`` (``name``) holds ends the search; then for each of these
    the segments that a reviewed alias names, then runs of neighbouring segments without venue words in front.
    The longest run that is a locality wins, unless another locality of as many letters is among the runs.
    A locality that the name or the address speaks against is none, but for reviewed aliases.
    """
    index = locality_index(localities, aliases, reviewed)
    raw = clean_city(F.col("store_name"))
    plain = F.regexp_replace(raw, ONLINE, "")
    marked = "^" + _literal(CHAIN_PREFIXES)
    bare = F.when(plain.rlike(marked), F.regexp_replace(F.regexp_replace(plain, marked, ""), AROUND, ""))
    names = F.array(raw, bare, plain)
    tries = stores.filter(raw.isNotNull()).select("store_id", "store_name", "address", F.posexplode(names).alias("at", "name")).filter("name is not null")
    segments = F.filter(F.transform(F.split("name", SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")
    free = F.transform("segments", lambda x: F.regexp_replace(x, "^" + _literal(VENUE_WORDS) + r"\s+", ""))
    tries = tries.withColumn("segments", segments)
    step = lambda kind, texts: F.transform(texts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), norm_locality(x).alias("key")))
    tries = tries.select("store_id", "at", F.explode(F.concat(step(0, F.array("name")), step(1, F.col("segments")), step(2, _runs(free)))).alias("t")).select("store_id", "at", "t.*").filter("key <> ''")
    rows = tries.join(index, "key", "left")
    rows = rows.withColumn("ends", F.lit(False))
    if blocked is not None:
        bad = blocked.select(F.lower(F.trim("name")).alias("__bad"), F.lit(True).alias("__is")).distinct()
        rows = rows.join(bad, F.lower("key") == F.col("__bad"), "left").withColumn("ends", F.coalesce("__is", F.lit(False)) & (F.col("kind") == 0)).drop("__bad", "__is")
    rows = rows.filter(F.col("ends") | (F.col("locality").isNotNull() & ((F.col("kind") != 1) | F.col("reviewed"))))
    # what each step of the search finds, then the first step that finds something
    hits = rows.groupBy("store_id", F.when(F.col("kind") == 0, F.col("at")).otherwise(10 + 2 * F.col("at") + F.col("kind")).alias("step"), "kind").agg(F.array_sort(F.collect_list(F.struct("place", "ends", "locality", "reviewed"))).alias("hits"))
    first = F.col("hits")[0]
    as_long = F.array_distinct(F.transform(F.filter("hits", lambda h: F.char_length(h["locality"]) == F.char_length(first["locality"])), lambda h: h["locality"]))
    clear = (F.col("kind") != 2) | (F.size(as_long) == 1)
    found = hits.filter(clear).groupBy("store_id").agg(F.min_by(first, "step").alias("hit")).filter(~F.col("hit.ends")).select("store_id", F.col("hit.locality").alias("named_city"), F.col("hit.reviewed").alias("reviewed"))

    rows = stores.select("store_id", "store_name", "address").join(found, "store_id")
    named = rows.select("store_id", F.explode(_segments(F.col("address"))).alias("key")).join(index, "key").groupBy("store_id").agg(F.collect_set("locality").alias("elsewhere"))
    rows = rows.join(named, "store_id", "left").withColumn("elsewhere", F.coalesce("elsewhere", F.array().cast("array<string>")))
    return rows.filter(F.col("reviewed") | corroborated(F.col("named_city"), F.col("store_name"), F.col("address"), F.col("elsewhere"))).select("store_id", "named_city")


def resolve_city(stores: DataFrame, codes: DataFrame, aliases: DataFrame, cities: DataFrame, localities: DataFrame | None = None, reviewed: DataFrame | None = None, blocked: DataFrame | None = None, neighbourhoods: DataFrame | None = None) -> DataFrame:
    """Stores with one spelling of their city.

    A number is a code (``code, city``, else ``code, name`` of ``localities``); another text is
    an alias (``alias, city``; reviewed ones first) or stands as it is.  Without a city or with an unknown
    code the branch's name says it: as a neighbourhood or alias, by a known city in it, or
    by :func:`strict_locality`.  All tables are joined by their keys; merges follow with :func:`canonical_city`.
    """
    rows = stores.withColumn("__city", clean_city(F.col("city")))
    number = F.col("__city").rlike(r"^\d+$")
    code = F.when(number, F.regexp_replace("__city", r"^0+(?=\d)", ""))

    def look(rows: DataFrame, table: DataFrame | None, key: str, value: str, at: Column, out: str) -> DataFrame:
        if table is None:
            return rows.withColumn(out, F.lit(None).cast("string"))
        one = table.groupBy(F.col(key).alias("__key")).agg(F.min(value).alias(out))
        return rows.join(one, at == F.col("__key"), "left").drop("__key")

    rows = look(rows, codes, "code", "city", code, "__of_code")
    rows = look(rows, localities if localities is not None and "code" in localities.columns else None, "code", "name", code, "__of_gazetteer")
    rows = look(rows, reviewed, "alias", "city", F.col("__city"), "__of_reviewed")
    rows = look(rows, aliases, "alias", "city", F.col("__city"), "__of_alias")
    own = clean_city(F.col("store_name"))
    rows = look(rows, neighbourhoods, "name", "city", own, "__hood")
    rows = look(rows, aliases, "alias", "city", own, "__named_alias")
    unsure = stores.filter(clean_city(F.col("city")).isNull() | clean_city(F.col("city")).rlike(r"^\d+$"))
    rows = rows.join(city_from_name(unsure, cities).withColumnRenamed("named_city", "__in_name"), "store_id", "left")
    if localities is not None:
        rows = rows.join(strict_locality(unsure, localities, aliases, reviewed, blocked).withColumnRenamed("named_city", "__strict"), "store_id", "left")
    else:
        rows = rows.withColumn("__strict", F.lit(None).cast("string"))
    by_name = F.coalesce("__hood", "__named_alias", "__in_name", "__strict")
    city = F.when(number, F.coalesce("__of_code", "__of_gazetteer", by_name)).when(F.col("__city").isNull(), by_name).otherwise(F.coalesce("__of_reviewed", "__of_alias", "__city"))
    return rows.withColumn("city", city).select(*stores.columns)


def validate_aliases(aliases: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases whose target is known, and the others."""
    cities = known.select("city").distinct()
    return aliases.join(cities, "city", "left_semi"), aliases.join(cities, "city", "left_anti")


def unmapped_cities(stores: DataFrame, cities: DataFrame) -> DataFrame:
    """Worklist of stores whose city is unknown: ``review_key, stores, examples``, most first."""
    rows = stores.join(cities.select("city").distinct(), "city", "left_anti").withColumn("review_key", F.coalesce(norm_locality(F.coalesce("city", "store_name")), F.lit("")))
    return rows.groupBy("review_key").agg(F.count("*").alias("stores"), F.slice(F.array_sort(F.collect_set("store_name")), 1, 4).alias("examples")).orderBy(F.desc("stores"), "review_key")
