"""Raw feeds: tolerant CSV scans with row ordinals, grouped identity columns, and files by chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns that only the first row of a block carries.
IDENTITY = ("found_folder", "file_name", "chainid", "chainname", "subchainid", "subchainname", "storeid", "bikoretno", "lastupdatedate", "lastupdatetime")


def read_feed(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], splittable: bool = False) -> DataFrame:
    """All columns as strings, rows with another number of fields dropped, with ``file`` and ``ord``.

    Quoted line feeds need whole files; ``splittable`` reads feeds without them in parts.
    ``ord`` sorts rows of a file as they stand there.
    """
    schema = ", ".join(f"`{c}` string" for c in columns) + ", `_bad` string"
    read = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("escape", '"').option("multiLine", not splittable).option("enforceSchema", True)
    rows = read.csv(list(paths) if not isinstance(paths, str) else paths)
    # the mark of bad rows stays selected up to the filter: a pruned scan would not parse them
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"))
    # ... and Spark refuses to read that mark alone, as a plain count would: a column that is always read goes with it
    return rows.filter(F.col("_bad").isNull() & (F.char_length(F.concat_ws("", F.col(f"`{columns[0]}`"))) >= 0)).drop("_bad")


def read_feeds(spark: SparkSession, paths: Sequence[str], splittable: bool = False) -> DataFrame:
    """Feeds whose columns differ in names and order: each file is read by its own header (lower-cased), and what a file lacks is null."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        names = spark.read.option("header", True).option("multiLine", not splittable).csv(path).columns
        by_header.setdefault(tuple(n.strip().lstrip("\ufeff").lower() for n in names), []).append(path)
    parts = [read_feed(spark, own, list(names), splittable) for names, own in by_header.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def chain_ids(raw: DataFrame) -> DataFrame:
    """``file, chain_id``: the first chain id of each store feed that is one."""
    own = F.trim("chainid")
    good = F.col("chainid").isNotNull() & ~F.lower(own).isin("", "none", "null")
    return raw.filter(good).groupBy("file").agg(F.min_by(own, F.col("ord")).alias("chain_id"))


def chain_files(spark: SparkSession, folder: str, slugs: Sequence[str], full: bool = False) -> dict[str, dict[str, str]]:
    """Existing store, price and promotion files of each chain; promotions fall back from full to snapshot files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in fs.listStatus(path)}
    out: dict[str, dict[str, str]] = {}
    for slug in slugs:
        wanted = {"stores": [f"store_file_{slug}.csv"], "prices": [f"price_full_file_{slug}.csv" if full else f"price_file_{slug}.csv"], "promotions": ([f"promo_full_file_{slug}.csv"] if full else []) + [f"promo_file_{slug}.csv"]}
        found = {kind: f"{folder}/{name}" for kind, names in wanted.items() for name in reversed(names) if name in there}
        if found:
            out[slug] = found
    return out


#: Names of feed files: what they hold, and the chain's slug.
FEED_NAME = r"^(store|price|promo)(_full)?_file_(.+)\.csv$"
KINDS = {"store": "stores", "price": "prices", "promo": "promotions"}
CHAIN_FIELDS = "slug string, name string, enabled boolean, reason string"


def chain_config(spark: SparkSession, path: str, fallback: Sequence[str] = ()) -> DataFrame:
    """``slug, name, enabled, reason`` of a JSON file with ``chains``; a chain is enabled unless it says otherwise, and named by its slug unless it has a name.

    Entries without a slug are left out.  Where the file is missing or no such JSON, the slugs of ``fallback`` are all there is.
    """
    known = spark.createDataFrame([(s, s, True, None) for s in fallback], CHAIN_FIELDS)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return known
    read = spark.read.schema(f"chains array<struct<{CHAIN_FIELDS.replace(' ', ': ').replace(',: ', ', ')}>>").json(path, multiLine=True)
    rows = read.select(F.inline("chains")).filter("slug <> ''")
    rows = rows.select("slug", F.coalesce(F.nullif("name", F.lit("")), "slug").alias("name"), F.coalesce("enabled", F.lit(True)).alias("enabled"), "reason")
    return known if rows.isEmpty() else rows


def chain_problems(config: DataFrame) -> DataFrame:
    """``slug, problem``: chains named twice, which would be loaded twice, and chains put aside without a reason."""
    each = config.groupBy("slug").agg(F.count("*").alias("n"), F.max(~F.col("enabled") & F.coalesce(F.trim("reason") == "", F.lit(True))).alias("silent"))
    found = F.filter(F.array(F.when(F.col("n") > 1, "twice"), F.when(F.col("silent"), "no reason")), lambda x: x.isNotNull())
    return each.select("slug", F.explode(found).alias("problem"))


def read_chains(spark: SparkSession, folder: str, config: DataFrame, kind: str, full: bool = False, splittable: bool = False) -> DataFrame | None:
    """The feeds of one kind (``stores``, ``prices``, ``promotions``) of all enabled chains as one table with ``slug`` and ``chain_label``.

    A chain without that file is passed over, and promotions fall back from the full to the
    snapshot file (:func:`chain_files`).  None if no chain has a file.  The list of chains is driver-sized, feeds are not read for it.
    """
    names = {r["slug"]: r["name"] for r in config.filter("enabled").select("slug", "name").distinct().collect()}
    paths = [own[kind] for own in chain_files(spark, folder, sorted(names), full).values() if kind in own]
    if not paths:
        return None
    rows = read_feeds(spark, paths, splittable)
    name = F.regexp_extract(F.col("file"), r"([^/]*)$", 1)
    slug = F.url_decode(F.regexp_extract(name, FEED_NAME, 3))
    label = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("slug")]
    return rows.withColumn("slug", slug).withColumn("chain_label", label)


def _blank(c: Column) -> Column:
    return c.isNull() | F.regexp_replace(c, r"(?U)^\s+|\s+$", "").isin("", "''", '""')


def forward_fill(df: DataFrame, columns: Sequence[str], file: str, order: str, block: Column | None = None) -> DataFrame:
    """Blank values of ``columns`` take the last value above them in their file.

    With ``block`` (which must ascend with the order) rows are filled within blocks
    first, and each block then takes what earlier blocks leave: no file is sorted by
    one task.
    """
    if block is None:
        above = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(F.when(~_blank(F.col(c)), F.col(c)), ignorenulls=True).over(above) for c in columns})
    rows = df.withColumn("__block", block)
    within = Window.partitionBy(file, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({c: F.last(F.when(~_blank(F.col(c)), F.col(c)), ignorenulls=True).over(within) for c in columns})
    lasts = rows.groupBy(file, "__block").agg(*(F.max_by(F.col(c), F.when(~_blank(F.col(c)), F.col(order))).alias(c) for c in columns))
    before = Window.partitionBy(file).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(file, "__block", *(F.last(c, ignorenulls=True).over(before).alias(f"__{c}") for c in columns))
    joined = filled.join(carried, [file, "__block"], "left")
    return joined.select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns))
