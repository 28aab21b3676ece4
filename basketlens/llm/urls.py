"""URL filters: host and path rules first, then a tree of path templates for each host.

The tree is built from the top, level by level: the children of a node become one
wildcard if they are many and hardly repeat, and what lies below them is counted
together from then on.  Digit runs are wildcards from the start (what stands around
them is kept).  Sibling branches whose labelled shares do not differ significantly
are merged, at every level.  Above the hosts the tree goes on with their suffixes:
``com``, ``example.com``, ``www.example.com``, then the path's nodes down to the template.
The share of labelled bad pages is smoothed from the root down, so that each node
starts from the share of its parent and labels reach templates that have none.
A template is rejected if its share reaches the threshold.

Everything is DataFrame expressions; counts cover all pages, and are summed before
any shuffle, so that a host with a third of all pages is no hot group.  Templates go
back to their pages by a join in which the few paths that a thousandth of all
pages have (a thousand at most) are broadcast.

Defined results: a null url or one without ``://`` has an empty host and path and
the empty template; repeated rows each get their own result; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.frames import cut


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
#: A node with at least so many children, of which each has at most so many pages on average, generalises them.
CHILDREN, PAGES_EACH = 20, 3
#: Virtual labelled pages with the parent's share of bad ones, and the share from which a template is rejected.
SMOOTHING, REJECT = 4.0, 0.8
#: Standard errors within which sibling shares count as the same.
SIMILAR = 2.0
#: Paths that so small a share of all pages has are not broadcast; nodes of a level that are.
HOT_SHARE, BROADCAST = 1000, 100_000
#: Most labels of a host name (RFC 1035); what has more is no name, and only its last ones and the whole are nodes.
LABELS = 127


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the last one decides
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """Segments with digit runs generalised."""
    own = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(own, lambda s: F.regexp_replace(s, r"[0-9a-fA-F]{16,}|[0-9]+", "#"))


def template_tree(paths: DataFrame) -> DataFrame:
    """``paths`` (``host, raw, segments, n``; one row for each path) with their ``template`` in their host's tree.

    A path is followed down as long as its node has enough paths for a wildcard to be possible.
    """
    done = None
    rows = paths.withColumns({"at": F.lit(0), "node": F.lit("")})
    while True:
        child = F.get("segments", F.col("at"))
        children = rows.filter(F.col("at") < F.size("segments")).groupBy("host", "node", child.alias("child")).agg(F.sum("n").alias("n"), F.count("*").alias("paths"))
        nodes = cut(children.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("paths").alias("paths")).filter(F.col("paths") >= CHILDREN).select("host", "node", ((F.col("kinds") >= CHILDREN) & (F.col("n") <= PAGES_EACH * F.col("kinds"))).alias("open")))
        n = nodes.count()
        met = rows.join(F.broadcast(nodes) if n <= BROADCAST else nodes, ["host", "node"], "left")
        step = F.when(F.col("open"), F.lit("*")).otherwise(child)
        going = F.col("open").isNotNull() & (F.col("at") < F.size("segments"))
        rest = F.transform(F.slice("segments", F.col("at") + 1, F.greatest(F.size("segments") - F.col("at"), F.lit(0))), lambda x: F.concat(F.lit("/"), x))
        ended = met.filter(~going).select("host", "raw", "n", F.concat("node", F.array_join(rest, "")).alias("template"))
        done = ended if done is None else done.unionByName(ended)
        if not n:
            return done.withColumn("template", F.when(F.col("template") == "", "/").otherwise(F.col("template")))
        rows = cut(met.filter(going).select("host", "raw", "segments", "n", (F.col("at") + 1).alias("at"), F.concat("node", F.lit("/"), step).alias("node")))


def ancestors(own: DataFrame) -> DataFrame:
    """``host, template, of, level, node, parent`` of all nodes of each template: suffixes of the host, the host, prefixes of the template.

    An address of digits has no suffixes, and a port is none of them.
    """
    names = F.split(F.regexp_replace("host", r":[0-9]*$", ""), r"\.")
    some = F.when(F.col("host").rlike(r"^[0-9.]*(:[0-9]*)?$|^\["), F.lit(0)).otherwise(F.least(F.size(names), F.lit(LABELS)))
    last = lambda k: F.array_join(F.slice(names, -k, k), ".")
    suffixes = F.transform(F.when(some > 0, F.sequence(F.lit(1), some)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.lit("").alias("of"), k.alias("level"), last(k).alias("node"), F.when(k > 1, last(F.greatest(k - 1, F.lit(1)))).otherwise("").alias("parent")))
    top = F.array(F.struct(F.col("host").alias("of"), F.lit(LABELS + 1).alias("level"), F.lit("").alias("node"), F.lit("").alias("parent")))
    hosts = own.select("host").distinct().select("host", F.explode(F.concat(suffixes, top)).alias("x"))
    steps = F.filter(F.split("template", "/"), lambda s: s != "")
    upto = lambda k: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, k), "/"))
    prefixes = F.transform(F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.col("host").alias("of"), (k + LABELS + 1).alias("level"), upto(k).alias("node"), upto(k - 1).alias("parent")))
    return hosts.select("host", F.lit(None).cast("string").alias("template"), "x.*").unionByName(own.select("host", "template", F.explode(prefixes).alias("x")).select("host", "template", "x.*"))


def merged(nodes: DataFrame) -> DataFrame:
    """Labelled counts of ``nodes`` (``of, level, node, parent, n, n_bad``), those of similar siblings summed."""
    family = ["of", "level", "parent"]
    pooled = nodes.groupBy(*family).agg(((F.sum("n_bad") + 1.0) / (F.sum("n") + 2.0)).alias("pooled"))
    error = F.sqrt(F.col("pooled") * (1 - F.col("pooled")) / F.col("n"))
    rows = nodes.join(pooled, family).withColumn("similar", F.abs(F.col("n_bad") / F.col("n") - F.col("pooled")) <= SIMILAR * error)
    sums = rows.filter("similar").groupBy(*family).agg(F.sum("n").alias("all_n"), F.sum("n_bad").alias("all_bad"))
    rows = rows.join(sums, family, "left")
    return rows.select("of", "level", "node", *(F.when(F.col("similar"), F.col(total)).otherwise(F.col(own)).alias(own) for own, total in (("n", "all_n"), ("n_bad", "all_bad"))))


def smoothed(chain: Column, start: Column) -> Column:
    """Share of bad pages at the end of ``chain`` (``level, n, n_bad``), each node smoothed towards the one above."""
    return F.aggregate(F.array_sort(chain), start, lambda share, x: (x["n_bad"] + SMOOTHING * share) / (x["n"] + SMOOTHING))


def template_shares(own: DataFrame) -> DataFrame:
    """``host, template, bad_share``: the smoothed bad share of templates with counts of labelled pages (``host, template, n, n_bad``)."""
    own = cut(own.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")))
    prior = own.agg(((F.coalesce(F.sum("n_bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("prior")).first()["prior"]
    # labels of a host are counted once for its suffixes, those of a template once for its prefixes
    above = ancestors(own)
    upper, lower = above.filter("template is null").drop("template"), above.filter("template is not null")
    host_n = own.groupBy("host").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
    sums = lambda nodes: merged(nodes.filter("n > 0").groupBy("of", "level", "node", "parent").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")))
    chained = lambda nodes, known, keys: nodes.join(known, ["of", "level", "node"]).groupBy(*keys).agg(F.collect_list(F.struct("level", "n", "n_bad")).alias("chain"))
    by_host = chained(upper, sums(upper.join(host_n, "host")), ["host"]).withColumnRenamed("chain", "upper")  # at most LABELS + 1 nodes
    by_path = chained(lower, sums(lower.join(own, ["host", "template"])), ["host", "template"]).withColumnRenamed("chain", "lower")  # as many as segments
    rows = own.join(by_path, ["host", "template"], "left").join(by_host, "host", "left")
    none = F.array().cast("array<struct<level:int,n:bigint,n_bad:bigint>>")
    return rows.select("host", "template", smoothed(F.concat(F.coalesce("upper", none), F.coalesce("lower", none)), F.lit(float(prior))).alias("bad_share"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, bad_share`` of every page (``page_id, url``).

    ``labels`` (``page_id, bad``; one row for each page) says which pages are known
    to be bad (1) or good (0); without it the pages that a rule decides are the labelled ones.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "__verdict": verdict, "__segments": segments(F.col("path"))}).withColumn("raw", F.array_join("__segments", "/"))
    if labels is None:
        labelled = rows.withColumn("bad", F.when(F.col("__verdict") == "block", 1).when(F.col("__verdict") == "allow", 0))
    else:
        known = labels.select(F.col("page_id").alias("__page"), "bad")
        labelled = rows.join(known, F.col("page_id") == F.col("__page"), "left").drop("__page")
    paths = cut(labelled.groupBy("host", "raw", F.col("__segments").alias("segments")).agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad")))
    named = cut(template_tree(paths.select("host", "raw", "segments", "n")))
    own = named.drop("n").join(paths.select("host", "raw", F.col("labelled").alias("n"), "n_bad"), ["host", "raw"])
    shares = template_shares(own)
    found = cut(named.join(shares, ["host", "template"]).select(F.col("host").alias("__host"), F.col("raw").alias("__raw"), "n", "template", "bad_share"))
    total = found.agg(F.sum("n")).first()[0] or 0
    often = found.filter(F.col("n") * HOT_SHARE >= total)  # at most HOT_SHARE rows
    same = (F.col("host") == F.col("__host")) & (F.col("raw") == F.col("__raw"))
    hot = rows.join(F.broadcast(often), same)
    cold = rows.join(F.broadcast(often.select("__host", "__raw")), same, "left_anti").join(found.filter(F.col("n") * HOT_SHARE < total), same)
    verdict = F.coalesce("__verdict", F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow"))
    return hot.unionByName(cold).select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when((F.col("host") == "") & (F.col("path") == ""), "").otherwise(F.col("template")).alias("template"), "bad_share")


def query(spark, folder):
    """``op5``: every page judged."""
    return judge(spark.read.parquet(f"{folder}/pages.parquet"))
