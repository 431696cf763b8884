"""URL filters: listed rules first, then a path-template tree with labelled purity.

Per host, paths form a tree of segments. Segments that look like numbers, dates or identifiers, and all
children of a node with more than FANOUT different ones, become wildcards, level by level; segments beyond
MAX_DEPTH are one wildcard. Templates that differ in one fixed segment only are merged if their share of bad
labelled addresses does not differ significantly from that of their siblings together. A template is rejected
if the smoothed share of bad addresses among its labelled ones is at least REJECT.

The labels are the verdicts of the listed rules on the addresses that they fit, and those given as a table. Hosts
lend each other evidence: a template's share is smoothed towards that of its shape, the same segments on all hosts,
and a shape's towards the share of all labels. So a template without labels of its own is judged by its shape, if
that has LEAST labels on LEAST_HOSTS hosts; otherwise it is allowed.

Rows meet three kinds of tables, by plain joins, of which adaptive execution splits those with a common key: wide
nodes (few), the templates of a host, and their sums. Nothing is broadcast by this module. Defined cases: a null address, or one without ``://``, has an empty host and path;
repeated rows each get a row; null ids stay; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

# The rules of the contract, as (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
FANOUT, MAX_DEPTH = 16, 8
#: Merging: |z| below this, with so many labelled addresses on both sides. Purity: weight of the overall share, least evidence, limit.
MERGE_Z, MERGE_LEAST, PRIOR_WEIGHT, LEAST, LEAST_HOSTS, REJECT = 1.96, 5, 4.0, 3, 3, 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^([0-9]+|[0-9]+(\.[A-Za-z0-9]+)+|[0-9]{4}-[0-9]{2}(-[0-9]{2})?|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. rules: a list as long as an expression can be."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        of, at = text.split("/", 1)
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(f"/{at}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def path_templates(rows: DataFrame, fanout: int = FANOUT, max_depth: int = MAX_DEPTH) -> DataFrame:
    """rows: at, host, path. Returns at, host, parts (the template's segments)."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.when(F.rlike(s, F.lit(VARIABLE)), "*").otherwise(s))
    segments = F.when(F.size(segments) > max_depth, F.concat(F.slice(segments, 1, max_depth), F.array(F.lit("**")))).otherwise(segments)
    rows = written(rows.select("at", "host", segments.alias("parts")), "segments")
    depth = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(1, depth + 1):
        # segments are free of "/", so the joined prefix names the node
        node, here = F.array_join(F.slice("parts", 1, level - 1), "/"), F.col("parts")[level - 1]
        deep = F.size("parts") >= level
        children = rows.where(deep & (here != "*")).select("host", node.alias("node"), here.alias("child")).distinct()
        wide = children.groupBy("host", "node").count().where(F.col("count") > fanout).select(F.col("host").alias("h"), F.col("node").alias("n"))
        joined = rows.join(wide, (rows["host"] == wide["h"]) & (node == wide["n"]) & deep, "left")
        starred = F.concat(F.slice("parts", 1, level - 1), F.array(F.lit("*")), F.slice("parts", level + 1, max_depth + 1))
        rows = written(joined.select("at", "host", F.when(F.col("n").isNotNull(), starred).otherwise(F.col("parts")).alias("parts")), "segments")
    return rows


def merged_templates(stats: DataFrame, depth: int) -> DataFrame:
    """stats: host, parts, labelled, bad. Returns host, parts, merged, with the segments of merged branches as "+"."""
    now = stats.select("host", "parts", F.col("parts").alias("merged"), "labelled", "bad")
    for level in range(depth, 0, -1):
        own = now.groupBy("host", "merged").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
        fixed = (F.size("merged") >= level) & ~F.col("merged")[level - 1].isin("*", "**", "+")
        shape = F.concat(F.slice("merged", 1, level - 1), F.array(F.lit("+")), F.slice("merged", level + 1, MAX_DEPTH + 2))
        own = own.where(fixed).withColumn("shape", shape)
        pool = own.groupBy("host", "shape").agg(F.sum("n").alias("pool_n"), F.sum("b").alias("pool_b"), F.count("*").alias("branches")).where("branches > 1")
        own = own.join(pool, ["host", "shape"])
        rest_n, share = F.col("pool_n") - F.col("n"), F.col("pool_b") / F.col("pool_n")
        apart = F.abs(F.col("b") / F.col("n") - (F.col("pool_b") - F.col("b")) / rest_n)
        spread = F.sqrt(share * (1 - share) * (1 / F.col("n") + 1 / rest_n))
        like = (F.col("n") >= MERGE_LEAST) & (rest_n >= MERGE_LEAST) & (apart <= F.lit(MERGE_Z) * spread)
        like = own.where(like).select("host", "merged", "shape")
        now = written(now.join(like, ["host", "merged"], "left").select("host", "parts", F.coalesce("shape", "merged").alias("merged"), "labelled", "bad"), "merged")
    return now


def url_verdicts(pages: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, reject: float = REJECT) -> DataFrame:
    """A row for each row of pages: page_id, host, path, rule, verdict, template, labelled, lent (labels of its shape), purity.

    labels: id, bad (boolean), one row for an id, of addresses that are labelled beside those that a rule fits."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, says = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says).withColumn("bad", F.col("says") == "block")
    if labels is not None:
        given = labels.select(F.col("id").alias("labelled_id"), F.col("bad").alias("given"))
        rows = rows.join(given, rows["page_id"] == given["labelled_id"], "left").withColumn("bad", F.coalesce("given", "bad")).drop("labelled_id", "given")
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "addresses")
    found = path_templates(rows.select("at", "host", "path"))
    whole = written(rows.join(found.select("at", "parts"), "at"), "templates")
    stats = whole.groupBy("host", "parts").agg(F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    depth = whole.agg(F.max(F.size("parts"))).first()[0] or 0
    stats = written(stats, "stats")
    merged = merged_templates(stats, depth)
    sums = merged.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad_n"))
    n, bad = stats.agg(F.sum("labelled"), F.sum("bad")).first()
    prior = (bad or 0) / n if n else 0.0
    shapes = stats.groupBy("parts").agg(F.sum("labelled").alias("lent"), F.sum("bad").alias("lent_bad"), F.count_if(F.col("labelled") > 0).alias("hosts"))
    shape_share = (F.col("lent_bad") + PRIOR_WEIGHT * prior) / (F.col("lent") + PRIOR_WEIGHT)
    purity = (F.col("bad_n") + PRIOR_WEIGHT * shape_share) / (F.col("labelled") + PRIOR_WEIGHT)
    judged = merged.select("host", "parts", "merged").join(sums, ["host", "merged"]).join(shapes, "parts")
    judged = judged.select("host", "parts", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "labelled", "lent", "hosts", purity.alias("purity"))
    known = (F.col("labelled") >= LEAST) | ((F.col("lent") >= LEAST) & (F.col("hosts") >= LEAST_HOSTS))
    verdict = F.coalesce("says", F.when(known & (F.col("purity") >= reject), "block").otherwise("allow"))
    return whole.join(judged, ["host", "parts"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "labelled", "lent", "purity")


def query(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
