"""URL filter: rules first, then a path-template tree with smoothed, labelled purity.

Rules `(host, path)` fit a host and its subdomains where the path starts with
the rule's; the longest wins. Every url that a rule decides is a labelled
example; templates decide the rest:

1. Tree. Per host, the path's segments are walked level by level. Below a
   (host, template so far) a segment is variable - a wildcard - where its
   distinct values are many (`least_values`) and a large share (`variable_share`) of its
   urls, or below the same template of all hosts together, so that small hosts
   share what large numbers show.
2. Merge. Of the literal siblings that remain, those whose share of blocked
   examples does not differ from their siblings' (a two-proportion z test at
   `similar_z`) share one branch; those that differ, and those without
   examples, stay apart.
3. Purity. A template's share of blocked examples is smoothed by its host's share,
   that by the same template's over all hosts, and that by the share of all
   examples, each weighing `prior` examples. A template is rejected (block) where the smoothed share is
   `reject` or more.

Each distinct (host, path) counts once in all of this, however many pages have it: a verdict is a function of
the set of urls, and crawling a url again changes none. Levels beyond `depth` form one last segment. Each level is a few aggregations and
joins on (host, template); only counts are joined back.

Defined results: a null url or one without `://` has empty host and path, one
template, and the verdict of step 3 for it. Without any example the verdict is allow. Repeated rows and page_ids
give a row each. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import stage

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MERGED = "{similar}"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    part = lambda pattern, k: F.when(at > 0, F.regexp_extract(rest, pattern, k)).otherwise(F.lit(""))
    return F.translate(part(r"^([^/?#]*)", 1), UPPER, LOWER), part(r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as `hostpath`, and its verdict; null where none fits."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    name, verdict = (F.coalesce(*(F.when(fits(h, p), F.lit(x)) for h, p, x in ((r[0], r[1], (r[0] + r[1], r[2])[k]) for r in ordered))) for k in (0, 1))
    return name, verdict


def _step(pages: DataFrame, level: int, least_values: int, variable_share: float, similar_z: float) -> DataFrame:
    """Extend each url's template by its segment at this level: itself, a wildcard or the merged branch."""
    node = ["host", "template"]
    pages = pages.withColumn("seg", F.get("segs", F.lit(level)))
    sums = [F.sum(x).alias(x) for x in ("urls", "examples", "blocked")]
    one = [F.lit(1).alias("urls"), F.col("label").isNotNull().cast("long").alias("examples"), F.coalesce("label", F.lit(0)).alias("blocked")]
    children = stage(pages.where("seg is not null").select(*node, "seg", *one).groupBy(*node, "seg").agg(*sums))
    parents = children.groupBy(*node).agg(F.count("*").alias("distinct"), *(F.sum(x).alias(f"all_{x}") for x in ("urls", "examples", "blocked")))
    everywhere = children.groupBy("template", "seg").agg(F.sum("urls").alias("urls")).groupBy("template").agg(F.count("*").alias("values"), F.sum("urls").alias("total"))
    many = lambda values, urls: (F.col(values) >= least_values) & (F.col(values) >= variable_share * F.col(urls))
    parents = stage(parents.join(everywhere, "template").withColumn("variable", many("distinct", "all_urls") | many("values", "total")))
    literal = children.join(parents.where("not variable"), node)
    rest = F.col("all_examples") - F.col("examples")
    pooled = F.col("all_blocked") / F.nullif(F.col("all_examples"), F.lit(0))
    gap = F.col("blocked") / F.nullif(F.col("examples"), F.lit(0)) - (F.col("all_blocked") - F.col("blocked")) / F.nullif(rest, F.lit(0))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(F.col("examples"), F.lit(0)) + 1 / F.nullif(rest, F.lit(0))))
    merged = literal.where(F.abs(gap) <= similar_z * error).select(*node, "seg", F.lit(True).alias("merged"))
    joined = pages.join(parents.select(*node, "variable"), node, "left").join(merged, [*node, "seg"], "left")
    name = F.when(F.col("variable"), F.lit("*")).when(F.col("merged"), F.lit(MERGED)).otherwise(F.col("seg"))
    longer = F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), name))
    return stage(joined.withColumn("template", longer).drop("seg", "variable", "merged"))


def url_verdicts(
    pages: DataFrame, rules=RULES, depth: int = 8, least_values: int = 8, variable_share: float = 0.3, similar_z: float = 1.96, prior: float = 4.0, reject: float = 0.5
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and share (its smoothed share of blocked examples)."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    all_segs = F.split(F.regexp_replace("path", "^/", ""), "/")
    tail = F.when(F.size(all_segs) > depth, F.array(F.array_join(F.slice(all_segs, depth, F.size(all_segs)), "/"))).otherwise(F.slice(all_segs, depth, 1))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("rule", rule).withColumn("fixed", verdict)
    parsed = parsed.withColumn("segs", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.concat(F.slice(all_segs, 1, depth - 1), tail)))
    parsed = stage(parsed)
    site = ["host", "path"]
    urls = parsed.select(*site, "fixed", "segs").groupBy(*site).agg(F.first("fixed").alias("fixed"), F.first("segs").alias("segs"))  # both follow from the url
    tree = stage(urls.select("*", F.when(F.col("fixed") == "block", 1).when(F.col("fixed") == "allow", 0).cast("long").alias("label"), F.lit("").alias("template")))
    levels = tree.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(levels):
        tree = _step(tree, level, least_values, variable_share, similar_z)
    examples, blocked = F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("k")
    own = stage(tree.groupBy("host", "template").agg(examples, blocked))
    total = lambda keys, tag: own.groupBy(*keys).agg(F.sum("n").alias(f"{tag}n"), F.sum("k").alias(f"{tag}k"))
    n, k = own.agg(F.sum("n"), F.sum("k")).first()
    overall = F.lit(k / n if n else 0.0)
    smooth = lambda k, n, base: (F.col(k) + prior * base) / (F.col(n) + prior)
    shares = own.join(total(["host"], "h"), "host").join(total(["template"], "t"), "template")
    share = smooth("k", "n", smooth("hk", "hn", smooth("tk", "tn", overall)))
    judged = tree.join(shares.select("host", "template", share.alias("share")), ["host", "template"]).select(*site, "template", "share")
    chosen = F.coalesce("fixed", F.when(F.col("share") >= reject, "block").otherwise("allow"))
    # one row an url on the right; AQE splits the pages of an url that very many have
    return parsed.drop("segs").join(judged, site).select("page_id", "host", "path", "rule", chosen.alias("verdict"), "template", "share")
