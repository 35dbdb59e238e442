"""URL filtering by rules and by a tree of path templates per host.

A path's segments that look variable (digits, hexadecimal, dates, long slugs)
become wildcards.  Below every prefix of a host whose literal children are many
and seldom seen, or whose labelled children can't be told apart by their share
of rejected pages, the children are merged into a wildcard too, those without
labels among them.  A template is rejected if its share of labelled pages that
the rules block is high, smoothed towards that of the pages around it: first of
those elsewhere on its host, then of those nearer by.  A template without labels
is judged by these alone.
Pages that a rule fits are the labels and keep the rule's verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


@dataclass(frozen=True)
class Settings:
    children: int = 8  # literal children from which a prefix may be variable
    repeats: float = 2.0  # mean pages of a child below which it is
    z: float = 1.96  # standard errors within which shares of rejected pages are alike
    strength: float = 4.0  # pages that the prior counts as
    prior: float = 0.2  # share of rejected pages before any label
    reject: float = 0.8  # smoothed share from which a template is rejected


def host_and_path(url: str) -> tuple[Column, Column]:
    """After the first `://`: the host up to `/`, `?` or `#`, A-Z lower-cased, and the path up to `?` or `#`; else both empty."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_for(rules=RULES) -> Column:
    """The longest rule (action, host and path) that fits columns host and path, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def generalised(segment: Column) -> Column:
    """A wildcard for a segment that looks variable, without its extension; else the segment."""
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    variable = stem.rlike(r"[0-9]") | stem.rlike(r"^[0-9A-Fa-f-]{16,}$") | (F.length(stem) > 40)
    return F.when(variable, F.lit("*")).otherwise(segment)


def templates(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, shape (segments after the first generalisation), template, purity, rejected; pages: host, path, blocked (null: no label).

    Level by level from the root: children of a prefix are judged after all prefixes above
    are rewritten, so subtrees of merged children are pooled.  A shape that is alone below
    its prefix can't be merged any further.  On the way down, prior is the smoothed share
    outside the prefix; every labelled page counts once.
    """
    smoothed = lambda bad, labelled, prior: (bad + settings.strength * prior) / (labelled + settings.strength)
    shapes = pages.groupBy("host", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), generalised).alias("shape")).agg(
        F.count("*").alias("pages"), F.count("blocked").alias("labelled"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("bad")
    )
    live = staged(shapes.select("*", F.array().cast("array<string>").alias("name"), F.lit(settings.prior).alias("prior"), F.lit(None).cast("long").alias("up_labelled"), F.lit(None).cast("long").alias("up_bad")), "url-shapes")
    done, depth = [], 0
    while True:
        live = live.withColumn("more", F.size("shape") > depth)
        nodes = live.groupBy("host", "name").agg(
            F.count("*").alias("shapes"),
            *(F.sum(c).alias(f"all_{c}") for c in ("labelled", "bad")),
            *(F.coalesce(F.sum(F.when(F.col("more"), F.col(c))), F.lit(0)).alias(f"below_{c}") for c in ("labelled", "bad")),
        )
        children = live.where("more").groupBy("host", "name", F.get("shape", F.lit(depth)).alias("child")).agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "bad")))
        step = nodes.join(_merged(children, settings), ["host", "name"], "left")
        step = live.join(step, ["host", "name"])
        ends = (F.col("shapes") == 1) | ~F.col("more")
        rest = F.slice("shape", depth + 1, F.greatest(F.size("shape") - depth, F.lit(0)))
        child = F.when(F.col("merge"), F.lit("*")).otherwise(F.get("shape", F.lit(depth)))
        outside = F.when(F.col("up_labelled").isNull(), F.col("prior")).otherwise(smoothed(F.col("up_bad") - F.col("all_bad"), F.col("up_labelled") - F.col("all_labelled"), F.col("prior")))
        prior = F.when(F.col("more"), outside).otherwise(smoothed(F.col("below_bad"), F.col("below_labelled"), outside))
        name = F.when(ends, F.concat("name", rest)).otherwise(F.concat("name", F.array(child)))
        step = staged(step.select("host", "shape", "pages", "labelled", "bad", name.alias("name"), prior.alias("prior"), F.col("all_labelled").alias("up_labelled"), F.col("all_bad").alias("up_bad"), ends.alias("ends")), "url-level")
        done.append(step.where("ends").drop("ends"))
        live = step.where("not ends").drop("ends")
        depth += 1
        if not live.limit(1).count():
            break
    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    named = named.withColumn("template", F.concat(F.lit("/"), F.concat_ws("/", "name")))
    purity = smoothed(F.sum("bad"), F.sum("labelled"), F.max("prior"))  # one prior a template
    judged = named.groupBy("host", "template").agg(purity.alias("purity"))
    return named.select("host", "shape", "template").join(judged, ["host", "template"]).withColumn("rejected", F.col("purity") >= settings.reject)


def _merged(children: DataFrame, settings: Settings) -> DataFrame:
    """host, name, merge of the prefixes whose literal children become a wildcard."""
    share = F.col("bad") / F.col("labelled")
    parents = children.where("child != '*'").groupBy("host", "name").agg(
        F.count("*").alias("children"),
        F.sum("pages").alias("pages"),
        F.sum("labelled").alias("all_labelled"),
        F.sum("bad").alias("all_bad"),
        F.count(F.when(F.col("labelled") > 0, 1)).alias("told"),
        F.sum(F.when(F.col("labelled") > 0, F.col("bad") * share)).alias("spread"),
    )
    # chi-square of the children's shares against the pooled one
    pooled = F.col("all_bad") / F.nullif(F.col("all_labelled"), F.lit(0))
    chi = (F.col("spread") - F.col("all_bad") * pooled) / F.nullif(pooled * (1 - pooled), F.lit(0.0))
    limit = (F.col("told") - 1) + settings.z * F.sqrt(2.0 * (F.col("told") - 1))
    variable = (F.col("children") >= settings.children) & (F.col("pages") < settings.repeats * F.col("children"))
    alike = (F.col("told") > 1) & F.coalesce(chi <= limit, F.lit(True))
    return parents.where(variable | alike).select("host", "name", F.lit(True).alias("merge"))


def judge(pages: DataFrame, rules=RULES, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity.  A null or shapeless url has empty host and path and is judged as any other."""
    host, path = host_and_path("url")
    action = {rule: action for action, rule in rules}
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_for(rules))
    blocked = F.col("rule").isin([r for r, a in action.items() if a == "block"])
    found = templates(rows.select("host", "path", blocked.alias("blocked")), settings)
    rows = rows.withColumn("shape", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), generalised))
    rows = rows.join(found, ["host", "shape"], "left")
    own = F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNull(), own).when(blocked, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op4_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template")
