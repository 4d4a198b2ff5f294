"""URL filters: fixed rules, and templates learned from the URLs that the rules judge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm import shared
from panelweave.sources.workspace import pin

# Rules as (verdict, host/path), and the letters that host names fold.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Segments after so many are one last segment together.
DEPTH = 8
# A segment varies if its node has so many values of one shape, and rarely the same one again.
VALUES = 10
VALUE_SHARE = 0.2
# Branches are alike if what follows differs from their siblings' sum by no more than this, and
# what is expected by chance.
DISTANCE = 0.25
# Templates go if (blocked + 1) / (labelled + 2) is above this.
PURITY = 0.8


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and subdomains, start of the path) and its verdict, or NULL."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = text.partition("/")
        fits = (host == domain) | host.endswith(f".{domain}")
        fits = fits & path.startswith(slash + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segments_of(path: Column) -> Column:
    """Segments after the first slash; those beyond the depth limit are one."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    rest = F.array(F.array_join(F.slice(parts, DEPTH + 1, F.greatest(F.size(parts) - DEPTH, F.lit(0))), "/"))
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), rest)).otherwise(parts)


def shape_of(segment: Column) -> Column:
    """What a segment is made of: runs of digits become 0, runs of letters a; the rest stays."""
    return F.regexp_replace(F.regexp_replace(segment, r"[0-9]+", "0"), r"\p{L}+", "a")


def url_templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, label, n) with ``template``: the path with its variable parts left out.

    Level by level, per host and template so far: values of one shape that are many and rarely
    repeat become the wildcard ``*shape``. Then, from the last level up, sibling branches with like
    continuations and like labels are merged into one, named by their labels. Every step groups or
    joins distinct paths, or what was counted from them.
    """
    cut = paths.withColumn("parts", segments_of(F.col("path"))).withColumn("template", F.array().cast("array<string>"))
    # One number: how many levels there are, DEPTH + 1 at most.
    deepest = paths.agg(F.max(F.size(segments_of(F.col("path"))))).first()[0] or 0
    for level in range(deepest):
        part = F.get("parts", F.lit(level))
        here = cut.withColumn("part", part).withColumn("shape", shape_of(part))
        values = here.filter("part is not null").groupBy("host", "template", "shape", "part")
        values = values.agg(F.sum("n").alias("n"))
        nodes = values.groupBy("host", "template", "shape").agg(
            F.count(F.lit(1)).alias("values"), F.sum("n").alias("pages")
        )
        many = F.col("values") >= F.greatest(F.lit(VALUES), F.col("pages") * VALUE_SHARE)
        varied = pin(nodes.filter(many).select("host", "template", "shape", F.lit(True).alias("varies")), "varied")
        here = here.join(varied, ["host", "template", "shape"], "left")
        named = F.when(F.col("varies"), F.concat(F.lit("*"), "shape")).otherwise(F.col("part"))
        longer = F.when(F.col("part").isNull(), F.col("template")).otherwise(
            F.concat("template", F.array(named))
        )
        cut = here.withColumn("template", longer).drop("part", "shape", "varies")
    cut = pin(cut.drop("parts"), "templates")
    merged = _merge_branches(cut, deepest)
    return cut.join(merged, ["host", "template"]).drop("template").withColumnRenamed("merged", "template")


def _merge_branches(cut: DataFrame, deepest: int) -> DataFrame:
    """For each host and template, the template with like branches merged: host, template, merged."""
    trees = cut.groupBy("host", "template").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("blocked"),
        F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("allowed"),
    )
    trees = pin(trees.withColumn("merged", F.col("template")), "trees")
    for level in range(deepest - 1, -1, -1):
        name = F.get("merged", F.lit(level))
        literal = name.isNotNull() & ~name.startswith("*")
        here = trees.withColumn("stem", F.slice("merged", 1, level))
        here = here.withColumn("branch", F.when(literal, name))
        here = here.withColumn("rest", F.slice("merged", level + 2, F.greatest(F.size("merged") - level - 1, F.lit(0))))
        tails = here.filter("branch is not null").groupBy("host", "stem", "branch", "rest")
        tails = tails.agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")])
        tails = pin(tails, "tails")
        pool = tails.groupBy("host", "stem", "rest").agg(F.sum("n").alias("of_rest"))
        stems = tails.groupBy("host", "stem").agg(F.sum("n").alias("of_stem"))
        branches = tails.groupBy("host", "stem", "branch").agg(
            *[F.sum(c).alias(f"of_{c}") for c in ("n", "blocked", "allowed")]
        )
        each = tails.join(pin(pool, "pool"), ["host", "stem", "rest"])
        each = each.join(pin(stems, "stems"), ["host", "stem"])
        each = each.join(pin(branches, "branches"), ["host", "stem", "branch"])
        common = F.sum(F.least(F.col("n") / F.col("of_n"), F.col("of_rest") / F.col("of_stem")))
        each = each.groupBy("host", "stem", "branch", "of_n", "of_blocked", "of_allowed").agg(
            common.alias("common")
        )
        alike = 1 - F.col("common") <= DISTANCE + 0.5 / F.sqrt("of_n")
        kind = (
            F.when(F.col("of_blocked") + F.col("of_allowed") == 0, "unknown")
            .when(F.col("of_blocked") > F.col("of_allowed"), "blocked")
            .otherwise("allowed")
        )
        each = each.filter(alike).select(
            "host", "stem", "branch", F.concat(F.lit("*|"), kind).alias("group")
        )
        here = here.join(pin(each, "merged"), ["host", "stem", "branch"], "left")
        new = F.concat("stem", F.array("group"), "rest")
        trees = here.withColumn("merged", F.when(F.col("group").isNotNull(), new).otherwise(F.col("merged")))
        trees = pin(trees.drop("stem", "branch", "rest", "group"), "trees")
    return trees.select("host", "template", "merged")


def judge_urls(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
) -> DataFrame:
    """Verdict on every row's URL: page_id, host, path, rule, verdict, template, purity.

    The host is what follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; the path goes on
    up to ``?`` or ``#``. Of the rules that fit, the longest decides. URLs that no rule fits are judged
    by their template (:func:`url_templates`), learned per host with the rules' verdicts as labels: it is
    rejected, ``block``, if (blocked + 1) / (labelled + 2) is over 0.8, else ``allow``. So a template without
    labels is allowed, and one needs four blocked pages at least to be rejected.

    NULL URLs and those without ``://`` have an empty host and path. Rows that repeat come out as often;
    an empty table gives an empty table; other columns are not read. Work is done on distinct
    (host, path) with counts; all groupings have more than the host as key, so a hot host is spread.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.withColumn("rule", rule).withColumn("label", verdict)
    paths = judged.groupBy("host", "path", "label").agg(F.count(F.lit(1)).alias("n"))
    known = pin(url_templates(pin(paths, "paths")), "known")
    sums = known.groupBy("host", "template").agg(
        F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("blocked"),
        F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).alias("labelled"),
    )
    purity = (F.col("blocked") + 1) / (F.col("labelled") + 2)
    sums = pin(sums.select("host", "template", purity.alias("purity")), "purity")
    known = pin(known.select("host", "path", "template").join(sums, ["host", "template"]), "judged")
    known = known.withColumn("template", F.concat(F.lit("/"), F.array_join("template", "/")))
    out = judged.join(known, ["host", "path"])
    method = F.when(F.col("purity") > PURITY, "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "template", "purity"
    )
