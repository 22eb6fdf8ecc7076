"""URL filtering by given rules first, then by association rules mined from the URLs that the rules decide.

Token combinations that go with a label are mined by Spark's FP-growth; rules below the support or the confidence go. A URL
without a given rule is judged by the mined rules whose tokens it has all: an inverted index from tokens to rules is joined
with the tokens of each distinct token set, and rules all of whose tokens joined apply.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z folded; empty for null or without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host/path) that fits host, subdomains included, and the path's beginning."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last of the chain is asked first
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), rule).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct sorted tokens: scheme, last host labels, subdomain, folders, file ending, query keys, fragment."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tag = lambda name, value: F.concat(F.lit(name + ":"), value)
    folders = F.filter(F.split(F.regexp_extract(path, r"^(.*)/", 1), "/"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: tag("key", F.substring_index(x, "=", 1)))
    parts = F.concat(
        F.array(
            tag("scheme", F.substring_index(F.coalesce(url, F.lit("")), "://", 1)),
            tag("top", F.element_at(labels, -1)),
            tag("site", F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")),
            tag("host", host),
            F.when(n > 2, tag("sub", F.element_at(labels, 1))),
            F.when(path.rlike(r"\.[A-Za-z0-9]+$"), tag("end", F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
            F.when(path.endswith("/"), F.lit("end:/")),
            F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("fragment")),
        ),
        F.transform(folders, lambda x: tag("folder", x)),
        keys,
    )
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())))


def _rules(items: DataFrame, least: int, transactions: int, min_confidence: float) -> DataFrame:
    """(antecedent, label, confidence, support as a share of `transactions`) of what FP-growth finds in at least `least` rows of items."""
    n = items.count()
    found = FPGrowth(itemsCol="items", minSupport=min((least - 0.5) / max(n, 1), 1.0), minConfidence=min_confidence).fit(items).associationRules
    ours = found.filter(F.element_at("consequent", 1).startswith("label=") & ~F.exists("antecedent", lambda x: x.startswith("label=")))
    count = F.round(F.col("support") * n)
    return ours.select(F.array_sort("antecedent").alias("antecedent"), F.regexp_replace(F.element_at("consequent", 1), "^label=", "").alias("label"), "confidence", (count / transactions).alias("support"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float, most_tokens: int) -> DataFrame:
    """labelled (tokens, label) -> (rule_id, antecedent, label, confidence, support) of one up to most_tokens tokens.

    FP-growth itself knows no longest pattern, and 20 query keys that occur together have a million combinations. So it is given
    short transactions: each token of a row that is frequent with its label, then each pair of such tokens, each three, and so on.
    A combination of a row is in one of them, so its counts are those of the rows, and no pattern is longer than a rule can be.
    """
    if most_tokens < 1:
        raise ValueError("rules have one token or more")
    held = materialise(labelled.select("tokens", F.concat(F.lit("label="), "label").alias("label")), "labelled")
    rows = held.count()
    least = max(1, math.ceil(min_support * rows - 1e-9))
    single = held.select("label", F.explode("tokens").alias("token")).select(F.array("token", "label").alias("items"))
    out = _rules(single, least, max(rows, 1), min_confidence)
    if most_tokens > 1:
        # At most the mean number of tokens over min_support, so this one row may be broadcast.
        frequent = held.select("label", F.explode("tokens").alias("token")).groupBy("token", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        known = frequent.agg(F.collect_set("token").alias("known"))
        kept = held.crossJoin(F.broadcast(known)).select("label", F.array_intersect("tokens", "known").alias("tokens"))
        longer = kept.select("label", F.col("tokens").alias("rest"), F.array().cast("array<string>").alias("some"))
        for size in range(1, most_tokens + 1):  # rest: the tokens of the row after the last of some
            at = longer.select("label", "some", "rest", F.posexplode("rest").alias("at", "token"))
            longer = at.select("label", F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), F.concat("some", F.array("token")).alias("some"))
            if size > 1:
                out = out.union(_rules(longer.select(F.concat("some", F.array("label")).alias("items")), least, max(rows, 1), min_confidence).filter(F.size("antecedent") == size))
    return out.select(F.array_join("antecedent", " ").alias("rule_id"), "antecedent", "label", "confidence", "support")


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    min_support: float = 0.01,
    min_confidence: float = 0.6,
    most_tokens: int = 2,
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence of every row of pages (page_id, url).

    Of the mined rules that apply, the one of highest confidence decides, then of highest support, then of most tokens, then
    the first by name; without any, `default`. A null url has an empty host and path and only the token of its missing
    scheme. Rows that repeat are judged each; further columns are ignored; a url of any length counts whole; an empty table
    gives an empty table.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    base = base.select("page_id", "host", "path", given_rule(F.col("host"), F.col("path"), rules).alias("rule"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    base = materialise(base, "urls")
    verdicts = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdicts = F.when(F.col("rule") == rule, verdict).otherwise(verdicts)
    mined = materialise(mine(base.filter("rule is not null").select("tokens", verdicts.alias("label")), min_support, min_confidence, most_tokens), "mined")
    index = mined.select("rule_id", "label", "confidence", "support", F.size("antecedent").alias("n"), F.explode("antecedent").alias("token"))
    shapes = base.filter("rule is null").select("tokens").distinct()
    applied = (
        spread_join(shapes.select("tokens", F.explode("tokens").alias("token")), index, ["token"], ["tokens"])  # all shapes may have a token, such as their scheme
        .groupBy("tokens", "rule_id", "label", "confidence", "support", "n")
        .agg(F.count("*").alias("met"))
        .filter("met = n")
    )
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.col("n"), "rule_id", "label")
    best = applied.groupBy("tokens").agg(F.min_by(F.struct("rule_id", "label", "confidence"), order).alias("best"))
    # Most urls may have one token set, so its rows are dealt among several tasks.
    return spread_join(base, best, ["tokens"], ["page_id", "path"], "left", salts=32).select(
        "page_id", "host", "path", "rule",
        F.coalesce(verdicts, F.col("best.label"), F.lit(default)).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("best.rule_id")).alias("mined_rule"),
        F.when(F.col("rule").isNull(), F.col("best.confidence")).alias("confidence"),
    )
