"""Source records to table rows: the declarative field map, details that lists don't repeat, and rows kept through upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..session import numbered, table
from ..views import WINS, wins

#: Characters that a search or a detail text keeps.
MOST_TEXT = 2000
#: Known ids below which the list of sources counts as unreadable.
LEAST_KNOWN = 50


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def mapped(items: DataFrame, fields: dict[str, str], prefix: str, now: Column, keywords: tuple[str, ...] = ()) -> DataFrame:
    """items (raw: JSON text) as rows by a map from our names to JSON paths; rows whose title has under 3 characters go.

    Blank values are null, the currency is UZS unless given, one category or a list of them is a list without blanks, and a
    readable deadline before `now` closes the row.
    """
    at = lambda name: _filled(paths.at_path(F.col("raw"), fields[name])) if name in fields else F.lit(None).cast("string")
    external = F.coalesce(at("external_id"), _filled(paths.at_path(F.col("raw"), "id")), F.lit(""))
    many = F.filter(F.from_json(at("categories"), "array<string>"), lambda c: c.isNotNull() & (c != ""))
    categories = F.when(at("categories").startswith("["), many).when(at("categories").isNotNull(), F.array(at("categories"))).otherwise(F.array().cast("array<string>"))
    closed = F.coalesce(F.try_to_timestamp(F.replace(at("deadline"), F.lit("Z"), F.lit("+00:00"))) < now, F.lit(False))
    search = F.substring(F.concat_ws(" ", *[_filled(paths.at_path(F.col("raw"), k)) for k in keywords]), 1, MOST_TEXT)
    rows = items.select(
        F.concat(F.lit(prefix + "-"), external).alias("id"), external.alias("external_id"), at("title").alias("title"), at("price").try_cast("double").alias("price"),
        F.coalesce(at("currency"), F.lit("UZS")).alias("currency"), at("deadline").alias("deadline"), categories.alias("categories"),
        F.when(closed, "closed").otherwise("active").alias("status"), search.alias("search_text"),
    )
    return rows.filter(F.char_length("title") >= 3)


def detail_text(json: Column, fields: list[str], encoded: tuple[str, ...] = ()) -> Column:
    """The distinct values of wildcard paths in their order, as one text of at most MOST_TEXT characters; null without any.

    A path whose first name is in `encoded` leads into JSON that the record holds as a string.
    """

    def values(path: str) -> Column:
        head, _, rest = path.partition(".")
        if head.split("[")[0] not in encoded:
            return paths.values_at(json, path)
        name = head.split("[")[0]
        inner = paths.at_path(json, name)
        rest = path[len(name) :].lstrip(".")
        return F.when(F.trim(inner).rlike(r"^[\[{]"), paths.values_at(F.concat(F.lit('{"v":'), inner, F.lit("}")), f"v{'' if rest.startswith('[') else '.'}{rest}")).otherwise(F.array().cast("array<string>"))

    every = F.filter(F.transform(F.concat(*[values(p) for p in fields]), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    return F.nullif(F.substring(F.array_join(F.array_distinct(every), " "), 1, MOST_TEXT), F.lit(""))


def with_stored_details(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """incoming (search_text, detail_text) with the details that stored rows of the same key have: a list doesn't repeat them.

    An incoming detail wins, then the stored one, then what a stored search text has beyond the incoming one. The detail
    comes first in the search text, once, and the whole is cut at MOST_TEXT characters.
    """
    known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("search_text").alias("_search"), F.col("detail_text").alias("_detail"))
    same = reduce(lambda a, b: a & b, [incoming[k] == known[f"_{k}"] for k in keys])
    tidy = lambda c: text.collapse(F.coalesce(c, F.lit("")))
    rows = incoming.join(known, same, "left").withColumn("_old", tidy(F.col("_search"))).withColumn("_new", tidy(F.col("search_text")))
    rest = F.substring(F.regexp_replace(F.expr("substring(_old, length(_new) + 1)"), r"^[ |·—\-\t]+|[ |·—\-\t]+$", ""), 1, MOST_TEXT)
    legacy = F.when((F.col("_new") != "") & F.lower("_old").startswith(F.lower("_new")), F.nullif(rest, F.lit("")))
    rows = rows.withColumn("detail_text", F.coalesce(_filled(F.col("detail_text")), _filled(F.col("_detail")), legacy))
    detail = text.collapse(F.coalesce("detail_text", F.lit("")))
    joined = F.substring(F.regexp_replace(F.concat(detail, F.lit(" | "), F.col("_new")), r"^[ |]+|[ |]+$", ""), 1, MOST_TEXT)
    merged = F.when((detail == "") | F.contains(F.lower("_new"), F.lower(detail)), F.col("_new")).otherwise(joined)
    return rows.withColumn("search_text", merged).select(*incoming.columns)


def partial_upsert(stored: DataFrame, batch: DataFrame, keys: list[str], owned: list[str]) -> DataFrame:
    """stored after a batch that knows the columns `owned` only: those are replaced, the others stay as they were.

    batch has a key once (see first_of); its rows without a stored one have nulls in the other columns.
    """
    new = batch.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in owned], F.lit(True).alias("_in"))
    both = stored.join(new, reduce(lambda a, b: a & b, [stored[k] == new[f"_{k}"] for k in keys]), "full")
    column = lambda c: F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in owned else F.coalesce(c, f"_{c}").alias(c) if c in keys else F.col(c)
    return both.select(*[column(c) for c in stored.columns])


def civil_results(items: DataFrame) -> DataFrame:
    """Results of civil contracts as rows; without an id or a title there is none. Currency UZS unless the name is another's."""
    external = F.coalesce(_filled(F.col("display_id")), _filled(F.col("civil_contract_id")))
    title, customer = _filled(F.col("civil_name")), F.trim(F.coalesce("customer_name", F.lit("")))
    start, final = F.nullif(F.col("cost"), F.lit(0.0)), F.nullif(F.col("result_cost"), F.lit(0.0))
    cut = F.floor((start - final) / start * 1000 + 0.5) / 10
    foreign = _filled(F.col("currency_name")).isNotNull() & ~F.contains(F.lower("currency_name"), F.lit("сом"))
    return items.select(
        F.concat(F.lit("civil-"), external).alias("external_id"), title.alias("title"), customer.alias("organization"), start.alias("price"), final.alias("winning_price"),
        F.when(foreign, F.col("currency_name")).otherwise("UZS").alias("currency"), "winner",
        F.when(F.contains(F.lower(F.coalesce("status_name", F.lit(""))), F.lit("совершена")), "completed").otherwise("cancelled").alias("status"),
        F.when((start > 0) & final.isNotNull(), cut).alias("discount"),
        F.trim(F.concat_ws(" ", title, _filled(customer), _filled(F.col("winner")))).alias("search_text"),
    ).filter("external_id is not null and title is not null")


def metric_rows(metrics: DataFrame, by: str) -> DataFrame:
    """One row a source and metric of a table with a column a metric; metrics that are null give none."""
    names = [c for c in metrics.columns if c != by]
    return metrics.unpivot(by, names, "metric", "value").filter("value is not null")


def without_noise(name: Column, noise: str) -> tuple[Column, Column]:
    """A name in lower case without quotes and brackets, and the same without the legal words that `noise` matches."""
    plain = text.collapse(F.regexp_replace(F.translate(F.lower(F.coalesce(name, F.lit(""))), "ʻ`", "''"), "[«»\"'()]", " "))
    return plain, text.collapse(F.regexp_replace(plain, noise, " "))


def holds_pattern(name: Column, patterns: list[str], noise: str) -> Column:
    """Whether a name holds one of the patterns, as it is or once legal words are left out."""
    return reduce(lambda a, b: a | b, [c.contains(p) for c in without_noise(name, noise) for p in patterns])


def purchases_with_lots(purchases: DataFrame, lots: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """purchases (feed, ...) with `lot`, the least id of a lot that has the key which the purchase's feed goes by.

    rules: for each feed the key of a purchase and that of a lot. Keys of different feeds never meet.
    """
    mine = F.lit(None).cast("string")
    for feed, (key, _) in rules.items():
        mine = F.when(F.col("feed") == feed, key.cast("string")).otherwise(mine)
    keyed = [lots.select(F.lit(feed).alias("_feed"), key.cast("string").alias("_key"), F.col("id").alias("lot")) for feed, (_, key) in rules.items()]
    first = reduce(DataFrame.union, keyed).filter("_key is not null").groupBy("_feed", "_key").agg(F.min("lot").alias("lot"))
    asked = purchases.withColumn("_mine", mine)
    return asked.join(first, (asked["feed"] == first["_feed"]) & (asked["_mine"] == first["_key"]), "left").select(*purchases.columns, "lot")


def _domain(url: Column) -> Column:
    """Lower-cased host without scheme, www. and path; null without any."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"https?://|www\.", "")
    return F.nullif(F.substring_index(bare, "/", 1), F.lit(""))


def _suffixes(domain: Column) -> Column:
    """A domain and all domains that it lies in, of two labels at least: a.b.org -> a.b.org, b.org."""
    labels = F.split(domain, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(starts, lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def platform_sources(platforms: DataFrame, sources: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """platforms (platform, name, url) with the source (place, id, name, url) that they are: by url, else by a group of names.

    By url: the first source (by place) whose domain holds the platform's or lies in it, found by an equi-join of domain
    suffixes. By name: the first group with a word that the platform's name holds and a source whose id or name holds one of
    its words; of these the first source. Null urls and names match nothing.
    """
    asked, known = platforms.withColumn("_d", _domain(F.col("url"))), sources.withColumn("_e", _domain(F.col("url")))
    inner = asked.select("platform", "_d", F.explode(_suffixes(F.col("_d"))).alias("_k")).join(known.select("place", "id", F.col("_e").alias("_k")), "_k").select("platform", "place", "id")
    outer = known.select("place", "id", F.explode(_suffixes(F.col("_e"))).alias("_d")).join(asked.select("platform", "_d"), "_d").select("platform", "place", "id")
    by_url = inner.union(outer).groupBy("platform").agg(F.min_by("id", "place").alias("_by_url"))
    holds = lambda c, words: reduce(lambda x, y: x | y, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(w) for w in words])
    found = [known.filter(holds("id", ws) | holds("name", ws)).agg(F.lit(g).alias("_g"), F.min_by("id", "place").alias("_named")) for g, ws in enumerate(groups.values())]
    first = reduce(DataFrame.union, found).filter("_named is not null")  # at most one row a group
    group = F.array_compact(F.array(*[F.when(holds("name", ws), F.lit(g)) for g, ws in enumerate(groups.values())]))
    named = asked.select("platform", F.explode(group).alias("_g")).join(F.broadcast(first), "_g").groupBy("platform").agg(F.min_by("_named", "_g").alias("_named"))
    return platforms.join(by_url, "platform", "left").join(named, "platform", "left").select(*platforms.columns, F.coalesce("_by_url", "_named").alias("source"))


def canonical_rows(principles: DataFrame, by: str, controlled: list[str]) -> DataFrame:
    """Of each group the row to keep: one with a controlled slug if there is any, else the longest principle, then the first."""
    order = F.struct((~F.col("slug").isin(*controlled)).alias("free"), -F.char_length(F.coalesce("principle", F.lit(""))), "principle", "slug")
    return principles.groupBy(by).agg(F.min_by(F.struct("slug", "principle"), order).alias("row")).select(by, "row.slug", "row.principle")


def star_stats(alerts: DataFrame) -> DataFrame:
    """One row: alerts (starred, by_keyword, pushed, label) in all, those with a star, those with nothing but a star, and how these are marked."""
    only = F.col("starred") & ~F.col("by_keyword")
    count = lambda c, name: F.count_if(c).alias(name)
    return alerts.agg(
        F.count("*").alias("alerts"), count(F.col("starred"), "starred"), count(F.col("starred") & F.col("pushed"), "starred_push"),
        count(only, "vip_only"), count(only & F.col("pushed"), "vip_only_push"), count(only & F.col("label").isNotNull(), "marked"), count(only & F.col("label").isNull(), "unmarked"),
    )


def recall_stats(rows: DataFrame, kind: Column, least: float = 50) -> DataFrame:
    """One row: how many rows (score), the share under `least` and the mean score, and the same share of the rows of a kind."""
    score = F.coalesce("score", F.lit(0.0))
    share = lambda c, n: F.when(n > 0, F.floor(100 * c / n + 0.5))
    sums = rows.agg(F.count("*").alias("n"), F.count_if(score < least).alias("r"), F.sum(score.cast("decimal(20,4)")).alias("s"), F.count_if(kind).alias("k"), F.count_if(kind & (score < least)).alias("kr"))
    return sums.select("n", share(F.col("r"), F.col("n")).alias("reject_pct"), F.when(F.col("n") > 0, F.floor(F.col("s").cast("double") / F.col("n") + 0.5)).alias("avg"), F.col("k").alias("kind_n"), share(F.col("kr"), F.col("k")).alias("kind_reject_pct"))


def few_shot(rows: DataFrame, n: int) -> DataFrame:
    """The examples that a judge is shown: all pinned ones, and of the others so many that there are n in all, those of most support first.

    Of equal support the newest comes first, then the least id. With n pinned ones or more there are no others.
    """
    pinned = rows.filter("pinned")
    place = numbered(rows.filter("not coalesce(pinned, false)"), F.desc_nulls_last("support"), F.desc_nulls_last("at"), "id", name="_place")
    held = pinned.agg(F.count("*").alias("_held"))  # one row
    return pinned.unionByName(place.crossJoin(F.broadcast(held)).filter(F.col("_place") + F.col("_held") <= n).drop("_place", "_held"))


def latest_corrections(feedback: DataFrame, n: int) -> DataFrame:
    """The n newest corrections of feedback (id, at, predicted, actual): rows where what was predicted is not what was right."""
    wrong = feedback.filter("predicted is not null and actual is not null and predicted <> actual")
    return numbered(wrong, F.desc_nulls_last("at"), F.desc("id"), name="_place").filter(F.col("_place") <= n).drop("_place")


def reconciled(state: DataFrame, known: DataFrame, least: int = LEAST_KNOWN) -> DataFrame:
    """state (id, pending, ...) against known sources (id, enabled): unknown ids go, those of disabled sources lose what is pending.

    A list of fewer than `least` known ids was not read whole: nothing changes then.
    """
    k = known.select(F.col("id").alias("_id"), "enabled").distinct()
    sure = k.agg((F.count_distinct("_id") >= least).alias("_sure"))  # one row
    joined = state.join(k, state["id"] == k["_id"], "left").crossJoin(F.broadcast(sure)).filter(~F.col("_sure") | F.col("_id").isNotNull())
    cleared = F.when(F.col("_sure") & ~F.col("enabled"), False).otherwise(F.col("pending"))
    return joined.withColumn("pending", cleared).select(*state.columns)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    parts = [
        '{"id":', k, ',"name":"', F.when(k % 11 == 0, "ab").otherwise(F.concat(F.lit(" lot "), k)), '","money":{"sum":', F.col("o_totalprice").cast("decimal(20,2)"), ',"cur":"',
        F.when(k % 3 == 0, " ").otherwise("USD"), '"},"end":"', F.when(k % 4 == 0, "").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00Z"))), '","kinds":',
        F.when(k % 2 == 0, F.concat(F.lit('["a","","'), F.col("o_orderpriority"), F.lit('"]'))).otherwise(F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))), "}",
    ]
    return table(spark, sf_dir, "orders").select(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("raw"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"title": "name", "price": "money.sum", "currency": "money.cur", "deadline": "end", "categories": "kinds", "external_id": "code"}
    rows = mapped(_items(spark, sf_dir), fields, "src", F.lit("1997-01-01 00:00:00").cast("timestamp"), ("name", "money.cur"))
    return rows.withColumn("categories", F.array_join("categories", "|"))


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    kept = F.when(F.col("o_orderkey") % 4 == 0, F.lit("none")).otherwise(F.concat(F.lit('[{\\"t\\":\\"part '), k, F.lit('\\"},{\\"t\\":\\"same\\"}]')))
    raw = F.concat(F.lit('{"rows":[{"s":"same"},{"s":" "},{"s":"'), F.col("o_orderstatus"), F.lit('"}],"extra":"'), kept, F.lit('"}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", detail_text(raw, ["rows[*].s", "extra[*].t"], ("extra",)).alias("detail"))


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    incoming = c.select("c_custkey", F.col("c_name").alias("search_text"), F.when(k % 7 == 0, F.concat(F.lit("fresh "), k)).alias("detail_text"))
    search = F.when(k % 3 == 0, F.concat(F.lower("c_name"), F.lit("  | spec "), k, F.lit(" - "))).when(k % 3 == 1, F.lit("older text"))
    stored = c.filter("c_custkey % 10 < 8").select("c_custkey", search.alias("search_text"), F.when(k % 5 == 0, F.concat(F.lit("kept  "), k)).otherwise("").alias("detail_text"))
    return with_stored_details(incoming, stored, ["c_custkey"])


def _partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    stored = c.filter("c_custkey % 4 > 0").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    batch = c.filter("c_custkey % 3 > 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return partial_upsert(stored, batch, ["c_custkey"], ["c_name", "c_acctbal"])


def _civil(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return civil_results(
        wins(spark, sf_dir).select(
            F.when(k % 5 > 0, F.concat_ws("-", "id", "line")).alias("display_id"), F.when(k % 10 > 0, F.concat_ws("/", "id", "line")).alias("civil_contract_id"), F.col("title").alias("civil_name"),
            F.col("start_price").cast("double").alias("cost"), F.when(k % 3 > 0, F.col("won_price").cast("double")).alias("result_cost"), F.when(F.col("feed") == "F", "Сделка СОВЕРШЕНА").alias("status_name"),
            F.col("category").alias("customer_name"), F.when(k % 2 == 0, "Сом").when(k % 7 == 0, "USD").alias("currency_name"), "winner",
        )
    )


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("rows"), F.max("value").alias("top"), F.max(F.when(F.col("event_type") > "d", F.col("value"))).alias("late"))
    return metric_rows(e, "event_type")


def _pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("«Red AJ "), F.col("p_name"), F.lit("» (OAO) "), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", holds_pattern(name, ["red small", "ring promo", "widget economy"], r"\b(aj|oao|tijorat)\b").alias("hit"))


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wins(spark, sf_dir).select("id", "line", "feed", F.concat(F.lit("https://x/lot/"), "id").alias("url"), F.concat(F.lit("C-"), F.col("id") % 100).alias("civil"))
    lots = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("https://x/lot/"), "o_orderkey").alias("url"), F.concat(F.lit("C-"), F.col("o_orderkey") % 130).alias("civil"))
    return purchases_with_lots(w, lots, {"F": (F.col("url"), F.col("url")), "O": (F.col("civil"), F.col("civil"))}).select("id", "line", "feed", "lot")


#: Names of one operator, as a platform list and a source list write them.
OPERATORS = {"first": ["site 3", "site 4"], "second": ["shop s1", "site 11"], "third": ["s7", "new"]}


def _platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Site "), k % 40)).otherwise(F.concat(F.lit("shop s"), k % 60, F.lit(" new")))
    url = F.when(k % 4 == 0, F.concat(F.lit("HTTP://www.host"), k % 70, F.lit(".org/a"))).when(k % 4 == 1, F.concat(F.lit("https://shop.host"), k % 90, F.lit(".org")))
    n, s = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    sources = n.select(s.alias("place"), F.concat(F.lit("s"), s).alias("id"), F.concat(F.lit("site "), s).alias("name"), F.concat(F.lit("https://"), F.when(s % 2 == 0, "shop.").otherwise(""), F.lit("host"), s + 20, F.lit(".org/x")).alias("url"))
    return platform_sources(c.select(k.alias("platform"), name.alias("name"), url.alias("url")), sources, OPERATORS).select("platform", "source")


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return star_stats(table(spark, sf_dir, "events").select((k % 3 == 0).alias("starred"), (k % 2 == 0).alias("by_keyword"), (F.col("value") > 50).alias("pushed"), F.when(k % 5 == 0, "yes").alias("label")))


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("pending"))
    return reconciled(state, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_custkey") % 3 > 0).alias("enabled")))


QUERIES = {
    "p01_field_map": _mapped,
    "p19_civil_results": _civil,
    "p25_detail_text": _details,
    "k03_partial_upsert": _partial,
    "k04_stored_details": _restored,
    "k09_metric_rows": _metrics,
    "f26_holds_pattern": _pattern,
    "j15_purchases_with_lots": _bought,
    "j28_platform_sources": _platforms,
    "e16_canonical_rows": lambda spark, sf_dir: canonical_rows(table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("slug"), F.concat_ws(" ", "p_name", "p_size").alias("principle")), "p_brand", ["PROMO", "SMALL"]),
    "a48_star_stats": _stars,
    "a52_recall_stats": lambda spark, sf_dir: recall_stats(table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("score")), F.col("event_type") == "click"),
    "t09_few_shot": lambda spark, sf_dir: few_shot(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100 == 0).alias("pinned"), (F.col("o_custkey") % 50).alias("support"), F.col("o_orderdate").alias("at")), 400).select("id"),
    "t09_latest_corrections": lambda spark, sf_dir: latest_corrections(table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.lit("O").alias("predicted"), F.col("o_orderstatus").alias("actual")), 40).select("id"),
    "st07_reconciled": _reconciled,
}

_REST = "regexp_replace(substr(old, length(new) + 1), '^[ |·—\\-\\t]+|[ |·—\\-\\t]+$', '', 'g')"

SQL = {
    "p01_field_map": """SELECT 'src-' || o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS external_id, 'lot ' || o_orderkey AS title, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DOUBLE) AS price,
        CASE WHEN o_orderkey % 3 = 0 THEN 'UZS' ELSE 'USD' END AS currency, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00Z' END AS deadline,
        CASE WHEN o_orderkey % 2 = 0 THEN 'a|' ELSE '' END || o_orderpriority AS categories, CASE WHEN o_orderkey % 4 > 0 AND CAST(o_orderdate AS DATE) < DATE '1997-01-01' THEN 'closed' ELSE 'active' END AS status,
        'lot ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' USD' END AS search_text FROM orders WHERE o_orderkey % 11 > 0""",
    "p19_civil_results": f"""WITH {WINS}, c AS (SELECT *, CASE WHEN id % 5 > 0 THEN id || '-' || line WHEN id % 10 > 0 THEN id || '/' || line END AS ext, CAST(start_price AS DOUBLE) AS s, CASE WHEN id % 3 > 0 THEN nullif(CAST(won_price AS DOUBLE), 0) END AS f FROM wins)
        SELECT 'civil-' || ext AS external_id, title, category AS organization, s AS price, f AS winning_price, CASE WHEN id % 2 > 0 AND id % 7 = 0 THEN 'USD' ELSE 'UZS' END AS currency, winner,
        CASE WHEN feed = 'F' THEN 'completed' ELSE 'cancelled' END AS status, floor((s - f) / s * 1000 + 0.5) / 10 AS discount, title || ' ' || category || ' ' || winner AS search_text FROM c WHERE ext IS NOT NULL""",
    "p25_detail_text": """SELECT o_orderkey, 'same ' || o_orderstatus || CASE WHEN o_orderkey % 4 > 0 THEN ' part ' || o_orderkey ELSE '' END AS detail FROM orders""",
    "k03_partial_upsert": """SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS c_acctbal,
        CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 4 > 0 OR c_custkey % 3 > 0""",
    "k04_stored_details": f"""WITH r AS (SELECT c_custkey, c_name AS new, CASE WHEN c_custkey % 7 = 0 THEN 'fresh ' || c_custkey END AS mine, CASE WHEN c_custkey % 10 < 8 AND c_custkey % 5 = 0 THEN 'kept  ' || c_custkey END AS kept,
            CASE WHEN c_custkey % 10 >= 8 THEN '' WHEN c_custkey % 3 = 0 THEN lower(c_name) || ' | spec ' || c_custkey || ' -' WHEN c_custkey % 3 = 1 THEN 'older text' ELSE '' END AS old FROM customer),
        d AS (SELECT c_custkey, new, coalesce(mine, kept, CASE WHEN starts_with(lower(old), lower(new)) THEN nullif({_REST}, '') END) AS detail_text FROM r)
        SELECT c_custkey, CASE WHEN detail_text IS NULL THEN new ELSE replace(detail_text, '  ', ' ') || ' | ' || new END AS search_text, detail_text FROM d""",
    "k09_metric_rows": """WITH m AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS "rows", max(value) AS top FROM events GROUP BY 1)
        SELECT event_type, 'rows' AS metric, "rows" AS value FROM m UNION ALL SELECT event_type, 'top', top FROM m UNION ALL SELECT event_type, 'late', top FROM m WHERE event_type > 'd'""",
    "f26_holds_pattern": """WITH n AS (SELECT p_partkey, 'red ' || p_name || ' ' || lower(p_type) AS bare, 'red aj ' || p_name || ' oao ' || lower(p_type) AS whole FROM part)
        SELECT p_partkey, list_bool_or(list_transform(['red small', 'ring promo', 'widget economy'], lambda p: contains(bare, p) OR contains(whole, p))) AS hit FROM n""",
    "j15_purchases_with_lots": f"""WITH {WINS}, l AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), c AS (SELECT o_orderkey % 130 AS k, min(o_orderkey) AS lot FROM l GROUP BY 1)
        SELECT w.id, w.line, w.feed, CASE w.feed WHEN 'F' THEN l.o_orderkey WHEN 'O' THEN c.lot END AS lot FROM wins w LEFT JOIN l ON l.o_orderkey = w.id LEFT JOIN c ON c.k = w.id % 100""",
    "j28_platform_sources": f"""WITH p AS (SELECT c_custkey AS platform, CASE WHEN c_custkey % 3 = 0 THEN 'site ' || c_custkey % 40 ELSE 'shop s' || c_custkey % 60 || ' new' END AS name,
            CASE c_custkey % 4 WHEN 0 THEN 'host' || c_custkey % 70 || '.org' WHEN 1 THEN 'shop.host' || c_custkey % 90 || '.org' END AS d FROM customer),
        s AS (SELECT n_nationkey AS place, 's' || n_nationkey AS id, 'site ' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'shop.' ELSE '' END || 'host' || n_nationkey + 20 || '.org' AS d FROM nation),
        g AS (SELECT * FROM (VALUES {", ".join(f"({k}, {ws!r})" for k, ws in enumerate(OPERATORS.values()))}) v(g, ws)),
        gs AS (SELECT g, ws, arg_min(id, place) AS id FROM g, s WHERE len(list_filter(ws, lambda w: contains(s.id, w) OR contains(s.name, w))) > 0 GROUP BY ALL),
        u AS (SELECT platform, arg_min(s.id, s.place) AS id FROM p JOIN s ON p.d = s.d OR ends_with(p.d, '.' || s.d) OR ends_with(s.d, '.' || p.d) GROUP BY 1),
        n AS (SELECT platform, arg_min(gs.id, gs.g) AS id FROM p JOIN gs ON len(list_filter(gs.ws, lambda w: contains(p.name, w))) > 0 GROUP BY 1)
        SELECT p.platform, coalesce(u.id, n.id) AS source FROM p LEFT JOIN u ON u.platform = p.platform LEFT JOIN n ON n.platform = p.platform""",
    "e16_canonical_rows": """SELECT p_brand, p_type AS slug, p_name || ' ' || p_size AS principle FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_type NOT IN ('PROMO', 'SMALL'), -length(p_name || ' ' || p_size), p_name || ' ' || p_size, p_type) = 1""",
    "a48_star_stats": """WITH e AS (SELECT event_id % 3 = 0 AS s, event_id % 2 = 0 AS k, value > 50 AS p, event_id % 5 = 0 AS l FROM events)
        SELECT count(*) AS alerts, count(*) FILTER (WHERE s) AS starred, count(*) FILTER (WHERE s AND p) AS starred_push, count(*) FILTER (WHERE s AND NOT k) AS vip_only, count(*) FILTER (WHERE s AND NOT k AND p) AS vip_only_push,
        count(*) FILTER (WHERE s AND NOT k AND l) AS marked, count(*) FILTER (WHERE s AND NOT k AND NOT l) AS unmarked FROM e""",
    "a52_recall_stats": """WITH e AS (SELECT event_type = 'click' AS k, coalesce(CASE WHEN event_id % 9 > 0 THEN value END, 0) AS s FROM events)
        SELECT count(*) AS n, CAST(floor(100 * count(*) FILTER (WHERE s < 50)::DOUBLE / count(*) + 0.5) AS BIGINT) AS reject_pct, CAST(floor(CAST(sum(CAST(s AS DECIMAL(20,4))) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS avg,
        count(*) FILTER (WHERE k) AS kind_n, CAST(floor(100 * count(*) FILTER (WHERE k AND s < 50)::DOUBLE / count(*) FILTER (WHERE k) + 0.5) AS BIGINT) AS kind_reject_pct FROM e""",
    "t09_few_shot": """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 100 = 0 AS pinned, row_number() OVER (PARTITION BY o_orderkey % 100 = 0 ORDER BY o_custkey % 50 DESC, o_orderdate DESC, o_orderkey) AS place FROM orders)
        SELECT id FROM r WHERE pinned OR place <= 400 - (SELECT count(*) FROM r WHERE pinned)""",
    "t09_latest_corrections": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND o_orderstatus <> 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40",
    "st07_reconciled": """WITH k AS (SELECT DISTINCT o_custkey AS id FROM orders), g AS (SELECT count(*) >= 50 AS sure FROM k)
        SELECT c_custkey AS id, CASE WHEN sure AND c_custkey % 3 = 0 THEN false ELSE c_acctbal > 0 END AS pending FROM customer, g WHERE NOT sure OR c_custkey IN (SELECT id FROM k)""",
}
