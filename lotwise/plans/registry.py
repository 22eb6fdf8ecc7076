"""Registries of customers, competitors, sources and principles: links, verdict reuse, deliveries, bounded choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from ..views import LEDGER, TENDERS, WINS, anchored, ledger, tenders, total, wins

#: Cyrillic letters in Latin, one letter each, and those that need more.
CYRILLIC, LATIN = "абвгдезийклмнопрстуфхэыўқғҳ", "abvgdeziyklmnoprstufheiokgh"
LONG_LETTERS = (("ё", "yo"), ("ж", "j"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sh"), ("ъ", ""), ("ь", ""), ("ю", "yu"), ("я", "ya"))


def name_tokens(name: Column, legal: tuple[str, ...] = ()) -> Column:
    """Words of at least three letters, in Latin, without apostrophes and legal forms; q reads k and x reads h."""
    out = F.lower(F.coalesce(name, F.lit("")))
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), LONG_LETTERS, F.translate(out, CYRILLIC, LATIN))
    out = F.translate(F.regexp_replace(out, "[ʻʼ’‘`'´]", ""), "qx", "kh")
    return F.filter(F.split(out, "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & (~t.isin(*legal) if legal else F.lit(True)))


def name_candidates(suppliers: DataFrame, aliases: DataFrame, least: int = 6) -> DataFrame:
    """Suppliers whose normal name holds a registry alias of at least `least` characters: for review, never a link.

    The first `least` characters of an alias meet every run of as many characters of a name, once a name, so the comparison is
    an equi-join, then a test of the whole alias.
    """
    normal = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    s = suppliers.select("supplier", normal(F.col("supplier")).alias("name")).filter(F.length("name") >= least)
    runs = F.transform(F.sequence(F.lit(1), F.length("name") - F.lit(least) + 1), lambda i: F.substring(F.col("name"), i, F.lit(least)))
    s = s.withColumn("head", F.explode(F.array_distinct(runs)))
    a = aliases.select("alias", normal(F.col("alias")).alias("key")).filter(F.length("key") >= least).withColumn("head", F.substring("key", 1, least))
    return s.join(a, "head").filter(F.contains("name", "key")).select("supplier", "alias")


def reuse_verdicts(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """rows with the verdict known for their key: a person's before a machine's, then the newest."""
    order = F.struct((F.col("by") == "human").alias("human"), "at", "verdict")
    known = verdicts.groupBy(key).agg(F.max_by("verdict", order).alias("verdict"))
    return rows.join(known, key, "left")


def merge_outbox(outbox: DataFrame, current: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """What is still to be delivered: the outbox and what is current, the current row of a key winning, less the delivered."""
    both = outbox.withColumn("_o", F.lit(0)).unionByName(current.withColumn("_o", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_o"), *[c for c in outbox.columns if c != key])
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_o").join(delivered.select(key), key, "left_anti")


def toggled(favourites: DataFrame, clicks: DataFrame, key: str) -> DataFrame:
    """Favourites after clicks: each click adds what isn't there and removes what is, so an odd number changes it."""
    odd = clicks.groupBy(key).agg(F.count("*").alias("n")).filter("n % 2 = 1").select(key)
    return favourites.select(key).join(odd, key, "left_anti").union(odd.join(favourites.select(key), key, "left_anti"))


def consolidated(principles: DataFrame, by: str, least: int = 2) -> DataFrame:
    """Groups of at least `least` principles: the longest is canonical, supports add up."""
    n = principles.groupBy(by).agg(F.max_by("principle", F.struct(F.length("principle"), "principle")).alias("canonical"), F.sum("support").alias("support"), F.count("*").alias("merged"))
    return n.filter(F.col("merged") >= least)


def top_and_pinned(entities: DataFrame, score: str, name: str, top: int, pinned: list) -> DataFrame:
    """The first `top` by score with their place, and the pinned wherever they stand.

    The top comes from a bounded sort; a pinned entity's place is counted by comparing, not by ordering all.
    """
    best = entities.orderBy(F.desc(score), name).limit(top)
    kept = entities.filter(F.col(name).isin(*pinned)).unionByName(best).distinct()
    ahead = entities.select(F.col(score).alias("_s"), F.col(name).alias("_n"))
    before = (F.col("_s") > F.col(score)) | ((F.col("_s") == F.col(score)) & (F.col("_n") < F.col(name)))
    counts = ahead.join(F.broadcast(kept.select(name, score)), before).groupBy(name).agg(F.count("*").alias("ahead"))  # at most top + pinned rows
    return kept.join(counts, name, "left").select(name, score, (F.coalesce("ahead", F.lit(0)) + 1).alias("place"))


def median_filled(rows: DataFrame, value: str) -> DataFrame:
    """rows with missing values set to the exact median of those known.

    Distinct values are counted before the shuffle; running counts go by ranges of values first, so no task holds or orders
    all of them. One row is broadcast.
    """
    n = rows.select(F.col(value).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("c")).withColumn("slot", F.floor(F.asinh("v") * 64))
    slots = n.groupBy("slot").agg(F.sum("c").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(F.lit(1)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.select("slot", before.alias("before"), F.sum("s").over(Window.partitionBy(F.lit(1))).alias("all"))  # some thousand ranges at most
    upto = n.join(slots, "slot").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("slot").orderBy("v")))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    median = upto.agg(((at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2).alias("_m"))
    return rows.crossJoin(F.broadcast(median)).withColumn(value, F.coalesce(value, "_m")).drop("_m")


def seeded_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows, the same for the same seed: the least by a hash of key and seed."""
    return rows.orderBy(F.sha1(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def branch_numbers(rows: DataFrame, buyer: str, number: str) -> DataFrame:
    """A buyer's number where all of its rows that have one agree."""
    g = rows.filter(F.col(number).isNotNull()).groupBy(buyer).agg(F.min(number).alias(number), F.max(number).alias("_last"), F.count("*").alias("cards"))
    return g.filter(F.col(number) == F.col("_last")).drop("_last")


def budgeted(rows: DataFrame, by: str, value: str, cap: int) -> DataFrame:
    """The `cap` most valuable rows of each group: what a costly check is spent on."""
    w = Window.partitionBy(by).orderBy(F.desc(value), *[c for c in rows.columns if c not in (by, value)])
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)


def source_registry(config: DataFrame, rows: DataFrame, ts: str) -> DataFrame:
    """Configured sources with what is known of them, and unknown sources that are alive all the same."""
    seen = rows.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("cnt"), F.max(ts).alias("last"))
    joined = config.join(seen, "name", "full_outer")
    state = F.when(F.col("enabled").isNull(), "unknown").when(~F.col("enabled"), "disabled").when(F.col("cnt").isNull(), "never").otherwise("alive")
    return joined.select("name", F.coalesce("cnt", F.lit(0)).alias("cnt"), "last", state.alias("state"))


def reminders(lots: DataFrame, deadline: str, days: list[int], sent: DataFrame) -> DataFrame:
    """(id, kind): lots whose deadline is about `days` ahead, half a day either side, and that were not reminded of."""
    left = (F.unix_timestamp(F.col(deadline).cast("timestamp")) - F.unix_timestamp(F.col("now").cast("timestamp"))) / 86400.0
    due = lots.select("id", F.explode(F.array(*[F.when(F.abs(left - d) <= 0.5, F.lit(f"{d}d")) for d in days])).alias("kind")).filter("kind is not null")
    return due.join(sent, ["id", "kind"], "left_anti")


def entity_winners(rows: DataFrame, top: int = 3) -> DataFrame:
    """Each buyer's foremost winners by money."""
    by = rows.filter("buyer_inn is not null and profile <> 'none'").groupBy("buyer_inn", "winner").agg(F.sum("amount_uzs").alias("s"))
    return budgeted(by, "buyer_inn", "s", top).select("buyer_inn", "place", "winner", F.col("s").cast("double").alias("total"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    verdicts = e.select("user_id", F.col("event_type").alias("verdict"), F.when(F.col("value") > 80, "human").otherwise("ai").alias("by"), F.col("ts").alias("at"))
    return reuse_verdicts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), verdicts, "user_id")


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderkey").alias("o_orderkey"))
    part = lambda s: o.filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey")
    return merge_outbox(part("F"), part("O"), table(spark, sf_dir, "customer").filter("c_acctbal > 8000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


def _reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = anchored(table(spark, sf_dir, "orders"), "o_orderdate")
    rows = o.select(F.col("o_orderkey").alias("id"), F.expr("timestampadd(DAY, cast(o_orderkey % 7 as int), now)").alias("deadline"), "now", "o_orderstatus")
    sent = rows.filter("o_orderstatus = 'F'").select("id", F.lit("3d").alias("kind"))
    return reminders(rows, "deadline", [1, 3], sent)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = spark.createDataFrame([("click", True), ("view", False), ("purchase", True), ("fax", True)], "name string, enabled boolean")
    return source_registry(config, _events(spark, sf_dir).withColumnRenamed("event_type", "source"), "ts")


QUERIES = {
    "e13_name_tokens": lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", F.array_join(name_tokens(F.concat_ws(" ", F.lit("ООО Қўшчи Юг’ Экс"), "p_name", "p_type"), ("ooo",)), " ").alias("tokens")),
    "j10_name_candidates": lambda spark, sf_dir: name_candidates(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("supplier")).distinct(), table(spark, sf_dir, "part").select(F.col("p_name").alias("alias")).distinct()),
    "j19_source_registry": _registry,
    "j23_verdict_reuse": _reuse,
    "j25_reminders": _reminders,
    "j29_outbox": _outbox,
    "j31_toggled": lambda spark, sf_dir: toggled(table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k"),
    "a53_consolidated": lambda spark, sf_dir: consolidated(table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("principle"), F.col("p_size").cast("long").alias("support")), "p_brand"),
    "a59_entity_winners": lambda spark, sf_dir: entity_winners(ledger(spark, sf_dir)),
    "a72_branch_numbers": lambda spark, sf_dir: branch_numbers(wins(spark, sf_dir).select(F.concat_ws("/", "title", "feed").alias("buyer"), F.when(F.col("category") == "PROMO", F.col("winner_inn")).alias("number")).withColumn("buyer", F.concat_ws("#", "buyer", F.col("number") % 13)), "buyer", "number"),
    "w08_top_and_pinned": lambda spark, sf_dir: top_and_pinned(tenders(spark, sf_dir).groupBy("organization").agg(total("price").alias("score")), "score", "organization", 20, ["Customer#000000001", "Customer#000000007"]),
    "w12_median_filled": lambda spark, sf_dir: median_filled(_events(spark, sf_dir).select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value")), "value"),
    "t06_budgeted": lambda spark, sf_dir: budgeted(_events(spark, sf_dir).select("user_id", "value", "event_id"), "user_id", "value", 4),
    "t10_seeded_sample": lambda spark, sf_dir: seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "w42", 50),
    "u02_union_of_feeds": lambda spark, sf_dir: reduce(DataFrame.unionByName, [_events(spark, sf_dir).select(F.lit("events").alias("feed"), F.col("event_id").alias("id")), table(spark, sf_dir, "orders").select(F.lit("orders").alias("feed"), F.col("o_orderkey").alias("id"))]).groupBy("feed").agg(F.count("*").alias("cnt"), F.max("id").alias("last")),
    "w11_win_share": lambda spark, sf_dir: wins(spark, sf_dir).groupBy("winner_inn", "feed").agg(total("won_price").alias("total")).withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy("winner_inn")), 4)).select("winner_inn", "feed", "share"),
}

_TOKENS = "lower('ООО Қўшчи Юг’ Экс ' || p_name || ' ' || p_type)"
_LATIN = f"translate({_TOKENS}, '{CYRILLIC}', '{LATIN}')"
for _a, _b in LONG_LETTERS:
    _LATIN = f"replace({_LATIN}, '{_a}', '{_b}')"
_NORMAL = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

SQL = {
    "e13_name_tokens": f"""SELECT p_partkey, array_to_string(list_filter(string_split_regex(translate(regexp_replace({_LATIN}, '[ʻʼ’‘`''´]', '', 'g'), 'qx', 'kh'), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND t <> 'ooo'), ' ') AS tokens FROM part""",
    "j10_name_candidates": f"""WITH s AS (SELECT DISTINCT p_name || ' ' || p_brand AS supplier FROM part), a AS (SELECT DISTINCT p_name AS alias FROM part)
        SELECT supplier, alias FROM s JOIN a ON length({_NORMAL.format("alias")}) >= 6 AND contains({_NORMAL.format("supplier")}, {_NORMAL.format("alias")})""",
    "j19_source_registry": """WITH c(name, enabled) AS (VALUES ('click', true), ('view', false), ('purchase', true), ('fax', true)), s AS (SELECT event_type AS name, count(*) AS cnt, max(ts) AS last FROM events GROUP BY 1)
        SELECT coalesce(c.name, s.name) AS name, coalesce(cnt, 0) AS cnt, last, CASE WHEN enabled IS NULL THEN 'unknown' WHEN NOT enabled THEN 'disabled' WHEN cnt IS NULL THEN 'never' ELSE 'alive' END AS state FROM c FULL JOIN s ON s.name = c.name""",
    "j23_verdict_reuse": """WITH k AS (SELECT user_id, event_type AS verdict FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value > 80 DESC, ts DESC, event_type DESC) = 1)
        SELECT c_custkey AS user_id, c_name, verdict FROM customer LEFT JOIN k ON k.user_id = c_custkey""",
    "j25_reminders": "SELECT o_orderkey AS id, o_orderkey % 7 || 'd' AS kind FROM orders WHERE o_orderkey % 7 IN (1, 3) AND NOT (o_orderkey % 7 = 3 AND o_orderstatus = 'F')",
    "j29_outbox": """WITH o AS (SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS c, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
        SELECT o_custkey, coalesce(c, f) AS o_orderkey FROM o WHERE coalesce(c, f) IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000)""",
    "j31_toggled": """WITH f AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), d AS (SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING count(*) % 2 = 1)
        (SELECT k FROM f EXCEPT SELECT k FROM d) UNION ALL (SELECT k FROM d EXCEPT SELECT k FROM f)""",
    "a53_consolidated": """WITH p AS (SELECT p_brand, p_name || ' ' || p_type AS principle, p_size FROM part)
        SELECT p_brand, arg_max(principle, row(length(principle), principle)) AS canonical, CAST(sum(p_size) AS BIGINT) AS support, count(*) AS merged FROM p GROUP BY 1 HAVING count(*) >= 2""",
    "a59_entity_winners": f"""WITH {LEDGER}, b AS (SELECT buyer_inn, winner, sum(amount_uzs) AS s FROM ledger WHERE buyer_inn IS NOT NULL AND profile <> 'none' GROUP BY ALL)
        SELECT buyer_inn, CAST(row_number() OVER (PARTITION BY buyer_inn ORDER BY s DESC, winner) AS INTEGER) AS place, winner, CAST(s AS DOUBLE) AS total FROM b QUALIFY row_number() OVER (PARTITION BY buyer_inn ORDER BY s DESC, winner) <= 3""",
    "a72_branch_numbers": f"""WITH {WINS}, n AS (SELECT title || '/' || feed || '#' || winner_inn % 13 AS buyer, winner_inn AS number FROM wins WHERE category = 'PROMO')
        SELECT buyer, min(number) AS number, count(*) AS cards FROM n GROUP BY 1 HAVING min(number) = max(number)""",
    "w08_top_and_pinned": f"""WITH {TENDERS}, g AS (SELECT organization, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) AS score FROM tenders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, organization) AS place FROM g)
        SELECT organization, score, place FROM r WHERE place <= 20 OR organization IN ('Customer#000000001', 'Customer#000000007')""",
    "w12_median_filled": "WITH e AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS value FROM events) SELECT event_id, coalesce(value, (SELECT median(value) FROM e)) AS value FROM e",
    "t06_budgeted": "SELECT user_id, value, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS place FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 4",
    "t10_seeded_sample": "SELECT o_orderkey FROM orders ORDER BY sha1('w42|' || o_orderkey), o_orderkey LIMIT 50",
    "u02_union_of_feeds": "SELECT 'events' AS feed, count(*) AS cnt, max(event_id) AS last FROM events UNION ALL SELECT 'orders', count(*), max(o_orderkey) FROM orders",
    "w11_win_share": f"""WITH {WINS}, g AS (SELECT winner_inn, feed, CAST(sum(won_price) AS DOUBLE) AS total FROM wins GROUP BY ALL) SELECT winner_inn, feed, round(total / sum(total) OVER (PARTITION BY winner_inn), 4) AS share FROM g""",
}
