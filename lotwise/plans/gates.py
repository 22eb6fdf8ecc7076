"""Single gates of the prefilter and of reports, and the projections that make lots, wins and positions of raw records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import either
from ..session import table
from ..views import LEDGER, TENDERS, WINS, anchored, ledger, tenders, wins

#: Fixed value: lots in UZS below this price are not judged.
LEAST_PRICE = 5_000_000


def filled(c: Column | str) -> Column:
    """Text without blanks at its ends, null where nothing is left."""
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def price_gate(price: Column, currency: Column, is_lead: Column, least: float = LEAST_PRICE) -> Column:
    """Unknown prices, prices from `least`, leads and other currencies pass."""
    return either(price.isNull(), price >= least, is_lead, currency != "UZS")


def stale(deadline: Column, now: Column, days: int = 365) -> Column:
    """The deadline is more than `days` before now; an unknown one is not stale."""
    return F.coalesce(F.to_date(deadline) < F.date_sub(F.to_date(now), days), F.lit(False))


def any_prefix(codes: Column, prefixes: list[str]) -> Column:
    return F.coalesce(F.exists(codes, lambda c: reduce(Column.__or__, [F.startswith(c, F.lit(p)) for p in prefixes])), F.lit(False))


def all_rejected(positions: Column, pattern: str) -> Column:
    """There are positions, and each is of a rejected kind."""
    return F.coalesce((F.size(positions) > 0) & F.forall(positions, lambda p: p.rlike(pattern)), F.lit(False))


def squeezed(text: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def mentions(text: Column, names: list[str]) -> Column:
    """Any of the names is in the text, white space and case apart."""
    own = squeezed(text)
    return either(*[own.contains(" ".join(n.lower().split())) for n in names])


def second_chance(lots: DataFrame, day_from: str, day_to: str, least: float, no_push: list[str]) -> DataFrame:
    """Lots of some days that were neither alerted nor judged, with no price or enough of it, of sources that may push."""
    when = (F.col("collected_at") >= F.lit(day_from).cast("timestamp")) & (F.col("collected_at") < F.lit(day_to).cast("timestamp"))
    open_ = F.col("alert_seq").isNull() & F.col("relevance_score").isNull() & (F.col("price").isNull() | (F.col("price") >= least))
    return lots.filter(when & open_ & ~F.col("source").isin(*no_push))


def shadow_match(text: Column, price: Column, any_of: list[str], context: list[str], least: float) -> Column:
    """true or false by any keyword and, where there are context words, any of them; null where the price is unknown."""
    own = squeezed(text)
    hit = either(*[own.contains(w) for w in any_of]) & (either(*[own.contains(w) for w in context]) if context else F.lit(True))
    return F.when(~hit, False).when(price.isNotNull(), price >= least)


def in_days(day: Column, first: str, last: str) -> Column:
    """Within the days, both included; null for an unknown day."""
    return F.try_to_timestamp(day.cast("string")).cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def qualified(purchases: DataFrame, statuses: list[str], least: float) -> DataFrame:
    """Purchases of a status that counts, of enough money, and not in the future."""
    return purchases.filter(F.col("status").isin(*statuses) & (F.col("amount_uzs") >= least) & (F.col("awarded_on") <= F.to_date("now")))


def needs_details(feed: Column, always: str, category: Column, pattern: str) -> Column:
    return F.when(feed == always, True).otherwise(F.coalesce(category.rlike(pattern), F.lit(False)))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """The keywords that are in the text, in the order given."""
    own = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(own, F.lower(k)))


def rewritten(url: Column, rules: list[tuple[str, str]]) -> Column:
    """The url after the first rule whose pattern it has; unchanged if none."""
    return reduce(lambda rest, r: F.when(url.rlike(r[0]), F.regexp_replace(url, r[0], r[1])).otherwise(rest), reversed(rules), url)


def route(status: Column, published: list[str], pending: list[str]) -> Column:
    """published by the beginning of the status text, pending by a hint in it, else drop."""
    own = F.lower(F.coalesce(status, F.lit("")))
    return F.when(either(*[own.startswith(p) for p in published]), "published").when(either(*[own.contains(p) for p in pending]), "pending").otherwise("drop")


def registry_faults(entities: DataFrame, key: str, number: str, name: str) -> DataFrame:
    """(fault, cnt): keys and numbers that several rows have, and rows without a name. A sound registry has no row here."""
    twice = lambda c: entities.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1").select(F.lit(f"repeated {c}").alias("fault"))
    unnamed = entities.filter(filled(name).isNull()).select(F.lit("no name").alias("fault"))
    return twice(key).union(twice(number)).union(unnamed).groupBy("fault").agg(F.count("*").alias("cnt"))


def money_of_items(items: Column) -> Column:
    """Sum of quantity times price over (quantity, price) structs; null unless positive."""
    s = F.aggregate(items, F.lit(0).cast("decimal(20,2)"), lambda a, x: (a + (x["quantity"] * x["price"])).cast("decimal(20,2)"))
    return F.when(s > 0, s)


def price_times(price: Column, amount: Column) -> Column:
    """The price of all units; the unit price where the amount is unknown or 0."""
    return F.when(F.coalesce(amount, F.lit(0)) == 0, price).otherwise(price * amount)


def first_filled(*parts: Column) -> Column:
    return F.coalesce(*[filled(p) for p in parts])


def external_id(link: Column, pattern: str, *fallback: Column) -> Column:
    """From a link: what the pattern's group finds, else its first digits, its last segment, a digest of the fallback."""
    own = F.coalesce(link, F.lit(""))
    segment = F.regexp_extract(own, r"([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.coalesce(
        filled(F.regexp_extract(own, pattern, 1)), filled(F.regexp_extract(own, r"(\d+)", 1)), filled(segment), F.substring(F.md5(F.concat_ws("|", *fallback).cast("binary")), 1, 12)
    )


def joined_titles(titles: Column, most: int = 1000) -> Column:
    """Distinct titles in their order, joined, cut to `most` characters: a card's display field."""
    return F.substring(F.array_join(F.array_distinct(F.filter(titles, lambda t: F.trim(t) != "")), "; "), 1, most)


def distinct_positions(positions: Column) -> Column:
    """Positions in their order, each once whatever its case."""
    lowered = F.transform(positions, lambda p: F.lower(p))
    return F.filter(positions, lambda p, i: F.array_position(lowered, F.lower(p)) == i + 1)


def win_rows(deals: DataFrame, winner: str, customer: str) -> DataFrame:
    """Deals with a named winner other than the customer, and the discount in percent of a positive start price."""
    shown = filled(winner).isNotNull() & (F.lower(F.trim(winner)) != F.lower(F.trim(customer))) & ~F.col(winner).rlike(r"^\(ИНН\s*\)$")
    pct = F.when(F.col("start_price") > 0, F.round((F.col("start_price") - F.col("won_price")).cast("double") / F.col("start_price").cast("double") * 100, 1))
    return deals.filter(shown).withColumn("discount", pct)


def without_winner(text: Column, winner: Column) -> Column:
    """The text with the winner's name cut out, so that it can't leak into matching."""
    return F.trim(F.regexp_replace(F.replace(text, winner, F.lit("")), r"\s+", " "))


def converted(raw: DataFrame, cost: str, parts: list[str], end: str) -> DataFrame:
    """A feed's row as a lot: a cost of 0 is unknown, region of the parts there are, open while its end is ahead."""
    return raw.select(
        "id",
        F.coalesce(filled("title"), F.concat(F.lit("#"), F.col("id").cast("string"))).alias("title"),
        F.nullif(F.col(cost), F.lit(0.0)).alias("price"),
        F.concat_ws(", ", *[filled(p) for p in parts]).alias("region"),
        F.when(F.col(end) > F.col("now"), "open").otherwise("closed").alias("status"),
    )


def result_positions(urls: DataFrame, key: str, url: str) -> DataFrame:
    """Search results of a group with their place and domain; the raw link where there is no host."""
    listed = urls.groupBy(key).agg(F.sort_array(F.collect_list(url)).alias("urls"))
    at = listed.select(key, F.posexplode("urls").alias("i", "url"))
    host = F.regexp_replace(F.regexp_extract("url", r"://([^/?#:]+)", 1), r"^www\.", "")
    return at.select(key, (F.col("i") + 1).alias("place"), F.coalesce(filled(host), F.col("url")).alias("domain"))


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots with a currency, and some without a price."""
    t = tenders(spark, sf_dir)
    return t.withColumn("currency", F.when(F.col("id") % 5 == 0, "USD").otherwise("UZS")).withColumn("price", F.when(F.col("id") % 7 != 0, F.col("price") * 20))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(_parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p_name")).alias("positions"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("l_quantity").cast("decimal(10,2)").alias("quantity"), (F.col("l_extendedprice") - 50000).cast("decimal(12,2)").alias("price"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")).alias("alert_seq"), F.when(F.col("o_orderkey") % 3 == 0, 50).alias("relevance_score"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.col("o_orderdate").alias("collected_at"), F.col("o_orderpriority").alias("source"),
    )


def _codes() -> Column:
    return F.array(*[F.concat(F.lit(head), F.lpad(F.col("p_size").cast("string"), 2, "0")) for head in ("39", "48")])


_REWRITES = [(r"^http://([^/]+)\.example\.com/", "https://$1.com.example/"), (r"^http://", "https://"), (r"\?.*$", "")]

QUERIES = {
    "f07_price_gate": lambda spark, sf_dir: _lots(spark, sf_dir).select("id", price_gate(F.col("price"), F.col("currency"), F.col("status") == "P").alias("passes")),
    "f09_stale": lambda spark, sf_dir: anchored(tenders(spark, sf_dir), "collected_at").filter(stale(F.col("collected_at"), F.col("now"))).select("id"),
    "f11_code_prefix": lambda spark, sf_dir: _parts(spark, sf_dir).select("p_partkey", any_prefix(_codes(), ["391", "4805"]).alias("in_scope")),
    "f12_all_rejected": lambda spark, sf_dir: _positions(spark, sf_dir).select("l_orderkey", all_rejected(F.col("positions"), "ring|bolt|gear").alias("rejected")),
    "f13_category_bypass": lambda spark, sf_dir: wins(spark, sf_dir).filter(F.col("feed").isin("O") & F.col("title").rlike("widget|bolt")).select("id", "line"),
    "f14_own_lot": lambda spark, sf_dir: _parts(spark, sf_dir).select("p_partkey", mentions(F.concat_ws("  ", "p_name", "p_type"), ["WIDGET  Promo", "bolt small"]).alias("own")),
    "f18_country": lambda spark, sf_dir: tenders(spark, sf_dir).filter(F.contains(F.upper("region"), F.lit("AN"))).select("id", "region"),
    "f19_second_chance": lambda spark, sf_dir: second_chance(_scored(spark, sf_dir), "1996-01-01", "1997-01-01", 50000, ["1-URGENT"]).select("id"),
    "f20_shadow_match": lambda spark, sf_dir: wins(spark, sf_dir).select("id", "line", shadow_match(F.concat_ws(" ", "title", "category"), F.when(F.col("line") != 3, F.col("won_price")), ["red", "blue"], ["promo", "small"], 20000).alias("match")),
    "f22_award_days": lambda spark, sf_dir: ledger(spark, sf_dir).filter(in_days(F.col("awarded_on"), "1997-03-01", "1997-04-30")).select("business_id"),
    "f23_qualified": lambda spark, sf_dir: qualified(anchored(ledger(spark, sf_dir), "awarded_on"), ["accepted", "protocol"], 40000).select("business_id"),
    "f24_needs_details": lambda spark, sf_dir: ledger(spark, sf_dir).filter(needs_details(F.col("feed"), "feed_O", F.col("subject"), "ring|nut")).select("business_id"),
    "f25_off_profile": lambda spark, sf_dir: ledger(spark, sf_dir).filter(~((F.col("profile") == "none") & F.col("buyer_type").isin("MACHINERY", "BUILDING"))).select("business_id"),
    "f27_prescreen": lambda spark, sf_dir: _parts(spark, sf_dir).select("p_partkey", F.col("p_name").rlike("red|green").alias("kw_hit"), F.col("p_type").rlike("PROMO|SMALL").alias("wide_hit")).filter("kw_hit or wide_hit"),
    "f28_keyword_hits": lambda spark, sf_dir: _parts(spark, sf_dir).select("p_partkey", F.array_join(keyword_hits(F.concat_ws(" ", "p_name", "p_type"), ["Widget", "eco", "Small", "red"]), ",").alias("hits")),
    "f29_recall_pull": lambda spark, sf_dir: anchored(_scored(spark, sf_dir), "collected_at").filter((F.col("alert_seq").isNull()) & (F.col("collected_at") > F.col("now") - F.expr("INTERVAL 14 DAYS")) & F.col("source").rlike("LOW|HIGH")).select("id"),
    "f30_rewritten": lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", rewritten(F.col("url"), _REWRITES).alias("url")),
    "f31_registry_faults": lambda spark, sf_dir: registry_faults(_parts(spark, sf_dir).select("p_partkey", "p_size", F.when(F.col("p_partkey") % 50 != 0, F.col("p_name")).alias("p_name")), "p_partkey", "p_size", "p_name"),
    "f33_route": lambda spark, sf_dir: tenders(spark, sf_dir).select("id", route(F.concat_ws(" ", "source", "category"), ["build", "auto"], ["urgent", "low"]).alias("route")),
    "p05_items_money": lambda spark, sf_dir: _items(spark, sf_dir).select("l_orderkey", money_of_items(F.col("items")).cast("double").alias("price")),
    "p06_price_times": lambda spark, sf_dir: table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", price_times(F.col("l_tax"), F.when(F.col("l_linenumber") > 2, F.col("l_quantity"))).alias("price")).distinct(),
    "p08_first_filled": lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", first_filled(F.when(F.col("doc_id") % 3 == 0, F.lit("  ")), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("lang")).alias("title")),
    "p15_external_id": lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", external_id(F.when(F.col("page_id") % 9 != 0, F.col("url")), r"[?&]id=(\d+)", F.col("page_id").cast("string"), F.lit("org"), F.lit("source")).alias("external_id")),
    "p18_joined_titles": lambda spark, sf_dir: _positions(spark, sf_dir).select("l_orderkey", joined_titles(F.col("positions")).alias("titles")),
    "p20_win_rows": lambda spark, sf_dir: win_rows(wins(spark, sf_dir).withColumn("winner", F.when(F.col("line") != 2, F.col("winner")).otherwise("(ИНН )")).withColumn("customer", F.lit("Supplier#000000003")), "winner", "customer").select("id", "line", "start_price", "discount"),
    "p21_without_winner": lambda spark, sf_dir: wins(spark, sf_dir).select("id", "line", without_winner(F.concat_ws(" ", "title", "winner", "category"), F.col("winner")).alias("text")),
    "p23_distinct_positions": lambda spark, sf_dir: _positions(spark, sf_dir).select("l_orderkey", F.array_join(distinct_positions(F.concat(F.col("positions"), F.transform("positions", F.upper))), "|").alias("positions")),
    "p30_converted": lambda spark, sf_dir: converted(anchored(_lots(spark, sf_dir), "collected_at").select("id", F.when(F.col("id") % 3 != 0, F.col("category")).alias("title"), F.when(F.col("id") % 11 != 0, F.col("price")).otherwise(0.0).alias("cost"), "region", F.when(F.col("id") % 2 == 0, F.col("source")).otherwise(" ").alias("district"), F.expr("timestampadd(DAY, cast(id % 3000 as int), collected_at)").alias("end"), "now"), "cost", ["region", "district"], "end"),
    "p35_result_positions": lambda spark, sf_dir: result_positions(table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("query"), F.when(F.col("page_id") % 17 != 0, F.col("url")).otherwise("broken").alias("url")), "query", "url"),
}

_LOTS = f"{TENDERS}, lots AS (SELECT * REPLACE (CASE WHEN id % 7 <> 0 THEN price * 20 END AS price), CASE WHEN id % 5 = 0 THEN 'USD' ELSE 'UZS' END AS currency FROM tenders)"
_POSITIONS = "pos AS (SELECT l_orderkey, list_sort(list(p_name)) AS positions FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"
_SCORED = "s AS (SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS alerted, o_orderkey % 3 = 0 AS judged, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, o_orderdate AS collected_at, o_orderpriority AS source FROM orders)"

SQL = {
    "f07_price_gate": f"WITH {_LOTS} SELECT id, price IS NULL OR price >= {LEAST_PRICE} OR status = 'P' OR currency <> 'UZS' AS passes FROM lots",
    "f09_stale": f"WITH {TENDERS} SELECT id FROM tenders WHERE CAST(collected_at AS DATE) < (SELECT CAST(max(collected_at) AS DATE) FROM tenders) - 365",
    "f11_code_prefix": "SELECT p_partkey, ('39' || lpad(CAST(p_size AS VARCHAR), 2, '0')) LIKE '391%' OR ('48' || lpad(CAST(p_size AS VARCHAR), 2, '0')) LIKE '4805%' AS in_scope FROM part",
    "f12_all_rejected": "SELECT l_orderkey, bool_and(regexp_matches(p_name, 'ring|bolt|gear')) AS rejected FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "f13_category_bypass": f"WITH {WINS} SELECT id, line FROM wins WHERE feed = 'O' AND regexp_matches(title, 'widget|bolt')",
    "f14_own_lot": "SELECT p_partkey, contains(lower(p_name || ' ' || p_type), 'widget promo') OR contains(lower(p_name || ' ' || p_type), 'bolt small') AS own FROM part",
    "f18_country": f"WITH {TENDERS} SELECT id, region FROM tenders WHERE contains(upper(region), 'AN')",
    "f19_second_chance": f"WITH {_SCORED} SELECT id FROM s WHERE NOT alerted AND NOT judged AND (price IS NULL OR price >= 50000) AND collected_at >= TIMESTAMP '1996-01-01' AND collected_at < TIMESTAMP '1997-01-01' AND source <> '1-URGENT'",
    "f20_shadow_match": f"""WITH {WINS} SELECT id, line, CASE WHEN NOT (regexp_matches(lower(title || ' ' || category), 'red|blue') AND regexp_matches(lower(title || ' ' || category), 'promo|small')) THEN false
        WHEN line <> 3 THEN won_price >= 20000 END AS match FROM wins""",
    "f22_award_days": f"WITH {LEDGER} SELECT business_id FROM ledger WHERE awarded_on BETWEEN DATE '1997-03-01' AND DATE '1997-04-30'",
    "f23_qualified": f"WITH {LEDGER} SELECT business_id FROM ledger WHERE status IN ('accepted', 'protocol') AND amount_uzs >= 40000",
    "f24_needs_details": f"WITH {LEDGER} SELECT business_id FROM ledger WHERE feed = 'feed_O' OR regexp_matches(subject, 'ring|nut')",
    "f25_off_profile": f"WITH {LEDGER} SELECT business_id FROM ledger WHERE NOT (profile = 'none' AND buyer_type IN ('MACHINERY', 'BUILDING'))",
    "f27_prescreen": "SELECT p_partkey, regexp_matches(p_name, 'red|green') AS kw_hit, regexp_matches(p_type, 'PROMO|SMALL') AS wide_hit FROM part WHERE regexp_matches(p_name, 'red|green') OR regexp_matches(p_type, 'PROMO|SMALL')",
    "f28_keyword_hits": "SELECT p_partkey, array_to_string(list_filter(['Widget', 'eco', 'Small', 'red'], lambda k: contains(lower(p_name || ' ' || p_type), lower(k))), ',') AS hits FROM part",
    "f29_recall_pull": f"WITH {_SCORED} SELECT id FROM s WHERE NOT alerted AND collected_at > (SELECT max(collected_at) FROM s) - INTERVAL 14 DAYS AND regexp_matches(source, 'LOW|HIGH')",
    "f30_rewritten": r"""SELECT page_id, CASE WHEN regexp_matches(url, '^http://([^/]+)\.example\.com/') THEN regexp_replace(url, '^http://([^/]+)\.example\.com/', 'https://\1.com.example/')
        WHEN regexp_matches(url, '^http://') THEN regexp_replace(url, '^http://', 'https://') ELSE regexp_replace(url, '\?.*$', '') END AS url FROM pages""",
    "f31_registry_faults": """SELECT 'repeated p_size' AS fault, count(*) AS cnt FROM (SELECT p_size FROM part WHERE p_size IS NOT NULL GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
        UNION ALL SELECT 'no name', count(*) FROM part WHERE p_partkey % 50 = 0 HAVING count(*) > 0""",
    "f33_route": f"""WITH {TENDERS}, s AS (SELECT id, lower(source || ' ' || category) AS t FROM tenders)
        SELECT id, CASE WHEN t LIKE 'build%' OR t LIKE 'auto%' THEN 'published' WHEN t LIKE '%urgent%' OR t LIKE '%low%' THEN 'pending' ELSE 'drop' END AS route FROM s""",
    "p05_items_money": """WITH s AS (SELECT l_orderkey, sum(CAST(CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_extendedprice - 50000 AS DECIMAL(12,2)) AS DECIMAL(20,2))) AS s FROM lineitem GROUP BY 1)
        SELECT l_orderkey, CASE WHEN s > 0 THEN CAST(s AS DOUBLE) END AS price FROM s""",
    "p06_price_times": "SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 AND l_quantity <> 0 THEN l_tax * l_quantity ELSE l_tax END AS price FROM lineitem",
    "p08_first_filled": "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN nullif(trim(source), '') END, nullif(trim(lang), '')) AS title FROM documents",
    "p15_external_id": r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN coalesce(url, '') ELSE '' END AS url FROM pages)
        SELECT page_id, coalesce(nullif(trim(regexp_extract(url, '[?&]id=(\d+)', 1)), ''), nullif(trim(regexp_extract(url, '(\d+)', 1)), ''), nullif(trim(regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1)), ''), md5(page_id || '|org|source')[:12]) AS external_id FROM p""",
    "p18_joined_titles": f"WITH {_POSITIONS} SELECT l_orderkey, array_to_string(list_sort(list_distinct(positions)), '; ')[:1000] AS titles FROM pos",
    "p20_win_rows": f"""WITH {WINS} SELECT id, line, start_price, CASE WHEN start_price > 0 THEN round(CAST(start_price - won_price AS DOUBLE) / CAST(start_price AS DOUBLE) * 100, 1) END AS discount
        FROM wins WHERE line <> 2 AND lower(winner) <> 'supplier#000000003'""",
    "p21_without_winner": f"WITH {WINS} SELECT id, line, title || ' ' || category AS text FROM wins",
    "p23_distinct_positions": f"WITH {_POSITIONS} SELECT l_orderkey, array_to_string(list_sort(list_distinct(positions)), '|') AS positions FROM pos",
    "p30_converted": f"""WITH {_LOTS}, n AS (SELECT max(collected_at) AS now FROM lots)
        SELECT id, CASE WHEN id % 3 <> 0 THEN category ELSE '#' || id END AS title, CASE WHEN id % 11 <> 0 THEN nullif(price, 0) END AS price,
               CASE WHEN id % 2 = 0 THEN region || ', ' || source ELSE region END AS region, CASE WHEN collected_at + to_days(CAST(id % 3000 AS INTEGER)) > now THEN 'open' ELSE 'closed' END AS status FROM lots CROSS JOIN n""",
    "p35_result_positions": r"""WITH p AS (SELECT page_id % 20 AS query, CASE WHEN page_id % 17 <> 0 THEN url ELSE 'broken' END AS url FROM pages)
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY url) AS INTEGER) AS place, coalesce(nullif(regexp_replace(regexp_extract(url, '://([^/?#:]+)', 1), '^www\.', ''), ''), url) AS domain FROM p WHERE url IS NOT NULL""",
}
