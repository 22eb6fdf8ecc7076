"""Conversion of source records: statuses, labels, titles, search text, awards and their discounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import table
from ..views import WINS, wins
from .identity import LOTS, lots, sql_org

#: What platforms call an open and a closed lot.
OPEN, CLOSED = ("open", "publicated", "active"), ("close", "closed", "cancel", "cancelled", "not_realized")


def platform_status(raw: Column) -> Column:
    """closed for what platforms call so, else active: an unknown status is no reason to lose a lot."""
    return F.when(F.lower(F.trim(F.coalesce(raw, F.lit("")))).isin(*CLOSED), "closed").otherwise("active")


def remaining(seconds: Column) -> Column:
    """Minutes under an hour, hours under a day, else days; null for nothing left."""
    return (
        F.when(seconds <= 0, None)
        .when(seconds < 3600, F.concat(F.lit("~"), F.greatest(F.lit(1), F.floor(seconds / 60)).cast("string"), F.lit(" min")))
        .when(seconds < 86400, F.concat(F.lit("~"), F.floor(seconds / 3600).cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.lit("~"), F.floor(seconds / 86400).cast("string"), F.lit(" d")))
    )


def discount_pct(start: Column, final: Column) -> Column:
    """Percent below the start price, one digit; null if either is not positive or the final price is higher."""
    s, f = start.cast("double"), final.cast("double")
    return F.when((s > 0) & (f > 0) & (f <= s), F.round((s - f) / s * 100, 1))


def winner_number(winner: Column) -> Column:
    """The number within «name (ИНН 123456789)»; null without one."""
    return F.nullif(F.regexp_extract(winner, r"\(ИНН\s*(\d+)\)", 1), F.lit(""))


def winner_name(winner: Column) -> Column:
    """The name without the number's bracket; the number if there is no name; '' for a hidden winner."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(winner, F.lit("")), r"\s*\(ИНН[^)]*\)", ""), r"^[ ,]+|[ ,]+$", ""))
    return F.when(name != "", name).otherwise(F.coalesce(F.concat(F.lit("ИНН "), winner_number(winner)), F.lit("")))


def search_text(parts: list[Column], most: int = 2000) -> Column:
    return F.substring(text.collapse(F.concat_ws(" ", *parts)), 1, most)


def merged_text(existing: Column, additions: Column) -> Column:
    """existing with those additions that it doesn't hold yet: doing it twice changes nothing."""
    base = F.trim(F.coalesce(existing, F.lit("")))
    fresh = F.filter(additions, lambda a: ~F.contains(F.lower(base), F.lower(a)))
    return F.when(F.size(fresh) > 0, F.trim(F.concat_ws(" ", base, F.array_join(fresh, " ")))).otherwise(base)


def headline(title: Column, names: Column, limit: int) -> Column:
    """The distinct names of a lot's positions as far as they fit, and how many more; the title if there are none.

    One pass over the array: the state is what is shown, how many of it, and whether something did not fit.
    """
    clean = F.array_distinct(F.filter(F.transform(names, lambda n: text.collapse(n)), lambda n: n != ""))
    start = F.struct(F.lit("").alias("shown"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(s: Column, name: Column) -> Column:
        longer = F.when(s["n"] == 0, name).otherwise(F.concat(s["shown"], F.lit(", "), name))
        fits = ~s["full"] & ((s["n"] == 0) | (F.length(longer) <= limit))
        return F.struct(F.when(fits, longer).otherwise(s["shown"]).alias("shown"), (s["n"] + fits.cast("int")).alias("n"), (~fits).alias("full"))

    out = F.aggregate(clean, start, step)
    more = F.size(clean) - out["n"]
    return F.when(F.size(clean) == 0, title).otherwise(F.concat(out["shown"], F.when(more > 0, F.concat(F.lit(" и ещё "), more.cast("string"))).otherwise("")))


def awards(rows: DataFrame) -> DataFrame:
    """One schema for awards: winner, number, discount, and whether the row is a win (a hidden winner is none)."""
    name, number = winner_name(F.col("winner")), winner_number(F.col("winner"))
    return rows.select("id", "line", F.nullif(name, F.lit("")).alias("winner_name"), text.normalize_inn(number).alias("inn"), discount_pct(F.col("start_price"), F.col("won_price")).alias("discount"), (name != "").alias("is_win"))


def recheck_due(since: Column, checked: Column, now: Column) -> Column:
    """Whether a waiting lot is to be looked at again: each run on its first day, every 6 hours to its third, then every 12."""
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    age = seconds(now) - seconds(since)
    every = F.when(age < 86400, 0).when(age < 3 * 86400, 6 * 3600).otherwise(12 * 3600)
    return F.coalesce(seconds(now) - seconds(checked) >= every, F.lit(True))


def fuzzy_codes(codes: Column, include: list[str], exclude: list[str]) -> Column:
    """Classification by code prefixes, exclusion first."""
    any_of = lambda prefixes: F.exists(codes, lambda c: F.array_contains(F.transform(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(c, p)), True))
    return F.when(F.size(codes) == 0, "none").when(any_of(exclude), "exclude").when(any_of(include), "include").otherwise("other")


def _awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wins(spark, sf_dir)
    shown = F.when(F.col("winner_inn") % 5 == 0, "(ИНН )").when(F.col("winner_inn") % 5 == 1, F.concat(F.lit("(ИНН "), F.lpad(F.col("winner_inn").cast("string"), 9, "7"), F.lit(")"))).otherwise(F.concat("winner", F.lit(" (ИНН "), F.lpad(F.col("winner_inn").cast("string"), 9, "3"), F.lit(")")))
    return awards(w.withColumn("winner", shown))


def _headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    names = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat_ws(" ", "p_name", "p_brand"))).alias("names"))
    return names.select("l_orderkey", headline(F.lit("rubric"), F.col("names"), 45).alias("headline"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", merged_text(F.col("p_name"), F.array(F.upper(F.substring_index("p_name", " ", 1)), F.col("p_brand"), F.col("p_type"))).alias("text"))


QUERIES = {
    "p11_remaining": lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", remaining(F.floor(F.col("value") * F.col("value") * 10) - 50).alias("label")),
    "p12_platform_status": lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", platform_status(F.element_at(F.array(*map(F.lit, ("Open", "closed ", "new", "CANCELLED", "not_realized", "publicated"))), (F.col("event_id") % 6 + 1).cast("int"))).alias("status")),
    "p16_awards": _awards,
    "p22_headline": _headlines,
    "p24_merged_text": _merged,
    "p10_search_text": lambda spark, sf_dir: lots(spark, sf_dir).select("id", search_text([F.col("title"), F.col("organization"), F.col("search_text")]).alias("search_text")),
    "f32_recheck_due": lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", recheck_due(F.col("ts"), F.when(F.col("event_id") % 9 > 0, F.col("ts") + F.expr("INTERVAL 20 HOURS")), F.lit("2024-01-05 00:00:00").cast("timestamp")).alias("due")),
    "f16_code_class": lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", fuzzy_codes(F.filter(F.array(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("49"), F.col("p_size"))).otherwise("")), lambda c: F.length(c) > 1), ["49", "12"], ["1", "491"]).alias("kind")),
    "f15_niche": lambda spark, sf_dir: lots(spark, sf_dir).select("id", (F.lower("title").rlike("tion|que|en ") & ~F.lower("title").rlike("wh|les ")).alias("niche"), text.normalize_org(F.col("organization")).contains("the").alias("own")),
}

_L = "lower(title)"
SQL = {
    "p11_remaining": """WITH s AS (SELECT event_id, CAST(floor(value * value * 10) AS BIGINT) - 50 AS s FROM events)
        SELECT event_id, CASE WHEN s <= 0 THEN NULL WHEN s < 3600 THEN '~' || greatest(1, s // 60) || ' min' WHEN s < 86400 THEN '~' || s // 3600 || ' h' ELSE '~' || s // 86400 || ' d' END AS label FROM s""",
    "p12_platform_status": "SELECT event_id, CASE WHEN event_id % 6 IN (1, 3, 4) THEN 'closed' ELSE 'active' END AS status FROM events",
    "p16_awards": f"""WITH {WINS} SELECT id, line, CASE WHEN winner_inn % 5 = 0 THEN NULL WHEN winner_inn % 5 = 1 THEN 'ИНН ' || lpad(CAST(winner_inn AS VARCHAR), 9, '7') ELSE winner END AS winner_name,
        CASE WHEN winner_inn % 5 = 0 THEN NULL WHEN winner_inn % 5 = 1 THEN lpad(CAST(winner_inn AS VARCHAR), 9, '7') ELSE lpad(CAST(winner_inn AS VARCHAR), 9, '3') END AS inn,
        CASE WHEN start_price > 0 AND won_price > 0 AND won_price <= start_price THEN round((CAST(start_price AS DOUBLE) - CAST(won_price AS DOUBLE)) / CAST(start_price AS DOUBLE) * 100, 1) END AS discount, winner_inn % 5 <> 0 AS is_win FROM wins""",
    "p22_headline": """WITH n AS (SELECT DISTINCT l_orderkey, p_name || ' ' || p_brand AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
        c AS (SELECT *, row_number() OVER w AS k, sum(length(name) + 2) OVER w - 2 AS upto FROM n WINDOW w AS (PARTITION BY l_orderkey ORDER BY name)),
        g AS (SELECT l_orderkey, count(*) AS n, string_agg(name, ', ' ORDER BY k) FILTER (WHERE k = 1 OR upto <= 45) AS shown, count(*) FILTER (WHERE k = 1 OR upto <= 45) AS m FROM c GROUP BY 1)
        SELECT l_orderkey, shown || CASE WHEN n > m THEN ' и ещё ' || (n - m) ELSE '' END AS headline FROM g""",
    "p24_merged_text": """SELECT p_partkey, trim(p_name) || CASE WHEN contains(lower(p_name), lower(p_brand)) THEN '' ELSE ' ' || p_brand END || CASE WHEN contains(lower(p_name), lower(p_type)) THEN '' ELSE ' ' || p_type END AS text FROM part""",
    "p10_search_text": f"WITH {LOTS} SELECT id, substr(trim(regexp_replace(title || ' ' || organization || ' ' || search_text, '\\s+', ' ', 'g')), 1, 2000) AS search_text FROM lots",
    "f32_recheck_due": """WITH e AS (SELECT event_id, epoch(TIMESTAMP '2024-01-05') - epoch(date_trunc('second', ts)) AS age, CASE WHEN event_id % 9 > 0 THEN epoch(TIMESTAMP '2024-01-05') - epoch(date_trunc('second', ts)) - 72000 END AS rest FROM events)
        SELECT event_id, coalesce(rest >= CASE WHEN age < 86400 THEN 0 WHEN age < 259200 THEN 21600 ELSE 43200 END, true) AS due FROM e""",
    "f16_code_class": """WITH c AS (SELECT p_partkey, list_filter([CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN '49' || p_size ELSE '' END], lambda c: length(c) > 1) AS cs FROM part)
        SELECT p_partkey, CASE WHEN len(cs) = 0 THEN 'none' WHEN len(list_filter(cs, lambda c: starts_with(c, '1') OR starts_with(c, '491'))) > 0 THEN 'exclude' WHEN len(list_filter(cs, lambda c: starts_with(c, '49') OR starts_with(c, '12'))) > 0 THEN 'include' ELSE 'other' END AS kind FROM c""",
    "f15_niche": f"WITH {LOTS} SELECT id, regexp_matches({_L}, 'tion|que|en ') AND NOT regexp_matches({_L}, 'wh|les ') AS niche, contains({sql_org('organization')}, 'the') AS own FROM lots",
}
