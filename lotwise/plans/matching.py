"""Matching of lots, purchases and registries: by keys, by names, by time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import table, written
from ..views import TENDERS, WINS, tenders, wins
from . import identity
from .registry import name_tokens

#: Legal forms, and words that alone say nothing about identity.
LEGAL = tuple((
    "aj atb atib mchj mchzh ooo ao jsc llc dm duk uk xk hk kk qk gup dk chp ytt yatt sp at ruz ozr aksiyadorlik "
    "aktsionernoe obshchestvo jamiyati tijorat davlat unitar korhonasi respublikasi respubliki ozbekiston uzbekistan "
    "uzbekiston huzuridagi boshkarmasi filiali filial mark amal boshk"
).split())
GENERIC = tuple((
    "bank banki banka group grupp company kompaniya servis service trade house home center tsentr markaz markazi fond "
    "plus market shop studio lab pro invest holding zavod zavodi vazirligi agentligi agentstvo ministerstvo test admin "
    "klient chastnoe litso super sport auto avto city siti shahar shahri tuman tumani viloyat viloyati oblast tashkent "
    "toshkent samarkand samarqand buhara buhoro andijan andijon fergana fargona namangan navoi navoiy karshi termez "
    "termiz nukus horezm horazm jizzah jizzax sirdaryo kashkadaryo surhondaryo karakalpakstan koraqalpogiston "
    "korakalpogiston angren chirchik olmalik almalyk kokand kokon gulistan guliston"
).split())
#: Names of one token that one part of the join holds, about.
PART = 2000


def lot_outcomes(alerts: DataFrame, deals: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Alerts with what became of their lot: a deal wins over a failed auction, else unknown."""
    d = deals.groupBy(key).agg(F.min("winner").alias("winner"))
    f = failed.select(key).distinct().withColumn("no_deal", F.lit(True))
    joined = alerts.join(d, key, "left").join(f, key, "left")
    result = F.when(F.col("winner").isNotNull(), "deal").when(F.col("no_deal"), "no_deal").otherwise("unknown")
    return joined.select(*alerts.columns, "winner", result.alias("result"))


def twins_within(candidates: DataFrame, sent: DataFrame, keys: list[str], time: str, days: int) -> DataFrame:
    """Candidates without a sent row of the same key within `days` (either side); rows without a time are near nothing.

    Keys and times that repeat meet once, by equi-joins on the key and on slots of `days`: a key that a third of all rows has
    meets itself only within neighbouring slots.
    """
    second, width = F.unix_timestamp(F.col(time).cast("timestamp")), days * 86400
    kept, names = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], [f"_{i}" for i in range(len(keys))]
    slot = F.floor(F.col("_at") / max(width, 1))
    s = sent.select(*kept, second.alias("_at")).filter("_at is not null").distinct().withColumn("_slot", slot)
    c = candidates.select(*kept, second.alias("_at")).filter("_at is not null").distinct().withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    same = lambda a, b: reduce(lambda x, n: x & a[n].eqNullSafe(b[n]), names, F.lit(True))
    met = c.join(s, same(c, s) & (c["_slot"] == s["_slot"]) & (F.abs(c["_at"] - s["_at"]) <= width), "left_semi").drop("_slot").distinct()
    asked = candidates.select("*", *kept, second.alias("_at"))
    return asked.join(met, same(asked, met) & (asked["_at"] == met["_at"]), "left_anti").select(*candidates.columns)


def twins_or_reposts(candidates: DataFrame, sent: DataFrame, keys: list[str], time: str, deadline: str, days: int) -> DataFrame:
    """candidates with prev_deadline, less the twins: those with a sent row of the same key within `days` (either side).

    A candidate whose deadline is later than those of all its near sent rows is a repost: it stays, and prev_deadline is the
    latest of theirs. If one of the deadlines can't be read, it is a twin. Rows without a time are near nothing. Keys and times
    that repeat meet once, by equi-joins on the key and on slots of `days`.
    """
    second, width = F.unix_timestamp(F.col(time).cast("timestamp")), days * 86400
    slot = F.floor(F.col("_at") / max(width, 1))
    kept = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    names = [f"_{i}" for i in range(len(keys))]
    day = text.rough_day(F.col(deadline).cast("string"))
    s = sent.select(*kept, second.alias("_at"), day.alias("_day")).filter("_at is not null")
    s = s.groupBy(*names, "_at").agg(F.max("_day").alias("_last"), F.bool_or(F.col("_day").isNull()).alias("_unread")).withColumn("_slot", slot)
    c = candidates.select(*kept, second.alias("_at")).filter("_at is not null").distinct()
    c = c.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    same = lambda a, b, columns: reduce(lambda x, n: x & a[n].eqNullSafe(b[n]), columns, F.lit(True))
    met = c.join(s, same(c, s, names) & (c["_slot"] == s["_slot"]) & (F.abs(c["_at"] - s["_at"]) <= width))
    near = met.groupBy(*[c[n] for n in names], c["_at"]).agg(F.max("_last").alias("_last"), F.bool_or("_unread").alias("_unread"))
    asked = candidates.select("*", *kept, second.alias("_at"))
    joined = asked.join(near, same(asked, near, names) & (asked["_at"] == near["_at"]), "left")
    repost = ~F.col("_unread") & F.coalesce(day > F.col("_last"), F.lit(False))
    return joined.filter(F.col("_unread").isNull() | repost).select(*[asked[n] for n in candidates.columns], F.col("_last").alias("prev_deadline"))


def unique_aliases(names: DataFrame, least: int = 8) -> DataFrame:
    """(alias, entity) of names long enough that belong to one entity only."""
    return names.filter(F.length("alias") >= least).groupBy("alias").agg(F.min("entity").alias("entity"), F.max("entity").alias("last")).filter("entity = last").drop("last")


def entity_of(rows: DataFrame, numbers: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows with entity: by number first, else by a unique alias."""
    by_number = numbers.select(F.col("inn").alias("_inn"), F.col("entity").alias("_e1"))
    by_alias = aliases.select(F.col("alias").alias("_alias"), F.col("entity").alias("_e2"))
    joined = rows.join(by_number, F.col("inn") == F.col("_inn"), "left").join(by_alias, F.col("alias") == F.col("_alias"), "left")
    return joined.select(*rows.columns, F.coalesce("_e1", "_e2").alias("entity"))


def token_candidates(left: DataFrame, right: DataFrame, least: int = 4) -> DataFrame:
    """(id, other, tokens): all pairs of names that share a significant token; both sides give (id, name).

    Legal forms and the fixed generic words are no tokens; every other one counts, however common. An equi-join on tokens, in
    which a pair is given by the first token that it shares. A token's names on the left are dealt into parts of about PART,
    so that a common one isn't one task.
    """

    def tokens(df: DataFrame, name: str) -> DataFrame:
        held = F.filter(name_tokens(F.col("name"), LEGAL), lambda x: (F.length(x) >= least) & ~x.isin(*GENERIC))
        t = df.select(F.col("id").alias(name), F.array_sort(F.array_distinct(held)).alias(f"{name}_tokens"))
        return t.withColumn("token", F.explode(f"{name}_tokens"))

    mine, theirs = tokens(left, "id"), tokens(right, "other")
    parts = mine.groupBy("token").agg((F.floor(F.count("*") / PART) + 1).alias("parts"))
    mine = mine.join(parts, "token").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    theirs = theirs.join(parts, "token").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    shared = F.array_sort(F.array_intersect("id_tokens", "other_tokens"))
    met = mine.join(theirs.drop("parts"), ["token", "part"]).filter(F.get(shared, F.lit(0)) == F.col("token"))
    return met.select("id", "other", F.array_join(shared, ",").alias("tokens"))


def competitor_of(names: DataFrame, competitors: list[str]) -> DataFrame:
    """names with the first competitor of a short list that the name holds, is held by, or has all long words of."""
    low = F.trim(F.lower("name"))
    out = F.lit(None).cast("string")
    for c in reversed(competitors):
        k = c.lower()
        words = [w for w in k.split() if len(w) >= 3]
        every = F.lit(bool(words))
        for w in words:
            every = every & low.contains(w)
        out = F.when(low.contains(k) | F.lit(k).contains(low) | every, c).otherwise(out)
    return names.withColumn("competitor", F.when(low != "", out))


def wins_with_lots(decided: DataFrame, lots: DataFrame) -> DataFrame:
    """Each win with how many of our lots share its id and the sources they came from."""
    by = lots.groupBy("id").agg(F.count("*").alias("lots"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return decided.join(by, "id", "left").select("id", "line", "winner", F.coalesce("lots", F.lit(0)).alias("lots"), "sources")


def preferred_row(rows: DataFrame, key: str, sources: list[str]) -> DataFrame:
    """Of each key's rows the one of the first source of the list, then the newest."""
    rank = F.lit(len(sources))
    for i, s in reversed(list(enumerate(sources))):
        rank = F.when(F.col("source") == s, i).otherwise(rank)
    w = Window.partitionBy(key).orderBy(rank, F.desc("collected_at"), "id")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def advance_state(known: DataFrame, current: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """What is known after a delivery: all that was, and what is current and was delivered."""
    return known.select(key).union(current.select(key).join(delivered.select(key), key, "left_semi")).distinct()


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wins(spark, sf_dir).select("id", "winner", "feed")
    rows = tenders(spark, sf_dir).select("id", "source")
    return lot_outcomes(rows, w.filter("feed = 'F'"), w, "id")


def _twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tenders(spark, sf_dir)
    kept = lambda c: rows.filter(c).select("id", "organization", "collected_at")
    return twins_within(kept("status = 'O'"), kept("status <> 'O'"), ["organization"], "collected_at", 14)


def _reposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampadd(DAY, cast(id * 7 % 40 as int), timestamp '2024-01-01 00:00:00')")
    rows = identity.keyed(identity.lots(spark, sf_dir)).withColumn("created_at", at)
    kept = twins_or_reposts(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"), ["key"], "created_at", "deadline", 14)
    return kept.select("id", "created_at", "prev_deadline")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("inn"), F.concat(F.lit("name "), F.col("c_custkey") % 400).alias("alias"))
    numbers = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("inn"), F.concat(F.lit("e"), F.col("c_custkey") % 50).alias("entity"))
    names = c.select(F.concat(F.lit("name "), F.col("c_custkey") % 700).alias("alias"), F.concat(F.lit("e"), F.col("c_custkey") % 140).alias("entity"))
    return entity_of(rows, numbers, unique_aliases(names)).select("c_custkey", "entity")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct names by the least part that has each, with how many parts have it: no pair of parts is left out."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.when(F.col("p_type") == "PROMO", "bank holding")).alias("name"), (F.col("p_size") < 25).alias("small"))
    names = written(part.groupBy("small", "name").agg(F.min("p_partkey").alias("id"), F.count("*").alias("n")), "names")
    left, right = names.filter("small"), names.filter("not small")
    found = token_candidates(left, right, 4)
    counted = found.join(left.select("id", F.col("n").alias("n_left")), "id").join(right.select(F.col("id").alias("other"), F.col("n").alias("n_right")), "other")
    return counted.select("id", "other", "tokens", "n_left", "n_right")


QUERIES = {
    "j03_lot_outcomes": _outcomes,
    "j05_wins_with_lots": lambda spark, sf_dir: wins_with_lots(wins(spark, sf_dir), tenders(spark, sf_dir).filter("status <> 'P'")),
    "j12_competitors": lambda spark, sf_dir: competitor_of(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), ["Red Widget", "ring", "a small ring of steel", "blue bolt"]),
    "j13_entities": _entities,
    "j16_token_candidates": _candidates,
    "j18_reposts": _reposts,
    "j18_twins_within": _twins,
    "j30_advance_state": lambda spark, sf_dir: advance_state(
        table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_totalprice > 300000").select("o_custkey"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_custkey"), table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"
    ),
    "t08_preferred_row": lambda spark, sf_dir: preferred_row(tenders(spark, sf_dir), "organization", ["BUILDING", "MACHINERY"]).select("organization", "source", "id"),
    "u03_intersection": lambda spark, sf_dir: table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey").intersect(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey")),
    "u05_difference": lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey").exceptAll(table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()),
    "u08_facets": lambda spark, sf_dir: tenders(spark, sf_dir).select("region", "status").distinct(),
}

SQL = {
    "j03_lot_outcomes": f"""WITH {TENDERS}, {WINS}, d AS (SELECT id, min(winner) AS winner FROM wins WHERE feed = 'F' GROUP BY 1), f AS (SELECT DISTINCT id FROM wins)
        SELECT t.id, t.source, d.winner, CASE WHEN d.winner IS NOT NULL THEN 'deal' WHEN f.id IS NOT NULL THEN 'no_deal' ELSE 'unknown' END AS result FROM tenders t LEFT JOIN d ON d.id = t.id LEFT JOIN f ON f.id = t.id""",
    "j05_wins_with_lots": f"""WITH {TENDERS}, {WINS}, b AS (SELECT id, count(*) AS lots, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM tenders WHERE status <> 'P' GROUP BY 1)
        SELECT w.id, line, winner, coalesce(lots, 0) AS lots, sources FROM wins w LEFT JOIN b ON b.id = w.id""",
    "j12_competitors": """SELECT p_partkey, p_name AS name, CASE WHEN contains(n, 'red widget') OR contains('red widget', n) OR (contains(n, 'red') AND contains(n, 'widget')) THEN 'Red Widget' WHEN contains(n, 'ring') OR contains('ring', n) THEN 'ring'
        WHEN contains(n, 'a small ring of steel') OR contains('a small ring of steel', n) OR (contains(n, 'small') AND contains(n, 'ring') AND contains(n, 'steel')) THEN 'a small ring of steel'
        WHEN contains(n, 'blue bolt') OR contains('blue bolt', n) OR (contains(n, 'blue') AND contains(n, 'bolt')) THEN 'blue bolt' END AS competitor FROM (SELECT *, trim(lower(p_name)) AS n FROM part)""",
    "j13_entities": """WITH a AS (SELECT 'name ' || c_custkey % 700 AS alias, min('e' || c_custkey % 140) AS entity FROM customer GROUP BY 1 HAVING length(alias) >= 8 AND count(DISTINCT c_custkey % 140) = 1)
        SELECT c_custkey, coalesce(CASE WHEN c_custkey % 6 = 0 THEN 'e' || c_custkey % 50 END, a.entity) AS entity FROM customer LEFT JOIN a ON a.alias = 'name ' || c_custkey % 400""",
    "j16_token_candidates": """WITH n AS (SELECT p_size < 25 AS small, p_name || CASE WHEN p_type = 'PROMO' THEN ' bank holding' ELSE '' END AS name, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY 1, 2),
        t AS (SELECT DISTINCT id, small, n, unnest(list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 4 AND x NOT IN ('bank', 'holding'))) AS token FROM n)
        SELECT l.id, r.id AS other, string_agg(DISTINCT l.token, ',' ORDER BY l.token) AS tokens, l.n AS n_left, r.n AS n_right FROM t l JOIN t r ON l.token = r.token WHERE l.small AND NOT r.small GROUP BY ALL""",
    "j18_twins_within": f"""WITH {TENDERS} SELECT id, organization, collected_at FROM tenders t WHERE status = 'O'
        AND NOT EXISTS (SELECT 1 FROM tenders s WHERE s.status <> 'O' AND s.organization = t.organization AND abs(epoch(s.collected_at) - epoch(t.collected_at)) <= 14 * 86400)""",
    "j18_reposts": f"""WITH {identity.LOTS}, rows AS (SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(id * 7 % 40 AS INTEGER)) AS created_at FROM lots), {identity._KEYED},
        n AS (SELECT c.id, max(s.day) AS last, bool_or(s.day IS NULL) AS unread FROM keyed c JOIN keyed s ON c.k1 IS NOT DISTINCT FROM s.k1 AND c.k2 = s.k2 AND c.k3 = s.k3 AND abs(epoch(c.created_at) - epoch(s.created_at)) <= 14 * 86400
              WHERE c.id % 2 = 1 AND s.id % 2 = 0 GROUP BY 1)
        SELECT id, created_at, last AS prev_deadline FROM keyed LEFT JOIN n USING (id) WHERE id % 2 = 1 AND (n.unread IS NULL OR (NOT n.unread AND coalesce(day > n.last, false)))""",
    "j30_advance_state": """SELECT DISTINCT o_custkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR (o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000))""",
    "t08_preferred_row": f"""WITH {TENDERS} SELECT organization, source, id FROM tenders QUALIFY row_number() OVER (PARTITION BY organization ORDER BY CASE source WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, collected_at DESC, id) = 1""",
    "u03_intersection": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "u05_difference": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000",
    "u08_facets": f"WITH {TENDERS} SELECT DISTINCT region, status FROM tenders",
}
