"""Changes of the customer register: confirmed merges, proposals that are made once, links, and replays of filters as of a lot's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.graphs import groups
from ..functions.text import normalize_inn
from ..session import table, written


def valid_decisions(decisions: DataFrame) -> DataFrame:
    """decisions (decision, inns, name, by, day) with their valid distinct numbers in order; those of fewer than two are left out."""
    numbers = F.array_distinct(F.array_compact(F.transform("inns", normalize_inn)))
    return decisions.withColumn("inns", numbers).filter("size(inns) > 1")


def merged(entities: DataFrame, members: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The register's entities and members (id, place, inn) after confirmed decisions that some of its numbers are one organisation.

    entities (id, name, rank, score, pinned, pinned_by, merged_by). What entities or decisions name together is one, through
    any number of steps. Of a merged organisation the name and the decision's mark are the last decision's (by day, then
    number); its id is that of the entity that begins with the first number of that decision, or made of this number; rank and
    score are the best-ranked part's; it is pinned if a part was, by whom the best-ranked of these says. Entities that no
    decision names stay as they are. Numbers that no entity had join it as well.
    """
    asked = written(valid_decisions(decisions), "decisions")
    parts = members.groupBy("id").agg(F.min_by("inn", "place").alias("first"))
    own = members.join(parts, "id").select(F.col("first").alias("a"), F.col("inn").alias("b"))
    named = asked.select(F.col("inns")[0].alias("a"), F.explode("inns").alias("b"))
    group = written(groups(own.union(named)), "groups")

    decided = asked.withColumn("node", F.col("inns")[0]).join(group, "node")
    last = decided.groupBy("least").agg(F.max_by(F.struct(F.col("inns")[0].alias("lead"), "name", F.concat_ws(" ", "by", "day").alias("mark")), F.struct("day", "decision")).alias("last")).select("least", "last.*")
    placed = entities.join(parts, "id").join(group, parts["first"] == group["node"]).select(*entities.columns, "first", "least")
    # Parts of merged organisations, best rank first; an organisation of numbers alone has no parts.
    order = F.struct(F.col("rank").isNull().alias("none"), "rank", "id")
    best = placed.join(last, "least", "left_semi").groupBy("least").agg(
        F.min_by(F.struct("rank", "score"), order).alias("best"), F.max(F.coalesce("pinned", F.lit(False))).alias("pinned"), F.min_by("pinned_by", F.when(F.coalesce("pinned", F.lit(False)), order)).alias("pinned_by")
    )
    lead = placed.select("least", F.col("first").alias("lead"), F.col("id").alias("_id")).groupBy("least", "lead").agg(F.min("_id").alias("_id"))
    new_id = F.coalesce("_id", F.concat(F.lit("c-"), "lead"))
    ours = last.join(lead, ["least", "lead"], "left").join(best, "least", "left").select(
        new_id.alias("id"), "name", "best.rank", "best.score", F.coalesce("pinned", F.lit(False)).alias("pinned"), "pinned_by", F.col("mark").alias("merged_by"), "least", "lead"
    )
    ours = written(ours, "merged")
    rest = entities.join(placed.join(last, "least", "left_semi").select("id"), "id", "left_anti")
    # The lead comes first, then the numbers in their order.
    numbers = group.join(ours.select("least", "id", "lead"), "least").select("id", F.row_number().over(Window.partitionBy("id").orderBy(F.col("node") != F.col("lead"), "node")).alias("place"), F.col("node").alias("inn"))
    kept = members.join(rest.select("id"), "id", "left_semi").select("id", "place", "inn")
    return rest.select(entities.columns).unionByName(ours.select(entities.columns)), kept.unionByName(numbers)


def settled_proposals(proposals: DataFrame, members: DataFrame, rejected: DataFrame) -> DataFrame:
    """proposals (inns, status) after merges and rejections: proposed ones whose numbers are all in one entity are confirmed, rejected
    ones (inns, in any order) are rejected. Those that were decided before stay as they are."""
    key = F.array_join(F.array_sort(F.array_distinct("inns")), ",")
    asked = proposals.withColumn("_key", key)
    numbers = asked.filter("status = 'proposed'").select("_key", F.explode(F.array_distinct("inns")).alias("inn"), F.size(F.array_distinct("inns")).alias("n")).distinct()
    inside = numbers.join(members.select("inn", "id"), "inn").groupBy("_key", "n", "id").agg(F.count("*").alias("met")).filter("met = n").select("_key", F.lit("confirmed").alias("_met")).distinct()
    gone = rejected.select(key.alias("_key"), F.lit("rejected").alias("_gone")).distinct()
    status = F.when(F.col("status") == "proposed", F.coalesce("_met", "_gone", "status")).otherwise(F.col("status"))
    return asked.join(inside, "_key", "left").join(gone, "_key", "left").withColumn("status", status).select(proposals.columns)


def proposed(proposals: DataFrame, new: DataFrame) -> DataFrame:
    """proposals (inns, status) with the new ones (inns) that were never made before, whatever became of them; each once."""
    key = F.array_join(F.array_sort(F.array_distinct("inns")), ",").alias("_key")
    fresh = new.select("inns", key).groupBy("_key").agg(F.min("inns").alias("inns")).join(proposals.select(key), "_key", "left_anti")
    return proposals.select("inns", "status").unionByName(fresh.select("inns", F.lit("proposed").alias("status")))


def links(old: DataFrame, confirmed: DataFrame, members: DataFrame) -> DataFrame:
    """(id, company, name) of companies linked with entities: old ones and those confirmed by a number (company, name, inn), a company once an
    entity; numbers that the register lacks link nothing."""
    found = confirmed.join(members.select("inn", "id"), "inn").select("id", "company", "name")
    new = found.join(old.select("id", "company"), ["id", "company"], "left_anti").groupBy("id", "company").agg(F.min("name").alias("name"))
    return old.select("id", "company", "name").unionByName(new)


def replayed(lots: DataFrame, versions: DataFrame, stages: list[str]) -> DataFrame:
    """lots (id, at, price, text) with `stage`, the first stage that drops a lot by the rules of its own time; null if it passes.

    versions (stage, since, until, least, word): of a stage, what held from `since` until before `until` (null: still): a least
    price, or a word that the text must not hold (each null if there is none). Rules meet lots by the months they held in, so
    neither side is held in one place. Of several versions at a time any may drop the lot.
    """
    end = F.coalesce("until", F.lit("2200-01-01").cast("timestamp"))
    newest, oldest = lots.agg(F.max("at"), F.min("at")).first()
    within = versions.filter((F.col("since") <= F.lit(newest)) & (end > F.lit(oldest)))
    month = F.sequence(F.trunc(F.greatest("since", F.lit(oldest)), "month"), F.trunc(F.least(end, F.lit(newest)), "month"), F.expr("interval 1 month"))
    rules = within.select("stage", "since", end.alias("_end"), "least", "word", F.explode(month).alias("_month"))
    met = lots.select("id", "at", "price", "text", F.trunc("at", "month").alias("_month")).join(rules, "_month").filter((F.col("since") <= F.col("at")) & (F.col("at") < F.col("_end")))
    drops = F.coalesce(F.coalesce("price", F.lit(0.0)) < F.col("least"), F.lit(False)) | F.coalesce(F.lower("text").contains(F.lower("word")), F.lit(False))
    order = F.array_position(F.lit(stages), F.col("stage"))
    first = met.filter(drops & (order > 0)).groupBy("id").agg(F.min(order).alias("_first"))
    return lots.join(first, "id", "left").withColumn("stage", F.get(F.lit(stages), (F.col("_first") - 1).cast("int"))).drop("_first")


def backtest(judged: DataFrame, days: int) -> DataFrame:
    """(stage, cnt, accepted, est_week): lots (stage, accepted) by the stage that dropped them, 'passed' for none.

    Of passed ones, accepted is the share of those with a verdict that were accepted, and est_week how many accepted ones a week would bring.
    """
    stage = F.coalesce("stage", F.lit("passed"))
    sums = judged.groupBy(stage.alias("stage")).agg(F.count("*").alias("cnt"), F.count("accepted").alias("_n"), F.count_if("accepted").alias("_ok"))
    share = F.when(F.col("stage") == "passed", F.coalesce(F.col("_ok") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0)))
    return sums.select("stage", "cnt", F.round(share, 6).alias("accepted"), F.round(F.col("cnt") * share / F.lit(days / 7.0), 1).alias("est_week"))


def _inn(c: Column) -> Column:
    return (c + 100_000_000).cast("string")


def _register(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities by customer (every ninth pinned), and decisions that join tens with their neighbours and some of these with others."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    entities = c.filter(k % 10 != 5).select(
        F.concat(F.lit("c-"), _inn(k)).alias("id"), F.col("c_name").alias("name"), F.when(k % 6 > 0, k * 37 % 1009).alias("rank"), k.alias("score"), (k % 9 == 0).alias("pinned"),
        F.when(k % 9 == 0, F.concat(F.lit("p"), k)).alias("pinned_by"), F.lit(None).cast("string").alias("merged_by"),
    )
    members = c.filter(k % 10 != 5).select(F.concat(F.lit("c-"), _inn(k)).alias("id"), F.lit(1).alias("place"), _inn(k).alias("inn"))
    row = lambda inns, day: [F.array(*inns).alias("inns"), F.concat(F.lit("G"), k).alias("name"), F.lit("d").alias("by"), F.lit(day).alias("day")]
    one = c.filter(k % 10 == 0).select(k.alias("decision"), *row([_inn(k), _inn(k + 1), F.lit("bad")], "2024-01-01"))
    two = c.filter(k % 50 == 0).select((k + 1).alias("decision"), *row([_inn(k + 1), _inn(k + 5)], "2024-01-02"))
    none = c.filter(k % 10 == 2).select((k + 2).alias("decision"), *row([_inn(k), _inn(k)], "2024-01-03"))
    return entities, members, one.union(two).union(none)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, members = merged(*_register(spark, sf_dir))
    sets = members.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "inn"))), lambda x: x["inn"]), ",").alias("inns"))  # a few numbers each
    return entities.join(sets, "id")


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    _, members = merged(*_register(spark, sf_dir))
    status = F.when(k % 4 == 0, "rejected").otherwise("proposed")
    old = c.filter(k % 5 == 0).select(F.array(_inn(k + 1), _inn(k)).alias("inns"), status.alias("status"))
    new = c.filter(k % 3 == 0).select(F.array(_inn(k), _inn(k + 1)).alias("inns"))
    gone = c.filter(k % 15 == 0).select(F.array(_inn(k), _inn(k + 1)).alias("inns"))
    out = settled_proposals(proposed(old, new), members, gone)
    return out.select(F.array_join(F.array_sort("inns"), ",").alias("inns"), "status")


STAGES = ["price", "word", "late"]


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("text"))
    s, day = table(spark, sf_dir, "nation"), lambda n: F.date_add(F.lit("1995-01-01").cast("date"), n).cast("timestamp")
    k = F.col("n_nationkey").cast("int")
    versions = s.select(
        F.when(k % 3 == 0, "price").when(k % 3 == 1, "word").otherwise("late").alias("stage"), day(k * 90).alias("since"), F.when(k % 4 > 0, day(k * 90 + 150)).alias("until"),
        F.when(k % 3 != 1, (k * 2000).cast("double")).alias("least"), F.when(k % 3 == 1, F.concat(F.lit(""), (k % 5 + 1).cast("string"), F.lit("-"))).alias("word"),
    )
    judged = replayed(o, versions, STAGES).withColumn("accepted", F.when(F.col("id") % 4 > 0, F.col("id") % 3 == 0))
    return backtest(judged, 700)


QUERIES = {
    "e15_merged_register": _merged,
    "e15_proposals": _proposals,
    "a51_backtest": _replay,
}

_PAD = "CAST(100000000 + {} AS VARCHAR)"
_GROUPS = f"""RECURSIVE d AS (SELECT c_custkey AS decision, c_custkey AS a, c_custkey + 1 AS b, 'G' || c_custkey AS name, '2024-01-01' AS day FROM customer WHERE c_custkey % 10 = 0
        UNION ALL SELECT c_custkey + 1, c_custkey + 1, c_custkey + 5, 'G' || c_custkey, '2024-01-02' FROM customer WHERE c_custkey % 50 = 0),
    e AS (SELECT a, b FROM d UNION SELECT b, a FROM d), r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
    g AS (SELECT x, min({_PAD.format("y")}) AS g FROM r GROUP BY x), l AS (SELECT g, arg_max(d.a, (day, decision)) AS lead, arg_max(name, (day, decision)) AS name, 'd ' || max(day) AS mark FROM d JOIN g ON g.x = d.a GROUP BY g),
    p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 > 0 THEN c_custkey * 37 % 1009 END AS rank, c_custkey % 9 = 0 AS pinned, g FROM customer LEFT JOIN g ON g.x = c_custkey WHERE c_custkey % 10 <> 5),
    n AS (SELECT k, g, CASE WHEN g IS NULL THEN 'c-' || {_PAD.format("k")} END AS id FROM p),
    m AS (SELECT 'c-' || {_PAD.format("lead")} AS id, g, x FROM l JOIN g USING (g))"""
SQL = {
    "e15_merged_register": f"""WITH {_GROUPS}, s AS (SELECT m.id, string_agg({_PAD.format("x")}, ',' ORDER BY x <> lead, {_PAD.format("x")}) AS inns FROM m JOIN l USING (g) GROUP BY 1),
        b AS (SELECT g, arg_min(k, (rank IS NULL, coalesce(rank, 0), {_PAD.format("k")})) AS best, bool_or(pinned) AS pinned, arg_min('p' || k, (rank IS NULL, coalesce(rank, 0), {_PAD.format("k")})) FILTER (WHERE pinned) AS pinned_by FROM p WHERE g IS NOT NULL GROUP BY g)
        SELECT 'c-' || {_PAD.format("k")} AS id, c_name AS name, rank, k AS score, pinned, CASE WHEN pinned THEN 'p' || k END AS pinned_by, NULL AS merged_by, {_PAD.format("k")} AS inns FROM p JOIN customer ON c_custkey = k WHERE g IS NULL
        UNION ALL SELECT 'c-' || {_PAD.format("lead")}, l.name, q.rank, q.k, coalesce(b.pinned, false), b.pinned_by, l.mark, s.inns FROM l LEFT JOIN b USING (g) LEFT JOIN p q ON q.k = b.best JOIN s ON s.id = 'c-' || {_PAD.format("lead")}""",
    "e15_proposals": f"""WITH {_GROUPS}, o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'rejected' ELSE 'proposed' END AS status FROM customer WHERE c_custkey % 5 = 0
            UNION ALL SELECT c_custkey, 'proposed' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0)
        SELECT array_to_string(list_sort([{_PAD.format("k")}, {_PAD.format("k + 1")}]), ',') AS inns, CASE WHEN status <> 'proposed' THEN status WHEN g.g = h.g THEN 'confirmed' WHEN k % 15 = 0 THEN 'rejected' ELSE status END AS status
        FROM o LEFT JOIN g ON g.x = k LEFT JOIN g h ON h.x = k + 1""",
    "a51_backtest": """WITH v AS (SELECT ['price', 'word', 'late'][n_nationkey % 3 + 1] AS stage, n_nationkey % 3 AS place, CAST(DATE '1995-01-01' + CAST(n_nationkey * 90 AS INT) AS TIMESTAMP) AS since, CASE WHEN n_nationkey % 4 > 0 THEN CAST(DATE '1995-01-01' + CAST(n_nationkey * 90 + 150 AS INT) AS TIMESTAMP) END AS until,
            CASE WHEN n_nationkey % 3 <> 1 THEN n_nationkey * 2000.0 END AS least, CASE WHEN n_nationkey % 3 = 1 THEN (n_nationkey % 5 + 1) || '-' END AS word FROM nation),
        j AS (SELECT o_orderkey AS id, arg_min(v.stage, v.place) AS stage FROM orders LEFT JOIN v ON since <= CAST(o_orderdate AS TIMESTAMP) AND (until IS NULL OR CAST(o_orderdate AS TIMESTAMP) < until) AND (coalesce(o_totalprice < least, false) OR coalesce(contains(lower(o_orderpriority), word), false)) GROUP BY 1),
        s AS (SELECT coalesce(stage, 'passed') AS stage, count(*) AS cnt, count(*) FILTER (WHERE id % 4 > 0) AS n, count(*) FILTER (WHERE id % 4 > 0 AND id % 3 = 0) AS ok FROM j GROUP BY 1)
        SELECT stage, cnt, CASE WHEN stage = 'passed' THEN round(ok / n::DOUBLE, 6) END AS accepted, CASE WHEN stage = 'passed' THEN round(cnt * (ok / n::DOUBLE) / 100.0::DOUBLE, 1) END AS est_week FROM s""",
}
