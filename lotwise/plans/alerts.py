"""The alert pipeline: which stage drops a lot first, where an alert goes, and how well that agrees with people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, dictionary, text
from ..session import table
from .identity import LOTS, lots

#: The stages in their order.
STAGES = ("message_type", "no_push_source", "own_lot", "min_price", "deadline_expired", "stale", "no_keyword", "reject_title")
MIN_PRICE = 5_000_000
STALE_DAYS = 365


def prefilter(
    rows: DataFrame, keywords: list[str], now: Column, no_push: tuple[str, ...] = (), own: tuple[str, ...] = (), rejected: tuple[str, ...] = (),
    bypass_sources: tuple[str, ...] = (), bypass_hints: tuple[str, ...] = (), weak: tuple[str, ...] = (), negative: tuple[str, ...] = (), is_lead: Column | None = None,
) -> DataFrame:
    """rows with dropped_at (the first stage that drops the lot, or null), matched_kw, bypass and passed.

    `now` is a column, so that history is judged at its own time. An unknown price passes, and so do an unknown or
    unreadable deadline, leads, and other currencies than the home one. All stages are one pass over the rows.
    """
    lead = is_lead if is_lead is not None else F.lit(False)
    low_title, name = F.lower(F.coalesce("title", F.lit(""))), text.collapse(F.lower(F.coalesce("organization", F.lit(""))))
    any_of = lambda c, words: dates.either(F.lit(False), *[c.contains(w) for w in words])
    keyword = text.first_keyword(F.concat_ws(" ", "search_text", "title"), keywords, weak, negative)
    currency = F.upper(F.coalesce(F.col("currency"), F.lit("UZS"))) if "currency" in rows.columns else F.lit("UZS")
    out = rows.withColumn("_day", dates.deadline_day(F.col("deadline")))
    early = (
        F.when(~F.coalesce(F.col("message_type").isin("tender", "customer_request"), F.lit(True)), STAGES[0])
        .when(F.coalesce(F.col("source").isin(*no_push), F.lit(False)), STAGES[1])
        .when(any_of(name, own), STAGES[2])
        .when(F.col("price").isNotNull() & (F.col("price") < MIN_PRICE) & ~lead & (currency == "UZS"), STAGES[3])
        .when(dates.deadline_expired(F.col("deadline"), now), STAGES[4])
        .when(F.coalesce(F.col("_day").cast("timestamp") < now - F.expr(f"INTERVAL {STALE_DAYS} DAYS"), F.lit(False)), STAGES[5])
    )
    # The whole text is searched only for what the cheap stages let through.
    out = out.withColumn("_early", early).withColumn("_kw", F.when(F.col("_early").isNull(), keyword))
    late = F.when(F.col("_kw").isNull(), STAGES[6]).when(any_of(low_title, rejected), STAGES[7])
    out = out.withColumn("dropped_at", F.coalesce("_early", late))
    passed = F.col("dropped_at").isNull()
    bypass = passed & F.col("source").isin(*bypass_sources) & any_of(low_title, bypass_hints) if bypass_sources else F.lit(False)
    return out.select(*rows.columns, "dropped_at", F.when(passed, F.col("_kw")).alias("matched_kw"), bypass.alias("bypass"), passed.alias("passed"))


def stage_counters(judged: DataFrame) -> DataFrame:
    """How many lots each stage dropped, with those that passed and bypassed; the counts add up to the input."""
    stage = F.coalesce("dropped_at", F.when(F.col("bypass"), "bypass").otherwise("passed"))
    return judged.groupBy(stage.alias("stage")).agg(F.count("*").alias("cnt"))


def route(rows: DataFrame, now: Column, catalogs: tuple[str, ...], auctions: tuple[str, ...], mutes: tuple[str, ...], floor: float = 1e8, sure_floor: float = 3e7) -> DataFrame:
    """rows with push: worth an interrupt rather than a line in the digest."""
    score, price = F.coalesce(F.col("relevance_score"), F.lit(0)), F.col("price")
    left = F.datediff(dates.deadline_day(F.col("deadline")), F.to_date(now))
    strong = (
        F.when(F.col("source").isin(*catalogs), False)
        .when(F.col("source").isin(*auctions) & (F.coalesce(F.col("bid_count"), F.lit(0)) > 0), True)
        .when(F.coalesce(price >= floor, F.lit(False)), True)
        .when((score >= 95) & F.coalesce(price >= sure_floor, F.lit(False)), True)
        .when((score >= 90) & price.isNull() & (F.coalesce("deadline", F.lit("")) == ""), True)
        .otherwise(F.coalesce(left.between(0, 1), F.lit(False)))
    )
    return rows.withColumn("push", strong & ~F.col("source").isin(*mutes))


def scorecard(judged: DataFrame, truth: str, verdict: str) -> DataFrame:
    """One row: recall, precision and accuracy of a verdict against what people said; rows without a label don't count."""
    known = judged.filter(F.col(truth).isNotNull())
    t, v = F.col(truth) == 1, F.col(verdict)
    n = known.agg(F.count_if(t & v).alias("hit"), F.count_if(t & ~v).alias("missed"), F.count_if(~t & v).alias("false_alarm"), F.count_if(~t & ~v).alias("rest"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.round(F.col(a) / (F.col(a) + F.col(b)), 4))
    return n.withColumn("recall", share("hit", "missed")).withColumn("precision", share("hit", "false_alarm"))


def mutes(feedback: DataFrame, least: int = 3) -> DataFrame:
    """Sources with at least `least` bad marks and no good one."""
    n = feedback.groupBy("source").agg(F.count_if(F.col("good") == 0).alias("negative"), F.count_if(F.col("good") == 1).alias("positive"))
    return n.filter((F.col("negative") >= least) & (F.col("positive") == 0))


KEYWORDS = ["theand", "anonly", "erthin", "ouvrage", "reonly", "tion", "en", "de la"]
_NOW = "2024-02-01 12:00:00"
_ARGS = {"no_push": ("src3", "src9"), "own": ('ооо "the',), "rejected": ("thth", "or "), "bypass_sources": ("src1", "src2"), "bypass_hints": ("an", "er"), "weak": ("tion",), "negative": ("wh",)}


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter(lots(spark, sf_dir), KEYWORDS, F.lit(_NOW).cast("timestamp"), **_ARGS)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lots(spark, sf_dir).withColumn("relevance_score", (F.col("id") % 101).cast("int")).withColumn("bid_count", (F.col("id") % 3).cast("int"))
    rows = rows.withColumn("deadline", F.when(F.col("id") % 4 != 0, F.col("deadline")))
    return route(rows, F.lit("2024-01-15 09:00:00").cast("timestamp"), ("src4",), ("src5", "src6"), ("src7",), 2e7, 1e7).select("id", "push")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return scorecard(_judged(spark, sf_dir).join(labels, F.col("id") == F.col("doc_id"), "left"), "quality", "passed")


def _muted(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return mutes(docs.join(labels, "doc_id").select(F.concat_ws("/", "source", "lang").alias("source"), (1 - F.col("toxic")).alias("good")), 1)


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a dictionary of the words of the benchmark's items."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("keyword")
    words = table(spark, sf_dir, "benchmark").select(word).filter(F.char_length("keyword") >= 5).distinct()
    entries = words.select("keyword", (F.char_length("keyword") * 7 % 11).alias("rank"), F.lit(False).alias("weak"), F.lit(False).alias("whole"), F.lit(None).cast("array<string>").alias("not_before"))
    return dictionary.first_keywords(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), entries)


QUERIES = {
    "f06_prefilter": lambda spark, sf_dir: _judged(spark, sf_dir).select("id", "dropped_at", "matched_kw", "bypass", "passed"),
    "f06_stage_counters": lambda spark, sf_dir: stage_counters(_judged(spark, sf_dir)),
    "f08_deadlines": lambda spark, sf_dir: lots(spark, sf_dir).select("id", dates.deadline_day(F.col("deadline")).alias("day"), dates.deadline_expired(F.col("deadline"), F.lit(_NOW).cast("timestamp")).alias("expired")),
    "f10_keyword_table": _dictionary,
    "f10_first_keyword": lambda spark, sf_dir: lots(spark, sf_dir).select("id", text.first_keyword(F.concat_ws(" ", "search_text", "title"), KEYWORDS).alias("keyword")),
    "p_push_or_digest": _routed,
    "a40_scorecard": _scored,
    "a32_mutes": _muted,
}


def _sql_keyword(c: str, weak: tuple[str, ...] = (), negative: tuple[str, ...] = ()) -> str:
    bad = " OR ".join(f"contains({c}, '{n}')" for n in negative) or "false"
    cases = " ".join(f"WHEN regexp_matches({c}, '(^|[^\\p{{L}}]){text.stem(k)}')" + (f" AND NOT ({bad})" if k in weak else "") + f" THEN '{k}'" for k in KEYWORDS)
    return f"CASE {cases} END"


_DAY_SQL = "CASE id % 3 WHEN 0 THEN strptime(substr(deadline, 4, 10), '%d.%m.%Y')::DATE WHEN 1 THEN substr(deadline, 1, 10)::DATE END"
_EXPIRED = f"coalesce(CASE id % 3 WHEN 1 THEN substr(deadline, 1, 19)::TIMESTAMP < TIMESTAMP '{_NOW}' ELSE ({_DAY_SQL})::TIMESTAMP < TIMESTAMP '{_NOW}' - INTERVAL 1 DAY END, false)"
_LOW = "lower(search_text || ' ' || title)"
_JUDGED = f"""{LOTS}, j0 AS (SELECT *, {_sql_keyword(_LOW, _ARGS["weak"], _ARGS["negative"])} AS kw,
    {" OR ".join(f"contains(lower(title), '{r}')" for r in _ARGS["rejected"])} AS bad, {" OR ".join(f"contains(lower(title), '{r}')" for r in _ARGS["bypass_hints"])} AS hint,
    contains(lower(organization), 'ооо "the') AS own FROM lots),
    j1 AS (SELECT *, CASE WHEN message_type <> 'tender' THEN 'message_type' WHEN source IN ('src3', 'src9') THEN 'no_push_source' WHEN own THEN 'own_lot' WHEN price < 5000000 THEN 'min_price'
        WHEN {_EXPIRED} THEN 'deadline_expired' WHEN kw IS NULL THEN 'no_keyword' WHEN bad THEN 'reject_title' END AS dropped_at FROM j0),
    judged AS (SELECT *, CASE WHEN dropped_at IS NULL THEN kw END AS matched_kw, dropped_at IS NULL AND source IN ('src1', 'src2') AND hint AS bypass, dropped_at IS NULL AS passed FROM j1)"""

_STEM = "coalesce(" + ", ".join(f"CASE WHEN ends_with(k, '{x}') AND length(k) - {len(x)} >= {text.LEAST_STEM} THEN k[:length(k) - {len(x)}] END" for x in text.SUFFIXES) + ")"

SQL = {
    "f06_prefilter": f"WITH {_JUDGED} SELECT id, dropped_at, matched_kw, bypass, passed FROM judged",
    "f06_stage_counters": f"WITH {_JUDGED} SELECT coalesce(dropped_at, CASE WHEN bypass THEN 'bypass' ELSE 'passed' END) AS stage, count(*) AS cnt FROM judged GROUP BY 1",
    "f08_deadlines": f"WITH {LOTS} SELECT id, {_DAY_SQL} AS day, {_EXPIRED} AS expired FROM lots",
    "f10_keyword_table": """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS k FROM benchmark), k AS (SELECT k, length(k) * 7 % 11 AS rank FROM w WHERE length(k) >= 5),
        s AS (SELECT k, rank, CASE WHEN length(k) <= 4 THEN k ELSE coalesce(""" + _STEM + """, k) END AS root FROM k),
        t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')) AS word FROM documents), p AS (SELECT DISTINCT doc_id, word[:n] AS root FROM t, (SELECT DISTINCT length(root) AS n FROM s) WHERE length(word) >= n)
        SELECT doc_id AS id, arg_min(k, (rank, k)) AS keyword FROM p JOIN s ON p.root = s.root GROUP BY doc_id""",
    "f10_first_keyword": f"WITH {LOTS} SELECT id, {_sql_keyword(_LOW)} AS keyword FROM lots",
    "p_push_or_digest": f"""WITH {LOTS}, r AS (SELECT id, source, price, id % 101 AS score, id % 3 AS bids, CASE WHEN id % 4 <> 0 THEN deadline END AS deadline, CASE WHEN id % 4 <> 0 THEN {_DAY_SQL} END AS day FROM lots)
        SELECT id, CASE WHEN source = 'src4' THEN false WHEN source IN ('src5', 'src6') AND bids > 0 THEN true WHEN coalesce(price >= 2e7, false) THEN true WHEN score >= 95 AND coalesce(price >= 1e7, false) THEN true
            WHEN score >= 90 AND price IS NULL AND coalesce(deadline, '') = '' THEN true ELSE coalesce(day - DATE '2024-01-15' BETWEEN 0 AND 1, false) END AND source <> 'src7' AS push FROM r""",
    "a40_scorecard": f"""WITH {_JUDGED}, n AS (SELECT count(*) FILTER (WHERE quality = 1 AND passed) AS hit, count(*) FILTER (WHERE quality = 1 AND NOT passed) AS missed, count(*) FILTER (WHERE quality <> 1 AND passed) AS false_alarm,
        count(*) FILTER (WHERE quality <> 1 AND NOT passed) AS rest FROM judged JOIN labels ON doc_id = id)
        SELECT *, CASE WHEN hit + missed > 0 THEN round(hit / (hit + missed)::DOUBLE, 4) END AS recall, CASE WHEN hit + false_alarm > 0 THEN round(hit / (hit + false_alarm)::DOUBLE, 4) END AS precision FROM n""",
    "a32_mutes": """SELECT source || '/' || lang AS source, count(*) FILTER (WHERE toxic = 1) AS negative, count(*) FILTER (WHERE toxic = 0) AS positive FROM documents JOIN labels USING (doc_id)
        GROUP BY 1 HAVING negative >= 1 AND positive = 0""",
}
