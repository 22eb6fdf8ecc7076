"""Web pages: what a site parser reads, keywords across pages, search positions and a query's score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import numbered, table, written

#: Words of a query that don't count.
STOP_WORDS = (
    "и", "в", "на", "с", "по", "для", "из", "от", "к", "о", "у", "за", "не", "но", "а", "или", "что", "как", "это", "при", "так", "все", "его", "уже",
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "with", "by", "is", "and", "or", "not", "but", "as", "it", "from",
)
#: Fixed value: links to files that are no pages.
FILES = r"\.(pdf|jpg|jpeg|png|gif|svg|zip|rar|doc|docx|xls|xlsx|mp3|mp4|css|js|xml|ico)$"
#: What a title, a heading and a description add to a score of 100.
WEIGHTS = {"title": 40, "h1": 35, "description": 25}


def plain(html: Column) -> Column:
    """Text without tags, blanks collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", ""), r"[ \t\n\r]+", " ")), F.lit(""))


def element(html: Column, tag: str) -> Column:
    """The text of the first element of that name."""
    return plain(F.regexp_extract(html, rf"(?is)<{tag}(?:[ \t\n\r][^>]*)?>(.*?)</{tag}>", 1))


def meta(html: Column, attribute: str, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, rf'(?is)<meta[^>]*{attribute}="{name}"[^>]*content="([^"]*)"', 1)), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """pages with domain, title, h1, description, keywords (array) and links (array of absolute links of the same host)."""
    html, url = F.col("html"), F.col("url")
    root = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a[^>]*href=\"([^\"]*)\""), 1)
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"#.*$", ""))
    absolute = F.transform(F.filter(bare, lambda x: x.startswith("/") | x.startswith("http")), lambda x: F.when(x.startswith("/"), F.concat(root, x)).otherwise(x))
    own = F.filter(absolute, lambda x: x.startswith(F.concat(root, F.lit("/"))) & ~F.regexp_replace(F.lower(x), r"\?.*$", "").rlike(FILES))
    keywords = F.filter(F.transform(F.split(F.coalesce(meta(html, "name", "keywords"), F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != "")
    description = F.coalesce(meta(html, "name", "description"), meta(html, "property", "og:description"))
    return pages.select(
        "page_id", "url", host(url).alias("domain"), element(html, "title").alias("title"), element(html, "h1").alias("h1"), description.alias("description"), keywords.alias("keywords"), F.array_distinct(own).alias("links")
    )


def page_keywords(pages: DataFrame) -> DataFrame:
    """(keyword, page_id), once a page: meta keywords, the phrases of title and description, and the heading, in lower case."""
    tidy = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    phrases = lambda c, marks, fits: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), marks), tidy), fits)
    title = phrases(F.col("title"), r"[|\-–—,•·]", lambda w: F.length(w) > 2)
    description = phrases(F.col("description"), r"[.,;!?|•·\-–—]", lambda w: (F.length(w) > 3) & (F.length(w) < 100))
    known = F.coalesce(F.transform("keywords", tidy), F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(known, title, F.array_compact(F.array(tidy(F.col("h1")))), description))
    return pages.select("page_id", F.explode(every).alias("keyword")).select("keyword", "page_id")


def keyword_counts(membership: DataFrame) -> DataFrame:
    """On how many pages each keyword is."""
    return membership.groupBy("keyword").agg(F.count("*").alias("cnt"))


def keyword_pages(pages: DataFrame) -> DataFrame:
    """(keyword, cnt, page_id): every keyword with its count and each of its pages, most frequent first."""
    from ..session import written

    membership = written(page_keywords(pages), "page_keywords")
    return membership.join(keyword_counts(membership), "keyword").select("keyword", "cnt", "page_id").orderBy(F.desc("cnt"), "keyword", "page_id")


def seo_score(pages: DataFrame, query: str) -> DataFrame:
    """How many of a query's words the title, heading and description hold, weighted to 100."""
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w) > 1 and w not in STOP_WORDS]
    part = lambda c: sum((F.coalesce(F.lower(c).contains(w), F.lit(False)).cast("int") for w in words), F.lit(0)) / float(len(words))
    score = sum((part(F.col(c)) * w for c, w in WEIGHTS.items()), F.lit(0.0)) if words else F.lit(0.0)
    return pages.select("page_id", F.floor(score + 0.5).cast("int").alias("score"))


def search_positions(results: DataFrame, tracked: DataFrame) -> DataFrame:
    """results (query, position, domain), tracked (query, host) -> the first position whose domain holds the host, or null."""
    joined = tracked.join(results, "query", "left")
    return joined.groupBy("query", "host").agg(F.min(F.when(F.col("domain").contains(F.col("host")), F.col("position"))).alias("position"))


def position_summary(positions: DataFrame) -> DataFrame:
    return positions.agg(
        F.count("*").alias("queries"), F.count_if(F.col("position") <= 3).alias("top3"), F.count_if(F.col("position") <= 10).alias("top10"), F.count_if(F.col("position").isNull()).alias("not_found")
    )


def top_domains(results: DataFrame, tracked_host: str, depth: int = 5, most: int = 10) -> DataFrame:
    """Which other domains come first most often."""
    return results.filter((F.col("position") <= depth) & ~F.col("domain").contains(tracked_host)).groupBy("domain").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "domain").limit(most)


def normalized_url(url: Column) -> Column:
    """Without fragment and trailing slash, query parts in order."""
    bare = F.regexp_replace(url, r"#.*$", "")
    path, query = F.regexp_replace(F.substring_index(bare, "?", 1), r"/+$", ""), F.when(bare.contains("?"), F.regexp_replace(bare, r"^[^?]*\?", ""))
    return F.concat(path, F.coalesce(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")), F.lit("")))


def crawl_frontier(links: DataFrame, start: DataFrame, most_pages: int) -> DataFrame:
    """(node, depth) of the first most_pages pages reached from start by links (a, b), breadth first; within a level in order of node.

    Each level is one join with the frontier; what was seen is left out by an anti join. Of the level that would pass
    most_pages the first rows are taken that still fit.
    """
    level, depth, found = start.select("node").distinct(), 0, 0
    levels: list[DataFrame] = []
    while True:
        room = most_pages - found
        now = written(numbered(level, "node", name="place").filter(F.col("place") <= room).select("node", F.lit(depth).alias("depth")), "frontier")
        n = now.count()
        if n:
            levels.append(now)
        found += n
        if not n or found >= most_pages:
            return reduce(DataFrame.unionByName, levels) if levels else now
        depth += 1
        level = links.join(now, links.a == now.node).select(F.col("b").alias("node")).filter("node is not null").distinct()
        for seen in levels:
            level = level.join(seen, "node", "left_anti")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results over pages: the query is the language folder and a number, the position follows the id."""
    pages = table(spark, sf_dir, "pages")
    return pages.select((F.col("page_id") % 12).alias("query"), ((F.col("page_id") * 7) % 25 + 1).alias("position"), host(F.col("url")).alias("domain"))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _results(spark, sf_dir)
    tracked = results.select("query").distinct().withColumn("host", F.when(F.col("query") < 8, "example.org").otherwise("m.th"))
    return search_positions(results, tracked)


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    links = o.select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % 1500).alias("b")).distinct()
    return crawl_frontier(links, o.filter("o_custkey = 1").select(F.col("o_custkey").alias("node")), 400)


QUERIES = {
    "s19_page_fields": lambda spark, sf_dir: parsed(table(spark, sf_dir, "pages")).select("page_id", "domain", "title", "h1", "description", F.array_join("keywords", "|").alias("keywords"), F.array_join("links", " ").alias("links")),
    "a56_page_keywords": lambda spark, sf_dir: keyword_pages(parsed(table(spark, sf_dir, "pages"))),
    "p_seo_score": lambda spark, sf_dir: seo_score(parsed(table(spark, sf_dir, "pages")), "the er thon en de"),
    "j32_search_positions": _positions,
    "a55_position_summary": lambda spark, sf_dir: position_summary(_positions(spark, sf_dir)),
    "a55_top_domains": lambda spark, sf_dir: top_domains(_results(spark, sf_dir), "tionsh"),
    "p_normalized_url": lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", normalized_url(F.col("url")).alias("url")),
    "s18_crawl_frontier": _frontier,
}

_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))"


def _el(tag: str) -> str:
    inner = f"regexp_extract(html, '(?is)<{tag}(?:[ \\t\\n\\r][^>]*)?>(.*?)</{tag}>', 1)"
    return f"nullif(trim(regexp_replace(regexp_replace({inner}, '<[^>]*>', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')), '')"


def _meta(attribute: str, name: str) -> str:
    return f"""nullif(trim(regexp_extract(html, '(?is)<meta[^>]*{attribute}="{name}"[^>]*content="([^"]*)"', 1)), '')"""


_ROOT = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
_PARSED = f"""parsed AS (SELECT page_id, {_HOST} AS domain, {_el("title")} AS title, {_el("h1")} AS h1, coalesce({_meta("name", "description")}, {_meta("property", "og:description")}) AS description,
    array_to_string(list_filter(list_transform(string_split(coalesce({_meta("name", "keywords")}, ''), ','), lambda k: trim(k)), lambda k: k <> ''), '|') AS keywords, html, url FROM pages)"""
_LINKS = f"""link0 AS (SELECT page_id, url, {_ROOT} AS root, unnest(regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1)) AS x, generate_subscripts(regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1), 1) AS i FROM pages),
    link1 AS (SELECT page_id, i, root, regexp_replace(x, '#.*$', '') AS x FROM link0),
    link2 AS (SELECT page_id, min(i) AS i, y FROM (SELECT page_id, i, root, CASE WHEN starts_with(x, '/') THEN root || x ELSE x END AS y FROM link1 WHERE starts_with(x, '/') OR starts_with(x, 'http'))
              WHERE starts_with(y, root || '/') AND NOT regexp_matches(regexp_replace(lower(y), '\\?.*$', ''), '{FILES}') GROUP BY page_id, y),
    links AS (SELECT page_id, string_agg(y, ' ' ORDER BY i) AS links FROM link2 GROUP BY 1)"""
_RESULTS = f"r AS (SELECT page_id % 12 AS query, (page_id * 7) % 25 + 1 AS position, {_HOST} AS domain FROM pages)"
_POS = f"{_RESULTS}, t AS (SELECT DISTINCT query, CASE WHEN query < 8 THEN 'example.org' ELSE 'm.th' END AS host FROM r), p AS (SELECT query, host, min(position) FILTER (WHERE contains(domain, host)) AS position FROM t LEFT JOIN r USING (query) GROUP BY ALL)"


def _tidied(words: str) -> str:
    return f"list_transform({words}, lambda x: lower(regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')))"


def _held(c: str) -> str:
    return " + ".join(f"coalesce(contains(lower({c}), '{w}')::INT, 0)" for w in ("er", "thon", "en", "de"))


SQL = {
    "s19_page_fields": f"WITH {_PARSED}, {_LINKS} SELECT page_id, domain, title, h1, description, keywords, coalesce(links, '') AS links FROM parsed LEFT JOIN links USING (page_id)",
    "a56_page_keywords": f"""WITH {_PARSED}, w AS (SELECT DISTINCT page_id, unnest(list_concat(
            CASE WHEN keywords <> '' THEN {_tidied("string_split(keywords, '|')")} ELSE [] END, list_filter({_tidied("string_split_regex(coalesce(title, ''), '[|\\-–—,•·]')")}, lambda x: length(x) > 2),
            CASE WHEN h1 IS NOT NULL THEN {_tidied("[h1]")} ELSE [] END, list_filter({_tidied("string_split_regex(coalesce(description, ''), '[.,;!?|•·\\-–—]')")}, lambda x: length(x) > 3 AND length(x) < 100))) AS keyword FROM parsed)
        SELECT keyword, count(*) OVER (PARTITION BY keyword) AS cnt, page_id FROM w""",
    "p_seo_score": f"WITH {_PARSED} SELECT page_id, CAST(floor(({_held('title')}) / 4.0::DOUBLE * 40 + ({_held('h1')}) / 4.0::DOUBLE * 35 + ({_held('description')}) / 4.0::DOUBLE * 25 + 0.5) AS INTEGER) AS score FROM parsed",
    "s18_crawl_frontier": """WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + o_orderkey % 3) % 1500 AS b FROM orders),
        r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth WHERE EXISTS (FROM orders WHERE o_custkey = 1) UNION SELECT l.b, depth + 1 FROM r JOIN l ON l.a = r.node WHERE depth < 40)
        SELECT node, min(depth) AS depth FROM r GROUP BY node QUALIFY row_number() OVER (ORDER BY min(depth), node) <= 400""",
    "j32_search_positions": f"WITH {_POS} SELECT query, host, position FROM p",
    "a55_position_summary": f"WITH {_POS} SELECT count(*) AS queries, count(*) FILTER (WHERE position <= 3) AS top3, count(*) FILTER (WHERE position <= 10) AS top10, count(*) FILTER (WHERE position IS NULL) AS not_found FROM p",
    "a55_top_domains": f"WITH {_RESULTS} SELECT domain, count(*) AS cnt FROM r WHERE position <= 5 AND NOT contains(domain, 'tionsh') GROUP BY 1 ORDER BY cnt DESC, domain LIMIT 10",
    "p_normalized_url": """WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)
        SELECT page_id, regexp_replace(string_split(u, '?')[1], '/+$', '') || CASE WHEN contains(u, '?') THEN '?' || array_to_string(list_sort(string_split(regexp_replace(u, '^[^?]*\\?', ''), '&')), '&') ELSE '' END AS url FROM b""",
}
