"""Lots and fields read from the saved pages by two container layouts and by CSS fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import dom

#: A layout is a container selector and the selectors of its fields.
MENU = ("nav li", {"title": "a", "organization": "b", "link": "a@href", "description": "i", "whole": "a"})
ARTICLE = ("article", {"title": "h1", "organization": "header b", "link": "a@href", "description": "p:nth-match(1)", "whole": "h1"})
FIELDS = {"third_link": "nav a:nth-match(2)@href", "ad": "div.ad", "heading": "article > h1", "language": "meta[charset]@charset", "first_item": "ul li a, article a"}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "html")


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of both layouts; the menu's must hold an E, as a country filter would ask."""
    read = dom.read_pages(_pages(spark, sf_dir))
    menu = dom.tender_rows(dom.records_of(*read, *MENU), "Menu", "m", country="e")
    article = dom.tender_rows(dom.records_of(*read, *ARTICLE), "Article", "a", id_pattern=r"lot/(\w+)")
    return menu.withColumn("layout", F.lit("menu")).unionByName(article.withColumn("layout", F.lit("article"))).drop("external_id")


QUERIES = {
    "s05_containers": _containers,
    "p13_css_fields": lambda spark, sf_dir: dom.container_records(_pages(spark, sf_dir), "html", FIELDS),
}

_HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<![^>]*>"


def _unescaped(c: str) -> str:
    for written, meant in dom.ENTITIES.items():
        one = "chr(39)" if meant == "'" else "chr(160)" if meant == "\xa0" else f"'{meant}'"
        c = f"replace({c}, {written.replace(chr(39), chr(39) * 2)!r}, {one})"
    return c


def _attribute(tag: str, name: str) -> str:
    return _unescaped(f"regexp_extract({tag}, '[ ]{name}=\"([^\"]*)\"', 1)")


_DOM = f"""tok AS (SELECT page_id, unnest(a) AS token, generate_subscripts(a, 1) - 1 AS pos
               FROM (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '{_HIDDEN}', '', 'g'), '(?s)<[^>]*>|[^<]+') AS a FROM pages)),
    txt AS (SELECT page_id, pos, regexp_replace({_unescaped("token")}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') AS text FROM tok WHERE NOT starts_with(token, '<')),
    tag AS (SELECT page_id, pos, token, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)) AS name FROM tok WHERE regexp_matches(token, '^</?[a-zA-Z]')),
    run AS (SELECT *, sum(step) OVER (PARTITION BY page_id, name ORDER BY pos) AS s FROM (SELECT *, CASE WHEN starts_with(token, '</') THEN -1 WHEN name IN ({", ".join(f"'{v}'" for v in dom.VOID)}) THEN 0 ELSE 1 END AS step FROM tag)),
    pair AS (SELECT o.page_id, o.pos AS a, o.name, o.token AS tag, CASE WHEN o.step = 0 THEN o.pos ELSE min(c.pos) END AS z
             FROM run o LEFT JOIN run c ON c.page_id = o.page_id AND c.name = o.name AND c.step < 0 AND c.pos > o.pos AND c.s = o.s - 1 WHERE o.step >= 0 GROUP BY o.page_id, o.pos, o.name, o.token, o.step),
    el AS (SELECT p.page_id, p.a, p.name, p.tag, coalesce(p.z, min(q.z), (SELECT max(pos) + 1 FROM tok WHERE tok.page_id = p.page_id)) AS z
           FROM pair p LEFT JOIN pair q ON p.z IS NULL AND q.page_id = p.page_id AND q.a < p.a AND p.a < q.z GROUP BY p.page_id, p.a, p.name, p.tag, p.z)"""


def _field(box: str, condition: str, nth: int = 0, attr: str = "") -> str:
    """(page_id, box, v): the n-th element in each row of `box` that meets a condition, by plain range joins."""
    text = "(SELECT replace(string_agg(text, '' ORDER BY pos), chr(160), ' ') FROM txt WHERE txt.page_id = e.page_id AND e.a < pos AND pos < e.z)"
    value = _attribute("e.tag", attr) if attr else text
    return f"(SELECT e.page_id, b.a AS box, {value} AS v FROM {box} b JOIN el e ON e.page_id = b.page_id AND b.a < e.a AND e.a < b.z WHERE {condition} QUALIFY row_number() OVER (PARTITION BY e.page_id, b.a ORDER BY e.a) = {nth + 1})"


_IN = lambda name: f"EXISTS (FROM el x WHERE x.page_id = e.page_id AND x.a < e.a AND e.a < x.z AND x.name = '{name}')"


def _rows(layout: str, prefix: str, source: str, extra: str) -> str:
    return f"""SELECT page_id, place, '{prefix}-' || coalesce(nullif(regexp_extract(link, '(\\d+)', 1), ''), nullif(string_split(trim(link, '/'), '/')[-1], ''), substr(md5(title || '|{source}|{source}'), 1, 12)) AS id,
        title, '{source}' AS organization, link AS source_url, substr(concat_ws(' ', title, '{source}', nullif(description, '')), 1, 2000) AS search_text, '{layout}' AS layout FROM {layout} WHERE length(title) >= 3 {extra}"""


SQL = {
    "s05_containers": f"""WITH {_DOM}, li AS (SELECT e.*, row_number() OVER (PARTITION BY page_id ORDER BY a) AS place FROM el e WHERE name = 'li' AND {_IN("nav")}), art AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY a) AS place FROM el WHERE name = 'article'),
        menu AS (SELECT li.page_id, place, coalesce(t.v, '') AS title, coalesce(l.v, '') AS link, '' AS description FROM li LEFT JOIN {_field("li", "e.name = 'a'")} t ON t.page_id = li.page_id AND t.box = li.a LEFT JOIN {_field("li", "e.name = 'a'", 0, "href")} l ON l.page_id = li.page_id AND l.box = li.a),
        article AS (SELECT art.page_id, place, coalesce(t.v, '') AS title, '' AS link, coalesce(d.v, '') AS description FROM art LEFT JOIN {_field("art", "e.name = 'h1'")} t ON t.page_id = art.page_id AND t.box = art.a LEFT JOIN {_field("art", "e.name = 'p'", 1)} d ON d.page_id = art.page_id AND d.box = art.a)
        {_rows("menu", "m", "Menu", "AND contains(upper(title), 'E')")} UNION ALL {_rows("article", "a", "Article", "")}""",
    "p13_css_fields": f"""WITH {_DOM}, html AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY a) AS place FROM el WHERE name = 'html')
        SELECT h.page_id, place, coalesce(k.v, '') AS third_link, coalesce(ad.v, '') AS ad, coalesce(hd.v, '') AS heading, coalesce(c.v, '') AS language, coalesce(f.v, '') AS first_item FROM html h
        LEFT JOIN {_field("html", f"e.name = 'a' AND {_IN('nav')}", 2, "href")} k ON k.page_id = h.page_id AND k.box = h.a LEFT JOIN {_field("html", "e.name = 'div' AND contains(e.tag, 'class=\"ad\"')")} ad ON ad.page_id = h.page_id AND ad.box = h.a
        LEFT JOIN {_field("html", f"e.name = 'h1' AND {_IN('article')}")} hd ON hd.page_id = h.page_id AND hd.box = h.a LEFT JOIN {_field("html", "e.name = 'meta' AND contains(e.tag, 'charset')", 0, "charset")} c ON c.page_id = h.page_id AND c.box = h.a
        LEFT JOIN {_field("html", f"e.name = 'a' AND ({_IN('article')} OR {_IN('ul')} AND {_IN('li')})")} f ON f.page_id = h.page_id AND f.box = h.a""",
}
