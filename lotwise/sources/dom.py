"""Records from saved HTML: elements as intervals of tag events, CSS steps as joins and window sums over them.

A page becomes tokens (tags and the texts between them); comments, doctypes and the contents of script and style go first. An
element is the interval from its open tag to the close tag that closes it: within a page and a tag name, running sums give
each tag its level, and an open tag is closed by the next close tag of its level. A close tag without an open one is ignored;
an element that is never closed ends with the element around it. So the tables of `elements` and `texts` hold everything that
selectors ask, whatever the page's size: a descendant step is a running count of open ancestors, a child step an equality of
parents, `:nth-match(n)` a rank, `@attr` a column.

Null and empty pages have no elements. Rows that repeat a page's key count as one page.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements that hold nothing and have no close tag.
VOID = "area base br col embed hr img input link meta source track wbr".split()
#: What named and numbered characters stand for; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#34;": '"', "&#x27;": "'", "&nbsp;": "\xa0", "&#160;": "\xa0", "&amp;": "&"}
#: Tokens of a page that share a bucket, by which containers and what they hold meet.
BUCKET = 256
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<![^>]*>"
STRIPPED = r"^[\s\xa0]+|[\s\xa0]+$"


def unescaped(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), c)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag as it is written, quoted or not; null if it has none."""
    found = F.regexp_extract(tag, rf"""(?is)^<[^\s>]+(?:\s+[^\s=>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*?\s+({re.escape(name)}\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))""", 1)
    return F.when(found != "", unescaped(F.regexp_replace(found, r"""(?s)^[^=]*=\s*["']?|["']$""", "")))


def tokens(pages: DataFrame) -> DataFrame:
    """(page_id, pos, token) of pages (page_id, html)."""
    seen = F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, "")
    once = pages.filter("page_id is not null").groupBy("page_id").agg(F.max("html").alias("html"))
    return once.select("page_id", F.posexplode(F.regexp_extract_all(seen, F.lit(r"(?s)<[^>]*>|[^<]+"), 0)).alias("pos", "token"))


def texts(tokens_: DataFrame) -> DataFrame:
    """(page_id, pos, text) of the texts between tags, stripped; blank ones are left out."""
    text = F.regexp_replace(unescaped(F.col("token")), STRIPPED, "")
    return tokens_.filter("not startswith(token, '<')").select("page_id", "pos", text.alias("text")).filter("text <> ''")


def elements(tokens_: DataFrame) -> DataFrame:
    """(page_id, start, end, name, tag, depth, parent) of every element; parent is the start of the one around it."""
    from ..session import written

    name = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
    tags = tokens_.select("page_id", "pos", "token", name.alias("name")).filter("name <> ''")
    closes, empty = F.col("token").startswith("</"), F.col("name").isin(*VOID) | F.col("token").endswith("/>")
    tags = tags.withColumn("step", F.when(closes, -1).when(empty, 0).otherwise(1))
    pairs = tags.filter("step <> 0")
    order = Window.partitionBy("page_id", "name").orderBy("pos")
    sums = pairs.withColumn("s", F.sum("step").over(order))
    low = F.least(F.lit(0), F.coalesce(F.min("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    level = sums.withColumn("low", low).filter("not (step < 0 and s < low)")  # else nothing is open that it could close
    level = level.withColumn("level", F.col("s") - F.col("low") + F.when(F.col("step") < 0, 1).otherwise(0))
    next_ = Window.partitionBy("page_id", "name", "level").orderBy("pos")
    closed = level.withColumn("end", F.when(F.lead("step").over(next_) < 0, F.lead("pos").over(next_))).filter("step > 0").select("page_id", F.col("pos").alias("start"), "end", "name", F.col("token").alias("tag"))
    closed = written(closed, "closed")  # three parts of what follows read it

    # What is never closed ends with the least interval around it, or with the page.
    whole = closed.filter("end is not null").select("page_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    open_ = closed.filter("end is null").drop("end")
    around = open_.join(whole, "page_id").filter("_s < start and start < _e").groupBy("page_id", "start").agg(F.min("_e").alias("end"))
    last = tokens_.groupBy("page_id").agg((F.max("pos") + 1).alias("_last"))
    ended = open_.join(around, ["page_id", "start"], "left").join(last, "page_id").withColumn("end", F.coalesce("end", "_last"))
    alone = tags.filter("step = 0").select("page_id", F.col("pos").alias("start"), F.col("pos").alias("end"), "name", F.col("token").alias("tag"))
    nodes = closed.filter("end is not null").unionByName(ended.select(closed.columns)).unionByName(alone)

    # The depth is the number of intervals that are open; the parent is the last element before it that is one level up.
    moves = nodes.select("page_id", F.col("start").alias("at"), F.lit(1).alias("d"), "start", "end", "name", "tag")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in nodes.dtypes if c != "page_id"]
    moves = moves.union(nodes.select("page_id", F.col("end").alias("at"), F.lit(-1), *nothing))
    depth = F.sum("d").over(Window.partitionBy("page_id").orderBy("at", F.desc("d")))
    placed = moves.withColumn("depth", depth).filter("start is not null").drop("at", "d")
    both = placed.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("asks")).withColumn("key", F.col("depth") - F.col("asks").cast("int"))
    up = F.last(F.when(~F.col("asks"), F.col("start")), ignorenulls=True).over(Window.partitionBy("page_id", "key").orderBy("start"))
    return both.withColumn("parent", up).filter("asks").drop("asks", "key")


def _holds(simple: str) -> Column:
    """The condition of one compound selector, such as div.card#main[href^=x], on name and tag."""
    met = F.lit(True)
    parts = re.findall(r"\[[^\]]*\]|[.#]?[\w-]+|\*", simple)
    if "".join(parts) != simple:
        raise ValueError(f"selector not supported: {simple!r}")
    for part in parts:
        if part[0] == ".":
            met &= F.array_contains(F.split(F.coalesce(attribute(F.col("tag"), "class"), F.lit("")), r"\s+"), part[1:])
        elif part[0] == "#":
            met &= F.coalesce(attribute(F.col("tag"), "id") == part[1:], F.lit(False))
        elif part[0] == "[":
            name, how, value = re.fullmatch(r"""\[([\w-]+)(?:([*^$]?)=["']?(.*?)["']?)?\]""", part).groups()
            held = attribute(F.col("tag"), name)
            tests = {None: held.isNotNull(), "": held == value, "*": held.contains(value or ""), "^": held.startswith(value or ""), "$": held.endswith(value or "")}
            met &= F.coalesce(tests[how], F.lit(False))
        elif part != "*":
            met &= F.col("name") == part.lower()
    return met


def _below(nodes: DataFrame, around: DataFrame) -> DataFrame:
    """The nodes that lie in one of `around`: at their start more of these have begun than ended."""
    asks = nodes.select("page_id", F.col("start").alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("d"), F.struct(*nodes.columns).alias("node"))
    none = F.lit(None).cast(asks.schema["node"].dataType)
    begins = around.select("page_id", F.col("start").alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("d"), none.alias("node"))
    ends = around.select("page_id", F.col("end").alias("at"), F.lit(2).alias("turn"), F.lit(-1).alias("d"), none.alias("node"))
    opened = F.sum("d").over(Window.partitionBy("page_id").orderBy("at", "turn"))
    return asks.union(begins).union(ends).withColumn("opened", opened).filter("node is not null and opened > 0").select("node.*")


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The elements that a selector matches: compounds, descendants (blank), children (>), alternatives (comma)."""
    found = []
    for one in selector.split(","):
        steps = re.sub(r"\s*>\s*", " > ", one.strip()).split()
        now, child = None, False
        for step in steps:
            if step == ">":
                child = True
                continue
            own = nodes.filter(_holds(step))
            if now is not None and child:
                own = own.join(now.select("page_id", F.col("start").alias("parent")), ["page_id", "parent"], "left_semi").select(nodes.columns)
            elif now is not None:
                own = _below(own, now)
            now, child = own, False
        found.append(now)
    return found[0] if len(found) == 1 else reduce(DataFrame.union, found).dropDuplicates(["page_id", "start"])


def _within(containers: DataFrame, inner: DataFrame, at: str) -> DataFrame:
    """inner (page_id, at, ...) with the start of each container that holds it; both sides meet by buckets of the page."""
    spans = containers.select("page_id", F.col("start").alias("container"), F.col("end").alias("_end"), F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET))).alias("_bucket"))
    return inner.withColumn("_bucket", F.floor(F.col(at) / BUCKET)).join(spans, ["page_id", "_bucket"]).filter((F.col("container") < F.col(at)) & (F.col(at) < F.col("_end"))).drop("_bucket", "_end")


def text_of(found: DataFrame, texts_: DataFrame) -> DataFrame:
    """found (page_id, start, end, ...) with `text`: its texts, stripped and joined without blanks; no-break blanks are blanks."""
    parts = _within(found.select("page_id", "start", "end").distinct(), texts_, "pos").groupBy("page_id", F.col("container").alias("start")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    joined = F.translate(F.array_join(F.transform("parts", lambda p: p["text"]), ""), "\xa0", " ")
    return found.join(parts, ["page_id", "start"], "left").withColumn("text", F.coalesce(joined, F.lit(""))).drop("parts")


def field(nodes: DataFrame, texts_: DataFrame, containers: DataFrame, selector: str) -> DataFrame:
    """(page_id, container, value) of the first element in a container that the selector matches.

    `selector@attr` gives an attribute, `@attr` one of the container's own, `selector:nth-match(n)` the n-th match from 0.
    Containers without a match are left out.
    """
    path, _, name = selector.rpartition("@") if "@" in selector else (selector, "", "")
    if not path:
        return containers.select("page_id", F.col("start").alias("container"), F.coalesce(attribute(F.col("tag"), name), F.lit("")).alias("value"))
    nth = re.fullmatch(r"(.+):nth-match\((\d+)\)", path)
    path, n = (nth.group(1), int(nth.group(2))) if nth else (path, 0)
    met = _within(containers, select(nodes, path), "start")
    if n:
        one = met.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "container").orderBy("start"))).filter(F.col("_n") == n + 1).drop("_n")
    else:
        first = met.groupBy("page_id", "container").agg(F.min(F.struct("start", "end", "tag")).alias("first"))
        one = first.select("page_id", "container", "first.*")
    if name:
        return one.select("page_id", "container", F.coalesce(attribute(F.col("tag"), name), F.lit("")).alias("value"))
    return text_of(one, texts_).select("page_id", "container", F.col("text").alias("value"))


def read_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The elements and texts of pages (page_id, html), written once for all that is selected from them."""
    from ..session import written

    read = written(tokens(pages), "tokens")
    return written(elements(read), "elements"), written(texts(read), "texts")


def records_of(nodes: DataFrame, held: DataFrame, container: str, fields: dict[str, str]) -> DataFrame:
    """page_id, place (of the container in its page, from 1) and the fields by name, '' where a container has no match.

    Fields that differ in name only are looked up once.
    """
    found = select(nodes, container)
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("start")))
    out = found.select("page_id", F.col("start").alias("container"), "place")
    first = {selector: name for name, selector in reversed(fields.items())}
    for selector, name in first.items():
        out = out.join(field(nodes, held, found, selector).withColumnRenamed("value", name), ["page_id", "container"], "left")
    return out.select("page_id", "place", *[F.coalesce(first[selector], F.lit("")).alias(name) for name, selector in fields.items()])


def container_records(pages: DataFrame, container: str, fields: dict[str, str]) -> DataFrame:
    """The records of one layout of pages."""
    return records_of(*read_pages(pages), container, fields)


def tender_rows(records: DataFrame, source: str, prefix: str, id_pattern: str = "", country: str = "") -> DataFrame:
    """Records (title, organization, link, description, whole) of a source as rows of lots.

    A title of under 3 characters is none, and its record is left out; so is one whose whole text lacks the country. The
    external id is what the pattern finds in the link, else its first digits, else its last part, else a hash of the content.
    """
    organization = F.when(F.col("organization") == "", source).otherwise(F.col("organization"))
    trimmed = F.regexp_replace("link", "^/+|/+$", "")
    tries = [F.regexp_extract("link", p, 1) for p in ([id_pattern] if id_pattern else []) + [r"(\d+)"]] + [F.substring_index(trimmed, "/", -1)]
    by_content = F.substring(F.md5(F.concat_ws("|", "title", organization, F.lit(source)).cast("binary")), 1, 12)
    external = F.coalesce(*[F.nullif(t, F.lit("")) for t in tries], by_content)
    kept = records.filter(F.char_length("title") >= 3)
    if country:
        kept = kept.filter(F.upper("whole").contains(country.upper()))
    return kept.select(
        "page_id", "place", F.concat(F.lit(f"{prefix}-"), external).alias("id"), external.alias("external_id"), "title", organization.alias("organization"),
        F.col("link").alias("source_url"), F.substring(F.concat_ws(" ", "title", organization, F.nullif(F.col("description"), F.lit(""))), 1, 2000).alias("search_text"),
    )
