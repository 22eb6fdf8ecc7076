"""A keyword dictionary as a table: which texts hold which keyword, by an inverted index over word beginnings.

A keyword's root begins a word of the text (or a run of words, if it has several). Texts give each distinct word once, the
dictionary its roots by their first word; both meet by equality: a root of one word equals a prefix of a text's word, and
prefixes are made only of the lengths that roots have. So the cost follows the words of a text, not the dictionary's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LEAST_STEM, SUFFIXES

SPECIAL = r"([\\.\[\]{}()*+\-?^$|#&~/])"


def stem_of(word: Column) -> Column:
    """A keyword without the first of SUFFIXES that it ends with, if enough is left: the rule of `text.stem`, by built-in functions."""
    out = word
    for suffix in reversed(SUFFIXES):
        out = F.when(word.endswith(suffix) & (F.char_length(word) - len(suffix) >= LEAST_STEM), F.substring(word, F.lit(1), F.char_length(word) - len(suffix))).otherwise(out)
    return F.when(F.char_length(word) > LEAST_STEM, out).otherwise(word)


def rooted(dictionary: DataFrame) -> DataFrame:
    """dictionary (keyword, rank, weak, whole, not_before) with root, key (its first run of letters), several (whether more follows) and pattern.

    A `whole` keyword isn't cut to its stem. Of a keyword that repeats the least rank counts; null and empty ones are left out.
    """
    once = dictionary.filter("keyword is not null and keyword <> ''").groupBy("keyword").agg(
        F.min("rank").alias("rank"), F.max(F.coalesce("weak", F.lit(False))).alias("weak"), F.max(F.coalesce("whole", F.lit(False))).alias("whole"), F.min("not_before").alias("not_before")
    )
    root = F.when(F.col("whole"), F.col("keyword")).otherwise(stem_of(F.col("keyword")))
    key = F.regexp_extract("root", r"\p{L}+", 0)
    pattern = F.concat(F.lit(r"(?:^|[^\p{L}])"), F.regexp_replace("root", SPECIAL, r"\\$1"))
    return once.withColumn("root", root).select("*", key.alias("key"), (key != F.col("root")).alias("several"), pattern.alias("pattern"))


def keyword_hits(texts: DataFrame, dictionary: DataFrame, negative: tuple[str, ...] = ()) -> DataFrame:
    """(id, keyword, rank) of the keywords that each of texts (id, text) holds.

    weak keywords don't count in texts that hold one of the `negative` stems; a keyword doesn't count if what follows its first
    place begins with one of its not_before (an array, or null). Null texts hold nothing; texts that repeat an id are asked
    together. A keyword that begins with a blank is never held.
    """
    low = texts.filter("id is not null").select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    entries = rooted(dictionary)
    lengths = entries.filter("key <> '' and not several").agg(F.coalesce(F.array_sort(F.collect_set(F.char_length("key"))), F.array().cast("array<int>")).alias("lengths"))  # one row, of as many lengths as words have
    held = low.crossJoin(F.broadcast(lengths)).select("id", "lengths", F.array_distinct(F.regexp_extract_all("low", F.lit(r"\p{L}+"), 0)).alias("words"))
    words = held.select("id", F.explode("words").alias("word"))
    cuts = F.transform("lengths", lambda n: F.transform(F.filter("words", lambda w: F.char_length(w) >= n), lambda w: F.substring(w, F.lit(1), n)))
    begins = held.select("id", F.explode(F.array_distinct(F.flatten(cuts))).alias("key"))  # a text's own are distinct before they are shuffled
    one = begins.join(entries.filter("not several"), "key").select("id", "keyword", "rank", ((F.col("weak") & F.lit(bool(negative))) | F.col("not_before").isNotNull()).alias("open"))
    several = words.select("id", F.col("word").alias("key")).join(entries.filter("several and key <> ''"), "key").select("id", "keyword")
    # A root that begins with another sign (a digit, say) or has no letter is asked of the texts that hold its sign runs.
    signs = entries.filter(r"root rlike '^[^\\p{L}]'").withColumn("key", F.regexp_extract("root", r"^[^\p{L}\s]+", 0))
    runs = low.select("id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(r"[^\p{L}\s]+"), 0))).alias("run"))
    ends = F.transform(F.sequence(F.lit(1), F.char_length("run")), lambda n: F.substring("run", n, F.char_length("run")))
    cut = runs.select("id", F.explode(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.transform(F.sequence(F.lit(1), F.char_length(e)), lambda n: F.substring(e, F.lit(1), n)))))).alias("key"))
    odd = cut.join(signs.filter("key <> ''"), "key").select("id", "keyword")
    # A root that is one word is held if it begins a word; the text is asked again only for what else the keyword demands.
    sure = one.filter("not open").select("id", "keyword", "rank")
    found = one.filter("open").select("id", "keyword").union(several.join(signs.select("keyword"), "keyword", "left_anti").select("id", "keyword")).union(odd)
    asked = found.distinct().join(low, "id").join(entries, "keyword").filter(F.rlike("low", "pattern"))
    after = F.expr("regexp_extract(low, concat(pattern, '((?s).{0,10})'), 1)")
    barred = F.exists(F.coalesce("not_before", F.array().cast("array<string>")), lambda w: after.startswith(w))
    alien = F.lit(False)
    for stem in negative:
        alien = alien | F.col("low").contains(stem)
    return asked.filter(~barred & ~(F.col("weak") & alien)).select("id", "keyword", "rank").union(sure).distinct()


def first_keywords(texts: DataFrame, dictionary: DataFrame, negative: tuple[str, ...] = ()) -> DataFrame:
    """(id, keyword): of each text that holds any the keyword of the least rank."""
    return keyword_hits(texts, dictionary, negative).groupBy("id").agg(F.min_by("keyword", F.struct("rank", "keyword")).alias("keyword"))
