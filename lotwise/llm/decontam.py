"""Benchmark decontamination by canonical templates, in DataFrame functions only.

A text becomes tokens (runs of letters and digits). Numbers, names (capitalised words within a sentence) and units after a
number become typed placeholders; other tokens are folded to lower case. Windows of `window` canonical tokens are hashed and
hash-joined: all windows of all documents against all windows of the benchmark (an item with fewer tokens is one window of
its own length). One pass over a text serves windows of all lengths: the join key is the hash of a window's first LEAST_TOKENS
tokens, and the hash of the whole window is compared where the keys meet. A joined window counts if its slots are consistent:
each value in it of the item stands for one value of the document and the other way round, so a question with other numbers
or names is caught and a chance meeting of placeholders is not. Windows of tokens folded to lower case are joined as well and
always count: a copy word for word is a leak wherever its capitals stand and whatever else of the passage was changed.

Of an item's windows that read alike, only the first is asked: those of equal folded tokens, and those of equal canonical
tokens whose slots repeat in the same pattern, which are consistent with the same windows. So what a place of a document
meets of an item is bounded, however often the item, the document or both repeat themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import key_filter, marked_by_filter, materialise, spread_join

#: Words that count as units after a number.
UNITS = (
    "km m cm mm mile miles kg g mg lb lbs t l ml h hour hours min minute minutes s sec second seconds day days week weeks "
    "month months year years dollar dollars euro euros usd eur percent pct litre litres liter liters meter meters metre metres"
)
#: Benchmark windows are broadcast up to so many; beyond, both sides are shuffled by the hash.
BROADCAST_WINDOWS = 500_000
#: An item of fewer tokens is no evidence, and neither is a window of which less than half is literal, unless it is copied word for word.
LEAST_TOKENS = 5

MARK = "\ue000"  # before a name, while tokens are made
SEPARATORS = rf"[^\p{{L}}\p{{M}}\p{{N}}{MARK}]+"


def marked(text: Column) -> Column:
    """Tokens parted by single blanks, in their own case, names with MARK in front."""
    named = F.regexp_replace(F.coalesce(text, F.lit("")), r"([^ \t\n\r.!?:][ \t\n\r])(\p{Lu})", f"$1{MARK}$2")
    return F.trim(F.regexp_replace(named, SEPARATORS, " "))


def canonical(tokens: Column) -> Column:
    """The output of `marked` with placeholders: #a for a name, #n for a number, #u for a unit after a number."""
    out = F.regexp_replace(F.lower(tokens), rf"{MARK}[^ ]+", "#a")
    out = F.regexp_replace(out, r"(^| )\p{N}[^ ]*", "$1#n")
    return F.regexp_replace(out, rf"#n ({'|'.join(UNITS.split())})( |$)", "#n #u$2")


def folded(tokens: Column) -> Column:
    """The output of `marked` in lower case, without marks."""
    return F.lower(F.translate(tokens, MARK, ""))


def even(x: Column) -> Column:
    """The hash of a token, its last bit 0."""
    return F.xxhash64(x).bitwiseOR(F.lit(1)).bitwiseXOR(F.lit(1))


def key_of(tokens: list[Column]) -> Column:
    """The hash of a run of token hashes, whatever their last bits."""
    return F.xxhash64(*[t.bitwiseOR(F.lit(1)) for t in tokens])


def windows(docs: DataFrame, own: list[str], window: int) -> DataFrame:
    """The columns `own`, place (from 1) and h1 ... h<window>: the token hashes from each place on, null past the end.

    Each place gives its canonical tokens, and also its folded ones if one of the window is a placeholder (last bit 1).
    """
    canon, literal = F.split(canonical(marked(F.col("text"))), " "), F.split(folded(marked(F.col("text"))), " ")
    tokens = docs.select(*own, canon.alias("canon"), literal.alias("literal"))
    is_slot = lambda x: x.startswith("#")
    flagged = F.transform("canon", lambda x, i: F.when(is_slot(x), F.xxhash64(F.get("literal", i)).bitwiseOR(F.lit(1))).otherwise(even(x)))
    hashed = tokens.select(*own, F.transform("canon", even).alias("c"), F.when(F.exists("canon", is_slot), flagged).otherwise(F.array().cast("array<bigint>")).alias("l"))
    hashed = hashed.select(*own, F.explode(F.array("c", "l")).alias("h"))
    shifted = [F.slice("h", k, F.size("h")).alias(f"h{k}") for k in range(1, window + 1)]
    placed = hashed.select(*own, F.posexplode(F.arrays_zip(*shifted)).alias("place", "t")).select(*own, (F.col("place") + 1).alias("place"), "t.*")
    return placed.filter(F.col(f"h{LEAST_TOKENS}").isNotNull())


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, size, at, own, canon, hashes): own and canon are the window's tokens as written and as canonical.

    hashes: (key, hash, pattern) of the folded tokens, and of the canonical ones if enough of them are literal; pattern says for
    each slot of canonical tokens which slot first has its value, and is empty for folded ones.
    """
    own = F.split(marked(F.col("text")), " ")
    tokens = items.filter("item_id is not null").select("item_id", own.alias("own"), F.split(canonical(marked(F.col("text"))), " ").alias("canon"))
    size = F.least(F.size("canon"), F.lit(window))
    starts = tokens.filter(F.size("canon") >= LEAST_TOKENS).withColumn("size", size).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("canon") - F.col("size") + 1)))
    cut = starts.select("item_id", "size", "at", F.slice("own", F.col("at"), F.col("size")).alias("own"), F.slice("canon", F.col("at"), F.col("size")).alias("canon"))
    literal = F.size(F.filter("canon", lambda x: ~x.startswith("#")))
    run = lambda c: lambda n: key_of([F.get(c, F.lit(k)) for k in range(n)])
    values = F.transform(F.filter(F.arrays_zip("own", "canon"), lambda x: x["canon"].startswith("#")), lambda x: F.lower(F.translate(x["own"], MARK, "")))
    pattern = {"c": F.array_join(F.transform(values, lambda v: F.array_position(values, v)), " "), "l": F.lit("")}
    hashes = lambda c: F.struct(run(c)(LEAST_TOKENS).alias("key"), _by_size(F.col("size"), window, run(c)).alias("hash"), pattern[c].alias("pattern"))
    held = cut.withColumn("c", F.transform("canon", even)).withColumn("l", F.transform("own", lambda x: even(folded(x))))
    both = F.array_distinct(F.array_compact(F.array(F.when(2 * literal >= F.col("size"), hashes("c")), hashes("l"))))
    return held.select("item_id", "size", "at", "own", "canon", both.alias("hashes"))


def _by_size(size: Column, window: int, make) -> Column:
    """make(n) for the n that is the value of `size`, from LEAST_TOKENS to window."""
    out = make(LEAST_TOKENS)
    for n in range(LEAST_TOKENS + 1, window + 1):
        out = F.when(size == n, make(n)).otherwise(out)
    return out


def leaks(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, item_id, n_windows, first_token, n_slots, n_changed: the items that a document holds, one row for each pair.

    docs (doc_id, text), items (item_id, text); further columns are ignored. n_windows: places of the document whose window is
    consistent with one of the item's or copied word for word; first_token: the first of them; n_slots, n_changed: their
    distinct slot values, and those that differ from the item's (of windows that read alike, the item's first).
    Null and empty texts match nothing; rows that repeat a doc_id give one row an item (null doc_ids together too); null
    item_ids are left out; a text may be of any length; either table may be empty. window is at least LEAST_TOKENS.
    """
    held = benchmark_windows(items, window)
    few = held.count() <= BROADCAST_WINDOWS
    sides = held.select("item_id", "size", "at", F.inline("hashes")).groupBy("item_id", "size", "key", "hash", "pattern").agg(F.min("at").alias("at")).drop("pattern")
    text_id = F.xxhash64("text").alias("text_id")
    placed = windows(docs.select("doc_id", text_id, "text"), ["doc_id", "text_id"], window)
    tokens = [F.col(f"h{k}") for k in range(1, window + 1)]
    # The folded tokens of a window without placeholders are its canonical ones: only one of the two rows is asked.
    placed = placed.withColumn("key", key_of(tokens[:LEAST_TOKENS]))
    same = _by_size(F.col("size"), window, lambda n: F.when(tokens[n - 1].isNotNull(), key_of(tokens[:n]))) == F.col("hash")
    if few:
        met = placed.join(F.broadcast(sides), (placed["key"] == sides["key"]) & same)
    else:  # windows whose key no item has are left where they are; the rest meet by their key, a common one in several tasks
        placed = marked_by_filter(placed, "key", key_filter(sides, "key")).filter("_maybe").drop("_maybe")
        met = spread_join(placed, sides, ["key"], ["doc_id", "text_id"]).filter(same)
    hits = materialise(met.select("doc_id", "text_id", "item_id", "size", "place", "at").distinct(), "hits")

    # Slots: only documents with a hit are read again, and only their joined windows are compared.
    where = F.xxhash64("doc_id", "text_id").alias("where")
    asked = marked_by_filter(docs.select("doc_id", text_id, "text").withColumn("where", where), "where", key_filter(hits.select(where), "where"))
    own = asked.filter("_maybe").select("doc_id", "text_id", F.split(marked(F.col("text")), " ").alias("tokens")).dropDuplicates(["doc_id", "text_id"])
    near = hits.join(own, hits.doc_id.eqNullSafe(own.doc_id) & (hits.text_id == own.text_id)).select(
        hits.doc_id, hits.text_id, "item_id", "size", "place", "at", F.slice("tokens", F.col("place"), F.col("size")).alias("theirs")
    )
    pairs = near.join(held, ["item_id", "size", "at"])
    copied = F.transform("own", folded) == F.transform("theirs", folded)
    slot = F.filter(
        F.arrays_zip(F.col("own"), F.when(copied, F.col("own")).otherwise(F.col("theirs")).alias("theirs"), F.col("canon")), lambda x: x["canon"].startswith("#")
    )
    lowered = F.array_distinct(F.transform(slot, lambda x: F.struct(F.lower(x["own"]).alias("ours"), F.lower(x["theirs"]).alias("theirs"))))
    pairs = pairs.select("doc_id", "text_id", "item_id", "place", lowered.alias("slots"))
    ours, theirs = F.array_distinct(F.transform("slots", lambda x: x["ours"])), F.array_distinct(F.transform("slots", lambda x: x["theirs"]))
    sound = pairs.filter((F.size("slots") == F.size(ours)) & (F.size("slots") == F.size(theirs)))
    lines = sound.groupBy("doc_id", "text_id", "item_id").agg(
        F.count_distinct("place").alias("n"), F.min("place").alias("first"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    changed = F.size(F.filter("slots", lambda x: x["ours"] != x["theirs"]))
    return lines.groupBy("doc_id", "item_id").agg(
        F.sum("n").alias("n_windows"),
        F.min("first").alias("first_token"),
        F.sum(F.size("slots")).alias("n_slots"),
        F.sum(changed).alias("n_changed"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows whose text holds an item; columns unchanged, whatever their names.

    Null and empty texts stay; rows that repeat go or stay together; either table may be empty.
    """
    text_id = F.xxhash64("text")
    wrapped = docs.select(F.struct("*").alias("row"), text_id.alias("text_id"))
    bad = leaks(docs.select(text_id.alias("doc_id"), "text"), items, window).select(F.col("doc_id").alias("text_id")).distinct()
    return wrapped.join(bad, "text_id", "left_anti").select("row.*")
