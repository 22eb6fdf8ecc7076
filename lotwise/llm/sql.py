"""DuckDB SQL for the opN_ queries that SQL can express."""

from __future__ import annotations

from .decontam import LEAST_TOKENS, UNITS
from .linedup import LOWER, UPPER


def words_of(text: str) -> str:
    folded = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    return f"list_filter(string_split_regex({folded}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


STUPID_BACKOFF = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {words_of("text")} AS ws FROM documents),
t AS (SELECT rid, i, ws[i] AS word, CASE WHEN i > 1 THEN ws[i - 1] END AS before
      FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
uni AS (SELECT word, count(*) AS n FROM t GROUP BY word),
bi AS (SELECT before, word, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY before, word),
total AS (SELECT count(*) AS n FROM t),
s AS (SELECT t.rid, CASE WHEN bi.n >= 2 THEN ln(bi.n / ub.n)
                    WHEN t.before IS NOT NULL THEN ln(0.4) + ln(u.n) - ln((SELECT n FROM total))
                    ELSE ln(u.n) - ln((SELECT n FROM total)) END AS l,
             t.before IS NOT NULL AND bi.n < 2 AS off
      FROM t JOIN uni u ON u.word = t.word LEFT JOIN uni ub ON ub.word = t.before
      LEFT JOIN bi ON bi.before = t.before AND bi.word = t.word)
SELECT w.doc_id, count(s.rid) AS n_words, count(*) FILTER (WHERE s.off) AS n_backoff, round(sum(s.l) / count(s.rid), 6) AS lm_score
FROM w LEFT JOIN s ON s.rid = w.rid GROUP BY w.rid, w.doc_id
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words_of("text")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
         SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * pair.n >= 75 * (na.n + nb.n - pair.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.c AS component_id, least.c = d.doc_id AS kept
FROM documents d JOIN least ON least.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: The same without `kept`, and at 80 instead of 75.
JACCARD_JOIN = NEAR_DEDUP.replace(">= 75 *", ">= 80 *").replace(", least.c = d.doc_id AS kept", "")

LINE_DEDUP = f"""
WITH l AS (SELECT rid, doc_id, i, ls[i] AS line, translate(trim(ls[i], E' \\t\\n\\x0b\\x0c\\r'), '{UPPER}', '{LOWER}') AS key
           FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i
                 FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), E'\\n') AS ls FROM documents))),
often AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT l.*, often.key IS NOT NULL AS gone FROM l LEFT JOIN often ON often.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\\n' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


def _canon(table: str, key: str) -> str:
    named = "regexp_replace(coalesce(text, ''), '([^ \\t\\n\\r.!?:][ \\t\\n\\r])(\\p{Lu})', '\\1' || chr(57344) || '\\2', 'g')"
    own = f"trim(regexp_replace({named}, '[^\\p{{L}}\\p{{M}}\\p{{N}}' || chr(57344) || ']+', ' ', 'g'))"
    canon = "regexp_replace(lower(own), chr(57344) || '[^ ]+', '#a', 'g')"
    canon = f"regexp_replace({canon}, '(^| )\\p{{N}}[^ ]*', '\\1#n', 'g')"
    canon = f"regexp_replace({canon}, '#n ({'|'.join(UNITS.split())})( |$)', '#n #u\\2', 'g')"
    return f"SELECT {key}, rid, string_split(own, ' ') AS own, string_split({canon}, ' ') AS canon FROM (SELECT {key}, row_number() OVER () AS rid, {own} AS own FROM {table})"


def _folded(tokens: str) -> str:
    return f"list_transform({tokens}, lambda x: lower(replace(x, chr(57344), '')))"


DECONTAMINATION = f"""
WITH d AS ({_canon("documents", "doc_id")}),
b AS ({_canon("benchmark", "item_id")}),
bw AS (SELECT item_id, size, spot, own[spot:spot + size - 1] AS own, canon[spot:spot + size - 1] AS canon
       FROM (SELECT *, least(len(canon), 10) AS size, unnest(range(1, len(canon) - least(len(canon), 10) + 2)) AS spot FROM b WHERE len(canon) >= {LEAST_TOKENS})),
held AS (SELECT *, array_to_string(canon, ' ') AS key, array_to_string({_folded("own")}, ' ') AS literal,
                2 * len(list_filter(canon, lambda x: NOT starts_with(x, '#'))) >= size AS telling,
                list_transform(list_filter(range(1, len(canon) + 1), lambda k: starts_with(canon[k], '#')), lambda k: {_folded("own")}[k]) AS vals FROM bw),
asked AS (SELECT item_id, size, key AS text, true AS template, min(spot) AS spot FROM held WHERE telling GROUP BY item_id, size, key, list_transform(vals, lambda v: list_position(vals, v))
          UNION ALL SELECT item_id, size, literal, false, min(spot) FROM held GROUP BY item_id, size, literal),
dw AS (SELECT doc_id, rid, size, place, own[place:place + size - 1] AS own, array_to_string(canon[place:place + size - 1], ' ') AS key,
              array_to_string({_folded("own[place:place + size - 1]")}, ' ') AS literal
       FROM (SELECT d.*, s.size, unnest(range(1, len(canon) - s.size + 2)) AS place FROM d, (SELECT DISTINCT size FROM held) s WHERE len(canon) >= s.size)),
met AS (SELECT DISTINCT dw.rid, dw.place, asked.item_id, asked.size, asked.spot FROM dw JOIN asked ON asked.size = dw.size AND asked.text = CASE WHEN asked.template THEN dw.key ELSE dw.literal END),
hit AS (SELECT dw.doc_id, met.rid, met.item_id, met.place, held.canon, {_folded("held.own")} AS ours,
               CASE WHEN held.literal = dw.literal THEN {_folded("held.own")} ELSE {_folded("dw.own")} END AS theirs
        FROM met JOIN held ON held.item_id = met.item_id AND held.size = met.size AND held.spot = met.spot JOIN dw ON dw.rid = met.rid AND dw.size = met.size AND dw.place = met.place),
slotted AS (SELECT *, list_distinct(list_transform(list_filter(range(1, len(canon) + 1), lambda k: starts_with(canon[k], '#')), lambda k: [ours[k], theirs[k]])) AS slots FROM hit),
sound AS (SELECT * FROM slotted WHERE len(slots) = len(list_distinct(list_transform(slots, lambda x: x[1]))) AND len(slots) = len(list_distinct(list_transform(slots, lambda x: x[2])))),
line AS (SELECT doc_id, rid, item_id, count(DISTINCT place) AS n, min(place) AS first, list_distinct(flatten(list(slots))) AS slots FROM sound GROUP BY doc_id, rid, item_id)
SELECT doc_id, item_id, CAST(sum(n) AS BIGINT) AS n_windows, CAST(min(first) AS INTEGER) AS first_token,
       CAST(sum(len(slots)) AS BIGINT) AS n_slots, CAST(sum(len(list_filter(slots, lambda x: x[1] <> x[2]))) AS BIGINT) AS n_changed
FROM line GROUP BY doc_id, item_id
"""

FILTER_AUDIT = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM c a, c b, c d, c e, c g
      WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT part, good, toxic, failed, filter_order, step, filter_order[step] AS filter,
             coalesce(list_min(list_filter(range(1, 6), lambda k: contains(failed, filter_order[k]))), 6) AS first
      FROM f, o, range(1, 6) t(step)),
n AS (SELECT part, filter_order, step, filter, count(*) FILTER (WHERE first > step) AS kept, count(*) FILTER (WHERE first = step) AS removed,
             count(*) FILTER (WHERE first < step AND contains(failed, filter)) AS redundant, count(*) FILTER (WHERE failed = filter) AS unique_fails,
             count(*) FILTER (WHERE first = step AND good = 1) AS good_lost, count(*) FILTER (WHERE first = step AND toxic = 1) AS toxic_lost
      FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM n
"""

_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""

PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS key,
             len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM t),
c AS (SELECT conv_id, list({{'key': key, 'words': words}} ORDER BY turn NULLS FIRST, key) AS own FROM k GROUP BY conv_id),
h AS (SELECT *, CAST({_CRC32} % 4 AS INT) AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[:h.h], h.own[h.h + 1:]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS n, d AS depth, CASE WHEN d > 0 THEN turns[d].words ELSE 0 END AS words,
             md5(array_to_string(list_transform(turns[:d], lambda x: x.key), ',')) AS node,
             CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[:d - 1], lambda x: x.key), ',')) END AS parent
      FROM r, unnest(range(0, len(turns) + 1)) u(d)),
n AS (SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own_saved,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
      FROM p GROUP BY depth, node),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY parent, depth),
leaf AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids ON kids.parent = n.node AND kids.depth = n.depth),
path AS (SELECT DISTINCT a.depth, a.node, b.depth AS below, b.node AS under FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sub AS (SELECT path.depth, path.node, count(*) FILTER (WHERE l.n_children = 0) AS n_leaves, sum(l.own_saved) AS saved
        FROM path JOIN leaf l ON l.depth = path.below AND l.node = path.under GROUP BY path.depth, path.node)
SELECT l.conv_id, l.depth, up.conv_id AS parent_conv_id, l.n_convs, l.n_children, sub.n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, l.ends_sha256
FROM leaf l JOIN sub ON sub.depth = l.depth AND sub.node = l.node LEFT JOIN n up ON up.node = l.parent AND up.depth = l.depth - 1
"""

ORACLE_SQL = {
    "op11_conversation_prefix_trie": PREFIX_TRIE,
    "op13_ngram_jaccard_join": JACCARD_JOIN,
    "op12_filter_interaction_audit": FILTER_AUDIT,
    "op2_stupid_backoff": STUPID_BACKOFF,
    "op5_minhash_near_dedup": NEAR_DEDUP,
    "op6_line_dedup_runs": LINE_DEDUP,
    "op8_template_decontamination": DECONTAMINATION,
}
