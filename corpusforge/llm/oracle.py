"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .chat import TURN_END, TURN_START
from .decontam import WINDOW
from .mixing import EPOCHS, WEIGHTS
from .prefix_trie import MOST_SHARED, SHARED_BY
from .quality_rules import STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE octet_length(body) >= 100 GROUP BY digest)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""

OP2 = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(f"{float(x)}::DOUBLE" for x in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}) + 1] AS w, (source_size * {EPOCHS})::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level * w <= cap), 0) * w) AS target FROM l),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, k, size, epoch, ((source_size * epoch + cum)::DOUBLE / target) AS vt FROM q, range({EPOCHS}) AS r(epoch) WHERE size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY vt, k, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM e),
cut AS (SELECT coalesce(min(CASE WHEN upto > (SELECT sum(source_size) FROM t) THEN upto END), 9e18) AS first_out FROM c),
n AS (SELECT doc_id, size, count(*) AS times FROM c, cut WHERE upto < first_out GROUP BY ALL)
SELECT q.doc_id, q.size, source_size, target, (CASE WHEN q.size > 0 THEN q.size * coalesce(times, 0) ELSE 0 END)::BIGINT AS taken
FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.size = n.size
"""

OP3 = f"""
WITH t AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
b AS (SELECT pair_id FROM o GROUP BY pair_id HAVING count(DISTINCT side) = 2),
m AS (SELECT pair_id, pos, count(*) = 2 AND count(DISTINCT (role, text)) = 1 AS same FROM o JOIN b USING (pair_id) GROUP BY pair_id, pos),
p AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN pos END) - 1, max(pos)) AS n FROM m GROUP BY pair_id),
r AS (SELECT o.*, n, '{TURN_START}' || role || chr(10) AS head, '{TURN_START}' || role || chr(10) || text || '{TURN_END.strip()}' || chr(10) AS shown FROM o JOIN p USING (pair_id)),
x AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side, pos > n ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM r)
SELECT pair_id, any_value(n)::BIGINT AS n_prompt_turns,
  count(CASE WHEN side = 0 AND pos > n THEN 1 END)::BIGINT AS n_chosen_turns, count(CASE WHEN side = 1 AND pos > n THEN 1 END)::BIGINT AS n_rejected_turns,
  coalesce(string_agg(CASE WHEN side = 0 AND pos <= n THEN shown END, '' ORDER BY pos), '') AS prompt,
  coalesce(string_agg(CASE WHEN side = 0 AND pos > n THEN shown END, '' ORDER BY pos), '') AS chosen,
  coalesce(string_agg(CASE WHEN side = 1 AND pos > n THEN shown END, '' ORDER BY pos), '') AS rejected,
  coalesce(string_agg(CASE WHEN side = 0 AND pos > n AND role = 'assistant' THEN (off + length(head))::VARCHAR || ':' || (off + length(shown))::VARCHAR END, ',' ORDER BY pos), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN side = 1 AND pos > n AND role = 'assistant' THEN (off + length(head))::VARCHAR || ':' || (off + length(shown))::VARCHAR END, ',' ORDER BY pos), '') AS rejected_mask
FROM x GROUP BY pair_id
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS both_have FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT x, y FROM c JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * both_have >= 75 * (a.n + b.n - both_have)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(doc_id) AS low FROM reach JOIN d ON d.rid = y GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(doc_id, low), doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN low ON x = rid
"""

_BENCH = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_BENCH}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_BENCH}) AS w FROM benchmark),
i AS (SELECT *, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT rid, p, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hw AS (SELECT rid, count(DISTINCT p + o)::BIGINT AS n_hit FROM (SELECT DISTINCT rid, p, n FROM h), range({WINDOW}) r(o) WHERE o < n GROUP BY rid),
hi AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
x AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM x) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n_rep FROM r, range(3) g(o) GROUP BY rid),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(n_rep, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop
  FROM d LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 20 AND n_symbols / greatest(n_words, 1) <= 0.2
    AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_stop / greatest(n_words, 1) >= 0.01 AS kept
FROM f
"""

PII_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[ -]', '', 'g')) AS c, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS p FROM d)
SELECT doc_id, len(e)::BIGINT AS n_email,
  len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: coalesce(try_cast(y AS BIGINT), 256))) <= 255))::BIGINT AS n_ip,
  len(list_filter(c, lambda x: len(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, len(x)), lambda k: CASE WHEN k % 2 = 0 THEN substr(x, len(x) - k, 1)::INT
    ELSE (2 * substr(x, len(x) - k, 1)::INT) // 10 + (2 * substr(x, len(x) - k, 1)::INT) % 10 END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(p, lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone
FROM m
"""

SHARD_LAW = """
SELECT count(*) AS n, sum(octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS bytes, true AS gapless, true AS near_equal, true AS groups_whole FROM documents
"""

# crc32 of a decimal id, which DuckDB lacks: bit by bit over the bytes of the text.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len({0}::VARCHAR)), lambda i: ascii(({0}::VARCHAR)[i + 1])::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295)"

OP13 = f"""
WITH d AS (SELECT conv_id::BIGINT AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, md5(len(role) || ':' || role || ':' || text) AS g, len(text) AS size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(len(role) || ':' || role || ':' || text)) AS p FROM d),
h AS (SELECT c, ({_CRC32.format("c")}) % {MOST_SHARED} AS h FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT h.c, b.p, b.g, b.size FROM h JOIN t b ON b.c = h.c - h.c % {SHARED_BY} AND b.p <= h),
r AS (SELECT * FROM b UNION ALL SELECT t.c, t.p - h + (SELECT count(*) FROM b WHERE b.c = t.c), t.g, t.size FROM t JOIN h USING (c) WHERE t.p > h),
o AS (SELECT c, p AS depth, md5(string_agg(g, '' ORDER BY p) OVER (PARTITION BY c ORDER BY p ROWS UNBOUNDED PRECEDING)) AS k,
  md5(coalesce(string_agg(g, '' ORDER BY p) OVER (PARTITION BY c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS parent, size FROM r
  UNION ALL SELECT c, 0, md5(''), NULL, 0 FROM h),
n AS (SELECT k, depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM o GROUP BY k, depth),
ch AS (SELECT parent AS k, count(*) AS n_children FROM n GROUP BY parent),
e AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM (SELECT c, arg_max(k, depth) AS k FROM o GROUP BY c) GROUP BY k),
below AS (SELECT DISTINCT a.k, x.k AS under FROM o a JOIN o x ON a.c = x.c AND x.depth >= a.depth),
s AS (SELECT below.k, count(*) FILTER (WHERE ch.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens FROM below JOIN n ON n.k = below.under LEFT JOIN ch ON ch.k = n.k GROUP BY below.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n JOIN s USING (k) LEFT JOIN ch ON ch.k = n.k LEFT JOIN e ON e.k = n.k LEFT JOIN n u ON u.k = n.parent
"""

LM_BASE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, ({_CRC32.format("coalesce(doc_id::VARCHAR, '')")}) % 10 AS m, list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), '') AS w FROM documents),
t AS (SELECT r, doc_id, m, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE m <> 0 GROUP BY w),
a AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, m = 0 AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 6) AS base_score
FROM t LEFT JOIN c USING (w), a GROUP BY r, doc_id, m
"""
