r"""DuckDB SQL with the results of the queries, written from their definitions."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS q FROM late, range(0, 20) AS r(i)),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.q) AS text
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) x
         LEFT JOIN gone USING (doc_id, q) WHERE gone.q IS NULL GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(w[p:p + 3], ' ') for p in range(1, greatest(len(w) - 2, 2))]) AS s
      FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b
      WHERE 100 * c.n >= 80 * (len(x.s) + len(y.s) - c.n)),
pairs AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other),
m AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p + i) AS n_hit FROM hit, range(0, 10) AS r(i) WHERE i < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS k
        FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
first AS (SELECT k, min(doc_id) AS doc_id FROM win GROUP BY k),
late AS (SELECT win.doc_id, p FROM win JOIN first USING (k) WHERE first.doc_id < win.doc_id),
ends AS (SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM late),
heads AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM ends),
spans AS (SELECT doc_id, g, min(p) AS a, max(p) + 50 AS b FROM heads GROUP BY doc_id, g),
cuts AS (SELECT d.doc_id, s.g, s.a, s.b, coalesce(lag(s.b) OVER (PARTITION BY d.doc_id ORDER BY s.a), 0) AS open, d.h
         FROM d JOIN spans s USING (doc_id)),
left_over AS (SELECT doc_id, string_agg(substring(h, 2 * open + 1, 2 * (a - open)), '' ORDER BY a) AS body, max(b) AS last,
                     sum(b - a) AS n_removed, count(*) AS n_spans FROM cuts GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN l.doc_id IS NULL THEN d.h ELSE l.body || substring(d.h, 2 * l.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN left_over l USING (doc_id)
"""

_HOST = r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
_PATH = r"regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1)"

URLS = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, string_split({_HOST}, '.') AS l, string_split({_PATH}, '/') AS s, {_PATH} AS path,
                  1704067200 + (page_id * 7919 % 525600) * 60 AS fetched_at FROM pages),
k AS (SELECT page_id, fetched_at, unnest(list_distinct(list_concat(
        ['d:' || array_to_string(l[i:], '.') for i in range(1, greatest(len(l) - 1, 1) + 1)],
        ['p:' || host || array_to_string(s[1:i], '/') || '/' for i in range(1, greatest(len(s) - 1, 1) + 1)],
        ['u:' || host || CASE WHEN path = '' THEN '/' ELSE path END]))) AS entry
      FROM p),
e AS (SELECT entry, ('0x' || substring(md5(entry), 1, 8))::BIGINT AS number FROM (SELECT DISTINCT entry FROM k)),
c AS (SELECT entry, number, unnest(range(0, number % 4 + 1)) AS step FROM e),
t AS (SELECT entry, 1704067200 + (number % 100) * 86400 + step * 60 * 86400 AS since, (number // 16 + step) % 2 = 0 AS listed FROM c),
v AS (SELECT entry, since, listed, lead(since) OVER (PARTITION BY entry ORDER BY since) AS until FROM t),
a AS (SELECT k.page_id, v.entry, v.since FROM k JOIN v ON v.entry = k.entry AND v.listed AND k.fetched_at >= v.since AND (v.until IS NULL OR k.fetched_at < v.until)),
r AS (SELECT page_id, entry, since, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC, entry DESC) AS i FROM a)
SELECT p.page_id, p.host, p.fetched_at::BIGINT AS fetched_at, coalesce(r.n, 0)::BIGINT AS n_active, r.entry AS decided_by, r.since::BIGINT AS listed_at,
       coalesce(r.n, 0) > 0 AS blocked
FROM p LEFT JOIN r ON r.page_id = p.page_id AND r.i = 1
"""

RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p + i) AS n FROM twice, range(0, 5) AS r(i) GROUP BY doc_id),
lines AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
filled AS (SELECT doc_id, line, w, len([x for x in w if x IN ('|', '»', '›', '·', '>', '/', '•')]) AS separators FROM lines WHERE len(w) > 0),
judged AS (SELECT doc_id, line, len(w) AS n, CASE
    WHEN separators >= 2 AND 3 * separators >= len(w) THEN true
    WHEN len(w) <= 3 AND NOT regexp_matches(line, '[.!?…:;,"''”’)\]»][\x20\x09-\x0D]*$') THEN true
    WHEN len(w) <= 20 AND regexp_matches(line, '(?i)cookie|javascript|all rights reserved|terms of (?:use|service)|privacy policy|sign in|log in|subscribe|click here|read more|share this|lorem ipsum|home page') THEN true
    WHEN len(w) <= 10 AND NOT regexp_matches(line, '[.!?…:;,"''”’)\]»][\x20\x09-\x0D]*$') THEN true
    WHEN 2 * len(regexp_extract_all(line, '[!?]{{2,}}|[#*$%&|<>]{{3,}}')) > len(w) THEN true ELSE false END AS bad FROM filled),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, sum(CASE WHEN bad THEN 0 ELSE n END) AS left_over FROM judged GROUP BY doc_id),
f AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(list_sum([length(x) for x in d.w]), 0) AS word_chars,
             len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.dups, 0) AS dups, coalesce(rep.n, 0) AS n_rep,
             coalesce(l.left_over, 0) AS left_over
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines,
       n_rep::BIGINT AS n_repeat_words, (n_words < 10 OR 100 * n_rep > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_rep > 20 * n_words) AND 100 * left_over >= 50 * n_words AS kept
FROM f
"""

# these pages hold one article element each, of headings and paragraphs
PAGES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(body, '[\s\x{00A0}]+', ' ', 'g'), '</?(?:p|h1)>', chr(10), 'g'), '</?(?:b|br)>', '', 'g') AS body FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(body, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS body FROM b),
t AS (SELECT page_id, url, array_to_string([trim(x) for x in string_split(body, chr(10)) if trim(x) <> ''], chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

# crc32 of a byte string: a table of steps, then one step per byte
_CRC = """
step(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8)"""


def _crc(key: str) -> str:
    """SQL for the unsigned crc32 of a text, where ``steps`` is joined."""

    hexed = f"hex(encode({key}))"
    bytes_ = f"[('0x' || substring({hexed}, 2 * i + 1, 2))::BIGINT for i in range(0, length({hexed}) // 2)]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(steps.t[xor(c, b) % 256 + 1], c // 256)), 4294967295)"


RESAMPLE = f"""
WITH RECURSIVE {_CRC},
w AS (SELECT 0 AS side, doc_id AS id, unnest({_ALNUM}) AS word FROM documents
      UNION ALL SELECT 1, item_id, unnest({_ALNUM}) FROM benchmark),
v AS (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), steps),
n AS (SELECT bucket, sum((side = 0)::INT) AS s, sum((side = 1)::INT) AS t FROM w JOIN v USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM n, sums),
f AS (SELECT id AS doc_id, count(*) AS n_features, sum(gain) AS gain FROM w JOIN v USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
h AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(floor(gain::DOUBLE / n_features), 0)::BIGINT AS weight,
             ('0x' || substring(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN f USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
             count(*) OVER (PARTITION BY n_features >= 20) AS total FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * total // 100 THEN place END AS rank FROM r
"""

SPELLINGS = rf"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, run, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc("doc_id::VARCHAR || ':' || run")} AS h FROM runs, steps),
written AS (SELECT n, CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.rest = v.word
          UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.rest = v.word),
ranked AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM pairs),
f AS (SELECT v.word, v.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.n >= 2 * v.n THEN r.other END AS form, CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n
      FROM v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
chain AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL
          UNION SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(ends.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN ends USING (word)
"""
