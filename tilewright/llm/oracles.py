"""SQL for the queries that SQL can express."""

from __future__ import annotations

from .decontaminate import WINDOW
from .mixing import MOST, SHARE, TILTS, WEIGHTS
from .quality import MAX_DOCS, MAX_REPEAT_PERCENT, MIN_LEFT, MIN_WORDS

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LOWER_TEXT = LOWER.format("coalesce(text, '')")

OP2 = f"""
WITH d AS (SELECT doc_id, {WORDS.format(LOWER_TEXT)} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
same AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i, first FROM win JOIN same USING (k)),
p AS (SELECT doc_id, p, max(later) AS later FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p, CAST(first < doc_id AS INTEGER) AS later FROM hit) GROUP BY ALL),
island AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM p) GROUP BY doc_id, g),
spans AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM island GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS n, sum(later) AS later FROM p GROUP BY doc_id),
firsts AS (SELECT doc_id, min(first) AS first FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(later, 0) AS BIGINT) AS n_later_words, first AS first_doc_id, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN firsts USING (doc_id)"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER_TEXT)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2) x
  JOIN n p ON p.doc_id = x.a JOIN n q ON q.doc_id = x.b WHERE 100 * k >= 90 * (p.n + q.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""

OP4 = f"""
WITH d AS (SELECT doc_id, {PLAIN.format(LOWER_TEXT)} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {WINDOW}) AS m FROM (SELECT item_id, {PLAIN.format(LOWER_TEXT)} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT item_id, m, j, array_to_string(w[j:j + m - 1], ' ') AS k FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM b)),
ms AS (SELECT DISTINCT m FROM b),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT doc_id, dw.m, i, j, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
runs AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS item, min(i) - 1 AS begin_, count(*) + max(m) - 1 AS n FROM (SELECT doc_id, item_id, m, i, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, m, i - j ORDER BY i) AS g FROM hit) GROUP BY doc_id, item_id, m, diagonal, g),
far AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, begin_, item) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n, 0) AS BIGINT) AS longest_match, CAST(coalesce(begin_, -1) AS BIGINT) AS longest_match_at, item AS longest_match_item
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN far USING (doc_id)"""

OP5 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, source, l, {WORDS.format("l")} AS lw FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d)),
full_ AS (SELECT doc_id, source, l, {LOWER.format("array_to_string(lw, ' ')")} AS k, len(lw) AS n FROM ln WHERE len(lw) > 0),
dupl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM full_ GROUP BY doc_id),
often AS (SELECT source, k FROM (SELECT DISTINCT source, doc_id, k FROM full_) GROUP BY source, k HAVING count(*) > {MAX_DOCS}),
rem AS (SELECT doc_id, sum(f.n) AS n FROM full_ f JOIN often o ON f.k = o.k AND f.source IS NOT DISTINCT FROM o.source GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dupl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(rem.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dupl USING (doc_id) LEFT JOIN rem USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {MIN_WORDS} AND n_words - n_removed_words >= CAST({MIN_LEFT} AS DOUBLE) * n_words AS kept FROM f"""


def _taken(copy: int) -> str:
    return f"greatest(0, least(size, words - {copy} * source_size - before))"


def _position(copy: int) -> str:
    u = f"(({copy} * source_size + before + {_taken(copy)} / 2) / words)"
    return f"CASE WHEN {_taken(copy)} > 0 THEN 2 * {u} / ((1 - c) + sqrt((1 - c) * (1 - c) + 4 * c * {u})) END"


OP6 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS o FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s0),
s2 AS (SELECT *, list_extract([{", ".join(map(str, WEIGHTS))}], CAST(rank % {len(WEIGHTS)} + 1 AS INTEGER)) AS weight, CAST(list_extract([{", ".join(map(str, TILTS))}], CAST(rank % {len(TILTS)} + 1 AS INTEGER)) AS DOUBLE) AS c FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY CAST({MOST} * total AS DOUBLE) / weight, rank) AS k FROM s2),
s4 AS (SELECT *, (CAST({SHARE} AS DOUBLE) * (SELECT sum(total) FROM s3) - coalesce((SELECT sum({MOST} * p.total) FROM s3 p WHERE p.k < s3.k), 0)) / (SELECT sum(q.weight) FROM s3 q WHERE q.k >= s3.k) AS level FROM s3),
l AS (SELECT arg_min(level, k) AS level FROM s4 WHERE weight * level <= {MOST} * total),
s5 AS (SELECT source, total, c, CASE WHEN weight * l.level > {MOST} * total THEN CAST({MOST} * total AS DOUBLE) ELSE weight * l.level END AS target FROM s4, l),
x AS (SELECT doc_id, size, total AS source_size, target, c, CAST(floor(target + 0.5) AS BIGINT) AS words, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target, CAST({_taken(0)} + {_taken(1)} AS BIGINT) AS taken, {_position(0)} AS position, {_position(1)} AS position_again FROM x"""

ORACLE_SQL = {"op2_suffix_dedup": OP2, "op3_jaccard": OP3, "op4_decontamination": OP4, "op5_quality_lines": OP5, "op6_mixture": OP6}
