"""SQL that gives the rows of those operators' queries that SQL can express."""

from __future__ import annotations

from .lm_score import LEAST, STRENGTH
from .quality import MARKS, MAX_REPEATED, MIN_WORDS, RULES, STOP_WORDS, WINDOW

_stops = sorted({v for w in " ".join(STOP_WORDS.values()).split() for v in (w, w.capitalize())})


def _rules() -> str:
    out = []
    for r in RULES:
        bad = []
        if r.least is not None:
            bad.append(f"100 * {r.measure} < {r.least} * {r.per}")
        if r.most is not None:
            bad.append(f"100 * {r.measure} > {r.most} * {r.per}")
        out.append(f"NOT (({' OR '.join(bad)}) AND n_words >= {r.words})")
    return " AND ".join(out)


assert MARKS == "[^A-Z#*$%&|<>]+"  # the SQL counts the same marks
QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
spot AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM spot),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: list_contains([{", ".join(f"'{s}'" for s in _stops)}], x))) AS n_stop_words,
    len(list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x)) AS n_runs
  FROM d LEFT JOIN rep USING (doc_id)),
x AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {_rules()} AS kept
FROM x
"""
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_REACH = """reach(a, b) AS (SELECT {id}, {id} FROM {nodes} UNION SELECT a, y FROM reach JOIN both_ways ON b = x),
least_of AS (SELECT a AS {id}, min(b) AS component_id FROM reach GROUP BY a)"""
REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13)),
src AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN src USING (k), range(13) r(j) WHERE m < doc_id),
wd AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM wd ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 2))) AS i, w FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
{_REACH.format(id="doc_id", nodes="d")}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least_of LEFT JOIN size USING (doc_id)
"""
VECTORS = f"""
WITH RECURSIVE raw AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT *, sqrt(list_dot_product(v, v)) AS s FROM raw WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
both_ways AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.93),
{_REACH.format(id="vec_id", nodes="raw")}
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least_of LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM both_ways GROUP BY x) USING (vec_id)
"""
#: CRC-32 of a text, from a table that the rule of its polynomial gives.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
# the end of a text, which opens it too, is a space, which no word is
LM = f"""
WITH tab AS ({_CRC_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} % 7 = 2 AS held, list_concat([' '], {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, [' ']) AS w FROM documents, tab),
tk AS (SELECT r, held, w[p] AS x, w[p - 1] AS b, CASE WHEN p > 2 THEN w[p - 2] END AS a FROM (SELECT *, unnest(range(2, len(w) + 1)) AS p FROM d)),
tr AS (SELECT * FROM tk WHERE NOT held),
n1 AS (SELECT x, count(*) AS c FROM tr GROUP BY x), n2 AS (SELECT b, x, count(*) AS c FROM tr GROUP BY b, x), n3 AS (SELECT a, b, x, count(*) AS c FROM tr WHERE a IS NOT NULL GROUP BY a, b, x),
s AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM n1),
p1 AS (SELECT tk.*, coalesce(n1.c, 0) AS c1, (coalesce(n1.c, 0) + 1) / (n + v + 1) AS p1, n FROM tk LEFT JOIN n1 USING (x), s),
p2 AS (SELECT p1.*, (coalesce(n2.c, 0) + {STRENGTH} * p1) / (coalesce(h.c, 0) + {STRENGTH}) AS p2 FROM p1 LEFT JOIN n2 ON n2.b = p1.b AND n2.x = p1.x LEFT JOIN n1 h ON h.x = p1.b),
p3 AS (SELECT p2.*, CASE WHEN g.c >= {LEAST} THEN (coalesce(n3.c, 0) + {STRENGTH} * p2) / (g.c + {STRENGTH}) ELSE p2 END AS p3 FROM p2 LEFT JOIN n3 ON n3.a = p2.a AND n3.b = p2.b AND n3.x = p2.x LEFT JOIN n2 g ON g.b = p2.a AND g.x = p2.b)
SELECT any_value(doc_id) AS doc_id, coalesce(any_value(d.held), false) AS held_out, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
  round(sum(log10(p1)), 8) AS base_score, round(sum(log10(p3)), 8) AS score FROM p3 JOIN d USING (r) GROUP BY r
"""
ORACLE_SQL = {"op5_lm_scores": LM, "op2_embedding_dedup": VECTORS, "op3_quality_rules": QUALITY, "op8_ngram_jaccard": JACCARD, "op10_substring_dedup": REPEATS}
