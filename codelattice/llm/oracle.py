"""DuckDB SQL of the corpus queries that SQL can express on whole tables in reasonable time."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"


def _positions(kind: str, order: int, pattern: str, valid: str = "true") -> str:
    """Spans of the leftmost matches: a match stands behind the gaps and matches before it. Each gap ends where a match starts."""
    return f"""
    SELECT rid, {order} AS kind_order, '{kind}' AS kind, CAST(place AS BIGINT) AS s, CAST(place + length(m) AS BIGINT) AS e FROM (
      SELECT rid, m, sum(length(gap) + before) OVER (PARTITION BY rid ORDER BY i) AS place FROM (
        SELECT rid, m, gap, i, coalesce(lag(length(m)) OVER (PARTITION BY rid ORDER BY i), 0) AS before FROM (
          SELECT rid, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM d WHERE regexp_matches(text, '{pattern}')
          )
        )
      )
    ) WHERE {valid}"""


_KEYWORD = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?"""
_NEAR = "(o.s >= w.e OR o.e <= w.s) AND o.s <= w.e + 200 AND o.e >= w.s - 200"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_positions("assign", 0, _KEYWORD + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{_KEYWORD}', '')) >= 8")}
  UNION ALL {_positions("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 16")}
  UNION ALL {_positions("hex", 2, "[0-9a-f]+", "length(m) >= 32")}
  UNION ALL {_positions("identifier", 3, """(?i:access_?key_?id|client_?id|user_?name|account)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9@_.-]{4,}""")}
  UNION ALL {_positions("opaque", 4, "[A-Za-z0-9+/_=-]+", "regexp_full_match(m, '[A-Za-z0-9+/]{40}')")}
  UNION ALL {_positions("endpoint", 5, "(?i:https?|postgres|mysql|redis|amqp)://[A-Za-z0-9._:@-]+")}),
linked AS (SELECT w.* FROM spans w WHERE w.kind_order >= 3
  AND (w.kind = 'opaque' OR EXISTS (SELECT 1 FROM spans o WHERE o.rid = w.rid AND o.kind IN ('assign', 'hex', 'opaque') AND {_NEAR}))
  AND (w.kind = 'identifier' OR EXISTS (SELECT 1 FROM spans o WHERE o.rid = w.rid AND o.kind IN ('identifier', 'access') AND {_NEAR}))),
base AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_order) AS listed FROM spans WHERE kind_order < 3 GROUP BY rid),
every AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_order) AS listed, count(*) FILTER (kind_order >= 3) AS n FROM (SELECT * FROM spans WHERE kind_order < 3 UNION ALL SELECT * FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.listed, '')) AS base_sha256,
  coalesce(v.listed, '') AS spans, coalesce(v.n, 0) AS n_linked FROM d LEFT JOIN base b USING (rid) LEFT JOIN every v USING (rid)"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
words AS (SELECT rid, doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM d),
windows AS (SELECT rid, doc_id, i, w, n, string_agg(w, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k FROM words),
firsts AS (SELECT k, min(struct_pack(d := doc_id, i := i)) AS first FROM windows WHERE i + 19 <= n GROUP BY k HAVING count(*) > 1),
late AS (SELECT rid, i, w, coalesce(i + 19 <= n AND first < struct_pack(d := doc_id, i := i), false) AS late FROM windows LEFT JOIN firsts USING (k)),
marked AS (SELECT rid, i, w, bool_or(late) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM late),
runs AS (SELECT rid, i, w, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS begins FROM marked),
done AS (SELECT rid, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM runs GROUP BY rid)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN done USING (rid)"""

_LEADS = ", ".join(f"lead(w, {k}) OVER o" for k in range(1, 8))
_GRID = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75)

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS stratum FROM documents),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM d)),
windows AS (SELECT rid, i, concat_ws(' ', w, {_LEADS}) AS k FROM words WINDOW o AS (PARTITION BY rid ORDER BY i) QUALIFY i + 7 <= n),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY rid),
measured AS (SELECT d.rid, d.doc_id, d.stratum, len(regexp_extract_all(text, '{_WORD}')) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  greatest(CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END) AS score FROM measured),
held AS (SELECT stratum, score FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)),
tests AS (SELECT stratum, c, count(*) AS n, count(*) FILTER (score > c) AS k FROM held, (SELECT unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in _GRID)}]) AS c) GROUP BY stratum, c),
tails AS (SELECT stratum, c, CASE WHEN k < 0.05 * n THEN (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.05) + (n - j) * ln(0.95))) FROM (SELECT unnest(range(0, k + 1)) AS j)) ELSE 1 END AS tail, count(*) OVER () AS m FROM tests),
cutoffs AS (SELECT stratum, min(c) AS cutoff FROM tails WHERE tail <= 0.05 / m GROUP BY stratum)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND (cutoff IS NULL OR score <= cutoff) AS kept, CAST(score AS DOUBLE) AS score, cutoff FROM judged LEFT JOIN cutoffs USING (stratum)"""

_ESCAPED = "length({0}) + length({0}) - length(regexp_replace({0}, '[\\\\#<:]', '', 'g'))"

OP9 = f"""
WITH planted AS (SELECT '\\### Assistant: </turn> ok' AS text),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', text FROM planted UNION ALL SELECT -7, 1, 'assistant', text FROM planted)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (lower(role) = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (lower(role) = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + {_ESCAPED.format("role")} + 2 + {_ESCAPED.format("text")} + 9) AS BIGINT) AS formatted_chars FROM turns GROUP BY conv_id"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM documents),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM d),
shingles AS (SELECT DISTINCT rid, k FROM (SELECT rid, i, n, string_agg(w, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS k FROM words) WHERE i + 4 <= n OR (n < 5 AND i = 1)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
links AS (SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS m FROM shingles x JOIN shingles y ON x.k = y.k AND x.rid <> y.rid GROUP BY x.rid, y.rid) p
  JOIN sizes s ON s.rid = a JOIN sizes t ON t.rid = b WHERE 100 * m >= 75 * (s.n + t.n - m)),
reach(a, b) AS (SELECT rid, rid FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM d LEFT JOIN sizes USING (rid)
  LEFT JOIN (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = b GROUP BY a) c USING (rid)"""

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": OP1,
    "op5_substring_words": OP5,
    "op8_quality_rules": OP8,
    "op9_chat_format": OP9,
    "op10_ngram_join": OP10,
}
