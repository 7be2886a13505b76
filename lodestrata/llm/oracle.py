"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from lodestrata.llm.line_quality import NOTICE, SEPARATORS, SYMBOLS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS8 = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORD9 = r"[^\x20\x09-\x0D]+"

OP8 = f"""WITH iw AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(x, ' ') AS win, len(x) AS n FROM (
  SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: w[i:i + 12])) AS x FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
dg AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, p, n, item_id FROM dg JOIN win USING (win, n)),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, n)) AS k FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP9 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
dw AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD9}') AS w FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram, unnest(range(1, len(w) - 1)) AS i FROM dw WHERE len(w) > 2),
twice AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM g SEMI JOIN twice USING (doc_id, gram)) GROUP BY 1),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD9}')),
f AS (SELECT doc_id, line, (length(line) - length(translate(line, '{SEPARATORS}', '')) >= 3 OR length(line) > length(translate(line, '{SEPARATORS}', '')) AND 3 * (length(line) - length(translate(line, '{SEPARATORS}', ''))) >= len(regexp_extract_all(line, '{_WORD9}'))) OR regexp_matches(lower(line), '{NOTICE}')
  OR NOT regexp_matches(line, '[.!?\x{{2026}}\x{{3002}}\x{{061F}}]') OR 10 * (length(line) - length(translate(line, '{SYMBOLS}', ''))) > length(line) AS fails FROM l),
c AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (WHERE fails), 0)::BIGINT AS lost FROM f GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
  coalesce(c.dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(c.lost, 0) AS n_lost FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * n_lost <= 50 * word_chars AS kept FROM b"""

ORACLE = {"op8_decontamination": OP8, "op9_line_quality": OP9}
