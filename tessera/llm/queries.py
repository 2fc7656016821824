"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .chat_format import op5_chat_formatting
from .jaccard_join import op8_ngram_jaccard_join
from .language_id import op10_language_id
from .line_dedup import op2_line_dedup
from .near_vectors import op1_embedding_near_dedup
from .packing import op9_best_fit_packing
from .piece_coding import op4_sentencepiece
from .quality import BOILERPLATE, MAX_BOILERPLATE_WORDS, MAX_LOST, op6_quality_rules
from .secret_scan import op3_secret_scans
from .token_count import op7_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_line_dedup,
        op3_secret_scans,
        op4_sentencepiece,
        op5_chat_formatting,
        op6_quality_rules,
        op7_token_counts,
        op8_ngram_jaccard_join,
        op9_best_fit_packing,
        op10_language_id,
    )
} | {"pipeline": corpus_pipeline.run}

_FAILS = r"""
  CASE WHEN regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') = '' THEN NULL
  WHEN bars >= 2 AND bars * 4 >= n THEN 1
  WHEN length(regexp_replace(line, '[^#*$%%&|<>]+', '', 'g')) * 10 > length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) THEN 1
  WHEN length(regexp_replace(line, '[^\p{L}]+', '', 'g')) >= 20 AND length(regexp_replace(line, '[^\p{Lu}]+', '', 'g')) * 10 > length(regexp_replace(line, '[^\p{L}]+', '', 'g')) * 6 THEN 1
  WHEN NOT regexp_matches(line, '[.!?…。:;]') AND n >= 10 THEN 1
  WHEN regexp_matches(line, '%s') AND n <= %d THEN 1 END
""" % (BOILERPLATE, MAX_BOILERPLATE_WORDS)

#: Words, windows and lines as tables; the operator does the same within each row.
ORACLE: dict[str, str] = {
    "op6_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i:i+4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(line, '[^|»›]+', '', 'g')) AS bars FROM l),
f AS (SELECT doc_id, line, n, ({_FAILS}) IS NOT NULL AS bad FROM m),
s AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) FILTER (bad) AS n_failed_lines,
  coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (bad), 0) AS lost FROM f GROUP BY 1),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  n_failed_lines::BIGINT AS n_failed_lines, lost FROM w JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= {MAX_LOST} * word_chars AS kept, n_failed_lines FROM b
""",
}
