"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import re
import string

from docgrid.llm.bpe import op2_byte_bpe
from docgrid.llm.decontaminate import op10_decontaminate
from docgrid.llm.fertility import op1_fertility
from docgrid.llm.html_text import op6_html_text
from docgrid.llm.interleave import op5_interleave
from docgrid.llm.kneser_ney import op9_kneser_ney
from docgrid.llm.langid import op4_langid
from docgrid.llm.ngram_join import op8_ngram_join
from docgrid.llm.secrets import op3_secrets
from docgrid.llm.token_files import op7_token_files

QUERIES = {
    "op1_fertility": op1_fertility,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secrets": op3_secrets,
    "op4_langid": op4_langid,
    "op5_interleave": op5_interleave,
    "op6_html_text": op6_html_text,
    "op7_token_files": op7_token_files,
    "op8_ngram_join": op8_ngram_join,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_decontaminate": op10_decontaminate,
}

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
#: Runs of one character are spelled out: this engine's patterns cannot refer back.
_PART = "(?i:example|placeholder|changeme|your[_-])|" + "|".join(re.escape(c) + "{8,}" for c in string.ascii_letters + string.digits + "+/_=-")
#: Spans of a pattern: what lies between its matches, and the matches, give their places.
_OP3 = (
    r"""
WITH patterns AS (SELECT * FROM (VALUES ('assign', 0, '@ASSIGN'), ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+'), ('entropy', 3, '[A-Za-z0-9+/_=-]{20,}')) x(kind, rank, p)),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT r, kind, rank, unnest(regexp_extract_all(t, p)) AS v, unnest(string_split_regex(t, p)[1:len(regexp_extract_all(t, p))]) AS gap, unnest(range(len(regexp_extract_all(t, p)))) AS i FROM texts, patterns),
spans AS (SELECT r, kind, rank, v, sum(length(gap)) OVER (PARTITION BY r, kind ORDER BY i) + coalesce(sum(length(v)) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM found),
kept AS (
  SELECT r, kind, rank, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(v) AS BIGINT) AS s, a FROM spans
  WHERE (kind = 'assign' AND length(regexp_extract(v, '@ASSIGN', 2)) >= 6) OR (kind = 'access' AND length(v) >= 20) OR (kind = 'hex' AND length(v) >= 24)
     OR (kind = 'entropy' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
         AND NOT regexp_matches(v, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AND NOT regexp_matches(v, '^.{1,33}EXAMPLE(?:KEY)?$')
         AND NOT regexp_matches(v, '^/?(?:[A-Za-z_-]{2,}/)+[A-Za-z_-]*$') AND NOT starts_with(v, 'sha256-') AND NOT starts_with(v, 'sha512-')
         AND list_max(list_transform(flatten(list_transform(string_split_regex(v, '@PART'), lambda p: list_transform(range(1, length(p) - 18), lambda i: substr(p, i, 20)))), lambda w: list_aggregate(string_split(w, ''), 'entropy')))
             >= CASE WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN 3.0 WHEN regexp_matches(v, '^[A-Z2-7]+=*$') THEN 3.3 ELSE 3.6 END)),
per AS (SELECT r, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex, count_if(kind = 'entropy') AS n_entropy,
  string_agg(s, ',' ORDER BY a, rank) FILTER (WHERE kind <> 'entropy') AS base, string_agg(s, ',' ORDER BY a, rank) AS spans FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM texts LEFT JOIN per ON texts.r = per.r"""
).replace("@ASSIGN", _ASSIGN).replace("@PART", _PART)

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, p.n, item FROM places p JOIN wins ON p.win = wins.win AND p.n = wins.n),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM hits) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.r = words.r LEFT JOIN names ON d.r = names.r"""

#: The others use trained models, tokenizers, hashes and files that SQL has not; tests hold them against brute force.
ORACLE: dict[str, str] = {"op3_secrets": _OP3, "op10_decontaminate": _OP10}
