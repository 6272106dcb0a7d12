"""SQL twins of the queries: the same results by the shortest way, without regard to scale."""

from __future__ import annotations

#: Every 100-byte string of every text; those that start earlier too are removed.
SUFFIX_DEDUP = """
WITH texts AS (
    SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), pieces AS (
    SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 99, 0), 200)) AS base, h FROM texts
), windows AS (
    SELECT doc_id, base + o AS i, md5_number(substr(piece, 2 * o + 1, 200)) AS name
    FROM (
        SELECT doc_id, base, substr(h, 2 * base + 1, 598) AS piece,
            unnest(range(0, least(200, length(h) // 2 - 99 - base))) AS o
        FROM pieces
    )
), again AS (
    SELECT doc_id, i FROM windows
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, i) > 1
), marked AS (
    SELECT doc_id, i,
        CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh
    FROM again
), counted AS (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), runs AS (
    SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM counted GROUP BY doc_id, run
), held AS (
    SELECT doc_id, x.b AS a, lead(x.a) OVER (PARTITION BY doc_id ORDER BY x.a) AS b FROM runs AS x
    UNION ALL
    SELECT t.doc_id, 0, (SELECT min(r.a) FROM runs AS r WHERE r.doc_id = t.doc_id) FROM texts AS t
), kept AS (
    SELECT doc_id, string_agg(
        substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, length(h) // 2) - a) AS BIGINT)), '' ORDER BY a
    ) AS k
    FROM held JOIN texts USING (doc_id) GROUP BY doc_id
), removed AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
    coalesce(r.n_spans, 0) AS n_spans, sha256(unhex(k.k)) AS kept_sha256
FROM texts AS t JOIN kept AS k USING (doc_id) LEFT JOIN removed AS r USING (doc_id)
"""

#: All pairs that share a shingle, and whom each document reaches by links.
NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
    SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
    WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reached AS r JOIN links AS l ON l.a = r.other
)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reached AS r LEFT JOIN sizes AS x ON x.doc_id = r.doc_id GROUP BY r.doc_id
"""

#: The turns in order; a turn opens a block where its role is another than the one before.
CHAT = """
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), placed AS (
    SELECT *, row_number() OVER w AS place, lag(role) OVER w IS DISTINCT FROM role AS opens
    FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), told AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
        coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learnt,
        sum(length(replace(text, '<|', '<||'))
            + CASE WHEN opens THEN length('<|turn|>' || replace(role, '<|', '<||') || '<|text|>' || '<|end|>')
              ELSE length('<|next|>') END) AS chars
    FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars,
    sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM told
"""


def quality(boilerplate: tuple[str, ...], sentence_end: str, menu_marks: str) -> str:
    """Measures from words, lines and 8-word windows as rows, and the verdict of the line rules at their defaults."""
    notice = " OR ".join(f"contains(lower(line), '{phrase}')" for phrase in boilerplate)
    space = r"[\x20\x09-\x0D]+"
    return rf"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '{space}'), lambda w: w <> '') AS w
    FROM documents
), places AS (
    SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM texts
), twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM places)
    QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), repeated AS (
    SELECT doc_id, count(DISTINCT i + o) AS n
    FROM (SELECT doc_id, i, unnest(range(0, 8)) AS o FROM twice) GROUP BY doc_id
), lines AS (
    SELECT doc_id, line, len(list_filter(string_split_regex(line, '{space}'), lambda w: w <> '')) AS n
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), measured AS (
    SELECT doc_id, line, n, {notice} AS notice,
        len(regexp_extract_all(line, '{sentence_end.replace("'", "''")}(?:[\x20\x09-\x0D]|$)')) AS ends,
        length(line) - length(translate(line, '{menu_marks}', '')) AS marks,
        length(line) - length(translate(line, '#*$%&|<>', '')) AS symbols
    FROM lines
), judged AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
        coalesce(sum(n) FILTER (
            ends * 80 < n OR (n >= 8 AND ends * 2 > n) OR (marks >= 3 AND marks * 3 >= n)
            OR symbols * 100 >= n * 60 OR (n <= 40 AND notice)
        ), 0) AS lost
    FROM measured GROUP BY doc_id
), base AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
    FROM texts LEFT JOIN judged USING (doc_id) LEFT JOIN repeated AS r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost <= 60 * n_words AS kept
FROM base
"""
