"""DuckDB SQL for the queries that SQL can express: all but the fitted classifier, the tokenizer and the pipeline."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s
), f AS (
  SELECT *, most / weight AS upto FROM w
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY upto, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY upto, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f
), t AS (
  SELECT source, source_size,
    CASE WHEN level > upto THEN most
         ELSE (SELECT arg_min(level, struct_pack(a := upto, b := i)) FROM l WHERE NOT level > upto) * weight END AS target
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS before,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS expected,
    CAST('0x' || substr(md5('mix/' || coalesce('=' || d.source, 'null')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, expected - floor(expected) AS part FROM r
), e AS (
  SELECT *, (floor(expected) + floor((before + 1)::DOUBLE * part + shift) - floor(before::DOUBLE * part + shift))::BIGINT AS copies FROM c
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM e
"""

OP1 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), t AS (
  SELECT *, 20 + length(role) + length(text) + len(regexp_extract_all(role || text, '\\')) + len(regexp_extract_all(role, '</?turn>|<text>')) + len(regexp_extract_all(text, '</?turn>|<text>')) AS chars FROM c
), g AS (
  SELECT conv_id, count(*) AS n, sum(chars) AS chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text) AS loss
  FROM t GROUP BY conv_id
)
SELECT conv_id, n::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g
"""

OP4_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP4 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, {AZ}), '{OP4_WORD}'), []) AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, coalesce(regexp_extract_all(translate(text, {AZ}), '{OP4_WORD}'), []) AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS words
  FROM b, unnest(range(greatest(len(w) - 12, 1))) AS u(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i + 1 : i + k], ' ') AS words
  FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(greatest(len(w) - k + 1, 0))) AS u(i)
), h AS (
  SELECT doc_id, i, bw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.words = bw.words
), p AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM h), unnest(range(k)) AS u(j) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP5 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p
"""

OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i + 1] || ' ' || w[i + 2] END AS shingle
  FROM d, unnest(range(greatest(len(w) - 1, 1))) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (
  SELECT list(shingle ORDER BY shingle) AS shingles, doc_id FROM s GROUP BY doc_id
), g AS (
  SELECT min(doc_id) AS rep, shingles, len(shingles) AS n FROM c GROUP BY shingles
), m AS (
  SELECT c.doc_id, g.rep FROM c JOIN g ON c.shingles = g.shingles
), k AS (
  SELECT rep, n, unnest(shingles) AS shingle FROM g
), o AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM k a JOIN k b ON a.shingle = b.shingle AND a.rep < b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4
), l AS (
  SELECT a, b FROM o WHERE 100 * common >= 80 * (na + nb - common)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT rep AS node, rep AS reached FROM g UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a
), f AS (
  SELECT r.node, min(x.doc_id) AS component FROM r JOIN m x ON x.rep = r.reached GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(f.component, d.doc_id) AS component_id, d.doc_id = coalesce(f.component, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN f ON f.node = m.rep
"""

OP10 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS times
  FROM (SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], ' ') AS words FROM d, unnest(range(greatest(len(w) - 7, 0))) AS u(i))
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM win, unnest(range(8)) AS u(j) WHERE times > 1 GROUP BY 1
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY 1
), b AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), v AS (
  SELECT doc_id, lang, source, unnest([
    {{'m': 0, 'part': 64, 'v': word_chars * 1000000 // n_words}},
    {{'m': 1, 'part': 4, 'v': (n_symbols + 1) * 1000000 // (n_words + 100)}},
    {{'m': 2, 'part': 4, 'v': (n_dup_lines + 1) * 1000000 // (n_words + 100)}},
    {{'m': 3, 'part': 4, 'v': (n_repeat_words + 8) * 1000000 // (n_words + 100)}}], recursive := true) FROM b WHERE n_words > 0
), k AS (
  SELECT *, v - v % (1::BIGINT << greatest(length(ltrim(bin(v), '0')) - 7, 0)::INT) AS cell FROM v
), tab AS (
  SELECT m, ln(quantile_disc(cell, 0.25)) AS q1, ln(quantile_disc(cell, 0.5)) AS q2, ln(quantile_disc(cell, 0.75)) AS q3 FROM k GROUP BY 1
), lang_own AS (
  SELECT lang, m, count(*) AS n, ln(quantile_disc(cell, 0.25)) AS q1, ln(quantile_disc(cell, 0.5)) AS q2, ln(quantile_disc(cell, 0.75)) AS q3 FROM k GROUP BY 1, 2
), l AS (
  SELECT lang, o.m, (n * o.q1 + 100 * t.q1) / (n + 100) AS q1, (n * o.q2 + 100 * t.q2) / (n + 100) AS q2, (n * o.q3 + 100 * t.q3) / (n + 100) AS q3 FROM lang_own o JOIN tab t ON o.m = t.m
), own AS (
  SELECT lang, source, m, max(part) AS part, count(*) AS n, ln(quantile_disc(cell, 0.25)) AS q1, ln(quantile_disc(cell, 0.5)) AS q2, ln(quantile_disc(cell, 0.75)) AS q3 FROM k GROUP BY 1, 2, 3
), q AS (
  SELECT o.lang, source, o.m, part, exp((n * o.q1 + 100 * l.q1) / (n + 100)) AS q1, exp((n * o.q2 + 100 * l.q2) / (n + 100)) AS q2, exp((n * o.q3 + 100 * l.q3) / (n + 100)) AS q3
  FROM own o JOIN l ON o.m = l.m AND o.lang IS NOT DISTINCT FROM l.lang
), good AS (
  SELECT doc_id, bool_and(v <= q2 + 12 * greatest(q2 - q1, q2 / q.part) AND (k.m > 0 OR v >= q2 - 12 * greatest(q3 - q2, q2 / q.part))) AS good
  FROM k JOIN q ON k.m = q.m AND k.lang IS NOT DISTINCT FROM q.lang AND k.source IS NOT DISTINCT FROM q.source GROUP BY 1
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(good, false) AS kept
FROM b LEFT JOIN good USING (doc_id)
"""

OP6 = r"""
WITH steps AS (
  SELECT doc_id, text, lang, [4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS bits FROM documents
), d AS (
  SELECT doc_id, text, lang, xor(list_reduce(bits, lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END), 4294967295::BIGINT) % 5 = 0 AS held_out FROM steps
), w AS (
  SELECT doc_id, '_' || lower(unnest(regexp_extract_all(text, '\p{L}+'))) || '_' AS word FROM d WHERE text IS NOT NULL
), g AS (
  SELECT doc_id, substr(word, i::INT, k::INT) AS gram, count(*) AS n
  FROM w, (VALUES (1), (2), (3)) AS ks(k), unnest(range(1, length(word) - k + 2)) AS u(i) WHERE substr(word, i::INT, k::INT) <> '_' GROUP BY 1, 2
), own AS (
  SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) - 1 AS place FROM g QUALIFY place < 400
), learned AS (
  SELECT lang, gram, sum(n) AS n FROM g JOIN d USING (doc_id) WHERE lang IS NOT NULL AND NOT held_out GROUP BY 1, 2
), known AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(gram), gram) - 1 AS place FROM learned QUALIFY place < 400
), size AS (
  SELECT doc_id, count(*) AS n FROM own GROUP BY 1
), saved AS (
  SELECT doc_id, lang, sum(400 - abs(o.place - k.place)) AS saved FROM own o JOIN known k USING (gram) GROUP BY 1, 2
), cost AS (
  SELECT doc_id, l.lang, 400 * n - coalesce(saved, 0) AS cost, 400 * n AS worst FROM size CROSS JOIN (SELECT DISTINCT lang FROM known) l LEFT JOIN saved USING (doc_id, lang)
), best AS (
  SELECT doc_id, lang, 1 - cost::DOUBLE / worst::DOUBLE AS score FROM cost QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cost, lang) = 1
)
SELECT d.doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN best USING (doc_id)
"""

OP9 = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT doc_id, i, hash(b[i + 1 : i + 400]) AS h FROM d, unnest(range(greatest(octet_length(b) - 399, 0))) AS u(i)
), again AS (
  SELECT h FROM w GROUP BY 1 HAVING count(*) > 1
), hit AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS first FROM w SEMI JOIN again USING (h)
), run AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT doc_id, i, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit) GROUP BY doc_id, r
), edge AS (
  SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a) AS n_removed, count(*) AS n_spans FROM run GROUP BY 1
), e AS (
  SELECT d.doc_id, b, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, [0] || coalesce(z, []) AS starts, coalesce(a, []) || [octet_length(b)] AS stops FROM d LEFT JOIN edge USING (doc_id)
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, n_removed, n_spans, n_removed > 0 AS has_repeats,
  sha256(unhex(array_to_string(list_transform(range(1, len(starts) + 1), lambda k: hex(b[starts[k] + 1 : stops[k]])), ''))) AS kept_sha256 FROM e
"""

ORACLE_SQL: dict[str, str] = {"op1_format_chats": OP1, "op3_mix_sources": OP3, "op4_decontaminate": OP4, "op5_warc_archive": OP5, "op6_language_id": OP6, "op7_near_duplicates": OP7, "op9_remove_repeats": OP9, "op10_quality_rules": OP10}
