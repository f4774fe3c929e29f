"""SQL (DuckDB) that checks text operators whose results follow from their definitions."""

from __future__ import annotations

#: Checksums bit by bit: a table of 256 remainders, then one step a byte.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)"""
A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), " + A_TO_Z + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def crc32(value: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes; needs the table `crc` in FROM."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({value})), '..'),
        lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1])))"""


RESAMPLING = f"""
WITH {CRC_TABLE},
found AS (SELECT doc_id, {WORDS} AS words FROM documents),
aims AS (SELECT unnest({WORDS}) AS word FROM benchmark),
each AS (SELECT doc_id, unnest(words) AS word FROM found),
known AS (SELECT DISTINCT word FROM (SELECT word FROM each UNION ALL SELECT word FROM aims)),
bucketed AS (SELECT word, {crc32('word')} % 10000 AS bucket FROM known, crc),
s AS (SELECT bucket, count(*) AS n FROM each JOIN bucketed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aims JOIN bucketed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gain AS (SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
         FROM (SELECT DISTINCT bucket FROM bucketed) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
weights AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM each JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
           FROM found LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY (n_features < 20), score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
FROM ranked
"""

SHARDS = f"""
WITH RECURSIVE {CRC_TABLE},
numbered AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents),
side AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS m FROM documents),
walk AS (
    SELECT row, row AS x, 0 AS walks FROM numbered
    UNION ALL
    SELECT row, r.l * m + r.r AS x, walks + 1 FROM (
        SELECT row, walks, m, list_reduce(list_prepend({{'k': 0::BIGINT, 'l': x // m, 'r': x % m}},
                   list_transform(range(1, 5), lambda k: {{'k': k, 'l': 0::BIGINT, 'r': 0::BIGINT}})),
               lambda a, b: {{'k': b.k, 'l': a.r, 'r': (a.l + ('0x' || substr(md5('42:' || b.k || ':' || a.r), 1, 15))::BIGINT % m) % m}}) AS r
        FROM walk, side WHERE walks = 0 OR x >= n)
),
placed AS (SELECT row, x AS place FROM walk, side WHERE walks > 0 AND x < n)
SELECT doc_id, octet_length(encode(text)) + 1 AS size, {crc32('text')} AS text_crc32, 'rows' AS law, (place % 16)::INTEGER AS shard, place // 16 AS slot,
       NULL::INTEGER AS grown_shard
FROM numbered JOIN placed USING (row), crc
"""

REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
known AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
         FROM known, (VALUES (0), (1)) AS copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
judged AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                  CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
insertion(state, reached, k, added) AS (VALUES (0, 0, 0, []), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (3, 2, 1, ['user:']),
    (2, 3, 1, ['assistant:']), (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])),
kept(state, initial, reached) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
given(state, role, reached) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
option(edit, state, initial, role, reached, price) AS (
    SELECT 'D', s, NULL::VARCHAR, NULL::VARCHAR, s, 2 FROM range(4) AS states(s) UNION ALL SELECT 'K', state, initial, NULL::VARCHAR, reached, 0 FROM kept
    UNION ALL SELECT 'R', state, NULL::VARCHAR, role, reached, 1 FROM given),
best AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM counted
    UNION ALL
    SELECT conv_id, i, state, cost, audit, said FROM (
        SELECT b.conv_id, j.i, o.reached AS state, b.cost + 5 * n.k + o.price + CASE WHEN o.edit <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
               b.audit || repeat('I', n.k) || o.edit AS audit,
               list_concat(b.said, n.added, CASE o.edit WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [o.role || ':' || j.text] END) AS said
        FROM best b JOIN insertion n ON n.state = b.state JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i + 1
        JOIN option o ON o.state = n.reached AND (o.edit <> 'K' OR o.initial = j.initial) AND (o.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate')))
    QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
),
ends AS (SELECT b.conv_id, b.cost + 5 * n.k AS cost, b.audit || repeat('I', n.k) AS audit, list_concat(b.said, n.added) AS said
         FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = c.n JOIN insertion n ON n.state = b.state WHERE n.reached IN (0, 3)
         QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + 5 * n.k, b.audit || repeat('I', n.k)) = 1)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost, coalesce(e.audit, '') AS audit,
       sha256(coalesce(array_to_string(e.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLE = {"op11_resampling": RESAMPLING, "op12_conversation_repair": REPAIR, "op13_shuffled_shards": SHARDS}
