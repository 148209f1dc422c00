"""Check SQL of the queries that SQL can express."""

#: The table of the CRC's 256 remainders comes from its rule: eight steps of the reversed polynomial.
_REMAINDERS = """steps(b, k, r) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END FROM steps WHERE k < 8
),
remainders AS (SELECT list(r ORDER BY b) AS t FROM steps WHERE k = 8),
"""

SHARDING = f"""
WITH RECURSIVE {_REMAINDERS}
raw AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
sized AS (
  SELECT doc_id, strlen(txt) + 1 AS size,
    list_reduce(
      list_transform(range(strlen(txt)), lambda i: CAST('0x' || substr(hex(encode(txt)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295) AS crc
  FROM raw, remainders
),
placed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(size) OVER () AS total
  FROM sized
),
cut AS (SELECT *, CAST((2 * start + size) * 8 // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(crc, 4294967295) AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

QUALITY_RULES = r"""
WITH raw AS (SELECT doc_id, source, coalesce(text, '') AS txt FROM documents),
listed AS (SELECT *, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') AS ws FROM raw),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed),
windows AS (
  SELECT doc_id, i, w, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w1, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM words
),
often AS (
  SELECT doc_id, i FROM windows WHERE w2 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1
),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM often CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) s GROUP BY doc_id
),
lines AS (SELECT doc_id, unnest(string_split(txt, chr(10))) AS line FROM raw),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
counted AS (
  SELECT listed.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(txt, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(txt, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM listed LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM failed GROUP BY source),
moments AS (
  SELECT sum(f) / sum(n) AS m, coalesce(var_samp(f / n), 0) - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * avg(1 / n) AS extra FROM hosts
),
prior AS (
  SELECT m, CASE WHEN extra > 0 THEN least(greatest(m * (1 - m) / extra - 1, 1), 1000000) ELSE 1000000 END AS strength FROM moments
),
rejected AS (SELECT source FROM hosts, prior WHERE (f + m * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM rejected WHERE rejected.source IS NOT DISTINCT FROM failed.source) AS kept
FROM failed
"""

DECONTAMINATION = r"""
WITH texts AS (
  SELECT 0 AS bench, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
),
listed AS (
  SELECT bench, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts
),
patterns AS (
  SELECT DISTINCT CAST(id AS VARCHAR) AS item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS pattern
  FROM listed, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS s(i)
  WHERE bench = 1 AND len(ws) > 0
),
spots AS (
  SELECT id AS doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS pattern
  FROM listed, (SELECT DISTINCT n FROM patterns) lengths, unnest(range(1, len(ws) - n + 2)) AS s(i)
  WHERE bench = 0
),
hits AS (SELECT doc_id, spots.n, i, item_id FROM spots JOIN patterns USING (n, pattern)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS s(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM hits GROUP BY doc_id)
SELECT listed.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM listed LEFT JOIN covered ON covered.doc_id = listed.id LEFT JOIN named ON named.doc_id = listed.id
WHERE bench = 0
"""

#: Every string of 100 bytes of the hexadecimal text, by its first start; removed stretches and what lies between.
SUFFIX_DEDUP = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 200) AS s FROM raw, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS t(i)),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM spans
  UNION ALL SELECT raw.doc_id, coalesce(max(b), 0), length(h) // 2 FROM raw LEFT JOIN spans USING (doc_id) GROUP BY raw.doc_id, length(h)
),
kept AS (
  SELECT pieces.doc_id, string_agg(substr(h, CAST(2 * s + 1 AS BIGINT), CAST(2 * (e - s) AS BIGINT)), '' ORDER BY s) AS k, sum(e - s) AS n, count(*) - 1 AS n_spans
  FROM pieces JOIN raw USING (doc_id) GROUP BY pieces.doc_id
)
SELECT raw.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(length(h) // 2 - n AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM raw JOIN kept USING (doc_id)
"""

#: Damage by key, faults, and backwards by turn the least (cost, edits, lines) to go from each of the four states.
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE {_REMAINDERS}
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
),
dealt AS (
  SELECT keyed.*, xor(list_reduce(
      list_transform(range(strlen(k)), lambda i: CAST('0x' || substr(hex(encode(k)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM keyed, remainders
),
rows_left AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE kind <> 0
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY turn NULLS FIRST, copy) AS seen
  FROM rows_left
),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(txt, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
    WHEN NOT regexp_matches(txt, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS initial_before
  FROM ordered
),
counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (i > 1 AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
),
togo AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS v0, {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}} AS v1,
    {{'c': 5, 'a': 'I', 't': ['assistant:']}} AS v2, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS v3
  FROM counted
  UNION ALL
  SELECT conv_id, i, list_min([b0, {{'c': 5 + v2.c, 'a': 'I' || v2.a, 't': ['user:'] || v2.t}}]), list_min([b1, {{'c': 5 + v2.c, 'a': 'I' || v2.a, 't': ['user:'] || v2.t}}]),
    v2, list_min([b3, {{'c': 5 + v2.c, 'a': 'I' || v2.a, 't': ['user:'] || v2.t}}])
  FROM (
    SELECT conv_id, i, b0, b1, b3, list_min([b2, {{'c': 5 + b3.c, 'a': 'I' || b3.a, 't': ['assistant:'] || b3.t}}]) AS v2
    FROM (
      SELECT conv_id, i,
        list_min([d0, u, CASE WHEN initial = 's' THEN {{'c': v1.c + more, 'a': 'K' || v1.a, 't': [line] || v1.t}} ELSE d0 END]) AS b0,
        list_min([d1, u]) AS b1, list_min([d2, a]) AS b2, list_min([d3, u]) AS b3
      FROM (
        SELECT togo.conv_id, faulty.i, initial, v1, fault, role || ':' || txt AS line, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000 END AS more,
          {{'c': 2 + v0.c, 'a': 'D' || v0.a, 't': v0.t}} AS d0, {{'c': 2 + v1.c, 'a': 'D' || v1.a, 't': v1.t}} AS d1,
          {{'c': 2 + v2.c, 'a': 'D' || v2.a, 't': v2.t}} AS d2, {{'c': 2 + v3.c, 'a': 'D' || v3.a, 't': v3.t}} AS d3,
          CASE WHEN initial = 'u' THEN {{'c': v2.c + more, 'a': 'K' || v2.a, 't': [line] || v2.t}}
            ELSE {{'c': v2.c + more + 1, 'a': 'R' || v2.a, 't': ['user:' || txt] || v2.t}} END AS u,
          CASE WHEN initial = 'a' THEN {{'c': v3.c + more, 'a': 'K' || v3.a, 't': [line] || v3.t}}
            ELSE {{'c': v3.c + more + 1, 'a': 'R' || v3.a, 't': ['assistant:' || txt] || v3.t}} END AS a
        FROM togo JOIN faulty ON faulty.conv_id IS NOT DISTINCT FROM togo.conv_id AND faulty.i = togo.i - 1
      )
    )
  )
),
firsts AS (SELECT conv_id, v0 FROM togo WHERE i = 1)
SELECT named.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.a, '') AS audit,
  sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) named
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM named.conv_id
LEFT JOIN firsts ON firsts.conv_id IS NOT DISTINCT FROM named.conv_id
"""

DOCUMENT_TREE = r"""
WITH texts AS (
  SELECT 0 AS bench, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
),
listed AS (
  SELECT bench, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM texts
),
sizes AS (SELECT id AS doc_id, count(*) AS n FROM listed WHERE bench = 0 GROUP BY id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
vectors AS (SELECT id AS doc_id, term, count(*) AS tf FROM listed WHERE bench = 0 GROUP BY id, term),
items AS (SELECT DISTINCT id AS item_id, term FROM listed WHERE bench = 1),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM vectors, total GROUP BY term, n_docs
),
lengths AS (SELECT doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM sizes, total),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN vectors USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
