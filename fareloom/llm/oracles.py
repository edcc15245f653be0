"""DuckDB statements of the text queries that SQL can express."""

WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS words FROM documents),
all_sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END AS s FROM w),
sets AS (SELECT doc_id, list_distinct(s) AS s, len(list_distinct(s)) AS n FROM all_sets),
sh AS (SELECT doc_id, n, unnest(s) AS shingle FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
components AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN components USING (doc_id)""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to FROM f""",
    "op7_substring_dedup": f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS window_words FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
least AS (SELECT window_words, min(doc_id) AS first FROM win GROUP BY 1),
dup AS (SELECT win.doc_id, i FROM win JOIN least USING (window_words) WHERE first < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM dup),
each AS (SELECT doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op12_conversation_repair": """
WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key, coalesce(role, ' ') AS r, coalesce("text", ' ') AS t FROM conversations),
c AS (SELECT conv_id, turn, r, t, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, bit: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1))))) % 20 AS damage FROM k),
d AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE r END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS txt,
  unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE damage != 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, copy) AS i FROM d),
f AS (SELECT conv_id, turn, role, txt, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(txt, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(txt, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM o),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY 1),
follows(state, initial, behind) AS (VALUES ('^', 's', 's'), ('^', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
inserts(state, behind, extra, more, lines) AS (VALUES ('^', '^', 0, '', ''), ('^', 'u', 3, 'I', 'user:\n'), ('^', 'a', 6, 'II', 'user:\nassistant:\n'), ('s', 's', 0, '', ''), ('s', 'u', 3, 'I', 'user:\n'), ('s', 'a', 6, 'II', 'user:\nassistant:\n'),
  ('u', 'u', 0, '', ''), ('u', 'a', 3, 'I', 'assistant:\n'), ('a', 'a', 0, '', ''), ('a', 'u', 3, 'I', 'user:\n')),
paths AS (SELECT conv_id, '^' AS state, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS body FROM stats
  UNION ALL
  SELECT conv_id, state, i, best.cost, best.audit, best.body FROM (
    SELECT p.conv_id, e.behind AS state, p.i + 1 AS i, min({'cost': p.cost + s.extra + e.price, 'audit': p.audit || s.more || e.letter, 'body': p.body || replace(s.lines, '\n', chr(10)) || e.line}) AS best
    FROM paths p JOIN inserts s ON s.state = p.state JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1,
    LATERAL (SELECT s.behind AS behind, 4 AS price, 'D' AS letter, '' AS line
      UNION ALL SELECT w.behind, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END, 'K', f.role || ':' || f.txt || chr(10) FROM follows w WHERE w.state = s.behind AND w.initial = f.initial AND f.fault NOT IN ('blank', 'duplicate')
      UNION ALL SELECT w.behind, CASE WHEN f.fault = 'truncated' THEN 6 ELSE 3 END, 'R', CASE w.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.txt || chr(10)
        FROM follows w WHERE w.state = s.behind AND w.initial != 's' AND f.fault NOT IN ('blank', 'duplicate')) e
    GROUP BY 1, 2, 3)),
ends AS (SELECT p.conv_id, min({'cost': p.cost + s.extra, 'audit': p.audit || s.more, 'body': p.body || replace(s.lines, '\n', chr(10))}) AS best
  FROM paths p JOIN stats t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.n = p.i JOIN inserts s ON s.state = p.state
  WHERE CASE WHEN p.state = '^' THEN s.behind = '^' ELSE s.behind = 'a' END GROUP BY 1)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.body, length(best.body) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id""",
}
