"""DuckDB SQL for the queries that SQL can express, from the contracts, not from the operators' method."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
level AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, sum(source_size) OVER ()::DOUBLE * 1.5 AS total FROM sources),
filled AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM level),
water AS (
  SELECT arg_min((total - before) / rest, most / w) AS height FROM filled WHERE (total - before) / rest * w <= most),
targets AS (
  SELECT source, source_size, CASE WHEN height IS NULL OR height * w > most THEN most ELSE height * w END AS target FROM level LEFT JOIN water ON true),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM sized)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target) - p)) + greatest(0, least(size, floor(target) - source_size - p)))::BIGINT AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
"""

OP4 = rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
one AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
parts AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id, sets.doc_id = component_id AS kept FROM sets JOIN parts USING (doc_id)
"""

OP5 = rf"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, greatest(1, len(w) - 12) + 1)]) AS g
  FROM items WHERE len(w) > 0),
found AS MATERIALIZED (
  SELECT doc_id, item_id, p, windows.size FROM (
    SELECT doc_id, size, unnest([{{'p': i, 'g': array_to_string(w[i:i + size - 1], ' ')}} FOR i IN range(1, len(w) - size + 2)], recursive := true)
    FROM words, (SELECT DISTINCT size FROM windows) sizes) t JOIN windows ON t.g = windows.g AND t.size = windows.size),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM found) t GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) t GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP8 = """
WITH RECURSIVE sound AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
parts AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM parts
"""

OP9 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
written AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS esc,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS head FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(head) + 1 + length(esc) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
       coalesce(regexp_matches(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' ORDER BY turn NULLS FIRST, role, text), '^s?(ua)+$'), false) AS valid
FROM written GROUP BY conv_id
"""

# CRC-32 of a text's bytes, bit by bit.
def crc32_sql(key: str) -> str:
    bits = f"flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[] FOR c IN string_split({key}, '')])"
    step = "lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295::BIGINT)"


OP12 = rf"""
WITH base AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
placed AS (
  SELECT doc_id, w, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM base),
words AS MATERIALIZED (
  SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) + 1] END
    FOR i IN range(0, len(w))] END AS w FROM placed),
grams AS MATERIALIZED (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + 8], ' ') AS g FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w) - 7)) AS i FROM words)),
pairs AS MATERIALIZED (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (
  SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 8 + q AS len FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) t GROUP BY doc_id, q, island),
found AS MATERIALIZED (
  SELECT doc_id, s, len, min(q) AS q FROM islands WHERE len >= greatest(24, 3 * q) GROUP BY doc_id, s, len),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         first({{'s': s, 'n': len, 'q': q}} ORDER BY len::DOUBLE / q DESC, s, q) AS best FROM found GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM found),
lost AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
rest AS (
  SELECT words.doc_id, CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE (
    SELECT coalesce(string_agg(x.word, ' ' ORDER BY x.i), '') FROM (SELECT unnest(w) AS word, unnest(range(0, len(w))) AS i) x WHERE NOT list_contains(gone, x.i)) END AS text
  FROM words LEFT JOIN lost USING (doc_id))
SELECT rest.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, best.n AS length, best.q AS period, (1000 * best.n) // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(text) AS collapsed_sha256
FROM rest LEFT JOIN told USING (doc_id)
"""

_WHITE = r"[\x20\x09-\x0D]"


def _op13() -> str:
    """Costs from the last turn backward, each with its edits and text, by the recursion over turns."""
    writes = [2, 2, 3, 2]
    keeps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    role = {2: "user", 3: "assistant"}
    new = lambda c, a, r: f"{{'c': {c}, 'a': {a}, 'r': {r}}}"

    def taken(q: int) -> str:
        ways = [new(f"v{q}.c + 3", f"'D' || v{q}.a", f"v{q}.r")]
        for (at, initial), to in keeps.items():
            if at == q:
                ways.append(f"CASE WHEN NOT must AND left(role, 1) = '{initial}' THEN {new(f'v{to}.c + cut', f"'K' || v{to}.a", f"list_prepend(role || ':' || text, v{to}.r)")} END")
        to = writes[q]
        ways.append(f"CASE WHEN NOT must THEN {new(f'v{to}.c + 2 + cut', f"'R' || v{to}.a", f"list_prepend('{role[to]}:' || text, v{to}.r)")} END")
        return f"list_sort(list_filter([{', '.join(ways)}], lambda z: z IS NOT NULL))[1]"

    def inserted(q: int, source: str) -> str:
        to = writes[q]
        return f"list_sort([b{q}, {new(f'{source}{to}.c + 2', f"'I' || {source}{to}.a", f"list_prepend('{role[to]}:', {source}{to}.r)")}])[1]"

    return rf"""
WITH RECURSIVE asked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM asked WHERE f <> 0),
turns AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         regexp_replace(text, '{_WHITE}+$', '') AS bare FROM hurt),
faults AS MATERIALIZED (
  SELECT *, bare = '' AS blank, bare <> '' AND again AS twice, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS broken,
         coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS off FROM turns),
counted AS MATERIALIZED (
  SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate,
         count(*) FILTER (broken) AS truncated, count(*) FILTER (off) AS illegal FROM faults GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS k, {new('0', "''", '[]::VARCHAR[]')} AS v0, {new('4', "'II'", "['user:', 'assistant:']")} AS v1, {new('2', "'I'", "['assistant:']")} AS v2, {new('0', "''", '[]::VARCHAR[]')} AS v3 FROM counted
  UNION ALL
  SELECT conv_id, k, {inserted(0, 'c')}, {inserted(1, 'c')}, c2, c3
  FROM (SELECT conv_id, k, b0, b1, {inserted(2, 'b')} AS c2, {inserted(3, 'b')} AS c3
    FROM (SELECT conv_id, k - 1 AS k, {taken(0)} AS b0, {taken(1)} AS b1, {taken(2)} AS b2, {taken(3)} AS b3
      FROM (SELECT walk.*, f.role, f.text, f.blank OR f.twice AS must, f.broken::INTEGER AS cut FROM walk JOIN faults f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.k = walk.k WHERE walk.k > 0)))),
ended AS (SELECT conv_id, v0 FROM walk WHERE k = 0)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
"""


SQL = {"op3_mixing": OP3, "op4_minhash_dedup": OP4, "op5_decontaminate": OP5, "op8_embedding_dedup": OP8, "op9_chat_format": OP9,
       "op12_periodic_runs": OP12, "op13_conversation_repair": _op13()}
