"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: crc32 by its definition: the table from the reversed polynomial, then a fold over the bytes.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc_table)"""


def crc32(blob: str) -> str:
    return f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({blob}), '..'),
    lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"""


SQL = {}

SQL["op1_histogram_sort"] = f"""
WITH {CRC_TABLE},
rows AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size,
    coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS k FROM documents),
placed AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY k) AS together,
    sum(size) OVER (ORDER BY k) - sum(size) OVER (PARTITION BY k) AS ahead,
    sum(size) OVER (ORDER BY k, doc_id NULLS FIRST) - sum(size) OVER (PARTITION BY k, doc_id) AS before FROM rows),
dealt AS (SELECT *, floor(CASE WHEN together <= 0.01::DOUBLE * total / 24 THEN ahead ELSE before END * 24 // total)::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, {crc32("encode(t)")}::BIGINT AS text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM dealt, crc
"""

SQL["op2_metric_range_join"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
"""

#: Words as the operators on shingles take them, and the distinct five-word shingles of every document with words.
SHINGLES = """words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM {docs}),
shingles AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words WHERE len(w) > 0)"""

NEAR = SHINGLES + """,
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, count(*) AS copies FROM shingles GROUP BY list_sort(s)),
member AS (SELECT doc_id, rep, copies FROM shingles JOIN classes ON list_sort(shingles.s) = classes.s),
grams AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes),
links AS (SELECT a.rep AS a, b.rep AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8::DOUBLE * (a.n + b.n - count(*)) - 1e-9),
reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
counted AS (SELECT a, sum(copies) AS n FROM links JOIN classes ON rep = b GROUP BY a),
near AS (SELECT d.doc_id, coalesce(m.rep, d.doc_id) AS class_id, (coalesce(m.copies, 1) - 1 + coalesce(n, 0))::BIGINT AS n_links,
    coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
    FROM {docs} d LEFT JOIN member m ON m.doc_id = d.doc_id LEFT JOIN least ON least.a = m.rep LEFT JOIN counted ON counted.a = m.rep)"""

SQL["op6_minhash_forest"] = "WITH RECURSIVE " + NEAR.replace("{docs}", "documents") + " SELECT * FROM near"

LEAKS = r"""dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM {docs}),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
dg AS (SELECT doc_id, len(w) - 4 AS long, unnest(range(0, len(w) - 4)) AS pos, array_to_string(w[pos + 1:pos + 5], ' ') AS g FROM dw WHERE len(w) > 4),
ig AS (SELECT item_id, len(w) - 4 AS n, unnest(range(0, len(w) - 4)) AS pos, array_to_string(w[pos + 1:pos + 5], ' ') AS g FROM iw WHERE len(w) > 4),
counted AS (SELECT item_id, n, g, count(*) AS c FROM ig GROUP BY ALL),
hits AS (SELECT doc_id, long, item_id, n, least(n, long) AS m, pos FROM dg JOIN counted USING (g)),
starts AS (SELECT DISTINCT doc_id, item_id, n, m, unnest(range(greatest(0, pos - m + 1), least(pos, long - m) + 1)) AS s FROM hits),
inside AS (SELECT doc_id, item_id, s, h.n, m, d.g, count(*) AS c FROM starts h JOIN dg d USING (doc_id) WHERE d.pos BETWEEN s AND s + m - 1 GROUP BY ALL),
scored AS (SELECT doc_id, item_id, s, i.n, m, sum(least(i.c, k.c)) AS shared FROM inside i JOIN counted k USING (item_id, g) GROUP BY ALL),
alike AS (SELECT doc_id, item_id, s, n, shared::DOUBLE / (n + m - shared) AS similarity FROM scored),
leaks AS (SELECT doc_id, item_id, similarity, s::INT AS start_word, (n + 4)::INT AS n_words FROM alike WHERE similarity >= 0.8::DOUBLE - 1e-12
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1)"""

SQL["op3_simhash_windows"] = "WITH " + LEAKS.replace("{docs}", "documents") + " SELECT * FROM leaks"

SQL["op10_nearest_url"] = r"""
WITH RECURSIVE article AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|$)', 1, 's') AS a FROM pages),
blocks AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(a, '</?(p|h1|h2|h3|ul|ol|li|br|div)( [^>]*)?/?>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS b FROM article)
SELECT page_id, url, array_to_string(b, chr(10)) AS text, length(array_to_string(b, chr(10)))::BIGINT AS n_chars FROM blocks
"""

SQL["op8_typed_parts"] = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, 17 + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'))
    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n FROM said)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

# The values of secrets.py once more: base patterns and least lengths, then character classes with their bits.
_BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]{12,}", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32),
    ("entropy_hex", "[0-9a-f]{24,}", 0, 2.9), ("entropy_base64", r"[A-Za-z0-9+/_\-]{24,}", 0, 4.0),
)
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {r} AS rank, '{k}' AS kind, {n} AS least, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', {i}) AS own FROM d" for r, (k, p, i, n) in enumerate(_BASE)
)

SQL["op7_entropy_windows"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
each AS (SELECT doc_id, rank, kind, least, unnest(range(1, len(h) + 1)) AS i, h, g, own FROM found WHERE len(h) > 0),
hits AS (SELECT doc_id, rank, kind, least, h[i] AS w, length(own[i]) AS n,
    (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM each),
base AS (SELECT doc_id, rank, kind, a, a + length(w) AS b FROM hits WHERE rank < 3 AND n >= least),
windows AS (SELECT doc_id, rank, kind, least, a, w, unnest(range(0, length(w) - 23)) AS j FROM hits WHERE rank > 2
    AND NOT regexp_matches(lower(w), 'example|placeholder|changeme|xxxxxxxx|abcdefghij|0123456789|1234567890|00000000')),
hot AS (SELECT * FROM (SELECT *, substr(w, j::INT + 1, 24) AS x FROM windows) WHERE list_aggregate(string_split(x, ''), 'entropy') >= least - 1e-9 AND len(regexp_extract_all(x, '[0-9]')) BETWEEN 1 AND 23),
begun AS (SELECT *, CASE WHEN j <= lag(j) OVER (PARTITION BY doc_id, rank, a ORDER BY j) + 24 THEN 0 ELSE 1 END AS fresh FROM hot),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, rank, a ORDER BY j) AS island FROM begun),
entropy AS (SELECT doc_id, rank, kind, a + min(j) AS s, a + max(j) + 24 AS e FROM island GROUP BY doc_id, rank, kind, a, island),
spans AS (SELECT * FROM base UNION ALL SELECT doc_id, rank, kind, s, e FROM entropy x WHERE NOT EXISTS (SELECT 1 FROM base y WHERE y.doc_id = x.doc_id AND y.a <= x.s AND x.e <= y.b)),
said AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3) AS own, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS every FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN said USING (doc_id)
"""
