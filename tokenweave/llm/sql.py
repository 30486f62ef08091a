"""DuckDB statements with the results of the queries that SQL can express."""

from tokenweave.llm.licenses import TEMPLATES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH l AS (
  SELECT doc_id, i, x[i] AS line, {LOWER.format("trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
), hot AS (
  SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE hot.key IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot USING (key) GROUP BY doc_id
"""

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
gap AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again),
num AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gap),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS z FROM num GROUP BY doc_id, g),
cut AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

WORDS = f"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
),
hit AS (SELECT DISTINCT doc_id, item_id, i, n FROM dw JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)
"""

_TEMPLATE_VALUES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k in sorted(TEMPLATES) for t in TEMPLATES[k])

OP6 = f"""
WITH tn AS (
  SELECT license, row_number() OVER () AS template, trim(regexp_replace({LOWER.format("txt")}, '[^a-z0-9]+', ' ', 'g')) AS u
  FROM (VALUES {_TEMPLATE_VALUES}) v(license, txt)
),
tg AS (SELECT license, template, w[i] || ' ' || w[i + 1] AS gram, len(w) - 1 AS b
       FROM (SELECT license, template, w, unnest(range(1, len(w))) AS i FROM (SELECT license, template, string_split(u, ' ') AS w FROM tn))),
tc AS (SELECT license, template, b, gram, count(*) AS times FROM tg GROUP BY ALL),
d AS (SELECT doc_id, regexp_replace({LOWER.format("text")}, '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
us AS (
  SELECT DISTINCT doc_id, trim(u) AS u FROM (
    SELECT doc_id, regexp_replace(t, '\\s+', ' ', 'g') AS u FROM d
    UNION ALL SELECT doc_id, regexp_replace(unnest(string_split_regex(t, '\\n *\\n')), '\\s+', ' ', 'g') FROM d
    UNION ALL SELECT doc_id, unnest(string_split(t, chr(10))) FROM d)
),
uw AS (SELECT doc_id, u, string_split(u, ' ') AS w FROM us WHERE u <> ''),
ug AS (SELECT doc_id, u, len(w) - 1 AS a, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, u, w, unnest(range(1, len(w))) AS i FROM uw)),
uc AS (SELECT doc_id, u, a, gram, count(*) AS n FROM ug GROUP BY ALL),
dice AS (
  SELECT doc_id, u, license, template, 2 * sum(least(n, times))::BIGINT / (a + b)::DOUBLE AS score
  FROM uc JOIN tc USING (gram) GROUP BY doc_id, u, license, template, a, b
),
ok AS (SELECT * FROM dice WHERE score >= 0.8),
best AS (SELECT doc_id, max(score) AS score, count(DISTINCT u) AS n_units, arg_min(license, {{'s': -score, 'l': license}}) AS license FROM ok GROUP BY doc_id)
SELECT doc_id, license, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_units, 0)::BIGINT AS n_units
FROM documents LEFT JOIN best USING (doc_id)
"""

def _mix_rounds(rounds: int) -> str:
    one = """
r{p} AS (
  SELECT * EXCLUDE (got, open, need, run), got OR (open AND run <= need) AS got FROM (
    SELECT *, sum(CASE WHEN open THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h, tie, size) AS run FROM (
      SELECT *, size > 0 AND size <= need * {part}::DOUBLE AND NOT got AS open FROM (
        SELECT *, target - whole * source_size - sum(CASE WHEN got THEN size ELSE 0 END) OVER (PARTITION BY source) AS need FROM r{q})))
)"""
    return ",".join(one.format(p=p, q=p - 1, part=0.25 if p < rounds - 1 else 1.0) for p in range(1, rounds + 1))


OP11 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, coalesce(doc_id::VARCHAR, '') AS tie,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
f AS (
  SELECT *, coalesce(sum(3::DOUBLE * source_size) OVER (ORDER BY 3::DOUBLE * source_size / w, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS below,
         sum(w) OVER (ORDER BY 3::DOUBLE * source_size / w, w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM s
),
level AS (SELECT max(((SELECT sum(source_size) FROM s)::DOUBLE - below) / free) AS level FROM f),
g AS (SELECT source, source_size, least(w * level, 3::DOUBLE * source_size) AS target FROM s, level),
r0 AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole, FALSE AS got
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
),{_mix_rounds(5)}
,
z AS (
  SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY open DESC, abs(n - need), h, tie, size) = 1 AND open AS last FROM (
    SELECT *, size > 0 AND NOT got AND n < 2 * need AS open FROM (
      SELECT *, sum(size) OVER (PARTITION BY source, h, tie, size) AS n, target - whole * source_size - sum(CASE WHEN got THEN size ELSE 0 END) OVER (PARTITION BY source) AS need FROM r5))
)
SELECT doc_id, size, source_size, target, size * (whole + (got OR last)::BIGINT) AS taken FROM z
"""

OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
r AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1 : least(a, b)], '') AS head, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1 :], '') AS tail FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))"

OP13 = f"""
WITH RECURSIVE o AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS x
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (SELECT conv_id, x, (4294967295 - {_CRC.format("conv_id::VARCHAR")}) % 6 AS h FROM o),
c AS (SELECT h.conv_id, list_concat(coalesce(b.x, [])[1 : h], h.x[h + 1 :]) AS x FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
e AS (SELECT conv_id, d, x[1 : d] AS p, len(x) AS n FROM (SELECT conv_id, x, unnest(range(0, len(x) + 1)) AS d FROM c)),
v AS (SELECT p, d, min(conv_id) AS low, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends FROM e GROUP BY p, d),
k AS (SELECT v.*, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(p[d].t) END AS own, CASE WHEN d = 0 THEN NULL ELSE p[1 : d - 1] END AS up FROM v),
kids AS (SELECT up AS p, count(*) AS n_children FROM k WHERE d > 0 GROUP BY up),
w AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN kids ON k.p = kids.p),
under AS (SELECT DISTINCT a.low AS alow, a.d AS ad, z.low AS zlow, z.d AS zd FROM e ea JOIN v a ON ea.p = a.p JOIN e ez ON ea.conv_id = ez.conv_id AND ez.d >= ea.d JOIN v z ON ez.p = z.p),
sums AS (SELECT alow, ad, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved FROM under JOIN w ON w.low = zlow AND w.d = zd GROUP BY alow, ad)
SELECT w.low AS conv_id, w.d::BIGINT AS depth, pa.low AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN sums ON alow = w.low AND ad = w.d LEFT JOIN v pa ON pa.p = w.up
"""

ORACLE = {"op8_vector_dedup": OP8, "op6_license_scan": OP6, "op2_suffix_dedup": OP2, "op4_line_dedup": OP4, "op9_decontamination": OP9, "op11_source_mix": OP11, "op12_fill_in_middle": OP12, "op13_conversation_trie": OP13}
