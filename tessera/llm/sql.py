"""SQL for DuckDB that gives the rows of this package's queries, written apart from the operators."""

DECONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM bw) AS k, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw USING (win)),
per AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (r) LEFT JOIN its USING (r)
"""

_EN = "the of and to in is that it was for on with as be by at this from are an"
_DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als"
_FR = "de la le et les des en un du une que est pour qui dans par sur au plus pas"
_ES = "de la que el en y a los se del las un por con no una su para es al"

RULES = rf"""
WITH known AS (SELECT 'en' AS lang, string_split('{_EN}', ' ') AS cw UNION ALL SELECT 'de', string_split('{_DE}', ' ') UNION ALL SELECT 'fr', string_split('{_FR}', ' ') UNION ALL SELECT 'es', string_split('{_ES}', ' ')),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(documents.lang, '') AS lang, coalesce(text, '') AS t, cw, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents LEFT JOIN known ON known.lang = documents.lang),
win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS x(i) WHERE len(w) >= 5),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win SEMI JOIN (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1) USING (r, s)) GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT d.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^a-z]', '', 'g')) AS c0, length(t) - length(array_to_string(w, '')) AS c1, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS c2, length(regexp_replace(t, '[^0-9]', '', 'g')) AS c3,
  length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS c6, length(t) AS chars
  FROM d LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
g AS (SELECT *, [c0, c1, c2, c3, n_symbols, chars - c0 - c1 - c2 - c3 - n_symbols - c6, c6] AS cls,
  CASE WHEN cw IS NOT NULL THEN list_append(list_transform(cw, lambda k: len(list_filter(w, lambda v: v = k))), len(list_filter(w, lambda v: NOT list_contains(cw, v)))) END AS com FROM f),
rc AS (SELECT lang, list(s ORDER BY k) AS rcls, sum(s) AS rsum FROM (SELECT lang, k, sum(cls[k]) AS s FROM g, range(1, 8) AS x(k) GROUP BY ALL) GROUP BY lang),
rw AS (SELECT lang, list(s ORDER BY k) AS rcom, sum(s) AS rn FROM (SELECT lang, k, sum(com[k]) AS s FROM g, range(1, 22) AS x(k) WHERE com IS NOT NULL GROUP BY ALL) GROUP BY lang),
sh AS (SELECT r, 'c' AS kind, cls[k]::DOUBLE / chars AS a, rcls[k]::DOUBLE / rsum AS b FROM g JOIN rc USING (lang), range(1, 8) AS x(k) WHERE chars > 0 AND rsum > 0
  UNION ALL SELECT r, 'w', com[k]::DOUBLE / n_words, rcom[k]::DOUBLE / rn FROM g JOIN rw USING (lang), range(1, 22) AS x(k) WHERE com IS NOT NULL AND n_words > 0 AND rn > 0),
js AS (SELECT r, kind, sqrt(greatest(0, sum((CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2))) AS dist FROM sh GROUP BY r, kind),
v AS (SELECT g.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(x.dist, 0) AS dc, coalesce(y.dist, 0) AS dw
  FROM g LEFT JOIN js x ON x.r = g.r AND x.kind = 'c' LEFT JOIN js y ON y.r = g.r AND y.kind = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (chars >= 400 AND dc > 0.33 OR n_words >= 150 AND dw > 0.28) AS kept FROM v
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT t, min(page_id) AS first FROM p GROUP BY t)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(t), (i // 4)::INT * 5 + 1, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (t)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS s FROM d, unnest(range(1, greatest(len(w), 2))) AS x(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.k, nb.k) >= 80 * greatest(na.k, nb.k) GROUP BY a.doc_id, b.doc_id, na.k, nb.k HAVING 100 * count(*) >= 80 * (na.k + nb.k - count(*))),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS node, x AS c FROM both_ways UNION SELECT b.x, r.c FROM both_ways b JOIN reach r ON r.node = b.y),
comp AS (SELECT node, min(c) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = d.doc_id
"""

_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRETS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES (0, '{_ASSIGN}'), (1, 'AKIA[A-Z0-9]{{12,}}'), (2, '[0-9a-f]{{32,}}'), (3, '[A-Za-z0-9+/_-]{{20,}}')) AS v(k, pat)),
m AS (SELECT r, owner, part, k, pat, CASE k WHEN 0 THEN string_split_regex(t, '{_ASSIGN}') WHEN 1 THEN string_split_regex(t, 'AKIA[A-Z0-9]{{12,}}') WHEN 2 THEN string_split_regex(t, '[0-9a-f]{{32,}}') ELSE string_split_regex(t, '[A-Za-z0-9+/_-]{{20,}}') END AS gaps,
  CASE k WHEN 0 THEN regexp_extract_all(t, '{_ASSIGN}') WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]{{12,}}') WHEN 2 THEN regexp_extract_all(t, '[0-9a-f]{{32,}}') ELSE regexp_extract_all(t, '[A-Za-z0-9+/_-]{{20,}}') END AS hits FROM d, p),
s AS (SELECT r, owner, part, k, hits[i] AS hit, (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM m, unnest(range(1, len(hits) + 1)) AS x(i)),
v AS (SELECT *, a + length(hit) AS e, CASE WHEN k = 0 THEN regexp_extract(hit, '{_ASSIGN}', 2) ELSE hit END AS val FROM s),
base AS (SELECT * FROM v WHERE k IN (1, 2) OR k = 0 AND length(val) >= 8),
bare AS (SELECT * FROM v WHERE k = 3 AND len(list_distinct(string_split(val, ''))) >= 10 AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = v.r AND b.a < v.e AND v.a < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
own AS (SELECT val, count(DISTINCT owner) AS n_owners FROM every GROUP BY val),
j AS (SELECT *, n_owners > 2 AS copied, n_owners <= 2 AND length(val) >= 16 AND len(list_distinct(string_split(val, ''))) >= 8 AND regexp_matches(val, '[A-Za-z]') AND regexp_matches(val, '[0-9]') AS live,
  ['assign', 'access', 'hex', 'owned'][k + 1] || ':' || a || ':' || e AS span FROM every JOIN own USING (val) WHERE k < 3 OR n_owners <= 2),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(span, ',' ORDER BY a, k) FILTER (k < 3) AS bs, string_agg(span, ',' ORDER BY a, k) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied FROM d LEFT JOIN g USING (r)
"""

RESAMPLING = r"""
WITH tbl AS (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS x(i))),
texts AS (SELECT row_number() OVER () AS r, 0 AS side, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), 1, NULL, text FROM benchmark),
w AS (SELECT r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT r, side, array_to_string(w[i : i + n - 1], ' ') AS s FROM w, range(1, 4) AS y(n), unnest(range(1, len(w) - n + 2)) AS x(i) WHERE len(w) >= n),
u AS (SELECT DISTINCT s FROM f),
b AS (SELECT s, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), (2 * i + 1)::INT, 2))::BIGINT)), lambda c, x: xor(c >> 8, tb[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM u, tbl),
k AS (SELECT r, side, bucket, count(*) AS n FROM f JOIN b USING (s) GROUP BY ALL),
h AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS c, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM k GROUP BY bucket),
z AS (SELECT coalesce(sum(c), 0) AS cs, coalesce(sum(t), 0) AS ts FROM h),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (cs + 10000) / ((c + 1) * (ts + 10000))))::BIGINT AS gain FROM h, z),
d AS (SELECT r, doc_id, len(w) AS n_words, ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hh FROM w WHERE side = 0),
e AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM k JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
sc AS (SELECT r, doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((hh + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN e USING (r)),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features DESC) AS rank, count(*) OVER () AS n FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END::BIGINT AS rank FROM sc LEFT JOIN rk USING (r)
"""

HARD_NEGATIVES = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT r AS ar, vec_id AS anchor_id, label AS al, v AS av FROM e WHERE vec_id % 100 = 0),
s AS (SELECT ar, anchor_id, al, vec_id, label, list_dot_product(av, v)::BIGINT AS score FROM a, e),
p AS (SELECT ar, anchor_id, al, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS pr FROM s WHERE label = al AND vec_id <> anchor_id QUALIFY pr <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ar, pr ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.ar = p.ar AND s.label <> p.al AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
