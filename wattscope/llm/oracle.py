"""DuckDB twins of the queries of this package that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({bits} >> {shift}) & 31), 1)"
_BITS = "('0x' || substr(sha1(payload), {at}, 5))::BIGINT"
_BASE32 = " || ".join(_DIGIT.format(bits=_BITS.format(at=at), shift=shift)
                      for at in range(1, 41, 5) for shift in (15, 10, 5, 0))

SQL["op2_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f"""

SQL["op5_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
                  vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL["op8_decontam"] = f"""
WITH dw AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
     iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
     iwin AS (SELECT item_id, w, least(13, len(w)) AS n FROM iw WHERE len(w) > 0),
     win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
             FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM iwin)),
     dg AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
                  FROM dw CROSS JOIN (SELECT DISTINCT n FROM win))),
     hit AS (SELECT doc_id, item_id, p, n FROM dg JOIN win USING (n, g)),
     pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit
             FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
             FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

SQL["op7_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS w FROM documents),
     sh AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
     size AS (SELECT r, count(*) AS n FROM sh GROUP BY 1),
     met AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM sh a JOIN sh b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
     link AS (SELECT a, b FROM met JOIN size x ON x.r = a JOIN size y ON y.r = b
              WHERE met.n >= 0.8::DOUBLE * (x.n + y.n - met.n) - 1e-9),
     reach AS (SELECT r, r AS other FROM w UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.other),
     class AS (SELECT reach.r, min(o.doc_id) AS class_id FROM reach JOIN w o ON o.r = reach.other GROUP BY 1),
     n AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM w JOIN class USING (r) LEFT JOIN n USING (r)"""

_LUHN = """list_sum(list_transform(range(0, strlen(digits)), lambda i:
    CASE WHEN i % 2 = 0 THEN substr(digits, strlen(digits) - i, 1)::INTEGER
         WHEN 2 * substr(digits, strlen(digits) - i, 1)::INTEGER > 9 THEN 2 * substr(digits, strlen(digits) - i, 1)::INTEGER - 9
         ELSE 2 * substr(digits, strlen(digits) - i, 1)::INTEGER END)) % 10 = 0"""

# Base spans by kind, then the terms beside them, their disclosure, and where they occur outside base spans.
SQL["op4_pii"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
     kinds AS (SELECT * FROM (VALUES
        (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
        (3, 'card', '[0-9]([ -]?[0-9])+'), (4, 'phone', '\+[0-9][ ().0-9-]+[0-9]')) k(ord, kind, pattern)),
     parted AS (SELECT r, ord, kind, string_split(regexp_replace(t, pattern, chr(57344) || '\0' || chr(57344), 'g'), chr(57344)) AS ps FROM d, kinds),
     matched AS (SELECT r, ord, kind, coalesce(list_sum(list_transform(ps[1:i - 1], lambda p: length(p))), 0)::BIGINT AS s, ps[i] AS v,
                        right(ps[i - 1], 120) AS lhs, left(ps[i + 1], 120) AS rhs
                 FROM (SELECT *, unnest(range(2, len(ps), 2)) AS i FROM parted)),
     digited AS (SELECT *, s + length(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM matched),
     base AS (SELECT * FROM digited WHERE CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN regexp_full_match(v, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})){{3}}')
        WHEN 'card' THEN strlen(digits) BETWEEN 16 AND 19 AND {_LUHN}
        ELSE strlen(digits) BETWEEN 8 AND 15 END),
     cut AS (SELECT kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN digits ELSE lower(v) END AS entity, lhs, rhs,
                    list_filter(regexp_split_to_array(lower(CASE WHEN length(lhs) = 120 THEN regexp_replace(lhs, '^\p{{L}}+', '') ELSE lhs END), '\P{{L}}+'), lambda w: length(w) >= 3) AS a,
                    list_filter(regexp_split_to_array(lower(CASE WHEN length(rhs) = 120 THEN regexp_replace(rhs, '\p{{L}}+$', '') ELSE rhs END), '\P{{L}}+'), lambda w: length(w) >= 3) AS b
             FROM base),
     mention AS (SELECT entity, lhs, rhs, list_distinct(list_concat(a[greatest(len(a) - 7, 1):], b[1:8])) AS terms FROM cut),
     near AS (SELECT entity, lhs, rhs, unnest(terms) AS term FROM mention),
     ent AS (SELECT entity, sum(len(terms)) AS w FROM mention GROUP BY 1),
     pair AS (SELECT entity, term, count(*) AS n, count(DISTINCT (lhs, rhs)) AS contexts FROM near GROUP BY 1, 2),
     word AS (SELECT r, unnest(list_filter(regexp_split_to_array(lower(t), '\P{{L}}+'), lambda w: length(w) >= 3)) AS term FROM d),
     voc AS (SELECT term, count(*) AS n_t FROM word GROUP BY 1),
     total AS (SELECT sum(n_t)::DOUBLE AS n FROM voc),
     -- Wilson's lower bound of the share, one-sided at 90 %.
     shared AS (SELECT term, contexts, w, total.n AS total, least(pair.n / n_t::DOUBLE, 1) AS p, n_t::DOUBLE AS m, 1.2815515655446008::DOUBLE AS z
                FROM pair JOIN voc USING (term) JOIN ent USING (entity), total WHERE w < total.n),
     judged AS (SELECT term, contexts, 1 + log2(p) / -log2(w / total) AS disclosure,
                       1 + log2((p + z * z / (2 * m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)) / -log2(w / total) AS surely FROM shared),
     risky AS (SELECT DISTINCT term FROM judged WHERE disclosure >= 0.9::DOUBLE AND (contexts >= 3 OR surely >= 0.9::DOUBLE)),
     own AS (SELECT r, string_agg(DISTINCT term, '|') AS terms FROM word JOIN risky USING (term) GROUP BY 1),
     -- A letter before or behind must not belong to the match, so letters runs are compared as a whole.
     runs AS (SELECT d.r, string_split(regexp_replace(t, '\p{{L}}+', chr(57344) || '\0' || chr(57344), 'g'), chr(57344)) AS ps, string_split(terms, '|') AS terms FROM d JOIN own USING (r)),
     term AS (SELECT r, 5 AS ord, 'term' AS kind, coalesce(list_sum(list_transform(ps[1:i - 1], lambda p: length(p))), 0)::BIGINT AS s, ps[i] AS v
              FROM (SELECT *, unnest(range(2, len(ps), 2)) AS i FROM runs) WHERE list_contains(terms, lower(ps[i]))),
     spans AS (SELECT r, ord, kind, s, e FROM base UNION ALL
               SELECT r, ord, kind, s, s + length(v) FROM term
               WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = term.r AND b.s < term.s + length(term.v) AND term.s < b.e)),
     listed AS (SELECT r, count(*) FILTER (ord = 1) AS n_email, count(*) FILTER (ord = 2) AS n_ip, count(*) FILTER (ord = 3) AS n_card, count(*) FILTER (ord = 4) AS n_phone,
                       string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (ord < 5) AS base,
                       string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) AS spans FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
       coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)"""

# The checksum of 0..255, then of each name byte by byte; neighbours by what is left without one letter.
SQL["op11_spelling"] = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                         lambda c, u: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
     run AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
             WHERE length(run) >= 6 GROUP BY 1, 2),
     hexed AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM run),
     summed AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
                    list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h FROM hexed, tab),
     cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n
             FROM summed),
     voc AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
     less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM voc)),
     near AS (SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM less a JOIN voc b ON a.rest = b.word
              UNION SELECT b.word, a.word, a.n FROM less a JOIN voc b ON a.rest = b.word),
     best AS (SELECT word, count(*) AS n_near, min({'m': -n, 'near': near}) AS b FROM near GROUP BY 1),
     form AS MATERIALIZED (SELECT word, voc.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.m >= 5 * voc.n THEN b.near END AS form,
                     (CASE WHEN -b.m >= 5 * voc.n THEN -b.m END)::BIGINT AS form_n FROM voc LEFT JOIN best USING (word)),
     walk AS (SELECT word, word AS root FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.root WHERE form.form IS NOT NULL),
     ends AS (SELECT walk.word, walk.root FROM walk JOIN form ON form.word = walk.root WHERE form.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN ends USING (word)"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL["op13_lexical"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
     n AS MATERIALIZED (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
     total AS MATERIALIZED (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM n),
     tf AS MATERIALIZED (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2),
     it AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY 1),
     ask AS MATERIALIZED (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM it) GROUP BY 1, 2),
     w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total WHERE term IN (SELECT term FROM ask) GROUP BY term, nd),
     s AS (SELECT item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // l))))::BIGINT AS score
           FROM ask JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r), total GROUP BY 1, 2, 3),
     ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
