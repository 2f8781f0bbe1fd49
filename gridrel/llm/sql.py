"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {5 * g + 1}, 5))::INTEGER >> {s}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0)
)
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL = {
    "op1_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, {_BASE32} AS payload_digest FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM w""",
    "op2_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, {_SPACE}), {_LOWER}) AS key FROM l),
        g AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> g.largest AS lost FROM k LEFT JOIN g USING (key))
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(lost::INTEGER) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op4_jaccard_join": f"""
        WITH RECURSIVE t AS (SELECT md5(coalesce(text, '')) AS id, min(doc_id) AS least, count(*) AS copies,
                 list_filter(regexp_split_to_array(translate(any_value(coalesce(text, '')), {_LOWER}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
               FROM documents GROUP BY 1),
        s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM t),
        x AS (SELECT id, len(g) AS n, unnest(g) AS g FROM s),
        p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.g = b.g AND a.id <> b.id
              GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
        r(id, other) AS (SELECT id, id FROM t UNION SELECT r.id, p.b FROM r JOIN p ON r.other = p.a),
        c AS (SELECT r.id, min(t.least) AS class_id FROM r JOIN t ON r.other = t.id GROUP BY r.id),
        n AS (SELECT a AS id, count(*) AS links FROM p GROUP BY a)
        SELECT d.doc_id, CASE WHEN len(t.w) = 0 THEN d.doc_id ELSE c.class_id END AS class_id,
               CAST(coalesce(n.links, 0) AS BIGINT) AS n_links, CAST(CASE WHEN len(t.w) = 0 THEN 0 ELSE t.copies - 1 END AS BIGINT) AS n_copies
        FROM documents d JOIN t ON md5(coalesce(d.text, '')) = t.id JOIN c ON c.id = t.id LEFT JOIN n ON n.id = t.id""",
    "op7_decontamination": f"""
        WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORD}') AS w FROM benchmark),
        v AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda s: array_to_string(w[s:s + 12], ' '))) AS win FROM i WHERE len(w) > 0),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORD}') AS w FROM documents),
        q AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda s: struct_pack(start := s, win := array_to_string(w[s:s + n - 1], ' '))), recursive := true)
              FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
        f AS (SELECT q.doc_id, q.start, q.n, v.item_id FROM q JOIN v ON q.n = v.n AND q.win = v.win),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(f.start, f.start + f.n)) AS p FROM f) GROUP BY doc_id),
        e AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN e USING (doc_id)""",
    "op10_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
