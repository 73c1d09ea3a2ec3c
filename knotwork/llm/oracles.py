"""SQL (DuckDB) for the queries whose results SQL can say."""

from knotwork.llm.quality import LINE_BYTES_SHARE, MIN_WORDS, WINDOW_SHARES

WORD = r"[^\x20\x09-\x0D]+"

_WINDOWS = "".join(
    f""", g{n} AS (SELECT doc_id, i, x, CASE WHEN i <= n - {n - 1} THEN string_agg(x, chr(1)) OVER (
            PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END g FROM w),
    r{n} AS (SELECT doc_id, i, x, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN i END hit FROM g{n}),
    i{n} AS (SELECT doc_id, count(*) k, sum(length(x)) chars FROM (
        SELECT doc_id, x, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) near
        FROM r{n}) WHERE near IS NOT NULL GROUP BY 1)"""
    for n in (3, *WINDOW_SHARES)
)
_SHARES = ", ".join(f"coalesce(i{n}.chars, 0) / greatest(word_chars, 1) AS share_{n}" for n in WINDOW_SHARES)
_JOINS = " ".join(f"LEFT JOIN i{n} USING (doc_id)" for n in (3, *WINDOW_SHARES))
_PASSED = " AND ".join(f"share_{n} <= {most}" for n, most in WINDOW_SHARES.items())

ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END lowest FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id = lowest THEN 'response' ELSE 'revisit' END record_type,
            CASE WHEN page_id <> lowest THEN lowest END refers_to FROM f""",
    "op4_quality": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}') ws FROM documents),
        w AS (SELECT doc_id, len(ws) n, unnest(ws) x, unnest(range(1, len(ws) + 1)) i FROM d),
        l AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id, x) k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM d)
              WHERE regexp_matches(x, '{WORD}')),
        s AS (SELECT doc_id, count(*) lines, count(*) FILTER (k > 1) dup, sum(strlen(x)) size, coalesce(sum(strlen(x)) FILTER (k > 1), 0) dup_size FROM l GROUP BY 1)
        {_WINDOWS},
        m AS (SELECT doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars,
            length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, coalesce(dup, 0) n_dup_lines, coalesce(i3.k, 0) n_repeat_words,
            coalesce(dup, 0) / greatest(coalesce(lines, 0), 1) line_share, coalesce(dup_size, 0) / greatest(coalesce(size, 0), 1) line_bytes_share, {_SHARES}
            FROM d LEFT JOIN s USING (doc_id) {_JOINS}),
        b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words base_failed FROM m)
        SELECT *, NOT base_failed AND line_bytes_share <= {LINE_BYTES_SHARE} AND {_PASSED} kept FROM b""",
    "op9_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) i FROM d WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        r AS (SELECT doc_id, doc_id c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
        o AS (SELECT doc_id, min(c) component_id FROM r GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept FROM documents JOIN o USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op11_merkle": """
        WITH RECURSIVE bits AS (
          SELECT d.*, list_reduce(flatten(list_transform(range(0, length(CAST(doc_id AS VARCHAR)) + 1),
              lambda i: CASE WHEN i = 0 THEN [4294967295] ELSE [CAST(ascii(substring(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] END)),
              lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc
          FROM documents d
        ), leaves AS (
          SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || tail) AS leaf,
                 sha256(head || coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') || tail) AS other,
                 coalesce(xor(crc, 4294967295) % 7 = 0, false) AS tampered
          FROM (SELECT *, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                          || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                       coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM bits)
        ), placed AS (
          SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                 count(*) OVER (PARTITION BY lang) AS n FROM leaves
        ), below(tree, level, i, n, h) AS (
          SELECT tree, 0, place, n, leaf FROM placed
          UNION ALL
          SELECT tree, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM below WHERE n > 1 GROUP BY tree, level, i // 2
        ), subroots AS (
          SELECT tree, h AS subroot, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM below WHERE n = 1
        ), above(level, i, n, h) AS (
          SELECT 0, place, n, subroot FROM subroots
          UNION ALL
          SELECT level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY level, i // 2
        ), nodes AS (
          SELECT tree, level, i, h FROM below WHERE n > 1
          UNION ALL SELECT s.tree, s.depth + a.level, a.i, a.h FROM subroots s, above a WHERE a.n > 1
        ), starts AS (SELECT s.*, (SELECT max(level) FROM above) AS top FROM subroots s), walk(doc_id, leaf, tree, level, i, h, proof) AS (
          SELECT doc_id, leaf, tree, 0, place, CASE WHEN tampered THEN other ELSE leaf END, '' FROM placed
          UNION ALL
          SELECT w.doc_id, w.leaf, w.tree, w.level + 1, CASE WHEN w.level + 1 = s.depth THEN s.place ELSE w.i // 2 END,
                 sha256(CASE WHEN sib.h IS NULL THEN w.h WHEN w.i % 2 = 1 THEN sib.h || w.h ELSE w.h || sib.h END), w.proof || coalesce(sib.h, '')
          FROM walk w JOIN starts s ON s.tree = w.tree LEFT JOIN nodes sib ON sib.tree = w.tree AND sib.level = w.level AND sib.i = xor(w.i, 1)
          WHERE w.level < s.depth + s.top
        )
        SELECT w.doc_id, w.leaf, s.subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
        FROM walk w JOIN starts s ON s.tree = w.tree AND w.level = s.depth + s.top, (SELECT h FROM above WHERE n = 1) r""",
}
