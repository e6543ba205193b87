"""The queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations


def _url_filter(rounds: int = 20) -> str:
    """Rules, then trust and distrust in whole numbers, one common table per round of the propagation."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    link = r"""<[Aa][\x09-\x0D\x20](?:[^<>]*?[\x09-\x0D\x20"''])?[Hh][Rr][Ee][Ff][\x09-\x0D\x20]*=[\x09-\x0D\x20]*["'']?[\x09-\x0D\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"''<>\x09-\x0D\x20]+)"""
    steps = ", ".join(
        f"""r{k} AS MATERIALIZED (
            SELECT host, kind, any_value(base) + coalesce(sum(moved), 0) AS score, any_value(base) AS base
            FROM (SELECT host, kind, base, 0::HUGEINT AS moved FROM r{k - 1}
                  UNION ALL
                  SELECT f.dst, f.kind, NULL, r.score * (f.weight * 85) // (f.total * 100) FROM r{k - 1} r JOIN flow f ON f.src = r.host AND f.kind = r.kind)
            GROUP BY host, kind
        )"""
        for k in range(1, rounds + 1)
    )
    return f"""
        WITH cut AS (
            SELECT page_id, {lower("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
                   list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda x: {lower("x")})) AS links
            FROM pages
        ), ruled AS (
            SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                           WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                           WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                           WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                           WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
            FROM cut
        ), decided AS (
            SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM ruled
        ), edges AS (
            SELECT host, link, count(*) AS weight
            FROM (SELECT host, unnest(links) AS link FROM decided WHERE host <> '') WHERE link <> host GROUP BY host, link
        ), directed AS (
            SELECT 'trust' AS kind, host AS src, link AS dst, weight FROM edges
            UNION ALL SELECT 'distrust', link, host, weight FROM edges
        ), flow AS MATERIALIZED (
            SELECT *, sum(weight) OVER (PARTITION BY kind, src) AS total FROM directed
        ), seeds AS (
            SELECT host, count(*) FILTER (verdict = 'allow') * 1000000000 // count(*) AS trust,
                   count(*) FILTER (verdict = 'block') * 1000000000 // count(*) AS distrust
            FROM decided GROUP BY host
        ), r0 AS MATERIALIZED (
            SELECT host, kind, max(seed)::HUGEINT AS score, (max(seed) * 15 // 100)::HUGEINT AS base
            FROM (SELECT host, 'trust' AS kind, trust AS seed FROM seeds UNION ALL SELECT host, 'distrust', distrust FROM seeds
                  UNION ALL SELECT dst, kind, 0 FROM directed UNION ALL SELECT src, kind, 0 FROM directed)
            GROUP BY host, kind
        ), {steps}, judged AS (
            SELECT host, CASE WHEN coalesce(max(score) FILTER (kind = 'distrust'), 0) > coalesce(max(score) FILTER (kind = 'trust'), 0)
                              THEN 'block' ELSE 'allow' END AS by_host
            FROM r{rounds} GROUP BY host
        )
        SELECT page_id, host, path, rule, coalesce(verdict, by_host) AS verdict FROM decided JOIN judged USING (host)
    """


_URL_FILTER = _url_filter()

LLM_ORACLE: dict[str, str] = {
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op6_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
        FROM n JOIN g USING (text_sha256)
    """,
    "op11_fill_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
                   sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS drawn
            FROM documents
        ), h AS (
            SELECT doc_id, text, lines, len(lines) AS n,
                   ('0x' || drawn[1:8])::BIGINT AS h1, ('0x' || drawn[9:16])::BIGINT AS h2,
                   ('0x' || drawn[17:24])::BIGINT AS h3, ('0x' || drawn[25:32])::BIGINT AS h4
            FROM d
        ), f AS (
            SELECT doc_id, text, n,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
                   array_to_string(lines[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
                   array_to_string(lines[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
                   array_to_string(lines[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix
            FROM h
        )
        SELECT doc_id, n::BIGINT AS n, form,
               CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM f
    """,
    "op12_resampling": r"""
        WITH RECURSIVE bits AS (
            -- The table of the CRC-32 with the reflected polynomial, from eight shifts of each byte.
            SELECT i, i AS c, 0 AS step FROM range(256) r(i)
            UNION ALL
            SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
        ), crc AS (
            SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8
        ), source AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), target AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM benchmark
        ), s AS (
            SELECT r, unnest(words) AS word FROM source
        ), t AS (
            SELECT unnest(words) AS word FROM target
        ), codes AS (
            SELECT word, hex(encode(word)) AS code FROM (SELECT word FROM s UNION SELECT word FROM t)
        ), dealt AS (
            SELECT word, xor(list_reduce(list_transform(range(0, length(code), 2), lambda i: ('0x' || code[i + 1:i + 2])::BIGINT),
                                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
            FROM codes, crc
        ), sums AS (
            SELECT bucket, sum(n_s) AS n_s, sum(n_t) AS n_t
            FROM (SELECT word, count(*) AS n_s, 0 AS n_t FROM s GROUP BY word UNION ALL SELECT word, 0, count(*) FROM t GROUP BY word)
            JOIN dealt USING (word) GROUP BY bucket
        ), gain AS (
            SELECT bucket, floor(1000 * ln(((n_t + 1) * ((SELECT sum(n_s) FROM sums) + 10000))::DOUBLE
                                           / ((n_s + 1) * ((SELECT sum(n_t) FROM sums) + 10000))::DOUBLE))::BIGINT AS gain
            FROM sums
        ), weights AS (
            SELECT r, sum(gain)::BIGINT AS weight FROM s JOIN dealt USING (word) JOIN gain USING (bucket) GROUP BY r
        ), scored AS (
            SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
                                                               / 4294967296))))::BIGINT AS score
            FROM source LEFT JOIN weights USING (r)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
                   count(*) OVER (PARTITION BY n_features >= 20) AS fit
            FROM scored
        )
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank
        FROM placed
    """,
    "op13_url_filter": _URL_FILTER,
}
