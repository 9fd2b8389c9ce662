"""DuckDB twins of the subpackage's queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"

# Fixed values, written out apart from the operator's own list.
_LICENSE_LINES = """
    ('released under the mit license', 'MIT'),
    ('licensed under the mit license', 'MIT'),
    ('this project is licensed under the mit license', 'MIT'),
    ('spdx license identifier mit', 'MIT'),
    ('licensed under the apache license version 2 0', 'Apache-2.0'),
    ('spdx license identifier apache 2 0', 'Apache-2.0'),
    ('this work is licensed under the gnu general public license version 3', 'GPL-3.0'),
    ('spdx license identifier gpl 3 0 only', 'GPL-3.0'),
    ('spdx license identifier gpl 2 0 only', 'GPL-2.0'),
    ('licensed under creative commons by nc 4 0', 'CC-BY-NC-4.0'),
    ('spdx license identifier creative commons by nc 4 0', 'CC-BY-NC-4.0'),
    ('licensed under cc by 4 0', 'CC-BY-4.0'),
    ('licensed under cc by sa 4 0', 'CC-BY-SA-4.0'),
    ('licensed under cc0 1 0', 'CC0-1.0'),
    ('spdx license identifier bsd 3 clause', 'BSD-3-Clause'),
    ('this is free and unencumbered software released into the public domain', 'Unlicense')
"""

_FORM = "concat(' ', regexp_replace(regexp_replace(lower(body), '(?m)^[^\\n]*(copyright|©|\\(c\\))[^\\n]*[0-9]{4}[^\\n]*$|^[\\x20\\t]*all rights reserved[.]?[\\x20\\t]*$', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')"
for _other, _one in (
    ("licenc", "licens"), ("sub licens", "sublicens"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("favour", "favor"), ("whilst", "while"), ("organis", "organiz"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"),
    ("fulfil ", "fulfill "), ("v 2 0", "version 2 0"), ("cc by nc", "creative commons by nc"),
):
    _FORM = f"replace({_FORM}, '{_other}', '{_one}')"

ORACLE = {
    "op1_license_scan": f"""
        WITH known(form, license) AS (VALUES {_LICENSE_LINES}),
        units AS (
            SELECT doc_id, 0 AS unit, coalesce(text, '') AS body FROM documents
            UNION ALL
            SELECT doc_id, 1 AS unit, unnest(string_split(coalesce(text, ''), chr(10))) AS body FROM documents
        ),
        forms AS (SELECT doc_id, unit, trim(regexp_replace({_FORM}, ' +', ' ', 'g')) AS form FROM units)
        SELECT doc_id,
               max(CASE WHEN unit = 0 THEN license END) AS whole_license,
               coalesce(array_to_string(list_sort(list(DISTINCT license) FILTER (unit = 1 AND license IS NOT NULL)), ','), '') AS licenses,
               count(license) FILTER (unit = 1) AS n_lines
        FROM forms LEFT JOIN known USING (form) GROUP BY doc_id
    """,
    "op5_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ),
        liked AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM liked JOIN scored USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
    # base32: five hexadecimal digits are four letters; ids that may be null are doubles, as
    # pandas makes them of Spark's
    "op13_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        h AS (SELECT page_id, octet_length(body) AS size, sha1(body) AS hex FROM p),
        fives AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS parts FROM h),
        named AS (
            SELECT page_id, size, hex,
                   array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1)), '')), '') AS digest
            FROM fives
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id DESC) AS place, max(page_id) OVER (PARTITION BY hex) AS first FROM named)
        SELECT page_id, size AS payload_bytes, digest AS payload_digest,
               CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CAST(CASE WHEN place > 1 THEN first END AS DOUBLE) AS refers_to, TRUE AS intact
        FROM ranked
    """,
}
