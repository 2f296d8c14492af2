"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

SQL["op3_mix_sources"] = rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
           length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS symbols
    FROM documents
),
draws AS (
    SELECT doc_id, source, size,
           -ln((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE)
               / 281474976710656.0::DOUBLE)
           / greatest(0.05::DOUBLE, 1 - symbols::DOUBLE / greatest(size, 1)) AS k
    FROM sized
),
sources AS (
    SELECT source, sum(size)::BIGINT AS total,
           [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
    FROM draws GROUP BY source
),
ranked AS (
    SELECT *, (sum(total) OVER ()
               - coalesce(sum(3.0::DOUBLE * total) OVER (ORDER BY 3.0::DOUBLE * total / weight, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY 3.0::DOUBLE * total / weight, source NULLS LAST
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources
),
targets AS (
    SELECT source, total,
           least(3.0::DOUBLE * total,
                 weight * max(CASE WHEN level <= 3.0::DOUBLE * total / weight THEN level END) OVER ()) AS target
    FROM ranked
),
plan AS (
    SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::INTEGER AS epochs FROM targets
),
prefixed AS (
    SELECT d.*, p.total, p.target, p.epochs,
           sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS FIRST, d.size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
    FROM draws d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
),
chosen AS (
    SELECT *, epochs + bool_or(before + size / 2.0::DOUBLE < target - epochs * total)
                       OVER (PARTITION BY source, k, doc_id, size)::INTEGER AS repeats
    FROM prefixed
)
SELECT doc_id, size::BIGINT AS size, total AS source_size, target, (size * repeats)::BIGINT AS taken,
       repeats::INTEGER AS repeats
FROM chosen
"""

SQL["op6_minhash_near_dup"] = rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
    FROM split, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i)
    WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
    SELECT DISTINCT a, a FROM both_ways
    UNION
    SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
),
roots AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id,
       d.doc_id = coalesce(root, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""

SQL["op13_exact_dup"] = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM texts JOIN groups USING (text)
"""

SQL["op11_source_divergence"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           {_LOWER} AS text
    FROM documents
),
occurrences AS (
    SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
kept AS (
    SELECT lang, term, count(*) AS whole FROM occurrences GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
),
sources AS (SELECT DISTINCT lang, source FROM docs),
own AS (SELECT lang, source, term, count(*) AS n FROM occurrences GROUP BY ALL),
cells AS (
    SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, whole
    FROM sources s JOIN kept k USING (lang) LEFT JOIN own USING (lang, source, term)
),
shares AS (
    SELECT lang, source, term, n,
           1 + 1000000000::HUGEINT * (n + 2)
               // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p,
           1 + 1000000000::HUGEINT * (whole + 2)
               // (sum(whole) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS q
    FROM cells
),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source
    GROUP BY ALL
),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source != b.source
    LEFT JOIN sums v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""

SQL["op12_collocations"] = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counts AS (
    SELECT lang, k, w[i : i + k - 1] AS p, count(*)::HUGEINT AS a
    FROM split, unnest([1, 2, 3]) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i)
    GROUP BY ALL
),
sizes AS (SELECT lang, sum(a) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE k > 1 AND a >= 10),
cuts AS (
    SELECT c.lang, c.p, c.a, j, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score
    FROM candidates c, unnest(range(1, c.k)) AS t(j)
    JOIN counts x ON x.lang = c.lang AND x.p = c.p[1 : j]
    JOIN counts y ON y.lang = c.lang AND y.p = c.p[j + 1 : c.k]
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
parts AS (
    SELECT lang, p[i : i + 1] AS p, a FROM candidates, unnest([1, 2]) AS t(i) WHERE k = 3
),
swallowed AS (
    SELECT DISTINCT s.lang, s.p FROM scored s JOIN parts USING (lang, p) WHERE 100 * parts.a >= 50 * s.a
),
ranked AS (
    SELECT *, array_to_string(p, ' ') AS phrase,
           row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
    FROM scored ANTI JOIN swallowed USING (lang, p)
)
SELECT lang, rank::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
