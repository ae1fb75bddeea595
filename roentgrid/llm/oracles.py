"""DuckDB SQL for the registered queries that it can express."""

from __future__ import annotations

from .divergence import IN_DOCUMENTS, TOP_TERMS
from .periods import LEAST, TIMES
from .rank_profiles import FOLDS, HELD_OUT, PLACES, UNKNOWN


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string: each byte is mixed in, then eight bits are shifted out."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, 3988292384 * (x & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda x, e: {step}), 4294967295)"


# Pairs of equal words at every distance; stretches of them are islands of consecutive places.
OP11 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
           {crc32_sql("doc_id::VARCHAR")} AS h
    FROM documents),
sized AS (
    SELECT r, doc_id, w, len(w)::BIGINT AS n, h % 10 = 0 AND len(w) > 0 AS planted,
           (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS g FROM docs),
lagged AS (SELECT *, 1 + (n - a) // (3 + g) AS p FROM sized),
original AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
places AS (
    SELECT r, n, i, CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END AS taken
    FROM lagged, unnest(range(n)) AS x(i)),
words AS (SELECT x.r, x.n, x.i, o.word FROM places x JOIN original o ON x.r = o.r AND x.taken = o.i),
pairs AS (
    SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i
    WHERE 3 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island),
runs AS (
    SELECT r, start, length, min(q) AS period FROM stretches
    WHERE length >= greatest({LEAST}, {TIMES} * q) GROUP BY r, start, length),
per_doc AS (
    SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
    FROM runs GROUP BY r),
best AS (
    SELECT x.* FROM runs x WHERE NOT EXISTS (
        SELECT 1 FROM runs y WHERE y.r = x.r AND (
            y.length * x.period > x.length * y.period
            OR y.length * x.period = x.length * y.period AND (y.start < x.start OR y.start = x.start AND y.period < x.period)))),
dropped AS (SELECT DISTINCT x.r, x.i FROM words x JOIN runs y ON x.r = y.r AND x.i >= y.start + y.period AND x.i < y.start + y.length),
kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words x
    WHERE NOT EXISTS (SELECT 1 FROM dropped y WHERE y.r = x.r AND y.i = x.i) GROUP BY r)
SELECT d.doc_id, coalesce(p.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
       (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(p.listed, '')) AS runs_sha256,
       sha256(coalesce(k.collapsed, '')) AS collapsed_sha256
FROM docs d LEFT JOIN per_doc p ON d.r = p.r LEFT JOIN best b ON d.r = b.r LEFT JOIN kept k ON d.r = k.r
"""

OP12 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
terms AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS n_docs FROM terms GROUP BY lang, source, term),
kept AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term HAVING sum(n_docs) >= {IN_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
entries AS (SELECT c.lang, c.source, c.term, c.n FROM counted c JOIN kept k ON c.lang = k.lang AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total FROM entries GROUP BY lang, source),
grid AS (
    SELECT s.lang, s.source, k.term, coalesce(e.n, 0) AS n,
           (1 + 1000000000::HUGEINT * (coalesce(e.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v))::BIGINT AS p,
           (1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v))::BIGINT AS q
    FROM sources s JOIN langs l ON s.lang = l.lang JOIN kept k ON s.lang = k.lang
    LEFT JOIN totals t ON s.lang = t.lang AND s.source = t.source
    LEFT JOIN entries e ON s.lang = e.lang AND s.source = e.source AND k.term = e.term),
sums AS (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON a.lang = s.lang AND a.source = s.source AND b.source = s.item),
telling AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM grid WHERE n > 0 AND p > q),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM telling)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""

OP13 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce({crc32_sql("doc_id::VARCHAR")} % {FOLDS} = {HELD_OUT}, false) AS held_out,
           CASE WHEN regexp_matches(coalesce(text, ''), '\p{{L}}')
                THEN trim(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}]+', ' ', 'g')) ELSE '' END AS t
    FROM documents),
words AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(string_split(t, ' ')) AS word FROM docs WHERE t <> '') GROUP BY r, word),
spaced AS (SELECT r, n, ' ' || word || ' ' AS s FROM words),
pieces AS (
    SELECT r, n, substr(s, i::BIGINT, k::BIGINT) AS gram FROM spaced, unnest([1, 2, 3]) AS x(k), unnest(range(1, length(s) - k + 2)) AS y(i)),
grams AS (SELECT r, gram, sum(n) AS n FROM pieces WHERE gram <> ' ' GROUP BY r, gram),
own AS (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) AS place FROM grams QUALIFY place <= {PLACES}),
totals AS (SELECT lang, gram, sum(n) AS n FROM grams JOIN docs USING (r) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, gram),
profiles AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM totals QUALIFY place <= {PLACES}),
langs AS (SELECT DISTINCT lang FROM profiles),
far AS (
    SELECT o.r, l.lang, sum(coalesce(abs(o.place - p.place), {PLACES})) AS distance, count(*) AS m
    FROM own o CROSS JOIN langs l LEFT JOIN profiles p ON p.lang = l.lang AND p.gram = o.gram GROUP BY o.r, l.lang),
best AS (SELECT r, lang, distance, m FROM far QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, '{UNKNOWN}') AS lang_pred, coalesce(1 - b.distance::DOUBLE / ({PLACES} * b.m)::DOUBLE, 0.0) AS score
FROM docs LEFT JOIN best b ON docs.r = b.r
"""

ORACLES: dict[str, str] = {"op11_minimizer_runs": OP11, "op12_divergence_cube": OP12, "op13_rank_profiles": OP13}
