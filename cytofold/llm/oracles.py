"""SQL of the queries that SQL expresses."""

from . import license_scan

OP5 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


OP8 = r"""
WITH rows_ AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM documents),
sums AS (SELECT source, sum(size)::DOUBLE AS source_size, 3.0 * sum(size)::DOUBLE AS most FROM rows_ GROUP BY source),
turns AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sums),
levels AS (SELECT *, (sum(source_size) OVER () - sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + most)
    / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM turns),
goals AS (SELECT source, source_size, least(weight * max(level) OVER (), most) AS target FROM levels),
told AS (SELECT *, coalesce(floor(CASE WHEN source_size > 0 THEN target / source_size END + 1e-12), 0) AS whole, target - whole * source_size AS rest FROM goals),
fit AS (SELECT r.*, rest, greatest(length(bin(size)) - 4, 0) AS low FROM rows_ r JOIN told t ON r.source IS NOT DISTINCT FROM t.source WHERE size > 0 AND size <= rest),
classes AS (SELECT source, rest, low, size >> low AS high, sum(size)::DOUBLE AS n, sum(size::DOUBLE * size) AS squares FROM fit GROUP BY ALL),
rates AS (SELECT source, max(rate) AS rate FROM (SELECT source,
    (rest - (sum(n) OVER (PARTITION BY source ORDER BY low DESC, high DESC ROWS UNBOUNDED PRECEDING) - n))
    / sum(squares) OVER (PARTITION BY source ORDER BY low DESC, high DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM classes) GROUP BY source),
chances AS (SELECT f.*, least(rate * size, 1 - 1e-9) AS p FROM fit f JOIN rates s ON f.source IS NOT DISTINCT FROM s.source),
ranks AS (SELECT *, floor(u * (1 - p) / (u * (1 - p) + p * (1 - u)) * 281474976710656.0)::BIGINT AS place FROM chances),
sums_ AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place) AS upto FROM ranks),
begun AS (SELECT source, max(rest) - coalesce(max(CASE WHEN upto <= rest THEN upto END), 0) AS gap FROM sums_ GROUP BY source),
beyond AS (SELECT s.*, gap, rank() OVER (PARTITION BY s.source ORDER BY abs(size - gap)) AS nth FROM sums_ s JOIN begun b ON s.source IS NOT DISTINCT FROM b.source WHERE upto > rest),
near AS (SELECT source, place, any_value(gap) AS gap, abs(sum(size) - any_value(gap)) AS off_ FROM beyond WHERE nth = 1 GROUP BY source, place),
last_ AS (SELECT source, place, row_number() OVER (PARTITION BY source ORDER BY off_, place) AS nth FROM near WHERE off_ < gap),
more AS (SELECT doc_id, s.source, u, size FROM sums_ s LEFT JOIN last_ l ON s.source IS NOT DISTINCT FROM l.source AND s.place = l.place AND nth = 1 WHERE upto <= rest OR l.place IS NOT NULL GROUP BY ALL)
SELECT r.doc_id, r.size, t.source_size::BIGINT AS source_size, round(t.target, 4) AS target, (r.size * (t.whole + CASE WHEN m.u IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM rows_ r JOIN told t ON r.source IS NOT DISTINCT FROM t.source
LEFT JOIN more m ON r.u = m.u AND r.size = m.size AND r.doc_id IS NOT DISTINCT FROM m.doc_id AND r.source IS NOT DISTINCT FROM m.source
"""

OP7 = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (SELECT *, coalesce(lead(text) OVER down, first_value(text) OVER down) AS next_text FROM base
    WINDOW down AS (ORDER BY doc_id DESC NULLS LAST, text)),
cut_ AS (SELECT *, length(text) AS n, length(text) // 3 AS part FROM pairs),
texts AS (SELECT *, substr(text, 1, n - part) || substr(next_text, 1, part) AS edited FROM cut_),
kinds AS (SELECT doc_id, 'own' AS kind, text FROM texts UNION ALL SELECT doc_id, 'edited', edited FROM texts UNION ALL SELECT doc_id, 'next', next_text FROM texts),
trees AS (SELECT doc_id, kind, list_transform(string_split(text, chr(10)), lambda s:
    list_transform(regexp_extract_all(s, '(?:[^\s\v.!?]{1,24}[\s\v]{0,8}){1,16}[.!?]{0,8}[\s\v]{0,8}|[.!?]{1,8}[\s\v]{0,8}|[\s\v]+'), lambda p: md5(p))) AS tree FROM kinds),
branches AS (SELECT doc_id, kind, list_transform(tree, lambda ps: md5(array_to_string(ps, ''))) AS digests,
    list_transform(tree, lambda ps: substr(md5(array_to_string(ps, '')), 1, 16) || array_to_string(list_transform(ps, lambda p: substr(p, 1, 8)), '')) AS parts FROM trees),
prints AS (SELECT doc_id, kind, sha256(array_to_string(digests, '')) || '/' || array_to_string(parts, '/') AS print, parts FROM branches),
sides AS (SELECT o.doc_id, e.kind, o.print AS a_print, e.print AS b_print,
    list_filter(list_distinct(o.parts), lambda s: NOT list_contains(e.parts, s)) AS a, list_filter(list_distinct(e.parts), lambda s: NOT list_contains(o.parts, s)) AS b,
    coalesce(list_sum(list_transform(list_intersect(o.parts, e.parts), lambda s: (length(s) - 16) // 8)), 0) AS same
    FROM prints o JOIN prints e ON o.doc_id = e.doc_id AND o.kind = 'own' AND e.kind <> 'own'),
leaves AS (SELECT doc_id, kind, a_print, b_print, same, list_distinct(flatten(list_transform(a, lambda s: regexp_extract_all(substr(s, 17), '.{8}')))) AS a,
    list_distinct(flatten(list_transform(b, lambda s: regexp_extract_all(substr(s, 17), '.{8}')))) AS b FROM sides),
likeness AS (SELECT doc_id, kind, a_print, b_print, CASE WHEN substr(a_print, 1, 64) = substr(b_print, 1, 64) THEN 1.0::DOUBLE WHEN 2 * same + len(a) + len(b) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * (same + len(list_intersect(a, b))) / (2 * same + len(a) + len(b)) END AS near FROM leaves)
SELECT t.doc_id, n AS n_chars, sha256(edited) AS edited_sha256, e.a_print AS fingerprint, e.b_print AS edited_fingerprint, e.near AS near_edited, x.near AS near_next
FROM texts t JOIN likeness e ON t.doc_id = e.doc_id AND e.kind = 'edited' JOIN likeness x ON t.doc_id = x.doc_id AND x.kind = 'next'
"""



def _op4() -> str:
    """The join of all blocks with all templates, without filters."""
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    text = lambda ws: [w.decode() for w in ws]
    templates = ", ".join(f"('{label}', {listed(sorted(text(s)))}, {step})" for label, s, step in license_scan.template_sets())
    telling = ", ".join(f"('{label}', ' {' '.join(text(license_scan.words(r)))} ')" for label, runs in license_scan.TELLING.items() for r in runs)
    phrases = ", ".join(f"({listed(p.split())}, '{label}')" for p, label in license_scan.PHRASES.items())
    return rf"""
WITH base AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
templates(label, t, step) AS (VALUES {templates}), telling(label, run) AS (VALUES {telling}), phrases(p, label) AS (VALUES {phrases}),
places AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS i FROM base, phrases WHERE len(list_intersect(w, p)) = len(p)),
blocks AS (SELECT doc_id, step, w[s + 1:s + 2 * step] AS b FROM (SELECT doc_id, w, step, unnest(range(0, greatest(len(w), 1)::BIGINT, step::BIGINT)) AS s FROM base, (SELECT DISTINCT step FROM templates))),
matches AS (SELECT DISTINCT doc_id, t.label, len(list_intersect(b, t)) / len(t)::DOUBLE AS share FROM blocks b JOIN templates t ON b.step = t.step
    WHERE len(list_intersect(b, t)) >= {license_scan.THRESHOLD} * len(t) - 1e-9 AND EXISTS (SELECT 1 FROM telling r WHERE r.label = t.label AND contains(' ' || array_to_string(b, ' ') || ' ', run))),
base_ AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
all_ AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT doc_id, label, 1.0 AS share FROM places UNION ALL SELECT * FROM matches) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM base LEFT JOIN base_ USING (doc_id) LEFT JOIN all_ USING (doc_id)
"""


OP4 = _op4()

#: Each 100-byte string with its least place, by hexadecimal digits.
OP1 = """
WITH base AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
strings AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) // 2 - 99, 0))) AS i FROM base),
named AS (SELECT doc_id, i, md5_number(substr(t, 2 * i + 1, 200)) AS s FROM strings),
repeats AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM named) WHERE k > 1),
edges AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM repeats),
islands AS (SELECT doc_id, i, sum(CASE WHEN before + 100 >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM edges),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM islands GROUP BY ALL),
gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM
    (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, -1, 0 FROM base)),
kept AS (SELECT doc_id, string_agg(substr(t, 2 * a + 1, 2 * (coalesce(b, len(t) // 2) - a)), '' ORDER BY a) AS t FROM gaps JOIN base USING (doc_id) GROUP BY doc_id),
told AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM spans GROUP BY doc_id)
SELECT b.doc_id, (len(b.t) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(x.t)) AS kept_sha256
FROM base b JOIN kept x USING (doc_id) LEFT JOIN told USING (doc_id)
"""

OP6 = r"""
WITH base AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS i FROM base),
named AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 12], ' ')) AS s FROM windows),
repeats AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS least FROM named) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM repeats),
words AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM base),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (doc_id)
"""
