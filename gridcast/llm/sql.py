"""DuckDB SQL that must give the same rows as the queries of the same name."""

from gridcast.llm.licenses import BASE_PHRASES, MORE_PHRASES

OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS run FROM starts),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM runs) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM again),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS run FROM starts),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM runs) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM again),
islands AS (SELECT doc_id, min(j) AS lo, max(j) AS hi
            FROM (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS g FROM gone) GROUP BY doc_id, g),
ranges AS (SELECT doc_id, string_agg((lo - 1) || ':' || hi, ',' ORDER BY lo) AS r FROM islands GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       coalesce(r, '') AS removed_words, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN ranges USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""
WITH w AS (SELECT doc_id, text, {_PLAIN} AS ws FROM documents),
phrase(p, label, base) AS (VALUES {{phrases}}),
split AS (SELECT string_split(p, ' ') AS ps, label, base FROM phrase),
word AS (SELECT doc_id, ws, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
hit AS (SELECT doc_id, i, label, base FROM word JOIN split ON word = ps[1] AND ws[i + 1:i + len(ps)] = ps),
found AS (SELECT doc_id, count(*) FILTER (base) AS n, min(i) FILTER (base) AS lo, max(i) FILTER (base) AS hi,
                 array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
                 array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
                 count(DISTINCT label) FILTER (base) AS b, count(DISTINCT label) AS a
          FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo AS first_word, hi AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN a IS NULL THEN 0.0 ELSE round(1.0 - pow(0.2::DOUBLE, b) * pow(0.4::DOUBLE, a - b), 6) END AS score
FROM w LEFT JOIN found USING (doc_id)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
b AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark),
win AS (SELECT item_id, ws[i:i + least(10, len(ws)) - 1] AS w
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
word AS (SELECT doc_id, ws, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
hit AS (SELECT DISTINCT doc_id, i, len(w) AS n, item_id FROM word JOIN win ON word = w[1] AND ws[i:i + len(w) - 1] = w),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (gram)
          WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT DISTINCT x AS node, x AS root FROM link UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = w.doc_id
"""

OP5 = r"""
WITH RECURSIVE
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT DISTINCT x AS node, x AS root FROM link UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id,
       coalesce(root, vec_id) = vec_id AS kept
FROM v LEFT JOIN comp ON node = vec_id LEFT JOIN n ON x = vec_id
"""

OP11 = rf"""
WITH RECURSIVE
d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
b AS (SELECT {_PLAIN} AS ws FROM benchmark),
crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i) ORDER BY i) AS t
              FROM (SELECT unnest(range(256)) AS i)),
gram AS (SELECT DISTINCT unnest(ws) AS g FROM d UNION SELECT DISTINCT unnest(ws) FROM b),
bytes AS (SELECT g, list_transform(range(1, length(hex(encode(g))) + 1, 2), lambda i: ('0x' || hex(encode(g))[i:i + 1])::BIGINT) AS bs FROM gram),
bucket AS (SELECT g, xor(list_reduce(bs, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k
           FROM bytes, crc_table),
s AS (SELECT k, count(*) AS n FROM (SELECT unnest(ws) AS g FROM d) JOIN bucket USING (g) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM (SELECT unnest(ws) AS g FROM b) JOIN bucket USING (g) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
                / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS v
         FROM s FULL JOIN t USING (k)),
sums AS (SELECT doc_id, sum(v) AS total FROM (SELECT doc_id, unnest(ws) AS g FROM d) JOIN bucket USING (g) JOIN gain USING (k) GROUP BY doc_id),
noise AS (SELECT doc_id, len(ws) AS n, CASE WHEN len(ws) > 0 THEN floor(total::DOUBLE / len(ws))::BIGINT ELSE 0 END AS weight,
                 ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h
          FROM d LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM noise),
placed AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place,
                  count(*) OVER (PARTITION BY n >= 20) AS able FROM scored)
SELECT doc_id, n::BIGINT AS n_features, weight, score,
       CASE WHEN n >= 20 AND place <= 10 * able // 100 THEN place END AS rank
FROM placed
"""

OP12 = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us FROM documents),
c AS (SELECT doc_id, text, us, len(us) AS n, ('0x' || h[1:8])::BIGINT % (len(us) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(us) + 1) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:least(a, b)], '') AS pre, array_to_string(us[least(a, b) + 1:greatest(a, b)], '') AS mid,
             array_to_string(us[greatest(a, b) + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def _phrases() -> str:
    rows = [(p, x, True) for p, x in BASE_PHRASES.items()] + [(p, x, False) for p, x in MORE_PHRASES.items()]
    return ", ".join(f"('{p}', '{x}', {base})" for p, x, base in rows)


SQL = {
    # without identifier tags, of which the tables hold none; tests compare those by brute force
    "op4_licenses": OP4.replace("{phrases}", _phrases()),
    "op2_suffix_dedup": OP2,
    "op5_embedding_dedup": OP5,
    "op6_substring_dedup": OP6,
    "op8_decontamination": OP8,
    "op10_ngram_join": OP10,
    "op11_resampling": OP11,
    "op12_infill": OP12,
}
