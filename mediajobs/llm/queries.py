"""Queries over the test tables, one for each llm operator, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, importance, jaccard, learned, licenses, manifest, mixing, packing, pages, quality, sharding, toxicity, vectors
from .common import read


def op1_toxicity(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_mixing(spark, sf_dir):
    return mixing.digest(read(spark, sf_dir, "documents"))


def op3_exact_top_k(spark, sf_dir):
    return vectors.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


def op5_perspective_rotation(spark, sf_dir):
    return chat.rotate(read(spark, sf_dir, "conversations"))


def op6_html_extraction(spark, sf_dir):
    return pages.extract(read(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.packed(read(spark, sf_dir, "documents"))


def op8_extendible_sharding(spark, sf_dir):
    return sharding.shards(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality.digest(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op11_importance_resampling(spark, sf_dir):
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark, sf_dir):
    return manifest.verified(read(spark, sf_dir, "documents"))


def op13_learned_partitions(spark, sf_dir):
    return learned.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: crc32 in DuckDB: its table, and the sum of a text's UTF-8 bytes.
CRC_TABLE_SQL = """crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS table)"""


def crc_sql(text: str) -> str:
    """crc32 of the expression ``text``, where ``table`` of the crc relation is in scope; text without bytes isn't allowed."""
    at = f"list_transform(range(1, CAST(strlen({text}) AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {at}), lambda c, b: xor(crc.table[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
    return "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_license_scan": op4_license_scan,
    "op5_perspective_rotation": op5_perspective_rotation,
    "op6_html_extraction": op6_html_extraction,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op8_extendible_sharding": op8_extendible_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_learned_partitions": op13_learned_partitions,
}

ORACLE_SQL = {
    "op2_mixing": r"""
WITH w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                  list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents),
d AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS size,
             greatest(0.05, coalesce(greatest(0.0, 1.0 - 4.0 * (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g'))) / greatest(length(text), 1))
               * (len(list_distinct(ls)) / greatest(len(ls), 1)::DOUBLE)
               * (least(1.0, len(list_distinct(ws)) / (2.0 * sqrt(greatest(len(ws), 1)))) * (len(ws) / (len(ws) + 10.0))), 0.0))::DOUBLE AS q
      FROM w),
k AS (SELECT *, -ln((CAST('0x' || substr(md5(concat_ws('|', doc_id, coalesce(source, 'null'), size, 20240229)), 1, 13) AS BIGINT) + 1) / 4503599627370497.0::DOUBLE)
             / q AS key FROM d),
s AS (SELECT source, sum(size) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
f AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER b, 0))
               / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM s WINDOW b AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size,
             CAST(CASE WHEN level * weight >= 2 * source_size THEN 2 * source_size
                  ELSE least(2 * source_size, weight * max(CASE WHEN level * weight < 2 * source_size THEN level END) OVER ()) END AS DOUBLE) AS target FROM f),
r AS (SELECT k.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, target - epochs * source_size - before AS remains FROM r)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (epochs + CASE WHEN remains > 0 AND 2 * remains >= size THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM x
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op3_exact_top_k": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.own <> q.own AND len(c.x) = len(q.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op5_perspective_rotation": """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t
      WHERE role <> 'system' OR conv_id NOT IN (SELECT conv_id FROM t WHERE role <> 'system')),
x AS (SELECT t.*, perspective,
             '<|' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
                          ELSE 'user name=' || role END || '|>' || chr(10) AS head
      FROM t JOIN p USING (conv_id)),
y AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM x),
z AS (SELECT *, row_number() OVER w - 1 AS turn_index,
             CAST(coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM y WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, role, text))
SELECT conv_id, perspective, turn_index, role, segment, start,
       start + CASE WHEN role = perspective THEN length(head) ELSE 0 END AS mask_start,
       start + CASE WHEN role = perspective THEN length(segment) ELSE 0 END AS mask_end
FROM z
""",
    "op8_extendible_sharding": """
WITH r AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
                  lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)), 32, '0') AS bits
           FROM documents),
p AS (SELECT doc_id, bytes, d, substr(bits, 1, d) AS prefix FROM r, (SELECT unnest(range(0, 33)) AS d)),
s AS (SELECT prefix, d, sum(bytes) AS b, count(*) AS n FROM p GROUP BY prefix, d),
l AS (SELECT doc_id, bytes, min(d) AS depth FROM p JOIN s USING (prefix, d)
      WHERE b <= 1048576 OR n = 1 OR d = 32 GROUP BY doc_id, bytes)
SELECT l.doc_id, l.bytes, p.prefix AS shard, CAST(l.depth AS INT) AS depth, CAST(0 AS BIGINT) AS page
FROM l JOIN p ON p.doc_id = l.doc_id AND p.d = l.depth
""",
    "op9_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c
        FROM (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s FROM d, unnest(range(1, len(ws) - 3)) AS r(i))),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, unnest([0, 1, 2, 3, 4]) AS u(k) WHERE c > 1 GROUP BY doc_id),
f AS (
  SELECT d.doc_id, t, ls, ws, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(replace(t, '!', '')) AS bangs,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS same
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * bangs > 3 * n_words OR 100 * same > 20 * n_words
            OR 100 * len(list_distinct(ws)) < 15 * n_words OR 2 * n_dup_lines > len(ls)
            OR word_chars > 20 * n_words) AS kept
FROM b
""",
    "op11_importance_resampling": f"""
WITH {CRC_TABLE_SQL},
w AS (SELECT src, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws
      FROM (SELECT 0 AS src, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
f AS (SELECT src, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM w),
b AS (SELECT feature, {crc_sql("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f), crc),
x AS (SELECT src, id, bucket FROM f JOIN b USING (feature)),
n AS (SELECT bucket, count(*) FILTER (src = 0)::DOUBLE AS s, count(*) FILTER (src = 1)::DOUBLE AS t FROM x GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM n),
d AS (SELECT id AS doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM x JOIN g USING (bucket) WHERE src = 0 GROUP BY id),
e AS (SELECT id AS doc_id, len(ws) >= 20 AS able, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d ON d.doc_id = w.id WHERE src = 0),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () * 25 // 100 AS k FROM y)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN able AND place <= k THEN place END AS BIGINT) AS rank FROM r
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS g, {_leaf_sql("n_chars")} AS leaf,
             CASE WHEN {crc_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS tampered
      FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
nodes AS (SELECT g, 0 AS level, i, n, leaf AS hash FROM p
          UNION ALL
          SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, level, i // 2, n),
subroots AS (SELECT g, hash AS subroot, row_number() OVER (ORDER BY g) - 1 AS rank, count(*) OVER () AS langs FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, rank AS i, langs AS n, subroot AS hash FROM subroots
         UNION ALL
         SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
every AS MATERIALIZED (SELECT g, level, i, n, hash FROM nodes UNION ALL SELECT NULL, level, i, n, hash FROM tops),
climb AS (SELECT p.doc_id, leaf, p.g AS own, p.g, 0 AS level, p.i, p.n, '' AS proof, tampered AS folded FROM p
          UNION ALL
          SELECT doc_id, leaf, own, CASE WHEN c.n = 1 THEN NULL ELSE c.g END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
                 CASE WHEN c.n = 1 THEN r.rank ELSE c.i // 2 END, CASE WHEN c.n = 1 THEN r.langs ELSE (c.n + 1) // 2 END,
                 proof || coalesce(e.hash, ''),
                 CASE WHEN c.n = 1 THEN folded WHEN c.i % 2 = 1 THEN sha256(e.hash || folded) ELSE sha256(folded || coalesce(e.hash, '')) END
          FROM climb c JOIN subroots r ON r.g = c.own
          LEFT JOIN every e ON c.n > 1 AND e.g IS NOT DISTINCT FROM c.g AND e.level = c.level AND e.i = xor(c.i, 1)
          WHERE c.n > 1 OR c.g IS NOT NULL)
SELECT doc_id, leaf, subroot, (SELECT hash FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = (SELECT hash FROM tops WHERE n = 1) AS verified
FROM climb c JOIN subroots r ON r.g = c.own WHERE c.g IS NULL AND c.n = 1
""",
}
