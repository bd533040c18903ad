"""The thin queries of the operators, over whole tables, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from brindle.llm import ann, codes, decontam, jaccard, language, licences, lines, packing, pii, resample, secrets, tokenfiles, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_digest(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.by_source(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sized(packing.near_clusters(table(spark, sf_dir, "documents")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_digest(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_digest(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_digest(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.digest(table(spark, sf_dir, "documents"))


BUILDERS = (
    op1_language_id, op2_personal_data, op3_toxicity, op4_secret_scan, op5_licence_scan, op6_best_fit_packing, op7_jaccard_join,
    op8_line_dedup, op9_decontamination, op10_nearest_neighbours, op11_vector_codes, op12_importance_resampling, op13_token_files,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in BUILDERS}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_licence_scan": op5_sql(), "op7_jaccard_join": OP7, "op8_line_dedup": OP8, "op9_decontamination": OP9,
        "op11_vector_codes": op11_sql(), "op12_importance_resampling": OP12,
    }


def op11_sql() -> str:
    """Every round unrolled: distances of all parts to all entries, the least (distance, index), floored means."""
    n, parts = codes.ENTRIES, codes.PARTS
    rounds = []
    for i in range(codes.ROUNDS + 1):
        rounds.append(f"""a{i} AS MATERIALIZED (SELECT id, p, any_value(v) AS v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS b FROM part JOIN c{i} USING (p) GROUP BY id, p)""")
        rounds.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT p, e, list(m ORDER BY k) AS c
 FROM (SELECT p, e, k, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT p, b.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM a{i}) GROUP BY ALL) GROUP BY ALL) n USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, id - 1 AS e, v AS c FROM part WHERE id <= {n}),
{", ".join(rounds[:-1])},
done AS (SELECT id, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{codes.ROUNDS}) AS codebooks_sha256
FROM kept JOIN done USING (id)
"""


def op5_sql() -> str:
    vectors, idf, other = licences.template_vectors()
    text = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    values = lambda rows: ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return rf"""
WITH vec(template, licence, word, weight) AS (VALUES {values(vectors)}), idf(word, idf) AS (VALUES {values(sorted(idf.items()))}),
doc AS (SELECT doc_id, concat_ws('/', dir, doc_id || '.txt') AS path, dir, text FROM (SELECT doc_id, text, concat_ws('/', source, CASE WHEN doc_id % 100 <> 50 THEN CAST(doc_id // 1000 AS VARCHAR) END, CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id // 100 AS VARCHAR) END) AS dir FROM documents)),
cue AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{licences.TOKEN}')) AS doc_words, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: regexp_matches(s, '{licences.CUE}'))) AS sentence FROM doc WHERE regexp_matches(text, '{licences.CUE}')),
tf AS (SELECT sentence, word, count(*) AS tf FROM (SELECT sentence, unnest(regexp_extract_all(lower(sentence), '{licences.TOKEN}')) AS word FROM (SELECT DISTINCT sentence FROM cue)) GROUP BY ALL),
w AS (SELECT sentence, word, tf, tf * coalesce(idf, {other!r}) AS w FROM tf LEFT JOIN idf USING (word)),
norm AS (SELECT sentence, sqrt(sum(w * w)) AS norm, sum(tf) AS words FROM w GROUP BY sentence),
dot AS (SELECT sentence, template, licence, sum(w * weight) AS dot FROM w JOIN vec USING (word) GROUP BY ALL),
best AS (SELECT sentence, words, round(dot / norm, 6) AS cosine, licence FROM dot JOIN norm USING (sentence) QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY round(dot / norm, 6) DESC, licence) = 1),
hit AS (SELECT DISTINCT doc_id, doc_words, sentence, words, licence, cosine FROM cue JOIN best USING (sentence) WHERE cosine >= {licences.THRESHOLD}),
own AS (SELECT doc_id, max(cosine) AS score, arg_min(licence, (-cosine, licence)) AS licence, sum(words) >= {licences.FILE_SHARE} * max(doc_words) AS is_file, count(*) AS n FROM hit GROUP BY doc_id),
giver AS (SELECT dir, arg_min(own.licence, (-score, own.licence)) AS dir_licence, max(score) AS dir_score FROM own JOIN doc USING (doc_id) WHERE is_file GROUP BY dir),
near AS (SELECT d.dir, arg_max(dir_licence, length(g.dir)) AS dir_licence, arg_max(dir_score, length(g.dir)) AS dir_score FROM (SELECT DISTINCT dir FROM doc) d JOIN giver g ON d.dir = g.dir OR starts_with(d.dir, g.dir || '/') GROUP BY d.dir)
SELECT doc_id, path, coalesce(licence, dir_licence, '') AS licence, CASE WHEN is_file THEN 'file' WHEN licence IS NOT NULL THEN 'header' WHEN dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
 coalesce(score, dir_score, 0.0) AS score, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences FROM doc LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)
"""


OP8 = r"""
WITH l AS (SELECT doc_id AS d, CAST(i - 1 AS INT) AS line, list_sort(list_distinct(list_filter(string_split(x[i], ' '), lambda w: w <> ''))) AS ws
           FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(translate(lower(text), chr(9) || chr(13) || chr(11) || chr(12), '    '), chr(10)) AS x FROM documents WHERE text <> ''))),
lines AS (SELECT d, line, ws, len(ws) AS n FROM l WHERE len(ws) >= 1),
class AS (SELECT ws, any_value(n) AS n, min((d, line)) AS first FROM lines GROUP BY ws),
tok AS (SELECT first, n, unnest(ws) AS w FROM class), df AS (SELECT w, count(*) AS df FROM tok GROUP BY w),
pre AS (SELECT first, n, w FROM tok JOIN df USING (w) QUALIFY row_number() OVER (PARTITION BY first ORDER BY df, w) <= n - ceil(n * 0.8 - 1e-9) + 1),
cand AS (SELECT DISTINCT a.first AS a, b.first AS b FROM pre a JOIN pre b ON a.w = b.w AND a.first < b.first AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
alike AS (SELECT DISTINCT b FROM cand JOIN class x ON a = x.first JOIN class y ON b = y.first WHERE 180 * len(list_intersect(x.ws, y.ws)) >= 80 * (x.n + y.n)),
gone AS (SELECT d AS doc_id, list(line ORDER BY line) AS g FROM lines JOIN class USING (ws) WHERE (d, line) <> first OR first IN (SELECT b FROM alike) GROUP BY d)
SELECT doc_id, CAST(coalesce(len(g), 0) AS BIGINT) AS n_gone, coalesce(array_to_string(g, ','), '') AS gone_lines,
 sha256(CASE WHEN g IS NULL THEN coalesce(text, '') ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(g, i - 1)), chr(10)) END) AS text_sha256
FROM documents LEFT JOIN gone USING (doc_id)
"""

OP9 = r"""
WITH doc AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, r.n, p FROM runs r JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE doc AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 4) - 1], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS p FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN size a ON x = a.doc_id JOIN size b ON y = b.doc_id WHERE 100 * c >= 85 * (a.n + b.n - c)),
ends AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS a, y AS b FROM ends UNION SELECT r.a, e.y FROM reach r JOIN ends e ON r.b = e.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""

OP12 = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
doc AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT row_number() OVER () AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
feature AS MATERIALIZED (SELECT id, true AS own, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM doc
 UNION ALL SELECT id, false, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM item),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feature)),
crc AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
 lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]))) % 10000 AS bucket FROM hexed, t),
count AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM feature JOIN crc USING (f) GROUP BY bucket),
total AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM count),
gain AS (SELECT bucket, CAST(floor(1000 * ln((c.t + 1) * (total.s + 10000) / ((c.s + 1) * (total.t + 10000)))) AS BIGINT) AS g FROM count c, total),
weight AS (SELECT id, count(*) AS n, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM feature JOIN crc USING (f) JOIN gain USING (bucket) WHERE own GROUP BY id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM doc LEFT JOIN weight USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""
