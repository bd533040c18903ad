"""Queries of token counts, keyword search, changes, similarity, shards, routes and paths over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.tokens import with_token_counts
from brindle.operators import changes, evaluation, relational, shards
from brindle.operators.search import mentions
from brindle.plans.base import query, table
from brindle.sources import databases
from brindle.storage import cut, scratch

MOST_TOKENS = 2048
TARGET = 200_000


@query()
def bpe_token_lengths(spark, d):
    """Documents of at most 2048 tokens of a published byte-level vocabulary, and how many they have."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return with_token_counts(docs, "text", "tokens", keep=["doc_id"]).filter(F.col("tokens") <= MOST_TOKENS)


@query()
def bpe_token_stats(spark, d):
    """The range of token counts of conversations' turns and what a limit of 2048 would drop."""
    counted = with_token_counts(table(spark, d, "conversations").select("text"), "text", "tokens", keep=[])
    return relational.token_stats(counted, "tokens", MOST_TOKENS).withColumn("mean", F.round("mean", 6))


@query("""
WITH k AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS k FROM benchmark UNION SELECT DISTINCT lower(p_name) FROM part UNION SELECT DISTINCT lower(p_type) FROM part),
body AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT k, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM body JOIN k ON contains(t, k) GROUP BY k
""")
def keyword_mentions(spark, d):
    """Of each benchmark word and part name the documents that hold it, anywhere; one pass over the texts for all of them."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("k"))
    parts = table(spark, d, "part")
    words = words.unionByName(parts.select(F.lower("p_name").alias("k"))).unionByName(parts.select(F.lower("p_type").alias("k")))
    return mentions(docs, "t", words, ["doc_id"]).groupBy("k").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def lcs_sql(a: str, b: str) -> str:
    """The length of a longest common subsequence of two lists, in DuckDB: rows of the usual table, one after another."""
    start = f"list_transform(range(len({b}) + 1), lambda j: 0::BIGINT)"
    row = f"list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len({b}) + 1), lambda j: [j])), lambda acc, j: list_append(acc, greatest(acc[-1], up[j[1] + 1], CASE WHEN {a}[x[1]] = {b}[j[1]] THEN up[j[1]] + 1 ELSE 0 END)))"
    return f"list_reduce(list_prepend({start}, list_transform(range(1, len({a}) + 1), lambda i: [i])), lambda up, x: {row})[-1]"


@query(f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
v AS (SELECT doc_id, a, list_transform(list_filter(a, lambda x: length(x) % 7 <> 3), lambda x: CASE WHEN length(x) % 5 = 0 THEN x || '!' ELSE x END) || [a[1]] AS b FROM l),
n AS (SELECT doc_id, len(a) AS a, len(b) AS b, {lcs_sql("a", "b")} AS common FROM v)
SELECT doc_id, CAST(a - common AS INT) AS n_removed, CAST(b - common AS INT) AS n_added, true AS restored FROM n
""")
def edited_documents(spark, d):
    """The changes from each document to an edited one: lines left out, lines altered, the first put at the end. Applied to the one they give the other."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.transform(F.filter(lines, lambda x: F.length(x) % 7 != 3), lambda x: F.when(F.length(x) % 5 == 0, F.concat(x, F.lit("!"))).otherwise(x))
    edited = F.array_join(F.concat(kept, F.slice(lines, 1, 1)), "\n")
    docs = table(spark, d, "documents").select("doc_id", "text", edited.alias("edited"))
    found = changes.with_changes(docs, "text", "edited", ["doc_id", "text", "edited"])
    restored = changes.applied(F.col("text"), F.col("changes")) == F.col("edited")
    return found.select("doc_id", changes.n_removed(F.col("changes")).alias("n_removed"), changes.n_added(F.col("changes")).alias("n_added"), restored.alias("restored"))


def _grams(side: str, n: int) -> str:
    return f"SELECT conv_id, turn, {n} AS n, array_to_string({side}[i : i + {n - 1}], chr(0)) AS g, count(*) AS c FROM (SELECT conv_id, turn, {side}, unnest(range(1, len({side}) - {n} + 2)) AS i FROM p WHERE len({side}) >= {n}) GROUP BY ALL"


@query(f"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]') AS w FROM conversations),
p AS (SELECT x.conv_id, x.turn, x.w AS a, y.w AS b FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
ga AS ({" UNION ALL ".join(_grams("a", n) for n in range(1, 5))}), gb AS ({" UNION ALL ".join(_grams("b", n) for n in range(1, 5))}),
m AS (SELECT conv_id, turn, sum(least(ga.c, gb.c)) FILTER (n = 1) AS m1, sum(least(ga.c, gb.c)) FILTER (n = 2) AS m2, sum(least(ga.c, gb.c)) FILTER (n = 3) AS m3, sum(least(ga.c, gb.c)) FILTER (n = 4) AS m4 FROM ga JOIN gb USING (conv_id, turn, n, g) GROUP BY ALL),
c AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, {lcs_sql("a", "b")} AS common, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(m3, 0) AS m3, coalesce(m4, 0) AS m4 FROM p LEFT JOIN m USING (conv_id, turn))
SELECT conv_id, turn, common, CAST(m1 AS BIGINT) AS matched_1, CAST(m4 AS BIGINT) AS matched_4, round(CASE WHEN na + nb > 0 THEN 2.0::DOUBLE * common / (na + nb) ELSE 1 END, 6) AS ratio,
 round(CASE WHEN na + nb = 0 THEN 1 WHEN m1 = 0 THEN 0 ELSE exp((ln(m1 / na) + ln((m2 + 1) / (greatest(na - 1, 0) + 1)) + ln((m3 + 1) / (greatest(na - 2, 0) + 1)) + ln((m4 + 1) / (greatest(na - 3, 0) + 1))) / 4)
  * CASE WHEN na < nb THEN exp(1 - nb / na) ELSE 1 END END, 6) AS score FROM c
""")
def turn_similarity(spark, d):
    """Each turn of a conversation against the next: common tokens, clipped matches of one and four tokens, and both scores."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected"))
    pairs = turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", "text", "expected")
    found = evaluation.token_overlap(pairs, "text", "expected", ["conv_id", "turn"])
    matched = lambda n: F.get("matches", F.lit(n - 1)).alias(f"matched_{n}")
    return found.select("conv_id", "turn", "common", matched(1), matched(4), F.round(evaluation.common_ratio(), 6).alias("ratio"), F.round(evaluation.precision_score(), 6).alias("score"))


@query(f"""
WITH RECURSIVE r AS (SELECT doc_id, size, sum(size) OVER (ORDER BY doc_id, source) AS upto FROM (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) AS size FROM documents)),
c AS (SELECT doc_id, size, CASE WHEN size = 0 OR (upto - size) // {TARGET // 16} = (upto - 1) // {TARGET // 16} THEN 2 * ((upto - size) // {TARGET // 16}) ELSE 2 * ((upto - size) // {TARGET // 16}) + 1 END AS cell FROM r),
n AS (SELECT cell, sum(size) AS size, row_number() OVER (ORDER BY cell) AS i FROM c GROUP BY cell),
f AS (SELECT i, cell, 0::BIGINT AS shard, size AS held FROM n WHERE i = 1 UNION ALL SELECT n.i, n.cell, CASE WHEN held > 0 AND held + size > {TARGET} THEN shard + 1 ELSE shard END, CASE WHEN held > 0 AND held + size > {TARGET} THEN size ELSE held + size END FROM f JOIN n ON n.i = f.i + 1),
total AS (SELECT max(shard) + 1 AS n FROM f)
SELECT printf('train-%05d-of-%05d', shard, (SELECT n FROM total)) AS name, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS bytes, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM c JOIN f USING (cell) GROUP BY shard
""")
def shards_by_bytes(spark, d):
    """Documents in shards of 200,000 bytes of text at most, in order of their ids."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    named = shards.by_bytes(docs, ["doc_id", "source"], F.col("size"), TARGET).withColumn("name", shards.shard_name(F.col("shard"), F.col("n_shards")))
    return named.groupBy("name").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


PATH = "^https?://[^/]+(/[^?#]*)"


@query(f"""
WITH p AS (SELECT page_id, regexp_extract(url, '{PATH}', 1) AS path FROM pages),
r AS (SELECT DISTINCT regexp_replace(path, '[0-9]+', '{{id}}') AS route FROM p UNION SELECT path FROM p WHERE page_id % 10 = 0 UNION SELECT regexp_replace(path, '^/[^/]+', '/:lang') FROM p WHERE page_id % 3 = 0),
x AS (SELECT route, '^' || regexp_replace(regexp_replace(route, '([.+*?^$()|\\[\\]\\\\])', '\\\\\\1', 'g'), '\\{{[^/}}]+\\}}|:[^/]+', '[^/]+', 'g') || '$' AS pattern FROM r),
f AS (SELECT DISTINCT path, route FROM (SELECT DISTINCT path FROM p) JOIN x ON path = route OR regexp_matches(path, pattern)),
best AS (SELECT path, route FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY path <> route, length(route), route) = 1)
SELECT page_id, path, route FROM p LEFT JOIN best USING (path)
""")
def page_routes(spark, d):
    """pages' paths to routes made of all pages' own paths, with placeholders for numbers and languages, by an equality join."""
    paths = table(spark, d, "pages").select("page_id", F.regexp_extract("url", PATH, 1).alias("path"))
    numbered = paths.select(F.regexp_replace("path", "[0-9]+", "{id}").alias("route"))
    routes = numbered.unionByName(paths.filter("page_id % 10 = 0").select(F.col("path").alias("route"))).unionByName(paths.filter("page_id % 3 = 0").select(F.regexp_replace("path", "^/[^/]+", "/:lang").alias("route")))
    return relational.match_routes(paths, routes).select("page_id", "path", "route")


@query("""
WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
scan AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '/home/runner/work/app/app/' || w[1] || '/' || w[2] || '.kt' WHEN 1 THEN '/x/github/workflows/' || w[1] || '.yml' WHEN 2 THEN 'github/workflows/' || w[2] || '.yml'
 WHEN 3 THEN w[1] || '/' || w[2] || '.kt' WHEN 4 THEN '/srv/' || w[2] || '/' || w[1] || '/index.ts' ELSE '/opt/' || w[1] || '.kt' END AS path FROM s),
file AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN w[1] || '/' || w[2] || '.kt' WHEN 1 THEN '.github/workflows/' || w[1] || '.yml' WHEN 2 THEN 'web/' || w[1] || '/index.ts' ELSE 'src/' || w[2] || '/' || w[1] || '.kt' END AS file FROM s WHERE p_partkey % 5 <> 2),
q AS (SELECT DISTINCT path, string_split(path, '/') AS x FROM scan),
cand AS (SELECT path, 0 AS k, 'checkout' AS how, array_to_string(string_split(regexp_replace(path, '^.*/runner/work/', ''), '/')[3:], '/') AS c FROM q WHERE contains(path, '/runner/work/')
 UNION ALL SELECT path, 1, 'workflow', '.github/workflows/' || regexp_replace(path, '^.*/github/workflows/', '') FROM q WHERE contains(path, '/github/workflows/') UNION ALL SELECT path, 1, 'workflow', '.' || path FROM q WHERE starts_with(path, 'github/workflows/')
 UNION ALL SELECT path, 2, 'relative', path FROM q WHERE NOT starts_with(path, '/') UNION ALL SELECT path, 3, 'name', x[-1] FROM q UNION ALL SELECT path, 4, 'end', array_to_string(x[-2:], '/') FROM q WHERE len(x) > 2 UNION ALL SELECT path, 5, 'end', array_to_string(x[-3:], '/') FROM q WHERE len(x) > 3),
ends AS (SELECT file, array_to_string(y[i:], '/') AS e FROM (SELECT file, string_split(file, '/') AS y FROM file), range(1, 20) t(i) WHERE i <= len(y)),
near AS (SELECT path, 1000 + i - 1 AS k, 'suffix' AS how, file FROM (SELECT path, i, array_to_string(x[i:], '/') AS e FROM q, range(1, 20) t(i) WHERE i <= len(x)) JOIN ends USING (e) WHERE e <> ''),
best AS (SELECT path, how, file FROM (SELECT path, k, how, file FROM cand JOIN file ON c = file UNION ALL SELECT * FROM near) QUALIFY row_number() OVER (PARTITION BY path ORDER BY k, how, length(file), file) = 1)
SELECT p_partkey, path, file, how FROM scan LEFT JOIN best USING (path)
""")
def resolved_sources(spark, d):
    """Paths as scanners write them to files of a source tree, by five rules and then by the longest common end."""
    w, k = F.split("p_name", " "), F.col("p_partkey")
    parts = table(spark, d, "part").select("p_partkey", F.get(w, F.lit(0)).alias("a"), F.get(w, F.lit(1)).alias("b"))
    path = (
        F.when(k % 6 == 0, F.format_string("/home/runner/work/app/app/%s/%s.kt", "a", "b")).when(k % 6 == 1, F.format_string("/x/github/workflows/%s.yml", "a")).when(k % 6 == 2, F.format_string("github/workflows/%s.yml", "b"))
        .when(k % 6 == 3, F.format_string("%s/%s.kt", "a", "b")).when(k % 6 == 4, F.format_string("/srv/%s/%s/index.ts", "b", "a")).otherwise(F.format_string("/opt/%s.kt", "a"))
    )
    file = (
        F.when(k % 4 == 0, F.format_string("%s/%s.kt", "a", "b")).when(k % 4 == 1, F.format_string(".github/workflows/%s.yml", "a"))
        .when(k % 4 == 2, F.format_string("web/%s/index.ts", "a")).otherwise(F.format_string("src/%s/%s.kt", "b", "a"))
    )
    return relational.resolve_sources(parts.select("p_partkey", path.alias("path")), parts.filter("p_partkey % 5 <> 2").select(file.alias("file")))


@query("""
SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(DISTINCT c_nationkey) AS nations
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus
""")
def database_orders(spark, d):
    """Orders written to database files and read from them, with the conditions left to the files, joined to customers."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    paths = databases.write_tables(orders, scratch(spark), "orders")
    with databases.pushing_down(spark):
        read = cut(databases.read_tables(spark, paths, "orders", orders.schema).filter("o_totalprice > 100000 and o_orderstatus in ('F', 'O')"))
    joined = read.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.count_distinct("c_nationkey").alias("nations"))
