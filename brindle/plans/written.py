"""Queries that write sources, diffs and paths from the words of every document and read them with the functions for such texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import code, packages
from brindle.operators import relational
from brindle.plans.base import query, table
from brindle.sources import corpora, reports

LETTERS = "[A-Za-z]+"
#: doc_id, i (from 1) and w of each word, n words in all.
SQL_WORDS = f"""
SELECT doc_id, n, unnest(ws) AS w, unnest(range(1, n + 1)) AS i FROM (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(text, '{LETTERS}') AS ws FROM documents WHERE text IS NOT NULL)) WHERE n > 0
"""


def words(spark, d) -> DataFrame:
    """doc_id and ws of each document with a word."""
    found = F.regexp_extract_all("text", F.lit(f"({LETTERS})"), 1)
    return table(spark, d, "documents").filter(F.col("text").rlike("[A-Za-z]")).select("doc_id", found.alias("ws"))


def lines(rows: DataFrame, line: str, *columns: str) -> DataFrame:
    """doc_id, columns and body: a line for each word, ``line`` being SQL over w and i (from 0)."""
    return rows.select("doc_id", *columns, F.expr(f"array_join(transform(ws, (w, i) -> {line}), '\\n')").alias("body"))


@query(f"""
WITH l AS (SELECT doc_id, n, i, strlen(w) AS deep, i % 3 <> 0 AS is_def, w || i AS name, 1 + doc_id % n AS target FROM ({SQL_WORDS})),
above AS (SELECT *, min(deep) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM l WHERE i <= target),
best AS (SELECT doc_id, max(i) AS f FROM above WHERE is_def AND (i = target OR deep < least) GROUP BY doc_id),
own AS (SELECT l.* FROM l JOIN best ON l.doc_id = best.doc_id AND l.i = f),
ends AS (SELECT own.doc_id, min(l.i) AS e FROM own JOIN l ON l.doc_id = own.doc_id AND l.i > own.i AND l.deep <= own.deep GROUP BY own.doc_id)
SELECT d.doc_id, own.name AS function_name, CAST(own.i + 1 AS INTEGER) AS function_start, CAST(CASE WHEN own.i IS NOT NULL THEN coalesce(e, d.n + 1) END AS INTEGER) AS function_end, 'D' || d.doc_id AS class_name
FROM (SELECT DISTINCT doc_id, n FROM l) d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN ends ON ends.doc_id = d.doc_id
""")
def scopes_in_texts(spark, d):
    """The function around a line of a class of nested functions, one line a word, as deep as the word is long."""
    line = "concat(repeat(' ', length(w)), if(i % 3 = 2, 'x = 1', concat('def ', w, i + 1, '():')))"
    rows = lines(words(spark, d), line, F.expr("cast(2 + doc_id % size(ws) as int)").alias("line"))
    source = F.concat(F.lit("class D"), "doc_id", F.lit(":\n"), "body")
    found = rows.select("doc_id", source.alias("source"), "line", F.lit("python").alias("language"))
    return found.select("doc_id", code.code_scope("source", "line", "language").alias("c")).select("doc_id", "c.function_name", "c.function_start", "c.function_end", "c.class_name")


@query(f"""
SELECT doc_id, count(*) AS files, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted
FROM (SELECT doc_id, w, arg_max(strlen(w) + i, i) AS added, arg_max(CASE WHEN i % 2 = 1 THEN i - 1 ELSE 0 END, i) AS deleted FROM ({SQL_WORDS}) GROUP BY doc_id, w) GROUP BY doc_id
""")
def numstats_of_texts(spark, d):
    """The totals of numbers of a diff in which each word is a file; of a repeated one the last line counts."""
    rows = lines(words(spark, d), "concat_ws('\\t', length(w) + i + 1, if(i % 2 = 0, string(i), '-'), w)")
    return relational.numstats(rows, "doc_id", "body").groupBy("doc_id").agg(F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


SUFFIX = "CASE length(w) % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.kt' WHEN 2 THEN '.rs' WHEN 3 THEN '.go' WHEN 4 THEN '' ELSE '.odd' END"


@query(f"""
WITH s AS (SELECT doc_id, {SUFFIX} AS suffix, count(*) AS n FROM ({SQL_WORDS}) GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS paths, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, suffix) AS k FROM s)
SELECT doc_id, CAST(paths AS INTEGER) AS paths, CASE suffix WHEN '.py' THEN 'Python' WHEN '.kt' THEN 'Kotlin' WHEN '.rs' THEN 'Rust' WHEN '.go' THEN 'Go' ELSE 'Other' END AS language FROM r WHERE k = 1
""")
def languages_of_texts(spark, d):
    """The commonest language of a diff that changes a file for each word."""
    rows = lines(words(spark, d), f"concat('--- a/', w, '\\n+++ b/d', i, '/', w, {SUFFIX}, '\\n+', w)")
    return rows.select("doc_id", F.size(packages.changed_paths(F.col("body"))).alias("paths"), packages.diff_language(F.col("body")).alias("language"))


TOOL = "CASE length(w) % 7 WHEN 0 THEN 'Trivy' WHEN 1 THEN 'checkov-out' WHEN 2 THEN 'SEMGREP' WHEN 3 THEN 'osv' WHEN 4 THEN 'zap/trivy' ELSE 'other' END"
END = "CASE (i + length(w)) % 5 WHEN 0 THEN '.sarif' WHEN 1 THEN '.JSON' WHEN 2 THEN '.json' WHEN 3 THEN '.SARIF' ELSE '.sarif.txt' END"


@query(f"""
SELECT tool, count(*) AS n, count(DISTINCT path) AS paths FROM (SELECT path, CASE WHEN is_sarif AND path LIKE '%trivy%' THEN 'trivy' WHEN is_sarif AND path LIKE '%checkov%' THEN 'checkov'
 WHEN is_json AND path LIKE '%semgrep%' THEN 'semgrep' WHEN is_json AND path LIKE '%osv%' THEN 'osv' WHEN is_json AND path LIKE '%zap%' THEN 'zap' END AS tool
 FROM (SELECT path, path LIKE '%.sarif' AS is_sarif, path LIKE '%.json' AS is_json FROM (SELECT lower(doc_id || '/' || {TOOL} || '/' || w || {END.replace('i +', 'i - 1 +')}) AS path FROM ({SQL_WORDS})))) GROUP BY tool
""")
def routed_words(spark, d):
    """The tools of a path for each word, folder and suffix by its length and place."""
    paths = words(spark, d).select("doc_id", F.posexplode("ws").alias("i", "w")).selectExpr(f"concat(doc_id, '/', {TOOL}, '/', w, {END}) AS path")
    return paths.withColumn("tool", reports.route(F.col("path"))).groupBy("tool").agg(F.count("*").alias("n"), F.countDistinct(F.lower("path")).alias("paths"))


KOTLIN = "CASE i % 4 WHEN 0 THEN concat('  get(\"/', w, '\") { }; post (  \"/', w, '/{id}\" ) { call(1) }') WHEN 1 THEN concat('  fetch(\"/', w, '\")') WHEN 2 THEN concat('  ', w, '(\"x\")') ELSE concat('  delete(\"/', w, '\", 1)') END"
EXPRESS = "CASE i % 4 WHEN 0 THEN concat('app.get(\\'/', w, '\\', (q, r) => r.send(1)); router . put(\"/', w, '\", h)') WHEN 1 THEN concat(w, '.post(\"/p\", h)') WHEN 2 THEN concat('router.delete(\"/', w, '\")') ELSE concat('const ', w, ' = 1') END"
METHODS = "('get', 'post', 'put', 'delete', 'patch')"


@query(f"""
WITH l AS (SELECT doc_id, doc_id % 2 = 0 AS kt, i, (i - 1) % 4 AS k, w FROM ({SQL_WORDS})),
r AS (SELECT doc_id, i, 'GET' AS method, '/' || w AS path FROM l WHERE k = 0 UNION ALL SELECT doc_id, i, CASE WHEN kt THEN 'POST' ELSE 'PUT' END, '/' || w || CASE WHEN kt THEN '/{{id}}' ELSE '' END FROM l WHERE k = 0
 UNION ALL SELECT doc_id, i, upper(w), 'x' FROM l WHERE kt AND k = 2 AND w IN {METHODS} UNION ALL SELECT doc_id, i, 'POST', '/p' FROM l WHERE NOT kt AND k = 1 AND w IN ('app', 'router'))
SELECT doc_id || CASE WHEN doc_id % 2 = 0 THEN '.kt' ELSE '.ts' END AS file, method, count(*) AS n, CAST(min(i) AS INTEGER) AS first_line, CAST(max(i) AS INTEGER) AS last_line, min(path) AS least_path, max(path) AS greatest_path FROM r GROUP BY ALL
""")
def routes_in_texts(spark, d):
    """Routes of sources of one line a word, among calls of other names, of other receivers and with other arguments."""
    rows = words(spark, d)
    kotlin = lines(rows.filter("doc_id % 2 = 0"), KOTLIN).select(F.concat("doc_id", F.lit(".kt")).alias("file"), F.col("body").alias("value"))
    express = lines(rows.filter("doc_id % 2 <> 0"), EXPRESS).select(F.concat("doc_id", F.lit(".ts")).alias("file"), F.col("body").alias("value"))
    found = corpora.routes_in(relational.union_all(kotlin, express))
    return found.groupBy("file", "method").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min("path").alias("least_path"), F.max("path").alias("greatest_path"))


DEFINED = "CASE (length(w) + i) % 6 WHEN 0 THEN concat('class ', w) WHEN 1 THEN concat('  public final class ', w, ' {') WHEN 2 THEN concat('\\tasync def ', w, '(self):') WHEN 3 THEN concat('fun ', w, '() = 1') WHEN 4 THEN concat('// class ', w) ELSE concat(w, '.fun ', w) END"


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS file, count(*) AS lines, count(*) FILTER (k IN (0, 1)) AS classes, count(*) FILTER (k IN (2, 3)) AS functions FROM (SELECT doc_id, (strlen(w) + i - 1) % 6 AS k FROM ({SQL_WORDS})) GROUP BY doc_id
""")
def definitions_in_texts(spark, d):
    """Lines, classes and functions of sources with one line a word."""
    rows = words(spark, d).select(F.col("doc_id").cast("string").alias("file"), F.posexplode("ws").alias("i", "w"))
    return corpora.line_counts(rows.selectExpr("file", f"{DEFINED} AS value"))
