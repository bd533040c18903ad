"""Queries that run the findings' functions over strings made of the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import advisories, analysis, chat, keywords, packages, severity, text
from brindle.functions.severity import lookup
from brindle.operators import ordering, relational, sampling
from brindle.plans.base import query, table

ECOSYSTEM = "CASE p_size % 4 WHEN 0 THEN 'maven' WHEN 1 THEN 'npm' WHEN 2 THEN 'pip' ELSE 'other' END"


def ecosystem():
    s = F.col("p_size") % 4
    return F.when(s == 0, "maven").when(s == 1, "npm").when(s == 2, "pip").otherwise("other")


def sql_snippet(v: str) -> str:
    return f"""CASE {ECOSYSTEM} WHEN 'maven' THEN 'implementation("' || p_name || ':' || {v} || '")' WHEN 'npm' THEN '"' || p_name || '": "^' || {v} || '"' WHEN 'pip' THEN p_name || '==' || {v} ELSE 'Upgrade ' || p_name || ' to version ' || {v} END"""


@query(f"""
SELECT p_partkey, CAST(1.0 AS DOUBLE) AS confidence, 'Upgrade ' || p_name || ' from 1.0 to ' || p_size || ' to fix security vulnerability' AS description, {sql_snippet("p_size")} AS fixed_code,
 CASE WHEN p_partkey % 2 = 0 THEN {sql_snippet("(p_size + 1)")} ELSE '' END AS alternatives FROM part
""")
def upgrade_fixes(spark, d):
    """The upgrade of each part, and of every second one an alternative."""
    fixed = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(", ", "p_size", F.col("p_size") + 1)).otherwise(F.col("p_size").cast("string"))
    fix = packages.upgrade_fix(F.col("p_name"), F.lit("1.0"), fixed, ecosystem())
    rows = table(spark, d, "part").select("p_partkey", fix.alias("f"))
    return rows.select("p_partkey", "f.confidence", "f.description", "f.fixed_code", F.array_join(F.transform("f.alternatives", lambda a: a.fixed_code), "|").alias("alternatives"))


PATHS = ["'.github/workflows/' || p_name || '.yml'", "p_name || '/Dockerfile'", "'k8s/' || p_name || '.yaml'", "p_name || '.tf'", "p_name || '.yml'", "'https://e/' || p_name", "'a/build/' || p_name", "'nginx:' || p_size", "'src/' || p_size || '.kt'"]
SQL_PATH = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(PATHS)) + " END"


def path():
    return F.expr(SQL_PATH)


@query(f"""
SELECT p_partkey, CASE WHEN contains(p, '.github/workflows') THEN 'github_actions' WHEN contains(p, 'dockerfile') THEN 'dockerfile' WHEN regexp_matches(p, '\\.ya?ml$') AND contains(p, 'k8s') THEN 'kubernetes' WHEN ends_with(p, '.tf') THEN 'terraform' WHEN regexp_matches(p, '\\.ya?ml$') THEN 'yaml_config' ELSE 'config' END AS config_type,
 p_partkey % 9 NOT IN (5, 6, 7) AS is_source FROM (SELECT p_partkey, lower({SQL_PATH}) AS p FROM part)
""")
def config_types(spark, d):
    """Kinds of configuration by path, and what is no source file."""
    return table(spark, d, "part").select("p_partkey", packages.config_type(path()).alias("config_type"), packages.is_source(path()).alias("is_source"))


@query("SELECT dir, count(*) AS n, language FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'CTP' WHEN 2 THEN 'cxx' WHEN 3 THEN 'rs' ELSE 'Other' END AS dir, CASE p_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'php' WHEN 2 THEN 'cpp' WHEN 3 THEN 'rust' END AS language FROM part) GROUP BY dir, language")
def directory_languages(spark, d):
    """Parts by the language of a directory."""
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "py").when(k == 1, "CTP").when(k == 2, "cxx").when(k == 3, "rs").otherwise("Other")
    return table(spark, d, "part").select(name.alias("dir")).groupBy("dir").agg(F.count("*").alias("n")).withColumn("language", packages.directory_language(F.col("dir")))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'A workflow has more rights than it needs.' WHEN 1 THEN 'Code analysis found a flaw that attackers could use.' WHEN 2 THEN 'A container or dependency is known to be vulnerable.' WHEN 3 THEN 'Deployed infrastructure would be open to attack.' ELSE CASE WHEN o_orderstatus = 'F' THEN 'The flaw is severe.' ELSE 'The flaw should be reviewed.' END END AS impact FROM orders")
def impact_texts(spark, d):
    """Template texts by rule, tool and severity."""
    k = F.col("o_orderkey") % 5
    id_ = F.when(k == 0, "CKV_GHA_7").otherwise("other")
    tool = F.when(k == 1, "Semgrep").when(k == 2, "trivy").when(k == 3, "checkov").otherwise("zap")
    return table(spark, d, "orders").select("o_orderkey", analysis.impact(id_, F.when(F.col("o_orderstatus") == "F", "HIGH").otherwise("LOW"), tool).alias("impact"))


@query("""
WITH r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, CASE WHEN value >= 90 THEN 'HIGH' WHEN value >= 20 THEN 'LOW' END AS severity, event_type AS tool FROM events), g AS (SELECT *, coalesce(severity, 'UNKNOWN') AS s FROM r WHERE status = 'success')
SELECT (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM g) AS ok, (SELECT count(*) FROM r WHERE status = 'error') AS failed,
 (SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT s, count(*) AS n FROM g GROUP BY s)) AS by_severity, (SELECT string_agg(tool || '=' || n, ',' ORDER BY tool) FROM (SELECT tool, count(*) AS n FROM g GROUP BY tool)) AS by_tool,
 (SELECT count(*) FROM g WHERE s = 'HIGH') AS n_severe
""")
def analysis_summary(spark, d):
    """A summary of analyses in one row."""
    level = F.when(F.col("value") >= 90, "HIGH").when(F.col("value") >= 20, "LOW")
    rows = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), level.alias("severity"), F.col("event_type").alias("tool"), F.col("event_id").cast("string").alias("id"))
    said = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e.key, e.value)), ",").alias(c)
    return analysis.summary(rows).select("n", "ok", "failed", said("by_severity"), said("by_tool"), "n_severe")


@query("""
SELECT p_partkey, CASE WHEN about AND below THEN 'update_dependency' ELSE 'manual_review' END AS action, CASE WHEN about AND below THEN '2.5.0' END AS suggested_version
FROM (SELECT p_partkey, p_partkey % 2 = 0 AS about, (CAST(p_size % 4 AS INT), CAST(p_partkey % 9 AS INT), 0) < (2, 5, 0) AS below FROM part)
""")
def notice_decisions(spark, d):
    """Whether an update may settle a notice."""
    about = F.when(F.col("p_partkey") % 2 == 0, "On Attestation").otherwise("On PINs")
    current = F.concat_ws(".", F.col("p_size") % 4, F.col("p_partkey") % 9)
    return table(spark, d, "part").select("p_partkey", advisories.decision(about, current, F.lit("2.5.0")).alias("x")).select("p_partkey", "x.action", "x.suggested_version")


@query("SELECT c_custkey, c_nationkey IS NOT NULL AND c_nationkey > 3 AND c_acctbal > 0 AS all_ok, c_acctbal > 0 AS bal_ok FROM customer")
def artifact_flags(spark, d):
    """non-empty checks and all of them."""
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") - 3).alias("key"), F.col("c_acctbal").alias("bal"))
    return advisories.artifact_checks(rows, ["key", "bal"]).select("c_custkey", "all_ok", "bal_ok")


@query("SELECT a.p_partkey FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size IS NOT NULL AND a.p_size IS DISTINCT FROM b.p_size")
def digest_changes(spark, d):
    """parts whose size differs from the next one's, or that have no next."""
    parts = table(spark, d, "part")
    other = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_size").alias("target_digest"))
    return advisories.changed_images(parts.select("p_partkey", F.col("p_size").alias("source_digest")).join(other, "p_partkey", "left")).select("p_partkey")


@query("SELECT s_suppkey, CASE WHEN k < 3 THEN array_to_string(list_transform(range(0, k), lambda i: s_name || i), ', ') ELSE s_name || '0, ' || s_name || '1, ' || s_name || '2' || CASE WHEN k > 3 THEN ' +' || (k - 3) || ' more' ELSE '' END END AS uris FROM (SELECT s_suppkey, s_name, s_suppkey % 6 AS k FROM supplier)")
def joined_uris(spark, d):
    """The first three of a list and how many more."""
    n = (F.col("s_suppkey") % 6).cast("int")
    list_ = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.col("s_name"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "supplier").select("s_suppkey", text.uris(list_).alias("uris"))


@query("SELECT s_suppkey, CAST(CASE s_suppkey % 4 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey * 60 WHEN 2 THEN s_suppkey * 3600 ELSE s_suppkey * 86400 END AS BIGINT) AS seconds FROM supplier")
def durations(spark, d):
    """Durations in words as seconds."""
    unit = F.element_at(F.array(*map(F.lit, "smhd")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    interval = text.duration(F.concat(F.col("s_suppkey").cast("string"), unit))
    start = F.lit("2000-01-01").cast("timestamp")
    return table(spark, d, "supplier").select("s_suppkey", (F.unix_seconds(start + interval) - F.unix_seconds(start)).alias("seconds"))


@query("SELECT c_custkey, rtrim(translate(base64(CAST(md5(c_name) AS BLOB)), '+/', '-_'), '=') AS encoded FROM customer")
def url_safe_keys(spark, d):
    """Key material for URLs."""
    return table(spark, d, "customer").select("c_custkey", text.url_safe(F.md5("c_name").cast("binary")).alias("encoded"))


@query("SELECT o_custkey, array_to_string(list_reverse_sort(list_distinct(list(v))), ',') AS versions FROM (SELECT o_custkey, '1.' || (o_orderkey % 12) AS v FROM orders) GROUP BY o_custkey")
def versions_as_text(spark, d):
    """Distinct versions, the greatest text first."""
    rows = table(spark, d, "orders").select("o_custkey", F.concat(F.lit("1."), (F.col("o_orderkey") % 12).cast("string")).alias("v"))
    return rows.groupBy("o_custkey").agg(F.collect_list("v").alias("v")).select("o_custkey", F.array_join(text.newest_versions(F.col("v")), ",").alias("versions"))


@query("SELECT o_custkey, arg_max(o_orderpriority, (n, p)) AS priority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, -CAST(left(o_orderpriority, 1) AS INT) AS p FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def commonest_priority(spark, d):
    """Each customer's commonest priority, of equally common ones the first."""
    counts = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.groupBy("o_custkey").agg(F.min(F.struct((-F.col("n")).alias("minus"), "o_orderpriority")).alias("m")).select("o_custkey", F.col("m.o_orderpriority").alias("priority"))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, round(CAST(CASE user_id % 3 WHEN 0 THEN least(r * 1.5, 0.5) WHEN 1 THEN least(r * 1.2, 0.3) ELSE r END AS DOUBLE), 6) AS ratio FROM (SELECT DISTINCT user_id, (user_id % 50) / 100.0 AS r FROM events)")
def adapted_ratios(spark, d):
    """Replay ratios after forgetting."""
    ratio = (F.col("user_id") % 50) / F.lit(100.0)
    seen = F.when(F.col("user_id") % 3 == 0, "severe").when(F.col("user_id") % 3 == 1, "moderate").otherwise("none")
    return table(spark, d, "events").select("user_id").distinct().select("user_id", F.round(sampling.adapt_ratio(ratio, seen), 6).alias("ratio"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS BIGINT) AS place FROM documents")
def shuffled_order(spark, d):
    """Documents in a reproducible random order, ranked by range partitions."""
    rows = table(spark, d, "documents").select("doc_id").withColumn("h", ordering.seeded(42, "doc_id"))
    return ordering.shards(rows, ["h", "doc_id"], 1).select("doc_id", F.col("shard").alias("place"))


@query("SELECT coalesce(lang, 'unknown') AS kind, count(*) AS n, max(source) AS latest FROM documents GROUP BY 1")
def group_with_fallback(spark, d):
    """Groups by a key with a fallback, and the last name of each."""
    return table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"), F.max("source").alias("latest"))


@query("""
WITH e AS (SELECT conv_id, turn, text, '### Finding' || chr(10) || conv_id || ', reported by zap with severity HIGH in t' || turn || '.' || chr(10) || '### Details' || chr(10) || replace(text, chr(10), ' ') || chr(10) || '### Remediation' || chr(10) || 'Follow the fix of ' || conv_id || '.' AS story FROM conversations)
SELECT conv_id, turn, 'Describe the finding.' AS instruction, md5(trim(replace(text, chr(10), ' '))) AS response FROM e UNION ALL
SELECT conv_id, turn, 'How is it fixed?', md5('Follow the fix of ' || conv_id || '.') FROM e UNION ALL SELECT conv_id, turn, 'Tell the whole story.', md5(story) FROM e
""")
def narrative_rows(spark, d):
    """Three instruction rows of each narrative."""
    id_, where = F.col("conv_id").cast("string"), F.concat(F.lit("t"), F.col("turn").cast("string"))
    story = chat.narrative(id_, F.lit("HIGH"), F.lit("zap"), where, F.replace("text", F.lit("\n"), F.lit(" ")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.inline(chat.instructions(story))).withColumn("response", F.md5("response"))


@query("SELECT n_nationkey, concat_ws(' ', nullif(n_name, ''), CASE WHEN n_regionkey > 1 THEN 'r' || n_regionkey END) AS body, '- ' || n_name || ' (LOW): ' || left(n_name, 60) || '...' AS line FROM nation")
def embedding_texts(spark, d):
    """Texts for embedding, and lines on similar cases."""
    region = F.when(F.col("n_regionkey") > 1, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).otherwise(F.lit(""))
    return table(spark, d, "nation").select("n_nationkey", text.embedding_text(F.col("n_name"), region).alias("body"), text.similar_case(F.col("n_name"), F.lit("LOW"), F.col("n_name")).alias("line"))


@query("SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 'INFO' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'UNKNOWN' END AS risk, CASE k WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'INFO' ELSE 'MEDIUM' END AS level, CAST(CASE k WHEN 0 THEN 9.5 WHEN 1 THEN 7.5 ELSE 5.0 END AS DOUBLE) AS score FROM (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 5 AS k FROM lineitem)")
def severity_maps(spark, d):
    """Severities by risk code and level, and default scores."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    level = lookup({0: "Error", 1: "warning", 2: "note", 3: "none"}, k, "odd")
    name = lookup({0: "Critical", 1: "high"}, k, "odd")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", severity.of_risk(k.cast("string")).alias("risk"), severity.of_level(level).alias("level"), severity.default_score(name).alias("score"))


@query("SELECT p_partkey, array_to_string(list_slice(CASE p_partkey % 2 WHEN 0 THEN ['a', 'b', 'c'] ELSE ['input_validation', 'error_handling', 'defensive_programming'] END || CASE WHEN p_size > 25 THEN ['in_memory_solution', 'cache_solution'] ELSE [] END || CASE WHEN p_size > 40 THEN ['database_solution', 'microservice_solution'] ELSE [] END, 1, 5), ',') AS approaches FROM part")
def fix_approaches(spark, d):
    """Ways to fix by class and context, five at most."""
    class_ = F.when(F.col("p_partkey") % 2 == 0, "sql_injection").otherwise("other")
    name = lambda n: F.when(F.col("p_size") > n, F.lit("x"))
    found = keywords.approaches(class_, name(25), name(40), {"sql_injection": ["a", "b", "c"]})
    return table(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("approaches"))


@query("""
WITH s AS (SELECT p_partkey, 'app/' || (p_partkey % 3) || '/x' || (p_partkey % 7) || '.kt' AS path FROM part), f(file) AS (SELECT 'src/' || a || '/x' || b || '.kt' FROM range(0, 3) t(a), range(0, 7) u(b))
SELECT p_partkey, (SELECT file FROM f WHERE split_part(file, '/', 3) = split_part(path, '/', 3) ORDER BY split_part(file, '/', 2) <> split_part(path, '/', 2), length(file), file LIMIT 1) AS file FROM s
""")
def source_of_scan(spark, d):
    """Scanned paths to source files by name and shared parts."""
    k = F.col("p_partkey")
    scans = table(spark, d, "part").select("p_partkey", F.concat(F.lit("app/"), (k % 3).cast("string"), F.lit("/x"), (k % 7).cast("string"), F.lit(".kt")).alias("path"))
    files = spark.range(21).select(F.concat(F.lit("src/"), (F.col("id") % 3).cast("string"), F.lit("/x"), F.floor(F.col("id") / 3).cast("string"), F.lit(".kt")).alias("file"))
    return relational.best_source(scans, files).select("p_partkey", "file")
