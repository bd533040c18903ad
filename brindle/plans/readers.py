"""Queries that run the readers: reports are built as JSON text from the tables' rows, fifty rows a report, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle import schemas
from brindle.functions import advisories, text
from brindle.operators import relational
from brindle.plans.base import query, table
from brindle.sources import corpora, reports

REPORT = "CAST(floor(p_partkey / 50) AS BIGINT)"


def report_texts(spark, d, tool: str, suffix: str, item: str, whole: str, name: str = "items") -> DataFrame:
    """file, body: a report for each fifty parts; ``item`` is a row's entry, ``whole`` the report around the list of them."""
    rows = table(spark, d, "part").select(F.expr(REPORT).alias("report"), F.expr(item).alias("item"))
    lists = rows.groupBy("report").agg(F.collect_list("item").alias(name))
    return lists.select(F.concat(F.lit(f"reports/{tool}/"), "report", F.lit(suffix)).alias("file"), F.to_json(F.expr(whole)).alias("body"))


# Trivy
TRIVY_RULES = "array(" + ", ".join(f"named_struct('id', 'R{i}', 'name', 'Rule {i}', 'properties', named_struct('security-severity', '{s}'))" for i, s in enumerate(("9.8", "7.0", "4.0", "0.1", "n/a"))) + ")"
LEVEL = "CASE p_partkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'note' ELSE 'none' END"
FIXED = "CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN '2.' || p_size || ' [more' WHEN p_partkey % 7 = 0 THEN '2.' || p_size || ',' ELSE '2.' || p_size || ', 3.0' END"
TRIVY_ITEM = f"""named_struct('ruleId', 'R' || p_partkey % 6, 'level', {LEVEL}, 'message', named_struct('text', concat('Package: lib-', p_partkey, '\\nInstalled Version: 1.', p_size, '\\nSeverity: any\\nFixed Version: ', {FIXED}, '\\nLink: [CVE](https://e/', p_partkey, ')')),
 'locations', array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', 'image/' || p_brand), 'region', named_struct('startLine', p_size)))),
 'properties', named_struct('security-severity', CASE WHEN p_partkey % 2 = 0 THEN '8.1' END, 'severity', CASE WHEN p_partkey % 8 = 1 THEN 'low' END))"""
SQL_FIXED = "CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN '2.' || p_size ELSE '2.' || p_size || ', 3.0' END"
SQL_LEVELS = "CASE p_partkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'UNKNOWN' END"
SQL_TRIVY = f"""SELECT 'trivy' AS tool, 'R' || p_partkey % 6 AS id, CASE p_partkey % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE {SQL_LEVELS} END AS severity, 'image/' || p_brand AS path,
 'lib-' || p_partkey AS package_name, '1.' || p_size AS installed_version, {SQL_FIXED} AS fixed_version, 'https://e/' || p_partkey AS url FROM part WHERE p_partkey % 3 <> 0 AND {REPORT} % 4 <> 3"""


def trivy_reports(spark, d) -> DataFrame:
    whole = f"named_struct('runs', array(named_struct('tool', named_struct('driver', named_struct('name', CASE WHEN report % 4 = 3 THEN 'Other' ELSE 'Trivy' END, 'version', '1.0', 'rules', {TRIVY_RULES})), 'results', items)))"
    return reports.captured(report_texts(spark, d, "trivy", ".sarif", TRIVY_ITEM, whole), schemas.SARIF)


@query(SQL_TRIVY)
def trivy_findings(spark, d):
    """Results with a package and a fixed version, by drivers named Trivy."""
    return reports.trivy(trivy_reports(spark, d)).select("tool", "id", "severity", "path", "package_name", "installed_version", "fixed_version", "url")


# Checkov
CHECKOV_ITEM = f"""named_struct('ruleId', 'CKV_' || p_partkey % 9, 'level', {LEVEL}, 'message', named_struct('text', p_name),
 'locations', CASE WHEN p_partkey % 4 = 1 THEN array() ELSE array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', '.github/workflows/' || p_brand || '.yml'), 'region', named_struct('startLine', p_size)))) END)"""
SQL_CHECKOV = """SELECT 'checkov' AS tool, 'CKV_' || p_partkey % 9 AS id, CASE p_partkey % 4 WHEN 0 THEN 'HIGH' WHEN 2 THEN 'LOW' ELSE 'INFO' END AS severity, '.github/workflows/' || p_brand || '.yml' AS path,
 p_size AS line, p_name AS message, 'github_actions' AS config_type, 'CKV_' || p_partkey % 9 AS rule_name FROM part WHERE p_partkey % 4 <> 1"""


def checkov_reports(spark, d) -> DataFrame:
    run = "named_struct('tool', named_struct('driver', named_struct('name', 'checkov', 'version', '3')), 'results', items)"
    return reports.captured(report_texts(spark, d, "checkov", ".sarif", CHECKOV_ITEM, f"named_struct('runs', array({run}, {run}))"), schemas.SARIF)


@query(SQL_CHECKOV)
def checkov_findings(spark, d):
    """Results of the first run that have a location."""
    return reports.checkov(checkov_reports(spark, d)).select("tool", "id", "severity", "path", F.col("start.line").alias("line"), "message", "config_type", "rule_name")


# OSV
OSV_ITEM = """named_struct('package', named_struct('name', 'pkg-' || p_partkey, 'version', '1.' || p_size, 'ecosystem', 'npm'), 'vulnerabilities', array(named_struct('id', 'OSV-' || p_partkey, 'summary', p_name,
 'severity', CASE p_partkey % 3 WHEN 0 THEN 'CVSS high ' || p_size WHEN 1 THEN NULL ELSE 'low' END,
 'affected', array(named_struct('ranges', array(named_struct('type', 'SEMVER', 'events', array(map('introduced', '0'), map('fixed', '2.' || p_size), map('fixed', '2.' || p_size), map('fixed', '3.0')))))))))"""
SQL_OSV = """SELECT 'osv-scanner' AS tool, 'OSV-' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'CVSS high ' || p_size WHEN 1 THEN 'Unknown' ELSE 'low' END AS severity, 'lock/' || CAST(floor(p_partkey / 50) AS BIGINT) AS path,
 p_name AS message, 'pkg-' || p_partkey AS package_name, '1.' || p_size AS installed_version, '2.' || p_size || ', 3.0' AS fixed_version, 'npm' AS ecosystem FROM part"""


def osv_reports(spark, d) -> DataFrame:
    whole = "named_struct('results', array(named_struct('source', named_struct('path', 'lock/' || report, 'type', 'lockfile'), 'packages', items)))"
    return reports.captured(report_texts(spark, d, "osv", ".json", OSV_ITEM, whole), schemas.OSV)


@query(SQL_OSV)
def osv_findings(spark, d):
    """A row for each vulnerability, its fixed versions in order and once each."""
    return reports.osv(osv_reports(spark, d)).select("tool", "id", "severity", "path", "message", "package_name", "installed_version", "fixed_version", "ecosystem")


# Semgrep
SEMGREP_ITEM = "named_struct('check_id', 'rules.' || p_brand, 'path', 'src/' || p_partkey || '.kt', 'start', named_struct('line', p_size, 'col', 1), 'extra', named_struct('message', p_name, 'severity', CASE WHEN p_partkey % 2 = 0 THEN 'ERROR' END, 'metadata', named_struct('cwe', 'CWE-' || p_size)))"
SQL_SEMGREP = "SELECT 'semgrep' AS tool, 'rules.' || p_brand AS id, CASE WHEN p_partkey % 2 = 0 THEN 'ERROR' END AS severity, 'src/' || p_partkey || '.kt' AS path, p_size AS line, p_name AS message, 'CWE-' || p_size AS cwe FROM part"


def semgrep_reports(spark, d) -> DataFrame:
    return reports.captured(report_texts(spark, d, "semgrep", ".json", SEMGREP_ITEM, "named_struct('version', '1.2', 'results', items)"), schemas.SEMGREP)


@query(SQL_SEMGREP)
def semgrep_findings(spark, d):
    """A row for each result."""
    return reports.semgrep(semgrep_reports(spark, d)).select("tool", "id", "severity", "path", F.col("start.line").alias("line"), "message", "cwe")


# ZAP
ZAP_ITEM = """named_struct('pluginid', CAST(p_partkey AS STRING), 'alert', p_name, 'riskcode', CASE WHEN p_partkey % 6 < 5 THEN CAST(p_partkey % 6 AS STRING) END, 'desc', '<p>' || p_type || ' &amp; more</p>', 'solution', '<b>Set</b>  it', 'cweid', CAST(p_size AS STRING),
 'instances', CASE WHEN p_partkey % 3 = 0 THEN array() ELSE array(named_struct('uri', 'https://h/' || p_partkey, 'method', 'GET'), named_struct('uri', 'https://h/x', 'method', 'PUT')) END)"""
SQL_RISK = "CASE p_partkey % 6 WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'UNKNOWN' ELSE 'INFO' END"
SQL_ZAP = f"""SELECT 'zap' AS tool, CAST(p_partkey AS VARCHAR) AS id, {SQL_RISK} AS severity, CASE WHEN p_partkey % 3 = 0 THEN 'https://site' ELSE 'https://h/' || p_partkey END AS path,
 p_type || ' & more' AS message, 'Set it' AS solution, CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE 'GET' END AS method, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS instance_count FROM part"""


def zap_reports(spark, d) -> DataFrame:
    whole = "named_struct('@version', '2.14', 'site', array(named_struct('@name', 'https://site', 'alerts', items)))"
    return reports.captured(report_texts(spark, d, "zap", ".json", ZAP_ITEM, whole), schemas.ZAP)


@query(SQL_ZAP)
def zap_findings(spark, d):
    """A row for each alert of each site."""
    return reports.zap(zap_reports(spark, d)).select("tool", "id", "severity", "path", "message", "solution", "method", "instance_count")


@query("SELECT tool, severity, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT tool, severity FROM ({q})" for q in (SQL_TRIVY, SQL_CHECKOV, SQL_SEMGREP, SQL_OSV, SQL_ZAP)) + ") GROUP BY ALL")
def findings_of_all_tools(spark, d):
    """All tools' findings in one table, repeats kept, counted by tool and severity."""
    parts = [reports.trivy(trivy_reports(spark, d)), reports.checkov(checkov_reports(spark, d)), reports.semgrep(semgrep_reports(spark, d)), reports.osv(osv_reports(spark, d)), reports.zap(zap_reports(spark, d))]
    return relational.union_all(*parts).groupBy("tool", "severity").agg(F.count("*").alias("n"))


@query(f"""
SELECT 'trivy' AS tool, CASE WHEN p_partkey % 8 = 1 THEN 'LOW' WHEN p_partkey % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'R' || p_partkey % 6 AS id, 'image/' || p_brand || ':' || p_size AS location, 'lib-' || p_partkey AS package, CAST(CASE WHEN p_partkey % 2 = 0 THEN 8.1 END AS DOUBLE) AS score
FROM part WHERE 'reports/trivy/' || {REPORT} || '.sarif' = (SELECT min('reports/trivy/' || {REPORT} || '.sarif') FROM part WHERE {REPORT} % 4 <> 3)
UNION ALL SELECT 'osv-scanner', CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END, 'OSV-' || p_partkey, 'lock/' || {REPORT}, 'pkg-' || p_partkey, NULL FROM part
UNION ALL SELECT 'zap', severity, id, path, NULL, NULL FROM ({SQL_ZAP})
""")
def dashboard_rows(spark, d):
    """What the dashboard counts: of each SARIF tool its first file, severity by the result's own properties."""
    sarif = trivy_reports(spark, d).filter("runs[0].tool.driver.name = 'Trivy'")
    return reports.dashboard_rows(sarif, osv_reports(spark, d), zap_reports(spark, d))


PATHS = ["Trivy-Results/a.sarif", "x/checkov/trivy.SARIF", "x/checkov/r.sarif", "osv/zap.json", "semgrep/osv.json", "zap/report.html", "gitleaks/r.sarif", "trivy/r.json"]


@query("SELECT path, n, CASE i WHEN 0 THEN 'trivy' WHEN 1 THEN 'trivy' WHEN 2 THEN 'checkov' WHEN 3 THEN 'osv' WHEN 4 THEN 'semgrep' END AS tool FROM (SELECT i, path, count(*) AS n FROM (SELECT p_partkey % 8 AS i, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATHS)) + " END AS path FROM part) GROUP BY ALL)")
def routed_reports(spark, d):
    """The tool of a file, by its lower-cased path and suffix, the first that fits."""
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select(path.alias("path")).groupBy("path").agg(F.count("*").alias("n")).withColumn("tool", reports.route(F.col("path")))


NVD_ITEM = """named_struct('cve', named_struct('id', 'CVE-' || p_partkey, 'published', '2024-01-01', 'lastModified', '2024-02-01', 'descriptions', array(named_struct('lang', 'es', 'value', 'otra'), named_struct('lang', 'en', 'value', p_name || ' login token')),
 'metrics', named_struct('cvssMetricV31', CASE WHEN p_partkey % 4 = 0 THEN array(named_struct('cvssData', named_struct('baseScore', p_size / 5.0D, 'baseSeverity', 'HIGH'))) END, 'cvssMetricV30', CASE WHEN p_partkey % 2 = 0 THEN array(named_struct('cvssData', named_struct('baseScore', 3.5D, 'baseSeverity', 'LOW'))) END,
 'cvssMetricV2', CASE WHEN p_partkey % 3 = 0 THEN array(named_struct('cvssData', named_struct('baseScore', 6.0D), 'baseSeverity', 'MEDIUM')) END)))"""


@query("""
SELECT 'CVE-' || p_partkey AS id, left(p_name || ' login token', 100) AS name, CASE WHEN p_partkey % 4 = 0 THEN 'high' WHEN p_partkey % 2 = 0 THEN 'low' WHEN p_partkey % 3 = 0 THEN 'medium' ELSE 'unknown' END AS severity,
 CASE WHEN p_partkey % 4 = 0 THEN p_size / 5.0 WHEN p_partkey % 2 = 0 THEN 3.5 WHEN p_partkey % 3 = 0 THEN 6.0 END AS cvss_score, p_name || ' login token' AS description FROM part
""")
def feed_advisories(spark, d):
    """Advisory rows of a vulnerability feed, the score of the newest metric that there is."""
    feed = reports.captured(report_texts(spark, d, "nvd", ".json", NVD_ITEM, "named_struct('vulnerabilities', items)"), schemas.NVD)
    return reports.advisories(feed).select("id", "name", "severity", "cvss_score", "description")


@query("SELECT tag_name, name FROM (SELECT 'v' || o_orderkey AS tag_name, o_orderpriority AS name, o_orderdate FROM orders) ORDER BY o_orderdate DESC, tag_name LIMIT 10")
def newest_release_list(spark, d):
    """The ten newest of a captured list of releases."""
    rows = table(spark, d, "orders").select(F.to_json(F.struct(F.concat(F.lit("v"), "o_orderkey").alias("tag_name"), F.col("o_orderpriority").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"))).alias("body"))
    return corpora.newest_releases(rows.select(F.from_json("body", schemas.RELEASE).alias("r")).select("r.*")).select("tag_name", "name")


STATUS = "CASE s_suppkey % 4 WHEN 0 THEN 'REVOKED' WHEN 1 THEN 'FIDO_CERTIFIED' WHEN 2 THEN 'UPDATE_AVAILABLE' ELSE 'USER_KEY_REMOTE_COMPROMISE' END"
DATE = "CASE WHEN s_suppkey % 5 = 0 THEN '2023-01-01' ELSE '2024-03-0' || (s_suppkey % 5) END"
ENTRIES = "aaid string, aaguid string, metadataStatement struct<description string>, statusReports array<struct<status string, effectiveDate string>>"


@query(f"""
SELECT 'FIDO-MDS-' || st || '-' || left('aaid' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0'), 8) || '-' || dt AS id, 'FIDO ' || st || ': ' || s_name AS name,
 CASE st WHEN 'REVOKED' THEN 'high' WHEN 'UPDATE_AVAILABLE' THEN 'medium' ELSE 'critical' END AS severity, CASE st WHEN 'REVOKED' THEN 7.5 WHEN 'UPDATE_AVAILABLE' THEN 5.5 ELSE 9.0 END AS score
FROM (SELECT s_suppkey, s_name, {STATUS} AS st, {DATE} AS dt FROM supplier) WHERE st <> 'FIDO_CERTIFIED' AND dt > '2023-12-02' AND s_suppkey % 7 <> 0
""")
def metadata_notices(spark, d):
    """Status reports in a metadata token's payload, those worth a notice since the last check that aren't known."""
    entry = f"named_struct('aaid', 'aaid' || lpad(s_suppkey, 4, '0'), 'aaguid', string(s_suppkey), 'metadataStatement', named_struct('description', s_name), 'statusReports', array(named_struct('status', {STATUS}, 'effectiveDate', {DATE})))"
    payload = F.to_json(F.struct(F.array(F.expr(entry)).alias("entries")))
    tokens = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("e30."), text.url_safe(F.encode(payload, "UTF-8")), F.lit(".c2ln")).alias("token"))
    found = lambda df: corpora.metadata_status(df, f"entries array<struct<{ENTRIES.replace(' string', ': string').replace(' struct<', ': struct<').replace(' array<', ': array<')}>>").select(F.col("report.status").alias("status"), "aaid", "aaguid", F.to_date("report.effectiveDate").alias("effective"), F.col("metadataStatement.description").alias("authenticator"))
    return advisories.new_notices(found(tokens), found(tokens.filter("s_suppkey % 7 = 0")), F.lit("2023-12-02").cast("date"))


def corpus_files(spark, d) -> DataFrame:
    """path, content of two files for each document: every fifth without its good one, every seventh in Latin-1."""
    docs = table(spark, d, "documents").filter("text is not null")
    name = lambda side: F.format_string("/data/CWE-%d/%s/%s_%d", F.col("doc_id") % 9, F.element_at(F.array(*map(F.lit, ("py", "rs", "Other"))), (F.col("doc_id") % 3 + 1).cast("int")), F.lit(side), F.col("doc_id"))
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    body = F.when(F.col("doc_id") % 7 == 0, F.encode(F.concat(ascii_only, F.lit("é")), "ISO-8859-1")).otherwise(F.encode(ascii_only, "UTF-8"))
    bad = docs.select(name("bad").alias("path"), body.alias("content"))
    return bad.unionByName(docs.filter("doc_id % 5 <> 0").select(name("good").alias("path"), F.encode(F.concat(F.lit("ok "), "doc_id"), "UTF-8").alias("content")))


SQL_PAIRS = r"""
SELECT 'CWE-' || doc_id % 9 AS cwe_id, ['py', 'rs', 'Other'][doc_id % 3 + 1] AS language_dir, CAST(doc_id AS VARCHAR) AS file_pair_id, CASE WHEN strlen(body) <= 20000 THEN md5(body) END AS vulnerable, 'ok ' || doc_id AS fixed_code, ['python', 'rust', NULL][doc_id % 3 + 1] AS language
FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') || CASE WHEN doc_id % 7 = 0 THEN 'é' ELSE '' END AS body FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0)
"""


@query(SQL_PAIRS)
def paired_corpus(spark, d):
    """Bad files with their good ones, read as UTF-8, else Latin-1, null beyond a size."""
    return corpora.paired(corpus_files(spark, d), limit=20_000).withColumn("vulnerable", F.md5("vulnerable_code")).drop("vulnerable_code")


@query(f"SELECT cwe_id, language_dir, file_pair_id FROM ({SQL_PAIRS}) WHERE language IN ('python') ORDER BY cwe_id, language_dir, file_pair_id LIMIT 20")
def selected_pairs(spark, d):
    """Pairs of a language, the first twenty by an explicit order."""
    return corpora.selected_pairs(corpora.paired(corpus_files(spark, d)), ["python"], 20).select("cwe_id", "language_dir", "file_pair_id")


KT = "concat('routing {\\n  get(\"/p/', p_partkey, '\") { }\\n  post(\"/q\") { }; delete(\"/r\") { }\\n}')"
TS = "concat('const a = 1\\napp.put(\\'/t/', p_partkey, '\\', h)\\nother.get(\"/no\", h)\\nrouter.get(\"/u\", h)')"


@query("""
SELECT v.method, CASE v.path WHEN 'K' THEN '/p/' || p_partkey WHEN 'T' THEN '/t/' || p_partkey ELSE v.path END AS path, 'src/' || p_partkey || suffix AS file, v.line AS line, handler FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '.kt' ELSE '.ts' END AS suffix, CASE WHEN p_partkey % 2 = 0 THEN 'kotlin_ktor' ELSE 'typescript_express' END AS handler FROM part) p
JOIN (VALUES ('.kt', 'GET', 'K', 2), ('.kt', 'POST', '/q', 3), ('.kt', 'DELETE', '/r', 3), ('.ts', 'PUT', 'T', 2), ('.ts', 'GET', '/u', 4)) v(own, method, path, line) ON own = suffix
""")
def source_routes(spark, d):
    """The routes that source files define."""
    kotlin = F.col("p_partkey") % 2 == 0
    files = table(spark, d, "part").select(F.concat(F.lit("src/"), "p_partkey", F.when(kotlin, ".kt").otherwise(".ts")).alias("file"), F.when(kotlin, F.expr(KT)).otherwise(F.expr(TS)).alias("value"))
    return corpora.routes_in(files)


@query("SELECT 'f' || p_size || '.py' AS file, 3 * count(*) AS lines, count(*) AS classes, count(*) AS functions FROM part GROUP BY p_size")
def tree_counts(spark, d):
    """Lines, classes and functions of each source file."""
    lines = table(spark, d, "part").select(F.concat(F.lit("f"), "p_size", F.lit(".py")).alias("file"), F.explode(F.array(F.concat(F.lit("class P"), "p_partkey"), F.lit("    def run(self):"), F.lit("        pass"))).alias("value"))
    return corpora.line_counts(lines)


@query("SELECT count(*) AS total_files, CAST(sum(strlen(text)) AS DOUBLE) / 1024 AS total_size_kb FROM documents WHERE text IS NOT NULL")
def file_totals(spark, d):
    """How many files and how many kilobytes there are."""
    return corpora.file_totals(table(spark, d, "documents").filter("text is not null").select(F.encode("text", "UTF-8").alias("content")))


ISSUE = "named_struct('title', 'Secret in ' || p_name, 'number', p_partkey, 'labels', array(named_struct('name', 'security'), named_struct('name', CASE WHEN p_partkey % 3 = 0 THEN 'gitleaks' ELSE 'bug' END)))"
ALERT = "named_struct('state', CASE WHEN p_partkey % 5 = 0 THEN 'fixed' ELSE 'open' END, 'dependency', named_struct('package', named_struct('name', p_brand)), 'security_advisory', named_struct('severity', CASE WHEN p_partkey % 2 = 0 THEN 'HIGH' ELSE 'Low' END, 'summary', p_name, 'ghsa_id', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'GHSA-' || p_partkey END))"


@query("""
SELECT 'gitLeaks' AS tool, 'high' AS severity, 'Secret in ' || p_name AS message, 'Issue #' || p_partkey AS location, 'Repository' AS package, 'Secret Detection' AS vulnerability FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'dependabot', CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'low' END, p_name, 'Dependencies', p_brand, CASE WHEN p_partkey % 7 = 0 THEN 'Dependabot Alert' ELSE 'GHSA-' || p_partkey END FROM part WHERE p_partkey % 5 <> 0
""")
def captured_alerts(spark, d):
    """Secret issues and open dependency alerts of captured answers."""
    return reports.secret_issues(report_texts(spark, d, "issues", ".json", ISSUE, "items")).unionByName(reports.dependency_alerts(report_texts(spark, d, "alerts", ".json", ALERT, "items")))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN 'lib-' || p_partkey END AS package, CASE WHEN p_partkey % 11 <> 0 THEN '1.' || p_size END AS installed_version, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'latest' ELSE {SQL_FIXED} END END AS fixed_version FROM part""")
def dependency_messages(spark, d):
    """P20: package and versions of a message, ``latest`` where no fixed version is named, nothing where no installed one is."""
    body = F.expr(f"concat('Package: lib-', p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '\\nInstalled Version: 1.' || p_size END, '\\nFixed Version: ', {FIXED})")
    return table(spark, d, "part").select("p_partkey", text.dependency_message(body).alias("m")).select("p_partkey", "m.*")


@query("SELECT o_orderkey AS hash, o_orderpriority AS message, left(repeat(o_orderstatus, 3000), 2000) AS diff FROM orders WHERE regexp_matches(lower(o_orderpriority), 'urgent|high') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def commits_by_keyword(spark, d):
    """The twenty newest commits that speak of a keyword, their diffs cut."""
    commits = table(spark, d, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("message"), F.repeat("o_orderstatus", F.lit(3000)).alias("diff"))
    return corpora.commits_about(commits, "urgent|high").drop("at")
