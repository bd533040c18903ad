"""Scanner reports as DataFrames of findings, all read by Spark's JSON reader with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import schemas
from brindle.functions import packages, severity, text
from brindle.functions.keywords import affected_components

#: The tools in the order in which a path is matched, and the suffixes their files have.
ROUTES = (("trivy", (".sarif",)), ("checkov", (".sarif",)), ("semgrep", (".json",)), ("osv", (".json",)), ("zap", (".json",)))


def route(path: Column) -> Column:
    """The tool a file belongs to by its lower-cased path and suffix; null if none."""
    low = F.lower(path)
    fits = lambda tool, ends: F.contains(low, F.lit(tool)) & low.rlike(f"({'|'.join(e.replace('.', '[.]') for e in ends)})$")
    return F.coalesce(*[F.when(fits(t, e), F.lit(t)) for t, e in ROUTES])


def read_json(spark: SparkSession, folder: str, schema, tool: str) -> DataFrame:
    """The reports of one tool below a folder, one row a file, with its path as ``file``."""
    found = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,sarif}").json(folder)
    return found.withColumn("file", F.col("_metadata.file_path")).filter(route(F.col("file")) == tool)


def captured(texts: DataFrame, schema) -> DataFrame:
    """Reports that stand as JSON text in ``body``, with their path in ``file``: as ``read_json`` gives them."""
    return texts.select("file", F.from_json("body", schema).alias("r")).select("file", "r.*")


def as_findings(df: DataFrame) -> DataFrame:
    """Every column of the findings' schema, those that ``df`` lacks as nulls, cast to its types."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.parsed(schemas.FINDING)])


def sarif_results(reports: DataFrame, first_run_only: bool = False) -> DataFrame:
    """One row a result with its rule (J2): the rule is looked up by id in the run it belongs to."""
    runs = reports.select("file", F.explode(F.slice("runs", 1, 1) if first_run_only else F.col("runs")).alias("run"))
    results = runs.select("file", "run", F.explode("run.results").alias("result"))
    rule = F.try_element_at(F.filter("run.tool.driver.rules", lambda r: r.id == F.col("result.ruleId")), F.lit(1))
    return results.select("file", F.col("run.tool.driver.name").alias("driver"), F.col("run.tool.driver.version").alias("driver_version"), "result", rule.alias("rule"))


def trivy(reports: DataFrame) -> DataFrame:
    """Results of a driver named Trivy that name a package and a fixed version."""
    rows = sarif_results(reports).filter(F.lower("driver") == "trivy")
    body, uri = F.col("result.message.text"), F.col("result.locations")[0]["physicalLocation"]["artifactLocation"]["uri"]
    line = F.col("result.locations")[0]["physicalLocation"]["region"]["startLine"]
    fixed = F.trim(F.regexp_replace(F.regexp_replace(text.labelled_line(body, "Fixed Version"), r"\s*\[.*$", ""), r",\s*$", ""))
    rows = rows.select(
        F.lit("trivy").alias("tool"), F.col("result.ruleId").alias("id"), severity.of_rule(F.col("rule.properties.security-severity"), F.col("result.level")).alias("severity"),
        F.coalesce(uri, F.lit("Unknown")).alias("path"), F.struct(F.coalesce(line, F.lit(1)).alias("line")).alias("start"), body.alias("message"), F.lit("dependency_security").alias("category"), F.lit(0.9).alias("confidence"),
        text.labelled_line(body, "Package").alias("package_name"), text.labelled_line(body, "Installed Version").alias("installed_version"), fixed.alias("fixed_version"),
        F.nullif(F.regexp_extract(text.labelled_line(body, "Link"), r"\(([^)]+)\)", 1), F.lit("")).alias("url"), F.col("rule.name").alias("rule_name"), F.col("driver_version").alias("tool_version"),
    ).filter("package_name <> '' and fixed_version <> ''")
    rows = rows.withColumn("ecosystem", packages.ecosystem(F.col("package_name"), F.col("path")))
    return as_findings(rows.withColumn("fix", packages.upgrade_fix(F.col("package_name"), F.col("installed_version"), F.col("fixed_version"), F.col("ecosystem"))))


def checkov(reports: DataFrame) -> DataFrame:
    """Results of the first run that have a location."""
    rows = sarif_results(reports, first_run_only=True).filter((F.lower("driver") == "checkov") & (F.size("result.locations") > 0))
    where = F.col("result.locations")[0]["physicalLocation"]
    path, name = where["artifactLocation"]["uri"], F.coalesce("rule.shortDescription.text", "rule.name", "result.ruleId")
    fix = F.struct(F.lit(0.8).alias("confidence"), F.concat(F.lit("Configure: "), name).alias("description"), F.coalesce("rule.help.text", name).alias("fixed_code"), F.coalesce("rule.fullDescription.text", name).alias("explanation"), *[F.lit(None).cast("string").alias(c) for c in ("package", "from_version", "to_version", "ecosystem")], F.array().cast("array<struct<description:string,fixed_code:string,explanation:string>>").alias("alternatives"))
    return as_findings(rows.select(
        F.lit("checkov").alias("tool"), F.col("result.ruleId").alias("id"), severity.of_level(F.coalesce("result.level", F.lit("warning"))).alias("severity"), path.alias("path"),
        F.struct(where["region"]["startLine"].alias("line")).alias("start"), F.col("result.message.text").alias("message"), F.lit("infrastructure_security").alias("category"), F.lit(0.9).alias("confidence"), fix.alias("fix"),
        packages.config_type(path).alias("config_type"), name.alias("rule_name"), F.col("driver_version").alias("tool_version"),
    ))


def zap(reports: DataFrame) -> DataFrame:
    """A row for each alert of each site, its address from its first instance or the site."""
    alerts = reports.select("`@version`", F.explode("site").alias("site")).select("`@version`", F.col("site.`@name`").alias("site_name"), F.explode("site.alerts").alias("a"))
    first = F.try_element_at("a.instances", F.lit(1))
    uri, body, solution = F.coalesce(first["uri"], "site_name", F.lit("Unknown")), text.strip_html(F.coalesce("a.desc", F.lit("No description"))), text.strip_html(F.coalesce("a.solution", F.lit("No solution provided")))
    fix = F.struct(F.lit(0.9).alias("confidence"), F.concat(F.lit("Resolve: "), F.col("a.alert")).alias("description"), solution.alias("fixed_code"), body.alias("explanation"), *[F.lit(None).cast("string").alias(c) for c in ("package", "from_version", "to_version", "ecosystem")], F.array().cast("array<struct<description:string,fixed_code:string,explanation:string>>").alias("alternatives"))
    return as_findings(alerts.select(
        F.lit("zap").alias("tool"), F.coalesce("a.pluginid", F.lit("Unknown")).alias("id"), severity.of_risk(F.col("a.riskcode")).alias("severity"), uri.alias("path"), F.struct(F.lit(1).alias("line")).alias("start"),
        body.alias("message"), F.lit("web_security").alias("category"), F.lit(0.9).alias("confidence"), fix.alias("fix"), F.col("a.alert").alias("rule_name"), solution.alias("solution"), text.strip_html(F.col("a.reference")).alias("reference"),
        F.col("a.cweid").alias("cwe"), uri.alias("url"), F.coalesce(first["method"], F.lit("Unknown")).alias("method"), F.coalesce(F.size("a.instances"), F.lit(0)).alias("instance_count"), F.col("@version").alias("tool_version"),
    ))


def osv_score(raw: Column) -> Column:
    """The score of a severity that is text, a struct or a list of structs; Unknown without one."""
    of_list = F.try_element_at(F.from_json(raw, "array<struct<type:string,score:string>>"), F.lit(1)).score
    of_one = F.from_json(raw, "struct<type:string,score:string>").score
    plain = F.when(~raw.rlike(r"^\s*[\[{]"), F.nullif(raw, F.lit("")))
    return F.coalesce(F.when(raw.rlike(r"^\s*\["), of_list), F.when(raw.rlike(r"^\s*\{"), of_one), plain, F.lit("Unknown"))


def osv(reports: DataFrame) -> DataFrame:
    """A row for each vulnerability of each package of each source; fixed versions in order, once each."""
    flat = reports.select(F.explode("results").alias("r")).select("r.source", F.explode("r.packages").alias("p")).select("source", "p.package", F.explode("p.vulnerabilities").alias("v"))
    events = F.flatten(F.flatten(F.transform("v.affected", lambda a: F.transform(a.ranges, lambda r: r.events))))
    fixed = F.array_join(F.array_distinct(F.array_compact(F.transform(events, lambda e: F.try_element_at(e, F.lit("fixed"))))), ", ")
    path = F.coalesce("source.path", F.lit("Unknown"))
    rows = flat.select(
        F.lit("osv-scanner").alias("tool"), F.coalesce("v.id", F.lit("Unknown")).alias("id"), osv_score(F.col("v.severity")).alias("severity"), path.alias("path"), F.struct(F.lit(1).alias("line")).alias("start"),
        F.coalesce("v.summary", F.lit("No summary")).alias("message"), F.lit("dependency_vulnerabilities").alias("category"), F.lit(0.9).alias("confidence"), F.coalesce("package.name", F.lit("Unknown")).alias("package_name"),
        F.coalesce("package.version", F.lit("Unknown")).alias("installed_version"), F.nullif(fixed, F.lit("")).alias("fixed_version"), F.coalesce("package.ecosystem", F.lit("Unknown")).alias("ecosystem"),
    )
    return as_findings(rows.withColumn("fix", packages.upgrade_fix(F.col("package_name"), F.col("installed_version"), F.col("fixed_version"), F.lower("ecosystem"))))


def semgrep(reports: DataFrame) -> DataFrame:
    """A row for each result."""
    rows = reports.select("version", F.explode("results").alias("r"))
    return as_findings(rows.select(
        F.lit("semgrep").alias("tool"), F.col("r.check_id").alias("id"), F.col("r.extra.severity").alias("severity"), F.col("r.path").alias("path"), F.struct(F.col("r.start.line").alias("line")).alias("start"),
        F.col("r.extra.message").alias("message"), F.lit("code_vulnerability").alias("category"), F.lit(0.7).alias("confidence"), F.col("r.extra.metadata.cwe").alias("cwe"), F.col("version").alias("tool_version"), F.col("r.path").alias("file_path"),
    ))


def all_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of all reports below a folder, every tool's by its own reader; repeated reports count each."""
    parts = [trivy(read_json(spark, folder, schemas.SARIF, "trivy")), checkov(read_json(spark, folder, schemas.SARIF, "checkov")), semgrep(read_json(spark, folder, schemas.SEMGREP, "semgrep")), osv(read_json(spark, folder, schemas.OSV, "osv")), zap(read_json(spark, folder, schemas.ZAP, "zap"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dashboard_findings(spark: SparkSession, folder: str) -> DataFrame:
    """``dashboard_rows`` of the reports below a folder."""
    sarif = spark.read.schema(schemas.SARIF).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sarif").json(folder)
    return dashboard_rows(sarif.withColumn("file", F.col("_metadata.file_path")), read_json(spark, folder, schemas.OSV, "osv"), read_json(spark, folder, schemas.ZAP, "zap"))


def dashboard_rows(sarif_reports: DataFrame, osv_reports: DataFrame, zap_reports: DataFrame) -> DataFrame:
    """Tool, severity, id, location, package, score as the dashboard counts them: severity by the result's own properties, else its level."""
    sarif = sarif_results(sarif_reports)
    first = sarif.groupBy("driver").agg(F.min("file").alias("file"))
    sarif = sarif.join(first, ["driver", "file"], "left_semi")  # only the first file of each tool
    where = F.col("result.locations")[0]["physicalLocation"]
    score = F.col("result.properties.security-severity").try_cast("double")
    own = F.coalesce(F.upper("result.properties.severity"), severity.from_score(score), severity.lookup(severity.LEVELS, F.col("result.level"), "MEDIUM"))
    location = F.concat_ws(":", where["artifactLocation"]["uri"], where["region"]["startLine"])
    rows = sarif.select(F.lower("driver").alias("tool"), own.alias("severity"), F.col("result.ruleId").alias("id"), location.alias("location"), text.labelled_line(F.col("result.message.text"), "Package").alias("package"), score.alias("score"))
    osv_rows, zap_rows = osv(osv_reports), zap(zap_reports)
    rest = osv_rows.select("tool", F.upper(severity.of_advisory(F.col("severity"))).alias("severity"), "id", F.col("path").alias("location"), F.col("package_name").alias("package"), F.lit(None).cast("double").alias("score"))
    return rows.unionByName(rest).unionByName(zap_rows.select("tool", "severity", "id", F.col("path").alias("location"), F.lit(None).cast("string").alias("package"), F.lit(None).cast("double").alias("score")))


def advisories(reports: DataFrame) -> DataFrame:
    """Advisory rows of a vulnerability feed; the score of the newest metric that there is."""
    cve = reports.select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")
    m = lambda name: F.try_element_at(F.col(f"metrics.{name}"), F.lit(1))
    score = F.coalesce(m("cvssMetricV31")["cvssData"]["baseScore"], m("cvssMetricV30")["cvssData"]["baseScore"], m("cvssMetricV2")["cvssData"]["baseScore"])
    name = F.coalesce(m("cvssMetricV31")["cvssData"]["baseSeverity"], m("cvssMetricV30")["cvssData"]["baseSeverity"], m("cvssMetricV2")["baseSeverity"])
    body = F.coalesce(F.try_element_at(F.filter("descriptions", lambda d: d.lang == "en"), F.lit(1)).value, F.lit(""))
    return cve.select("id", F.left(body, F.lit(100)).alias("name"), F.lower(F.coalesce(name, severity.from_score(score), F.lit("unknown"))).alias("severity"), score.alias("cvss_score"), "published", F.col("lastModified").alias("modified"), body.alias("description"), affected_components(body).alias("affected_components"))


#: Captured answers about secret issues and dependency alerts.
ISSUES = "array<struct<title string, number bigint, created_at string, labels array<struct<name string>>>>"
ALERTS = "array<struct<state string, dependency: struct<package: struct<name string>>, security_advisory: struct<severity string, summary string, ghsa_id string>>>"


def secret_issues(answers: DataFrame, label: str = "gitleaks") -> DataFrame:
    """A row for each issue with the label in captured answers (``body``); secrets are always high."""
    issues = answers.select(F.explode(F.from_json("body", ISSUES)).alias("i")).filter(F.exists("i.labels", lambda x: x["name"] == label))
    return issues.select(
        F.lit("gitLeaks").alias("tool"), F.lit("high").alias("severity"), F.col("i.title").alias("message"), F.concat(F.lit("Issue #"), F.col("i.number")).alias("location"),
        F.lit("Repository").alias("package"), F.lit("Secret Detection").alias("vulnerability"),
    )


def dependency_alerts(answers: DataFrame) -> DataFrame:
    """A row for each open alert in captured answers (``body``); an answer that is no list is an error and fails the job."""
    parsed = F.when(F.trim("body") == "", F.lit(None)).when(F.ltrim("body").startswith("["), F.from_json("body", ALERTS)).otherwise(F.raise_error(F.concat(F.lit("not a list of alerts: "), F.left("body", F.lit(200)))))
    a = answers.select(F.explode(parsed).alias("a")).filter("coalesce(a.state, 'open') = 'open'")
    return a.select(
        F.lit("dependabot").alias("tool"), F.lower("a.security_advisory.severity").alias("severity"), F.col("a.security_advisory.summary").alias("message"), F.lit("Dependencies").alias("location"),
        F.col("a.dependency.package.name").alias("package"), F.coalesce(F.nullif("a.security_advisory.ghsa_id", F.lit("")), F.lit("Dependabot Alert")).alias("vulnerability"),
    )
