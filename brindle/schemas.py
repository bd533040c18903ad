"""Schemas of reports, findings, code records and state tables: the one place where they are spelled out.

They are DDL text, which Spark's readers take as it is; ``parsed`` makes a type of one, for which a session must be there.
"""

from __future__ import annotations

from pyspark.sql import types as T


def parsed(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


#: A proposed fix.
FIX = "confidence double, description string, fixed_code string, explanation string, package string, from_version string, to_version string, ecosystem string, alternatives array<struct<description string, fixed_code string, explanation string>>"
#: A finding, with the columns every tool fills first and those of single tools, nullable, after.
FINDING = (
    f"tool string, id string, severity string, path string, start struct<line: int>, message string, category string, confidence double, fix struct<{FIX}>, "
    "package_name string, installed_version string, fixed_version string, ecosystem string, config_type string, rule_name string, solution string, reference string, cwe string, url string, method string, instance_count int, tool_version string, file_path string"
)
#: D3: the source around a finding.
CODE_CONTEXT = "path string, start_line int, end_line int, before array<string>, after array<string>, function_name string, class_name string"
#: An example for training on chat.
CHAT = "messages array<struct<role string, content string>>, metadata struct<tool string, severity string, quality string, source string, vulnerability_type string, training_focus string, is_augmented boolean>"
#: A vulnerability's fix commit.
CVE_FIX = (
    "cve_id string, hash string, repo_url string, cve_description string, cvss2_base_score double, cvss3_base_score double, published_date string, severity string, cwe_id string, cwe_name string, cwe_description string, "
    "commit_message string, commit_date string, version_tag string, repo_total_files bigint, repo_total_commits bigint, file_paths array<string>, language string, diff_stats string, diff_with_context string, vulnerable_code string, fixed_code string, security_keywords array<string>"
)
#: A file before and after its fix.
CODE_PAIR = "cwe_id string, cwe_description string, language string, vulnerable_code string, fixed_code string, file_pair_id string, source string, language_dir string"
#: Signing keys and what happened to them.
KEY = "key_id string, status string, created_at timestamp, activated_at timestamp, retired_at timestamp, expires_at timestamp, metadata string"
KEY_EVENT = "event_id bigint, key_id string, event string, at timestamp, metadata string"
#: A value that lives until a time.
TTL_ENTRY = "key string, value string, expires_at timestamp"
#: An advisory.
ADVISORY = "id string, name string, severity string, cvss_score double, published string, modified string, description string, affected_components array<string>"

# Reports as the tools write them.
_LOCATION = "struct<physicalLocation: struct<artifactLocation: struct<uri string>, region: struct<startLine int, endLine int>>>"
SARIF = (
    "runs array<struct<tool: struct<driver: struct<name string, version string, rules: array<struct<id string, name string, shortDescription: struct<text string>, fullDescription: struct<text string>, help: struct<text string>, helpUri string, properties: struct<`security-severity`: string, tags: array<string>>>>>>, "
    f"results: array<struct<ruleId string, level string, message: struct<text string>, locations: array<{_LOCATION}>, properties: struct<`security-severity`: string, severity string>>>>>"
)
ZAP = (
    "`@version` string, site array<struct<`@name`: string, `@host`: string, `@port`: string, alerts: array<struct<pluginid string, alertRef string, alert string, riskcode string, confidence string, riskdesc string, desc string, "
    "instances: array<struct<uri string, method string, param string>>, count string, solution string, reference string, cweid string, wascid string>>>>"
)
#: severity is text, a list of structs or a struct there: it is read as text and told apart afterwards.
OSV = (
    "results array<struct<source: struct<path string, type string>, packages: array<struct<package: struct<name string, version string, ecosystem string>, "
    "vulnerabilities: array<struct<id string, summary string, details string, severity string, affected: array<struct<ranges: array<struct<type string, events: array<map<string, string>>>>>>>>>>>>"
)
SEMGREP = (
    "version string, results array<struct<check_id string, path string, start: struct<line int, col int>, `end`: struct<line int, col int>, "
    "extra: struct<message string, severity string, metadata: struct<cwe string, owasp string, confidence string, likelihood string, impact string>>>>"
)
NVD = (
    "vulnerabilities array<struct<cve: struct<id string, published string, lastModified string, descriptions: array<struct<lang string, value string>>, "
    "metrics: struct<cvssMetricV31: array<struct<cvssData: struct<baseScore double, baseSeverity string>>>, cvssMetricV30: array<struct<cvssData: struct<baseScore double, baseSeverity string>>>, cvssMetricV2: array<struct<cvssData: struct<baseScore double>, baseSeverity string>>>>>>"
)
RELEASE = "tag_name string, name string, body string, published_at string"
