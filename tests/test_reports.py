"""Readers on small reports of the tools' shapes, made here."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from brindle import schemas
from brindle.operators import relational
from brindle.sources import corpora, reports, sinks


def result(rule, text, level="error", uri="pom.xml", locations=True):
    place = [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": 3}}}]
    return {"ruleId": rule, "level": level, "message": {"text": text}, "locations": place if locations else []}


def sarif(driver, rules, *runs):
    return {"runs": [{"tool": {"driver": {"name": driver, "version": "1", "rules": rules}}, "results": r} for r in runs]}


BODY = "Package: org.x:y\nInstalled Version: 1.0\nVulnerability CVE-1\nSeverity: HIGH\nFixed Version: {}\nLink: [CVE-1](https://e/1)"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("reports")

    def put(name, content):
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(content))

    rules = [{"id": "R1", "name": "r", "properties": {"security-severity": "9.1"}}, {"id": "R2", "properties": {"security-severity": "none"}}]
    put("trivy-1/a.sarif", sarif("Trivy", rules, [result("R1", BODY.format("1.1, 2.0 [more](x)")), result("R2", BODY.format("1.2,")), result("R1", BODY.format(""))], [result("R9", BODY.format("3"), "note")]))
    put("trivy-1/other.sarif", sarif("Else", rules, [result("R1", BODY.format("1"))]))
    put("checkov/c.sarif", sarif("checkov", [{"id": "C1", "shortDescription": {"text": "pin it"}}], [result("C1", "m", uri=".github/workflows/a.yml"), result("C1", "m", locations=False)], [result("C1", "second run")]))
    put("gitleaks/g.sarif", sarif("gitleaks", [], []))
    put("zap/z.json", {"@version": "2", "site": [{"@name": "http://s", "@host": "s", "@port": "80", "alerts": [
        {"pluginid": "1", "alert": "Header missing", "riskcode": "2", "desc": "<p>No &lt;header&gt;</p>", "solution": "<p>Set it</p>", "reference": "<p>r</p>", "instances": [{"uri": "http://s/a", "method": "GET"}]},
        {"pluginid": "2", "alert": "Odd", "riskcode": "7", "instances": []}]}]})
    event = lambda *v: {"ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, *({"fixed": x} for x in v)]}]}
    put("osv/o.json", {"results": [{"source": {"path": "package-lock.json", "type": "lockfile"}, "packages": [{"package": {"name": "lib", "version": "1", "ecosystem": "npm"}, "vulnerabilities": [
        {"id": "V1", "severity": [{"type": "CVSS_V3", "score": "8.1"}], "affected": [event("2", "3"), event("2")]}, {"id": "V2", "severity": {"type": "x", "score": "low"}}, {"id": "V3", "severity": "high"}, {"id": "V4"}]}]}]})
    put("semgrep/s.json", {"version": "1", "results": [{"check_id": "k", "path": "a.kt", "start": {"line": 5}, "end": {"line": 6}, "extra": {"message": "m", "severity": "ERROR", "metadata": {"cwe": "CWE-1"}}}]})
    return str(top)


def test_all_findings(spark, folder):
    found = reports.all_findings(spark, folder).orderBy("tool", "id", "fixed_version").collect()
    assert [(r["tool"], r["id"], r["severity"]) for r in found] == [
        ("checkov", "C1", "HIGH"), ("osv-scanner", "V1", "8.1"), ("osv-scanner", "V2", "low"), ("osv-scanner", "V3", "high"), ("osv-scanner", "V4", "Unknown"),
        ("semgrep", "k", "ERROR"), ("trivy", "R1", "CRITICAL"), ("trivy", "R2", "HIGH"), ("trivy", "R9", "LOW"), ("zap", "1", "MEDIUM"), ("zap", "2", "UNKNOWN"),
    ]
    by_id = {r["id"]: r for r in found}
    assert by_id["R1"]["fixed_version"] == "1.1, 2.0"
    assert by_id["R1"]["fix"]["to_version"] == "1.1"
    assert len(by_id["R1"]["fix"]["alternatives"]) == 1
    assert by_id["R2"]["fixed_version"] == "1.2"
    assert by_id["R1"]["url"] == "https://e/1"
    assert by_id["C1"]["config_type"] == "github_actions"
    assert by_id["V1"]["fixed_version"] == "2, 3"
    assert by_id["V4"]["fixed_version"] is None
    assert (by_id["1"]["message"], by_id["1"]["path"], by_id["2"]["path"]) == ("No <header>", "http://s/a", "http://s")


def test_dashboard_counts(spark, folder):
    found = reports.dashboard_findings(spark, folder)
    totals = relational.severity_totals(found).collect()[0]
    assert totals["total"] == found.count()
    assert totals["high"] > 0


def test_advisories(spark, tmp_path):
    cve = {"id": "CVE-1", "published": "p", "lastModified": "m", "descriptions": [{"lang": "en", "value": "Login replay"}], "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 7.5, "baseSeverity": "HIGH"}}]}}
    (tmp_path / "n.json").write_text(json.dumps({"vulnerabilities": [{"cve": cve}, {"cve": {"id": "CVE-2"}}]}))
    rows = {r["id"]: r for r in reports.advisories(spark.read.schema(schemas.NVD).option("multiLine", True).json(str(tmp_path))).collect()}
    assert (rows["CVE-1"]["severity"], rows["CVE-1"]["cvss_score"], rows["CVE-1"]["affected_components"]) == ("high", 7.5, ["authentication flows", "replay protection"])
    assert (rows["CVE-2"]["severity"], rows["CVE-2"]["cvss_score"]) == ("unknown", None)


def test_corpora(spark, tmp_path):
    d = tmp_path / "c" / "CWE-79" / "py"
    d.mkdir(parents=True)
    (d / "bad_1_0").write_text("x")
    (d / "good_1_0").write_text("y")
    (d / "bad_2_0").write_text("alone")
    rows = corpora.paired_files(spark, str(tmp_path / "c")).collect()
    assert [(r["cwe_id"], r["language"], r["vulnerable_code"], r["fixed_code"]) for r in rows] == [("CWE-79", "python", "x", "y")]
    src = tmp_path / "src"
    src.mkdir()
    (src / "A.kt").write_text('class A {\n  get("/a/{id}")\n  post( "/b" )\n}')
    (src / "b.ts").write_text("app.get('/c', f)\nrouter.put(\"/d\", g)")
    found = {(r["method"], r["path"], r["line"]) for r in corpora.routes(spark, str(src)).collect()}
    assert found == {("GET", "/a/{id}", 2), ("POST", "/b", 3), ("GET", "/c", 1), ("PUT", "/d", 2)}
    counts = {r["file"].rsplit("/", 1)[1]: (r["lines"], r["classes"]) for r in corpora.tree_counts(spark, str(src)).collect()}
    assert counts == {"A.kt": (4, 1), "b.ts": (2, 0)}
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        (tmp_path / "l.json").write_text("{broken\n")
        corpora.json_lines(spark, str(tmp_path / "l.json"), "a int").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i / 2) if i else "bad", f"u{i % 2}") for i in range(10)], "id long, score string, url string")
    sinks.write_typed(df, str(tmp_path / "t"), "id bigint, score double, extra string")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.columns == ["id", "score", "extra"]
    assert back.filter("id = 0").collect()[0]["score"] is None
    sinks.write_shards(df, str(tmp_path / "s"), ["id"], 3)
    assert all(r["count"] <= 3 for r in spark.read.parquet(str(tmp_path / "s")).groupBy(F.input_file_name()).count().collect())
    sinks.write_by_source(df, str(tmp_path / "b"), "url")
    assert spark.read.json(str(tmp_path / "b")).select("chunk").distinct().count() == 2
    judged = relational.reject(df, {"odd": F.col("id") % 2 == 1})
    sinks.write_with_rejects(judged, str(tmp_path / "ok"), str(tmp_path / "no"))
    assert (spark.read.parquet(str(tmp_path / "ok")).count(), spark.read.json(str(tmp_path / "no")).count()) == (5, 5)
    assert sinks.card(relational.value_counts(df, "url"), "Urls") == "# Urls\n\n| url | n |\n| --- | --- |\n| u0 | 5 |\n| u1 | 5 |\n"
