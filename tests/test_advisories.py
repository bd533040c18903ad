from __future__ import annotations

import datetime as dt

import duckdb
from compare import assert_same
from pyspark.sql import functions as F

from brindle.functions import advisories, analysis, severity
from brindle.functions.code import code_scope, enclosing
from brindle.plans import catalogue


def test_notices(spark):
    day = dt.datetime(2024, 5, 1)
    rows = [("REVOKED", None, "0123456789", day, "Key A"), ("UPDATE_AVAILABLE", "4e4e#4005xyz", None, day, "Key B"), ("NOT_FIDO_CERTIFIED", "x", None, day, "C"), ("REVOKED", "old", None, dt.datetime(2023, 1, 1), "D")]
    reports = spark.createDataFrame(rows, "status string, aaid string, aaguid string, effective timestamp, authenticator string")
    known = spark.createDataFrame([("FIDO-MDS-UPDATE_AVAILABLE-4e4e#400-2024-05-01",)], "id string")
    found = advisories.new_notices(reports, known, F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r["id"], r["severity"], r["score"]) for r in found] == [("FIDO-MDS-REVOKED-01234567-2024-05-01", "high", 7.5)]


def test_notices_of_ids_that_begin_alike(spark):
    """A known report hides itself only, not others whose notices have the same id."""
    day = dt.date(2024, 5, 1)
    rows = [("REVOKED", "aaid1234", str(i), day, name) for i, name in enumerate("AABC")] + [("REVOKED", "aaid1234", None, day, "D"), ("REVOKED", "aaid1234", "1", day, "A")]
    reports = spark.createDataFrame(rows, "status string, aaid string, aaguid string, effective date, authenticator string")
    found = advisories.new_notices(reports, reports.filter("authenticator in ('B', 'D')"), F.lit("2024-01-01").cast("date"))
    assert found.columns == ["id", "name", "severity", "score"]
    assert sorted((r["id"], r["name"]) for r in found.collect()) == [("FIDO-MDS-REVOKED-aaid1234-2024-05-01", f"FIDO REVOKED: {n}") for n in "AAC"]


def test_notices_of_many_suppliers(spark, tmp_path):
    """Keys of five digits, of which a notice's id holds the first four, against the query's SQL."""
    keys = [*range(12340, 12350), *range(100_000, 100_040), 5, 6, 7]
    spark.createDataFrame([(k, f"Supplier#{k % 1000}") for k in keys], "s_suppkey long, s_name string").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert_same(catalogue.queries()["metadata_notices"](spark, str(tmp_path)), con, catalogue.oracle_sql()["metadata_notices"])


def test_updates(spark):
    now = F.lit("2024-06-01").cast("timestamp")
    rows = [("2.6.0", "Security fix", dt.datetime(2024, 5, 1)), ("2.5.4", "docs", dt.datetime(2024, 1, 1)), ("2.4.0", "CVE-1", dt.datetime(2020, 1, 1))]
    releases = spark.createDataFrame(rows, "tag string, body string, published timestamp")
    got = advisories.update_advisory(F.lit("2.5.0"), releases, now).collect()
    assert [(r["latest"], r["n"], r["severity"], r["score"]) for r in got] == [("2.6.0", 1, "high", 5.5)]
    assert advisories.update_advisory(F.lit("2.6.0"), releases, now).count() == 0
    levels = spark.range(1).select(*[severity.update_severity(F.lit(n), F.lit(d).cast("timestamp"), now).alias(f"c{i}") for i, (n, d) in enumerate([(0, None), (1, "2020-01-01"), (2, "2020-01-01")])]).collect()[0]
    assert list(levels) == ["low", "medium", "high"]
    d = spark.range(1).select(advisories.decision(F.lit("Attestation key"), F.lit("2.5.0"), F.lit("2.6.0")).alias("a"), advisories.decision(F.lit("PIN"), F.lit("2.5.0"), F.lit("2.6.0")).alias("b")).collect()[0]
    assert (d["a"]["action"], d["a"]["suggested_version"], d["b"]["action"]) == ("update_dependency", "2.6.0", "manual_review")


def test_images(spark):
    rows = [("a", "1", "1", ["pr-1"]), ("b", "1", "2", ["main"]), ("c", "1", None, []), ("d", None, "1", None)]
    images = spark.createDataFrame(rows, "name string, source_digest string, target_digest string, tags array<string>")
    assert {r["name"] for r in advisories.changed_images(images).collect()} == {"b", "c"}
    assert [r["name"] for r in advisories.with_tag(images, "^pr-").collect()] == ["a"]
    checks = advisories.artifact_checks(spark.createDataFrame([(1, 2), (0, 2), (None, 1)], "a long, b long"), ["a", "b"])
    assert [r["all_ok"] for r in checks.collect()] == [True, False, False]


def test_analysis(spark):
    row = spark.range(1).select(
        analysis.impact(F.lit("CKV2_GHA_1"), F.lit("HIGH"), F.lit("checkov")).alias("a"), analysis.impact(F.lit("x"), F.lit("HIGH"), F.lit("zap")).alias("b"), analysis.remediation(F.lit("CKV_GHA_7"), F.lit("checkov")).alias("c"),
        analysis.prevention(F.lit("none")).alias("d"), analysis.header_fix(F.lit("Spectre"), F.lit("s")).alias("e"), analysis.header_fix(F.lit("Else"), F.lit("s")).alias("f"),
        analysis.transformed(F.lit("a=1"), [{"type": "replace", "pattern": r"(\w)=", "replacement": "$1 = "}, {"type": "wrap", "prefix": "{", "suffix": "}"}, {"type": "prepend", "code": "x"}, {"type": "append", "code": "y"}]).alias("g"),
    ).collect()[0]
    assert row["a"].startswith("A workflow")
    assert row["b"] == "The flaw is severe."
    assert row["c"].startswith("Name the least")
    assert (row["d"], row["e"], row["f"]) == ("Scan in each build.", "Cross-Origin-Resource-Policy: same-origin", "s")
    assert row["g"] == "x\n{a = 1}\ny"
    results = spark.createDataFrame([("success", "HIGH", "zap", "1"), ("success", None, "zap", "2"), ("error", "HIGH", "zap", "3")], "status string, severity string, tool string, id string")
    s = analysis.summary(results).collect()[0]
    assert (s["n"], s["ok"], s["failed"], s["by_severity"], s["by_tool"], s["severe"]) == (3, 2, 1, {"HIGH": 1, "UNKNOWN": 1}, {"zap": 2}, ["1"])
    similar = F.array(F.struct(F.lit("zap").alias("tool"), F.lit("xss").alias("type"), F.lit(0.876).alias("score")))
    m = spark.range(1).select(analysis.merged(F.lit("b"), F.lit("e"), similar, F.lit(9)).alias("m")).collect()[0]["m"]
    assert (m["baseline"], m["about"]["n_similar"], m["about"]["similar"][0]["similarity"]) == ("b", 1, "87.6%")


PYTHON = "class A:\n    def f(self):\n        x = 1\n\n        return x\n\n    y = 2\n"
KOTLIN = "class B {\n  suspend fun <T> g(a: T) {\n    if (a) { b() }\n    c()\n  }\n  val z = 1\n}"


def test_code_scope(spark):
    assert [enclosing(PYTHON, n, "python")["function_name"] for n in (2, 3, 5, 7)] == ["f", "f", "f", None]
    assert enclosing(PYTHON, 7, "python")["class_name"] == "A"
    found = enclosing(KOTLIN, 4, "kotlin")
    assert (found["function_name"], found["function_start"], found["function_end"], found["class_name"]) == ("g", 2, 5, "B")
    rows = [(PYTHON, 3, "python"), (None, 1, "python"), ("x", None, "kotlin"), ("x", 9, "kotlin"), ("x", 1, "cobol")]
    df = spark.createDataFrame(rows, "s string, n int, k string").select(code_scope("s", "n", "k").alias("c")).collect()
    assert [r["c"]["function_name"] for r in df] == ["f", None, None, None, None]
