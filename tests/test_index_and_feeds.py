"""A saved index that was damaged, and captured answers that are no lists."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import similarity
from brindle.sources import corpora, reports


def test_a_damaged_index_is_fatal(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    similarity.save_index(rows, f"{tmp_path}/index")
    assert similarity.load_index(spark, f"{tmp_path}/index").count() == 10
    rows.limit(9).write.mode("overwrite").parquet(f"{tmp_path}/index/vectors")
    with pytest.raises(ValueError, match="damaged"):
        similarity.load_index(spark, f"{tmp_path}/index")


def test_answers_that_are_no_lists(spark):
    answers = spark.createDataFrame([('{"message": "no"}',)], "body string")
    with pytest.raises(PySparkException, match="not a list"):
        reports.dependency_alerts(answers).collect()
    assert reports.dependency_alerts(answers.select(F.lit(" ").alias("body"))).count() == 0
    assert reports.secret_issues(answers.select(F.lit("[]").alias("body"))).count() == 0


def test_long_keys_have_no_line_ends(spark):
    long = spark.range(1).select(text.url_safe(F.encode(F.repeat(F.lit("key?"), F.lit(200)), "UTF-8")).alias("k")).first()["k"]
    assert len(long) == 1067 and "\n" not in long and "\r" not in long


def test_a_commit_without_a_message(spark):
    rows = spark.createDataFrame([("a", 1, None, None), ("b", 2, "Fix CVE", "x" * 3000)], "hash string, at int, message string, diff string")
    assert [(r["hash"], len(r["diff"])) for r in corpora.commits_about(rows, "cve").collect()] == [("b", 2000)]
