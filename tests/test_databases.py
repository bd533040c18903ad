"""Tables in SQLite files: what is written is read, in parts, with conditions pushed down."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.sources import databases

SCHEMA = 'id long, n int, x double, "a ""b" string'.replace('"a ""b"', "`a \"b`")


def rows(n):
    return [(i, None if i % 7 == 0 else i % 5, i / 4, None if i % 11 == 0 else f"é'{i}\\n" * (i % 3)) for i in range(n)]


def test_round_trip_in_parts(spark, tmp_path):
    frame = spark.createDataFrame(rows(5000), SCHEMA).repartition(3)
    paths = databases.write_tables(frame, str(tmp_path), "odd name")
    assert len(paths) == 3
    (tmp_path / "odd name-left-by-a-lost-task.db").write_bytes(b"half")
    read = databases.read_tables(spark, paths, "odd name", frame.schema, part_bytes=20_000)
    assert read.rdd.getNumPartitions() > 6
    assert sorted(map(tuple, read.collect())) == rows(5000)
    assert databases.read_tables(spark, [], "t", frame.schema).collect() == []
    assert databases.write_tables(frame.limit(0), str(tmp_path / "none"), "t") == []


def test_conditions_reach_the_files(spark, tmp_path):
    frame = spark.createDataFrame(rows(3000), SCHEMA)
    paths = databases.write_tables(frame, str(tmp_path), "t")
    with databases.pushing_down(spark):
        read = databases.read_tables(spark, paths, "t", frame.schema)
        text = F.col("`a \"b`")
        for condition in (F.col("id") == 17, (F.col("id") > 5) & (F.col("x") <= 300.5), F.col("n").isin(1, 3), text.isNull(), (text >= "é'2") & F.col("n").isNotNull(), (F.col("n") + 1 == 3) & (F.col("id") < 99)):
            assert sorted(map(tuple, read.filter(condition).collect()), key=str) == sorted(map(tuple, frame.filter(condition).collect()), key=str)
        plan = read.filter("id = 17")._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.split("BatchScan")[0]  # nothing is left to Spark
    assert databases.read_tables(spark, paths, "t", frame.schema).filter("id = 17").count() == 1
    reader = databases.FilteringReader({"paths": "[]", "table": "t"}, frame.schema)
    kept = list(reader.pushFilters([databases.EqualTo(("id",), 3), databases.GreaterThan(("x",), float("nan")), databases.In(("n",), (1, 2))]))
    assert [type(f) for f in kept] == [databases.GreaterThan] and reader.conditions == ['"id" = ?', '"n" IN (?, ?)'] and reader.values == [3, 1, 2]
