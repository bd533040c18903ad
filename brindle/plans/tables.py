"""Queries over orders, lines, customers, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import packages, severity, text
from brindle.operators import ordering, relational
from brindle.plans.base import query, table

SCORE = "CASE WHEN value / 10 >= 9 THEN 'CRITICAL' WHEN value / 10 >= 7 THEN 'HIGH' WHEN value / 10 >= 4 THEN 'MEDIUM' WHEN value IS NOT NULL THEN 'LOW' END"


def scored(spark, d):
    return table(spark, d, "events").withColumn("severity", severity.from_score(F.col("value") / 10))


@query(f"SELECT event_id, {SCORE} AS severity FROM events")
def severity_bucket(spark, d):
    """A severity for each event's value."""
    return scored(spark, d).select("event_id", "severity")


@query(f"SELECT event_type, count(*) FILTER (s = 'CRITICAL') AS CRITICAL, count(*) FILTER (s = 'HIGH') AS HIGH, count(*) FILTER (s = 'MEDIUM') AS MEDIUM, count(*) FILTER (s = 'LOW') AS LOW FROM (SELECT event_type, {SCORE} AS s FROM events) GROUP BY event_type")
def tool_severity_pivot(spark, d):
    """Event types by severities."""
    return relational.pivot_counts(scored(spark, d), "event_type", "severity", ["CRITICAL", "HIGH", "MEDIUM", "LOW"])


@query(f"SELECT count(*) FILTER (s = 'CRITICAL') AS critical, count(*) FILTER (s = 'HIGH') AS high, count(*) FILTER (s = 'MEDIUM') AS medium, count(*) FILTER (s = 'LOW') AS low, count(*) FILTER (s = 'INFO') AS info, count(*) AS total FROM (SELECT {SCORE} AS s FROM events)")
def severity_totals(spark, d):
    """A5: how many of each severity."""
    return relational.severity_totals(scored(spark, d))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, d):
    """A number out of JSON text."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def left_join_chain(spark, d):
    """Four tables joined from the left, the small ones broadcast by their size."""
    fact, orders, customers, nations = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    joined = relational.left_chain(fact, [(orders, F.col("l_orderkey") == F.col("o_orderkey")), (customers, F.col("o_custkey") == F.col("c_custkey")), (nations, F.col("c_nationkey") == F.col("n_nationkey"))])
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def group_records_by_key(spark, d):
    """A1: customers with all their orders."""
    grouped = relational.grouped_records(table(spark, d, "orders"), "o_custkey", ["o_orderkey"])
    return grouped.select("o_custkey", F.size("records").cast("long").alias("n"), F.array_join(F.transform("records", lambda r: r.o_orderkey.cast("string")), ",").alias("orders"))


@query("SELECT c_mktsegment, count(*) AS orders, count(DISTINCT c_custkey) AS customers, count(DISTINCT c_nationkey) AS nations, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def dataset_card_stats(spark, d):
    """A2, A3: distinct counts and ranges."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.count_distinct("c_custkey").alias("customers"), F.count_distinct("c_nationkey").alias("nations"), F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))


@query("SELECT o_orderstatus AS split, o_orderpriority AS quality, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 2) AS percent FROM orders GROUP BY 1, 2")
def split_quality_card(spark, d):
    """Counts and percentages by split and quality."""
    return relational.dataset_card(table(spark, d, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("quality")), "split", "quality")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def value_counts_top10(spark, d):
    """The ten commonest brands."""
    return relational.value_counts(table(spark, d, "part"), "p_brand", 10)


@query("SELECT s_suppkey, n_name, coalesce(r_name, 'none') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def rule_lookup_left(spark, d):
    """Suppliers with their nation and region as rules' dictionaries."""
    joined = relational.left_chain(table(spark, d, "supplier"), [(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), (table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))])
    return joined.select("s_suppkey", "n_name", F.coalesce("r_name", F.lit("none")).alias("region"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) - 1 AS BIGINT) AS place FROM orders")
def case_priority_sort(spark, d):
    """O1: open orders first, then partial ones, the newest first; ranks come from range partitions."""
    ranked = table(spark, d, "orders").withColumn("p", F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)).withColumn("newest", -F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return ordering.shards(ranked.select("p", "newest", "o_orderkey"), ["p", "newest", "o_orderkey"], 1).select("o_orderkey", F.col("shard").alias("place"))


@query("SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_state_per_key(spark, d):
    """Each user's last event."""
    return ordering.latest_state(table(spark, d, "events"), "user_id", "ts", "event_type")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def rolling_last5_avg(spark, d):
    """The mean of each user's last five values."""
    return ordering.rolling_mean(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("rolling", 6).alias("rolling"))


@query("""
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - CASE WHEN g = 0 THEN 0 ELSE 1 END ELSE 0 END AS BIGINT) AS run
FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
""")
def consecutive_errors(spark, d):
    """How many errors in succession a user has had."""
    return ordering.runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "run")


@query("SELECT event_id FROM events WHERE ts + INTERVAL 300 SECOND > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00'")
def ttl_live_entries(spark, d):
    """Entries written with the default life of 300 seconds that are alive at a moment."""
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    entries = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).filter(F.col("at") <= now)
    return ordering.live(entries.withColumn("expires_at", F.col("at") + F.expr("interval 300 seconds")), now).select("event_id")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-25 12:00:00'")
def incremental_since(spark, d):
    """What is newer than the last check; the filter reaches the scan."""
    return ordering.since(table(spark, d, "events"), "ts", F.lit("2024-01-25 12:00:00").cast("timestamp")).select("event_id")


@query("SELECT o_orderkey, CAST(r AS INT) AS rank FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r > 5")
def keep_newest5_rest(spark, d):
    """All but each customer's newest five orders."""
    return ordering.after_newest(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "rank")


@query("SELECT shard, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM (SELECT l_orderkey, CAST(floor((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) / 5000) AS BIGINT) AS shard FROM lineitem) GROUP BY shard")
def shard_ranges(spark, d):
    """Shards of 5000 lines in key order; no window runs over the whole table."""
    sharded = ordering.shards(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5000)
    return sharded.groupBy("shard").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


@query("""
SELECT p_partkey, (a, b, c) < (1, 10, 2) AS outdated, concat_ws('.', a, b, c) AS plain FROM (SELECT p_partkey, CAST(p_partkey % 3 AS INT) AS a, CAST(p_size AS INT) AS b, CAST(p_partkey % 7 AS INT) AS c FROM part)
""")
def version_compare(spark, d):
    """Versions compared by their numbers."""
    parts = table(spark, d, "part").select("p_partkey", F.concat(F.lit("v"), F.concat_ws(".", F.col("p_partkey") % 3, "p_size", F.col("p_partkey") % 7)).alias("v"))
    found = parts.select("p_partkey", text.version(F.col("v")).alias("n"))
    return found.select("p_partkey", (F.col("n") < F.array(F.lit(1), F.lit(10), F.lit(2))).alias("outdated"), F.array_join(F.col("n").cast("array<string>"), ".").alias("plain"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'failure' WHEN 'N' THEN 'success' ELSE 'cancelled' END AS a, CASE l_linestatus WHEN 'O' THEN 'success' ELSE 'skipped' END AS b FROM lineitem)
SELECT CASE WHEN 'failure' IN (a, b) THEN 'failure' WHEN a = 'success' AND b = 'success' THEN 'success' WHEN 'cancelled' IN (a, b) THEN 'cancelled' ELSE 'skipped' END AS overall, count(*) AS n FROM s GROUP BY 1
""")
def overall_result(spark, d):
    """One result of several statuses."""
    first = F.when(F.col("l_returnflag") == "A", "failure").when(F.col("l_returnflag") == "N", "success").otherwise("cancelled")
    overall = severity.overall_result(first, F.when(F.col("l_linestatus") == "O", "success").otherwise("skipped"))
    return table(spark, d, "lineitem").groupBy(overall.alias("overall")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY ALL")
def weighted_totals(spark, d):
    """Sums of values by weights."""
    return relational.weighted_total(table(spark, d, "lineitem"), F.col("l_quantity"), 1 - F.col("l_discount"), ["l_returnflag", "l_linestatus"]).withColumn("total", F.round("total", 2))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS greatest, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def metrics_by_tag(spark, d):
    """Counts, sums and maxima by tag."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("greatest"), F.count_distinct("user_id").alias("users"))


@query("SELECT count(*) AS n, count(*) FILTER (value > 10) AS matches, round(count(*) FILTER (value > 10) / count(*), 6) AS accuracy, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest FROM events")
def evaluation_stats(spark, d):
    """A10: matches, accuracy and the range of scores."""
    stats = relational.score_stats(table(spark, d, "events").withColumn("matched", F.col("value") > 10), "value", "matched")
    return stats.withColumn("accuracy", F.round("accuracy", 6)).withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_check(spark, d):
    """Orders without a customer in good standing."""
    customers = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.orphans(table(spark, d, "orders"), customers, "o_custkey").select("o_orderkey")


@query("""
WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'ACTIVE' WHEN 'click' THEN 'RETIRED' WHEN 'error' THEN 'DELETED' ELSE 'PENDING' END AS s FROM events),
k AS (SELECT user_id, max((ts, s)) AS m FROM e GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS key_id, m[2] AS status, CASE WHEN m[2] = 'ACTIVE' AND m[1] + INTERVAL 1 DAY <= TIMESTAMP '2024-01-31' THEN 'rotate' WHEN m[2] = 'RETIRED' AND m[1] + INTERVAL 2 HOUR <= TIMESTAMP '2024-01-31' THEN 'delete' END AS due FROM k WHERE m[2] <> 'DELETED'
""")
def key_lifecycle_due(spark, d):
    """T4, F8: what each key is due for, its state folded from its events."""
    names = F.when(F.col("event_type") == "view", "activated").when(F.col("event_type") == "click", "retired").when(F.col("event_type") == "error", "deleted").otherwise("created")
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key_id"), names.alias("event"), F.col("ts").cast("timestamp").alias("at"))
    return ordering.due(ordering.key_states(events), F.lit("2024-01-31").cast("timestamp"), F.expr("interval 1 day"), F.expr("interval 2 hours")).select("key_id", "status", "due")


@query("SELECT p_partkey, CASE WHEN contains(n, ':') THEN 'maven' WHEN contains(n, '/') OR starts_with(n, '@') THEN 'npm' WHEN ends_with(u, 'requirements.txt') THEN 'pip' WHEN ends_with(u, '.tar') AND contains(lower(u), 'alpine') THEN 'os_apk' WHEN ends_with(u, '.tar') THEN 'os_apt' ELSE 'unknown' END AS ecosystem FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'org:' || p_name WHEN 1 THEN '@' || p_name ELSE p_name END AS n, CASE p_size % 4 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'Alpine.tar' WHEN 2 THEN 'image.tar' ELSE p_type END AS u FROM part)")
def ecosystem_classify(spark, d):
    """packages' ecosystems by name and file."""
    k, s = F.col("p_partkey") % 4, F.col("p_size") % 4
    name = F.when(k == 0, F.concat(F.lit("org:"), "p_name")).when(k == 1, F.concat(F.lit("@"), "p_name")).otherwise(F.col("p_name"))
    uri = F.when(s == 0, "requirements.txt").when(s == 1, "Alpine.tar").when(s == 2, "image.tar").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", packages.ecosystem(name, uri).alias("ecosystem"))
