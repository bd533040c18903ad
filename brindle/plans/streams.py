"""Queries that run a stream over the events table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.plans.base import query, table
from brindle.storage import scratch
from brindle.streaming import jobs
from brindle.streaming.lifecycle import key_life, state_in_rocksdb


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_new_files(spark, d):
    """Events taken from files as a stream, then counted."""
    at = scratch(spark)
    events = table(spark, d, "events")
    stream = jobs.new_files(spark, f"{d}/events.parquet", events.schema)
    jobs.run_available(stream.select("event_type", "value"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("event_type string, value double").parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, CASE WHEN last_type = 'signup' AND epoch_us(ts) - epoch_us(last_ts) < 300000000 THEN CAST(last_id AS VARCHAR) END AS value
FROM (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER w AS last_type, lag(event_id) OVER w AS last_id, lag(ts) OVER w AS last_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE event_type <> 'signup'
""")
def stream_ttl_state(spark, d):
    """Signups put a value that lives 300 seconds, later events of the user read it once; the stream's order within a batch follows time."""
    at = scratch(spark)
    events = table(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "put").otherwise("get")
    rows = jobs.new_files(spark, f"{d}/events.parquet", events.schema).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").cast("string").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    rows = rows.select("key", "seq", "op", "value", (F.col("us") / 1e6).alias("at"), F.lit(300.0).alias("ttl"))
    with state_in_rocksdb(spark):
        jobs.run_available(jobs.read_once(rows), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("key string, seq bigint, value string").parquet(f"{at}/out")


KEY_EVENTS = {"signup": "created", "purchase": "activated", "click": "retired", "error": "deleted"}
GRACE, ROTATION, RETENTION = 6 * 3600, 12 * 3600, 10 * 3600


@query(f"""
WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) AS us, event_id AS seq, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KEY_EVENTS.items())} END AS event FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
allof AS (SELECT * FROM e UNION ALL SELECT key, (SELECT max(us) // 1000 * 1000 - 60000000 FROM e), NULL, 'end' FROM (SELECT DISTINCT key FROM e)),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event = 'end' NULLS FIRST, us, seq) AS i FROM allof),
s AS (SELECT key, 0::BIGINT AS i, 3 AS was, 3 AS aged, 3 AS idx, 0::BIGINT AS old, 0::BIGINT AS base, 0::BIGINT AS us, NULL::VARCHAR AS event FROM (SELECT DISTINCT key FROM e)
 UNION ALL SELECT key, i, was, aged, CASE WHEN event = 'created' AND aged = 3 THEN 0 WHEN event = 'activated' AND aged = 0 THEN 1 WHEN event = 'retired' AND aged = 1 THEN 2 WHEN event = 'deleted' THEN 3 ELSE aged END,
  base, CASE WHEN event = 'created' AND aged = 3 THEN us WHEN event = 'activated' AND aged = 0 THEN us - {GRACE}000000 WHEN event = 'retired' AND aged = 1 THEN us - {GRACE + ROTATION}000000 ELSE base END, us, event
 FROM (SELECT o.key, o.i, s.idx AS was, s.base, o.us, o.event, greatest(s.idx, CASE WHEN o.us >= base + {GRACE + ROTATION + RETENTION}000000 THEN 3 WHEN o.us >= base + {GRACE + ROTATION}000000 THEN 2 WHEN o.us >= base + {GRACE}000000 THEN 1 ELSE 0 END) AS aged
  FROM s JOIN o ON o.key = s.key AND o.i = s.i + 1)),
name AS (SELECT ['PENDING', 'ACTIVE', 'RETIRED', 'DELETED'] AS n, [0, {GRACE}000000, {GRACE + ROTATION}000000, {GRACE + ROTATION + RETENTION}000000] AS g)
SELECT CAST(key AS VARCHAR) AS key_id, old + g[j + 1] AS us, n[j] AS before, n[j + 1] AS after, 'age' AS cause FROM (SELECT *, unnest(range(was + 1, aged + 1)) AS j FROM s WHERE was < 3), name
UNION ALL SELECT CAST(key AS VARCHAR), us, CASE WHEN aged < 3 THEN n[aged + 1] END, n[idx + 1], 'event' FROM s, name WHERE i > 0 AND aged <> idx
""")
def key_life_stream(spark, d):
    """T4: users' events as keys' lives: a key goes on by age where no event comes, up to a minute before the last event of all."""
    at = scratch(spark)
    events = table(spark, d, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in KEY_EVENTS.items()], F.lit(""))
    stream = jobs.new_files(spark, f"{d}/events.parquet", events.schema)
    stream = stream.select(F.col("user_id").alias("key_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.col("ts").cast("timestamp").alias("at"))
    with state_in_rocksdb(spark):
        jobs.run_available(key_life(stream, GRACE, ROTATION, RETENTION, "1 minute"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("key_id string, us bigint, before string, after string, cause string").parquet(f"{at}/out")
