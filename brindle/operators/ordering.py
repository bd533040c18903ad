"""Positional operators as windows: dedup, ranks, runs, shards, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.relational import small
from brindle.storage import cut


def seeded(seed: int, *keys: str) -> Column:
    """A reproducible random order: the hash of a seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def keep_first(df: DataFrame, same: Column, order: list[Column]) -> DataFrame:
    """The first row of each group of equal ``same``, null being a value."""
    rank = F.row_number().over(Window.partitionBy("__same").orderBy(*order))
    return df.withColumn("__same", same).withColumn("__rank", rank).filter("__rank = 1").drop("__same", "__rank")


def message_key(messages: Column, most: int = 150) -> Column:
    """Role and first characters of every message, hashed."""
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m.role, F.lit(":"), F.left(m.content, F.lit(most)))), "|"))


def latest_state(events: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """Each key's last state, of equal times the greatest; a maximum, so combined before the shuffle."""
    return events.groupBy(key).agg(F.max(F.struct(at, state)).alias("m")).select(key, F.col(f"m.{state}").alias(state), F.col(f"m.{at}").alias(at))


def runs(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """For each row how many rows in succession have had the flag, 0 where it hasn't."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum((~flag).cast("int")).over(w)
    marked = df.withColumn("__island", island).withColumn("__flag", flag.cast("int"))
    return marked.withColumn("run", F.sum("__flag").over(Window.partitionBy(key, "__island").orderBy(*order))).drop("__island", "__flag")


def rolling_mean(df: DataFrame, key: str, order: list[str], value: str, rows: int = 5) -> DataFrame:
    """The mean of the last rows, this one included."""
    return df.withColumn("rolling", F.avg(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(1 - rows, 0)))


def after_newest(df: DataFrame, key: str, order: list[Column], keep: int = 5) -> DataFrame:
    """Of each key all rows but the first ones of the order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") > keep)


def ranked(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``df`` with rank (from 1) in the order of columns, within groups of ``by`` if given, and group_size.

    Rows are range-partitioned and sorted once and numbered there; a rank is that number less the
    first of its group in the partition, plus what the group has in earlier partitions. So a group
    with a third of all rows, or a rank over all of them, is the work of many tasks.
    """
    by = by or []
    numbered = cut(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    groups = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    names = [f"__g{i}" for i in range(len(by))]
    runs = numbered.groupBy(*groups, part.alias("__part")).agg(F.min("__id").alias("__lo"), F.count("*").alias("__n"))  # a row for each group and partition
    over = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    before = runs.select(*names, "__part", "__lo", (F.sum("__n").over(over.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(over).alias("group_size"))
    same = part == F.col("__part")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    joined = numbered.join(small(before), same)
    return joined.withColumn("rank", F.col("__id") - F.col("__lo") + F.col("__before") + 1).drop("__id", "__part", "__lo", "__before", *names)


def shards(df: DataFrame, order: list[str], rows_per_shard: int) -> DataFrame:
    """Contiguous shards of an order, numbered from 0."""
    return ranked(df, order).withColumn("shard", F.floor((F.col("rank") - 1) / rows_per_shard).cast("long")).drop("rank", "group_size")


def by_priority(df: DataFrame, column: str, values: list[str], then: list[Column]) -> DataFrame:
    """O1: an order by a list of values, others last, then by ``then``; the place is a column."""
    priority = F.coalesce(*[F.when(F.col(column) == v, F.lit(i)) for i, v in enumerate(values)], F.lit(len(values)))
    return df.withColumn("priority", priority).orderBy("priority", *then)


def key_states(events: DataFrame, key: str = "key_id") -> DataFrame:
    """A key's status by its events: created PENDING, activated ACTIVE, retired RETIRED; a deleted key is left out."""
    status = F.when(F.col("event") == "activated", "ACTIVE").when(F.col("event") == "retired", "RETIRED").when(F.col("event") == "deleted", "DELETED").otherwise("PENDING")
    return latest_state(events.withColumn("status", status), key, "at", "status").filter("status <> 'DELETED'")


def due(keys: DataFrame, now: Column, rotate_after: Column, keep_retired: Column) -> DataFrame:
    """F8, T4: what a key is due for: rotation of an active key of that age, deletion of a retired one past its time; null otherwise."""
    action = F.when((F.col("status") == "ACTIVE") & (F.col("at") + rotate_after <= now), "rotate").when((F.col("status") == "RETIRED") & (F.col("at") + keep_retired <= now), "delete")
    return keys.withColumn("due", action)


def violations(keys: DataFrame, allowed: tuple[str, ...] = ("PENDING", "ACTIVE", "RETIRED")) -> DataFrame:
    """what breaks the rules of the key table: statuses not allowed, and other than one active key."""
    wrong = keys.filter(~F.col("status").isin(*allowed) | F.col("status").isNull()).select(F.lit("status").alias("rule"), "key_id")
    active = keys.agg(F.count_if(F.col("status") == "ACTIVE").alias("n")).filter("n <> 1").select(F.lit("one_active").alias("rule"), F.lit(None).cast("string").alias("key_id"))
    return wrong.unionByName(active)


def live(entries: DataFrame, now: Column) -> DataFrame:
    """Entries whose time isn't over; at that very moment it is."""
    return entries.filter(F.col("expires_at") > now)


def since(df: DataFrame, at: str, last: Column) -> DataFrame:
    """Rows after the last check; all within 90 days if there was none."""
    return df.filter(F.col(at) > F.coalesce(last, F.current_timestamp() - F.expr("interval 90 days")))


def newest(df: DataFrame, at: str, then: list[str], most: int) -> DataFrame:
    """The newest rows, of one time by the other columns; a top-k, so each task keeps that many at most."""
    return df.orderBy(F.desc(at), *then).limit(most)


def audit(events: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """For each change of a key's row an audit row: from which state to which; the first has none before it and is left out."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(at))
    return events.withColumn("event", F.concat(before, F.lit(">"), F.col(state))).filter("event is not null").select(key, at, "event")
