"""Splits, quotas, replay and augmentation; every draw is a hash of a seed and a key, so it is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.chat import replace_terms
from brindle.operators.ordering import ranked, seeded
from brindle.operators.relational import small
from brindle.storage import cut

#: Buckets of a drawn row's interval that one task makes at a time.
PIECE = 1000


def split_of(rank: Column, n: Column, small_rule: bool = True) -> Column:
    """Train, validation or test by a row's rank (from 1) in its stratum of n: 80/10/10, with the rule for small strata if wanted."""
    train, val = F.floor(n * 0.8), F.floor(n * 0.1)
    plain = F.when(rank <= train, "train").when(rank <= train + val, "validation").otherwise("test")
    if not small_rule:
        return plain
    few = F.when(rank == 1, "test").when(rank == 2, "validation").otherwise("train")
    return F.when(n <= 2, "test").when(n < 10, few).otherwise(plain)


def stratified_split(df: DataFrame, stratum: str, key: str, seed: int = 42, small_rule: bool = True) -> DataFrame:
    """``df`` with split; sizes are those of the rule, members follow from the hash order."""
    placed = ranked(df.withColumn("__draw", seeded(seed, key)), ["__draw", key], [stratum])
    return placed.withColumn("split", split_of(F.col("rank"), F.col("group_size"), small_rule)).drop("rank", "group_size", "__draw")


def quota(df: DataFrame, group: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """Target // groups rows of each group, one more of the first groups in the alphabet for the remainder."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    total = sizes.count()
    own = sizes.withColumn("at", F.row_number().over(Window.orderBy(group)))  # one row a group
    own = own.withColumn("quota", F.lit(target // max(total, 1)) + (F.col("at") <= target % max(total, 1)).cast("int")).select(F.col(group).alias("__g"), "quota")
    placed = ranked(df.withColumn("__draw", seeded(seed, key)), ["__draw", key], [group])
    return placed.join(small(own), F.col(group).eqNullSafe(F.col("__g"))).filter("rank <= quota").drop("__g", "quota", "rank", "group_size", "__draw")


def sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """So many rows, the first of the hash order."""
    return df.orderBy(seeded(seed, key), key).limit(rows)


def replay_mix(new: DataFrame, old: DataFrame, key: str, ratio: float = 0.15, base: str = "stage2", weight: float = 0.5, seed: int = 42) -> DataFrame:
    """New rows and a sample of old ones, of ``ratio`` of the new (stage2) or the old (stage1), as many as there are at most; marked and weighted."""
    n = int((new if base == "stage2" else old).count() * ratio)
    mark = lambda df, replay, w: df.withColumn("is_replay", F.lit(replay)).withColumn("loss_weight", F.lit(w))
    return mark(new, False, 1.0).unionByName(mark(sample(old, key, n, seed), True, weight), allowMissingColumns=True)


def adapt_ratio(ratio: Column, forgetting: Column) -> Column:
    """A replay ratio grows by half up to 0.5 on severe forgetting, by a fifth up to 0.3 on moderate."""
    return F.when(forgetting == "severe", F.least(ratio * 1.5, F.lit(0.5))).when(forgetting == "moderate", F.least(ratio * 1.2, F.lit(0.3))).otherwise(ratio)


def diversity(df: DataFrame, type_: str) -> DataFrame:
    """1 / (rows of the type + 1); the counts are made before they are joined, so a common type is one row."""
    counts = df.groupBy(F.col(type_).alias("__t")).agg(F.count("*").alias("__n"))
    return df.join(small(counts), F.col(type_).eqNullSafe(F.col("__t"))).withColumn("diversity", 1.0 / (F.col("__n") + 1)).drop("__t", "__n")


def weighted_draws(df: DataFrame, key: str, weight: Column, draws: int, seed: int = 42) -> DataFrame:
    """U8, Q2: so many draws with replacement, each row's chance being its weight; draw i is a hash of the seed and i.

    Weights are summed along the key's order by range partition, so no task holds all rows; a draw
    is met with the row whose interval of the total holds it by buckets of that total.
    """
    ranged = df.withColumn("__w", weight.cast("double")).filter("__w > 0").repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged)
    sizes = ranged.groupBy("__part").agg(F.sum("__w").alias("__s"))
    before = sizes.select("__part", (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__before"), F.sum("__s").over(Window.partitionBy()).alias("__total"))  # one row a partition
    upto = F.sum("__w").over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    placed = ranged.join(F.broadcast(before), "__part").withColumn("__hi", upto / F.col("__total")).withColumn("__lo", (upto - F.col("__w")) / F.col("__total"))
    bucket = lambda c: F.floor(c * draws).cast("long")
    # A row of great weight has many buckets: they are made by pieces, in as many tasks as there are.
    pieces = placed.withColumn("__last", bucket(F.col("__hi"))).withColumn("__from", F.explode(F.sequence(bucket(F.col("__lo")), "__last", F.lit(PIECE))))
    spread_out = pieces.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__from")
    rows = spread_out.withColumn("__b", F.explode(F.sequence("__from", F.least(F.col("__from") + (PIECE - 1), "__last")))).drop("__from", "__last")
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 10), 16, 10).cast("double") / float(1 << 40)
    points = df.sparkSession.range(draws).select(F.col("id").alias("draw"), drawn.alias("__u")).withColumn("__b", bucket(F.col("__u")))
    met = rows.join(points, "__b").filter("__u >= __lo and __u < __hi")
    return met.drop("__w", "__part", "__before", "__total", "__hi", "__lo", "__b", "__u")


def oversample(df: DataFrame, chosen: Column, multiplier: float = 2.5) -> DataFrame:
    """Chosen rows int(multiplier) times, others once, numbered by ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(chosen, int(multiplier) - 1).otherwise(0))))


def augment(df: DataFrame, key: str, text: str, per_row: int = 7) -> DataFrame:
    """Each row as it is (variant 0) and variants with other terms, those that came out unchanged left out (Q12)."""
    rows = df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(per_row))))
    new = replace_terms(F.col(text), F.concat_ws("-", F.col(key).cast("string"), F.col("variant").cast("string")))
    rows = rows.withColumn("__old", F.col(text)).withColumn(text, F.when(F.col("variant") == 0, F.col(text)).otherwise(new))
    return rows.filter((F.col("variant") == 0) | (F.col(text) != F.col("__old"))).withColumn("is_augmented", F.col("variant") > 0).drop("__old")


def blend(df: DataFrame, group: str, order: list[str], text: str, target: int) -> DataFrame:
    """Rows whose text is made of the first lines of their own and of the next row's of the same group; the first ``target`` in the order."""
    rows = ranked(df, order, [group])
    after = rows.select(F.col(group).alias("__group"), (F.col("rank") - 1).alias("__rank"), F.col(text).alias("__text"))
    line = lambda c: F.substring_index(c, "\n", 1)
    blended = F.concat(line(F.col(text)), F.lit("\n"), line(F.col("__text")), F.lit("\n\nConsider these related findings together."))
    pairs = rows.join(after, (F.col(group) == F.col("__group")) & (F.col("rank") == F.col("__rank")))
    return pairs.withColumn(text, blended).drop("__group", "__rank", "__text", "rank", "group_size").orderBy(*order).limit(target)
