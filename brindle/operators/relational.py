"""Filters, joins and aggregations over findings, corpora and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.functions.packages import PLACEHOLDER, route_pattern, source_candidates, stat_number
from brindle.functions.severity import ORDER
from brindle.operators.search import mentions
from brindle.schemas import parsed
from brindle.storage import cut, small

def conform(df: DataFrame, schema: str | StructType) -> DataFrame:
    """Columns of a schema, in its order; missing ones and values that can't be cast are null."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in parsed(schema)])


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all parts by column name; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def reject(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``df`` with reject_reason, the first of the named conditions that holds, null if none does."""
    return df.withColumn("reject_reason", F.coalesce(*[F.when(c, F.lit(n)) for n, c in reasons.items()]))


def pair_quality(before: Column, after: Column, least: int = 50, most: int = 500_000) -> dict[str, Column]:
    """why a pair of texts is left out, in the order in which it is asked."""
    return {
        "unreadable": before.isNull() | after.isNull(),
        "identical": F.trim(before) == F.trim(after),
        "too_short": (F.length(F.trim(before)) < least) | (F.length(F.trim(after)) < least),
        "too_large": (F.octet_length(before) > most) | (F.octet_length(after) > most),
    }


def left_chain(fact: DataFrame, steps: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Left joins one after another; rows multiply where a step has several matches."""
    return reduce(lambda df, step: df.join(step[0], step[1], "left"), steps, fact)


def unseen(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't known; a null key is never known."""
    return new.join(known.select(*keys).distinct(), keys, "left_anti")


def fatal_lookup(df: DataFrame, dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """A left join to a dictionary that ends the job where the key is missing."""
    joined = df.join(small(dictionary.select(key, value)), key, "left")
    return joined.withColumn(value, F.coalesce(value, F.raise_error(F.format_string("no entry for %s", F.col(key).cast("string")))))


def newest_mention(advisories: DataFrame, releases: DataFrame) -> DataFrame:
    """Of each advisory (id, keywords array) the newest release (tag, body, published) whose text holds one of its keywords.

    All keywords are looked for in one pass over the releases' texts, which stay where they are.
    """
    words = advisories.select(F.explode("keywords").alias("k")).select(F.lower("k").alias("k"))
    lowered = releases.select("published", "tag", F.lower("body").alias("body"))
    found = mentions(lowered, "body", words, ["published", "tag"]).groupBy("k").agg(F.max(F.struct("published", "tag")).alias("m"))
    matched = advisories.select("id", F.explode("keywords").alias("k")).select("id", F.lower("k").alias("k")).join(found, "k").groupBy("id").agg(F.max("m").alias("m"))
    return advisories.join(matched, "id", "left").select(advisories["*"], F.col("m.tag").alias("release"), F.col("m.published").alias("released_at"))


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) for each document (doc_id, text) whose text holds an item (item_id, item) as it is written.

    Where a document holds an item, it has the words between the item's first and last blank as words too. So the longest of these is the
    key of a join; only documents that have it are searched for the item. Items without such a word are searched for in all, in one pass.
    """
    inner = F.filter(F.slice(F.split("item", " "), F.lit(2), F.greatest(F.size(F.split("item", " ")) - 2, F.lit(0))), lambda w: w != "")
    keyed = items.withColumn("word", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("w")))).w)
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    near = words.join(small(keyed.filter("word is not null").select("word", "item_id")), "word").select(F.col("doc_id").alias("near_id"), "item_id").distinct()
    near = small(cut(near))
    searched = docs.join(near, docs["doc_id"].eqNullSafe(near["near_id"])).join(small(items.select(F.col("item_id").alias("own_id"), "item")), F.col("item_id") == F.col("own_id"))
    found = searched.filter(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    rest = keyed.filter("word is null and item is not null").select("item_id", F.col("item").alias("k"))
    short = mentions(docs, "text", rest, ["doc_id"]).join(small(rest), "k").select("doc_id", "item_id")
    return found.unionByName(short).distinct()


def _kept_parts(route: Column) -> Column:
    """The places (from 0) of a route's parts without a placeholder."""
    parts = F.split(route, "/", -1)
    plain = F.transform(parts, lambda p, i: F.when(F.regexp_replace(p, PLACEHOLDER, "") == p, i))
    return F.array_compact(plain)


def match_routes(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """Of each distinct ``path`` the route that equals it, else that whose pattern fits; of several the shortest, then the first in the alphabet.

    A route can only fit a path of as many parts that has the route's plain parts at the same places. Routes differ
    in few sets of such places (their shapes), so a path has a key for each shape of its number of parts, and meets
    the routes of that key only. The pattern is tried on what has met.
    """
    parts = lambda c: F.split(c, "/", -1)
    key = lambda c, places: F.to_json(F.transform(places, lambda p: F.get(parts(c), p)))
    shape = [F.size(parts("route")).alias("n"), _kept_parts(F.col("route")).alias("places")]
    listed = routes.select("route").filter("route is not null").distinct().select("route", *shape)
    keyed = listed.withColumn("key", key("route", F.col("places"))).withColumn("pattern", route_pattern(F.col("route")))
    shapes = small(listed.select("n", "places").distinct())
    distinct = paths.select("path").filter("path is not null").distinct().withColumn("n", F.size(parts("path")))
    asked = distinct.join(shapes, "n").withColumn("key", key("path", F.col("places")))
    fits = asked.join(small(keyed), ["n", "places", "key"]).filter((F.col("path") == F.col("route")) | F.expr("path rlike pattern"))
    best = fits.groupBy("path").agg(F.min(F.struct((F.col("path") != F.col("route")).alias("by_pattern"), F.length("route").alias("n"), "route")).alias("b"))
    return paths.join(best, "path", "left").select(paths["*"], F.col("b.route").alias("route"))


def best_source(scans: DataFrame, files: DataFrame) -> DataFrame:
    """Of each scanned ``path`` the file with the same base name that shares most parts with it; of several the shortest, then the first in the alphabet."""
    name = lambda c: F.substring_index(c, "/", -1)
    both = scans.select("path").distinct().withColumn("name", name("path")).join(files.select("file").distinct().withColumn("name", name("file")), "name")
    shared = F.size(F.array_intersect(F.split("path", "/"), F.split("file", "/")))
    best = both.groupBy("path").agg(F.min(F.struct((-shared).alias("minus"), F.length("file").alias("n"), "file")).alias("b"))
    return scans.join(best, "path", "left").select(scans["*"], F.col("b.file").alias("file"))


def suffixes(path: str | Column) -> Column:
    """The ends of a path by whole parts, the longest first."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def resolve_sources(scans: DataFrame, files: DataFrame) -> DataFrame:
    """Of each scanned ``path`` the source ``file``, and by which rule (how) it was found.

    The candidates that ``source_candidates`` makes of a path are tried in order for a file of exactly that path; how is the
    number of the first that there is. Otherwise it is the file that shares the longest end of whole parts with the path, one
    at least (how is 'suffix'); of several the shortest, then the first in the alphabet. Neither is null.

    Each end of any file's path stands for its best file only, so a name that a great many files have is one row.
    """
    paths = scans.select("path").filter("path is not null").distinct()
    own = files.select("file").filter("file is not null").distinct()
    direct = paths.select("path", F.posexplode(source_candidates(F.col("path"))).alias("at", "x"))
    direct = direct.filter("x.candidate is not null").select("path", "at", F.col("x.how").alias("how"), F.col("x.candidate").alias("file")).join(own, "file")
    ends = own.select("file", F.explode(suffixes("file")).alias("end")).groupBy("end").agg(F.min(F.struct(F.length("file").alias("n"), "file")).file.alias("file"))
    near = paths.select("path", F.posexplode(suffixes("path")).alias("at", "end")).filter("end <> ''").join(ends, "end").select("path", (F.col("at") + 1000).alias("at"), F.lit("suffix").alias("how"), "file")
    best = direct.select("path", "at", "how", "file").unionByName(near).groupBy("path").agg(F.min(F.struct("at", "how", "file")).alias("b"))
    return scans.join(best, "path", "left").select(scans["*"], F.col("b.file").alias("file"), F.col("b.how").alias("how"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def grouped_records(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A1: a row a key with all its records in order; rows without a key are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("records"))


def severity_totals(df: DataFrame, column: str = "severity") -> DataFrame:
    """A5: how many rows of each severity, in one row."""
    return df.agg(*[F.count_if(F.col(column) == s).alias(s.lower()) for s in ORDER], F.count("*").alias("total"))


def pivot_counts(df: DataFrame, rows: str, column: str, values: list[str]) -> DataFrame:
    """Rows by values, counted; 0 where there are none. The values are given, so no job runs to find them."""
    return df.groupBy(rows).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """The commonest values, of equal ones the first in the alphabet."""
    counts = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts.limit(top) if top else counts


def score_stats(df: DataFrame, score: str, matched: str) -> DataFrame:
    """A10: rows, matches, accuracy, mean, least and greatest score; accuracy 0 without rows."""
    return df.agg(F.count("*").alias("n"), F.count_if(matched).alias("matches"), F.coalesce(F.avg(F.col(matched).cast("double")), F.lit(0.0)).alias("accuracy"), F.avg(score).alias("mean"), F.min(score).alias("least"), F.max(score).alias("greatest"))


def token_stats(df: DataFrame, tokens: str, most: int) -> DataFrame:
    """Rows in all, kept and dropped at a limit of tokens, the share dropped, and the range of tokens."""
    n, kept = F.count("*"), F.count_if(F.col(tokens) <= most)
    return df.agg(n.alias("n"), kept.alias("kept"), (n - kept).alias("dropped"), F.when(n > 0, (n - kept) / n).otherwise(0.0).alias("dropped_share"), F.min(tokens).alias("least"), F.max(tokens).alias("greatest"), F.avg(tokens).alias("mean"))


def whitespace_tokens(text: str | Column) -> Column:
    """Runs of other than white space; stands for a model's tokens, of which there are more. 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def dataset_card(df: DataFrame, split: str, quality: str) -> DataFrame:
    """Rows and their percentage of the split, by split and quality."""
    counts = df.groupBy(split, quality).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(split)), 2))


def weighted_total(df: DataFrame, value: Column, weight: Column, by: list[str]) -> DataFrame:
    """Sums of value by weight."""
    return df.groupBy(*by).agg(F.sum(value * weight).alias("total"))


def extraction_totals(results: DataFrame) -> DataFrame:
    """Totals of extractions (success, path): how many went well, the rate (0 without any), distinct files of the good ones."""
    ok, n = F.count_if("success"), F.count("*")
    return results.agg(
        n.alias("total"), ok.alias("successful"), (n - ok).alias("failed"), F.coalesce(F.try_divide(ok.cast("double"), n), F.lit(0.0)).alias("success_rate"),
        F.count_distinct(F.when(F.col("success"), F.col("path"))).alias("unique_files"),
    )


def numstats(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, file, added and deleted of each file in texts of numbers, as ``packages.numstat`` has them in a map; a row a line, grouped in one hash pass where the key's texts are."""
    lines = diffs.select(key, text).repartition(key).select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).filter(F.substring_index("line", "\t", 2) != F.col("line"))
    part = lambda i: F.split_part("line", F.lit("\t"), F.lit(i))
    parts = lines.select(key, part(3).alias("file"), stat_number(part(1)).alias("added"), stat_number(part(2)).alias("deleted"), "at")
    return parts.groupBy(key, "file").agg(F.max_by("added", "at").alias("added"), F.max_by("deleted", "at").alias("deleted"))
