"""Corpora: paired files, JSON lines, source trees, releases, metadata tokens, captured feeds."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import schemas
from brindle.functions import packages, text


def paired_files(spark: SparkSession, folder: str, limit: int = 500_000) -> DataFrame:
    """The pairs of ``paired`` among the files below a folder."""
    return paired(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), limit)


def paired(files: DataFrame, limit: int = 500_000) -> DataFrame:
    """``CWE-n/language/bad_id`` with the ``good_id`` beside it: cwe_id, language_dir, file_pair_id, vulnerable_code, fixed_code.

    ``files`` has path and content (bytes). Files beyond the limit have null text, bad ones without a good one are left out.
    """
    part = lambda i: F.regexp_extract("path", r"(CWE-[^/]+)/([^/]+)/(bad|good)_([^/]+)$", i)
    rows = files.select(part(1).alias("cwe_id"), part(2).alias("language_dir"), part(3).alias("side"), part(4).alias("file_pair_id"), text.safe_decode(F.col("content"), limit).alias("body")).filter("side <> ''")
    keys = ["cwe_id", "language_dir", "file_pair_id"]
    bad, good = (rows.filter(F.col("side") == s).select(*keys, F.col("body").alias(c)) for s, c in (("bad", "vulnerable_code"), ("good", "fixed_code")))
    return bad.join(good, keys).withColumn("language", packages.directory_language(F.col("language_dir")))


def selected_pairs(pairs: DataFrame, languages: list[str], most: int) -> DataFrame:
    """pairs of some languages, the first so many by class and pair id."""
    return pairs.filter(F.col("language").isin(languages)).orderBy("cwe_id", "language_dir", "file_pair_id").limit(most)


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; a bad one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def releases(spark: SparkSession, path: str, newest: int = 10) -> DataFrame:
    """The newest releases of a captured list."""
    return newest_releases(spark.read.schema(schemas.RELEASE).option("multiLine", True).json(path), newest)


def newest_releases(found: DataFrame, newest: int = 10) -> DataFrame:
    """The newest releases, of one time the first by tag."""
    return found.orderBy(F.desc("published_at"), "tag_name").limit(newest)


# Methods of routes, and of source files by suffix: what their routes' handlers are called, whose calls they are (any
# receiver's where none is named), which quotes a path may have, and what follows it.
METHODS = ["get", "post", "put", "delete", "patch"]
ROUTING = {".kt": ("kotlin_ktor", None, "\"", ")"), ".ts": ("typescript_express", ["app", "router"], "\"'", ",")}
def routes(spark: SparkSession, folder: str) -> DataFrame:
    """The routes that the source files below a folder define."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{kt,ts}").text(folder, wholetext=True)
    return routes_in(files.select(F.col("_metadata.file_path").alias("file"), "value"))


def _routes(line: Column, receivers: list[str] | None, quotes: str, then: str) -> Column:
    """array of struct (method, path) of a line's calls of a method's name with a quoted path that isn't empty and is followed by ``then``. What follows a bracket is only looked at, so calls within calls are found too."""
    owner = rf"(?<!\w)(?:{'|'.join(receivers)}) *\.(?:[\w\s]*\s)?" if receivers else r"(?<!\w)"
    found = []
    for quote in quotes:
        call = F.lit(rf"{owner}({'|'.join(METHODS)}) *\( *(?={quote}([^{quote}]+){quote} *{re.escape(then)})")
        both = F.arrays_zip(F.regexp_extract_all(line, call, 1).alias("method"), F.regexp_extract_all(line, call, 2).alias("path"))
        found.append(F.when(F.rlike(line, call), F.transform(both, lambda c: F.struct(F.upper(c["method"]).alias("method"), c["path"].alias("path")))).otherwise(F.array().cast("array<struct<method:string,path:string>>")))
    return F.concat(*found)


def routes_in(files: DataFrame) -> DataFrame:
    """Method, path, file, line (from 1) and handler of each route in ``files`` (file, value): calls within a line. The files are read once for all kinds of sources."""
    ends = {suffix: F.endswith("file", F.lit(suffix)) for suffix in ROUTING}
    own = files.filter(reduce(operator.or_, ends.values())).select("file", F.posexplode(F.split("value", "\n")).alias("at", "body"))
    of = lambda value: F.coalesce(*[F.when(ends[suffix], value(*rule)) for suffix, rule in ROUTING.items()])
    found = of(lambda handler, *rule: _routes(F.col("body"), *rule))
    lines = own.filter(F.contains("body", F.lit("("))).select("file", "at", F.inline(found))
    return lines.select("method", "path", "file", (F.col("at") + 1).alias("line"), of(lambda handler, *rule: F.lit(handler)).alias("handler"))


def commits_about(commits: DataFrame, words: str, newest: int = 20, most: int = 2000) -> DataFrame:
    """The newest commits whose message fits a pattern, in any case, their diffs cut. ``commits`` has hash, at, message, diff."""
    found = commits.filter(F.col("message").rlike(f"(?i){words}")).orderBy(F.desc("at"), "hash").limit(newest)
    return found.withColumn("diff", F.left("diff", F.lit(most)))


def metadata_status(tokens: DataFrame, schema: str) -> DataFrame:
    """Entries and their status reports of metadata tokens (``token``), one row a report."""
    return tokens.select(text.jwt_payload(F.col("token"), schema).alias("p")).select(F.explode("p.entries").alias("e")).select("e.*", F.explode("e.statusReports").alias("report"))


def tree_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``line_counts`` of each source file below a folder."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{py,kt,ts,js,java}").text(folder)
    return line_counts(lines.select(F.col("_metadata.file_path").alias("file"), "value"))


def line_counts(lines: DataFrame) -> DataFrame:
    """Lines, classes and functions of each file; ``lines`` has file and value."""
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("value").rlike(r"^\s*(\w+\s+)*class\s+\w+")).alias("classes"), F.count_if(F.col("value").rlike(r"^\s*(\w+\s+)*(def|fun|function)\s+\w+")).alias("functions"))


def file_totals(files: DataFrame) -> DataFrame:
    """How many files there are and how many kilobytes in all; ``files`` has content (bytes)."""
    return files.agg(F.count("*").alias("total_files"), (F.coalesce(F.sum(F.length("content")), F.lit(0)) / 1024).alias("total_size_kb"))
