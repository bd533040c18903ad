"""Queries that run scalar functions, filters and small operators which no other query runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle import schemas
from brindle.functions import advisories, analysis, chat, code, keywords, packages, severity, text
from brindle.operators import ordering, relational, sampling, similarity
from brindle.plans.base import query, table
from brindle.sources import corpora, sinks
from brindle.storage import scratch


@query("""
SELECT p_partkey, 'int main() { ' || replace(p_name, 'a', 'A') || ' }' AS wrapped, 'import x' || chr(10) || p_name || chr(10) || '// end' AS framed,
 CASE WHEN p_size % 3 = 0 THEN 'X-Content-Type-Options: nosniff' WHEN p_size % 3 = 1 THEN 'Cache-Control: no-store, private' ELSE 'ask ' || p_brand END AS fix FROM part
""")
def code_templates(spark, d):
    """Code after a template's steps, and the setting that answers an alert."""
    steps = [{"type": "replace", "pattern": "a", "replacement": "A"}, {"type": "wrap", "prefix": "int main() { ", "suffix": " }"}]
    frame = [{"type": "prepend", "code": "import x"}, {"type": "append", "code": "// end"}]
    alert = F.when(F.col("p_size") % 3 == 0, "X-Content-Type-Options missing").when(F.col("p_size") % 3 == 1, "Cacheable content").otherwise("other")
    return table(spark, d, "part").select("p_partkey", analysis.transformed(F.col("p_name"), steps).alias("wrapped"), analysis.transformed(F.col("p_name"), frame).alias("framed"), analysis.header_fix(alert, F.concat(F.lit("ask "), "p_brand")).alias("fix"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 OR p_size % 2 = 0 THEN 3 END AS n, CASE WHEN p_partkey % 3 <> 0 OR p_size % 2 = 0 THEN concat_ws(chr(10), 'Finding: F' || p_partkey, 'Severity: HIGH', 'Location: ' || p_brand, 'Description: ' || p_name, CASE WHEN p_partkey % 3 = 0 THEN 'Installed: 1.0' END) END AS ask FROM part
""")
def finding_chats(spark, d):
    """Findings with a fix as examples; nothing where a dependency's versions are missing."""
    k = F.col("p_partkey")
    fix = F.struct(F.lit("d").alias("description"), F.lit("c").alias("fixed_code"), F.lit("e").alias("explanation"), F.when(F.col("p_size") % 2 == 0, "1.0").alias("from_version"), F.lit("2.0").alias("to_version"))
    rows = table(spark, d, "part").withColumn("fix", fix).withColumn("category", F.when(k % 3 == 0, "container_security").otherwise("web_security"))
    example = chat.finding_example(F.col("category"), F.concat(F.lit("F"), k), F.lit("HIGH"), F.col("p_brand"), F.col("p_name"), F.col("fix"))
    return rows.select("p_partkey", example.alias("m")).select("p_partkey", F.nullif(F.size("m"), F.lit(-1)).alias("n"), F.try_element_at("m", F.lit(2)).content.alias("ask"))


@query("SELECT p_brand, sum(p_size) + count(*) AS added, sum(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END) AS deleted FROM part GROUP BY p_brand")
def numstat_totals(spark, d):
    """Lines added and deleted by numbers of a diff's files; a dash is 0, of a repeated file the last counts."""
    k = F.col("p_partkey")
    body = F.concat(F.lit("9\t9\ta.kt\n"), F.col("p_size").cast("string"), F.lit("\t"), F.when(k % 2 == 0, "3").otherwise("-"), F.lit("\ta.kt\n1\t-\tb.png\n\nbad line"))
    stats = F.map_values(packages.numstat(body))
    rows = table(spark, d, "part").select("p_brand", F.explode(stats).alias("s"))
    return rows.groupBy("p_brand").agg(F.sum("s.added").alias("added"), F.sum("s.deleted").alias("deleted"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'src/' || p_partkey || '.py' ELSE 'a/x.py,b/' || p_partkey || '.rs,c/y.rs' END AS paths, CASE p_partkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Python' ELSE 'Rust' END AS language FROM part")
def diff_languages(spark, d):
    """The changed paths of a diff and the language of their commonest suffix."""
    k = F.col("p_partkey")
    two = F.concat(F.lit("--- a/x\n+++ b/a/x.py\n+x\n+++ b/b/"), k, F.lit(".rs\n+++ b/c/y.rs"))
    diff = F.when(k % 4 == 0, "+++ /dev/null").when(k % 4 == 1, F.concat(F.lit("+++ b/src/"), k, F.lit(".py"))).otherwise(two)
    rows = table(spark, d, "part").select("p_partkey", diff.alias("diff"))
    return rows.select("p_partkey", F.array_join(packages.changed_paths(F.col("diff")), ",").alias("paths"), packages.diff_language(F.col("diff")).alias("language"))


@query("""
SELECT p_partkey, p_name AS impact, CASE WHEN p_size % 2 = 0 THEN p_brand END AS remediation, CAST(NULL AS VARCHAR) AS prevention, 'in ' || p_type AS inner_part, p_name || chr(10) || p_brand AS notes, p_type AS steps FROM part
""")
def labelled_texts(spark, d):
    """Labelled parts of a text, what stands between markers, and sections carried forward line by line."""
    rows = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("Impact: "), "p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(". Remediation: "), "p_brand")).otherwise(F.lit(""))).alias("labelled"),
        F.concat(F.lit("a <s> in "), "p_type", F.lit(" </s> b")).alias("marked"), F.concat(F.lit("x\nNotes:\n"), "p_name", F.lit("\n"), "p_brand", F.lit("\nSteps:\n"), "p_type").alias("lines"),
    )
    both = rows.select("p_partkey", text.labelled_parts(F.col("labelled")).alias("p"), text.between(F.col("marked"), "<s>", "</s>").alias("inner_part"), text.sections(F.col("lines"), ["Notes", "Steps"]).alias("s"))
    return both.select("p_partkey", "p.*", "inner_part", F.col("s")["Notes"].alias("notes"), F.col("s")["Steps"].alias("steps"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'run' WHEN p_size % 3 = 1 THEN 'go' END AS function_name, CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 THEN 5 END AS function_start, CASE WHEN p_size % 3 = 0 THEN 4 WHEN p_size % 3 = 1 THEN 7 END AS function_end,
 CASE WHEN p_size % 3 < 2 THEN 'C' || p_partkey END AS class_name FROM part
""")
def enclosing_scopes(spark, d):
    """The function and the class around a line."""
    source = F.concat(F.lit("class C"), "p_partkey", F.lit(":\n    def run(self):\n        pass\n\n    def go(self):\n        pass\n"))
    line = F.when(F.col("p_size") % 3 == 0, 3).when(F.col("p_size") % 3 == 1, 6).otherwise(99)
    rows = table(spark, d, "part").select("p_partkey", source.alias("source"), line.alias("line"), F.lit("python").alias("language"))
    return rows.select("p_partkey", code.code_scope("source", "line", "language").alias("c")).select("p_partkey", "c.function_name", "c.function_start", "c.function_end", "c.class_name")


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 4 = 1 THEN 'cryptographic' ELSE 'general' END AS kind, p_size % 2 = 0 AS same,
 CASE p_size % 5 WHEN 0 THEN 'react' WHEN 1 THEN 'android' WHEN 2 THEN 'ktor' WHEN 3 THEN 'github_actions' ELSE 'generic' END AS framework FROM part
""")
def kinds_of_examples(spark, d):
    """An example's type by its fallbacks, exact matches but for ends, framework by path."""
    n = F.col("p_size")
    path = F.when(n % 5 == 0, "web/App.tsx").when(n % 5 == 1, "Android/x.py").when(n % 5 == 2, "src/a.kt").when(n % 5 == 3, ".github/ci.yml").otherwise("x.c")
    kind = keywords.type_of_focus(F.when(n % 4 == 0, F.col("p_brand")), F.when(n % 4 == 1, "on cryptographic code"))
    same = chat.exact_match(F.concat(F.lit("  "), "p_name"), F.when(n % 2 == 0, F.concat("p_name", F.lit(" "))).otherwise(F.lit("x")))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), same.alias("same"), packages.framework(path).alias("framework"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'lib-' || p_partkey END AS package, CASE WHEN p_size % 2 = 0 THEN '1.0' END AS from_version, CASE WHEN p_size % 2 = 0 THEN '2.' || p_size END AS to_version,
 CASE p_partkey % 4 WHEN 0 THEN '3.' || p_size WHEN 1 THEN '4.' || p_size WHEN 2 THEN '5.' || p_size || '.1' END AS version, CASE p_partkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'medium' END AS severity FROM part
""")
def parsed_upgrades(spark, d):
    """Package and versions of a fix's description, a version by three fallbacks, a severity word in a text."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    description = F.when(F.col("p_size") % 2 == 0, F.format_string("Upgrade lib-%d from 1.0 to 2.%s", k, n)).otherwise(F.lit("nothing to do"))
    body = F.when(k % 4 == 0, F.concat(F.lit("9.9 g.x:art:3."), n)).when(k % 4 == 1, F.concat(F.lit('version = "4.'), n, F.lit('"'))).when(k % 4 == 2, F.concat(F.lit("see 5."), n, F.lit(".1"))).otherwise(F.lit("none"))
    level = F.when(k % 3 == 0, "Low or CRITICAL").when(k % 3 == 1, "low").otherwise("?")
    return table(spark, d, "part").select("p_partkey", packages.parse_upgrade(description).alias("u"), text.find_version(body).alias("version"), severity.of_advisory(level).alias("severity")).select("p_partkey", "u.*", "version", "severity")


@query("""
WITH r AS (SELECT 'v' || p_size || '.0.0' AS tag, CASE WHEN p_partkey % 2 = 0 THEN 'Security fix' ELSE 'docs' END AS body, TIMESTAMP '2024-01-01' + to_days(CAST(p_size AS INTEGER)) AS published, p_size FROM part WHERE p_size > 40)
SELECT 'v' || max(p_size) || '.0.0' AS latest, count(*) FILTER (body <> 'docs') AS n, 'high' AS severity, CAST(7.5 AS DOUBLE) AS score FROM r
""")
def missed_security_releases(spark, d):
    """An advisory if the current version is behind and a newer release speaks of security."""
    found = table(spark, d, "part").filter("p_size > 40").select(F.concat(F.lit("v"), "p_size", F.lit(".0.0")).alias("tag"), F.when(F.col("p_partkey") % 2 == 0, "Security fix").otherwise("docs").alias("body"), F.expr("timestamp'2024-01-01' + make_dt_interval(p_size)").alias("published"))
    return advisories.update_advisory(F.lit("v1.2.3"), found, F.lit("2024-03-01").cast("timestamp"))


@query("""
SELECT 'GHSA-' || p_partkey AS id, p_name AS name, CASE p_size % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'odd' END AS severity,
 CASE WHEN p_partkey % 2 = 0 THEN 1.5 ELSE CASE p_size % 5 WHEN 0 THEN 9.5 WHEN 1 THEN 7.5 WHEN 2 THEN 5.0 WHEN 3 THEN 2.5 ELSE 5.0 END END::DOUBLE AS cvss_score, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_type END, p_name) AS description FROM part
""")
def repository_advisories(spark, d):
    """A repository's advisories as advisory rows, the score by severity where it is missing."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ("CRITICAL", "High", "medium", "low", "odd"))), F.col("p_size") % 5 + 1)
    rows = table(spark, d, "part").select(F.concat(F.lit("GHSA-"), k).alias("ghsa_id"), F.col("p_name").alias("summary"), F.when(k % 3 == 0, F.col("p_type")).alias("description"), name.alias("severity"), F.when(k % 2 == 0, 1.5).alias("score"), F.lit("2024").alias("published_at"))
    return advisories.normalised(rows).drop("published")


@query("SELECT p_partkey, p_name AS baseline, p_size % 3 > 0 AS enhanced, CAST(p_size % 3 AS INTEGER) AS n_similar, array_to_string(list_transform(range(0, p_size % 3), lambda i: printf('%.1f%%', (p_size + i) / 100.0 * 100)), ',') AS similarity FROM part")
def merged_analyses(spark, d):
    """Baseline and enhancement side by side, with a summary of the similar cases."""
    case = lambda i: F.struct(F.lit("t").alias("tool"), F.lit("x").alias("type"), ((F.col("p_size") + i) / 100).alias("score"))
    similar = F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda i: i < F.col("p_size") % 3), case)
    m = analysis.merged(F.col("p_name"), F.col("p_brand"), similar, F.lit(7))
    return table(spark, d, "part").select("p_partkey", m.alias("m")).select("p_partkey", "m.baseline", "m.about.enhanced", "m.about.n_similar", F.array_join(F.transform("m.about.similar", lambda s: s.similarity), ",").alias("similarity"))


@query("SELECT p_partkey, p_brand FROM part")
def published_columns(spark, d):
    """What may be published, without columns that hold local paths."""
    return sinks.without_local_paths(table(spark, d, "part").select("p_partkey", "p_brand", F.lit("/home/x").alias("adapter_path"), F.lit("/tmp").alias("training_dir")), ["adapter_path", "training_dir"])


@query("SELECT p_partkey FROM part WHERE p_size % 10 = 3")
def tagged_images(spark, d):
    """images of which a tag fits a pattern."""
    tags = F.array(F.lit("latest"), F.concat(F.lit("sha-"), (F.col("p_size") % 10).cast("string")))
    return advisories.with_tag(table(spark, d, "part").select("p_partkey", tags.alias("tags")), "^sha-3$").select("p_partkey")


@query("SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'no_id' WHEN p_size < 10 THEN 'no_text' END AS reason FROM part) GROUP BY ALL")
def required_fields(spark, d):
    """Rows that lack a field, with the first reason; written apart from the others, and both counted as they are read again."""
    rows = table(spark, d, "part").select(F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey")).alias("id"), F.when(F.col("p_size") >= 10, F.col("p_name")).alias("body"))
    folder = scratch(spark)
    sinks.write_with_rejects(relational.reject(rows, {"no_id": F.col("id").isNull(), "no_text": F.col("body").isNull()}), f"{folder}/kept", f"{folder}/rejects")
    kept = spark.read.parquet(f"{folder}/kept").select(F.lit("kept").alias("reason"))
    return kept.unionByName(spark.read.schema("reject_reason string").json(f"{folder}/rejects").select(F.col("reject_reason").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT 'status' AS rule, 'k' || p_partkey AS key_id FROM part WHERE p_partkey % 50 = 1 UNION ALL SELECT 'one_active', NULL WHERE (SELECT count(*) FROM part WHERE p_partkey % 100 = 0) <> 1")
def key_violations(spark, d):
    """keys of a status that isn't allowed, and other than one active key."""
    k = F.col("p_partkey")
    keys = table(spark, d, "part").select(F.concat(F.lit("k"), k).alias("key_id"), F.when(k % 100 == 0, "ACTIVE").when(k % 50 == 1, "BROKEN").otherwise("RETIRED").alias("status"))
    return ordering.violations(keys)


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dictionary_lookup(spark, d):
    """A dictionary lookup in which a missing id is fatal."""
    regions = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return relational.fatal_lookup(table(spark, d, "nation"), regions, "n_regionkey", "r_name").select("n_nationkey", "r_name")


@query("SELECT 'a' AS origin, c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'b', s_suppkey, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def corpus_union(spark, d):
    """Two corpora in one, columns that one lacks as null; of the second only what the first hasn't."""
    a = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.lit("a").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.lit("b").alias("origin"), F.col("s_suppkey").alias("id"))
    return relational.union_all(a, relational.unseen(b, a, ["id"]))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_finished(spark, d):
    """Rows that meet a predicate, newest first, the last fifty kept."""
    return ordering.newest(table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"], 50)


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey ORDER BY o_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey LIMIT 100")
def limited_join(spark, d):
    """The first rows of a join, by an order that is stated."""
    joined = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.orderBy("o_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey").limit(100).select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT count(*) AS total, count(*) FILTER (p_size % 4 <> 0) AS successful, count(*) FILTER (p_size % 4 = 0) AS failed, count(*) FILTER (p_size % 4 <> 0)::DOUBLE / count(*) AS success_rate, count(DISTINCT CASE WHEN p_size % 4 <> 0 THEN 'f' || p_partkey % 90 END) AS unique_files FROM part")
def extraction_totals(spark, d):
    """Extractions that went well and failed, and how many files they were from."""
    return relational.extraction_totals(extractions(spark, d))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE 'go' END AS language, count(*) AS n FROM part WHERE p_size % 4 <> 0 GROUP BY ALL")
def extractions_by_language(spark, d):
    """Successful extractions by language."""
    return extractions(spark, d).filter("success").groupBy("language").agg(F.count("*").alias("n"))


def extractions(spark, d):
    language = F.element_at(F.array(*map(F.lit, ("python", "rust", "go"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select((F.col("p_size") % 4 != 0).alias("success"), language.alias("language"), F.concat(F.lit("f"), F.col("p_partkey") % 90).alias("path"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS cve_id, CASE WHEN p_size % 2 = 0 THEN p_size / 10.0 END::DOUBLE AS cvss3_base_score FROM part")
def typed_sink(spark, d):
    """K3: Parquet of exactly a schema, scores that are no numbers as null, read again."""
    folder = scratch(spark)
    score = F.when(F.col("p_size") % 2 == 0, (F.col("p_size") / 10).cast("string")).otherwise("n/a")
    sinks.write_typed(table(spark, d, "part").select(F.col("p_partkey").alias("cve_id"), score.alias("cvss3_base_score"), "p_name"), f"{folder}/typed", schemas.CVE_FIX)
    return spark.read.parquet(f"{folder}/typed").select("cve_id", "cvss3_base_score")


@query("SELECT p_brand, count(*) AS n, sum(p_size) AS total FROM part GROUP BY p_brand")
def json_lines_again(spark, d):
    """JSON lines written and read again, a bad line being fatal."""
    folder = scratch(spark)
    sinks.write_json(table(spark, d, "part").select("p_brand", "p_size"), f"{folder}/lines")
    return corpora.json_lines(spark, f"{folder}/lines", "p_brand string, p_size int").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query("SELECT '# Regions' || chr(10) || chr(10) || '| r_name | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' |', chr(10) ORDER BY r_name) || chr(10) AS card FROM (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)")
def region_card(spark, d):
    """A card in Markdown of a small aggregate."""
    counts = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n")).orderBy("r_name")
    return spark.range(1).select(F.lit(sinks.card(counts, "Regions")).alias("card"))


@query("SELECT label, count(*) AS n, 64 AS dimensions FROM embeddings GROUP BY label")
def saved_index(spark, d):
    """K9: vectors and what they are about, saved as an index and loaded again; damage would be fatal."""
    folder = scratch(spark)
    similarity.save_index(table(spark, d, "embeddings").select("vec_id", "embedding", "label"), f"{folder}/index")
    index = similarity.load_index(spark, f"{folder}/index")
    return index.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dimensions"))


@query("""
WITH r AS (SELECT conv_id, turn, role, split_part(text, chr(10), 1) AS line, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS k FROM conversations WHERE text <> '')
SELECT a.conv_id, a.turn, a.line || chr(10) || b.line || chr(10) || chr(10) || 'Consider these related findings together.' AS prompt FROM r a JOIN r b ON a.role = b.role AND b.k = a.k + 1 ORDER BY a.conv_id, a.turn LIMIT 200
""")
def blended_prompts(spark, d):
    """Two rows of one kind blended, the first line of each, up to a target."""
    return sampling.blend(table(spark, d, "conversations").filter("text <> ''"), "role", ["conv_id", "turn"], "text", 200).select("conv_id", "turn", F.col("text").alias("prompt"))


@query("SELECT 'k' || p_partkey AS key_id, CASE WHEN p_partkey % 2 = 0 THEN 'ACTIVE' ELSE 'RETIRED' END AS status, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS n_events, CASE WHEN p_partkey % 2 = 0 THEN 'PENDING>ACTIVE' ELSE 'PENDING>ACTIVE,ACTIVE>RETIRED' END AS events FROM part WHERE p_partkey % 5 > 0")
def audited_changes(spark, d):
    """Changes of key rows (insert, update, delete) and the audit rows that go with them."""
    k = F.col("p_partkey")
    log = table(spark, d, "part").select(F.concat(F.lit("k"), k).alias("key_id"), F.inline(F.expr("filter(array(struct(1 AS at, 'PENDING' AS status), struct(2 AS at, 'ACTIVE' AS status), struct(3 AS at, CASE WHEN p_partkey % 5 = 0 THEN 'DELETED' WHEN p_partkey % 2 = 1 THEN 'RETIRED' END AS status)), x -> x.status IS NOT NULL)")))
    audit = ordering.audit(log, "key_id", "at", "status")
    state = ordering.latest_state(log, "key_id", "at", "status").filter("status <> 'DELETED'").select("key_id", "status")
    events = audit.groupBy("key_id").agg(F.count("*").cast("int").alias("n_events"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event"))), lambda x: x.event), ",").alias("events"))
    return state.join(events, "key_id")
