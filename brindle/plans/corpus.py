"""Queries over documents, labels, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import chat, keywords, packages, severity, text
from brindle.operators import augmentation, ordering, relational, sampling
from brindle.plans.base import query, table



def sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def sql_hits(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{w}') AS INT)" for w in words) + ")"


RANKED = """
SELECT doc_id, lang, source, text, row_number() OVER (PARTITION BY {by} ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {of}
"""
DEDUPED = "(SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY md5('user:' || left(text, 150)) ORDER BY doc_id) = 1)"
SPLIT = """CASE WHEN n <= 2 THEN 'test' WHEN n < 10 THEN CASE r WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END
 WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END"""


def deduped(spark, d):
    docs = table(spark, d, "documents")
    key = ordering.message_key(F.array(chat.message("user", F.col("text"))))
    return ordering.keep_first(docs, key, [F.col("doc_id")])


@query(f"SELECT lang, split, count(*) AS n FROM (SELECT lang, {SPLIT} AS split FROM ({RANKED.format(by='lang', of=DEDUPED)})) GROUP BY ALL")
def stratified_split_counts(spark, d):
    """Flagship: deduplicated documents split by language, counted."""
    return sampling.stratified_split(deduped(spark, d), "lang", "doc_id").groupBy("lang", "split").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {SPLIT.replace('WHEN n <= 2', 'WHEN n < 0').replace('WHEN n < 10', 'WHEN n < 0')} AS split FROM ({RANKED.format(by='source', of='documents')})")
def stratified_split_by_source(spark, d):
    """Plain 80/10/10 by source."""
    return sampling.stratified_split(table(spark, d, "documents"), "source", "doc_id", small_rule=False).select("doc_id", "split")


@query(f"SELECT doc_id FROM {DEDUPED}")
def dedup_prefix150(spark, d):
    """The first document of each 150-character beginning."""
    return deduped(spark, d).select("doc_id")


@query("SELECT min(doc_id) AS doc_id, left(sha256(text), 16) AS chunk, count(*) AS copies FROM documents GROUP BY sha256(text)")
def dedup_exact_hash(spark, d):
    """Exact copies by hash; the aggregation combines before the shuffle."""
    docs = table(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", F.left("h", F.lit(16)).alias("chunk"), "copies")


TOKENS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"


@query(f"SELECT doc_id, CAST({TOKENS} AS BIGINT) AS tokens FROM documents WHERE {TOKENS} <= 512")
def token_length_filter(spark, d):
    """documents of at most 512 white-space tokens."""
    return table(spark, d, "documents").select("doc_id", relational.whitespace_tokens("text").cast("long").alias("tokens")).filter("tokens <= 512")


@query(f"SELECT count(*) AS n, count(*) FILTER (t <= 512) AS kept, count(*) FILTER (t > 512) AS dropped, round(count(*) FILTER (t > 512) / count(*), 6) AS dropped_share, CAST(min(t) AS BIGINT) AS least, CAST(max(t) AS BIGINT) AS greatest, round(avg(t), 6) AS mean FROM (SELECT {TOKENS} AS t FROM documents)")
def token_length_stats(spark, d):
    """The range of token counts and what a limit of 512 would drop."""
    tokens = table(spark, d, "documents").select(relational.whitespace_tokens("text").cast("long").alias("t"))
    return relational.token_stats(tokens, "t", 512).withColumn("dropped_share", F.round("dropped_share", 6)).withColumn("mean", F.round("mean", 6))


@query("""
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (
 SELECT CASE WHEN a.text IS NULL OR b.text IS NULL THEN 'unreadable' WHEN trim(a.text) = trim(b.text) THEN 'identical'
  WHEN length(trim(a.text)) < 50 OR length(trim(b.text)) < 50 THEN 'too_short' WHEN strlen(a.text) > 5000 OR strlen(b.text) > 5000 THEN 'too_large' END AS reason
 FROM documents a JOIN documents b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1) GROUP BY 1
""")
def pair_quality_skip_reasons(spark, d):
    """Even documents paired with their odd followers, counted by why they would be left out."""
    docs = table(spark, d, "documents")
    bad = docs.filter("doc_id % 2 = 0").select("doc_id", F.col("text").alias("before"))
    good = docs.filter("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    judged = relational.reject(bad.join(good, "doc_id"), relational.pair_quality(F.col("before"), F.col("after"), most=5000))
    return judged.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def conversation(spark, d):
    turns = table(spark, d, "conversations")
    grouped = relational.grouped_records(turns, "conv_id", ["turn", "role", "text"])
    return grouped.select("conv_id", F.transform("records", lambda r: F.struct(r.role.alias("role"), r.text.alias("content"))).alias("messages"))


@query(r"""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""")
def chatml_render(spark, d):
    """Conversations as marked text."""
    return conversation(spark, d).select("conv_id", chat.chatml(F.col("messages")).alias("rendered"))


@query("""
SELECT conv_id, count(*) FILTER (role <> 'assistant') AS n_prompt, arg_max(text, turn) FILTER (role = 'assistant') AS answer, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS first_user
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role <> 'assistant') > 0 AND count(*) FILTER (role = 'assistant') > 0
""")
def conversation_to_example(spark, d):
    """Prompt and answer of conversations that have both."""
    examples = conversation(spark, d).select("conv_id", chat.prompt_and_answer(F.col("messages")).alias("x"), chat.first_user_message(F.col("messages")).alias("first_user"))
    return examples.filter("x is not null").select("conv_id", F.size("x.prompt").cast("long").alias("n_prompt"), "x.answer", "first_user")


@query("SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'")
def pair_inner_join(spark, d):
    """User turns with the assistant's next."""
    turns = table(spark, d, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    own = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(own, ["conv_id", "turn"])


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')) AS body FROM pages""")
def strip_html_pages(spark, d):
    """Pages without their markup."""
    return table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


ROUTES = ["/", "/{lang}/{id}", "/en/{id}", "/fr/{id}", "/{lang}/{section}/{id}", "/en/1"]


@query("""
WITH routes(route) AS (VALUES ('/'), ('/{lang}/{id}'), ('/en/{id}'), ('/fr/{id}'), ('/{lang}/{section}/{id}'), ('/en/1')),
p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, (SELECT route FROM routes WHERE route = path OR regexp_matches(path, '^' || regexp_replace(route, '[{][^/}]+[}]', '[^/]+', 'g') || '$') ORDER BY route <> path, length(route), route LIMIT 1) AS route FROM p
""")
def url_route_match(spark, d):
    """Pages to routes: equal ones first, then patterns, the shortest."""
    paths = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    routes = spark.range(1).select(F.explode(F.array(*map(F.lit, ROUTES))).alias("route"))
    return relational.match_routes(paths, routes).select("page_id", "path", "route")


# In the tables' invented prose, words that stand for a keyword.
PROSE = {"sanitization": ["thing", "heat"], "validation": ["tion"], "authentication": ["auth", "elle"], "authorization": ["ung"], "cryptography": ["hash"], "input_handling": ["ing the"]}


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql_any('lower(text)', w)} THEN '{k}' END" for k, w in PROSE.items()) + "], lambda x: x IS NOT NULL), ',') AS categories FROM documents")
def keyword_categories(spark, d):
    """Every category with a keyword in the text."""
    return table(spark, d, "documents").select("doc_id", F.array_join(keywords.categories(F.col("text"), PROSE), ",").alias("categories"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {sql_any('lower(text)', w)} THEN '{k}'" for k, w in keywords.CLASSES.items()) + " ELSE 'generic_security_issue' END AS class FROM documents")
def keyword_class_first_match(spark, d):
    """The first class with a keyword in the text."""
    return table(spark, d, "documents").select("doc_id", keywords.first_class(F.col("text")).alias("class"))


@query(f"""
WITH x AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'zap' WHEN 2 THEN 'trivy' ELSE 'osv-scanner' END AS tool, CASE WHEN toxic = 1 THEN 'HIGH' ELSE 'LOW' END AS sev, {sql_hits('lower(text)', keywords.REFINEMENT)} AS h FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN tool = 'semgrep' AND h > 0 THEN 'webauthn_security' WHEN tool = 'semgrep' THEN 'code_vulnerabilities' WHEN tool = 'zap' THEN 'web_security' WHEN tool = 'trivy' THEN 'container_security' ELSE 'dependency_vulnerabilities' END AS category,
 round(CAST(CASE WHEN tool = 'semgrep' AND h >= 2 THEN least(0.8 + h * 0.05, 1.0) WHEN tool = 'semgrep' AND h = 1 THEN 0.6
  ELSE least(CASE tool WHEN 'osv-scanner' THEN 0.9 WHEN 'zap' THEN 0.8 ELSE 0.7 END + CASE WHEN length(text) > 100 THEN 0.05 ELSE 0 END + CASE WHEN sev = 'HIGH' THEN 0.05 ELSE 0 END, 1.0) END AS DOUBLE), 6) AS confidence FROM x
""")
def category_confidence(spark, d):
    """Category and confidence by tool, keywords, length and severity."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    tool = F.when(F.col("doc_id") % 4 == 0, "semgrep").when(F.col("doc_id") % 4 == 1, "zap").when(F.col("doc_id") % 4 == 2, "trivy").otherwise("osv-scanner")
    found = keywords.categorised(tool, F.col("text"), F.col("text"), F.when(F.col("toxic") == 1, "HIGH").otherwise("LOW"))
    return rows.select("doc_id", found.alias("c")).select("doc_id", "c.category", F.round("c.confidence", 6).alias("confidence"))


@query(f"SELECT page_id, {sql_any('t', keywords.DIRECT)} OR (NOT {sql_any('t', keywords.EXCLUDED)} AND {sql_any('t', keywords.CONTEXTUAL)} AND {sql_any('t', keywords.SUPPORTING)}) AS relevant, array_to_string(CASE WHEN len(c) = 0 THEN ['general webauthn'] ELSE c END, ',') AS components FROM (SELECT page_id, lower(html) AS t, list_filter([" + ", ".join(f"CASE WHEN {sql_any('lower(html)', w)} THEN '{k}' END" for k, w in keywords.COMPONENTS.items()) + "], lambda x: x IS NOT NULL) AS c FROM pages)")
def relevance_predicate(spark, d):
    """Relevance by keywords, and components named."""
    return table(spark, d, "pages").select("page_id", keywords.relevant(F.col("html")).alias("relevant"), F.array_join(keywords.affected_components(F.col("html")), ",").alias("components"))


@query("SELECT d.doc_id, copy FROM documents d LEFT JOIN labels l USING (doc_id), LATERAL (SELECT unnest(range(CASE WHEN coalesce(l.quality, 0) = 1 AND coalesce(l.toxic, 0) = 0 THEN 2 ELSE 1 END)) AS c), LATERAL (SELECT CAST(c AS INT) AS copy)")
def quality_oversample(spark, d):
    """Clean documents of high quality twice."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return sampling.oversample(rows, F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).select("doc_id", "copy")


@query("""
WITH new AS (SELECT doc_id FROM documents WHERE lang = 'en'), old AS (SELECT doc_id FROM documents WHERE lang <> 'en')
SELECT doc_id, false AS is_replay, CAST(1.0 AS DOUBLE) AS loss_weight FROM new UNION ALL
SELECT doc_id, true, CAST(0.5 AS DOUBLE) FROM old QUALIFY row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= (SELECT floor(count(*) * 0.15) FROM new)
""")
def replay_mix(spark, d):
    """English documents and a sample of the others, 15 % of their number."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.replay_mix(docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"), "doc_id").select("doc_id", "is_replay", "loss_weight")


@query("""
WITH g AS (SELECT source, row_number() OVER (ORDER BY source) AS place, count(*) OVER () AS groups FROM (SELECT DISTINCT source FROM documents)),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, source FROM r JOIN g USING (source) WHERE r <= floor(110 / groups) + CASE WHEN place <= 110 % groups THEN 1 ELSE 0 END
""")
def quota_sample(spark, d):
    """110 documents dealt evenly over sources."""
    return sampling.quota(table(spark, d, "documents"), "source", "doc_id", 110).select("doc_id", "source")


@query("""
WITH x AS (SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'high' ELSE 'low' END AS sev, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) AS n FROM x GROUP BY lang)
SELECT doc_id, round(CAST((CASE sev WHEN 'high' THEN 1.3 ELSE 0.8 END) * (CASE WHEN quality = 1 THEN 1.1 ELSE 1.0 END) * (1.0 / (n + 1)) AS DOUBLE), 9) AS weight FROM x JOIN c USING (lang)
""")
def importance_diversity(spark, d):
    """Importance by severity and context, times the rarity of the type."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    weight = severity.importance(F.when(F.col("toxic") == 1, "high").otherwise("low"), F.lit(None).cast("string"), F.col("quality") == 1)
    return sampling.diversity(rows, "lang").select("doc_id", F.round(weight * F.col("diversity"), 9).alias("weight"))


@query("""
WITH x AS (SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 1.3 ELSE 0.8 END AS sev, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
w AS (SELECT doc_id, CAST(round(CAST(sev * (CASE WHEN quality = 1 THEN 1.1 ELSE 1.0 END) * (1.0 / (n + 1)) AS DOUBLE), 9) AS DOUBLE) AS weight FROM x JOIN c USING (lang)),
s AS (SELECT doc_id, weight, sum(weight) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER () AS total FROM w),
p AS (SELECT i AS draw, CAST('0x' || substr(md5('42|' || i), 1, 10) AS BIGINT) / 1099511627776.0 AS u FROM range(0, 1000) t(i))
SELECT draw, doc_id FROM p JOIN s ON u >= (upto - weight) / total AND u < upto / total
""")
def weighted_replay(spark, d):
    """U8: a thousand draws with replacement, each a hash of its number, by weight."""
    rows = importance_diversity(spark, d)
    return sampling.weighted_draws(rows, "doc_id", F.col("weight"), 1000).select("draw", "doc_id")



DIGIT = "ascii(substr(md5({key}), {i}, 1))"


def sql_hash(key: str, n: int) -> str:
    return "(" + " + ".join(DIGIT.format(key=key, i=i) for i in range(1, 5)) + f") % {n}"


def sql_terms() -> str:
    out = "text"
    for i, (word, other) in enumerate(chat.SYNONYMS):
        out = f"regexp_replace({out}, CASE WHEN ({i} - s + 10) % 10 < n THEN '\\b{word}\\b' ELSE '$a' END, '{other}', 'i')"
    return out


@query(f"""
WITH x AS (SELECT doc_id, CAST(v AS INT) AS variant, text, {sql_hash("doc_id || '-' || v", 3)} + 3 AS n, {sql_hash("'t' || doc_id || '-' || v", 10)} AS s FROM documents, range(0, 4) t(v) WHERE lang = 'en'),
y AS (SELECT doc_id, variant, text AS old, CASE WHEN variant = 0 THEN text ELSE {sql_terms()} END AS text FROM x)
SELECT doc_id, variant, variant > 0 AS is_augmented, md5(text) AS text_md5 FROM y WHERE variant = 0 OR text <> old
""")
def augment_expand(spark, d):
    """English documents and variants with other terms."""
    return sampling.augment(table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "text"), "doc_id", "text", 3).select("doc_id", "variant", "is_augmented", F.md5("text").alias("text_md5"))


TERMS = {
    "wording": [("the", "that"), ("and", "as well as"), ("of", "out of"), ("in", "within"), ("is", "may be"), ("to", "towards"), ("with", "along with"), ("for", "on behalf of"), ("on", "upon"), ("are", "may be")],
    "detail": [("an", "one"), ("as", "such as"), ("or", "or else"), ("by", "by way of"), ("that", "which"), ("from", "out of"), ("this", "the present"), ("he", "the user"), ("we", "the team"), ("by", "next to")],
}
PHRASES, OPENINGS = ["The", "To ", "An"], ["Look at this.", "What of the following?", "Answer this:"]


def sql_number(key: str, n: object) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT) % {n}"


def sql_variant(kind: str, n: int) -> str:
    """A conversation's messages with the terms of a kind exchanged; ``c`` is the conversation's key as text."""
    text, key = "m.content", f"'42|{kind}|{n}|' || c"
    for i, (word, other) in enumerate(TERMS[kind]):
        text = f"regexp_replace({text}, CASE WHEN ({i} - {sql_number(f'{chr(39)}s{chr(39)} || {key}', 10)} + 10) % 10 < {sql_number(f'{chr(39)}n{chr(39)} || {key}', 3)} + 3 THEN '(^|[^\\p{{L}}\\p{{N}}_]){word}($|[^\\p{{L}}\\p{{N}}_])' ELSE '$(a)(b)' END, '\\1{other}\\2', 'i')"
    return f"SELECT 1 AS place, -1 AS attempt, c, conv_id, {list(TERMS).index(kind)} AS nth_kind, '{kind}' AS kind, {n} AS variant, list_transform(messages, lambda m: struct_pack(role := m.role, content := CASE WHEN m.role IN ('user', 'assistant') THEN {text} ELSE m.content END)) AS messages FROM e"


SQL_FIRST = "coalesce(list_filter(messages, lambda m: m.role = 'user')[1].content, '')"


@query(f"""
WITH e AS (SELECT CAST(conv_id AS VARCHAR) AS c, conv_id, CAST(count(*) AS VARCHAR) AS category, list(struct_pack(role := role, content := text) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY conv_id) AS k, count(*) OVER (PARTITION BY category) AS members, {SQL_FIRST} AS said FROM e),
g AS (SELECT category, members, row_number() OVER (ORDER BY category) AS slot FROM (SELECT DISTINCT category, members FROM r WHERE members > 1)),
a AS (SELECT i AS attempt, {sql_number("'42|group|' || i", "(SELECT count(*) FROM g)")} + 1 AS slot FROM (SELECT CAST(unnest(range(0, 6 * (SELECT count(*) FROM e))) AS BIGINT) AS i)),
p AS (SELECT attempt, category, members, {sql_number("'42|first|' || attempt", "members")} + 1 AS k1 FROM a JOIN g USING (slot)),
q AS (SELECT attempt, category, k1, (k1 + {sql_number("'42|second|' || attempt", "(members - 1)")}) % members + 1 AS k2 FROM p),
b AS (SELECT q.attempt, x.c, x.conv_id, x.messages, split_part(x.said, chr(10), 1) || chr(10) || split_part(y.said, chr(10), 1) || chr(10) || chr(10) || 'Consider these related findings together.' AS prompt, row_number() OVER (ORDER BY q.attempt) AS n,
 list_position(list_transform(x.messages, lambda m: m.role), 'user') AS spot FROM q JOIN r x ON x.category = q.category AND x.k = k1 JOIN r y ON y.category = q.category AND y.k = k2 WHERE x.said <> '' AND y.said <> ''),
u AS (SELECT 0 AS place, -1 AS attempt, c, conv_id, 0 AS nth_kind, 'original' AS kind, 0 AS variant, messages FROM e
 UNION ALL {" UNION ALL ".join(sql_variant(kind, n) for kind in TERMS for n in range(2))}
 UNION ALL SELECT 2, -1, c, conv_id, 0, 'mixed', 0, list_transform(messages, lambda m: struct_pack(role := m.role, content := CASE WHEN m.role = 'user' AND ({" OR ".join(f"contains(split_part(m.content, chr(10), 1), '{p}')" for p in PHRASES)})
  THEN list_extract([{", ".join(f"'{o}'" for o in OPENINGS)}], CAST({sql_number("'42|mixed|0|' || c", 3)} + 1 AS BIGINT)) || substr(m.content, length(split_part(m.content, chr(10), 1)) + 1) ELSE m.content END)) FROM e
 UNION ALL SELECT 3, attempt, c, conv_id, 0, 'blend', attempt, list_transform(messages, lambda m, i: struct_pack(role := m.role, content := CASE WHEN i = spot THEN prompt ELSE m.content END)) FROM b WHERE n <= 3 * (SELECT count(*) FROM e)),
d AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(list_transform(messages, lambda m: m.role || ':' || left(m.content, 150)), '|') ORDER BY place, attempt, conv_id, nth_kind, variant) AS nth FROM u)
SELECT conv_id, kind, CAST(variant AS INT) AS variant, md5(array_to_string(list_transform(messages, lambda m: m.role || ':' || m.content), '|')) AS said FROM d WHERE nth = 1 AND place > 0
""")
def augmented_examples(spark, d):
    """Conversations made nine times as many: variants with other terms, other openings, blends within those of equal length."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    examples = turns.select("conv_id", "turns", F.transform("m", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))
    made = augmentation.augmented_examples(examples, "conv_id", "turns", multiplier=9, kinds=TERMS, phrases=PHRASES, openings=OPENINGS)
    said = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.content)), "|")
    return made.select("conv_id", "kind", "variant", F.md5(said).alias("said"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def known_id_anti_join(spark, d):
    """Documents that have no label."""
    return relational.unseen(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT p.page_id, CAST(p.page_id % 40 AS BIGINT) AS item FROM pages p WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id % 3 = 0 AND b.item_id = p.page_id % 40)")
def resume_anti_join(spark, d):
    """Pages whose item isn't done."""
    pages = table(spark, d, "pages").select("page_id", (F.col("page_id") % 40).alias("item"))
    return relational.unseen(pages, table(spark, d, "benchmark").filter("item_id % 3 = 0").select(F.col("item_id").alias("item")), ["item"]).select("page_id", "item")


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contaminated_docs(spark, d):
    """Documents that hold a whole benchmark item as it is written."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return relational.holding(docs, items)


@query("""
WITH a(id, keywords) AS (SELECT n_nationkey, [lower(left(n_name, 3)), lower(n_name)] FROM nation), r AS (SELECT page_id, html FROM pages)
SELECT CAST(id AS INT) AS id, (SELECT max(page_id) FROM r WHERE contains(lower(html), keywords[1]) OR contains(lower(html), keywords[2])) AS released_at FROM a
""")
def advisory_release_theta(spark, d):
    """Of each nation's name as keywords the newest page that holds one."""
    advisories = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.lower(F.left("n_name", F.lit(3))), F.lower("n_name")).alias("keywords"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("published"), F.col("page_id").cast("string").alias("tag"), F.col("html").alias("body"))
    return relational.newest_mention(advisories, pages).select("id", "released_at")


@query(r"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(list_filter(l, lambda v: (v LIKE 'A%')), lambda v: substr(v, 2)), chr(10))) AS side FROM x
""")
def diff_sides(spark, d):
    """P25: the lines that begin with a sign, without it (here the sign is a letter)."""
    return table(spark, d, "documents").select("doc_id", F.md5(packages.diff_side(F.col("text"), "A")).alias("side"))


@query("SELECT doc_id, CASE WHEN length(s) > 200 THEN left(s, 197) || '...' ELSE s END AS sentence FROM (SELECT doc_id, trim(split_part(text, '.', 1)) || '.' AS s FROM documents)")
def first_sentences(spark, d):
    """First sentences, cut at 200."""
    return table(spark, d, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_slice(l, greatest(3 - 1, 1), 3 + 1), lambda v, i: format('{:>4d} | {}', greatest(3 - 1, 1) + i - 1, v)), chr(10)) AS context FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def code_context(spark, d):
    """The third line of each text with a line around it, numbered."""
    return table(spark, d, "documents").select("doc_id", packages.context(F.col("text"), F.lit(3), 1).alias("context"))
