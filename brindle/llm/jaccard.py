"""Exact Jaccard join of documents' word-shingle sets: a grouped prefix join.

1. Documents whose whole set is equal are one, known by a 64-bit digest of the set and its size;
   all that follows is about these sets. Sets are of 64-bit shingle hashes.
2. Of each set the smallest hashes, a share of ``1 - t + SLACK``, are counted over all documents.
   Two sets that reach the threshold t must share enough of these; a set of which too few stand
   in any other set's is done.
3. The sets left are taken whole and their tokens counted among them. A token that no other set
   has matches nothing, so a set's other tokens bound its overlap with any; sets bound below t
   are done. The rest have prefixes in order of rarity.
4. Sets with the same prefix, size and number of shared tokens are one group. Groups, not sets,
   are listed under the tokens of their prefix; pairs of groups that meet in a list are filtered
   by sizes and by the token's places in the two orders; pairs that pass are expanded to their
   members, and members whose parities don't rule it out are verified by their whole sets.

For components step 4 runs twice. First each group meets itself and the leading group of each of
its lists (the one whose tokens stand in the most sets), of which only the leading member is
compared: that joins most of a large group of near copies by as many comparisons as it has
members. Then groups are split by the components known so far, and pairs of these parts meet
as in step 4 where their components differ; pairs inside one component need no comparison. With
``counts`` all pairs of groups are expanded, whatever their components, to count links; that
work grows with the number of links.

Texts are never shuffled. Tokens are counted in packed runs (``counting``), with partial counts
made before the shuffle, so a token that a third of all documents share is one value for each
batch of documents. Nothing is dropped or sampled.

A text with fewer words than a shingle has its word sequence as its only element; a null or
blank text has none and links with nothing. Repeated rows are equal sets. Of a doc_id on several
rows all count, and a null doc_id takes part without ever naming a component while others do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.counting import Chunks, packed, with_counts
from brindle.llm.graph import components
from brindle.llm.store import checkpointed, shared_folder, stored
from brindle.llm.words import NOT_SPACE, U, Words, lists, mix, parts

SLACK = 0.05
#: Parity bits of a whole set, in lanes of 64; a power of two.
LANES = 8
#: Candidate groups up to which their ids are broadcast to the documents.
BROADCAST_ROWS = 1_000_000


def _sets(column: pa.Array, k: int):
    """Of each text: number of words, size of its set, digest, where its hashes begin, and all hashes in ascending order."""
    words = Words(column, NOT_SPACE)
    doc, h = words.shingles(k)
    n = np.bincount(doc, minlength=words.n_docs)
    first = np.concatenate(([0], np.cumsum(n)))
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=U)))
    key = mix((total[first[1:]] - total[first[:-1]]) + n.astype(U) * U(0x2545F4914F6CDD1D))
    return words.count, n, key.view(np.int64), first, h


def _heads(k: int, share: float, carried: list[str]):
    def run(batches):
        chunks = Chunks()
        for batch in parts(batches):
            count, n, key, first, h = _sets(batch.column("text"), k)
            p = np.minimum(n, np.ceil(share * n).astype(np.int64) + 1)
            start = np.concatenate(([0], np.cumsum(p)))
            take = np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], p)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(count, pa.int64()), pa.array(key), pa.array(n, pa.int64()), chunks.of(p), packed(start, h[take])]
            columns += [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_words", "key", "n", "chunk", "tokens", *carried])

    return run


def _whole(k: int):
    def run(batches):
        chunks = Chunks()
        for batch in parts(batches):
            _, n, key, first, h = _sets(batch.column("text"), k)
            own = np.repeat(np.arange(len(n)), n)
            parity = np.zeros((len(n), LANES), U)
            np.bitwise_xor.at(parity, (own, ((h >> U(6)) & U(LANES - 1)).astype(np.int64)), U(1) << (h & U(63)))
            lanes = lists(np.arange(len(n) + 1) * LANES, parity.ravel().view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64()), lanes, chunks.of(n), packed(first, h)], ["key", "n", "parity", "chunk", "tokens"])

    return run


def _common(rows: pa.Table, tokens, first, df) -> pa.Table:
    """Of each set, how many of its tokens another has too."""
    seen = np.concatenate(([0], np.cumsum(df > 1)))[first]
    return pa.Table.from_arrays([rows.column("row"), pa.array(np.diff(seen))], ["row", "s"])


def _by_rarity(rows: pa.Table, tokens, first, df) -> pa.Table:
    """Of each set the tokens that another has too, rarest first, their number, and the sum of their counts a token."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    several = df > 1
    doc, tokens, df = doc[several], tokens[several], df[several]
    order = np.lexsort((tokens, df, doc))
    start = np.concatenate(([0], np.cumsum(several)))[first]
    weight = np.bincount(doc, df, len(first) - 1) / np.maximum(np.diff(first), 1)
    columns = [rows.column("key"), rows.column("n"), rows.column("parity"), pa.array(np.diff(start)), pa.array(weight), lists(start, tokens[order].view(np.int64), pa.int64())]
    return pa.Table.from_arrays(columns, ["key", "n", "parity", "e", "central", "own"])


def needed(a: Column, b: Column, num: int, den: int) -> Column:
    """The least overlap at which sets of sizes a and b reach num / den."""
    return F.ceil((a + b) * num / (num + den) - 1e-9)


def link(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, counts: bool = False, carry: str | None = None) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64), n_words, n (set size), component (smallest doc_id reachable by links), label (a number of the component, unique where doc_ids aren't; null without words) of each row of ``docs`` (doc_id, text).

    Two documents link when den * |A and B| >= num * |A or B|. With ``counts`` also n_links: how many other rows each row links with.
    With ``carry``, the name of a long column of ``docs``, also ``carried``, its value.
    """
    carried = ["carried"] if carry else []
    spark, t = docs.sparkSession, num / den
    shared_folder(spark)
    share = 1 - t + SLACK
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), *(F.col(carry).alias(c) for c in carried))
    row = F.coalesce("doc_id", "text_hash")  # names a row without doc_id too; two that fall together give a candidate more, never one less
    heads = stored(docs.mapInArrow(_heads(k, share, carried), "doc_id long, text_hash long, n_words long, key long, n long, chunk long, tokens binary" + ", carried long" * len(carried)))
    groups = heads.filter("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("least_id"), F.min(row).alias("row"), F.count("*").alias("rows"))

    # 2: sets of which enough smallest hashes stand in another document's
    n, size = F.col("n"), lambda x: F.least(x, F.ceil(x * share) + 1)
    other = F.floor(n / t + 1e-9)
    least = F.least(F.ceil(n * t - 1e-9) - (n - size(n)), needed(n, other, num, den) - (other - size(other)) - 2)
    told = with_counts(heads.filter("n > 0").select("chunk", row.alias("row"), "tokens"), _common, "row long, s long")
    close = told.groupBy("row").agg(F.sum("s").alias("s"))
    wanted = checkpointed(groups.join(close, "row").filter(F.col("s") >= F.greatest(least, F.lit(1))).select("key", "n", "row"))
    few = wanted.count() <= BROADCAST_ROWS
    ids = wanted.select("row").distinct()
    texts = docs.withColumn("row", row).join(F.broadcast(ids) if few else ids, "row", "left_semi").drop("row")

    # 3: whole sets, tokens that another has, prefixes by rarity
    keys = wanted.select("key").distinct()
    sets = texts.mapInArrow(_whole(k), "key long, n long, parity array<long>, chunk long, tokens binary").join(F.broadcast(keys) if few else keys, "key", "left_semi")
    rest = with_counts(stored(sets), _by_rarity, "key long, n long, parity array<long>, e long, central double, own array<long>")
    rest = checkpointed(rest.filter(F.col("e") >= F.ceil(F.col("n") * t - 1e-9)))
    prefix = F.slice("own", F.lit(1), (F.col("e") - F.ceil(F.col("n") * t - 1e-9) + 1).cast("int"))

    # 4: groups of one prefix, size and number of shared tokens; their lists
    members = rest.select("key", "n", "e", "parity", "central", prefix.alias("prefix")).withColumn("group", F.xxhash64("prefix", "n", "e"))
    members = stored(members)
    lead = F.max(F.struct("central", "key")).alias("lead")
    posts = members.groupBy("group", "n", "e", "prefix").agg(lead).select("group", "n", "e", "lead", F.posexplode("prefix").alias("at", "h"))
    members = members.select("group", "key", "n", "parity")

    def roomy(a: str, b: str) -> Column:
        room = F.least(F.col(f"{a}.e") - F.col(f"{a}.at"), F.col(f"{b}.e") - F.col(f"{b}.at"))  # if this is the first token that both have
        return room >= needed(F.col(f"{a}.n"), F.col(f"{b}.n"), num, den)

    def alike(a: str, b: str) -> Column:
        """Parities of the whole sets don't rule the threshold out: sets differ in at least as many tokens as their parities in bits."""
        differ = sum((F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(LANES)), F.lit(0))
        return differ <= F.col(f"{a}.n") + F.col(f"{b}.n") - 2 * needed(F.col(f"{a}.n"), F.col(f"{b}.n"), num, den)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        x, y = (rest.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("own").alias(f"own_{c}")) for c in "ab")
        both = F.size(F.array_intersect("own_a", "own_b"))
        return pairs.join(x, "a").join(y, "b").filter(both >= needed(F.col("n_a"), F.col("n_b"), num, den)).select("a", "b")

    def met(parts: DataFrame, of: DataFrame, apart: Column) -> DataFrame:
        """Pairs of members of pairs of ``parts`` (part, n, e, at, h) that meet in a list, are roomy, ``apart`` and alike; ``of`` has part, key, n and parity."""
        on = (F.col("x.h") == F.col("y.h")) & (F.col("x.part") < F.col("y.part")) & apart & roomy("x", "y")
        near = parts.alias("x").join(parts.alias("y"), on).select(F.col("x.part").alias("p"), F.col("y.part").alias("q")).distinct()
        met = near.join(of.alias("x"), F.col("p") == F.col("x.part")).join(of.alias("y"), (F.col("q") == F.col("y.part")) & alike("x", "y"))
        return met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))

    def all_links() -> DataFrame:
        """Every pair of different sets that reaches the threshold, once."""
        x, y = members.alias("x"), members.alias("y")
        inside = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.key") < F.col("y.key")) & alike("x", "y")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        across = met(posts.withColumnRenamed("group", "part"), members.withColumnRenamed("group", "part"), F.lit(True))
        return verified(inside.unionByName(across))

    # First all members against the leading members of their own group and of their lists' leading groups
    hubs = posts.groupBy("h").agg(F.max(F.struct("lead", "group", "n", "e", "at")).alias("hub"), F.count("*").alias("m")).filter("m > 1").select("h", "hub.*")
    led = posts.alias("x").join(hubs.alias("y"), "h").filter((F.col("x.group") != F.col("y.group")) & roomy("x", "y")).select(F.col("x.group").alias("group"), F.col("y.lead.key").alias("b"))
    led = led.unionByName(posts.select("group", F.col("lead.key").alias("b"))).distinct()
    stars = checkpointed(verified(members.join(led, "group").select(F.col("key").alias("a"), "b")))
    label = components(stars).withColumnRenamed("node", "key")
    # Then parts of groups, one for each component in a group, where components differ
    named = checkpointed(members.join(label, "key", "left").withColumn("label", F.coalesce("label", "key")).withColumn("part", F.xxhash64("group", "label")))
    dealt = posts.drop("lead").join(named.select("group", "label", "part").distinct(), "group")
    mixed = dealt.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("h")
    dealt = dealt.join(mixed, "h", "left_semi")
    links = stars.unionByName(verified(met(dealt, named.select("part", "key", "n", "parity"), F.col("x.label") != F.col("y.label"))))
    found = components(links)
    named_groups = groups.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least_ids = named_groups.groupBy("label").agg(F.min("least_id").alias("component"))
    by_key = named_groups.join(least_ids, "label").select("key", "n", "component", "label")
    more = []
    if counts:
        pairs = checkpointed(all_links())
        ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = ends.join(groups.select(F.col("key").alias("b"), "rows"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("rows").alias("others"))
        n_links = groups.join(others, "key", "left").select("key", "n", (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
        by_key, more = by_key.join(n_links, ["key", "n"]), [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    out = heads.select("doc_id", "text_hash", "n_words", "key", "n", *carried).join(by_key, ["key", "n"], "left")
    return out.select("doc_id", "text_hash", "n_words", "n", F.coalesce("component", "doc_id").alias("component"), "label", *more, *carried)


def link_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return link(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, the first by doc_id (null last) and hash of the text; rows without words all stay."""
    linked = checkpointed(link(docs, k, num, den).filter("n > 0").select("label", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("row")))
    first = linked.groupBy("label").agg(F.min("row").alias("kept"))
    gone = linked.join(first, "label").filter("not row <=> kept").select(F.col("row.doc_id").alias("gone_id"), F.col("row.text_hash").alias("gone_hash")).distinct()
    same = lambda other: docs["doc_id"].eqNullSafe(other[f"{other.columns[0]}"]) & (F.xxhash64(docs["text"]) == other[other.columns[1]])
    kept = docs.join(gone, same(gone), "left_anti")
    twice = linked.groupBy("row").count().filter("count > 1").select(F.col("row.doc_id").alias("twice_id"), F.col("row.text_hash").alias("twice_hash"))
    if not twice.limit(1).count():
        return kept
    again = kept.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same(twice), "left_anti").unionByName(again)
