"""Line dedup: an exact set-similarity join on the word sets of lines, in DataFrame operations only.

A line is removed if an earlier line (by doc_id, then line number) has a word set of Jaccard
``num / den`` or more with its own. Lines of equal sets are one class known by its first line,
so a line stays only if it is the first of its class and no similar class has an earlier first
line. Classes are joined exactly:

1. A word's key is its length, turned round, and 58 bits of its hash, so that a set in ascending
   order has its longest words first. They are the rare ones in most languages, so words needn't
   be counted; which order it is affects speed only, never the result.
2. Of two similar sets, each word of one outside the other takes away at most two of its pairs of
   neighbours in that order, and each word of the other outside it at most one. So all but
   ``2 * (1 - t) * n`` of a set's ``n - 1`` pairs stand in the other too, and two sets have one in
   common among the first ``2 * (1 - t) * n + 1`` of each (``posts``). Pairs of rare words are rare, so
   fewer sets meet that aren't similar than in lists of single words. Where t is 2/3 or less no
   pair need be common, and single words are listed.
3. A pair of words that two lines have gives their classes at once. Longer lists (``hot``) are
   read again: first each class meets the earliest of each list, which settles nearly all of a large
   group of near copies by one comparison a member, then classes that found none meet whole lists.
4. Classes that meet pass a filter of sizes and parities before their whole sets are compared.

Classes are told apart by 128 bits of digest. In lists 64 of them name a class, and all classes of
that name are compared; only two similar classes of one name, alone in a list, would be missed.

Classes come from a minimum taken before the shuffle, so a line that a third of all documents
have is one row a task. Only positions, digests and hashes of pairs are shuffled, and the texts only
to take the lines out or read sets again, unless what they are joined with is proven small.

Words are runs of other than white space, lower-cased. Lines end at a line feed. Lines with
fewer than ``min_words`` distinct words stay. A null text stays null and an empty one empty.
Rows equal in doc_id and text are one document read again and lose the same lines; rows that
share a doc_id only are different documents. A null doc_id comes before all others. Texts are
taken whole; one text's lines are held in memory once, never once a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.store import small, stored

MIN_WORDS = 1
NO_DOC_ID = -(2**63)
#: Names of long lists, numbers only, up to which they are broadcast.
HOT_ROWS, HOT_BYTES = 2_000_000, 64 << 20
#: Rounds in which lists are made.
ROUNDS = 4
#: A word's key: 5 bits of its length, the longest least, and 58 of its hash.
KEY = "shiftleft(cast(31 - least(octet_length(w), 31) as bigint), 58) | shiftrightunsigned(xxhash64(w), 6)"
#: The distinct words' keys of a line in ascending order; '' stands between two blanks and is no word.
KEYS = f"sort_array(array_except(transform(split(line_text, ' '), w -> {KEY}), array({KEY.replace('(w', "(''")})))"

#: Two halves of 128 bits, each the parity of how many words fall on it.
PARITIES = [f"aggregate(keys, 0L, (p, k) -> p ^ shiftleft(shiftrightunsigned(k, 6) & 1L ^ {half}L, cast(k & 63 as int)))" for half in (0, 1)]


def plain(text: str | Column) -> Column:
    """A text in lower case with blanks as its only white space but line feeds."""
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(F.when(text.rlike(r"[\t\r\x0B\f]"), F.translate(text, "\t\r\x0b\f", "    ")).otherwise(text))


def needed(a: Column, b: Column, num: int, den: int) -> Column:
    """The least overlap at which sets of sizes a and b reach num / den."""
    return F.ceil((a + b) * num / (num + den) - 1e-9)


def partnerless(t: float) -> int:
    """The largest size at which a set can't reach t with any set but an equal one: even one word more is too much."""
    n = 1
    while n / (n + 1) < t - 1e-12:
        n += 1
    return n - 1


def posts(num: int, den: int) -> Column:
    """Of a set's ``keys`` (n of them, ascending) the hashes under which it is listed: two different sets that reach num / den have one in common."""
    t = num / den
    if 3 * num > 2 * den:
        p = f"cast(least(n - 1, floor({2 * (1 - t)!r} * n + 1e-9) + 1) as int)"
        listed = f"zip_with(slice(keys, 1, {p}), slice(keys, 2, {p}), (a, b) -> xxhash64(a, b))"
    else:
        listed = f"slice(keys, 1, cast(n - ceil(n * {t!r} - 1e-9) + 1 as int))"
    return F.expr(f"CASE WHEN n > {partnerless(t)} THEN {listed} END")


class Join:
    """The join of one table of lines: what its steps share."""

    def __init__(self, docs: DataFrame, num: int, den: int, min_words: int):
        self.num, self.den = num, den
        own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC_ID)).alias("doc_id")
        docs = docs.select(own, "text").filter("text is not null and text <> ''")
        self.hashed = bool(docs.groupBy("doc_id").count().filter("count > 1").limit(1).count())
        self.docs = docs.select("doc_id", F.xxhash64("text" if self.hashed else F.lit(0)).alias("text_hash"), "text")  # the hash tells rows of one doc_id apart
        lines = self.docs.select("doc_id", "text_hash", F.posexplode(F.split(plain("text"), "\n")).alias("line", "line_text"))
        sets = lines.select(F.struct("doc_id", "text_hash", "line").alias("pos"), F.expr(KEYS).alias("keys")).withColumn("n", F.size("keys"))
        known = sets.select("pos", F.xxhash64("keys").alias("d1"), F.xxhash64(F.lit(1), "keys").alias("d2"), "n", F.expr(PARITIES[0]).alias("parity"), F.expr(PARITIES[1]).alias("parity2"), posts(num, den).alias("posts"))
        self.known = stored(known).filter(F.col("n") >= min_words)
        # A class is known by its first position from here on.
        first = F.min(F.struct("pos", "n", "parity", "parity2")).alias("f")
        self.classes = stored(self.known.groupBy("d1", "d2").agg(first, F.count("*").alias("lines")).select("d1", "d2", "lines", "f.*"))

    def may_match(self, x: str, y: str) -> Column:
        """Sizes allow the threshold, and parities don't rule it out: sets differ in at least as many words as their parities in bits."""
        c = lambda side, name: F.col(f"{side}.{name}")
        least = needed(c(x, "n"), c(y, "n"), self.num, self.den)
        sizes = F.least(c(x, "n"), c(y, "n")) * self.den >= F.greatest(c(x, "n"), c(y, "n")) * self.num
        differ = F.bit_count(c(x, "parity").bitwiseXOR(c(y, "parity"))) + F.bit_count(c(x, "parity2").bitwiseXOR(c(y, "parity2")))
        return sizes & (differ <= c(x, "n") + c(y, "n") - 2 * least)

    def lists(self) -> tuple[DataFrame, DataFrame]:
        """(a, b): names of two classes that stand in a list alone; and (w, pos, n and parities), the classes of the lists of more than two lines."""
        met, members = [], []
        for i in range(ROUNDS):  # no more than a share of the posts is in shuffle files at once
            own = F.pmod("w", F.lit(ROUNDS)) == i
            names = self.known.select("d1", F.explode("posts").alias("w")).filter(own).groupBy("w")
            met.append(stored(names.agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.count("*").alias("m")).filter("a <> b")))
            hot = small(met[-1].filter("m > 2").select("w"), HOT_ROWS, HOT_BYTES)
            long = self.known.select("d1", "d2", "pos", "n", "parity", "parity2", F.explode("posts").alias("w")).filter(own).join(hot, "w", "left_semi")
            first = F.min(F.struct("pos", "n", "parity", "parity2")).alias("f")
            members.append(stored(long.groupBy("w", "d1", "d2").agg(first).select("w", "f.*")))
        return reduce(DataFrame.unionByName, met).filter("m = 2").select("a", "b"), reduce(DataFrame.unionByName, members)

    def named(self, pairs: DataFrame) -> DataFrame:
        """(a, b): first positions, the earlier first, of classes named in ``pairs`` that may match."""
        slim = self.classes.select("d1", "pos", "n", "parity", "parity2")
        x, y = (slim.select(F.col("d1").alias(c), F.struct("pos", "n", "parity", "parity2").alias(s)) for c, s in (("a", "x"), ("b", "y")))
        met = pairs.distinct().join(x, "a").join(y, "b").filter(self.may_match("x", "y"))
        return met.select(F.least("x.pos", "y.pos").alias("a"), F.greatest("x.pos", "y.pos").alias("b"))

    def listed(self, earlier: DataFrame, later: DataFrame) -> DataFrame:
        """(a, b): first positions of classes of two tables of list members that meet in a list, in this order, and may match."""
        on = (F.col("x.w") == F.col("y.w")) & (F.col("x.pos") < F.col("y.pos")) & self.may_match("x", "y")
        return earlier.alias("x").join(later.alias("y"), on).select(F.col("x.pos").alias("a"), F.col("y.pos").alias("b")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """pos of each class b that is similar to a partner a, by their whole sets read again from the texts."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("pos")).distinct()
        where = stored(ends.groupBy("pos.doc_id", "pos.text_hash").agg(F.collect_set("pos.line").alias("wanted")))
        read = self.docs.join(small(where), ["doc_id", "text_hash"])
        read = read.select("doc_id", "text_hash", "wanted", F.split(plain("text"), "\n").alias("parts"))
        # parts is named twice, so that it is made once and not for each line.
        some = "transform(filter(wanted, i -> i < size(parts)), i -> struct(i as line, parts[i] as line_text))"
        lines = read.select("doc_id", "text_hash", F.explode(F.expr(some)).alias("l")).select("doc_id", "text_hash", "l.*")
        whole = lines.select(F.struct("doc_id", "text_hash", "line").alias("pos"), F.expr(KEYS).alias("own"))
        if self.hashed:  # a row read again gives its lines again
            whole = whole.dropDuplicates(["pos"])
        whole = stored(whole)
        x, y = (whole.select(F.col("pos").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")
        need = needed(F.size("own_a"), F.size("own_b"), self.num, self.den)
        return pairs.join(x, "a").join(y, "b").filter(F.size(F.array_intersect("own_a", "own_b")) >= need).select(F.col("b").alias("pos")).distinct()

    def similar(self) -> DataFrame:
        """pos of each class to which an earlier class is similar."""
        two, members = self.lists()
        first = F.min(F.struct("pos", "n", "parity", "parity2")).alias("f")
        hubs = members.groupBy("w").agg(first).select("w", "f.*")
        pairs = stored(self.named(two).unionByName(self.listed(hubs, members)).distinct())
        early = stored(self.verified(pairs))
        open_ = stored(members.join(small(early), "pos", "left_anti"))
        rest = stored(self.listed(members, open_).join(pairs, ["a", "b"], "left_anti"))
        if not rest.limit(1).count():
            return early
        return stored(early.unionByName(self.verified(rest)))

    def gone(self) -> DataFrame:
        """doc_id, text_hash, gone: the numbers of the lines to be removed of each text that loses any."""
        similar = self.similar().withColumn("similar", F.lit(True))
        verdict = self.classes.select("d1", "d2", "lines", F.col("pos").alias("kept")).join(small(similar), F.col("kept") == F.col("pos"), "left").drop("pos")
        verdict = stored(verdict.filter("similar or lines > 1").select("d1", "d2", "kept", "similar"))
        gone = self.known.select("d1", "d2", "pos").join(small(verdict), ["d1", "d2"]).filter(F.col("similar") | (F.col("pos") != F.col("kept")))
        return stored(gone.groupBy("pos.doc_id", "pos.text_hash").agg(F.sort_array(F.collect_set("pos.line")).alias("gone")))


def later_lines(docs: DataFrame, num: int = 80, den: int = 100, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, hashed, gone: the numbers (from 0) of the lines to be removed, for each row of ``docs`` (doc_id, text) that loses any.

    doc_id is NO_DOC_ID for null. text_hash counts, and is that of the text, only where ``hashed``: where some doc_id stands on several rows.
    """
    join = Join(docs, num, den, min_words)
    return join.gone().withColumn("hashed", F.lit(join.hashed))


def dedup_lines(docs: DataFrame, num: int = 80, den: int = 100, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with their text less the lines that an earlier one matches, and gone_lines (numbers, from 0); a column of this name is replaced."""
    docs = docs.drop("gone_lines")
    gone = small(later_lines(docs, num, den, min_words))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_DOC_ID)) == gone["doc_id"]) & (~gone["hashed"] | (F.xxhash64(docs["text"]) == gone["text_hash"]))
    # Texts that lose lines are split once, in a column of its own, as a function called for each line would split again.
    split = F.when(gone["gone"].isNotNull(), F.split(docs["text"], "\n"))
    own = [c for c in docs.columns if c != "text"]
    read = docs.join(gone, same, "left").select(F.struct(*(docs[c] for c in own)).alias("own"), docs["text"].alias("text"), gone["gone"].alias("gone"), split.alias("parts"))
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone"), lambda i: F.col("parts")[i])
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    kept = [text.alias("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns]
    return read.select(*kept, F.coalesce("gone", F.array().cast("array<int>")).alias("gone_lines"))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_gone, gone_lines (comma-joined) and text_sha256 (of what stays; empty for null) of each document."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.size("gone_lines").cast("long").alias("n_gone"),
        F.array_join(F.col("gone_lines").cast("array<string>"), ",").alias("gone_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
