"""A set of chat examples made larger by three means, as long as its target asks for more.

1. Variants with other terms (P45): of each kind of terms some, wherever the user or the assistant speaks.
2. A mixed variant: the user's prompt with another opening (P46), where it has a known one.
3. Blends of two examples of a category, only if the first two left the target unmet (Q11).

What equals an example already there is left out, by role and beginning of each message (W3, Q13);
originals come first, then variants, mixed ones and blends, by key. So a mixed variant whose opening isn't known goes (Q12).

All choices are hashes of a seed and a key. Variants are one pass over the rows; a blend's attempt
picks its two members by category and rank, so attempts meet members by an equality join in which
a category with a third of all rows is as many keys as it has rows. Equal examples are told by a
minimum, combined before the shuffle. An example without messages (null or none) gives nothing; a null
category is one of its own, ``general``. Rows of one key give variants each, of which equal ones stand once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import chat
from brindle.operators.ordering import message_key, ranked
from brindle.storage import cut, small

#: Terms that may stand for each other, ten of a kind: our own, and a parameter.
KINDS = {
    "wording": chat.SYNONYMS,
    "detail": [
        ("severe", "of great severity"), ("input", "user input"), ("login", "sign-in"), ("rights", "permissions"), ("package", "third-party package"),
        ("release", "published release"), ("upgrade", "move to a newer release"), ("log", "record"), ("secret", "credential"), ("password", "pass phrase"),
    ],
    "view": [
        ("danger", "exposure"), ("attacker", "hostile party"), ("users", "people who rely on it"), ("harm", "damage"), ("cause", "origin"),
        ("effect", "consequence"), ("measure", "safeguard"), ("rule", "policy"), ("finding", "observation"), ("scan", "examination"),
    ],
}
BLEND_END = "Consider these related findings together."
ORDER = {"original": 0, "terms": 1, "mixed": 2, "blend": 3}


def _messages(messages: Column, roles: tuple[str, ...], change) -> Column:
    """The messages, those of some roles with their content changed."""
    return F.transform(messages, lambda m: F.when(m.role.isin(*roles), F.struct(m.role.alias("role"), change(m.content).alias("content"))).otherwise(F.struct(m.role.alias("role"), m.content.alias("content"))))


def _variants(df: DataFrame, kinds: dict, per_kind: int, phrases: list[str], openings: list[str], seed: int) -> DataFrame:
    """Each example's variants of every kind and its mixed one, by one explosion."""
    of = lambda kind, n: F.concat_ws("|", F.lit(f"{seed}|{kind}|{n}"), F.col("key").cast("string"))
    row = lambda phase, kind, n, messages: F.struct(F.lit(phase).alias("phase"), F.lit(kind).alias("kind"), F.lit(n).alias("variant"), messages.alias("messages"))
    made = [
        row("terms", kind, n, _messages(F.col("messages"), ("user", "assistant"), lambda c, k=kind, n=n: chat.other_terms(c, of(k, n), kinds[k])))
        for kind in kinds for n in range(per_kind)
    ]
    made.append(row("mixed", "mixed", 0, _messages(F.col("messages"), ("user",), lambda c: chat.vary_intro(c, of("mixed", 0), phrases, openings))))
    return df.select("key", "category", F.inline(F.array(*made)))


def _blends(df: DataFrame, wanted: int, seed: int) -> DataFrame:
    """Blends of two members of a category drawn at random; twice as many attempts as are wanted, of which the first that work are kept."""
    members = ranked(df, ["key"], ["category"]).filter("group_size > 1")
    groups = cut(ranked(members.select("category", "group_size").distinct().withColumnRenamed("group_size", "members"), ["category"]))
    n_groups = groups.count()
    number = lambda what, n: chat.spread(F.concat_ws("|", F.lit(f"{seed}|{what}"), F.col("attempt").cast("string")), n)
    attempts = df.sparkSession.range(2 * wanted if n_groups else 0).select(F.col("id").alias("attempt")).withColumn("at", number("group", F.lit(max(n_groups, 1))) + 1)
    picked = attempts.join(small(groups.select(F.col("rank").alias("at"), "category", "members")), "at")
    picked = picked.withColumn("first", number("first", F.col("members")) + 1)
    picked = picked.withColumn("second", (F.col("first") + number("second", F.col("members") - 1)) % F.col("members") + 1)
    line = F.substring_index(chat.first_user_message(F.col("messages")), "\n", 1)
    said = chat.first_user_message(F.col("messages")) != ""
    firsts = members.filter(said).select("category", F.col("rank").alias("first"), "key", "messages", line.alias("line"))
    seconds = members.filter(said).select("category", F.col("rank").alias("second"), line.alias("other"))
    met = picked.join(firsts, ["category", "first"]).join(seconds, ["category", "second"])
    prompt = F.concat("line", F.lit("\n"), "other", F.lit(f"\n\n{BLEND_END}"))
    at = F.array_position(F.transform("messages", lambda m: F.coalesce(m.role, F.lit(""))), "user") - 1
    blended = F.transform("messages", lambda m, i: F.struct(m.role.alias("role"), F.when(i == at, prompt).otherwise(m.content).alias("content")))
    made = met.select("key", "category", F.lit("blend").alias("phase"), F.lit("blend").alias("kind"), "attempt", blended.alias("messages"))
    kept = ranked(made, ["attempt"]).filter(F.col("rank") <= wanted)
    return kept.select("key", "category", "phase", "kind", F.col("attempt").cast("int").alias("variant"), "messages")


def augmented_examples(df: DataFrame, key: str, category: str, messages: str = "messages", multiplier: int = 4, per_kind: int = 2, kinds: dict | None = None, phrases: list[str] | None = None, openings: list[str] | None = None, seed: int = 42) -> DataFrame:
    """New examples (key, category, kind, variant, messages) of ``df``; the originals themselves aren't among them.

    ``multiplier`` is how many times as many examples there shall be, originals and all. A blend has the key and the answers of its first example.
    """
    kinds, phrases, openings = KINDS if kinds is None else kinds, chat.PHRASES if phrases is None else phrases, chat.INTROS if openings is None else openings
    slim = df.select(F.col(key).alias("key"), F.coalesce(F.col(category).cast("string"), F.lit("general")).alias("category"), F.col(messages).alias("messages"))
    rows = cut(slim.filter(F.size("messages") > 0))
    n = rows.count()
    new = _variants(rows, kinds, per_kind, phrases, openings, seed)
    missing = df.count() * (multiplier - 1) - n * (len(kinds) * per_kind + 1)
    if missing > 0:
        new = new.unionByName(_blends(rows, missing, seed))
    old = rows.select("key", "category", F.lit("original").alias("phase"), F.lit("original").alias("kind"), F.lit(0).alias("variant"), F.transform("messages", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))
    place = F.coalesce(*[F.when(F.col("phase") == p, F.lit(i)) for p, i in ORDER.items()])
    # Blends come in the order of their attempts, all others by key.
    attempt = F.when(F.col("phase") == "blend", F.col("variant")).otherwise(-1)
    order = F.struct(place.alias("place"), attempt.alias("attempt"), "key", F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(0)).alias("of"), "variant", "category", "kind", "messages")
    first = old.unionByName(new).groupBy(message_key(F.col("messages")).alias("same")).agg(F.min(order).alias("f"))
    return first.filter("f.place > 0").select(F.col("f.key").alias(key), "f.category", "f.kind", "f.variant", "f.messages")
