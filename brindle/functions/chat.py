"""Chat examples: messages, prompts, narratives, augmentation."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms that may stand for each other, and first lines of prompts: our own.
SYNONYMS = [
    ("weakness", "soft spot"), ("repair", "mend"), ("library", "dependency"), ("server", "host"), ("request", "call"),
    ("file", "document"), ("value", "figure"), ("check", "inspect"), ("access", "entry"), ("result", "outcome"),
]
INTROS = ["Analyze this security finding:", "Review the following finding:", "Assess this report:", "Explain and fix this finding:"]
#: A character of a word in any script, whatever the Java version takes for a word's end.
WORD = r"[\p{L}\p{N}_]"
# What a first line has to hold to be known as an opening; ours are known too.
PHRASES = ["Fix the following", "Address this", *INTROS]
SYSTEM = {
    "dependency_vulnerabilities": "You are a security engineer who fixes vulnerable dependencies.",
    "web_security": "You are a security engineer who fixes web applications.",
    "infrastructure_security": "You are a security engineer who fixes infrastructure as code.",
    "container_security": "You are a security engineer who fixes container images.",
}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chatml(messages: Column) -> Column:
    """Messages as text with a start and an end mark around each."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m.role, F.lit("\n"), m.content, F.lit("<|im_end|>"))), "\n")


def prompt_and_answer(messages: Column) -> Column:
    """The messages that aren't the assistant's, and the assistant's last content; null where either is missing."""
    others = F.filter(messages, lambda m: m.role != "assistant")
    own = F.filter(messages, lambda m: m.role == "assistant")
    return F.when((F.size(others) > 0) & (F.size(own) > 0), F.struct(others.alias("prompt"), F.try_element_at(own, F.lit(-1)).content.alias("answer")))


def first_user_message(messages: Column) -> Column:
    """The first content of the user; empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m.role == "user"), F.lit(1)).content, F.lit(""))


def exact_match(a: Column, b: Column) -> Column:
    """Equality but for white space at the ends."""
    return F.trim(a) == F.trim(b)


def code_example(language: Column, description: Column, vulnerable: Column, fixed: Column) -> Column:
    """A pair of code as an example of three messages; null if either side is blank."""
    ask = F.concat(F.lit("Fix this "), F.coalesce(language, F.lit("unknown")), F.lit(" code. "), F.coalesce(description, F.lit("")), F.lit("\n\n"), vulnerable)
    blank = (F.trim(F.coalesce(vulnerable, F.lit(""))) == "") | (F.trim(F.coalesce(fixed, F.lit(""))) == "")
    return F.when(~blank, F.array(message("system", F.lit("You are a security engineer who fixes vulnerable code.")), message("user", ask), message("assistant", fixed)))


def finding_example(category: Column, id_: Column, severity: Column, path: Column, text: Column, fix: Column) -> Column:
    """A finding with a fix as an example; null, to be rejected by the caller, where a part that the category needs is missing."""
    system = F.coalesce(*[F.when(category == k, F.lit(v)) for k, v in SYSTEM.items()], F.lit("You are a security engineer who fixes code."))
    dependency = category.isin("dependency_vulnerabilities", "container_security")
    complete = id_.isNotNull() & text.isNotNull() & fix["description"].isNotNull() & (~dependency | (fix["from_version"].isNotNull() & fix["to_version"].isNotNull()))
    ask = F.concat_ws("\n", F.concat(F.lit("Finding: "), id_), F.concat(F.lit("Severity: "), severity), F.concat(F.lit("Location: "), path), F.concat(F.lit("Description: "), text), F.when(dependency, F.format_string("Installed: %s", fix["from_version"])))
    answer = F.concat_ws("\n\n", F.concat(F.lit("## Fix\n"), fix["description"]), F.concat(F.lit("```\n"), fix["fixed_code"], F.lit("\n```")), fix["explanation"])
    return F.when(complete, F.array(message("system", system), message("user", ask), message("assistant", answer)))


def narrative(id_: Column, severity: Column, tool: Column, path: Column, text: Column) -> Column:
    """A finding told in sentences."""
    return F.format_string("### Finding\n%s, reported by %s with severity %s in %s.\n### Details\n%s\n### Remediation\nFollow the fix of %s.", id_, tool, severity, path, text, id_)


def instructions(story: Column) -> Column:
    """Up to three instruction and response rows of a narrative: its details, its remediation, the whole."""
    part = lambda name, end: F.nullif(F.trim(F.regexp_extract(story, rf"(?s)### {name}\n(.*?){end}", 1)), F.lit(""))
    row = lambda ask, text: F.when(text.isNotNull(), F.struct(F.lit(ask).alias("instruction"), text.alias("response")))
    return F.array_compact(F.array(row("Describe the finding.", part("Details", r"(?=\n###|$)")), row("How is it fixed?", part("Remediation", r"$")), row("Tell the whole story.", story)))


def small_hash(key: Column, n: int) -> Column:
    """A number below n from the first four digits of the key's MD5, the same in any engine."""
    digest = F.md5(key.cast("string"))
    return (sum((F.ascii(F.substr(digest, F.lit(i), F.lit(1))) for i in range(2, 5)), F.ascii(F.substr(digest, F.lit(1), F.lit(1)))) % n).cast("int")


def replace_terms(text: Column, seed: Column) -> Column:
    """Three to five of the ten terms, chosen by a hash of the seed, replaced where they stand first as whole words."""
    n, start = small_hash(seed, 3) + 3, small_hash(F.concat(F.lit("t"), seed.cast("string")), 10)
    for i, (word, other) in enumerate(SYNONYMS):
        chosen = F.pmod(F.lit(i) - start, F.lit(10)) < n
        pattern = F.when(chosen, rf"(?is)\A(.*?)\b{word}\b").otherwise("(?!)")  # a pattern that fails, so that the text stands once in the expression
        text = F.regexp_replace(text, pattern, F.lit(f"$1{other}"))
    return text


def spread(key: Column, n: Column) -> Column:
    """A number below n from the first 60 bits of the key's MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % n


def other_terms(text: Column, seed: Column, terms: list[tuple[str, str]]) -> Column:
    """30 to 50 of a hundred of these terms, chosen by a hash of the seed, replaced in their order where they stand first as whole words."""
    most = len(terms)
    low, high = max(1, most * 3 // 10), max(1, most // 2)
    n = spread(F.concat(F.lit("n"), seed), F.lit(high - low + 1)) + low
    start = spread(F.concat(F.lit("s"), seed), F.lit(most))
    for i, (word, other) in enumerate(terms):
        chosen = F.pmod(F.lit(i) - start, F.lit(most)) < n
        pattern = F.when(chosen, rf"(?is)\A(.*?)(?<!{WORD}){re.escape(word)}(?!{WORD})").otherwise("(?!)")
        text = F.regexp_replace(text, pattern, F.lit("$1" + other.replace("\\", "\\\\").replace("$", "\\$")))
    return text


def vary_intro(prompt: Column, seed: Column, phrases: list[str] = PHRASES, openings: list[str] = INTROS) -> Column:
    """A first line that holds a known phrase exchanged for another opening; other prompts stay as they are."""
    first = F.substring_index(prompt, "\n", 1)
    known = functools.reduce(Column.__or__, [F.contains(first, F.lit(p)) for p in phrases], F.lit(False))
    other = F.array(*map(F.lit, openings))[spread(seed.cast("string"), F.lit(len(openings))).cast("int")]
    return F.when(known, F.concat(other, F.substr(prompt, F.length(first) + 1))).otherwise(prompt)
