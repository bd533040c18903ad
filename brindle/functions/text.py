"""Text: markup, sentences, sections, durations, versions and paths. Column in, Column out; null in, null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities that are resolved, in this order.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")]


def strip_html(html: Column) -> Column:
    """Tags out, five entities resolved, white space collapsed, ends trimmed."""
    out = F.regexp_replace(html, "<[^>]+>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def labelled_line(text: Column, label: str) -> Column:
    """What follows ``label:`` on the first line that begins with it, trimmed; null if no line does."""
    found = F.regexp_extract(text, rf"(?m)^[ \t]*{label}:[ \t]*(.*)$", 1)
    return F.when(text.rlike(rf"(?m)^[ \t]*{label}:"), F.trim(found))


def dependency_message(text: Column) -> Column:
    """P20: package, installed_version and fixed_version of a message's lines; a fixed version that is missing is ``latest``. Null without a package or an installed version."""
    name, installed = labelled_line(text, "Package"), labelled_line(text, "Installed Version")
    fixed = F.trim(F.regexp_replace(F.regexp_replace(labelled_line(text, "Fixed Version"), r"\s*\[.*$", ""), r",\s*$", ""))
    fixed = F.coalesce(F.nullif(fixed, F.lit("")), F.lit("latest"))
    return F.when((name != "") & (installed != ""), F.struct(name.alias("package"), installed.alias("installed_version"), fixed.alias("fixed_version")))


def first_sentence(text: Column, limit: int = 200) -> Column:
    """Up to the first full stop, cut to ``limit`` with three dots."""
    sentence = F.concat(F.trim(F.split_part(text, F.lit("."), F.lit(1))), F.lit("."))
    return F.when(F.length(sentence) > limit, F.concat(F.left(sentence, F.lit(limit - 3)), F.lit("..."))).otherwise(sentence)


def labelled_parts(text: Column) -> Column:
    """``Impact: .. Remediation: .. Prevention: ..`` as a struct; a part that is missing is null."""
    part = lambda name: F.nullif(F.regexp_extract(text, rf"(?s)(?:^|\. ){name}: (.*?)(?=\. |$)", 1), F.lit("")).alias(name.lower())
    return F.struct(*[part(n) for n in ("Impact", "Remediation", "Prevention")])


def between(text: Column, start: str, end: str) -> Column:
    """What stands between two markers; to the end if the second is missing, null if the first is."""
    after = F.locate(start, text)
    tail = F.substr(text, after + len(start))
    stop = F.locate(end, tail)
    return F.when(after > 0, F.trim(F.when(stop > 0, F.left(tail, stop - 1)).otherwise(tail)))


def sections(text: Column, names: list[str]) -> Column:
    """A map from each header line ``Name:`` to the lines below it until the next, carried forward line by line."""
    header = F.array(*[F.lit(f"{n}:") for n in names])
    start = F.struct(F.lit("").alias("at"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("out"))

    def step(acc: Column, line: Column) -> Column:
        here = F.array_contains(header, F.trim(line))
        at = F.when(here, F.regexp_replace(F.trim(line), ":$", "")).otherwise(acc.at)
        old = F.coalesce(acc.out[acc.at], F.lit(""))
        new = F.map_from_arrays(F.array(acc.at), F.array(F.when(old == "", line).otherwise(F.concat(old, F.lit("\n"), line))))
        put = F.map_concat(F.map_filter(acc.out, lambda k, v: k != acc.at), new)
        return F.struct(at.alias("at"), F.when(here | (acc.at == ""), acc.out).otherwise(put).alias("out"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda a: a.out)


def uris(list_: Column, most: int = 3) -> Column:
    """The first of a list, joined, and how many more there are."""
    rest = F.size(list_) - most
    return F.concat(F.array_join(F.slice(list_, 1, most), ", "), F.when(rest > 0, F.format_string(" +%d more", rest)).otherwise(F.lit("")))


def percent(value: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.format_string("%.1f%%", value.cast("double") * 100)


def similar_case(type_: Column, severity: Column, description: Column) -> Column:
    """One line on a similar case, its description cut at 60."""
    return F.format_string("- %s (%s): %s...", type_, severity, F.left(description, F.lit(60)))


def embedding_text(*parts: Column) -> Column:
    """P50: the non-empty parts, joined by blanks."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def duration(text: Column) -> Column:
    """``30s``, ``5m``, ``12h``, ``180d`` as an interval of days to seconds; null if it isn't one."""
    number, unit = F.regexp_extract(text, r"^\s*(\d+)\s*([smhd])\s*$", 1).try_cast("int"), F.regexp_extract(text, r"^\s*(\d+)\s*([smhd])\s*$", 2)
    pick = lambda u: F.when(unit == u, number).otherwise(0)
    return F.when(number.isNotNull(), F.make_dt_interval(pick("d"), pick("h"), pick("m"), pick("s").cast("decimal(18,6)")))


def version(text: Column) -> Column:
    """The first three numbers of a version as an array, missing ones 0; null if it doesn't begin with one."""
    plain = F.regexp_replace(text, "^[vV]", "")
    part = lambda i: F.coalesce(F.regexp_extract(plain, r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?", i).try_cast("int"), F.lit(0))
    return F.when(plain.rlike(r"^\d"), F.array(part(1), part(2), part(3)))


def find_version(text: Column) -> Column:
    """A version after a dependency's coordinates, after ``version``, or the first one in the text."""
    tries = (r"[\w.-]+:[\w.-]+:(\d+\.\d+(?:\.\d+)?)", r"(?i)version[\s=:\"']+(\d+\.\d+(?:\.\d+)?)", r"(\d+\.\d+(?:\.\d+)?)")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, t, 1), F.lit("")) for t in tries])


def newest_versions(versions: Column, numeric: bool = False) -> Column:
    """Distinct versions, greatest first, by text as the default has it or by their numbers."""
    distinct = F.array_distinct(versions)
    if not numeric:
        return F.sort_array(distinct, asc=False)
    return F.transform(F.sort_array(F.transform(distinct, lambda v: F.struct(version(v).alias("n"), v.alias("v"))), asc=False), lambda x: x.v)


def url_safe(raw: Column) -> Column:
    """Bytes as base64 for URLs, without padding or line ends."""
    return F.rtrim(F.translate(F.base64(raw), "+/\r\n", "-_"), F.lit("="))


def jwt_payload(token: Column, schema: str) -> Column:
    """The second part of a signed token, decoded and parsed; its signature isn't checked."""
    body = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(body, F.ceil(F.length(body) / 4) * 4, F.lit("="))
    return F.from_json(F.decode(F.unbase64(padded), "UTF-8"), schema)


def safe_decode(raw: Column, limit: int = 500_000) -> Column:
    """Bytes of at most ``limit`` as UTF-8 if valid, else as Latin-1; null beyond the limit."""
    return F.when(F.length(raw) <= limit, F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1")))
