"""Analyses of findings: template texts by rules, transformations of code, merged results, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_rules(rules: list[tuple[Column, str]], otherwise: Column) -> Column:
    """The text of the first rule that holds."""
    return F.coalesce(*[F.when(test, F.lit(text)) for test, text in rules], otherwise)


def has(column: Column, word: str) -> Column:
    return F.contains(F.coalesce(column, F.lit("")), F.lit(word))


def impact(id_: Column, severity: Column, tool: Column) -> Column:
    """What a finding may lead to, by workflow rules, then tools, then severity."""
    tool = F.lower(tool)
    rules = [
        (has(id_, "CKV_GHA") | has(id_, "CKV2_GHA"), "A workflow has more rights than it needs."),
        (has(tool, "semgrep"), "Code analysis found a flaw that attackers could use."),
        (has(tool, "trivy"), "A container or dependency is known to be vulnerable."),
        (has(tool, "checkov"), "Deployed infrastructure would be open to attack."),
        (severity.isin("HIGH", "CRITICAL"), "The flaw is severe."),
    ]
    return by_rules(rules, F.lit("The flaw should be reviewed."))


def remediation(id_: Column, tool: Column) -> Column:
    """What to do about a finding, by rule ids, then tools."""
    tool, low = F.lower(tool), F.lower(id_)
    rules = [
        (has(id_, "CKV_GHA_7"), "Name the least permissions under permissions."),
        (has(id_, "CKV2_GHA_1"), "Replace write-all by the permissions of each job."),
        (has(low, "webauthn"), "Check how credentials are validated."),
        (has(id_, "exported_activity"), "Don't export the activity."),
        (has(id_, "unsafe-formatstring"), "Use parameters instead of formatted input."),
        (has(tool, "semgrep"), "Validate and escape input in the code found."),
        (has(tool, "trivy"), "Update to a version that has the fix."),
    ]
    return by_rules(rules, F.lit("Apply the vendor's patch or configuration."))


def prevention(id_: Column) -> Column:
    """How to keep a finding from coming back."""
    low = F.lower(id_)
    rules = [(has(id_, "GHA"), "Review workflows for least permissions."), (has(low, "webauthn"), "Test the ceremony's checks."), (has(low, "android"), "Test the app in each build.")]
    return by_rules(rules, F.lit("Scan in each build."))


def header_fix(alert: Column, solution: Column) -> Column:
    """The setting that answers an alert on HTTP headers, by keyword; else the scanner's own advice."""
    low = F.lower(alert)
    rules = [
        (has(low, "cors"), "Allow only known hosts to share resources."),
        (has(low, "x-content-type-options"), "X-Content-Type-Options: nosniff"),
        (has(low, "cache"), "Cache-Control: no-store, private"),
        (has(low, "cross-origin-resource-policy") | has(low, "spectre"), "Cross-Origin-Resource-Policy: same-origin"),
        (has(low, "sec-fetch"), "Refuse requests whose Sec-Fetch-Site is cross-site."),
    ]
    return by_rules(rules, solution)


def transformed(code: Column, steps: list[dict[str, str]]) -> Column:
    """Code after a template's steps: replace (pattern, replacement), wrap (prefix, suffix), prepend and append (code)."""
    for s in steps:
        match s["type"]:
            case "replace":
                code = F.regexp_replace(code, s["pattern"], s["replacement"])
            case "wrap":
                code = F.concat(F.lit(s.get("prefix", "")), code, F.lit(s.get("suffix", "")))
            case "prepend":
                code = F.concat(F.lit(s["code"] + "\n"), code)
            case "append":
                code = F.concat(code, F.lit("\n" + s["code"]))
    return code


def merged(baseline: Column, enhanced: Column, similar: Column, index_size: Column) -> Column:
    """Baseline and enhancement side by side with a summary of the similar cases (array of struct with tool, type, score)."""
    summary = F.transform(similar, lambda s: F.struct(s.tool.alias("tool"), s.type.alias("type"), F.format_string("%.1f%%", s.score.cast("double") * 100).alias("similarity")))
    about = F.struct((F.size(similar) > 0).alias("enhanced"), F.size(similar).alias("n_similar"), summary.alias("similar"), index_size.alias("index_size"))
    return F.struct(baseline.alias("baseline"), enhanced.alias("enhanced"), about.alias("about"))


def summary(results: DataFrame, most: int = 1000) -> DataFrame:
    """In one row how many analyses went well and failed, counts by severity and tool of the good ones, how many are severe and the first ``most`` ids of these in order.

    ``results`` has status, severity, tool, id. Counts are made by severity and tool first, so the one row gathers as many entries as there are
    of these; each task hands on ``most`` ids of severe findings at most.
    """
    good = results.filter("status = 'success'").withColumn("severity", F.coalesce("severity", F.lit("UNKNOWN"))).withColumn("tool", F.coalesce("tool", F.lit("unknown")))
    severe = F.col("severity").isin("HIGH", "CRITICAL", "ERROR")
    ok = F.col("status") == "success"
    totals = results.agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(ok & severe).alias("n_severe"))
    gathered = lambda c: good.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    first = good.filter(severe).orderBy("id").limit(most).agg(F.sort_array(F.collect_list("id")).alias("severe"))
    return totals.join(F.broadcast(gathered("severity"))).join(F.broadcast(gathered("tool"))).join(F.broadcast(first))
