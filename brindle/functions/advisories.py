"""Advisories, releases and notices: ids, severities, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import severity
from brindle.functions.keywords import any_of
from brindle.functions.text import version
from brindle.operators.ordering import since

# Statuses of authenticators that make a notice, and what they and severities are worth.
STATUSES = {"REVOKED": "high", "USER_VERIFICATION_BYPASS": "high", "ATTESTATION_KEY_COMPROMISE": "critical", "USER_KEY_REMOTE_COMPROMISE": "critical", "USER_KEY_PHYSICAL_COMPROMISE": "medium", "UPDATE_AVAILABLE": "medium"}
NOTICE_SCORES = {"critical": 9.0, "high": 7.5, "medium": 5.5, "low": 3.0}
SECURITY_WORDS = ["security", "vulnerability", "cve", "fix", "patch", "advisory"]


def outdated(current: Column, latest: Column) -> Column:
    """Whether a version is below another by its three numbers; null if either has none."""
    return version(current) < version(latest)


def is_security_release(body: Column) -> Column:
    """F16: whether a release's text speaks of security."""
    return any_of(F.lower(F.coalesce(body, F.lit(""))), SECURITY_WORDS)


def notice(status: Column, aaid: Column, aaguid: Column, effective: Column, authenticator: Column) -> Column:
    """Id, name, severity and score of a status report."""
    level = severity.lookup(STATUSES, status, "medium")
    who = F.left(F.coalesce(aaid, aaguid, F.lit("UNKNOWN")), F.lit(8))
    return F.struct(
        F.format_string("FIDO-MDS-%s-%s-%s", status, who, F.date_format(effective, "yyyy-MM-dd")).alias("id"),
        F.format_string("FIDO %s: %s", status, authenticator).alias("name"),
        level.alias("severity"),
        severity.lookup(NOTICE_SCORES, level, 5.5).alias("score"),
    )


#: What tells a status report from others; a notice's id has only eight letters of the authenticator's.
REPORT = ("status", "aaid", "aaguid", "effective")


def new_notices(reports: DataFrame, known: DataFrame, last: Column) -> DataFrame:
    """Status reports worth a notice, since the last check, that aren't known; ``reports`` has status, aaid, aaguid, effective (date), authenticator.

    ``known`` has those but the authenticator; or, where only notices were kept, id, which authenticators whose ids begin alike share.
    """
    worth = since(reports.filter(F.col("status").isin(*STATUSES)), "effective", last)
    made = worth.select(*REPORT, notice(*[F.col(c) for c in (*REPORT, "authenticator")]).alias("n")).select(*REPORT, "n.*").distinct()
    by = REPORT if set(REPORT) <= set(known.columns) else ("id",)
    held = known.select(*[F.col(c).alias(f"known_{c}") for c in by]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in by]
    return made.join(held, same, "left_anti").drop(*REPORT)


def decision(description: Column, current: Column, latest: Column) -> Column:
    """Whether updating the library may settle a notice: if it is about metadata or attestation and the library is outdated; else a manual review."""
    about = any_of(F.lower(F.coalesce(description, F.lit(""))), ["metadata", "attestation"])
    settled = F.coalesce(about & outdated(current, latest), F.lit(False))
    return F.struct(settled.alias("mitigated"), F.when(settled, "update_dependency").otherwise("manual_review").alias("action"), F.when(settled, latest).alias("suggested_version"))


def update_advisory(current: Column, releases: DataFrame, now: Column) -> DataFrame:
    """One row if the newest of ``releases`` (tag, body, published) is above the current version and some newer one speaks of security; else none."""
    newer = releases.withColumn("security", is_security_release(F.col("body")) & outdated(current, F.col("tag")))
    facts = newer.agg(F.max_by("tag", F.struct("published", "tag")).alias("latest"), F.count_if("security").alias("n"), F.max(F.when(F.col("security"), F.col("published"))).alias("newest"))
    facts = facts.filter(outdated(current, F.col("latest")) & (F.col("n") > 0))
    return facts.select("latest", "n", severity.update_severity(F.col("n"), F.col("newest"), now).alias("severity"), severity.update_score(F.col("n")).alias("score"))


def normalised(rows: DataFrame) -> DataFrame:
    """Advisories of a repository as advisory rows, the score by the severity where it is missing. ``rows`` has ghsa_id, summary, description, severity, score, published_at."""
    return rows.select(F.col("ghsa_id").alias("id"), F.col("summary").alias("name"), F.lower("severity").alias("severity"), F.coalesce("score", severity.default_score(F.col("severity"))).alias("cvss_score"), F.col("published_at").alias("published"), F.coalesce("description", "summary").alias("description"))


def changed_images(images: DataFrame) -> DataFrame:
    """images whose digest at the source is known and differs from the target's, or whose target is missing."""
    return images.filter(F.col("source_digest").isNotNull() & ~F.col("source_digest").eqNullSafe(F.col("target_digest")))


def with_tag(images: DataFrame, pattern: str) -> DataFrame:
    """images of which a tag fits a pattern."""
    return images.filter(F.exists("tags", lambda t: t.rlike(pattern)))


def artifact_checks(df: DataFrame, sizes: list[str]) -> DataFrame:
    """whether each of the files is there and not empty, and whether all are."""
    checks = {f"{c}_ok": F.coalesce(F.col(c) > 0, F.lit(False)) for c in sizes}
    return df.withColumns(checks).withColumn("all_ok", F.forall(F.array(*[F.col(c) for c in checks]), lambda x: x))
