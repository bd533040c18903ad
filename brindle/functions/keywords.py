"""Categories, classes and predicates by keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.severity import lookup

# Keywords, in the order in which they are tried or listed.
CATEGORIES = {
    "sanitization": ["sanitize", "escape", "encode", "filter"],
    "validation": ["validate", "check", "verify", "assert"],
    "authentication": ["auth", "login", "credential", "token"],
    "authorization": ["permission", "access control", "privilege"],
    "cryptography": ["encrypt", "decrypt", "hash", "crypto", "cipher"],
    "input_handling": ["input", "user data", "untrusted"],
}
CLASSES = {
    "sql_injection": ["sql", "injection", "query"],
    "xss": ["xss", "cross-site", "script"],
    "command_injection": ["command", "exec", "shell"],
    "authentication_bypass": ["auth", "credential", "bypass"],
    "information_disclosure": ["disclosure", "leak", "expose"],
    "insecure_configuration": ["config", "setting", "default"],
}
TOOLS = {
    "sarif-trivy": "container_security", "trivy": "container_security",
    "sarif-checkov": "infrastructure_security", "checkov": "infrastructure_security", "sarif-gitleaks": "infrastructure_security", "gitleaks": "infrastructure_security",
    "zap": "web_security", "sarif-zap": "web_security",
    "osv-scanner": "dependency_vulnerabilities", "sarif-osv": "dependency_vulnerabilities",
    "semgrep": "code_vulnerabilities", "sarif-semgrep": "code_vulnerabilities",
    "mobsf": "mobile_security",
}
CANONICAL = {"dependency_security": "dependency_vulnerabilities", "code_vulnerability": "code_vulnerabilities"}
REFINEMENT = ["webauthn", "fido", "authenticator", "credential", "attestation", "assertion", "challenge", "passkey"]
SURE_TOOLS, FAIR_TOOLS = ["sarif-trivy", "sarif-checkov", "osv-scanner"], ["zap", "gitleaks"]
DIRECT = ["webauthn", "web authentication", "fido2", "fido", "passkey", "passwordless", "public key credential", "assertion", "attestation", "relying party", "java-webauthn-server", "yubico", "yubikey"]
CONTEXTUAL = ["authenticator", "credential", "biometric", "security key"]
EXCLUDED = ["oauth", "saml", "ldap", "active directory", "certificate authority", "ssl", "tls", "ssh", "vpn", "database credential", "api key", "password hash", "encryption key", "private key", "digital certificate"]
SUPPORTING = ["browser", "client", "origin", "challenge", "signature", "registration", "authentication", "user verification", "cross-origin", "same-origin", "javascript", "web application"]
COMPONENTS = {
    "authentication flows": ["authentication", "login"],
    "registration flows": ["registration", "enrollment"],
    "origin validation": ["origin", "cross-origin"],
    "credential management": ["credential", "key"],
    "session management": ["session", "token"],
    "user enumeration": ["user", "username"],
    "replay protection": ["replay", "reuse"],
    "timing attacks": ["timing", "side-channel"],
}


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words, anywhere; the text is to be in lower case."""
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out |= F.contains(text, F.lit(w))
    return out


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text holds."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words[1:]), F.contains(text, F.lit(words[0])).cast("int"))


def categories(text: Column, table: dict[str, list[str]] = CATEGORIES) -> Column:
    """Every category of which the text holds a keyword; empty for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(any_of(low, words), F.lit(name)) for name, words in table.items()]))


def first_class(*texts: Column, default: str = "generic_security_issue") -> Column:
    """The first class of which any of the texts holds a keyword."""
    low = F.lower(F.concat_ws("\n", *texts))
    return F.coalesce(*[F.when(any_of(low, words), F.lit(name)) for name, words in CLASSES.items()], F.lit(default))


def approaches(class_: Column, function: Column, class_name: Column, table: dict[str, list[str]]) -> Column:
    """A class's ways to fix, then those that the context adds, five at most; for no context at all the four of infrastructure."""
    base = F.coalesce(*[F.when(class_ == k, F.array(*map(F.lit, v))) for k, v in table.items()], F.array(*map(F.lit, ["input_validation", "error_handling", "defensive_programming"])))
    more = lambda test, names: F.when(test, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(base, more(function.isNotNull(), ["in_memory_solution", "cache_solution"]), more(class_name.isNotNull(), ["database_solution", "microservice_solution"]))
    return F.slice(all_, 1, 5)


def tool_category(tool: Column) -> Column:
    """The category of a tool; null for a tool that isn't known, to be rejected by the caller."""
    return lookup(TOOLS, F.lower(tool))


def categorised(tool: Column, text: Column, description: Column, severity: Column) -> Column:
    """Struct of category and confidence: keywords refine code findings, else the tool, length and severity decide."""
    base, n = tool_category(tool), hits(F.lower(F.coalesce(text, F.lit(""))), REFINEMENT)
    refined = (base == "code_vulnerabilities") & (n > 0)
    sure = F.when(F.lower(tool).isin(SURE_TOOLS), 0.9).when(F.lower(tool).isin(FAIR_TOOLS), 0.8).otherwise(0.7)
    plain = sure + F.when(F.length(F.coalesce(description, F.lit(""))) > 100, 0.05).otherwise(0.0) + F.when(F.lower(severity).isin("high", "critical"), 0.05).otherwise(0.0)
    confidence = F.when(refined & (n >= 2), F.least(F.lit(0.8) + n * 0.05, F.lit(1.0))).when(refined, 0.6).otherwise(F.least(plain, F.lit(1.0)))
    return F.when(base.isNotNull(), F.struct(F.when(refined, "webauthn_security").otherwise(base).alias("category"), confidence.alias("confidence")))


def canonical_category(category: Column) -> Column:
    """Q14: one name where tools' parsers have two."""
    return F.coalesce(lookup(CANONICAL, category), category)


def relevant(text: Column) -> Column:
    """A direct keyword, or a contextual and a supporting one and none that excludes."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return any_of(low, DIRECT) | (~any_of(low, EXCLUDED) & any_of(low, CONTEXTUAL) & any_of(low, SUPPORTING))


def affected_components(text: Column) -> Column:
    """Components named in a text, or a general one."""
    found = categories(text, COMPONENTS)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general webauthn")))


def type_of_focus(type_: Column, focus: Column) -> Column:
    """The stated type, else one named in the training focus, else general."""
    focus = F.coalesce(focus, F.lit(""))
    return F.coalesce(type_, *[F.when(F.contains(focus, F.lit(w)), F.lit(w)) for w in ("authentication", "cryptographic", "configuration", "implementation")], F.lit("general"))
