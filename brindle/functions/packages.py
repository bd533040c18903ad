"""Packages, paths and code: ecosystems, languages, diffs, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.severity import lookup

# Fixed values.
DIRECTORY_LANGUAGES = {
    "java": "java", "py": "python", "js": "javascript", "go": "go", "rb": "ruby", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp", "php": "php", "ts": "typescript", "kt": "kotlin", "rs": "rust",
    "swift": "swift", "scala": "scala", "html": "html", "htm": "html", "css": "css", "xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml", "sh": "shell", "bash": "shell", "cgi": "perl", "coffee": "coffeescript",
    "as": "actionscript", "inc": "php", "ctp": "php", "jelly": "xml", "h": "c",
}
EXTENSION_LANGUAGES = {
    ".js": "JavaScript", ".ts": "TypeScript", ".html": "HTML", ".css": "CSS", ".php": "PHP", ".rb": "Ruby", ".erb": "Ruby", ".py": "Python", ".java": "Java", ".kt": "Kotlin", ".go": "Go", ".rs": "Rust", ".cs": "C#", ".fs": "F#",
    ".scala": "Scala", ".swift": "Swift", ".c": "C", ".h": "C", ".cpp": "C++", ".hpp": "C++", ".cc": "C++", ".hh": "C++", ".sh": "Shell", ".bash": "Shell", ".pl": "Perl", ".pm": "Perl", ".lua": "Lua", ".r": "R",
    ".m": "Objective-C", ".mm": "Objective-C++", ".sql": "SQL", ".xml": "XML", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".md": "Markdown",
}


def ecosystem(package: Column, uri: Column) -> Column:
    """Where a package comes from, by its name and the file that was scanned."""
    uri = F.coalesce(uri, F.lit(""))
    return (
        F.when(F.contains(package, F.lit(":")), "maven")
        .when(F.contains(package, F.lit("/")) | F.startswith(package, F.lit("@")), "npm")
        .when(F.endswith(uri, F.lit("requirements.txt")) | F.contains(uri, F.lit("site-packages")), "pip")
        .when((F.contains(uri, F.lit("dockerfile://")) | F.endswith(uri, F.lit(".tar"))) & F.contains(F.lower(uri), F.lit("alpine")), "os_apk")
        .when(F.contains(uri, F.lit("dockerfile://")) | F.endswith(uri, F.lit(".tar")), "os_apt")
        .otherwise("unknown")
    )


def config_type(path: Column) -> Column:
    """P10: what kind of configuration a file is, by its path."""
    low = F.lower(path)
    yaml = low.rlike(r"\.ya?ml$")
    return (
        F.when(F.contains(low, F.lit(".github/workflows")), "github_actions")
        .when(F.contains(low, F.lit("dockerfile")), "dockerfile")
        .when(yaml & F.contains(low, F.lit("k8s")), "kubernetes")
        .when(F.endswith(low, F.lit(".tf")), "terraform")
        .when(yaml, "yaml_config")
        .otherwise("config")
    )


def upgrade_snippet(package: Column, version: Column, eco: Column) -> Column:
    """The line that asks for a version, in the ecosystem's notation."""
    return (
        F.when(eco == "maven", F.format_string('implementation("%s:%s")', package, version))
        .when(eco == "npm", F.format_string('"%s": "^%s"', package, version))
        .when(eco == "pip", F.format_string("%s==%s", package, version))
        .otherwise(F.format_string("Upgrade %s to version %s", package, version))
    )


def upgrade_fix(package: Column, installed: Column, fixed: Column, eco: Column) -> Column:
    """The fix of a finding with a comma-separated list of fixed versions: the first, and the others as alternatives."""
    versions = F.transform(F.split(fixed, ","), lambda v: F.trim(v))
    first = versions[0]
    alternative = lambda v: F.struct(
        F.format_string("Upgrade to %s if on a different release branch", v).alias("description"),
        upgrade_snippet(package, v, eco).alias("fixed_code"),
        F.format_string("On another release branch, version %s has the fix too.", v).alias("explanation"),
    )
    return F.when(
        first != "",
        F.struct(
            F.lit(1.0).alias("confidence"),
            F.format_string("Upgrade %s from %s to %s to fix security vulnerability", package, installed, first).alias("description"),
            upgrade_snippet(package, first, eco).alias("fixed_code"),
            F.format_string("Version %s of %s is vulnerable; version %s is not.", installed, package, first).alias("explanation"),
            package.alias("package"),
            installed.alias("from_version"),
            first.alias("to_version"),
            eco.alias("ecosystem"),
            F.transform(F.slice(versions, F.lit(2), F.greatest(F.size(versions) - 1, F.lit(0))), alternative).alias("alternatives"),
        ),
    )


def parse_upgrade(description: Column) -> Column:
    """Package, from and to of a description as ``upgrade_fix`` writes it."""
    part = lambda i: F.nullif(F.regexp_extract(description, r"Upgrade (\S+) from (\S+) to (\S+)", i), F.lit(""))
    return F.struct(part(1).alias("package"), part(2).alias("from_version"), part(3).alias("to_version"))


def directory_language(directory: Column) -> Column:
    """The language a directory stands for; null if none."""
    return lookup(DIRECTORY_LANGUAGES, F.lower(directory))


def extension(path: Column) -> Column:
    """The last suffix of a path's file name, with its dot; empty if there is none."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]+)$", 1)


def changed_paths(diff: Column) -> Column:
    """The paths after a diff, in order."""
    heads = F.filter(F.split(diff, "\n"), lambda l: F.startswith(l, F.lit("+++ b/")))
    return F.transform(heads, lambda l: F.substring_index(l, " b/", -1))


def diff_language(diff: Column) -> Column:
    """The language of the commonest suffix in a diff, of equally common ones the first in the alphabet; Unknown without paths, Other for suffixes not listed."""
    suffixes = F.sort_array(F.transform(changed_paths(diff), extension))
    # a suffix's first place in the sorted list and the next one's say how often it stands there; the list is made once, as a lambda's variable
    first = lambda a: F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == 1) | (F.get(a, i - 1) != F.get(a, i - 2)))
    counted = lambda a: F.transform(F.array(first(a)), lambda at: F.transform(at, lambda i, j: F.struct((i - F.coalesce(F.get(at, j + 1), F.size(a) + 1)).alias("n"), F.get(a, i - 1).alias("s"))))[0]
    best = F.transform(F.array(suffixes), lambda a: F.when(F.size(a) > 0, F.array_min(counted(a)).s))
    language = lambda s: F.when(s.isNotNull(), lookup(EXTENSION_LANGUAGES, s, "Other")).otherwise("Unknown")
    return F.transform(best, language)[0]


def diff_side(diff: Column, sign: str) -> Column:
    """P25: the lines that a diff takes out (``-``) or puts in (``+``), without the sign."""
    own = F.filter(F.split(diff, "\n"), lambda l: F.startswith(l, F.lit(sign)) & ~F.startswith(l, F.lit(sign * 3)))
    return F.array_join(F.transform(own, lambda l: F.substr(l, F.lit(2))), "\n")


def stat_number(text: Column) -> Column:
    """The number in a column of a line of numbers, 0 if there is none. A dash isn't cast, since a cast that fails costs an exception."""
    return F.when(text == "-", F.lit(0)).otherwise(F.coalesce(text.try_cast("int"), F.lit(0)))


def numstat(text: Column) -> Column:
    """A map from file to lines added and deleted; a dash, for binary files, is 0; of a repeated file the last counts."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda l: F.split(l, "\t")), lambda p: F.size(p) >= 3)
    entries = F.transform(rows, lambda p: F.struct(p[2].alias("k"), F.struct(stat_number(p[0]).alias("added"), stat_number(p[1]).alias("deleted")).alias("v")))
    ordered = F.sort_array(F.transform(entries, lambda x, i: F.struct(x.k.alias("k"), i.alias("i"), x.v.alias("v"))))
    # bound to a lambda's variable, so that the list is made once, and of each file's run the last is taken: a sort's work, not a square's
    last = F.transform(F.array(ordered), lambda a: F.filter(a, lambda x, i: ~F.coalesce(F.get(a, i + 1).k == x.k, F.lit(False))))[0]
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x.k.alias("k"), x.v.alias("v"))))


def context(text: Column, line: Column, around: int = 10) -> Column:
    """Numbered lines around a line (from 1), joined."""
    lines, first = F.split(text, "\n"), F.greatest(line - around, F.lit(1))
    return F.array_join(F.transform(F.slice(lines, first, line + around - first + 1), lambda l, i: F.format_string("%4d | %s", first + i, l)), "\n")


def is_source(path: Column) -> Column:
    """false for what stands where a path does but is no source file: addresses, images, archives, coordinates, build output."""
    low = F.lower(path)
    wrong = (
        low.rlike(r"(^|/)(https?|ftp):|^file:")
        | path.rlike(r"^(container:|library/|docker\.io/|registry\.|ghcr\.io/)")
        | path.rlike(r"^[^./][^/]*:[^/]*$")
        | path.rlike(r"/[^/]*:[^/]*$")
        | path.rlike(r"\.(jar|war|ear|class)$")
        | low.rlike(r"/(tmp|temp|build|target|dist|node_modules)/")
        | path.rlike(r"^[A-Za-z0-9]+(\.[A-Za-z0-9]+){2,}$")
        | path.rlike(r":.*:")
    )
    return F.coalesce(path != "", F.lit(False)) & ~wrong


def shared_parts(a: Column, b: Column) -> Column:
    """How many of a path's parts another has."""
    return F.size(F.array_intersect(F.split(a, "/"), F.split(b, "/")))


def source_candidates(path: Column) -> Column:
    """What a scanned path may be called in the source tree, in the order to be tried: array of struct (how, candidate), candidate null where the rule doesn't apply.

    ``checkout``: what follows the two folders of a build machine's work folder; ``workflow``: a workflow file with its
    dot put back; ``relative``: a path that is relative already; ``name``: the last part; ``end``: the last two, then three parts.
    """
    parts = F.split(path, "/", -1)
    work = F.split(F.substring_index(path, "/runner/work/", -1), "/", -1)
    checkout = F.when(F.contains(path, F.lit("/runner/work/")) & (F.size(work) >= 3), F.array_join(F.slice(work, 3, F.greatest(F.size(work), F.lit(1))), "/"))
    inner = F.when(F.contains(path, F.lit("/github/workflows/")), F.concat(F.lit(".github/workflows/"), F.substring_index(path, "/github/workflows/", -1)))
    workflow = F.coalesce(inner, F.when(F.startswith(path, F.lit("github/workflows/")), F.concat(F.lit("."), path)))
    last = lambda n: F.when(F.size(parts) > n, F.array_join(F.slice(parts, -n, n), "/"))
    rules = [("checkout", checkout), ("workflow", workflow), ("relative", F.when(~F.startswith(path, F.lit("/")), path)), ("name", F.substring_index(path, "/", -1)), ("end", last(2)), ("end", last(3))]
    return F.array(*[F.struct(F.lit(how).alias("how"), F.when(c != "", c).alias("candidate")) for how, c in rules])


def framework(path: Column) -> Column:
    """Framework or technology by a path."""
    low = F.lower(path)
    tests = (("react", r"react|\.(jsx|tsx)$"), ("android", "android"), ("ktor", r"ktor|\.kt$"), ("spring", r"spring|\.java$"), ("docker", "docker"), ("github_actions", r"\.github/"))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(n)) for n, p in tests], F.lit("generic"))


PLACEHOLDER = r"\{[^/}]+\}|:[^/]+"


def route_pattern(route: Column) -> Column:
    """A regex for a route in which ``{name}`` and ``:name`` stand for one part of a path each."""
    quoted = F.regexp_replace(route, r"([.+*?^$()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, PLACEHOLDER, "[^/]+"), F.lit("$"))
