"""Small column functions shared by the operators. All are built from Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilake.rules.model import SEVERITIES

# Ecosystem names of the public advisory database.
ECOSYSTEM_NAMES = {
    "pypi": "PyPI", "npm": "npm", "go": "Go", "rust": "crates.io", "maven": "Maven", "nuget": "NuGet",
    "packagist": "Packagist", "rubygems": "RubyGems",
}


def lookup(key: Column, table: dict) -> Column:
    """Value of a fixed table, null for an unknown key."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def severity_rank(severity: Column) -> Column:
    """0 for low to 3 for critical; unknown text counts as low."""
    position = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(severity))
    return F.coalesce(F.greatest(position.cast("int") - 1, F.lit(0)), F.lit(0))



def cvss_to_severity(score: Column, text: Column) -> Column:
    """Severity from a score, or from the text where there is no score."""
    word = F.lower(text)
    return (
        F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium")
        .when(score.isNotNull(), "low")
        .when(word.isin("critical", "high"), "high")
        .when(word.isin("medium", "moderate"), "medium")
        .when(word.isin("low", "minor"), "low")
        .otherwise("medium")
    )


def ecosystem_osv(ecosystem: Column) -> Column:
    return F.coalesce(lookup(F.lower(ecosystem), ECOSYSTEM_NAMES), ecosystem)


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), name, F.lit("@"), version)


def clean_npm_version(version: Column) -> Column:
    """Version without range signs, cut at the first character that is no digit or dot."""
    return F.regexp_replace(F.regexp_replace(version, r"^[\^~>=<]+", ""), r"(?s)[^0-9.].*$", "")


def strip_range_signs(version: Column) -> Column:
    return F.regexp_replace(version, r"[\^~]", "")


def finding_id(analyzer: Column, path: Column, line: Column, finding_type: Column, repo: Column | None = None) -> Column:
    """Stable id: three letters of the analyzer and a hash of where and what, at full length, as scans are compared by it.

    A repository that is known is part of the place; a null one counts as not known. :func:`short_id` is for display.
    """
    place = F.coalesce(line.cast("string"), F.lit("N/A"))
    digest = F.sha2(F.concat_ws(":", analyzer, *([] if repo is None else [repo]), path, place, finding_type), 256)
    return F.concat(F.upper(F.substring(analyzer, 1, 3)), F.lit("-"), digest)


def short_id(full: Column, digits: int = 12) -> Column:
    """The first digits of an id, for reports. Not a key: in large tables several findings share them."""
    return F.substring(full, 1, 4 + digits)


def location_string(path: Column, line_start: Column, line_end: Column) -> Column:
    span = F.when(line_end.isNotNull() & (line_end != line_start),
                  F.concat(F.lit("-"), line_end.cast("string"))).otherwise("")
    return F.when(line_start.isNull(), path).otherwise(
        F.concat(path, F.lit(":"), line_start.cast("string"), span)
    )


def is_night(ts: Column, start: int = 22, end: int = 6) -> Column:
    """True for hours from ``start`` up to ``end``, across midnight if the window wraps."""
    hour = F.hour(ts)
    return (hour >= start) | (hour < end) if start > end else (hour >= start) & (hour < end)


def days_inactive(ts: Column, as_of: Column) -> Column:
    """Whole days between a timestamp and the reference time."""
    return F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000)


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def repo_name_from_url(url: Column, fallback: str = "repository") -> Column:
    last = F.regexp_extract(F.rtrim(url, F.lit("/")), r"[^/]+$", 0)
    name = F.regexp_replace(last, r"\.git$", "")
    return F.when(name == "", F.lit(fallback)).otherwise(F.coalesce(name, F.lit(fallback)))


def confidence_percent(confidence: Column) -> Column:
    return F.format_string("%.0f%%", confidence * 100)


def parse_osv_time(text: Column) -> Column:
    """ISO time of an advisory; null if it does not parse."""
    return F.try_to_timestamp(text)


def issue_label(text: Column) -> Column:
    """``open_port`` becomes ``Open port``."""
    words = F.replace(text, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, F.lit(2), F.length(words))))


def vulnerability_description(
    name: Column, version: Column, summary: Column, cvss: Column, fixed: Column, references: Column
) -> Column:
    """Readable text of a dependency finding; at most three references are listed."""
    refs = F.slice(F.coalesce(references, F.array().cast("array<string>")), 1, 3)
    has = lambda c: c.isNotNull() & (c != "")
    return F.concat(
        F.format_string("Package %s version %s has a known vulnerability.\n\n", name, version),
        F.when(has(summary), F.concat(F.lit("Summary: "), summary, F.lit("\n\n"))).otherwise(""),
        F.when(F.coalesce(cvss, F.lit(0.0)) != 0, F.concat(F.lit("CVSS Score: "), cvss.cast("string"), F.lit("\n"))).otherwise(""),
        F.when(has(fixed), F.concat(F.lit("Fixed in version: "), fixed, F.lit("\n"))).otherwise(""),
        F.when(F.size(refs) > 0, F.concat(
            F.lit("\nReferences:\n"), F.array_join(F.transform(refs, lambda r: F.concat(F.lit("- "), r, F.lit("\n"))), "")
        )).otherwise(""),
        F.lit("\nRecommendation: Update "), name, F.lit(" to version "),
        F.when(has(fixed), fixed).otherwise("latest"), F.lit(" or later."),
    )


def glob_to_regex(glob: str) -> str:
    """Java pattern of a shell glob over whole paths; ``*`` also crosses ``/``."""
    special = set(".^$+{}()|\\")
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and close > 0:
            body = glob[i + 1:close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append("\\" + c if c in special or c in "[]" else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"
