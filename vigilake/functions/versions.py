"""Version comparison on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

def version_key(version: Column) -> Column:
    """Numeric parts of a dotted version as whole numbers, or null if any part is none that a long holds."""
    parts = F.split(version, r"\.", -1)
    numbers = F.transform(parts, lambda x: F.trim(x).try_cast("bigint"))
    return F.when(F.forall(parts, lambda x: F.trim(x).rlike(r"^[0-9]{1,18}$")), numbers)


def ordering_key(version: Column) -> Column:
    """What dotted versions sort and compare by: their parts as (number of digits, digits), without trailing zeros.

    Parts of any length compare as numbers, and the shorter version as padded with zeros. Null if a part is no number.
    """
    parts = F.split(version, r"\.", -1)
    digits = F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^0+", ""))
    key = F.transform(digits, lambda x: F.struct(F.length(x).alias("n"), x.alias("digits")))
    zeros = F.aggregate(digits, F.lit(0), lambda n, x: F.when(x == "", n + 1).otherwise(0))
    return F.when(F.forall(parts, lambda x: F.trim(x).rlike("^[0-9]+$")), F.slice(key, F.lit(1), F.size(key) - zeros))


def compare_keys(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two ordering keys."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two version strings; text comparison if one has a part that is not a number."""
    left, right = ordering_key(a), ordering_key(b)
    as_text = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.when(left.isNotNull() & right.isNotNull(), compare_keys(left, right)).otherwise(as_text)


def version_lt(a: Column, b: Column) -> Column:
    """True if both versions are numeric and the first is lower; a version that does not parse is not lower."""
    left, right = ordering_key(a), ordering_key(b)
    return F.coalesce(compare_keys(left, right) < 0, F.lit(False)) & left.isNotNull() & right.isNotNull()


def version_sufficient(current: Column, minimum: Column) -> Column:
    """True if a tool version reaches the minimum; a version that does not parse is taken as sufficient."""
    left, right = ordering_key(current), ordering_key(minimum)
    return F.when(left.isNull() | right.isNull(), True).otherwise(compare_keys(left, right) >= 0)


def version_matches(version: Column, spec: Column) -> Column:
    """True if a version satisfies ``< v``, ``<= v``, ``> v``, ``>= v``, ``== v``, ``= v``, a wildcard or equality."""
    bound = F.trim(F.regexp_replace(spec, r"^(<=|>=|==|<|>|=) ", ""))
    order = compare_versions(version, bound)
    # wildcards: * is any text, x is digits; a dot keeps its meaning of any character
    wildcard = F.concat(F.lit("^"), F.replace(F.replace(spec, F.lit("*"), F.lit(".*")), F.lit("x"), F.lit("\\d+")), F.lit("$"))
    return (
        F.when(spec.startswith("< "), order < 0)
        .when(spec.startswith("<= "), order <= 0)
        .when(spec.startswith("> "), order > 0)
        .when(spec.startswith(">= "), order >= 0)
        .when(spec.startswith("== ") | spec.startswith("= "), order == 0)
        .when(spec.contains("*") | spec.contains("x"), F.rlike(version, wildcard))
        .otherwise(version == spec)
    )
