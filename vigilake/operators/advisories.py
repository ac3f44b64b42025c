"""Packages against advisories, and bills of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigilake.functions.scalars import (
    cvss_to_severity, ecosystem_osv, finding_id, parse_osv_time, purl, severity_rank, strip_range_signs,
    vulnerability_description,
)
from vigilake.functions.versions import ordering_key, version_lt
from vigilake.operators.findings import with_finding_defaults
from vigilake.operators.packages import distinct_packages
from vigilake.rules.config import KNOWN_VULNERABLE
from vigilake.session import HOT_ROWS, join_tasks, salted_join

_OSV = (
    "id string, summary string, severity array<struct<type:string,score:string>>, "
    "affected array<struct<package:struct<name:string,ecosystem:string>, "
    "ranges:array<struct<type:string,events:array<map<string,string>>>>,versions:array<string>>>, "
    "references array<struct<type:string,url:string>>, published string, modified string"
)


def load_advisories(raw: DataFrame, column: str = "value") -> DataFrame:
    """Advisory records (one JSON text per row) as advisory rows, one per affected package.

    Every range becomes intervals from an introduced version to the fixed version that follows it. A score that is no
    number, such as a vector, leaves the score empty and keeps the advisory.
    """
    parsed = raw.select(F.from_json(F.col(column), _OSV).alias("a")).where(F.col("a.id").isNotNull()).select("a.*")
    first = F.get("severity", F.lit(0))
    rows = parsed.select(
        "id", F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce(first["type"], F.lit("UNKNOWN")).alias("severity"),
        first["score"].try_cast("double").alias("cvss_score"),
        F.explode_outer("affected").alias("p"),
        F.coalesce(F.transform("references", lambda r: F.coalesce(r["url"], F.lit(""))), F.array().cast("array<string>")).alias("references"),
        parse_osv_time(F.col("published")).alias("published"), parse_osv_time(F.col("modified")).alias("modified"),
    )
    # commit ids of GIT ranges have no order that versions could be compared by
    ranges = F.filter("p.ranges", lambda r: F.coalesce(r["type"], F.lit("ECOSYSTEM")) != "GIT")
    events = F.coalesce(F.flatten(F.transform(ranges, lambda r: r["events"])), F.array().cast("array<map<string,string>>"))

    def intervals(items: Column) -> Column:
        # an introduced event opens an interval that ends at the next fixed event of the list
        return F.filter(
            F.transform(items, lambda e, i: F.struct(
                F.try_element_at(e, F.lit("introduced")).alias("introduced"),
                F.when(
                    F.try_element_at(F.get(items, i + 1), F.lit("introduced")).isNull(),
                    F.try_element_at(F.get(items, i + 1), F.lit("fixed")),
                ).alias("fixed"),
                F.when(
                    F.try_element_at(F.get(items, i + 1), F.lit("introduced")).isNull(),
                    F.try_element_at(F.get(items, i + 1), F.lit("last_affected")),
                ).alias("last_affected"),
            )),
            lambda x: x["introduced"].isNotNull(),
        )

    fixed = F.get(F.filter(F.transform(events, lambda e: F.try_element_at(e, F.lit("fixed"))), lambda x: x.isNotNull()), F.lit(0))
    return rows.select(
        "id", F.col("p.package.ecosystem").alias("ecosystem"), F.col("p.package.name").alias("name"), "summary", "severity",
        "cvss_score", intervals(events).alias("affected"), fixed.alias("fixed_version"), "references", "published", "modified",
        F.coalesce("p.versions", F.array().cast("array<string>")).alias("versions"),
    )


def _at_least(version: Column, bound: Column, key: Column, bound_key: Column) -> Column:
    """version >= bound, by precomputed sort texts where both are numeric, else as text."""
    return F.when(key.isNotNull() & bound_key.isNotNull(), key >= bound_key).otherwise(version >= bound)


#: The order of the characters that sort texts consist of. Every sort text ends with the first, so none is the start of another.
_ALPHABET = "!0123456789ABCDEF"
#: Sort texts are indexed up to this length. What agrees so far is left to the exact test.
_DEPTH = 64


def sort_text(version: Column) -> Column:
    """A text that sorts as the numeric version does: each part as its number of digits and its digits. Null for other versions."""
    parts = F.transform(ordering_key(version), lambda x: F.concat(
        F.when(x["n"] < 9, x["n"].cast("string")).otherwise(F.concat(F.lit("9"), F.lpad(x["n"].cast("string"), 10, "0"))),
        x["digits"],
    ))
    return F.concat(F.array_join(parts, ""), F.lit("!"))


def _byte_text(version: Column) -> Column:
    """A text of the same alphabet that sorts as the bytes of the version do."""
    return F.concat(F.hex(version.cast("binary")), F.lit("!"))


def _starts(text: Column, space: str) -> Column:
    """All prefixes of a sort text, the empty one included, each behind the name of its order."""
    cut = F.concat(F.lit(space), F.substring(text, 1, _DEPTH))
    return F.transform(F.sequence(F.lit(1), F.length(cut)), lambda n: F.substr(cut, F.lit(1), n))


def _fork(low: Column, high: Column) -> Column:
    """How many characters two bounds have in common; -1 if one is missing."""
    same = F.filter(F.sequence(F.lit(1), F.least(F.length(low), F.lit(_DEPTH))), lambda n: F.substr(low, F.lit(1), n) == F.substr(high, F.lit(1), n))
    return F.when(low.isNull() | high.isNull(), -1).otherwise(F.size(same))


def _cover(low: Column, high: Column, fork: Column, space: str) -> Column:
    """The prefixes that tile low <= text <= high; a missing bound leaves that end open.

    Every text in between starts with exactly one of them. A tile is a prefix of a bound followed by a character on the
    inner side, so their number follows from the length of the bounds and not from what lies between them.
    """
    low, high = F.substring(low, 1, _DEPTH), F.substring(high, 1, _DEPTH)

    def at(text, i):
        return F.position(F.substr(text, i + 1, F.lit(1)), F.lit(_ALPHABET))

    def tiles(text, i, first, last):
        # the text up to a place, followed by the characters of a stretch of the alphabet
        letters = F.split(F.substr(F.lit(_ALPHABET), first, F.greatest(last - first + 1, F.lit(0))), "")
        return F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.concat(F.substr(text, F.lit(1), i), c))

    def beside(text, stretch):
        # the tiles that leave the bound at one of its places behind the fork
        places = F.filter(F.sequence(F.lit(0), F.length(text) - 1), lambda i: i > fork)
        return F.flatten(F.transform(places, lambda i: tiles(text, i, *stretch(at(text, i)))))

    above = beside(low, lambda x: (x + 1, F.lit(len(_ALPHABET))))
    below = beside(high, lambda x: (F.lit(1), x - 1))
    between = tiles(low, fork, at(low, fork) + 1, at(high, fork) - 1)
    out = (
        F.when((fork >= 0) & (low > high), F.array().cast("array<string>")).when((fork >= 0) & (low == high), F.array(low))
        .when(fork >= 0, F.concat(F.array(low, high), above, between, below))
        .when(low.isNotNull(), F.concat(F.array(low), above)).when(high.isNotNull(), F.concat(F.array(high), below))
        .otherwise(F.array(F.lit("")))
    )
    return F.transform(out, lambda x: F.concat(F.lit(space), x))


def _bounds(affected: Column, has_last: bool, mode: str) -> Column:
    """The intervals of an advisory row: ``_low`` <= version < ``_high``, up to ``_last``; null is an open end."""
    none = F.lit(None).cast("string")

    def interval(low: Column, high: Column, b: Column) -> Column:
        last = b["last_affected"].cast("string") if has_last else none
        return F.struct(low.cast("string").alias("_low"), high.cast("string").alias("_high"), last.alias("_last"))

    def with_bound(name: str) -> Column:
        return F.filter(affected, lambda b: b[name].isNotNull())

    if mode == "interval":
        # zero is below every version; without any bound nothing is affected
        bounded = F.filter(affected, lambda b: b["introduced"].isNotNull() | b["fixed"].isNotNull())
        out = F.transform(bounded, lambda b: interval(F.when(b["introduced"] != "0", b["introduced"]), b["fixed"], b))
    else:
        out = F.concat(
            F.transform(with_bound("introduced"), lambda b: interval(b["introduced"], none, b)),
            F.transform(with_bound("fixed"), lambda b: interval(none, b["fixed"], b)),
        )
    return F.coalesce(out, F.array().cast("array<struct<_low:string,_high:string,_last:string>>"))


def _merged(advisories: DataFrame, mode: str) -> DataFrame:
    """One row per package and advisory, with all its intervals and listed versions and the smallest of its descriptions.

    ``_class`` is the same for advisories of a package that affect the same versions; where it is ``_own``, the row stands
    for all of them. It is a text, so that an advisory without id has one too.
    """
    has_last = "last_affected" in advisories.select(F.explode("affected").alias("b")).select("b.*").columns
    no_texts = F.array().cast("array<string>")
    listed = F.coalesce(F.col("versions"), no_texts) if "versions" in advisories.columns else no_texts
    rows = advisories.select(
        F.col("ecosystem").alias("_eco"), "name", F.col("id").alias("advisory_id"), F.struct(*_DESCRIBED).alias("_about"),
        _bounds(F.col("affected"), has_last, mode).alias("_ranges"), listed.alias("_listed"),
    )
    rows = rows.groupBy("_eco", "name", "advisory_id").agg(
        F.min("_about").alias("_about"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ranges")))).alias("_ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_listed")))).alias("_listed"),
    ).withColumn("_own", F.coalesce(F.concat(F.lit("="), "advisory_id"), F.lit("")))
    alike = Window.partitionBy("_eco", "name", "_ranges", "_listed")
    return rows.withColumn("_class", F.min("_own").over(alike))


_DESCRIBED = ("summary", "severity", "cvss_score", "fixed_version", "references", "published", "modified")
_BOUNDS = ("_eco", "name", "_low", "_high", "_last")


def _affected(versions: DataFrame, intervals: DataFrame) -> DataFrame:
    """Pairs of a version and an interval that holds it.

    Versions and intervals meet in the prefixes of their sort texts: an interval is tiled by few prefixes, a version has
    few, and a pair has one in common just if the version lies inside. So the work is the sum of both sides and the
    hits, and a package with very many versions is dealt by prefix. There are three orders, and a pair meets in one:
    ``n`` of numeric versions with bounds of which one is numeric, ``t`` of other versions with such bounds, as texts,
    and ``x`` of all versions with bounds that are all no numbers, as texts. The exact comparison decides in the end.
    """
    bytes_of = _byte_text(F.col("version"))
    version_sort = F.col("_sort")
    left = versions.withColumn("_sort", sort_text(F.col("version"))).select(
        "ecosystem", "version", "_sort", "_eco", "name", F.explode(F.concat(
            F.when(version_sort.isNotNull(), _starts(version_sort, "n")).otherwise(_starts(bytes_of, "t")), _starts(bytes_of, "x")
        )).alias("_at"),
    )
    sorts = {f"{c}_sort": sort_text(F.col(c)) for c in ("_low", "_high", "_last")}
    ends = {
        "_upper": F.coalesce("_high_sort", "_last_sort"), "_low_bytes": _byte_text(F.col("_low")),
        "_upper_bytes": _byte_text(F.coalesce("_high", "_last")),
    }
    forks = {"_fork": _fork(F.col("_low_sort"), F.col("_upper")), "_fork_bytes": _fork(F.col("_low_bytes"), F.col("_upper_bytes"))}
    texts = F.coalesce("_low", "_high", "_last")
    numeric = F.coalesce("_low_sort", "_upper").isNotNull() | texts.isNull()

    def by_text(space):
        return _cover(F.col("_low_bytes"), F.col("_upper_bytes"), F.col("_fork_bytes"), space)

    by_number = _cover(F.col("_low_sort"), F.col("_upper"), F.col("_fork"), "n")
    right = intervals.withColumns(sorts).withColumns(ends).withColumns(forks).select(
        *_BOUNDS, *sorts,
        F.explode(F.when(numeric, F.concat(by_number, by_text("t"))).otherwise(by_text("x"))).alias("_at"),
    )

    def reaches(bound):
        return _at_least(F.col("version"), F.col(bound), F.col("_sort"), F.col(f"{bound}_sort"))

    # the last affected version belongs to the interval
    holds = (F.col("_low").isNull() | reaches("_low")) & (F.col("_high").isNull() | ~reaches("_high"))
    holds = holds & (F.col("_last").isNull() | (F.col("version") == F.col("_last")) | ~reaches("_last"))
    return left.join(right, ["_eco", "name", "_at"]).where(holds).select("ecosystem", "version", *_BOUNDS)


def join_advisories(packages: DataFrame, advisories: DataFrame, mode: str = "interval", salts: int = 16) -> DataFrame:
    """Packages with the advisories that affect their version.

    Versions are matched once per distinct (ecosystem, name, version), so a package that is declared a billion times
    is compared once per version, and once with all advisories that affect the same versions. The hits then go back to
    the advisories and, in a salted join, to the declarations. ``mode='any'`` takes the
    two bounds of an interval as alternatives. Versions that an advisory lists by name are affected whatever its ranges
    say. An advisory that comes in several rows for one package counts once, with the smallest of its descriptions.
    """
    if mode not in ("interval", "any"):
        raise ValueError("mode is 'interval' or 'any'")
    declared = ["ecosystem", "name", "version"]
    versions = packages.select(*declared).where(F.col("version").isNotNull()).distinct().withColumn(
        "_eco", ecosystem_osv(F.col("ecosystem"))
    )
    merged = _merged(advisories, mode)
    classes = merged.where(F.col("_class") == F.col("_own"))
    # advisories share intervals, so versions are compared with distinct ones
    intervals = classes.select("_eco", "name", "_class", F.explode("_ranges").alias("_b")).select("_class", "_eco", "name", "_b.*")
    held, owners = _affected(versions, intervals.select(*_BOUNDS).distinct()).alias("v"), intervals.alias("i")
    pairs = held.join(owners, [F.col(f"v.{c}").eqNullSafe(F.col(f"i.{c}")) for c in _BOUNDS]).select(
        "v.ecosystem", "v._eco", "v.name", "v.version", "i._class"
    )
    listed = classes.select("_eco", "name", "_class", F.explode("_listed").alias("version"))
    pairs = pairs.unionByName(versions.join(listed, ["_eco", "name", "version"]).select(*pairs.columns))
    # several intervals of one class may hold for a version; an advisory is of one class, so its hits are distinct then
    shared = ["_eco", "name", "_class"]
    # few bytes become many rows here: with a number of its own, Spark does not put these tasks together by their bytes;
    # dealt by version, as classes are few and of any size
    hits = pairs.repartition(join_tasks(packages.sparkSession), *declared).distinct()
    found = hits.join(merged.select(*shared, "advisory_id", "_about.*"), shared).drop("_eco", "_class")
    return salted_join(packages, found, declared, ["file_path", "line_number"], salts=salts, hot_rows=HOT_ROWS)


def known_vulnerable_bounds(spark: SparkSession) -> DataFrame:
    """The built-in list of lowest safe versions, in order of checking."""
    rows = [
        (ecosystem, name, order, bound)
        for ecosystem, names in KNOWN_VULNERABLE.items() for name, bounds in names.items() for order, bound in enumerate(bounds)
    ]
    return spark.createDataFrame(rows, "ecosystem string, name string, bound_order int, bound string")


def join_known_vulnerable(packages: DataFrame, bounds: DataFrame, salts: int = 16) -> DataFrame:
    """Packages below a lowest safe version, each with the first bound it falls under."""
    versions = packages.select("ecosystem", "name", "version").distinct()
    hits = versions.join(bounds, ["ecosystem", "name"]).where(version_lt(strip_range_signs(F.col("version")), F.col("bound")))
    return salted_join(
        packages, first_bound_per_package(hits), ["ecosystem", "name", "version"], ["file_path", "line_number"], salts=salts
    )


def first_bound_per_package(hits: DataFrame) -> DataFrame:
    """Only the first bound a version falls under."""
    return hits.groupBy("ecosystem", "name", "version").agg(F.min_by("bound", "bound_order").alias("bound"))


_TITLE = "finding_title"


def _dependency_title() -> Column:
    # as text, a missing part shows as null; formatting each row costs more than joining texts
    return F.concat(F.lit("Vulnerable dependency: "), F.coalesce("name", F.lit("null")), F.lit(" "), F.coalesce("version", F.lit("null")))


def with_finding_titles(packages: DataFrame) -> DataFrame:
    """Packages with the title of their findings, which is then made per declaration and not per declaration and advisory."""
    return packages.withColumn(_TITLE, _dependency_title())


def dependency_findings(hits: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Findings of the dependency join. Titles are taken from the packages where :func:`with_finding_titles` made them."""
    level = cvss_to_severity(F.col("cvss_score"), F.col("severity"))
    repo = (F.col("repo") if "repo" in hits.columns else F.lit(None)).cast("string")
    rows = hits.select(
        finding_id(F.lit("vulnerability"), F.col("file_path"), F.col("line_number"),
                   F.concat_ws("@", "advisory_id", "name", "version"), repo).alias("id"),
        F.lit("VULNERABLE-DEPENDENCY").alias("rule_id"),
        (F.col(_TITLE) if _TITLE in hits.columns else _dependency_title()).alias("title"),
        vulnerability_description(
            F.col("name"), F.col("version"), F.col("summary"), F.col("cvss_score"), F.col("fixed_version"), F.col("references")
        ).alias("description"),
        level.alias("severity"), severity_rank(level).alias("severity_rank"), F.lit("vulnerability").alias("type"),
        F.struct(
            F.col("file_path").alias("path"), F.col("line_number").alias("line_start"),
            F.col("line_number").alias("line_end"), F.lit(0).alias("column_start"),
            F.lit(None).cast("int").alias("column_end"), F.lit(None).cast("string").alias("snippet"),
        ).alias("location"),
        F.lit("vulnerability").alias("analyzer"), F.lit(1.0).alias("confidence"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        "references",
        F.array(F.lit("dependency"), F.lit("vulnerability")).alias("tags"),
        F.create_map(
            F.lit("package_name"), F.col("name"), F.lit("package_version"), F.col("version"),
            F.lit("ecosystem"), F.col("ecosystem"), F.lit("vulnerability_id"), F.col("advisory_id"),
            F.lit("fixed_version"), F.col("fixed_version"),
        ).alias("metadata"),
        "cvss_score", repo.alias("repo"),
    )
    return with_finding_defaults(rows)


def limit_references(df: DataFrame, n: int = 3, column: str = "references") -> DataFrame:
    return df.withColumn(column, F.slice(column, 1, n))


def sbom_components(packages: DataFrame) -> DataFrame:
    """Distinct packages as bill-of-materials components."""
    return distinct_packages(packages).select(
        F.lit("library").alias("type"), "name", "version", "ecosystem",
        purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"), F.lit("required").alias("scope"),
    )
