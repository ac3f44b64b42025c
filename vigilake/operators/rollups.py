"""Counts and summaries over files, findings and caches. All are partial aggregates, so a hot key costs no task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.scalars import issue_label
from vigilake.rules.model import SEVERITIES
from vigilake.session import cut_lineage

PATH = "location.path"


def _ext(path: Column) -> Column:
    suffix = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+?(\.[^.]*)$", 1)
    return F.lower(F.when(suffix == ".", "").otherwise(suffix))


def extension_stats(files: DataFrame, ext: str = "ext") -> DataFrame:
    """Files per suffix."""
    return files.groupBy(F.lower(ext).alias("ext")).agg(F.count("*").alias("n_files"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity, with zero for levels that do not occur."""
    counted = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counted.select(F.explode(F.create_map(*[x for s in SEVERITIES for x in (F.lit(s), F.col(s))])).alias("severity", "n"))


def type_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").alias("n"))


def analyzer_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("analyzer").agg(F.count("*").alias("n"))


def counts_grouping_sets(findings: DataFrame) -> DataFrame:
    """Counts by severity, by type, by analyzer and in total, in one pass."""
    return findings.groupingSets([["severity"], ["type"], ["analyzer"], []], "severity", "type", "analyzer").agg(
        F.count("*").alias("n")
    )


def tag_set(findings: DataFrame) -> DataFrame:
    """Distinct tags, one row each."""
    return findings.select(F.explode("tags").alias("tag")).distinct()


def top_extensions(findings: DataFrame, n: int = 5) -> DataFrame:
    """Suffixes with most findings."""
    counts = findings.groupBy(_ext(F.col(PATH)).alias("ext")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "ext").limit(n)


def top_types(findings: DataFrame, n: int = 2) -> DataFrame:
    counts = type_counts(findings).orderBy(F.desc("n"), "type").limit(n)
    return counts.select("type", issue_label(F.col("type")).alias("label"), "n")


def _repo(findings: DataFrame) -> list[str]:
    """Equal paths of different repositories are different files."""
    return ["repo"] if "repo" in findings.columns else []


def top_files(findings: DataFrame, n: int = 2) -> DataFrame:
    """Files with most findings."""
    counts = findings.groupBy(*_repo(findings), F.col(PATH).alias("path")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), *_repo(findings), "path").limit(n)


def findings_per_file(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings, files and their ratio, null without files."""
    n_files = files.agg(F.count("*").alias("n_files"))
    n_findings = findings.agg(F.count("*").alias("n_findings"))
    return n_files.withColumn("n_findings", n_findings.scalar()).withColumn(
        "findings_per_file", F.try_divide(F.col("n_findings"), F.col("n_files"))
    )


def files_per_second(n_files: Column, seconds: Column) -> Column:
    return F.try_divide(n_files, seconds)


def cache_stats(joined: DataFrame, hit: str = "is_hit") -> DataFrame:
    """Hits, misses and hit rate in percent of a cache lookup."""
    hits = F.count_if(F.col(hit))
    return joined.agg(
        hits.alias("hits"), F.count_if(~F.col(hit)).alias("misses"),
        F.coalesce(F.try_divide(hits * 100.0, F.count("*")), F.lit(0.0)).alias("hit_rate"),
    )


def ancestors(path: Column) -> Column:
    """All folders above a path, the top one as an empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def directory_rollup(findings: DataFrame, path: str = PATH) -> DataFrame:
    """Findings below every folder of a repository, with depth, parent and worst severity.

    Findings are counted per file first, so a folder tree is only unfolded once per file.
    """
    repo = _repo(findings)
    per_file = findings.groupBy(*repo, F.col(path).alias("path")).agg(
        F.count("*").alias("n"), F.max("severity_rank").alias("rank")
    )
    folders = per_file.select(*repo, F.explode(ancestors(F.col("path"))).alias("dir_path"), "n", "rank")
    total = folders.groupBy(*repo, "dir_path").agg(F.sum("n").alias("issues"), F.max("rank").alias("_rank"))
    depth = F.when(F.col("dir_path") == "", 0).otherwise(F.size(F.split("dir_path", "/")))
    parent = F.when(F.col("dir_path") == "", F.lit(None)).otherwise(
        F.when(F.contains("dir_path", F.lit("/")), F.regexp_replace("dir_path", r"/[^/]*$", "")).otherwise("")
    )
    return total.select(
        *repo, "dir_path", depth.alias("depth"), parent.alias("parent"), "issues",
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("_rank") + 1).alias("worst_severity"),
    )


def findings_by_file(findings: DataFrame, root: str = "") -> DataFrame:
    """Per file, relative to a root: findings by severity and the worst one.

    The findings themselves stay rows (:func:`file_issues`): one file may hold a third of them.
    """
    prefix = root.rstrip("/") + "/" if root else ""
    path = F.col(PATH)
    relative = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    return findings.groupBy(*_repo(findings), relative.alias("path")).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES],
        F.max_by("severity", "severity_rank").alias("worst_severity"),
    )


def file_issues(findings: DataFrame, path: str, repo: str | None = None) -> DataFrame:
    """The findings of one file, of one repository if it is named."""
    found = findings.where(F.col(PATH) == path)
    return found if repo is None else found.where(F.col("repo") == repo)


def worst_severity(findings: DataFrame, by: Column | None = None, name: str = "path") -> DataFrame:
    """Most severe level per file, or per any other grouping column."""
    keys = [*_repo(findings), F.col(PATH).alias(name)] if by is None else [by.alias(name)]
    return findings.groupBy(*keys).agg(F.max_by("severity", "severity_rank").alias("worst_severity"))


def _totals(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
        F.count_if(F.col("type") == "secret").alias("secrets"),
        F.max("severity_rank").alias("worst_rank"),
    )


def risk_level(findings: DataFrame) -> DataFrame:
    """Overall risk of a scan."""
    return _totals(findings).select(
        "total", "critical", "high",
        F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") > 0, "HIGH")
        .when(F.col("total") > 10, "MEDIUM").otherwise("LOW").alias("risk_level"),
    )


# Advice of the summary.
ADVICE = {
    "severe": "Address critical/high issues first",
    "secrets": "Rotate exposed secrets",
    "many": "Consider automated CI/CD checks",
}


def recommendations(findings: DataFrame) -> DataFrame:
    """Advice that follows from the counts, in order."""
    tests = F.array_compact(F.array(
        F.when((F.col("critical") > 0) | (F.col("high") > 0), F.lit(ADVICE["severe"])),
        F.when(F.col("secrets") > 0, F.lit(ADVICE["secrets"])),
        F.when(F.col("total") > 10, F.lit(ADVICE["many"])),
    ))
    return _totals(findings).select(F.posexplode(tests).alias("ordinal", "recommendation"))


def exit_status(findings: DataFrame) -> DataFrame:
    """1 if a scan found anything critical or high."""
    return findings.agg(F.when(F.coalesce(F.max("severity_rank"), F.lit(0)) >= 2, 1).otherwise(0).alias("exit_status"))


def urgent_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` critical and high findings, each with the number that is left out."""
    urgent = findings.where(F.col("severity_rank") >= 2)
    order = [F.desc("severity_rank"), F.col(PATH), F.col("location.line_start"), F.col("rule_id"), F.col("id")]
    rest = urgent.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("remaining"))
    first = urgent.orderBy(*order).limit(n)
    return first.select(
        "id", "rule_id", "severity", F.col(PATH).alias("path"), F.col("location.line_start").alias("line_start"),
        rest.scalar().alias("remaining"),
    )


def scan_metadata(
    files: DataFrame, findings: DataFrame, *, scan_id: str, repository: str, started_at: Column, finished_at: Column,
    analyzers: Sequence[str] = (),
) -> DataFrame:
    """The summary of a scan as rows (section, key, value): counts, sizes, rates and the distinct tags.

    Rows instead of one record of maps: suffixes and tags are open-ended sets.
    """
    # seven parts read the findings, so they are found once beforehand
    findings = cut_lineage(findings.select(
        "severity", "type", "analyzer", "tags", F.struct("location.path").alias("location"),
    ))

    def section(name, df, key, value):
        return df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))

    spark = files.sparkSession
    seconds = (F.unix_micros(finished_at) - F.unix_micros(started_at)) / 1e6
    facts = spark.range(1).select(F.explode(F.create_map(
        F.lit("scan_id"), F.lit(scan_id), F.lit("repository"), F.lit(repository),
        F.lit("timestamp"), started_at.cast("string"), F.lit("duration_seconds"), seconds.cast("string"),
        F.lit("enabled_analyzers"), F.lit(",".join(sorted(analyzers))),
    )).alias("key", "value"))
    ratio = findings_per_file(files, findings).select(F.explode(F.create_map(
        F.lit("file_count"), F.col("n_files").cast("string"),
        F.lit("finding_count"), F.col("n_findings").cast("string"),
        F.lit("findings_per_file"), F.col("findings_per_file").cast("string"),
        F.lit("files_per_second"), files_per_second(F.col("n_files"), seconds).cast("string"),
    )).alias("key", "value"))
    parts = [
        section("scan", facts, "key", "value"),
        section("totals", ratio, "key", "value"),
        section("extension_stats", extension_stats(files), "ext", "n_files"),
        section("severity_counts", severity_counts(findings), "severity", "n"),
        section("type_counts", type_counts(findings), "type", "n"),
        section("analyzer_counts", analyzer_counts(findings), "analyzer", "n"),
        section("top_extensions", top_extensions(findings), "ext", "n"),
        section("tags", tag_set(findings), "tag", "tag"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
