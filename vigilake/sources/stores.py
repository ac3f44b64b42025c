"""Findings and scan caches on storage, and the text report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vigilake.functions.scalars import location_string
from vigilake.operators.findings import with_finding_defaults
from vigilake.operators.ordering import latest, number_findings
from vigilake.operators.rollups import severity_counts, type_counts
from vigilake.operators.sets import file_keys, keyed
from vigilake.schemas import CACHE, FINDINGS
from vigilake.session import cut_lineage

CACHE_VERSION = "1"


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", pretty: bool = False) -> None:
    """Write findings, one folder per severity. JSON gives one record per line, or indented records with ``pretty``."""
    if fmt == "parquet":
        # range-partitioning by severity and place keeps files few per folder and splits a severity that holds most rows
        findings.repartitionByRange("severity", "location.path", "id").write.mode(mode).partitionBy("severity").parquet(path)
    elif fmt == "json":
        options = {"pretty": "true"} if pretty else {}
        rows = findings.select(F.to_json(F.struct(*findings.columns), options).alias("value"))
        rows.write.mode(mode).text(path, lineSep="\n")
    else:
        raise ValueError("fmt is 'parquet' or 'json'")


def read_findings(spark: SparkSession, path: str, fmt: str = "parquet", column_report: bool = False) -> DataFrame:
    """Findings of a folder, with defaults for fields that are missing. ``column_report`` reads whole reports, which
    hold a list of findings each, such as those of many repositories."""
    if fmt == "parquet":
        return with_finding_defaults(spark.read.parquet(path))
    if column_report:
        inner = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in FINDINGS.fields)
        reports = spark.read.option("wholetext", True).text(path)
        rows = reports.select(F.explode(F.from_json("value", f"findings array<struct<{inner}>>")["findings"]).alias("f"))
        return with_finding_defaults(rows.select("f.*"))
    return with_finding_defaults(spark.read.schema(FINDINGS).json(path))


def write_cache(entries: DataFrame, path: str, previous: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Write a new generation of the cache: the newest entry per file and analyzer wins.

    A generation is written to a folder of its own, so the previous one can still be read while this one is built.
    """
    merged = entries if previous is None else previous.select(*entries.columns).unionByName(entries)
    newest = cache_latest(merged).withColumn("version", F.lit(CACHE_VERSION))
    newest.write.mode(mode).partitionBy("analyzer").parquet(path)


def cache_latest(entries: DataFrame) -> DataFrame:
    """The newest entry per file and analyzer; equal paths of different repositories are different files."""
    return latest(entries, [*file_keys(entries), "analyzer"], ["scanned_at"])


def read_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """Entries of a generation; none if there is no cache or it was written by another version."""
    empty = spark.createDataFrame([], CACHE)
    if path is None:
        return empty
    rows = spark.read.parquet(path)
    if "version" not in rows.columns:
        return empty
    return _cache_rows(rows.where(F.col("version") == CACHE_VERSION))


def append_cache(entries: DataFrame, root: str, generation: int) -> None:
    """Add the entries of one scan to a cache that is kept as a log; what is there already is neither read nor written.

    A generation that is written again, as by a repeated micro-batch, replaces itself. Read with :func:`read_cache_log`.
    """
    rows = _cache_rows(entries).withColumn("version", F.lit(CACHE_VERSION))
    rows.write.mode("overwrite").parquet(f"{root}/kind=log/generation={generation}")


def read_cache_log(spark: SparkSession, root: str, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """The newest entry per file and analyzer of all generations, or of those ``before`` a number; none if there is no log.

    Starts from the last finished compaction. With ``only``, entries of other files are left out before anything is
    shuffled, so a few files against a large cache cost a scan of it.
    """
    rows = _log_rows(spark, root)
    if rows is None:
        return spark.createDataFrame([], CACHE)
    if before is not None:
        rows = rows.where(F.col("generation") < before)
    # a mark per finished compaction: a handful of rows
    base = rows.where(F.col("kind") == "done").agg(F.max("generation")).first()[0]
    logs = F.col("kind") == "log"
    if base is not None:
        logs = (logs & (F.col("generation") > base)) | ((F.col("kind") == "whole") & (F.col("generation") == base))
    rows = rows.where(logs & (F.col("version") == CACHE_VERSION))
    if only is not None:
        keys = file_keys(only)
        there = keyed(only, keys).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        own = {k: F.coalesce(rows[k], F.lit("")) if k == "repo" else rows[k] for k in keys}
        rows = rows.join(there, [own[k] == F.col(f"_{k}") for k in keys], "left_semi")
    return latest(rows, ["repo", "path", "analyzer"], ["scanned_at", "generation"]).select(*CACHE.fieldNames())


def compact_cache(spark: SparkSession, root: str, upto: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Merge the generations up to a number into one, as a job of its own beside the scans; ``keep`` may drop entries, such
    as :func:`expire_cache`. Readers go by the merged one once its mark is written, so a job that fails or is run again does
    no harm. The merged generations stay until they are deleted by hand, as running scans may read them."""
    rows = _log_rows(spark, root)
    if rows is None or not rows.where((F.col("kind") == "done") & (F.col("generation") == upto)).isEmpty():
        return
    entries = read_cache_log(spark, root, before=upto + 1)
    merged = (entries if keep is None else keep(entries)).withColumn("version", F.lit(CACHE_VERSION))
    merged.write.mode("overwrite").parquet(f"{root}/kind=whole/generation={upto}")
    mark = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in CACHE.fields], F.lit(CACHE_VERSION).alias("version"))
    mark.coalesce(1).write.mode("overwrite").parquet(f"{root}/kind=done/generation={upto}")


def _cache_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CACHE.fields
    ])


def _log_rows(spark: SparkSession, root: str) -> DataFrame | None:
    schema = T.StructType([*CACHE.fields, *(T.StructField(n, t) for n, t in (
        ("version", T.StringType()), ("kind", T.StringType()), ("generation", T.LongType())
    ))])
    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def expire_cache(entries: DataFrame, current: DataFrame, as_of: Column, max_age_days: int = 30) -> DataFrame:
    """Entries of files that still exist and that are not too old. Entries without a time are dropped."""
    fresh = entries.where(
        F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("scanned_at") <= max_age_days * 86_400_000_000
    )
    keys = file_keys(entries, current)
    there = keyed(current, keys).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    own = {k: F.coalesce(fresh[k], F.lit("")) if k == "repo" else fresh[k] for k in keys}
    return fresh.join(there, [own[k] == F.col(f"_{k}") for k in keys], "left_semi")


def text_report(findings: DataFrame, title: str = "Security Report") -> DataFrame:
    """A report as rows (section, ordinal, line), most severe findings first. Sort by all three to print it."""
    spark = findings.sparkSession
    # counts and details read the findings, so they are found once beforehand
    findings = cut_lineage(findings.select(
        "id", "title", "description", "remediation", "severity", "severity_rank", "type", "location", "references", "rule_id",
    ))
    head = spark.range(1).select(F.lit(0).alias("section"), F.lit(1).cast("bigint").alias("ordinal"), F.lit(title).alias("line"))
    by_severity = severity_counts(findings).where(F.col("n") > 0).select(
        F.lit(1).alias("section"),
        F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "high", 2)
        .when(F.col("severity") == "medium", 3).otherwise(4).cast("bigint").alias("ordinal"),
        F.format_string("%s: %d", F.upper("severity"), F.col("n")).alias("line"),
    )
    by_type = type_counts(findings).select(
        F.lit(2).alias("section"), (-F.col("n")).alias("ordinal"), F.format_string("%s: %d", F.initcap("type"), F.col("n")).alias("line")
    )
    where = location_string(F.col("location.path"), F.col("location.line_start"), F.col("location.line_end"))
    details = number_findings(findings).select(
        (F.lit(6) - F.col("severity_rank")).alias("section"), F.col("ordinal"),
        F.concat_ws(
            "\n",
            F.format_string("%d. %s", F.col("ordinal"), F.col("title")),
            F.concat(F.lit("   ID: "), F.col("id")),
            F.concat(F.lit("   Type: "), F.initcap("type")),
            F.concat(F.lit("   Location: "), where),
            F.concat(F.lit("   Description: "), F.col("description")),
            F.concat(F.lit("   Remediation: "), F.nullif(F.col("remediation"), F.lit(""))),
            F.when(F.size("references") > 0, F.concat(
                F.lit("   References:\n     - "), F.array_join("references", "\n     - "))),
        ).alias("line"),
    )
    return head.unionByName(by_severity).unionByName(by_type).unionByName(details)
