"""Scans that only look at what is new, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilake.operators.sets import cache_misses, file_keys
from vigilake.session import cut_lineage
from vigilake.sources.stores import append_cache, compact_cache, read_cache_log

Scan = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class IncrementalResult:
    """What an incremental scan looked at, found, and remembers."""

    scanned: DataFrame
    findings: DataFrame
    entries: DataFrame


def incremental_scan(
    files: DataFrame, cache: DataFrame, analyzers: dict[str, Scan], as_of: Column, hold: Callable[[DataFrame], DataFrame] | None = None,
    hash_of: Callable[[DataFrame], DataFrame] | None = None,
) -> IncrementalResult:
    """Run each analyzer on the files whose content it has not seen, and give the cache entries for them.

    Files, findings and entries are told apart by repository and path where files have a repository; analyzers carry it on
    to their findings. A file without findings gets an entry too, so it is not scanned again. The counts of the entries need the findings a
    second time; with ``hold`` (such as ``cut_lineage``, which writes them) they are computed once.
    With ``hash_of`` the files need no hash yet: those with the time of their entry are unchanged, the others are hashed.
    """
    scanned, found, entries = [], [], []
    keys = file_keys(files)
    for name, run in analyzers.items():
        new = cache_misses(files, cache, name, hash_of)
        findings = run(new) if hold is None else hold(run(new))
        counts = findings.groupBy(*[F.coalesce("repo", F.lit("")).alias("_repo") for k in keys if k == "repo"], F.col("location.path").alias("_path")).agg(F.count("*").alias("n_findings"))
        met = [(F.coalesce(new[k], F.lit("")) if k == "repo" else new[k]) == F.col(f"_{k}") for k in keys]
        scanned.append(new.select(*keys, "content_hash", F.lit(name).alias("analyzer")))
        found.append(findings)
        entries.append(
            new.select(*keys, "content_hash", "mtime").join(counts, met, "left").select(
                *keys, F.lit(name).alias("analyzer"), "content_hash", "mtime",
                F.coalesce("n_findings", F.lit(0)).cast("bigint").alias("n_findings"), as_of.alias("scanned_at"),
            )
        )

    def union(parts):
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return IncrementalResult(union(scanned), union(found), union(entries))


def stream_new_files(
    files: DataFrame, scan: Scan, *, event_time: str = "mtime", delay: str = "1 hour", dedupe_by: Sequence[str] = ("content_hash",)
) -> DataFrame:
    """Findings of arriving files, each content once within the watermark. The packs keep no state of their own."""
    once = files.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(dedupe_by))
    return scan(once)


def stream_finding_counts(
    findings: DataFrame, *, event_time: str = "created_at", window: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Findings per severity and tumbling window. Works on streams and on tables."""
    source = findings.withWatermark(event_time, delay) if findings.isStreaming else findings
    return source.groupBy(F.window(event_time, window), "severity").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), "severity", "n"
    )


def start_finding_counts(
    findings: DataFrame, path: str, checkpoint: str, *, event_time: str = "created_at", window: str = "1 hour", delay: str = "1 hour"
) -> StreamingQuery:
    """Write the counts that a micro-batch changed to a folder of its number; windows behind the watermark leave the state.

    A batch that is run again replaces its folder. Read the result with :func:`read_finding_counts`.
    """

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts = stream_finding_counts(findings, event_time=event_time, window=window, delay=delay)
    return counts.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_finding_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every window and severity."""
    rows = spark.read.schema("window_start timestamp, severity string, n bigint, batch bigint").parquet(path)
    return rows.groupBy("window_start", "severity").agg(F.max_by("n", "batch").alias("n"))


def start_incremental_stream(
    spark: SparkSession, arriving: DataFrame, analyzers: dict[str, Scan], *, findings_path: str, cache_root: str,
    checkpoint: str, available_now: bool = True, compact_every: int | None = None,
) -> StreamingQuery:
    """Scan arriving files against a cache that grows with each micro-batch.

    The cache is a log to which every micro-batch adds its own entries only, under its number; of the older ones it
    shuffles those of its files. A batch that is run again after a failure replaces its own output and reads the cache as
    of the batch before, so results are exactly once. With ``compact_every`` the log is merged after so many batches.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        batch.persist()
        previous = read_cache_log(spark, cache_root, before=number, only=batch)
        result = incremental_scan(batch, previous, analyzers, F.current_timestamp(), hold=cut_lineage)
        result.findings.write.mode("overwrite").parquet(f"{findings_path}/batch={number}")
        append_cache(result.entries, cache_root, number)
        if compact_every and number % compact_every == compact_every - 1:
            compact_cache(spark, cache_root, number)
        batch.unpersist()

    writer = arriving.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
