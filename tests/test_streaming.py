"""Re-scans, caches and streams."""

import datetime as dt

from pyspark.sql import functions as F

from vigilake.operators.findings import as_findings
from vigilake.operators.matching import match_content
from vigilake.operators.sets import join_cache
from vigilake.rules import PACKS
from vigilake.sources.stores import append_cache, cache_latest, compact_cache, expire_cache, read_cache, read_cache_log, write_cache
from vigilake.streaming.incremental import incremental_scan, start_incremental_stream, stream_finding_counts

FILE = "path string, text string, content_hash string, mtime timestamp"
NOW = dt.datetime(2024, 6, 1)


def find_secrets(files):
    return as_findings(match_content(files, PACKS["secrets"]), PACKS["secrets"])


def rows(spark, *names, text="pwd='abcdefgh1'"):
    return spark.createDataFrame([(n, text, f"hash-{n}-{text}", NOW) for n in names], FILE)


def test_second_scan_skips_what_is_known(spark, tmp_path):
    as_of = F.lit(NOW)
    first = incremental_scan(rows(spark, "a", "b"), read_cache(spark, None), {"secrets": find_secrets}, as_of)
    write_cache(first.entries, str(tmp_path / "0"))
    known = read_cache(spark, str(tmp_path / "0"))
    assert known.count() == 2
    files = rows(spark, "a", "c").unionByName(rows(spark, "b", text="nothing now"))
    second = incremental_scan(files, known, {"secrets": find_secrets}, as_of)
    assert sorted(r.path for r in second.scanned.collect()) == ["b", "c"]
    assert [r.location.path for r in second.findings.collect()] == ["c"]
    assert sorted((r.path, r.n_findings) for r in second.entries.collect()) == [("b", 0), ("c", 1)]


def entries(spark, *items):
    data = [(p, a, h, NOW, 0, at) for p, a, h, at in items]
    return spark.createDataFrame(data, "path string, analyzer string, content_hash string, mtime timestamp, n_findings long, scanned_at timestamp")


def test_cache_hits(spark):
    cache = entries(spark, ("a", "x", "hash-a-t", NOW), ("b", "y", "hash-b-t", NOW), ("c", "x", "old", NOW))
    later = rows(spark, "a", "b", "c", "d", text="t").withColumn("mtime", F.lit(NOW + dt.timedelta(days=1)))
    got = {r.path: r.is_hit for r in join_cache(later, cache, "x").collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_cache_expiry_and_latest(spark):
    old = NOW - dt.timedelta(days=31)
    cache = entries(spark, ("kept", "x", "h", NOW), ("gone", "x", "h", NOW), ("kept", "y", "h", old), ("kept", "x", "h0", old))
    current = spark.createDataFrame([("kept",)], "path string")
    left = expire_cache(cache_latest(cache), current, F.lit(NOW))
    assert [(r.path, r.analyzer, r.content_hash) for r in left.collect()] == [("kept", "x", "h")]


def test_stream_against_growing_cache(spark, tmp_path):
    source = tmp_path / "in"
    rows(spark, "a", "b").write.parquet(str(source / "1"))
    arriving = spark.readStream.schema(FILE).option("recursiveFileLookup", "true").parquet(str(source))
    options = dict(findings_path=str(tmp_path / "f"), cache_root=str(tmp_path / "c"), checkpoint=str(tmp_path / "k"))
    start_incremental_stream(spark, arriving, {"secrets": find_secrets}, **options).awaitTermination()
    rows(spark, "a", "d").write.parquet(str(source / "2"))
    start_incremental_stream(spark, arriving, {"secrets": find_secrets}, **options).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "f"))
    assert sorted((r.batch, r.location.path) for r in found.collect()) == [(0, "a"), (0, "b"), (1, "d")]
    assert sorted(r.path for r in read_cache_log(spark, str(tmp_path / "c")).collect()) == ["a", "b", "d"]
    # a micro-batch writes its own entries only
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "c" / "kind=log" / "generation=1")).collect()) == ["d"]


def test_cache_as_a_log(spark, tmp_path):
    root, later = str(tmp_path / "c"), NOW + dt.timedelta(days=1)
    assert read_cache_log(spark, root).count() == 0

    def state(**options):
        return sorted((r.repo or "", r.path, r.analyzer, r.content_hash) for r in read_cache_log(spark, root, **options).collect())

    append_cache(entries(spark, ("a", "x", "h0", NOW), ("b", "x", "h0", NOW)).withColumn("repo", F.lit("r1")), root, 0)
    append_cache(entries(spark, ("a", "x", "lost", later)).withColumn("repo", F.lit("r1")), root, 1)
    append_cache(entries(spark, ("a", "x", "h1", later)).withColumn("repo", F.lit("r1")), root, 1)  # run again
    append_cache(entries(spark, ("a", "x", "h2", later), ("a", "y", "h2", later)), root, 2)  # no repository
    first = [("r1", "a", "x", "h1"), ("r1", "b", "x", "h0")]
    whole = [("", "a", "x", "h2"), ("", "a", "y", "h2"), *first]
    assert state(before=0) == [] and state(before=2) == first and state() == whole
    one = spark.createDataFrame([("r1", "b"), ("r2", "a")], "repo string, path string")
    assert state(only=one) == [("r1", "b", "x", "h0")]
    # a merge that was not finished is not read
    entries(spark, ("half", "x", "h", NOW)).write.parquet(f"{root}/kind=whole/generation=1")
    assert state() == whole
    compact_cache(spark, root, 1)
    compact_cache(spark, root, 1)
    assert state() == whole and state(before=2) == first and state(before=1) == [("r1", "a", "x", "h0"), ("r1", "b", "x", "h0")]
    read = {r._metadata.file_path.split("/c/")[1].rsplit("/", 1)[0] for r in spark.read.parquet(root).where("kind = 'whole'").select("_metadata").collect()}
    assert read == {"kind=whole/generation=1"}
    compact_cache(spark, root, 2, keep=lambda rows: rows.where("path = 'a'"))
    assert state() == [r for r in whole if r[1] == "a"]


def test_equal_times_go_by_generation(spark, tmp_path):
    for number, seen in enumerate(["h9", "h1"]):
        append_cache(entries(spark, ("a", "x", seen, NOW)), str(tmp_path / "c"), number)
    assert [r.content_hash for r in read_cache_log(spark, str(tmp_path / "c")).collect()] == ["h1"]


def test_files_of_the_known_time_are_not_hashed(spark):
    hashed = F.udf(lambda path, text: 1 / 0 if path == "same" else f"hash-{path}-{text}")
    cache = entries(spark, *((p, "secrets", f"hash-{p}-pwd='abcdefgh1'", NOW) for p in ("same", "touched", "edited")))
    files = rows(spark, "same", "touched", "edited", "new").drop("content_hash").withColumns({
        "mtime": F.when(F.col("path") == "same", F.lit(NOW)).when(F.col("path") != "new", F.lit(NOW + dt.timedelta(days=1))),
        "text": F.when(F.col("path") == "edited", F.lit("changed")).otherwise(F.col("text")),
    })
    result = incremental_scan(files, cache, {"secrets": find_secrets}, F.lit(NOW), hash_of=lambda f: f.withColumn("content_hash", hashed("path", "text")))
    assert sorted(r.path for r in result.scanned.collect()) == ["edited", "new"]
    assert sorted((r.path, r.content_hash, r.n_findings) for r in result.entries.collect()) == [("edited", "hash-edited-changed", 0), ("new", "hash-new-pwd='abcdefgh1'", 1)]


def test_counts_per_window(spark):
    data = [(NOW + dt.timedelta(minutes=m), s) for m, s in [(1, "high"), (2, "high"), (70, "low")]]
    got = stream_finding_counts(spark.createDataFrame(data, "created_at timestamp, severity string")).collect()
    assert sorted((r.window_start.hour, r.severity, r.n) for r in got) == [(0, "high", 2), (1, "low", 1)]
