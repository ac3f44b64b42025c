"""URL filters with a history: every capture is judged by the list entries in force when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_PORT = r":[0-9]*$"
FAR_FUTURE = "9999-12-31"


def url_host(url: Column) -> Column:
    """Lower-case host without user, port, a last dot and a leading ``www.``; null where there is none."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), _PORT, "")
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"\.+$", ""), r"^www\.", "")
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    """Path without query and fragment, ``/`` where there is none."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def candidate_keys(host: str, path: str) -> Column:
    """Keys an entry may have to cover a URL: the host, the domains above it, and the host with each first folders of
    the path. Given as column names; their number follows the URL, not the list."""
    labels = f"split({host}, '[.]')"
    domains = f"transform(sequence(1, size({labels})), i -> array_join(slice({labels}, i, size({labels})), '.'))"
    folders = f"filter(split({path}, '/'), x -> x <> '')"
    prefixes = f"transform({folders}, (x, i) -> concat({host}, '/', array_join(slice({folders}, 1, i + 1), '/')))"
    return F.expr(f"array_distinct(concat({domains}, if(size({folders}) = 0, array(), {prefixes})))")


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (list, key, verdict, dated) as intervals: list, key, verdict, valid_from, valid_to (exclusive).

    An entry holds until the next one of the same list and key; verdict ``remove`` ends it and holds for nothing itself.
    Of entries of one list, key and moment the alphabetically last verdict counts (allow, block, remove), and repeated
    entries count once. Entries with a null in any column are left out.
    """
    clean = entries.select("list", "key", "verdict", "dated").dropna().groupBy("list", "key", "dated").agg(F.max("verdict").alias("verdict"))
    after = F.lead("dated").over(Window.partitionBy("list", "key").orderBy("dated"))
    spans = clean.withColumn("valid_to", F.coalesce(after, F.lit(FAR_FUTURE).cast("timestamp"))).where("verdict <> 'remove'")
    return spans.select("list", "key", "verdict", F.col("dated").alias("valid_from"), "valid_to")


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The verdict on every capture: capture_id, url, fetched_at, host, verdict, list, key, valid_from, n_active.

    As-of join: an entry counts if it covers the URL and ``valid_from <= fetched_at < valid_to``. The longest key
    decides; of equal keys ``block`` beats ``allow``, then the newer entry, then the last list by name. Without an
    active entry the verdict is ``none`` and list, key and valid_from are null; so it is for null or empty URLs and
    null times. Rows that repeat a capture_id and URL and time are one capture. An empty table gives no rows, an empty
    list ``none`` for all.

    Captures and intervals meet by key and month, so that a key with a long history meets each capture only with what
    was in force that month. Only number, URL and time travel; a host with a third of all captures is met by a join whose
    large partitions Spark splits.
    """
    month = lambda c: F.trunc(c, "MM")
    spans = validity(entries)
    seen = captures.select("capture_id", F.col("url").cast("string").alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at")).distinct()
    seen = seen.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    asked = seen.where("host is not null and fetched_at is not null").select(
        "capture_id", "url", "fetched_at", F.explode(candidate_keys("host", "path")).alias("key"), month("fetched_at").alias("month")
    )
    last = captures.agg(F.max("fetched_at").cast("timestamp").alias("m")).first()["m"]
    until = F.least(F.col("valid_to"), F.coalesce(F.lit(last), F.col("valid_from")))
    months = F.when(until >= F.col("valid_from"), F.sequence(month("valid_from"), month(until), F.expr("interval 1 month")))
    held = spans.select("*", F.explode(months).alias("month"))
    met = asked.join(held, ["key", "month"]).where("valid_from <= fetched_at and fetched_at < valid_to")
    force = F.struct(F.length("key").alias("n"), (F.col("verdict") == "block").alias("b"), "valid_from", "list", "key", "verdict")
    best = met.groupBy("capture_id", "url", "fetched_at").agg(F.max(force).alias("best"), F.count("*").alias("n_active"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("capture_id", "url", "fetched_at")]
    out = seen.alias("s").join(best.alias("b"), same[0] & same[1] & same[2], "left")
    return out.select(
        "s.capture_id", "s.url", "s.fetched_at", "s.host", F.coalesce("b.best.verdict", F.lit("none")).alias("verdict"),
        F.col("b.best.list").alias("list"), F.col("b.best.key").alias("key"), F.col("b.best.valid_from").alias("valid_from"),
        F.coalesce("b.n_active", F.lit(0)).cast("long").alias("n_active"),
    )
