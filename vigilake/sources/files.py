"""File rows: from folders and from tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilake.functions.scalars import normalize_path


def path_columns(path: Column) -> dict[str, Column]:
    """Name, stem, lower-case suffix, depth and hidden flag of a path."""
    clean = normalize_path(path)
    name = F.element_at(F.split(clean, "/"), -1)
    # a leading dot starts a hidden name, not a suffix
    suffix = F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1)
    suffix = F.when(suffix == ".", "").otherwise(suffix)
    return {
        "name": name,
        "stem": F.substring(name, F.lit(1), F.length(name) - F.length(suffix)),
        "ext": F.lower(suffix),
        "depth": F.size(F.split(clean, "/")) - 1,
        "is_hidden": F.rlike(clean, F.lit(r"(^|/)\.[^/]")),
    }


def path_attributes(df: DataFrame, path: str = "path") -> DataFrame:
    """Add the parts of a path as columns."""
    return df.withColumns({path: normalize_path(F.col(path))}).withColumns(path_columns(F.col(path)))


def scan_files(
    spark: SparkSession, root: str, *, max_depth: int | None = None, include_hidden: bool = False, glob: str | None = None
) -> DataFrame:
    """Files below a folder as rows, with paths relative to it.

    Listing and reading are done by Spark; ``content`` is only read if a later step uses it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = re.sub(r"^file:/+", "/", root.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"^.*?\Q" + base + r"\E/", "")
    files = reader.load(root).select(
        F.lit(base.rsplit("/", 1)[-1]).alias("repo"), relative.alias("path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content",
    )
    files = path_attributes(files)
    if not include_hidden:
        files = files.where(~F.col("is_hidden"))
    if max_depth is not None:
        files = files.where(F.col("depth") < max_depth)
    return files


def files_from_table(
    df: DataFrame, *, path: Column, text: Column, repo: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Bind any table of texts as file rows, so that a corpus is scanned like a source tree."""
    rows = df.select(
        (F.lit(None).cast("string") if repo is None else repo.cast("string")).alias("repo"),
        path.cast("string").alias("path"), text.alias("text"), *keep,
    )
    return path_attributes(rows).withColumn("size", F.octet_length("text").cast("bigint"))


def decode_text(
    files: DataFrame, content: str = "content", max_bytes: int | None = None, errors: str = "replace"
) -> DataFrame:
    """Text of file contents, of any size. Invalid bytes are replaced or left out.

    With ``max_bytes`` the text of larger files is null; their rows stay.
    """
    text = F.make_valid_utf8(F.col(content).cast("string"))
    if max_bytes is not None:
        text = F.when(F.octet_length(content) <= max_bytes, text)
    if errors == "ignore":
        text = F.replace(text, F.lit("�"), F.lit(""))
    return files.withColumn("text", text)


def content_hash(files: DataFrame, algorithm: str = "sha256", column: str = "content", strict: bool = True) -> DataFrame:
    """Hex digest of contents. An unknown algorithm gives null, or sha256 if not ``strict``."""
    value = F.col(column).cast("binary")
    digests = {
        "md5": F.md5(value), "sha1": F.sha1(value), "sha256": F.sha2(value, 256), "sha512": F.sha2(value, 512),
    }
    fallback = F.lit(None).cast("string") if strict else digests["sha256"]
    return files.withColumn("content_hash", digests.get(algorithm, fallback))
