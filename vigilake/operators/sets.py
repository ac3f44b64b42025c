"""Unions, deduplication and differences of findings, and joins with rules and caches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F


def union_findings(*parts: DataFrame) -> DataFrame:
    """All findings of all parts; nothing is dropped."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def file_keys(*tables: DataFrame) -> list[str]:
    """What tells files apart: the path, and the repository where all tables have one."""
    return ["repo", "path"] if all("repo" in t.columns for t in tables) else ["path"]


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files without a repository compare as equal in it: null becomes the empty text."""
    return df.withColumn("repo", F.coalesce("repo", F.lit(""))) if "repo" in keys else df


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per rule and place. Rows that agree in place are told apart by id, so the result is the same in every run."""
    place = ["rule_id", "location.path", "location.line_start", "location.column_start"]
    place += [c for c in ("repo",) if c in findings.columns]
    # without a column the text tells matches of one line apart
    matched = F.when(F.col("location.column_start").isNull(), F.try_element_at("metadata", F.lit("matched_text")))
    rest = [c for c in findings.columns if c not in ("rule_id", "id", "metadata")]
    picked = findings.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(place)], matched.alias("_kt")).agg(
        F.min_by(F.struct(*findings.columns), F.struct("id", F.to_json(F.struct(*rest)))).alias("_f")
    )
    return picked.select("_f.*")


def diff_scans(old: DataFrame, new: DataFrame, key: str = "id", carry: Sequence[str] = ("rule_id", "severity")) -> DataFrame:
    """New, fixed and unchanged findings between two scans."""
    a = old.groupBy(key).agg(*[F.min(c).alias(f"_old_{c}") for c in carry], F.lit(True).alias("_in_old"))
    b = new.groupBy(key).agg(*[F.min(c).alias(f"_new_{c}") for c in carry], F.lit(True).alias("_in_new"))
    status = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "fixed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(
        key, *[F.coalesce(f"_new_{c}", f"_old_{c}").alias(c) for c in carry], status.alias("status")
    )


def enrich_findings(findings: DataFrame, rules: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Fill title, weakness and advice from the rule table; rules that are unknown get the defaults."""
    columns = ("title", "cwe_id", "remediation")
    right = rules.select("rule_id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = findings.join(right, "rule_id", "left")
    defaults = defaults or {"remediation": "Review the place and confirm that the behaviour is intended."}
    out = {}
    for c in columns:
        own = F.col(c) if c in findings.columns else F.lit(None).cast("string")
        out[c] = F.coalesce(own, F.col(f"_{c}"), F.lit(defaults.get(c)))
    return joined.withColumns(out).drop(*[f"_{c}" for c in columns])


def join_files_rules(
    files: DataFrame, rules: DataFrame, *, language: str = "language", keys: Sequence[str] = ("path",), text: str = "text",
    salts: int = 16,
) -> DataFrame:
    """Texts with the user rules of their language that match them.

    An equi join on the language with the expression as extra condition. For rules that come as a table at run time
    only: the built-in packs use literal expressions, which are compiled once. Spark broadcasts the rules if their
    size allows; the salt keeps a language with most texts in many tasks if it does not.
    """
    salt = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(salts)).cast("int")
    left = files.select(*keys, F.col(language), F.col(text).alias("_text"), salt.alias("_salt"))
    right = rules.select("rule_id", F.col(language), F.col("pattern").alias("_p")).withColumn(
        "_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    )
    hits = left.join(right, [language, "_salt"]).where(F.rlike(F.col("_text"), F.col("_p")))
    return hits.select(*keys, language, "rule_id", F.regexp_count("_text", F.col("_p")).alias("n_matches"))


def join_cache(files: DataFrame, cache: DataFrame, analyzer: str) -> DataFrame:
    """Files with ``is_hit``: known to the analyzer, and unchanged by time or else by content."""
    keys = file_keys(files, cache)
    known = keyed(cache, keys).where(F.col("analyzer") == analyzer).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("mtime").alias("_mtime"), F.col("content_hash").alias("_hash"), F.lit(True).alias("_known")
    )
    hit = F.col("_known").isNotNull() & (
        (F.col("mtime") == F.col("_mtime")) | (F.col("content_hash") == F.col("_hash"))
    )
    own = {"repo": F.coalesce(files["repo"], F.lit("")) if "repo" in keys else None, "path": files["path"]}
    on = [own[k] == F.col(f"_{k}") for k in keys]
    return files.join(known, on, "left").withColumn("is_hit", F.coalesce(hit, F.lit(False))).drop(
        "_mtime", "_hash", "_known", *[f"_{k}" for k in keys]
    )


def cache_misses(files: DataFrame, cache: DataFrame, analyzer: str, hash_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Files whose content the analyzer has not seen.

    With ``hash_of``, which adds ``content_hash``, a file that has the time of its entry is taken as unchanged, and only
    the others are hashed.
    """
    keys = file_keys(files, cache)
    known = keyed(cache, keys).where(F.col("analyzer") == analyzer)

    def unknown(rows, by):
        seen = known.select(*[F.col(k).alias(f"_{k}") for k in (*keys, by)])
        own = {k: F.coalesce(rows[k], F.lit("")) if k == "repo" else rows[k] for k in (*keys, by)}
        return rows.join(seen, [own[k] == F.col(f"_{k}") for k in (*keys, by)], "left_anti")

    return unknown(files if hash_of is None else hash_of(unknown(files, "mtime")), "content_hash")
