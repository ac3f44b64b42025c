"""Checks on exported commit histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilake.functions.scalars import days_inactive, is_night
from vigilake.operators.matching import match_content
from vigilake.rules import secrets as S


def recent_commits(commits: DataFrame, n: int = 100, by: tuple[str, ...] = ("repo",)) -> DataFrame:
    """The newest ``n`` commits per repository. Every task keeps its own best ``n`` before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("committed_at"), F.desc("sha"))
    return commits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def commit_message_secrets(commits: DataFrame, keys: tuple[str, ...] = ("repo", "sha"), message: str = "message") -> DataFrame:
    """Every ``name=value`` pair in commit messages that looks like a secret."""
    return match_content(commits, S.COMMIT_MESSAGES, keys=keys, text=message)


def night_commits(commits: DataFrame, start: int = S.NIGHT_START, end: int = S.NIGHT_END) -> DataFrame:
    return commits.where(is_night(F.col("committed_at"), start, end))


def large_commits(commits: DataFrame, commit_files: DataFrame, threshold: int = S.LARGE_COMMIT_FILES) -> DataFrame:
    """Commits with a parent that touch more than ``threshold`` files. Only the few large ones take part in the join."""
    counts = commit_files.groupBy("repo", "sha").agg(F.count("*").alias("files_changed")).where(F.col("files_changed") > threshold)
    return commits.where(F.col("n_parents") > 0).join(counts, ["repo", "sha"])


def large_binaries(commits: DataFrame, commit_files: DataFrame, threshold: int = S.LARGE_BINARY_BYTES) -> DataFrame:
    """Changed files above a size, in commits with a parent; deleted files do not count."""
    big = commit_files.where(~F.col("deleted") & (F.col("size") > threshold))
    parented = commits.where(F.col("n_parents") > 0).select("repo", "sha")
    return big.join(parented, ["repo", "sha"], "left_semi")


def contributor_counts(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo", "author").agg(F.count("*").alias("n_commits"))


def one_time_contributors(commits: DataFrame) -> DataFrame:
    """Authors with exactly one commit, with that commit. One row each: a list could hold millions."""
    return (
        commits.groupBy("repo", "author")
        .agg(F.count("*").alias("n_commits"), F.max("sha").alias("sha"))
        .where(F.col("n_commits") == 1)
        .select("repo", "author", "sha")
    )


def one_time_commits(commits: DataFrame) -> DataFrame:
    """Commits of authors with exactly one commit. A group of one is its own commit, so no join back is needed."""
    others = [c for c in commits.columns if c not in ("repo", "author")]
    return (
        commits.groupBy("repo", "author")
        .agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others])
        .where(F.col("_n") == 1)
        .select(*commits.columns)
    )


def suspicious_branches(branches: DataFrame, words: tuple[str, ...] = S.SUSPICIOUS_BRANCH_WORDS, name: str = "name") -> DataFrame:
    """Branches whose name holds a suspicious word."""
    return branches.where(F.rlike(F.lower(name), F.lit("|".join(words))))


def suspicious_branch_counts(branches: DataFrame, words: tuple[str, ...] = S.SUSPICIOUS_BRANCH_WORDS) -> DataFrame:
    """Suspicious and all branches per repository."""
    return branches.groupBy("repo").agg(
        F.count_if(F.rlike(F.lower("name"), F.lit("|".join(words)))).alias("n_suspicious"), F.count("*").alias("total_branches")
    )


def latest_per_branch(commits: DataFrame, by: tuple[str, ...] = ("repo", "branch")) -> DataFrame:
    """The newest commit of every branch, by a partial maximum instead of a sort."""
    return commits.groupBy(*by).agg(F.max(F.struct("committed_at", "sha")).alias("_m")).select(
        *by, F.col("_m.committed_at").alias("committed_at"), F.col("_m.sha").alias("sha")
    )


def stale_branches(branches: DataFrame, as_of: Column, days: int = S.STALE_DAYS) -> DataFrame:
    """Branches without a commit for more than ``days`` days, with the whole days since the last one."""
    last = branches.groupBy("repo", "name").agg(F.max("last_commit_at").alias("last_commit"))
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_commit").cast("timestamp"))
    return last.where(age > days * 86_400_000_000).withColumn("days_inactive", days_inactive(F.col("last_commit"), as_of))


def repo_marker(files: DataFrame, path: str = "path") -> DataFrame:
    """Which repositories hold a ``.git`` folder."""
    return files.groupBy("repo").agg(F.bool_or(F.rlike(F.col(path), F.lit(r"(^|/)\.git/"))).alias("is_git"))
