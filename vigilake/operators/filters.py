"""Filters over files and findings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.scalars import glob_to_regex, lookup, severity_rank
from vigilake.rules.model import SEVERITIES
from vigilake.rules.prompts import DOCUMENTATION_FILES, DOCUMENTATION_WORDS, PROMPT_EXTENSIONS, PROMPT_FILE_NAMES
from vigilake.rules.secrets import SENSITIVITY_KINDS
from vigilake.session import any_of


@dataclass(frozen=True)
class ScanConfig:
    """What a scan looks at and what it reports."""

    include: Sequence[str] = ("*",)
    exclude: Sequence[str] = ()
    max_depth: int | None = None
    include_hidden: bool = False
    min_severity: str = "low"
    min_confidence: float = 0.0
    analyzer_confidence: dict[str, float] = field(default_factory=dict)
    allow_findings: Sequence[str] = ()
    allow_files: Sequence[str] = ()
    allow_directories: Sequence[str] = ()
    allow_patterns: Sequence[str] = ()
    disabled_analyzers: Sequence[str] = ()
    sensitivity: str = "normal"


def filter_hidden(files: DataFrame, path: str = "path") -> DataFrame:
    """Drop rows with a hidden component in their path."""
    return files.where(~F.rlike(F.col(path), F.lit(r"(^|/)\.[^/]")))


def filter_depth(files: DataFrame, max_depth: int, path: str = "path") -> DataFrame:
    """Keep files whose folder lies less than ``max_depth`` levels down."""
    return files.where(F.size(F.split(F.col(path), "/")) - 1 < max_depth)


def glob_test(path: Column, globs: Iterable[str]) -> Column:
    globs = list(globs)
    return any_of([F.rlike(path, F.lit(glob_to_regex(g))) for g in globs]) if globs else F.lit(False)


def filter_globs(files: DataFrame, include: Sequence[str] = ("*",), exclude: Sequence[str] = (), path: str = "path") -> DataFrame:
    """Keep paths that match an include glob and no exclude glob."""
    kept = files if "*" in include else files.where(glob_test(F.col(path), include))
    return kept.where(~glob_test(F.col(path), exclude)) if exclude else kept


def union_includes(files: DataFrame, include: Sequence[str], path: str = "path", dedupe: bool = True) -> DataFrame:
    """Paths that match an include glob; without ``dedupe`` once per glob they match."""
    if dedupe or "*" in include:
        return filter_globs(files, include, (), path)
    hits = F.array_compact(F.array(*[
        F.when(F.rlike(F.col(path), F.lit(glob_to_regex(g))), F.lit(i)) for i, g in enumerate(include)
    ]))
    return files.withColumn("_hit", F.explode(hits)).drop("_hit")


def except_excludes(files: DataFrame, exclude: Sequence[str], path: str = "path") -> DataFrame:
    return files.where(~glob_test(F.col(path), exclude))


def filter_allowlist_paths(
    files: DataFrame, exact: Sequence[str] = (), directories: Sequence[str] = (), patterns: Sequence[str] = (),
    path: str = "path",
) -> DataFrame:
    """Drop listed files, files below listed folders and paths that hold a listed text."""
    column = F.col(path)
    tests = [column.isin(*exact)] if exact else []
    tests += [column.startswith(d) for d in directories] + [column.contains(p) for p in patterns]
    return files.where(~any_of(tests)) if tests else files


def filter_severity(findings: DataFrame, minimum: str) -> DataFrame:
    """Keep findings at or above a level; an unknown level means low."""
    level = minimum.lower()
    return findings.where(F.col("severity_rank") >= (SEVERITIES.index(level) if level in SEVERITIES else 0))


def filter_confidence(findings: DataFrame, minimum: float = 0.0, by_analyzer: dict[str, float] | None = None) -> DataFrame:
    """Keep findings at or above a confidence, which may differ by analyzer."""
    bound = F.lit(float(minimum))
    if by_analyzer:
        bound = F.coalesce(lookup(F.col("analyzer"), {k: float(v) for k, v in by_analyzer.items()}), bound)
    return findings.where(F.col("confidence") >= bound)


def anti_allowlist(findings: DataFrame, allowed: DataFrame, column: str = "id") -> DataFrame:
    """Drop findings whose id is on a list. Spark broadcasts the list if its size allows."""
    return findings.join(allowed.select(column).distinct(), column, "left_anti")


def filter_findings(findings: DataFrame, config: ScanConfig, allowed: DataFrame | None = None) -> DataFrame:
    """Allowed ids first, then severity, then confidence."""
    if config.allow_findings:
        findings = findings.where(~F.col("id").isin(*config.allow_findings))
    if allowed is not None:
        findings = anti_allowlist(findings, allowed)
    findings = filter_severity(findings, config.min_severity)
    return filter_confidence(findings, config.min_confidence, config.analyzer_confidence)


def filter_sensitivity(findings: DataFrame, level: str, kind: str = "kind") -> DataFrame:
    """Keep the finding kinds a sensitivity level admits; an unknown level means normal."""
    return findings.where(F.col(kind).isin(*SENSITIVITY_KINDS.get(level, SENSITIVITY_KINDS["normal"])))


def enabled_analyzers(analyzers: DataFrame, disabled: DataFrame, column: str = "analyzer") -> DataFrame:
    return analyzers.select(column).distinct().join(disabled.select(column), column, "left_anti")


def file_role(name: Column, ext: Column, text: Column | None = None) -> Column:
    """What a file is by its name: all roles that apply, as an array."""
    low = F.lower(name)
    yaml = low.endswith(".yml") | low.endswith(".yaml")
    words = any_of([low.contains(w) for w in DOCUMENTATION_WORDS])
    roles = {
        "dockerfile": low.contains("dockerfile") | low.endswith(".docker"),
        "compose": low.contains("compose") & yaml,
        "package_json": low == "package.json",
        "requirements": low == "requirements.txt",
        "yaml": yaml,
        "toml": F.lower(ext) == ".toml",
        "documentation": low.isin(*DOCUMENTATION_FILES) | words,
        "prompt_text": low.isin(*PROMPT_FILE_NAMES) | F.lower(ext).isin(*PROMPT_EXTENSIONS),
    }
    if text is not None:
        marks = any_of([text.contains(m) for m in ("apiVersion:", "kind:", "metadata:", "spec:")])
        roles["kubernetes"] = (yaml | low.endswith(".json")) & marks
    return F.array_compact(F.array(*[F.when(test, F.lit(role)) for role, test in roles.items()]))


def dispatch_by_name(files: DataFrame, name: str = "name", ext: str = "ext", text: str | None = None) -> DataFrame:
    """Add the roles of every file."""
    return files.withColumn("roles", file_role(F.col(name), F.col(ext), F.col(text) if text else None))


def _analyzers_of(ext: Column, extensions: dict[str, Sequence[str]]) -> Column:
    wildcard = [a for a, exts in extensions.items() if "*" in exts]
    by_ext: dict[str, list[str]] = {}
    for analyzer, exts in extensions.items():
        for e in exts:
            if e != "*" and "*" not in exts:
                by_ext.setdefault(e.lower(), []).append(analyzer)
    every = F.array(*[F.lit(a) for a in wildcard]).cast("array<string>")
    if not by_ext:
        return every
    table = F.create_map(*[
        x for e, names in by_ext.items() for x in (F.lit(e), F.array(*[F.lit(n) for n in sorted(set(names))]))
    ])
    own = F.coalesce(F.try_element_at(table, F.lower(ext)), F.array().cast("array<string>"))
    return F.concat(own, every)


def dispatch_by_extension(files: DataFrame, extensions: dict[str, Sequence[str]], ext: str = "ext") -> DataFrame:
    """Add the analyzers that accept a file; ``*`` accepts every file."""
    return files.withColumn("analyzers", _analyzers_of(F.col(ext), extensions))


def join_files_analyzers(files: DataFrame, extensions: dict[str, Sequence[str]], ext: str = "ext") -> DataFrame:
    """One row per file and accepting analyzer. The analyzer table is code, so it is unfolded in place, not joined."""
    return files.withColumn("analyzer", F.explode(_analyzers_of(F.col(ext), extensions)))
