"""Extension points: own analyzers and own rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vigilake.functions.scalars import finding_id
from vigilake.operators.findings import as_findings, with_finding_defaults
from vigilake.operators.matching import match_content, match_lines
from vigilake.operators.sets import file_keys
from vigilake.rules import code, prompts, threats
from vigilake.rules.model import Pack, Rule
from vigilake.schemas import FINDINGS

Analyzer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    run: Analyzer
    extensions: tuple[str, ...]


_REGISTRY: dict[str, Registered] = {}

# Extensions of the built-in analyzers.
EXTENSIONS = {
    "binary": (
        ".exe", ".dll", ".so", ".dylib", ".bin", ".sys", ".o", ".a", ".lib", ".obj", ".pyc", ".pyd", ".cmxs", ".ko",
        ".class", ".jar", ".war", ".ear", ".elf", ".out",
    ),
    "browser_theft": threats.CODE_EXTENSIONS,
    "config": (".dockerfile", ".json", ".txt", ".yml", ".yaml", ".toml"),
    "container": (".dockerfile", ".docker", ".yml", ".yaml", ".json"),
    "crypto_wallet": threats.CODE_EXTENSIONS,
    "javascript_static_analyzer": code.JAVASCRIPT_EXTENSIONS,
    "llm_exploitation": prompts.PROMPT_EXTENSIONS,
    "malicious_character": ("*",),
    "metadata": ("*",),
    "python_static_analyzer": code.PYTHON_EXTENSIONS,
    "shell_script_analyzer": code.SHELL_EXTENSIONS,
    "vulnerability": (
        ".py", ".txt", ".json", ".yml", ".yaml", ".toml", ".cfg", ".ini", ".js", ".ts", ".jsx", ".tsx", ".lock", ".go",
        ".mod", ".sum", ".rs", ".java", ".gradle", ".xml", ".pom", ".cs", ".csproj", ".fsproj", ".vbproj", ".rb",
        ".gemspec", ".gemfile", ".php", ".composer",
    ),
}


def register_analyzer(name: str, run: Analyzer, extensions: Iterable[str] = ("*",)) -> None:
    """Register a function from file rows to findings rows under a name."""
    _REGISTRY[name] = Registered(name, run, tuple(extensions))


def registered_analyzers() -> dict[str, Registered]:
    return dict(_REGISTRY)


def run_registered(files: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Findings of the registered analyzers, each on the files it accepts."""
    chosen = [_REGISTRY[n] for n in (_REGISTRY if names is None else names)]
    parts = []
    for a in chosen:
        own = files if "*" in a.extensions else files.where(F.col("ext").isin(*a.extensions))
        parts.append(with_finding_defaults(a.run(own)))
    if not parts:
        return files.sparkSession.createDataFrame([], FINDINGS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def register_rule_pack(rules: Sequence[Rule], name: str, analyzer: str = "custom", extensions: Iterable[str] = ("*",)) -> Pack:
    """Turn own rules into a pack and register the analyzer that runs it."""
    pack = Pack(name, analyzer, tuple(rules))

    def run(files: DataFrame) -> DataFrame:
        by_line = [r for r in pack.matchable if r.scope == "line"]
        by_text = [r for r in pack.matchable if r.scope != "line"]
        parts = []
        keys = file_keys(files)
        if by_line:
            parts.append(match_lines(files, [(r, None) for r in by_line], keys=keys))
        if by_text:
            parts.append(match_content(files, [(r, None) for r in by_text], keys=keys))
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return as_findings(found, pack)

    register_analyzer(name, run, extensions)
    return pack


def analyzer_from_function(
    name: str, analyze: Callable[[str, str], Iterable[dict]], text: str = "text", path: str = "path"
) -> Analyzer:
    """An analyzer from a Python function (path, text) -> findings as dicts.

    The repository of a file, where files have one, goes on to its findings. Texts go through Arrow batches. If the function fails on one text, the failure becomes a finding of that text and
    the scan goes on.
    """
    columns = ["repo", "path", "rule_id", "title", "description", "severity", "type", "line_start", "confidence", "tags"]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for repo, where, value in zip(part["repo"], part["path"], part["text"]):
                try:
                    for f in analyze(where, value):
                        rows.append((
                            repo, where, f.get("rule_id", name), f.get("title", name), f.get("description", ""),
                            f.get("severity", "low"), f.get("type", "other"), f.get("line_start"),
                            float(f.get("confidence", 1.0)), list(f.get("tags", [])),
                        ))
                except Exception as error:  # noqa: BLE001 - one bad text must not end the scan
                    rows.append((
                        repo, where, "ANALYZER-ERROR", "Analyzer failed", f"{type(error).__name__}: {error}", "low", "other",
                        None, 1.0, ["analyzer-error"],
                    ))
            out = pd.DataFrame(rows, columns=columns)
            out["line_start"] = out["line_start"].astype("Int32")
            yield out

    def run(files: DataFrame) -> DataFrame:
        repo = F.col("repo").cast("string") if "repo" in files.columns else F.lit(None).cast("string")
        found = files.select(repo.alias("repo"), F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(
            batches,
            "repo string, path string, rule_id string, title string, description string, severity string, type string, "
            "line_start int, confidence double, tags array<string>",
        )
        return with_finding_defaults(found.select(
            finding_id(F.lit(name), F.col("path"), F.col("line_start"), F.col("rule_id"), F.col("repo")).alias("id"),
            "repo", "rule_id", "title", "description", "severity", "type", "confidence", "tags",
            F.struct(
                F.col("path"), F.col("line_start"), F.col("line_start").alias("line_end"),
                F.lit(None).cast("int").alias("column_start"), F.lit(None).cast("int").alias("column_end"),
                F.lit(None).cast("string").alias("snippet"),
            ).alias("location"),
            F.lit(name).alias("analyzer"), F.current_timestamp().alias("created_at"),
        ))

    return run


def error_findings(findings: DataFrame) -> DataFrame:
    """Findings that report a failed analyzer."""
    return findings.where(F.array_contains("tags", "analyzer-error"))
