"""From matches to rows of the findings table."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.scalars import finding_id
from vigilake.rules.model import Pack
from vigilake.schemas import FINDINGS


_ATTRIBUTES = (
    "map<string, struct<title:string, severity:string, severity_rank:int, type:string, analyzer:string, "
    "confidence:double, tags:array<string>, remediation:string, cwe_id:string, cvss_score:double>>"
)


def rule_attributes(packs: Iterable[Pack]) -> Column:
    """Fixed map from rule id to what a finding takes from its rule; a constant of the plan."""
    table = {
        rule.rule_id: {
            "title": rule.title, "severity": rule.severity, "severity_rank": rule.severity_rank, "type": rule.type,
            "analyzer": pack.analyzer, "confidence": float(rule.confidence),
            "tags": list(rule.tags or (pack.name, f"rule:{rule.rule_id}")), "remediation": rule.advice,
            "cwe_id": rule.cwe_id, "cvss_score": rule.cvss_score,
        }
        for pack in packs for rule in pack.rules
    }
    return F.from_json(F.lit(json.dumps(table)), _ATTRIBUTES)


def rule_levels(packs: Iterable[Pack]) -> dict[str, str]:
    """Severity of every rule."""
    return {rule.rule_id: rule.severity for pack in packs for rule in pack.rules}


def as_findings(
    matches: DataFrame,
    packs: Pack | Iterable[Pack],
    *,
    path: str = "path",
    created_at: Column | None = None,
    severity: Column | None = None,
    description: Column | None = None,
    metadata: Column | None = None,
) -> DataFrame:
    """Findings of matches that carry ``rule_id`` and, where known, positions, matched text and snippet."""
    packs = [packs] if isinstance(packs, Pack) else list(packs)
    have = set(matches.columns)

    def column(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind)

    rows = matches.withColumn("_r", F.element_at(rule_attributes(packs), F.col("rule_id")))
    level = F.col("_r.severity") if severity is None else severity
    text = F.coalesce(column("matched_text", "string"), F.lit(""))
    told = F.when(text == "", F.col("_r.title")).otherwise(F.concat(F.col("_r.title"), F.lit(": "), text))
    facts = F.create_map(F.lit("matched_text"), text, F.lit("pattern_id"), F.col("rule_id"))
    ranks = F.when(level == "critical", 3).when(level == "high", 2).when(level == "medium", 1).otherwise(0)
    return rows.select(
        finding_id(
            F.col("_r.analyzer"), F.col(path), column("line_start", "int"),
            F.concat_ws("@", "rule_id", F.coalesce(column("column_start", "string"), column("matched_text", "string"))),
            column("repo", "string"),
        ).alias("id"),
        F.col("rule_id"),
        F.col("_r.title").alias("title"),
        (told if description is None else description).alias("description"),
        level.alias("severity"),
        ranks.cast("int").alias("severity_rank"),
        F.col("_r.type").alias("type"),
        F.struct(
            F.col(path).cast("string").alias("path"),
            column("line_start", "int").alias("line_start"),
            column("line_end", "int").alias("line_end"),
            column("column_start", "int").alias("column_start"),
            column("column_end", "int").alias("column_end"),
            column("snippet", "string").alias("snippet"),
        ).alias("location"),
        F.col("_r.analyzer").alias("analyzer"),
        F.col("_r.confidence").alias("confidence"),
        (F.current_timestamp() if created_at is None else created_at).cast("timestamp").alias("created_at"),
        F.array().cast("array<string>").alias("references"),
        F.col("_r.tags").alias("tags"),
        (facts if metadata is None else metadata).alias("metadata"),
        F.col("_r.remediation").alias("remediation"),
        F.col("_r.cwe_id").alias("cwe_id"),
        F.col("_r.cvss_score").alias("cvss_score"),
        column("repo", "string").alias("repo"),
    )


# Defaults of a finding that lacks fields.
DEFAULTS = {"severity": "low", "type": "other", "confidence": 1.0}


def with_finding_defaults(df: DataFrame) -> DataFrame:
    """Bring rows to the findings schema: missing columns become null, and null fields get their defaults."""
    present, kinds = set(df.columns), dict(df.dtypes)
    out = []
    for field in FINDINGS.fields:
        value = F.col(field.name) if field.name in present else F.lit(None)
        if kinds.get(field.name) != field.dataType.simpleString():  # a struct behind a cast is built for every row
            value = value.cast(field.dataType)
        if field.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field.name]))
        elif field.name in ("references", "tags"):
            value = F.coalesce(value, F.array().cast("array<string>"))
        elif field.name == "metadata":
            value = F.coalesce(value, F.create_map().cast("map<string,string>"))
        out.append(value.alias(field.name))
    rows = df.select(*out)
    level = F.lower(F.col("severity"))
    rank = F.when(level == "critical", 3).when(level == "high", 2).when(level == "medium", 1).otherwise(0)
    return rows.withColumn("severity_rank", rank.cast("int"))
