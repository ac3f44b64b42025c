"""Reports of other scanners as findings. Each operator takes rows of (path, report JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.scalars import finding_id, lookup
from vigilake.operators.findings import with_finding_defaults
from vigilake.session import any_of

# Levels and words of the tools.
BANDIT_SEVERITY = {"high": "high", "medium": "medium", "low": "low"}
BANDIT_CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.5}
BANDIT_SUSPICIOUS = ("malicious", "backdoor")
SEMGREP_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
SEMGREP_SUSPICIOUS = ("backdoor", "malicious", "insecure", "suspicious", "eval", "exec", "command injection")
SEMGREP_MISCONFIG = ("config", "hardening", "secret", "credential")
SHELLCHECK_SEVERITY = {"error": "high", "warning": "medium", "info": "low", "style": "low"}
SHELLCHECK_CONFIDENCE = {"error": 0.9, "warning": 0.7, "info": 0.5, "style": 0.4}
SHELLCHECK_SUSPICIOUS = (
    "injection", "arbitrary", "suspicious", "security", "backdoor", "insecure", "unsafe", "dangerous", "malicious",
    "privilege",
)
SHELLCHECK_MISCONFIG = ("configuration", "undefined", "not found", "deprecated", "export")
NPM_SEVERITY = {"critical": "critical", "high": "high", "moderate": "medium", "low": "low"}


def _words(text: Column, words) -> Column:
    return any_of([F.coalesce(text, F.lit("")).contains(w) for w in words])


def _finish(rows: DataFrame, analyzer: str, created_at: Column | None, **columns) -> DataFrame:
    """Findings from the columns given; place columns default to null."""
    def place(name, kind="int"):
        return columns.pop(name, F.lit(None)).cast(kind).alias(name)

    location = F.struct(
        F.col("path"), place("line_start"), place("line_end"), place("column_start"), place("column_end"),
        place("snippet", "string"),
    )
    rule = columns["rule_id"]
    out = rows.select(
        finding_id(F.lit(analyzer), F.col("path"), location["line_start"],
                   F.concat_ws("@", rule, location["column_start"].cast("string"))).alias("id"),
        location.alias("location"), F.lit(analyzer).alias("analyzer"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        *[value.alias(name) for name, value in columns.items()],
    )
    return with_finding_defaults(out)


def ingest_bandit(reports: DataFrame, report: str = "report", created_at: Column | None = None) -> DataFrame:
    schema = (
        "results array<struct<test_id:string,test_name:string,issue_severity:string,issue_confidence:string,"
        "issue_text:string,line_number:int,col_offset:int,code:string,more_info:string>>"
    )
    r = F.col("r")
    rows = reports.select("path", F.explode(F.from_json(report, schema)["results"]).alias("r"))
    test = F.coalesce(r["test_id"], F.lit("UNKNOWN"))
    column = F.coalesce(r["col_offset"], F.lit(0))
    return _finish(
        rows, "bandit", created_at,
        rule_id=F.concat(F.lit("BANDIT-"), test),
        title=F.coalesce(r["test_name"], F.lit("Unknown bandit finding")),
        description=F.coalesce(r["issue_text"], F.lit("")),
        severity=F.coalesce(lookup(F.lower(r["issue_severity"]), BANDIT_SEVERITY), F.lit("medium")),
        confidence=F.coalesce(lookup(F.lower(r["issue_confidence"]), BANDIT_CONFIDENCE), F.lit(0.7)),
        type=F.when(_words(F.lower(r["issue_text"]), BANDIT_SUSPICIOUS), "suspicious").otherwise("vulnerability"),
        line_start=F.coalesce(r["line_number"], F.lit(1)), line_end=F.coalesce(r["line_number"], F.lit(1)),
        column_start=column, column_end=column + 1, snippet=F.coalesce(r["code"], F.lit("")),
        references=F.array(F.coalesce(r["more_info"], F.lit(""))),
        tags=F.array(F.lit("bandit"), F.concat(F.lit("test_id:"), test)),
    )


def ingest_semgrep(reports: DataFrame, report: str = "report", language: str = "python", created_at: Column | None = None) -> DataFrame:
    schema = (
        "results array<struct<check_id:string,start:struct<line:int,col:int>,end:struct<line:int,col:int>,"
        "extra:struct<severity:string,message:string,lines:string,fix:string,"
        "metadata:struct<references:array<string>,cwe:string,description:string,confidence_level:double,fix:string>>>>"
    )
    r = F.col("r")
    extra, meta = r["extra"], r["extra"]["metadata"]
    rows = reports.select("path", F.explode(F.from_json(report, schema)["results"]).alias("r"))
    rule = F.coalesce(r["check_id"], F.lit("unknown-semgrep-rule"))
    message = F.coalesce(extra["message"], F.lit("Unknown semgrep finding"))
    text = F.concat_ws("\n", F.lower(rule), F.lower(message))
    # cwe is a text, a number or a list; a list comes through as its JSON text
    cwe = F.coalesce(F.get(F.from_json(meta["cwe"], "array<string>"), F.lit(0)), meta["cwe"])
    return _finish(
        rows, "semgrep", created_at,
        rule_id=F.concat(F.lit("SEMGREP-"), F.replace(rule, F.lit("/"), F.lit("-"))),
        title=message,
        description=F.when(F.coalesce(meta["description"], F.lit("")) != "", meta["description"]).otherwise(message),
        severity=F.coalesce(lookup(F.upper(extra["severity"]), SEMGREP_SEVERITY), F.lit("low")),
        confidence=F.coalesce(meta["confidence_level"], F.lit(0.8)),
        type=F.when(_words(text, SEMGREP_SUSPICIOUS), "suspicious").when(_words(text, SEMGREP_MISCONFIG), "misconfig")
        .otherwise("vulnerability"),
        line_start=F.coalesce(r["start"]["line"], F.lit(1)),
        line_end=F.coalesce(r["end"]["line"], r["start"]["line"], F.lit(1)),
        column_start=F.coalesce(r["start"]["col"], F.lit(0)), column_end=F.coalesce(r["end"]["col"], F.lit(0)),
        snippet=F.coalesce(extra["lines"], F.lit("")),
        references=F.coalesce(F.array_compact(meta["references"]), F.array().cast("array<string>")),
        tags=F.array(F.lit("semgrep"), F.concat(F.lit("semgrep_rule:"), rule), F.lit(f"language:{language}")),
        cwe_id=F.when(F.upper(cwe).startswith("CWE-"), cwe).otherwise(F.concat(F.lit("CWE-"), cwe)),
        remediation=F.coalesce(meta["fix"], extra["fix"]),
    )


def ingest_shellcheck(reports: DataFrame, report: str = "report", created_at: Column | None = None) -> DataFrame:
    schema = (
        "array<struct<level:string,code:string,message:string,line:int,column:int,endLine:int,endColumn:int,"
        "fix:struct<replacements:array<struct<text:string>>>>>"
    )
    r = F.col("r")
    rows = reports.select("path", F.explode(F.from_json(report, schema)).alias("r"))
    message = F.lower(F.coalesce(r["message"], F.lit("")))
    level = F.lower(r["level"])
    base = F.coalesce(lookup(level, SHELLCHECK_SEVERITY), F.lit("low"))
    suspicious = _words(message, SHELLCHECK_SUSPICIOUS)
    line, column = F.coalesce(r["line"], F.lit(1)), F.coalesce(r["column"], F.lit(1))
    code = F.coalesce(r["code"], F.lit("0"))
    page = F.concat(F.lit("https://github.com/koalaman/shellcheck/wiki/SC"), code)
    fix = F.get(r["fix"]["replacements"], F.lit(0))["text"]
    return _finish(
        rows, "shellcheck", created_at,
        rule_id=F.concat(F.lit("SHELLCHECK-SC"), code),
        title=F.concat(F.lit("ShellCheck: "), message),
        description=F.coalesce(r["message"], F.lit("Unknown ShellCheck issue")),
        severity=F.when(suspicious & (base == "low"), "medium").otherwise(base),
        confidence=F.coalesce(lookup(level, SHELLCHECK_CONFIDENCE), F.lit(0.5)),
        type=F.when(suspicious, "suspicious").when(_words(message, SHELLCHECK_MISCONFIG), "misconfig").otherwise("other"),
        line_start=line, line_end=F.coalesce(r["endLine"], line), column_start=column,
        column_end=F.coalesce(r["endColumn"], column + 1),
        snippet=F.when(F.coalesce(fix, F.lit("")) != "", fix).otherwise(F.coalesce(r["code"], message)),
        references=F.array(page), tags=F.array(F.lit("shellcheck"), F.concat(F.lit("SC"), code)),
        remediation=F.concat(F.lit("See "), page),
    )


def ingest_npm_audit(reports: DataFrame, report: str = "report", created_at: Column | None = None) -> DataFrame:
    entry = (
        "struct<severity:string,name:string,version:string,title:string,url:string,overview:string,"
        "recommendation:string,cwe:string,cvss:struct<score:double>>"
    )
    schema = f"vulnerabilities map<string,{entry}>, advisories map<string,{entry}>"
    parsed = reports.select("path", F.from_json(report, schema).alias("j"))
    rows = parsed.select("path", F.explode(F.coalesce("j.vulnerabilities", "j.advisories")).alias("vuln", "r"))
    r = F.col("r")
    name, version = F.coalesce(r["name"], F.lit("Unknown")), F.coalesce(r["version"], F.lit("Unknown"))
    return _finish(
        rows, "npm_audit", created_at,
        rule_id=F.concat(F.lit("NPM-AUDIT-"), F.col("vuln")),
        title=F.coalesce(r["title"], F.concat(F.lit("Vulnerability in "), name)),
        description=F.concat(
            F.lit("npm audit found vulnerability in "), name, F.lit("@"), version, F.lit(": "),
            F.coalesce(r["overview"], F.lit("")),
        ),
        severity=F.coalesce(lookup(F.lower(r["severity"]), NPM_SEVERITY), F.lit("medium")),
        confidence=F.lit(0.9), type=F.lit("vulnerability"),
        references=F.array_compact(F.array(F.nullif(r["url"], F.lit("")))),
        tags=F.array(*[F.lit(t) for t in ("npm", "audit", "dependency", "vulnerability")]),
        remediation=F.coalesce(r["recommendation"], F.lit("Update to a patched version.")),
        cwe_id=F.concat(F.lit("CWE-"), F.coalesce(r["cwe"], F.lit("1104"))),
        cvss_score=F.coalesce(r["cvss"]["score"], F.lit(5.0)),
    )


def ingest_safety(reports: DataFrame, report: str = "report", created_at: Column | None = None) -> DataFrame:
    """Rows of package, installed version, affected versions, id, description."""
    rows = reports.select("path", F.explode(F.from_json(report, "array<array<string>>")).alias("r")).where(F.size("r") >= 5)
    at = lambda i: F.get("r", F.lit(i))
    return _finish(
        rows, "safety", created_at,
        rule_id=F.concat(F.lit("SAFETY-"), at(3)),
        title=F.concat(F.lit("Vulnerable Python package: "), at(0)),
        description=F.concat(F.lit("Package "), at(0), F.lit("=="), at(1), F.lit(" is vulnerable: "), at(4)),
        severity=F.lit("high"), confidence=F.lit(0.9), type=F.lit("vulnerability"),
        references=F.array(F.concat(F.lit("https://pypi.org/project/"), at(0), F.lit("/"))),
        tags=F.array(*[F.lit(t) for t in ("python", "pip", "dependency", "vulnerability", "safety")]),
        remediation=F.concat(F.lit("Update "), at(0), F.lit(" to a non-vulnerable version.")),
        cwe_id=F.lit("CWE-1104"), cvss_score=F.lit(7.5),
    )
