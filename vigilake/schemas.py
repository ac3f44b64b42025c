"""Table schemas shared by all operators."""

from pyspark.sql import types as T

_S, _I, _L, _D, _TS, _B = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType(),
)
_STRINGS = T.ArrayType(_S)


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


LOCATION = _table(path=_S, line_start=_I, line_end=_I, column_start=_I, column_end=_I, snippet=_S)
FINDINGS = _table(
    id=_S, rule_id=_S, title=_S, description=_S, severity=_S, severity_rank=_I, type=_S, location=LOCATION,
    analyzer=_S, confidence=_D, created_at=_TS, references=_STRINGS, tags=_STRINGS, metadata=T.MapType(_S, _S),
    remediation=_S, cwe_id=_S, cvss_score=_D, repo=_S,
)
PACKAGES = _table(
    name=_S, version=_S, version_key=T.ArrayType(_L), ecosystem=_S, file_path=_S, line_number=_I,
)
ADVISORIES = _table(
    id=_S, ecosystem=_S, name=_S, summary=_S, severity=_S, cvss_score=_D,
    affected=T.ArrayType(_table(introduced=_S, fixed=_S, last_affected=_S)), fixed_version=_S, references=_STRINGS,
    published=_TS, modified=_TS, versions=_STRINGS,
)
# One row per file and analyzer says what was scanned; the findings of a scan lie in a table of their own.
CACHE = _table(path=_S, analyzer=_S, content_hash=_S, mtime=_TS, n_findings=_L, scanned_at=_TS, repo=_S)
