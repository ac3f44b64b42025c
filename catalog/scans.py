"""Sources, sinks, extraction and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.bindings import (
    AS_OF, FINDINGS_CTE, NL, PAGE_PATH, doc_files, doc_files_sql, doc_findings, documents, lines_sql, lit, on_findings,
    page_files, page_files_sql, pages, query,
)
from vigilake.operators import advisories as A, filters as Fi, packages as Pk
from vigilake.operators.matching import explode_lines, skip_comment_lines
from vigilake.operators.packs import missing_directive
from vigilake.operators.structured import flatten_documents
from vigilake.session import read_table, scratch_folder, spread_rows
from vigilake.sources import stores, tool_reports as TR
from vigilake.sources.files import content_hash, decode_text, path_attributes, scan_files
from vigilake.udf import EXTENSIONS

FILES = f"WITH files AS ({doc_files_sql()})"


@query("scan_files", """SELECT 'source=' || source || '/lang=' || lang AS folder, 2 AS depth, '.txt' AS ext, CAST(sum(strlen(text) + 1) AS BIGINT) AS size
  FROM documents GROUP BY source, lang""")
def _(s, d):
    root = scratch_folder(s, "tree")
    documents(s, d).select("text", "lang", "source").write.partitionBy("source", "lang").text(root)
    # how many files a folder has depends on the tasks that wrote it, what they hold together does not
    files = scan_files(s, root, max_depth=3).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    return files.groupBy("folder", "depth", "ext").agg(F.sum("size").alias("size"))


@query("files_from_table", f"""{FILES} SELECT repo, path, string_split(path, '/')[-1] AS name, '.txt' AS ext, 2 AS depth,
  strlen(text) AS size FROM files""")
def _(s, d):
    return doc_files(s, d).select("repo", "path", "name", "ext", "depth", "size")


@query("decode_text", f"""{FILES} SELECT path, md5(text || chr(65533)) AS digest, length(text) + 1 AS n FROM files""")
def _(s, d):
    files = doc_files(s, d).select("path", F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff")).alias("content"))
    return decode_text(files).select("path", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query("explode_lines", f"{FILES} {lines_sql('SELECT path, text FROM files')}")
def _(s, d):
    return explode_lines(doc_files(s, d), mode="universal")


@query("content_hash", f"{FILES} SELECT path, sha256(text) AS content_hash, md5(text) AS md5_hash FROM files")
def _(s, d):
    rows = content_hash(doc_files(s, d), "md5", "text").withColumnRenamed("content_hash", "md5_hash")
    return content_hash(rows, "sha256", "text").select("path", "content_hash", "md5_hash")


@query("load_advisories", """SELECT 'ADV-' || p_partkey AS id, 'PyPI' AS ecosystem, lower(p_brand) AS name, p_name AS summary,
  CAST(p_size AS DOUBLE) / 10 AS cvss_score, '0.' || p_size AS introduced, '1.' || p_size AS fixed, '1.' || p_size AS fixed_version,
  'https://example.org/' || p_partkey AS reference, '2024-01-01 00:00:00' AS published FROM part""")
def _(s, d):
    size = F.col("p_size").cast("string")
    event = lambda k, v: F.create_map(F.lit(k), v)
    record = F.to_json(F.struct(
        F.concat(F.lit("ADV-"), "p_partkey").alias("id"), F.col("p_name").alias("summary"),
        F.array(F.struct(F.lit("CVSS_V3").alias("type"), (F.col("p_size") / 10).cast("string").alias("score"))).alias("severity"),
        F.array(F.struct(
            F.struct(F.lower("p_brand").alias("name"), F.lit("PyPI").alias("ecosystem")).alias("package"),
            F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(
                event("introduced", F.concat(F.lit("0."), size)), event("fixed", F.concat(F.lit("1."), size))
            ).alias("events"))).alias("ranges"),
        )).alias("affected"),
        F.array(F.struct(F.lit("WEB").alias("type"), F.concat(F.lit("https://example.org/"), "p_partkey").alias("url"))).alias("references"),
        F.lit("2024-01-01T00:00:00Z").alias("published"), F.lit("not a time").alias("modified"),
    ))
    rows = A.load_advisories(read_table(s, d, "part").select(record.alias("value")))
    return rows.select(
        "id", "ecosystem", "name", "summary", "cvss_score", F.col("affected")[0]["introduced"].alias("introduced"),
        F.col("affected")[0]["fixed"].alias("fixed"), "fixed_version", F.col("references")[0].alias("reference"),
        F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"),
    )


# Reports of other tools are made from events: one report per event, levels and texts follow the event type.

def _reports(s, d, report):
    return read_table(s, d, "events").select(F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("path"), report.alias("report"))


def _case(mapping, default, column="event_type"):
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {v if not isinstance(v, str) else lit(v)}" for k, v in mapping.items()) + f" ELSE {default if not isinstance(default, str) else lit(default)} END"


def _level():
    return F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "click", "LOW").otherwise("odd")


def _message():
    return F.when(F.col("event_type") == "error", "Possible backdoor found").when(
        F.col("event_type") == "purchase", "config value missing").otherwise("plain message")


_EVENTS = "SELECT 'event/' || event_id AS path, CAST(event_id AS INTEGER) AS line_start, event_type FROM events"
FINDING = ("path", "rule_id", "severity", "type", "confidence", "line_start", "analyzer")


def _shape(df):
    return df.select(
        F.col("location.path").alias("path"), "rule_id", "severity", "type", "confidence",
        F.col("location.line_start").alias("line_start"), "analyzer",
    )


@query("ingest_bandit", f"""SELECT path, 'BANDIT-B101' AS rule_id, {_case({'error': 'high', 'click': 'low'}, 'medium')} AS severity,
  {_case({'error': 'suspicious'}, 'vulnerability')} AS type, {_case({'error': 0.9, 'click': 0.5}, 0.7)} AS confidence, line_start,
  'bandit' AS analyzer FROM ({_EVENTS})""")
def _(s, d):
    report = F.to_json(F.struct(F.array(F.struct(
        F.lit("B101").alias("test_id"), _level().alias("issue_severity"), _level().alias("issue_confidence"),
        _message().alias("issue_text"), F.col("event_id").alias("line_number"),
    )).alias("results")))
    return _shape(TR.ingest_bandit(_reports(s, d, report)))


@query("ingest_semgrep", f"""SELECT path, 'SEMGREP-a-b' AS rule_id, {_case({'error': 'high', 'click': 'medium'}, 'low')} AS severity,
  {_case({'error': 'suspicious', 'purchase': 'misconfig'}, 'vulnerability')} AS type, 0.8 AS confidence, line_start,
  'semgrep' AS analyzer FROM ({_EVENTS})""")
def _(s, d):
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "WARNING").otherwise("INFO")
    report = F.to_json(F.struct(F.array(F.struct(
        F.lit("a/b").alias("check_id"), F.struct(F.col("event_id").alias("line"), F.lit(1).alias("col")).alias("start"),
        F.struct(level.alias("severity"), _message().alias("message"), F.struct(F.array(F.lit(79)).alias("cwe")).alias("metadata")).alias("extra"),
    )).alias("results")))
    return _shape(TR.ingest_semgrep(_reports(s, d, report)))


@query("ingest_shellcheck", f"""SELECT path, 'SHELLCHECK-SC2086' AS rule_id, {_case({'error': 'medium', 'click': 'medium'}, 'low')} AS severity,
  {_case({'error': 'suspicious'}, 'other')} AS type, {_case({'error': 0.4, 'click': 0.7}, 0.5)} AS confidence, line_start,
  'shellcheck' AS analyzer FROM ({_EVENTS})""")
def _(s, d):
    level = F.when(F.col("event_type") == "error", "style").when(F.col("event_type") == "click", "warning").otherwise("info")
    report = F.to_json(F.array(F.struct(
        level.alias("level"), F.lit(2086).alias("code"), _message().alias("message"), F.col("event_id").alias("line"), F.lit(1).alias("column"),
    )))
    return _shape(TR.ingest_shellcheck(_reports(s, d, report)))


@query("ingest_npm_audit", f"""SELECT path, 'NPM-AUDIT-lodash' AS rule_id, {_case({'error': 'critical', 'click': 'medium'}, 'medium')} AS severity,
  'vulnerability' AS type, 0.9 AS confidence, CAST(NULL AS INTEGER) AS line_start, 'npm_audit' AS analyzer FROM ({_EVENTS})""")
def _(s, d):
    level = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "moderate").otherwise("odd")
    report = F.to_json(F.struct(F.create_map(F.lit("lodash"), F.struct(
        level.alias("severity"), F.lit("lodash").alias("name"), F.col("user_id").cast("string").alias("version"),
    )).alias("vulnerabilities")))
    return _shape(TR.ingest_npm_audit(_reports(s, d, report)))


@query("ingest_safety", f"""SELECT path, 'SAFETY-' || line_start AS rule_id, 'high' AS severity, 'vulnerability' AS type, 0.9 AS confidence,
  CAST(NULL AS INTEGER) AS line_start, 'safety' AS analyzer FROM ({_EVENTS})""")
def _(s, d):
    report = F.to_json(F.array(F.array(
        F.col("event_type"), F.lit("1.0"), F.lit("<2.0"), F.col("event_id").cast("string"), F.col("props"),
    )))
    return _shape(TR.ingest_safety(_reports(s, d, report)))


@query("write_findings", on_findings("SELECT id, rule_id, severity, path FROM findings"))
def _(s, d):
    folder = scratch_folder(s, "findings")
    stores.write_findings(doc_findings(s, d), folder, "parquet")
    return s.read.parquet(folder).select("id", "rule_id", "severity", F.col("location.path").alias("path"))


@query("read_findings", on_findings("""SELECT id, 'low' AS severity, 'other' AS type, 1.0 AS confidence, 0 AS n_tags, path
  FROM findings"""))
def _(s, d):
    # only id and place are written, so every other field comes from the defaults
    folder = scratch_folder(s, "reports")
    doc_findings(s, d).select("id", "location").write.json(folder)
    return stores.read_findings(s, folder, "json").select(
        "id", "severity", "type", "confidence", F.size("tags").alias("n_tags"), F.col("location.path").alias("path")
    )


_CAPITAL = "upper(left(type, 1)) || substr(type, 2)"


@query("text_report", on_findings(f"""SELECT 0 AS section, CAST(1 AS BIGINT) AS ordinal, 'Security Report' AS line
  UNION ALL SELECT 1, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, upper(severity) || ': ' || count(*)
    FROM findings GROUP BY severity
  UNION ALL SELECT 2, -count(*), {_CAPITAL} || ': ' || count(*) FROM findings GROUP BY type
  UNION ALL SELECT 6 - severity_rank, ordinal, ordinal || '. ' || title || {NL} || '   ID: ' || id || {NL} || '   Type: ' || {_CAPITAL} || {NL}
    || '   Location: ' || path || ':' || line_start || {NL} || '   Description: ' || title || ': ' || matched_text
    || coalesce({NL} || '   Remediation: ' || nullif(remediation, ''), '')
    FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY path, line_start, column_start, rule_id, id) AS ordinal FROM findings)"""))
def _(s, d):
    return stores.text_report(doc_findings(s, d))


def cache_entries(s, d, analyzer="secrets", when="2024-01-01 00:00:00"):
    files = content_hash(doc_files(s, d), "sha256", "text")
    return files.select(
        "path", F.lit(analyzer).alias("analyzer"), "content_hash", F.to_timestamp(F.lit(when)).alias("mtime"),
        F.size(F.split("text", "\n")).cast("bigint").alias("n_findings"), F.to_timestamp(F.lit(when)).alias("scanned_at"),
    )


_CACHE_SQL = f"""{FILES} SELECT path, analyzer, content_hash, n_findings, scanned_at FROM (
  SELECT path, 'secrets' AS analyzer, sha256(text) AS content_hash, len(string_split(text, chr(10))) AS n_findings,
  '2024-02-01 00:00:00' AS scanned_at FROM files)"""


def _cache_roundtrip(s, d):
    folder = scratch_folder(s, "cache")
    stores.write_cache(cache_entries(s, d, when="2024-02-01 00:00:00"), folder, cache_entries(s, d))
    return stores.read_cache(s, folder).select(
        "path", "analyzer", "content_hash", "n_findings", F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss").alias("scanned_at")
    )


query("write_cache", _CACHE_SQL)(_cache_roundtrip)
query("read_cache", _CACHE_SQL)(_cache_roundtrip)


def _cache_log(s, d, upto):
    """English documents are scanned a second time; then the first ``upto`` generations are merged."""
    root = scratch_folder(s, "cache-log")
    stores.append_cache(cache_entries(s, d), root, 0)
    newer = cache_entries(s, d, when="2024-02-01 00:00:00").where(F.col("path").contains("/en/"))
    stores.append_cache(newer, root, 1)
    if upto:
        stores.compact_cache(s, root, upto - 1)
    return stores.read_cache_log(s, root).select(
        "path", "analyzer", "content_hash", "n_findings", F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss").alias("scanned_at")
    )


_LOG_SQL = _CACHE_SQL.replace("'2024-02-01 00:00:00'", "CASE WHEN lang = 'en' THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END")
query("append_cache", _LOG_SQL)(lambda s, d: _cache_log(s, d, 0))
query("compact_cache", _LOG_SQL)(lambda s, d: _cache_log(s, d, 2))

# --- extraction ------------------------------------------------------------------------------------------------------

_V = "p_size || '.' || (p_partkey % 7) || '.0'"


def _version():
    return F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(".0"))


def _manifest(s, d, *lines):
    """One small manifest per part."""
    def filled(line):
        out = []
        for piece in line.replace("{n}", "\0n\0").replace("{v}", "\0v\0").split("\0"):
            out.append(F.lower(F.translate("p_brand", "#", "-")) if piece == "n" else _version() if piece == "v" else F.lit(piece))
        return F.concat(*out)

    return spread_rows(read_table(s, d, "part"), "p_partkey").select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), F.concat_ws("\n", *map(filled, lines)).alias("text")
    )


PARTS = f"parts AS (SELECT 'part/' || p_partkey AS file_path, lower(replace(p_brand, '#', '-')) AS n, {_V} AS v FROM part)"
_PK = ("name", "version", "ecosystem", "file_path", "line_number")


def _rows(*entries):
    """SQL rows of (name, version, ecosystem, line) for every part."""
    return "WITH " + PARTS + " " + " UNION ALL ".join(
        f"SELECT {name} AS name, {version} AS version, {lit(eco)} AS ecosystem, file_path, CAST({line} AS INTEGER) AS line_number FROM parts"
        for name, version, eco, line in entries
    )


NAMES = ("requirements.txt", "Pipfile", "package.json", "go.sum", "Cargo.toml", "pom.xml", "notes.md")


@query("detect_ecosystem", f"""SELECT p_partkey, CASE lower(name) WHEN 'requirements.txt' THEN 'pypi' WHEN 'pipfile' THEN 'pypi'
  WHEN 'package.json' THEN 'npm' WHEN 'go.sum' THEN 'go' WHEN 'cargo.toml' THEN 'rust' WHEN 'pom.xml' THEN 'maven' END AS ecosystem
  FROM (SELECT p_partkey, ([{', '.join(map(lit, NAMES))}])[p_size % {len(NAMES)} + 1] AS name FROM part)""")
def _(s, d):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("p_size") % len(NAMES) + 1)
    return read_table(s, d, "part").select("p_partkey", Pk.detect_ecosystem(name).alias("ecosystem"))


@query("packages_requirements", _rows(("n", "v", "pypi", 2), ("'django'", "v || 'b1'", "pypi", 5)))
def _(s, d):
    files = _manifest(s, d, "# pinned", "{n}=={v}  # why", "", "numpy", "  Django >= {v}b1; python_version > '3'")
    return Pk.packages_requirements(files).select(*_PK)


@query("packages_pinned", _rows(("n", "v", "pypi", 2), ("'django'", "v", "pypi", 4)))
def _(s, d):
    files = _manifest(s, d, "# a==1", "{n} == {v};x", "flask>=1", "Django=={v} # note")
    return Pk.packages_pinned(files).select(*_PK)


@query("packages_setup_py", _rows(("n", "v", "pypi", "NULL"), ("'six'", "'1.0'", "pypi", "NULL")))
def _(s, d):
    files = _manifest(s, d, "setup(", "  install_requires = ['{n}>={v}',", "    \"six == 1.0\", 'bare'],", "  extras=['x==1'])")
    return Pk.packages_setup_py(files).select(*_PK)


@query("packages_pyproject", _rows(("n", "v", "pypi", "NULL"), ("'six'", "'1.0'", "pypi", "NULL")))
def _(s, d):
    files = _manifest(s, d, "[project]", "name = 'x'", "dependencies = ['{n}>={v}', 'Six == 1.0', 'bare']")
    return Pk.packages_pyproject(files).select(*_PK)


@query("packages_pipfile", _rows(("n", "v", "pypi", "NULL"), ("'six'", "'1.0'", "pypi", "NULL")))
def _(s, d):
    files = _manifest(s, d, "[packages]", "{n} = '~={v}'", "six = {version = '==1.0'}", "any = '*'")
    return Pk.packages_pipfile(files).select(*_PK)


@query("packages_cargo", _rows(("n", "v", "rust", "NULL"), ("'serde'", "'1.0'", "rust", "NULL")))
def _(s, d):
    files = _manifest(s, d, "[dependencies]", "{n} = '{v}'", "serde = {version = '1.0', features = ['derive']}", "local = {path = 'x'}")
    return Pk.packages_cargo(files).select(*_PK)


@query("packages_package_json", _rows(("n", "v", "npm", "NULL"), ("'jest'", "'26.6.0'", "npm", "NULL")))
def _(s, d):
    files = _manifest(s, d, '{"dependencies": {"{n}": "^{v}-beta", "any": "latest"}, "devDependencies": {"jest": "~26.6.0"}}')
    return Pk.packages_package_json(files).select(*_PK)


@query("packages_go_mod", _rows(("'github.com/' || n || '/mux'", "v", "go", 4)))
def _(s, d):
    files = _manifest(s, d, "module x", "", "require (", "\tgithub.com/{n}/mux v{v}", ")")
    return Pk.packages_go_mod(files).select(*_PK)


@query("extract_packages", "WITH " + PARTS + """ SELECT n AS name, v AS version, 'pypi' AS ecosystem, file_path || '/requirements.txt' AS
  file_path FROM parts UNION ALL SELECT 'github.com/' || n, v, 'go', file_path || '/go.mod' FROM parts UNION ALL
  SELECT n, v, 'rust', file_path || '/Cargo.toml' FROM parts""")
def _(s, d):
    kinds = {"requirements.txt": ["{n}=={v}"], "go.mod": ["github.com/{n} v{v}"], "Cargo.toml": ["[dependencies]", "{n} = '{v}'"]}
    parts = [
        _manifest(s, d, *lines).select(F.concat_ws("/", "path", F.lit(name)).alias("path"), F.lit(name).alias("name"), "text")
        for name, lines in kinds.items()
    ]
    return Pk.extract_packages(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("name", "version", "ecosystem", "file_path")


@query("dockerfile_instructions", f"""WITH {PARTS} SELECT file_path AS path, 1 AS line_no, 'FROM' AS instruction, n || ':' || v AS argument
  FROM parts UNION ALL SELECT file_path, 2, 'USER', 'root' FROM parts UNION ALL SELECT file_path, 3, 'COPY', n || ' /srv' FROM parts""")
def _(s, d):
    files = _manifest(s, d, "FROM {n}:{v} AS build", "  USER root", "COPY {n} /srv", "RUN make")
    return Pk.dockerfile_instructions(files)


@query("flatten_documents", """SELECT event_id, 'k' AS key_path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events
  UNION ALL SELECT event_id, 'u.tags[0]', event_type FROM events UNION ALL SELECT event_id, 'u.tags[1].id', CAST(user_id AS VARCHAR) FROM events""")
def _(s, d):
    nested = F.concat(
        F.regexp_replace("props", r"\}$", ""), F.lit(', "u": {"tags": ["'), F.col("event_type"), F.lit('", {"id": '),
        F.col("user_id").cast("string"), F.lit("}]}}"),
    )
    rows = read_table(s, d, "events").select("event_id", nested.alias("text"))
    return flatten_documents(rows, keys=("event_id",)).select("event_id", "key_path", "value")


# --- filters ---------------------------------------------------------------------------------------------------------

@query("path_attributes", f"""WITH f AS (SELECT page_id, {PAGE_PATH} AS path FROM pages) SELECT page_id, path,
  string_split(path, '/')[-1] AS name, regexp_replace(string_split(path, '/')[-1], '\\.html$', '') AS stem, '.html' AS ext,
  len(string_split(path, '/')) - 1 AS depth, false AS is_hidden FROM f""")
def _(s, d):
    return page_files(s, d).select("page_id", "path", "name", "stem", "ext", "depth", "is_hidden")


@query("filter_hidden", """SELECT source || '/' || lang || '/' || doc_id AS path FROM documents WHERE lang <> 'de'""")
def _(s, d):
    # German documents lie in a hidden folder
    folder = F.when(F.col("lang") == "de", F.concat(F.lit("."), "lang")).otherwise(F.col("lang"))
    return Fi.filter_hidden(documents(s, d).select(F.concat_ws("/", "source", folder, F.col("doc_id").cast("string")).alias("path")))


@query("filter_depth", f"SELECT page_id, path FROM (SELECT page_id, {PAGE_PATH} AS path FROM pages) WHERE len(string_split(path, '/')) - 1 < 3")
def _(s, d):
    return Fi.filter_depth(page_files(s, d), 3).select("page_id", "path")


@query("filter_globs", f"""{FILES} SELECT path FROM files WHERE (regexp_matches(path, '^src1.*/en/.*$') OR regexp_matches(path, '^.*/fr/.*[0-4]\\.txt$'))
  AND NOT regexp_matches(path, '^src1./.*$')""")
def _(s, d):
    return Fi.filter_globs(doc_files(s, d), ["src1*/en/*", "*/fr/*[0-4].txt"], ["src1?/*"]).select("path")


@query("filter_allowlist_paths", f"""{FILES} SELECT path FROM files WHERE path <> 'src1/en/1.txt' AND NOT starts_with(path, 'src2')
  AND NOT contains(path, '/fr/')""")
def _(s, d):
    return Fi.filter_allowlist_paths(doc_files(s, d), ["src1/en/1.txt"], ["src2"], ["/fr/"]).select("path")


@query("is_binary", f"""{FILES} SELECT path, lang = 'de' OR lang = 'fr' AS is_binary FROM files""")
def _(s, d):
    from vigilake.operators.binary import is_binary

    # German contents get a zero byte, French ones are cut inside a character, the others stay text
    raw = F.encode("text", "UTF-8")
    content = F.when(F.col("lang") == "de", F.concat(raw, F.lit(b"\x00"))).when(
        F.col("lang") == "fr", F.concat(raw, F.lit(b"\xc3"))).otherwise(raw)
    rows = documents(s, d).select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.lit(".unknown").alias("ext"), content.alias("content"),
    )
    return is_binary(rows).select("path", "is_binary")


_EXT_MAP = {"python": [".en", ".de"], "shell": [".de"], "text": ["*"]}


@query("dispatch_by_extension", """SELECT doc_id, CASE lang WHEN 'en' THEN 'python,text' WHEN 'de' THEN 'python,shell,text' ELSE 'text' END
  AS analyzers FROM documents""")
def _(s, d):
    rows = documents(s, d).select("doc_id", F.concat(F.lit("."), "lang").alias("ext"))
    return Fi.dispatch_by_extension(rows, _EXT_MAP).select("doc_id", F.array_join("analyzers", ",").alias("analyzers"))


@query("join_files_analyzers", """SELECT doc_id, 'text' AS analyzer FROM documents UNION ALL SELECT doc_id, 'python' FROM documents
  WHERE lang IN ('en', 'de') UNION ALL SELECT doc_id, 'shell' FROM documents WHERE lang = 'de'""")
def _(s, d):
    rows = documents(s, d).select("doc_id", F.concat(F.lit("."), "lang").alias("ext"))
    return Fi.join_files_analyzers(rows, _EXT_MAP).select("doc_id", "analyzer")


_ROLE_NAMES = ("Dockerfile.dev", "docker-compose.yml", "package.json", "requirements.txt", "Cargo.toml", "README.md", "deploy.yaml")


@query("dispatch_by_name", f"""SELECT p_partkey, CASE name WHEN 'Dockerfile.dev' THEN 'dockerfile' WHEN 'docker-compose.yml' THEN
  'compose,yaml,prompt_text' WHEN 'package.json' THEN 'package_json,prompt_text' WHEN 'requirements.txt' THEN 'requirements,prompt_text'
  WHEN 'Cargo.toml' THEN 'toml,prompt_text' WHEN 'README.md' THEN 'documentation,prompt_text' ELSE 'yaml,prompt_text' END AS roles
  FROM (SELECT p_partkey, ([{', '.join(map(lit, _ROLE_NAMES))}])[p_size % {len(_ROLE_NAMES)} + 1] AS name FROM part)""")
def _(s, d):
    name = F.element_at(F.array(*[F.lit(n) for n in _ROLE_NAMES]), F.col("p_size") % len(_ROLE_NAMES) + 1)
    rows = path_attributes(read_table(s, d, "part").select("p_partkey", name.alias("path")))
    return Fi.dispatch_by_name(rows).select("p_partkey", F.array_join("roles", ",").alias("roles"))


@query("filter_severity", on_findings("SELECT id, severity FROM findings WHERE severity_rank >= 2"))
def _(s, d):
    return Fi.filter_severity(doc_findings(s, d), "high").select("id", "severity")


@query("filter_confidence", on_findings("""SELECT id, confidence FROM findings WHERE confidence >= CASE analyzer WHEN 'wording'
  THEN 0.7 ELSE 0.6 END"""))
def _(s, d):
    return Fi.filter_confidence(doc_findings(s, d), 0.6, {"wording": 0.7}).select("id", "confidence")


@query("filter_findings", on_findings("""SELECT id, severity, confidence FROM findings WHERE severity_rank >= 1 AND confidence >= 0.55
  AND id NOT IN (SELECT min(id) FROM findings GROUP BY rule_id)"""))
def _(s, d):
    found = doc_findings(s, d)
    allowed = found.groupBy("rule_id").agg(F.min("id").alias("id"))
    cfg = Fi.ScanConfig(min_severity="medium", min_confidence=0.55)
    return Fi.filter_findings(found, cfg, allowed).select("id", "severity", "confidence")


@query("anti_allowlist", on_findings("SELECT id, rule_id FROM findings WHERE id NOT IN (SELECT id FROM findings WHERE rule_id = 'DOC-MAIL')"))
def _(s, d):
    found = doc_findings(s, d)
    return Fi.anti_allowlist(found, found.where(F.col("rule_id") == "DOC-MAIL")).select("id", "rule_id")


_KINDS = {"error": "critical_secrets", "click": "large_commits", "view": "unusual_hours", "purchase": "stale_branches", "signup": "sensitive_commits"}


@query("filter_sensitivity", f"""SELECT event_id, kind FROM (SELECT event_id, {_case(_KINDS, 'x')} AS kind FROM events) WHERE kind IN
  ('critical_secrets', 'sensitive_commits', 'large_commits', 'stale_branches')""")
def _(s, d):
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("event_type"))
    return Fi.filter_sensitivity(read_table(s, d, "events").select("event_id", kind.alias("kind")), "high")


@query("enabled_analyzers", "SELECT DISTINCT event_type AS analyzer FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_type = 'view')")
def _(s, d):
    names = read_table(s, d, "events").select(F.col("event_type").alias("analyzer"))
    return Fi.enabled_analyzers(names, names.where(F.col("analyzer") == "view").distinct())


_COMMENTS = ["# note {id}", "   ", "echo {src}"]


@query("skip_comment_lines", f"""SELECT path, line_no, line FROM ({lines_sql(doc_files_sql(_COMMENTS))})
  WHERE NOT regexp_matches(trim(line), '^\\s*(#|$)')""")
def _(s, d):
    return skip_comment_lines(explode_lines(doc_files(s, d, _COMMENTS), mode="universal"))


@query("missing_directive", f"{FILES} SELECT path, 'NO-NUMBER' AS rule_id FROM files WHERE NOT regexp_matches(text, '[0-9]')")
def _(s, d):
    return missing_directive(doc_files(s, d), "[0-9]", "NO-NUMBER").select("path", "rule_id")


__all__ = ["AS_OF", "EXTENSIONS", "FINDINGS_CTE", "cache_entries", "page_files_sql", "pages"]
