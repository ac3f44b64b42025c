"""The test tables as files, lines, commits, packages and findings - once for Spark and once as SQL text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilake.functions.versions import version_key
from vigilake.operators.findings import as_findings
from vigilake.operators.matching import match_content, pack_entries
from vigilake.rules.model import Pack, Rule
from vigilake.session import read_table, spread
from vigilake.sources.files import files_from_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NL = "chr(10)"


def query(name: str, sql: str | None = None):
    """Register a query under the name of its operator, with its SQL where there is one."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- files ---------------------------------------------------------------------------------------------------------

def documents(s: SparkSession, d: str) -> DataFrame:
    return spread(read_table(s, d, "documents"), "doc_id")


def pages(s: SparkSession, d: str) -> DataFrame:
    return spread(read_table(s, d, "pages"), "page_id")


def doc_path(ext: str = ".txt") -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(ext)))


def doc_files(s: SparkSession, d: str, seed: Sequence[str] = (), ext: str = ".txt") -> DataFrame:
    """Documents as files. ``seed`` lines go below each text, with ``{id}`` and ``{src}`` taken from the row."""
    return files_from_table(documents(s, d), path=doc_path(ext), text=seeded(seed), repo=F.col("source"))


def page_files(s: SparkSession, d: str, seed: Sequence[str] = ()) -> DataFrame:
    path = F.concat(
        F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"\?.*$", ""), "/$", "/index"), F.lit(".html")
    )
    return files_from_table(pages(s, d), path=path, text=seeded(seed, "html", "page_id", "url"), repo=F.lit("web"), keep=("page_id",))


def seeded(seed: Sequence[str], text: str = "text", key: str = "doc_id", src: str = "source") -> Column:
    if not seed:
        return F.col(text)
    return F.concat_ws("\n", F.col(text), *[_filled(line, key, src) for line in seed])


def _parts(line: str) -> list[tuple[str, bool]]:
    out, rest = [], line
    while rest:
        at = min((i for i in (rest.find("{id}"), rest.find("{src}")) if i >= 0), default=-1)
        if at < 0:
            out.append((rest, False))
            break
        if at:
            out.append((rest[:at], False))
        name = "{id}" if rest.startswith("{id}", at) else "{src}"
        out.append((name, True))
        rest = rest[at + len(name):]
    return out


def _filled(line: str, key: str, src: str) -> Column:
    names = {"{id}": F.col(key).cast("string"), "{src}": F.col(src)}
    return F.concat(*[names[p] if is_name else F.lit(p) for p, is_name in _parts(line)])


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def seeded_sql(seed: Sequence[str], text: str = "text", key: str = "doc_id", src: str = "source") -> str:
    if not seed:
        return text
    names = {"{id}": f"CAST({key} AS VARCHAR)", "{src}": src}
    lines = [" || ".join(names[p] if is_name else lit(p) for p, is_name in _parts(line)) for line in seed]
    return f" || {NL} || ".join([text, *lines])


def doc_files_sql(seed: Sequence[str] = (), ext: str = ".txt") -> str:
    return (
        f"SELECT source AS repo, source || '/' || lang || '/' || doc_id || '{ext}' AS path, "
        f"{seeded_sql(seed)} AS text, n_chars, lang FROM documents"
    )


PAGE_PATH = "regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '\\?.*$', ''), '/$', '/index') || '.html'"


def page_files_sql(seed: Sequence[str] = ()) -> str:
    return f"SELECT page_id, {PAGE_PATH} AS path, {seeded_sql(seed, 'html', 'page_id', 'url')} AS text FROM pages"


def lines_sql(files: str) -> str:
    """Lines of a files subquery, cut at line feeds, a last empty line dropped."""
    return (
        f"SELECT path, CAST(i AS INTEGER) AS line_no, parts[i] AS line FROM (SELECT path, "
        f"CASE WHEN p[-1] = '' THEN p[1:len(p)-1] ELSE p END AS parts FROM (SELECT path, string_split(text, {NL}) AS p "
        f"FROM ({files}))), unnest(range(1, len(parts) + 1)) AS t(i)"
    )


# --- matches in SQL --------------------------------------------------------------------------------------------------

def re2(rule: Rule) -> str:
    return (f"(?{rule.flags})" if rule.flags else "") + rule.pattern


def matches_sql(source: str, rules: Iterable[Rule], key: str = "path", text: str = "text", patterns: dict | None = None) -> str:
    """All matches of all rules in a source, with 0-based start and stop offsets."""
    parts = []
    for rule in rules:
        p = lit((patterns or {}).get(rule.rule_id, re2(rule)))
        parts.append(f"""
SELECT {key}, {lit(rule.rule_id)} AS rule_id, m[k] AS matched_text, txt,
  CAST(coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0)
     + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS INTEGER) AS pos
FROM (SELECT {key}, {text} AS txt, regexp_extract_all({text}, {p}) AS m, regexp_split_to_array({text}, {p}) AS g
      FROM ({source})), unnest(range(1, len(m) + 1)) AS t(k)""")
    return "\nUNION ALL".join(parts)


def line_matches_sql(files: str, rules: Iterable[Rule], base: int = 0, where: str = "true", patterns: dict | None = None) -> str:
    """Matches per line: path, rule_id, line_start, column_start, matched_text."""
    source = f"SELECT path || chr(1) || line_no AS k_, line FROM ({lines_sql(files)}) WHERE {where}"
    return (
        f"SELECT split_part(k_, chr(1), 1) AS path, rule_id, CAST(split_part(k_, chr(1), 2) AS INTEGER) AS line_start, "
        f"pos + {base} AS column_start, matched_text FROM ({matches_sql(source, rules, 'k_', 'line', patterns)})"
    )


def content_matches_sql(files: str, rules: Iterable[Rule], patterns: dict | None = None, key: str = "path") -> str:
    """Matches per text: path, rule_id, line_start, column_start, matched_text."""
    return (
        f"SELECT {key}, rule_id, CAST(length(pre) - length(replace(pre, {NL}, '')) + 1 AS INTEGER) AS line_start, "
        f"CAST(length(string_split(pre, {NL})[-1]) + 1 AS INTEGER) AS column_start, matched_text "
        f"FROM (SELECT *, left(txt, pos) AS pre FROM ({matches_sql(files, rules, key, 'text', patterns)}))"
    )


MATCH = ("path", "rule_id", "line_start", "column_start", "matched_text")

# --- findings --------------------------------------------------------------------------------------------------------

CORPUS = Pack("corpus", "corpus", (
    Rule("DOC-TOKEN", "Token in a document", "critical", "secret", r'token = "[0-9a-f]{40}"', "", "CWE-798", 9.0, 0.9, "content"),
    Rule("DOC-MAIL", "Mail address in a document", "high", "vulnerability", r"[A-Za-z0-9_.]+@[A-Za-z0-9_.]+", "", "CWE-200",
         7.0, 0.7, "content"),
    Rule("DOC-DIGITS", "Long number in a document", "medium", "misconfig", r"[0-9]{6,}", "", None, None, 0.5, "content"),
))
WORDING = Pack("wording", "wording", (
    Rule("DOC-LICENSE", "License wording", "low", "license", r"(?i)licen[sc]e", "", None, None, 0.8, "content"),
    Rule("DOC-SHELL", "Shell character", "medium", "suspicious", r"[;&|]", "", "CWE-78", 5.0, 0.6, "content"),
))
AS_OF = "2024-06-01 00:00:00"


def doc_findings(s: SparkSession, d: str) -> DataFrame:
    """Findings of five user rules over all documents."""
    found = match_content(doc_files(s, d), [*pack_entries(CORPUS), *pack_entries(WORDING)], keys=("repo", "path"))
    return as_findings(found, [CORPUS, WORDING], created_at=F.to_timestamp(F.lit(AS_OF)))


_RULE_ROWS = ", ".join(
    f"({lit(r.rule_id)}, {lit(r.title)}, {lit(r.severity)}, {r.severity_rank}, {lit(r.type)}, {lit(p.analyzer)}, "
    f"CAST({r.confidence} AS DOUBLE), {lit(p.name)}, {lit(r.cwe_id) if r.cwe_id else 'NULL'}, {lit(r.advice)})"
    for p in (CORPUS, WORDING) for r in p.rules
)
RULE_CTE = (
    f"rules(rule_id, title, severity, severity_rank, type, analyzer, confidence, pack, cwe_id, remediation) AS (VALUES {_RULE_ROWS})"
)
FINDINGS_CTE = f"""{RULE_CTE}, hits AS ({content_matches_sql(doc_files_sql(), [*CORPUS.rules, *WORDING.rules])}),
findings AS (SELECT upper(left(r.analyzer, 3)) || '-' || sha256(r.analyzer || ':' || string_split(path, '/')[1] || ':' || path || ':'
  || line_start || ':' || rule_id || '@' || column_start) AS id, string_split(path, '/')[1] AS repo, rule_id, r.title, r.severity, r.severity_rank, r.type, r.analyzer,
  r.confidence, r.pack, r.cwe_id, r.remediation, path, line_start, column_start, matched_text,
  [r.pack, 'rule:' || rule_id] AS tags FROM hits JOIN rules r USING (rule_id))"""


def on_findings(body: str) -> str:
    return f"WITH {FINDINGS_CTE} {body}"


# --- commits ---------------------------------------------------------------------------------------------------------

def event_commits(s: SparkSession, d: str) -> DataFrame:
    """Events as commits: one repository per event type, users as authors."""
    return read_table(s, d, "events").select(
        F.col("event_type").alias("repo"), F.col("event_id").alias("sha"), F.col("user_id").alias("author"),
        F.col("ts").cast("timestamp").alias("committed_at"), F.concat_ws(" ", "event_type", "props").alias("message"),
        F.lit(1).alias("n_parents"),
    )


EVENT_COMMITS = "SELECT event_type AS repo, event_id AS sha, user_id AS author, ts AS committed_at FROM events"


def order_commits(s: SparkSession, d: str) -> DataFrame:
    """Orders as commits: one repository per priority, customers as authors; open orders are root commits."""
    return read_table(s, d, "orders").select(
        F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("committed_at"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("n_parents"),
    )


ORDER_COMMITS = (
    "SELECT o_orderpriority AS repo, o_orderkey AS sha, o_custkey AS author, o_orderdate AS committed_at, "
    "CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS n_parents FROM orders"
)


def commit_files(s: SparkSession, d: str) -> DataFrame:
    """Line items as changed files of the orders they belong to."""
    li = read_table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("sha"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"),
        F.col("l_extendedprice").alias("size"), (F.col("l_returnflag") == "R").alias("deleted"),
    )
    repos = read_table(s, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("repo"))
    return li.join(repos, "sha")


COMMIT_FILES = (
    "SELECT o_orderpriority AS repo, l_orderkey AS sha, l_partkey || '/' || l_linenumber AS path, l_extendedprice AS size, "
    "l_returnflag = 'R' AS deleted FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)


# --- packages --------------------------------------------------------------------------------------------------------

# Names of packages with known bounds; parts are spread over them by brand.
_NAMES = ("django", "flask", "werkzeug", "requests", "pyyaml", "pillow", "cryptography")


def part_packages(s: SparkSession, d: str) -> DataFrame:
    """Parts as declared packages: the name follows the brand, the version the size and price."""
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), brand % len(_NAMES) + 1)
    version = F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (F.col("p_size") % 40).cast("string"), (F.floor("p_retailprice") % 20).cast("string"))
    return read_table(s, d, "part").select(
        name.alias("name"), version.alias("version"), version_key(version).alias("version_key"), F.lit("pypi").alias("ecosystem"),
        F.concat(F.lower("p_type"), F.lit("/requirements.txt")).alias("file_path"), F.col("p_partkey").cast("int").alias("line_number"),
    )


_NAME_LIST = "[" + ", ".join(lit(n) for n in _NAMES) + "]"
PART_PACKAGES = (
    f"SELECT ({_NAME_LIST})[CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % {len(_NAMES)} + 1] AS name, "
    "(p_size % 5) || '.' || (p_size % 40) || '.' || (CAST(floor(p_retailprice) AS BIGINT) % 20) AS version, 'pypi' AS ecosystem, "
    "lower(p_type) || '/requirements.txt' AS file_path, CAST(p_partkey AS INTEGER) AS line_number FROM part"
)
