"""Joins, roll-ups, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.bindings import (
    AS_OF, COMMIT_FILES, CORPUS, EVENT_COMMITS, FINDINGS_CTE, ORDER_COMMITS, PART_PACKAGES, WORDING, commit_files, doc_files,
    doc_files_sql, doc_findings, documents, event_commits, lines_sql, lit, on_findings, order_commits, page_files, page_files_sql,
    part_packages, query,
)
from catalog.scans import FILES, cache_entries
from vigilake.operators import advisories as A, commits as Cm, filters as Fi, ordering as O, packages as Pk, rollups as R, sets as S
from vigilake.operators.packs import rules_table
from vigilake.plans.history import History, history_findings
from vigilake.rules.config import KNOWN_VULNERABLE
from vigilake.rules.secrets import LARGE_BINARY_BYTES
from vigilake.session import read_table
from vigilake.sources.files import content_hash
from vigilake.sources.stores import cache_latest, expire_cache

# --- joins -----------------------------------------------------------------------------------------------------------

_USER_RULES = (("U1", "en", "th[aeiou]n"), ("U2", "de", "sch"), ("U3", "fr", "[éè]a"), ("U4", "en", "[0-9]{3}"), ("U5", "es", "ci[oó]n"))


@query("join_files_rules", "WITH r(rule_id, lang, pattern) AS (VALUES " + ", ".join(f"({lit(a)}, {lit(b)}, {lit(c)})" for a, b, c in _USER_RULES) + """)
  SELECT doc_id, rule_id, len(regexp_extract_all(text, pattern)) AS n_matches FROM documents JOIN r USING (lang) WHERE regexp_matches(text, pattern)""")
def _(s, d):
    rules = s.createDataFrame(_USER_RULES, "rule_id string, lang string, pattern string")
    return S.join_files_rules(documents(s, d), rules, language="lang", keys=("doc_id",)).select("doc_id", "rule_id", "n_matches")


_BOUNDS = ", ".join(f"({lit(n)}, {i}, {lit(b)})" for n, bs in KNOWN_VULNERABLE["pypi"].items() for i, b in enumerate(bs))
_KEY = "list_transform(string_split({0}, '.'), lambda x: CAST(x AS BIGINT))"


def _padded(v):
    return f"(({_KEY.format(v)}) || [0, 0, 0, 0])[1:4]"


_KNOWN = f"""WITH p AS ({PART_PACKAGES}), b(name, bound_order, bound) AS (VALUES {_BOUNDS}),
  h AS (SELECT p.*, b.bound, row_number() OVER (PARTITION BY p.line_number, p.file_path ORDER BY bound_order) AS rn
    FROM p JOIN b USING (name) WHERE {_padded('version')} < {_padded('bound')})"""


@query("join_known_vulnerable", _KNOWN + " SELECT name, version, file_path, line_number, bound FROM h WHERE rn = 1")
def _(s, d):
    return A.join_known_vulnerable(part_packages(s, d), A.known_vulnerable_bounds(s)).select("name", "version", "file_path", "line_number", "bound")


@query("first_bound_per_package", _KNOWN + " SELECT DISTINCT name, version, ecosystem, bound FROM h WHERE rn = 1")
def _(s, d):
    from vigilake.functions.versions import version_lt

    hits = Pk.distinct_packages(part_packages(s, d)).join(A.known_vulnerable_bounds(s), ["ecosystem", "name"])
    return A.first_bound_per_package(hits.where(version_lt(F.col("version"), F.col("bound"))))


# Advisories come from suppliers: each names one package and one interval.
_NAMES = "['django', 'flask', 'werkzeug', 'requests', 'pyyaml', 'pillow', 'cryptography']"
_ADV = f"""adv AS (SELECT 'ADV-' || s_suppkey AS advisory_id, ({_NAMES})[s_suppkey % 7 + 1] AS name, (s_nationkey % 5) || '.' || (s_nationkey % 30) AS introduced,
  (s_nationkey % 5) || '.' || (s_nationkey % 30 + 9) AS fixed, s_acctbal / 1000 AS cvss_score FROM supplier)"""


def advisories(s, d):
    key = F.col("s_nationkey")
    name = F.element_at(F.array(*[F.lit(n) for n in ("django", "flask", "werkzeug", "requests", "pyyaml", "pillow", "cryptography")]),
                        (F.col("s_suppkey") % 7 + 1).cast("int"))
    introduced = F.concat_ws(".", (key % 5).cast("string"), (key % 30).cast("string"))
    fixed = F.concat_ws(".", (key % 5).cast("string"), (key % 30 + 9).cast("string"))
    return read_table(s, d, "supplier").select(
        F.concat(F.lit("ADV-"), "s_suppkey").alias("id"), F.lit("PyPI").alias("ecosystem"), name.alias("name"), F.col("s_name").alias("summary"),
        F.lit("CVSS").alias("severity"), (F.col("s_acctbal") / 1000).alias("cvss_score"),
        F.array(F.struct(introduced.alias("introduced"), fixed.alias("fixed"))).alias("affected"), fixed.alias("fixed_version"),
        F.array(F.lit("https://example.org")).alias("references"), F.lit(None).cast("timestamp").alias("published"),
        F.lit(None).cast("timestamp").alias("modified"),
    )


_HIT = f"WITH p AS ({PART_PACKAGES}), {_ADV}, h AS (SELECT * FROM p JOIN adv USING (name) WHERE {_padded('version')} >= {_padded('introduced')} {{0}} {_padded('version')} < {_padded('fixed')})"


@query("join_advisories", _HIT.format("AND") + " SELECT name, version, file_path, line_number, advisory_id FROM h")
def _(s, d):
    return A.join_advisories(part_packages(s, d), advisories(s, d)).select("name", "version", "file_path", "line_number", "advisory_id")


@query("join_advisories_any", _HIT.format("OR") + " SELECT name, version, file_path, line_number, advisory_id FROM h")
def _(s, d):
    return A.join_advisories(part_packages(s, d), advisories(s, d), "any").select("name", "version", "file_path", "line_number", "advisory_id")


@query("dependency_findings", _HIT.format("AND") + """ SELECT file_path AS path, line_number, 'Vulnerable dependency: ' || name || ' ' || version AS title, CASE WHEN cvss_score >= 9
  THEN 'critical' WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium' ELSE 'low' END AS severity FROM h""")
def _(s, d):
    rows = A.dependency_findings(A.join_advisories(A.with_finding_titles(part_packages(s, d)), advisories(s, d)))
    return rows.select(F.col("location.path").alias("path"), F.col("location.line_start").alias("line_number"), "title", "severity")


@query("enrich_findings", on_findings("SELECT id, title, remediation, cwe_id FROM findings"))
def _(s, d):
    rows = [(r.rule_id, r.title, r.cwe_id, r.advice) for p in (CORPUS, WORDING) for r in p.rules]
    rules = s.createDataFrame(rows, "rule_id string, title string, cwe_id string, remediation string")
    return S.enrich_findings(doc_findings(s, d).select("id", "rule_id"), rules).select("id", "title", "remediation", "cwe_id")


def _perturbed(s, d):
    """Cached state: English documents as they are, German ones with an older content, others unknown."""
    entries = cache_entries(s, d)
    kept = entries.where(F.col("path").contains("/en/"))
    changed = entries.where(F.col("path").contains("/de/")).withColumn("content_hash", F.lit("old")).withColumn("mtime", F.to_timestamp(F.lit("2023-01-01")))
    return kept.unionByName(changed)


def _current(s, d):
    return content_hash(doc_files(s, d), "sha256", "text").withColumn("mtime", F.to_timestamp(F.lit("2024-05-05")))


@query("join_cache", f"{FILES} SELECT path, lang = 'en' AS is_hit FROM files")
def _(s, d):
    return S.join_cache(_current(s, d), _perturbed(s, d), "secrets").select("path", "is_hit")


@query("cache_misses", f"{FILES} SELECT path FROM files WHERE lang <> 'en'")
def _(s, d):
    return S.cache_misses(_current(s, d), _perturbed(s, d), "secrets").select("path")


@query("cache_misses_by_time", f"{FILES} SELECT path FROM files WHERE lang <> 'en'")
def _(s, d):
    # English documents have the time of their entry, so their content is not looked at
    entries = cache_entries(s, d).withColumns({"content_hash": F.lit("old"), "mtime": F.to_timestamp(F.lit("2024-05-05"))})
    files = doc_files(s, d).withColumn("mtime", F.to_timestamp(F.when(F.col("path").contains("/en/"), "2024-05-05").otherwise("2024-06-06")))
    return S.cache_misses(files, entries, "secrets", lambda f: content_hash(f, "sha256", "text")).select("path")


@query("cache_stats", f"{FILES} SELECT count(*) FILTER (lang = 'en') AS hits, count(*) FILTER (lang <> 'en') AS misses, round(count(*) FILTER (lang = 'en') * 100.0 / count(*), 6) AS hit_rate FROM files")
def _(s, d):
    stats = R.cache_stats(S.join_cache(_current(s, d), _perturbed(s, d), "secrets"))
    return stats.withColumn("hit_rate", F.round("hit_rate", 6))


@query("cache_latest", f"{FILES} SELECT path, '2024-02-01' AS scanned FROM files")
def _(s, d):
    both = cache_entries(s, d).unionByName(cache_entries(s, d, when="2024-02-01 00:00:00"))
    return cache_latest(both).select("path", F.date_format("scanned_at", "yyyy-MM-dd").alias("scanned"))


@query("expire_cache", f"{FILES} SELECT path FROM files WHERE lang NOT IN ('fr', 'de')")
def _(s, d):
    entries = cache_entries(s, d, when="2024-05-20 00:00:00")
    aged = entries.withColumn("scanned_at", F.when(F.col("path").contains("/fr/"), F.to_timestamp(F.lit("2024-03-01"))).otherwise(F.col("scanned_at")))
    current = doc_files(s, d).where(~F.col("path").contains("/de/"))
    return expire_cache(aged, current, F.to_timestamp(F.lit(AS_OF))).select("path")


_HITS = "h AS (SELECT path, line_no FROM l WHERE regexp_matches(line, '[0-9]{6,}'))"


def _has_number(line):
    return F.rlike(line, F.lit("[0-9]{6,}"))


@query("snippet_context", f"""WITH l AS ({lines_sql(doc_files_sql())}), {_HITS} SELECT h.path, h.line_no, string_agg(l.line, chr(10) ORDER BY l.line_no) AS snippet
  FROM h JOIN l ON h.path = l.path AND l.line_no BETWEEN h.line_no - 3 AND h.line_no + 3 GROUP BY ALL""")
def _(s, d):
    return O.text_windows(doc_files(s, d), 3, hit=_has_number).select("path", "line_no", "snippet")


@query("lines_of_interest", f"""WITH l AS ({lines_sql(doc_files_sql())}), {_HITS} SELECT DISTINCT l.path, l.line_no, l.line
  FROM h JOIN l ON h.path = l.path AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2""")
def _(s, d):
    return O.text_lines_near(doc_files(s, d), _has_number)


@query("snippet_window", f"""SELECT path, line_no, string_agg(line, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS snippet
  FROM ({lines_sql(doc_files_sql())})""")
def _(s, d):
    return O.text_windows(doc_files(s, d), 3).select("path", "line_no", "snippet")


@query("one_time_commits", f"WITH c AS ({ORDER_COMMITS}) SELECT repo, sha, author FROM c WHERE (repo, author) IN (SELECT (repo, author) FROM c GROUP BY repo, author HAVING count(*) = 1)")
def _(s, d):
    return Cm.one_time_commits(order_commits(s, d)).select("repo", "sha", "author")


@query("repo_marker", "SELECT source AS repo, bool_or(lang = 'de') AS is_git FROM documents GROUP BY source")
def _(s, d):
    folder = F.when(F.col("lang") == "de", ".git").otherwise(F.col("lang"))
    return Cm.repo_marker(documents(s, d).select(F.col("source").alias("repo"), F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("path")))


# --- roll-ups --------------------------------------------------------------------------------------------------------

@query("extension_stats", "SELECT '.' || lang AS ext, count(*) AS n_files FROM documents GROUP BY lang")
def _(s, d):
    return R.extension_stats(read_table(s, d, "documents").select(F.concat(F.lit("."), F.upper("lang")).alias("ext")))


@query("severity_counts", on_findings("""SELECT s AS severity, count(f.id) AS n FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) AS v(s)
  LEFT JOIN findings f ON f.severity = s GROUP BY s"""))
def _(s, d):
    return R.severity_counts(doc_findings(s, d))


@query("type_counts", on_findings("SELECT type, count(*) AS n FROM findings GROUP BY type"))
def _(s, d):
    return R.type_counts(doc_findings(s, d))


@query("analyzer_counts", on_findings("SELECT analyzer, count(*) AS n FROM findings GROUP BY analyzer"))
def _(s, d):
    return R.analyzer_counts(doc_findings(s, d))


@query("counts_grouping_sets", on_findings("SELECT severity, type, analyzer, count(*) AS n FROM findings GROUP BY GROUPING SETS ((severity), (type), (analyzer), ())"))
def _(s, d):
    return R.counts_grouping_sets(doc_findings(s, d))


@query("tag_set", on_findings("SELECT DISTINCT unnest(tags) AS tag FROM findings"))
def _(s, d):
    return R.tag_set(doc_findings(s, d))


@query("top_extensions", on_findings("SELECT '.txt' AS ext, count(*) AS n FROM findings"))
def _(s, d):
    return R.top_extensions(doc_findings(s, d))


@query("scan_metadata", on_findings("""SELECT 'scan' AS section, key, value FROM (VALUES ('scan_id', 'scan'), ('repository', 'corpus'),
    ('timestamp', '2024-06-01 00:00:00'), ('duration_seconds', '60.0'), ('enabled_analyzers', 'corpus,wording')) AS facts(key, value)
  UNION ALL SELECT 'totals', key, value FROM (SELECT count(*) AS f, (SELECT count(*) FROM findings) AS n FROM documents),
    LATERAL (VALUES ('file_count', CAST(f AS VARCHAR)), ('finding_count', CAST(n AS VARCHAR)),
      ('findings_per_file', CAST(n / f AS VARCHAR)), ('files_per_second', CAST(f / 60.0::DOUBLE AS VARCHAR))) AS rates(key, value)
  UNION ALL SELECT 'extension_stats', '.txt', CAST(count(*) AS VARCHAR) FROM documents
  UNION ALL SELECT 'severity_counts', s, CAST(count(f.id) AS VARCHAR) FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) AS v(s)
    LEFT JOIN findings f ON f.severity = s GROUP BY s
  UNION ALL SELECT 'type_counts', type, CAST(count(*) AS VARCHAR) FROM findings GROUP BY type
  UNION ALL SELECT 'analyzer_counts', analyzer, CAST(count(*) AS VARCHAR) FROM findings GROUP BY analyzer
  UNION ALL SELECT 'top_extensions', '.txt', CAST(count(*) AS VARCHAR) FROM findings
  UNION ALL SELECT DISTINCT 'tags', tag, tag FROM (SELECT unnest(tags) AS tag FROM findings)"""))
def _(s, d):
    start, end = F.to_timestamp(F.lit(AS_OF)), F.to_timestamp(F.lit("2024-06-01 00:01:00"))
    return R.scan_metadata(doc_files(s, d), doc_findings(s, d), scan_id="scan", repository="corpus", started_at=start, finished_at=end,
                           analyzers=("corpus", "wording"))


@query("findings_per_file", on_findings("""SELECT (SELECT count(*) FROM documents) AS n_files, (SELECT count(*) FROM findings) AS n_findings,
  round((SELECT count(*) FROM findings) / (SELECT count(*) FROM documents), 6) AS findings_per_file"""))
def _(s, d):
    return R.findings_per_file(documents(s, d), doc_findings(s, d)).withColumn("findings_per_file", F.round("findings_per_file", 6))


@query("files_per_second", "SELECT source, round(count(*) / nullif(sum(length(lang)) - 2 * count(*) + 30, 0), 6) AS rate FROM documents GROUP BY source")
def _(s, d):
    counts = read_table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), (F.sum(F.length("lang")) - 2 * F.count("*") + 30).alias("secs"))
    return counts.select("source", F.round(R.files_per_second(F.col("n"), F.col("secs")), 6).alias("rate"))


_PAGE_HITS = f"SELECT path, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(text, '[;&|]')) FROM ({page_files_sql()})) GROUP BY path"


@query("directory_rollup", f"""WITH h AS ({_PAGE_HITS}), a AS (SELECT array_to_string(string_split(path, '/')[1:i], '/') AS dir_path, n FROM h, unnest(range(0, len(string_split(path, '/')))) AS t(i))
  SELECT 'web' AS repo, dir_path, CASE WHEN dir_path = '' THEN 0 ELSE len(string_split(dir_path, '/')) END AS depth, CASE WHEN dir_path = '' THEN NULL WHEN contains(dir_path, '/')
  THEN regexp_replace(dir_path, '/[^/]*$', '') ELSE '' END AS parent, sum(n) AS issues, 'medium' AS worst_severity FROM a GROUP BY dir_path""")
def _(s, d):
    from vigilake.operators.findings import as_findings
    from vigilake.operators.matching import match_content, pack_entries

    rule = [e for e in pack_entries(WORDING) if e[0].rule_id == "DOC-SHELL"]
    found = as_findings(match_content(page_files(s, d), rule, keys=("repo", "path", "page_id")), WORDING)
    return R.directory_rollup(found)


@query("findings_by_file", on_findings("""SELECT repo, regexp_replace(path, '^src1/', '') AS path, count(*) AS n, count(*) FILTER (severity = 'low') AS n_low,
  count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'critical') AS n_critical,
  arg_max(severity, severity_rank) AS worst_severity FROM findings GROUP BY 1, 2"""))
def _(s, d):
    return R.findings_by_file(doc_findings(s, d), "src1")


@query("worst_severity", on_findings("SELECT repo, path, arg_max(severity, severity_rank) AS worst_severity FROM findings GROUP BY ALL"))
def _(s, d):
    return R.worst_severity(doc_findings(s, d))


_TOTALS = """SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (type = 'secret') AS secrets FROM findings"""


@query("risk_level", on_findings(f"SELECT total, critical, high, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN total > 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM ({_TOTALS})"))
def _(s, d):
    return R.risk_level(doc_findings(s, d))


@query("recommendations", on_findings(f"""SELECT row_number() OVER (ORDER BY o) - 1 AS ordinal, r AS recommendation FROM (
  SELECT 1 AS o, 'Address critical/high issues first' AS r FROM ({_TOTALS}) WHERE critical > 0 OR high > 0 UNION ALL
  SELECT 2, 'Rotate exposed secrets' FROM ({_TOTALS}) WHERE secrets > 0 UNION ALL SELECT 3, 'Consider automated CI/CD checks' FROM ({_TOTALS}) WHERE total > 10)"""))
def _(s, d):
    return R.recommendations(doc_findings(s, d))


@query("top_types", on_findings("SELECT type, upper(left(type, 1)) || substr(type, 2) AS label, count(*) AS n FROM findings GROUP BY type ORDER BY n DESC, type LIMIT 2"))
def _(s, d):
    return R.top_types(doc_findings(s, d))


@query("top_files", on_findings("SELECT repo, path, count(*) AS n FROM findings GROUP BY ALL ORDER BY n DESC, repo, path LIMIT 2"))
def _(s, d):
    return R.top_files(doc_findings(s, d))


@query("exit_status", on_findings("SELECT CASE WHEN max(severity_rank) >= 2 THEN 1 ELSE 0 END AS exit_status FROM findings"))
def _(s, d):
    return R.exit_status(doc_findings(s, d))


@query("urgent_findings", on_findings("""SELECT id, rule_id, severity, path, line_start, (SELECT greatest(count(*) - 5, 0) FROM findings WHERE severity_rank >= 2) AS remaining
  FROM findings WHERE severity_rank >= 2 ORDER BY severity_rank DESC, path, line_start, rule_id, id LIMIT 5"""))
def _(s, d):
    return R.urgent_findings(doc_findings(s, d))


@query("contributor_counts", f"SELECT repo, author, count(*) AS n_commits FROM ({ORDER_COMMITS}) GROUP BY repo, author")
def _(s, d):
    return Cm.contributor_counts(order_commits(s, d))


@query("one_time_contributors", f"SELECT repo, author, max(sha) AS sha FROM ({ORDER_COMMITS}) GROUP BY repo, author HAVING count(*) = 1")
def _(s, d):
    return Cm.one_time_contributors(order_commits(s, d))


@query("large_commits", f"""WITH n AS (SELECT repo, sha, count(*) AS files_changed FROM ({COMMIT_FILES}) GROUP BY repo, sha HAVING count(*) > 5)
  SELECT repo, sha, author, files_changed FROM ({ORDER_COMMITS}) JOIN n USING (repo, sha) WHERE n_parents > 0""")
def _(s, d):
    return Cm.large_commits(order_commits(s, d), commit_files(s, d), 5).select("repo", "sha", "author", "files_changed")


@query("large_binaries", f"SELECT repo, sha, path, size FROM ({COMMIT_FILES}) WHERE NOT deleted AND size > 60000 AND sha IN (SELECT sha FROM ({ORDER_COMMITS}) WHERE n_parents > 0)")
def _(s, d):
    return Cm.large_binaries(order_commits(s, d), commit_files(s, d), 60000).select("repo", "sha", "path", "size")


def _branches(s, d):
    return read_table(s, d, "part").select(F.col("p_brand").alias("repo"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("name"))


_BRANCHES = "SELECT p_brand AS repo, p_name || '-' || p_partkey AS name FROM part"


@query("suspicious_branches", f"SELECT repo, name FROM ({_BRANCHES}) WHERE regexp_matches(lower(name), 'ring|blue')")
def _(s, d):
    return Cm.suspicious_branches(_branches(s, d), ("ring", "blue"))


@query("suspicious_branch_counts", f"SELECT repo, count(*) FILTER (regexp_matches(lower(name), 'ring|blue')) AS n_suspicious, count(*) AS total_branches FROM ({_BRANCHES}) GROUP BY repo")
def _(s, d):
    return Cm.suspicious_branch_counts(_branches(s, d), ("ring", "blue"))


@query("stale_branches", f"""SELECT repo, author AS name, CAST(floor((epoch(TIMESTAMP '2001-01-01') - epoch(max(committed_at))) / 86400) AS BIGINT) AS days_inactive
  FROM ({ORDER_COMMITS}) GROUP BY repo, author HAVING epoch(TIMESTAMP '2001-01-01') - epoch(max(committed_at)) > 180 * 86400""")
def _(s, d):
    branches = order_commits(s, d).select("repo", F.col("author").alias("name"), F.col("committed_at").alias("last_commit_at"))
    return Cm.stale_branches(branches, F.to_timestamp(F.lit("2001-01-01"))).select("repo", "name", "days_inactive")


@query("night_commits", f"SELECT sha, author FROM ({EVENT_COMMITS}) WHERE hour(committed_at) >= 22 OR hour(committed_at) < 6")
def _(s, d):
    return Cm.night_commits(event_commits(s, d)).select("sha", "author")


@query("sbom_components", f"SELECT DISTINCT 'library' AS type, name, version, ecosystem, 'pkg:' || ecosystem || '/' || name || '@' || version AS purl, 'required' AS scope FROM ({PART_PACKAGES})")
def _(s, d):
    return A.sbom_components(part_packages(s, d))


# --- windows, orders, sets ---------------------------------------------------------------------------------------------

@query("number_findings", on_findings("SELECT id, severity, row_number() OVER (PARTITION BY severity ORDER BY path, line_start, column_start, rule_id, id) AS ordinal FROM findings"))
def _(s, d):
    return O.number_findings(doc_findings(s, d)).select("id", "severity", "ordinal")


@query("recent_commits", f"SELECT repo, sha FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY committed_at DESC, sha DESC) AS n FROM ({EVENT_COMMITS})) WHERE n <= 100")
def _(s, d):
    return Cm.recent_commits(event_commits(s, d), 100).select("repo", "sha")


@query("latest_per_branch", f"SELECT repo, author AS branch, sha FROM (SELECT *, row_number() OVER (PARTITION BY repo, author ORDER BY committed_at DESC, sha DESC) AS n FROM ({ORDER_COMMITS})) WHERE n = 1")
def _(s, d):
    return Cm.latest_per_branch(order_commits(s, d).withColumnRenamed("author", "branch")).select("repo", "branch", "sha")


@query("sort_by_severity", on_findings("SELECT id, severity FROM findings ORDER BY severity_rank DESC, path, line_start, column_start, rule_id, id"))
def _(s, d):
    return O.sort_by_severity(doc_findings(s, d)).select("id", "severity")


@query("top_k", on_findings("SELECT path, count(*) AS n FROM findings GROUP BY path ORDER BY n DESC, path LIMIT 10"))
def _(s, d):
    counts = doc_findings(s, d).groupBy(F.col("location.path").alias("path")).agg(F.count("*").alias("n"))
    return O.top_k(counts, "n", 10, "path")


@query("limit_references", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS refs FROM documents")
def _(s, d):
    rows = documents(s, d).select("doc_id", F.split("text", " ", -1).alias("references"))
    return A.limit_references(rows).select("doc_id", F.array_join("references", " ").alias("refs"))


@query("analyzer_ranking", on_findings("SELECT analyzer, n, row_number() OVER (ORDER BY n DESC, analyzer) AS rank FROM (SELECT analyzer, count(*) AS n FROM findings GROUP BY analyzer)"))
def _(s, d):
    return O.analyzer_ranking(doc_findings(s, d))


@query("union_findings", on_findings("SELECT id, path FROM findings UNION ALL SELECT id, path FROM findings WHERE severity = 'medium'"))
def _(s, d):
    found = doc_findings(s, d)
    return S.union_findings(found, found.where(F.col("severity") == "medium")).select("id", F.col("location.path").alias("path"))


@query("union_includes", f"{FILES} SELECT path FROM files WHERE regexp_matches(path, '^src1') UNION ALL SELECT path FROM files WHERE contains(path, '/en/')")
def _(s, d):
    return Fi.union_includes(doc_files(s, d), ["src1*", "*/en/*"], dedupe=False).select("path")


@query("except_excludes", f"{FILES} SELECT path FROM files WHERE NOT contains(path, '/en/') AND NOT regexp_matches(path, '^src1')")
def _(s, d):
    return Fi.except_excludes(doc_files(s, d), ["*/en/*", "src1*"]).select("path")


@query("distinct_packages", f"SELECT DISTINCT name, version, ecosystem FROM ({PART_PACKAGES})")
def _(s, d):
    return Pk.distinct_packages(part_packages(s, d))


@query("dedupe_findings", on_findings("SELECT rule_id, path, line_start, column_start FROM findings"))
def _(s, d):
    found = doc_findings(s, d)
    rows = S.dedupe_findings(found.unionByName(found))
    return rows.select("rule_id", F.col("location.path").alias("path"), F.col("location.line_start").alias("line_start"), F.col("location.column_start").alias("column_start"))


@query("diff_scans", on_findings("SELECT id, severity, CASE WHEN severity IN ('critical', 'high') THEN 'fixed' WHEN severity = 'low' THEN 'new' ELSE 'unchanged' END AS status FROM findings"))
def _(s, d):
    found = doc_findings(s, d)
    old = found.where(F.col("severity") != "low")
    new = found.where(F.col("severity").isin("low", "medium"))
    return S.diff_scans(old, new).select("id", "severity", "status")


_AT = "TIMESTAMP '2001-01-01'"


@query("history_findings", f"""WITH c AS ({ORDER_COMMITS}), f AS ({COMMIT_FILES}), b AS ({_BRANCHES}),
  m(repo, rule_id, severity, matched_text) AS (
  SELECT repo, 'COMMIT-BINARY', 'medium', sha || ': ' || path FROM f WHERE NOT deleted AND size * 200 > {LARGE_BINARY_BYTES} AND sha IN (SELECT sha FROM c WHERE n_parents > 0)
  UNION ALL SELECT repo, 'COMMIT-NIGHT', 'low', CAST(sha AS VARCHAR) FROM c WHERE hour(committed_at) >= 22 OR hour(committed_at) < 6
  UNION ALL SELECT repo, 'COMMIT-ONE-TIME', 'low', CAST(count(*) AS VARCHAR) FROM (SELECT repo, author FROM c GROUP BY repo, author HAVING count(*) = 1) GROUP BY repo
  UNION ALL SELECT repo, 'BRANCH-NAME', 'low', count(*) FILTER (regexp_matches(lower(name), 'temp|hidden|hack|exploit|malware|bypass|backdoor')) || ' of ' || count(*) FROM b GROUP BY repo
    HAVING count(*) FILTER (regexp_matches(lower(name), 'temp|hidden|hack|exploit|malware|bypass|backdoor')) > 0
  UNION ALL SELECT repo, 'BRANCH-STALE', 'low', CAST(count(*) AS VARCHAR) FROM (SELECT p_brand AS repo, p_name || '-' || p_partkey AS name FROM part
    WHERE epoch({_AT}) - epoch(TIMESTAMP '2000-01-01' + to_days(CAST(p_partkey % 366 AS INTEGER))) > 180 * 86400) GROUP BY repo)
  SELECT 'MET-' || sha256('metadata:' || repo || ':' || repo || ':N/A:' || rule_id || '@' || matched_text) AS id, * FROM m""")
def _(s, d):
    last = F.to_timestamp(F.lit("2000-01-01 00:00:00")) + F.make_interval(days=(F.col("p_partkey") % 366).cast("int"))
    branches = read_table(s, d, "part").select(
        F.col("p_brand").alias("repo"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("name"), last.alias("last_commit_at"))
    # prices stand for sizes: made larger, so that some are over the limit
    files = commit_files(s, d).withColumn("size", F.col("size") * 200)
    found = history_findings(History(order_commits(s, d), files, branches), F.to_timestamp(F.lit("2001-01-01 00:00:00")), "very_high")
    return found.select("id", "repo", "rule_id", "severity", F.col("metadata")["matched_text"].alias("matched_text"))


__all__ = ["FINDINGS_CTE", "lines_sql", "rules_table"]
