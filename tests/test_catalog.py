"""Catalog queries against DuckDB. All of them run with CATALOG=all, a cross-section without."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = (
    "decode_text", "explode_lines", "packages_requirements", "packages_cargo", "flatten_documents", "filter_globs", "filter_findings", "pack_python",
    "pack_shell", "pack_crypto_wallet", "pack_dockerfile", "pack_jailbreak", "invisible_characters", "entropy", "k8s_checks", "join_advisories",
    "snippet_window", "directory_rollup", "number_findings", "large_commits", "dedupe_findings", "version_matches", "incremental_scan",
    "stream_new_files", "stream_finding_counts", "error_findings", "append_cache", "compact_cache", "cache_misses_by_time",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CATALOG") == "all" else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return connection


def plain(value):
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sql, name):
    df = entry.queries()[name](spark, DIR)
    expected = sql.sql(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table(expected.columns, expected.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
