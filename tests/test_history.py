"""Findings of commit histories, alone and as a part of a scan."""

import datetime
import json

from pyspark.sql import functions as F

from vigilake.operators.advisories import load_advisories
from vigilake.operators.filters import ScanConfig
from vigilake.plans.history import History, history_findings
from vigilake.plans.scan import scan
from vigilake.sources.files import files_from_table

def now():
    return F.to_timestamp(F.lit("2024-06-01 12:00:00"))


def history(spark):
    noon, night = datetime.datetime(2024, 5, 1, 12), datetime.datetime(2024, 5, 1, 23)
    commits = spark.createDataFrame([
        ("r1", "c1", "ann", noon, 0, "start"), ("r1", "c2", "ann", noon, 1, "password=hunter22"), ("r1", "c3", "bob", night, 1, ""),
        ("r2", "c1", "ann", noon, 1, None), ("r2", "c4", "ann", noon, 1, "x"),
    ], "repo string, sha string, author string, committed_at timestamp, n_parents int, message string")
    files = spark.createDataFrame(
        [("r1", "c2", f"f{i}", 10, False) for i in range(1001)] + [("r1", "c3", "big.bin", 20 << 20, False), ("r1", "c3", "gone.bin", 20 << 20, True), ("r1", "c1", "root.bin", 20 << 20, False)],
        "repo string, sha string, path string, size long, deleted boolean")
    branches = spark.createDataFrame([("r1", "main", noon), ("r1", "hack-it", noon), ("r2", "old", datetime.datetime(2023, 1, 1)), ("r2", "none", None)],
                                     "repo string, name string, last_commit_at timestamp")
    return History(commits, files, branches)


def told(found):
    return sorted((r.repo, r.rule_id, r.metadata["matched_text"]) for r in found.collect())


BINARY, SECRET = ("r1", "COMMIT-BINARY", "c3: big.bin"), ("r1", "COMMIT-password", "c2: password=hunter22")
LARGE, STALE = ("r1", "COMMIT-LARGE", "c2: 1001 files"), ("r2", "BRANCH-STALE", "1")
REST = [("r1", "BRANCH-NAME", "1 of 2"), ("r1", "COMMIT-NIGHT", "c3"), ("r1", "COMMIT-ONE-TIME", "1")]


def test_findings_by_sensitivity(spark):
    every = told(history_findings(history(spark), now(), "very_high"))
    assert every == sorted([BINARY, SECRET, LARGE, STALE, *REST])
    assert told(history_findings(history(spark), now(), "high")) == sorted([BINARY, SECRET, LARGE, STALE])
    assert told(history_findings(history(spark), now(), "normal")) == sorted([BINARY, SECRET])
    assert history_findings(history(spark), now(), "low") is None and history_findings(History(), now()) is None
    rows = history_findings(history(spark), now(), "very_high").collect()
    assert len({r.id for r in rows}) == len(rows) and {r.analyzer for r in rows} == {"metadata"} and all(r.location.path == r.repo for r in rows)


def test_scan_takes_in_histories_and_advisories(spark):
    df = spark.createDataFrame([("r1", "requirements.txt", "requests==1.0\n"), ("r1", "notes.txt", "nothing")], "r string, p string, t string")
    files = files_from_table(df, path=F.col("p"), text=F.col("t"), repo=F.col("r"))
    plain = {r.id for r in scan(files).collect()}
    whole = scan(files, ScanConfig(sensitivity="high"), history=history(spark), as_of=now()).collect()
    assert {r.rule_id for r in whole} >= {"COMMIT-BINARY", "COMMIT-LARGE", "COMMIT-password", "BRANCH-STALE"} and plain <= {r.id for r in whole}
    advisory = json.dumps({"id": "A1", "summary": "s", "affected": [{"package": {"name": "requests", "ecosystem": "PyPI"}, "ranges": [
        {"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2.0"}]}]}]})
    known = load_advisories(spark.createDataFrame([(advisory,)], "value string"))
    found = scan(files, advisories=known).where("rule_id = 'VULNERABLE-DEPENDENCY'").collect()
    assert [(r.repo, r.location.path, r.location.line_start) for r in found] == [("r1", "requirements.txt", 1)]
    low = scan(files, ScanConfig(sensitivity="high", min_severity="medium"), history=history(spark), as_of=now()).collect()
    assert {r.rule_id for r in low} >= {"COMMIT-LARGE"} and "BRANCH-STALE" not in {r.rule_id for r in low}
