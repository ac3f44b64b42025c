"""What large inputs need: one search for many literals, one reading of findings, tasks that follow the rows."""

from pyspark.sql import functions as F

from vigilake.functions.patterns import MARK, any_literal
from vigilake.operators import advisories as A, ordering as O, rollups as R
from vigilake.operators.findings import as_findings
from vigilake.operators.matching import match_content, match_lines
from vigilake.rules.model import Pack, Rule
from vigilake.session import ROWS_PER_TASK, salted_join, spread_rows
from vigilake.sources import stores

LITERALS = ["exec", "execute", "token = \"", "a.b", "\\x", "-----begin", "é", "zz"]
PACK = Pack("p", "p", (
    Rule("R1", "t", "high", "secret", r"token=\d+", ""),
    Rule("R2", "t", "low", "secret", r"[;&|]", ""),
    Rule("R3", "t", "low", "secret", r"run\s+x", "i"),
))


def test_many_literals_are_found_in_one_search(spark):
    texts = [f"..{x}.." for x in LITERALS] + LITERALS + ["", "exe c", "axb", "token = '", "----begin", "z z", "e", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.rlike("t", F.lit(any_literal(LITERALS))).alias("hit")).collect()
    assert {r.t: r.hit for r in rows} == {t: any(x in t for x in LITERALS) for t in texts}


def test_matches_and_gaps_of_one_search(spark):
    text = f"a; token=1 & token=22\nRUN \n x{MARK}; run x\n|"
    files = spark.createDataFrame([("f", text), ("g", None), ("h", "")], "path string, text string")
    rows = match_content(files, PACK).collect()
    assert sorted((r.rule_id, r.line_start, r.column_start, r.matched_text) for r in rows) == [
        ("R1", 1, 4, "token=1"), ("R1", 1, 14, "token=22"), ("R2", 1, 2, ";"), ("R2", 1, 12, "&"), ("R2", 3, 4, ";"), ("R2", 4, 1, "|"),
        ("R3", 2, 1, "RUN \n x"), ("R3", 3, 6, "run x"),
    ]
    lines = match_lines(files, PACK).collect()
    assert sorted((r.rule_id, r.line_start, r.column_start) for r in lines) == [
        ("R1", 1, 3), ("R1", 1, 13), ("R2", 1, 1), ("R2", 1, 11), ("R2", 3, 3), ("R2", 4, 0), ("R3", 3, 5),
    ]


def test_texts_are_not_copied_to_every_place(spark):
    files = spark.createDataFrame([("f", "a; b")], "path string, text string")
    plan = match_lines(files, PACK).select("path", "rule_id")._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate" in line]
    assert generated and not any("_lines" in line for line in generated)


def test_shared_intervals_are_compared_once(spark):
    packages = spark.createDataFrame([("pypi", "a", f"1.{i}", "f", i) for i in range(4)], "ecosystem string, name string, version string, file_path string, line_number int")
    rows = [(f"A{i}", "PyPI", "a", [("1.1", "1.3")] * (1 + i % 2)) for i in range(5)]
    advisories = spark.createDataFrame(rows, "id string, ecosystem string, name string, affected array<struct<introduced:string,fixed:string>>").select(
        "*", *[F.lit(None).cast(t).alias(c) for c, t in (("summary", "string"), ("severity", "string"), ("cvss_score", "double"),
               ("fixed_version", "string"), ("references", "array<string>"), ("published", "timestamp"), ("modified", "timestamp"))],
    )
    found = A.join_advisories(packages, advisories)
    assert sorted((r.version, r.advisory_id) for r in found.collect()) == [(v, f"A{i}") for v in ("1.1", "1.2") for i in range(5)]
    assert A.join_advisories(packages, advisories, "any").count() == 4 * 5
    # rows that are not hot are not copied to every salt
    assert "_hot" in found._jdf.queryExecution().analyzed().toString()


def test_only_hot_keys_are_dealt(spark):
    big = spark.createDataFrame([("hot", i) for i in range(20)] + [("cold", 100), (None, 101)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3), (None, 4)], "k string, v int")
    joined = salted_join(big, small, ["k"], ["i"], hot_rows=5)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, big.join(small, "k").collect()))


def test_tasks_follow_the_rows(spark):
    rows = spark.range(4 * ROWS_PER_TASK + 1)
    assert spread_rows(rows, "id").rdd.getNumPartitions() >= 5
    assert spread_rows(rows, "id").count() == 4 * ROWS_PER_TASK + 1


def test_ranges_follow_the_rows_when_numbering(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_SORT", 10)
    df = spark.createDataFrame([("g" if i % 3 else "h", i) for i in range(300)], "g string, v int").repartition(7)
    rows = O.number_rows(df, ["g"], [F.desc("v")])
    for g, want in (("g", [i for i in range(299, -1, -1) if i % 3]), ("h", list(range(297, -1, -3)))):
        assert [(r.v, r.ordinal) for r in rows.where(F.col("g") == g).orderBy("ordinal").collect()] == [(v, n) for n, v in enumerate(want, 1)]


def test_reports_find_their_findings_once(spark):
    files = spark.range(3).select(F.concat(F.lit("d/f.txt"), "id").alias("path"), F.lit(".txt").alias("ext"), F.lit("a; token=1").alias("text"))
    found = as_findings(match_lines(files, PACK), PACK, created_at=F.to_timestamp(F.lit("2024-01-01")))
    at = F.to_timestamp(F.lit("2024-01-01"))
    told = R.scan_metadata(files, found, scan_id="s", repository="r", started_at=at, finished_at=at)
    for report in (told, stores.text_report(found)):
        assert "rlike" not in report._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {(r.key, r.value) for r in told.where("section = 'severity_counts'").collect()} == {("high", "3"), ("low", "3"), ("medium", "0"), ("critical", "0")}
