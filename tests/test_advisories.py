"""The advisory join against plain comparisons."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vigilake.operators import advisories as A
from vigilake.schemas import FINDINGS
from vigilake.session import join_tasks

PACKAGE = "name string, version string, ecosystem string, file_path string, line_number int"
ADVISORY = (
    "id string, ecosystem string, name string, summary string, severity string, cvss_score double, fixed_version string, "
    "references array<string>, published timestamp, modified timestamp, "
    "affected array<struct<introduced:string,fixed:string,last_affected:string>>, versions array<string>"
)
VERSIONS = [
    "0", "0.0", "0.9", "1", "1.0", "1.0.0", "1.0.1", "1.2", "1.10", "1.9.9", "2", "2.0rc1", "2.0.0-beta", "10.0", "010.1", "9" * 30,
    "1." + "0" * 40 + "7", "1234567890.1", "12345678.1", "", "x", "1.x", " 1.2 ", "v1.0", "é", "1." + "1" * 70, "1." + "1" * 69 + "2", "1..2", "~1.0",
]


def advisories(spark, *items):
    rows = [(i, "PyPI", n, "s", "x", 1.0, None, [], None, None, a, v) for i, n, a, v in items]
    return spark.createDataFrame(rows, ADVISORY)


def packages(spark, *versions, name="p"):
    return spark.createDataFrame([(name, v, "pypi", "f", i) for i, v in enumerate(versions)], PACKAGE)


def key(version):
    parts = [p.strip(" ") for p in version.split(".")]
    if not all(p and all(c in "0123456789" for c in p) for p in parts):
        return None
    numbers = [int(p) for p in parts]
    while numbers and not numbers[-1]:
        numbers.pop()
    return numbers


def at_least(version, bound):
    a, b = key(version), key(bound)
    return a >= b if a is not None and b is not None else version.encode() >= bound.encode()


def holds(version, low, high, last, mode):
    below = last is None or version == last or not at_least(version, last)
    if mode == "any":
        return below and ((low is not None and at_least(version, low)) or (high is not None and not at_least(version, high)))
    above = low is None or low == "0" or at_least(version, low)
    return (low is not None or high is not None) and above and (high is None or not at_least(version, high)) and below


@pytest.mark.parametrize("mode", ["interval", "any"])
def test_every_pair_as_plain_comparison(spark, mode):
    bounds = [(a, b, None) for a, b in itertools.product([None, *VERSIONS], repeat=2)]
    draw = random.Random(7)
    bounds += [(draw.choice([None, *VERSIONS]), draw.choice([None, None, *VERSIONS]), draw.choice(VERSIONS)) for _ in range(150)]
    adv = advisories(spark, *[(str(i), "p", [b], []) for i, b in enumerate(bounds)])
    got = {(r.version, int(r.advisory_id)) for r in A.join_advisories(packages(spark, *VERSIONS), adv, mode).collect()}
    expected = {(v, i) for v in VERSIONS for i, b in enumerate(bounds) if holds(v, *b, mode)}
    assert got == expected


def test_tiles_are_disjoint(spark):
    # a version meets an interval once, so nothing has to be removed afterwards
    rows = [(a, b, v) for a, b in itertools.product(["0.9", "1.0.1", "1.10", "2", "10.0"], repeat=2) for v in ("0.95", "1.0.1", "1.5", "1.10", "3", "10.0")]
    low, high, version = (A.sort_text(F.col(c)) for c in ("low", "high", "v"))
    df = spark.createDataFrame(rows, "low string, high string, v string").withColumn("tiles", A._cover(low, high, A._fork(low, high), "n"))
    df = df.select("*", F.size(F.filter(A._starts(version, "n"), lambda x: F.array_contains("tiles", x))).alias("n"))
    for r in df.collect():
        assert r.n == (key(r.low) <= key(r.v) <= key(r.high)), r
        assert len(r.tiles) == len(set(r.tiles)) <= 16 * 2 * 16


def test_odd_advisories(spark):
    adv = advisories(
        spark, ("listed", "p", [], ["1.0", "1.0"]), ("listed-too", "p", None, ["3"]), ("nothing", "p", [], None), ("no bound", "p", [(None, None, None)], []),
        ("twice", "p", [("0", None, None), ("1", "2", None)], ["1.0"]), ("twice", "p", [("0", "9", None)], []), ("other", "q", [("0", None, None)], []),
        (None, "p", [("2", None, None)], []),
    )
    got = sorted((r.version, str(r.advisory_id)) for r in A.join_advisories(packages(spark, "1.0", "3", None, "1.0"), adv).collect())
    assert got == [("1.0", "listed")] * 2 + [("1.0", "twice")] * 2 + [("3", "None"), ("3", "listed-too"), ("3", "twice")]
    assert A.join_advisories(packages(spark, "1.0").where("false"), adv).count() == 0
    assert A.join_advisories(packages(spark, "1.0"), adv.where("false")).count() == 0


def test_package_of_very_many_versions(spark):
    # 60,000 versions and 6,000 short intervals: 360 million pairs, of which 60,000 hold
    versions = spark.range(60_000).select(
        F.lit("hot").alias("name"), F.concat_ws(".", F.floor(F.col("id") / 1000).cast("string"), (F.col("id") % 1000).cast("string")).alias("version"),
        F.lit("pypi").alias("ecosystem"), F.lit("f").alias("file_path"), F.col("id").cast("int").alias("line_number"),
    )
    edge = F.concat_ws(".", F.floor(F.col("id") / 100).cast("string"), (F.col("id") % 100 * 10).cast("string"))
    upto = F.concat_ws(".", F.floor(F.col("id") / 100).cast("string"), (F.col("id") % 100 * 10 + 10).cast("string"))
    none = F.lit(None).cast("timestamp")
    adv = spark.range(6_000).select(
        F.col("id").cast("string").alias("id"), F.lit("PyPI").alias("ecosystem"), F.lit("hot").alias("name"), F.lit("s").alias("summary"), F.lit("x").alias("severity"),
        F.lit(1.0).alias("cvss_score"), upto.alias("fixed_version"), F.array().cast("array<string>").alias("references"), none.alias("published"), none.alias("modified"),
        F.array(F.struct(edge.alias("introduced"), upto.alias("fixed"))).alias("affected"),
    )
    hits = A.join_advisories(versions, adv)
    assert hits.count() == 60_000
    assert hits.where(F.col("advisory_id").cast("int") != F.floor(F.col("line_number") / 10)).count() == 0


def test_advisories_of_one_class(spark):
    # advisories that affect the same versions are compared once and all come back; the order of ranges and rows does not matter
    a, b = ("1", "2", None), ("3", "4", None)
    adv = advisories(
        spark, ("x", "p", [a, b], ["9"]), ("y", "p", [b, a, a], ["9"]), ("z", "p", [a], []), ("z", "p", [b], ["9", "9"]), ("other", "p", [a], []),
        (None, "p", [b, a], ["9"]), ("x", "q", [a], []),
    )
    got = sorted((r.version, str(r.advisory_id)) for r in A.join_advisories(packages(spark, "1.5", "3.5", "9", "2.5"), adv).collect())
    same = ["None", "x", "y", "z"]
    assert got == sorted([("1.5", "other"), *((v, i) for v in ("1.5", "3.5", "9") for i in same)])


def test_hits_keep_their_tasks(spark):
    # few bytes of versions and classes give very many rows, so Spark must not put the tasks together by their bytes
    adv = advisories(spark, *[(str(i), "p", [("1", "2", None)], []) for i in range(20)])
    hits = A.join_advisories(packages(spark, *[f"1.{i}" for i in range(200)]), adv)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert f"{join_tasks(spark)}), REPARTITION_BY_NUM" in plan
    assert hits.count() == 4000


def test_findings_are_not_built_per_row(spark):
    # titles come with the packages, and a place is taken from its columns without building the struct it lies in
    adv, declared = advisories(spark, ("x", "p", [("1", "2", None)], [])), packages(spark, "1.5")
    found = A.dependency_findings(A.join_advisories(A.with_finding_titles(declared), adv))
    plain = A.dependency_findings(A.join_advisories(declared, adv))
    drop = ["created_at"]
    assert found.drop(*drop).collect() == plain.drop(*drop).collect() and found.columns == plain.columns
    assert [f.dataType.simpleString() for f in found.schema] == [f.dataType.simpleString() for f in FINDINGS]
    plan = found.select("location.path", "title")._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(path" not in plan
    # the title is joined before the packages meet the advisories: below the join, not in the uppermost projection
    assert "Vulnerable dependency" not in plan.split("Join", 1)[0]
