"""Nearest neighbours, URL filters and the pipeline against plain Python."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DIR
from vigilake.llm import nearest, url_filter


def exact_nearest(vectors, query, k):
    rows = sorted((float(np.sqrt(((np.array(v) - vectors[query]) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return [i for _, i in rows[:k]]


def test_recall_on_the_table(spark, tables):
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in tables("embeddings").collect()}
    rows = nearest.nearest(tables("embeddings"), every=20, k=10).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
        assert r.score == pytest.approx(float(np.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum())), abs=1e-12)
    asked = [i for i in vectors if i % 20 == 0]
    assert sorted(found) == sorted(asked) and all(sorted(f) == list(range(1, 11)) for f in found.values())
    hits = sum(len(set(found[q].values()) & set(exact_nearest(vectors, q, 10))) for q in asked)
    assert hits >= 0.9 * 10 * len(asked)


def test_scan_gives_up_no_near_candidate():
    rng = np.random.default_rng(1)
    columns = rng.normal(size=(64, 5000))
    missed = 0
    for _ in range(50):
        q = columns[:, int(rng.integers(0, 5000))] + rng.normal(size=64) * 0.3
        best = set(np.argsort(((columns - q[:, None]) ** 2).sum(0))[:10])
        near = set(nearest.adaptive_scan(q, columns, 10).tolist())
        missed += len(best - near)
        assert len(near) < 2500
    assert missed <= 5


def test_ties_and_odd_vectors(spark):
    one, inf, nan = [1.0, 0.0], [float("inf"), 0.0], [float("nan"), 1.0]
    rows = [(0, one), (100, [0.0, 1.0]), (3, one), (2, one), (1, one), (4, None), (5, [0.0, 0.0]), (6, inf), (7, nan), (8, [None, 1.0]), (None, one), (9, [1.0]), (3, one)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest.nearest(df, k=3).collect()}
    assert [out[0, i] for i in (1, 2, 3)] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert [out[100, i][0] for i in (1, 2, 3)] == [0, 1, 2] and len(out) == 6
    assert nearest.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, one), (1, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest.nearest(few).collect()] == [(0, 1, 1, 1.0)]


def test_rows_that_repeat_the_query_take_no_neighbours_place(spark):
    rng = np.random.default_rng(7)
    rows = [(0, [1.0, 0.0, 0.0])] * 40 + [(i, rng.normal(size=3).tolist()) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nearest.nearest(df, k=10, lists=2, probes=2, doubt=None).orderBy("rank").collect()
    assert [r.vec_id for r in out] == exact_nearest({i: np.array(v) for i, v in rows}, 0, 10)


def test_all_lists_without_doubt_are_exact(spark):
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=48) for i in range(400)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    rows = nearest.nearest(df, every=20, k=10, lists=8, probes=8, doubt=None).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in rows] == [i for q in range(0, 400, 20) for i in exact_nearest(vectors, q, 10)]


def test_large_lists_are_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_VECTORS", 50)
    monkeypatch.setattr(nearest, "CELL_SEARCHES", 3)
    rng = np.random.default_rng(3)
    vectors = {i: (np.ones(8) if i % 3 == 0 else rng.normal(size=8)) for i in range(600)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    rows = nearest.nearest(df, every=20, k=5, lists=4, probes=4).collect()
    for q in (0, 20, 40):
        assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] == exact_nearest(vectors, q, 5)


def test_hosts_paths_and_keys(spark):
    urls = ["HTTP://u:p@WWW.A.B.com.:80/x/y?q#f", "a.b.com", "//a.com/#x", "", None, "https:///x", "http://h/a//b/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.url_host(F.col("u")).alias("h"), url_filter.url_path(F.col("u")).alias("p"))
    assert [tuple(r) for r in df.collect()] == [("a.b.com", "/x/y"), ("a.b.com", "/"), ("a.com", "/"), (None, "/"), (None, None), (None, "/x"), ("h", "/a//b/")]
    keys = df.limit(1).select(url_filter.candidate_keys("h", "p").alias("k")).first().k
    assert keys == ["a.b.com", "b.com", "com", "a.b.com/x", "a.b.com/x/y"]


def test_as_of_verdicts(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    entries = spark.createDataFrame([
        ("l", "b.com", "block", day(10)), ("l", "b.com", "block", day(10)), ("l", "b.com", "remove", day(100)), ("l", "b.com", "block", day(200)),
        ("l", "a.b.com", "allow", day(50)), ("m", "a.b.com", "block", day(60)), ("m", "a.b.com", "remove", day(60)), ("l", None, "block", day(1)),
    ], "list string, key string, verdict string, dated timestamp")
    times = [0, 10, 49, 50, 99, 100, 200]
    captures = spark.createDataFrame([(i, "http://a.b.com/x", day(n), "clash") for i, n in enumerate(times)] + [(90, None, day(20), ""), (91, "http://b.com", None, ""), (0, "http://a.b.com/x", day(0), "")],
                                     "capture_id long, url string, fetched_at timestamp, key string")
    out = {r.capture_id: (r.verdict, r.n_active) for r in url_filter.judge_captures(captures, entries).collect()}
    assert [out[i] for i in range(7)] == [("none", 0), ("block", 1), ("block", 1), ("allow", 2), ("allow", 2), ("allow", 1), ("allow", 2)]
    assert out[90] == out[91] == ("none", 0)
    assert {r.verdict for r in url_filter.judge_captures(captures, entries.limit(0)).collect()} == {"none"}
    assert url_filter.judge_captures(captures.limit(0), entries).count() == 0


def test_pipeline(spark, tables):
    import corpus_pipeline
    import sentencepiece

    docs, seen = tables("documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs)
    before = tables("documents")
    assert [d.columns for d in seen[:4]] == [before.columns] * 4
    bad = {r.doc_id for r in tables("labels").where("quality = 0").collect()}
    good = {r.doc_id for r in tables("labels").where("quality = 1").collect()}
    kept = {r.doc_id for r in seen[0].collect()}
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.15 * len(bad)
    assert seen[1].count() == seen[0].select("text").distinct().count()
    mixed = {r.doc_id for r in seen[3].collect()}
    assert mixed <= {r.doc_id for r in seen[2].collect()} <= {r.doc_id for r in seen[1].collect()}
    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    texts = {r.doc_id: r.text for r in seen[3].collect()}
    assert all(r.ids == library.encode(texts[r.doc_id] or "") and r.n_pieces == len(r.ids) for r in seen[4].collect())
