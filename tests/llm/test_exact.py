"""Sharding, line dedup, mixing and exact dedup against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, ODD_TEXTS
from vigilake.llm import exact_dedup, line_dedup, mixing, queries, sharding
from vigilake.llm.common import components, word_count


def groups_of(rows):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows}


def expected_groups(texts):
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[t or ""].append(i)
    return {i: (max(ids), len(ids), i == max(ids)) for ids in by.values() for i in ids}


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups_with_and_without_collisions(docs, bits):
    texts = [*ODD_TEXTS, "k" * 700 + "one", "k" * 700 + "two", "k" * 700 + "one"] + [f"text {i % 7} " * 200 for i in range(30)]
    rows = exact_dedup.exact_groups(docs(texts), fingerprint_bits=bits).collect()
    assert groups_of(rows) == expected_groups(texts)
    assert {r.doc_id: r.text_sha256 for r in rows} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}


def test_dropping_copies_keeps_columns_of_any_name(spark):
    rows = [(1, "a", "s1", 1, 7), (2, "a", "s2", 2, 7), (3, None, "s3", 3, 7), (None, "", "s4", 4, 7), (None, "b", "s5", 5, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _sha string, _id int, sha_ int")
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[1], rows[2], rows[4]], key=repr)
    assert exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


def test_slices_are_bounded_by_bytes(monkeypatch):
    import pyarrow as pa

    from vigilake.llm import common

    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", None, "bbbb", "c" * 30, "d", "", "e"])], names=["text"])
    parts = [p.column("text").to_pylist() for p in common.byte_slices(batch, "text")]
    assert parts == [["aaaa", None, "bbbb"], ["c" * 30], ["d", "", "e"]]


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "a"), (None, "c")], DOCS)
    rows = exact_dedup.exact_groups(df).collect()
    assert sum(r.kept for r in rows if r.keep_id == 1) == 1 and len(rows) == 5
    assert sorted(r.text for r in exact_dedup.drop_exact_copies(df).collect()) == ["a", "b", "c"]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_chunks_join_to_the_text():
    data = np.random.default_rng(1).integers(97, 110, 300_000, dtype=np.uint8)
    starts = np.array([0, 10, 10, 150_000, 300_000])
    ends = exact_dedup.chunk_ends(data, starts, 10, 256, 8192)
    for begin, end, own in zip(starts, starts[1:], ends):
        sizes = np.diff([begin, *own])
        assert (own[-1] if own else begin) == end and (sizes[:-1] >= 256).all() and (sizes <= 8192).all()
    alone = exact_dedup.chunk_ends(data[10:150_000].copy(), np.array([0, 149_990]), 10, 256, 8192)[0]
    assert [e - 10 for e in ends[2]] == alone


def kept_lines(texts, least):
    blank = " \t\n\x0b\x0c\r"
    fold = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(blank))
    split = [(t or "").split("\n") for t in texts]
    often = {k for k, n in Counter(k for lines in split for k in {fold(x) for x in lines}).items() if n >= least and k}
    out = {}
    for i, lines in enumerate(split):
        stay = [x for x in lines if fold(x) not in often]
        out[i] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def test_line_dedup(docs):
    texts = [*ODD_TEXTS, "Same\none", " same \ntwo\nsame", "SAME\t", "same\n\n", "ÉA", "éA"]
    rows = line_dedup.drop_frequent_lines(docs(texts), min_docs=3).collect()
    assert {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in rows} == kept_lines(texts, 3)


def test_line_dedup_odd_rows(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "a"), (None, None)], DOCS)
    rows = line_dedup.drop_frequent_lines(df, min_docs=3).collect()
    assert sorted((r.kept_text, r.n_dropped) for r in rows) == [("", 0), ("", 1), ("b", 1), ("b", 1)]
    assert line_dedup.drop_frequent_lines(df.limit(0)).count() == 0


def test_line_dedup_of_repeated_ids_is_what_the_sql_says(spark, tmp_path):
    import duckdb

    rows = [(1, "a\nb")] * 12 + [(2, "b"), (2, None), (None, "a\nc"), (None, "a\nc"), (3, "c"), (4, "A ")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op3_line_dedup"]).fetchall()
    got = [tuple(r) for r in queries.op3(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(rows)


def test_many_frequent_lines_are_salted(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    texts = [*ODD_TEXTS, *["same\none"] * 5, " one \ntwo"]
    rows = line_dedup.drop_frequent_lines(docs(texts), min_docs=3).collect()
    assert {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in rows} == kept_lines(texts, 3)


def check_shards(rows, texts_by_id):
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.size == len((texts_by_id[r.doc_id] or "").encode()) + 1
        assert r.text_crc32 == zlib.crc32((texts_by_id[r.doc_id] or "").encode()) and r.law == "bytes"
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(loads) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_shards_of_the_table(spark, tables):
    texts = {r.doc_id: r.text for r in tables("documents").collect()}
    rows = queries.op1(spark, "/root/testdata/sf0.01").collect()
    loads = check_shards(rows, texts)
    assert len(rows) == len(texts) and max(loads.values()) < 1.02 * sum(loads.values()) / 16
    homes = defaultdict(set)
    for r in rows:
        homes[texts[r.doc_id]].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_shards_of_one_hot_text(spark, docs):
    texts = ["the same text"] * 3000 + [f"text {i}" for i in range(3000)]
    df = docs(texts)
    records, versions = sharding.shard_records(df, F.col("text"), F.octet_length("text") + 1)
    loads = Counter()
    for r in records.collect():
        loads[r.shard] += r.size
    assert len(loads) == 16 and max(loads.values()) < 1.05 * min(loads.values())
    assert {r.version for r in versions.select("version").distinct().collect()} == {0, 1}


def test_texts_in_a_hot_slot_stay_together(spark):
    """One slot for all: the text with half of all bytes is dealt out, the copies of other texts are not."""
    texts = ["hot" * 20] * 400 + [f"light {i % 50}" for i in range(400)] + ["w " * 3000]
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], DOCS)
    records, _ = sharding.shard_records(df, F.col("text"), F.octet_length("text") + 1, 16, 1, F.col("text"))
    homes, loads = defaultdict(set), Counter()
    for r in records.collect():
        homes[r._c0].add(r.shard)
        loads[r.shard] += r.size
    assert len(homes["hot" * 20]) > 4 and all(len(h) == 1 for t, h in homes.items() if t.startswith("light"))
    assert len(homes) == 52 and sum(loads.values()) == sum(len(t) + 1 for t in texts)


def test_null_ids_of_a_hot_text_are_spread(spark):
    df = spark.createDataFrame([(None, "same")] * 4000 + [(i, f"t{i}") for i in range(2000)], DOCS).repartition(4)
    records, _ = sharding.shard_records(df, F.col("text"), F.octet_length("text") + 1)
    counts = Counter(r.shard for r in records.where("doc_id is null").collect())
    assert len(counts) == 16 and max(counts.values()) < 500


def test_shards_of_odd_rows_and_growth(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, "")], DOCS)
    records, versions = sharding.shard_records(df, F.col("text"), F.octet_length("text") + 1)
    rows = records.collect()
    assert len(rows) == 4 and sorted(r.size for r in rows) == [0, 0, 1, 2]
    assert sharding.shard_records(df.limit(0), F.col("text"), F.octet_length("text"))[0].count() == 0
    wide = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    _, versions = sharding.shard_records(wide, F.col("doc_id"), F.lit(10), 4, 256)
    now = versions.where("version = 1")
    grown = sharding.edited_map(now, 5)
    moved = now.alias("a").join(grown.alias("b"), ["slot", "part"]).where("a.shard <> b.shard")
    assert moved.where("b.shard = 4").count() > 0.8 * moved.count() > 0
    sizes = [r[1] for r in grown.groupBy("shard").sum("bytes").collect()]
    assert len(sizes) == 5 and max(sizes) < 1.1 * min(sizes)


def filled_targets(sizes, weights, total, most):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    budget, full = total * sum(sizes.values()), set()
    while True:
        open_ = [n for n in names if n not in full]
        rest = budget - sum(most * sizes[n] for n in full)
        over = [n for n in open_ if rest * w[n] / sum(w[m] for m in open_) > most * sizes[n]]
        if not over:
            return {n: most * sizes[n] if n in full else rest * w[n] / sum(w[m] for m in open_) for n in names}
        full |= set(over)


def test_mixing(spark):
    rng = np.random.default_rng(3)
    names = ["b", "a", None, "Z", "é", "empty"]
    rows = [(i, "w " * int(rng.integers(0, 60)) if names[i % 6] != "empty" else "", names[i % 6] if i % 3 else "hot") for i in range(4000)] + [(7, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, word_count("text"), [5.0, 2.0, 1.0]).collect()
    again = mixing.mix(df.repartition(3), word_count("text"), [5.0, 2.0, 1.0]).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    goals, taken = filled_targets(sizes, [5.0, 2.0, 1.0], 1.5, 2.0), Counter()
    for r in out:
        assert r.target == pytest.approx(goals[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goals[s]) <= 60 for s in sizes)
    copies = mixing.mix_documents(df.withColumn("copies", F.lit("own")), word_count("text"), [5.0, 2.0, 1.0])
    assert copies.columns == ["doc_id", "text", "source", "copies"]
    assert copies.count() == sum(r.copies for r in out)
    assert mixing.mix(df.limit(0), word_count("text"), [1.0]).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)] + [(7, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert len({found[i] for i in range(101)}) == 1 and len({found[1000 + i] for i in range(300)}) == 1
    assert found[0] != found[1000] and 5000 not in found
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
