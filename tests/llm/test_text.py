"""PII, SimHash, quality and SentencePiece against plain Python."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import DIR, DOCS, ODD_TEXTS
from vigilake.llm import pii, quality, queries, sentencepiece_wfst, simhash
from vigilake.llm.common import shingle_set


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in tests.items()}


PII_TEXTS = [
    *ODD_TEXTS, "a@b.c_d@e.f x@y x@y.z. q@w.e@r.t", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111",
    "+1 (555) 123-4567 and +49 30 1234567890123456 +1", "é" * 30 + "mail me: ü@x.de ü.a@x.de", "0" * 40, "a@b." + "c." * 3000 + "d", "9" * 30_000 + ".1.1.1",
    "x" * 30_000 + "@" + "y" * 10 + ".z", "+1" + "(" * 5000 + "2", "x@y.z " * 2000,
]


def test_pii_base_spans(docs):
    rows = pii.personal_data(docs(PII_TEXTS)).collect()
    for r in rows:
        for kind, spans in base_spans(PII_TEXTS[r.doc_id] or "").items():
            assert [(s.start, s.stop) for s in r[kind]] == spans, (r.doc_id, kind)


def test_pii_added_kinds_scores_and_masks(docs):
    texts = ["account GB82WEST12345698765432 or GB82WEST12345698765433", "ssn 123-45-6789", "part 123-45-6789", "ssn 000-45-6789", "Call +1 555 123 4567", "x@y.z"]
    rows = {r.doc_id: r for r in pii.personal_data(docs(texts)).collect()}
    assert len(rows[0].iban) == 1 and rows[0].iban[0].start == 8 and rows[0].iban[0].score == 100
    assert [len(rows[i].ssn) for i in (1, 2, 3)] == [1, 0, 0]
    assert rows[4].phone[0].score == 100 and rows[5].email[0].score == 60
    masked = {r.doc_id: r.masked for r in pii.masked_text(docs(texts)).collect()}
    assert masked[4] == "Call [phone]" and masked[5] == "[email]"
    assert pii.personal_data(docs(texts).limit(0)).count() == 0


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, distance):
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(codes))]


def test_fingerprints_and_components(docs):
    rng = np.random.default_rng(2)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(20)]
    near = []
    for t in base:
        for _ in range(6):
            words = t.split()
            words[int(rng.integers(0, 400))] = "other"
            near.append(" ".join(words))
    texts = [*[t for t in ODD_TEXTS if len(t or "") < 2000], *base, *near, *base[:5]]
    rows = simhash.near_groups(docs(texts)).collect()
    found = {r.doc_id: r.fp % (1 << 64) for r in rows}
    codes = [plain_fingerprint(t, 3) for t in texts]
    assert [found[i] for i in range(len(texts))] == codes
    assert [r.component_id for r in sorted(rows, key=lambda r: r.doc_id)] == plain_components(codes, 3)


@pytest.mark.parametrize(("bucket", "spread"), [(4096, 40), (8, 40), (8, 6)])
def test_links_lose_no_group(spark, bucket, spread):
    """Random walks of few bits around centres, also with buckets so small that all rounds are needed."""
    rng = np.random.default_rng(bucket + spread)
    codes = set()
    for _ in range(spread):
        code = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(40):
            for bit in rng.integers(0, 64, int(rng.integers(1, 5))):
                code ^= 1 << int(bit)
            codes.add(code)
    codes = sorted(codes)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    links = simhash.fingerprint_links(df, 3, bucket=bucket).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() == r.d <= 3 for r in links)
    place = {c: i for i, c in enumerate(codes)}
    parent = plain_components(codes, 3)
    union = list(range(len(codes)))

    def find(i):
        while union[i] != i:
            i = union[i]
        return i

    for r in links:
        a, b = sorted((find(place[r.a % (1 << 64)]), find(place[r.b % (1 << 64)])))
        union[b] = a
    assert [find(i) for i in range(len(codes))] == parent


def test_near_copies_stage(spark, docs):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 300)) for _ in range(10)]
    changed = [t.replace(t.split()[50], "new", 1).replace(t.split()[200], "more", 1) for t in base]
    half = [" ".join(t.split()[:150] + [f"z{x}" for x in rng.integers(0, 3000, 150)]) for t in base]
    df = docs([*base, *changed, *half, None, ""])
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(df).collect())
    assert kept == [*range(10), *range(20, 31)]
    assert simhash.drop_near_copies(df).columns == df.columns
    empty = df.limit(0)
    assert simhash.drop_near_copies(empty).count() == 0 and simhash.near_groups(empty).count() == 0


def test_stage_finds_similar_documents_of_the_table(tables):
    """Of all pairs with 0.8 or more of their five-word shingles in common, nearly all are brought together."""
    rows = {r.doc_id: r.text for r in tables("documents").collect()}
    sets = {i: set(shingle_set(t, 5).tolist()) for i, t in rows.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    pairs = {(a, b) for ids in where.values() if len(ids) < 60 for n, a in enumerate(ids) for b in ids[:n]}
    alike = [p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])]
    kept = {r.doc_id for r in simhash.drop_near_copies(tables("documents")).collect()}
    missed = [p for p in alike if p[0] in kept and p[1] in kept]
    assert len(alike) > 10 and len(missed) <= 0.1 * len(alike)
    touched = {i for p in alike for i in p}
    assert kept >= set(rows) - touched


def test_quality_on_held_out_rows(spark, tables):
    rows = {r.doc_id: r for r in queries.op10(spark, DIR).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    labels = [(rows[r.doc_id].score, r.quality) for r in tables("labels").collect() if rows[r.doc_id].held_out]
    good, bad = [s for s, q in labels if q], [s for s, q in labels if not q]
    assert np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good]) > 0.95
    assert np.mean([(s >= 0.7) == bool(q) for s, q in labels]) > 0.93


def test_quality_is_the_plain_fit(spark, tables):
    """The query against one matrix: same features, a direct solve, the same isotonic levels."""
    import zlib

    docs = tables("documents").select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)).alias("fold")).collect()
    labels = {r.doc_id: r.quality for r in tables("labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    x = np.array([quality.text_statistics((d.text or "").encode()) for d in docs], dtype=np.float32).astype(float)
    known = np.array([d.doc_id in labels for d in docs])
    y = np.array([labels.get(d.doc_id, 0) for d in docs], dtype=float)
    fold = np.array([d.fold for d in docs])
    mean, scale = x[known].mean(axis=0), x[known].std(axis=0)
    rng = np.random.default_rng(quality.SEED)
    waves = rng.normal(size=(quality.FEATURES, quality.RANDOM_FEATURES)) / np.sqrt(quality.FEATURES)
    phase = rng.uniform(0, 2 * np.pi, quality.RANDOM_FEATURES)
    z = np.clip((x - mean) / np.where(scale > 1e-9, scale, 1.0), -8, 8)
    f = np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / quality.RANDOM_FEATURES) * np.cos(z @ waves + phase)])
    learn, check = known & (fold != 3), known & (fold == 3)
    penalty = np.full(f.shape[1], quality.RIDGE * learn.sum() / 100)
    penalty[0] = 1e-9
    raw = f @ np.linalg.solve(f[learn].T @ f[learn] + np.diag(penalty), f[learn].T @ y[learn])
    bins = np.clip((raw[check] + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    used, at = np.unique(bins, return_inverse=True)
    count = np.bincount(at)
    rate = np.bincount(at, y[check]) / count
    levels = np.empty(len(used))  # the isotonic fit as the largest of the least means
    for i in range(len(used)):
        levels[i] = max(min(np.average(rate[a : b + 1], weights=count[a : b + 1]) for b in range(i, len(used))) for a in range(i + 1))
    edges, values = [], []
    for level in np.unique(np.round(levels, 12)):
        own = np.abs(levels - level) < 1e-9
        weight = count[own].sum()
        edges.append(((used[own] + 0.5) / quality.BINS * 2 - 0.5) @ count[own] / weight)
        values.append((level * weight + 0.5) / (weight + 1))
    want = np.clip(np.interp(raw, edges, np.maximum.accumulate(values)), 0, 1)
    got = {r.doc_id: r for r in queries.op10(spark, DIR).collect()}
    assert np.abs(np.array([got[d.doc_id].score for d in docs]) - want).max() < 1e-6
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for i, r in got.items())


def test_quality_of_odd_rows(spark, docs):
    df = docs(ODD_TEXTS)
    labels = spark.createDataFrame([(0, 1), (5, 0), (5, 1), (7, None), (None, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        rows = quality.quality_scores(df, known).collect()
        assert len(rows) == len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(df.limit(0), labels).count() == 0
    assert quality.keep_good(df, labels, 0.0).count() == len(ODD_TEXTS)


def test_isotonic():
    values = quality.isotonic(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1, 1, 1, 2, 1]))
    assert np.allclose(values, [0.1, 0.3, 0.3, 0.3, 0.9])


def test_pieces_are_those_of_the_library(spark, tables, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    rng = np.random.default_rng(4)
    alphabet = list("aeinrst  \n.ABzé▁ß梦0%ﬁ\t😀") + ["the", " ing", "  ", "▁▁"]
    texts = [t for t in ODD_TEXTS] + ["".join(rng.choice(alphabet, int(rng.integers(1, 60)))) for _ in range(1500)] + [" " * n for n in range(1, 40)] + ["a" + " " * n + "b" for n in range(40)]
    model = sentencepiece_wfst.load_model(spark, queries.PIECE_MODEL)
    df = docs(texts).unionByName(tables("documents").where("doc_id < 300").select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"), allowMissingColumns=True)
    known = {r.doc_id: r.text for r in df.collect()}
    rows = sentencepiece_wfst.decode(sentencepiece_wfst.encode(df, model), model).collect()
    assert len(rows) == len(known)
    for r in rows:
        text = known[r.doc_id] or ""
        assert r.ids == library.encode(text), repr(text[:80])
        assert r.text == library.decode(r.ids)
        assert r.text == text.replace("▁", " ")
    assert sentencepiece_wfst.encode(df.limit(0), model).count() == 0


def test_decoding_of_broken_bytes_and_control_pieces(spark):
    model = sentencepiece_wfst.load_model(spark, queries.PIECE_MODEL)
    df = spark.createDataFrame([(1, [1, 3 + 0xC3, 2]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.text for r in sentencepiece_wfst.decode(df, model).orderBy("doc_id").collect()] == ["�", "", ""]


def test_scores_model_shortest_path():
    """A model with piece scores takes the path with the largest sum."""
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -1.5), ("abc", -9.0), ("c", -1.0)]
    machine = sentencepiece_wfst.Transducer(pieces, {p: i for i, (p, _) in enumerate(pieces)}, [], 99, False, False)
    assert machine.shortest_path("abcab") == ["ab", "c", "ab"] and machine.encode("abz") == [2, 99]
