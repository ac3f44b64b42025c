"""The near-copy stage against brute force over all pairs."""

import numpy as np
import pytest

from vigilake.llm import set_join, simhash
from vigilake.llm.common import shingle_set


def alike(x, y):
    both = len(x & y)
    return both >= 0.8 * (len(x) + len(y) - both)


def brute_force(texts):
    """The ids that stay, and the similar pairs."""
    sets = [set(shingle_set(t, 5).tolist()) for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if alike(sets[i], sets[j])]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    return [i for i in range(len(sets)) if find(i) == i], pairs


def words_of(rng, count):
    return [f"w{x}" for x in rng.integers(0, 1 << 30, count)]


def edited(rng, words, similarity):
    """The words with enough of them changed, each far from the others, to come to the similarity or just over it."""
    n = len(words) - 4
    places = int((1 - similarity) / (1 + similarity) * n / 5)
    out = list(words)
    for at in np.linspace(5, len(words) - 6, max(1, places)).astype(int):
        out[at] = f"x{rng.integers(0, 1 << 30)}"
    return out


def kept_ids(df):
    return sorted(r.doc_id for r in simhash.drop_near_copies(df).collect())


@pytest.mark.parametrize("similarity", [0.80, 0.85, 0.90])
def test_planted_pairs_are_all_found(docs, similarity):
    rng = np.random.default_rng(int(100 * similarity))
    base = [words_of(rng, int(rng.integers(100, 700))) for _ in range(60)]
    texts = [" ".join(t) for t in [*base, *[edited(rng, t, similarity) for t in base]]]
    kept, pairs = brute_force(texts)
    assert len(pairs) == 60 and kept == list(range(60))
    assert kept_ids(docs(texts)) == kept


def test_links_behind_failing_candidates(docs):
    """Clusters from one template, most of whose pairs are below 0.8 and closer than some that are over it."""
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(4):
        template = words_of(rng, 300)
        for _ in range(25):
            own = edited(rng, template, float(rng.uniform(0.78, 0.9)))
            texts += [" ".join(own), *[" ".join(edited(rng, own, float(rng.uniform(0.78, 0.9)))) for _ in range(2)]]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    kept, pairs = brute_force(texts)
    assert 10 < len(kept) < len(texts) - 10
    assert kept_ids(docs(texts)) == kept


def test_equal_fingerprints_are_no_proof(docs):
    """One shingle makes most of each text, so it is the fingerprint; the texts differ otherwise."""
    rng = np.random.default_rng(3)
    texts = [" ".join(["pad"] * 400 + words_of(rng, 100)) for _ in range(5)]
    texts += [" ".join(["pad"] * 300 + edited(rng, t.split()[400:], 0.9)) for t in texts[:2]]
    assert len({simhash.fingerprint(t.encode(), 5) for t in texts}) == 1
    assert brute_force(texts)[0] == [0, 1, 2, 3, 4]
    assert kept_ids(docs(texts)) == [0, 1, 2, 3, 4]


def test_texts_of_a_repeated_id_are_compared_each(spark):
    rng = np.random.default_rng(4)
    one, two = words_of(rng, 200), words_of(rng, 200)
    rows = [(7, one), (7, two), (8, edited(rng, two, 0.9)), (9, edited(rng, one, 0.9))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    assert kept_ids(df) == [7, 7]


def test_groups_over_a_block_lose_nothing(docs, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 8)
    rng = np.random.default_rng(6)
    template = words_of(rng, 150)
    texts = [" ".join(edited(rng, template, float(rng.uniform(0.8, 0.9)))) for _ in range(60)]
    kept, _ = brute_force(texts)
    assert kept_ids(docs(texts)) == kept


def test_jobs_stay_few(spark, docs):
    """A group of copies takes few jobs, since plans and jobs are what the driver's memory is spent on."""
    rng = np.random.default_rng(8)
    template = words_of(rng, 300)
    texts = [" ".join(edited(rng, template, float(rng.uniform(0.85, 0.97)))) for _ in range(300)]
    frame = docs(texts)
    spark.sparkContext.setJobGroup("near", "near")
    assert kept_ids(frame) == [0]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 100


def test_null_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    one, two = words_of(rng, 100), words_of(rng, 100)
    rows = [(None, one, 1), (None, one, 2), (None, two, 3), (4, two, 4), (4, two, 5), (6, None, 6), (5, "", 7), (None, " ", 8)]
    df = spark.createDataFrame([(i, t if t is None else t if isinstance(t, str) else " ".join(t), n) for i, t, n in rows], "doc_id long, text string, node int")
    out = sorted((r.doc_id or 0, r.node) for r in simhash.drop_near_copies(df).collect())
    assert [i for i, _ in out] == [0, 4, 5] and out[2] == (5, 7)
    assert simhash.drop_near_copies(df).columns == df.columns and simhash.drop_near_copies(df.limit(0)).count() == 0
