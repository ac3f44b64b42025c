"""Near copies among embeddings and hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.llm import hard_negatives, itq_dedup

INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    """Vectors with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, lab, 7, 8) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, block int, row int")


def brute_links(x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    return near


def roots_of(near, ids):
    """Smallest id reachable from each row."""
    root = np.array(ids)
    while True:
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(root))])
        if (new == root).all():
            return root
        root = new


def planted(rng, width, groups, size, low, high):
    """Groups of vectors at cosines between low and high from their base, among as many at random."""
    out = [rng.normal(size=(groups * size, width))]
    for _ in range(groups):
        base = rng.normal(size=width)
        base /= np.linalg.norm(base)
        out.append(itq_dedup.planted_partners(np.repeat(base[None], size, axis=0), float(rng.uniform(low, high)), rng) * rng.uniform(0.5, 3, size=(size, 1)))
    return np.concatenate(out)


@pytest.mark.parametrize("width, mean", [(64, 0.0), (64, 0.2), (16, 0.0), (100, 0.1)])
def test_links_against_brute_force(spark, width, mean):
    rng = np.random.default_rng(width)
    x = planted(rng, width, 12, 40, 0.93, 0.99) + mean
    x = np.concatenate([x, itq_dedup.planted_partners(itq_dedup.unit(x[:400]), 0.9 + 1e-9, rng)])
    ids = rng.permutation(len(x)) * 3
    near = brute_links(x)
    out = {r.vec_id: r for r in itq_dedup.near_copies(frame(spark, [(int(i), v.tolist(), 1) for i, v in zip(ids, x)])).collect()}
    assert sorted(out) == sorted(ids.tolist())
    got = np.array([out[i].n_links for i in ids])
    assert (got <= near.sum(axis=1)).all() and got.sum() >= 0.95 * near.sum() > 0
    hard = slice(len(x) - 400, None)  # partners at the threshold itself
    assert got[hard].sum() >= 0.9 * near.sum(axis=1)[hard].sum()
    if (got == near.sum(axis=1)).all():
        assert [out[i].component_id for i in ids] == roots_of(near, ids).tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


def test_dense_group_goes_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(itq_dedup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    x = np.concatenate([base + 0.18 * rng.normal(size=(300, 32)), base + 0.02 * rng.normal(size=(200, 32)), rng.normal(size=(300, 32))])
    near = brute_links(x)
    out = {r.vec_id: r for r in itq_dedup.near_copies(frame(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])).collect()}
    assert [out[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [out[i].component_id for i in range(len(x))] == roots_of(near, range(len(x))).tolist()


def test_chain_and_copies(spark):
    """Each is linked with the next only; equal vectors count each other and share links."""
    steps = [[float(np.cos(a)), float(np.sin(a)), 0.0] for a in np.arange(12) * 0.4]
    rows = [(100 - i, v, 0) for i, v in enumerate(steps)] + [(500 + i, steps[3], 0) for i in range(50)]
    out = {r.vec_id: r for r in itq_dedup.near_copies(frame(spark, rows)).collect()}
    assert {r.component_id for r in out.values()} == {89} and [i for i, r in out.items() if r.kept] == [89]
    assert out[100].n_links == 1 and out[97].n_links == 52 == out[510].n_links and out[98].n_links == 1 + 51


def test_codes_are_balanced_and_lose_less_than_random_ones():
    rng = np.random.default_rng(2)
    x = itq_dedup.unit(rng.normal(size=(4000, 32)) * np.linspace(0.2, 3, 32) + 0.5)
    codes = itq_dedup.fit_codes(x, 4000, 0.9)
    bits = np.concatenate([((x - codes.mean) @ d > 0) for d in codes.directions], axis=1)
    assert abs(bits.mean(axis=0) - 0.5).max() < 0.06
    v = x - x.mean(axis=0)
    loss = lambda t: ((np.where(v @ t > 0, 1, -1) - v @ t / v.std()) ** 2).mean()
    assert loss(itq_dedup.learn_rotation(v, rng)) < loss(np.linalg.qr(rng.normal(size=(32, 32)))[0])


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(5, one, 1), (4, one, None), (4, one, 1), (3, None, 1), (2, [0.0, 0.0, 0.0], 1), (1, [INF, 0.0, 0.0], 1), (0, [NAN, 0.0, 1.0], 1), (7, [None, 1.0, 0.0], 1),
            (8, [1.0], 1), (9, [], 1), (None, [0.0, 1.0, 0.0], 1), (None, [0.0, 1.0, 0.0], 1), (None, None, 1), (10, [1e200, -0.0, 0.0], 1), (11, [1e-300, 0.0, 0.0], 1)]
    out = sorted((tuple(r) for r in itq_dedup.near_copies(frame(spark, rows)).collect()), key=repr)
    assert out == sorted([
        (5, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (10, 4, 4, False), (11, 4, 4, False),
        *[(i, 0, i, True) for i in (0, 1, 2, 3, 7, 8, 9)], (None, 1, None, True), (None, 1, None, True), (None, 0, None, True),
    ], key=repr)
    assert itq_dedup.near_copies(frame(spark, [])).count() == 0
    assert [tuple(r) for r in itq_dedup.near_copies(frame(spark, [(1, None, 1)])).collect()] == [(1, 0, 1, True)]


# --- hard negatives ---------------------------------------------------------------------------------------------------

def test_packed_scores_are_exact():
    rng = np.random.default_rng(0)
    for most, width in ((300, 64), (1 << 24, 64), (1, 1), (1 << 20, 3)):
        rows, anchors = rng.integers(-most, most + 1, (50, width)), rng.integers(-most, most + 1, (20, width))
        anchors[0], anchors[1] = most, -most
        packed = hard_negatives.PackedRows(rows, int(np.abs(anchors).sum(axis=1).max()))
        for a in anchors:
            assert packed.scores(a).tolist() == [sum(int(x) * int(y) for x, y in zip(r, a)) for r in rows]
    assert hard_negatives.PackedRows(np.full((3, 2), -5), 10).scores([-5, 5]).tolist() == [0, 0, 0]
    assert hard_negatives.PackedRows(np.zeros((3, 2), dtype=np.int64), 0).scores([0, 0]).tolist() == [0, 0, 0]


def brute_negatives(rows, every=50, k=5, n=3):
    """All rows of the answer, by plain loops over the rows that take part."""
    used = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, v, lab in rows]
    out = []
    for at, (a, lab, x) in enumerate(used):
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, j, other) for j, (i, other, y) in enumerate(used) if j != at)
        for score, positive, _, _ in [s for s in scored if s[3] == lab][:k]:
            fit = [s for s in scored if s[3] != lab and 50 * -score <= 100 * -s[0] <= 95 * -score][:n]
            out += [(a, positive, r, s[1], -score, -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [(8192, 2048), (16, 3)])
def test_negatives_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", cells[0])
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", cells[1])
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] * 0.3 + rng.normal(size=12) * 0.2).tolist(), int(i % 5 == 0) if i % 3 else 2) for i in range(500)]
    rows += [(i, v, lab) for i, v, lab in rows[::25]] + [(1000 + i, rows[0][1], i % 3) for i in range(20)]  # repeated rows and ties
    out = hard_negatives.hard_negatives(frame(spark, rows), F.col("label"))
    assert sorted(map(tuple, out.collect())) == brute_negatives(rows) != []
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}


def test_odd_rows_take_no_part(spark):
    one, half = [1.0, 0.0], [0.75, 0.0]
    good = [(0, one, 1), (50, one, 1), (1, half, 2), (2, [0.0, 0.0], 2), (100, [-1.0, 0.5], 1), (150, one, 9)]
    bad = [(None, half, 2), (3, None, 2), (4, half, None), (5, [INF, 0.0], 2), (6, [NAN, 0.0], 2), (7, [None, 0.0], 2), (8, [1.0], 2), (9, [], 2)]
    out = hard_negatives.hard_negatives(frame(spark, good + bad), F.col("label"))
    assert sorted(map(tuple, out.collect())) == brute_negatives(good) and out.count() > 0
    huge = [(0, [1e300, 0.0], 1), (1, [1e38, 1.0], 1), (2, [0.9 * 2**19, 0.0], 2)]
    assert [r.negative_id for r in hard_negatives.hard_negatives(frame(spark, huge), F.col("label")).collect()] == [2]
    for none in ([], bad):
        assert hard_negatives.hard_negatives(frame(spark, none), F.col("label")).count() == 0
