"""Merkle manifests against a plain tree."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS
from vigilake.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, root string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def climb(leaves):
    """The root, and the (left, right) siblings on the way up from each leaf."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for i, place in enumerate(at):
            run = runs[place // 3]
            paths[i].append(("".join(run[: place % 3]), "".join(run[place % 3 + 1 :])))
            at[i] = place // 3
        level = [H(*run) for run in runs]
    return level[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each record."""
    import zlib

    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for doc_id, source, lang, n_chars, text, *_ in rows:
        given = H(*map(value, (doc_id, source, lang, n_chars, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        claimed = H(*map(value, (doc_id, source, lang, n_chars, text and text.replace("\n", "")))) if hit else given
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, given, claimed, doc_id))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: (sorted(trees[s]), *climb([r[2] for r in sorted(trees[s])])) for s in order}
    root, upper = climb([grown[s][1] for s in order])
    out = []
    for s, way in zip(order, upper):
        leaves, subroot, paths = grown[s]
        for (_, _, leaf, claimed, doc_id), path in zip(leaves, paths):
            digest, proof = claimed, ""
            for left, right in [*path, *way]:
                digest, proof = H(left, digest, right), proof + left + right
            out.append((doc_id, leaf, subroot, root, H(proof), digest, digest == root))
    return sorted(out, key=repr)


def found(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "t", 3, "r") for r in rows], SCHEMA)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, queries.leaf_digest(text=F.replace("text", F.lit("\n"), F.lit(""))))
    proofs, layers, upper = merkle.manifest(docs, F.col("source"), F.col("doc_id"), queries.leaf_digest(), tampered, **kw)
    assert proofs.columns == ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, proofs.collect()), key=repr), layers, upper


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_against_a_plain_tree(spark, height):
    """Trees of many sizes, layers of blocks, sources in byte order, null and empty sources, tampered texts."""
    sizes = {None: 5, "": 1, "b": 1, "B": 2, "é": 3, "a": 4, "hot": 130, "z\U0001f600": 9, "￿": 10, "aa": 27, "ab": 28}
    rows, at = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            at += 1
            rows.append((at * 7 % 1000, source, "en" if at % 3 else None, at if at % 4 else None, "a\nb\n" if at % 5 else None))
    got, layers, _ = found(spark, rows, height=height)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}
    assert len(layers) == {1: 5, 2: 3, 6: 1}[height]


def test_odd_records(spark):
    rows = [(i if i % 4 else None, "s" if i % 3 else None, None, None, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[1], rows[1], (7, "s", "x", 1, "one"), (7, "s", "x", 1, "two"), (-3, "s", "", 0, "")]
    assert found(spark, rows, height=1)[0] == plain(rows)
    one = [(1, None, None, None, None)]
    got = found(spark, one)[0]
    assert got == plain(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == H("")
    assert found(spark, [])[0] == []


def test_addresses_fill_the_layout():
    for levels in range(1, 8):
        seen = np.concatenate([merkle.address(levels, depth, np.arange(3**depth)) for depth in range(levels)])
        assert sorted(seen.tolist()) == list(range(merkle.nodes_of(levels)))
    # three levels split into one and two: the root, then each lower subtree in one piece
    assert merkle.address(3, 2, np.arange(9)).tolist() == [2, 3, 4, 6, 7, 8, 10, 11, 12]
    assert merkle.address(4, 2, np.arange(9)).tolist() == [4 + 4 * i for i in range(9)]


def test_blocks_hold_their_nodes():
    leaves = [H(str(i)) for i in range(20)]
    nodes, root = merkle.build_block(leaves)
    want, paths = climb(leaves)
    assert root == want == nodes[:32].hex()
    levels = merkle.sibling_levels(nodes, 20)
    assert [[level[i // 3**up] for up, level in enumerate(levels)] for i in range(20)] == paths
    assert all(merkle.fold(leaf, path) == root for leaf, path in zip(leaves, paths))
    assert merkle.split_path(merkle.joined_path(paths[3])) == paths[3] and merkle.split_path("") == [] and merkle.split_path(",") == [("", "")]
