"""Merkle manifests of datasets, stored as blocks in van Emde Boas layout.

The leaves of a tree are cut into aligned runs of ``fan ** height``; each run is a block, that is a whole subtree in one row.
The roots of the blocks are the leaves of the next layer, until one block is left. Inside a block the nodes lie in van Emde
Boas order: the upper half of the levels first, then the lower subtrees one after the other, each laid out the same way. Where
a node lies follows from its depth and place alone, both when a block is built and when siblings are read.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilake.session import cut_lineage

FAN, HEIGHT = 3, 6


# --- the layout of a block --------------------------------------------------------------------------------------------

def nodes_of(levels: int, fan: int = FAN) -> int:
    """Nodes of a full tree of so many levels."""
    return (fan**levels - 1) // (fan - 1)


def address(levels: int, depth: int, place: np.ndarray, fan: int = FAN) -> np.ndarray:
    """Where the nodes of one depth (0 is the root) lie in a full tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(place)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, place, fan)
    below = fan ** (depth - upper)
    tree = place // below
    return nodes_of(upper, fan) + tree * nodes_of(levels - upper, fan) + address(levels - upper, depth - upper, place % below, fan)


@lru_cache(maxsize=256)
def row_addresses(levels: int, depth: int, count: int, fan: int) -> np.ndarray:
    return address(levels, depth, np.arange(count, dtype=np.int64), fan)


def counts_up(leaves: int, fan: int) -> list[int]:
    """Nodes of each level from the leaves up to the first level with one node."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // fan))
    return out


def parent(children: str) -> str:
    return sha256(children.encode()).hexdigest()


def build_block(leaves: list[str], fan: int = FAN) -> tuple[bytes, str]:
    """Digests of a subtree in van Emde Boas order, 32 bytes each, and its root in hex."""
    counts = counts_up(len(leaves), fan)
    nodes = np.zeros((nodes_of(len(counts), fan), 32), dtype=np.uint8)
    level = leaves
    for up, count in enumerate(counts):
        if up:
            level = [parent("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
        nodes[row_addresses(len(counts), len(counts) - 1 - up, count, fan)] = np.frombuffer(bytes.fromhex("".join(level)), dtype=np.uint8).reshape(-1, 32)
    return nodes.tobytes(), level[0]


def sibling_levels(block: bytes, leaves: int, fan: int = FAN) -> list[list[tuple[str, str]]]:
    """For each level from the leaves up, what stands left and right of each node in its run."""
    counts = counts_up(leaves, fan)
    nodes = np.frombuffer(block, dtype=np.uint8).reshape(-1, 32)
    out = []
    for up, count in enumerate(counts[:-1]):
        text = nodes[row_addresses(len(counts), len(counts) - 1 - up, count, fan)].tobytes().hex()
        runs = [text[i : i + 64 * fan] for i in range(0, len(text), 64 * fan)]
        out.append([(run[:i], run[i + 64 :]) for run in runs for i in range(0, len(run), 64)])
    return out


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a digest and the siblings on its way up come to."""
    for left, right in path:
        digest = parent(left + digest + right)
    return digest


def joined_path(path: list[tuple[str, str]]) -> str:
    return "|".join(f"{left},{right}" for left, right in path)


def split_path(path: str | None) -> list[tuple[str, str]]:
    return [tuple(step.split(",")) for step in path.split("|")] if path else []


# --- trees of any size ------------------------------------------------------------------------------------------------

def in_places(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Rows with their place in their tree (pos, from 0) and the tree's size (total), by ranges, so no tree has to fit a task."""
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    dealt = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    whole = Window.partitionBy(tree)
    runs = dealt.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    runs = runs.select(
        tree, "_part", "_first", F.sum("_n").over(whole).alias("total"),
        F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    return dealt.join(runs, [tree, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def build_layers(leaves: DataFrame, fan: int = FAN, height: int = HEIGHT) -> list[DataFrame]:
    """Tables of blocks (tree, block, total, n, nodes, root) from rows (tree, pos, total, leaf), the leaves' layer first.

    total is the number of leaves that the tree has in this layer. A tree's last layer is the one where it has one block.
    """
    width = fan**height

    def build(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy(), kind="stable")
        leaves = table.column("leaf").take(pa.array(order)).to_pylist()
        nodes, root = build_block(leaves, fan)
        total = table.column("total")[0].as_py()
        if total > width:  # more layers follow, so a block that is not full is carried up to its whole height
            for _ in range(height - (len(counts_up(len(leaves), fan)) - 1)):
                root = parent(root)
        return pa.table({
            "tree": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([total], pa.int64()),
            "n": pa.array([len(leaves)], pa.int32()), "nodes": pa.array([nodes], pa.binary()), "root": [root],
        })

    most = leaves.agg(F.max("total").alias("m")).first().m or 0
    layers, rows = [], leaves.select("tree", "pos", "total", "leaf")
    while True:
        dealt = rows.withColumn("block", F.floor(F.col("pos") / width))
        layers.append(cut_lineage(dealt.groupBy("tree", "block").applyInArrow(build, "tree string, block long, total long, n int, nodes binary, root string")))
        if most <= width:
            return layers
        most = -(-most // width)
        rows = layers[-1].where(F.col("total") > width).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("total") / width).alias("total"), F.col("root").alias("leaf"))


def tree_roots(layers: list[DataFrame], fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """(tree, root) of every tree."""
    tops = [layer.where(F.col("total") <= fan**height).select("tree", "root") for layer in layers]
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return out


def opened(block: dict, fan: int, height: int) -> tuple[list[list[tuple[str, str]]], list[tuple[str, str]]]:
    """The sibling levels of a block, and the way on from its root."""
    levels = sibling_levels(block["nodes"], block["n"], fan)
    carried = [("", "")] * (height - len(levels)) if block["total"] > fan**height else []
    return levels, [*carried, *split_path(block["path"])]


def path_of(place: int, levels: list[list[tuple[str, str]]], rest: list[tuple[str, str]], fan: int) -> list[tuple[str, str]]:
    return [*(level[place // fan**up] for up, level in enumerate(levels)), *rest]


def with_paths(layers: list[DataFrame], above: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """The leaves' blocks with the path from their root to the end; ``above`` (tree, path, ...) is the way on from each tree's root."""
    width = fan**height
    extra = [c for c in above.columns if c not in ("tree", "path")]

    def down(key: tuple, table: pa.Table) -> pa.Table:
        block = table.slice(0, 1).to_pylist()[0]
        levels, rest = opened(block, fan, height)
        n = block["n"]
        paths = [joined_path(path_of(i, levels, rest, fan)) for i in range(n)]
        places = pa.array([block["block"] * width + i for i in range(n)], pa.int64())
        return pa.table({"tree": [block["tree"]] * n, "block": places, "path": paths, **{c: [block[c]] * n for c in extra}})

    paths = None
    for at in range(len(layers) - 1, -1, -1):
        layer = layers[at]
        whole = layer.where(F.col("total") <= width).join(above, "tree")
        if paths is not None:
            whole = whole.unionByName(layer.where(F.col("total") > width).join(paths, ["tree", "block"]))
        if at:
            kinds = "".join(f", {c} string" for c in extra)
            paths = cut_lineage(whole.groupBy("tree", "block").applyInArrow(down, f"tree string, block long, path string{kinds}"))
    return whole


def manifest(
    records: DataFrame, group: Column, key: Column, leaf: Column, claimed: Column | None = None, fan: int = FAN, height: int = HEIGHT
) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Every record's place in the manifest and the check of its proof; the blocks of the groups' trees and of the tree over them.

    Rows (key, leaf, subroot, root, proof_sha256, folded_root, verified). Records of one ``group`` (a string, null is a group
    of its own) are the leaves of one tree, by ``key`` and then by leaf digest, null keys first; the trees' roots, in order of
    the group (null first, by UTF-8 bytes), are the leaves of the last tree. Runs of ``fan`` nodes, the last one maybe
    shorter, make a parent until one node is left. proof_sha256 is the digest of all siblings on the way up. folded_root is
    what ``claimed`` (a digest in hex, ``leaf`` where it is null) and these siblings come to; verified says that it is the
    root. A lone record is its own subroot. Repeated records are leaves each; an empty table gives no rows.
    """
    width = fan**height
    claimed = leaf if claimed is None else F.coalesce(claimed, leaf)
    tree = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))
    rows = cut_lineage(records.select(tree.alias("tree"), key.alias("key"), leaf.alias("leaf"), claimed.alias("claimed")))
    leaves = cut_lineage(in_places(rows, "tree", "key", "leaf"))
    layers = build_layers(leaves, fan, height)
    roots = tree_roots(layers, fan, height).select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"))
    roots = cut_lineage(in_places(roots, "tree", "key"))
    upper = build_layers(roots, fan, height)
    root = tree_roots(upper, fan, height).select("tree", F.col("root").alias("whole"), F.lit("").alias("path"))

    def group_paths(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({c: pa.array([], pa.string()) for c in ("tree", "subroot", "path", "whole")})
        block = right.slice(0, 1).to_pylist()[0]
        levels, rest = opened(block, fan, height)
        places = (left.column("pos").to_numpy() - block["block"] * width).tolist()
        paths = [joined_path(path_of(p, levels, rest, fan)) for p in places]
        return pa.table({"tree": left.column("key"), "subroot": left.column("leaf"), "path": paths, "whole": [block["whole"]] * len(paths)})

    names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def record_proofs(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table([left.column("key").slice(0, 0), *[pa.array([], pa.string())] * 5, pa.array([], pa.bool_())], names=names)
        block = right.slice(0, 1).to_pylist()[0]
        levels, rest = opened(block, fan, height)
        places = (left.column("pos").to_numpy() - block["block"] * width).tolist()
        proofs, folded = [], []
        for place, digest in zip(places, left.column("claimed").to_pylist(), strict=True):
            path = path_of(place, levels, rest, fan)
            proofs.append(parent("".join(a + b for a, b in path)))
            folded.append(fold(digest, path))
        n, whole = len(places), block["whole"]
        ends = [[block["subroot"]] * n, [whole] * n, proofs, folded, [f == whole for f in folded]]
        return pa.table([left.column("key"), left.column("leaf"), *map(pa.array, ends)], names=names)

    in_blocks = lambda df: df.withColumn("block", F.floor(F.col("pos") / width)).groupBy("tree", "block")
    met = in_blocks(roots).cogroup(with_paths(upper, root, fan, height).groupBy("tree", "block"))
    above = cut_lineage(met.applyInArrow(group_paths, "tree string, subroot string, path string, whole string"))
    met = in_blocks(leaves).cogroup(with_paths(layers, above, fan, height).groupBy("tree", "block"))
    kinds = ", ".join([f"key {dict(rows.dtypes)['key']}", *[f"{c} string" for c in names[1:-1]], "verified boolean"])
    return met.applyInArrow(record_proofs, kinds), layers, upper
