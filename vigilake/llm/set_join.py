"""All pairs of shingle sets over a Jaccard similarity, joined into groups; nothing is lost at any size.

A node is a distinct shingle set. Two sets of similarity t share at least t times the larger size, so in any common order of
all shingles they meet in the first ``n - ceil(t n) + 1`` of each (the prefix). Shingles often seen in a sample come last in
that order, which keeps common passages out of the prefixes; the sample bears on the cost only. The nodes with one prefix
shingle are a group. Pairs of a group whose nodes are joined already are left out, all others are looked at: by size, by a
lower bound of their difference, and then by their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vigilake.llm.common import folded_words, majority, shingle_hashes, shingle_set
from vigilake.session import cut_lineage

#: Sets in the sample that orders the shingles, and how many of its shingles come last.
SAMPLE, COMMON = 10_000, 100_000
#: Rows of a group that are compared at a time.
BLOCK = 1024
#: For sums of floats that stand for whole numbers.
TINY = 1e-9


def signature(shingles: np.ndarray) -> bytes:
    """Parity of the shingles by their low bits, in about two bits per shingle; two sets differ at least by the bits that differ."""
    bits = 1 << min(15, max(6, (2 * len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def shingle_nodes(docs: DataFrame, words: int) -> DataFrame:
    """The rows of docs, columns renamed c0, c1, ..., with (rid, node, n, sig, fp, text).

    The node stands for the shingle set, n is its size, fp its SimHash with repeats. No words are node 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                blocks = list(shingle_hashes(folded_words((text or "").encode()), words))
                s = np.unique(np.concatenate(blocks)) if blocks else np.empty(0, dtype=np.uint64)
                found.append((xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0, len(s), signature(s), majority(blocks)))
            node, n, sig, fp = zip(*found) if found else [()] * 4
            columns = [pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(fp, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "node", "n", "sig", "fp"])

    at = docs.columns.index("text")
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows = rows.select("*", F.monotonically_increasing_id().alias("rid"), F.col(f"c{at}").cast("string").alias("text")).drop(f"c{at}")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, node long, n int, sig binary, fp long")


def common_shingles(nodes: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found more than once in a sample of the sets, sorted, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], names=["h"])

    every = max(1, nodes.count() // SAMPLE)
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(run, "h long").groupBy("h").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "h").limit(COMMON).toPandas()
    h, often = rows["h"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], often[order]


def in_order(shingles: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The sorted shingles, common ones last and the most common at the end."""
    if not len(common) or not len(shingles):
        return shingles
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    hit = common[at] == shingles
    return np.r_[shingles[~hit], shingles[hit][np.argsort(often[at[hit]], kind="stable")]]


def prefix_groups(nodes: DataFrame, roots: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (g, node, n, r): groups of nodes of several roots with a prefix shingle in common, r is the place by size. Equal groups are one."""
    shared = nodes.sparkSession.sparkContext.broadcast(common)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        for batch in batches:
            out = []
            for text, size in zip(batch.column("text").to_pylist(), batch.column("n").to_pylist(), strict=True):
                out.append(in_order(shingle_set(text, words), common, often)[: size - math.ceil(similarity * size - TINY) + 1])
            many = [len(p) for p in out]
            h = np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)
            rest = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), many) for c in ("node", "n", "root")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, *rest)], names=["h", "node", "n", "root"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[list[np.ndarray]] = []  # a group that may go on in the next batch
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "node", "n", "root")]
            if not len(new[0]):
                continue
            held.append(new)
            if held[0][0][0] == new[0][-1]:
                continue
            whole = [np.concatenate(c) for c in zip(*held)]
            tail = int(np.argmax(whole[0] == whole[0][-1]))
            yield from found(*(c[:tail] for c in whole), seen)
            held = [[c[tail:] for c in whole]]
        if held:
            yield from found(*(np.concatenate(c) for c in zip(*held)), seen)

    def found(h, node, n, root, seen):
        new = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]  # a set may have several rows
        h, node, n, root = h[new], node[new], n[new], root[new]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[first, len(h)])
        mixed = node.view(np.uint64) ^ (node.view(np.uint64) >> np.uint64(31))
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
        group = np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), first).view(np.int64)
        several = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        pick = [k for k in np.flatnonzero(several) if group[k] not in seen and not seen.add(group[k])]
        if len(seen) > 1 << 20:
            seen.clear()
        if pick:
            take = np.zeros(len(first), dtype=bool)
            take[pick] = True
            rows = np.repeat(take, sizes)
            place = np.arange(len(h)) - np.repeat(first, sizes)
            columns = (np.repeat(group, sizes)[rows], node[rows], n[rows], place[rows])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["g", "node", "n", "r"])

    rows = nodes.where("n > 0").select("node", "n", "text").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rows.select("node", "n", "root", "text").mapInArrow(prefixes, "h long, node long, n int, root long")
    dealt = rows.repartition("h").sortWithinPartitions("h", "n", "node")
    return cut_lineage(dealt.mapInArrow(groups, "g long, node long, n int, r long").distinct())


def close_pairs(n: np.ndarray, place: np.ndarray, root: np.ndarray, sigs: list[bytes], apart: np.ndarray, low: int, high: int | None, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the later rows of another block (of any if ``apart`` is all alike) that may be as similar."""
    width = np.array([len(s) for s in sigs])
    folded, start = {}, {}
    one_block = apart.all()
    room = (1 - similarity) / (1 + similarity)
    for p in range(len(n) - 1):
        if not one_block and apart[p] != apart[0]:
            break
        q = np.arange(p + 1, len(n))
        far = place[p + 1 :] - place[p]
        q = q[(far > low) & ((far <= high) if high is not None else True) & (similarity * n[p + 1 :] <= n[p] + TINY) & (root[p + 1 :] != root[p]) & (one_block | (apart[p + 1 :] != apart[p]))]
        if not len(q):
            continue
        w = int(width[p])  # rows are sorted by size, so later ones are as wide at least
        if w not in folded:
            start[w] = int(np.argmax(width >= w))
            folded[w] = np.array([fold_to(s, w) for s in sigs[start[w] :]])
        table = folded[w]
        differ = np.bitwise_count(table[q - start[w]] ^ table[p - start[w]]).sum(axis=1, dtype=np.int64)
        q = q[differ <= room * (n[p] + n[q].astype(np.int64)) + TINY]
        if len(q):
            yield p, q


def fold_to(sig: bytes, width: int) -> np.ndarray:
    out = np.frombuffer(sig, dtype=np.uint8)
    while len(out) > width:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def candidates(groups: DataFrame, sigs: DataFrame, roots: DataFrame, low: int, high: int | None, similarity: float) -> DataFrame:
    """Different pairs (a, b) of nodes that are not joined yet, with places more than ``low`` and at most ``high`` apart."""
    live = groups.withColumn("blk", F.floor(F.col("r") / BLOCK)).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = live.groupBy("g", "blk").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("from"), F.max("root").alias("to"), F.max("r").alias("last"))
    side = lambda p: blocks.select("g", *[F.col(c).alias(p + c) for c in blocks.columns if c != "g"])
    reach = F.lit(True) if high is None else (F.col("jblk") - F.col("iblk") - 1) * BLOCK < high
    work = side("i").join(side("j"), "g").where(
        (F.col("iblk") <= F.col("jblk")) & reach & (F.lit(similarity) * F.col("jleast") <= F.col("imost") + TINY)
        & (F.least("ifrom", "jfrom") != F.greatest("ito", "jto")) & (F.col("jlast") - F.col("iblk") * BLOCK > low)
    ).select("g", F.col("iblk").alias("i"), F.col("jblk").alias("j"))
    ends = work.select("g", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"))
    rows = live.join(ends, ["g", "blk"]).join(sigs, "node").select("g", "i", "j", "blk", "r", "n", "node", "root", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            if not len(held):
                continue
            g, i, j = (held.column(c).to_numpy(zero_copy_only=False) for c in ("g", "i", "j"))
            tail = int(np.argmax((g == g[-1]) & (i == i[-1]) & (j == j[-1])))
            if tail:
                yield from pairs(held.slice(0, tail))
                held = held.slice(tail)
        if held is not None and len(held):
            yield from pairs(held)

    def pairs(rows):
        g, i, j, blk, r, n, node, root = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("g", "i", "j", "blk", "r", "n", "node", "root"))
        sig = rows.column("sig").to_pylist()
        cuts = np.r_[np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]), len(g)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            apart = np.ones(e - s, dtype=bool) if i[s] == j[s] else blk[s:e] == i[s]
            for p, q in close_pairs(n[s:e], r[s:e], root[s:e], sig[s:e], apart, low, high, similarity):
                a, b = np.minimum(node[s + p], node[s + q]), np.maximum(node[s + p], node[s + q])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "r")
    return cut_lineage(dealt.mapInArrow(run, "a long, b long").distinct())


def confirmed(pairs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose sets share at least ``similarity`` of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = shingle_set(left.as_py(), words), shingle_set(right.as_py(), words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = cut_lineage(nodes.select("node", "text").join(ends, "node").dropDuplicates(["node"]))  # all texts of a node have its set
    side = lambda key, name: texts.select(F.col("node").alias(key), F.col("text").alias(name))
    return cut_lineage(pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").mapInArrow(run, "a long, b long"))
