"""What several operators share: words, shingle hashes, row slices of Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vigilake.session import cut_lineage

#: Blank characters of all contracts: space and \t \n \v \f \r. ``bytes.split()`` splits at exactly these.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
WORD = r"[^\x20\x09-\x0D]+"
#: Shingles hashed at a time: bounds the memory one long text takes.
BLOCK = 1 << 15


def fold(text: str | Column) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: str | Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def folded_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all word shingles in blocks; fewer words than ``size`` are one shingle, none give nothing."""
    if not words:
        return
    count = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    for start in range(0, count, BLOCK):
        stop = min(count, start + BLOCK)
        yield np.array([digest(b" ".join(words[i : i + size]), 42) for i in range(start, stop)], dtype=np.uint64)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """SimHash of hashes: 64 bits, each set where over half of the hashes have it set; none give zero. As a signed long."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little", signed=True) if total else 0


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    blocks = list(shingle_hashes(folded_words((text or "").encode()), size))
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, dtype=np.uint64)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column one by one as bytes, null as empty."""
    binary = column.cast(pa.large_binary())
    for value in binary:
        yield value.as_py() or b""


#: Bytes of text, and rows, in a slice of a batch.
SLICE_BYTES, SLICE_ROWS = 1 << 28, 1000


def byte_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded sum of text, so that offsets of 32 bits hold; one text may be over the bound."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    low, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and (total + size > SLICE_BYTES or i - low >= SLICE_ROWS):
            yield batch.slice(low, i - low)
            low, total = i, 0
        total += size
    if low < len(sizes):
        yield batch.slice(low)


#: Links that a task joins at a time.
TOGETHER = 1 << 21


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components by fewer links: each node of a component with its smallest node."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        low, before = np.minimum(x, y), label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    far = label != np.arange(len(nodes))
    return nodes[label[far]], nodes[far]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, joined in bounded lots."""

    def out(held):
        u, v = local_stars(*(np.concatenate(c) for c in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held, count = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("u", "v")])
        count += batch.num_rows
        if count > TOGETHER:
            yield out(held)
            held, count = [], 0
    if count:
        yield out(held)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of any number of links between longs: one row (node, root) per node that has a link.

    Each task first joins the links it has. Then, in rounds, every node joins its smallest neighbour, or in every other round
    the one with the smallest hash, and the graph is contracted; on average a fixed share of the nodes goes in two rounds, so
    long chains take few rounds too. Minima are partial aggregates, so a node with very many links is no burden, and each round is a
    written table.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u <> v")
    live = cut_lineage(ends.mapInArrow(_stars, "u long, v long"))
    steps = []
    while not live.isEmpty():
        turn = len(steps)  # the centres of the tasks' stars are their smallest nodes
        rank = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(turn)) if turn % 2 else F.col(c)).alias("h"), F.col(c).alias("n"))
        ends = F.explode(F.array(
            F.struct(F.col("u").alias("node"), F.least(rank("u"), rank("v")).alias("best")),
            F.struct(F.col("v").alias("node"), F.least(rank("u"), rank("v")).alias("best")),
        )).alias("e")
        step = cut_lineage(
            live.select(ends).select("e.*").groupBy("node").agg(F.min("best").alias("best"))
            .select("node", F.col("best.n").alias("root"))
        )
        to = lambda a, b: step.select(F.col("node").alias(a), F.col("root").alias(b))
        met = live.join(to("u", "a"), "u").join(to("v", "b"), "v").where("a <> b")
        live = cut_lineage(met.select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_stars, "u long, v long"))
        steps.append(step)
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("_top"))
        out = step.join(later, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return cut_lineage(out) if len(steps) > 1 else out
