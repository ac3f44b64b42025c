"""Near copies among embeddings: balanced binary codes, multi-index Hamming tables, and the vectors themselves at the end.

Iterative quantisation turns the principal directions of the vectors so that their signs lose as little as possible; the
signs are the code. Each table holds one substring of the code. Two vectors meet in a table if their substrings differ in two
bits at most, as both stand under all strings one bit away from their own. Those whose whole codes are close enough are
compared by cosine.

Vectors so close to one leader that all of them must be linked with each other form a block, which goes through the tables as
one and is compared with another block by angles to the leaders where these leave no doubt. So a dense group of any size
costs the pairs of its blocks, not of its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilake.llm.common import components
from vigilake.session import cut_lineage

#: Values in the sample that the rotation is learned on (rows with the smallest hashes), and rounds of learning.
SAMPLE_VALUES, FIT_ROUNDS, SEED = 1 << 20, 30, 20240601
#: Tables are added until this share of partners planted at exactly the threshold meets in one; tables at most.
FOUND, MOST_TABLES = 0.98, 24
#: Partners that are planted at least. This share of them lies within the distance of whole codes that is looked at.
TRIALS, WITHIN = 8192, 0.995
#: Bits by which each side of a pair may be off in a table.
BALL = 1
#: Vectors that are searched for leaders at a time, and members of a block.
CHUNK, BLOCK = 1024, 256
#: Angles nearer to a bound than this are decided by the vectors.
DOUBT = 1e-7


@dataclass
class Codes:
    """Learned codes: table t takes the signs of ``(x - mean) @ directions[t]``."""

    mean: np.ndarray
    directions: np.ndarray
    radius: int  # whole codes of partners differ in so many bits at most

    def of(self, x: np.ndarray) -> np.ndarray:
        """A row of table substrings for each unit vector."""
        weights = 1 << np.arange(self.directions.shape[2], dtype=np.int64)
        return np.stack([((x - self.mean) @ d > 0) @ weights for d in self.directions], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_rotation(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The rotation of ``v`` whose signs are nearest to it, from a random start."""
    turn = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(FIT_ROUNDS):
        signs = np.where(v @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ signs)
        turn = left @ right
    return turn


def planted_partners(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector another one at exactly this cosine, in a random direction."""
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((away * away).sum(axis=1, keepdims=True))
    return cosine * x + np.sqrt(1 - cosine**2) * np.divide(away, length, out=np.zeros_like(away), where=length > 1e-12)


def fit_codes(x: np.ndarray, rows: int, cosine: float) -> Codes:
    """Codes for so many rows from a sample of unit vectors. Substrings have about as many bits as the number of rows."""
    rng = np.random.default_rng(SEED)
    mean, width = x.mean(axis=0), x.shape[1]
    bits = min(width, 40, max(2, ceil(log2(max(2, rows))) - 2))
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    one = np.tile(x, (ceil(TRIALS / len(x)), 1))
    partners = planted_partners(one, cosine, rng)
    found, differ, directions = np.zeros(len(one), dtype=bool), np.zeros(len(one), dtype=np.int64), []
    while len(directions) < MOST_TABLES and (not directions or found.mean() < FOUND):
        # as many whole tables as the directions give; the next rotation starts from another place
        use = min(width, bits * max(1, width // bits))
        top = vectors[:, ::-1][:, :use]
        turned = top @ learn_rotation((x - mean) @ top, rng)
        for at in range(0, use - bits + 1, bits):
            d = turned[:, at : at + bits]
            off = (((one - mean) @ d > 0) != ((partners - mean) @ d > 0)).sum(axis=1)
            found, differ = found | (off <= 2 * BALL), differ + off
            directions.append(d)
            if found.mean() >= FOUND:
                break
    return Codes(mean, np.stack(directions), int(np.quantile(differ, WITHIN, method="higher")))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _lists(x: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32), pa.array(x.ravel(), kind))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, CHUNK):
            yield batch.slice(low, CHUNK)


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def leaders(x: np.ndarray, close: float) -> np.ndarray:
    """For each unit vector the index of its leader, whose cosine to it is ``close`` at least; a leader leads itself."""
    near = x @ x.T >= close
    lead = np.arange(len(x))
    free = np.ones(len(x), dtype=bool)
    for i in np.flatnonzero(near.sum(axis=1) > 1):
        if free[i]:
            members = np.flatnonzero(near[i] & free)
            members = np.r_[i, members[members != i]][:BLOCK]
            lead[members], free[members] = i, False
    return lead


def coded(rows: DataFrame, codes: Codes) -> DataFrame:
    """Rows with the code of their vector, ``first`` is its first substring."""
    width = len(codes.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = codes.of(unit(_matrix(part.column("v"), width)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found[:, 0]), _lists(found, pa.int64())], names=[*part.schema.names, "first", "code"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, first long, code array<long>")


def in_blocks(rows: DataFrame, width: int, cosine: float) -> DataFrame:
    """Classes with their block (the leader's id), the leader's code, and angle and code distance to it."""
    close = np.sqrt((1 + cosine) / 2) + 1e-9  # two vectors as close as this to a third are linked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            x = unit(_matrix(part.column("v"), width))
            lead = leaders(x, close)
            code = _matrix_long(part.column("code"))
            off = np.bitwise_count(code ^ code[lead]).sum(axis=1, dtype=np.int32)
            cos = np.clip((x * x[lead]).sum(axis=1), -1, 1)
            angle = np.where(lead == np.arange(len(x)), 0.0, np.arccos(cos))
            ids = part.column("cid").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [part.column("cid"), part.column("copies"), part.column("v"), part.column("code"), pa.array(ids[lead]), _lists(code[lead], pa.int64()), pa.array(off), pa.array(angle)],
                names=["cid", "copies", "v", "code", "block", "lead", "off", "angle"],
            )

    # by ranges of the code, so that near ones lie together and no group has to fit a task
    near = rows.repartitionByRange("first", "code", "cid").sortWithinPartitions("first", "code", "cid").select("cid", "copies", "v", "code")
    return near.mapInArrow(run, "cid long, copies long, v array<double>, code array<long>, block long, lead array<long>, off int, angle double")


def table_rows(members: DataFrame, bits: int) -> DataFrame:
    """(t, key, block): the blocks under every string one bit away from a member's substring, in every table."""
    flips = np.r_[0, 1 << np.arange(bits, dtype=np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            if not part.num_rows:
                continue
            code = _matrix_long(part.column("code"))
            block = part.column("block").to_numpy()
            for t in range(code.shape[1]):
                keys = (code[:, t, None] ^ flips).ravel()
                rows = np.unique(np.stack([keys, np.repeat(block, len(flips))], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, dtype=np.int32)), pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["t", "key", "block"])

    return members.select("block", "code").mapInArrow(run, "t int, key long, block long")


def _matrix_long(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def near_blocks(members: DataFrame, blocks: DataFrame, codes: Codes) -> DataFrame:
    """Pairs (a, b) of blocks that meet in a table and whose codes allow partners."""
    tables, bits = codes.directions.shape[0], codes.directions.shape[2]
    known = table_rows(members, bits).join(blocks.select("block", "lead", "reach"), "block")
    side = lambda p: known.select("t", "key", *[F.col(c).alias(p + c) for c in ("block", "lead", "reach")])
    differ = sum((F.bit_count(F.get("alead", F.lit(i)).bitwiseXOR(F.get("blead", F.lit(i)))) for i in range(tables)), F.lit(0))
    meet = side("a").join(side("b"), ["t", "key"]).where((F.col("ablock") < F.col("bblock")) & (differ <= F.lit(codes.radius) + F.col("areach") + F.col("breach")))
    return meet.select(F.col("ablock").alias("a"), F.col("bblock").alias("b")).distinct()


def judge_blocks(pairs: DataFrame, blocks: DataFrame, width: int, cosine: float) -> DataFrame:
    """Pairs with what their leaders tell: all members are linked (true), or the members must be looked at (null)."""
    limit = float(np.arccos(cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            x, y = (unit(_matrix(part.column(c), width)) for c in ("av", "bv"))
            cos = (x * y).sum(axis=1)
            room = part.column("aangle").to_numpy() + part.column("bangle").to_numpy()
            angle = np.arccos(np.clip(cos, -1, 1))
            single = room == 0
            linked = np.where(single, cos >= cosine, angle + room <= limit - DOUBT)
            open_ = ~single & ~linked & (angle - room <= limit + DOUBT)
            keep = linked | open_
            whole = pa.array(linked, mask=~linked)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("a", "b", "aweight", "bweight")] + [whole], names=["a", "b", "aweight", "bweight", "linked"]).filter(pa.array(keep))

    side = lambda p: blocks.select(F.col("block").alias(p), *[F.col(c).alias(p + c) for c in ("v", "angle", "weight")])
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, aweight long, bweight long, linked boolean")


def member_links(pairs: DataFrame, members: DataFrame, width: int, cosine: float) -> DataFrame:
    """(a, b, cid, links): how many vectors of the other block each member of a pair of blocks is linked with."""
    whole = members.groupBy("block").agg(F.collect_list(F.struct("cid", "copies", "v")).alias("m"))  # at most BLOCK members

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                sides = [one.column(c).flatten() for c in ("am", "bm")]
                x, y = (unit(_matrix(s.field("v"), width)) for s in sides)
                near = x @ y.T >= cosine
                ids = [s.field("cid").to_numpy() for s in sides]
                copies = [s.field("copies").to_numpy() for s in sides]
                links = [near @ copies[1], near.T @ copies[0]]
                cid, count = np.concatenate(ids), np.concatenate(links).astype(np.int64)
                hit = count > 0
                n = int(hit.sum())
                a, b = (np.full(n, one.column(c)[0].as_py(), dtype=np.int64) for c in ("a", "b"))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, cid[hit], count[hit])], names=["a", "b", "cid", "links"])

    side = lambda p: whole.select(F.col("block").alias(p), F.col("m").alias(p + "m"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, "a long, b long, cid long, links long")


def near_copies(vectors: DataFrame, cosine: float = 0.9, vector: str = "embedding") -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other rows whose cosine, in double precision, is ``cosine`` or more, of those found; component_id is
    the smallest vec_id reachable by links, itself included; kept says that it is the row's own. All links below are true;
    a pair at exactly the threshold is found with probability ``FOUND`` at least, as measured on partners planted in the
    sample, and nearer pairs with more.

    Vectors that are null, zero, of another length than most or hold null or non-finite components link with nothing: no
    links, their own component, kept. Equal vectors are one class and linked with each other. Rows that repeat a vec_id are
    vectors each. Null vec_ids are not the smallest; a component of only such rows has a null component_id and all of it is
    kept. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")), F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 is 0.0
    rows = cut_lineage(rows.withColumns({"h1": F.xxhash64(F.lit(1), "v"), "h2": F.xxhash64(F.lit(2), "v")}))
    sizes = rows.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    if not sizes:
        return rows.select("vec_id", *alone)
    width = sizes[0].n
    takes_part = F.coalesce(F.size("v") == width, F.lit(False))
    classes = rows.where(takes_part).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()))

    few = max(256, SAMPLE_VALUES // width)
    sample = classes.orderBy("h1", "h2").limit(few).select("v").toArrow()
    codes = fit_codes(unit(_matrix(sample.column("v"), width)), classes.count(), cosine)
    members = cut_lineage(in_blocks(coded(classes.select("cid", "copies", "v"), codes), width, cosine))
    blocks = members.groupBy("block").agg(
        F.sum("copies").alias("weight"), F.max("off").alias("reach"), F.max("angle").alias("angle"), F.first("lead").alias("lead"),
        F.min_by("v", F.struct(F.col("cid") != F.col("block"), F.col("cid"))).alias("v"),
    )
    blocks = cut_lineage(blocks)
    judged = cut_lineage(judge_blocks(near_blocks(members, blocks, codes), blocks, width, cosine))
    sure, doubt = judged.where("linked"), judged.where("linked is null")
    looked = cut_lineage(member_links(doubt, members, width, cosine))

    edges = sure.select("a", "b").unionByName(looked.select("a", "b").distinct())
    roots = components(edges, "a", "b").select(F.col("node").alias("block"), "root")
    ends = F.explode(F.array(F.struct(F.col("a").alias("block"), F.col("bweight").alias("n")), F.struct(F.col("b").alias("block"), F.col("aweight").alias("n")))).alias("e")
    of_blocks = sure.select(ends).groupBy("e.block").agg(F.sum("e.n").alias("by_block"))
    of_members = looked.groupBy("cid").agg(F.sum("links").alias("by_member"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = (
        members.select("cid", "block").join(blocks.select("block", "weight"), "block").join(of_blocks, "block", "left").join(of_members, "cid", "left")
        .join(roots, "block", "left").join(classes.select("cid", "h1", "h2", "least"), "cid")
        .select("h1", "h2", "least", F.coalesce("root", "block").alias("root"), (F.col("weight") - 1 + zero("by_block") + zero("by_member")).alias("n_links"))
    )
    found = cut_lineage(found)
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    known = found.join(least, "root").select("h1", "h2", "n_links", "component_id")
    linked = rows.where(takes_part).select("vec_id", "h1", "h2").join(known, ["h1", "h2"])
    linked = linked.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(rows.where(~takes_part).select("vec_id", *alone))
