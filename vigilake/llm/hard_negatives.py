"""Hard negatives by exact integer scores, thousands of them from one multiplication per component.

In a cell of rows, the components of one dimension are made non-negative by a bias and laid side by side in fields of one
wide integer (Kronecker packing). An anchor multiplies each of these integers by its own component and adds them up; fields
are wide enough that none runs over into the next, so all scores stand in the sum and are cut out of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from math import ceil, log2
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilake.session import cut_lineage

#: Components are floor(SCALE * x).
SCALE = 256
#: Rows and anchors that meet in one task call at most.
CELL_ROWS, CELL_ANCHORS = 8192, 2048


class PackedRows:
    """The rows of an integer matrix, packed by dimension."""

    def __init__(self, rows: np.ndarray, anchor_sum: int):
        """``anchor_sum``: what the absolute components of an anchor come to at most."""
        self.count = len(rows)
        self.bias = max(0, -int(rows.min()))
        self.top = int(rows.max()) + self.bias
        self.field = "<u4" if anchor_sum * self.top < 1 << 32 else "<u8"
        wide = (rows + self.bias).astype(self.field)
        self.columns = [int.from_bytes(np.ascontiguousarray(wide[:, i]).tobytes(), "little") for i in range(rows.shape[1])]
        self.ones = int.from_bytes(np.ones(self.count, dtype=self.field).tobytes(), "little")

    def scores(self, anchor: Iterable[int]) -> np.ndarray:
        """Inner products of all rows with the anchor, exact."""
        anchor = [int(a) for a in anchor]
        lift = -sum(a for a in anchor if a < 0) * self.top  # keeps every field from going below zero
        total = sum(map(mul, self.columns, anchor), self.ones * lift)
        fields = np.frombuffer(total.to_bytes(self.count * int(self.field[2]), "little"), dtype=self.field)
        return fields.astype(np.int64) - (lift + self.bias * sum(anchor))


def scaled_rows(vectors: DataFrame, label: Column, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows (row, vec_id, label, x) that take part, x the whole-number components, and their number of components."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = sizes[0].n if sizes else 0
    most = float(1 << (62 - 7 - ceil(log2(max(2, width)))) // 2)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x * SCALE))).cast("long"))
    return rows.where(F.size("v") == width).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("x")), width


def in_cells(rows: DataFrame, anchors: DataFrame, by: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors of one ``by`` (None: all) dealt to cells (by, block, turn), so that each row meets each anchor once.

    A row is in one block of about ``CELL_ROWS`` and goes to every turn of anchors; an anchor is in one turn.
    """
    if by is None:
        sizes = {"blocks": ceil(rows.count() / CELL_ROWS), "turns": ceil(anchors.count() / CELL_ANCHORS)}
        known = lambda df: df.withColumns({c: F.lit(n).cast("long") for c, n in sizes.items()})
    else:
        count = lambda df, most, name: df.groupBy(by).agg(F.ceil(F.count("*") / most).alias(name))
        by_key = cut_lineage(count(rows, CELL_ROWS, "blocks").join(count(anchors, CELL_ANCHORS, "turns"), by))
        known = lambda df: df.join(by_key, by)
    part = lambda c: F.pmod(F.xxhash64("row"), F.col(c))
    every = lambda c: F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col(c)), lambda i: i < F.col(c)))
    left = known(rows).withColumn("block", part("blocks")).withColumn("turn", every("turns"))
    right = known(anchors).withColumn("turn", part("turns")).withColumn("block", every("blocks"))
    return left.drop("blocks", "turns"), right.drop("blocks", "turns")


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def first_of(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, index: np.ndarray, k: int) -> np.ndarray:
    """Of the rows in ``index`` the first ``k``: higher scores, then smaller ids."""
    if len(index) > k:
        some = scores[index]
        index = index[some >= np.partition(some, len(some) - k)[len(some) - k]]
    return index[np.lexsort((rows[index], ids[index], -scores[index]))[:k]]


def _cell(width: int, pick: Callable) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Anchors and rows of one cell to the rows that ``pick`` chooses for each anchor from all scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            anchors, names = _matrix(left.column("x"), width), left.column("row").to_pylist()
            rows, ids, labels = (right.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            packed = PackedRows(_matrix(right.column("x"), width), int(np.abs(anchors).sum(axis=1).max()))
            given = left.drop_columns(["x"]).to_pylist()
            for name, anchor, own in zip(names, anchors, given, strict=True):
                scores = packed.scores(anchor)
                for place, found in pick(own, scores, ids, rows, labels):
                    out += [(name, place, int(rows[i]), int(ids[i]), int(scores[i])) for i in found]
        columns = list(zip(*out)) or [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "place", "row", "vec_id", "score"), columns)})

    return run


_FOUND = "anchor long, place long, row long, vec_id long, score long"


def hard_negatives(vectors: DataFrame, label: Column, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   vector: str = "embedding") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``every``; all rows are candidates. A score is the inner product of
    the whole-number components; higher scores come first, ties by smaller vec_id. An anchor's positives are its first other
    rows of the same label; a positive's negatives are the first rows of other labels whose score lies between ``low`` and
    ``high`` hundredths of the positive's.

    Rows with a null label, null vector or a null or non-finite component take no part, nor do rows without a number or of
    another length than most. Zero vectors do. Repeated rows each count, also as anchors. Components are clamped so that
    every score, times 100, fits a long (at 64 components to 2^24, that is x to 65536). A positive with no row in its range
    (as with a negative score) gives no rows; an empty table neither. Other columns are ignored.
    """
    rows, width = scaled_rows(vectors, label, vector)
    if not width:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = cut_lineage(rows)
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select([F.col(c).alias(c) for c in rows.columns])  # columns of their own

    def same_label(own, scores, ids, names, labels):
        yield 0, first_of(scores, ids, names, np.flatnonzero(names != own["row"]), positives)

    def in_range(own, scores, ids, names, labels):
        other = np.flatnonzero(labels != own["label"])
        some = 100 * scores[other]
        for place, score in zip(own["places"], own["goals"], strict=True):
            yield place, first_of(scores, ids, names, other[(some >= low * score) & (some <= high * score)], negatives)

    def best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def meet(a: DataFrame, by: str | None, pick: Callable) -> DataFrame:
        left, right = in_cells(rows, a, by)
        cell = [c for c in (by, "block", "turn") if c]
        return right.groupBy(*cell).cogroup(left.groupBy(*cell)).applyInArrow(_cell(width, pick), _FOUND)

    alike = cut_lineage(best(meet(anchors, "label", same_label), positives).select(
        "anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    goals = alike.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("g"))  # a few per anchor
    asked = cut_lineage(anchors.join(goals.select(F.col("anchor").alias("row"), F.col("g.place").alias("places"), F.col("g.positive_score").alias("goals")), "row"))
    apart = best(meet(asked, None, in_range), negatives)
    return (
        apart.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(alike, ["anchor", "place"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
