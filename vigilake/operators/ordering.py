"""Orders, top lists, numbering and line neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilake.functions.text import split_lines
from vigilake.session import cut_lineage

PATH = "location.path"
#: Rows that one task sorts when rows are numbered.
ROWS_PER_SORT = 200_000


def finding_order() -> list[Column]:
    """Most severe first, then by place."""
    return [
        F.desc("severity_rank"), F.col(PATH), F.col("location.line_start"), F.col("location.column_start"),
        F.col("rule_id"), F.col("id"),
    ]


def sort_by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*finding_order())


def top_k(df: DataFrame, column: str, k: int, key: str) -> DataFrame:
    """The ``k`` largest rows; ties go by key. Every task keeps its own ``k``."""
    return df.orderBy(F.desc(column), key).limit(k)


def analyzer_ranking(findings: DataFrame) -> DataFrame:
    """Analyzers by number of findings, most first, with their rank. One row per analyzer, so the window is tiny."""
    counts = findings.groupBy("analyzer").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "analyzer")))


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """Number rows 1, 2, 3 ... inside each group of ``by``, however large a group is.

    A plain window would put a whole group into one task. Here rows are range-partitioned by the full order, numbered
    inside their partition, and shifted by what the partitions before hold. The ranges are sampled, so the rows are
    written to the checkpoint folder before they are read twice. The number of ranges follows the number of rows, so
    what a task sorts does not grow with the input.
    """
    # sampling the ranges and dealing the rows both read the input, so it is computed once beforehand
    held = cut_lineage(df)
    ranges = max(-(-held.count() // ROWS_PER_SORT), held.sparkSession.sparkContext.defaultParallelism)
    keys = [*[F.col(c) for c in by], *order]
    # the high bits are the partition and the low ones the place in it
    placed = held.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    rows = cut_lineage(placed.withColumns({
        "_part": F.shiftright("_id", 33), "_n": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
    }).drop("_id"))
    # one row per partition and group that meet: a number of partitions, not of rows
    sizes = rows.groupBy(*by, "_part").agg(F.count("*").alias("_size"), F.min("_n").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, "_part", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(shifts, [*by, "_part"]).withColumn(name, F.col("_n") + F.col("_shift")).drop("_part", "_n", "_shift")


def number_findings(findings: DataFrame) -> DataFrame:
    """Number findings inside their severity, in report order."""
    return number_rows(findings, ["severity"], finding_order()[1:])


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The newest row per key, by a partial maximum."""
    rest = [c for c in df.columns if c not in keys]
    order = [*by, *(c for c in rest if c not in by)]
    return df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_m")).select(
        *[F.col(c) if c in keys else F.col(f"_m.{c}").alias(c) for c in df.columns]
    )


def _near(array: str, n: int, at: Column) -> Column:
    """The part of an array within ``n`` of a 0-based place."""
    first = F.greatest(at - n, F.lit(0))
    return F.slice(array, first + 1, F.least(at + n, F.size(array) - 1) - first + 1)


def text_windows(
    files: DataFrame, n: int = 3, keys: Sequence[str] = ("path",), text: str = "text", mode: str = "universal",
    hit: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Lines of texts (those that pass ``hit``) with the lines within ``n`` of them as snippet.

    The text of a file is one row, so its lines are at hand and nothing is shuffled.
    """
    lines = files.select(*keys, split_lines(F.col(text), mode).alias("_lines"))
    rows = lines.select(*keys, "_lines", F.posexplode("_lines").alias("_i", "line"))
    if hit is not None:
        rows = rows.where(hit(F.col("line")))
    return rows.select(*keys, (F.col("_i") + 1).alias("line_no"), "line", F.array_join(_near("_lines", n, F.col("_i")), "\n").alias("snippet"))


def text_lines_near(
    files: DataFrame, hit: Callable[[Column], Column], n: int = 2, keys: Sequence[str] = ("path",), text: str = "text", mode: str = "universal"
) -> DataFrame:
    """Lines of texts that pass ``hit`` and the lines within ``n`` of them, each once and without a shuffle."""
    lines = files.select(*keys, split_lines(F.col(text), mode).alias("_lines")).withColumn("_hits", F.transform("_lines", hit))
    rows = lines.select(*keys, "_hits", F.posexplode("_lines").alias("_i", "line"))
    return rows.where(F.array_contains(_near("_hits", n, F.col("_i")), True)).select(*keys, (F.col("_i") + 1).alias("line_no"), "line")


_CHUNK = 512


def snippet_window(
    lines: DataFrame, n: int = 3, keys: Sequence[str] = ("path",), line_no: str = "line_no", line: str = "line"
) -> DataFrame:
    """Add the lines within ``n`` of every line.

    Lines are dealt to stretches of 512 and each stretch borrows ``n`` lines on both sides, so even a file with a
    third of all lines is spread over many tasks, and no window holds more than a stretch.
    """
    chunk = F.floor(F.col(line_no) / _CHUNK)
    homes = F.array_distinct(F.array(
        chunk, F.floor((F.col(line_no) - n) / _CHUNK), F.floor((F.col(line_no) + n) / _CHUNK)
    ))
    spread = lines.withColumn("_home", chunk).withColumn("_chunk", F.explode(homes))
    window = Window.partitionBy(*keys, "_chunk").orderBy(line_no).rowsBetween(-n, n)
    return (
        spread.withColumn("snippet", F.array_join(F.collect_list(line).over(window), "\n"))
        .where(F.col("_home") == F.col("_chunk"))
        .drop("_home", "_chunk")
    )


def snippet_context(
    hits: DataFrame, lines: DataFrame, n: int = 3, keys: Sequence[str] = ("path",), line_no: str = "line_no", line: str = "line"
) -> DataFrame:
    """Add the lines around hits, for hits and lines that come as two tables.

    Each hit asks for its 2n+1 lines, which makes the range join an equi join on (file, line) that no file can skew.
    """
    wanted = hits.select(*keys, line_no).distinct()
    asked = wanted.select(
        *keys, F.col(line_no).alias("_hit"),
        F.explode(F.sequence(F.greatest(F.col(line_no) - n, F.lit(1)), F.col(line_no) + n)).alias(line_no),
    )
    found = asked.join(lines.select(*keys, line_no, line), [*keys, line_no])
    # at most 2n+1 lines per group
    around = found.groupBy(*keys, "_hit").agg(F.array_sort(F.collect_list(F.struct(line_no, line))).alias("_l")).select(
        *keys, F.col("_hit").alias(line_no), F.array_join(F.transform("_l", lambda x: x[line]), "\n").alias("snippet")
    )
    return hits.join(around, [*keys, line_no], "left")


def lines_of_interest(
    wanted: DataFrame, lines: DataFrame, n: int = 2, keys: Sequence[str] = ("path",), line_no: str = "line_no"
) -> DataFrame:
    """Requested lines and their neighbours, each once. Lines that do not exist bring no neighbours."""
    asked = wanted.select(*keys, line_no).distinct().join(lines.select(*keys, line_no), [*keys, line_no], "left_semi")
    near = asked.select(*keys, F.explode(F.sequence(F.col(line_no) - n, F.col(line_no) + n)).alias(line_no)).distinct()
    return lines.join(near, [*keys, line_no], "left_semi")
