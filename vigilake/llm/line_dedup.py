"""Line deduplication: lines that stand in many documents are taken out of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilake.llm.common import BLANKS, LOWER, UPPER
from vigilake.session import cut_lineage, salted_join

#: Frequent lines (16 bytes each) that are sent to all tasks at most.
BROADCAST_LINES = 200_000
_WS = "' \\t\\n\\u000B\\f\\r'"
_LINES = "split(coalesce(text, ''), '\\n', -1)"
_KEYS = f"transform(split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '\\n', -1), x -> trim(BOTH {_WS} FROM x))"
assert BLANKS == " \t\n\x0b\x0c\r"


def _hashed(rows: DataFrame, line: str) -> DataFrame:
    """128 bits of hash for each line key, as two longs, which group faster than strings or binary values."""
    return rows.withColumn("h1", F.xxhash64(line)).withColumn("h2", F.xxhash64(F.lit("second"), F.col(line)))


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int = 1) -> DataFrame:
    """Hashes (h1, h2) of the line keys found in at least ``min_docs`` documents, with that number.

    A document counts once however often it repeats a line, so counts are plain partial sums: a line in a third of all
    documents comes from each task as one row.
    """
    keys = docs.select(F.explode(F.expr(f"array_distinct(filter({_KEYS}, x -> char_length(x) >= {int(min_chars)}))")).alias("line"))
    return _hashed(keys, "line").groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Each document without its frequent lines: doc_id, kept_text, n_lines, n_dropped.

    A line's key is the line without blanks at both ends and with A-Z in lower case; keys shorter than ``min_chars`` code
    points are never frequent. Every row is a document, also where rows repeat a doc_id. A null text is one empty line.
    Where all lines go the kept text is empty. An empty table gives no rows.

    Lines are shuffled as hashes only. The places to drop come back per document, and each text moves once at most, to
    meet its places.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    frequent = cut_lineage(frequent_lines(docs, min_docs, min_chars)).select("h1", "h2")
    few = frequent.count() <= BROADCAST_LINES
    marked = docs.withColumn("row_key", F.xxhash64("text"))
    lines = _hashed(marked.select("doc_id", "row_key", F.posexplode(F.expr(_KEYS)).alias("place", "line")), "line")
    lines = lines.select("doc_id", "row_key", "place", "h1", "h2")
    # a line of a third of all documents is one key: few frequent lines go to all tasks, of many each hot one is salted
    hit = lines.join(F.broadcast(frequent), ["h1", "h2"], "left_semi") if few else salted_join(lines, frequent, ["h1", "h2"], ["row_key", "place"], "left_semi")
    places = (
        hit
        .groupBy("doc_id", "row_key").agg(F.collect_set("place").alias("drop"))
        .withColumnsRenamed({"doc_id": "_id", "row_key": "_key"})
    )
    met = marked.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left")
    kept = f"transform(array_except(sequence(0, size({_LINES}) - 1), drop), i -> lines[i])"
    kept = f"transform(array({_LINES}), lines -> array_join({kept.replace(_LINES, 'lines')}, '\\n'))[0]"
    return met.select(
        "doc_id", F.expr(f"if(drop is null, coalesce(text, ''), {kept})").alias("kept_text"),
        F.expr(f"cast(size({_LINES}) as long)").alias("n_lines"), F.expr("cast(coalesce(size(drop), 0) as long)").alias("n_dropped"),
    )
