"""Exact deduplication over content-defined chunks.

Texts are cut where a rolling hash of the last 32 bytes says so, so equal stretches give equal chunks wherever they stand.
The bytes of every chunk travel once, to be compared with all chunks of the same fingerprint; from then on a text is its
recipe: the ordered list of verified chunk identifiers, about one long per kilobyte. Recipes decide which texts are equal.

An identifier is a 64-bit fingerprint plus an ordinal among the different chunks that share the fingerprint. The ordinal is
0 but for true collisions, so it is kept only where it is not (``marks``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from vigilake.llm.common import byte_slices
from vigilake.session import cut_lineage

REACH = 32
_SEGMENT = 1 << 20
#: A random number for each byte value, from a fixed seed: the same cuts on every machine.
_GEAR = np.random.default_rng(20240601).integers(0, 1 << 32, 256, dtype=np.uint32)


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes that end at each place: byte i places back counts shifted left by i."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def _marked_places(data: np.ndarray, bits: int) -> np.ndarray:
    """Places after which a cut may be made, found in stretches of a megabyte."""
    found = []
    for start in range(0, len(data), _SEGMENT):
        base = max(0, start - REACH + 1)
        h = _rolling(data[base : start + _SEGMENT])
        places = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + base
        found.append(places[places >= start])
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def chunk_ends(data: np.ndarray, starts: np.ndarray, bits: int, least: int, most: int) -> list[list[int]]:
    """Ends of the chunks of each text in a buffer. ``starts`` has one more entry than there are texts.

    ``least`` is above the reach of the hash, so what stands before a text never decides a cut in it.
    """
    places = _marked_places(data, bits) + 1
    lows, highs = np.searchsorted(places, starts[:-1], "right"), np.searchsorted(places, starts[1:], "left")
    out = []
    for begin, end, low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), lows, highs, strict=True):
        ends, last = [], begin
        for place in [*places[low:high].tolist(), end]:
            while place - last > most:
                last += most
                ends.append(last)
            if place - last >= least or (place == end and place > last):
                ends.append(place)
                last = place
        out.append(ends)
    return out


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts, without a copy of the bytes."""
    texts = column.fill_null("").cast(pa.large_binary())
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


def _chunker(mode: str, bits: int, least: int, most: int, fingerprint_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What an executor runs. ``chunks``: fingerprint and bytes of all chunks; ``recipes``: a row per text;
    ``places``: chunks with the text they are in and their place."""
    keep = 64 - fingerprint_bits

    def print_of(piece) -> int:
        value = xxhash.xxh64_intdigest(piece, 42) >> keep
        return value - (1 << 64) if value >> 63 else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                data, starts = _buffer(part.column("text"))
                ends = chunk_ends(data, starts, bits, least, most)
                view = memoryview(data)
                prints = []
                for begin, own in zip(starts[:-1].tolist(), ends, strict=True):
                    prints.append([print_of(view[a:b]) for a, b in zip([begin, *own], own)])
                if mode == "recipes":
                    shas = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(np.diff(starts)), pa.array(prints, pa.list_(pa.int64())), pa.array(shas, pa.string())],
                        names=["doc_id", "n_bytes", "recipe", "text_sha256"],
                    )
                    continue
                flat = [e for own in ends for e in own]
                offsets = np.array([0, *flat], dtype=np.int32)
                chunks = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                fp = pa.array([p for own in prints for p in own], pa.int64())
                if mode == "chunks":
                    yield pa.RecordBatch.from_arrays([fp, chunks], names=["fp", "chunk"])
                    continue
                counts = [len(own) for own in ends]
                texts = np.repeat(np.arange(len(ends)), counts)
                sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(texts)), pa.array(sha, pa.string()).take(pa.array(texts)),
                     pa.array([i for n in counts for i in range(n)], pa.int32()), fp, chunks],
                    names=["doc_id", "text_sha256", "place", "fp", "chunk"],
                )

    return run


def text_recipes(
    docs: DataFrame, bits: int = 10, least: int = 256, most: int = 8192, fingerprint_bits: int = 64
) -> DataFrame:
    """A row per text: doc_id, n_bytes, recipe, marks, text_sha256. Equal texts, and only they, have equal
    (n_bytes, recipe, marks).

    ``bits`` sets the usual chunk (2^bits bytes beyond ``least``). Chunk bytes are shuffled once, and only the different
    ones of each task. ``fingerprint_bits`` exists to provoke collisions in tests.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    cut = lambda mode: _chunker(mode, bits, least, most, fingerprint_bits)
    chunks = rows.select("text").mapInArrow(cut("chunks"), "fp long, chunk binary").distinct()
    shared = cut_lineage(chunks.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    recipes = cut_lineage(rows.mapInArrow(cut("recipes"), f"doc_id {id_type}, n_bytes long, recipe array<long>, text_sha256 string"))
    none = F.expr("cast(array() as array<struct<place: int, ordinal: int>>)")
    if shared.isEmpty():
        return recipes.withColumn("marks", none)
    # true collisions: number the different chunks of a fingerprint and note every place of all but the first
    at = rows.mapInArrow(cut("places"), f"doc_id {id_type}, text_sha256 string, place int, fp long, chunk binary").join(shared, "fp")
    order = Window.partitionBy("fp").orderBy("chunk")
    numbered = at.select("fp", "chunk").distinct().withColumn("ordinal", F.row_number().over(order) - 1).where("ordinal > 0")
    marks = (
        at.join(numbered, ["fp", "chunk"]).groupBy("doc_id", "text_sha256")
        .agg(F.array_sort(F.collect_set(F.struct("place", "ordinal"))).alias("marks")).withColumnRenamed("doc_id", "_id")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (recipes["text_sha256"] == marks["text_sha256"])
    return recipes.join(marks, same, "left").select(recipes["*"], F.coalesce("marks", none).alias("marks"))


def exact_groups(docs: DataFrame, **chunking) -> DataFrame:
    """Which documents are copies of which: a row per document, dropped ones too.

    Columns: doc_id, keep_id (the largest doc_id of the equal texts), group_size, kept, text_sha256, n_bytes, n_chunks.
    Null is the empty text. Rows that repeat a doc_id with the same text are one group of which exactly one row is kept.
    A null doc_id counts in its group, and stays only where the group has no other. An empty table gives no rows.
    """
    recipe = ["n_bytes", "recipe", "marks"]
    rows = text_recipes(docs, **chunking).groupBy("doc_id", "text_sha256", *recipe).agg(F.count("*").alias("_same"))
    rows = cut_lineage(rows)
    groups = rows.groupBy(*recipe).agg(F.max("doc_id").alias("keep_id"), F.sum("_same").alias("group_size"))
    out = rows.join(groups, recipe).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_same").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_bytes", F.size("recipe").cast("long").alias("n_chunks"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents with one row left of each group of equal texts, all columns as they were, whatever their names.

    The largest doc_id stays; a null one only where the group has no other. Of rows that repeat a doc_id and text one is
    left, whatever their other columns say.
    """
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("id_"), F.col("text_sha256").alias("sha_"))
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*places.values())
    sha = F.sha2(F.coalesce(F.col(places["text"]).cast("string"), F.lit("")), 256)
    named = own.withColumn("sha", sha)
    once = named.dropDuplicates([places["doc_id"], "sha"]) if _repeats(docs) else named
    met = once.join(kept, F.col(places["doc_id"]).eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_")), "left_semi")
    return met.select(*[F.col(c).alias(name) for name, c in places.items()])


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id stands on more than one row: only then must whole rows be dealt by it."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
