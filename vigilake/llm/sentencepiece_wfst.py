"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

The transducer is composed of three parts. The normaliser marks blanks and puts one before the text. Pieces are arcs that
read their characters and give their number; a character that is in no piece reads itself and gives its bytes. For a model
made by pair merging, a third machine remembers the last piece and gives infinite weight to a pair of neighbours that merging
would not have left side by side. Composed with an input, the shortest path (least sum of weights) is the encoding.

Paths are independent between words, as no piece reads a blank mark after another character, so inputs are composed word by
word and words met before are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLANK = "▁"
#: Words a task remembers; when they are more it starts anew. Longer words are never kept.
REMEMBERED, KEPT_LENGTH = 200_000, 48
#: Pairs of pieces a task remembers.
PAIRS = 400_000
UNKNOWN_SCORE = -1e3
_INFINITE = float("inf")


class Transducer:
    """Compiled from a model file's bytes; see the module's text."""

    def __init__(self, pieces: list[tuple[str, float]], ids: dict[str, int], byte_ids: list[int], unknown: int, prefix: bool, merging: bool):
        self.rank = dict(pieces)
        self.ids, self.byte_ids, self.unknown, self.prefix, self.merging = ids, byte_ids, unknown, prefix, merging
        self.arcs: dict = {}  # tree of the pieces by character; "" holds the piece that ends at a node
        for p in self.rank:
            if not merging or self._stands(p):
                node = self.arcs
                for c in p:
                    node = node.setdefault(c, {})
                node[""] = p
        self.joined: dict[tuple[str, str], float] = {}
        known = {c for p in self.rank for c in p}
        stops = "".join(c for c in "\n\t\r" if c not in known)
        apart = not any(BLANK in p.lstrip(BLANK) for p in self.rank)
        self.words = re.compile(f"{BLANK}*[^{BLANK}{stops}]+|{BLANK}+|[{stops}]" if stops else f"{BLANK}*[^{BLANK}]+|{BLANK}+") if apart else re.compile(r"(?s).+")
        self.seen: dict[str, tuple[int, ...]] = {}

    # --- the pair machine ---

    def _merged(self, text: str) -> list[str]:
        """What pair merging makes of a short text: always the best pair, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = -_INFINITE, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stands(self, piece: str) -> bool:
        """Whether merging makes the piece out of its characters, so that it can be on a path at all."""
        return len(piece) == 1 or self._merged(piece) == [piece]

    def pair_weight(self, left: str, right: str) -> float:
        """0 where merging leaves the two side by side, else infinite."""
        found = self.joined.get((left, right))
        if found is None:
            if len(self.joined) >= PAIRS:
                self.joined.clear()
            found = self.joined[left, right] = 0.0 if self._merged(left + right) == [left, right] else _INFINITE
        return found

    # --- composition and shortest path ---

    def shortest_path(self, text: str) -> list[str]:
        """Pieces of the least weight over an input."""
        return self._only_path(text) if self.merging else self._least_path(text)

    def _arcs_from(self, text: str, at: int) -> list[str]:
        """Pieces that begin at a place, short ones first; a character that is no piece reads itself."""
        node, found = self.arcs.get(text[at]), []
        if node is None or "" not in node:
            found.append(text[at])
        while node is not None:
            piece = node.get("")
            if piece is not None:
                found.append(piece)
            at += 1
            node = node.get(text[at]) if at < len(text) else None
        return found

    def _only_path(self, text: str) -> list[str]:
        """For a merging model all weights are 0 or infinite, and exactly one path of weight 0 leads to any place.

        It is searched with long arcs first. A place that was left again is on no path to the end, so it is tried once.
        """
        path: list[str] = []
        untried: list[list[str]] = []
        closed: set[int] = set()
        at, arcs, end = 0, self._arcs_from(text, 0), len(text)
        while True:
            while arcs:
                piece = arcs.pop()
                stop = at + len(piece)
                if stop not in closed and not (path and self.pair_weight(path[-1], piece)):
                    break
            else:
                closed.add(at)
                at -= len(path.pop())
                arcs = untried.pop()
                continue
            path.append(piece)
            if stop == end:
                return path
            untried.append(arcs)
            at, arcs = stop, self._arcs_from(text, stop)

    def _least_path(self, text: str) -> list[str]:
        """For a model with piece scores the weight of an arc is its negative score: relax all arcs from left to right."""
        n = len(text)
        cost, last = [0.0] + [_INFINITE] * n, [""] * (n + 1)
        for at in range(n):
            for piece in self._arcs_from(text, at):
                total, stop = cost[at] - self.rank.get(piece, UNKNOWN_SCORE), at + len(piece)
                if total < cost[stop]:
                    cost[stop], last[stop] = total, piece
        path = []
        while n:
            path.append(last[n])
            n -= len(last[n])
        return path[::-1]

    def word_ids(self, word: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.shortest_path(word):
            number = self.ids.get(piece)
            if number is not None:
                out.append(number)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        out: list[int] = []
        seen = self.seen
        for word in self.words.findall(marked):
            ids = seen.get(word)
            if ids is None:
                ids = self.word_ids(word)
                if len(word) <= KEPT_LENGTH:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[word] = ids
            out += ids
        return out


def compile_model(model: bytes) -> dict:
    """The parts of a model file that the transducer is built from. Only the identity normaliser is known."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(model)
    if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("the model's normaliser changes characters, which is not supported")
    normal = [(i, p.piece, p.score) for i, p in enumerate(spec.pieces) if p.type == proto.ModelProto.SentencePiece.NORMAL]
    kinds = proto.ModelProto.SentencePiece
    return {
        "pieces": [(p, s) for _, p, s in normal], "ids": {p: i for i, p, _ in normal},
        "byte_ids": [i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE],
        "unknown": next((i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN), 0),
        "prefix": spec.normalizer_spec.add_dummy_prefix, "merging": spec.trainer_spec.model_type == 2,
        "silent": [i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL],
        "size": len(spec.pieces),
    }


_BUILT: dict[int, Transducer] = {}


def _transducer(shared) -> Transducer:
    """The transducer of this worker, built once."""
    parts = shared.value
    key = id(parts)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Transducer(*(parts[k] for k in ("pieces", "ids", "byte_ids", "unknown", "prefix", "merging")))
    return _BUILT[key]


def load_model(spark, path: str):
    """Read a model file on the driver and send its parts (a vocabulary, some megabytes at most) to the executors."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(compile_model(file.read()))


def encode(docs: DataFrame, model) -> DataFrame:
    """Rows (doc_id, ids) with the piece numbers of every whole text.

    Null and empty texts have no pieces. Each row is encoded by itself, also where rows repeat a doc_id. An empty table
    gives no rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids, ends = [], [0]
                for text in part.column("text"):
                    ids.append(np.array(machine.encode(text.as_py() or ""), dtype=np.int32))
                    ends.append(ends[-1] + len(ids[-1]))
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "ids"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, model) -> DataFrame:
    """Rows (doc_id, ids, text): pieces joined, bytes put together, marks turned into blanks, the first mark dropped.

    Bytes that are no valid text become replacement characters; control pieces are silent; null ids give empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = model.value
        table = [b"\xef\xbf\xbd"] * parts["size"]
        for piece, number in parts["ids"].items():
            table[number] = piece.replace(BLANK, " ").encode()
        for value, number in enumerate(parts["byte_ids"]):
            table[number] = bytes([value])
        for number in parts["silent"]:
            table[number] = b""
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = []
                for ids in part.column("ids"):
                    numbers = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                    text = b"".join(map(table.__getitem__, numbers)).decode(errors="replace")
                    texts.append(text[1:] if parts["prefix"] and text[:1] == " " else text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids array<int>, text string")
