"""Near duplicates by SimHash with a Gray-order hierarchical index.

Fingerprints are dealt to buckets that agree on whole bit blocks, so that every pair within the sure distance meets in one
bucket at least. In a bucket the fingerprints are sorted by Gray rank, which puts similar ones next to each other; eight
neighbours make a node that carries the bits all of them share, eight nodes the next, up to the root. A search goes down
from the root, adds up the differences on the bits that each node newly fixes, and leaves a whole group as soon as the sum
is over the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilake.llm.common import components, folded_words, majority, shingle_hashes, texts_of
from vigilake.llm.set_join import candidates, common_shingles, confirmed, prefix_groups, shingle_nodes
from vigilake.session import cut_lineage

FAN = 8
#: Rows a bucket may hold before it is dealt anew by more bit blocks.
BUCKET = 4096
#: Pairs of a search and a fingerprint that may be open at a time, which bounds memory.
OPEN_PAIRS = 1 << 20
ROUNDS = 3
#: Bits by which candidates of the index may differ in the search for similar sets.
INDEX_BITS = 3
#: Distances, in groups of sets sorted by size, that the rounds after the index look at: up to the first, then all.
REACH = (8, None)


def fingerprint(text: bytes, words: int) -> int:
    """64 bits, each set where over half of the shingle hashes have it set; no words give zero."""
    return majority(shingle_hashes(folded_words(text), words))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, fp) with the fingerprint of each whole text; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text, words) for text in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


# --- the index of one bucket or of many -------------------------------------------------------------------------------

class GrayIndex:
    """Nodes over fingerprints sorted by (bucket, Gray rank). All buckets are built and searched at once."""

    def __init__(self, buckets: np.ndarray, codes: np.ndarray):
        self.codes = codes
        every, some = codes, codes  # bits set in all and in any code below a node
        owner = buckets
        last = np.arange(len(codes))
        self.levels = [(every, every | ~some, last, np.arange(len(codes) + 1))]
        while True:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            if len(first) == len(owner):
                break
            inside = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            starts = np.flatnonzero(inside % FAN == 0)
            every, some = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)
            bounds = np.r_[starts, len(owner)]
            last = last[bounds[1:] - 1]
            owner = owner[starts]
            self.levels.append((every, every | ~some, last, bounds))
        self.root = np.searchsorted(last, np.arange(len(codes)))

    def pairs(self, low: int, high: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (i, j, differing bits) with low <= i < high, i < j, in one bucket and within the distance."""
        query = np.arange(low, high)
        node = self.root[low:high]
        so_far = np.zeros(len(query), dtype=np.int64)
        seen = np.zeros(len(query), dtype=np.uint64)  # bits counted already
        for depth in range(len(self.levels) - 1, -1, -1):
            every, mask, last, _ = self.levels[depth]
            so_far = so_far + np.bitwise_count((self.codes[query] ^ every[node]) & mask[node] & ~seen)
            alive = (so_far <= distance) & (last[node] > query)
            query, node, so_far = query[alive], node[alive], so_far[alive]
            if depth == 0 or not len(query):
                break
            seen = mask[node]
            bounds = self.levels[depth][3]
            width = bounds[node + 1] - bounds[node]
            shift = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            node = np.repeat(bounds[node], width) + shift
            query, so_far, seen = np.repeat(query, width), np.repeat(so_far, width), np.repeat(seen, width)
        return query, node, so_far


def closest_forest(u: np.ndarray, v: np.ndarray, d: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the links with the fewest differing bits: the same groups, at most a link per node."""
    order = np.argsort(d, kind="stable")
    u, v, d = u[order], v[order], d[order]
    label, index, taken = np.arange(size), np.arange(len(u)), []
    while len(index):
        a, b = label[u[index]], label[v[index]]
        open_ = a != b
        index, a, b = index[open_], a[open_], b[open_]
        if not len(index):
            break
        best = np.full(size, len(u))
        np.minimum.at(best, a, index)
        np.minimum.at(best, b, index)
        chosen = np.unique(best[best < len(u)])
        taken.append(chosen)
        x, y = label[u[chosen]], label[v[chosen]]
        parent = np.arange(size)
        while True:
            low = np.minimum(parent[x], parent[y])
            before = parent.copy()
            np.minimum.at(parent, x, low)
            np.minimum.at(parent, y, low)
            parent = parent[parent]
            if (parent == before).all():
                break
        label = parent[label]
    pick = np.concatenate(taken) if taken else np.empty(0, dtype=np.int64)
    return u[pick], v[pick], d[pick]


def bucket_links(buckets: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (code, code, bits) that keep together whatever is within the distance in a bucket."""
    index, size = GrayIndex(buckets, codes), len(codes)
    u = v = d = np.empty(0, dtype=np.int64)
    largest = int(np.bincount(buckets).max()) if size else 1
    together = max(16, min(4096, OPEN_PAIRS // largest))
    for low in range(0, size, together):
        i, j, bits = index.pairs(low, min(size, low + together), distance)
        u, v, d = np.r_[u, i], np.r_[v, j], np.r_[d, bits]
        if len(u) > 4 * size:
            u, v, d = closest_forest(u, v, d, size)
    u, v, d = closest_forest(u, v, d, size)
    return codes[u], codes[v], d


# --- all buckets ------------------------------------------------------------------------------------------------------

def block_masks(blocks: int, agree: int) -> list[int]:
    """The bits of every choice of ``agree`` out of ``blocks`` nearly equal bit blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    sums = [sum(pick) for pick in combinations(parts, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def _searcher(distance: int, limit: int | None):
    """Runs over rows sorted by bucket and Gray rank. Buckets over ``limit`` are handed back (b is null)."""

    def links(t, k, fp):
        change = np.r_[False, (t[1:] != t[:-1]) | (k[1:] != k[:-1])]
        a, b, d = bucket_links(np.cumsum(change), fp.view(np.uint64), distance)
        return rows(a.view(np.int64), b.view(np.int64), d)

    def rows(a, b, d):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d, pa.int32())], names=["a", "b", "d"])

    def back(fp):
        return rows(fp, pa.nulls(len(fp), pa.int64()), pa.nulls(len(fp), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, k, fp = (np.empty(0, dtype=np.int64) for _ in range(3))
        over = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "k", "fp")]
            if over is not None:
                same = (new[0] == over[0]) & (new[1] == over[1])
                if same.any():
                    yield back(new[2][same])
                new = [x[~same] for x in new]
                if not len(new[0]):
                    continue
                over = None
            t, k, fp = np.r_[t, new[0]], np.r_[k, new[1]], np.r_[fp, new[2]]
            if not len(t):
                continue
            tail = int(np.argmax((t == t[-1]) & (k == k[-1])))  # where the last bucket begins; more of it may follow
            if tail:
                yield from search(t[:tail], k[:tail], fp[:tail])
                t, k, fp = t[tail:], k[tail:], fp[tail:]
            if limit is not None and len(t) > limit:
                yield back(fp)
                over = (t[-1], k[-1])
                t, k, fp = t[:0], k[:0], fp[:0]
        if len(t):
            yield from search(t, k, fp)

    def search(t, k, fp):
        first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        sizes = np.diff(np.r_[first, len(t)])
        large = np.repeat(sizes > limit, sizes) if limit is not None else np.zeros(len(t), dtype=bool)
        if large.any():
            yield back(fp[large])
        if (~large).any():
            yield links(t[~large], k[~large], fp[~large])

    return run


def fingerprint_links(codes: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b, d) that join all distinct fingerprints (column ``fp``) within ``distance`` into their groups.

    Not every pair is returned: a bucket gives a spanning forest of its closest links, which loses no group.
    A bucket over ``bucket`` rows is not searched; its fingerprints are dealt anew with one more block to agree on, which
    splits it and still lets all its pairs meet. The last of three rounds takes buckets of any size.
    """
    agree = max(1, round(16 * distance / (64 - 16)))  # keys of about 16 bits in the first round
    live, found = codes.select("fp"), []
    for step in range(ROUNDS):
        masks = block_masks(distance + agree + step, agree + step)
        keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)]))
        routed = live.select("fp", keys.alias("_")).select("_.t", "_.k", "fp").withColumn("rank", gray_rank())
        dealt = routed.repartition("t", "k").sortWithinPartitions("t", "k", "rank").select("t", "k", "fp")
        out = cut_lineage(dealt.mapInArrow(_searcher(distance, None if step == ROUNDS - 1 else bucket), "a long, b long, d int"))
        found.append(out.where("b is not null"))
        live = out.where("b is null").select(F.col("a").alias("fp")).distinct()
        if step < ROUNDS - 1 and live.isEmpty():
            break
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.groupBy("a", "b").agg(F.min("d").alias("d"))


def gray_rank():
    """Place of the fingerprint in Gray order: every bit is the parity of the bits from the top down to it."""
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


def near_groups(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """A row per document: doc_id, fp (signed 64 bits), component_id (smallest doc_id reachable, itself included).

    Null is the empty text; texts without words have fingerprint zero and are linked like others. Equal fingerprints are
    one node, so copies cost nothing. Rows that repeat a doc_id each have their row. A component whose doc_ids are all
    null has a null component_id. An empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, words))
    codes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return prints.join(_code_components(codes, fingerprint_links(codes, distance)), "fp")


def _code_components(codes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, component_id) for every fingerprint."""
    found = components(links, "a", "b").withColumnRenamed("node", "fp")
    rooted = cut_lineage(codes.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def index_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of nodes that the Gray index puts together: a forest of fingerprints, and the nodes of one fingerprint."""
    codes = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    links = fingerprint_links(codes, distance)
    of = lambda c: codes.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    ends = links.join(of("a"), "a").join(of("b"), "b").select("a_node", "b_node")
    alike = nodes.join(codes, "fp").select("node", "least").where("node <> least").distinct()
    pairs = ends.unionByName(alike.toDF("a_node", "b_node"))
    return cut_lineage(pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct())


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The roots after further links, which mostly lie between nodes of different roots."""
    if roots is None:
        return components(links, "a", "b")
    of = lambda key: roots.select(F.col("node").alias(key), F.col("root").alias(f"{key}_root"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = components(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")), "a", "b")
    later = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut_lineage(moved.unionByName(more.join(roots, "node", "left_anti")))


def similar_roots(nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root) of the nodes that have a partner; nodes of one root are joined by similar pairs.

    The Gray index gives the first candidates. It cannot give all, as texts that share 0.8 of their shingles differ in ten
    bits as a rule; what is not joined yet meets in the prefixes of the shingle sets, near neighbours by size first.
    """
    roots = components(confirmed(index_pairs(nodes, INDEX_BITS), nodes, words, similarity), "a", "b")
    groups = prefix_groups(nodes, roots, words, similarity, common_shingles(nodes, words))
    sigs = nodes.select("node", "sig").dropDuplicates(["node"])
    low = 0
    for high in REACH:
        pairs = candidates(groups, sigs, roots, low, high, similarity)
        if not pairs.isEmpty():
            roots = joined(roots, confirmed(pairs, nodes, words, similarity))
        low = high
    return roots


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one left (the smallest doc_id) of each group of near copies, all columns as they were.

    Two texts are linked if they share at least ``similarity`` of their different shingles; all such pairs count, see
    ``set_join``. Texts without words are copies of each other. One row of each group stays, also where rows repeat a doc_id
    or where it is null; a null doc_id stays only if the group has no other. An empty table gives no rows.
    """
    nodes = cut_lineage(shingle_nodes(docs, words))
    roots = similar_roots(nodes, words, similarity)
    own = docs.columns.index("doc_id")
    rows = nodes.select("rid", F.col(f"c{own}").alias("id"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first")
    kept = rows.groupBy("root").agg(first).select(F.col("first.rid").alias("rid"))
    text = docs.columns.index("text")
    columns = [F.col("text" if i == text else f"c{i}").cast(kind).alias(c) for i, (c, kind) in enumerate(docs.dtypes)]
    return nodes.join(kept, "rid", "left_semi").select(*columns)
