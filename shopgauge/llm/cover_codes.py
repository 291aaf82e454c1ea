"""Vector code compression by Lloyd rounds over cover trees.

Vectors become whole numbers floor(256 x), cut into 16 equal parts; each part position has a codebook of up to 64 entries.
A block of vectors keeps one cover tree for each position, built once and stored: a node is a centre with the greatest
distance of what it covers, its children are centres at half the radius, and what it covers lies in one stretch of the
block's points, so that cumulative sums give the count and the sum of any subtree. In a round a subtree goes to an entry as
a whole where the triangle inequality leaves no other; only ambiguous nodes descend, and at the leaves points are compared
exactly. A round adds up counts and sums of entries, one row for each entry from a task; the driver gets the totals.

The first entries are those parts of the smallest ids, of equal ids the smaller vectors; with fewer rows there are fewer
entries. Rows count unless the vector is null or empty, holds an entry that is null, NaN, infinite or beyond 2**18 in size,
or has another length than most; a length that 16 does not divide is filled up with zeros. A null id comes after all
others and stays null; repeated rows count as often as they come. Null labels are one label. An empty table gives an
empty result. Other columns than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shopgauge.llm.vectors import matrix, usable
from shopgauge.session import materialize

#: Fixed values of the contract: scale of entries, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors of one block; points that a node need not divide any more.
BLOCK, LEAF = 8192, 12
#: Distances are square roots of whole numbers: a bound that is closer than this is left to the exact comparison.
_MARGIN = 1e-6
_FAR = np.int64(1) << 62


@dataclass
class CoverTree:
    """Nodes in levels, children side by side; ``first`` and ``end`` bound a node's stretch of ``points``.

    ``rows`` has the block's row of each point; ``child`` and ``child_end`` are equal at a leaf.
    """

    points: np.ndarray
    rows: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    end: np.ndarray
    child: np.ndarray
    child_end: np.ndarray

    def cumulative(self) -> np.ndarray:
        """Sums of the first 0, 1, 2, .. points."""
        return np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0, dtype=np.int64)])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.int64) - b
    return (d * d).sum(axis=-1)


def _cover(points: np.ndarray, node: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divide the points of every node among centres whose reach (a squared distance) covers them.

    The node's own centre comes first; then, as long as points are left, the first of them. Returns the number of
    the centre inside the node for every point, and its point (-1: the node's own centre).
    """
    child, of = np.full(len(points), -1), np.full(len(points), -1)
    left = np.arange(len(points))
    chosen, number = centres, 0
    pick = np.full(len(centres), -1)
    while len(left):
        near = _squared(points[left], chosen[node[left]]) <= reach[node[left]]
        child[left[near]], of[left[near]] = number, pick[node[left[near]]]
        left = left[~near]
        nodes, at = np.unique(node[left], return_index=True)
        pick = np.full(len(centres), -1)
        pick[nodes] = left[at]
        chosen = points[pick]  # of nodes without points left: any
        number += 1
    return child, of


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """A cover tree of whole points; nodes of at most ``leaf`` points, or of equal ones, are not divided."""
    order, place = np.arange(len(points)), np.arange(len(points))  # places of the points of the level's nodes, ascending
    node = np.zeros(len(points), np.int64)  # number in the level of each of these
    centre, first, end = points[:1], np.array([0]), np.array([len(points)])
    levels, total = [], 1
    while len(place):
        apart = _squared(points[order[place]], centre[node])
        radius = np.maximum.reduceat(apart, np.flatnonzero(np.diff(node, prepend=-1)))
        divided = (end - first > leaf) & (radius > 0)
        child, child_end = np.zeros(len(centre), np.int64), np.zeros(len(centre), np.int64)
        levels.append((centre, np.sqrt(radius.astype(float)), first, end, child, child_end))
        inner = divided[node]
        place, node, centre = place[inner], (np.cumsum(divided) - 1)[node[inner]], centre[divided]
        if not len(place):
            break
        inside, own = _cover(points[order[place]], node, centre, radius[divided] // 4)
        sort = np.lexsort((inside, node))
        # Points move inside their node's stretch only; a picked point stays a centre by its value.
        picked = points[order[place]][np.maximum(own, 0)][sort]
        order[place], node, inside, own = order[place][sort], node[sort], inside[sort], own[sort]
        new = (np.diff(node, prepend=-1) != 0) | (np.diff(inside, prepend=-1) != 0)
        heads = np.flatnonzero(new)
        counts = np.bincount(node[heads], minlength=len(centre))
        child_end[divided] = total + np.cumsum(counts)
        child[divided] = child_end[divided] - counts
        total += len(heads)
        centre = np.where((own[heads] < 0)[:, None], centre[node[heads]], picked[heads])
        first, end = place[heads], place[np.append(heads[1:], len(place)) - 1] + 1
        node = np.cumsum(new) - 1
    return CoverTree(points[order], order, *(np.concatenate(column) for column in zip(*levels)))


def _stretches(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, one range after the other."""
    sizes = end - first
    return np.arange(sizes.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)


def assigned(tree: CoverTree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, entry) of stretches of the tree's points that go to one entry; each point is in one of them.

    Of equal entries only the first can win, so the others are no candidates.
    """
    candidate = np.zeros(len(entries), bool)
    candidate[np.unique(entries, axis=0, return_index=True)[1]] = True
    nodes, open_to = np.zeros(1, np.int64), candidate[None, :]
    while len(nodes):
        apart = np.where(open_to, np.sqrt(_squared(tree.centre[nodes][:, None, :], entries).astype(float)), np.inf)
        open_to = apart <= (apart.min(axis=1) + 2 * tree.radius[nodes] + _MARGIN)[:, None]
        sure = open_to.sum(axis=1) == 1
        yield tree.first[nodes[sure]], tree.end[nodes[sure]], apart[sure].argmin(axis=1)
        nodes, open_to = nodes[~sure], open_to[~sure]
        leaf = tree.child[nodes] == tree.child_end[nodes]
        first, end = tree.first[nodes[leaf]], tree.end[nodes[leaf]]
        at, among = _stretches(first, end), np.repeat(open_to[leaf], end - first, axis=0)
        exact = np.where(among, _squared(tree.points[at][:, None, :], entries), _FAR)
        yield at, at + 1, exact.argmin(axis=1)
        first, end = tree.child[nodes[~leaf]], tree.child_end[nodes[~leaf]]
        nodes, open_to = _stretches(first, end), np.repeat(open_to[~leaf], end - first, axis=0)


def entry_sums(tree: CoverTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the points of each entry, whole subtrees at once."""
    cumulative = tree.cumulative()
    count, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    for first, end, entry in assigned(tree, entries):
        np.add.at(count, entry, end - first)
        np.add.at(sums, entry, cumulative[end] - cumulative[first])
    return count, sums


def codes(tree: CoverTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance to it of every row of the tree's block."""
    code, error = np.empty(len(tree.points), np.int64), np.empty(len(tree.points), np.int64)
    for first, end, entry in assigned(tree, entries):
        at, chosen = _stretches(first, end), np.repeat(entry, end - first)
        code[tree.rows[at]] = chosen
        error[tree.rows[at]] = _squared(tree.points[at], entries[chosen])
    return code, error


def _whole(x: np.ndarray) -> np.ndarray:
    """Scaled entries by part: (rows, parts, width), filled up with zeros."""
    width = -(-x.shape[1] // PARTS)
    filled = np.zeros((len(x), PARTS * width), np.int64)
    filled[:, : x.shape[1]] = np.floor(SCALE * x)
    return filled.reshape(len(x), PARTS, width)


def blocks(rows: DataFrame, length: int) -> DataFrame:
    """Blocks of vectors as ids, labels and one cover tree for each part, written once."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks_of(batches):
            x = _whole(matrix(batch.column("vector"), length)).astype(np.int32)
            trees = [cover_tree(x[:, part]) for part in range(PARTS)]
            for tree in trees:
                tree.rows = tree.rows.astype(np.uint16)
            row = pickle.dumps((batch.column("vec_id"), batch.column("label"), trees))
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["block"])

    return materialize(rows.select("vec_id", "label", "vector").mapInArrow(packed, "block binary"), "cover-trees")


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, height = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if height + part.num_rows > BLOCK:
                yield pa.concat_batches(waiting)
                waiting, height = [], 0
            waiting.append(part)
            height += part.num_rows
    if height:
        yield pa.concat_batches(waiting)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, list[CoverTree]]]:
    for batch in batches:
        for block in batch.column("block"):
            yield pickle.loads(block.as_py())


def improved(stored: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: entries replaced by the floored mean of the parts that are nearest to them; unused ones stay."""
    parts, entries, width = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for _, _, trees in _unpacked(batches):
            for part, tree in enumerate(trees):
                count, added = entry_sums(tree, codebooks[part])
                total[part, :, 0] += count
                total[part, :, 1:] += added
        at = np.flatnonzero(np.repeat(total[:, :, 0].ravel() > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "total"])

    found = stored.mapInArrow(sums, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()
    totals = np.zeros(parts * entries * (width + 1), np.int64)
    for row in found:
        totals[row["at"]] = row["total"]
    totals = totals.reshape(parts, entries, width + 1)
    count = totals[:, :, :1]
    return np.where(count > 0, totals[:, :, 1:] // np.maximum(count, 1), codebooks)


def learned(kept: DataFrame, length: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Stored blocks and the codebooks (parts, entries, width) after the rounds."""
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    codebooks = _whole(np.array([r["vector"] for r in least], float)).transpose(1, 0, 2)
    stored = blocks(kept, length)
    for _ in range(rounds):
        codebooks = improved(stored, codebooks)
    return stored, codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encoded(stored: DataFrame, codebooks: np.ndarray, label_type: str) -> DataFrame:
    """vec_id, label, code and error of every stored vector, written once."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, trees in _unpacked(batches):
            found = [codes(tree, codebooks[part]) for part, tree in enumerate(trees)]
            digits = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
            text = [row.tobytes().hex() for row in digits]
            error = np.sum([e for _, e in found], axis=0)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return materialize(stored.mapInArrow(work, f"vec_id long, label {label_type}, code string, error long"), "vector-codes")


def compressed(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that counts."""
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).alias("label"), F.col(vector).alias("vector"))
    kept, length = usable(named, "vector", "vec_id", "label")
    label_type = kept.schema["label"].dataType.simpleString()
    if not length:
        none = kept.where(F.lit(False)).select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")])
        return none.withColumn("codebooks_sha256", F.lit(""))
    stored, codebooks = learned(kept, length)
    done = encoded(stored, codebooks, label_type)
    sums = done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return done.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )
