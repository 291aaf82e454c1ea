"""Gradient-boosted trees with logistic loss over histograms of binned features.

A level of a tree needs, for every open node, feature and bin, the summed gradients and curvatures of the rows there.
``grow`` takes these sums in the memory of one task. ``fit_together`` deals the rows to the tasks of one barrier stage;
each keeps its share in memory, and the tasks exchange sums of nodes and bins level by level. ``fit`` takes the sums in
passes over blocks of rows that Spark keeps on the executors, a job of one stage each; the driver sees sums of nodes and bins
only. Gradients are whole multiples of 2**-24, so every sum is exact, and rows are sampled by a hash of person and tree:
all forms, and any number of tasks, give the same trees. Of two siblings the left one is summed, the right one is what is
left of their parent.

A null or NaN feature goes right at every split. A feature without two values is never split.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shopgauge.functions.ordering import lay_out, running
from shopgauge.session import materialize

#: Bins of a feature at most; rows in one block of a distributed fit, or a batch more; rows of one of its tasks, unless each
#: core has a task; trees between two writings of the margins.
BINS, BLOCK_ROWS, TASK_ROWS, TREES_PER_WRITE = 64, 1 << 16, 1 << 18, 10
#: Bytes of all tasks' sums of a level, before they are packed, up to which the driver adds them up.
MOST_COLLECTED = 1 << 27
#: Gradients are whole multiples of 1 / _ONE.
_ONE = float(1 << 24)
#: A split must gain more than this, also where no loss reduction is asked for.
_LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    """Parameters of a fit; their names in a trial are those of ``of``."""

    trees: int = 100
    depth: int = 6
    rate: float = 0.3
    row_share: float = 1.0
    column_share: float = 1.0
    least_weight: float = 1.0
    least_gain: float = 0.0
    l1: float = 0.0
    l2: float = 1.0
    positive_weight: float = 1.0
    seed: int = 42

    @staticmethod
    def of(params: dict[str, float], seed: int) -> "Settings":
        names = {
            "trees": ("n_estimators", int), "depth": ("max_depth", int), "rate": ("learning_rate", float),
            "row_share": ("subsample", float), "column_share": ("colsample_bytree", float),
            "least_weight": ("min_child_weight", float), "least_gain": ("gamma", float), "l1": ("reg_alpha", float),
            "l2": ("reg_lambda", float), "positive_weight": ("scale_pos_weight", float),
        }
        given = {name: kind(params[key]) for name, (key, kind) in names.items() if key in params}
        return Settings(**given, seed=seed)


@dataclass
class Tree:
    """Nodes from the root down; a leaf has feature -1, a right child follows its left one."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list, compare=False)  # the cut as a bin, while fitting only
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, first in ((self.feature, -1), (self.bin, 0), (self.cut, 0.0), (self.left, 0), (self.gain, 0.0)):
            column.append(first)
        self.value.append(value)
        return len(self.value) - 1

    def leaf_values(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[_leaves(bins, self)]


def importance(trees: Sequence[Tree], features: int) -> np.ndarray:
    """Share of the whole gain by feature; zeros if nothing was split."""
    gains = np.zeros(features)
    for tree in trees:
        for f, g in zip(tree.feature, tree.gain):
            if f >= 0:
                gains[f] += g
    return gains / gains.sum() if gains.sum() > 0 else gains


def _below(node: np.ndarray, bins: np.ndarray, tree: Tree) -> np.ndarray:
    """The nodes one level down; rows at a leaf stay."""
    feature, cut, left = (np.asarray(c) for c in (tree.feature, tree.bin, tree.left))
    f = feature[node]
    right = bins[np.arange(len(node)), np.maximum(f, 0)] > cut[node]
    return np.where(f < 0, node, left[node] + right)


def _leaves(bins: np.ndarray, tree: Tree) -> np.ndarray:
    node = np.zeros(len(bins), np.int64)
    while True:
        lower = _below(node, bins, tree)
        if (lower == node).all():
            return node
        node = lower


def _lookups(bins: np.ndarray, tree: Tree) -> tuple[np.ndarray, ...]:
    """All bins, and by node the start of its feature's line, its cut and its left child.

    A leaf's child is itself: no bin is above its cut. So every step is the same few lookups for all rows.
    """
    feature, left = np.asarray(tree.feature), np.asarray(tree.left)
    leaf = feature < 0
    line = np.where(leaf, 0, feature) * bins.shape[1]
    return bins.ravel(), line, np.where(leaf, BINS, tree.bin).astype(np.uint8), np.where(leaf, np.arange(len(leaf)), left)


def _lower(bins: np.ndarray, tree: Tree, rows: np.ndarray, node: np.ndarray, steps: int = 1) -> np.ndarray:
    """The nodes some levels below those of the rows; rows at a leaf stay. ``bins`` has a line for each feature."""
    flat, line, cut, left = _lookups(bins, tree)
    for _ in range(steps):
        node = left[node] + (flat[line[node] + rows] > cut[node])
    return node


def _reached(bins: np.ndarray, tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The node without children that each of the rows reaches."""
    return _lower(bins, tree, rows, np.zeros(len(rows), np.int64), _depth([tree]))


def _drawn(keys: np.ndarray, s: Settings, tree: int) -> np.ndarray:
    """Whether a row takes part in a tree: by a hash of its key, the seed and the tree."""
    if s.row_share >= 1.0:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) ^ (np.uint64(s.seed * 1_000_003 + tree + 1) * np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / float(1 << 53) < s.row_share


def _columns(features: int, s: Settings, tree: int) -> np.ndarray:
    """The features that a tree may use."""
    count = max(1, round(s.column_share * features))
    return np.sort(np.random.default_rng([s.seed, tree]).permutation(features)[:count])


def _gradients(margin: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(y == 1, s.positive_weight, 1.0) * _ONE
    return np.rint((p - y) * w), np.rint(p * (1.0 - p) * w)


def _histogram(bins: Sequence[np.ndarray], place: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums (gradient, curvature, rows) by open node, column and bin; whole numbers, shape (3, nodes, columns, BINS)."""
    first = place * BINS
    out = np.empty((3, nodes, len(bins), BINS), np.int64)
    for c, column in enumerate(bins):
        slot = first + column
        for i, weight in enumerate((g, h, None)):
            out[i, :, c] = np.bincount(slot, weight, nodes * BINS).reshape(nodes, BINS)
    return out


def _score(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    kept = np.sign(g) * np.maximum(np.abs(g) - s.l1, 0.0)
    return np.divide(kept * kept, h + s.l2, out=np.zeros_like(kept), where=h + s.l2 > 0)


def _weight(g: float, h: float, s: Settings) -> float:
    kept = math.copysign(max(abs(g) - s.l1, 0.0), g)
    return -s.rate * kept / (h + s.l2) if h + s.l2 > 0 else 0.0


def _split(sums: np.ndarray, open_nodes: list[int], columns: np.ndarray, cuts: list[np.ndarray], tree: Tree, s: Settings) -> list[int]:
    """Give every open node its best split, if one gains enough; returns the new nodes."""
    left = np.cumsum(sums, axis=3)
    whole = left[:, :, :, -1:]
    right = whole - left
    gl, hl, gr, hr, g, h = (v / _ONE for v in (left[0], left[1], right[0], right[1], whole[0], whole[1]))
    gain = _score(gl, hl, s) + _score(gr, hr, s) - _score(g, h, s)
    allowed = (left[2] > 0) & (right[2] > 0) & (hl >= s.least_weight) & (hr >= s.least_weight)
    gain = np.where(allowed, gain, -np.inf).reshape(len(open_nodes), -1)
    best = gain.argmax(axis=1)
    created = []
    for i, node in enumerate(open_nodes):
        if gain[i, best[i]] <= max(s.least_gain, _LEAST_GAIN):
            continue
        c, b = divmod(int(best[i]), BINS)
        f = int(columns[c])
        tree.feature[node], tree.bin[node], tree.cut[node] = f, b, float(cuts[f][b])
        tree.gain[node] = float(gain[i, best[i]])
        tree.left[node] = tree.add(_weight(float(gl[i, c, b]), float(hl[i, c, b]), s))
        tree.add(_weight(float(gr[i, c, b]), float(hr[i, c, b]), s))
        created += [tree.left[node], tree.left[node] + 1]
    return created


def _grown(sums_of: Callable[[list[int]], np.ndarray], columns: np.ndarray, cuts: list[np.ndarray], tree: Tree, s: Settings) -> None:
    """Split ``tree``, a single node so far, level by level; ``sums_of`` gives the histograms of the nodes it is asked for.

    The open nodes are numbered consecutively, and higher than all others; ``sums_of`` is asked for the root, or for the
    left ones of all open siblings.
    """
    open_nodes, whole = [0], None
    for level in range(s.depth):
        sums = sums_of(open_nodes[::2])
        if level == 0:
            g, h = sums[:2, 0, 0, :].sum(axis=1) / _ONE
            tree.value[0] = _weight(float(g), float(h), s)
        else:
            sums = np.stack([sums, whole - sums], axis=2).reshape(3, len(open_nodes), *sums.shape[2:])
        parents = open_nodes
        open_nodes = _split(sums, parents, columns, cuts, tree, s)
        if not open_nodes:
            return
        whole = sums[:, [i for i, node in enumerate(parents) if tree.feature[node] >= 0]]


def _asked(node: np.ndarray, wanted: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The rows at the wanted nodes, and the place of each one's node among them."""
    offset = node - wanted[0]
    live = np.flatnonzero((offset >= 0) & (offset % 2 == 0))
    return live, offset[live] // 2


def bins_of(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of cuts below it, so that ``bin <= b`` is ``value <= cuts[b]``; NaN is above all."""
    return np.stack([np.searchsorted(c, values[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def cuts_of(values: np.ndarray) -> list[np.ndarray]:
    """Cuts of each feature: all values but the greatest if they are few, else the values at equally spaced ranks."""
    cuts = []
    for column in values.T:
        known = np.sort(column[~np.isnan(column)])
        distinct = np.unique(known)
        ranks = [-(-i * len(known) // BINS) for i in range(1, BINS)]
        at = distinct if len(distinct) <= BINS else np.unique(known[np.array(ranks) - 1])
        cuts.append(at[at < known[-1]] if len(known) else at)
    return cuts


def _sapling() -> Tree:
    tree = Tree()
    tree.add(0.0)
    return tree


def grow(keys: np.ndarray, values: np.ndarray, y: np.ndarray, s: Settings) -> list[Tree]:
    """Trees for rows in memory: ``keys`` as int64, ``values`` (rows, features) as double, ``y`` 0 or 1."""
    cuts = cuts_of(values)
    return _grow(keys, bins_of(values, cuts), y, cuts, s, lambda own: own)


def grow_binned(keys: np.ndarray, bins: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], s: Settings) -> list[Tree]:
    """``grow`` for rows whose values are bins (rows, features) of the cuts already."""
    return _grow(keys, bins, y, cuts, s, lambda own: own)


def _grow(keys: np.ndarray, bins: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], s: Settings,
          total: Callable[[np.ndarray], np.ndarray]) -> list[Tree]:
    """Trees for binned rows; ``total`` adds the sums of the rows that others hold to those of these rows."""
    trees, margin, lines, every = [], np.zeros(len(y)), np.ascontiguousarray(bins.T), np.arange(len(y))
    for number in range(s.trees):
        tree, columns = _sapling(), _columns(len(cuts), s, number)
        drawn = np.flatnonzero(_drawn(keys, s, number))
        g, h = _gradients(margin[drawn], y[drawn], s)
        node = np.zeros(len(drawn), np.int64)

        def sums(wanted: list[int]) -> np.ndarray:
            nonlocal node
            node = _lower(lines, tree, drawn, node)
            live, place = _asked(node, wanted)
            at = drawn[live]
            return total(_histogram([lines[c][at] for c in columns], place, len(wanted), g[live], h[live]))

        _grown(sums, columns, cuts, tree, s)
        margin = margin + np.asarray(tree.value)[_reached(lines, tree, every)]
        trees.append(tree)
    return trees


def _flat(trees: Sequence[Tree]) -> list[tuple[np.ndarray, ...]]:
    """(feature, cut, left, value) of each tree; a leaf's child is itself, whatever the value."""
    out = []
    for tree in trees:
        feature, left = np.asarray(tree.feature), np.asarray(tree.left)
        leaf = feature < 0
        out.append((np.where(leaf, 0, feature), np.where(leaf, np.inf, tree.cut), np.where(leaf, np.arange(len(leaf)), left), np.asarray(tree.value)))
    return out


def _paths(trees: Sequence[Tree], values: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each tree the leaf values of the rows, and a list of steps (node, feature, node below)."""
    first = np.arange(len(values)) * values.shape[1]
    flat = np.where(np.isnan(values), np.inf, values).ravel()  # beyond every cut, as a missing value is
    for tree, (feature, cut, left, value) in zip(trees, _flat(trees)):
        node, steps = np.zeros(len(values), np.int64), []
        for _ in range(_depth([tree])):
            f = feature[node]
            below = left[node] + ~(flat[first + f] <= cut[node])
            steps.append((node, f, below))
            node = below
        yield value[node], steps


def staged_margins(trees: Sequence[Tree], values: np.ndarray, stages: Sequence[int]) -> Iterator[np.ndarray]:
    """Margins after each of the (ascending) numbers of trees: a fit answers for all its beginnings."""
    total, done = np.zeros(len(values)), 0
    for stage in stages:
        for leaves, _ in _paths(trees[done:stage], values):
            total = total + leaves
        done = stage
        yield total


def staged_binned(trees: Sequence[Tree], bins: np.ndarray, stages: Sequence[int]) -> Iterator[np.ndarray]:
    """``staged_margins`` for trees that were fitted here, and rows (rows, features) of their bins."""
    total, done, lines, every = np.zeros(len(bins)), 0, np.ascontiguousarray(bins.T), np.arange(len(bins))
    for stage in stages:
        for tree in trees[done:stage]:
            total = total + np.asarray(tree.value)[_reached(lines, tree, every)]
        done = stage
        yield total


# The distributed forms.

_BLOCK = "keys binary, bins binary, y binary, margin binary"


def cuts_in(rows: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """``cuts_of`` over all rows: distinct values where they are few, else the values at exact ranks.

    Values are counted before anything is ordered, and one order by (feature, value) serves all ranks.
    """
    entries = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names)]))
    known = rows.select(entries).where(F.col("v").isNotNull() & ~F.isnan("v"))
    laid = lay_out(known.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")), ["v"], by=["f"])
    sizes = laid.groupBy("f").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"), F.max("v").alias("top"))
    upto, n = F.col("upto").cast("decimal(38,0)") * BINS, F.col("rows")
    ranks_before = F.call_function("div", upto - F.col("n") * BINS, n)
    ranks_upto = F.least(F.call_function("div", upto, n), F.lit(BINS - 1))
    found = (
        running(laid, ["f"], "upto", F.col("n"), F.sum).join(F.broadcast(sizes), "f")  # one row per feature
        .where((F.col("v") < F.col("top")) & ((F.col("distinct") <= BINS) | (ranks_upto > ranks_before)))
        .select("f", "v").collect()
    )
    return [np.array(sorted(r["v"] for r in found if r["f"] == f)) for f in range(len(names))]


def _keyed(rows: DataFrame, names: Sequence[str], key: str, label: str) -> DataFrame:
    return rows.select(
        F.xxhash64(key).alias("_key"), F.col(label).cast("tinyint").alias("_y"), *[F.col(n).cast("double").alias(n) for n in names]
    )


def _blocks(rows: DataFrame, names: Sequence[str], key: str, label: str, cuts: list[np.ndarray], parts: int) -> DataFrame:
    """Rows dealt to ``parts`` tasks and packed into blocks: keys, bins, labels and margins as bytes."""
    def block(batches: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(batches)
        return pd.DataFrame({
            "keys": [whole["_key"].to_numpy(np.int64).tobytes()],
            "bins": [bins_of(whole[list(names)].to_numpy(float), cuts).T.tobytes()],
            "y": [whole["_y"].to_numpy(np.int8).tobytes()], "margin": [np.zeros(len(whole)).tobytes()],
        })

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield block(held)
                held = []
        if held:
            yield block(held)

    return materialize(_keyed(rows, names, key, label).repartition(parts).mapInPandas(pack, _BLOCK), "boosting-blocks")


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _unpacked(row, features: int) -> Block:
    """Keys, bins (a line for each feature), labels and margins of a block."""
    y = np.frombuffer(row["y"], np.int8)
    bins = np.frombuffer(row["bins"], np.uint8).reshape(features, len(y))
    return np.frombuffer(row["keys"], np.int64), bins, y, np.frombuffer(row["margin"])


def _advanced(block: Block, trees: Sequence[Tree]) -> Block:
    """The block with the answers of more trees in its margins."""
    keys, bins, y, margin = block
    for tree in trees:
        margin = margin + np.asarray(tree.value)[_reached(bins, tree, np.arange(len(y)))]
    return keys, bins, y, margin


def _packed(sums: np.ndarray) -> str:
    """Whole numbers as text, the bytes of one rank side by side: most of the high ones are alike."""
    return base64.b64encode(zlib.compress(np.ascontiguousarray(sums.view(np.uint8).reshape(-1, 8).T), 1)).decode()


def _added_up(messages: Iterable[str], shape: tuple[int, ...]) -> np.ndarray:
    total = np.zeros(shape, np.int64)
    for message in messages:
        octets = np.frombuffer(zlib.decompress(base64.b64decode(message)), np.uint8).reshape(8, -1)
        total += np.ascontiguousarray(octets.T).view(np.int64).reshape(shape)
    return total


def message_bytes(features: int, s: Settings) -> int:
    """Bytes of the sums that a task of ``fit_together`` sends for a level, before they are packed, at most."""
    return 3 * 8 * 2 ** max(s.depth - 2, 0) * features * BINS


def fit_together(rows: DataFrame, names: Sequence[str], key: str, label: str, s: Settings, tasks: int) -> list[Tree]:
    """Trees by ``tasks`` tasks at once, which must not be more than the cluster has room for.

    A task holds its share of the rows (some 100 bytes each while it works) and sees of the others' rows only sums of
    nodes and bins, which all tasks exchange at each level. The driver passes these on and gets the trees.
    """
    cuts = cuts_in(rows, names)

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        keys, y, bins = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)], [np.zeros((0, len(names)), np.uint8)]
        for batch in batches:
            keys.append(batch["_key"].to_numpy(np.int64))
            y.append(batch["_y"].to_numpy(np.int8))
            bins.append(bins_of(batch[list(names)].to_numpy(float), cuts))
        share = np.concatenate(keys), np.concatenate(bins), np.concatenate(y)
        trees = _grow(*share, cuts, s, lambda own: _added_up(context.allGather(_packed(own)), own.shape))
        if context.partitionId() == 0:
            yield to_pandas(trees)

    dealt = _keyed(rows, names, key, label).repartition(tasks)
    return from_frame(materialize(dealt.mapInPandas(grown, TREES_SCHEMA, barrier=True), "boosting-trees"))


def _total(sums: RDD, shape: tuple[int, ...]) -> np.ndarray:
    """The sums of all tasks added up: by the driver while they are small, else by tasks before it gets them."""
    if sums.getNumPartitions() * math.prod(shape) * 8 > MOST_COLLECTED:
        return sums.treeReduce(np.add)

    def known(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = own.reshape(3, -1)
        at = np.flatnonzero(flat[2])
        return at.astype(np.int32), flat[:, at]

    total = np.zeros((3, math.prod(shape[1:])), np.int64)
    for at, own in sums.map(known).collect():
        total[:, at] += own
    return total.reshape(shape)


def fit(rows: DataFrame, names: Sequence[str], key: str, label: str, s: Settings, parts: int | None = None) -> list[Tree]:
    """Trees for any number of rows: one pass over their blocks for each level of each tree, by ``parts`` tasks.

    A pass is a job of one stage over blocks that stay on the executors, in memory or on their disks; a task gives at most
    2**(depth - 2) * features * BINS sums, whatever the number of rows. A tree's answers are added to the margins in the
    first pass of the next one. Every few trees the margins are written, so a lost executor repeats a few trees at most.
    """
    cuts, trees, features = cuts_in(rows, names), [], len(names)
    blocks = _blocks(rows, names, key, label, cuts, parts or rows.sparkSession.sparkContext.defaultParallelism)

    def held() -> RDD:
        return blocks.rdd.map(lambda row: _unpacked(row, features)).persist(StorageLevel.MEMORY_AND_DISK)

    def answered(block: RDD, tree: Tree) -> RDD:
        return block.map(lambda b: _advanced(b, [tree])).persist(StorageLevel.MEMORY_AND_DISK)

    def written(since: list[Tree]) -> DataFrame:
        def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    margin = _advanced(_unpacked(row, features), since)[-1]
                    yield pd.DataFrame([{**row, "margin": margin.tobytes()}])

        return materialize(blocks.mapInPandas(advance, _BLOCK), "boosting-margins")

    kept = [held()]  # the blocks of this tree, and before its first pass those of the last one
    for number in range(s.trees):
        tree, columns = _sapling(), _columns(features, s, number)

        def sums(wanted: list[int]) -> np.ndarray:
            shape = 3, len(wanted), len(columns), BINS

            def partial(own: Iterator[Block]) -> Iterator[np.ndarray]:
                total = np.zeros(shape, np.int64)
                for keys, bins, y, margin in own:
                    drawn = np.flatnonzero(_drawn(keys, s, number))
                    live, place = _asked(_reached(bins, tree, drawn), wanted)
                    at = drawn[live]
                    g, h = _gradients(margin[at], y[at], s)
                    total += _histogram([bins[c][at] for c in columns], place, len(wanted), g, h)
                yield total

            return _total(kept[-1].mapPartitions(partial), shape)

        _grown(sums, columns, cuts, tree, s)
        trees.append(tree)
        for last in kept[:-1]:
            last.unpersist()
        if len(trees) < s.trees and len(trees) % TREES_PER_WRITE == 0:
            blocks = written(trees[-TREES_PER_WRITE:])
            kept = [kept[-1], held()]
        elif len(trees) < s.trees:
            kept = [kept[-1], answered(kept[-1], tree)]
    for last in kept:
        last.unpersist()
    return trees


# Answers. ``margin`` is an expression without Python, for a few small trees; the other two walk batches of rows.

def _numbers(values: Sequence[float], kind: str) -> Column:
    """A constant array, made once when the plan is optimised."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _depth(trees: Sequence[Tree]) -> int:
    """Splits on the longest path."""
    deepest = 0
    for tree in trees:
        depth = [0] * len(tree.value)  # children come after their parents
        for node, f in enumerate(tree.feature):
            if f >= 0:
                depth[tree.left[node]] = depth[tree.left[node] + 1] = depth[node] + 1
        deepest = max([deepest, *depth])
    return deepest


def _walked(trees: Sequence[Tree], features: Sequence[Column], visit) -> Column:
    """``visit(row, child)`` with the trees one after the other as constant arrays, and the values of the features.

    The row is an array of one element, so that it is made once and then named.
    """
    starts = np.cumsum([0] + [len(t.value) for t in trees]).tolist()

    def numbers(values: Iterable, kind: str) -> Column:
        return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")

    row = F.struct(
        F.transform(F.array(*features), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("x"),
        numbers((f for t in trees for f in t.feature), "int").alias("feature"),
        numbers((c for t in trees for c in t.cut), "double").alias("cut"),
        numbers((start + lt for start, t in zip(starts, trees) for lt in t.left), "int").alias("left"),
        numbers((v for t in trees for v in t.value), "double").alias("value"),
        numbers(starts[:-1], "int").alias("roots"),
    )

    def of(r: Column) -> Column:
        def child(node: Column) -> Column:
            f = r["feature"][node]
            return F.when(f < 0, node).otherwise(r["left"][node] + (~(r["x"][f] <= r["cut"][node])).cast("int"))

        return visit(r, child)

    return F.transform(F.array(row), of)[0]


def margin(trees: Sequence[Tree], features: Sequence[Column]) -> Column:
    """Sum of the leaves that a row reaches: the logit of its probability."""
    steps = _depth(trees)

    def visit(r: Column, child) -> Column:
        def leaf(root: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), root, lambda node, _: child(node)) if steps else root

        return F.aggregate(r["roots"], F.lit(0.0), lambda total, root: total + r["value"][leaf(root)])

    return _walked(trees, features, visit) if trees else F.lit(0.0)


def _matrix(columns: Sequence[pd.Series]) -> np.ndarray:
    return np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], axis=1)


def margin_by_batch(trees: Sequence[Tree], features: Sequence[Column]) -> Column:
    """``margin``, with the same numbers, for batches of rows at a time."""
    def walked(*columns: pd.Series) -> pd.Series:
        return pd.Series(next(staged_margins(trees, _matrix(columns), [len(trees)])))

    return F.pandas_udf(walked, "double")(*[f.cast("double") for f in features]) if trees else F.lit(0.0)


def attribution(trees: Sequence[Tree], features: Sequence[Column]) -> Column:
    """What each feature adds to a row's margin: the change of node value at each split on it.

    An array of one number per feature, and last the sum of the roots' values. The sum of the array is the margin.
    """
    base = float(sum(t.value[0] for t in trees))

    def walked(*columns: pd.Series) -> pd.Series:
        x = _matrix(columns)
        sums, rows = np.zeros((len(x), len(columns) + 1)), np.arange(len(x))
        for tree, (_, steps) in zip(trees, _paths(trees, x)):
            value = np.asarray(tree.value)
            for node, feature, below in steps:
                sums[rows, feature] += value[below] - value[node]
        sums[:, -1] = base
        return pd.Series(list(sums))

    return F.pandas_udf(walked, "array<double>")(*[f.cast("double") for f in features])


TREES_SCHEMA = "tree int, node int, feature int, cut double, left int, value double, gain double"


def to_pandas(trees: Sequence[Tree]) -> pd.DataFrame:
    rows = [
        (number, node, *fields) for number, t in enumerate(trees)
        for node, fields in enumerate(zip(t.feature, t.cut, t.left, t.value, t.gain))
    ]
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "left", "value", "gain"])


def to_frame(spark: SparkSession, trees: Sequence[Tree]) -> DataFrame:
    return spark.createDataFrame(to_pandas(trees), TREES_SCHEMA)


def from_frame(frame: DataFrame) -> list[Tree]:
    """Trees that ``to_frame`` stored; bins are only needed while fitting."""
    trees: dict[int, Tree] = {}
    for r in frame.orderBy("tree", "node").collect():
        tree = trees.setdefault(r.tree, Tree())
        node = tree.add(r.value)
        tree.feature[node], tree.cut[node], tree.left[node], tree.gain[node] = r.feature, r.cut, r.left, r.gain
    return list(trees.values())
