"""Document quality by Bradley-Terry pairwise ranking.

Each text has a vector of counts and ratios of its whole content. From preference pairs (a good document over a bad one)
a linear score is learned by logistic loss on the difference of the two vectors. All learnable documents are dealt to
buckets, and every good one of a bucket is paired with every bad one there; Newton steps are passes over the buckets. The
exact quantile of the scores of all learnable documents tells which are rejected: as many as have label 0. The reported
score is a logistic curve that passes 0.5 there. ``fit`` does the same for drawn pairs of vectors in memory.

Nulls: a null text is an empty one, which has a vector and a score like any other. Documents without an id are never
learned from and never held out. Without labels of both kinds every score is 0.5. Repeated rows give repeated result
rows; an empty table gives an empty result. Only doc_id and text are read; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shopgauge.llm import textarrays as ta
from shopgauge.functions.ordering import lay_out, with_rank
from shopgauge.llm.samples import is_held_out, labelled_ids
from shopgauge.llm.tables import beside_text, broadcast_if_small, in_blocks
from shopgauge.session import materialize

#: Pairs per document of the rarer label in ``fit``; documents of the commoner label in a bucket, about, and of the rarer
#: one at least (few ones go to several buckets); goods of a bucket that are compared at a time; Newton steps at most.
PAIRS_PER_DOCUMENT, BUCKET, LEAST_IN_BUCKET, SLICE, STEPS = 20, 1000, 40, 1000, 15
DIVISOR, HELD_OUT = 3, 1
_BLOCK_CHARS = 500_000
_ASCII = 128


def vectors(texts: list[str]) -> np.ndarray:
    """One row of features per text."""
    points, offsets = ta.code_points(texts)
    n, lengths = len(texts), np.diff(offsets) - 1
    owner = np.repeat(np.arange(n), lengths + 1)
    safe = np.maximum(lengths, 1)[:, None]
    # Shares of the ASCII characters one by one, and of all others together.
    kind = np.minimum(points, _ASCII).astype(np.int64)
    counts = np.bincount(owner * (_ASCII + 1) + kind, minlength=n * (_ASCII + 1)).reshape(n, _ASCII + 1)
    counts[:, 10] -= 1  # the separator that follows each text
    shares = counts / safe

    space = ta.is_space(points)
    starts, ends = ta.runs(~space)
    word_owner = owner[starts]
    words = np.bincount(word_owner, minlength=n)
    letters = ta.is_letter(points)
    low = ta.lowered(points)
    upper = letters & (low != points)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=mask, minlength=n)

    def distinct(hashes: np.ndarray, who: np.ndarray) -> np.ndarray:
        _, at = np.unique(hashes ^ ta.mixed(who.astype(np.uint64) + np.uint64(1)), return_index=True)
        return np.bincount(who[at], minlength=n)

    hashes = ta.span_hashes(low, starts, ends)
    same_text = word_owner[1:] == word_owner[:-1]
    repeats = np.bincount(word_owner[1:], weights=(hashes[1:] == hashes[:-1]) & same_text, minlength=n)
    pair = ta.mixed(hashes[1:] * np.uint64(31) + hashes[:-1])[same_text]
    pair_owner = word_owner[1:][same_text]
    line_starts, line_ends = ta.runs(points != 10)
    line_owner = owner[line_starts] if len(line_starts) else np.zeros(0, np.int64)
    lines = np.bincount(line_owner, minlength=n)
    line_hashes = ta.span_hashes(points, line_starts, line_ends)
    has_letter = np.concatenate([[0], np.cumsum(letters)])
    wordless = np.bincount(word_owner, weights=has_letter[ends] == has_letter[starts], minlength=n)
    odd_end = np.bincount(word_owner, weights=~letters[np.maximum(ends - 1, 0)] if len(ends) else None, minlength=n)

    some, rows = np.maximum(words, 1), np.maximum(lines, 1)
    extra = [
        np.log1p(words), np.log1p(lengths), np.log1p(lines), lengths / some,
        per_text(letters) / safe[:, 0], per_text(upper) / np.maximum(per_text(letters), 1),
        distinct(hashes, word_owner) / some, repeats / some,
        distinct(pair, pair_owner) / np.maximum(words - 1, 1), distinct(line_hashes, line_owner) / rows,
        wordless / some, odd_end / some, np.log1p(lengths / rows),
    ]
    return np.concatenate([np.sqrt(shares), np.stack(extra, axis=1)], axis=1)


@dataclass
class Ranker:
    """Weights of the standardised features; the score of the quantile; a scale."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.scale, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, sizes: tuple[int, int], pairs: int = PAIRS_PER_DOCUMENT, rounds: int = 300,
        penalty: float = 1e-3, seed: int = 1) -> Ranker | None:
    """Learn from pairs (label 1 over label 0). ``sizes``: how many documents of either label the sample stands for."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - centre) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    many = pairs * min(len(good), len(bad))
    wins, losses = good[rng.integers(0, len(good), many)], bad[rng.integers(0, len(bad), many)]
    difference = (z[wins] - z[losses]).astype(np.float32)
    weights = np.zeros(z.shape[1], np.float32)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        margin = difference @ weights
        pull = 1 / (1 + np.exp(np.clip(margin, -30, 30)))
        slope = -(pull @ difference) / many + penalty * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights - 0.03 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    raw = z @ weights
    # The quantile of the scores that leaves as many documents below as have label 0.
    weight = np.where(y == 1, sizes[1] / len(good), sizes[0] / len(bad))
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order])
    last = min(int(np.searchsorted(below, sizes[0] * (1 + 1e-9), side="right")), len(order) - 1)
    cut = (raw[order[max(last - 1, 0)]] + raw[order[last]]) / 2
    return Ranker(centre, spread, weights.astype(float), float(cut), float(max(raw.std() / 4, 1e-6)))


def _vectors(x: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32) for v in x]).astype(float)


def _labelled_vectors(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, label, x) of all documents with these ids, written once; x as bytes."""
    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in in_blocks(zip(batch["id"], batch["text"], batch["label"]), lambda r: len(r[1]) + 1, _BLOCK_CHARS):
                x = vectors([r[1] for r in block]).astype(np.float32)
                yield pd.DataFrame({"id": [r[0] for r in block], "label": [r[2] for r in block], "x": [v.tobytes() for v in x]})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(broadcast_if_small(ids), "id").select("id", "text", "label")
    return materialize(joined.mapInPandas(featurise, "id long, label int, x binary"), "quality-vectors")


def _moments(rows: DataFrame) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Rows of either label, mean and deviation of each feature."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _vectors(batch["x"])
            yield pd.DataFrame({"bad": [int((batch["label"] == 0).sum())], "n": [len(x)], "sum": [x.sum(axis=0)], "square": [(x * x).sum(axis=0)]})

    parts = rows.mapInPandas(partial, "bad long, n long, sum array<double>, square array<double>")
    each = parts.select("bad", "n", F.posexplode(F.arrays_zip("sum", "square")).alias("at", "v"))
    got = each.groupBy("at").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.sum("v.sum").alias("sum"), F.sum("v.square").alias("square")
    ).orderBy("at").collect()
    if not got:
        return {0: 0, 1: 0}, np.zeros(0), np.zeros(0)
    n, mean = got[0]["n"], np.array([r["sum"] for r in got]) / got[0]["n"]
    spread = np.sqrt(np.maximum(np.array([r["square"] for r in got]) / n - mean**2, 0)) + 1e-3
    return {0: got[0]["bad"], 1: n - got[0]["bad"]}, mean, spread


def _buckets(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Vectors of the good and the bad documents of each bucket as bytes, a row per bucket, written once."""
    rare = min(sizes, key=sizes.get)
    buckets = -(-sizes[1 - rare] // BUCKET)
    copies = min(buckets, -(-LEAST_IN_BUCKET * buckets // sizes[rare]))
    numbers = F.sequence(F.lit(0), F.when(F.col("label") == rare, F.lit(copies - 1)).otherwise(F.lit(0)))
    dealt = rows.select("id", "label", "x", F.explode(numbers).alias("copy")).withColumn(
        "bucket", F.pmod(F.xxhash64("id", F.lit(HELD_OUT)) + F.col("copy"), F.lit(buckets))
    )

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "x"], kind="stable")
        sides = [b"".join(part["x"][part["label"] == y]) for y in (1, 0)]
        return pd.DataFrame({"bucket": [part["bucket"].iloc[0]], "good": [sides[0]], "bad": [sides[1]]})

    return materialize(dealt.groupBy("bucket").applyInPandas(pack, "bucket long, good binary, bad binary"), "quality-buckets")


def _slopes(blocks: DataFrame, weights: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Over all pairs: their number, the sum of their losses, its gradient and its second derivatives."""
    width = len(weights)

    def standard(octets: bytes) -> np.ndarray:
        return np.clip((np.frombuffer(octets, np.float32).reshape(-1, width) - centre) / spread, -8, 8)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, loss, slope, bend = 0, 0.0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for good, bad in zip(batch["good"], batch["bad"]):
                every, losing = standard(good), standard(bad)
                for at in range(0, len(every), SLICE):
                    winning = every[at : at + SLICE]
                    margin = (winning @ weights)[:, None] - (losing @ weights)[None, :]
                    pull = 1 / (1 + np.exp(np.clip(margin, -30, 30)))
                    curve = pull * (1 - pull)
                    cross = winning.T @ curve @ losing
                    pairs, loss = pairs + pull.size, loss + float(np.logaddexp(0, -margin).sum())
                    slope += losing.T @ pull.sum(axis=0) - winning.T @ pull.sum(axis=1)
                    bend += (winning.T * curve.sum(axis=1)) @ winning + (losing.T * curve.sum(axis=0)) @ losing - cross - cross.T
        yield pd.DataFrame({"pairs": [pairs], "loss": [loss], "slope": [slope], "bend": [bend.ravel()]})

    # One row per task of sums of features and of pairs of features.
    parts = blocks.mapInPandas(partial, "pairs long, loss double, slope array<double>, bend array<double>").toPandas()
    bend = np.sum(np.stack(parts["bend"].to_list()), axis=0).reshape(width, width)
    return int(parts["pairs"].sum()), float(parts["loss"].sum()), np.sum(np.stack(parts["slope"].to_list()), axis=0), bend


def _newton(blocks: DataFrame, centre: np.ndarray, spread: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    weights = best = np.zeros(len(centre))
    step, least = best, math.inf
    for _ in range(STEPS):
        pairs, loss, slope, bend = _slopes(blocks, weights, centre, spread)
        if not pairs:
            return best
        value = loss / pairs + penalty / 2 * float(weights @ weights)
        if value > least:
            step = step / 2  # too far: half the way from the best place so far
        else:
            settled = least - value < 1e-7
            best, least = weights, value
            step = -np.linalg.solve(bend / pairs + penalty * np.eye(len(best)), slope / pairs + penalty * best)
            if settled:
                break
        weights = best + step
    return best


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranker | None:
    """A ranker from all learnable documents; vectors, pairs and quantile stay on the executors."""
    rows = _labelled_vectors(docs, materialize(labelled_ids(labels, label, DIVISOR, HELD_OUT), "quality-ids"))
    sizes, centre, spread = _moments(rows)
    if not sizes[0] or not sizes[1]:
        return None
    ranker = Ranker(centre, spread, _newton(_buckets(rows, sizes), centre, spread), 0.0, 1.0)

    def raws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"raw": ranker.raw(_vectors(batch["x"])), "id": batch["id"]})

    ranked = with_rank(lay_out(rows.select("id", "x").mapInPandas(raws, "raw double, id long"), ["raw", "id"]))
    # The quantile of the scores that leaves as many documents below as have label 0.
    found = ranked.agg(
        F.avg(F.when(F.col("rk").isin(sizes[0], sizes[0] + 1), F.col("raw"))).alias("cut"), F.stddev_pop("raw").alias("spread")
    ).head()
    ranker.cut, ranker.scale = found["cut"], max(found["spread"] / 4, 1e-6)
    return ranker


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document."""
    ranker = learn(docs, labels)

    def score(texts: list[str]) -> list:
        made = ranker.score(vectors(texts)) if ranker else np.full(len(texts), 0.5)
        return [made, (made >= 0.5).astype(np.int32)]

    key = F.col("doc_id").cast("long")
    flagged = docs.select(key.alias("doc_id"), is_held_out(key, DIVISOR, HELD_OUT).alias("held_out"), "text")
    return beside_text(flagged, ["doc_id", "held_out"], {"score": pa.float64(), "predicted": pa.int32()}, score, _BLOCK_CHARS)
