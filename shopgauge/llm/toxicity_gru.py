"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Words are runs of letters in lower case. The input of a word is the sum of its word vector and of the vectors of its
character n-grams, both from hashed tables. Windows of ``WINDOW`` words, each overlapping the next one, run through a
gated recurrent network in either direction; attention weighs the states of a window, and the pooled state gives its
logit. A document scores as its highest window, so every word of a text of any length is seen at least once.

Training is by documents: the loss is that of the soft maximum over the windows of a document, so windows need no labels.
The cut is chosen on logits by networks that have not seen the document (one for either half of the sample), where every
document of the sample weighs as many as it stands for: the share of a label in the sample follows the bound, the cut not.

Nulls: a null text is an empty one; texts without letters have one window of padding and get its score. Documents
without an id are never learned from and never held out. Without labels of both kinds every score is 0. Repeated rows
give repeated result rows; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shopgauge.llm import textarrays as ta
from shopgauge.llm.samples import class_sizes, is_held_out, labelled_texts
from shopgauge.llm.tables import beside_text, in_blocks

#: Documented bound of the fit: labelled rows of either label. All windows of a document are in its training step.
PER_CLASS = 2000
DIVISOR, HELD_OUT, THRESHOLD = 3, 1, 0.7
WINDOW, STEP = 32, 24
_ROWS, _INPUT, _STATE, _GRAMS = 1 << 15, 12, 8, (3, 5)
_BLOCK_CHARS = 600_000
#: Windows that a training step runs forward and back at a time; their gradients are summed.
_SLICE = 4096
#: Training steps of the network, documents in a step, seed; networks that are trained: of the sample, and of its halves.
STEPS, BATCH, SEED, PARTS = 288, 48, 7, 3
_PART_SCHEMA = pa.schema(
    [("part", pa.int32()), ("network", pa.binary()), ("logits", pa.list_(pa.float64())), ("labels", pa.list_(pa.int32()))]
)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _rows_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(_ROWS)).astype(np.int64)


class Block:
    """Distinct words of a block of texts, the table rows that make up their inputs, and the windows over all words."""

    def __init__(self, texts: list[str]):
        words = ta.letter_words(texts)
        hashes = ta.span_hashes(words.points, words.starts[words.first], words.ends[words.first])
        self.word_rows = _rows_of(hashes)
        grams, self.gram_word = ta.form_ngrams(words, *_GRAMS)
        self.gram_rows = _rows_of(grams)
        self.gram_count = np.maximum(np.bincount(self.gram_word, minlength=words.forms), 1).astype(np.float32)
        self.gram_start = np.searchsorted(self.gram_word, np.arange(words.forms))
        # Windows: every STEP words one starts, as long as words are left that no window holds yet.
        count = np.bincount(words.owner, minlength=len(texts))
        first = np.cumsum(count) - count
        windows = 1 + np.maximum(0, -(-(count - WINDOW) // STEP))
        self.document = np.repeat(np.arange(len(texts)), windows)
        order = np.arange(len(self.document)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = np.repeat(first, windows) + order * STEP
        end = np.repeat(first + count, windows)
        at = begin[:, None] + np.arange(WINDOW)
        self.mask = at < end[:, None]
        padded = np.append(words.form, words.forms)  # one more word, which is the padding
        self.word = np.where(self.mask, padded[np.minimum(at, len(words.form))], words.forms).astype(np.int64)
        self.mask[:, 0] = True  # an empty window attends to its padding


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def small(*shape: int, by: float) -> np.ndarray:
            return (rng.standard_normal(shape) * by).astype(np.float32)

        self.words, self.grams = small(_ROWS, _INPUT, by=0.05), small(_ROWS, _INPUT, by=0.05)
        self.p = {"b": np.zeros(1, np.float32)}
        for d in ("f", "r"):
            self.p["W" + d] = small(_INPUT, 3 * _STATE, by=_INPUT**-0.5)
            self.p["U" + d] = small(_STATE, 3 * _STATE, by=_STATE**-0.5)
            self.p["c" + d] = np.zeros(3 * _STATE, np.float32)
        self.p["a"], self.p["w"] = small(2 * _STATE, by=0.3), small(2 * _STATE, by=0.5)

    def inputs(self, block: Block) -> np.ndarray:
        """Input vectors of the distinct words and, in the last row, of the padding."""
        x = np.zeros((len(block.word_rows) + 1, _INPUT), np.float32)
        if len(block.word_rows):
            grams = np.add.reduceat(self.grams[block.gram_rows], block.gram_start, axis=0)
            x[:-1] = self.words[block.word_rows] + grams / np.sqrt(block.gram_count)[:, None]
        return x

    def run(self, gates: np.ndarray, word: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States of one direction, [step, window, state]. ``gates``: the words' share of the gates' inputs."""
        u, n, h = self.p["U" + d], len(word), _STATE
        state = np.zeros((n, h), np.float32)
        out = np.empty((WINDOW, n, h), np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            own, back = gates[word[:, t]], state @ u
            both = _sigmoid(own[:, : 2 * h] + back[:, : 2 * h])
            z, r = both[:, :h], both[:, h:]
            new = np.tanh(own[:, 2 * h :] + r * back[:, 2 * h :])
            if trace is not None:
                trace.append((t, state, z, r, new, back[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def windows(self, x: np.ndarray, word: np.ndarray, mask: np.ndarray, traces: dict | None = None):
        """Logits of windows; also the states and the attention, for training."""
        states = np.concatenate(
            [self.run(x @ self.p["W" + d] + self.p["c" + d], word, d, None if traces is None else traces.setdefault(d, [])) for d in "fr"],
            axis=2,
        )
        heat = np.where(mask.T, states @ self.p["a"], -np.inf)
        heat = np.exp(heat - heat.max(axis=0))
        heat /= heat.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", heat, states)
        return pooled @ self.p["w"] + self.p["b"][0], states, heat, pooled

    def score(self, texts: list[str], shift: float = 0.0) -> np.ndarray:
        block = Block(texts)
        x = self.inputs(block)
        best = np.full(len(texts), -np.inf)
        for low in range(0, len(block.word), 8192):  # bounded memory, however long the texts are
            part = slice(low, low + 8192)
            logits = self.windows(x, block.word[part], block.mask[part])[0]
            np.maximum.at(best, block.document[part], logits)
        return _sigmoid(np.clip(best - shift, -30, 30))


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[start], np.add.reduceat(values[order], start, axis=0)


class Trainer:
    """Adam for the dense parameters, Adagrad for the touched rows of the tables."""

    def __init__(self, network: Network, rate: float = 0.02):
        self.net, self.rate, self.steps = network, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.seen = {"words": np.full(_ROWS, 1e-6, np.float32), "grams": np.full(_ROWS, 1e-6, np.float32)}

    def step(self, block: Block, chosen: np.ndarray, y: np.ndarray) -> float:
        """One step over the chosen windows; ``y`` is the label of each document of the block."""
        net = self.net
        x = net.inputs(block)
        word, mask, document = block.word[chosen], block.mask[chosen], block.document[chosen]
        slices = [slice(low, low + _SLICE) for low in range(0, len(word), _SLICE)]
        traces: dict = {}
        kept = net.windows(x, word, mask, traces) if len(slices) == 1 else None
        logits = kept[0] if kept else np.concatenate([net.windows(x, word[part], mask[part])[0] for part in slices])
        # Soft maximum over the windows of a document, and the logistic loss of that.
        top = np.full(len(y), -np.inf)
        np.maximum.at(top, document, logits)
        mass = np.exp(logits - top[document])
        whole = np.bincount(document, weights=mass, minlength=len(y))
        total = top + np.log(np.maximum(whole, 1e-12))
        wrong = _sigmoid(np.clip(total, -30, 30)) - y
        slope = (wrong[document] * mass / whole[document] / len(y)).astype(np.float32)

        g, d_x = {k: np.zeros_like(v) for k, v in net.p.items()}, np.zeros_like(x)
        for part in slices:
            traces = traces if kept else {}
            made = kept or net.windows(x, word[part], mask[part], traces)
            for k, v in self._back(x, word[part], slope[part], traces, *made[1:], d_x).items():
                g[k] = g[k] + v
        self._dense(g)
        self._tables(block, d_x[:-1])
        return float(np.mean(np.logaddexp(0, total) - y * total))

    def _back(
        self, x: np.ndarray, word: np.ndarray, slope: np.ndarray, traces: dict, states: np.ndarray, heat: np.ndarray,
        pooled: np.ndarray, d_x: np.ndarray,
    ) -> dict[str, np.ndarray]:
        """Gradients of the dense parameters from some windows; those of the inputs are added to ``d_x``."""
        net, h = self.net, _STATE
        g = {"b": slope.sum(keepdims=True), "w": slope @ pooled}
        d_pooled = slope[:, None] * net.p["w"]
        d_heat = heat * (np.einsum("tnh,nh->tn", states, d_pooled) - (pooled * d_pooled).sum(axis=1))
        g["a"] = np.einsum("tn,tnh->h", d_heat, states)
        d_states = heat[:, :, None] * d_pooled + d_heat[:, :, None] * net.p["a"]
        for d, own in (("f", d_states[:, :, :h]), ("r", d_states[:, :, h:])):
            u, d_u = net.p["U" + d], np.zeros_like(net.p["U" + d])
            d_gates = np.empty((WINDOW, len(word), 3 * h), np.float32)
            carry = np.zeros((len(word), h), np.float32)
            for t, before, z, r, new, back in reversed(traces[d]):
                carry = carry + own[t]
                d_new = carry * (1 - z) * (1 - new * new)
                d_back = np.concatenate([carry * (before - new) * z * (1 - z), d_new * back * r * (1 - r), d_new * r], axis=1)
                d_gates[t, :, : 2 * h], d_gates[t, :, 2 * h :] = d_back[:, : 2 * h], d_new
                d_u += before.T @ d_back
                carry = carry * z + d_back @ u.T
            rows, sums = _summed(word.T.ravel(), d_gates.reshape(-1, 3 * h))
            g["U" + d], g["c" + d] = d_u, sums.sum(axis=0)
            g["W" + d] = x[rows].T @ sums
            d_x[rows] += sums @ net.p["W" + d].T
        return g

    def _dense(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, g in gradients.items():
            g = np.clip(g, -1, 1).astype(np.float32)
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            push = self.first[k] / (1 - 0.9**self.steps) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)
            self.net.p[k] = self.net.p[k] - np.float32(self.rate) * push

    def _tables(self, block: Block, d_x: np.ndarray) -> None:
        if not len(d_x):
            return
        per_gram = (d_x / np.sqrt(block.gram_count)[:, None])[block.gram_word]
        for name, table, rows, values in (
            ("words", self.net.words, block.word_rows, d_x), ("grams", self.net.grams, block.gram_rows, per_gram),
        ):
            rows, sums = _summed(rows, values)
            self.seen[name][rows] += (sums * sums).mean(axis=1)
            table[rows] -= 0.1 * sums / np.sqrt(self.seen[name][rows])[:, None]


def _trained(texts: list[str], labels: np.ndarray, steps: int, batch: int, seed: int) -> Network:
    network = Network(seed)
    trainer, rng = Trainer(network), np.random.default_rng(seed)
    epochs = -(-steps // max(1, len(texts) // batch))
    for epoch in range(epochs):
        trainer.rate = 0.02 * (1 - epoch / epochs) + 0.002
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            block = Block([texts[i] for i in part])
            trainer.step(block, np.arange(len(block.document)), labels[part])
    return network


def _logits(network: Network, texts: list[str]) -> np.ndarray:
    made = np.concatenate([network.score(block) for block in in_blocks(texts, len, _BLOCK_CHARS)])
    return np.log(made / (1 - np.minimum(made, 1 - 1e-12)) + 1e-300)


def _fitted_part(part: int, texts: list[str], labels: np.ndarray, steps: int, batch: int, seed: int) -> tuple[Network | None, np.ndarray, np.ndarray]:
    """Part 0: the network of the whole sample. Parts 1 and 2: the logits and labels of a half, by a network of the other half.

    With one document of a label there is no second half to learn it from; then part 0 has the logits too.
    """
    halved = min((labels == 1).sum(), (labels == 0).sum()) > 1
    if part == 0:
        network = _trained(texts, labels, steps, batch, seed)
        return (network, np.empty(0), labels[:0]) if halved else (network, _logits(network, texts), labels)
    if not halved:
        return None, np.empty(0), labels[:0]
    half = 1 + np.where(labels == 1, np.cumsum(labels == 1), np.cumsum(labels == 0)) % 2
    seen, unseen = np.flatnonzero(half != part), np.flatnonzero(half == part)
    other = _trained([texts[i] for i in seen], labels[seen], -(-steps // 2), batch, seed)
    return None, _logits(other, [texts[i] for i in unseen]), labels[unseen]


def _with_cut(parts: list[tuple[Network | None, np.ndarray, np.ndarray]], stands_for: tuple[float, float]) -> tuple[Network, float]:
    """The network of part 0, and the shift that the logits and labels of all parts call for."""
    logits, labels = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    return parts[0][0], _best_shift(logits, labels, np.where(labels == 1, stands_for[1], stands_for[0]))


def fit(texts: list[str], labels: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0), steps: int = STEPS, batch: int = BATCH,
        seed: int = SEED) -> tuple[Network, float] | None:
    """A network, and the shift of its logits: that unseen documents are told apart best at the threshold.

    ``stands_for``: how many documents one of label 0 and one of label 1 stands for.
    """
    if not (labels == 1).any() or not (labels == 0).any():
        return None
    return _with_cut([_fitted_part(part, texts, labels, steps, batch, seed) for part in range(PARTS)], stands_for)


def _best_shift(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The shift that puts the threshold's logit midway between the two logits where most weight is told apart.

    Equal logits, up to their rounding, stay on one side; above the last one the cut is one more.
    """
    order = np.argsort(logits, kind="stable")
    sorted_logits, y = logits[order], labels[order]
    clean, toxic = weight[order] * (y == 0), weight[order] * (y == 1)
    right = np.cumsum(clean) + toxic.sum() - np.cumsum(toxic)
    following = np.append(sorted_logits[1:], sorted_logits[-1] + 2)
    best = int(np.argmax(np.where(following - sorted_logits > 1e-4, right, -1)))
    above = following[best]
    return float((sorted_logits[best] + above) / 2 - np.log(THRESHOLD / (1 - THRESHOLD)))


def _training(part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that takes the whole sample and trains one of its networks."""
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In the order of ids and texts, so that a repeated task, or other files, give the same network.
        rows = sorted(row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        y = np.array([row[2] for row in rows])
        if (y == 1).any() and (y == 0).any():
            network, logits, seen = _fitted_part(part, [row[1] for row in rows], y, STEPS, BATCH, SEED)
            stored = pickle.dumps(network) if network else None
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "network": [stored], "logits": [logits.tolist()], "labels": [seen.tolist()]}, schema=_PART_SCHEMA
            )

    return train


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> tuple[Network, float] | None:
    """A network from a bounded labelled sample. Its three networks are trained by three tasks; no text goes to the driver."""
    sample = labelled_texts(docs, labels, label, per_class, DIVISOR, HELD_OUT).select("id", "text", "label").coalesce(1)
    schema = "part int, network binary, logits array<double>, labels array<int>"
    # A job each, side by side: a union of frames of one partition may be planned as one partition, so as one task.
    with ThreadPoolExecutor(PARTS) as pool:
        made = list(pool.map(lambda part: sample.mapInArrow(_training(part), schema).collect(), range(PARTS)))
    rows = [row for rows_of_part in made for row in rows_of_part]
    if not rows:
        return None
    parts = [(row["network"] and pickle.loads(row["network"]), np.array(row["logits"], float), np.array(row["labels"], int)) for row in rows]
    clean, toxic = (max(1.0, size / per_class) for size in class_sizes(labels, label, DIVISOR, HELD_OUT))
    return _with_cut(parts, (clean, toxic))


def _scores(model: tuple[Network, float] | None, texts: list[str]) -> np.ndarray:
    return np.asarray(model[0].score(texts, model[1])) if model else np.zeros(len(texts))


def scored_rows(docs: DataFrame, model: tuple[Network, float] | None, columns: list[str]) -> DataFrame:
    """The given columns of the documents, as they are, score and predicted."""
    def score(texts: list[str]) -> list:
        made = _scores(model, texts)
        return [made, (made >= THRESHOLD).astype(np.int32)]

    return beside_text(docs, columns, {"score": pa.float64(), "predicted": pa.int32()}, score, _BLOCK_CHARS)


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document."""
    key = F.col("doc_id").cast("long")
    flagged = docs.select(key.alias("doc_id"), is_held_out(key, DIVISOR, HELD_OUT).alias("held_out"), "text")
    return scored_rows(flagged, learn(docs, labels, "toxic", per_class), ["doc_id", "held_out"])


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    model = learn(docs, labels, "toxic", per_class)

    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            blocks = in_blocks(range(len(texts)), lambda i: len(texts[i]) + 1, _BLOCK_CHARS)
            made = [_scores(model, [texts[i] for i in b]) for b in blocks]
            yield batch.filter(pa.array(np.concatenate(made) < THRESHOLD)) if made else batch

    return docs if model is None else docs.mapInArrow(keep, docs.schema)
