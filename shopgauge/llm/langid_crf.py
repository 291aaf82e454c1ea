"""Language of words and documents by a linear-chain conditional random field.

Words are runs of letters in lower case. The emission of a word is the sum of learned weights of its features: its
prefixes and suffixes, its character n-grams, and its entries in a lexicon (how often the training documents of each
language hold the word). Learned transitions tie neighbouring words. Forward-backward gives each word the probability
of each language, so code-switched text is labelled word by word; a document takes the language with the largest mean
probability over all of its words.

A chain is a run of at most ``CHAIN`` words within one text. Training chains are cut from the training texts; half of
them are spliced from two languages, which is where the transitions learn how rarely, and how, a text switches.

Nulls: a null text, and a text without a letter, is ``und`` with score 0. Documents without an id or a language are
never learned from, and those without an id are never held out. With no language to learn every text is ``und``.
Repeated rows give repeated result rows; an empty table gives an empty result. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shopgauge.llm import textarrays as ta
from shopgauge.llm.samples import is_held_out, learnable
from shopgauge.llm.tables import beside_text
from shopgauge.session import materialize

#: Documented bounds of the fit: documents of each language, languages, and documents of all languages.
PER_LANGUAGE, MOST_LANGUAGES, MOST_DOCUMENTS = 250, 200, 5000
DIVISOR, HELD_OUT, UNKNOWN = 4, 2, "und"
CHAIN = 64
_ROWS, _BLOCK_CHARS = 1 << 17, 600_000


def _word_features(words: ta.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the features of the distinct words, their word, and the words' own hashes (for the lexicon)."""
    starts, ends = words.starts[words.first], words.ends[words.first]
    number, lengths = np.arange(words.forms), ends - starts
    hashes, owners = [], []
    for n in (1, 2, 3, 4):
        long_ = np.flatnonzero(lengths >= n)
        for kind, low in ((1, starts), (2, ends - n)):  # prefixes and suffixes
            hashes.append(ta.mixed(ta.span_hashes(words.points, low[long_], low[long_] + n) + np.uint64(10 * n + kind)))
            owners.append(number[long_])
    grams, gram_word = ta.form_ngrams(words, 1, 3)
    rows = np.concatenate([*hashes, grams])
    owner = np.concatenate([*owners, gram_word])
    order = np.argsort(owner, kind="stable")
    return (rows[order] % np.uint64(_ROWS)).astype(np.int64), owner[order], ta.span_hashes(words.points, starts, ends)


def chains(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the chains over words whose texts are ``owner``."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    sizes = np.diff(np.append(first, len(owner)))
    many = -(-sizes // CHAIN)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    starts = np.repeat(first, many) + nth * CHAIN
    return starts, np.minimum(CHAIN, np.repeat(first + sizes, many) - starts)


@dataclass
class Field:
    """Languages, feature weights, lexicon (sorted word hashes and their log shares), start and transition weights."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    shares: np.ndarray
    lexicon_weight: np.ndarray
    start: np.ndarray
    moves: np.ndarray

    def emissions(self, words: ta.Words) -> np.ndarray:
        """Scores of the distinct words, [word, language]."""
        rows, owner, own = _word_features(words)
        out = np.zeros((words.forms, len(self.languages)), np.float32)
        if words.forms:
            begin = np.searchsorted(owner, np.arange(words.forms))
            count = np.diff(np.append(begin, len(owner)))[:, None]
            out = np.add.reduceat(self.weights[rows], begin, axis=0) / np.sqrt(count)
            out = out + self.lexicon_shares(own) * self.lexicon_weight
        return out.astype(np.float32)

    def lexicon_shares(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(hashes), len(self.languages)), np.float32)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            found = self.lexicon[at] == hashes
            out[found] = self.shares[at[found]]
        return out

    def marginals(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Forward-backward over chains of the given word scores.

        Returns the probabilities of each word's languages and, for training, the expected starts and moves.
        """
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        longest = int(lengths[0]) if len(lengths) else 0
        live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest)]  # chains longer than t
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))
        moves = np.exp(self.moves - self.moves.max())
        ahead, back = np.empty_like(emit), np.ones_like(emit)
        state = None
        for t in range(longest):
            at = starts[: live[t]] + t
            prior = np.exp(self.start - self.start.max()) if t == 0 else state[: live[t]] @ moves
            state = prior * emit[at]
            state = state / state.sum(axis=1, keepdims=True)
            ahead[at] = state
        state, crossing = None, np.zeros_like(moves)
        for t in range(longest - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            later = emit[at + 1] * back[at + 1]
            crossed = ahead[at][:, :, None] * moves * later[:, None, :]
            crossing += (crossed / crossed.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            state = later @ moves.T
            back[at] = state / state.sum(axis=1, keepdims=True)
        both = ahead * back
        both /= both.sum(axis=1, keepdims=True)
        return both, both[starts].sum(axis=0) if len(starts) else np.zeros(len(self.languages)), crossing

    def label(self, texts: list[str]) -> tuple[ta.Words, np.ndarray]:
        """The words of the texts and the probabilities of their languages."""
        words = ta.letter_words(texts)
        starts, lengths = chains(words.owner)
        scores = self.emissions(words)[words.form]
        return words, self.marginals(scores, starts, lengths)[0] if len(scores) else scores


def fit(texts: list[str], langs: list[str], epochs: int = 3, batch: int = 256, rate: float = 0.15, seed: int = 5) -> Field | None:
    """A field learned by gradient steps on the chains of the texts, half of them spliced."""
    languages = sorted(set(langs))
    if not languages:
        return None
    k, rng = len(languages), np.random.default_rng(seed)
    gold = np.array([languages.index(x) for x in langs])
    words = ta.letter_words(texts)
    rows, owner, own = _word_features(words)
    begin = np.searchsorted(owner, np.arange(words.forms + 1))
    counts = np.bincount(words.form * k + gold[words.owner], minlength=words.forms * k).reshape(-1, k).astype(np.float32)
    often = counts.sum(axis=1) >= 5
    shares = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * k)) + np.log(k)
    order = np.argsort(own[often], kind="stable")
    field = Field(
        languages, np.zeros((_ROWS, k), np.float32), own[often][order], shares[often][order].astype(np.float32),
        np.full(k, 0.1, np.float32), np.zeros(k), 2 * np.eye(k),
    )
    seen = np.full(_ROWS, 1e-6, np.float32)
    dense = {name: np.full(np.shape(getattr(field, name)), 1e-6) for name in ("lexicon_weight", "start", "moves")}
    starts, lengths = chains(words.owner)
    label = gold[words.owner]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(starts)), max(1, len(starts) // batch)):
            # Chains as lists of word places; every second one goes on in another chain from a random word.
            places = [np.arange(starts[c], starts[c] + lengths[c]) for c in part]
            for i in range(0, len(places) - 1, 2):
                a, b = places[i], places[i + 1]
                places[i] = np.concatenate([a[: rng.integers(0, len(a) + 1)], b[rng.integers(0, len(b)) :]])[:CHAIN]
            size = np.array([len(p) for p in places])
            if not size.sum():
                continue
            at, first = np.concatenate(places), np.cumsum(size) - size
            forms, where = np.unique(words.form[at], return_inverse=True)
            where = where.ravel()
            spans = begin[forms + 1] - begin[forms]
            feature = rows[np.repeat(begin[forms], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)]
            of = np.repeat(np.arange(len(forms)), spans)
            root = np.sqrt(spans)[:, None]
            lexical = field.lexicon_shares(own[forms])
            scores = np.add.reduceat(field.weights[feature], np.cumsum(spans) - spans, axis=0) / root + lexical * field.lexicon_weight
            made, begun, crossing = field.marginals(scores[where].astype(np.float32), first, size)
            y = label[at]
            error = made.copy()
            error[np.arange(len(y)), y] -= 1
            by_form = np.zeros((len(forms), k))
            np.add.at(by_form, where, error)
            inside = np.ones(len(at), bool)
            inside[first] = False
            told = np.bincount(y[np.flatnonzero(inside) - 1] * k + y[inside], minlength=k * k).reshape(k, k)
            gradients = {
                "lexicon_weight": (by_form * lexical).sum(axis=0), "moves": crossing - told,
                "start": begun - np.bincount(y[first], minlength=k),
            }
            for name, g in gradients.items():
                dense[name] += g * g
                setattr(field, name, getattr(field, name) - rate * g / np.sqrt(dense[name]))
            order = np.argsort(feature, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(feature[order]) != 0]))
            touched = feature[order][edge]
            g = np.add.reduceat((by_form / root)[of][order], edge, axis=0)
            seen[touched] += (g * g).mean(axis=1)
            field.weights[touched] -= (rate * g / np.sqrt(seen[touched])[:, None]).astype(np.float32)
    return field


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Field | None:
    """A field from a bounded sample: of each language the learnable documents with the smallest hashes of their ids.

    All languages are learned, up to the ``MOST_LANGUAGES`` with the most learnable documents; where there are many, each
    has fewer documents, ``MOST_DOCUMENTS`` together.
    """
    key = F.col("doc_id").cast("long")
    ids = docs.select(key.alias("id"), "lang").where(F.col("lang").isNotNull() & learnable(key, DIVISOR, HELD_OUT))
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))
    languages = materialize(sizes.orderBy(F.desc("documents"), "lang").limit(MOST_LANGUAGES).select("lang"), "languages")
    per_language = min(per_language, MOST_DOCUMENTS // max(1, languages.count()))
    ids = ids.join(F.broadcast(languages), "lang")
    order = F.xxhash64(F.col("id"), F.lit(DIVISOR))
    # Only hashes of a language's smallest remain of each group before the next one is made: a filter by rank, which
    # keeps the first rows of a group on the map side.
    first = Window.partitionBy("lang").orderBy(order, "id")
    chosen = materialize(
        ids.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language).select("id", F.col("lang").alias("of")).distinct(),
        "language-ids",
    )
    texts = docs.select(key.alias("id"), F.col("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # At most MOST_DOCUMENTS ids, so this side may be broadcast whatever the size of the corpus.
    sample = texts.join(F.broadcast(chosen), "id").where(F.col("lang") == F.col("of")).select("id", "text", "lang")
    rows = sample.toPandas().sort_values(["id", "text"], kind="stable")
    return fit(rows["text"].tolist(), rows["lang"].tolist()) if len(rows) else None


def document_languages(field: Field | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and its mean probability over the words of each text."""
    if field is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    words, made = field.label(texts)
    n, k = len(texts), len(field.languages)
    sums = np.stack([np.bincount(words.owner, weights=made[:, j], minlength=n) for j in range(k)], axis=1) if len(made) else np.zeros((n, k))
    count = np.bincount(words.owner, minlength=n)
    best = sums.argmax(axis=1)
    score = np.where(count > 0, sums[np.arange(n), best] / np.maximum(count, 1), 0.0)
    return [field.languages[b] if c else UNKNOWN for b, c in zip(best, count)], np.minimum(score, 1.0)


def predicted(docs: DataFrame, field: Field | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per document."""
    field = field or learn(docs, per_language)

    key = F.col("doc_id").cast("long")
    flagged = docs.select(key.alias("doc_id"), is_held_out(key, DIVISOR, HELD_OUT).alias("held_out"), "text")
    made = {"lang_pred": pa.string(), "score": pa.float64()}
    return beside_text(flagged, ["doc_id", "held_out"], made, lambda texts: list(document_languages(field, texts)), _BLOCK_CHARS)


def word_spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and its spans (start, end, lang, score): runs of words of one language, in order, by code points."""
    def spans(texts: list[str]) -> list:
        words, made = field.label(texts)
        best = made.argmax(axis=1) if len(made) else np.zeros(0, np.int64)
        new = np.concatenate([[True], (np.diff(best) != 0) | (np.diff(words.owner) != 0)]) if len(best) else np.zeros(0, bool)
        edge = np.flatnonzero(new)
        last = np.append(edge[1:], len(best)) - 1
        out: list[list[dict]] = [[] for _ in texts]
        for a, b in zip(edge.tolist(), last.tolist()):
            who = int(words.owner[a])
            base = words.offsets[who]
            out[who].append({
                "start": int(words.starts[a] - base), "end": int(words.ends[b] - base),
                "lang": field.languages[best[a]], "score": float(made[a : b + 1, best[a]].mean()),
            })
        return [out]

    one = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return beside_text(rows, ["doc_id"], {"spans": pa.list_(one)}, spans, _BLOCK_CHARS)
