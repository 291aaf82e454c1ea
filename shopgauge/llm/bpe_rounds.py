"""Byte-pair encoding and decoding in batched numpy merge rounds.

The distinct words of a block of texts are laid out as one flat array of symbols. In each round every adjacent pair
inside a word is looked up by binary search in the sorted keys of the vocabulary's pairs; in each word the pair of the
lowest rank is merged wherever it stands, from left to right; words without a known pair are finished. So a round costs
a few array operations however many words there are, and the number of rounds is that of merges in the longest word.

The vocabulary file is a JSON description with a normaliser (NFC, white space to one space, lower case), a split into
contractions, runs of letters, single numbers and runs of other signs, bytes written as characters, an end-of-word mark,
and special tokens that are found before anything else. Decoding joins the tokens' own strings by one space.

Nulls: a null text is an empty one. Empty texts have no tokens, and decode to the empty text. Repeated rows give
repeated result rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from shopgauge.llm.tables import beside_text

#: The split pattern and the white space of the vocabulary's normaliser.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WHITE = regex.compile(r"\s+")
#: Letters and numbers that are newer than the Unicode version (16) of the vocabulary's library.
_NEWER_LETTERS = (
    "\\u0558\\u058B-\\u058C\\u088F\\u0C5C\\u0CDC\\u208F\\u209D-\\u209F\\uA7CE-\\uA7CF\\uA7D2\\uA7D4\\uA7DD\\uA7E2\\uA7F1"
    "\\uAB6C-\\uAB6D\\U000107BB-\\U000107BF\\U00010940-\\U00010959\\U00010EC5-\\U00010EC7\\U00010ED9-\\U00010EEE"
    "\\U00011B0A\\U00011DB0-\\U00011DDB\\U00011DF1\\U00016EA0-\\U00016EB8\\U00016EBB-\\U00016ED3\\U00016FF2-\\U00016FF3"
    "\\U000187F8-\\U000187FF\\U00018CD6-\\U00018CDA\\U00018D09-\\U00018D20\\U00018D80-\\U00018DF2\\U00018E00-\\U00019191"
    "\\U000191A0-\\U000191D2\\U0001B123-\\U0001B128\\U0001B168\\U0001D6A6\\U0001DF1F-\\U0001DF24\\U0001DF2B-\\U0001DF81"
    "\\U0001DF90-\\U0001DF96\\U0001DFCD-\\U0001DFFF\\U0001E6C0-\\U0001E6DE\\U0001E6E0-\\U0001E6E2\\U0001E6E4-\\U0001E6E5"
    "\\U0001E6E7-\\U0001E6ED\\U0001E6F0-\\U0001E6F4\\U0001E6FE-\\U0001E6FF\\U0002B73A-\\U0002B73F\\U0002B81E"
    "\\U0002CEA2-\\U0002CEAD\\U000323B0-\\U00033479"
)
_NEWER_NUMBERS = "\\U00011DE0-\\U00011DE9\\U0001246F\\U00012475-\\U0001247F\\U00012550-\\U00012686\\U00016FF4-\\U00016FF6"
#: Lower-case forms that the library knows and Python's tables do not yet have.
_LOWER = {
    **{c: c + 1 for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}, 0xA7CB: 0x264, 0xA7DC: 0x19B,
    **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)},
}
_ANY_LETTER, _ANY_NUMBER = rf"[\p{{L}}--[{_NEWER_LETTERS}]]", rf"[\p{{N}}--[{_NEWER_NUMBERS}]]"
_SPLIT = regex.compile(
    rf"{_CONTRACTIONS}|{_ANY_LETTER}+|{_ANY_NUMBER}|[^\s[{_ANY_LETTER}||{_ANY_NUMBER}]]+", regex.V1
)
#: The same split for texts of Latin letters only, which are all below U+0250; white space is one space by then.
_LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LATIN_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPLIT_LATIN = re.compile(rf"{_CONTRACTIONS}|[{_LATIN}]+|[{_LATIN_NUMBER}]|[^ {_LATIN}{_LATIN_NUMBER}]+")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_BLOCK_CHARS = 500_000
_KNOWN_WORDS = 100_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    return [chr(others.get(b, b)) for b in range(256)]


class Vocabulary:
    """Symbols, ranked pairs and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.specials.items()]}
        self.size = max(self.tokens) + 1
        suffix = model["end_of_word_suffix"]
        chars = byte_characters()
        self.inner = np.array([self.ids[c] for c in chars], np.int64)
        self.last = np.array([self.ids[c + suffix] for c in chars], np.int64)
        pairs = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]]
        left, right, merged = (np.array(column, np.int64) for column in zip(*pairs))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order, merged[order]
        self.by_rank = merged
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None


def merge_rounds(symbols: np.ndarray, word: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge until no word has a known pair. ``word`` is the ascending number of the word of each symbol.

    Returns the symbols of all words and their words, in order of words.
    """
    none = len(vocabulary.ranks)
    done_symbols, done_words = [], []
    while len(symbols):
        pair = symbols[:-1] * vocabulary.size + symbols[1:]
        at = np.minimum(np.searchsorted(vocabulary.keys, pair), none - 1)
        known = (vocabulary.keys[at] == pair) & (word[:-1] == word[1:])
        rank = np.append(np.where(known, vocabulary.ranks[at], none), none)
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(begin, len(word)))
        least = np.repeat(np.minimum.reduceat(rank, begin), sizes)
        open_ = least < none
        if not open_.all():
            done_symbols.append(symbols[~open_])
            done_words.append(word[~open_])
            symbols, word, rank, least = symbols[open_], word[open_], rank[open_], least[open_]
            if not len(symbols):
                break
        chosen = rank == least
        # Of overlapping places (the same symbol again and again) every second one counts, from the left.
        run_start = chosen & ~np.concatenate([[False], chosen[:-1]])
        place = np.arange(len(chosen))
        since = place - np.maximum.accumulate(np.where(run_start, place, 0))
        chosen &= since % 2 == 0
        symbols = np.where(chosen, vocabulary.by_rank[np.minimum(rank, none - 1)], symbols)
        stays = ~np.concatenate([[False], chosen[:-1]])
        symbols, word = symbols[stays], word[stays]
    if not done_symbols:
        return symbols, word
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def encode_words(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and where each word starts (one more entry: the end)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    encoded = [w.encode("utf-8", "replace") for w in words]
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    octets = np.frombuffer(b"".join(encoded), np.uint8)
    symbols = vocabulary.inner[octets]
    ends = np.cumsum(lengths) - 1
    symbols[ends] = vocabulary.last[octets[ends]]
    ids, owner = merge_rounds(symbols, np.repeat(np.arange(len(words)), lengths), vocabulary)
    return ids, np.searchsorted(owner, np.arange(len(words) + 1))


def normalise(text: str) -> str:
    """NFC, each run of white space one space, every character in lower case by itself."""
    text = _WHITE.sub(" ", unicodedata.normalize("NFC", text))
    if _BEYOND_LATIN.search(text):
        text = text.replace("Σ", "σ").translate(_LOWER)
    return text.lower()


def _plain_words(text: str) -> list[str]:
    text = normalise(text)
    return (_SPLIT if _BEYOND_LATIN.search(text) else _SPLIT_LATIN).findall(text)


def split_words(text: str, vocabulary: Vocabulary) -> list[str]:
    """The words of a text; a special token is an item of its own, marked by a leading line feed."""
    if vocabulary.special is None or not any(s in text for s in vocabulary.specials):
        return _plain_words(text)
    words = []
    for i, piece in enumerate(vocabulary.special.split(text)):
        words += ["\n" + piece] if i % 2 else _plain_words(piece)
    return words


class Encoder:
    """Encodes and decodes texts; remembers what it has made of a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, str, str]] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > _KNOWN_WORDS:
            self.known.clear()
        tokens = self.vocabulary.tokens
        new = [w for w in words if w not in self.known]
        plain = [w for w in new if w[0] != "\n"]
        ids, at = encode_words(plain, self.vocabulary)
        ids, at = ids.tolist(), at.tolist()
        for i, w in enumerate(plain):
            own = ids[at[i] : at[i + 1]]
            self.known[w] = (len(own), " ".join(map(str, own)), " ".join([tokens[x] for x in own]))
        for w in new:
            if w[0] == "\n":
                special = self.vocabulary.specials[w[1:]]
                self.known[w] = (1, str(special), tokens[special])

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids as text joined by one space, and the decoded text, of every text."""
        split = [split_words(t, self.vocabulary) for t in texts]
        self.learn(set().union(*split))
        out = []
        for words in split:
            counts, ids, tokens = zip(*map(self.known.__getitem__, words)) if words else ((), (), ())
            out.append((sum(counts), " ".join(ids), " ".join(tokens)))
        return out


def _encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path))
    return _encoders[path]


_encoders: dict[str, Encoder] = {}


def encoded(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (joined by one space) and decoded text of every document."""
    made = {"n_tokens": pa.int64(), "ids": pa.string(), "decoded": pa.string()}
    return _beside(docs, made, lambda texts: list(zip(*_encoder(vocabulary_path).encode_batch(texts))))


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text, made where the texts are encoded."""
    def work(texts: list[str]) -> list:
        return list(zip(*[(n, _hex(ids), _hex(decoded)) for n, ids, decoded in _encoder(vocabulary_path).encode_batch(texts)]))

    return _beside(docs, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, work)


def _beside(docs: DataFrame, made: dict, work) -> DataFrame:
    return beside_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], made, work, _BLOCK_CHARS)
