"""Texts as flat numpy arrays: letters, words and their 64-bit hashes for a block of texts at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_TOP = 0x32400  # past the last assigned letter
_tables: dict[str, np.ndarray] = {}


def _table(kind: str) -> np.ndarray:
    """``letter``: whether a code point is a letter; ``lower``: its lower-case form, if that is one code point."""
    if kind not in _tables:
        chars = [chr(i) for i in range(_TOP)]
        if kind == "letter":
            _tables[kind] = np.fromiter((c.isalpha() for c in chars), bool, _TOP)
        else:
            lowered = (c.lower() for c in chars)
            _tables[kind] = np.fromiter(
                (ord(low) if len(low) == 1 else i for i, low in enumerate(lowered)), np.uint32, _TOP
            )
    return _tables[kind]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each text starts (one more entry: the end)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    flat = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def lowered(points: np.ndarray) -> np.ndarray:
    low = _table("lower")
    return np.where(points < _TOP, low[np.minimum(points, _TOP - 1)], points)


def is_letter(points: np.ndarray) -> np.ndarray:
    return _table("letter")[np.minimum(points, _TOP - 1)] & (points < _TOP)


def is_space(points: np.ndarray) -> np.ndarray:
    """The six ASCII space characters."""
    return (points == 32) | ((points >= 9) & (points <= 13))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true entries."""
    steps = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = values ^ (values >> np.uint64(33))
    values = values * _MIX[0]
    values = values ^ (values >> np.uint64(33))
    values = values * _MIX[1]
    return values ^ (values >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least n positions."""
    have = _tables.get("powers")
    if have is None or len(have[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        many = max(n, 1 << 16)
        have = tuple(
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(many - 1, b, np.uint64)])) for b in (_BASE, inverse)
        )
        _tables["powers"] = have
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span, from one running polynomial over all values."""
    powers, inverses = _powers(len(values) + 1)
    terms = (values.astype(np.uint64) + np.uint64(1)) * powers[: len(values)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a block: spans in ``points``, the text each belongs to, and their distinct forms."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    form: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def forms(self) -> int:
        return len(self.first)


def letter_words(texts: list[str]) -> Words:
    """Runs of letters in lower case. ``form`` numbers the distinct words, ``first`` is one place where each stands."""
    raw, offsets = code_points(texts)
    points = lowered(raw)
    starts, ends = runs(is_letter(points))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    hashes = span_hashes(points, starts, ends)
    _, first, form = np.unique(hashes, return_index=True, return_inverse=True)
    return Words(points, starts, ends, owner, form.ravel(), first, offsets)


def form_ngrams(words: Words, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams (``low``..``high`` characters, a mark at either end) of the distinct words.

    Returns the hashes, and for each the number of the distinct word, in ascending order.
    """
    starts, ends = words.starts[words.first], words.ends[words.first]
    lengths = ends - starts + 2
    at = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    which = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(total) - np.repeat(at, lengths)
    source = np.repeat(starts, lengths) + place - 1
    inner = (place > 0) & (place < np.repeat(lengths, lengths) - 1)
    marked = np.where(inner, words.points[np.clip(source, 0, len(words.points) - 1)], np.uint32(3))
    out, owner = [], []
    left = np.repeat(lengths, lengths) - place
    for n in range(low, high + 1):
        begin = np.flatnonzero(left >= n)
        out.append(span_hashes(marked, begin, begin + n) + np.uint64(n))
        owner.append(which[begin])
    hashes, owners = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order]
