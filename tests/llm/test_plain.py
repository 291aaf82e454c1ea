"""Scores of the classifiers beside plain code that goes through one text at a time, word by word."""

import math
import random
import re

import numpy as np
import pytest

from shopgauge.llm import langid_crf, quality_bt, toxicity_gru

TEXTS = [
    "", "x", " \t\n", "One one ONE two\nTwo, two!  \n\nTHREE 3 33 three.", "été É ß İstanbul ΑΒΓ αβγ 　 日本", "a b a b a b\na b\na b",
    "12 34 -- ??\r\n12", "\n\nline\n\n", "\x00\x1c a\x0bb",
]


def lowered(text):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def made_text(rng, words):
    return " ".join("".join(rng.choice("abcdeéßX") for _ in range(rng.randint(1, 7))) for _ in range(words))


def plain_vector(text):
    n, low = len(text), lowered
    counts = [0] * 129
    for c in text:
        counts[min(ord(c), 128)] += 1
    raw = [w for w in re.split("[ \t-\r]+", text) if w]
    words, lines = [low(w) for w in raw], [line for line in text.split("\n") if line]
    letters = sum(c.isalpha() for c in text)
    some, rows = max(len(words), 1), max(len(lines), 1)
    pairs = list(zip(words, words[1:]))
    extra = [
        math.log1p(len(words)), math.log1p(n), math.log1p(len(lines)), n / some, letters / max(n, 1),
        sum(c.isalpha() and low(c) != c for c in text) / max(letters, 1), len(set(words)) / some, sum(a == b for a, b in pairs) / some,
        len(set(pairs)) / max(len(words) - 1, 1), len(set(lines)) / rows, sum(not any(c.isalpha() for c in w) for w in raw) / some,
        sum(not w[-1].isalpha() for w in raw) / some, math.log1p(n / rows),
    ]
    return [math.sqrt(k / max(n, 1)) for k in counts] + extra


def test_vectors_of_quality_equal_plain_ones():
    rng = random.Random(3)
    texts = TEXTS + [made_text(rng, k) for k in (1, 2, 40, 400)]
    got = quality_bt.vectors(texts)
    for row, text in zip(got, texts):
        assert row == pytest.approx(plain_vector(text), abs=1e-12), text


MASK = (1 << 64) - 1


def plain_hash(word):
    """Polynomial of the code points, then a bijective scramble; all modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    value = (sum((ord(c) + 1) * pow(base, i, 1 << 64) for i, c in enumerate(word)) + len(word)) & MASK
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        value ^= value >> 33
        value = value * factor & MASK
    return value ^ (value >> 33)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_input(net, word):
    marked = "\x03" + word + "\x03"
    grams = [marked[i : i + n] for n in range(3, 6) for i in range(len(marked) - n + 1)]
    rows = len(net.words)
    summed = sum(net.grams[((plain_hash(g) + len(g)) & MASK) % rows].astype(float) for g in grams)
    return net.words[plain_hash(word) % rows] + summed / math.sqrt(len(grams))


def plain_states(net, inputs, d):
    h = toxicity_gru._STATE
    w, u, c = (net.p[k + d].astype(float) for k in "WUc")
    state, out = np.zeros(h), []
    for x in inputs if d == "f" else inputs[::-1]:
        own, back = x @ w + c, state @ u
        keep, reset = sigmoid(own[:h] + back[:h]), sigmoid(own[h : 2 * h] + back[h : 2 * h])
        state = (1 - keep) * np.tanh(own[2 * h :] + reset * back[2 * h :]) + keep * state
        out.append(state)
    return out if d == "f" else out[::-1]


def plain_score(net, text, shift):
    words = re.findall(r"[^\W\d_]+", lowered(text))
    best, start = -math.inf, 0
    while True:
        window = words[start : start + 32]
        inputs = [plain_input(net, w) for w in window] + [np.zeros(toxicity_gru._INPUT)] * (32 - len(window))
        states = [np.concatenate(both) for both in zip(plain_states(net, inputs, "f"), plain_states(net, inputs, "r"))]
        states = states[: max(len(window), 1)]
        heat = np.exp([s @ net.p["a"] for s in states])
        pooled = sum(a * s for a, s in zip(heat / heat.sum(), states))
        best = max(best, float(pooled @ net.p["w"] + net.p["b"][0]))
        if start + 32 >= len(words):
            return sigmoid(best - shift)
        start += 24


def test_scores_of_toxicity_equal_plain_ones():
    rng = random.Random(4)
    texts = [t for t in TEXTS if "日" not in t] + [made_text(rng, k) for k in (1, 31, 32, 33, 56, 57, 200)]
    net, shift = toxicity_gru.fit(texts, np.arange(len(texts)) % 2, steps=30, batch=8)
    got = net.score(texts, shift)
    assert got.std() > 0.05  # the network has learned something
    for score, text in zip(got, texts):
        assert score == pytest.approx(plain_score(net, text, shift), abs=1e-4), text


def test_the_sample_of_languages_is_bounded_whatever_the_values(spark, monkeypatch):
    rows = [(i, "wort und haus" if i % 2 else "word and house", ("de", "en")[1 - i % 2]) for i in range(200)]
    rows += [(1000 + i, f"junk{i}", f"value {i}") for i in range(300)]
    asked = []

    def fit(texts, languages):
        asked.append(languages)

    monkeypatch.setattr(langid_crf, "fit", fit)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid_crf, "MOST_LANGUAGES", 10)
    monkeypatch.setattr(langid_crf, "MOST_DOCUMENTS", 100)
    langid_crf.learn(docs)
    kept = sorted(set(asked[0]))
    assert len(kept) == 10 and {"de", "en"} <= set(kept) and len(asked[0]) <= 100
    assert asked[0].count("de") == asked[0].count("en") == 10
