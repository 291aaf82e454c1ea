"""Removal of repeated passages with super-k-mers.

A window is ``WINDOW`` consecutive words, its minimiser the smallest hash of the ``MINIMISER`` consecutive words in it.
Windows that follow each other with the same minimiser make a super-k-mer, which travels as one packed string of its
words. Equal windows have equal minimisers, so only super-k-mers whose minimiser stands in several documents travel at
all, each to the bucket of its minimiser. In a bucket the windows are sorted exactly, by doubling: ranks of single words
give ranks of pairs, these of fours, up to the whole window. A window that also starts in a document with a smaller id
is repeated, and the words that it covers are removed.

A minimiser with more than ``MOST`` super-k-mers is split: its windows go out one by one under their SHA-256, and only
the smallest id of each task and window is shuffled to find the first document.

Nulls: a null text has no words; a document without an id counts as later than all others, and two such do not remove
from each other, nor do rows that share an id. Repeated rows give repeated result rows. An empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shopgauge.llm import textarrays as ta
from shopgauge.llm.tables import SPACE_RUN, in_blocks, word_count
from shopgauge.session import materialize

#: Fixed value of the contract: words of a window. Then words of a minimiser, and super-k-mers of an unsplit one.
WINDOW, MINIMISER, MOST = 50, 8, 4000
_LAST = (1 << 63) - 1
_BLOCK_CHARS, _BLOCK_BYTES = 1_000_000, 6_000_000
_SPACES = bytes(range(9, 14))
_TO_SPACE = bytes(32 if b in _SPACES else b for b in range(256))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    least, have = values, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def super_kmers(texts: list[str], window: int = WINDOW, minimiser: int = MINIMISER):
    """Text, first word, number of windows and minimiser of every super-k-mer of the texts."""
    points, offsets = ta.code_points(texts)
    starts, ends = ta.runs(~ta.is_space(points))
    none = np.zeros(0, np.int64)
    if len(starts) < window:
        return none, none, none, none
    owner = np.searchsorted(offsets, starts, side="right") - 1
    hashes = ta.span_hashes(points, starts, ends)
    at = np.arange(len(hashes) - minimiser + 1)
    least = _sliding_least(ta.span_hashes(hashes, at, at + minimiser), window - minimiser + 1)
    place = np.flatnonzero(owner[: len(least)] == owner[window - 1 :])  # windows within one text
    if not len(place):
        return none, none, none, none
    least, own = least[place], owner[place]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (own[1:] != own[:-1])])
    edge = np.flatnonzero(new)
    first = np.searchsorted(owner, np.arange(len(texts)))
    return own[edge], place[edge] - first[own[edge]], np.diff(np.append(edge, len(place))), least[edge].view(np.int64)


def _emit_kmers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = zip(batch["id"], batch["text_hash"], batch["text"])
        for block in in_blocks(rows, lambda r: len(r[2]) + 1, _BLOCK_CHARS):
            own, first, windows, least = super_kmers([r[2] for r in block])
            ids, prints = (np.array([r[i] for r in block], np.int64) for i in (0, 1))
            yield pd.DataFrame(
                {"id": ids[own], "text_hash": prints[own], "least": least, "first": first.astype(np.int32), "windows": windows.astype(np.int32)}
            )


def _packed(words: list[bytes], first: int, windows: int) -> bytes:
    return b" ".join(words[first : first + windows + WINDOW - 1])


def _words(text: str) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_TO_SPACE).split(b" ") if w]


def _emit_packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The packed strings of the shared super-k-mers of each document."""
    for batch in batches:
        docs = zip(batch["id"], batch["text_hash"], batch["text"], batch["shared"])
        for block in in_blocks(docs, lambda r: len(r[2]) + 1, _BLOCK_CHARS):
            rows = []
            for id_, print_, text, shared in block:
                words = _words(text)
                rows += [(id_, print_, s["least"], s["first"], s["split"], _packed(words, s["first"], s["windows"])) for s in shared]
            yield pd.DataFrame(rows, columns=["id", "text_hash", "least", "first", "split", "packed"])


def _window_ranks(word: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers for equal windows, by sorting pairs of the ranks of their halves; one for every start."""
    ranks, have = word, 1
    while have < window:
        step = min(have, window - have)
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1].ravel()
        have += step
    return ranks


def repeated_spans(ids: np.ndarray, packed: list[bytes], window: int = WINDOW):
    """For super-k-mers of whole buckets: which one, first and past-the-last word (in it) of its repeated passages."""
    number: dict[bytes, int] = {}
    split = [p.split(b" ") for p in packed]
    word = np.array([number.setdefault(w, len(number)) for words in split for w in words], np.int64)
    sizes = np.array([len(w) for w in split], np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ranks = _window_ranks(word, window)
    place = np.flatnonzero(row[: len(ranks)] == row[window - 1 :])
    ranks, row = ranks[place], row[place]
    earliest = np.full(int(ranks.max()) + 1, _LAST)
    np.minimum.at(earliest, ranks, ids[row])
    again = np.flatnonzero(ids[row] > earliest[ranks])
    if not len(again):
        none = np.zeros(0, np.int64)
        return none, none, none
    where, who = place[again], row[again]
    # Passages that touch or overlap are one: the next window starts at the next word at most.
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(where) > 1) | (np.diff(who) != 0)]))
    last = np.append(edge[1:], len(again)) - 1
    begin = np.cumsum(sizes) - sizes
    return who[edge], where[edge] - begin[who[edge]], where[last] - begin[who[edge]] + window


def _count_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by minimiser; whole minimisers are counted together, some million words at a time."""
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        who, begin, end = repeated_spans(rows["id"].to_numpy(), rows["packed"].tolist())
        first = rows["first"].to_numpy(np.int64)[who]
        return pd.DataFrame({"id": rows["id"].to_numpy()[who], "text_hash": rows["text_hash"].to_numpy()[who],
                             "begin": first + begin, "end": first + end})

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(batch["packed"].str.len().sum())
        if size > _BLOCK_BYTES:
            rows = pd.concat(held, ignore_index=True)
            changes = np.flatnonzero(np.diff(rows["least"].to_numpy())) + 1
            last = int(changes[-1]) if len(changes) else 0  # the last minimiser may go on in the next batch
            if last:
                yield count(rows.iloc[:last])
            held = [rows.iloc[last:]]
            size = int(held[0]["packed"].str.len().sum())
    if held:
        yield count(pd.concat(held, ignore_index=True))


def _emit_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Single windows of super-k-mers, named by their SHA-256."""
    for batch in batches:
        rows = zip(batch["id"], batch["text_hash"], batch["first"], batch["packed"])
        for block in in_blocks(rows, lambda r: len(r[3]), _BLOCK_BYTES // 4):
            out = []
            for id_, print_, first, packed in block:
                words = packed.split(b" ")
                out += [
                    (id_, print_, first + i, hashlib.sha256(b" ".join(words[i : i + WINDOW])).digest())
                    for i in range(len(words) - WINDOW + 1)
                ]
            yield pd.DataFrame(out, columns=["id", "text_hash", "begin", "window"])


def _keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words, removed words and the hash of the words that stay, of every affected document."""
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"]):
            words = _words(text)
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans if spans is not None else ():
                gone[s["begin"]] += 1
                gone[s["end"]] -= 1
            stays = np.cumsum(gone[:-1]) == 0
            kept = b" ".join([w for w, s in zip(words, stays.tolist()) if s])
            out.append((len(words), len(words) - int(stays.sum()), hashlib.sha256(kept).hexdigest()))
        made = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])
        made.insert(0, "id", batch["id"].to_numpy())
        made.insert(1, "named", batch["named"].to_numpy())
        yield made


def removed_windows(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words that stay, joined by one space), one row per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    key = ["id", "text_hash"]
    kmers = materialize(
        rows.select(*key, "text").mapInPandas(_emit_kmers, "id long, text_hash long, least long, first int, windows int"), "super-kmers"
    )
    held = kmers.groupBy("least").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    common = held.where("low < high").select("least", (F.col("n") > most).alias("split"))
    shared = kmers.join(common, "least").groupBy(*key).agg(F.collect_set(F.struct("least", "first", "windows", "split")).alias("shared"))

    # Only documents that share a minimiser carry their text on.
    affected = F.col("shared").isNotNull()
    trimmed = F.regexp_replace(F.regexp_replace("text", SPACE_RUN, " "), "^ | $", "")
    found = materialize(
        rows.join(shared, key, "left").select(
            "doc_id", *key, "shared", F.when(affected, F.col("text")).alias("text"),
            F.when(~affected, word_count(F.col("text"))).alias("n_words"),
            F.when(~affected, F.sha2(trimmed.cast("binary"), 256)).alias("kept_sha256"),
        ),
        "superkmer-documents",
    )
    carriers = found.where(affected)
    packed = materialize(
        carriers.select(*key, "text", "shared").mapInPandas(
            _emit_packed, "id long, text_hash long, least long, first int, split boolean, packed binary"
        ),
        "packed",
    )
    span = "id long, text_hash long, begin long, end long"
    buckets = packed.where("not split").drop("split").repartition("least").sortWithinPartitions("least")
    spans = buckets.mapInPandas(_count_buckets, span)
    single = packed.where("split").mapInPandas(_emit_windows, "id long, text_hash long, begin long, window binary")
    earliest = single.groupBy("window").agg(F.min("id").alias("earliest"))
    again = single.join(earliest, "window").where("id > earliest").select(*key, "begin", (F.col("begin") + WINDOW).alias("end"))
    gone = spans.union(again).groupBy(*key).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    # A column with nulls would pass through doubles, so a null id travels as its order and a flag.
    named = F.col("doc_id").isNotNull().alias("named")
    mended = carriers.join(gone, key, "left").select("id", named, "text", "spans").mapInPandas(
        _keep, "id long, named boolean, n_words long, n_removed long, kept_sha256 string"
    ).select(F.when(F.col("named"), F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    whole = found.where(~affected).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return whole.union(mended)
