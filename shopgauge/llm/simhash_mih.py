"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the distance agree, up to a small radius, in at least one
segment, so each fingerprint looks up the small Hamming ball around each of its segments in a table of all segments,
and the complete distance is verified inside that join. Equal fingerprints are one row throughout, so a group of
copies costs as much as one document. Links are then contracted into components by large-star and small-star rounds
over written tables.

Nulls: a null text is an empty one; it and a text of spaces only have fingerprint zero, which links like any other.
A null doc_id takes part in linking, never names a component unless it is alone (then null). Repeated rows give
repeated result rows. An empty table gives an empty result. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from shopgauge.llm.tables import SPACES, beside_text, broadcast_if_small
from shopgauge.session import materialize

#: Fixed values of the contract: shingle length, hash seed, greatest distance.
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Segments as (bits, radius). If every segment differed by more than its radius, the distance would be at least
#: (1+1) + (1+1) + (0+1) = 5, so no pair within 4 is lost. For corpora beyond some 2**28 distinct fingerprints
#: ((32, 2), (32, 1)) probes more and meets fewer: (2+1) + (1+1) = 5 as well.
SEGMENTS = ((22, 1), (21, 1), (21, 0))
_BLOCK_CHARS = 1 << 22
_COLUMN = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TO_SPACE = bytes(32 if chr(b) in SPACES else b for b in range(256))
_TABLE = bytes(_TO_SPACE[_LOWER[b]] for b in range(256))


def fingerprint(text: str) -> int:
    """SimHash of the whole text, from the hashes of all its shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    count = len(words) - SHINGLE + 1
    spans = zip(starts[:count].tolist(), ends[SHINGLE - 1 :].tolist())
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in spans], np.uint64, count)
    # How often each value of each of the eight bytes occurs, then how often each bit is set.
    octets = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits((2 * (octets @ _BITS) > count).ravel(), bitorder="little").view(np.uint64)[0])


def _prints_of(texts: list[str]) -> list[np.ndarray]:
    return [np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of its text as a long (its bits), one row per document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return beside_text(narrow, ["doc_id"], {"bits": pa.int64()}, _prints_of, _BLOCK_CHARS)


def _balls(segments: Sequence[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(shift, mask, flips) of every segment; flips are all patterns of up to radius bits."""
    out, shift = [], 0
    for width, radius in segments:
        flips = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
        out.append((shift, (1 << width) - 1, flips))
        shift += width
    return out


def links(prints: DataFrame, distance: int = DISTANCE, segments: Sequence[tuple[int, int]] = SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct ``bits`` at most ``distance`` apart; every such pair, each once."""
    if sum(w for w, _ in segments) != 64 or sum(r + 1 for _, r in segments) <= distance:
        raise ValueError("the segments must cover 64 bits, and their radii the distance")
    parts = _balls(segments)
    entry = [
        F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned("bits", s).bitwiseAND(F.lit(m)).alias("key"))
        for i, (s, m, _) in enumerate(parts)
    ]
    probe = [
        F.struct(
            F.lit(i).alias("segment"), F.shiftrightunsigned("bits", s).bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(f)).alias("key")
        )
        for i, (s, m, flips) in enumerate(parts)
        for f in flips
    ]
    entries = prints.select(F.col("bits").alias("a"), F.inline(F.array(*entry)))
    probes = prints.select(F.col("bits").alias("b"), F.inline(F.array(*probe)))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # Spark sizes either side by that of ``prints``, as if each fingerprint were one row, and would send tens of millions of
    # probes through the driver. A sorted join spills, and splits a key that many fingerprints share.
    met = entries.join(probes.hint("merge"), ["segment", "key"]).where((F.col("a") < F.col("b")) & (apart <= distance))
    return met.select("a", "b").distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the pairs; root is the smallest node reachable.

    Alternates large-star and small-star; the nodes' links move towards the smallest one. Each round is written,
    so a lost executor costs one round at most, and the driver only sees one count a round.
    """
    edges = materialize(
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above a node go to its smallest neighbour.
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and those below it go to the smallest of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        step = materialize(small, "star")
        same = step.exceptAll(edges).isEmpty() and edges.exceptAll(step).isEmpty()
        edges = step
        if same:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rooted(prints: DataFrame, distance: int, segments: Sequence[tuple[int, int]]) -> DataFrame:
    """bits and root of every distinct fingerprint, written once."""
    distinct = materialize(prints.select("bits").distinct(), "distinct-fingerprints")
    reach = components(links(distinct, distance, segments))
    return materialize(
        distinct.join(reach, distinct["bits"] == reach["node"], "left").select("bits", F.coalesce("root", "bits").alias("root")), "fingerprint-roots"
    )


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, segments: Sequence[tuple[int, int]] = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row per document."""
    prints = materialize(fingerprints(docs), "fingerprints")
    rooted = _rooted(prints, distance, segments)
    least = prints.groupBy("bits").agg(F.min("doc_id").alias("least_id"))
    named = rooted.join(least, "bits").groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = rooted.join(named, "root").select("bits", "component_id")
    return prints.join(by_print, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, distance: int = DISTANCE, segments: Sequence[tuple[int, int]] = SEGMENTS) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest doc_id, null last, of equal ids that
    with the smallest hash of its text; of rows equal in both, one."""
    key = F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    prints = materialize(beside_text(rows, ["doc_id", "text_hash"], {"bits": pa.int64()}, _prints_of, _BLOCK_CHARS), "fingerprints")
    members = prints.join(_rooted(prints, distance, segments), "bits")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    groups = members.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = broadcast_if_small(materialize(groups, "simhash-components"))
    several = materialize(
        members.join(groups, "root").groupBy("doc_id", "text_hash", (place == F.col("first")).alias("stays")).agg(F.count(F.lit(1)).alias("rows")),
        "simhash-groups",
    )
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash"))

    def keys(of: DataFrame) -> DataFrame:
        return broadcast_if_small(materialize(of.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash")), "simhash-keys"))

    # Documents alone in their component, nearly all, pass these joins where they are.
    repeated = several.where("stays and rows > 1")
    once = rows.join(keys(several.where("not stays or rows > 1")), same, "left_anti").select("row.*")
    if repeated.isEmpty():
        return once
    again = rows.join(keys(repeated), same, "left_semi").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
    return once.union(again.select("row.*"))
