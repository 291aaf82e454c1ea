"""Exact, SimHash, substring and SpotSigs operators against plain code, on the odd cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from shopgauge.llm import simhash_mih, spotsigs, stream_dedup, superkmers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, digest string, locator string"


@pytest.fixture(scope="module")
def made():
    """Ids and texts: copies, near copies, shared passages, empty, null, blank, long and repeated rows."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(400)] + ["the", "of", "und", "é", "ΑΣ"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(60)]
    passage = " ".join(rng.choices(words, k=70))
    texts += [t + "  \t" for t in texts[:10]]
    texts += [t.replace("a", "b", 1) for t in texts[10:25]]
    texts += [" ".join(rng.choices(words, k=9)) + "\n" + passage + " " + rng.choice(words) for _ in range(12)]
    texts += ["", None, " \n", "x", "X", "one two three", "one two  three", " ".join(rng.choices(words, k=20_000))]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[0]), (None, None), (7, texts[7])]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def frame(spark, made):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in made], SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[normal(t)]
        known = [x for x in ids if x is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups_equal_those_by_hand(frame, made):
    got = stream_dedup.exact_groups(frame, files_per_batch=1)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr) == exact_by_hand(made)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_one_row_of_each_text_and_all_columns(frame, made):
    kept = stream_dedup.deduplicated(frame)
    assert kept.columns == frame.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted({normal(t) for _, t in made})


def test_exact_groups_of_an_empty_table(empty):
    assert stream_dedup.exact_groups(empty).collect() == []
    assert stream_dedup.deduplicated(empty).collect() == []


def test_digests_that_collide_are_told_apart_by_their_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "a", 7), (4, "c", 8)], "doc_id long, text string, id long")
    monkeypatch.setattr(F, "sha2", lambda column, bits: F.concat(F.lit("same"), F.left(column.cast("string"), F.lit(0))))
    unequal = stream_dedup._hits(stream_dedup.located(docs), 4)[2]
    assert [r.digest for r in unequal.collect()] == ["same"]
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in stream_dedup.exact_groups(docs).collect())
    assert got == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)]
    assert sorted((r.doc_id, r.id) for r in stream_dedup.deduplicated(docs).collect()) == [(1, 5), (2, 6), (4, 8)]


def test_a_stream_goes_on_from_its_state(spark, tmp_path):
    """A second run over new arrivals counts on from what the first one stored."""
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    schema = "doc_id long, digest string, locator struct<file:long,number:long>"
    spark.createDataFrame([(5, "x", (1, 1)), (6, "y", (1, 2))], schema).write.parquet(source)
    rows = spark.read.parquet(source)
    stream_dedup.run_stream(spark, source, rows.schema, state, out)
    spark.createDataFrame([(3, "x", (2, 3))], schema).write.mode("append").parquet(source)
    stream_dedup.run_stream(spark, source, rows.schema, state, out)
    got = {r.digest: (r.keep_order, tuple(r.keep_locator), r.group_size) for r in stream_dedup.states(spark, out).collect()}
    assert got == {"x": (3, (2, 3), 2), "y": (6, (1, 2), 1)}


def test_locators_are_of_the_files_where_rows_are_rows_of_files(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"t{i % 4}") for i in range(40)], "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    assert stream_dedup._reads_files(docs.where("doc_id < 30").select("text", "doc_id"))
    for other in (docs.union(docs), docs.select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2)))), docs.limit(3), docs.distinct(), docs.withColumn("_metadata", F.lit(1))):
        assert not stream_dedup._reads_files(other)
    twice = docs.select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("number"))
    assert sorted(r.doc_id for r in stream_dedup.deduplicated(twice).collect()) == [0, 1, 2, 3]
    assert sum(r.kept for r in stream_dedup.exact_groups(docs.union(docs)).collect()) == 4


@pytest.mark.parametrize("most", [0, 200_000])
def test_documents_without_copies_are_not_shuffled(spark, tmp_path, monkeypatch, most):
    from builders import plan_of

    from shopgauge.llm import tables

    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"t{min(i, 30)}") for i in range(40)], "doc_id long, text string").write.parquet(path)
    monkeypatch.setattr(tables, "BROADCAST_ROWS", most)
    kept = stream_dedup.deduplicated(spark.read.parquet(path))
    if most:
        assert "hashpartitioning" not in plan_of(kept, "simple")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(31))


CLASHING = ["id", "h", "hash", "of", "copies", "_copy", "_h", "_digest", "digest", "text_sha256", "locator", "row", "file", "number", "bits", "root", "stays", "rows"]


def test_columns_of_clashing_names_stay_as_they_are(spark):
    from shopgauge.llm import source_mix

    rows = [(1, "a b c", "s"), (2, "a  b c", "s"), (3, "d", None), (None, "e", "s")]
    docs = spark.createDataFrame([(*r, *[i] * len(CLASHING)) for i, r in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in CLASHING))
    for result, want in ((stream_dedup.deduplicated(docs), {0, 2, 3}), (simhash_mih.one_per_group(docs), {0, 2, 3}), (source_mix.mixed_documents(docs), None)):
        assert result.columns == docs.columns
        got = [tuple(r) for r in result.collect()]
        assert all(row[3:] == (row[3],) * len(CLASHING) for row in got)
        assert want is None or sorted(row[3] for row in got) == sorted(want)


def fingerprint_by_hand(text):
    import xxhash

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(rows, distance):
    prints = [fingerprint_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = least.setdefault(find(i), [])
        ids += [doc_id] if doc_id is not None else []
    return sorted(((i, f"{p:016x}", min(least[find(k)], default=None)) for k, ((i, _), p) in enumerate(zip(rows, prints))), key=repr)


@pytest.mark.parametrize("segments", [simhash_mih.SEGMENTS, ((32, 2), (32, 1))])
def test_simhash_components_equal_those_by_hand(frame, made, segments):
    got = collected(simhash_mih.near_duplicates(frame, segments=segments))
    assert got == components_by_hand(made, 4)


def test_links_lose_no_pair(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        flipped = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            flipped ^= 1 << bit
        prints.append(flipped)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = {(r.a, r.b) for r in simhash_mih.links(spark.createDataFrame([(p,) for p in signed], "bits long")).collect()}
    assert got == want and len(want) > 50
    with pytest.raises(ValueError):
        simhash_mih.links(spark.createDataFrame([], "bits long"), 5)


def test_probes_are_never_broadcast(spark, tmp_path):
    """Spark takes the probes for as many rows as there are fingerprints."""
    spark.range(50).select(F.xxhash64("id").alias("bits")).write.parquet(str(tmp_path / "prints"))
    met = simhash_mih.links(spark.read.parquet(str(tmp_path / "prints")))
    assert met.collect() == []
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_the_stage_of_the_pipeline_broadcasts_no_probes(frame, monkeypatch):
    plans, materialize = {}, simhash_mih.materialize

    def seen(df, label):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label)

    monkeypatch.setattr(simhash_mih, "materialize", seen)
    assert simhash_mih.one_per_group(frame).count() > 0
    assert "SortMergeJoin" in plans["links"] and "Broadcast" not in plans["links"]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash_mih.components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_one_document_of_each_component_stays(frame, made):
    kept = simhash_mih.one_per_group(frame).collect()
    want = {c for i, _, c in components_by_hand(made, 4) if c is not None}
    named = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(named) == sorted(want)


def test_rows_without_ids_and_repeated_ids_are_members_like_others(spark):
    far = ["one two three four five six", "Seven eight nine ten eleven twelve", "red green blue black white grey brown", "north south east west up down"]
    rows = [(1, far[0]), (None, far[0]), (2, far[0]), (2, far[1]), (2, far[1]), (None, far[2]), (None, far[2]), (None, far[2].upper()), (None, far[3])]
    kept = simhash_mih.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == sorted([("1", far[0]), ("2", far[1].lower()), ("None", far[2]), ("None", far[3])])


def test_simhash_of_an_empty_table(empty):
    assert simhash_mih.near_duplicates(empty).collect() == []
    assert simhash_mih.one_per_group(empty).collect() == []


def removed_by_hand(rows, window=50):
    words = [WORD.findall(t or "") for _, t in rows]
    order = [i if i is not None else 1 << 62 for i, _ in rows]
    first = {}
    for own, ws in zip(order, words):
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            first[key] = min(first.get(key, own), own)
    out = []
    for (doc_id, _), own, ws in zip(rows, order, words):
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < own:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((doc_id, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [superkmers.MOST, 1])
def test_removed_windows_equal_those_by_hand(frame, made, most):
    want = removed_by_hand(made)
    assert sum(w[2] > 0 for w in want) > 20
    assert collected(superkmers.removed_windows(frame, most)) == want


def test_super_kmers_hold_every_window_once():
    texts = ["", "a b", " ".join(str(i % 17) for i in range(500)), " ".join(str(i) for i in range(50))]
    own, first, windows, _ = superkmers.super_kmers(texts)
    got = sorted((int(o), int(f) + k) for o, f, n in zip(own, first, windows) for k in range(n))
    assert got == [(2, i) for i in range(451)] + [(3, 0)]


def test_removed_windows_of_an_empty_table(empty):
    assert superkmers.removed_windows(empty).collect() == []


def test_edited_texts_and_likeness(frame, made):
    order = sorted((row for row in made if row[0] is not None), key=lambda r: r[0])
    rows = spotsigs.edited_likeness(frame).collect()
    assert len(rows) == len(made)
    unique = {i for i, _ in order if sum(j == i for j, _ in order) == 1}
    text = {i: t or "" for i, t in order}
    for place, (i, _) in enumerate(order):
        following = order[(place + 1) % len(order)][0]
        if i not in unique or following not in unique:
            continue
        got = next(r for r in rows if r.doc_id == i)
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[following][:half]
        assert got.n_chars == len(text[i])
        assert got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got.near_edited <= 1 and 0 <= got.near_next <= 1
        if edited == text[i]:
            assert got.near_edited == 1 and got.fingerprint == got.edited_fingerprint
    prints = {}
    for r, t in ((r, text[r.doc_id]) for r in rows if r.doc_id in unique):
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def test_likeness_does_not_depend_on_the_ranges(frame, monkeypatch):
    want = collected(spotsigs.edited_likeness(frame))
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 4)
    assert collected(spotsigs.edited_likeness(frame)) == want


def test_signatures_are_anchors_with_the_next_content_words(spark):
    from pyspark.sql import functions as F

    text = "The cat and the dog of spain sat"
    anchors = [w for w in text.lower().split() if spark.range(1).select(spotsigs.is_anchor(F.lit(w))).head()[0]]
    words = text.lower().split()
    spots = set()
    for i, w in enumerate(words):
        if w in anchors:
            chain = [x for x in words[i + 1 : i + 1 + spotsigs.REACH] if x not in anchors][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                spots.add(spark.range(1).select(F.xxhash64(F.lit(w), F.lit(chain))).head()[0])
    got = spark.range(1).select(spotsigs.signatures(F.lit(text))).head()[0]
    assert {"the", "and", "of"} <= set(anchors) and got == sorted(spots)


def test_pruning_changes_no_likeness_at_or_above_the_bound(spark):
    from pyspark.sql import functions as F

    sets = spark.createDataFrame([([1, 2, 3, 4], [2, 3, 4, 5]), ([1], [1, 2, 3, 4, 5, 6]), ([7], [7])], "a array<long>, b array<long>")
    got = [tuple(r) for r in sets.select(spotsigs.likeness(F.col("a"), F.col("b")), spotsigs.likeness(F.col("a"), F.col("b"), 0.5)).collect()]
    assert got == [(0.6, 0.6), (1 / 6, 0.0), (1.0, 1.0)]


def test_spotsigs_near_duplicates_equal_all_pairs(spark, frame, made):
    from pyspark.sql import functions as F

    pairs, members = spotsigs.near_duplicates(frame.where("doc_id is not null"), 0.5)
    sets = {}
    for r in frame.where("doc_id is not null").select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect():
        sets.setdefault(tuple(r.s), []).append(r.doc_id)
    classes = {min(ids): set(s) for s, ids in sets.items()}
    want = {(a, b) for a in classes for b in classes if a < b and len(classes[a] & classes[b]) >= 0.5 * len(classes[a] | classes[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert {(r.doc_id, r.class_id) for r in members.collect()} == {(i, min(ids)) for ids in sets.values() for i in ids}


def test_spotsigs_links_classes_without_ids_and_of_one_id(spark):
    words = "the quick brown fox of spain and a lazy dog in the garden with some other animals that were on the hill"
    rows = [(None, words), (None, words + " today"), (7, words + " tomorrow"), (7, words + " yesterday"), (8, "nothing like that")]
    pairs, members = spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.5)
    none = (None, None)
    got = sorted(((r.a, r.b) for r in pairs.collect()), key=str)
    assert got == sorted([none, (7, None), (7, None), (7, None), (7, None), (7, 7)], key=str)
    assert sorted(((r.doc_id, r.class_id) for r in members.collect()), key=str) == sorted([none, none, (7, 7), (7, 7), (8, 8)], key=str)


def test_spotsigs_of_an_empty_table(empty):
    assert spotsigs.edited_likeness(empty).collect() == []


def test_texts_without_letters_are_told_apart(spark):
    texts = ["10 20 30 40", "99 98 97 96 95", "", "--- ---", "+++", None]
    rows = spotsigs.edited_likeness(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert len(set(prints.values())) == 5 and prints[2] == prints[5]
    assert {r.doc_id: r.near_next for r in rows}[0] == 0.0


def test_equal_sets_only_at_a_likeness_of_one(spark):
    texts = ["the cat sat on the mat and saw the dog", "The cat sat on the mat, and saw the dog!", "a dog of the cat and the mat sat still"]
    pairs, members = spotsigs.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1.0)
    assert pairs.collect() == [] and sorted((r.doc_id, r.class_id) for r in members.collect()) == [(0, 0), (1, 0), (2, 2)]
