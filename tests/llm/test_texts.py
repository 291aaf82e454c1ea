"""Classifiers, archives, mixing and encoding: held-out accuracy, round trips, plain code, and the odd cases."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from shopgauge.llm import bpe_rounds, langid_crf, quality_bt, samples, source_mix, textarrays, toxicity_gru, warc_revisits
from shopgauge.llm.tables import table, word_count

SF_DIR = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n\t", "x", "12 3", "é" * 3, "The THE the. " * 4000, "日本語 テスト", "\x00\x1c a b"]


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF_DIR, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF_DIR, "labels")


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en", None, "clash", 0.5) for i, t in enumerate(ODD)] + [(0, "", "en", None, "clash", 0.5), (None, "x", None, "s", "clash", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, held_out string, score double")


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def held_out_accuracy(scored, labels, column):
    truth = {r.doc_id: r[column] for r in labels.select("doc_id", column).collect()}
    rows = [r for r in scored.collect() if r.held_out and r.doc_id in truth]
    assert all(remainder(r.doc_id, 3) == 1 for r in rows)
    return sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows), len(rows)


def test_quality_of_held_out_documents(documents, labels):
    scored = quality_bt.scored(documents, labels).cache()
    accuracy, rows = held_out_accuracy(scored, labels, "quality")
    assert rows > 50 and accuracy > 0.97
    assert scored.count() == documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.collect())


def test_toxicity_of_held_out_documents(documents, labels):
    scored = toxicity_gru.scored(documents, labels).cache()
    accuracy, rows = held_out_accuracy(scored, labels, "toxic")
    assert rows > 50 and accuracy > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored.collect())


@pytest.mark.parametrize("per_class", [200, 5000])
def test_toxicity_cut_does_not_follow_the_size_of_the_sample(spark, per_class):
    """One word tells toxic documents, another is in few of them and in more clean ones: only an even sample rejects it."""
    rng = random.Random(5)
    rows = []
    for i in range(3600):
        toxic = int(i % 10 == 0)
        chance = rng.random()
        vile, harsh = (chance < 0.7, chance >= 0.7) if toxic else (chance < 0.01, chance > 0.85)
        rows.append((i, "vile day" if vile else "harsh day" if harsh else "good day", toxic))
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sizes = samples.class_sizes(made, "toxic", 3, 1)
    assert 200 < sizes[1] < sizes[0] < 5000
    got = {r.doc_id: r.predicted for r in toxicity_gru.scored(made.select("doc_id", "text"), made.select("doc_id", "toxic"), per_class).collect()}
    recall = sum(got[i] for i, _, y in rows if y) / sum(y for _, _, y in rows)
    rejected = sum(got[i] for i, _, y in rows if not y) / sum(1 - y for _, _, y in rows)
    assert recall > 0.6 and rejected < 0.05


def test_networks_trained_by_tasks_do_not_depend_on_how_rows_are_laid_out(spark):
    """As where a task is repeated: the tasks give what a plain call gives, whatever files the sample is read from."""
    rows = [(i, f"{'vile' if i % 3 == 0 else 'good'} day {i % 7}", int(i % 3 == 0)) for i in range(120)] + [(1, "good night", 0)] * 2
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learnt = [toxicity_gru.learn(made.repartition(parts), made.select("doc_id", "toxic")) for parts in (1, 7)]
    usable = sorted((i, text, y) for i, text, y in rows if remainder(i, 3) != 1)
    plain = toxicity_gru.fit([text for _, text, _ in usable], np.array([y for _, _, y in usable]))
    texts = ["vile day", "good night and day", ""]
    for network, shift in learnt:
        assert shift == pytest.approx(plain[1], abs=1e-3)
        assert np.allclose(network.score(texts, shift), plain[0].score(texts, plain[1]), atol=1e-4)


@pytest.mark.parametrize("operator", [quality_bt, toxicity_gru])
def test_classifiers_take_odd_rows_and_missing_labels(spark, odd, operator):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = operator.scored(odd, none).collect()
    assert len(rows) == len(ODD) + 2 and {r.score for r in rows} == {0.5 if operator is quality_bt else 0.0}
    some = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(len(ODD))] + [(1, None, None, "x"), (None, 1, 1, "x")],
                                 "doc_id long, quality int, toxic int, text string")
    rows = operator.scored(odd, some).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert {r.doc_id for r in rows if r.held_out} == {i for i in range(len(ODD)) if remainder(i, 3) == 1}
    assert operator.scored(odd.limit(0), some).collect() == []


def test_quality_is_learned_from_every_learnable_document(spark, monkeypatch):
    monkeypatch.setattr(quality_bt, "BUCKET", 300)
    # Beyond any bound of the sample that was: 60 bad documents, which few buckets would hold, and 5,000 good ones.
    rows = [(i, int(i % 80 != 0), ("?!#% " if i % 80 == 0 else "plain words ") * (5 + i % 7)) for i in range(7500)]
    made = spark.createDataFrame(rows, "doc_id long, quality int, text string")
    ids = samples.labelled_ids(made, "quality", 3, 1)
    vectors = quality_bt._labelled_vectors(made, ids)
    wanted = {y: sum(r[1] == y and remainder(r[0], 3) != 1 for r in rows) for y in (0, 1)}
    sizes, centre, _ = quality_bt._moments(vectors)
    assert sizes == wanted and wanted[1] > 4000
    blocks = quality_bt._buckets(vectors, sizes).collect()
    assert sum(len(b.good) for b in blocks) == 4 * len(centre) * wanted[1] and all(len(b.bad) for b in blocks)
    got = quality_bt.scored(made, made).collect()
    assert sum(r.predicted == int(r.doc_id % 80 != 0) for r in got) > 0.99 * len(got)


def test_pairs_give_the_order_and_the_quantile():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    y = (x @ [2, -1, 0, 0, 0, 0] + 0.1 * rng.normal(size=400) > -1).astype(int)
    ranker = quality_bt.fit(x, y, (int((y == 0).sum()), int((y == 1).sum())))
    made = ranker.score(x)
    assert ((made >= 0.5) == y).mean() > 0.97
    assert abs((made < 0.5).sum() - (y == 0).sum()) <= 2
    assert quality_bt.fit(x, np.ones(400), (0, 400)) is None


def test_windows_of_the_network_hold_every_word_and_overlap():
    block = toxicity_gru.Block(["", "one", " ".join("w" * (i % 5 + 1) + chr(97 + i % 26) for i in range(100))])
    assert block.document.tolist() == [0, 1, 2, 2, 2, 2]
    assert block.mask.sum(axis=1).tolist() == [1, 1, 32, 32, 32, 28]
    assert toxicity_gru.WINDOW > toxicity_gru.STEP


def test_training_gradients_of_the_network_are_right():
    """Each dense gradient against the difference of the losses on either side."""
    texts, y = ["bad thing here", "good day to you all", "bad", "nice words"], np.array([1, 0, 1, 0])
    block, chosen = toxicity_gru.Block(texts), np.arange(4)
    network = toxicity_gru.Network(1)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    got = {}
    trainer = toxicity_gru.Trainer(network)
    trainer._dense, trainer._tables = got.update, lambda block, d_x: None
    trainer.step(block, chosen, y)
    for name, value in network.p.items():
        at = (0,) * value.ndim
        losses = []
        for by in (1e-3, -1e-3):
            value[at] += by
            losses.append(trainer.step(block, chosen, y))
            value[at] -= by
        trainer._dense = lambda g: None
        assert got[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.05, abs=2e-4), name
        trainer._dense = got.update
        trainer.step(block, chosen, y)


def test_training_takes_every_window_of_a_document(monkeypatch):
    taken = []
    step = toxicity_gru.Trainer.step
    monkeypatch.setattr(toxicity_gru.Trainer, "step", lambda self, block, chosen, y: taken.append((len(block.word), len(chosen))) or step(self, block, chosen, y))
    toxicity_gru.fit(["good day " * 2400, "bad day"], np.array([0, 1]), steps=2)
    assert taken and all(windows > 150 and chosen == windows for windows, chosen in taken)


def test_slices_of_windows_give_the_same_gradients(monkeypatch):
    texts, y = ["bad thing here " * 60, "good day to you all " * 30, "bad"], np.array([1, 0, 1])
    block, got = toxicity_gru.Block(texts), []
    for windows in (4096, 3):
        monkeypatch.setattr(toxicity_gru, "_SLICE", windows)
        trainer, made = toxicity_gru.Trainer(toxicity_gru.Network(1)), {}
        trainer._dense, trainer._tables = made.update, lambda block, d_x, made=made: made.update(x=d_x)
        made["loss"] = trainer.step(block, np.arange(len(block.document)), y)
        got.append(made)
    assert got[0].keys() == got[1].keys()
    for name in got[0]:
        assert np.allclose(got[0][name], got[1][name], rtol=1e-3, atol=1e-6), name


def test_languages_of_held_out_documents(documents):
    rows = {r.doc_id: r for r in langid_crf.predicted(documents).collect()}
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    out = [i for i in truth if remainder(i, 4) == 2]
    assert {i for i, r in rows.items() if r.held_out} == set(out)
    assert sum(rows[i].lang_pred == truth[i] for i in out) / len(out) > 0.96
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_words_of_code_switched_text(spark, documents):
    field = langid_crf.learn(documents)
    text = {r.lang: r.text for r in documents.where("length(text) > 400").select("lang", "text").collect()}
    mixed = text["en"][:200].rsplit(" ", 1)[0] + " " + text["de"][:200].rsplit(" ", 1)[0]
    (row,) = langid_crf.word_spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), field).collect()
    share = {"en": 0, "de": 0}
    for s in row.spans:
        middle = (s.start + s.end) / 2
        share["en" if middle < len(mixed) / 2 else "de"] += (s.end - s.start) * (s.lang == ("en" if middle < len(mixed) / 2 else "de"))
    assert sum(share.values()) > 0.8 * len(mixed.replace(" ", ""))
    assert all(a.end <= b.start for a, b in zip(row.spans, row.spans[1:]))


def test_forward_backward_equals_the_sum_over_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    field = langid_crf.Field(["a", "b", "c"], np.zeros((1, 3)), np.zeros(0, np.uint64), np.zeros((0, 3)), np.zeros(3), rng.normal(size=3), rng.normal(size=(3, 3)))
    scores = rng.normal(size=(7, 3))
    starts, lengths = np.array([0, 4, 6]), np.array([4, 2, 1])
    made, begun, crossing = field.marginals(scores, starts, lengths)
    want, moves = np.zeros((7, 3)), np.zeros((3, 3))
    for s, n in zip(starts, lengths):
        paths = list(product(range(3), repeat=int(n)))
        mass = np.exp([field.start[p[0]] + sum(scores[s + t, y] for t, y in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        for p, m in zip(paths, mass / mass.sum()):
            for t, y in enumerate(p):
                want[s + t, y] += m
            for a, b in zip(p, p[1:]):
                moves[a, b] += m
    assert np.allclose(made, want) and np.allclose(crossing, moves) and np.allclose(begun, want[starts].sum(axis=0))


def test_languages_of_odd_rows(spark, odd, documents):
    rows = langid_crf.predicted(odd, langid_crf.learn(documents, 20)).collect()
    assert len(rows) == len(ODD) + 2
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 4)} == {"und"}
    nothing = langid_crf.predicted(odd.withColumn("lang", odd.source.cast("string")).where("doc_id is not null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}
    assert langid_crf.predicted(odd.limit(0)).collect() == []


PAGES = [
    (1, "u", "a"), (2, "u", "a"), (2, "u2", "a"), (None, "x\r\ny", "a"), (None, None, None), (7, "z", "WARC/1.1\r\n\r\n\r\n"),
    (8, "z", "é" * 300_000), (9, "z", "é" * 300_000), (3, "q", ""), (1, "u", "a"), (11, "w", "é"),
]


def archives_by_hand(rows, least=0):
    ids = {}
    for i, _, html in rows:
        ids.setdefault(html or "", []).append(-1 if i is None else i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        largest = max(ids[html or ""])
        revisit = len(data) >= least and (-1 if i is None else i) != largest
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", largest if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 2])
def test_archives_read_back_equal_those_by_hand(spark, least):
    pages = spark.createDataFrame([(*r, "clash") for r in PAGES], "page_id long, url string, html string, payload_digest string")
    got = warc_revisits.deduplicated_archive(pages, least).collect()
    assert sorted((tuple(r) for r in got), key=repr) == archives_by_hand(PAGES, least)
    assert warc_revisits.deduplicated_archive(pages.limit(0)).collect() == []


def test_an_archive_holds_each_payload_once_and_revisits_name_it(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>same</p>") for i in range(5)], "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc_revisits.write_archives(pages, warc_revisits.resolve(warc_revisits.headers(pages)), path)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").rglob("*.gz"))
    assert whole.count(b"<p>same</p>") == 1 and whole.count(b"WARC-Type: revisit") == 4
    records = [r for p in (tmp_path / "warc").rglob("*.gz") for r in warc_revisits.records_of(p.read_bytes())]
    (original,) = [f for f, _ in records if f["WARC-Type"] == "response"]
    assert {f["WARC-Refers-To"] for f, _ in records if f["WARC-Type"] == "revisit"} == {original["WARC-Record-ID"]}
    assert {f["WARC-Refers-To-Target-URI"] for f, _ in records if f["WARC-Type"] == "revisit"} == {"http://h/4"}
    with pytest.raises(ValueError):
        list(warc_revisits.records_of(gzip.compress(whole[:-40])))


def mixed_by_hand(rows):
    """Targets by repeated resharing of the excess, and each source's documents in the order of their hashes."""
    size = {}
    for i, s, n in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        level = left / max(1, sum(weight[s] for s in free))
        over = {s for s in free if 2 * size[s] <= weight[s] * level}
        if not over:
            break
        capped |= over
    return {s: 2.0 * size[s] if s in capped else weight[s] * level for s in order}, size


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "a", "a", "b", "c", "é", None])
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 40))) if rng.random() > 0.02 else None, source, "clash"))
    rows += [rows[3], rows[3], (None, "x y", "a", "clash"), (None, None, "b", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = source_mix.mix(docs).collect()
    assert len(got) == len(rows)
    target, size = mixed_by_hand([(i, s, len((t or "").split())) for i, t, s, _ in rows])
    taken, largest = {}, 0
    by_id = {i: s for i, _, s, _ in rows}
    for r in got:
        s = by_id[r.doc_id] if r.doc_id is not None else ("a" if r.size else "b")
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
        largest = max(largest, r.size)
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    again = source_mix.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert source_mix.mix(docs.limit(0)).collect() == []
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_thresholds_are_nested(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "a") for i in range(300)], "doc_id long, text string, source string")
    sizes = source_mix.measured(docs)
    ends = []
    for rest in (50, 200, 700):
        wanted = spark.createDataFrame([("a", float(rest))], "source string, rest double")
        ends.append(source_mix.thresholds(sizes, wanted).head()["threshold"])
        assert abs(sizes.where(f"h <= {ends[-1]}").selectExpr("sum(size)").head()[0] - rest) <= 7
    assert ends == sorted(ends)


def test_word_count_is_that_of_the_pattern(spark):
    import re

    texts = [*ODD, "a\x0bb\x0cc d", "...", " . . "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in rows.select(word_count(rows.text)).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def encoded_by_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


def test_encoding_equals_the_library_on_any_text(library):
    rng = random.Random(4)
    special = ["<|startoftext|> hi<|endoftext|>there", "<|ENDOFTEXT|>", "it's I'LL 's", "aaaaaaaaaaaaaaaa abababab", "ΑΣ Σ ΣΑΣ", "İ ẞ ß ŉ ǅ"]
    texts = [t for t in ODD if t is not None] + special
    for _ in range(1500):
        kinds = [(0x20, 0x7F), (0, 0x300), (0, 0xD800), (0xE000, 0x1FBFF), (0x1C80, 0x1C8B), (0xA7C0, 0xA7DD)]
        texts.append("".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randint(1, 40))))
    encoder = bpe_rounds.Encoder(bpe_rounds.Vocabulary(VOCABULARY))
    got = encoder.encode_batch(texts)
    assert [t for t, g in zip(texts, got) if g != encoded_by_library(library, t)] == []


def test_digests_of_documents_equal_the_library(spark, documents, library, odd):
    for docs in (documents.select("doc_id", "text"), odd):
        text = [(r.doc_id, r.text or "") for r in docs.collect()]
        want = []
        for i, t in text:
            n, ids, decoded = encoded_by_library(library, t)
            want.append((i, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        got = [tuple(r) for r in bpe_rounds.digests(docs, VOCABULARY).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe_rounds.encoded(odd.limit(0), VOCABULARY).collect() == []


def test_a_full_memory_of_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_rounds, "_KNOWN_WORDS", 2)
    encoder = bpe_rounds.Encoder(bpe_rounds.Vocabulary(VOCABULARY))
    for text in ("one two three", "two four", "one five six"):
        assert encoder.encode_batch([text])[0] == encoded_by_library(library, text)


def test_spans_of_equal_words_have_equal_hashes():
    words = textarrays.letter_words(["The cat, the Cat!", "", "CAT3the"])
    assert words.owner.tolist() == [0, 0, 0, 0, 2, 2]
    form = words.form.tolist()
    assert form[0] == form[2] == form[5] and form[1] == form[3] == form[4] and form[0] != form[1]
    grams, owner = textarrays.form_ngrams(words, 2, 3)
    assert np.bincount(owner).tolist() == [7, 7] and len(set(grams.tolist())) == 14


def test_archives_of_several_members_are_read_to_their_end(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 9) for i in range(4)], "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc_revisits.write_archives(pages.coalesce(1), warc_revisits.resolve(warc_revisits.headers(pages)), path)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").rglob("*.gz"))
    single = [b"WARC/1.1" + part for part in whole.split(b"WARC/1.1")[1:]]
    assert len(single) == 4
    members = b"".join(map(gzip.compress, single))
    assert [f["WARC-Record-ID"] for f, _ in warc_revisits.records_of(members)] == [f["WARC-Record-ID"] for f, _ in warc_revisits.records_of(gzip.compress(whole))]
    with pytest.raises(ValueError):
        list(warc_revisits.records_of(members[:-20]))


def test_files_are_bounded_by_bytes(spark, tmp_path):
    sizes = [10, 300, 700, 5000, 90000, 2000000, 0]
    pages = spark.createDataFrame([(i, "u", chr(97 + i % 26) * sizes[i % 7]) for i in range(42)] + [(99, None, None)], "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    none = warc_revisits.resolve(warc_revisits.headers(pages), 1 << 40)
    warc_revisits.write_archives(pages.coalesce(1), none, path, bytes_per_file=1 << 21)
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").rglob("*.gz")]
    assert max(len(f) for f in files) < (1 << 21) + 4096 * 600
    got = {r.page_id: r.payload_bytes for r in warc_revisits.read_archives(spark, path).collect()}
    assert got == {**{i: sizes[i % 7] for i in range(42)}, 99: 0}
