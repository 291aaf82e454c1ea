"""Personal data: strict spans against plain code, what the trees add, and odd tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from shopgauge.llm import pii_boosting, queries
from shopgauge.llm.tables import table

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
# The contract's patterns, as it states them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def strict_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def written(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


ODD = [
    "", " ", None, "a@b@c.d e@f", "a@b.c_d@e.f.g", "x..y%+-@-.-", "@a.b", "aé@b.cd ü@x.y", "1.2.3.4.5.6.7.8", "1.2.3.256", "001.002.003.0255",
    "12.3.4 1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111 4111111111111111", "4111111111111111 4111111111111111",
    "+1 (017) 555-7713", "+1(017)555.7713.", "+12345 +123456789012 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++49 30 1234567", "+1 234 567 890\t12",
    "😀 a@b.cd 😀😀 1.2.3.4 😀+1 (017) 555-7713😀", "1" * 40, "9" * 5000 + "." + "8" * 5000, "a" * 30000 + "@" + "b." * 3000 + "c",
    "a@b.c" + ".d" * 4000, " ".join(str(i * 7919) for i in range(3000)), "٤٤٤٤@x.y ４１１１１１１１１１１１１１１１", "a\nb@c.d\r1.2.3.4",
]


def test_strict_spans_equal_plain_code(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    letters = random.Random(4)
    rows += [(100 + i, "".join(letters.choice("a1.@+- (9_é2") for _ in range(60))) for i in range(300)]
    got = {r.doc_id: r for r in pii_boosting.spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc_id, text in rows:
        spans = strict_spans(text)
        row = got[doc_id]
        assert row.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest(), (doc_id, text and text[:80])
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s[3] == k for s in spans) for k in PATTERNS]
        assert set(filter(None, written(spans).split(","))) <= set(row.spans.split(","))


def test_whole_table_equals_plain_code(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.personal_data(spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id].base_sha256 == hashlib.sha256(written(strict_spans(r.text)).encode()).hexdigest()


def test_many_matches_have_their_places(spark):
    text = " ".join(f"u{i}@h{i % 13}.org" + "x" * (i % 5) for i in range(2000))
    row = pii_boosting.spans(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert row.n_email == 2000 and row.spans == written(strict_spans(text))


@pytest.fixture(scope="module")
def corpus(spark):
    """Phones and cards in several forms, beside numbers that are none."""
    draw = random.Random(6)

    def digits(n):
        return "".join(str(draw.randint(0, 9)) for _ in range(n))

    def card():
        body = digits(15)
        return body + next(str(c) for c in range(10) if luhn(body + str(c)))

    rows = []
    for i in range(1500):
        kind = i % 5
        if kind == 0:
            rows.append((i, f"please phone +1 ({digits(3)}) 555-{digits(4)} or else"))
        elif kind == 1:
            rows.append((i, f"pay by card {card()} today"))
        elif kind == 2:
            rows.append((i, f"order {digits(11)} came in box {digits(9)}"))
        elif kind == 3:
            rows.append((i, f"part number {digits(16)} is {'x' * draw.randint(1, 9)}"))
        else:
            rows.append((i, "nothing of that kind"))
    odd = [(9000, "please phone (212) 555-0100 or else"), (9001, "please phone 1 (212) 555-0199 or else"), (9002, "order 12345678901 came"),
           (9003, "pay by card 4111.1111.1111.1111 today"), (9004, None), (9005, "")]
    return spark.createDataFrame(rows + odd, SCHEMA)


def test_trees_add_what_is_like_checked_spans_and_leave_the_rest(spark, corpus):
    got = {r.doc_id: r for r in pii_boosting.spans(corpus).collect()}
    assert got[9001].spans == "phone:13:29" and got[9001].n_phone == 0
    assert got[9003].spans == "card:12:31" and got[9003].n_card == 0
    plain = [r for r in corpus.where("doc_id < 9000").collect() if r.doc_id % 5 in (2, 3, 4)]
    added = [r.doc_id for r in plain if got[r.doc_id].spans != written(strict_spans(r.text))]
    assert len(added) <= len(plain) // 50 and got[9002].spans == ""
    assert got[9004].spans == got[9005].spans == ""


def test_trees_run_alike_as_an_expression(spark, corpus):
    found = pii_boosting.candidates(corpus)
    sample, weights = pii_boosting._sample(found, 400)
    trees = pii_boosting.fitted(sample, weights)
    assert len(trees) == pii_boosting.TREES

    def plain(x):
        total = 0.0
        for tree in trees:
            node = 0
            while tree.feature[node] >= 0:
                node = tree.left[node] + (not x[tree.feature[node]] <= tree.cut[node])
            total += tree.value[node]
        return total

    import math

    for r in sample.select("x", "strict", pii_boosting.score(trees, F.col("x")).alias("score")).limit(200).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-plain(r.x))), abs=1e-12)
    least = pii_boosting.thresholds(sample, trees, weights)
    assert all(0 < t <= 1 or t == 2 for t in least)


def test_all_distinct_candidates_are_learned_from(spark):
    rows = [(i, f"order {10_000_000_000 + 7919 * i} came") for i in range(9000)] + [(9000 + i, f"mail a{i}@b.org now") for i in range(4500)]
    found = pii_boosting.candidates(spark.createDataFrame(rows + rows[:50], SCHEMA))
    every, weights = pii_boosting._sample(found)
    counted = {r.strict: (r["count"], r.copies) for r in every.groupBy("strict").agg(F.count("*").alias("count"), F.sum("copies").alias("copies")).collect()}
    assert counted == {True: (4500, 4500), False: (9000, 9050)} and weights == {True: 1.0, False: 1.0}


def test_odd_tables(spark):
    none = pii_boosting.spans(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and none.isEmpty()
    rows = [(None, "a@b.cd"), (None, "a@b.cd"), (1, "a@b.cd"), (1, "1.2.3.4"), (9007199254740993, None), (9007199254740995, "x")]
    extra = spark.createDataFrame(rows, SCHEMA).withColumn("candidates", F.lit(1)).withColumn("strict", F.lit("s")).withColumn("base", F.lit(2))
    got = sorted((str(r.doc_id), r.spans) for r in pii_boosting.spans(extra).collect())
    assert got == sorted([("None", "email:0:6")] * 2 + [("1", "email:0:6"), ("1", "ip:0:7"), ("9007199254740993", ""), ("9007199254740995", "")])


def test_no_python_in_the_plan(spark):
    from builders import plan_of

    assert "Python" not in plan_of(pii_boosting.spans(table(spark, SF_DIR, "documents")))
