"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators propose spans of four kinds: the strict patterns, whose checked matches always stay, and wide ones for the forms
that people write as well (``name (at) host``, numbers without a plus, digits with other separators). Spans of different
generators may overlap. Spark's boosted trees learn from format and context which candidates are like the checked ones; the
trees then run as an expression beside the candidates, and a wide candidate is redacted if its score reaches the threshold
of its kind. Thresholds are calibrated on candidates that the trees have not seen: the least score from which on a given
share of the candidates is right.

Candidates of a document are an array beside its id, so texts are read once and never shuffled. One half of all distinct
candidates, by the hash of span and context, is fitted on, the other half gives the thresholds; both stay in Spark, each
candidate weighs as often as it occurs. Patterns are possessive, so a match takes time in proportion to the text.

A null text is empty, and an empty one has no spans. Null ids and repeated ids or rows each give a row of their own. Ties
between overlapping candidates go to the earlier and then the longer one. Without candidates of both classes to learn from
(an empty table, say) nothing is added to the strict spans. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from shopgauge.operators.boosting import Tree, margin
from shopgauge.session import materialize

#: Kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_NAME = "[A-Za-z0-9-]"
#: The strict patterns of the contract. A run of characters is entered at its start or behind the last match only, and
#: repeats are possessive: the same matches, without trying a run again from each of its places.
STRICT = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Wide patterns of the same kinds.
WIDE = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?(?:@|\(at\)|\[at\]|\{{at\}})\x20?{_NAME}++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{{dot\}})\x20?{_NAME}++)++",
    r"(?<![0-9.,])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|,|·)\x20?[0-9]{1,3}){3}(?![0-9])",
    r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}+[0-9]){13,18}+(?![0-9])",
    r"(?<![0-9+])(?:\+|00)?\(?[0-9](?:[\x20()./-]{0,3}+[0-9]){8,14}+(?![0-9])",
)
#: Letters of the text before a span that are looked at, and words there that announce one.
CONTEXT, ANNOUNCING = 24, "mail|contact|kontakt|correo|courriel|phone|tel[.:e]|fax|call|mobil|card|visa|konto|account|carte|tarjeta|\\bip\\b|host|server"
#: Trees and their depth; the share that must be right from the threshold on, and how many right ones must have been seen there.
TREES, DEPTH, PRECISION, LEAST_SEEN = 20, 4, 0.98, 20
_BINS = 1000


def _counted(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def located(text: Column, pattern: str) -> Column:
    """Matches as (start, end, span, before, after), in code points; before and after reach to the neighbouring match.

    The pieces between matches give the places. They are added up in about sqrt(n) stretches of sqrt(n) matches.
    """
    whole = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("spans"))

    def of(w: Column) -> Column:
        sized = F.transform(
            w["spans"],
            lambda s, i: F.struct(s.alias("span"), w["gaps"][i].alias("gap"), w["gaps"][i + 1].alias("next"),
                                  (F.char_length(w["gaps"][i]) + F.char_length(s)).alias("step")),
        )
        return F.when(F.size(w["spans"]) > 0, F.transform(F.array(sized), stretched)[0])

    def stretched(sized: Column) -> Column:
        n = F.size(sized)
        width = F.ceil(F.sqrt(n.cast("double"))).cast("int")
        stretches = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda k: F.slice(sized, k * width + 1, width))
        return F.transform(F.array(stretches), placed)[0]

    def total(steps: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    def placed(stretches: Column) -> Column:
        sums = F.transform(stretches, lambda one: total(F.transform(one, lambda s: s["step"])))

        def inside(one: Column, k: Column) -> Column:
            before = F.array(total(F.slice(sums, F.lit(1), k)))
            return F.transform(before, lambda b: F.transform(one, lambda s, i: F.struct(
                s.alias("s"), (b + total(F.transform(F.slice(one, F.lit(1), i + 1), lambda t: t["step"]))).alias("end"))))[0]

        return F.transform(
            F.flatten(F.transform(stretches, inside)),
            lambda m: F.struct(
                (m["end"] - F.char_length(m["s"]["span"])).alias("start"), m["end"].alias("end"), m["s"]["span"].alias("span"),
                F.right(m["s"]["gap"], F.lit(CONTEXT)).alias("before"), F.left(m["s"]["next"], F.lit(1)).alias("after"),
            ),
        )

    return F.coalesce(F.transform(F.array(whole), of)[0], F.array().cast(_PLACED))


_PLACED = "array<struct<start:int,end:int,span:string,before:string,after:string>>"


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _small_parts(span: Column) -> Column:
    """Whether all numbers between dots are at most 255."""
    parts = F.transform(F.split(span, "[^0-9]+"), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _passes(kind: int, span: Column) -> Column:
    """The check of the contract on a strict match."""
    n = F.char_length(_digits(span))
    return (F.lit(True), _small_parts(span), n.between(14, 19) & _luhn(span), n.between(10, 15))[kind]


def _luhn(span: Column) -> Column:
    return F.call_function("luhn_check", _digits(span))


def _class_of(character: Column) -> Column:
    return (
        F.when(character == "", 0.0).when(character.rlike("\\s"), 1.0).when(character.rlike("\\p{L}"), 2.0)
        .when(character.rlike("[0-9]"), 3.0).otherwise(4.0)
    )


def _features(kind: int, m: Column) -> Column:
    """Format and context of a candidate. What only restates a strict pattern (plus, bare @, whole length) is no feature."""
    span, digits = m["span"], _digits(m["span"])
    groups = F.filter(F.split(span, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.char_length(g))
    numbers = [
        *[F.lit(1.0 if kind == k else 0.0) for k in range(len(KINDS))],
        F.char_length(digits), _counted(span, "\\p{L}"), F.size(groups),
        F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)),
        _counted(span, "\\s"), _counted(span, "-"), _counted(span, "[.]"), _counted(span, "[()]"), _counted(span, "[/,_\\[\\]{}]"),
        _luhn(span) if kind == 2 else F.lit(False), _small_parts(span) if kind == 1 else F.lit(False),
        F.coalesce(F.left(digits, F.lit(1)).try_cast("int"), F.lit(-1)),
        F.char_length(F.regexp_extract(span, "(\\p{L}*)$", 1)),
        _class_of(F.right(m["before"], F.lit(1))), _class_of(m["after"]),
        F.lower(m["before"]).rlike(ANNOUNCING), _counted(m["before"], "[0-9]"), _counted(m["before"], "\\p{L}"),
    ]
    return F.array(*[n.cast("double") for n in numbers])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidates (kind, start, end, span, before, after, strict, x), written once.

    ``strict`` are checked matches of the strict patterns; a wide candidate that is one of these is not proposed again.
    """
    text = F.coalesce("text", F.lit(""))

    def found(kind: int, pattern: str, strict: bool) -> Column:
        may = F.contains(text, F.lit("@")) | text.rlike("(?i)[(\\[{]at[)\\]}]") if kind == 0 else text.rlike("[0-9]")
        matches = F.when(may, located(text, pattern)).otherwise(F.array().cast(_PLACED))
        if strict:
            matches = F.filter(matches, lambda m: _passes(kind, m["span"]))
        return F.transform(matches, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["span"].alias("span"),
            m["before"].alias("before"), m["after"].alias("after"), F.lit(strict).alias("strict"), _features(kind, m).alias("x"),
        ))

    strict = F.concat(*[found(k, STRICT[k], True) for k in range(len(KINDS))])
    wide = F.concat(*[found(k, WIDE[k], False) for k in range(len(KINDS))])
    once = docs.select(F.col("doc_id").cast("long").alias("doc_id"), strict.alias("strict"), wide.alias("wide"))
    known = F.transform("strict", lambda c: F.struct(c["kind"], c["start"], c["end"]))
    new = F.transform(F.array(known), lambda k: F.filter("wide", lambda c: ~F.array_contains(k, F.struct(c["kind"], c["start"], c["end"]))))[0]
    return materialize(once.select("doc_id", F.concat("strict", new).alias("candidates")), "pii-candidates")


def _sample(found: DataFrame, per_class: int | None = None) -> tuple[DataFrame, dict[bool, float]]:
    """Distinct candidates of either class, and how many corpus candidates each stands for.

    All of them, unless a caller bounds the number of either class: then those with the smallest hashes. A wide candidate
    that overlaps a strict span of its document is neither right nor wrong, and left out. Rows are written in the order of
    their hashes, so that a fit can be repeated.
    """
    clear = F.filter("candidates", lambda c: c["strict"] | ~F.exists("candidates", lambda s: s["strict"] & (s["start"] < c["end"]) & (c["start"] < s["end"])))
    each = found.where(F.size("candidates") > 0).select(F.inline(clear))
    keys = ["strict", "kind", "span", "before", "after"]
    order = F.xxhash64(*keys)
    distinct = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    marked = distinct.withColumn("learns", F.pmod(order, F.lit(2)) == 0)
    if per_class is None:
        every = materialize(marked.sortWithinPartitions(order, *keys), "pii-distinct")
        return every, {r["strict"]: 1.0 for r in every.select("strict").distinct().collect()}
    written = materialize(marked, "pii-distinct")
    classes = [written.where(F.col("strict") == right).orderBy(order, *keys).limit(per_class) for right in (True, False)]
    sample = materialize(classes[0].union(classes[1]), "pii-sample")
    whole = {r["strict"]: r["n"] for r in written.groupBy("strict").agg(F.sum("copies").alias("n")).collect()}
    taken = {r["strict"]: r["n"] for r in sample.groupBy("strict").agg(F.sum("copies").alias("n")).collect()}
    return sample, {right: whole[right] / taken[right] for right in taken}


def _as_tree(node) -> Tree:
    """A tree of Spark's learner with children side by side."""
    tree, waiting = Tree(), []

    def add(n) -> int:
        at = tree.add(float(n.prediction()))
        if n.subtreeDepth() > 0:
            waiting.append((at, n))
        return at

    add(node)
    for at, n in waiting:
        tree.feature[at], tree.cut[at] = n.split().featureIndex(), float(n.split().threshold())
        tree.left[at] = add(n.leftChild())
        add(n.rightChild())
    return tree


def fitted(sample: DataFrame, weights: dict[bool, float]) -> list[Tree]:
    """Trees from the learning half of the candidates; their margin is twice the sum of weighted predictions, as a logit."""
    weight = F.when(F.col("strict"), F.lit(weights.get(True, 1.0))).otherwise(F.lit(weights.get(False, 1.0))) * F.col("copies")
    rows = sample.where("learns").select(array_to_vector("x").alias("features"), F.col("strict").cast("double").alias("label"), weight.alias("weight"))
    if rows.select("label").distinct().count() < 2:
        return []
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=42, weightCol="weight", maxBins=32).fit(rows)
    trees = [_as_tree(t._call_java("rootNode")) for t in model.trees]
    for tree, share in zip(trees, model.treeWeights):
        tree.value = [2.0 * share * v for v in tree.value]
    return trees


def score(trees: list[Tree], x: Column) -> Column:
    size = len(KINDS) + 19
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(trees, [x[i] for i in range(size)])))


def thresholds(sample: DataFrame, trees: list[Tree], weights: dict[bool, float], precision: float = PRECISION) -> list[float]:
    """For each kind the least score, in steps, from which on ``precision`` of the unseen candidates is right; 2 if none."""
    weight = F.when(F.col("strict"), F.lit(weights[True])).otherwise(F.lit(weights[False])) * F.col("copies")
    scored = sample.where(~F.col("learns")).select("kind", "strict", weight.alias("weight"), F.floor(score(trees, F.col("x")) * _BINS).alias("bin"))
    rows = scored.groupBy("kind", "bin").agg(
        F.sum(F.when(F.col("strict"), F.col("weight")).otherwise(0.0)).alias("right"),
        F.sum(F.when(F.col("strict"), F.lit(0.0)).otherwise(F.col("weight"))).alias("wrong"), F.count_if("strict").alias("seen"),
    ).collect()
    out = []
    for kind in range(len(KINDS)):
        right = wrong = seen = 0
        least = 2.0
        for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: -r["bin"]):
            right, wrong, seen = right + r["right"], wrong + r["wrong"], seen + r["seen"]
            if seen >= LEAST_SEEN and right >= precision * (right + wrong):
                least = r["bin"] / _BINS
        out.append(least)
    return out


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def selected(found: DataFrame, trees: list[Tree], least: list[float]) -> DataFrame:
    """doc_id, ``base`` and ``added`` spans (kind, start, end, score), each by start, then kind.

    Added are wide candidates at their threshold that no strict span overlaps; of two neighbours that overlap each other
    the better one.
    """
    base = F.transform(F.filter("candidates", lambda c: c["strict"]), lambda c: F.struct(c["start"], c["kind"], c["end"]))
    added = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    if trees:
        limits = F.lit(least)
        scored = F.transform(
            F.filter("candidates", lambda c: ~c["strict"]),
            lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), score(trees, c["x"]).alias("score")),
        )
        wanted = F.array_sort(F.filter(scored, lambda c: (c["score"] >= limits[c["kind"]]) & ~F.exists("base", lambda b: _overlap(b, c))))

        def best(all_of: Column) -> Column:
            def beaten(c: Column, i: Column) -> Column:
                before, after = F.get(all_of, i - 1), F.get(all_of, i + 1)
                worse = _overlap(before, c) & (before["score"] >= c["score"])
                return F.coalesce(worse, F.lit(False)) | F.coalesce(_overlap(after, c) & (after["score"] > c["score"]), F.lit(False))

            return F.filter(all_of, lambda c, i: ~beaten(c, i))

        added = F.transform(F.array(wanted), best)[0]
    with_base = found.select("doc_id", F.array_sort(base).cast("array<struct<start:int,kind:int,end:int>>").alias("base"), "candidates")
    return with_base.select("doc_id", "base", added.alias("added"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def personal_data(docs: DataFrame, per_class: int | None = None) -> DataFrame:
    """doc_id, base and added spans of every document."""
    found = candidates(docs)
    sample, weights = _sample(found, per_class)
    trees = fitted(sample, weights) if len(weights) == 2 else []
    return selected(found, trees, thresholds(sample, trees, weights) if trees else [])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, the number of strict spans of each kind, their digest, and all spans as text."""
    done = personal_data(docs)
    every = F.array_sort(F.concat("base", F.transform("added", lambda s: F.struct(s["start"], s["kind"], s["end"]))))
    return done.select(
        "doc_id",
        *[_number_of(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(every).alias("spans"),
    )
