"""SpotSigs fingerprints, in DataFrame operations only.

A spot is an anchor, a common word of one of four languages, and its signature the anchor with a full chain of the next
content words after it: words that are no anchors themselves. An anchor that no full chain follows within ``REACH`` words is
no spot. Words are runs of letters and digits. As a text may hold no common word at all (tables, lists), one word in
``SAMPLED`` is an anchor by its own hash, whatever text it is in. A fingerprint is the set of a text's signatures. Two
sets are compared by Jaccard: pairs whose lengths alone rule the likeness out are pruned before anything is intersected,
and in the search for near duplicates sets only meet inside neighbouring partitions of set length.

Nulls: a null text is an empty one. A text without spots has one signature, its whole sequence of words (of a text without
letters and digits, the text), so equal texts have equal fingerprints and the empty text has one too. Rows without a doc_id come after all others. Rows that share a
doc_id follow each other in the order of their texts' hashes. Repeated rows give repeated result rows. An empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shopgauge.session import materialize

#: Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be by for from has he in is it its of on that the this to was were will with not or which "
    "un une le la les du des de et en est que qui dans pour par sur au aux avec pas il elle son sa "
    "der die das den dem ein eine einer und ist zu von mit im auf für nicht sich auch als bei aus "
    "el los las del una y se no su lo al con para como más pero esta está o ha"
).split()
#: Words in a chain; how many words after an anchor are searched for them; one word in so many is an anchor by its hash.
CHAIN, REACH, SAMPLED = 2, 8, 16
#: Rows in one range of the order by id, about, and the most ranges; beyond, ranges get longer and their sort spills.
RANGE_ROWS, MOST_RANGES = 2048, 1 << 14
_BETWEEN = "[^\\p{L}\\p{N}]+"


def is_anchor(word: Column) -> Column:
    return word.isin(sorted(set(ANCHORS))) | (F.pmod(F.xxhash64(word), F.lit(SAMPLED)) == 0)


def signatures(text: Column) -> Column:
    """The sorted distinct signatures of a text, as 64-bit hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")

    def spot(marked: Column, m: Column, i: Column) -> Column:
        chain = F.slice(F.filter(F.slice(marked, i + 2, REACH), lambda n: ~n["a"]), 1, CHAIN)
        return F.when(m["a"] & (F.size(chain) == CHAIN), F.xxhash64(m["w"], chain["w"]))

    def of(marked: Column) -> Column:
        found = F.array_sort(F.array_distinct(F.array_compact(F.transform(marked, lambda m, i: spot(marked, m, i)))))
        whole = F.when(F.size(marked) > 0, F.xxhash64(marked["w"])).otherwise(F.xxhash64(F.coalesce(text, F.lit(""))))
        return F.when(F.size(found) > 0, found).otherwise(F.array(whole))

    # An array of one element, so that the words are made once and then named.
    marked = F.transform(words, lambda w: F.struct(w.alias("w"), is_anchor(w).alias("a")))
    return F.transform(F.array(marked), of)[0]


def fingerprint(signature_set: Column) -> Column:
    """Number of signatures and a hash of the whole set, as text."""
    return F.concat_ws(":", F.size(signature_set).cast("string"), F.lower(F.lpad(F.hex(F.xxhash64(signature_set)), 16, "0")))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets. Pairs that their lengths keep below ``least`` are pruned: 0, not intersected."""
    n, m = F.size(a), F.size(b)
    bound = F.least(n, m) / F.greatest(n, m)
    common = F.size(F.array_intersect(a, b))
    return F.when(bound < least, F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(common / (n + m - common)).cast("double")


def _range_of(doc_id: Column, firsts: list[int]) -> Column:
    """Number of the last range that starts at or before the id; ranges are found in two steps of their square root."""
    wide = max(1, int(len(firsts) ** 0.5))
    groups = [firsts[i : i + wide] for i in range(0, len(firsts), wide)]
    heads = F.lit([g[0] for g in groups])
    at = F.size(F.filter(heads, lambda x: x <= doc_id)) - 1
    inside = F.element_at(F.lit([g + [(1 << 63) - 1] * (wide - len(g)) for g in groups]), at + 1)
    return (at * wide + F.size(F.filter(inside, lambda x: x <= doc_id)) - 1).cast("int")


def _firsts(ids: DataFrame, rows: int) -> list[int]:
    """The first id of every range of the order by id: at most ``MOST_RANGES`` numbers."""
    ranges = min(MOST_RANGES, max(1, -(-rows // RANGE_ROWS)))
    spread = ids.repartitionByRange(ranges, "doc_id").groupBy(F.spark_partition_id().alias("at")).agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in spread.collect())


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs, next_text and next_sigs; next is the following document by id, and the first after the last.

    Every range of ids is a window of its own. The rows with the first id of a range also go to the range before, where
    they only serve as the next ones, so texts are shuffled once and no task needs all rows. Rows without an id are
    followed by the first document, and follow none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    sizes = rows.agg(F.min("doc_id").alias("least"), F.count("doc_id").alias("named")).head()
    lead = rows if sizes["least"] is None else rows.where(F.col("doc_id") == sizes["least"])
    first = lead.orderBy(F.xxhash64("text")).limit(1).collect()
    named, nameless = rows.where("doc_id is not null"), rows.where("doc_id is null")
    opening = F.lit(first[0]["text"] if first else "")
    if sizes["named"]:
        firsts = _firsts(named.select("doc_id"), sizes["named"])
        at = _range_of(F.col("doc_id"), firsts)
        starts_range = F.element_at(F.lit(firsts), F.col("at") + 1) == F.col("doc_id")
        places = F.when(starts_range & (F.col("at") > 0), F.array("at", F.col("at") - 1)).otherwise(F.array("at"))
        placed = named.withColumn("at", at).select("doc_id", "text", "at", F.explode(places).alias("range"))
        window = Window.partitionBy("range").orderBy(*order)
        named = (
            placed.withColumn("sigs", signatures(F.col("text")))
            .withColumn("next_text", F.lead("text").over(window))
            .withColumn("next_sigs", F.lead("sigs").over(window))
            .where(F.col("at") == F.col("range"))
            .select(
                "doc_id", "text", "sigs", F.coalesce("next_text", opening).alias("next_text"),
                F.coalesce("next_sigs", signatures(opening)).alias("next_sigs"),
            )
        )
    else:
        named = named.select("doc_id", "text", signatures(F.col("text")).alias("sigs"), opening.alias("next_text"), signatures(opening).alias("next_sigs"))
    return named.union(
        nameless.select("doc_id", "text", signatures(F.col("text")).alias("sigs"), opening.alias("next_text"), signatures(opening).alias("next_sigs"))
    )


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike it is to that and to the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return (
        followed(docs)
        .withColumn("edited", edited)
        .select("doc_id", "sigs", "next_sigs", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                signatures(F.col("edited")).alias("edited_sigs"))
        .select(
            "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"),
            fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
            likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
            likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        )
    )


def near_duplicates(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of classes at least ``least`` alike, and the class (class_id) of every document.

    A class is the documents of equal sets, named by its smallest doc_id, or null if none of them has one. Classes meet
    under their fingerprints, so those without a name are linked too, and two texts of one doc_id are two classes of one
    name. Every link is one row with a <= b; null names come last. Signatures are ordered by how few classes hold them; two sets as alike as asked share one of the first n - ceil(least * n) + 1, and their lengths differ by
    no more than that factor, so sets only meet at these rare signatures and in neighbouring partitions of length.
    """
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text")).alias("sigs"))
    sets = materialize(sets.withColumn("print", fingerprint(F.col("sigs"))), "spot-sets")
    names = materialize(sets.groupBy("print").agg(F.min("doc_id").alias("class_id")), "spot-classes")
    classes = sets.groupBy("print").agg(F.first("sigs").alias("sigs")).join(names, "print")
    n = F.size("sigs")
    # Lengths of one partition differ by less than the factor that the likeness allows; by nothing, if that is one.
    by_length = F.floor(F.log(n.cast("double")) / -F.log(F.lit(least))) if least < 1 else n.cast("long")
    spots = materialize(
        classes.select("print", "class_id", "sigs", n.alias("n"), by_length.alias("partition")), "spot-lengths"
    )
    single = spots.select("print", "n", "partition", F.explode("sigs").alias("sig"))
    rare = single.groupBy("sig").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    ranked = single.join(rare, "sig", "left").withColumn(
        "nth", F.row_number().over(Window.partitionBy("print").orderBy(F.coalesce("held", F.lit(1)), "sig"))
    )
    heads = materialize(ranked.where((F.col("nth") <= F.col("n") - F.ceil(F.col("n") * least) + 1) & (F.col("held") > 1)), "spot-heads")
    left = heads.select("sig", F.col("print").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(*[F.col("partition") + d for d in (-1, 0, 1)])).alias("partition"))
    right = heads.select("sig", "partition", F.col("print").alias("b"), F.col("n").alias("n_b"))
    near = left.join(right, ["sig", "partition"]).where(
        (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    )
    pairs = near.select("a", "b").distinct()
    full = spots.select("print", "class_id", "sigs")
    alike = (
        pairs.join(full.toDF("a", "id_a", "sigs_a"), "a").join(full.toDF("b", "id_b", "sigs_b"), "b")
        .select("id_a", "id_b", likeness(F.col("sigs_a"), F.col("sigs_b"), least).alias("likeness"))
        .where(F.col("likeness") >= least)
        .select(
            F.least("id_a", "id_b").alias("a"), F.when(F.col("id_a").isNotNull() & F.col("id_b").isNotNull(), F.greatest("id_a", "id_b")).alias("b"),
            "likeness",
        )
    )
    return alike, sets.select("doc_id", "print").join(names, "print").select("doc_id", "class_id")
