import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopgauge.operators import boosting, learning, model_metrics, scoring, trials
from shopgauge.plans import registry
from shopgauge.schema import FEATURES, LABEL, PERSON


@pytest.fixture(scope="module")
def features(spark):
    """Synthetic features; more orders make leaving less likely."""
    draw = random.Random(42)
    data = []
    for i in range(1000):
        orders = draw.randint(1, 14)
        data.append((
            f"p{i:04}", orders, draw.uniform(20, 3000), draw.uniform(20, 500), draw.uniform(1, 10),
            draw.randint(1, 3), draw.uniform(1, 5), draw.randint(0, 9), draw.randint(0, 729), draw.uniform(1, 365),
            draw.randint(0, 26), int(draw.random() < 0.9 - orders * 0.055),
        ))
    names = [PERSON, *FEATURES, LABEL]
    whole = {"frequency", "payment_type_count", "review_count", "tenure_days", "state_encoded", LABEL}
    kinds = ", ".join(f"{n} {'string' if n == PERSON else 'long' if n in whole else 'double'}" for n in names)
    return spark.createDataFrame(data, kinds).cache()


@pytest.fixture(scope="module")
def split(features):
    return learning.stratified_split(features).cache()


def test_split_is_exact_per_label_and_repeatable(features, split):
    counts = {(r[LABEL], r.part): r["count"] for r in split.groupBy(LABEL, "part").count().collect()}
    for label in (0, 1):
        n = counts[label, "train"] + counts[label, "test"]
        assert counts[label, "test"] == (n * 20 + 50) // 100
    again = learning.stratified_split(features.repartition(3))
    assert split.select(PERSON, "part").exceptAll(again.select(PERSON, "part")).isEmpty()


def test_folds_are_even_per_label(features):
    sizes = learning.stratified_folds(features).groupBy(LABEL, "fold").count().collect()
    for label in (0, 1):
        of_label = [r["count"] for r in sizes if r[LABEL] == label]
        assert len(of_label) == 3 and max(of_label) - min(of_label) <= 1


@pytest.fixture(scope="module")
def fitted(split):
    train, test = (split.where(F.col("part") == part).drop("part") for part in ("train", "test"))
    return learning.train(train, test, {"n_estimators": 8, "max_depth": 3, "scale_pos_weight": 2.0}), test


def test_model_learns(fitted):
    model, _ = fitted
    assert set(model.feature_names) == set(FEATURES)
    assert set(model.metrics) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    assert all(0 <= v <= 1 for v in model.metrics.values())
    assert model.metrics["roc_auc"] > 0.6


def test_scores(fitted):
    model, test = fitted
    for r in scoring.batch_score(model.score(test)).collect():
        assert 0 <= r.churn_probability <= 1
        assert r.risk_level in ("LOW", "MEDIUM", "HIGH")
        assert r.is_churned == (r.churn_probability >= 0.5) or abs(r.churn_probability - 0.5) < 1e-4


def test_importance_finds_the_driver(spark, fitted):
    model, test = fitted
    gain = learning.feature_importance(spark, model).collect()
    assert gain[0].feature == "frequency"
    assert sum(r.importance for r in gain) == pytest.approx(1, abs=1e-3)
    drop = learning.permutation_importance(model, test).collect()
    assert drop[0].feature == "frequency" and drop[0].auc_drop > 0.05
    assert len(drop) == len(FEATURES)


def test_save_and_load(fitted, tmp_path):
    model, test = fitted
    learning.save_model(model, str(tmp_path / "m"))
    loaded = learning.load_model(str(tmp_path / "m"))
    assert loaded.feature_names == model.feature_names
    assert loaded.metrics == model.metrics
    assert loaded.params == model.params
    before, after = (m.score(test).select(PERSON, "probability") for m in (model, loaded))
    assert before.exceptAll(after).isEmpty()


def test_runs_are_appended(spark, fitted, tmp_path):
    model, _ = fitted
    ids = {learning.log_run(spark, model, str(tmp_path / "runs")) for _ in range(2)}
    runs = learning.read_runs(spark, str(tmp_path / "runs")).collect()
    assert {r.run_id for r in runs} == ids
    assert all(r.metrics == model.metrics and r.features == model.feature_names and r.ts for r in runs)


SAMPLED = {"n_estimators": 12, "max_depth": 4, "subsample": 0.8, "colsample_bytree": 0.7, "reg_alpha": 0.5, "scale_pos_weight": 3.0}


def test_the_model_depends_neither_on_tasks_nor_on_where_it_is_fitted(features):
    inside = learning.fit(features, SAMPLED).trees
    for parts in (4, 16):
        assert learning.fit(features.repartition(parts, "monetary"), SAMPLED, in_task=0).trees == inside
    assert learning.fit(features, {**SAMPLED, "subsample": 0.7}).trees != inside


def test_the_three_forms_of_a_fit_give_the_same_trees(features, monkeypatch):
    inside = learning.fit(features, SAMPLED).trees
    monkeypatch.setattr(learning, "LEAST_SHARE", 10)
    asked = []
    by_tasks = boosting.fit_together
    monkeypatch.setattr(boosting, "fit_together", lambda *given: asked.append(given[-1]) or by_tasks(*given))
    assert learning.fit(features, SAMPLED, in_task=0, together=1000).trees == inside
    assert len(asked) == 1 and asked[0] > 1  # several tasks at once, each with its share of the rows
    assert learning.fit(features, SAMPLED, in_task=0, together=0).trees == inside
    assert len(asked) == 1


def jobs_of(spark, group, call):
    spark.sparkContext.setJobGroup(group, group)
    call()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = [spark.sparkContext.statusTracker().getJobInfo(i) for i in spark.sparkContext.statusTracker().getJobIdsForGroup(group)]
    return len(found), sum(len(job.stageIds) for job in found)


def test_a_level_in_passes_is_one_job_of_one_stage(spark, features):
    fits = [
        jobs_of(spark, f"fit-{n}", lambda: learning.fit(features, {**SAMPLED, "n_estimators": n}, in_task=0)) for n in (3, 9)
    ]
    for fewer, more in zip(*fits):
        assert 0 < more - fewer <= 6 * SAMPLED["max_depth"]


def test_sums_too_large_for_the_driver_are_added_up_by_tasks(features, monkeypatch):
    few = {**SAMPLED, "n_estimators": 3}
    inside = learning.fit(features, few).trees
    tasks, total = [], boosting._total
    monkeypatch.setattr(boosting, "_total", lambda sums, shape: tasks.append(sums.getNumPartitions()) or total(sums, shape))
    monkeypatch.setattr(boosting, "MOST_COLLECTED", 0)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    assert learning.fit(features, few, in_task=0).trees == inside
    assert min(tasks) > 1


def test_batches_have_the_numbers_of_the_expression(features):
    model = learning.fit(features, SAMPLED)
    rows = features.withColumn("monetary", F.when(F.col("frequency") > 3, F.col("monetary")))
    columns = [F.col(name) for name in model.feature_names]
    both = rows.select(model.margin().alias("batch"), boosting.margin(model.trees, columns).alias("expression"))
    assert both.where("batch != expression or batch is null").isEmpty()


def test_fewer_trees_are_the_beginning_of_more(features):
    more = learning.fit(features, SAMPLED).trees
    assert learning.fit(features, {**SAMPLED, "n_estimators": 5}).trees == more[:5]


def brute_splits(rows, depth, s):
    """The first tree's root split and leaf weights by trying every cut of every feature in plain Python."""
    def soft(g):
        return (g - s.l1 if g > s.l1 else g + s.l1 if g < -s.l1 else 0.0)

    def sums(part):
        return sum((0.5 - y) * (s.positive_weight if y else 1) for _, y in part), sum(0.25 * (s.positive_weight if y else 1) for _, y in part)

    def score(part):
        g, h = sums(part)
        return soft(g) ** 2 / (h + s.l2)

    best = None
    for f in range(len(rows[0][0])):
        for cut in sorted({x[f] for x, _ in rows})[:-1]:
            left, right = [r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]
            if min(sums(left)[1], sums(right)[1]) < s.least_weight:
                continue
            gain = score(left) + score(right) - score(rows)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, cut, [-s.rate * soft(sums(p)[0]) / (sums(p)[1] + s.l2) for p in (left, right)])
    return best


def test_a_tree_equals_brute_force():
    import numpy as np

    draw = random.Random(5)
    rows = [((draw.randint(0, 9), draw.choice([0.0, 1.0, 2.5]), draw.randint(0, 40)), int(draw.random() < 0.4)) for _ in range(120)]
    settings = boosting.Settings(trees=1, depth=1, l1=0.3, l2=2.0, least_weight=4.0, positive_weight=2.0)
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    tree = boosting.grow(np.arange(len(rows)), x, y, settings)[0]
    gain, feature, cut, leaves = brute_splits(rows, 1, settings)
    assert (tree.feature[0], tree.cut[0]) == (feature, cut)
    assert tree.gain[0] == pytest.approx(gain, abs=1e-5) and tree.value[1:] == pytest.approx(leaves, abs=1e-6)


def test_rows_of_a_block_are_walked_feature_by_feature():
    draw = np.random.default_rng(7)
    bins, y = draw.integers(0, boosting.BINS, (3000, 4)).astype(np.uint8), draw.integers(0, 2, 3000).astype(np.int8)
    keys, cuts, lines = np.arange(3000), [np.arange(63.0)] * 4, np.ascontiguousarray(bins.T)
    trees = boosting._grow(keys, bins, y, cuts, boosting.Settings(trees=3, depth=5), lambda own: own)
    rows = np.flatnonzero(draw.random(3000) < 0.7)
    for tree in [boosting._sapling(), *trees]:
        assert (boosting._reached(lines, tree, rows) == boosting._leaves(bins[rows], tree)).all()
    row = {"keys": keys.tobytes(), "bins": lines.tobytes(), "y": y.tobytes(), "margin": np.zeros(3000).tobytes()}
    margin = boosting._advanced(boosting._unpacked(row, 4), trees)[-1]
    assert (margin == sum(tree.leaf_values(bins) for tree in trees)).all()
    assert (boosting._reached(np.zeros((4, 0), np.uint8), trees[0], np.arange(0)) == np.zeros(0)).all()


def test_scores_are_the_margins_of_the_fit(features):
    import numpy as np

    model = learning.fit(features, SAMPLED)
    rows = features.toPandas()
    margins = next(boosting.staged_margins(model.trees, rows[model.feature_names].to_numpy(float), [12]))
    theirs = dict(zip(rows[PERSON], 1 / (1 + np.exp(-margins))))
    for r in model.score(features).collect():
        assert r.probability == pytest.approx(theirs[r[PERSON]], abs=1e-12)


def test_attributions_sum_to_the_margin(features):
    model = learning.fit(features, SAMPLED)
    both = model.attributed(features).select(F.aggregate("attribution", F.lit(0.0), lambda a, v: a + v).alias("total"), model.margin().alias("margin"))
    assert both.where(F.abs(F.col("total") - F.col("margin")) > 1e-9).isEmpty()
    means = learning.mean_attribution(model, features).collect()
    assert means[0].feature == "frequency" and len(means) == len(FEATURES)


def test_null_features_and_constant_ones(spark, features):
    spoiled = features.withColumn("monetary", F.when(F.col("frequency") > 3, F.col("monetary"))).withColumn("state_encoded", F.lit(1))
    inside = learning.fit(spoiled, SAMPLED)
    assert learning.fit(spoiled, SAMPLED, in_task=0).trees == inside.trees
    at = inside.feature_names.index("state_encoded")
    assert all(at not in tree.feature for tree in inside.trees)
    assert inside.score(spoiled).where("probability is null or isnan(probability)").isEmpty()
    empty = learning.fit(features.limit(0), SAMPLED)
    assert empty.score(features).where("probability <> 0.5").isEmpty()


SMALL = {**learning.SEARCH_SPACE, "n_estimators": (3, 5, "int"), "max_depth": (2, 3, "int")}


def test_a_search_goes_on_from_its_ledger(spark, features, tmp_path, monkeypatch):
    made = []
    fit = learning._cross_validated

    def counted(spark, data, fits, study, seed):
        if len(made) + len(fits) > 4:
            raise RuntimeError("lost")
        made.extend(fits)
        return fit(spark, data, fits, study, seed)

    monkeypatch.setattr(learning, "_cross_validated", counted)
    ledger = str(tmp_path / "fits")
    with pytest.raises(RuntimeError, match="lost"):
        learning.tune(features, 3, SMALL, ledger=ledger, wave=2)
    assert len(made) == 4
    made.clear()
    monkeypatch.setattr(learning, "_cross_validated", lambda *a: (made.extend(a[2]), fit(*a))[1])
    trials, _ = learning.tune(features.repartition(5), 3, SMALL, ledger=ledger, wave=2)
    assert len(made) == 3 * learning.FOLDS - 4
    made.clear()
    assert learning.tune(features, 3, SMALL, ledger=ledger)[0] == trials == learning.tune(features, 3, SMALL)[0]
    assert len(made) == 3 * learning.FOLDS  # only the call with a ledger of its own
    made.clear()
    learning.tune(features.where("frequency > 2"), 3, SMALL, ledger=ledger)
    assert len(made) == 3 * learning.FOLDS  # other rows are another search


def test_points_that_differ_in_trees_share_a_fit(features, monkeypatch):
    points = [{**SAMPLED, "n_estimators": n} for n in (3, 9, 6)]
    monkeypatch.setattr(learning, "sample_params", lambda *_: points)
    assert [sorted(f[2]) for f in learning._fits(points, 2, {})] == [[3, 6, 9]] * 2
    together = [t["value"] for t in learning.tune(features, 3, folds=2)[0]]
    monkeypatch.setattr(learning, "sample_params", lambda *_: points[2:])
    assert learning.tune(features, 1, folds=2)[0][0]["value"] == together[2]


def test_tuned_values_are_those_of_single_fits(features, monkeypatch):
    monkeypatch.setattr(learning, "sample_params", lambda *_: [SAMPLED])
    value = learning.tune(features, 1)[0][0]["value"]
    folded = learning.stratified_folds(learning.sampled(features, learning.SAMPLE)).cache()
    aucs = []
    for fold in range(learning.FOLDS):
        model = learning.fit(folded.where(F.col("fold") != fold).drop("fold"), SAMPLED)
        scored_rows = model.score(folded.where(F.col("fold") == fold))
        aucs.append(model_metrics.roc_auc(scored_rows, LABEL, "probability").first().roc_auc)
    assert value == pytest.approx(sum(aucs) / len(aucs), abs=1e-6)


def test_the_search_looks_at_all_persons(spark, monkeypatch):
    """More persons than the search once took."""
    number = F.col("id").cast("int")
    people = spark.range(52_001).select(F.col("id").cast("string").alias(PERSON), (number % 3 % 2).alias(LABEL), *[F.xxhash64("id", F.lit(n)).cast("double").alias(n) for n in FEATURES])
    monkeypatch.setattr(learning, "sample_params", lambda *_: [{"n_estimators": 1, "max_depth": 1}])
    seen, folds = [], learning.stratified_folds
    monkeypatch.setattr(learning, "stratified_folds", lambda rows, *others: (seen.append(rows.count()), folds(rows, *others))[1])
    learning.tune(people, 1)
    assert seen == [52_001]


def test_fits_inside_tasks_and_in_passes_are_worth_the_same(features, monkeypatch):
    monkeypatch.setattr(learning, "sample_params", lambda *_: [{**SAMPLED, "n_estimators": n} for n in (2, 5)])
    inside = learning.tune(features, 2)[0]
    monkeypatch.setattr(learning, "IN_TASK", 0)  # cuts by all tasks
    assert learning.tune(features, 2)[0] == inside
    passes = learning.tune(features, 2, in_task=0)[0]
    assert [t["value"] for t in passes] == pytest.approx([t["value"] for t in inside], abs=2e-6)


def test_each_fit_of_the_search_has_a_task(spark, features):
    data = learning._folded(learning.stratified_folds(features), FEATURES, 3, learning.SEARCH_IN_TASK)
    fits = learning._fits([{"n_estimators": 1, "max_depth": depth} for depth in (1, 2)], 3, {})
    values = learning._cross_validated(spark, data, fits, "s", 1)
    assert len(values.inputFiles()) == len(fits) == values.count()


def test_queries_of_a_kept_model_read_the_persons_anew(spark, tmp_path):
    import shutil

    folder = tmp_path / "tables"
    shutil.copytree("/root/testdata/sf0.001", folder, copy_function=shutil.copyfile)  # the tables are read-only
    query = registry.learning_queries()["model_batch_score"]
    before = query(spark, str(folder)).count()
    few = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_custkey % 2 = 0").toPandas()
    few.to_parquet(folder / "orders.parquet", coerce_timestamps="us")
    spark.catalog.refreshByPath(str(folder))
    after = query(spark, str(folder)).count()
    assert 0 < after < before


@pytest.mark.parametrize("name", ["mean_attribution", "model_risk_histogram", "rule_risk_histogram"])
def test_a_query_that_fits_the_model_reads_the_persons_once(spark, monkeypatch, name):
    reads, features = [], registry.features
    monkeypatch.setattr(registry, "features", lambda *given: reads.append(given) or features(*given))
    monkeypatch.setattr(registry, "_fitted", {})
    monkeypatch.setattr(registry, "_rule_fitted", {})
    monkeypatch.setattr(learning, "train", lambda *_: learning.ChurnModel([], FEATURES))
    query = registry.learning_queries()[name]
    first = query(spark, "/root/testdata/sf0.001").collect()
    assert len(reads) == 1
    assert query(spark, "/root/testdata/sf0.001").collect() == first
    assert len(reads) == 2


def test_parameters_are_drawn_from_the_space():
    points = learning.sample_params(50)
    assert points == learning.sample_params(50)
    for point in points:
        assert set(point) == set(learning.SEARCH_SPACE)
        for name, (low, high, kind) in learning.SEARCH_SPACE.items():
            assert low <= point[name] <= high
            assert kind != "int" or isinstance(point[name], int)


def test_tuning_and_training_run(features, tmp_path):
    run = learning.churn_training(features, str(tmp_path), trials=2, space=SMALL)
    assert [t["number"] for t in run.trials] == [0, 1]
    assert max(t["value"] for t in run.trials) > 0.6
    assert run.model.params == max(run.trials, key=lambda t: t["value"])["params"]
    assert learning.load_model(f"{tmp_path}/churn_model").metrics == run.model.metrics


def brute_auc(pairs):
    good = bad = 0.0
    for p, y in pairs:
        for q, z in pairs:
            if y == 1 and z == 0:
                good += 1.0 if p > q else 0.5 if p == q else 0.0
                bad += 1
    return good / bad


def scored(spark, pairs):
    return spark.createDataFrame([(y, p) for p, y in pairs], f"{LABEL} long, p double")


def test_auc_with_ties_equals_brute_force(spark):
    draw = random.Random(3)
    pairs = [(draw.choice([0.2, 0.2, 0.5, draw.random()]), draw.randint(0, 1)) for _ in range(300)]
    got = model_metrics.roc_auc(scored(spark, pairs), LABEL, "p").first().roc_auc
    assert got == pytest.approx(brute_auc(pairs), abs=1e-12)


def test_auc_agrees_with_the_evaluator(spark, fitted):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    model, test = fitted
    rows = model.score(test)
    theirs = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol=LABEL, numBins=0).evaluate(rows)
    assert model_metrics.roc_auc(rows, LABEL, "probability").first().roc_auc == pytest.approx(theirs, abs=1e-9)


def test_auc_without_one_class_is_null(spark):
    assert model_metrics.roc_auc(scored(spark, [(0.1, 1), (0.2, 1)]), LABEL, "p").first().roc_auc is None


def test_metrics_and_report(spark):
    pairs = [(0.9, 1), (0.8, 1), (0.5, 0), (0.4, 1), (0.3, 0), (0.1, 0), (0.1, 0)]
    m = model_metrics.binary_metrics(scored(spark, pairs), LABEL, "p").first()
    assert (m.accuracy, m.precision, m.recall, m.f1, m.roc_auc) == (0.7143, 0.6667, 0.6667, 0.6667, 0.9167)
    report = {r["class"]: r for r in model_metrics.classification_report(scored(spark, pairs), LABEL, "p").collect()}
    assert (report["Active"].precision, report["Active"].recall, report["Active"].support) == (0.75, 0.75, 4)
    assert report["macro avg"].f1 == 0.71 and report["accuracy"].support == 7


def test_trials_fail_tie_and_go_below_zero(spark):
    history = spark.createDataFrame(
        [("s", 0, None), ("s", 1, -0.2), ("s", 2, 0.5), ("s", 3, 0.4), ("s", 4, 0.5), ("f", 7, None), ("f", 8, -1.0)],
        "study string, number long, value double",
    )
    got = {(r.study, r.number): r.running_max for r in trials.trial_running_max(history).collect()}
    assert [got["s", i] for i in range(5)] == [0.0, 0.0, 0.5, 0.5, 0.5]
    assert got["f", 8] == 0.0
    best = {r.study: (r.number, r.value) for r in trials.best_trial(history).collect()}
    assert best == {"s": (2, 0.5), "f": (7, None)}


def test_named_searches_draw_the_default_number_of_points(spark, monkeypatch):
    class Drawn(Exception):
        pass

    def draw(count, *_):
        raise Drawn(count)

    monkeypatch.setattr(learning, "sample_params", draw)
    for name in ("tune", "churn_training"):
        with pytest.raises(Drawn, match="^50$"):
            registry.learning_queries()[name](spark, "/root/testdata/sf0.001")
