"""Churn model: splits, tuning, training, explanation, storage and run records."""

from __future__ import annotations

import json
import math
import random
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shopgauge.functions.columns import array_round, half_up
from shopgauge.functions.ordering import lay_out, with_rank
from shopgauge.operators import boosting
from shopgauge.operators.boosting import Settings, Tree
from shopgauge.operators.model_metrics import binary_metrics, roc_auc
from shopgauge.schema import FEATURES, LABEL, PERSON
from shopgauge.session import materialize, scratch_path

SEED = 42
TEST_PERCENT = 20
FOLDS = 3
# Points of the search space that tuning tries, unless the caller gives a number.
TRIALS = 50

# Search space of the tuning, as (low, high, kind).
SEARCH_SPACE: dict[str, tuple[float, float, str]] = {
    "n_estimators": (50, 300, "int"),
    "max_depth": (3, 10, "int"),
    "learning_rate": (0.01, 0.3, "log"),
    "subsample": (0.6, 1.0, "float"),
    "colsample_bytree": (0.6, 1.0, "float"),
    "min_child_weight": (1, 10, "int"),
    "gamma": (0.0, 5.0, "float"),
    "reg_alpha": (0.0, 10.0, "float"),
    "reg_lambda": (0.0, 10.0, "float"),
    "scale_pos_weight": (1.0, 10.0, "float"),
}


def shuffle_key(seed: int | str) -> Column:
    """A reproducible random order of persons, the same however the rows are partitioned."""
    return F.md5(F.concat_ws("#", F.col(PERSON).cast("string"), F.lit(str(seed))))


def _shuffled_within_label(features: DataFrame, seed: int) -> DataFrame:
    """Rows with their random rank ``rk`` and the count ``n`` of their label."""
    keyed = features.withColumn("_key", shuffle_key(seed))
    return with_rank(lay_out(keyed, ["_key", PERSON], by=[LABEL]), [LABEL], groups=2)


def stratified_split(features: DataFrame, test_percent: int = TEST_PERCENT, seed: int = SEED) -> DataFrame:
    """Add ``part``: exactly ``test_percent`` of each label, rounded, are ``test``, the rest ``train``."""
    ranked = _shuffled_within_label(features, seed)
    wanted = half_up(F.col("n") * test_percent, F.lit(100))
    return ranked.withColumn("part", F.when(F.col("rk") <= wanted, "test").otherwise("train")).select(
        *features.columns, "part"
    )


def stratified_folds(features: DataFrame, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` (0..folds-1); the folds of a label differ by one row at most."""
    ranked = _shuffled_within_label(features, seed)
    return ranked.withColumn("fold", ((F.col("rk") - 1) % folds).cast("int")).select(*features.columns, "fold")


@dataclass
class ChurnModel:
    """Fitted trees with what is needed to use and describe them."""

    trees: list[Tree]
    feature_names: list[str]
    metrics: dict[str, float] = field(default_factory=dict)
    params: dict[str, float] = field(default_factory=dict)

    def _features(self) -> list[Column]:
        return [F.col(name) for name in self.feature_names]

    def margin(self) -> Column:
        return boosting.margin_by_batch(self.trees, self._features())

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``probability`` of churn."""
        return rows.select("*", (F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))).alias("probability"))

    def attributed(self, rows: DataFrame) -> DataFrame:
        """Add ``attribution``: an array of what each feature adds to the margin, and last what every person starts from."""
        return rows.select("*", boosting.attribution(self.trees, self._features()).alias("attribution"))


#: Persons of a fit inside one task; more are fitted in passes over all tasks, with the same trees as the result. A caller may
#: have up to so many for each task fitted by all tasks together instead: not by default, as an exchange was measured to take
#: longer than a pass. Tasks that work together hold some persons at least.
IN_TASK, TOGETHER, LEAST_SHARE = 200_000, 0, 25_000
#: Bytes of all tasks' sums of a level, up to which they are exchanged.
MOST_EXCHANGED = 1 << 28
#: Persons of a fit of the search inside one task, which holds some 150 bytes of each while it works. The fits of more are made
#: by all tasks in passes, one fit after the other.
SEARCH_IN_TASK = 4_000_000
#: Persons that tuning looks at: all, unless a caller gives a number.
SAMPLE: int | None = None


def _narrow(rows: DataFrame, names: Sequence[str], *others: Column) -> DataFrame:
    key = F.xxhash64(PERSON).alias("_key")
    return rows.select(key, F.col(LABEL).cast("int").alias("_y"), *others, *[F.col(n).cast("double").alias(n) for n in names])


def _fit_in_task(rows: DataFrame, names: Sequence[str], settings: Settings) -> list[Tree]:
    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(batches))
        trees = boosting.grow(whole["_key"].to_numpy(), whole[list(names)].to_numpy(float), whole["_y"].to_numpy(), settings)
        yield boosting.to_pandas(trees)

    return boosting.from_frame(_narrow(rows, names).coalesce(1).mapInPandas(grown, boosting.TREES_SCHEMA))


def _room(spark: SparkSession) -> int:
    """Tasks that the cluster surely runs at once; none where executors come and go."""
    context = spark.sparkContext
    conf = context.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    parallelism = context.defaultParallelism
    if conf.contains("spark.default.parallelism") and not context.master.startswith("local["):
        executors = max(context._jsc.sc().getExecutorMemoryStatus().size() - 1, 1)
        parallelism = min(parallelism, executors * int(conf.get("spark.executor.cores", "1")))
    return parallelism // int(conf.get("spark.task.cpus", "1"))


def fit(rows: DataFrame, params: dict[str, float], seed: int = SEED, in_task: int = IN_TASK, together: int = TOGETHER) -> ChurnModel:
    """The model of all rows. It depends neither on their order nor on tasks, nor on where its sums are made."""
    names = [c for c in rows.columns if c in FEATURES]
    settings, count = Settings.of(params, seed), rows.count()
    tasks = min(_room(rows.sparkSession), -(-count // LEAST_SHARE))
    if count <= in_task:
        trees = _fit_in_task(rows, names, settings)
    elif count <= tasks * together and tasks * boosting.message_bytes(len(names), settings) <= MOST_EXCHANGED:
        trees = boosting.fit_together(rows, names, PERSON, LABEL, settings, tasks)
    else:
        cores = rows.sparkSession.sparkContext.defaultParallelism
        trees = boosting.fit(rows, names, PERSON, LABEL, settings, cores * -(-count // (cores * boosting.TASK_ROWS)) or cores)
    return ChurnModel(trees, names, params=dict(params))


def train(
    train_rows: DataFrame, test_rows: DataFrame, params: dict[str, float] | None = None, in_task: int = IN_TASK
) -> ChurnModel:
    """Fit on the training rows and measure on the test rows."""
    model = fit(train_rows, params or {}, in_task=in_task)
    scored = materialize(model.score(test_rows).select(LABEL, "probability"), "scored")
    model.metrics = binary_metrics(scored, LABEL, "probability").first().asDict()
    return model


def sample_params(count: int, space: dict[str, tuple[float, float, str]] | None = None, seed: int = SEED) -> list[dict]:
    """Seeded random points of the search space."""
    draw = random.Random(seed)
    points = []
    for _ in range(count):
        point = {}
        for name, (low, high, kind) in (space or SEARCH_SPACE).items():
            if kind == "int":
                point[name] = draw.randint(int(low), int(high))
            elif kind == "log":
                point[name] = math.exp(draw.uniform(math.log(low), math.log(high)))
            else:
                point[name] = draw.uniform(low, high)
        points.append(point)
    return points


def sampled(rows: DataFrame, most: int | None, seed: int = SEED) -> DataFrame:
    """All persons, or the ``most`` with the smallest hashes of their ids if a caller asks for so many only."""
    return rows if most is None else rows.orderBy(F.xxhash64(PERSON, F.lit(seed)), PERSON).limit(most)


def _auc(margin: np.ndarray, y: np.ndarray) -> float:
    """Share of (positive, negative) pairs in the right order, ties counting half; NaN if a class is missing."""
    _, place, count = np.unique(margin, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(count) - (count - 1) / 2)[place]
    positives, negatives = int((y == 1).sum()), int((y != 1).sum())
    if not positives or not negatives:
        return float("nan")
    return float((ranks[y == 1].sum() - positives * (positives + 1) / 2) / (positives * negatives))


LEDGER_SCHEMA = "study string, point string, fold int, value double"


def _point_key(point: dict) -> str:
    return json.dumps(point, sort_keys=True)


def study_key(rows: DataFrame, folds: int, seed: int, most: int | None) -> str:
    """Name of a search by what its values depend on: the rows, whatever their order, and how they are cut and sampled."""
    content = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("digest")
    ).first()
    return f"{content.n}:{content.digest}:{folds}:{seed}:{most}"


def _finished(spark: SparkSession, ledger: str, study: str) -> dict[tuple[str, int], float]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {}
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where(F.col("study") == study).collect()
    return {(r.point, r.fold): r.value for r in rows}


def _fits(points: list[dict], folds: int, done: dict) -> list[tuple[dict, int, dict[int, str]]]:
    """(parameters, fold, {number of trees: point}) of the fits that are left, the longest first.

    Points that differ in the number of trees only share a fit: its beginnings are the smaller models.
    """
    left: dict[tuple[str, int], tuple[dict, int, dict[int, str]]] = {}
    for point in points:
        for fold in range(folds):
            if (_point_key(point), fold) in done:
                continue
            rest = {k: v for k, v in point.items() if k != "n_estimators"}
            trees = int(point.get("n_estimators", Settings.trees))
            left.setdefault((_point_key(rest), fold), (rest, fold, {}))[2][trees] = _point_key(point)
    return sorted(left.values(), key=lambda f: -max(f[2]) * f[0].get("max_depth", Settings.depth))


def tune(
    train_rows: DataFrame, count: int = TRIALS, space: dict | None = None, folds: int = FOLDS, seed: int = SEED,
    ledger: str | None = None, most: int | None = SAMPLE, wave: int | None = None, in_task: int = SEARCH_IN_TASK,
) -> tuple[list[dict], dict]:
    """Mean cross-validated ROC-AUC of random parameter points; returns the trials and the best point.

    All points share the stratified folds of all persons (of ``most``, if given), which are written once as bins. A task
    reads them for one fit and gives the values of all points that differ in the number of trees only; over more than
    ``in_task`` persons all tasks make a fit together. The values of each ``wave`` of fits (four for each core, or one that
    all make together, unless given) are appended to the ``ledger``, and a later call over the same rows makes those fits
    only that are not found there.
    """
    spark = train_rows.sparkSession
    points = sample_params(count, space, seed)
    names = [c for c in train_rows.columns if c in FEATURES]
    ledger = ledger or scratch_path(spark, "trial-ledger")
    study = study_key(train_rows, folds, seed, most)
    done = _finished(spark, ledger, study)
    waiting = _fits(points, folds, done)
    if waiting:
        data = _folded(stratified_folds(sampled(train_rows, most, seed), folds, seed), names, folds, in_task)
        wave = wave or (4 * spark.sparkContext.defaultParallelism if data.blocks else 1)
        for at in range(0, len(waiting), wave):
            values = _cross_validated(spark, data, waiting[at : at + wave], study, seed)
            values.coalesce(1).write.mode("append").parquet(ledger)
        done = _finished(spark, ledger, study)
    trials = [
        {
            "number": i, "value": round(sum(done[_point_key(point), fold] for fold in range(folds)) / folds, 6),
            "params": point, "state": "COMPLETE",
        }
        for i, point in enumerate(points)
    ]
    best = max(trials, key=lambda t: (t["value"], -t["number"]))
    return trials, best["params"]


@dataclass
class _Folded:
    """Written persons with their folds; and, for fits inside tasks, the cuts of the persons outside of each fold, and blocks of
    keys, labels, folds and bins by each fold's cuts."""

    rows: DataFrame
    names: list[str]
    cuts: list[list[np.ndarray]] = field(default_factory=list)
    blocks: DataFrame | None = None


def _folded(folded: DataFrame, names: list[str], folds: int, in_task: int) -> _Folded:
    rows = materialize(folded.select(PERSON, LABEL, "fold", *names), "folds")
    count = rows.count()
    if count > in_task:
        return _Folded(rows, names)
    narrow = _narrow(rows, names, F.col("fold"))
    cuts = _fold_cuts(narrow, names, folds, count)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[names].to_numpy(float)
            kinds = (("_key", np.int64), ("_y", np.int8), ("fold", np.int32))
            block = {name: [batch[name].to_numpy(kind).tobytes()] for name, kind in kinds}
            yield pd.DataFrame({**block, **{f"bins{k}": [boosting.bins_of(values, c).tobytes()] for k, c in enumerate(cuts)}})

    schema = ", ".join(f"{name} binary" for name in ("_key", "_y", "fold", *(f"bins{k}" for k in range(folds))))
    return _Folded(rows, names, cuts, materialize(narrow.mapInPandas(pack, schema), "fold-blocks"))


def _fold_cuts(narrow: DataFrame, names: list[str], folds: int, count: int) -> list[list[np.ndarray]]:
    """The cuts of the persons outside of each fold."""
    if count > IN_TASK:
        return [boosting.cuts_in(narrow.where(F.col("fold") != fold), names) for fold in range(folds)]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in [pd.concat(held)] if (held := list(batches)) else []:
            values, at = whole[names].to_numpy(float), whole["fold"].to_numpy()
            cuts = [(fold, f, c) for fold in range(folds) for f, c in enumerate(boosting.cuts_of(values[at != fold]))]
            yield pd.DataFrame(cuts, columns=["fold", "f", "cuts"])

    rows = narrow.coalesce(1).mapInPandas(found, "fold int, f int, cuts array<double>").collect()
    made = {(r.fold, r.f): np.array(r.cuts) for r in rows}
    return [[made.get((fold, f), np.zeros(0)) for f in range(len(names))] for fold in range(folds)]


def _cross_validated(spark: SparkSession, data: _Folded, fits: list[tuple[dict, int, dict[int, str]]], study: str, seed: int) -> DataFrame:
    """A row for each point and fold, by one task for each fit. Written, so that a fit is made once."""
    if data.blocks is None:
        return _cross_validated_in_passes(spark, data, fits, study, seed)

    def values(fit: tuple[dict, int, dict[int, str]]) -> DataFrame:
        (rest, held_out, stages), cuts = fit, data.cuts[fit[1]]

        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [block for batch in batches for block in batch.itertuples(index=False, name=None)]

            def column(at: int, kind: type) -> np.ndarray:
                return np.concatenate([np.zeros(0, kind), *(np.frombuffer(block[at], kind) for block in held)])

            keys, y, fold, bins = column(0, np.int64), column(1, np.int8), column(2, np.int32), column(3, np.uint8)
            del held
            bins, fitted, test = bins.reshape(len(y), len(cuts)), fold != held_out, fold == held_out
            settings = Settings.of({**rest, "n_estimators": max(stages)}, seed)
            trees, wanted = boosting.grow_binned(keys[fitted], bins[fitted], y[fitted], cuts, settings), sorted(stages)
            aucs = [_auc(margin, y[test]) for margin in boosting.staged_binned(trees, bins[test], wanted)]
            yield pd.DataFrame({"study": study, "point": [stages[n] for n in wanted], "fold": held_out, "value": aucs})

        return data.blocks.select("_key", "_y", "fold", f"bins{held_out}").coalesce(1).mapInPandas(made, LEDGER_SCHEMA)

    # Spark would take frames of one part each for one part together, and make all fits in one task.
    setting = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(setting, "true")
    spark.conf.set(setting, "false")
    try:
        return materialize(reduce(DataFrame.union, map(values, fits)), "trial-values")
    finally:
        spark.conf.set(setting, before)


def _cross_validated_in_passes(spark: SparkSession, data: _Folded, fits: list[tuple[dict, int, dict[int, str]]], study: str, seed: int) -> DataFrame:
    """The same values of fits over more persons than a task holds."""
    found = []
    for rest, held_out, stages in fits:
        model = fit(data.rows.where(F.col("fold") != held_out), {**rest, "n_estimators": max(stages)}, seed)
        for count, point in stages.items():
            margin = ChurnModel(model.trees[:count], model.feature_names).margin()
            scored = materialize(data.rows.where(F.col("fold") == held_out).select(LABEL, margin.alias("margin")), "scored")
            value = roc_auc(scored, LABEL, "margin").first().roc_auc
            found.append((study, point, held_out, float("nan") if value is None else float(value)))
    return spark.createDataFrame(found, LEDGER_SCHEMA)


def trials_frame(spark: SparkSession, trials: list[dict]) -> DataFrame:
    rows = [(t["number"], t["value"], {k: float(v) for k, v in t["params"].items()}, t["state"]) for t in trials]
    return spark.createDataFrame(rows, "number long, value double, params map<string, double>, state string")


def feature_importance(spark: SparkSession, model: ChurnModel) -> DataFrame:
    importance = boosting.importance(model.trees, len(model.feature_names))
    rows = [(name, float(value)) for name, value in zip(model.feature_names, importance)]
    return (
        spark.createDataFrame(rows, "feature string, importance double")
        .withColumn("importance", array_round("importance", 4))
        .orderBy(F.desc("importance"), "feature")
    )


def permutation_importance(model: ChurnModel, rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Loss of ROC-AUC when one feature takes the value of another, random row.

    Every row is paired with its successor in a random order (one ranking, one join on the rank). Each row
    is then scored once as it is and once per feature with the partner's value.
    """
    names = model.feature_names
    ordered = lay_out(rows.select(PERSON, LABEL, *names, shuffle_key(seed).alias("_key")), ["_key", PERSON])
    ranked = materialize(with_rank(ordered).select(LABEL, "rk", "n", *names), "ranked")
    partner = ranked.select(
        (F.col("rk") % F.col("n") + 1).alias("rk"), F.struct(*names).alias("other")
    )
    variants = ranked.join(partner, "rk").withColumn(
        "feature", F.explode(F.array(F.lit(""), *[F.lit(name) for name in names]))
    )
    swapped = variants.select(
        "feature", LABEL,
        *[F.when(F.col("feature") == name, F.col(f"other.{name}")).otherwise(F.col(name)).alias(name) for name in names],
    )
    aucs = materialize(
        roc_auc(model.score(swapped).select("feature", LABEL, "probability"), LABEL, "probability", by=["feature"]),
        "importance",
    )
    whole = aucs.where(F.col("feature") == "").select("roc_auc").scalar()
    return (
        aucs.where(F.col("feature") != "")
        .select("feature", array_round(whole - F.col("roc_auc"), 4).alias("auc_drop"))
        .orderBy(F.desc("auc_drop"), "feature")
    )


def mean_attribution(model: ChurnModel, rows: DataFrame) -> DataFrame:
    """Per feature: mean and mean size of what it adds to the margins of the persons, the largest first.

    ``ChurnModel.attributed`` has the attributions of every person; they sum to that person's margin.
    """
    each = model.attributed(rows).select(F.posexplode(F.slice("attribution", 1, len(model.feature_names))).alias("at", "value"))
    means = each.groupBy("at").agg(F.avg(F.abs("value")).alias("mean_size"), F.avg("value").alias("mean"))
    names = F.array(*[F.lit(name) for name in model.feature_names])
    return means.select(
        names[F.col("at")].alias("feature"), array_round("mean_size", 4).alias("mean_size"), array_round("mean", 4).alias("mean")
    ).orderBy(F.desc("mean_size"), "feature")


_META = "feature_names array<string>, metrics map<string, double>, params map<string, double>"


def save_model(model: ChurnModel, path: str) -> None:
    spark = SparkSession.active()
    boosting.to_frame(spark, model.trees).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    params = {k: float(v) for k, v in model.params.items()}
    meta = spark.createDataFrame([(model.feature_names, model.metrics, params)], _META)
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(path: str) -> ChurnModel:
    read = SparkSession.active().read
    meta = read.schema(_META).parquet(f"{path}/meta").first()
    trees = boosting.from_frame(read.schema(boosting.TREES_SCHEMA).parquet(f"{path}/trees"))
    return ChurnModel(trees, meta.feature_names, meta.metrics, meta.params)


RUN_SCHEMA = (
    "run_id string, run_name string, ts timestamp, params map<string, double>, "
    "metrics map<string, double>, features array<string>"
)


def log_run(spark: SparkSession, model: ChurnModel, path: str, run_name: str = "churn-model") -> str:
    """Append one record to the table of training runs."""
    run_id = uuid.uuid4().hex
    params = {k: float(v) for k, v in model.params.items()}
    row = spark.createDataFrame(
        [(run_id, run_name, None, params, model.metrics, model.feature_names)], RUN_SCHEMA
    ).withColumn("ts", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(path)
    return run_id


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


@dataclass
class TrainingRun:
    model: ChurnModel
    trials: list[dict]
    importance: DataFrame
    run_id: str


def churn_training(features: DataFrame, folder: str, trials: int = TRIALS, space: dict | None = None) -> TrainingRun:
    """Split, tune, train, record, save and explain, from a written feature table.

    The fits of the search are kept in ``folder``, so a run that was broken off goes on from there.
    """
    spark = features.sparkSession
    split = materialize(stratified_split(features), "split")
    train_rows = split.where(F.col("part") == "train").drop("part")
    test_rows = split.where(F.col("part") == "test").drop("part")
    history, best = tune(train_rows, trials, space, ledger=f"{folder}/fits")
    model = train(train_rows, test_rows, best)
    run_id = log_run(spark, model, f"{folder}/runs")
    save_model(model, f"{folder}/churn_model")
    trials_frame(spark, history).write.mode("overwrite").json(f"{folder}/trials")
    return TrainingRun(model, history, permutation_importance(model, test_rows), run_id)
