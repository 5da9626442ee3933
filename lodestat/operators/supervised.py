"""Supervised learning on MLlib, and evaluation by aggregation."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Binarizer, Imputer, MinMaxScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions import columns as C
from lodestat.functions import ordering as O
from lodestat.operators import describe as D
from lodestat.session import stored

SEED = 42


# ---- task, split, preparation ------------------------------------------------


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """``(task, n_distinct, n_rows)``: numeric targets with few values are classes."""
    counts = df.where(~C.missing(df, target)).groupBy(target).agg(F.count(F.lit(1)).alias("c"))
    one = counts.agg(F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"))
    few = (F.col("n_distinct") <= 10) & (F.col("n_distinct") < 0.1 * F.col("n_rows"))
    classes = few if target in C.numeric_columns(df) else F.lit(True)
    return one.select(F.when(classes, "classification").otherwise("regression").alias("task"), "n_distinct", "n_rows")


def hash_order(key: list[str], seed: int | Column = SEED) -> Column:
    mark = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", mark, *[F.col(k).cast("string") for k in key]))


def split_train_test(
    df: DataFrame, key: list[str], test: float = 0.2, label: str | None = None, seed: int = SEED
) -> DataFrame:
    """Add ``split``: the first share of each class in hash order tests. Same result on any partitioning."""
    keys = [label] if label else []
    pos = O.with_position(df.withColumn("_h", hash_order(key, seed)), ["_h", *key], keys, "_pos", "_n")
    is_test = F.col("_pos") < F.floor(F.col("_n") * test)
    return pos.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_h", "_pos", "_n")


def parts(df: DataFrame, key: list[str], test: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test by hash bucket of the key: a narrow filter, no shuffle."""
    bucket = C.key_bucket(key, 10_000, seed)
    cut = int(test * 10_000)
    return df.where(bucket >= cut), df.where(bucket < cut)


def feature_stages(df: DataFrame, columns: list[str], scale: str = "standard") -> list:
    """Median fill, label codes (unseen as a further code), assembly and scaling."""
    strings = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    numbers = [c for c in columns if c not in strings]
    stages = []
    if numbers:
        stages.append(Imputer(strategy="median", inputCols=numbers, outputCols=[f"_i_{c}" for c in numbers]))
    if strings:
        stages.append(
            StringIndexer(
                inputCols=strings, outputCols=[f"_i_{c}" for c in strings], handleInvalid="keep", stringOrderType="alphabetAsc"
            )
        )
    stages.append(VectorAssembler(inputCols=[f"_i_{c}" for c in columns], outputCol="_raw", handleInvalid="keep"))
    if scale == "standard":
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True))
    else:
        stages.append(MinMaxScaler(inputCol="_raw", outputCol="features"))
    return stages


def prepare_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Prepared feature values as an array column beside the input.

    Missing numbers become the median, missing strings the most frequent one of the column, ``unknown`` if it has none.
    """
    from lodestat.operators.typing import fill_missing

    strings = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    filled = df.withColumns({f"_own_{c}": F.col(c) for c in strings})
    if strings:
        filled = fill_missing(filled, strings, "mode").fillna("unknown", subset=strings)
    model = Pipeline(stages=feature_stages(filled, columns)).fit(filled)
    out = model.transform(filled).withColumn("prepared", vector_to_array("features"))
    return out.select(*[F.col(f"_own_{c}" if c in strings else c).alias(c) for c in df.columns], "prepared")


# ---- training ----------------------------------------------------------------


def classifier(name: str, n_classes: int = 2, n_features: int | None = None, **params):
    args = {"featuresCol": "features", "labelCol": "label", **params}
    if name == "logistic":
        return LogisticRegression(**{"maxIter": 50, **args})
    if name == "random_forest":
        return RandomForestClassifier(**{"numTrees": 20, "maxDepth": 5, "seed": SEED, **args})
    if name == "gradient_boosting":
        base = GBTClassifier(**{"maxIter": 10, "maxDepth": 3, "seed": SEED, **args})
        return base if n_classes == 2 else OneVsRest(classifier=base, featuresCol="features", labelCol="label")
    if name == "linear_svm":
        base = LinearSVC(**{"maxIter": 30, **args})
        return base if n_classes == 2 else OneVsRest(classifier=base, featuresCol="features", labelCol="label")
    if name.startswith("naive_bayes"):
        kind = name.partition("_")[2].partition("_")[2] or "gaussian"
        return NaiveBayes(**{"modelType": kind, **args})
    if name == "mlp":
        layers = [n_features, 16, n_classes]
        return MultilayerPerceptronClassifier(**{"layers": layers, "maxIter": 50, "seed": SEED, **args})
    raise ValueError(f"unknown classifier {name}")


def regressor(name: str, alpha: float = 1.0, l1_ratio: float = 0.5, **params):
    args = {"featuresCol": "features", "labelCol": "label", **params}
    if name == "linear":
        return LinearRegression(**{"maxIter": 100, **args})
    if name in ("ridge", "lasso", "elastic_net"):
        mix = {"ridge": 0.0, "lasso": 1.0, "elastic_net": l1_ratio}[name]
        return LinearRegression(**{"regParam": alpha, "elasticNetParam": mix, "standardization": False, "maxIter": 100, **args})
    if name == "random_forest":
        return RandomForestRegressor(**{"numTrees": 20, "maxDepth": 5, "seed": SEED, **args})
    if name == "gradient_boosting":
        return GBTRegressor(**{"maxIter": 10, "maxDepth": 3, "seed": SEED, **args})
    raise ValueError(f"unknown regressor {name}")


def _classes(df: DataFrame, target: str, limit: int = 1000) -> list:
    got = [r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"{target} has more than {limit} classes")
    return sorted(got)


def with_label(df: DataFrame, target: str, classes: list | None) -> DataFrame:
    """Double ``label``: position in the sorted classes, or the value itself."""
    if classes is None:
        return df.where(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double"))
    spot = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target))
    return df.where(F.col(target).isNotNull()).withColumn("label", (spot - 1).cast("double"))


def fit_classifier(df: DataFrame, columns: list[str], target: str, name: str, **params) -> tuple[PipelineModel, list]:
    classes = _classes(df, target)
    scale = "minmax" if name in ("naive_bayes_multinomial", "naive_bayes_bernoulli", "mlp") else "standard"
    stages = feature_stages(df, columns, scale)
    if name == "naive_bayes_bernoulli":
        stages[-1].setOutputCol("_scaled")
        stages.append(Binarizer(threshold=0.5, inputCol="_scaled", outputCol="features"))
    model = classifier(name, len(classes), len(columns), **params)
    return Pipeline(stages=[*stages, model]).fit(with_label(df, target, classes)), classes


def fit_regressor(df: DataFrame, columns: list[str], target: str, name: str, **params) -> PipelineModel:
    return Pipeline(stages=[*feature_stages(df, columns), regressor(name, **params)]).fit(with_label(df, target, None))


def _prepared(train: DataFrame, test: DataFrame, columns: list[str], scale: str) -> list[DataFrame]:
    """Features of both parts from one fitted preparation, cached for several fits."""
    model = Pipeline(stages=feature_stages(train, columns, scale)).fit(train)
    return [model.transform(d).select("features", "label").persist() for d in (train, test)]


def train_classifier(df: DataFrame, columns: list[str], target: str, key: list[str], names: list[str]) -> DataFrame:
    """Held-out accuracy and F1 of each algorithm; the features are prepared once per scaling."""
    classes = _classes(df, target)
    train, test = parts(with_label(df, target, classes), key)
    ready, rows = {}, []
    for name in names:
        scale = "minmax" if name in ("naive_bayes_multinomial", "naive_bayes_bernoulli", "mlp") else "standard"
        if scale not in ready:
            ready[scale] = _prepared(train, test, columns, scale)
        fit_on, score_on = ready[scale]
        if name == "naive_bayes_bernoulli":
            binary = Binarizer(threshold=0.5, inputCol="features", outputCol="_bin")
            fit_on, score_on = (binary.transform(d).drop("features").withColumnRenamed("_bin", "features") for d in (fit_on, score_on))
        model = classifier(name, len(classes), len(columns)).fit(fit_on)
        rows.append((name, *classification_summary(model.transform(score_on)).first()))
    for pair in ready.values():
        for d in pair:
            d.unpersist()
    spec = "model string, accuracy double, n long, macro_precision double, weighted_precision double, macro_recall double, weighted_recall double, macro_f1 double, weighted_f1 double"
    return df.sparkSession.createDataFrame(rows, spec)


def train_regressor(df: DataFrame, columns: list[str], target: str, key: list[str], names: list[str]) -> DataFrame:
    train, test = parts(with_label(df, target, None), key)
    fit_on, score_on = _prepared(train, test, columns, "standard")
    rows = []
    for name in names:
        rows.append((name, *regression_scores(regressor(name).fit(fit_on).transform(score_on)).first()))
    fit_on.unpersist()
    score_on.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, r2 double, mse double, rmse double, mae double, explained_variance double")


def regression_scores(scored: DataFrame) -> DataFrame:
    """One row ``(r2, mse, rmse, mae, var)`` as MLlib's evaluator defines them, all from one pass over ``label`` and ``prediction``."""
    y, p = F.col("label"), F.col("prediction")
    mse, gap = F.avg((y - p) * (y - p)), F.avg(p) - F.avg(y)
    # in double arithmetic, so that a constant label gives what the evaluator gives
    r2 = 1 - F.coalesce(F.try_divide(mse, F.var_pop(y)), F.when(mse > 0, float("inf")).otherwise(float("nan")))
    return scored.agg(r2.alias("r2"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"), (F.var_pop(p) + gap * gap).alias("var"))


def linear_coefficients(df: DataFrame, x: str, y: str) -> DataFrame:
    """One-feature least squares in closed form."""
    return df.agg(F.regr_slope(C.number(df, y), C.number(df, x)).alias("slope"), F.regr_intercept(C.number(df, y), C.number(df, x)).alias("intercept"))


def cross_validate(df: DataFrame, columns: list[str], target: str, key: list[str], name: str, task: str = "classification", folds: int = 5) -> DataFrame:
    """Mean and std of the metric over key-hash folds."""
    rows = []
    data = df.withColumn("_fold", C.key_bucket(key, folds, SEED + 1))
    for f in range(folds):
        train, test = data.where(F.col("_fold") != f).drop("_fold"), data.where(F.col("_fold") == f).drop("_fold")
        if task == "classification":
            model, classes = fit_classifier(train, columns, target, name)
            value = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(with_label(test, target, classes)))
        else:
            value = RegressionEvaluator(metricName="r2").evaluate(fit_regressor(train, columns, target, name).transform(with_label(test, target, None)))
        rows.append((f, float(value)))
    scores = df.sparkSession.createDataFrame(rows, "fold int, score double")
    return scores.crossJoin(scores.agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score")))


# fixed values: search grids by model
GRIDS = {
    "logistic": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 1.0]},
    "random_forest": {"numTrees": [10, 20], "maxDepth": [3, 5]},
    "ridge": {"regParam": [0.1, 1.0, 10.0]},
    "lasso": {"regParam": [0.01, 0.1, 1.0]},
    "gradient_boosting": {"maxIter": [10, 20], "maxDepth": [3, 5], "stepSize": [0.05, 0.1]},
}


def tune(
    df: DataFrame, columns: list[str], target: str, key: list[str], name: str, task: str = "classification",
    method: str = "grid", iterations: int = 4, folds: int = 3, grid: dict | None = None, seed: int = SEED,
) -> DataFrame:
    """``(setting, <parameters as text>, mean_score, is_best)`` over the grid, or a random part of it."""
    if grid is None and name not in GRIDS:
        raise ValueError(f"no default grid for {name}; pass grid, or use one of {sorted(GRIDS)}")
    grid = grid or GRIDS[name]
    if task == "classification":
        classes = _classes(df, target)
        est, judge = classifier(name, len(classes), len(columns)), MulticlassClassificationEvaluator(metricName="accuracy")
    else:
        classes, est, judge = None, regressor(name), RegressionEvaluator(metricName="r2")
    settings = [dict(zip(grid, v)) for v in product(*grid.values())]
    if method == "random":
        pick = np.random.default_rng(seed).permutation(len(settings))[:iterations]
        settings = [settings[i] for i in sorted(pick)]
    maps = [{est.getParam(k): v for k, v in s.items()} for s in settings]
    data = with_label(df, target, classes).withColumn("_fold", C.key_bucket(key, folds, seed + 1))
    prepared = Pipeline(stages=feature_stages(df, columns)).fit(data).transform(data).select("features", "label", "_fold")
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol="_fold", parallelism=4, seed=seed)
    scores = cv.fit(prepared).avgMetrics
    best = int(np.argmax(scores))
    rows = [(i, k, str(v), float(scores[i]), i == best) for i, s in enumerate(settings) for k, v in s.items()]
    return df.sparkSession.createDataFrame(rows, "setting int, parameter string, value string, mean_score double, is_best boolean")


def parameter_importance(scores: DataFrame) -> DataFrame:
    """Spread of the mean score over the values of each parameter."""
    by_value = scores.groupBy("parameter", "value").agg(F.avg("mean_score").alias("m"))
    out = by_value.groupBy("parameter").agg(F.max("m").alias("best"), F.min("m").alias("worst"), F.max_by("value", "m").alias("best_value"))
    return out.withColumn("importance", F.col("best") - F.col("worst"))


# ---- classification metrics --------------------------------------------------


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("cnt"))


def class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """TP, FP, FN, TN, precision, recall, specificity, F1, support and share per class."""
    m = confusion_matrix(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(0)
    rows = m.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("cls"), F.col("cnt").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
                F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("cnt").alias("predicted"), F.lit(0).cast("long").alias("tp")),
            )
        )
    )
    g = rows.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("support").alias("n"))))
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    tn = F.col("n") - tp - fp - fn
    p, r = C.or_zero(C.ratio(tp, tp + fp)), C.or_zero(C.ratio(tp, tp + fn))
    return g.select(
        "cls",
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        tn.alias("tn"),
        p.alias("precision"),
        r.alias("recall"),
        C.or_zero(C.ratio(tn, tn + fp)).alias("specificity"),
        C.or_zero(C.ratio(2 * p * r, p + r)).alias("f1"),
        "support",
        C.ratio(F.col("support"), F.col("n")).alias("share"),
    )


def classification_summary(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy with macro and weighted precision, recall and F1; one row."""
    g = class_metrics(df, label, prediction)
    n = F.sum("support").cast("double")
    out = [(F.sum("tp") / n).alias("accuracy"), F.sum("support").alias("n")]
    for c in ("precision", "recall", "f1"):
        out += [F.avg(c).alias(f"macro_{c}"), (F.sum(F.col(c) * F.col("support")) / n).alias(f"weighted_{c}")]
    return g.agg(*out)


def confused_pairs(df: DataFrame, label: str = "label", prediction: str = "prediction", top: int = 5) -> DataFrame:
    m = confusion_matrix(df, label, prediction)
    sums = m.groupBy("label").agg(F.sum("cnt").alias("_n"))
    rows = m.join(sums, "label").where(F.col("label") != F.col("prediction"))
    return rows.withColumn("error_share", F.col("cnt") / F.col("_n")).drop("_n").orderBy(F.desc("cnt"), "label", "prediction").limit(top)


def roc_auc(df: DataFrame, label: Column, score: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from the rank sum of the positives; ties count half."""
    keys = keys or []
    rows = df.select(*keys, label.cast("int").alias("_l"), C.number(df, score).alias("value")).dropna(subset=["_l", "value"])
    counts = rows.groupBy(*keys, "value").agg(F.sum("_l").alias("pos_n"), F.count(F.lit(1)).alias("cnt"))
    ranked = O.cumulate(counts, "value", ["cnt"], keys)
    rank = F.col("cnt_before") + (F.col("cnt") + 1) / 2.0
    g = ranked.groupBy(*keys) if keys else ranked
    s = g.agg(F.sum(F.col("pos_n") * rank).alias("_r"), F.sum("pos_n").alias("positives"), F.sum("cnt").alias("n"))
    p = F.col("positives").cast("double")
    return s.withColumn("auc", C.ratio(F.col("_r") - p * (p + 1) / 2, p * (F.col("n") - p))).drop("_r")


def roc_auc_one_vs_rest(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """AUC per class from one score column per class, all classes in one pass."""
    rows = F.array(
        *[F.struct(F.lit(k).alias("cls"), (F.col(label) == k).cast("int").alias("_y"), F.col(c).cast("double").alias("_s")) for k, c in scores.items()]
    )
    return roc_auc(df.select(F.inline(rows)), F.col("_y"), "_s", ["cls"])


def confidence_bands(df: DataFrame, probability: str) -> DataFrame:
    """Statistics and bands of the top probability; ``probability`` is an array column."""
    p = F.array_max(probability)
    return df.select(p.alias("p")).agg(
        F.avg("p").alias("mean"),
        F.min("p").alias("min"),
        F.max("p").alias("max"),
        F.stddev_pop("p").alias("std"),
        F.count_if(F.col("p") > 0.9).alias("very_high"),
        F.count_if((F.col("p") > 0.7) & (F.col("p") <= 0.9)).alias("high"),
        F.count_if((F.col("p") > 0.5) & (F.col("p") <= 0.7)).alias("medium"),
        F.count_if(F.col("p") <= 0.5).alias("low"),
        F.count_if(F.col("p") > 0.8).alias("sure"),
        F.count_if(F.col("p") < 0.6).alias("unsure"),
    )


# ---- regression metrics ------------------------------------------------------


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row of error statistics with a grade."""
    y, f = C.number(df, label), C.number(df, prediction)
    rows = df.select(y.alias("y"), (y - f).alias("e")).dropna().withColumn("abs_e", F.abs("e"))
    basic = rows.agg(
        F.count(F.lit(1)).alias("n"),
        (1 - C.ratio(F.avg(F.col("e") ** 2), F.var_pop("y"))).alias("r2"),
        F.avg(F.col("e") ** 2).alias("mse"),
        F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"),
        F.avg("abs_e").alias("mae"),
        (F.avg(F.col("abs_e") / F.greatest(F.abs("y"), F.lit(1e-8))) * 100).alias("mape"),
        (1 - C.ratio(F.var_pop("e"), F.var_pop("y"))).alias("explained_variance"),
        F.max("abs_e").alias("max_error"),
    )
    q = O.exact_quantiles(rows, ["abs_e"], {"median_ae": 0.5, "p90_error": 0.9, "p95_error": 0.95}).drop("n", "column_name")
    grade = C.bands(F.col("r2"), [(0.9, "excellent"), (0.7, "good"), (0.5, "fair")], "poor")
    return basic.crossJoin(q).withColumn("grade", grade)


def residual_analysis(df: DataFrame, label: str, prediction: str, key: list[str]) -> DataFrame:
    """Residual moments, share beyond two std, and spread of the halves in prediction order."""
    e = (C.number(df, label) - C.number(df, prediction)).alias("e")
    rows = df.select(*key, C.number(df, prediction).alias("p"), e).dropna()
    stats = rows.agg(
        F.avg("e").alias("mean"),
        F.stddev_pop("e").alias("std"),
        F.skewness("e").alias("skewness"),
        F.min("e").alias("min"),
        F.max("e").alias("max"),
    )
    pos = O.with_position(rows, ["p", *key], None, "_pos", "_n").crossJoin(F.broadcast(stats.select(F.col("std").alias("_s"))))
    first = F.col("_pos") < F.ceil(F.col("_n") / 2)
    halves = pos.agg(
        F.count_if(F.abs("e") > 2 * F.col("_s")).alias("outliers"),
        F.stddev_pop(F.when(first, F.col("e"))).alias("first_std"),
        F.stddev_pop(F.when(~first, F.col("e"))).alias("second_std"),
    )
    a, b = F.col("first_std"), F.col("second_std")
    spread = C.ratio(F.greatest(a, b), F.least(a, b))
    return stats.crossJoin(halves).withColumns({"std_ratio": spread, "heteroscedastic": spread > 1.5})


def baseline_compare(train: DataFrame, test: DataFrame, label: str, prediction: str, task: str = "classification") -> DataFrame:
    """Model against the most frequent class or the mean of the training rows."""
    if task == "classification":
        top = train.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.min_by(label, F.struct(-F.col("c"), label)).alias("_base"))
        s = test.crossJoin(F.broadcast(top)).agg(
            F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("model_score"),
            F.avg((F.col(label) == F.col("_base")).cast("double")).alias("baseline_score"),
        )
        gain = C.ratio(F.col("model_score") - F.col("baseline_score"), F.col("baseline_score")) * 100
    else:
        y = C.number(test, label)
        mean = train.agg(F.avg(C.number(train, label)).alias("_base"))
        s = test.crossJoin(F.broadcast(mean)).agg(
            F.sqrt(F.avg((y - C.number(test, prediction)) ** 2)).alias("model_score"),
            F.sqrt(F.avg((y - F.col("_base")) ** 2)).alias("baseline_score"),
        )
        gain = C.ratio(F.col("baseline_score") - F.col("model_score"), F.col("baseline_score")) * 100
    return s.withColumn("improvement_pct", gain)


# ---- ensembles ---------------------------------------------------------------


def ensemble_vote(predictions: list[DataFrame], key: list[str], value: str = "prediction", kind: str = "mean") -> DataFrame:
    """Mean of the predictions, or the class with most votes (ties to the smaller)."""
    rows = predictions[0].select(*key, value)
    for p in predictions[1:]:
        rows = rows.unionByName(p.select(*key, value))
    if kind == "mean":
        return rows.groupBy(*key).agg(F.avg(value).alias("ensemble"), F.count(F.lit(1)).alias("models"))
    votes = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("v"), value)).alias("ensemble"), F.sum("v").alias("models"))


def ensemble_weighted(predictions: list[DataFrame], weights: list[float], key: list[str], value: str = "prediction") -> DataFrame:
    rows = None
    for p, w in zip(predictions, weights):
        part = p.select(*key, value, F.lit(float(w)).alias("_w"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*key).agg(C.ratio(F.sum(F.col(value) * F.col("_w")), F.sum("_w")).alias("ensemble"))


def ensemble_stacking(df: DataFrame, columns: list[str], target: str, key: list[str], names: list[str], folds: int = 3) -> DataFrame:
    """Linear meta-model on out-of-fold predictions; rows with every base and the final prediction.

    The features are prepared once per fold; the out-of-fold predictions are written, so that the meta-model doesn't score them anew.
    """
    data = with_label(df, target, None).select(*dict.fromkeys([*key, target, *columns]), "label").withColumn("_fold", C.key_bucket(key, folds, SEED + 1))
    out = None
    for f in range(folds):
        train, held = data.where(F.col("_fold") != f), data.where(F.col("_fold") == f)
        prepare = Pipeline(stages=feature_stages(train, columns)).fit(train)
        fit_on = prepare.transform(train).select("features", "label").persist()
        rows = prepare.transform(held).select(*dict.fromkeys([*key, target]), "label", "features")
        for name in names:
            model = regressor(name).fit(fit_on)
            rows = model.transform(rows).withColumnRenamed("prediction", f"base_{name}")
        fit_on.unpersist()
        rows = rows.drop("features")
        out = rows if out is None else out.unionByName(rows)
    base = [f"base_{n}" for n in names]
    meta = VectorAssembler(inputCols=base, outputCol="_meta").transform(stored(out))
    model = LinearRegression(featuresCol="_meta", labelCol="label", maxIter=50).fit(meta)
    return model.transform(meta).select(*key, target, *base, "prediction")


# ---- interpretation ----------------------------------------------------------


def importance_model(df: DataFrame, columns: list[str], target: str, name: str = "random_forest", task: str = "classification") -> DataFrame:
    """Model importances (tree gain or absolute coefficients) ranked with cumulative share."""
    if task == "classification":
        model, _ = fit_classifier(df, columns, target, name)
    else:
        model = fit_regressor(df, columns, target, name)
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        v = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        v = np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    else:
        v = np.abs(last.coefficients.toArray())
    rows = df.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(columns, v)], "column_name string, importance double")
    return analyze_importance(rows)


def analyze_importance(rows: DataFrame) -> DataFrame:
    """Rank, cumulative share, name-prefix group and high / low quartile group; one row per feature."""
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.desc(F.abs("importance")), "column_name")
    size = F.abs("importance")
    q75, q25 = F.percentile(size, F.lit(0.75)).over(one), F.percentile(size, F.lit(0.25)).over(one)
    return rows.select(
        "column_name",
        "importance",
        F.row_number().over(order).alias("rank"),
        C.ratio(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum(size).over(one)).alias("cumulative"),
        F.split("column_name", "_")[0].alias("prefix"),
        F.when(size >= q75, "high").when(size <= q25, "low").otherwise("medium").alias("tier"),
    )


def importance_permutation(
    df: DataFrame, columns: list[str], target: str, key: list[str], name: str = "random_forest", repeats: int = 10, seed: int = SEED
) -> DataFrame:
    """Drop of r2 when one column is shuffled.

    A shuffle pairs the i-th row by key with the i-th row in hash order, not
    by a driver permutation. All repeats and columns are scored in the same
    pass. If the paired rows repeat each other, they are written repeat by
    repeat, so that the disk holds the shuffle of one.
    """
    model = fit_regressor(df, columns, target, name)
    data = with_label(df, target, None).select(*key, *columns, "label")
    rows = stored(O.with_position(data, key, None, "_pos", None))
    n = rows.count()

    def r2(scored: DataFrame) -> dict[tuple[int, int], float]:
        gap = F.col("_y") - F.col("prediction")
        sums = scored.groupBy("_r", "_c").agg(F.sum(F.col("_yy") + F.col("_n") * gap * gap).alias("err")).crossJoin(F.broadcast(spread))
        with np.errstate(divide="ignore", invalid="ignore"):  # a constant label has no r2, as in MLlib's evaluator
            # one row per repeat and column
            return {(g["_r"], g["_c"]): float(1 - np.float64(g["err"]) / np.float64(g["tot"])) for g in sums.collect()}

    spread = rows.agg((F.var_pop("label") * F.count("label")).alias("tot"))
    one = {"_r": F.lit(-1), "_c": F.lit(-1), "_n": F.lit(1), "_y": F.col("label"), "_yy": F.lit(0.0)}
    base = r2(model.transform(rows.select(*columns, "label").withColumns(one)))[-1, -1]
    moved, few = None, True
    for r, part in enumerate(_paired(rows, n, columns, key, [seed + r for r in range(repeats)])):
        part = part.withColumn("_r", F.lit(r))
        if few:
            part = stored(part)
            few = r > 0 or part.count() <= n
        moved = part if moved is None else moved.unionByName(part)
    got = r2(model.transform(moved))
    drops = [(columns[i], r, base - score) for (r, i), score in got.items()]
    out = df.sparkSession.createDataFrame(drops, "column_name string, repeat int, drop double")
    return out.groupBy("column_name").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))


#: Rows that are paired in one group, and rows that a task deals out at once.
PAIR_ROWS, DEAL_ROWS = 1 << 18, 1 << 20


def _paired(rows: DataFrame, n: int, columns: list[str], key: list[str], seeds: list[int]) -> list[DataFrame]:
    """For each seed ``columns..., _n, _y, _yy, _c``: the row at each position ``_pos`` with column number ``_c`` of the row that has that place in hash order.

    Groups are ranges of the hash, and rows go to them packed by column: once by their hash and once by their position. Rows that a
    shuffle makes equal inside a group leave it once, with their number, the mean label and the label's squared deviations from it.
    """
    groups = min(1 << 16, -(-n // PAIR_ROWS))
    marks = [hash_order(key, seed) for seed in seeds]
    group = F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("long") * groups / (1 << 16)).cast("int")
    each = rows.select(F.posexplode(F.array(*marks)).alias("_r", "_h")).groupBy("_r", group.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    sizes = np.zeros((len(seeds), groups), np.int64)
    for g in each.collect():  # one row for each seed and group
        sizes[g["_r"], g["_b"]] = g["n"]
    held = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)

    def words(hashes) -> np.ndarray:  # 16 bytes each
        one = hashes.chunk(0)
        return np.frombuffer(one.buffers()[2], ">u8", 2 * len(one), 16 * one.offset).reshape(-1, 2).astype(np.uint64)

    def dealt(starts: np.ndarray):
        def pack(table, part: np.ndarray, own: bool):
            import pyarrow as pa

            order = np.argsort(part, kind="stable")
            table, part = table.take(pa.array(order)), part[order]
            at = np.flatnonzero(np.diff(part, prepend=-1))
            for i, j in zip(at, np.append(at[1:], len(part))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as w:
                    w.write_table(table.slice(i, j - i))
                yield int(part[i]), own, sink.getvalue().to_pybytes()

        def deal(batches):
            import pyarrow as pa

            def out(table):
                table = table.combine_chunks()  # rows taken from many pieces take long
                high = (words(table["_h"])[:, 0] >> np.uint64(48)).astype(np.int64)
                packed = [*pack(table.drop(["label", "_pos"]), high * groups >> 16, False)]
                pos = table["_pos"].to_numpy()
                part = np.searchsorted(starts, pos, "right") - 1
                own = table.drop(["_h", "_pos"]).append_column("_at", pa.array((pos - starts[part]).astype(np.int32)))
                packed += pack(own, part, True)
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*packed), (pa.int32(), pa.bool_(), pa.binary()))], ["_b", "_own", "_rows"])

            have, n = [], 0
            for batch in batches:
                have.append(batch)
                n += len(batch)
                if n >= DEAL_ROWS:
                    yield out(pa.Table.from_batches(have))
                    have, n = [], 0
            if n:
                yield out(pa.Table.from_batches(have))

        return deal

    def pair(table):
        import pyarrow as pa

        sides = []
        for own in (True, False):
            picked = [r for r, o in zip(table["_rows"], table["_own"].to_pylist()) if o == own]
            sides.append(pa.concat_tables([pa.ipc.open_stream(r.as_buffer()).read_all() for r in picked]).combine_chunks())
        base, other = sides
        base = base.take(pa.array(np.argsort(base["_at"].to_numpy(), kind="stable")))
        high, low = words(other["_h"]).T
        other = other.take(pa.array(np.lexsort((low, high))))
        y = base["label"].to_numpy()

        def codes(values) -> np.ndarray:  # 0: missing
            return values.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

        own, new = [codes(base[c]) for c in columns], [codes(other[c]) for c in columns]
        parts = []
        for i, c in enumerate(columns):
            at = new[i]
            for k in range(len(columns)):  # the whole row as one number, which stays below the number of rows
                if k != i:
                    at = np.unique(at * (own[k].max() + 1) + own[k], return_inverse=True)[1]
            first, at, n = np.unique(at, return_index=True, return_inverse=True, return_counts=True)[1:]
            mean = np.bincount(at, y) / n
            square = np.bincount(at, (y - mean[at]) ** 2)
            taken = pa.array(first)
            values = [(other if x == c else base)[x].take(taken) for x in columns]
            parts.append(pa.table([*values, pa.array(n, pa.int64()), pa.array(mean), pa.array(square), pa.array([i] * len(n), pa.int32())], [*columns, "_n", "_y", "_yy", "_c"]))
        return pa.concat_tables(parts)

    out = []
    for mark, size in zip(marks, sizes):
        starts = np.cumsum(size) - size
        sent = rows.select(*columns, "label", "_pos", F.unhex(mark).alias("_h")).mapInArrow(dealt(starts), "_b int, _own boolean, _rows binary")
        out.append(sent.groupBy("_b").applyInArrow(pair, f"{held}, _n long, _y double, _yy double, _c int"))
    return out


def partial_dependence(df: DataFrame, columns: list[str], target: str, feature: str, points: int = 100, name: str = "random_forest") -> DataFrame:
    """Mean prediction over an even grid of one feature."""
    model = fit_regressor(df, columns, target, name)
    b = df.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi")).first()
    grid = [float(v) for v in np.linspace(b["lo"], b["hi"], points)]
    scored = model.transform(on_grid(df, columns, feature, grid)).select(feature, array_to_vector(F.array("prediction")).alias("_p"), "_n")
    sums = weighted_moments(scored, feature, "_p")
    return sums.select(feature, F.get("mean", 0).alias("mean_prediction"), F.get("std", 0).alias("std"))


def on_grid(df: DataFrame, columns: list[str], feature: str, grid: list[float]) -> DataFrame:
    """The other columns' distinct rows, ``_n`` times in the table, at each grid value of ``feature``: a model need not score equal rows twice."""
    rest = df.groupBy(*[c for c in columns if c != feature]).agg(F.count(F.lit(1)).alias("_n"))
    return C.spread(rest).withColumn(feature, F.explode(F.array(*[F.lit(v) for v in grid])))


def weighted_moments(rows: DataFrame, by: str, vector: str, weight: str = "_n") -> DataFrame:
    """``(by, mean, std)`` of weighted vectors as arrays, with the population's standard deviation."""
    w = F.col(weight).cast("double")
    sums = rows.groupBy(by).agg(
        Summarizer.metrics("mean", "variance").summary(F.col(vector), w).alias("_m"), F.sum(w).alias("_w"), F.sum(w * w).alias("_ww")
    )
    # the summary divides by w - ww / w, which is zero for a single row
    pop = F.transform(vector_to_array("_m.variance"), lambda v: F.sqrt(v * (F.col("_w") - F.col("_ww") / F.col("_w")) / F.col("_w")))
    return sums.select(by, vector_to_array("_m.mean").alias("mean"), pop.alias("std"))


def linear_shap(df: DataFrame, coefficients: dict[str, float], key: list[str]) -> DataFrame:
    """Contribution coef * (x - mean) per row and column, with the rank by size inside the row."""
    means = df.agg(*[F.avg(C.number(df, c)).alias(c) for c in coefficients]).first()
    parts_ = [
        F.struct((-F.abs(F.lit(k) * (C.number(df, c) - means[c]))).alias("_neg"), F.lit(c).alias("column_name"), (F.lit(k) * (C.number(df, c) - means[c])).alias("contribution"))
        for c, k in coefficients.items()
    ]
    ranked = df.select(*key, F.posexplode(F.array_sort(F.array(*parts_))).alias("_p", "_s"))
    return ranked.select(*key, F.col("_s.column_name").alias("column_name"), F.col("_s.contribution").alias("contribution"), (F.col("_p") + 1).alias("rank"))


def linear_shap_summary(shap: DataFrame) -> DataFrame:
    return shap.groupBy("column_name").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean"))


def learning_curve(df: DataFrame, columns: list[str], target: str, key: list[str], name: str = "linear", shares=(0.1, 0.3, 0.5, 0.7, 1.0)) -> DataFrame:
    train, test = parts(df, key)
    judge = RegressionEvaluator(metricName="r2")
    rows = []
    for share in shares:
        part = train.where(C.key_bucket(key, 1000, SEED + 2) < int(share * 1000))
        model = fit_regressor(part, columns, target, name)
        on_train, on_test = (judge.evaluate(model.transform(with_label(d, target, None))) for d in (part, test))
        rows.append((float(share), int(part.count()), float(on_train), float(on_test)))
    return df.sparkSession.createDataFrame(rows, "share double, n_train long, train_score double, test_score double")


def align_features(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add missing model columns as 0 / empty text and keep just the model's columns in type."""
    out = df
    for c, kind in columns.items():
        if c not in df.columns:
            out = out.withColumn(c, F.lit("" if kind == "string" else 0).cast(kind))
    return out


def batch_predict(model: PipelineModel, df: DataFrame, columns: dict[str, str], classes: list | None = None) -> DataFrame:
    out = model.transform(align_features(df, columns))
    if classes is not None:
        names = F.array(*[F.lit(c) for c in classes])
        out = out.withColumn("predicted_class", F.element_at(names, F.col("prediction").cast("int") + 1))
        if "probability" in out.columns:
            out = out.withColumn("confidence", F.array_max(vector_to_array("probability")))
    return out.drop("features", "rawPrediction", *[c for c in out.columns if c.startswith("_")])


def prediction_distribution(predicted: DataFrame, column: str) -> DataFrame:
    return D.frequency(predicted, column)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def compare_models(metrics: DataFrame, higher: dict[str, bool]) -> DataFrame:
    """Rank models per metric from ``(model, <metric columns>)``; few rows."""
    out = None
    for m, up in higher.items():
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc(m) if up else F.asc(m), "model")
        part = metrics.select("model", F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.row_number().over(order).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


def automl(df: DataFrame, columns: list[str], target: str, key: list[str], top: int = 3) -> DataFrame:
    """Task by the target, several models, an ensemble of the best ``top``, best model marked."""
    task = detect_task(df, target).first()["task"]
    train, test = parts(df, key)
    names = ["logistic", "random_forest", "naive_bayes_gaussian"] if task == "classification" else ["linear", "random_forest", "gradient_boosting"]
    classes = _classes(train, target) if task == "classification" else None
    judge = MulticlassClassificationEvaluator(metricName="accuracy") if classes else RegressionEvaluator(metricName="r2")
    held = with_label(test, target, classes).select(*key, *columns, "label")
    # all of these take standardised features, which are prepared once
    known = with_label(train, target, classes)
    prepare = Pipeline(stages=feature_stages(known, columns)).fit(known)
    fit_on = prepare.transform(known).select("features", "label").persist()
    wide = prepare.transform(held).select(*key, "label", "features")
    for name in names:
        model = (classifier(name, len(classes), len(columns)) if classes else regressor(name)).fit(fit_on)
        wide = model.transform(wide).withColumnRenamed("prediction", f"_by_{name}").select(*wide.columns, f"_by_{name}")
    wide = stored(wide.drop("features"))
    fit_on.unpersist()
    preds = {n: wide.select(*key, "label", F.col(f"_by_{n}").alias("prediction")) for n in names}
    scores = {n: judge.evaluate(preds[n]) for n in names}
    best = sorted(scores, key=scores.get, reverse=True)[:top]
    vote = ensemble_vote([preds[n] for n in best], key, kind="vote" if classes else "mean")
    joined = wide.select(*key, "label").join(vote, key).withColumn("prediction", F.col("ensemble").cast("double"))
    scores["ensemble"] = judge.evaluate(joined)
    winner = max(scores, key=scores.get)
    return df.sparkSession.createDataFrame(
        [(task, n, float(s), n == winner) for n, s in scores.items()], "task string, model string, score double, is_best boolean"
    )
