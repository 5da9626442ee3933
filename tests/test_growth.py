"""Work that must grow with the rows, not with their square: plans, and results on rows that span several chunks."""

import collections
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lodestat.functions import ordering as O
from lodestat.operators import inspection as X
from lodestat.operators import neighbors as N
from lodestat.operators import similarity as V
from lodestat.operators import stats as H
from lodestat.operators import supervised as J
from lodestat.operators import text as L
from lodestat.operators import typing as Y


def shrinks(df):
    """Whether a window frame starts at or behind its row and runs to the end: read anew for each row."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    return re.search(r"(currentrow\$\(\)|\b1), unboundedfollowing", plan) is not None


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("strategy", ["back_fill", "forward_fill"])
def test_fill_reads_frames_that_grow(spark, strategy, keys):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"i": rng.permutation(300), "k": rng.integers(0, 3, 300), "v": rng.normal(size=300)})
    x.loc[rng.random(300) < 0.8, "v"] = np.nan
    x.loc[x["i"] > 280, "v"] = np.nan
    rows = spark.createDataFrame([(int(i), int(k), None if np.isnan(v) else float(v)) for i, k, v in x.itertuples(index=False)], "i int, k int, v double")
    out = Y.fill_missing(rows, ["v"], strategy, order_by=["i"], keys=keys, chunk=16)
    assert not shrinks(out)
    by = x.sort_values("i")
    held = by.groupby("k")["v"] if keys else by["v"]
    want = (held.bfill() if strategy == "back_fill" else held.ffill()).set_axis(by["i"])
    got = out.toPandas().set_index("i").sort_index()["v"]
    np.testing.assert_array_equal(got.to_numpy(float), want.to_numpy(float))


def test_fdr_reads_frames_that_grow(spark, monkeypatch):
    monkeypatch.setattr(O, "CHUNK", 16)
    rng = np.random.default_rng(4)
    p = np.round(rng.random(300) ** 3, 2)
    out = H.fdr_bh(spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "p": p})), "p", ["id"])
    assert not shrinks(out)
    order = np.argsort(p, kind="stable")
    want = np.empty(300)
    want[order] = np.minimum(1, np.minimum.accumulate((p[order] * 300 / np.arange(1, 301))[::-1])[::-1])
    np.testing.assert_allclose(out.toPandas().sort_values("id")["p_adjusted"], want, rtol=1e-12)


def test_importance_scores_all_shuffles_in_one_pass(spark, monkeypatch):
    import hashlib

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(200), "a": rng.normal(size=200), "b": rng.normal(size=200)})
    pdf["y"] = 2 * pdf["a"] - pdf["b"] + rng.normal(size=200) * 0.1
    passes, fit = [], J.fit_regressor

    class Counted:
        def __init__(self, model):
            self.model = model

        def transform(self, rows):
            passes.append(1)
            return self.model.transform(rows)

    monkeypatch.setattr(J, "fit_regressor", lambda *a: Counted(fit(*a)))
    out = J.importance_permutation(spark.createDataFrame(pdf), ["a", "b"], "y", ["id"], "linear", repeats=3).toPandas().set_index("column_name")
    assert len(passes) == 2
    line = np.linalg.lstsq(np.column_stack([pdf["a"], pdf["b"], np.ones(200)]), pdf["y"], rcond=None)[0]

    def r2(a, b):
        return 1 - ((pdf["y"] - (line[0] * a + line[1] * b + line[2])) ** 2).sum() / ((pdf["y"] - pdf["y"].mean()) ** 2).sum()

    drops = []
    for r in range(3):
        order = np.argsort([hashlib.md5(f"{J.SEED + r}|{i}".encode()).hexdigest() for i in range(200)])
        drops.append(r2(pdf["a"], pdf["b"]) - r2(pdf["a"].to_numpy()[order], pdf["b"]))
    assert out.loc["a", "importance"] == pytest.approx(np.mean(drops), rel=1e-3)
    assert out.loc["a", "std"] == pytest.approx(np.std(drops), rel=1e-2)


def test_queries_are_sent_on_in_small_groups(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 64))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    near = N.knn_join(points, points, 3, exclude_same=True, block=32)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = near.toPandas().sort_values(["query", "rank"])["id"].to_numpy().reshape(300, 3)
    np.testing.assert_array_equal(got, np.argsort(d, axis=1)[:, :3])
    tree = N.Tree(points, 32)
    sizes, plain = [], N.Tree._groups

    def seen(rows, parents, size=N.GROUP):
        sizes.append(size)
        return plain(rows, parents, size)

    tree._groups = seen
    tree.route(points.withColumn("bound", F.lit(float("inf"))), 3)
    assert sizes and max(sizes) * N.FAN * 64 <= N.SENT


def test_query_terms_alone_get_document_frequencies(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red red yellow"), (3, None), (4, "black white")], "id int, text string")
    asked = spark.createDataFrame([(7, "yellow red purple"), (8, "purple")], "q int, text string")
    counted, plain = [], V.vocabulary
    monkeypatch.setattr(V, "vocabulary", lambda counts, *a: counted.append(counts) or plain(counts, *a))
    rows = {r["term"]: r["w"] for r in V.query_vectors(docs, "id", "text", asked, "q", "text").collect()}
    idf = np.log(5 / np.array([3.0, 2.0])) + 1
    assert rows == pytest.approx({"red": idf[0] / np.hypot(*idf), "yellow": idf[1] / np.hypot(*idf)}, rel=1e-12)
    assert {r["term"] for r in counted[0].collect()} == {"red", "yellow"}


def test_nmf_hands_numbers_to_the_factors(spark, monkeypatch):
    rows = [(i, "red green blue" if i % 2 else "bread milk cheese") for i in range(12)]
    written, plain = [], V.stored
    monkeypatch.setattr(V, "stored", lambda df: written.append(df.columns) or plain(df))
    topics, mix = V.topics_nmf(spark.createDataFrame(rows, "id int, text string"), "id", "text", 2, 3)
    assert mix.count() == 12 and topics.select("topic").distinct().count() == 2
    assert ["id", "term", "w"] in written and ["doc_id_", "term_id", "w"] in written


def brute_terms(texts):
    """Counts of the one- and two-word terms per text."""
    out = []
    for text in texts:
        words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in L.STOPWORDS_ENGLISH]
        out.append(collections.Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    return out


@pytest.mark.parametrize("label", [None, "g"])
@pytest.mark.parametrize("counters", [3, 64, 1 << 16])
def test_keywords_count_only_frequent_terms_by_document(spark, monkeypatch, label, counters):
    monkeypatch.setattr(L, "TERM_COUNTERS", counters)
    monkeypatch.setattr(L, "WIDE", 1)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(w)}x" for w in rng.zipf(1.4, 30) % 60) for _ in range(40)]
    rows = [(i, "ab"[i % 2] if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, g string, text string")
    got = L.keywords(df, ["id"], "text", 5, "count", label)
    # the answer comes from written counts of few terms, not from a grouping of all of them by document
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    want = set()
    for g in {r[1] for r in rows} if label else {0}:
        docs = brute_terms([t for _, k, t in rows if not label or k == g])
        total = sum(docs, collections.Counter())
        for term in sorted(total, key=lambda t: (-total[t], t))[:5]:
            want.add((*([g] if label else []), term, float(total[term]), sum(term in d for d in docs)))
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


def test_common_words_move_once(spark):
    rows = [(1, "b a the a c"), (1, "c c b"), (2, None), (None, "z k k"), (3, "the"), (None, "z z q")]
    out = L.common_words(spark.createDataFrame(rows, "id int, text string"), ["id"], "text", 2)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {tuple(r) for r in out.select("id", "word", "cnt", "rank").collect()}
    assert got == {(1, "c", 3, 1), (1, "b", 2, 2), (None, "z", 3, 1), (None, "k", 2, 2)}


def test_vectors_of_some_documents(spark):
    texts = ["red fox runs", "red fox sleeps", "blue whale swims", "red whale", None, "fox fox fox whale"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "red fox again"), (None, "red moon")]
    df = spark.createDataFrame(rows, "id int, text string")
    for kwargs in ({}, {"min_df": 2, "max_df": 0.6}, {"max_features": 4}):
        whole = V.tfidf_vectors(df, "id", "text", **kwargs).where(F.col("id").isin([1, 3]))
        some = V.tfidf_vectors(df, "id", "text", only=[1, 3], **kwargs)
        want, got = ({(r["id"], r["term"]): r["w"] for r in x.collect()} for x in (whole, some))
        assert want.keys() == got.keys() and got
        np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-12)


def test_fits_read_written_counts(spark):
    texts = ["red fox runs", "red fox sleeps", None, "blue whale", "the blue whale and the fox", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    model, counts = V._counted(df, "id", "text", None)
    # a round of a fit reads vectors, not texts
    assert "regexp" not in counts._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r["id"]: {model.vocabulary[i]: v for i, v in zip(r["features"].indices, r["features"].values)} for r in counts.collect()}
    assert got == {0: {"red": 1, "fox": 1}, 1: {"red": 1, "fox": 1}, 2: {}, 3: {"blue": 1, "whale": 1}, 4: {"blue": 1, "whale": 1, "fox": 1}, 5: {}}


def test_partial_dependence_scores_distinct_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": np.arange(300), "a": rng.normal(size=300), "b": rng.integers(0, 4, 300).astype(float)})
    pdf["y"] = pdf["a"] + 3 * pdf["b"] + rng.normal(size=300) * 0.1
    pdf["kind"] = (pdf["y"] > 4).astype(int)
    scored = []

    class Counted:
        def __init__(self, model):
            self.model = model

        def transform(self, rows):
            scored.append(rows.count())
            return self.model.transform(rows)

    fit, fit_class = J.fit_regressor, J.fit_classifier
    kept = {}
    monkeypatch.setattr(J, "fit_regressor", lambda *a: Counted(kept.setdefault("r", fit(*a))))
    monkeypatch.setattr(J, "fit_classifier", lambda *a: (lambda m: (Counted(kept.setdefault("c", m[0])), m[1]))(fit_class(*a)))
    df = spark.createDataFrame(pdf)
    got = J.partial_dependence(df, ["a", "b"], "y", "a", 5, "random_forest").toPandas().sort_values("a")
    classes = X.partial_dependence_classes(df, ["a", "b"], "kind", "a", 5, "logistic").toPandas().sort_values(["a", "class"])
    assert scored == [4 * 5, 4 * 5]  # distinct values of b on a grid of five
    whole = df.drop("a").withColumn("a", F.explode(F.array(*[F.lit(float(v)) for v in got["a"]])))
    want = kept["r"].transform(whole).groupBy("a").agg(F.avg("prediction").alias("m"), F.stddev_pop("prediction").alias("s")).toPandas().sort_values("a")
    np.testing.assert_allclose(got[["mean_prediction", "std"]], want[["m", "s"]], rtol=1e-9)
    p = kept["c"].transform(whole).select("a", F.posexplode(vector_to_array("probability")).alias("k", "p"))
    want = p.groupBy("a", "k").agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("s")).toPandas().sort_values(["a", "k"])
    np.testing.assert_allclose(classes[["mean_probability", "std"]], want[["m", "s"]], rtol=1e-9)


def test_dbscan_of_few_columns_compares_cells_not_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    # crowded cells, two strips just out of reach of each other, loose points, and an id with rows in two places
    strips = [np.column_stack([rng.uniform(4, 6, 60), rng.uniform(0, 0.1, 60) + y]) for y in (0.0, 0.41)]
    # and two cells linked by inner points, none of their outermost
    cells = [[0.2, 0], [0, 0.1], [0.1, 0.2], [0.19, 0.1], [0.1, 0.1], [0.43, 0.2], [0.62, 0.1], [0.53, 0.01], [0.44, 0.1], [0.53, 0.1]]
    x = np.vstack([rng.normal(0, 0.05, (60, 2)), rng.normal(1, 0.4, (60, 2)), *strips, rng.uniform(-2, 3, (30, 2)), np.array(cells) + 21.2137])
    ids = np.arange(len(x))
    ids[5] = 200
    rows = [(int(i), *map(float, p)) for i, p in zip(ids, x)] + [(None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    monkeypatch.setattr(N, "Tree", None)
    got = N.dbscan(df, "id", ["a", "b"], 0.3, 5, standardize=False, block=16).collect()
    x = np.vstack([x, [0.0, 0.0]])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.3
    each = collections.Counter()
    for i, c in zip(ids, near.sum(axis=1)):
        each[int(i)] += int(c)
    core = np.array([each[int(i)] >= 5 for i in ids] + [False])
    ids = np.append(ids, -1)
    label = {int(i): int(i) for i in ids[core]}
    while True:
        new = {i: min([label[int(k)] for j in np.flatnonzero(ids == i) for k in ids[near[j] & core]] + [label[i]]) for i in label}
        if new == label:
            break
        label = new
    for i in set(ids[~core].tolist()) - {-1}:
        hit = [label[int(k)] for j in np.flatnonzero(ids == i) for k in ids[near[j] & core]]
        label[i] = min(hit, default=-1)
    want = collections.Counter((int(i), label[int(i)], bool(c)) for i, c in zip(ids[:-1], core)) + collections.Counter([(None, -1, False)])
    assert collections.Counter(map(tuple, got)) == want
    assert set(label.values()) == {-1, 0, 61, 120, 270}


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_permutation_importance_scores_equal_rows_once(spark, monkeypatch, task):
    rng = np.random.default_rng(5)
    x = pd.DataFrame({"id": range(600), "a": rng.integers(0, 4, 600), "b": rng.integers(0, 3, 600), "s": rng.choice(["u", "v"], 600)})
    rows = [(int(i), None if i % 50 == 0 else float(a), int(b), s, float(a + b + (i % 2))) for i, a, b, s in x.itertuples(index=False)]
    df = spark.createDataFrame(rows, "id int, a double, b int, s string, y double")
    df = df.withColumn("y", (F.col("y") > 2).cast("int")) if task == "classification" else df
    fit, scored = X._fit, []

    class Watched:
        def __init__(self, model):
            self.model = model

        def transform(self, d):
            scored.append(d.toPandas())
            return self.model.transform(d)

    def watched(*args):
        model, classes = fit(*args)
        return Watched(model), classes

    monkeypatch.setattr(X, "_fit", watched)
    name = "logistic" if task == "classification" else "linear"
    got = {r["column_name"]: r for r in X.permutation_importance(df, ["a", "b", "s"], "y", ["id"], name, task, repeats=3).collect()}
    assert len(scored[0]) < 10 * 600 / 2
    # every shuffle still holds all rows, and the metric of each is that of the rows one by one
    model, classes = fit(df, ["a", "b", "s"], "y", name, task)
    assert (scored[0].groupby(["_c", "_r"])["_n"].sum() == 600).all()
    each = scored[0].loc[scored[0].index.repeat(scored[0]["_n"])]
    assert {c: each[each["_c"] == 0][c].isna().sum() for c in "ab"} == {"a": 3 * 12, "b": 0}
    out = model.transform(spark.createDataFrame(each.astype(object).where(each.notna(), None), "a double, b int, s string, label double, _n long, _c int, _r int"))
    want = out.groupBy("_c", "_r").agg(X._score(task).alias("v")).toPandas().set_index(["_c", "_r"])["v"]
    base = want[-1, 0]
    for i, c in enumerate("abs"):
        drops = base - want[i]
        assert got[c]["base_score"] == pytest.approx(base, abs=1e-12)
        assert got[c]["importance"] == pytest.approx(drops.mean(), abs=1e-12) and got[c]["std"] == pytest.approx(drops.std(ddof=0), abs=1e-12)


def learnt(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b), float(2 * a + b + e)) for i, (a, b, e) in enumerate(rng.normal(size=(400, 3)))]
    return spark.createDataFrame([*rows, (400, 1.0, None, 2.0), (401, 1.0, 1.0, None), (3, 0.5, 0.5, 1.0), (None, 0.1, 0.2, 0.3)], "id int, a double, b double, y double")


def test_train_regressor_reads_the_scored_rows_once(spark, monkeypatch):
    df = learnt(spark)
    train, test = J.parts(J.with_label(df, "y", None), ["id"])
    ready = J._prepared(train, test, ["a", "b"], "standard")
    scored = J.regressor("linear").fit(ready[0]).transform(ready[1])
    want = [J.RegressionEvaluator(metricName=m).evaluate(scored) for m in ("r2", "mse", "rmse", "mae", "var")]

    def refuse(*args, **kwargs):
        raise AssertionError("a pass for each metric")

    monkeypatch.setattr(J.RegressionEvaluator, "evaluate", refuse)
    got = J.train_regressor(df, ["a", "b"], "y", ["id"], ["linear", "ridge"]).collect()
    assert [r["model"] for r in got] == ["linear", "ridge"] and list(got[0][1:]) == pytest.approx(want, rel=1e-9)


def test_regression_scores_of_a_constant_label(spark):
    for p, r2 in ((1.0, float("nan")), (2.0, float("-inf"))):
        got = J.regression_scores(spark.createDataFrame([(1.0, p)] * 3, "label double, prediction double")).first()
        assert got["r2"] == pytest.approx(r2, nan_ok=True) and got["mse"] == (p - 1) ** 2


def test_stacking_prepares_a_fold_once_and_scores_its_rows_once(spark, monkeypatch):
    df, made = learnt(spark), []
    stages = J.feature_stages
    monkeypatch.setattr(J, "feature_stages", lambda *args: made.append(1) or stages(*args))
    out = J.ensemble_stacking(df, ["a", "b"], "y", ["id"], ["linear", "random_forest"])
    assert len(made) == 3
    # the result reads written predictions, no model scores behind it
    assert "xxhash64" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = out.toPandas()
    assert list(got.columns) == ["id", "y", "base_linear", "base_random_forest", "prediction"] and len(got) == 403
    data = df.withColumn("_f", J.C.key_bucket(["id"], 3, J.SEED + 1))
    for f in range(3):
        for name in ("linear", "random_forest"):
            model = J.fit_regressor(data.where(F.col("_f") != f), ["a", "b"], "y", name)
            held = model.transform(data.where((F.col("_f") == f) & F.col("y").isNotNull())).select("id", "y", "prediction").toPandas()
            both = held.merge(got, on=["id", "y"], how="left")
            np.testing.assert_allclose(both[f"base_{name}"], both["prediction_x"], rtol=1e-9)


@pytest.mark.parametrize("target", ["y", "kind"])
def test_automl_prepares_the_features_once(spark, monkeypatch, target):
    df = learnt(spark).withColumn("kind", F.when(F.col("y") > 1, "high").when(F.col("y") < -1, "low").otherwise("mid"))
    made, stages = [], J.feature_stages
    monkeypatch.setattr(J, "feature_stages", lambda *args: made.append(1) or stages(*args))
    got = {r["model"]: r["score"] for r in J.automl(df, ["a", "b"], target, ["id"]).collect()}
    assert len(made) == 1 and len(got) == 4
    train, test = J.parts(df, ["id"])
    for name in got.keys() - {"ensemble"}:
        if target == "kind":
            model, classes = J.fit_classifier(train, ["a", "b"], target, name)
            judge = J.MulticlassClassificationEvaluator(metricName="accuracy")
        else:
            model, classes, judge = J.fit_regressor(train, ["a", "b"], target, name), None, J.RegressionEvaluator(metricName="r2")
        assert got[name] == pytest.approx(judge.evaluate(model.transform(J.with_label(test, target, classes))), rel=1e-9)


@pytest.mark.parametrize("discrete", [True, False])
def test_importance_pairs_rows_in_groups(spark, monkeypatch, discrete):
    monkeypatch.setattr(J, "PAIR_ROWS", 200)
    monkeypatch.setattr(J, "DEAL_ROWS", 100)
    rng = np.random.default_rng(9)
    a = rng.integers(0, 4, 500).astype(float) if discrete else rng.normal(size=500)
    x = pd.DataFrame({"id": np.arange(500), "a": a, "b": rng.integers(0, 3, 500), "s": rng.choice(["u", "v"], 500)})
    x["y"] = x["a"] + x["b"] + 2 * (x["s"] == "u") + rng.normal(size=500)
    rows = [(int(i), None if i % 50 == 0 else float(a), int(b), s, float(y)) for i, a, b, s, y in x.itertuples(index=False)]
    df = spark.createDataFrame(rows, "id int, a double, b int, s string, y double")
    fit, scored, kept = J.fit_regressor, [], []

    class Watched:
        def __init__(self, model):
            self.model = model

        def transform(self, d):
            scored.append(d)
            return self.model.transform(d)

    monkeypatch.setattr(J, "fit_regressor", lambda *args: kept.append(fit(*args)) or Watched(kept[-1]))
    got = {r["column_name"]: r for r in J.importance_permutation(df, ["a", "b", "s"], "y", ["id"], "linear", repeats=3).collect()}
    moved = scored[1].toPandas()
    assert (moved.groupby(["_r", "_c"])["_n"].sum() == 500).all()
    # repeats whose rows are few are written one by one, so that no job holds the shuffles of all
    assert ("md5" in scored[1]._jdf.queryExecution().optimizedPlan().toString()) != discrete
    if discrete:
        assert len(moved) < 9 * 500 * 0.8
    drops = {c: [] for c in "abs"}
    for r in range(3):
        order = [int(v[0]) for v in df.select("id").orderBy(J.hash_order(["id"], 42 + r), "id").collect()]
        for c in "abs":
            swapped = [list(row) for row in rows]
            at = " abs".index(c)
            for row, i in zip(swapped, order):
                row[at] = rows[i][at]
            both = [kept[0].transform(spark.createDataFrame(v, df.schema)).select("y", "prediction").toPandas() for v in (rows, swapped)]
            base, new = (1 - ((p["y"] - p["prediction"]) ** 2).sum() / ((x["y"] - x["y"].mean()) ** 2).sum() for p in both)
            drops[c].append(base - new)
    for c, v in drops.items():
        assert got[c]["importance"] == pytest.approx(np.mean(v), rel=1e-8) and got[c]["std"] == pytest.approx(np.std(v), rel=1e-6)


def test_nmf_blocks_follow_the_weights(spark, monkeypatch):
    rows = [(i, "red green blue" if i % 2 else "bread milk cheese") for i in range(12)]
    df, used, plain = spark.createDataFrame(rows, "id int, text string"), [], V.ALS.setNumBlocks
    monkeypatch.setattr(V.ALS, "setNumBlocks", lambda self, n: used.append(n) or plain(self, n))
    for size, blocks in ((1 << 21, 10), (3, 20), (1, 60), (0.5, 64)):
        monkeypatch.setattr(V, "BLOCK_WEIGHTS", size)
        topics, mix = V.topics_nmf(df, "id", "text", 2, 3)
        assert used[-1] == blocks and mix.count() == 12
    assert topics.select("topic").distinct().count() == 2


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from lodestat import session

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())}

    before, was = {f for f in shuffled() if f.startswith("shuffle_")}, spark.conf.get(session.FREED, None)
    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    kept = session.stored(counts)
    until = time.time() + 20
    while (left := {f for f in shuffled() if f.startswith("shuffle_")} - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and kept.count() == counts.count() == 10 and spark.conf.get(session.FREED, None) == was
