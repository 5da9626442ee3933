"""Small frames with known answers, edge cases, and independence from partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.functions import ordering as O
from lodestat.functions import tails
from lodestat.operators import correlate as R
from lodestat.operators import describe as D
from lodestat.operators import series as S
from lodestat.operators import similarity as V
from lodestat.operators import spectrum as P
from lodestat.operators import stats as H
from lodestat.operators import supervised as J
from lodestat.operators import text as L
from lodestat.operators import typing as Y


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; the rest are spread."""
    rng = np.random.default_rng(42)
    x = np.where(rng.random(3000) < 0.34, 7.0, rng.normal(0, 10, 3000).round(2))
    return x, frame(spark, x=x, y=(x * 0.5 + rng.normal(0, 3, 3000)).round(1), k=rng.integers(0, 3, 3000))


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_match_numpy(skewed, parts):
    x, df = skewed
    got = one(O.exact_quantiles(df.repartition(parts), ["x"], {"a": 0.1, "m": 0.5, "b": 0.93}))
    assert np.allclose([got["a"], got["m"], got["b"]], np.quantile(x, [0.1, 0.5, 0.93]))


def test_positions_are_complete_and_ordered(skewed):
    _, df = skewed
    rows = df.withColumn("id", F.monotonically_increasing_id())
    got = O.with_position(rows, ["x", "id"], ["k"]).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("pos")
        assert g["pos"].tolist() == list(range(len(g)))
        assert g["x"].is_monotonic_increasing and (g["n_rows"] == len(g)).all()


def test_halo_equals_plain_window(spark):
    y = np.random.default_rng(1).normal(size=200)
    s = S.prepare_series(frame(spark, t=pd.date_range("2024-01-01", periods=200), y=y), "t", "y")
    got = S.rolling_band(s, [], 7, chunk=10).orderBy("pos").toPandas()["rolling_mean"]
    assert np.allclose(got, pd.Series(y).rolling(7).mean(), equal_nan=True)
    wide = S.window_mean(s, [], F.lit(51)).orderBy("pos").toPandas()["trend"]
    want = pd.Series(y).rolling(51, center=True).mean().bfill().ffill()
    assert np.allclose(wide, want)


def test_change_points_by_sums_equal_frames(spark):
    y = np.concatenate([np.arange(60) * 2.0, 120 - np.arange(60) * 3.0])
    s = S.prepare_series(frame(spark, t=pd.date_range("2024-01-01", periods=120), y=y), "t", "y")
    wide = S.change_points(s, []).orderBy("pos").toPandas()
    near = S.change_points(s, [], 12).orderBy("pos").toPandas()
    assert wide["pos"].tolist() == near["pos"].tolist()
    assert np.allclose(wide["slope_change"], near["slope_change"])


def test_kendall_and_spearman_against_pandas(skewed):
    x, df = skewed
    pdf = df.toPandas()
    tau = one(R.corr_kendall(df, ["x", "y"]))["r"]
    a, b = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    s = np.sign(a[:, None] - a) * np.sign(b[:, None] - b)
    n0 = len(a) * (len(a) - 1) / 2
    ties = [sum(c * (c - 1) / 2 for c in pd.Series(v).value_counts()) for v in (a, b)]
    assert tau == pytest.approx(s.sum() / 2 / np.sqrt((n0 - ties[0]) * (n0 - ties[1])))
    rho = one(R.corr_spearman(df, ["x", "y"]))["r"]
    assert rho == pytest.approx(np.corrcoef(pdf["x"].rank(), pdf["y"].rank())[0, 1])


@pytest.mark.parametrize("n", [31, 64, 97])
def test_power_spectrum_equals_fft(spark, n):
    y = np.random.default_rng(n).normal(size=n)
    s = S.prepare_series(frame(spark, t=pd.date_range("2024-01-01", periods=n), y=y), "t", "y")
    got = P.power_spectrum(s, []).orderBy("k").toPandas()["power"].to_numpy()
    want = np.abs(np.fft.fft(y - y.mean())) ** 2
    assert np.allclose(got, want[1 : (n + 1) // 2])


def test_tail_functions_have_published_values():
    assert tails.t_sf2(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_sf(4.965, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert tails.normal_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert tails.kolmogorov_sf(1.358) == pytest.approx(0.05, abs=1e-3)
    assert tails.beta_ppf(0.5, 3, 3) == pytest.approx(0.5)


def test_shapiro_wilk_published_example():
    # Shapiro and Wilk (1965), weights of eleven men
    w, p = H._shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.01


def test_fisher_exact_tea_tasting(spark):
    rows = [(True, True)] * 3 + [(True, False)] + [(False, True)] + [(False, False)] * 3
    got = one(H.fisher_exact(spark.createDataFrame(rows, "a boolean, b boolean"), "a", "b"))
    assert got["p_value"] == pytest.approx(0.4857, abs=1e-4) and got["odds_ratio"] == 9


def test_empty_constant_and_null_columns(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert one(D.describe(empty, ["x"]))["n"] == 0
    flat = frame(spark, x=[5.0] * 4, y=[1.0, 2.0, 3.0, 4.0])
    assert one(R.corr_pearson(flat, ["x", "y"]))["r"] == 0
    assert one(D.describe(flat, ["x"]))["median"] == 5
    gone = spark.createDataFrame([(None,), (None,)], "x double")
    assert one(D.describe(gone, ["x"]))["median"] is None


def test_fill_directions_cross_chunks(spark):
    v = [None, 1.0, None, None, None, None, 2.0, None]
    df = spark.createDataFrame(list(enumerate(v)), "i int, v double")
    fwd = [r["v"] for r in Y.fill_missing(df, ["v"], "forward_fill", order_by=["i"], chunk=2).orderBy("i").collect()]
    back = [r["v"] for r in Y.fill_missing(df, ["v"], "back_fill", order_by=["i"], chunk=2).orderBy("i").collect()]
    assert fwd == [None, 1, 1, 1, 1, 1, 2, 2] and back == [1, 1, 2, 2, 2, 2, 2, None]


def test_type_precedence(spark):
    df = spark.createDataFrame([("0", "2024-01-05", "1.5", "7", "a"), ("1", "2024-02-05", "2.5", "8", "b")], "a string, b string, c string, d string, e string")
    got = {r["column_name"]: r["inferred_type"] for r in Y.infer_column_type(df).collect()}
    assert got == {"a": "boolean", "b": "datetime", "c": "float", "d": "integer", "e": "string"}


def test_auc_extremes(spark):
    df = frame(spark, y=[0, 0, 1, 1], s=[0.1, 0.2, 0.8, 0.9])
    assert one(J.roc_auc(df, F.col("y"), "s"))["auc"] == 1
    assert one(J.roc_auc(df.withColumn("s", F.lit(1.0)), F.col("y"), "s"))["auc"] == 0.5


def test_porter_known_stems():
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "happy": "happi", "relational": "relat", "hopefulness": "hope", "adjustment": "adjust", "probate": "probat", "controll": "control"}
    assert {w: L.porter_stem(w) for w in known} == known


def test_near_duplicates_links_copies_once(spark):
    rows = [(i, "alpha beta gamma delta epsilon zeta") for i in range(6)] + [(6, "one two three four"), (7, "five six seven eight")]
    got = V.near_duplicates(spark.createDataFrame(rows, "id int, text string"), "id", "text", 0.95, max_df=1.0).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(0, i) for i in range(1, 6)]


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = ["w%02d" % i for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocab, 12))) for i in range(60)]
    vectors = V.tfidf_vectors(spark.createDataFrame(rows, "id int, text string"), "id", "text", max_df=1.0).cache()
    m = vectors.toPandas().pivot_table(index="id", columns="term", values="w", fill_value=0).to_numpy()
    sim = m @ m.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if sim[i, j] >= 0.2}
    got = {(r["a"], r["b"]) for r in V.similar_pairs(vectors, "id", 0.2).collect()}
    assert got == want


def test_near_duplicates_of_a_term_in_every_document(spark):
    """Many documents that share one telling term and little else, some of them nearly alike, and copies."""
    import random

    import numpy as np

    from lodestat.operators import similarity as V

    rnd = random.Random(3)
    words = ["word%d" % i for i in range(400)]
    rows = []
    for i in range(700):
        rows.append((i, "boilerplate " * 30 + " ".join(rnd.sample(words, 2))))
    rows += [(1000 + i, rows[i][1] + " " + rnd.choice(words)) for i in range(5)] + [(2000 + i, rows[0][1]) for i in range(4)] + [(3000, ""), (3001, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    vectors = V.tfidf_vectors(df, "id", "text", max_df=1.0).toPandas()
    names, at = np.unique(vectors["term"], return_inverse=True)
    ids, row = np.unique(vectors["id"], return_inverse=True)
    m = np.zeros((len(ids), len(names)))
    m[row, at] = vectors["w"]
    sims = m @ m.T
    for threshold, least in ((0.25, 1000), (0.9, 8)):
        a, b = np.nonzero(np.triu(sims >= threshold, 1))
        want = {(ids[x], ids[y]): sims[x, y] for x, y in zip(a, b)}
        found = V.similar_pairs(V.tfidf_vectors(df, "id", "text", max_df=1.0), "id", threshold).collect()
        assert len(found) == len(want) >= least
        assert all(abs(want[r["a"], r["b"]] - r["similarity"]) < 1e-9 for r in found)
    linked = V.near_duplicates(df, "id", "text", 0.9, max_df=1.0).collect()
    firsts = {(x, y) for x, y in want if x < 2000 and y < 2000}
    copies = {(0, 2000 + i) for i in range(4)}
    assert {(r["a"], r["b"]) for r in linked} == firsts | copies


def test_phrases_are_taken_leftmost_and_longest(spark):
    from lodestat.operators import text as L

    known = spark.createDataFrame([("New York", "CITY"), ("new york city", "CITY"), ("York", "TOWN"), ("city hall", "PLACE"), ("new york", "STATE"), ("!!", "NONE"), (None, "NONE")], "phrase string, label string")
    rows = [(1, "In New York City Hall, york; NEW YORK new new york-city"), (2, "city"), (3, None), (4, ""), (5, "york york")]
    got = L.entities_phrases(spark.createDataFrame(rows, "id long, body string"), ["id"], "body", known).collect()
    assert sorted((r["id"], r["token"], r["n_tokens"], r["label"], r["entity"]) for r in got) == [
        (1, 1, 3, "CITY", "new york city"), (1, 5, 1, "TOWN", "york"), (1, 6, 2, "CITY", "new york"), (1, 9, 3, "CITY", "new york city"),
        (5, 0, 1, "TOWN", "york"), (5, 1, 1, "TOWN", "york"),
    ]
    assert L.entities_phrases(spark.createDataFrame(rows, "id long, body string"), ["id"], "body", known.limit(0)).count() == 0
