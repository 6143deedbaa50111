"""Operators against numpy and against SQL on the small tables."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from trialwise.functions import math as M
from trialwise import utilities
from trialwise.functions import order
from trialwise.operators import gram, local, preprocessing, rsa, series, splits, tasks
from trialwise.plans.catalog import ORACLE_SQL, QUERIES
from trialwise.sources import generators

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert set(want.columns) == set(got.columns)
    cols = list(want.columns)
    want, got = want.sort_values(cols).reset_index(drop=True), got[cols].sort_values(cols).reset_index(drop=True)
    assert len(want) == len(got)
    for c in cols:
        if want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].astype(float), want[c], atol=2e-6)
        else:
            assert (got[c] == want[c]).all()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("n,p", [(10, 20), (20, 10)])
@pytest.mark.parametrize("targets", [1, 3])
@pytest.mark.parametrize("intercept", [True, False])
def test_ridge_is_brute_force_leave_one_out(spark, n, p, targets, intercept):
    rng = np.random.default_rng(42)
    X, Y = rng.standard_normal((n, p)), rng.standard_normal((n, targets))
    alphas = np.logspace(-2, 3, 6)

    def solve(A, B, a):
        mx, my = (A.mean(0), B.mean(0)) if intercept else (np.zeros(p), np.zeros(targets))
        w = np.linalg.solve((A - mx).T @ (A - mx) + a * np.eye(p), (A - mx).T @ (B - my))
        return w, my - mx @ w

    loss = []
    for a in alphas:
        e = []
        for i in range(n):
            keep = np.arange(n) != i
            w, b = solve(X[keep], Y[keep], a)
            e.append((Y[i] - X[i] @ w - b) ** 2)
        loss.append(np.mean(e))
    best = alphas[int(np.argmin(loss))]
    m = local.RidgeCV(alphas, intercept).fit(X, Y)
    assert m.alpha_ == best
    np.testing.assert_allclose(m.coef_.T, solve(X, Y, best)[0], rtol=1e-5, atol=1e-7)
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(X, Y)], "x array<double>, y array<double>")
    r = gram.ridge_cv(df, alphas=alphas, fit_intercept=intercept).first()
    np.testing.assert_allclose(np.array(r["coef"]).T, solve(X, Y, best)[0], rtol=1e-5, atol=1e-7)


def test_scaler_edges_and_round_trip(spark):
    rng = np.random.default_rng(1)
    X = rng.standard_normal((12, 4))
    X[:, 2] = 7
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "trial long, x array<double>")
    m = preprocessing.Scaler().fit(df)
    got = np.array([r["x"] for r in m.transform(df).orderBy("trial").collect()])
    s = X.std(0, ddof=1)
    s[2] = 1
    np.testing.assert_allclose(got, (X - X.mean(0)) / s, atol=1e-12)
    back = np.array([r["x"] for r in m.inverse_transform(m.transform(df)).orderBy("trial").collect()])
    np.testing.assert_allclose(back, X, atol=1e-12)
    with pytest.raises(ValueError):
        preprocessing.Scaler().transform(df)


def test_degenerate_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([3.0, 3.0], [1.0, 2.0])], "x array<double>, y array<double>")
    a, b = df.select(M.cosine("x", "y").alias("c"), M.pearsonr("x", "y").alias("p")).collect()
    assert np.isnan(a["c"]) and np.isnan(a["p"]) and np.isnan(b["p"])


def test_shuffled_folds_partition(spark):
    df = spark.range(103).withColumnRenamed("id", "trial")
    rows = splits.RepeatedKFold(5, 2, 3).assign(df).collect()
    for r in (0, 1):
        own = [x for x in rows if x["repeat"] == r]
        assert sorted(x["trial"] for x in own) == list(range(103))
        assert sorted(np.bincount([x["fold"] for x in own]).tolist()) == [20, 20, 21, 21, 21]


def test_receptive_field_finds_the_kernel():
    rng = np.random.default_rng(0)
    kernel = np.array([1.0, 2, 3, 2, 1])
    X = rng.standard_normal((100, 1, 50))
    y = np.stack([[np.convolve(x[0], kernel, "same")] for x in X])
    m = local.ReceptiveField(-2, 2, 1, [1e-3, 1.0]).fit(X, y)
    np.testing.assert_allclose(m.coef_[0, 0], kernel, atol=0.05)


def test_pairwise_coupling_of_consistent_probabilities():
    p = np.array([0.5, 0.3, 0.2])
    P = p[:, None] / (p[:, None] + p)
    np.testing.assert_allclose(local.couple(P), p, atol=0.01)


def test_feature_sets_drop_equal_masks():
    sets, masks = tasks.feature_sets(2, [[1, 0], [0, 1], [1, 1]])
    assert len(masks) == 3 and sets[0] == (0,)
    with pytest.raises(ValueError):
        tasks.feature_sets(2, [[1, 0]])


def blocks(spark, X, Y, **keys):
    names = [*keys, "trial", "x", "y"]
    rows = [(*[v[i] for v in keys.values()], i, list(map(float, x)), list(map(float, y))) for i, (x, y) in enumerate(zip(X, Y))]
    return spark.createDataFrame(rows, ", ".join([*[f"{k} long" for k in keys], "trial long, x array<double>, y array<double>"])).select(*names)


def test_reduce_and_score():
    X = np.arange(24.0).reshape(2, 3, 4)
    assert (tasks.reduce_(X, 0) == X.transpose(1, 2, 0)).all() and (tasks.reduce_(X, (-1, 0)) == X.transpose(1, 0, 2).reshape(3, 8)).all()
    for bad in ((0, 0), (3,), (0, -3)):
        with pytest.raises(ValueError):
            tasks.reduce_(X, bad)
    rng = np.random.default_rng(0)
    A, B = rng.standard_normal((30, 4)), rng.standard_normal((30, 2))
    m = local.RidgeCV(1.0).fit(A, B)
    p = m.predict(A)
    want = 1 - ((B - p) ** 2).sum(0) / ((B - B.mean(0)) ** 2).sum(0)
    np.testing.assert_allclose(m.score(A, B), want)
    both = m.score(A, B, (tasks.r2, tasks.pearsonr))
    np.testing.assert_allclose(both["pearsonr"], [np.corrcoef(B[:, t], p[:, t])[0, 1] for t in (0, 1)])
    np.testing.assert_allclose(tasks.score(m, tasks.r2.grant(y_b=np.zeros(2)), A, B), 1 - ((B - p) ** 2).sum(0) / (B**2).sum(0))
    own = tasks.Metric("alpha", ("alpha_", "y"), lambda a, y: a.ravel()[0] + 0 * y.mean(-1), reduce=(0,)).mutate(name="other")
    assert tasks.score(local.RidgeCV(2.0).fit(A, B), own.mutate(request=("coef_", "y"), f=lambda c, y: c.shape), A, B) == (4, 2) and own.name == "other"
    y = np.repeat([0, 1, 2], 10)[:, None]
    assert local.RidgeClassifier(1.0).fit(A + y, y).score(A + y, y)[0] > 0.5
    pipe = local.make_pipeline(local.BlockScaler(), local.BlockClamp(), local.RidgeCV(1.0)).fit(A, B)
    np.testing.assert_allclose(pipe.predict(A), pipe[-1].predict(pipe[1].transform(pipe[0].transform(A))))
    np.testing.assert_allclose(pipe.clone().fit(A, B).score(A, B), pipe.score(A, B))


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("masks", [None, [[1, 0, 1], [0, 1, 0], [1, 1, 1]]])
def test_validation_by_sums_is_validation_by_blocks(spark, intercept, masks):
    class Gathered(local.RidgeCV):
        """The same model, but not one that is known to be made of sums."""

    rng = np.random.default_rng(1)
    X, Y = rng.standard_normal((60, 3)) + 5, rng.standard_normal((60, 2))
    Y[:, 0] += X[:, 0]
    df = blocks(spark, X, Y, g=(np.arange(60) % 2).tolist())
    out = []
    for kind in (local.RidgeCV, Gathered):
        v = tasks.Validator(kind([0.1, 1.0, 100.0], intercept, True), splits.RepeatedKFold(3, 2, 4), (tasks.r2, tasks.pearsonr))
        out.append({tuple(r)[:-1]: r["score"] for r in v.scores(df, ["g"], masks=masks).collect()})
    assert out[0].keys() == out[1].keys() and len(out[0]) == 2 * 6 * 4 * len(masks or [0])
    np.testing.assert_allclose([out[0][k] for k in out[0]], [out[1][k] for k in out[0]], rtol=1e-8, atol=1e-10)
    assert tasks.Validator(local.RidgeCV(), 3).scores(df.where("g = 0 or trial < 40"), ["g"]).count() == 2 * 3 * 2


@pytest.mark.parametrize("most", [1 << 28, 0])
def test_fitted_validator(spark, monkeypatch, most):
    # with 0 bytes allowed, models are not sent: they meet the trials by key
    monkeypatch.setattr(tasks, "MOST_MODELS", most)
    rng = np.random.default_rng(2)
    X, y = rng.standard_normal((40, 3)), rng.integers(0, 2, (40, 1)).astype(float)
    X[:, :1] += 2 * y
    df = blocks(spark, X, y)
    model = local.make_pipeline(local.BlockScaler(), local.RidgeClassifier(1.0))
    fitted, scores = tasks.cross_val_score(model, df, 4, (tasks.accuracy, tasks.roc_auc), return_validator=True)
    again = {tuple(r) for r in tasks.cross_val_score(model, df, 4, (tasks.accuracy, tasks.roc_auc)).collect()}
    assert {tuple(r) for r in scores.collect()} == again
    assert sorted(r["trial"] for r in fitted.tests().collect()) == list(range(40))
    own = [model.clone().fit(X[np.arange(40) // 10 != f], y[np.arange(40) // 10 != f]) for f in range(4)]
    for method in ("predict", "predict_proba", "decision_function"):
        got = {(r["fold"], r["trial"]): r["value"] for r in getattr(fitted, method)(df).collect()}
        for f, m in enumerate(own):
            np.testing.assert_allclose([got[f, i] for i in range(40)], getattr(m, method)(X).reshape(40, -1))
    step = {(r["fold"], r["trial"]): r["value"] for r in fitted.call("transform", df, from_step=0).collect()}
    np.testing.assert_allclose([step[2, i] for i in range(40)], own[2][0].transform(X))
    coef = {r["fold"]: np.reshape(r["value"], r["shape"]) for r in fitted.collect("coef_").collect()}
    np.testing.assert_allclose(coef[1], own[1][-1].coef_)
    mean = {r["fold"]: r["value"] for r in fitted.collect("mean_", from_step=0).collect()}
    np.testing.assert_allclose(mean[3], X[:30].mean(0))
    whole = {(r["fold"], r["metric"]): r["score"] for r in fitted.score(df).collect()}
    assert whole[0, "accuracy"] == (own[0].predict(X) == y).mean()
    with pytest.raises(Exception, match="has no"):
        fitted.call("nothing", df).collect()


@pytest.mark.parametrize("most", [1 << 28, 0])
def test_sliding_over_keys(spark, monkeypatch, most):
    monkeypatch.setattr(tasks, "MOST_MODELS", most)
    rng = np.random.default_rng(3)
    X, Y = rng.standard_normal((60, 3)), rng.standard_normal((60, 1))
    df = blocks(spark, X, Y, g=np.repeat([0, 1], 30).tolist())
    fitted = tasks.Sliding(local.RidgeCV(1.0), ["g"]).fit(df)
    own = local.RidgeCV(1.0).fit(X[30:], Y[30:])
    got = {r["trial"]: r["value"] for r in fitted.predict(df).where("g = 1").collect()}
    np.testing.assert_allclose([got[i] for i in range(30, 60)], own.predict(X[30:]))
    scores = {r["g"]: r["score"] for r in fitted.score(df).collect()}
    np.testing.assert_allclose(scores[1], own.score(X[30:], Y[30:])[0])
    np.testing.assert_allclose([r["value"] for r in fitted.collect("coef_").where("g = 1").collect()][0], own.coef_.ravel())
    bare = {r["g"]: r["value"] for r in tasks.Sliding(lambda A, B: A.T @ B, ["g"]).fit(df).transform(df).collect()}
    np.testing.assert_allclose(bare[0], (X[:30].T @ Y[:30]).ravel())
    # targets without the key are those of all its values
    wide = spark.createDataFrame([(t, i, X[i + 20 * t].tolist()) for t in range(3) for i in range(20)], "g long, trial long, x array<double>")
    targets = spark.createDataFrame([(i, Y[i].tolist()) for i in range(20)], "trial long, y array<double>")
    s = tasks.Sliding(local.RidgeCV(1.0), ["g"])
    coef = {r["g"]: r["value"] for r in s.collect(s.with_targets(wide, targets), ["coef_"]).collect()}
    np.testing.assert_allclose(coef[2], local.RidgeCV(1.0).fit(X[40:], Y[:20]).coef_.ravel())
    scaled = tasks.Sliding(local.BlockScaler(), ["g"]).fit_transform(df).where("g = 0").orderBy("trial").collect()
    np.testing.assert_allclose([r["value"] for r in scaled], (X[:30] - X[:30].mean(0)) / X[:30].std(0, ddof=1))


@pytest.mark.parametrize("intercept", [True, False])
def test_encoder_over_time_is_ridge_on_the_expanded_design(spark, intercept):
    rng = np.random.default_rng(4)
    X, Y = rng.standard_normal((25, 3, 4)) + 1, rng.standard_normal((25, 2, 4))
    Y[:, 0] += X[:, 1] * np.arange(4)
    alphas = [0.1, 3.0, 100.0]
    m = local.RidgeEncoder(alphas, intercept).fit(X, Y)
    assert m.coef_.shape == (2, 3, 4) and m.predict(X).shape == Y.shape
    df = spark.createDataFrame([(t, X[i, :, t].tolist(), Y[i, :, t].tolist()) for i in range(25) for t in range(4)], "t int, x array<double>, y array<double>")
    got = {r["t"]: r for r in gram.ridge_encoder(df, "t", alphas, intercept).collect()}
    assert got[0]["alpha"] == [m.alpha_] * 2
    for t in range(4):
        np.testing.assert_allclose(got[t]["coef"], m.coef_[:, :, t], rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(got[3]["intercept"], m.intercept_, rtol=1e-7, atol=1e-9)
    assert gram.ridge_encoder(df.where("false")).count() == 0


def test_pairwise_classifiers():
    rng = np.random.default_rng(5)
    y = np.repeat([0, 1, 2], 20)[:, None]
    X = rng.standard_normal((60, 2)) + 3 * np.array([[0, 0], [1, 0], [0, 1]])[y[:, 0]]
    for one in (local.RidgeClassifier(1.0, method="OvO"), local.SVC(method="OvO"), local.SVC(kernel="rbf"), local.RidgeClassifier(1.0, normalise=True)):
        m = one.fit(X, y)
        assert (m.predict(X) == y).mean() > 0.8
        p = m.predict_proba(X)
        np.testing.assert_allclose(p.sum(1), 1, atol=1e-6)
    votes = np.zeros((60, 3))
    for j in range(3):
        for k in range(j):
            own = np.isin(y[:, 0], (j, k))
            votes[np.arange(60), local.RidgeClassifier(1.0).fit(X[own], y[own]).predict(X)[:, 0].astype(int)] += 1
    assert (local.RidgeClassifier(1.0, method="OvO").fit(X, y).predict(X)[:, 0] == votes.argmax(1)).all()
    assert local.Classifier(local.RidgeClassifier, "OvO", (1.0,), {"fit_intercept": True}).fit(X, y).predict(X).shape == (60, 1)
    a, b = local.RidgeClassifier(1e-9).fit(X, y), local.RidgeClassifier(1e-9, normalise=True).fit(X, y)
    np.testing.assert_allclose(a.coef_, b.coef_, rtol=1e-5)
    with pytest.raises(ValueError):
        local.SVC(method="other").fit(X, y)


def test_support_vectors_meet_their_conditions():
    rng = np.random.default_rng(6)
    y = np.repeat([0.0, 1.0], 25)[:, None]
    X = rng.standard_normal((50, 2)) + 2 * y
    m = local.SVC(lr=5e-3, max_iter=40000, tol=1e-12).fit(X, y)
    L = np.where(y == 1, 1.0, -1.0)[:, 0]
    Z, a = (X - m.mean_) / m.scale_, (m.A_[:, 1] * L)
    slack = L * (Z @ (m.A_[:, 1] @ Z))
    # free vectors' gradients vanish, those at a bound point outwards
    g = 1 - slack
    assert np.abs(g[(a > 1e-6) & (a < 1 - 1e-6)]).max() < 1e-3 and (g[a <= 1e-6] < 1e-3).all() and (g[a >= 1 - 1e-6] > -1e-3).all()


@pytest.mark.parametrize("kernel", ["linear", "poly", "rbf", "sigmoid"])
def test_kernel_ridge_is_brute_force_leave_one_out(kernel):
    rng = np.random.default_rng(7)
    X, y, alphas = rng.standard_normal((15, 3)), rng.standard_normal((15, 2)), [0.5, 2.0, 20.0]
    m = local.KernelRidgeCV(alphas, kernel, 0.1).fit(X, y)
    K = local.gram(kernel, X, X, 0.1, 1.0, 3.0)
    loss = []
    for a in alphas:
        e = [y[i] - K[i, own] @ np.linalg.solve(K[np.ix_(own, own)] + a * np.eye(14), y[own]) for i in range(15) if len(own := np.delete(np.arange(15), i))]
        loss.append(np.mean(np.square(e)))
    if kernel != "sigmoid":  # not positive: rows are left out of a form that is none
        assert m.alpha_ == alphas[int(np.argmin(loss))]
    np.testing.assert_allclose(m.predict(X), K @ np.linalg.solve(K + m.alpha_ * np.eye(15), y), rtol=1e-6, atol=1e-8)


def test_back_to_back_finds_the_cause():
    rng = np.random.default_rng(8)
    y = rng.standard_normal((400, 2))
    y[:, 1] += y[:, 0]
    X = y[:, :1] @ rng.standard_normal((1, 6)) + 0.3 * rng.standard_normal((400, 6))
    m = local.B2B([0.01, 1.0]).fit(X, y)
    assert m.causal_[0] > 0.5 and abs(m.causal_[1]) < 0.25 * m.causal_[0] and m.pattern_.shape == (6, 2)
    half = local.RidgeDecoder([0.01, 1.0]).fit(X[:200], y[:200])
    z = half.predict(X[200:])
    z = (z - z.mean(0)) / z.std(0, ddof=1)
    np.testing.assert_allclose(m.causal_, np.diag(local.RidgeCV([0.01, 1.0]).fit(z, y[200:]).coef_))


def test_lagged_models(spark):
    rng = np.random.default_rng(9)
    X, Y = rng.standard_normal((6, 2, 20)), rng.standard_normal((6, 3, 20))
    m = local.TimeDelayed(-0.2, 0.1, 10, [0.1, 10.0], patterns=True).fit(X, Y)
    assert m.coef_.shape == m.pattern_.shape == (3, 2, 4) and m.predict(X).shape == Y.shape
    np.testing.assert_allclose(m.predict(X, reshape=False), np.concatenate([v.T for v in m.predict(X)]))
    D = np.concatenate([local.lagged(x, m.window_) for x in X])
    want = np.cov(D.T) @ m.flat_.T @ np.linalg.pinv(np.cov(np.concatenate([v.T for v in Y]).T))
    np.testing.assert_allclose(m.pattern_[1, 0], want[:4, 1][::-1], rtol=1e-8)
    rows = [(i, t, X[i, :, t].tolist(), Y[i, :, t].tolist()) for i in range(6) for t in range(20)]
    df = spark.createDataFrame(rows, "trial long, t long, x array<double>, y array<double>")
    long = series.time_delayed(df, ["trial"], -0.2, 0.1, 10, [0.1, 10.0]).first()
    np.testing.assert_allclose(long["coef"], m.coef_, rtol=1e-7, atol=1e-10)
    for kind in ("ridge", "laplacian"):
        r = local.ReceptiveField(-2, 3, 1, 0.5, kind, patterns=True).fit(X, Y)
        long = series.receptive_field(df, ["trial"], -2, 3, 1, 0.5, kind).first()
        np.testing.assert_allclose(long["coef"], r.coef_, rtol=1e-7, atol=1e-10)
        np.testing.assert_allclose(long["intercept"], r.intercept_, rtol=1e-7, atol=1e-10)
        assert r.pattern_.shape == r.coef_.shape
    assert series.receptive_field(df.where("false"), ["trial"], -2, 3, 1, fit_intercept=False).count() == 0
    # leave-one-out over time points, by brute force on the same centred design
    r = local.ReceptiveField(0, 1, 1, [0.1, 5.0, 500.0], reg_cv="LOO").fit(X, Y)
    A = np.concatenate([local.lagged(x - X.mean((0, 2))[:, None], -r.window_, "zero") for x in X])
    B = np.concatenate([(v - Y.mean((0, 2))[:, None]).T for v in Y])
    loss = []
    for a in (0.1, 5.0, 500.0):
        e = [B[i] - A[i] @ np.linalg.solve(np.delete(A, i, 0).T @ np.delete(A, i, 0) + a * np.eye(4), np.delete(A, i, 0).T @ np.delete(B, i, 0)) for i in range(len(A))]
        loss.append(np.mean(np.square(e)))
    assert r.alpha_ == [0.1, 5.0, 500.0][int(np.argmin(loss))]
    # without correction products run over the padding: autocorrelations of the whole padded signal
    x = X[0, 0]
    free = local.ReceptiveField(0, 2, 1, 1.0, fit_intercept=False, edge_correction=False)
    free.fit(X[:1, :1], Y[:1, :1])
    d = free._design(X[0, :1])
    np.testing.assert_allclose((d.T @ d)[0], [x @ x, x[1:] @ x[:-1], x[2:] @ x[:-2]])


@pytest.mark.parametrize("slack,few", [(0.002, 2000), (0.05, 10)])
def test_positions_ranks_and_quantiles_over_ranges(spark, slack, few):
    rng = np.random.default_rng(10)
    rows = [(i, [None, 1, 1, 1, 2][i % 5], float(rng.integers(0, 40)) if i % 7 else 5.0) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g long, v double")
    got = {r["id"]: r["p"] for r in order.before(df, [], [F.col("v"), F.col("id")], "p", rows=50).collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    ranks = {r["id"]: r["rank"] for r in order.ranked(df, ["g"], "v", rows=20).collect()}
    q = {r["g"]: r for r in order.quantiles(df, ["g"], "v", [0.1, 0.5, 0.77], slack=slack, few=few).collect()}
    odd = {r["g"]: r for r in order.quantiles(df.where("id < 695"), ["g"], "v", [0.1, 0.5, 0.77], odd_lower=True, slack=slack, few=few).collect()}
    for g in (None, 1, 2):
        own = [r for r in rows if r[1] == g]
        v = np.array([r[2] for r in own])
        want = [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]
        assert [ranks[r[0]] for r in own] == want
        np.testing.assert_allclose(q[g]["q"], np.quantile(v, [0.1, 0.5, 0.77]))
        w = np.array([r[2] for r in own if r[0] < 695])
        assert odd[g]["n"] == len(w)
        np.testing.assert_allclose(odd[g]["q"], np.quantile(w, [0.1, 0.5, 0.77], method="lower" if len(w) % 2 else "linear"))
    assert order.quantiles(df.where("false"), ["g"], "v", [0.5]).count() == 0
    many = np.round(rng.standard_normal(30000), 3)
    wide = spark.createDataFrame([(float(x),) for x in many], "v double").repartition(7)
    for qs in ([0.0, 0.25, 0.5, 0.999, 1.0], [0.05, 0.95]):
        np.testing.assert_allclose(order.quantiles(wide, [], "v", qs).first()["q"], np.quantile(many, qs))


def test_dissimilarities_in_small_tiles(spark):
    rng = np.random.default_rng(11)
    X = rng.standard_normal((23, 5))
    df = spark.createDataFrame([(int(i % 2), i, x.tolist()) for i, x in enumerate(X)], "g long, trial long, x array<double>")
    for name, f in rsa.ESTIMATORS.items():
        a = {(r["i"], r["j"]): r["value"] for r in rsa.rsa(df, name, tile=4).collect()}
        b = {(r["i"], r["j"]): r["value"] for r in rsa.rsa(df, f, tile=5).collect()}
        assert a.keys() == b.keys() == {(i, j) for j in range(23) for i in range(j)}
        np.testing.assert_allclose([a[k] for k in a], [b[k] for k in a], atol=1e-7)
    keyed = rsa.rsa(df, "euclidean", ["g"], tile=3)
    assert keyed.count() == 12 * 11 // 2 + 11 * 10 // 2
    full = rsa.full_rdm(keyed, ["g"]).collect()
    assert len(full) == 144 + 121 and sum(np.isnan(r["value"]) for r in full) == 23
    order_matters = rsa.rsa(df, lambda a, b: F.get(a, F.lit(0)) - F.get(b, F.lit(0)), tile=4).collect()
    np.testing.assert_allclose([r["value"] for r in order_matters], [X[r["i"], 0] - X[r["j"], 0] for r in order_matters])


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0]), ([2.0, 1.0], [2.0]), ([3.0, 5.0], [2.5]), (None, [1.0]), ([1.0, None], [1.0]), ([1.0, 1.0], None)], "x array<double>, y array<double>")
    m = gram.ridge_cv(df, alphas=[0.1, 1.0]).first()
    want = local.RidgeCV([0.1, 1.0]).fit([[1, 2], [2, 1], [3, 5]], [1, 2, 2.5])
    np.testing.assert_allclose(m["coef"], want.coef_)
    assert gram.ridge_cv(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        rsa.covariance_fit(df.where("false"))
    with pytest.raises(ValueError, match="labels"):
        preprocessing.LabelBinariser(most_labels=5).fit(spark.range(9).select(F.array("id").alias("y")))
    with pytest.raises(ValueError):
        splits.StratifiedKFold(5).assign(spark.range(3).select(F.col("id").alias("trial"), F.col("id").alias("y")))


def test_whitening_is_of_each_time_point(spark):
    rng = np.random.default_rng(12)
    X = rng.standard_normal((30, 4, 3)) @ np.diag([1.0, 2.0, 3.0])
    df = spark.createDataFrame([(i, t, X[i, t].tolist()) for i in range(30) for t in range(4)], "trial long, t long, x array<double>")
    c = rsa.Covariance("oas", 1, 3).fit(df)
    flat = X[:, 1:3].reshape(-1, 3)
    Z = flat - flat.mean(0)
    want, shrink = local.covariance(Z.T @ Z / 60, 60, "oas")
    np.testing.assert_allclose(c.covariance_, want)
    got = {(r["trial"], r["t"]): r["x"] for r in c.transform(df).collect()}
    np.testing.assert_allclose(got[7, 3], local.whitener(want) @ X[7, 3])
    with pytest.raises(ValueError):
        c.clone().transform(df)
    own = rsa.Covariance(lambda S, n, phi: (2 * S, 0.5)).fit(df)
    np.testing.assert_allclose(own.covariance_, 2 * rsa.Covariance("empirical").fit(df).covariance_)
    A = np.random.default_rng(0).standard_normal((10, 3))
    a, b = (local.KernelRidgeCV(1.0, k).fit(A, A[:, :1]).predict(A) for k in ("linear", lambda a, b: a @ b.T))
    np.testing.assert_allclose(a, b)


def test_generators(spark):
    share = []
    for snr in (0.05, 1.0, 20.0):
        m = generators._Maker("continuous", 16, 1.0, 0.25, 1.0, 2.0, 100, 20, 2, 2, 1.0, 0.5, 3, True, True, 0.001, 0.1, 2, 1.0, 0.2)
        m.settle(12, snr)
        back, fore, _ = zip(*[m.parts(i) for i in range(12)])
        share.append(np.square(np.array(back) * m.scale).mean() / np.square(fore).mean())
    assert share[0] > 20 * share[1] > 400 * share[2]  # the larger snr, the less background
    df = generators.make_meeg_categorical(spark, n_trials=12, n_channels=9, n_classes=3, fs=50).cache()
    labels = {r["trial"]: r["x"] for r in df.where("t = 0").collect()}
    assert [sum(x == [k] for x in labels.values()) for k in range(3)] == [4, 4, 4] and [labels[i] for i in range(12)] != [[i % 3] for i in range(12)]
    y = np.array([r["y"] for r in df.collect()])
    assert df.count() == 12 * 100 and y.shape[1] == 9 and abs(y.std() - 1) < 0.3
    events = generators.make_meeg_discrete(spark, n_trials=3, n_channels=4, fs=50).collect()
    assert sum(abs(r["x"][0]) > 0 for r in events if r["trial"] == 0) >= 2
    pos = generators.layout(10)
    assert pos.shape == (10, 3) and np.allclose((pos**2).sum(1), 1)


def test_utilities(spark, monkeypatch):
    import io

    monkeypatch.setenv("TRIALWISE_FLAG", " Yes ")
    assert utilities.is_enabled("TRIALWISE_FLAG") and not utilities.is_enabled("TRIALWISE_FLAG", flag=False) and utilities.is_enabled("TRIALWISE_NONE", True)
    assert utilities.get_var("TRIALWISE_NONE", "x") == "x" and utilities.get_var("TRIALWISE_FLAG", flag="y") == "y"
    ordered = ["0.9", "1.0.dev2", "1.0a1", "1.0rc1", "1.0", "1.0.post1", "1.0.1", "1.10"]
    for i, a in enumerate(ordered):
        for j, b in enumerate(ordered):
            assert utilities.compare(a, "<", b) == (i < j) and utilities.compare(a, ">=", b) == (i >= j)
    assert utilities.compare("1.0", "==", "1") and utilities.compare("2.4.0+cu12", ">", "2.3")
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],)], "x array<double>")
    for flag in ("1", "0"):
        monkeypatch.setenv("TRIALWISE_BATCHED", flag)
        top = utilities.batched("double")(lambda x: np.max(np.asarray(x)))
        assert [r["m"] for r in df.select(top("x").alias("m")).collect()] == [2.0, 5.0]
    out = io.StringIO()
    with utilities.Progress(spark, "counting", every=0.01, out=out):
        spark.range(10**6).repartition(8).count()
    assert "counting" in out.getvalue()


@pytest.mark.parametrize("dims", [None, (0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)])
@pytest.mark.parametrize("mean,std", [(True, True), (True, False), (False, True), (False, False)])
def test_scaler_over_any_axes(spark, dims, mean, std):
    """Axes of (trials, features, times): trial and time are keys, features are positions."""
    X = np.random.default_rng(42).standard_normal((12, 8, 4))
    rows = [(i, t, X[i, :, t].tolist()) for i in range(12) for t in range(4)]
    df = spark.createDataFrame(rows, "trial long, t long, x array<double>")
    reduced = dims or (0,)
    by = [k for k, d in (("trial", 0), ("t", 2)) if d not in reduced]
    m = preprocessing.Scaler(mean, std, by=by, per_feature=1 not in reduced).fit(df)
    out = m.transform(df)
    n = np.prod([X.shape[d] for d in reduced])
    mid = X.mean(reduced, keepdims=True)
    s = X.std(reduced, ddof=1, keepdims=True) if n > 1 else np.ones_like(mid)
    want = (X - mid * mean) / np.where((s == 0) | np.isnan(s), 1, s) if std else X - mid * mean
    got = np.empty_like(X)
    for r in out.collect():
        got[r["trial"], :, r["t"]] = r["x"]
    np.testing.assert_allclose(got, want, atol=1e-12)
    for r in m.inverse_transform(out).collect():
        got[r["trial"], :, r["t"]] = r["x"]
    np.testing.assert_allclose(got, X, atol=1e-12)


def test_scaler_fits_some_rows_and_scales_others(spark):
    X = np.random.default_rng(42).standard_normal((10, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "trial long, x array<double>")
    m = preprocessing.Scaler().fit(df.where("trial < 5"))
    got = np.array([r["x"] for r in m.transform(df.where("trial >= 5")).orderBy("trial").collect()])
    np.testing.assert_allclose(got, (X[5:] - X[:5].mean(0)) / X[:5].std(0, ddof=1), atol=1e-12)
    flat = df.select("trial", F.slice("x", 1, 1).alias("x"))
    one = np.array([r["x"] for r in preprocessing.Scaler().fit_transform(flat).orderBy("trial").collect()])
    np.testing.assert_allclose(one[:, 0], (X[:, 0] - X[:, 0].mean()) / X[:, 0].std(ddof=1), atol=1e-12)
