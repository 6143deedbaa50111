"""Methods over tables against the same methods on one block."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from trialwise.functions import order
from trialwise.operators import classes, duals, gram, keyed, local, preprocessing, rsa, series, splits, tasks, tiles


def frame(spark, X, y=None, **more):
    cols = {k: v.tolist() for k, v in more.items()}
    rows = [(i, x.tolist(), *([np.atleast_1d(y[i]).tolist()] if y is not None else []), *[c[i] for c in cols.values()]) for i, x in enumerate(X)]
    kinds = "trial long, x array<double>" + (", y array<double>" if y is not None else "") + "".join(f", {k} {'double' if isinstance(c[0], float) else 'long'}" for k, c in cols.items())
    return spark.createDataFrame(rows, kinds)


def by_trial(df, name):
    rows = sorted(df.collect(), key=lambda r: r["trial"])
    return np.array([r[name] for r in rows])


@pytest.mark.parametrize("kernel,per_target", [("rbf", False), ("linear", True)])
def test_kernel_ridge_of_many_tiles_is_the_dense_one(spark, kernel, per_target):
    rng = np.random.default_rng(0)
    X, Y = rng.standard_normal((120, 5)), rng.standard_normal((120, 2))
    Y[:, 0] += X[:, 0] * 2
    alphas = [0.1, 1.0, 10.0, 100.0]
    want = local.KernelRidgeCV(alphas, kernel, alpha_per_target=per_target).fit(X, Y)
    got = tiles.KernelRidge(alphas, kernel, alpha_per_target=per_target, tile=12).fit(frame(spark, X, Y))
    assert len(got.tiles.sizes) == 10 and np.allclose(got.alpha_, want.alpha_)
    np.testing.assert_allclose(by_trial(got.dual(), "dual"), want.A_dual_, atol=1e-6)
    new = rng.standard_normal((30, 5))
    np.testing.assert_allclose(by_trial(got.predict(frame(spark, new)), "predict"), want.predict(new), atol=1e-6)
    if kernel == "linear":
        np.testing.assert_allclose(got.coefficients(), want.coef_.T, atol=1e-6)


def test_kernel_ridge_folds_share_their_tiles(spark):
    rng = np.random.default_rng(1)
    X = rng.standard_normal((90, 4))
    y = np.sin(X[:, :1]) + 0.1 * rng.standard_normal((90, 1))
    own = np.arange(90) % 3
    got = tiles.KernelRidge([0.1, 1.0], "rbf", gamma=0.3, tile=16).predictions(frame(spark, X, y, own=own)).orderBy("trial").collect()
    for f in range(3):
        m = local.KernelRidgeCV([0.1, 1.0], "rbf", gamma=0.3).fit(X[own != f], y[own != f])
        np.testing.assert_allclose([r["predict"] for r in got if r["own"] == f], m.predict(X[own == f]), atol=1e-6)
        assert all(np.isclose(r["base"][0], y[own != f].mean()) for r in got if r["own"] == f)
    assert tiles.KernelRidge().predictions(frame(spark, X, y, own=own * 0)).count() == 0


def test_kernel_ridge_with_probes_and_nulls(spark):
    rng = np.random.default_rng(2)
    X = rng.standard_normal((100, 3))
    y = X @ rng.standard_normal((3, 1)) + 0.5 * rng.standard_normal((100, 1))
    want = local.KernelRidgeCV([1.0, 1e4], "linear").fit(X, y)
    df = frame(spark, X, y).union(spark.createDataFrame([(900, None, [1.0]), (901, [1.0, None, 2.0], [1.0]), (902, [1.0, 1.0, 1.0], None)], "trial long, x array<double>, y array<double>"))
    got = tiles.KernelRidge([1.0, 1e4], "linear", tile=24, probes=32).fit(df)
    assert got.alpha_ == want.alpha_ and got.dual().count() == 100
    np.testing.assert_allclose(got.coefficients(), want.coef_.T, atol=1e-6)
    with pytest.raises(ValueError):
        tiles.KernelRidge().fit(df.where("false"))
    with pytest.raises(ValueError):
        tiles.KernelRidge(0.0).fit(df)


def test_support_vectors_of_many_tiles(spark):
    kernel, rng = "rbf", np.random.default_rng(3)
    label = rng.integers(0, 3, 60)
    X = rng.standard_normal((60, 4)) + 1.5 * np.eye(4)[label] * [1, 5, 1, 1]
    X[:, 3] = 2.0  # a feature without spread
    got = tiles.SupportVectors(kernel=kernel, tile=16, tol=1e-2).fit(frame(spark, X, label=label))
    s = X.std(0, ddof=1)
    Z = (X - X.mean(0)) / np.where(s == 0, 1, s)
    K = local.gram(kernel, Z, Z, got.gamma_)
    assert np.isclose(got.gamma_, 1 / (4 * Z.var()))
    L, A = np.where(label[:, None] == np.arange(3), 1.0, -1.0), by_trial(got.dual(), "dual")
    a, g = A * L, 1 - L * (K @ A)
    assert (a >= 0).all() and (a <= 1).all()
    # optimal in the box: no gradient leads inwards
    assert (np.abs(np.clip(a + g, 0, 1) - a) <= 1.0001e-2).all()
    on = (a > 1e-9) & (a < 1 - 1e-9)
    icpt = [((L - K @ A)[on[:, c], c]).mean() for c in range(3)]
    np.testing.assert_allclose(got.intercept_, icpt, atol=1e-4)
    decision = by_trial(got.decision_function(frame(spark, X)), "predict")
    np.testing.assert_allclose(decision, K @ A + icpt, atol=1e-4)
    assert (by_trial(got.predict(frame(spark, X)), "label") == decision.argmax(1)).all() and (decision.argmax(1) == label).mean() > 0.7
    with pytest.raises(ValueError):
        tiles.SupportVectors().fit(frame(spark, X, label=label * 0))


@pytest.mark.parametrize("n,p", [(10, 20), (20, 10)])
@pytest.mark.parametrize("intercept,per_target", [(True, False), (False, True)])
def test_wide_ridge_is_ridge(spark, n, p, intercept, per_target):
    rng = np.random.default_rng(42)
    X, Y, alphas = rng.standard_normal((n, p)) + 3, rng.standard_normal((n, 3)) - 5, np.logspace(-2, 3, 6)
    want = local.RidgeCV(alphas, intercept, per_target).fit(X, Y)
    got = tiles.wide_ridge(frame(spark, X, Y), alphas, intercept, per_target, tile=6).first()
    np.testing.assert_allclose(got["coef"], want.coef_, atol=1e-7)
    np.testing.assert_allclose(got["intercept"], np.broadcast_to(want.intercept_, 3), atol=1e-6)
    np.testing.assert_allclose(got["alpha"], np.broadcast_to(want.alpha_, 3))


def test_more_features_than_a_matrix_holds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    X, Y = rng.standard_normal((12, 40)), rng.standard_normal((12, 1))
    monkeypatch.setattr(gram, "MOST_FEATURES", 32)
    got = gram.ridge_cv(frame(spark, X, Y), [], [0.1, 10.0]).first()
    np.testing.assert_allclose(got["coef"], local.RidgeCV([0.1, 10.0]).fit(X, Y).coef_, atol=1e-7)
    assert gram.ridge_cv(frame(spark, X, Y).where("false"), [], [0.1, 10.0]).count() == 0


@pytest.mark.parametrize("alphas", [[1.0], [0.01, 1.0, 100.0]])
def test_ridge_of_keys_on_executors(spark, monkeypatch, alphas):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 7, 400)
    X, Y = rng.standard_normal((400, 3)), rng.standard_normal((400, 2))
    monkeypatch.setattr(keyed, "PART", 5)  # sums in several parts
    monkeypatch.setattr(keyed, "ROWS", 16)  # keys in several pieces
    df = frame(spark, X, Y, g=g).withColumn("h", F.when(F.col("g") > 0, F.col("g").cast("string"))).repartition(5)
    got = {(r["g"], r["h"]): r for r in gram.ridge_cv(df, ["g", "h"], alphas).collect()}
    assert len(got) == 7 and (0, None) in got
    for (k, _), r in got.items():
        m = local.RidgeCV(alphas).fit(X[g == k], Y[g == k])
        np.testing.assert_allclose(r["coef"], m.coef_, atol=1e-8)
        np.testing.assert_allclose(r["intercept"], m.intercept_, atol=1e-8)
        assert np.allclose(r["alpha"], m.alpha_)
    assert gram.ridge_cv(df.where("false"), ["g"], alphas).count() == 0


def test_ridge_of_many_keys_never_meets_the_driver(spark, monkeypatch):
    """100,000 keys of four trials: nothing is collected but one number."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows = spark.range(400_000).select((F.col("id") % 100_000).alias("k"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("x"), F.array(F.sin(F.col("id") * 7)).alias("y"))
    collect, seen = DataFrame.collect, []
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, None)
    m = gram.ridge_cv(rows, ["k"], [0.1, 1.0])
    monkeypatch.undo()
    assert sum(map(len, seen)) <= 1 and m.count() == 100_000
    own = np.array([[k + 100_000 * i for i in range(4)] for k in (3, 77_777)], float)
    for k, ids in zip((3, 77_777), own):
        want = local.RidgeCV([0.1, 1.0]).fit(np.stack([np.sin(ids), np.cos(ids * 3)], 1), np.sin(ids * 7))
        got = m.where(F.col("k") == k).first()
        np.testing.assert_allclose(got["coef"], want.coef_, atol=1e-8)


def labelled(spark, n=120, seed=6):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 4, n).astype(float) * 2
    X = rng.standard_normal((n, 5)) + np.eye(5)[(y / 2).astype(int)]
    return X, y, frame(spark, X, y)


@pytest.mark.parametrize("method", ["OvR", "OvO"])
@pytest.mark.parametrize("alphas", [[1.0], [0.01, 1.0, 100.0]])
def test_classifiers_by_class_sums(spark, monkeypatch, method, alphas):
    X, y, df = labelled(spark)
    model = local.RidgeClassifier(alphas, method=method)
    metrics = (tasks.accuracy,) if method == "OvO" else (tasks.accuracy, tasks.roc_auc)
    got = sorted(map(tuple, tasks.cross_val_score(model, df, 3, metrics).collect()))
    monkeypatch.setattr(tasks.Validator, "class_models", lambda *a: None)
    want = sorted(map(tuple, tasks.cross_val_score(model, df, 3, metrics).collect()))
    assert [r[:4] for r in got] == [r[:4] for r in want] and len(got) == 3 * len(metrics)
    np.testing.assert_allclose([r[4] for r in got], [r[4] for r in want], atol=1e-9)
    # decisions and probabilities of every trial by the models that have not seen it
    dealt = splits.KFold(3).assign(df, "trial").withColumns({"repeat": F.lit(0), "c": F.col("y")[0]})
    m = classes.ClassModels(dealt, [], "fold", "c", alphas, True, False, method)
    for proba in (False, True):
        rows = {r["trial"]: r for r in m.decide(dealt, proba=proba).collect()}
        for f in range(3):
            at = [i for i, r in rows.items() if r["fold"] == f]
            own = model.clone().fit(np.delete(X, at, 0), np.delete(y, at))
            assert (own.predict(X[at])[:, 0] == [rows[i]["predict"] for i in at]).all() or proba
            if proba or method == "OvR":
                np.testing.assert_allclose([rows[i]["decision"] for i in at], own.predict_proba(X[at]) if proba else own.decision_function(X[at]), atol=1e-8)


def test_keys_in_one_fold_have_no_scores(spark, monkeypatch):
    X, y, df = labelled(spark, 40)
    keyed_ = df.withColumn("g", F.when(F.col("trial") == 7, "b").otherwise("a"))
    nulls = spark.createDataFrame([(900, None, [2.0], "a"), (901, [1.0] * 5, None, "a"), (902, [1.0] * 5, [None], "a")], "trial long, x array<double>, y array<double>, g string")
    for model, metric, name in ((local.RidgeClassifier([0.1, 1.0]), tasks.accuracy, "class_models"), (local.RidgeCV([0.1, 1.0]), tasks.r2, "_by_sums")):
        sums = sorted(map(tuple, tasks.cross_val_score(model, keyed_, 4, metric, keys=["g"]).collect()))
        with monkeypatch.context() as m:
            m.setattr(tasks.Validator, name, lambda *a: None)
            block = sorted(map(tuple, tasks.cross_val_score(model, keyed_, 4, metric, keys=["g"]).collect()))
        assert len(sums) == 4 and [r[:5] for r in sums] == [r[:5] for r in block] and {r[0] for r in sums} == {"a"}
        np.testing.assert_allclose([r[5] for r in sums], [r[5] for r in block], atol=1e-9)
    assert tasks.cross_val_score(local.RidgeClassifier([0.1]), df.union(nulls.drop("g")), 4, tasks.accuracy).count() == 4


def test_rank_metrics_of_all_folds_and_masks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    X = rng.standard_normal((80, 3))
    Y = np.round(X @ rng.standard_normal((3, 2)) + 0.5 * rng.standard_normal((80, 2)), 1)
    df, masks = frame(spark, X, Y), [np.array(m, bool) for m in ([1, 0, 1], [1, 1, 1])]
    v = tasks.Validator(local.RidgeCV([0.1, 10.0]), 4, (tasks.r2, tasks.spearmanr))
    got = {tuple(r)[:-1]: r["score"] for r in v.scores(df, masks=masks).collect()}
    monkeypatch.setattr(tasks.Validator, "_by_sums", lambda self: False)
    want = {tuple(r)[:-1]: r["score"] for r in v.scores(df, masks=masks).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 4 * 2 * 2
    np.testing.assert_allclose([got[k] for k in want], [*want.values()], atol=1e-9)


def test_shapley_orders_have_folds_of_their_own(spark):
    rng = np.random.default_rng(9)
    X = rng.standard_normal((40, 3))
    y = X @ [[2.0], [1.0], [0.0]] + rng.standard_normal((40, 1))
    df, groups = frame(spark, X, y), np.eye(3, dtype=bool)
    s = tasks.Shapley(tasks.Validator(local.RidgeCV([0.1, 10.0]), 4), 3, seed=5, shuffle=True)
    got = {(r["permutation"], r["group"], r["fold"]): r["score"] for r in s.scores(df, groups).collect()}
    steps, masks = s.orders(groups)
    folds = [{r["trial"]: r["fold"] for r in splits.KFold(4, True, 5000 + p).assign(df.select("trial")).collect()} for p in range(3)]
    assert len(got) == 3 * 3 * 4 and folds[0] != folds[1] != folds[2]

    def score(p, mask, f):
        test = np.array([folds[p][i] == f for i in range(40)])
        m = local.RidgeCV([0.1, 10.0]).fit(X[~test][:, masks[mask]], y[~test])
        return 1 - ((y[test] - m.predict(X[test][:, masks[mask]])) ** 2).sum() / ((y[test] - y[~test].mean()) ** 2).sum()

    for p, g, mask, last in steps:
        for f in range(4):
            assert np.isclose(got[p, g, f], score(p, mask, f) - (score(p, last, f) if last >= 0 else 0))


@pytest.mark.parametrize("precise", [False, True])
def test_grouped_distances_with_holes(spark, monkeypatch, precise):
    rng = np.random.default_rng(10)
    monkeypatch.setattr(rsa, "GROUPS", 2)
    monkeypatch.setattr(rsa, "CHUNK", 9)
    X, there = rng.standard_normal((2, 12, 5, 3)), rng.random((2, 12, 5)) < 0.7
    there[0, :, 4] = [True] + [False] * 11
    P = np.eye(3) * 2 + 0.3 if precise else None
    rows = [("kx"[k], t, f"g{g}", X[k, t, g].tolist()) for k, t, g in np.argwhere(there).tolist()] + [("k", None, "g1", [1.0] * 3), ("k", 1, None, [1.0] * 3), ("k", 1, "g2", None)]
    df = spark.createDataFrame(rows, "k string, trial long, g string, x array<double>")
    got = {tuple(r)[:3]: r["value"] for r in rsa.grouped_rsa(df, ["k"], precision=None if P is None else P.tolist()).collect()}
    want = {}
    for k in range(2):
        for i in range(5):
            for j in range(i + 1, 5):
                at = there[k, :, i] & there[k, :, j]
                if at.any():
                    d, n = X[k, at, i] - X[k, at, j], at.sum()
                    M = d @ (np.eye(3) if P is None else P) @ d.T
                    want["kx"[k], f"g{i}", f"g{j}"] = (M.sum() - np.trace(M)) / n**2
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], [*want.values()], atol=1e-10)
    assert rsa.grouped_rsa(df.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("edge", ["replicate", "zero"])
def test_lagged_designs_of_long_series(spark, edge):
    rng = np.random.default_rng(11)
    rows = [(s, int(t), rng.standard_normal(2).tolist(), rng.standard_normal(2).tolist()) for s, n in ((0, 100), (1, 7), (2, 1), (None, 23)) for t in rng.permutation(n) * 3]
    df, window = spark.createDataFrame(rows, "s long, t long, x array<double>, y array<double>"), [-3, -1, 0, 2]
    a, b = (sorted(map(repr, map(tuple, d.collect()))) for d in (rsa.lagged_design(df, window, ["s"], edge=edge), rsa.lagged_ranges(df, window, ["s"], edge=edge, span=4)))
    assert a == b and len(a) == len(rows)
    # one series in fifty ranges is one block
    X, Y = (np.array([r[i] for r in sorted(rows[:100], key=lambda r: r[1])]).T[None] for i in (2, 3))
    want = local.TimeDelayed(-2, 1, 1, [0.1, 10.0], edge, True).fit(X, Y)
    got = series.time_delayed(df.where("s = 0"), ["s"], -2, 1, 1, [0.1, 10.0], edge=edge, patterns=True, span=2).first()
    np.testing.assert_allclose(got["coef"], want.coef_, atol=1e-8)
    np.testing.assert_allclose(got["pattern"], want.pattern_, atol=1e-8)


def test_back_to_back_from_sums(spark):
    rng = np.random.default_rng(12)
    X, g = rng.standard_normal((90, 4)) + 1, np.repeat([0, 1, 2], [60, 29, 1])
    Y = X @ rng.standard_normal((4, 2)) + rng.standard_normal((90, 2))
    order = rng.permutation(90)
    df = spark.createDataFrame([(int(g[i]), int(order[i]), X[i].tolist(), Y[i].tolist()) for i in range(90)] + [(0, 999, None, [1.0, 1.0])], "g long, trial long, x array<double>, y array<double>")
    got = {r["g"]: r for r in gram.back_to_back(df, ["g"], [0.1, 1.0, 10.0]).collect()}
    assert got.keys() == {0, 1}
    for k in (0, 1):
        at = [i for i in np.argsort(order) if g[i] == k]
        want = local.B2B([0.1, 1.0, 10.0]).fit(X[at], Y[at])
        np.testing.assert_allclose(got[k]["causal"], want.causal_, atol=1e-8)
        np.testing.assert_allclose(got[k]["pattern"], want.pattern_, atol=1e-8)
    assert gram.back_to_back(df.where("false"), ["g"], [0.1]).count() == 0 and gram.back_to_back(df, [], 1.0).count() == 1


@pytest.mark.parametrize("alpha,reg_cv,reg_type,edge", [(2.0, 5, "ridge", True), ([0.1, 100.0, 1e4], 3, "laplacian", True), ([0.1, 100.0, 1e4], "LOO", "ridge", True), ([0.1, 10.0], 3, "ridge", False)])
def test_receptive_fields_of_long_series(spark, alpha, reg_cv, reg_type, edge):
    rng = np.random.default_rng(13)
    n, f, d, T = 7, 2, 2, 50
    X = rng.standard_normal((n, f, T)) + 1
    Y = 3 * rng.standard_normal((n, d, T))
    Y[:, 0, 1:] += X[:, 0, :-1]
    rows = [(i, 3 * t, X[i, :, t].tolist(), Y[i, :, t].tolist()) for i in range(n) for t in range(T)] + [(0, 1, None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "s long, t long, x array<double>, y array<double>")
    want = local.ReceptiveField(-2, 3, 1, alpha, reg_type, reg_cv, patterns=True, edge_correction=edge).fit(X, Y)
    got = series.receptive_field(df, ["s"], -2, 3, 1, alpha, reg_type, reg_cv=reg_cv, patterns=True, edge_correction=edge, span=1).first()
    assert got["alpha"] == want.alpha_
    np.testing.assert_allclose(got["coef"], want.coef_, atol=1e-8)
    np.testing.assert_allclose(got["intercept"], want.intercept_, atol=1e-8)
    np.testing.assert_allclose(got["pattern"], want.pattern_, atol=1e-8)
    assert series.receptive_field(df.where("false"), ["s"], -1, 1, 1).count() == 0


def test_linear_support_vectors_of_all_folds_by_sums(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n, p = 150, 4
    X, y = rng.standard_normal((n, p)), rng.integers(0, 3, n).astype(float)
    X[:, 0] += y
    df = frame(spark, X, y)
    monkeypatch.setattr(tasks, "MOST_TRIALS", 50)
    monkeypatch.setattr(tasks.margins, "LAST", 1e-5)
    made = []
    monkeypatch.setattr(tasks.margins.LinearMargins, "remove", lambda self: made.append(self))
    got = {r["fold"]: r["score"] for r in tasks.cross_val_score(local.SVC(), df, 3, tasks.accuracy).collect()}
    for s, (_, fold) in enumerate(made[0].systems):
        test = np.arange(n) // 50 == fold
        m, sd = X[~test].mean(0), X[~test].std(0, ddof=1)
        Z, L = (X - m) / sd, np.where(y[:, None] == np.unique(y), 1.0, -1.0)
        a, K = np.zeros((100, 3)), Z[~test] @ Z[~test].T
        for _ in range(5000):  # the box dual, by short steps
            a = np.clip(a + (1 - L[~test] * (K @ (a * L[~test]))) / np.linalg.norm(K, 2), 0, 1)
        lost = lambda w: (w * w).sum(1) / 2 + np.maximum(0, 1 - L[~test] * (Z[~test] @ w.T)).sum(0)
        w = made[0].W[s]
        bound = a.sum(0) - (((a * L[~test]).T @ Z[~test]) ** 2).sum(1) / 2  # no weights lose less than any dual is worth
        assert (lost(w) >= bound).all() and np.allclose(lost(w), bound, rtol=2e-3)
        assert got[fold] == pytest.approx(((Z[test] @ w.T).argmax(1) == y[test]).mean())


def test_narrow_ridge_makes_no_products_of_trials(spark, monkeypatch):
    rng = np.random.default_rng(6)
    X, Y, alphas = rng.standard_normal((40, 5)) + 2, rng.standard_normal((40, 2)), [0.1, 1.0, 10.0]
    monkeypatch.setattr(tiles, "Tiles", None)
    want, got = local.RidgeCV(alphas).fit(X, Y), tiles.wide_ridge(frame(spark, X, Y), alphas).first()
    np.testing.assert_allclose(got["coef"], want.coef_, atol=1e-8)
    np.testing.assert_allclose(got["intercept"], want.intercept_, atol=1e-8)


def test_linear_kernel_ridge_of_folds_makes_no_products_of_trials(spark, monkeypatch):
    rng = np.random.default_rng(7)
    X, Y, own = rng.standard_normal((40, 5)) + 2, rng.standard_normal((40, 2)), np.arange(40) % 3
    monkeypatch.setattr(tiles, "Tiles", None)
    got = tiles.KernelRidge([0.1, 1.0, 10.0]).predictions(frame(spark, X, Y, own=own))
    want, base = np.zeros((40, 2)), np.zeros((40, 2))
    for f in range(3):
        want[own == f] = local.KernelRidgeCV([0.1, 1.0, 10.0]).fit(X[own != f], Y[own != f]).predict(X[own == f])
        base[own == f] = Y[own != f].mean(0)
    np.testing.assert_allclose(by_trial(got, "predict"), want, atol=1e-8)
    np.testing.assert_allclose(by_trial(got, "base"), base)
    np.testing.assert_allclose(by_trial(got, "y"), Y)


def test_linear_kernel_ridge_is_validated_by_sums(spark, monkeypatch):
    rng = np.random.default_rng(8)
    X, Y, key = rng.standard_normal((60, 4)) + 1, rng.standard_normal((60, 2)), np.arange(60) % 2
    df, model = frame(spark, X, Y, g=key), local.KernelRidgeCV([0.1, 1.0, 10.0])
    blocks = {(r["g"], r["fold"], r["metric"], r["target"]): r["score"] for r in tasks.Validator(model, 3, (tasks.r2, tasks.pearsonr)).fit(df, ["g"]).scores().collect()}
    monkeypatch.setattr(tasks, "run_tasks", None)
    got = {(r["g"], r["fold"], r["metric"], r["target"]): r["score"] for r in tasks.cross_val_score(model, df, 3, (tasks.r2, tasks.pearsonr), keys=["g"]).collect()}
    assert got.keys() == blocks.keys() and all(np.isclose(got[k], v) for k, v in blocks.items())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("model", [preprocessing.Scaler(by=["g"]), preprocessing.RobustScaler(by=["g"]), *[preprocessing.Clamp(method=m) for m in ("iqr", "quantile", "mad")]])
def test_few_keys_gather_no_rows(spark, monkeypatch, model):
    rng = np.random.default_rng(9)
    df = frame(spark, rng.standard_normal((90, 2)), g=np.arange(90) % 3)
    monkeypatch.setattr(order, "SENT", 1 << 14)
    few = model.fit(df)
    assert "SortMergeJoin" not in _plan(few.table) + _plan(few.transform(df))
    weighed = preprocessing.Scaler(by=["g"]).fit(df, weight="g")
    assert "SortMergeJoin" not in _plan(weighed.table)
    monkeypatch.setattr(order, "SENT", 2 if model.by else 1 << 14)
    np.testing.assert_allclose(by_trial(few.transform(df), "x"), by_trial(model.fit_transform(df), "x"))


def test_short_series_are_not_padded_to_a_range(spark, monkeypatch):
    rng, sizes, transform = np.random.default_rng(10), [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda a, n, axis: sizes.append(n) or transform(a, n, axis=axis))
    t = pa.table({"__range": [0] * 9, "__n": [9] * 9, "__fold": pa.array([0] * 9, pa.int32()), "__pos": list(range(9)), "x": rng.standard_normal((9, 1)).tolist(), "y": rng.standard_normal((9, 1)).tolist()})

    class Rows:
        def __getattr__(self, _):
            return lambda *a, **k: self

        def applyInArrow(self, work, kind):
            work(t)
            return self

        def toLocalIterator(self):
            return iter(())

    series.Lags(Rows(), ["k"], [-1, 0, 1], True, 1 << 14)
    assert sizes and max(sizes) <= 64


def test_kernel_rows_of_pairs_of_blocks(spark):
    rng = np.random.default_rng(11)
    A, B = rng.standard_normal((50, 3)), rng.standard_normal((30, 3))
    got = rsa.kernel_rows(frame(spark, A).withColumnRenamed("trial", "row"), frame(spark, B).withColumnRenamed("trial", "row"), "rbf", 0.5, block=8)
    assert "Exchange" not in _plan(got).split("MapInArrow")[1]  # from blocks to kernels nothing is shuffled
    K, rows = local.gram("rbf", A, B, 0.5), sorted(got.collect())
    assert [r["n"] for r in rows] == [30] * 50
    np.testing.assert_allclose([r["total"] for r in rows], K.sum(1))
    np.testing.assert_allclose([r["least"] for r in rows], K.min(1))


def test_both_orientations_read_the_pairs_once(spark):
    rng = np.random.default_rng(12)
    X = rng.standard_normal((7, 3))
    pairs = rsa.rsa(frame(spark, X), "euclidean")
    full = rsa.full_rdm(pairs)
    assert full._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 2  # and once for the trials
    D = np.sqrt(((X[:, None] - X) ** 2).sum(2))
    got = {(r["i"], r["j"]): r["value"] for r in full.collect()}
    assert len(got) == 49 and all(np.isnan(v) if i == j else np.isclose(v, D[i, j]) for (i, j), v in got.items())


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles_evaluate_their_sketch_once(spark, keys):
    rng = np.random.default_rng(13)
    v, g = rng.standard_normal(9000), np.arange(9000) % 2
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g long, v double")
    found = order.quantiles(df, keys, "v", [0.25, 0.5, 0.9], few=100)
    # brackets may differ between evaluations: one must serve both the rows below them and those inside
    assert found._jdf.queryExecution().optimizedPlan().toString().count("percentile_approx") == 1
    for r in found.collect():
        np.testing.assert_allclose(r["q"], np.quantile(v[g == r["g"]] if keys else v, [0.25, 0.5, 0.9]))


def test_support_vectors_store_no_kernel(spark, monkeypatch):
    """Blocks that meet in pairs, with near copies of other labels, on which steps along the gradient settle slowly; the other way is that of the test above."""
    rng = np.random.default_rng(14)
    X, label = np.repeat(rng.standard_normal((20, 3)), 2, 0) + 0.01 * rng.standard_normal((40, 3)), rng.integers(0, 2, 40)
    monkeypatch.setattr(tiles.interior, "SENT", 0)
    got = tiles.SupportVectors(kernel="rbf", tile=20, tol=1e-2, max_iter=150).fit(frame(spark, X, label=label))
    assert "k" not in got.tiles.tiles.columns
    Z = (X - X.mean(0)) / X.std(0, ddof=1)
    L, A = np.where(label[:, None] == np.arange(2), 1.0, -1.0), by_trial(got.dual(), "dual")
    a, g = A * L, 1 - L * (local.gram("rbf", Z, Z, got.gamma_) @ A)
    assert (a >= 0).all() and (a <= 1).all() and np.abs(np.clip(a + g, 0, 1) - a).max() <= 1e-2 + 1e-6


@pytest.mark.parametrize("model,swept", [(local.KernelRidgeCV([0.1, 10.0], "rbf", "scale", alpha_per_target=True), False), (local.KernelRidgeCV([0.5, 5.0], "sigmoid", 0.1), True)])
def test_kernel_ridge_of_many_trials_meets_no_task(spark, monkeypatch, model, swept):
    rng = np.random.default_rng(11)
    X, key = rng.standard_normal((150, 3)), np.r_[np.zeros(120, int), np.ones(30, int)]
    Y = np.stack([np.sin(X[:, 0]) + 0.1 * rng.standard_normal(150), rng.standard_normal(150)], 1)
    df, metrics = frame(spark, X, Y, g=key), (tasks.r2, tasks.pearsonr, tasks.spearmanr)

    def scores():
        return {(r["g"], r["fold"], r["metric"], r["target"]): r["score"] for r in tasks.cross_val_score(model, df, 3, metrics, keys=["g"]).collect()}

    want, made, most, fallen = scores(), tasks.run_tasks, [], []
    monkeypatch.setattr(tasks, "MOST_TRIALS", 40)
    for name, value in (("TILE", 16), ("BLOCKS", 2), ("RANKS", (80, 120))):
        monkeypatch.setattr(duals, name, value)
    monkeypatch.setattr(tasks, "run_tasks", lambda rows, keys, *rest: most.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0]) or made(rows, keys, *rest))
    sweeps = duals._swept
    monkeypatch.setattr(duals, "_swept", lambda *a: fallen.append(a[1:3]) or sweeps(*a))
    got = scores()
    # blocks of the larger key meet in no task; only the smaller key's trials do
    assert most == [30] and bool(fallen) == swept
    assert got.keys() == want.keys() and all(np.isclose(got[k], v, atol=1e-7) for k, v in want.items())


def test_kernel_ridge_leaves_close_alphas_open():
    own = duals.DualRidge.__new__(duals.DualRidge)
    own.model, own.alphas, own.d = local.KernelRidgeCV([0.1, 1.0]), np.array([0.1, 1.0]), 1
    far = np.array([[0.0, 0.0], [1e-3, 1e-3]])
    assert own._pick(np.array([[1.0], [1.001]]), far) is None
    assert own._pick(np.array([[1.0], [1.1]]), far).tolist() == [0] and own._pick(np.array([[1.0], [1.001]]), far * 1e-3).tolist() == [0]


@pytest.mark.parametrize("held", [64 << 20, 0])
def test_support_vectors_that_settle_apart(spark, monkeypatch, held):
    """Classes of very unlike sizes: the first that settles must not be led on until its variables round to their bounds. Few trials settle in few products, and are at their bounds exactly."""
    rng = np.random.default_rng(21)
    X, label = rng.standard_normal((120, 8)), np.r_[np.zeros(3, int), np.ones(60, int), np.full(57, 2)]
    made, product = [], tiles.interior.Near.product
    monkeypatch.setattr(tiles.interior, "HELD", held)
    monkeypatch.setattr(tiles.interior.Near, "product", lambda self, v: made.append(1) or product(self, v))
    with np.errstate(all="raise"):
        got = tiles.SupportVectors(kernel="rbf", tile=64, tol=1e-2, max_iter=150).fit(frame(spark, X, label=label))
    Z = (X - X.mean(0)) / X.std(0, ddof=1)
    L, A = np.where(label[:, None] == np.arange(3), 1.0, -1.0), by_trial(got.dual(), "dual")
    K = local.gram("rbf", Z, Z, got.gamma_)
    a, g = A * L, 1 - L * (K @ A)
    assert (a >= 0).all() and (a <= 1).all() and np.abs(np.clip(a + g, 0, 1) - a).max() <= 1e-2 + 1e-6
    assert (a == 0).any() or (a == 1).any()
    np.testing.assert_allclose(by_trial(got.own_sums(), "sums"), K @ A, atol=1e-9)
    assert len(made) <= 30 and bool(made) == bool(held)


def test_dissimilarities_copy_no_trial_to_its_tiles(spark):
    rng = np.random.default_rng(22)
    X = rng.standard_normal((45, 3))
    rows = [(f"t{i:02}", x.tolist()) for i, x in enumerate(X)]
    df = spark.createDataFrame([*rows, (None, [1.0, 2.0, 3.0])], "trial string, x array<double>")
    D, name = np.sqrt(((X[:, None] - X) ** 2).sum(2)), [r[0] for r in rows]
    pairs = rsa.rsa(df, "euclidean", tile=8)
    # from blocks to pairs nothing is shuffled, nor are trials repeated
    assert not {"Exchange", "Generate"} & set(_plan(pairs).replace("(", " ").split())
    got = {(r["i"], r["j"]): r["value"] for r in pairs.collect()}
    assert got.keys() == {(a, b) for a in name for b in name if a < b} and pairs.count() == len(got)
    assert all(np.isclose(v, D[name.index(i), name.index(j)]) for (i, j), v in got.items())
    full = rsa.whole_rdm(df, "euclidean", tile=8).collect()
    assert len(full) == 45 * 45 == len({(r["i"], r["j"]) for r in full})
    assert all(np.isnan(r["value"]) if r["i"] == r["j"] else np.isclose(r["value"], D[name.index(r["i"]), name.index(r["j"])]) for r in full)
    # rows that repeat an id are in pairs with others, not with each other, as in SQL
    twice = df.where("trial is not null").union(df.where("trial = 't03'"))
    assert rsa.rsa(twice, "euclidean", tile=8).count() == 45 * 44 // 2 + 44
    assert rsa.whole_rdm(df.where("false"), "euclidean").count() == 0 and rsa.whole_rdm(df.where("trial = 't01'"), "euclidean").count() == 1
