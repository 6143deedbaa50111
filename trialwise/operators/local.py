"""Estimators on one task's block of trials, in numpy. Spark runs them grouped (see tasks.py); where statistics are additive, gram.py fits without gathering trials."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np


class Local:
    def clone(self):
        new = copy.copy(self)
        new.__dict__ = {k: v for k, v in self.__dict__.items() if not k.endswith("_")}
        return new

    def _fitted(self, name="coef_"):
        if not hasattr(self, name):
            raise ValueError(f"{type(self).__name__} is not fitted")

    def score(self, X, y, metric=None):
        """What the metrics, by default the estimator's own, give for its answers on X."""
        from .tasks import accuracy, r2, score

        return score(self, metric or (accuracy if isinstance(self, Labelled) else r2), X, y)

    def params(self) -> dict[str, np.ndarray]:
        return {k: np.asarray(v, float) for k, v in self.__dict__.items() if k.endswith("_") and isinstance(v, (int, float, np.ndarray))}


def two_d(y: np.ndarray) -> np.ndarray:
    return y[:, None] if y.ndim == 1 else y


def checked(X, y):
    X, y = np.asarray(X, float), two_d(np.asarray(y, float))
    if X.ndim != 2 or len(X) != len(y):
        raise ValueError("X (trials, features) and y (trials, targets) must have the same trials")
    return X, y


def ridge_from_moments(n, sx, sy, xx, xy, alphas, loss, fit_intercept=True, per_target=False):
    """Coefficients (targets, features), intercept and alpha from sums; loss[alpha, target] are summed squared leave-one-out errors."""
    mx, my = (sx / n, sy / n) if fit_intercept else (np.zeros_like(sx), np.zeros_like(sy))
    c, d = xx - n * np.outer(mx, mx), xy - n * np.outer(mx, my)
    pick = loss.argmin(0) if per_target else np.full(loss.shape[1], loss.mean(1).argmin())
    w, q = np.linalg.eigh(c)
    coef = np.stack([q @ ((q.T @ d[:, t]) / (w + alphas[a])) for t, a in enumerate(pick)])
    alpha = np.asarray(alphas, float)[pick]
    return coef, my - coef @ mx, alpha if per_target else float(alpha[0])


@dataclass
class RidgeCV(Local):
    """Ridge regression; alpha by closed-form leave-one-out error, shared or per target; the first of equals wins."""

    alphas: object = 1.0
    fit_intercept: bool = True
    alpha_per_target: bool = False

    def fit(self, X, y):
        X, y = checked(X, y)
        al = np.atleast_1d(np.asarray(self.alphas, float))
        mx, my = (X.mean(0), y.mean(0)) if self.fit_intercept else (np.zeros(X.shape[1]), np.zeros(y.shape[1]))
        A, B = X - mx, y - my
        u, s, vt = np.linalg.svd(A, full_matrices=False)
        ub, loss, coefs = u.T @ B, [], []
        for a in al:
            shrink = s**2 / (s**2 + a)
            h = (u**2) @ shrink + (1 / len(X) if self.fit_intercept else 0)
            loss.append(np.mean(((B - u @ (shrink[:, None] * ub)) / (1 - h)[:, None]) ** 2, 0))
            coefs.append(vt.T @ ((s / (s**2 + a))[:, None] * ub))
        loss = np.array(loss)
        pick = loss.argmin(0) if self.alpha_per_target else np.full(y.shape[1], loss.mean(1).argmin())
        self.coef_ = np.stack([coefs[a][:, t] for t, a in enumerate(pick)])
        self.intercept_ = my - self.coef_ @ mx
        self.alpha_ = al[pick] if self.alpha_per_target else float(al[pick[0]])
        return self

    def predict(self, X):
        self._fitted()
        return np.asarray(X, float) @ self.coef_.T + self.intercept_


@dataclass
class RidgeDecoder(RidgeCV):
    """RidgeCV with patterns cov(X) coef' pinv(cov(y)); with one target the factor is 1 / (n - 1)."""

    alpha_per_target: bool = True

    def fit(self, X, y):
        super().fit(X, y)
        X, y = checked(X, y)
        self.pattern_ = pattern(X, y, self.coef_)
        return self


@dataclass
class RidgeEncoder(RidgeCV):
    """RidgeCV from features to channels. X (trials, features, time) with y (trials, channels, time) has coefficients (channels, features, time) of its
    own at each time, one intercept and one alpha: ridge on the expanded design, whose products are a block per time. gram.ridge_encoder does it without gathering trials."""

    def fit(self, X, y):
        X, y = np.asarray(X, float), np.asarray(y, float)
        if X.ndim != 3 or y.ndim != 3:
            return super().fit(X, y)
        if X.shape[::2] != y.shape[::2]:
            raise ValueError("X and y must have the same trials and times")
        (n, f, T), d = X.shape, y.shape[1]
        D = np.zeros((n, T, T, f))
        D[:, np.arange(T), np.arange(T)] = X.transpose(0, 2, 1)
        super().fit(D.reshape(n * T, T * f), y.transpose(0, 2, 1).reshape(n * T, d))
        self.coef_ = self.coef_.reshape(d, T, f).transpose(0, 2, 1)
        self.intercept_ = np.asarray(self.intercept_)
        return self

    def predict(self, X):
        self._fitted()
        X = np.asarray(X, float)
        return super().predict(X) if self.coef_.ndim == 2 else np.einsum("nft,dft->ndt", X, self.coef_) + self.intercept_[:, None]


def pattern(X: np.ndarray, y: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """(features, targets): cov(X) coef' pinv(cov(y)); with one target the factor is 1 / (n - 1)."""
    cx = np.atleast_2d(np.cov(X.T))
    return cx @ coef.T @ np.linalg.pinv(np.cov(y.T)) if y.shape[1] > 1 else cx @ coef.T / (len(X) - 1)


def codes(y, labels=None):
    """Per label feature: sorted labels and +-1 one-hot columns, concatenated."""
    y = two_d(np.asarray(y))
    labels = labels or [np.unique(c) for c in y.T]
    return labels, np.concatenate([np.where(c[:, None] == k[None], 1.0, -1.0) for c, k in zip(y.T, labels)], 1)


class Labelled(Local):
    """Decisions to labels: argmax and normalised sigmoids within each label feature."""

    def _parts(self, d):
        at = np.cumsum([0, *[len(k) for k in self.labels_]])
        return [d[:, a:b] for a, b in zip(at, at[1:])]

    def predict(self, X):
        return np.stack([k[p.argmax(1)] for k, p in zip(self.labels_, self._parts(self.decision_function(X)))], 1)

    def predict_proba(self, X):
        s = [1 / (1 + np.exp(-p)) for p in self._parts(self.decision_function(X))]
        return np.concatenate([p / p.sum(1, keepdims=True) for p in s], 1)


class OneOrPairs(Labelled):
    """An estimator of its own classes with method 'OvR'; with 'OvO' a model per pair of classes, held by a Classifier."""

    def fit(self, X, y):
        if self.method not in ("OvR", "OvO"):
            raise ValueError(f"no method {self.method}")
        if self.method == "OvR":
            return self._fit(X, y)
        own = self.clone()
        own.method = "OvR"
        self.pairs_ = Classifier(own, "OvO").fit(X, y)
        self.labels_ = self.pairs_.labels_
        for name in ("coef_", "intercept_", "pattern_"):
            parts = [getattr(m, name) for *_, m in self.pairs_.models_ if hasattr(m, name)]
            if parts:
                setattr(self, name, np.concatenate(parts, 1 if name == "pattern_" else 0))
        return self

    def decision_function(self, X):
        return self.pairs_.decision_function(X) if self.method == "OvO" else self._decide(X)

    def predict(self, X):
        return self.pairs_.predict(X) if self.method == "OvO" else super().predict(X)

    def predict_proba(self, X):
        return self.pairs_.predict_proba(X) if self.method == "OvO" else super().predict_proba(X)


@dataclass
class RidgeClassifier(OneOrPairs):
    """normalise: features are scaled to unit deviation for the fit; coefficients and patterns are those of the features as given."""

    alphas: object = 1.0
    fit_intercept: bool = True
    alpha_per_target: bool = False
    method: str = "OvR"
    normalise: bool = False

    def _fit(self, X, y):
        X = np.asarray(X, float)
        self.labels_, c = codes(y)
        scale = X.std(0, ddof=1) if self.normalise and len(X) > 1 else np.ones(X.shape[1])
        scale = np.where((scale == 0) | np.isnan(scale), 1.0, scale)
        m = RidgeDecoder(self.alphas, self.fit_intercept, self.alpha_per_target).fit(X / scale, c)
        self.coef_, self.intercept_, self.pattern_, self.alpha_ = m.coef_ / scale, m.intercept_, m.pattern_ * scale[:, None], m.alpha_
        return self

    def _decide(self, X):
        self._fitted()
        return np.asarray(X, float) @ self.coef_.T + self.intercept_


KERNELS = ("linear", "poly", "rbf", "sigmoid")


def gram(kind, a, b, gamma=1.0, coef0=0.0, degree=2.0):
    """The kernel of all rows of a with all rows of b; kind is a name or a function of a and b."""
    if callable(kind):
        return kind(a, b)
    if kind not in KERNELS:
        raise ValueError(f"no kernel {kind}")
    k = a @ b.T
    if kind == "poly":
        return (coef0 + gamma * k) ** degree
    if kind == "rbf":
        return np.exp(-gamma * np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * k))
    return np.tanh(coef0 + gamma * k) if kind == "sigmoid" else k


def gamma_of(gamma, X):
    if gamma == "scale":
        return 1 / (X.shape[1] * max(X.var(), 1e-12))
    return 1 / X.shape[1] if gamma == "auto" else float(gamma)


@dataclass
class KernelRidgeCV(Local):
    """Dual ridge; all alphas share one decomposition of the kernel; leave-one-out error from the diagonal of the hat matrix. No intercept."""

    alphas: object = 1.0
    kernel: str = "linear"
    gamma: object = "auto"
    coef0: float = 1.0
    degree: float = 3.0
    alpha_per_target: bool = False

    def fit(self, X, y):
        X, y = checked(X, y)
        self.gamma_, self.X_ = gamma_of(self.gamma, X), X
        al = np.atleast_1d(np.asarray(self.alphas, float))
        w, q = np.linalg.eigh(gram(self.kernel, X, X, self.gamma_, self.coef0, self.degree))
        qy, loss, dual = q.T @ y, [], []
        for a in al:
            inv = 1 / np.where(np.abs(w + a) < 1e-12, np.inf, w + a)
            fit, h = q @ ((w * inv)[:, None] * qy), (q * q) @ (w * inv)
            loss.append(np.mean(((y - fit) / (1 - h)[:, None]) ** 2, 0))
            dual.append(q @ (inv[:, None] * qy))
        loss = np.array(loss)
        pick = loss.argmin(0) if self.alpha_per_target else np.full(y.shape[1], loss.mean(1).argmin())
        self.A_dual_ = np.stack([dual[a][:, t] for t, a in enumerate(pick)], 1)
        self.alpha_ = al[pick] if self.alpha_per_target else float(al[pick[0]])
        if self.kernel == "linear":
            self.coef_ = X.T @ self.A_dual_
        return self

    def predict(self, X):
        self._fitted("A_dual_")
        return gram(self.kernel, np.asarray(X, float), self.X_, self.gamma_, self.coef0, self.degree) @ self.A_dual_


@dataclass
class SVC(OneOrPairs):
    """One-versus-rest support vectors by projected gradient ascent on the dual, from a seeded start, on scaled data."""

    C: float = 1.0
    kernel: str = "linear"
    gamma: object = "scale"
    coef0: float = 0.0
    degree: float = 3.0
    tol: float = 1e-3
    lr: float = 1e-3
    max_iter: int = 1000
    seed: int = 0
    method: str = "OvR"

    def _fit(self, X, y):
        X = np.asarray(X, float)
        self.labels_, L = codes(y)
        self.mean_, s = X.mean(0), X.std(0, ddof=1) if len(X) > 1 else np.ones(X.shape[1])
        self.scale_ = np.where((s == 0) | np.isnan(s), 1.0, s)
        Z = (X - self.mean_) / self.scale_
        self.gamma_, self.X_train_ = gamma_of(self.gamma, Z), Z
        K = gram(self.kernel, Z, Z, self.gamma_, self.coef0, self.degree)
        a, before = np.clip(np.random.default_rng(self.seed).standard_normal(L.shape), 0, self.C), np.inf
        for _ in range(self.max_iter if self.max_iter > 0 else 1_000_000):
            g = 1 - L * (K @ (a * L))
            a = np.clip(a + self.lr * g, 0, self.C)
            if abs((m := np.abs(g).max()) - before) < self.tol:
                break
            before = m
        self.A_ = a * L
        rest, eps = L - K @ self.A_, 1e-9
        on = (a > eps) & (a < self.C - eps)
        self.intercept_ = np.array([rest[on[:, t], t].mean() if on[:, t].any() else rest[a[:, t].argmax(), t] for t in range(L.shape[1])])
        if self.kernel == "linear":
            w = self.A_.T @ Z
            self.coef_ = w / self.scale_
            self.pattern_ = np.atleast_2d(np.cov(X.T)) @ self.coef_.T @ np.linalg.pinv(np.cov(L.T))
        return self

    def _decide(self, X):
        self._fitted("A_")
        Z = (np.asarray(X, float) - self.mean_) / self.scale_
        return self.intercept_ + gram(self.kernel, Z, self.X_train_, self.gamma_, self.coef0, self.degree) @ self.A_


def couple(P: np.ndarray, max_iter: int | None = None) -> np.ndarray:
    """Class probabilities from pairwise ones P[i, j] = p(i | i or j): Newton steps on the weighted least-squares system with sum 1."""
    K = len(P)
    eps = tol = 5e-3 / K
    p = np.full(K, 1 / K)
    for _ in range(max_iter or max(100, K)):
        Q, r = np.zeros((K, K)), np.zeros(K)
        for j in range(K):
            for k in range(j):
                a, b = P[j, k], P[k, j]
                w, s = 1 / max(eps, a * b), p[j] + p[k] + eps
                for (u, v), (own, other) in (((j, k), (a, b)), ((k, j), (b, a))):
                    Q[u, u] += w * other / s**2
                    Q[u, v] -= w * other / s**2
                    r[u] += w * (own - p[u] / s)
        M = np.block([[Q + 1e-9 * np.eye(K), np.ones((K, 1))], [np.ones((1, K)), np.zeros((1, 1))]])
        new = np.maximum(0, p + np.linalg.lstsq(M, np.r_[r, 0], rcond=None)[0][:K])
        new = new / new.sum() if new.sum() > eps else np.full(K, 1 / K)
        done, p = np.abs(new - p).sum() < tol, new
        if done:
            break
    return p


@dataclass
class Classifier(Labelled):
    """Multi-class by 'OvR' (the estimator itself) or 'OvO' (a model per pair of classes; votes, ties to the lowest class). estimator is an
    estimator, or a class that is called with arguments and kwarguments."""

    estimator: object = None
    method: str = "OvR"
    arguments: tuple = ()
    kwarguments: dict = field(default_factory=dict)

    def _new(self):
        return self.estimator(*self.arguments, **self.kwarguments) if isinstance(self.estimator, type) else self.estimator.clone()

    def fit(self, X, y):
        X, y = np.asarray(X, float), two_d(np.asarray(y))
        self.labels_ = [np.unique(c) for c in y.T]
        if self.method == "OvR":
            self.models_ = [self._new().fit(X, y)]
        elif self.method == "OvO":
            self.models_ = [(f, j, k, self._new().fit(X[m], y[m, f])) for f, own in enumerate(self.labels_) for j in range(len(own)) for k in range(j) if (m := np.isin(y[:, f], (own[j], own[k]))).any()]
        else:
            raise ValueError(f"no method {self.method}")
        return self

    def decision_function(self, X):
        self._fitted("models_")
        return self.models_[0].decision_function(X) if self.method == "OvR" else np.concatenate([m.decision_function(X) for *_, m in self.models_], 1)

    def predict(self, X):
        if self.method == "OvR":
            return self.models_[0].predict(X)
        votes = [np.zeros((len(X), len(k))) for k in self.labels_]
        for f, j, k, m in self.models_:
            own = m.predict(X)[:, 0]
            votes[f][:, j] += own == self.labels_[f][j]
            votes[f][:, k] += own == self.labels_[f][k]
        return np.stack([k[v.argmax(1)] for k, v in zip(self.labels_, votes)], 1)

    def predict_proba(self, X):
        if self.method == "OvR":
            return self.models_[0].predict_proba(X)
        out = []
        for f, own in enumerate(self.labels_):
            P = np.zeros((len(X), len(own), len(own)))
            for g, j, k, m in self.models_:
                if g == f:
                    s = 1 / (1 + np.exp(-m.decision_function(X)))
                    P[:, k, j], P[:, j, k] = s[:, 0], s[:, 1]
            out.append(np.stack([couple(p) for p in P]))
        return np.concatenate(out, 1)


@dataclass
class B2B(Local):
    """Back-to-back regression: decode y from X on the first half of trials, encode y from scaled predictions on the second."""

    alphas: object = 1.0

    def fit(self, X, y):
        X, y = checked(X, y)
        h = len(X) // 2
        self.decoder_ = RidgeDecoder(self.alphas).fit(X[:h], y[:h])
        z = self.decoder_.predict(X[h:])
        s = z.std(0, ddof=1)
        self.mean_, self.scale_ = z.mean(0), np.where((s == 0) | np.isnan(s), 1.0, s)
        self.encoder_ = RidgeCV(self.alphas).fit((z - self.mean_) / self.scale_, y[h:])
        self.causal_, self.pattern_ = np.diag(self.encoder_.coef_).copy(), self.decoder_.pattern_
        return self

    def predict(self, X):
        self._fitted("causal_")
        return self.encoder_.predict((self.decoder_.predict(X) - self.mean_) / self.scale_)


def covariance(S: np.ndarray, n: int, method, phi: float | None = None):
    """(covariance, shrinkage) from S = X'X / n of centred X; phi (for 'ledoitwolf') is the sum of (X^2)'(X^2) / n. method is a name or a function of S, n and phi."""
    if callable(method):
        return method(S, n, phi)
    F = len(S)
    mu = np.trace(S) / F
    T = mu * np.eye(F)
    if method == "empirical":
        return S, 0.0
    if method == "ledoitwolf":
        g = ((S - T) ** 2).sum()
        d = 0.0 if g == 0 else float(np.clip((phi - (S**2).sum()) / g / n, 0, 1))
    elif method == "oas":
        a, b = (S**2).sum(), np.trace(S) ** 2
        d = float(np.clip(((1 - 2 / F) * a + b) / max(np.finfo(float).eps, (n + 1 - 2 / F) * (a - b / F)), 0, 1))
    else:
        raise ValueError(f"no method {method}")
    return d * T + (1 - d) * S, d


def whitener(C: np.ndarray) -> np.ndarray:
    w, q = np.linalg.eigh(C)
    return (q * np.where(w > 0, 1 / np.sqrt(np.where(w > 0, w, 1)), 0)) @ q.T


def lag_window(t_min: float, t_max: float, fs: float) -> np.ndarray:
    """Offsets of TimeDelayed: from -ceil(|t_min| fs) to ceil(|t_max| fs), always with 0."""
    return np.arange(-int(np.ceil(abs(t_min) * fs)), int(np.ceil(abs(t_max) * fs)) + 1)


def lagged(X: np.ndarray, window: np.ndarray, edge: str = "replicate") -> np.ndarray:
    """Design (time, features * lags), features first, of one trial (features, time): x(t + w), edges replicated or zero."""
    t = np.arange(X.shape[1])[:, None] + window
    d = X[:, t.clip(0, X.shape[1] - 1)]
    if edge == "zero":
        d = d * ((t >= 0) & (t < X.shape[1]))
    return d.transpose(1, 0, 2).reshape(X.shape[1], -1)


@dataclass
class TimeDelayed(Local):
    """Ridge on lagged copies. X (trials, features, time), y (trials, channels, time); coef_ (channels, features, lags) is flipped along lags."""

    t_min: float = 0.0
    t_max: float = 0.0
    fs: float = 1.0
    alphas: object = 1.0
    edge: str = "replicate"
    patterns: bool = False

    def fit(self, X, y):
        X, y = np.asarray(X, float), np.asarray(y, float)
        self.window_ = lag_window(self.t_min, self.t_max, self.fs)
        D, Y = np.concatenate([lagged(x, self.window_, self.edge) for x in X]), np.concatenate([v.T for v in y])
        m = RidgeCV(self.alphas).fit(D, Y)
        self.flat_, self.intercept_, self.alpha_ = m.coef_, m.intercept_, m.alpha_
        self.coef_ = m.coef_.reshape(len(m.coef_), X.shape[1], -1)[:, :, ::-1]
        if self.patterns:
            self.pattern_ = pattern(D, Y, m.coef_).T.reshape(self.coef_.shape)[:, :, ::-1]
        return self

    def predict(self, X, reshape: bool = True):
        """(trials, channels, time), or without reshape (trials * time, channels)."""
        self._fitted()
        out = [lagged(x, self.window_, self.edge) @ self.flat_.T + self.intercept_ for x in np.asarray(X, float)]
        return np.stack([v.T for v in out]) if reshape else np.concatenate(out)


@dataclass
class ReceptiveField(Local):
    """Lagged regression from zero-padded designs' X'X and X'y per trial; ridge or Laplacian penalty; alpha by k-fold mean correlation over test trials.

    X (trials, features, time), y (trials, channels, time). y(t) is explained by x(t - lag), lags int(t_min fs) .. int(t_max fs).
    """

    t_min: float = 0.0
    t_max: float = 0.0
    fs: float = 1.0
    alpha: object = 1.0
    reg_type: str = "ridge"
    reg_cv: object = 5
    fit_intercept: bool = True
    patterns: bool = False
    edge_correction: bool = True

    def _design(self, x):
        """Lagged copies within the recording; without edge correction products run over the padded lags as well, as correlations by Fourier transforms do."""
        if self.edge_correction:
            return lagged(x, -self.window_, "zero")
        low, high = max(0, -int(self.window_.min())), max(0, int(self.window_.max()))
        return lagged(np.pad(x, ((0, 0), (low, high))), -self.window_, "zero")

    def _target(self, v):
        low, high = (0, 0) if self.edge_correction else (max(0, -int(self.window_.min())), max(0, int(self.window_.max())))
        return np.pad(v, ((0, 0), (low, high))).T

    def _penalty(self, f, w):
        if self.reg_type == "ridge":
            return np.eye(f * w)
        L = 2 * np.eye(w) - np.eye(w, k=1) - np.eye(w, k=-1)
        L[0, 0] = L[-1, -1] = 1.0
        return np.kron(np.eye(f), L if w > 1 else np.eye(1))

    def fit(self, X, y):
        X, y = np.asarray(X, float), np.asarray(y, float)
        self.window_ = np.arange(int(self.t_min * self.fs), int(self.t_max * self.fs) + 1)
        n, f, w = len(X), X.shape[1], len(self.window_)
        mx, my = (X.mean((0, 2)), y.mean((0, 2))) if self.fit_intercept else (np.zeros(f), np.zeros(y.shape[1]))
        D = [lagged(x - mx[:, None], -self.window_, "zero") for x in X]
        wide = [self._design(x - mx[:, None]) for x in X]
        XX, XY = np.stack([d.T @ d for d in wide]), np.stack([d.T @ self._target(v - my[:, None]) for d, v in zip(wide, y)])
        R, al = self._penalty(f, w), np.atleast_1d(np.asarray(self.alpha, float))

        def solve(rows, a):
            M = XX[rows].sum(0) + a * R
            return np.linalg.lstsq(M, XY[rows].sum(0), rcond=None)[0]

        if len(al) > 1 and self.reg_cv == "LOO":
            # closed-form leave-one-out error over time points; no intercept is fitted on centred data
            A, B = np.concatenate(D), np.concatenate([(v - my[:, None]).T for v in y])
            loss = []
            for a in al:
                inv = np.linalg.pinv(XX.sum(0) + a * R)
                h = ((A @ inv) * A).sum(1)
                loss.append((((B - A @ (inv @ XY.sum(0))) / (1 - h)[:, None]) ** 2).mean())
            self.alpha_ = float(al[int(np.argmin(loss))])
        elif len(al) > 1:
            folds, k = np.arange(n), min(self.reg_cv, n)
            parts = np.array_split(folds, k)
            score = np.zeros(len(al))
            for test in parts:
                train = np.setdiff1d(folds, test)
                for i, a in enumerate(al):
                    p = np.stack([D[t] @ solve(train, a) for t in test])
                    v = np.stack([(y[t] - my[:, None]).T for t in test])
                    p, v = p - p.mean(0), v - v.mean(0)
                    with np.errstate(all="ignore"):
                        score[i] += np.nanmean((p * v).sum(0) / np.sqrt((p * p).sum(0) * (v * v).sum(0))) / k
            self.alpha_ = float(al[np.nan_to_num(score, nan=-2).argmax()])
        else:
            self.alpha_ = float(al[0])
        b = solve(np.arange(n), self.alpha_)
        self.coef_ = b.T.reshape(y.shape[1], f, w)
        self.intercept_ = my - np.einsum("cfw,f->c", self.coef_, mx) if self.fit_intercept else np.zeros(y.shape[1])
        if self.patterns:
            # covariances of lagged copies and of targets, over all time points
            N, A, B = n * X.shape[2], XX.sum(0), np.concatenate([(v - my[:, None]).T for v in y])
            by = np.linalg.pinv(B.T @ B / (N - 1)) if y.shape[1] > 1 else np.ones((1, 1)) / (N - 1)
            self.pattern_ = (A / (N - 1) @ b @ by).T.reshape(self.coef_.shape)
        return self

    def predict(self, X):
        self._fitted()
        flat = self.coef_.reshape(len(self.coef_), -1)
        return np.stack([(lagged(x, -self.window_, "zero") @ flat.T + self.intercept_).T for x in np.asarray(X, float)])


@dataclass
class BlockScaler(Local):
    """Scaler of one block: (x - mean) / deviation with n - 1; a scale of 0 or undefined is 1."""

    with_mean: bool = True
    with_std: bool = True

    def fit(self, X, y=None):
        X = np.asarray(X, float)
        s = X.std(0, ddof=1) if len(X) > 1 else np.zeros(X.shape[1:])
        self.mean_, self.scale_ = X.mean(0) * self.with_mean, np.where((s == 0) | np.isnan(s), 1.0, s) if self.with_std else np.ones(X.shape[1:])
        return self

    def transform(self, X):
        self._fitted("mean_")
        return (np.asarray(X, float) - self.mean_) / self.scale_

    def inverse_transform(self, X):
        self._fitted("mean_")
        return np.asarray(X, float) * self.scale_ + self.mean_


@dataclass
class BlockRobustScaler(BlockScaler):
    """RobustScaler of one block: (x - median) / quantile range; of an odd count quantiles are the element floor(q (n - 1)), of an even one interpolated."""

    with_mean: bool = True
    with_std: bool = True
    quantile_range: tuple = (25.0, 75.0)

    def fit(self, X, y=None):
        X = np.asarray(X, float)
        low, mid, high = (np.quantile(X, q, axis=0, method="lower" if len(X) % 2 else "linear") for q in (self.quantile_range[0] / 100, 0.5, self.quantile_range[1] / 100))
        s = high - low
        self.mean_, self.scale_ = mid * self.with_mean, np.where(s == 0, 1.0, s) if self.with_std else np.ones(X.shape[1:])
        return self


@dataclass
class BlockClamp(Local):
    """Clamp of one block, by quartiles ('iqr'), quantiles ('quantile') or median deviations ('mad')."""

    method: str = "iqr"
    k: float | None = None

    def fit(self, X, y=None):
        X, k = np.asarray(X, float), self.k if self.k is not None else {"iqr": 1.5, "quantile": 0.05, "mad": 3.0}[self.method]
        if self.method == "mad":
            mid = np.median(X, 0)
            wide = k * np.median(np.abs(X - mid), 0)
            self.lower_, self.upper_ = mid - wide, mid + wide
        else:
            low, high = np.quantile(X, [0.25, 0.75] if self.method == "iqr" else [k, 1 - k], axis=0)
            wide = k * (high - low) if self.method == "iqr" else 0.0
            self.lower_, self.upper_ = low - wide, high + wide
        return self

    def transform(self, X):
        self._fitted("lower_")
        return np.clip(np.asarray(X, float), self.lower_, self.upper_)

    def inverse_transform(self, X):
        return np.asarray(X, float)


@dataclass
class BlockWhitener(Local):
    """Covariance of one block, and whitening by it."""

    method: str = "ledoitwolf"

    def fit(self, X, y=None):
        X = np.asarray(X, float)
        self.mean_ = X.mean(0)
        Z = X - self.mean_
        self.covariance_, self.shrinkage_ = covariance(Z.T @ Z / len(Z), len(Z), self.method, ((Z**2).T @ Z**2).sum() / len(Z))
        self.precision_, self.whitener_ = np.linalg.pinv(self.covariance_), whitener(self.covariance_)
        return self

    def transform(self, X):
        self._fitted("whitener_")
        return (np.asarray(X, float) - self.mean_) @ self.whitener_


class Pipeline(Local):
    """Transformers and a last estimator, in a row. What is asked of the pipeline is asked of the last step, on transformed X."""

    def __init__(self, *steps):
        self.steps = list(steps)

    def clone(self):
        return Pipeline(*[s.clone() for s in self.steps])

    def __getitem__(self, i):
        return self.steps[i]

    def __len__(self):
        return len(self.steps)

    def _through(self, X):
        for s in self.steps[:-1]:
            X = s.transform(X)
        return X

    def fit(self, X, y=None):
        for s in self.steps[:-1]:
            X = s.fit(X, y).transform(X)
        self.steps[-1].fit(X, y)
        return self

    def __getattr__(self, name):
        if name.startswith("__") or name == "steps":
            raise AttributeError(name)
        own = getattr(self.steps[-1], name)
        return (lambda X, *a, **k: own(self._through(X), *a, **k)) if name in ("predict", "predict_proba", "decision_function", "transform") else own

    def score(self, X, y, metric=None):
        return self.steps[-1].score(self._through(X), y, metric)

    def params(self):
        return self.steps[-1].params()


def make_pipeline(*steps) -> Pipeline:
    return Pipeline(*steps)
