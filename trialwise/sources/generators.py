"""Synthetic multi-channel recordings: (trial, t, x array<double>, y array<double>), made per trial from a seed of its own."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def layout(n_channels: int) -> np.ndarray:
    """Positions (channels, 3): cell centres of a nearly square grid, mapped concentrically to the disk and lifted to a hemisphere."""
    columns = math.ceil(math.sqrt(n_channels))
    lines = math.ceil(n_channels / columns)
    n = np.arange(n_channels)
    a, b = (2 * (n % columns) + 1) / columns - 1, (2 * (n // columns) + 1) / lines - 1
    # the larger coordinate is the radius, the smaller one an eighth turn at most from its axis
    wide = np.abs(a) > np.abs(b)
    radius, other = np.where(wide, a, b), np.where(wide, b, a)
    turn = np.pi / 4 * np.divide(other, radius, out=np.zeros(n_channels), where=radius != 0)
    near, far = radius * np.cos(turn), radius * np.sin(turn)
    x, y = np.where(wide, near, far), np.where(wide, far, near)
    return np.stack([x, y, np.sqrt(np.maximum(0, 1 - x * x - y * y))], 1)


def make_layout(spark: SparkSession, n_channels: int = 64) -> DataFrame:
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(layout(n_channels))], "channel int, x double, y double, z double")


def make_colours(positions: DataFrame) -> DataFrame:
    """(channel, r, g, b): coordinates scaled to 0..1."""
    from ..functions.math import safe_div

    names = ("x", "y", "z")
    ends = positions.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))])
    joined = positions.join(F.broadcast(ends))  # one row
    return joined.select("channel", *[safe_div(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}"), 0.0).alias(o) for c, o in zip(names, "rgb")])


def _kernels(rng, freqs, phases, fs: float, T: int, cycles: float, pos: np.ndarray, gamma: float):
    """Kernels (n, T) and channel weights (n, channels) shared by all trials: each source is drawn at one channel and pushed off at another."""
    kern = np.zeros((len(freqs), T))
    for k, f, p in zip(kern, freqs, phases):
        m = max(2, min(int(cycles * fs / f), T))
        s = np.linspace(0, 1, m)
        k[:m] = (0.5 - 0.5 * np.cos(2 * np.pi * s)) / f * np.sin(2 * np.pi * f * s + p * np.pi)
    K = np.exp(-gamma * ((pos[:, None] - pos[None]) ** 2).sum(2))
    ends = np.stack([rng.permutation(len(pos))[:2] for _ in freqs]) if len(pos) > 1 else np.zeros((len(freqs), 2), int)
    return kern, K[ends[:, 0]] - K[ends[:, 1]]


class _Maker:
    """What trials are made from; the same on every worker."""

    def __init__(self, kind, n_channels, t_padding, t_baseline, t_duration, t_length, fs, n_background, n_features, n_cycles, gamma, phi, seed, poisson, variable, lambda_min, lambda_max, n_classes, temperature, sigma):
        self.__dict__.update(locals())
        self.pad, self.T, self.keep = int(t_padding * fs), int((t_length + t_padding) * fs), int(t_length * fs)
        self.on, self.off = self.pad + int(t_baseline * fs), self.pad + int((t_baseline + t_duration) * fs)
        self.n_drive = n_features * (n_classes if kind == "categorical" else 1)
        rng, pos = np.random.default_rng(seed), layout(n_channels)
        self.back, self.back_w = _kernels(rng, np.arange(1, n_background + 1.0), rng.uniform(size=n_background), fs, self.T, n_cycles, pos, gamma)
        self.fore, self.fore_w = _kernels(rng, rng.integers(2, 5, self.n_drive).astype(float), np.zeros(self.n_drive), fs, self.T, n_cycles, pos, gamma)
        self.rates = np.maximum(lambda_max * (rng.uniform(size=n_features) if variable else np.full(n_features, rng.uniform())), lambda_min)
        mix = 0.25 * rng.standard_normal((self.n_drive, self.n_drive))
        np.fill_diagonal(mix, 1.0)
        mix = np.exp(mix / temperature)
        self.mix, self.shared = mix / mix.sum(0), self._drive(rng, self.n_drive, True)
        self.scale, self.norm = 1.0, 1.0

    def _drive(self, rng, n: int, inside: bool) -> np.ndarray:
        """Autoregressive noise, for the foreground from noise inside the stimulus only."""
        e = rng.standard_normal((n, self.T))
        if inside:
            e[:, : self.on] = e[:, self.off :] = 0
        for t in range(1, self.T):
            e[:, t] += self.phi * e[:, t - 1]
        return e

    def labels(self, trial: int) -> np.ndarray:
        """A class for each feature: every run of n_classes trials holds each class once, in an order by chance, so classes are balanced and shuffled."""
        block, i = divmod(trial, self.n_classes)
        return np.array([np.random.default_rng([self.seed, 7, f, block]).permutation(self.n_classes)[i] for f in range(self.n_features)])

    def drives(self, trial: int) -> tuple[np.ndarray, np.ndarray]:
        """Background and foreground of a trial."""
        rng = np.random.default_rng([self.seed, trial])
        back = self._drive(rng, self.n_background, False)
        if self.kind == "continuous":
            return back, self._drive(rng, self.n_drive, True)
        if self.kind == "discrete":
            fore, span = np.zeros((self.n_drive, self.T)), self.off - self.on
            fore[:, self.on] = 1
            for i in range(self.n_drive if self.poisson else 0):
                m = min(span, max(1, int(span * self.rates[i])))
                fore[i, self.on + rng.permutation(span)[:m]] += rng.standard_normal(m)
            return back, fore
        code = np.eye(self.n_classes)[self.labels(trial)].ravel() @ self.mix.T + self.sigma * rng.standard_normal(self.n_drive)
        return back, code[:, None] * self.shared

    def parts(self, trial: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the background and the foreground give at each channel (time, channels), and the foreground's drive."""
        back, fore = self.drives(trial)
        wave = lambda d, k: np.fft.irfft(np.fft.rfft(d, 2 * self.T) * np.fft.rfft(k, 2 * self.T), 2 * self.T)[:, : self.T]
        return wave(back, self.back).T @ self.back_w, wave(fore, self.fore).T @ self.fore_w, fore

    def settle(self, n_trials: int, snr: float, pilot: int = 16) -> None:
        """Scales the background so that the foreground's kernels are snr times as strong as its own, and again so the drives during the stimulus; then all by their deviation. Sizes are those of the first trials, which stand for the others."""
        own = range(min(n_trials, pilot))
        during = slice(self.on, self.off)
        strength = [(np.abs(k)[:, :, None] * np.abs(w)[:, None]).sum() for k, w in ((self.back, self.back_w), (self.fore, self.fore_w))]
        amount = np.sum([[np.abs(d[:, during]).sum() for d in self.drives(t)] for t in own], 0)
        if snr > 0 and min(*strength, *amount) > 0:
            self.scale = (strength[1] / strength[0] / snr) * (amount[1] / amount[0] / snr)
        y = np.concatenate([b * self.scale + f for b, f, _ in map(self.parts, own)])
        self.norm = max(float(y.std()), 1e-12)

    def trial(self, trial: int) -> tuple[np.ndarray, np.ndarray]:
        back, fore, drive = self.parts(trial)
        y = ((back * self.scale + fore) / self.norm)[self.pad :][: self.keep]
        x = np.tile(self.labels(trial), (self.keep, 1)) if self.kind == "categorical" else drive[:, self.pad :][:, : self.keep].T
        return x.astype(float), y


def make_meeg(spark: SparkSession, kind: str = "continuous", n_trials: int = 120, n_channels: int = 64, t_padding=1.0, t_baseline=0.25, t_duration=1.0, t_length=2.0, fs: int = 200, n_background: int = 50, n_features: int = 3, n_cycles: float = 2, snr: float = 0.1, gamma: float = 1.0, phi: float = 0.5, seed: int = 42, poisson: bool = True, variable: bool = True, lambda_min: float = 0.001, lambda_max: float = 0.1, n_classes: int = 2, temperature: float = 1.0, sigma: float = 0.2) -> DataFrame:
    """kind: 'continuous' (autoregressive predictors), 'discrete' (an onset impulse and random events) or 'categorical' (x holds class labels). snr is the
    foreground's strength over the background's: the larger, the less background. Trials are made from seeds of their own."""
    if kind not in ("continuous", "discrete", "categorical"):
        raise ValueError(f"no kind {kind}")
    maker = _Maker(kind, n_channels, t_padding, t_baseline, t_duration, t_length, fs, n_background, n_features, n_cycles, gamma, phi, seed, poisson, variable, lambda_min, lambda_max, n_classes, temperature, sigma)
    maker.settle(n_trials, snr)

    def work(batches):
        for b in batches:
            for trial in b.column("id").to_pylist():
                x, y = maker.trial(trial)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel())) for v in (x, y)]
                yield pa.RecordBatch.from_arrays([pa.array([trial] * len(x), pa.int64()), pa.array(np.arange(len(x), dtype=np.int32)), *lists], ["trial", "t", "x", "y"])

    return spark.range(n_trials).mapInArrow(work, "trial long, t int, x array<double>, y array<double>")


def make_meeg_continuous(spark, **kw) -> DataFrame:
    return make_meeg(spark, "continuous", **kw)


def make_meeg_discrete(spark, **kw) -> DataFrame:
    return make_meeg(spark, "discrete", **kw)


def make_meeg_categorical(spark, **kw) -> DataFrame:
    return make_meeg(spark, "categorical", **{"n_features": 1, **kw})
