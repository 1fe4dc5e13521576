"""Detectors that Spark ML lacks, as numpy models fitted on a bounded sample and applied in Arrow batches.

Each ``fit_*`` takes a matrix of rows and gives a function of a matrix to scores,
higher is more anomalous. ``applied`` runs such a function over a DataFrame.
``sampled`` draws the fitting rows: at most ``most``, by hash order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.splits import hash_order

Scorer = Callable[[np.ndarray], np.ndarray]
FIT_ROWS = 20_000


def sampled(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = ("series_id", "t"), most: int = FIT_ROWS, seed: int = 42) -> np.ndarray:
    return rows.orderBy(hash_order(seed, *keys), *keys).limit(most).select(*columns).toPandas().to_numpy(float)


def applied(rows: DataFrame, columns: list[str], scorer: Scorer) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(scorer)  # a model of bounded size
    keys = [c for c in rows.columns if c in ("series_id", "t")]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys) + ", score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(score=sent.value(batch[columns].to_numpy(float)) if len(batch) else np.zeros(0))

    return rows.select(*keys, *[c for c in columns if c not in keys]).mapInPandas(run, schema)


def _path_length(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Random splits of small samples; rows that few splits set apart are anomalous."""

    def __init__(self, x: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 42):
        r = np.random.default_rng(seed)
        self.size = min(sample, len(x))
        self.limit = int(np.ceil(np.log2(max(self.size, 2))))
        self.trees = [self._grow(x[r.choice(len(x), self.size, replace=False)], 0, r) for _ in range(trees)] if len(x) else []

    def _grow(self, x: np.ndarray, depth: int, r: np.random.Generator):
        span = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if depth >= self.limit or not len(span):
            return depth + _path_length(len(x))
        k = int(r.choice(span))
        cut = r.uniform(x[:, k].min(), x[:, k].max())
        left = x[:, k] < cut
        return k, cut, self._grow(x[left], depth + 1, r), self._grow(x[~left], depth + 1, r)

    def _depth(self, node, x: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[at] += node
        elif len(at):
            left = x[at, node[0]] < node[1]
            self._depth(node[2], x, at[left], out)
            self._depth(node[3], x, at[~left], out)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            self._depth(tree, x, np.arange(len(x)), total)
        return 2.0 ** (-total / max(len(self.trees), 1) / max(_path_length(self.size), 1e-9))


class LocalOutlierFactor:
    """Density of a row's neighbours over its own, against a bounded reference sample."""

    def __init__(self, x: np.ndarray, k: int = 20):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-8)
        self.x, self.k = (x - self.mean) / self.scale, min(k, max(len(x) - 1, 1))
        d, i = self._near(self.x, own=True)
        self.reach = d[:, -1]
        self.density = 1 / np.maximum(np.maximum(d, self.reach[i]).mean(1), 1e-10)

    def _near(self, q: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        dist, index = [], []
        for a in range(0, len(q), 512):
            d = np.sqrt(np.maximum((q[a : a + 512] ** 2).sum(1)[:, None] + (self.x**2).sum(1) - 2 * q[a : a + 512] @ self.x.T, 0))
            if own:
                d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            i = np.argpartition(d, min(self.k - 1, d.shape[1] - 1), axis=1)[:, : self.k]
            i = np.take_along_axis(i, np.argsort(np.take_along_axis(d, i, 1), axis=1), 1)
            dist.append(np.take_along_axis(d, i, 1))
            index.append(i)
        return np.concatenate(dist), np.concatenate(index)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        d, i = self._near((x - self.mean) / self.scale)
        own = 1 / np.maximum(np.maximum(d, self.reach[i]).mean(1), 1e-10)
        return self.density[i].mean(1) / own


class OneClassBoundary:
    """One-class boundary on random Fourier features: stochastic descent of the nu objective; score is the margin below it."""

    def __init__(self, x: np.ndarray, nu: float = 0.1, features: int = 128, epochs: int = 20, seed: int = 42):
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-8)
        self.w = r.normal(0, np.sqrt(2.0 / x.shape[1]), (x.shape[1], features))
        self.b = r.uniform(0, 2 * np.pi, features)
        z = self._map(x)
        self.v, self.rho = z.mean(0), 0.0
        for epoch in range(epochs):
            rate = 0.5 / (1 + epoch)
            for part in np.array_split(r.permutation(len(z)), max(1, len(z) // 256)):
                inside = z[part] @ self.v < self.rho
                self.v -= rate * (self.v - z[part][inside].sum(0) / (nu * len(part)))
                self.rho -= rate * (inside.mean() / nu - 1)

    def _map(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.b)) * np.cos((x - self.mean) / self.scale @ self.w + self.b)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.rho - self._map(x) @ self.v


class Adam:
    """Steps of Adam on a list of arrays, in place."""

    def __init__(self, parameters: list[np.ndarray], rate: float = 1e-3):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]

    def __call__(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for p, (m, v), g in zip(self.parameters, self.moments, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def _batches(n: int, size: int, epochs: int, r: np.random.Generator) -> Iterator[np.ndarray]:
    for _ in range(epochs):
        order = r.permutation(n)
        for a in range(0, n, size):
            yield order[a : a + size]


class AutoEncoder:
    """A 64-32-64 ReLU network trained with Adam to give its input, as it is, back; score is the mean squared error."""

    def __init__(self, x: np.ndarray, hidden: tuple[int, ...] = (64, 32, 64), epochs: int = 50, size: int = 200, seed: int = 42):
        r = np.random.default_rng(seed)
        sizes = [x.shape[1], *hidden, x.shape[1]]
        bound = lambda a, b: np.sqrt(6 / (a + b))
        self.layers = [[r.uniform(-bound(a, b), bound(a, b), (a, b)), r.uniform(-bound(a, b), bound(a, b), b)] for a, b in zip(sizes, sizes[1:], strict=False)]
        adam = Adam([p for layer in self.layers for p in layer])
        for part in _batches(len(x), min(size, max(len(x), 1)), epochs, r):
            acts = self._forward(x[part])
            grad, grads = (acts[-1] - x[part]) / len(part), []
            for k in reversed(range(len(self.layers))):
                grads = [acts[k].T @ grad, grad.sum(0), *grads]
                grad = grad @ self.layers[k][0].T * (acts[k] > 0) if k else grad
            adam(grads)

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for k, (w, b) in enumerate(self.layers):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if k < len(self.layers) - 1 else z)
        return acts

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((self._forward(x)[-1] - x) ** 2).mean(1)


def _taps(x: np.ndarray, axis: int) -> np.ndarray:
    """x[i - 1], x[i], x[i + 1] along an axis, zeros beyond its ends, side by side in the last axis."""
    zero = np.zeros_like(x.take([0], axis))
    n = x.shape[axis]
    return np.concatenate([np.concatenate([zero, x.take(range(n - 1), axis)], axis), x, np.concatenate([x.take(range(1, n), axis), zero], axis)], axis=-1)


def _untaps(g: np.ndarray, axis: int) -> np.ndarray:
    """The gradient of what ``_taps`` was made from."""
    before, own, after = np.split(g, 3, axis=-1)
    n, zero = own.shape[axis], np.zeros_like(own.take([0], axis))
    return own + np.concatenate([before.take(range(1, n), axis), zero], axis) + np.concatenate([zero, after.take(range(n - 1), axis)], axis)


def _uniform(r: np.random.Generator, fan_in: int, *shape: int) -> np.ndarray:
    return r.uniform(-1, 1, shape) / np.sqrt(fan_in)


class Forecaster:
    """A network trained with Adam to give the value after a context window; score is the squared error.

    Rows are a context window with its target as the last column. Subclasses make ``parameters``, and give the forecasts with
    what ``_backward`` needs for the parameters' gradients.
    """

    def _fit(self, x: np.ndarray, r: np.random.Generator, epochs: int, size: int) -> None:
        adam = Adam(self.parameters)
        for part in _batches(len(x), size, epochs, r):
            forecast, kept = self._forward(x[part, :-1])
            adam(self._backward(2 * (forecast - x[part, -1]) / len(part), kept))

    def __call__(self, x: np.ndarray, size: int = 4096) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[(self._forward(x[a : a + size, :-1])[0] - x[a : a + size, -1]) ** 2 for a in range(0, len(x), size)]])


class ConvForecaster(Forecaster):
    """Two convolutions of width three with ReLU, the mean over the window, a linear head; all trained."""

    def __init__(self, x: np.ndarray, channels: int = 32, epochs: int = 10, size: int = 128, seed: int = 42):
        r = np.random.default_rng(seed)
        c = channels
        self.parameters = [_uniform(r, 3, 3, c), _uniform(r, 3, c), _uniform(r, 3 * c, 3 * c, c), _uniform(r, 3 * c, c), _uniform(r, c, c), _uniform(r, c, 1)]
        self._fit(x, r, epochs, size)

    def _forward(self, x: np.ndarray):
        w1, b1, w2, b2, head, bias = self.parameters
        t1 = _taps(x[:, :, None], 1)
        a1 = np.maximum(t1 @ w1 + b1, 0)
        t2 = _taps(a1, 1)
        a2 = np.maximum(t2 @ w2 + b2, 0)
        pooled = a2.mean(axis=1)
        return pooled @ head + bias[0], (t1, a1, t2, a2, pooled)

    def _backward(self, g: np.ndarray, kept) -> list[np.ndarray]:
        w2, head = self.parameters[2], self.parameters[4]
        t1, a1, t2, a2, pooled = kept
        g2 = g[:, None, None] * head / a2.shape[1] * (a2 > 0)
        g1 = _untaps(g2 @ w2.T, 1) * (a1 > 0)
        return [np.tensordot(t1, g1, ((0, 1), (0, 1))), g1.sum((0, 1)), np.tensordot(t2, g2, ((0, 1), (0, 1))), g2.sum((0, 1)), pooled.T @ g, g.sum(keepdims=True)]


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The activation (by its tanh form) and its slope."""
    inner = np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)
    t = np.tanh(inner)
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * np.sqrt(2 / np.pi) * (1 + 3 * 0.044715 * x * x)


def top_periods(x: np.ndarray, top: int) -> tuple[list[int], np.ndarray]:
    """The periods of the strongest frequencies of a batch (rows, window, channels), and the softmax of their mean amplitudes."""
    strength = np.abs(np.fft.rfft(x, axis=1)).mean(axis=(0, 2))
    if len(strength) <= 1:
        return [max(x.shape[1], 1)], np.ones(1)
    strength[0] = 0
    best = np.argsort(-strength, kind="stable")[: max(1, min(top, len(strength) - 1))]
    weight = np.exp(strength[best] - strength[best].max())
    return [max(x.shape[1] // max(int(k), 1), 1) for k in best], weight / weight.sum()


class PeriodForecaster(Forecaster):
    """Blocks that fold the window by its strongest periods and convolve along a period and across periods; all trained.

    Values are projected to ``width`` channels; a block adds, for each period, a convolution of three along the period, GELU,
    one of three across periods, GELU, weighted by the periods' strengths (taken as constants in training). The last step,
    normalised, goes through a linear head.
    """

    def __init__(self, x: np.ndarray, width: int = 16, top: int = 3, blocks: int = 2, epochs: int = 5, size: int = 128, seed: int = 42):
        r = np.random.default_rng(seed)
        self.top, self.blocks, w = top, blocks, width
        self.parameters = [_uniform(r, 1, 1, w), _uniform(r, 1, w)]
        for _ in range(blocks):
            self.parameters += [_uniform(r, 3 * w, 3 * w, w), _uniform(r, 3 * w, w), _uniform(r, 3 * w, 3 * w, w), _uniform(r, 3 * w, w)]
        self.parameters += [np.ones(w), np.zeros(w), _uniform(r, w, w), _uniform(r, w, 1)]
        self._fit(x, r, epochs, size)

    def _block(self, h: np.ndarray, w1, b1, w2, b2):
        n, out, kept = h.shape[1], h.copy(), []
        for period, weight in zip(*top_periods(h, self.top), strict=True):
            more = -n % period
            folded = np.concatenate([h, np.repeat(h[:, -1:], more, axis=1)], axis=1).reshape(len(h), -1, period, h.shape[2])
            t1 = _taps(folded, 2)
            a1, s1 = _gelu(t1 @ w1 + b1)
            t2 = _taps(a1, 1)
            a2, s2 = _gelu(t2 @ w2 + b2)
            out += weight * a2.reshape(len(h), -1, h.shape[2])[:, :n]
            kept.append((weight, more, t1, s1, t2, s2))
        return out, kept

    def _forward(self, x: np.ndarray):
        p = self.parameters
        h, kept = x[:, :, None] @ p[0] + p[1], []
        for k in range(self.blocks):
            h, own = self._block(h, *p[2 + 4 * k : 6 + 4 * k])
            kept.append(own)
        last = h[:, -1]
        spread = np.sqrt(last.var(axis=1, keepdims=True) + 1e-5)
        normal = (last - last.mean(axis=1, keepdims=True)) / spread
        scaled = normal * p[-4] + p[-3]
        return scaled @ p[-2] + p[-1][0], (x, h.shape, kept, normal, spread, scaled)

    def _backward(self, g: np.ndarray, kept) -> list[np.ndarray]:
        p, (x, shape, blocks, normal, spread, scaled) = self.parameters, kept
        gs = g[:, None] * p[-2]
        tail = [(gs * normal).sum(0), gs.sum(0), scaled.T @ g, g.sum(keepdims=True)]
        gn = gs * p[-4]
        gh = np.zeros(shape)
        gh[:, -1] = (gn - gn.mean(1, keepdims=True) - normal * (gn * normal).mean(1, keepdims=True)) / spread
        grads: list[np.ndarray] = []
        for k in reversed(range(self.blocks)):
            w1, _, w2, _ = p[2 + 4 * k : 6 + 4 * k]
            own, back = [np.zeros_like(q) for q in p[2 + 4 * k : 6 + 4 * k]], gh.copy()
            for weight, more, t1, s1, t2, s2 in blocks[k]:
                g2 = (weight * np.concatenate([gh, np.zeros((len(gh), more, gh.shape[2]))], axis=1)).reshape(s2.shape) * s2
                own[2] += np.tensordot(t2, g2, ((0, 1, 2), (0, 1, 2)))
                own[3] += g2.sum((0, 1, 2))
                g1 = _untaps(g2 @ w2.T, 1) * s1
                own[0] += np.tensordot(t1, g1, ((0, 1, 2), (0, 1, 2)))
                own[1] += g1.sum((0, 1, 2))
                folded = _untaps(g1 @ w1.T, 2).reshape(len(gh), -1, gh.shape[2])
                back += folded[:, : gh.shape[1]]
                back[:, -1] += folded[:, gh.shape[1] :].sum(axis=1)
            grads, gh = own + grads, back
        return [np.tensordot(x[:, :, None], gh, ((0, 1), (0, 1))), gh.sum((0, 1)), *grads, *tail]
