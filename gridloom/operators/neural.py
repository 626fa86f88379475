"""A small network of dense layers: trained on a bounded sample, applied to all rows in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from . import algorithms as A

D = F.col


@dataclass
class Network:
    """Layers (matrix, offset) with rectifiers in between; the last one is linear, or a softmax for classes."""

    layers: list
    classes: bool

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i + 1 < len(self.layers):
                x = np.maximum(x, 0)
        if self.classes:
            e = np.exp(x - x.max(1, keepdims=True))
            x = e / e.sum(1, keepdims=True)
        return x


def _pack(layers):
    return np.concatenate([p.ravel() for layer in layers for p in layer])


def _unpack(v, sizes):
    layers, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        layers.append((v[at : at + a * b].reshape(a, b), v[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def train(x: np.ndarray, y: np.ndarray, hidden=(32,), classes: bool = False, steps: int = 2000, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Network:
    """Adam over batches; y: values (n x outputs), or class numbers (n)."""
    target = np.eye(int(y.max()) + 1)[y.astype(int)] if classes else np.asarray(y, float).reshape(len(x), -1)
    sizes = [x.shape[1], *hidden, target.shape[1]]
    rng = np.random.default_rng(seed)
    start = _pack([(rng.normal(size=(a, b)) * np.sqrt(2 / a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])])
    picks = A.batches(len(x), min(batch, len(x)), seed)

    def gradient(v, _):
        at = next(picks)
        layers, inputs, h = _unpack(v, sizes), [], x[at]
        for i, (w, b) in enumerate(layers):
            inputs.append(h)
            h = h @ w + b
            if i + 1 < len(layers):
                h = np.maximum(h, 0)
        if classes:
            e = np.exp(h - h.max(1, keepdims=True))
            h = e / e.sum(1, keepdims=True)
        d, out = (h - target[at]) / len(at), []
        for i in range(len(layers) - 1, -1, -1):
            w = layers[i][0]
            out.append((inputs[i].T @ d + decay * w, d.sum(0)))
            d = (d @ w.T) * (inputs[i] > 0)
        return _pack(out[::-1])

    return Network(_unpack(A.adam(gradient, start, rate, steps), sizes), classes)


def _rows(a: ArrayFrame, dim: int):
    """(keys beside dim, features as an array): absent cells are zeros."""
    rest = a.complement(1 << dim)
    entries = F.map_from_entries(F.collect_list(F.struct(D(f"d{dim}"), D("re"))))
    df = a.df.groupBy(*rest).agg(entries.alias("m"))
    places = F.sequence(F.lit(0), F.lit(a.dims[dim] - 1))
    return rest, df.select(*rest, F.transform(places, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("x"))


def fit(features: ArrayFrame, targets: ArrayFrame, dim: int = 0, max_rows: int = 10_000, **options) -> Network:
    """A network from features along dim to class numbers or values of the other dimensions; at most max_rows rows, chosen by a hash of their place, are looked at."""
    rest, rows = _rows(features, dim)
    y = targets.densify().df.select(*rest, D("re").alias("y"))
    sample = rows.join(y, rest).orderBy(F.xxhash64(*rest), *rest).limit(max_rows).collect()
    return train(np.array([r.x for r in sample]), np.array([r.y for r in sample]), **options)


def apply(network: Network, features: ArrayFrame, dim: int = 0) -> ArrayFrame:
    """The network's outputs along dim."""
    rest, rows = _rows(features, dim)
    n = network.layers[-1][0].shape[1]

    def run(batches):
        import pandas as pd

        for p in batches:
            y = network(np.stack(p["x"].to_numpy())) if len(p) else np.zeros((0, n))
            yield pd.DataFrame({k: np.repeat(p[k].to_numpy(), n) for k in rest} | {"o": np.tile(np.arange(n, dtype=np.int32), len(p)), "re": y.ravel(), "im": 0.0})

    out = rows.mapInPandas(run, ", ".join([*(f"{c} int" for c in rest), "o int", "re double", "im double"]))
    return ArrayFrame.of(out.withColumnRenamed("o", f"d{dim}"), features.replace_dims(**{f"d{dim}": n}))
