"""Inference of small dense networks as vectorised column functions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Dense:
    """Int8 weights [inputs, outputs] with one scale for each output, and a bias."""

    weights: np.ndarray
    scale: np.ndarray
    bias: np.ndarray

    @classmethod
    def quantised(cls, w: np.ndarray, bias: np.ndarray) -> Dense:
        scale = np.maximum(np.abs(w).max(axis=0), 1e-12) / 127
        return cls(np.rint(w / scale).astype(np.int8), scale, bias)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.astype(float) * self.scale + self.bias


def forward(layers: list[Dense], x: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """Class probabilities: ReLU between layers, softmax with a temperature at the end."""
    for layer in layers[:-1]:
        x = np.maximum(layer(x), 0)
    z = layers[-1](x) / temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def predict(vector: Column, layers: list[Dense], temperature: float = 1.0) -> Column:
    """struct(label, confidence) of each vector."""

    @F.pandas_udf("label int, confidence double")
    def run(v: pd.Series) -> pd.DataFrame:
        p = forward(layers, np.array(v.tolist(), float), temperature)
        return pd.DataFrame({"label": p.argmax(axis=1).astype("int32"), "confidence": p.max(axis=1)})

    return run(vector)
