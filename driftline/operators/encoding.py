"""Trajectory encoders: a plug-in interface, batch inference, and a transformer whose weights are read from a file.

An encoder is any callable that is sent to the workers and takes (steps, mask): float32 rows of
four features padded with zeros, and 1 for the rows that are there.  It returns one vector for
each trajectory.  Nothing is trained here; published weights are an input.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from driftline.schema import IGNORED, MAX_LEN

Encoder = Callable[[np.ndarray, np.ndarray], np.ndarray]

FEATURES = 4

# Defaults of training, kept as data for the tools that train.
TRAINING = {"epochs": 5, "batch_size": 512, "gradient_accumulation_steps": 4, "logging_steps": 10, "evaluation_steps": 50, "half_precision": True}


@dataclass(frozen=True)
class Config:
    """The encoder's sizes."""

    hidden_size: int = 256
    layers: int = 4
    heads: int = 4
    intermediate_size: int = 1024
    positions: int = MAX_LEN
    embedding_eps: float = 1e-5
    layer_eps: float = 1e-12


def shapes(c: Config) -> dict[str, tuple[int, ...]]:
    """The name and shape of every weight."""
    h, wide = c.hidden_size, c.intermediate_size
    out: dict[str, tuple[int, ...]] = {"embed.w": (FEATURES, h), "embed.b": (h,), "positions": (c.positions, h), "embed.scale": (h,), "embed.shift": (h,), "head.w": (h, FEATURES), "head.b": (FEATURES,)}
    for i in range(c.layers):
        for name in ("query", "key", "value", "out"):
            out |= {f"{i}.{name}.w": (h, h), f"{i}.{name}.b": (h,)}
        out |= {f"{i}.up.w": (h, wide), f"{i}.up.b": (wide,), f"{i}.down.w": (wide, h), f"{i}.down.b": (h,)}
        for name in ("attended", "fed"):
            out |= {f"{i}.{name}.scale": (h,), f"{i}.{name}.shift": (h,)}
    return out


def _normal(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float) -> np.ndarray:
    gone = x - x.mean(-1, keepdims=True)
    return gone / np.sqrt((gone * gone).mean(-1, keepdims=True) + eps) * scale + shift


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - tail * np.exp(-x * x))


@dataclass
class Transformer:
    """A post-normalised transformer encoder over trajectories, forward pass only (no dropout)."""

    config: Config = field(default_factory=Config)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def random(cls, config: Config, seed: int = 42) -> Transformer:
        """Untrained weights, for tests."""
        r = np.random.RandomState(seed)
        made = {n: np.ones(s) if n.endswith("scale") else np.zeros(s) if n.endswith(("shift", ".b")) else r.normal(0, 0.02, s) for n, s in shapes(config).items()}
        return cls(config, {n: v.astype(np.float32) for n, v in made.items()})

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: Config | None = None) -> Transformer:
        """Weights from one ``.npz`` file in any store that Spark reads; bounded by the model's size."""
        raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
        found = dict(np.load(io.BytesIO(raw)))
        config = config or Config()
        for name, shape in shapes(config).items():
            if name not in found or found[name].shape != shape:
                raise ValueError(f"the weight {name} is missing or not of shape {shape}")
        return cls(config, found)

    def embed(self, steps: np.ndarray) -> np.ndarray:
        """The embedding layer: a projection of the features plus learned positions, normalised."""
        if steps.shape[1] > self.config.positions:
            raise ValueError(f"a sequence has at most {self.config.positions} rows")
        w = self.weights
        return _normal(steps @ w["embed.w"] + w["embed.b"] + w["positions"][: steps.shape[1]], w["embed.scale"], w["embed.shift"], self.config.embedding_eps)

    def states(self, steps: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The last hidden states; padded rows are attended by nothing."""
        c, w = self.config, self.weights
        n, length, _ = steps.shape
        size = c.hidden_size // c.heads
        heads = lambda x: x.reshape(n, length, c.heads, size).transpose(0, 2, 1, 3)
        hide = np.where(mask[:, None, None, :] > 0, 0.0, -np.inf).astype(np.float32)
        x = self.embed(steps)
        for i in range(c.layers):
            at = lambda name, y, i=i: y @ w[f"{i}.{name}.w"] + w[f"{i}.{name}.b"]
            q, k, v = (heads(at(name, x)) for name in ("query", "key", "value"))
            score = q @ k.transpose(0, 1, 3, 2) / np.sqrt(np.float32(size)) + hide
            score = np.exp(score - score.max(-1, keepdims=True))
            met = (score / score.sum(-1, keepdims=True)) @ v
            met = at("out", met.transpose(0, 2, 1, 3).reshape(n, length, -1))
            x = _normal(x + met, w[f"{i}.attended.scale"], w[f"{i}.attended.shift"], c.layer_eps)
            up = at("up", x)
            x = _normal(x + at("down", up * (1 + _erf(up / np.sqrt(2))) / 2), w[f"{i}.fed.scale"], w[f"{i}.fed.shift"], c.layer_eps)
        return x

    def forward(self, steps: np.ndarray, mask: np.ndarray | None = None, labels: np.ndarray | None = None) -> tuple[np.ndarray, float | None]:
        """Predicted features of every row, and the mean squared error over rows whose labels are all set."""
        mask = np.ones(steps.shape[:2]) if mask is None else mask
        predicted = self.states(steps, mask) @ self.weights["head.w"] + self.weights["head.b"]
        if labels is None:
            return predicted, None
        hidden = (labels != IGNORED).all(-1)
        return predicted, float(((predicted[hidden] - labels[hidden]) ** 2).mean()) if hidden.any() else None

    def __call__(self, steps: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The first row's state stands for the trajectory."""
        return self.states(steps, mask)[:, 0]


def mean_step(steps: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The plainest encoder: the mean of the rows."""
    return (steps * mask[..., None]).sum(1) / mask.sum(1, keepdims=True)


def embeddings(items: DataFrame, encoder: Encoder, batch_size: int = 512, normalise: bool = True) -> DataFrame:
    """(mmsi, time_start, embedding) of items with ``tokens``; a task encodes ``batch_size`` trajectories at once.

    With ``normalise`` vectors are divided by their length; a zero vector stays as it is.  Of a
    batch all are padded to its longest, sorted by length first, so little is padded.
    """
    sent = items.sparkSession.sparkContext.broadcast(encoder)
    out = T.StructType([items.schema["mmsi"], items.schema["time_start"], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = sent.value
        for whole in batches:
            tokens = [np.asarray(t, np.float32).reshape(-1, FEATURES) for t in whole.column(2).to_pylist()]
            order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
            found: list = [None] * len(tokens)
            for at in range(0, len(order), batch_size):
                part = order[at : at + batch_size]
                longest = max(1, *(len(tokens[i]) for i in part))
                steps, mask = np.zeros((len(part), longest, FEATURES), np.float32), np.zeros((len(part), longest), np.float32)
                for row, i in enumerate(part):
                    steps[row, : len(tokens[i])] = tokens[i]
                    mask[row, : len(tokens[i])] = 1
                vectors = encode(steps, mask)
                if normalise:
                    length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
                    vectors = vectors / np.where(length > 0, length, 1)
                for i, v in zip(part, vectors, strict=True):
                    found[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([whole.column(0), whole.column(1), pa.array(found, pa.list_(pa.float32()))], names=out.names)

    return items.select("mmsi", "time_start", "tokens").mapInArrow(run, out)
