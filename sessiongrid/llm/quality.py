"""Quality: attention-based multiple-instance learning on the passages of a document.

A document is a bag of passages of PASSAGE bytes. A passage is encoded from the histogram of its
character-class pairs by a dense layer; gated attention, learned from document labels alone, weighs the
passage encodings, and the weighted encoding is scored. Fitting takes a bounded sample of labelled documents
(``bound``, about half of each class); scoring reads every passage of every text.

Defined results: a null or empty text has one empty passage; without labels of both classes every score is
the share of good labels (0 where there are none); columns named as an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.llm.texts import Shared, class_sample, crc_bucket, map_texts, text_of_byte

PASSAGE = 512
BOUND = 3000
HIDDEN = 24
ATTENTION = 16
THRESHOLD = 0.3
#: fixed values: character classes by byte; letters, digits, white space and single signs that mark up or decorate text
CLASSES = [b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"|", b"#", b"*%", b"$&", b"<>{}[]()=/\\\"'`_-@+~^"]
KINDS = len(CLASSES) + 1


def class_table() -> np.ndarray:
    table = np.full(256, KINDS - 1, np.int64)
    for kind, members in enumerate(CLASSES):
        table[list(members)] = kind
    return table


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histograms of class pairs, a row per passage in order of the texts, and the number of passages of each text."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    firsts = np.cumsum(counts) - counts
    owner = text_of_byte(offsets)
    passage = firsts[owner] + (np.arange(len(data)) - offsets[:-1][owner]) // PASSAGE
    kind = class_table()[data]
    pair = kind[:-1] * KINDS + kind[1:]
    inside = passage[:-1] == passage[1:] if len(data) else np.zeros(0, bool)
    rows = int(counts.sum())
    found = np.bincount(passage[:-1][inside] * KINDS**2 + pair[inside], minlength=rows * KINDS**2)
    return found.reshape(rows, KINDS**2).astype(np.float32), counts


def _scaled(found: np.ndarray) -> np.ndarray:
    return np.sqrt(found / np.maximum(1, found.sum(1, keepdims=True)))


def attend(x: np.ndarray, firsts: np.ndarray, counts: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Encodings, gated attention within each bag, weighted encodings and margins."""
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-h @ w["gate"]))
    energy = (t * g) @ w["attend"]
    energy = np.exp(energy - np.repeat(np.maximum.reduceat(energy, firsts), counts))
    a = energy / np.repeat(np.add.reduceat(energy, firsts), counts)
    z = np.add.reduceat(a[:, None] * h, firsts)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "margin": z @ w["out"] + w["out_bias"][0]}


def slopes(x: np.ndarray, counts: np.ndarray, target: np.ndarray, weight: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss of ``attend``, written out; ``weight`` adds up to 1."""
    firsts = np.cumsum(counts) - counts
    s = attend(x, firsts, counts, w)
    error = weight * (1 / (1 + np.exp(-s["margin"])) - target)
    dz = np.repeat(error[:, None] * w["out"], counts, axis=0)
    da = (dz * s["h"]).sum(1)
    de = s["a"] * (da - np.repeat(np.add.reduceat(s["a"] * da, firsts), counts))
    dt = de[:, None] * w["attend"] * s["g"] * (1 - s["t"] ** 2)
    dg = de[:, None] * w["attend"] * s["t"] * s["g"] * (1 - s["g"])
    dh = (s["a"][:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - s["h"] ** 2)
    return {"encode": x.T @ dh, "encode_bias": dh.sum(0), "tanh": s["h"].T @ dt, "gate": s["h"].T @ dg, "attend": (s["t"] * s["g"]).T @ de, "out": s["z"].T @ error, "out_bias": error.sum(keepdims=True)}


def train(x: np.ndarray, counts: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 200, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the whole sample of bags."""
    random = np.random.default_rng(seed)
    shapes = {"encode": (x.shape[1], HIDDEN), "encode_bias": (HIDDEN,), "tanh": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION), "attend": (ATTENTION,), "out": (HIDDEN,), "out_bias": (1,)}
    w = {k: (random.normal(0, 1 / np.sqrt(s[0]), s) if "bias" not in k else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    weight = (weight / weight.sum()).astype(np.float32)
    for step in range(1, rounds + 1):
        for k, value in slopes(x, counts, target, weight, w).items():
            value = value.astype(np.float32) + 1e-5 * w[k]
            first[k] = 0.9 * first[k] + 0.1 * value
            second[k] = 0.999 * second[k] + 0.001 * value**2
            w[k] = w[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def _features(data: np.ndarray, offsets: np.ndarray) -> dict:
    found, counts = passages(data, offsets)
    parts = np.split(np.minimum(found, PASSAGE).astype(np.uint16), np.cumsum(counts)[:-1])
    return {"passages": pa.array([p.tobytes() for p in parts], pa.binary())}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, remainder: int = 0, bound: int = BOUND) -> Model:
    """Learn from labelled documents outside the held-out remainder."""
    sample, sizes = class_sample(docs, labels, label, modulus, remainder, bound)
    fields = [T.StructField("passages", T.BinaryType())]
    rows = sorted(map_texts(sample, _features, fields, keep=["doc_id", "__label"]).collect(), key=lambda r: (r["doc_id"], r["__label"]))
    target = np.array([r["__label"] for r in rows], np.float32)
    if len(set(target)) < 2:
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    weight = np.where(target == 1, sizes[1] / target.sum(), sizes[0] / (len(target) - target.sum()))
    bags = [np.frombuffer(r["passages"], np.uint16).reshape(-1, KINDS**2) for r in rows]
    counts = np.array([len(b) for b in bags])
    return Model(0.0, train(_scaled(np.concatenate(bags).astype(np.float32)), counts, target, weight))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` in [0, 1], ``predicted`` and ``n_passages``."""
    shared = Shared(docs.sparkSession, model)

    def work(data: np.ndarray, offsets: np.ndarray) -> dict:
        m = shared.value
        found, counts = passages(data, offsets)
        if m.weights:
            margin = attend(_scaled(found), np.cumsum(counts) - counts, counts, m.weights)["margin"].astype(np.float64)
        else:
            margin = np.full(len(counts), m.intercept)
        value = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return {"score": value, "predicted": (value >= THRESHOLD).astype(np.int32), "n_passages": counts.astype(np.int64)}

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_passages", T.LongType())]
    return map_texts(docs, work, fields, keep=keep)


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", crc_bucket(F.col("doc_id"), 5) == 0)
