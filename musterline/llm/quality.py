"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded (surface
statistics and a hashed bag of words through one tanh layer), a gated attention weighs the
passages, and the weighted sum is scored. Encoder, attention and score are learnt together
from document labels alone, so a bad passage in a long text can decide for the text.

Fitting uses at most SAMPLE labelled IDs (the first by a seeded hash). Of a text of more than SAMPLE_PASSAGES
passages it takes that many, drawn by a seed, so the driver's matrix is bounded and no
text is left out for its length; scoring covers every passage of every text. The model has a
fixed size.

A null or empty text is a bag of one empty passage. Rows are scored one by one: repeated rows
get equal scores, a null ID is kept. Labels of one ID are averaged (a tie counts as 1); rows
without a label, or labels without a row, take no part in fitting. With no labelled rows every
score is 0.5. Columns other than ID and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from musterline.llm.words import document_words

PASSAGE = 64
SAMPLE = 4000
SAMPLE_PASSAGES = 256
_WORDS = 64
_SURFACE = 18
WIDTH = _SURFACE + _WORDS
_HIDDEN, _GATE = 32, 16

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 mark, 5 line end, 6 beyond ASCII
_KIND[33:127] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[10], _KIND[128:] = 1, 2, 3, 5, 6


def passage_features(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One row of WIDTH numbers for each passage of one text."""
    n = len(hashes)
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    first = np.arange(0, n, PASSAGE)
    last = np.append(first[1:], n)
    words = (last - first).astype(np.float64)
    owner = np.repeat(np.arange(len(first)), last - first)
    lo, hi = starts[first], np.append(starts[first[1:]], len(text))
    size = np.maximum(ends[last - 1] - lo, 1).astype(np.float64)
    kinds = _KIND[text[: hi[-1]]]
    x = np.zeros((len(first), WIDTH), np.float32)
    for kind in range(1, 7):
        x[:, kind - 1] = np.add.reduceat((kinds == kind).view(np.int8), lo, dtype=np.int64) / size
    length = (ends - starts).astype(np.float64)
    tail = text[ends - 1]
    per = lambda v: np.bincount(owner, v, len(first)) / words
    x[:, 6] = per(length) / 8
    x[:, 7] = np.sqrt(per(length**2)) / 8
    x[:, 8] = per(np.append(0, hashes[1:] == hashes[:-1]))
    pairs = np.unique(np.stack([owner.astype(np.uint64), hashes], 1), axis=0)[:, 0].astype(np.int64)
    x[:, 9] = np.bincount(pairs, minlength=len(first)) / words
    x[:, 10] = per(_KIND[tail] == 4)
    x[:, 11] = per((_KIND[tail] == 4) & (_KIND[text[np.maximum(ends - 2, starts)]] == 4))
    x[:, 12] = per(_KIND[text[starts]] == 2)
    x[:, 13] = per((_KIND[tail] == 2) & (_KIND[text[starts]] == 2))
    x[:, 14] = per((length == 1) & (_KIND[tail] == 4))
    x[:, 15] = per(length > 20)
    x[:, 16] = np.log1p(words) / 4
    x[:, 17] = 1
    bag = np.bincount(owner * _WORDS + (hashes % np.uint64(_WORDS)).astype(np.int64), minlength=len(first) * _WORDS)
    x[:, _SURFACE:] = np.sqrt(bag.reshape(len(first), _WORDS) / words[:, None])
    return x


@dataclass
class Model:
    """Weights by name; features are scaled by mean and spread first."""

    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """bags: index of the first passage of each bag."""
        w = self.weights
        h = np.tanh(((x - w["mean"]) / w["spread"]) @ w["encode"] + w["encode0"])
        g, s = np.tanh(h @ w["look"] + w["look0"]), 1 / (1 + np.exp(-(h @ w["gate"] + w["gate0"])))
        a = (g * s) @ w["weigh"]
        size = np.diff(np.append(bags, len(x)))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, bags), size))
        a /= np.repeat(np.add.reduceat(a, bags), size)
        z = np.add.reduceat(a[:, None] * h, bags, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score0"], -30, 30)))
        return {"h": h, "g": g, "s": s, "a": a, "z": z, "p": p, "size": size}

    def gradient(self, x: np.ndarray, bags: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Slope of the mean log loss of bag labels in every weight."""
        w, f = self.weights, self.forward(x, bags)
        d = (f["p"] - labels) / len(bags)
        grad = {"score": f["z"].T @ d, "score0": d.sum()}
        dz = np.repeat(d[:, None] * w["score"], f["size"], 0)
        da = (dz * f["h"]).sum(1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, bags), f["size"]))
        grad["weigh"] = (f["g"] * f["s"]).T @ da
        dg = da[:, None] * w["weigh"] * f["s"] * (1 - f["g"] ** 2)
        ds = da[:, None] * w["weigh"] * f["g"] * f["s"] * (1 - f["s"])
        grad |= {"look": f["h"].T @ dg, "look0": dg.sum(0), "gate": f["h"].T @ ds, "gate0": ds.sum(0)}
        dh = f["a"][:, None] * dz + dg @ w["look"].T + ds @ w["gate"].T
        dh *= 1 - f["h"] ** 2
        return grad | {"encode": ((x - w["mean"]) / w["spread"]).T @ dh, "encode0": dh.sum(0)}


def fit(x: np.ndarray, bags: np.ndarray, labels: np.ndarray, epochs: int = 16, seed: int = 7) -> Model:
    """Adam on the log loss of bag labels, in mini-batches of bags."""
    random = np.random.default_rng(seed)
    spread = x.std(0) + 1e-3
    spread[_SURFACE - 1] = 1
    shape = {"encode": (WIDTH, _HIDDEN), "encode0": (_HIDDEN,), "look": (_HIDDEN, _GATE), "look0": (_GATE,), "gate": (_HIDDEN, _GATE), "gate0": (_GATE,), "weigh": (_GATE,), "score": (_HIDDEN,), "score0": ()}
    w = {k: (random.normal(0, s[0] ** -0.5, s) if len(s) else np.zeros(())) for k, s in shape.items()}
    w |= {"mean": x.mean(0), "spread": spread, "score0": np.array(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))}
    model, step = Model(w), 0
    m, v = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}
    ends = np.append(bags[1:], len(x))
    for epoch in range(epochs):
        order = random.permutation(len(bags))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            size = ends[some] - bags[some]
            rows = np.concatenate([np.arange(bags[i], ends[i]) for i in some])
            own, y = np.append(0, np.cumsum(size)[:-1]), labels[some]
            bx = x[rows]
            grad = model.gradient(bx, own, y)
            step += 1
            for k in shape:
                g = grad[k] + 1e-4 * w[k] * (k[-1] != "0")
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _features(most: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for row, text, s, e, h in document_words(batch.column("text")):
                x = passage_features(text, s, e, h)
                if len(x) > most:
                    x = x[np.sort(np.random.default_rng(len(x)).choice(len(x), most, replace=False))]
                keep.append(row)
                rows.append(x.astype(np.float16).tobytes())
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([kept.column("doc_id").cast(pa.int64()), kept.column("label").cast(pa.float64()), pa.array(rows, pa.binary())], names=["doc_id", "label", "features"])

    return task


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> Model | None:
    """A model from labels (doc_id, label 0 or 1) and the texts they name."""
    chosen = (
        labels.where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id")
        .limit(sample)
    )
    # One row of an ID: the least text of those that repeat it, so no more than `sample` rows reach the driver.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    rows = found.mapInArrow(_features(passages), "doc_id long, label double, features binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    each = [np.frombuffer(r["features"], np.float16).reshape(-1, WIDTH) for r in rows]
    bags = np.cumsum([0] + [len(x) for x in each[:-1]])
    return fit(np.concatenate(each).astype(np.float64), bags, np.array([r["label"] for r in rows]))


def scorer(spark: SparkSession, model: Model | None) -> Callable[[Column], Column]:
    """A column function from text to a score from 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    def scores(text: pa.Array) -> pa.Array:
        out, held, size = np.full(len(text), 0.5), [], 0

        def settle() -> None:
            x = np.concatenate([f for _, f in held]).astype(np.float64)
            bags = np.cumsum([0] + [len(f) for _, f in held[:-1]])
            out[[row for row, _ in held]] = shared.value.forward(x, bags)["p"]

        if shared.value is not None:
            for row, data, s, e, h in document_words(text):
                held.append((row, passage_features(data, s, e, h).astype(np.float16)))
                size += len(held[-1][1])
                if size >= 4096:
                    settle()
                    held, size = [], 0
            if held:
                settle()
        return pa.array(out)

    return F.arrow_udf(scores, "double")
