"""Quality by compression: zstandard dictionaries of good and of bad texts, their size difference calibrated.

A text is cut into blocks of BLOCK bytes, each compressed on its own under both
dictionaries, so that a long text cannot become its own dictionary.  The measure is
(size under good - size under bad) / (their sum); beside it stands how far the text
compresses with and without a dictionary, because repeated words compress under any.  A
logistic curve over these and their products, fitted on held-back labelled texts, turns
them into a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import mix, sample_key, slices, text_bytes

BLOCK = 1024
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
# Bounds of the learning sample: labelled texts of each class, and blocks of each that go into a dictionary.
TEXTS_PER_CLASS = 1500
BLOCKS_PER_TEXT = 16


def _measures(good: int, bad: int, size: int, own: int) -> tuple[float, float, float]:
    return (good - bad) / max(1, good + bad), (good + bad) / (2 * max(1, size)), own / max(1, size)


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self) -> tuple:
        make = lambda d: zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        return make(self.good), make(self.bad), make(b"")

    def probability(self, m: np.ndarray) -> np.ndarray:
        z = _terms((m - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def measure(texts: list[bytes], compressors: tuple) -> np.ndarray:
    """Size difference, size under the dictionaries and size without one, each over the text's own."""
    good, bad, own = compressors
    out = np.zeros((len(texts), 3))
    for k, t in enumerate(texts):
        blocks = [t[i : i + BLOCK] for i in range(0, len(t), BLOCK)]
        g = sum(len(good.compress(b)) for b in blocks)
        d = sum(len(bad.compress(b)) for b in blocks)
        out[k] = _measures(g, d, len(t), sum(len(own.compress(b)) for b in blocks))
    return out


def _terms(x: np.ndarray) -> np.ndarray:
    """Constant, the measures, their squares and products, and their positive parts."""
    products = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    hinges = [np.maximum(x[:, i] - c, 0) for i in range(x.shape[1]) for c in (-1, 0, 1)]
    return np.column_stack([np.ones(len(x)), x, *products, *hinges])


def calibrate(m: np.ndarray, label: np.ndarray, share_good: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps; classes count as often as ``share_good`` says."""
    mean, scale = m.mean(axis=0), m.std(axis=0) + 1e-9
    x = _terms((m - mean) / scale)
    n_good, n_bad = max(1, label.sum()), max(1, (1 - label).sum())
    weight = np.where(label == 1, share_good / n_good, (1 - share_good) / n_bad) * len(label)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w += np.linalg.solve(curve, x.T @ (weight * (label - p)) - 0.1 * w)
    return mean, scale, w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = TEXTS_PER_CLASS, per_text: int = BLOCKS_PER_TEXT) -> Model:
    """Dictionaries from half of a bounded sample of labelled texts, calibration from the other half.

    A text gives a dictionary ``per_text`` of its blocks, chosen by hash from the whole text.
    A document with several labels is good only if all are 1.  Without texts of both
    classes every score is the share of good labels (0.5 without any).
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    share = marked.agg(F.avg(F.col("label").cast("double")).alias("s")).first().s
    both = [marked.where(F.col("label") == k).orderBy(sample_key("id"), "id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(both[0].unionByName(both[1]))  # at most two times per_class ids
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    sample = rows.groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    fitted = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda g: _fit(g, 0.5 if share is None else float(share), per_text), "good binary, bad binary, mean array<double>, scale array<double>, weights array<double>").toArrow().to_pandas()
    if not len(fitted):
        return Model(b"", b"", np.zeros(3), np.ones(3), _constant(0.5 if share is None else float(share)))
    r = fitted.iloc[0]
    return Model(bytes(r["good"]), bytes(r["bad"]), *(np.asarray(r[c], float) for c in ("mean", "scale", "weights")))


def _constant(share: float) -> np.ndarray:
    w = np.zeros(_terms(np.zeros((1, 3))).shape[1])
    w[0] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    return w


def _fit(group: pd.DataFrame, share: float, per_text: int) -> pd.DataFrame:
    """One task: the sample holds at most twice ``per_class`` texts."""
    group = group.sort_values("id")
    texts = [t.encode() for t in group["text"]]
    label = group["label"].to_numpy(int)
    half = np.zeros(len(texts), bool)
    for k in (0, 1):
        half[np.flatnonzero(label == k)[::2]] = True
    dictionaries = [_dictionary([texts[i] for i in np.flatnonzero(half & (label == k))], per_text) for k in (1, 0)]
    model = Model(*dictionaries, np.zeros(3), np.ones(3), _constant(share))
    rest = np.flatnonzero(~half)
    if len(set(label[rest])) == 2:
        m = measure([texts[i] for i in rest], model.compressors())
        model.mean, model.scale, model.weights = calibrate(m, label[rest].astype(float), share)
    row = {"good": model.good, "bad": model.bad, "mean": model.mean, "scale": model.scale, "weights": model.weights}
    return pd.DataFrame([row])


def _sampled(text: bytes, per_text: int) -> list[bytes]:
    """At most ``per_text`` blocks from anywhere in the text, in order; the choice is repeatable."""
    starts = np.arange(0, len(text), BLOCK)
    order = np.argsort(mix(starts.astype(np.uint64) + np.uint64(zlib.crc32(text) << 32)), kind="stable")
    return [text[i : i + BLOCK] for i in np.sort(starts[order[:per_text]]).tolist()]


def _dictionary(texts: list[bytes], per_text: int) -> bytes:
    blocks = [b for t in texts for b in _sampled(t, per_text)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: their own bytes serve
        return b"".join(blocks)[:DICTIONARY_BYTES]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, difference`` for every row; a null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.compressors()
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(text_bytes(part.column(1)), own)
                p = shared.value.probability(m) if len(m) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(m[:, 0])], ["id", "score", "difference"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, difference double").withColumnRenamed("id", id_col)
