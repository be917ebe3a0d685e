"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic texts are the positives; a random sample of all texts is the unlabelled
side.  With class prior p the risk of a linear scorer z under the logistic loss is

    p * mean_P loss(z, +1) + max(0, mean_U loss(z, -1) - p * mean_P loss(z, -1))

and where the second part would turn negative its gradient is stepped back, so that the
scorer cannot fit the unlabelled texts beyond what the prior allows.  Every feature of the
sample takes part; one whose rates in positives and unlabelled texts are t standard errors
apart counts with t^2 / (t^2 + DOUBT), so the ridge term weighs heavier on features without
evidence.  The prior is an argument, or else estimated from texts that a first
fit did not see: the least ratio of unlabelled to positive texts above any threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Spans, sample_key, slices, word_bounds

BITS = 18
# Leading bytes of a word that are features beside the word itself.
PREFIXES = (4, 5, 6)
# Bounds of the learning sample: positives, and expected unlabelled texts of each member.
POSITIVES = 2000
UNLABELLED = 6000
MEMBERS = 3
# Squared standard errors at which a feature counts half.
DOUBT = 25.0
# Steps of the fit, and of the first fit that only ranks texts to estimate the prior.
STEPS = 150
RANKING_STEPS = 50
# Prior of that first fit: small, so that it seldom steps back and ranks as plain positive against unlabelled.
RANKING_PRIOR = 0.02
# The sample is dealt to so many folds; each is ranked by a first fit to the others.
FOLDS = 2
RATE = 0.1
RIDGE = 2e-4

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text: (text number, bucket) pairs in order; only ``wanted`` buckets."""
    parts = [t.lower().encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends_of_text = np.cumsum([len(p) for p in parts])
    starts, ends = word_bounds(_LETTER[data])
    text = np.searchsorted(ends_of_text, starts, "right")
    spans = Spans(data)
    keys = []
    for salt, size in enumerate((0, *PREFIXES)):
        longer = (ends - starts > size) if size else np.ones(len(starts), bool)
        a = starts[longer]
        h = spans.hash(a, a + size if size else ends[longer]) + np.uint64(salt)
        bucket = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            hit = wanted[bucket]
            bucket, own = bucket[hit], text[longer][hit]
        else:
            own = text[longer]
        keys.append((own << BITS) | bucket)
    both = np.unique(np.concatenate(keys))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        text, bucket = features(texts, self.weights != 0)
        z = self.bias + np.bincount(text, weights=self.weights[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk(z: np.ndarray, share_p: np.ndarray, share_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, bool]:
    """Positive and negative part of the risk of outputs ``z``, the gradient to follow, and whether it steps back."""
    p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    as_negative = np.logaddexp(0, z)
    positive_part = prior * (share_p @ np.logaddexp(0, -z))
    negative_part = share_u @ as_negative - prior * (share_p @ as_negative)
    of_negative = (share_u - prior * share_p) * p
    back = negative_part < 0
    return positive_part, negative_part, -of_negative if back else prior * share_p * (p - 1) + of_negative, back


def fit_nnpu(indices: np.ndarray, lengths: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, size: int, scale: np.ndarray | None = None, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of one scorer from rows of features (``indices`` row after row), averaged over the second half of the steps.

    A feature counts as ``scale`` of it; the ridge term is on the weights before scaling.
    """
    row = np.repeat(np.arange(len(lengths)), lengths)
    scale = np.ones(size) if scale is None else scale
    w, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    share_p = positive / max(1, positive.sum())
    share_u = unlabelled / max(1, unlabelled.sum())
    m, v, total = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, weights=(w * scale)[indices], minlength=len(lengths))
        g = risk(z, share_p, share_u, prior)[2]
        step = np.append(scale * np.bincount(indices, weights=g[row], minlength=size) + RIDGE * w, g.sum())
        m = 0.9 * m + 0.1 * step
        v = 0.999 * v + 0.001 * step**2
        move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
        if t > steps // 2:
            total += np.append(w * scale, bias)
    total /= steps - steps // 2
    return total[:-1], float(total[-1])


def evidence(indices: np.ndarray, lengths: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, size: int) -> np.ndarray:
    """Share with which each feature counts, by how far its rates in positive and unlabelled rows lie apart."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    in_p, in_u = (np.bincount(indices, weights=x[row], minlength=size) for x in (positive, unlabelled))
    n_p, n_u = max(1.0, positive.sum()), max(1.0, unlabelled.sum())
    squared = (in_p / n_p - in_u / n_u) ** 2 / ((in_u + 1) / n_u * (1 / n_p + 1 / n_u))
    return squared / (squared + DOUBT)


def estimate_prior(z: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the shares of unlabelled and positive rows at or above a threshold that half of the positives pass."""
    above_p, above_u = np.sort(z[positive > 0]), np.sort(z[unlabelled > 0])
    if not len(above_p) or not len(above_u):
        return 0.5
    cuts = above_p[: len(above_p) // 2 + 1]
    p, u = (1 - np.searchsorted(x, cuts, "left") / len(x) for x in (above_p, above_u))
    return float((u / p).min())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, members: int = MEMBERS, prior: float | None = None) -> Scorer:
    """A scorer averaged over ``members`` classifiers, each trained in a task of its own.

    A document with several labels is toxic if one of them is 1.  ``prior`` is the share of
    toxic ones among all documents; if it is not given, each member estimates it from its
    unlabelled texts, so that labels may hold more or fewer toxic ones than the corpus.  Rows
    that share an id share its label and are rows of their own.  Without any positive
    nothing is toxic.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    chosen = marked.where("label = 1").orderBy(sample_key("id"), "id").limit(positives).select("id", F.lit(True).alias("pos"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, rows.count())
    share = min(1.0, unlabelled * members / n)
    rows = rows.withColumn("key", sample_key("id")).join(F.broadcast(chosen), "id", "left")
    rows = rows.withColumn("unl", F.col("key") < share).where("unl or pos").select("id", "text", F.coalesce("pos", F.lit(False)).alias("pos"), "unl", "key")
    found = rows.mapInArrow(_features_of, "pos boolean, unl boolean, part int, features array<int>")
    # each positive serves every member, each unlabelled text one
    dealt = found.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1)))).withColumn("unl", F.expr(f"unl and part % {members} = member")).where("pos or unl")
    fitted = dealt.groupBy("member").applyInPandas(lambda group: _fit(group, prior), "member int, bias double, buckets array<int>, weights array<double>").toArrow().to_pandas()
    total, bias = np.zeros(1 << BITS), -20.0
    for b, w in zip(fitted["buckets"], fitted["weights"], strict=True):
        total[np.asarray(b, np.int64)] += np.asarray(w) / len(fitted)
    return Scorer(total, float(fitted["bias"].mean()) if len(fitted) else bias)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            names = part.schema.names
            text, bucket = features(part.column(names.index("text")).to_pylist())
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            key = np.asarray(part.column(names.index("key")).to_pylist(), float)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(names.index("pos")),
                    part.column(names.index("unl")),
                    pa.array((key * (1 << 30)).astype(np.int32) >> 4),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket.astype(np.int32))),
                ],
                ["pos", "unl", "part", "features"],
            )


def _fit(group: pd.DataFrame, prior: float | None) -> pd.DataFrame:
    if not group["pos"].any():
        return pd.DataFrame({"member": group["member"].head(1), "bias": [-20.0], "buckets": [[]], "weights": [[]]})
    group = group.sort_values("part", kind="stable")  # the same sample in any order of arrival
    pos, unl = (group[x].to_numpy(float) for x in ("pos", "unl"))
    lists = group["features"].to_list()
    lengths = np.array([len(x) for x in lists])
    used, indices = np.unique(np.concatenate([np.empty(0, np.int32), *lists]), return_inverse=True)
    indices, size = indices.astype(np.int32), len(used)
    if prior is None:
        z, row, turn = np.zeros(len(lists)), np.repeat(np.arange(len(lists)), lengths), np.arange(len(lists)) % FOLDS
        for k in range(FOLDS):
            rest = turn != k
            w, bias = fit_nnpu(indices, lengths, pos * rest, unl * rest, RANKING_PRIOR, size, evidence(indices, lengths, pos * rest, unl * rest, size), RANKING_STEPS)
            z[~rest] = bias + np.bincount(row, weights=w[indices], minlength=len(lists))[~rest]
        prior = estimate_prior(z, pos, unl)
    w, bias = fit_nnpu(indices, lengths, pos, unl, min(max(prior, 1e-4), 0.9), size, evidence(indices, lengths, pos, unl, size))
    return pd.DataFrame({"member": group["member"].head(1).to_numpy(), "bias": [bias], "buckets": [used.astype(np.int32)], "weights": [w]})


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """``id_col, keep..., out`` for every row: the score; a null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    names = [f"k{i}" for i in range(1 + len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for k, c in zip(names, (id_col, *keep), strict=True)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = shared.value.score(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(p)], [*names, "score"])

    scored = rows.mapInArrow(run, f"{schema}, score double")
    return scored.select(*[F.col(k).alias(c) for k, c in zip(names, (id_col, *keep), strict=True)], F.col("score").alias(out))
