"""Quality classifier by positive-unlabelled learning.

A linear scorer is fitted to trusted positives and unlabelled web text only; negatives are never shown to
it. The share of positives among the unlabelled (the class prior) is estimated from the same two samples,
and the non-negative unbiased risk

    prior * E_p[loss(+f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])

is minimised with the logistic loss (Kiryo et al. 2017). The prior is the least ratio of the
unlabelled to the positive mass above a threshold of a held-back discriminator (Garg et al. 2021).

Features of a whole text: square roots of the shares of hashed byte trigrams, and shares of character
kinds and of repeated words. They are computed with numpy inside map tasks, so scoring never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.llm import sampling, text

#: Hashed trigram buckets; the documented bounds of the two training samples, in rows.
BUCKETS, MOST_POSITIVE, MOST_UNLABELLED = 1024, 4_000, 6_000

DENSE = ("upper", "digit", "stop", "mark", "symbol", "pipe", "space", "beyond_ascii", "same_1", "same_2", "same_3", "same_4", "word_length", "log_words", "empty")

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 3
_KIND[[ord(c) for c in "!?"]] = 4
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 5
_KIND[ord("|")] = 6
_KIND[[32, 9, 10, 11, 12, 13]] = 7
_KIND[128:] = 8


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """float32 rows of buckets + len(DENSE) columns, one per text."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, buckets + len(DENSE)), np.float32)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    if len(data) > 2:
        x = data.astype(np.uint32)
        h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - buckets.bit_length() + 1)
        whole = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][whole] * np.int64(buckets) + h[whole], minlength=n * buckets).reshape(n, buckets)
        out[:, :buckets] = np.sqrt(counts / np.maximum(1, sizes - 2)[:, None])
    kinds = np.bincount(row * np.int64(9) + _KIND[data], minlength=n * 9).reshape(n, 9) / np.maximum(1, sizes)[:, None]
    starts, ends, of = text.word_spans(data, offsets, text.NOT_SPACE)
    words = np.bincount(of, minlength=n)
    hashes = text.SpanHash(text.lower_ascii(data)).of(starts, ends)
    same = []
    for lag in (1, 2, 3, 4):
        hit = (hashes[lag:] == hashes[:-lag]) & (of[lag:] == of[:-lag])
        same.append(np.sqrt(np.bincount(of[lag:][hit], minlength=n) / np.maximum(1, words - lag)))
    length = np.bincount(of, weights=ends - starts, minlength=n) / np.maximum(1, words)
    out[:, buckets:] = np.stack([*kinds.T[1:], *same, np.minimum(length, 40) / 10, np.log1p(words) / 10, sizes == 0], axis=1)
    return out


@dataclass(frozen=True)
class Model:
    """f(x) = ((x - mean) / scale) . weights + bias, with the estimated prior kept for the record."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + np.float32(self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, epochs: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk over mini-batches with the same share of both samples.

    Where the estimated risk of the negatives falls below zero, the step goes up that part alone.
    """
    rng = np.random.default_rng(seed)
    dims = p.shape[1]
    w = np.zeros(dims + 1)
    first, second, t = np.zeros(dims + 1), np.zeros(dims + 1), 0
    batches = max(1, min(len(p), len(u)) // 256)
    for _ in range(epochs):
        for a, b in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)):
            xp, xu = p[a], u[b]
            fp, fu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            gp_minus, gu_minus = _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
            if negative >= 0:
                cp, cu = prior * (-_sigmoid(-fp) / len(fp) - gp_minus), gu_minus
            else:
                cp, cu = prior * gp_minus, -gu_minus
            grad = np.append(cp @ xp + cu @ xu + decay * w[:-1], cp.sum() + cu.sum())
            t += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p_scores: np.ndarray, u_scores: np.ndarray, confidence: float = 0.1) -> float:
    """The least upper bound of unlabelled mass over positive mass above a threshold, in (0, 1)."""
    cuts = np.sort(p_scores)
    q_p = 1 - np.arange(len(cuts)) / len(cuts)
    q_u = 1 - np.searchsorted(np.sort(u_scores), cuts, "left") / len(u_scores)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(u_scores)) + 1 / np.sqrt(len(p_scores)))
    best = int(np.argmin((q_u + slack) / q_p))
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


def fit(p: np.ndarray, u: np.ndarray, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> Model:
    """Estimates the prior on one half of each sample with a scorer of the other half, then fits all.

    No positives: every text scores 0.5. No unlabelled rows: the positives stand in for them.
    """
    dims = p.shape[1] if len(p) else u.shape[1] if len(u) else BUCKETS + len(DENSE)
    if not len(p):
        return Model(np.zeros(dims, np.float32), np.ones(dims, np.float32), np.zeros(dims, np.float32), 0.0, 0.5)
    u = u if len(u) else p
    # the samples are this function's own from here on; they are scaled where they lie
    mean, scale = u.mean(axis=0), u.std(axis=0) + 0.01
    scale[: -len(DENSE)] *= 4  # single trigrams weigh less than the shares of whole kinds
    for x in (p, u) if u is not p else (p,):
        x -= mean
        x /= scale
    if min(len(p), len(u)) >= 40:
        w, b = _descend(p[::2], u[::2], 0.5, epochs, rate, decay, seed)
        prior = estimate_prior(p[1::2] @ w + b, u[1::2] @ w + b)
    else:
        prior = 0.5
    w, b = _descend(p, u, prior, epochs, rate, decay, seed)
    return Model(mean.astype(np.float32), scale.astype(np.float32), w.astype(np.float32), b, prior)


def _matrix(rows: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """The features of a bounded set of rows, ordered by id, on the driver."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.steps(batch, "text"):
                x = features(*text.joined(part.column("text"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    got = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(pack, "id string, x binary").toArrow()
    got = got.sort_by([("id", "ascending"), ("x", "ascending")])
    out = np.empty((got.num_rows, BUCKETS + len(DENSE)), np.float32)
    for i, x in enumerate(got.column("x")):
        out[i] = np.frombuffer(x.as_buffer(), np.float16)
    return out


def train(documents: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, seed: int = 7) -> Model:
    """Fits a model to texts whose ids are in `positives` (a column id) and to texts of any kind.

    Both samples are drawn by a hash and hold at most `most_*` rows, one for each id among the positives, so that
    what reaches the driver, and the broadcast of sampled ids, is bounded at every input size.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = sampling.about(positives.select("id").where("id IS NOT NULL").distinct(), ["id"], most_positive, seed)
    trusted = sampling.one_each(rows.join(F.broadcast(chosen), "id", "left_semi"), "id", "text")
    unlabelled = sampling.about(rows, ["id", "text"], most_unlabelled, seed + 1)
    return fit(_matrix(trusted, "id", "text"), _matrix(unlabelled, "id", "text"))


def probability(model: Model) -> Callable[[Column], Column]:
    """Text column -> double in (0, 1); null texts count as empty."""

    @F.pandas_udf("double")
    def of(texts):
        out = []
        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(texts, type=pa.large_string())], ["text"])
        for part in text.steps(batch, "text"):
            out.append(_sigmoid(model.logits(features(*text.joined(part.column("text")))).astype(np.float64)))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return of


def score(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of `documents` and a double in (0, 1); null texts count as empty. No shuffle.

    Where `documents` has a column `score_col` already it stays, and the new one gets underscores behind its name.
    Repeated rows are scored alike, an empty table stays empty.
    """
    return documents.select("*", probability(model)(F.col(text_col)).alias(text.free_name(documents.columns, score_col)))
