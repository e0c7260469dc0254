"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text is reduced to counts (letters, capitals, symbols, repeated words, lines, ...), turned into smoothed
log ratios. Class means and covariances come from sums that Spark adds up over all labelled rows; covariances
are shrunk towards their diagonal and the pooled covariance. The model keeps one Cholesky factor per class; a
score is the logistic of the difference of the two Gaussian log densities (Mahalanobis distances plus log
determinants) and the log prior odds, damped by a factor fitted on the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcare.llm.text import buffers, pieces, word_hashes
from stationcare.session import staged

SHRINK_POOLED = 0.3
SHRINK_DIAGONAL = 0.02
RIDGE = 1e-3
THRESHOLD = 0.3
BYTE_PRIOR = 0.5
TEMPERATURES = (1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08)

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9),
            "line": (10, 13), "stop": b".?", "bang": b"!", "comma": b",;:", "pipe": b"|/\\<>{}[]=_~^",
            "junk": b"*&%$#@+", "other": b"\"'()-`", "wide": range(192, 256)}
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[*_CLASSES["bang"], *_CLASSES["pipe"], *_CLASSES["junk"]]] = True
FEATURES = ["letters", *[f"share_{c}" for c in _CLASSES], "word_length", "distinct", "adjacent", "top",
            "line_words", "symbol_words", "caps_words", "wide_mix"]


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x FEATURES. A text without a byte has the statistics of zero counts."""
    kind = np.full(256, -1, np.int8)
    for i, members in enumerate(_CLASSES.values()):
        kind[list(members)] = i
    kinds = kind[data]
    counts = {name: _sums(kinds == i, offsets) for i, name in enumerate(_CLASSES)}
    size = np.diff(offsets).astype(np.float64)
    hashes, at = word_hashes(data, offsets)
    words = np.diff(at).astype(np.float64)
    text = np.repeat(np.arange(len(words)), np.diff(at))

    keys = np.sort((text.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    t = (keys >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(t[new], minlength=len(words)).astype(np.float64)
    runs = np.diff(np.append(np.flatnonzero(new), len(keys)))
    top = np.zeros(len(words))
    np.maximum.at(top, t[new], runs)
    twice = np.bincount(text[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])], minlength=len(words))

    letters = counts["upper"] + counts["lower"] + counts["wide"]
    symbol = _SYMBOLS[data]
    heads = symbol.copy()
    heads[1:] &= ~symbol[:-1]
    cut = offsets[:-1][size > 0]
    heads[cut] = symbol[cut]
    upper = kinds == 0
    both = upper.copy()
    both[1:] &= upper[:-1]
    both[cut] = False

    def share(part: np.ndarray, whole: np.ndarray, add: float) -> np.ndarray:
        return np.log((part + add) / (np.maximum(whole - part, 0) + 20 * add))

    columns = [np.log1p(letters)]
    columns += [share(c, size, BYTE_PRIOR) for c in counts.values()]
    columns += [np.log((letters + 5) / (words + 1)), share(words - distinct, words, 0.5), share(twice, words, 0.25),
                share(top, words, 0.5), np.log((words + 3) / (counts["line"] + 1)),
                share(_sums(heads, offsets), words, 0.25), share(_sums(both, offsets), letters, 0.5),
                share(counts["wide"], letters, 0.5)]
    return np.stack(columns, axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, stats array<double>`` of every whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            x = statistics(*buffers(piece.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)),
                                             pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_hash"), lists],
                                             ["doc_id", "text_hash", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       "text").mapInArrow(run, "doc_id long, text_hash long, stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Fitted model; ``factors`` are the Cholesky factors of the two shrunk covariances."""

    means: np.ndarray
    factors: np.ndarray
    bias: float
    temperature: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density under label 1 minus that under label 0, and the log prior odds."""
        parts = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            parts.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        return parts[1] - parts[0] + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) * self.temperature, -500, 500)))


def shrunk(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float = SHRINK_POOLED,
           diagonal: float = SHRINK_DIAGONAL) -> tuple[np.ndarray, np.ndarray]:
    """Class means and Cholesky factors from counts, sums and sums of outer products."""
    means = sums / counts[:, None]
    cov = squares / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    both = (cov * counts[:, None, None]).sum(axis=0) / counts.sum()
    out = []
    for c in cov:
        c = (1 - pooled) * c + pooled * both
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + RIDGE * np.eye(len(c))
        out.append(np.linalg.cholesky(c))
    return means, np.stack(out)


def fit(labelled: DataFrame, pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL) -> Discriminant | None:
    """Fit on ``stats, label`` rows (label 0 or 1, others ignored). None if a label has fewer than two rows.

    Two passes of sums over all labelled rows; the driver sees one small matrix per task and class.
    """
    d = len(FEATURES)
    rows = labelled.filter(F.col("label").isin(0, 1)).select("stats", F.col("label").cast("int").alias("label"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = batch.column("label").to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    part = x[y == c]
                    held[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(list(held.ravel())), pa.array(range(held.size), pa.int32())],
                                         ["value", "place"])

    total = np.zeros(2 * (1 + d + d * d))
    for r in (rows.mapInArrow(moments, "value double, place int").groupBy("place")
              .agg(F.sum("value").alias("value")).collect()):
        total[r["place"]] = r["value"]
    total = total.reshape(2, -1)
    counts, sums, squares = total[:, 0], total[:, 1:1 + d], total[:, 1 + d:].reshape(2, d, d)
    if (counts < 2).any():
        return None
    means, factors = shrunk(counts, sums, squares, pooled, diagonal)
    model = Discriminant(means, factors, float(np.log(counts[1] / counts[0])), 1.0)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(TEMPERATURES))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = batch.column("label").to_numpy(zero_copy_only=False)
                signed = model.margin(x) * np.where(y == 1, 1, -1)
                held += [np.logaddexp(0, -signed * t).sum() for t in TEMPERATURES]
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(range(len(held)), pa.int32())],
                                         ["value", "place"])

    found = (rows.mapInArrow(losses, "value double, place int").groupBy("place")
             .agg(F.sum("value").alias("value")).collect())
    best = min(found, key=lambda r: (r["value"], r["place"]))["place"]
    return Discriminant(means, factors, model.bias, TEMPERATURES[best])


def score(stats: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_hash, score, predicted`` for every row of statistics; without a model every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(s),
                 pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "text_hash", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, text_hash long, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
          fold: int | None = 5) -> tuple[DataFrame, Discriminant | None]:
    """Fit on ``labels`` (doc_id, quality) and score all of ``docs``: ``doc_id, text_hash, score, predicted``, and the
    model.

    With ``fold``, rows whose crc32(doc_id as text) is divisible by it are held out of the fit. Only the text
    enters a score. Null texts score as empty ones; labels other than 0 and 1 and labels without a document are
    not used; if a label is missing altogether every score is 0.5.
    """
    stats = staged(document_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("label"))
    if fold:
        known = known.filter(~held_out(F.col("_id"), fold, 0))
    model = fit(stats.join(known, F.col("doc_id") == F.col("_id")))
    return score(stats, model, threshold), model


def held_out(doc_id: Column, fold: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text has this remainder; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == remainder, F.lit(False))
