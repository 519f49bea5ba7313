"""Quality scores from random Fourier features of document statistics.

Statistics of whole texts are standardised and mapped to random cosines, which approximate a Gaussian kernel. Each
partition sums its part of the normal equations; one ridge solution of fixed size follows. Isotonic regression of the
labels on leave-one-out scores turns scores into shares of good documents.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portage.llm import words as W
from portage.llm.scratch import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 128
RIDGE = 1e-3
#: Raw scores are counted in steps of this size for the calibration, so that its input is bounded.
STEP = 1 / 2048
#: Share of the raw score in the final one; it keeps the order where the calibrated curve is flat.
ORDER_SHARE = 1e-3
_CLIP = 4.0

STATISTICS = (
    "log_bytes", "upper", "lower", "digit", "blank", "line_end", "stop", "mark", "symbol", "bar", "exclaim", "beyond_ascii",
    "entropy", "log_words", "word_mean", "word_deviation", "short_words", "long_words", "distinct_words", "top_word",
    "words_per_line", "repeated_lines", "repeated_windows",
)


def _byte_class(characters: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(characters.encode())] = 1
    return out


_CLASSES = np.stack([
    _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _byte_class("abcdefghijklmnopqrstuvwxyz"), _byte_class("0123456789"),
    _byte_class(" \t\r\v\f"), _byte_class("\n"), _byte_class(".,;:?"), _byte_class("\"'()[]{}/\\-_=+~^`@"),
    _byte_class("#*$%&<>"), _byte_class("|"), _byte_class("!"), (np.arange(256) > 127).astype(float),
], axis=1)


def statistics_of(texts: list[bytes | None]) -> np.ndarray:
    """The statistics of each text, one row each; all shares of an empty text are 0."""
    w = W.Words(texts)
    hashes = w.hashes()
    windows = W.window_hashes(hashes, 5)
    sizes = w.ends - w.starts
    out = np.zeros((len(texts), len(STATISTICS)))
    for t, (text, a, b) in enumerate(zip(texts, w.first[:-1].tolist(), w.first[1:].tolist())):
        if not text:
            continue
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        shares = counts / len(text)
        present = shares[shares > 0]
        row = [np.log1p(len(text)), *(shares @ _CLASSES), -float(present @ np.log2(present)), np.log1p(b - a)]
        if b > a:
            size = sizes[a:b]
            _, uses = np.unique(hashes[a:b], return_counts=True)
            lines = [line for line in text.split(b"\n") if line.strip()]
            some = windows[a:b - 4] if b - a >= 5 else windows[:0]
            row += [
                size.mean(), size.std(), (size <= 3).mean(), (size >= 15).mean(), len(uses) / (b - a),
                uses.max() / (b - a), np.log1p((b - a) / len(lines)), 1 - len(set(lines)) / len(lines),
                1 - len(np.unique(some)) / len(some) if len(some) else 0.0,
            ]
        out[t, :len(row)] = row
    return out


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in W.chunks(batches):
        values = statistics_of(texts)
        offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=["doc_id", "stats"]
        )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text, as a stored table; a null text counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, stats array<double>"), "statistics")


@dataclass(frozen=True)
class KernelMap:
    """Standardisation and random cosines; the last feature is constant."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -_CLIP, _CLIP)
        z = np.sqrt(2 / self.directions.shape[1]) * np.cos(x @ self.directions + self.phases)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


@dataclass(frozen=True)
class QualityModel:
    kernel: KernelMap
    weights: np.ndarray
    curve_x: np.ndarray
    curve_y: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.kernel(stats) @ self.weights
        calibrated = np.interp(raw, self.curve_x, self.curve_y)
        return (1 - ORDER_SHARE) * calibrated + ORDER_SHARE * np.clip((raw + 1) / 3, 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1)


def sum_normal_equations(batches: Iterator[pa.RecordBatch], kernel: KernelMap) -> Iterator[pa.RecordBatch]:
    """This partition's part of the upper triangle of Z'Z, with Z'y as its last column."""
    total = None
    for batch in batches:
        if batch.num_rows:
            z = kernel(_matrix(batch))
            part = z.T @ np.column_stack([z, batch.column("quality").to_numpy()])
            total = part if total is None else total + part
    if total is not None:
        rows, columns = np.nonzero(np.triu(np.ones(total.shape, bool)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows * total.shape[1] + columns, pa.int32()), pa.array(total[rows, columns])], names=["cell", "value"]
        )


def leave_one_out(batches: Iterator[pa.RecordBatch], kernel: KernelMap, weights, inverse) -> Iterator[pa.RecordBatch]:
    """Each labelled row's score by a model fitted without it, in steps."""
    for batch in batches:
        z, y = kernel(_matrix(batch)), batch.column("quality").to_numpy().astype(float)
        leverage = np.minimum(np.einsum("ij,jk,ik->i", z, inverse, z, optimize=True), 0.999)
        raw = (z @ weights - leverage * y) / (1 - leverage)
        steps = np.round(np.clip(raw, -1, 2) / STEP).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(y)], names=["step", "quality"])


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix of a few hundred rows, by elimination."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], axis=1)
    for i in range(n):
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0
        both -= factors[:, None] * both[i]
    return both[:, n:]


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Nondecreasing values with least weighted squared distance from ``values``, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, weight in zip(values.tolist(), weights.tolist()):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, k = blocks.pop()
            u, m, j = blocks[-1]
            blocks[-1] = [(u * m + v * n) / (m + n), m + n, j + k]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def calibration_curve(steps: np.ndarray, counts: np.ndarray, goods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and share of good rows of each block of the isotonic fit; scores between are interpolated."""
    fitted = isotonic(goods / counts, counts)
    x, y = [], []
    for value in np.unique(fitted):
        own = fitted == value
        n = counts[own].sum()
        x.append(float((steps[own] * counts[own]).sum() / n) * STEP)
        y.append(float((goods[own].sum() + goods.sum() / counts.sum()) / (n + 1)))
    return np.array(x), np.maximum.accumulate(np.array(y))


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = 7) -> QualityModel | None:
    """Model of ``quality`` (0 or 1) from ``stats``; None without rows.

    What comes to the driver has a size set by ``features`` and the number of steps, whatever the number of rows.
    """
    d = len(STATISTICS)
    moments = labelled.agg(F.count("*"), *(f(F.col("stats")[i]) for i in range(d) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        return None
    mean, deviation = np.array(moments[1::2], float), np.array(moments[2::2], float)
    random = np.random.default_rng(seed)
    kernel = KernelMap(
        mean, np.where(deviation > 1e-9, deviation, 1.0), random.normal(size=(d, features)) / np.sqrt(d),
        random.uniform(0, 2 * np.pi, features),
    )
    cells = labelled.mapInArrow(lambda batches: sum_normal_equations(batches, kernel), "cell int, value double")
    cells = cells.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((features + 1, features + 2))
    total.ravel()[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
    gram = total[:, :-1]
    gram = gram + np.triu(gram, 1).T + ridge * moments[0] * np.eye(features + 1) / features
    inverse = inverse_of(gram)
    weights = (inverse * total[:, -1]).sum(axis=1)
    steps = labelled.mapInArrow(lambda b: leave_one_out(b, kernel, weights, inverse), "step long, quality double")
    steps = steps.groupBy("step").agg(F.count("*").alias("n"), F.sum("quality").alias("good")).orderBy("step").toArrow()
    x, y = calibration_curve(*(steps.column(name).to_numpy().astype(float) for name in ("step", "n", "good")))
    return QualityModel(kernel, weights, x, y)


def apply_model(batches: Iterator[pa.RecordBatch], model: QualityModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = model.score(_matrix(batch)) if model else np.full(batch.num_rows, 0.5)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def remainder(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 3; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    The model learns from labelled documents whose ``remainder`` is not 1. Of repeated labels of a doc_id the largest
    counts; labels that are null or of unknown documents don't. Repeated rows are scored each; without any label every
    score is 0.5. Other columns of the documents are not read.
    """
    stats = document_statistics(docs)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(remainder(F.col("doc_id")) != 1)
    known = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    labelled = stored(stats.join(known, "doc_id").select("stats", "quality"), "labelled")
    model = fit(labelled)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(lambda batches: apply_model(batches, model), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
