"""Quality scores from a factorisation machine over hashed words, structure statistics and text metadata.

y = b + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): the pairwise interactions of all features
in time linear in their number. Probabilities are 1 / (1 + exp(-y)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.text import U64, raw_bytes, release, span_hashes, spans
from freshet.shared import small_batches


@dataclass(frozen=True)
class Settings:
    """words: buckets for hashed words (a power of two). rank: of the interactions. sample: labelled rows that
    the model is fitted on, at most about so many (whole texts, drawn by a hash of the id). The rest steers the
    optimiser."""

    words: int = 2048
    rank: int = 6
    sample: int = 6000
    epochs: int = 14
    rate: float = 0.02
    decay: float = 1e-4
    batch: int = 256


#: Structure statistics and metadata, in order; all are derived from the text alone.
STATISTICS = (
    "log_words", "log_bytes", "mean_word", "digits", "upper", "punctuation", "marks", "bars", "non_ascii", "distinct_words",
    "log_lines", "repeated_lines", "line_length", "upper_words", "words_with_mark", "end_marks",
)

_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 3
_CLASS[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 126, 91, 93, 123, 125]] = 4
_CLASS[124] = 5
_CLASS[128:] = 6


def features(text: str | None, s: Settings) -> np.ndarray:
    """Dense feature row: word buckets (log counts, unit length), then the statistics."""
    raw = raw_bytes(text)
    low = raw_bytes(text, lower=True)
    starts, ends = spans(raw)
    h = span_hashes(low, starts, ends)
    n, size = len(h), max(1, len(raw))
    words = np.log1p(np.bincount((h & U64(s.words - 1)).astype(np.int64), minlength=s.words).astype(np.float32))
    words /= max(1e-6, float(np.sqrt((words * words).sum())))
    kinds = np.bincount(_CLASS[raw], minlength=7) / size
    breaks = np.flatnonzero(raw == 10)
    line_start = np.concatenate([np.zeros(1, np.int64), breaks + 1])
    line_end = np.concatenate([breaks, np.array([len(raw)], np.int64)])
    lines = len(line_start)
    same = 1 - len(np.unique(span_hashes(low, line_start, line_end))) / lines if len(raw) else 0.0
    kind = _CLASS[raw]
    upper_words = float((kind[ends - 1] == 2).mean()) if n else 0.0
    last = kind[ends - 1] if n else np.zeros(0)
    held = np.array([
        np.log1p(n) / 10, np.log1p(len(raw)) / 12, (float((ends - starts).mean()) if n else 0.0) / 10, *(kinds[1:] * np.array([1, 1, 4, 8, 8, 1])),
        len(np.unique(h)) / n if n else 0.0, np.log1p(lines) / 6, same, min(4.0, size / lines / 400), upper_words,
        float(((last == 4) | (last == 5)).mean()) if n else 0.0, float((last == 3).mean()) if n else 0.0,
    ], np.float32)
    return np.concatenate([words, held])


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    settings: Settings


def raw_scores(x: np.ndarray, m: Model) -> np.ndarray:
    """The sum-of-squares identity, for a block of rows."""
    inner = x @ m.factors
    return m.bias + x @ m.linear + 0.5 * (inner * inner - (x * x) @ (m.factors * m.factors)).sum(axis=1)


def fit(rows: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> Model:
    """Fit on labelled rows; those without text count as empty text, those without a label are not used.

    A bounded sample (settings.sample) is drawn by hash; its features are made in Spark tasks and only they come
    to the driver, so neither size depends on the table. Order of rows does not matter: they are sorted by id.
    Without labelled rows every score is 0.5.
    """
    known = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    n = known.count()
    share = min(1.0, settings.sample / max(1, n))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1_000_000)) < share * 1_000_000)

    @F.pandas_udf("binary")
    def make(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([features(t, settings).astype(np.float16).tobytes() for t in part], dtype=object)

    got = drawn.select("id", "y", make("text").alias("x")).toArrow().to_pydict()
    order = sorted(range(len(got["id"])), key=lambda i: (got["id"][i], got["y"][i], got["x"][i]))
    width = settings.words + len(STATISTICS)
    x = np.stack([np.frombuffer(got["x"][i], np.float16) for i in order]).astype(np.float32) if order else np.zeros((0, width), np.float32)
    return _descend(x, np.array([got["y"][i] for i in order], np.float32), settings)


def _descend(x: np.ndarray, y: np.ndarray, s: Settings) -> Model:
    """Adam on the log loss; both classes weigh the same in half of the loss, so that rare rejects are learned."""
    draw = np.random.default_rng(7)
    width = s.words + len(STATISTICS)
    part = [np.zeros(1, np.float32), np.zeros(width, np.float32), draw.normal(0, 0.02, (width, s.rank)).astype(np.float32)]
    first, second, step = [np.zeros_like(p) for p in part], [np.zeros_like(p) for p in part], 0
    if not len(y):
        return Model(0.0, part[1], np.zeros_like(part[2]), s)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    part[0][0] = np.log(share / (1 - share))
    weight = np.where(y == 1, 0.5 + 0.25 / share, 0.5 + 0.25 / (1 - share)).astype(np.float32)
    for _ in range(s.epochs):
        order = draw.permutation(len(y))
        for at in range(0, len(y), s.batch):
            i = order[at : at + s.batch]
            b = x[i]
            inner = b @ part[2]
            z = part[0][0] + b @ part[1] + 0.5 * (inner * inner - (b * b) @ (part[2] * part[2])).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(i)
            grad = [np.array([g.sum()], np.float32), b.T @ g + s.decay * part[1], b.T @ (g[:, None] * inner) - ((b * b).T @ g)[:, None] * part[2] + s.decay * part[2]]
            step += 1
            for k in range(3):
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                part[k] -= s.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return Model(float(part[0][0]), part[1], part[2], s)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1). Null and empty texts score like a text without words; long texts are
    scored whole; a column called quality_score is replaced. Tasks get the model, whose size settings fix."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors, model.settings))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts in batches:
            got = np.zeros(len(texts))
            for at in range(0, len(texts), 128):
                block = np.stack([features(t, own.settings) for t in texts.iloc[at : at + 128]])
                got[at : at + 128] = 1 / (1 + np.exp(-np.clip(raw_scores(block, own), -30, 30)))
            yield pd.Series(got)
        release()

    return docs.drop("quality_score").withColumn("quality_score", run(F.col(text_col)))
