"""Language identification by language-bitmask n-gram filters.

For each language the character n-grams typical of it are put into one bit-sliced Bloom filter: an array of
cells in which bit l of a cell belongs to language l. The AND of an n-gram's cells is the bitmask of all
languages that hold it. A document's n-grams are looked up, the hits are counted per language (popcounts),
corrected for the false positives expected from that language's fill, and the highest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.text import U64, mix, release, unused
from freshet.shared import small_batches

#: Languages per 64-bit word of a cell; the sign bit is left free.
WORD = 63


@dataclass(frozen=True)
class Settings:
    """sizes: n-gram lengths in code points. sample_per_lang: documents of each language that the model is
    fitted on, at most about so many, drawn by a hash of the id (whole texts). least_rate: smallest share of a
    language's n-grams an n-gram must have to be typical of it; least_ratio: smallest part of its highest share
    in any language. cells: size of the filter (a power of two); hashes: cells an n-gram sets."""

    sizes: tuple[int, ...] = (2, 3, 4)
    sample_per_lang: int = 1500
    least_rate: float = 2e-6
    least_ratio: float = 0.2
    cells: int = 1 << 21
    hashes: int = 3


@dataclass
class Model:
    """cells: words x cells, or the cells of the only word; bit l % WORD of word l // WORD belongs to language l."""

    langs: list[str]
    cells: np.ndarray
    settings: Settings = field(default_factory=Settings)
    false_rate: np.ndarray | None = None


def _codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters than letters as one space."""
    low = (text or "").lower()
    cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters(cp)
    cp = np.where(letter, cp, 32)
    cp = np.concatenate([np.array([32], np.uint32), cp, np.array([32], np.uint32)])
    space = cp == 32
    return cp[~(space & np.concatenate([np.zeros(1, bool), space[:-1]]))]


_table = np.zeros(0, bool)


def _letters(cp: np.ndarray) -> np.ndarray:
    global _table
    if not len(_table):
        _table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _table[cp]


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def ngrams(text: str | None, sizes: tuple[int, ...]) -> np.ndarray:
    """64-bit hashes of the n-grams that hold a letter, repeats kept."""
    cp = _codes(text).astype(U64)
    out = []
    with np.errstate(over="ignore"):
        for n in sizes:
            if len(cp) < n:
                continue
            m = len(cp) - n + 1
            h = np.full(m, n, U64)
            for j in range(n):
                h = h * U64(0x9E3779B97F4A7C15) + cp[j : j + m] + U64(1)
            out.append(h)
    return mix(np.concatenate(out)) if out else np.zeros(0, U64)


def _slots(h: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Double hashing: cell of each of the filter's hash functions."""
    a, b = h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)
    with np.errstate(over="ignore"):
        return [((a + U64(i) * b) & U64(s.cells - 1)).astype(np.int64) for i in range(s.hashes)]


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on labelled documents. Counts run in Spark; the driver gets the filter's non-zero cells, whose number
    is fixed by settings.cells, never the n-grams. Rows with a null text or language are not used. All languages are
    learned: every 63 of them take one more word per cell (16 MB at 2^21 cells)."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    langs = sorted(r["lang"] for r in counts)
    spark = docs.sparkSession
    if not langs:
        return Model([], np.zeros((1, settings.cells), np.int64), settings, np.zeros(0))
    share = spark.createDataFrame([(r["lang"], langs.index(r["lang"]), min(1.0, settings.sample_per_lang / r["count"])) for r in counts], "lang string, l int, share double")
    drawn = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    sample = rows.join(F.broadcast(share), "lang").where(drawn).select("l", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch, the number of each n-gram of each language."""
        for batch in batches:
            by: dict[int, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text, settings.sizes))
            for lang, parts in by.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), lang, np.int32)), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["l", "g", "n"])

    grams = sample.mapInArrow(count, "l int, g long, n long").groupBy("g", "l").agg(F.sum("n").alias("n"))
    totals = {r["l"]: r["n"] for r in grams.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    total = F.element_at(F.array(*[F.lit(float(totals.get(i, 1))) for i in range(len(langs))]), F.col("l") + 1)
    masks = [f"mask{w}" for w in range(-(-len(langs) // WORD))]
    typical = (
        grams.withColumn("rate", F.col("n") / total).groupBy("g").agg(F.collect_list(F.struct("l", "rate")).alias("in"))
        .withColumn("top", F.array_max(F.transform("in", lambda x: x["rate"])))
        .select("g", *[F.expr(f"aggregate(filter(in, x -> x.l div {WORD} = {w} and x.rate >= {settings.least_rate!r} and x.rate >= {settings.least_ratio!r} * top), 0L, (m, x) -> m | shiftleft(1L, x.l % {WORD}))").alias(m) for w, m in enumerate(masks)])
        .where(" or ".join(f"{m} <> 0" for m in masks))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.concatenate(_slots(batch.column(0).to_numpy().view(U64), settings))
            yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(np.tile(batch.column(w + 1).to_numpy(), settings.hashes)) for w in range(len(masks)))], ["cell", *masks])

    filled = typical.mapInArrow(place, ", ".join(["cell long", *(f"{m} long" for m in masks)])).groupBy("cell").agg(*[F.bit_or(m).alias(m) for m in masks]).toArrow()
    cells = np.zeros((len(masks), settings.cells), np.int64)
    for w, m in enumerate(masks):
        cells[w, filled["cell"].to_numpy()] = filled[m].to_numpy()
    fill = np.array([np.count_nonzero((cells[i // WORD] >> (i % WORD)) & 1) for i in range(len(langs))]) / settings.cells
    if len(langs) <= 8:
        cells = cells.astype(np.uint8)
    return Model(langs, cells, settings, fill**settings.hashes)


def judge(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[float]]:
    """(language, score, hit rate) of each text. score: the winner's part of all corrected hits; hit rate: the
    part of the text's n-grams that the winner holds."""
    out: list[tuple[str, float, float]] = []
    cells = np.atleast_2d(model.cells)
    for text in texts:
        if not model.langs or not has_letter(text):
            out.append(("und", 0.0, 0.0))
            continue
        h = ngrams(text, model.settings.sizes)
        first, *others = _slots(h, model.settings)
        mask = cells[:, first]
        for s in others:
            mask = mask & cells[:, s]
        hits = np.array([np.count_nonzero(mask[i // WORD] & (1 << i % WORD)) for i in range(len(model.langs))], float)
        fixed = np.maximum(0, (hits - len(h) * model.false_rate) / (1 - model.false_rate))
        best = int(np.argmax(fixed))
        whole = fixed.sum()
        out.append((model.langs[best], float(fixed[best] / whole) if whole else 0.0, float(min(1.0, fixed[best] / max(1, len(h))))))
    langs, scores, rates = zip(*out, strict=True) if out else ([], [], [])
    return list(langs), list(scores), list(rates)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language, or 'und'), lang_score (0 to 1) and lang_hits (0 to 1).

    - Null text, or a text without a letter: 'und', 0, 0. So is every text if nothing could be learned.
    - Ties: the language that comes first by code point. A text none of whose n-grams is known: that one, score 0.
    - Long texts are scored whole. Columns of docs called lang_pred, lang_score or lang_hits are replaced.
    The filter that tasks receive has settings.cells cells of one word per 63 languages.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.cells, model.settings, model.false_rate))

    @F.pandas_udf("lang string, score double, hits double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for texts in batches:
            langs, scores, rates = judge(texts.tolist(), own)
            yield pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float), "hits": pd.Series(rates, dtype=float)})
        release()

    kept = docs.drop("lang_pred", "lang_score", "lang_hits")
    judged = unused(docs.columns, "judged")
    got = kept.withColumn(judged, run(F.col(text_col)))
    return got.select(*kept.columns, F.col(f"{judged}.lang").alias("lang_pred"), F.col(f"{judged}.score").alias("lang_score"), F.col(f"{judged}.hits").alias("lang_hits"))
