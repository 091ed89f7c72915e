"""Phrase collocation mining: runs of two to four words that occur together more often than their parts suggest.

Candidates grow level by level: a run can only be frequent if both of its parts without the last and without the first
word are (Apriori). Each level's frequent runs stand in a bit filter of fixed size, which may let a rare run through but
never loses one. The candidates go into double-array tries of a bounded number of phrases, broadcast one after the
other; tasks walk all positions of a block of text through a trie at once, bincount the states that accept, and the
blocks' counts are summed. Only those counts are reported.

Words are told apart by 64-bit symbols of language and word; that no two words share one is checked over all words,
and another seed is taken if they do. Texts are read whole; a piece or document never runs on into the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.text import U64, mix, raw_bytes, release, span_hashes
from freshet.llm.tries import Trie
from freshet.shared import drop, keep

#: Bytes of text that a task takes at a time.
BLOCK = 1 << 20
#: Phrases of a trie: what is broadcast, and built on the driver, holds at most so many.
TRIE = 250_000
#: Counts of neighbouring phrases that are summed as one row.
PACK = 32
#: Bits of a level's filter, 16 MB at every size of the corpus, and bits set by one run.
FILTER, PROBES = 1 << 27, 3
#: Languages that fill blocks of their own in a task; texts of more begin blocks anew.
OPEN = 64

_END = re.compile(r"[.,;:!?\x0A-\x0D]")
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _STOP.copy()
_GAP[[0x20, 0x09]] = True
_STEP = U64(0x9E3779B97F4A7C15)


@contextmanager
def _batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of about so many bytes while tables are written."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _joined(symbols: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key of runs whose k-th symbols stand in the k-th array."""
    with np.errstate(over="ignore"):
        out = symbols[0]
        for s in symbols[1:]:
            out = mix(out * _STEP + s)
    return out


def _bits(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the keys' bits in a filter."""
    for _ in range(PROBES):
        with np.errstate(over="ignore"):
            keys = mix(keys + _STEP)
        yield (keys & U64(FILTER - 1)).astype(np.int64)


def _held(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _bits(keys):
        found &= (bits[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1
    return found


def _filter(rows: DataFrame, width: int) -> np.ndarray:
    """Bits of the runs in s1..s<width>, or-ed together in Spark; at most FILTER / 64 rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _joined([_symbols(b.column(i)) for i in range(width)])
            at = np.concatenate([np.zeros(0, np.int64), *_bits(keys)])
            bit = (U64(1) << (at & 63).astype(U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(bit)], ["cell", "bit"])

    cells = rows.select(*[f"s{i + 1}" for i in range(width)]).mapInArrow(run, "cell int, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(FILTER >> 6, U64)
    bits[cells.column("cell").to_numpy()] = cells.column("bit").to_numpy().view(U64)
    return bits


def _symbols(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(U64)


def _words(texts: list[str], lang: str, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, symbols of the words, whether a piece begins with the word) of some texts of one language."""
    raw = raw_bytes("\n".join(texts), lower=True)
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_GAP[raw]
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
    begins = np.ones(len(starts), bool)
    begins[1:] = stops[starts[1:]] != stops[ends[:-1]]
    name = np.frombuffer(f"{seed} {lang}".encode("utf-8", "surrogatepass"), np.uint8)
    with np.errstate(over="ignore"):
        symbols = mix(span_hashes(raw, starts, ends) + span_hashes(name, np.array([0]), np.array([len(name)])))
    return raw, starts, ends, np.where(symbols == 0, U64(1), symbols), begins


def _slices(text: str) -> Iterator[str]:
    """A text in parts of about BLOCK characters that end where a piece ends."""
    at = 0
    while len(text) - at > BLOCK:
        end = _END.search(text, at + BLOCK)
        if not end:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language, about BLOCK characters at a time."""
    held: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in ((x, part) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for part in _slices(y)):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= BLOCK:
                yield lang, held.pop(lang)
                del size[lang]
            elif len(held) > OPEN:
                lang = max(size, key=size.get)
                yield lang, held.pop(lang)
                del size[lang]
    yield from held.items()


def _counter(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _blocks(batches):
            raw, starts, ends, symbols, _ = _words(texts, lang, seed)
            own, first, times = np.unique(symbols, return_index=True, return_counts=True)
            order = np.argsort(first)  # spans of one buffer must ascend
            own, first, times = own[order], first[order], times[order]
            both = np.stack([starts[first], ends[first]], 1).ravel()
            offsets = np.concatenate([both, both[-1:]]).astype(np.int32)
            spans = pa.BinaryArray.from_buffers(pa.binary(), len(both), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
            words = spans.take(pa.array(np.arange(0, len(both), 2))).cast(pa.string())
            for at in range(0, len(own), 50_000):
                part = slice(at, at + 50_000)
                n = len(own[part])
                yield pa.RecordBatch.from_arrays([pa.array(own[part].view(np.int64)), pa.array([lang] * n, pa.string()), words[part], pa.array(times[part])], ["s1", "lang", "word", "times"])
        release()

    return run


def _packer(shared, seed: int):
    """Texts as blocks: the distinct frequent words' symbols, and for every word its place among them; -1 for a rare
    word and between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _blocks(batches):
            _, _, _, symbols, begins = _words(texts, lang, seed)
            own, place = np.unique(symbols, return_inverse=True)
            known = _held(own, shared.value)
            number = np.where(known, np.cumsum(known) - 1, -1).astype(np.int32)
            codes = np.full(len(symbols) + int(begins.sum()), -1, np.int32)
            codes[np.arange(len(symbols)) + np.cumsum(begins)] = number[place]
            yield pa.RecordBatch.from_arrays([pa.array([own[known].tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], ["symbols", "codes"])
        release()

    return run


def _grower(width: int, shared):
    """Runs of so many words whose parts of one word less are in the filter, with their times in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for symbols, codes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own, c = np.frombuffer(symbols, U64), np.frombuffer(codes, np.int32).astype(np.int64)
                runs = c
                for level in range(2, width + 1):
                    ok = (runs[:-1] >= 0) & (runs[1:] >= 0 if level == width else c[level - 1 :] >= 0)
                    at = np.flatnonzero(ok)
                    _, first, place, times = np.unique(runs[at] * len(own) + c[at + level - 1], return_index=True, return_inverse=True, return_counts=True)
                    found = [own[c[at[first] + j]] for j in range(level)]
                    number = np.arange(len(first))
                    if level == width - 1:
                        number[~_held(_joined(found), shared.value)] = -1
                    runs = np.full(max(0, len(runs) - 1), -1, np.int64)
                    runs[at] = number[place]
                for lo in range(0, len(times), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000].view(np.int64)) for x in (*found, times)], [*(f"s{j + 1}" for j in range(width)), "times"])
        release()

    return run


def _walker(shared):
    """Times of a trie's phrases in the blocks of a task, PACK numbers to a row; rows of zeros are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, _ = shared.value
        times = np.zeros(-(-trie.size // PACK) * PACK, np.int64)
        for b in batches:
            for symbols, codes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                number = np.append(trie.codes(np.frombuffer(symbols, U64)), np.int32(-1))
                times[: trie.size] += trie.count(number[np.frombuffer(codes, np.int32)])
        packs = times.reshape(-1, PACK)
        seen = np.flatnonzero(packs.any(1))
        for lo in range(0, len(seen), 4000):
            at = seen[lo : lo + 4000]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(packs[at].ravel()), PACK).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), lists], ["pack", "times"])
        release()

    return run


def _named(shared):
    """Summed packs -> the phrases and their times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, phrases = shared.value
        for b in batches:
            number = (b.column("pack").to_numpy().astype(np.int64)[:, None] * PACK + np.arange(PACK)).ravel()
            times = b.column("times").flatten().to_numpy()
            number, times = number[times > 0], times[times > 0]
            yield pa.RecordBatch.from_arrays([*(pa.array(phrases[number, j].view(np.int64)) for j in range(phrases.shape[1])), pa.array(times)], [*(f"s{j + 1}" for j in range(phrases.shape[1])), "times"])

    return run


def _schema(width: int) -> str:
    return ", ".join(f"s{j + 1} long" for j in range(width)) + ", times long"


def word_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """(s1, lang, word, times) of all words of texts(lang, text), and the seed under which no two share a symbol."""
    for seed in range(8):
        with _batches(texts.sparkSession):
            words = keep(texts.mapInArrow(_counter(seed), "s1 long, lang string, word string, times long").groupBy("s1", "lang", "word").agg(F.sum("times").alias("times")), "words")
        if words.groupBy("s1").count().where("count > 1").isEmpty():
            return words, seed
        drop(words)
    raise RuntimeError("words share symbols under every seed")


def _counted(blocks: DataFrame, candidates: DataFrame, longest: int) -> list[DataFrame]:
    """Times of the candidates, by one trie after the other."""
    spark, names = blocks.sparkSession, [f"s{j + 1}" for j in range(longest)]
    parts = -(-candidates.count() // TRIE)
    out = []
    for part in range(parts):
        rows = candidates.where(F.pmod(F.xxhash64("s1", "s2"), F.lit(parts)) == part).select(*names).toArrow()
        if not len(rows):
            continue
        phrases = np.stack([rows.column(c).to_numpy().view(U64) for c in names], 1)
        shared = spark.sparkContext.broadcast((Trie.of(phrases), phrases))
        with _batches(spark):
            packs = blocks.mapInArrow(_walker(shared), "pack int, times array<long>")
            summed = packs.groupBy("pack").agg(*[F.sum(F.get("times", F.lit(i))).alias(f"t{i}") for i in range(PACK)])
            summed = summed.select("pack", F.array(*[f"t{i}" for i in range(PACK)]).alias("times"))
            out.append(keep(summed.mapInArrow(_named(shared), _schema(longest)).withColumnRenamed("times", "a"), "phrases"))
        shared.destroy()
    return out


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, first: int = 2000, covered: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the phrases that score highest.

    Words are lower-cased (A-Z) and split at spaces and tabs within pieces, which end at . , ; : ! ? and line ends.
    Phrases of 2 to longest words that occur at least so often (a, overlaps included) are candidates. A cut after the
    first words gives l and r, the times of both parts, and floor(2000000 a / (l + r)); the lowest cut counts, of equal
    ones the first. Candidates inside a longer candidate that has covered per cent of their times or more are dropped. n
    counts the words of the language. Order: score, a, then phrase by its bytes.

    Null language: "und", together with one of that name. Null and empty texts have no words. Null ids do not matter,
    repeated rows count again. Empty table: no rows. Only the two columns named are read, so others cannot clash.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    words, seed = word_counts(texts)
    frequent = words.where(F.col("times") >= least)
    shared = spark.sparkContext.broadcast(_filter(frequent, 1))
    with _batches(spark):
        blocks = keep(texts.mapInArrow(_packer(shared, seed), "symbols binary, codes binary"), "blocks")
    levels = []
    for width in range(2, longest + 1):
        names = [f"s{j + 1}" for j in range(width)]
        if width > 2:
            shared = spark.sparkContext.broadcast(_filter(levels[-1], width - 1))
        with _batches(spark):
            # dealt by run before it is grouped: a block's runs differ already, so maps of a task's runs would take much
            # memory to merge little
            runs = blocks.mapInArrow(_grower(width, shared), _schema(width)).repartition(*names)
            level = runs.groupBy(*names).agg(F.sum("times").alias("times")).where(F.col("times") >= least)
            levels.append(keep(level.select(*names, *[F.lit(0).cast("long").alias(f"s{j + 1}") for j in range(width, longest)]), "level"))
        shared.destroy()
    candidates = levels[0]
    for level in levels[1:]:
        candidates = candidates.unionByName(level)
    counted = _counted(blocks, candidates, longest)
    for table in (blocks, *levels):
        drop(table)
    found = spark.createDataFrame([], _schema(longest).replace("times", "a"))
    for part in counted:
        found = found.unionByName(part)
    w = F.filter(F.array(*[f"s{j + 1}" for j in range(longest)]), lambda s: s != 0)
    found = found.where(F.col("a") >= least).select(w.alias("w"), "a")
    n = words.groupBy("lang").agg(F.sum("times").alias("n"))
    best = _scored(found, frequent).join(_outer(found, covered), "w", "left_anti")
    leading = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = best.withColumn("near", F.rank().over(leading)).where(F.col("near") <= first).drop("near")
    spelled = best.select("*", F.posexplode("w").alias("at", "s1")).join(frequent.select("s1", "word"), "s1").groupBy("w").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = best.join(spelled.select("w", F.array_join("words.word", " ").alias("phrase")), "w").join(n, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """(w, a, lang, l, r, score) by the lowest cut. Parts of a candidate are candidates or frequent words themselves."""
    parts = found.select("w", F.col("a").alias("f"), F.lit(None).cast("string").alias("lang")).unionByName(frequent.select(F.array("s1").alias("w"), F.col("times").alias("f"), "lang"))
    cuts = found.select("w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("w", F.lit(1), F.col("k")).alias("head"), F.expr("slice(w, k + 1, size(w) - k)").alias("tail"))
    cuts = cuts.join(parts.select(F.col("w").alias("head"), F.col("f").alias("l"), "lang"), "head").join(parts.select(F.col("w").alias("tail"), F.col("f").alias("r")), "tail")
    score = F.expr("(cast(a as decimal(20)) * 2000000bd) div (cast(l as decimal(20)) + cast(r as decimal(20)))")
    best = cuts.withColumn("score", score).groupBy("w", "a").agg(F.max("lang").alias("lang"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("w", "a", "lang", "best.l", "best.r", "best.score")


def _outer(found: DataFrame, covered: int) -> DataFrame:
    """w of the candidates that a longer one covers."""
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))))")
    longer = found.where(F.size("w") > 2).select("a", F.explode(inner).alias("w")).groupBy("w").agg(F.max("a").alias("most"))
    return found.join(longer, "w").where(F.expr(f"100bd * cast(most as decimal(20)) >= {covered}bd * cast(a as decimal(20))")).select("w")
