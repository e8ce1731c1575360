"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled texts in parallel (SAMPLE_PER_LANG documents of each language in
expectation, chosen by a hash of the id and the text); the matrix of log probabilities is broadcast, and batches of whole texts are
scored in numpy by gathering matrix rows and summing them by document. Probabilities are kept as integers, so a text's
score doesn't depend on how texts are batched.

Defined cases: text that is null or has no letter is ``und`` with score 0; rows whose lang is null or whose text has no
letter teach nothing; without any labelled text every document is ``und``; more than MAX_LANGS languages raise (the
matrix would have no size bound); clashing column names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialmill.runtime import bound_batches, tidy, without

BITS, ORDERS, SAMPLE_PER_LANG, MAX_LANGS, WINDOW = 15, (1, 2, 3), 3000, 256, 1 << 16
FIXED = 1 << 16
#: Java's name for the code points that Python's str.isalpha() counts.
LETTER = r"\p{L}"
_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point its lower case letter, or 0 where it is no letter."""
    global _fold
    if _fold is None:
        t = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _fold = t
    return _fold


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with runs of other characters as one 0, each text led and ended by 0; text starts."""
    parts, starts, at = [], [], 0
    table = fold_table()
    for t in texts:
        codes = table[np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        parts.append(codes)
        starts.append(at)
        at += len(codes)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array([*starts, at], np.int64)


def grams(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of the n-grams, window by window; an n-gram lies within one text and isn't a lone 0."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for a in range(0, len(codes), WINDOW):
        part, own = codes[a : a + WINDOW + max(ORDERS) - 1].astype(np.uint64), owner[a : a + WINDOW + max(ORDERS) - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            m = min(WINDOW, len(part) - n + 1)
            if m <= 0:
                break
            h = (h[:m] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 : n - 1 + m] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            if n in ORDERS:
                ok = own[:m] == own[n - 1 : n - 1 + m]
                if n == 1:
                    ok &= part[:m] != 0
                yield own[:m][ok], ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))[ok].astype(np.int64)


class Model:
    """langs in order; weights: BITS x langs, FIXED-point log probabilities; prior likewise."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray) -> None:
        self.langs = langs
        p = (counts + 0.5) / (counts.sum(0) + 0.5 * counts.shape[0])
        self.weights = np.round(np.log(p) * FIXED).astype(np.int64)
        self.prior = np.round(np.log((docs + 1) / (docs + 1).sum()) * FIXED).astype(np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, starts = letters(texts)
        n, k = len(texts), len(self.langs)
        total = np.zeros((n, k), np.int64)
        any_letter = np.zeros(n, bool)
        for own, bucket in grams(codes, starts):
            if len(own):
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                total[own[first]] += np.add.reduceat(self.weights[bucket], first, axis=0)
                any_letter[own[first]] = True
        if not k:
            return ["und"] * n, np.zeros(n)
        logit = (total + self.prior) / FIXED
        best = logit.argmax(1)
        score = 1 / np.exp(logit - logit.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, any_letter, strict=True)], np.where(any_letter, np.round(score, 9), 0.0)


def held_out(id_col: Column) -> Column:
    """Whether the fold of the id, crc32 of its text mod 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learn from the rows given, a hash sample of about per_lang texts of each language."""
    bound_batches(docs.sparkSession)
    seen = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER))
    sizes = {r[0]: r[1] for r in seen.groupBy(lang_col).count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    spark = docs.sparkSession
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    # an Arrow table becomes rows in the JVM; a list would start a second set of Python workers in every executor
    shares = spark.createDataFrame(pa.table({"__lang": langs, "__k": pa.array(range(len(langs)), pa.int32()), "__share": [min(1.0, per_lang / sizes[v]) for v in langs]}))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 20)) / float(1 << 20)
    sample = seen.select(F.col(lang_col), F.col(text_col).alias("__text"), draw.alias("__u")).join(F.broadcast(shares), F.col(lang_col) == F.col("__lang")).filter("__u < __share").select("__k", "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = np.zeros((len(langs), 1 << BITS), np.int64), np.zeros(len(langs), np.int64)
        for batch in batches:
            k, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            codes, starts = letters(texts)
            n += np.bincount(k, minlength=len(langs))
            for own, bucket in grams(codes, starts):
                np.add.at(got, (k[own], bucket), 1) if len(langs) > 64 else got.__iadd__(np.bincount(k[own] * (1 << BITS) + bucket, minlength=got.size).reshape(got.shape))
        i, b = np.nonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array([*i, *range(len(langs))], pa.int32()), pa.array([*b, *[-1] * len(langs)], pa.int32()), pa.array([*got[i, b], *n], pa.int64())], ["k", "b", "n"])

    counts = sample.mapInArrow(tidy(count), "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most MAX_LANGS * (2 ** BITS + 1) rows
    k, b, n = (table.column(c).to_numpy() for c in ("k", "b", "n"))
    full, docs_of = np.zeros((1 << BITS, len(langs))), np.zeros(len(langs))
    full[b[b >= 0], k[b >= 0]] = n[b >= 0]
    docs_of[k[b < 0]] = n[b < 0]
    return Model(langs, full, docs_of)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or keep) with lang_pred and score."""
    kept = [c for c in without(docs, ["lang_pred", "score", "__t"]).columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, score = shared.value.predict(part.column("__t").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names[:-1], "lang_pred", "score"])

    bound_batches(docs.sparkSession)
    src = docs.select(*kept, F.col(text_col).alias("__t"))
    schema = T.StructType([*src.drop("__t").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(tidy(run), schema)
