"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; a binary n-gram classifier predicts each of its bits.
The classifiers are log-odds of hashed n-grams, whose counts are summed over all
labelled rows on the executors; the driver gets one vector of `BUCKETS` counts for
each language.  Decoding takes the codeword with the least loss, each bit weighed by
how well it does on a sample of labelled rows, and flags what is nearly a tie.

Defined results: texts that are null or have no letter are `und` with score 0; with
no labelled rows all are; with one language that one; repeated rows are judged each;
extra columns stay, those that clash with added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, field, in_arrow, lowered, mix

BUCKETS = 4096
#: Labelled rows at most that weigh the bits; the n-gram counts come from all labelled rows.
CALIBRATION_ROWS = 4096
UNKNOWN = "und"
#: n-grams at which a text's margins count half.
SHRINK = 50

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[97:123] = np.arange(97, 123, dtype=np.uint8)


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed counts (texts by BUCKETS) of runs of 2 to 4 bytes; all of ASCII but letters counts as blank."""
    n = len(offsets) - 1
    plain = _PLAIN[lowered(data)].astype(np.uint64)
    text = np.repeat(np.arange(n), np.diff(offsets))
    key, out = plain, np.zeros(n * BUCKETS, dtype=np.int64)
    for size in (2, 3, 4):
        if len(plain) < size:
            break
        key = key[:-1] * np.uint64(256) + plain[size - 1 :]
        same = text[: len(key)] == text[size - 1 :]
        bucket = (mix(key + np.uint64(size * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(52)).astype(np.int64)
        out += np.bincount((text[: len(key)] * BUCKETS + bucket)[same], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """Codewords in -1 and 1 (languages by bits): all splits of up to five languages, else the widest apart of random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1] + [1 if m >> i & 1 else -1 for i in range(n - 1)] for m in range(2 ** (n - 1) - 1)]
        return np.array(bits, dtype=float).T
    size, best, apart = max(15, math.ceil(10 * math.log2(n))), None, -1
    rng = np.random.default_rng(seed)
    for _ in range(50):
        words = rng.choice([-1.0, 1.0], (n, size))
        distance = (size - words @ words.T) / 2 + np.eye(n) * size
        mixed = (np.abs(words.sum(axis=0)) < n).all()
        if mixed and distance.min() > apart:
            best, apart = words, distance.min()
    return best


@dataclass(frozen=True)
class LanguageModel:
    """languages; code (languages by bits); weights (BUCKETS by bits); scale: a usual margin of each bit; trust: a bit's weight in decoding."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weights / np.maximum(counts.sum(axis=1, keepdims=True), 1)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score (0 to 1) and ambiguity of each text: least trust-weighted logistic loss to a codeword."""
        total = counts.sum(axis=1, keepdims=True)
        z = 4 * self.margins(counts) / self.scale * total / (total + SHRINK)  # few n-grams say little
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        likely = np.exp(loss.min(axis=1, keepdims=True) - loss)
        likely /= likely.sum(axis=1, keepdims=True)
        best = order[:, 0]
        top = likely[np.arange(len(best)), best]
        second = likely[np.arange(len(best)), order[:, 1]] if loss.shape[1] > 1 else np.zeros(len(best))
        return best, top, top - second < 0.2


def _language_counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """n-gram counts of each label over all of rows (text, lang)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), dtype=object)
            for lo, hi, data, offsets in chunks(batch.column(0)):
                counts = ngram_counts(data, offsets)
                # Whole texts, but no text weighs more than another by its length.
                shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
                for label in set(labels[lo:hi]):
                    total[label] = total.get(label, 0) + np.rint(1e6 * shares[labels[lo:hi] == label]).astype(np.int64).sum(axis=0)
        for label, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * BUCKETS), pa.array(np.arange(BUCKETS), pa.int32()), pa.array(counts)], names=["lang", "bucket", "n"])

    summed = in_arrow(rows.select("text", "lang"), work, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("v")).select("lang", "v.n").collect()
    return {r["lang"]: np.array(r["n"], dtype=np.float64) / 1e6 for r in packed}


def _calibration_sample(rows: DataFrame, limit: int) -> DataFrame:
    """limit of rows (id, text, lang) at most, those with the smallest hashes; copies of a text under other ids are drawn each for itself."""
    drawn = rows.withColumn("drawn", F.xxhash64("id", "text", "lang"))
    # About 2 * limit rows stay before the order, so that what it gathers doesn't grow with the rows.
    near = drawn.filter(F.pmod("drawn", F.lit(max(1, rows.count() // (2 * limit)))) == 0)
    least = [r["drawn"] for r in near.select("drawn").orderBy("drawn").limit(limit + 1).collect()]
    if len(least) <= limit:
        return near
    last = least[limit - 1]
    if least[limit] != last:
        return near.filter(F.col("drawn") <= last)
    # The last place falls among repeated rows of one id: as many of them as there is room for.
    return near.filter(F.col("drawn") < last).union(near.filter(F.col("drawn") == last).limit(least[:limit].count(last)))


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", calibration_rows: int = CALIBRATION_ROWS, id_col: str = "doc_id") -> LanguageModel:
    """The model of all rows with a label; calibration_rows bounds the sample that weighs the bits."""
    rows = labelled.select(field(id_col).alias("id"), field(text).alias("text"), field(lang).alias("lang")).filter("text is not null and lang is not null")
    counts = _language_counts(rows)
    languages = sorted(counts)
    code = codebook(len(languages))
    bits = code.shape[1]
    if not languages:
        return LanguageModel([], code, np.zeros((BUCKETS, 1)), np.ones(1), np.ones(1))
    shares = np.stack([counts[x] / max(counts[x].sum(), 1e-9) for x in languages])
    smooth = 0.5 / BUCKETS
    weights = np.zeros((BUCKETS, bits))
    for b in range(bits):
        if (code[:, b] > 0).all() or (code[:, b] < 0).all():
            continue
        weights[:, b] = np.log(shares[code[:, b] > 0].mean(axis=0) + smooth) - np.log(shares[code[:, b] < 0].mean(axis=0) + smooth)
    model = LanguageModel(languages, code, weights, np.ones(bits), np.ones(bits))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, right, size = 0, np.zeros(bits), np.zeros(bits)
        at = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            labels = np.array([at[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for lo, hi, data, offsets in chunks(batch.column(0)):
                margins = model.margins(ngram_counts(data, offsets))
                right += (margins * code[labels[lo:hi]] > 0).sum(axis=0)
                size += np.abs(margins).sum(axis=0)
                number += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([right.tolist()]), pa.array([size.tolist()])], names=["n", "right", "size"])

    sample = _calibration_sample(rows, calibration_rows).select("text", "lang")
    found = in_arrow(sample, judge, "n long, right array<double>, size array<double>")
    sums = found.agg(F.sum("n").alias("n"), *[F.sum(F.col(c)[b]).alias(f"{c}{b}") for c in ("right", "size") for b in range(bits)]).first()
    n = sums["n"] or 0
    right = np.array([sums[f"right{b}"] or 0 for b in range(bits)])
    size = np.array([sums[f"size{b}"] or 0 for b in range(bits)])
    accuracy = (right + 1) / (n + 2)
    trust = np.log(np.clip(accuracy, 0.51, 0.999) / (1 - np.clip(accuracy, 0.51, 0.999)))
    return LanguageModel(languages, code, weights, np.maximum(size / max(n, 1), 1e-6), trust / trust.mean())


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs without text, with lang_pred, score and ambiguous."""
    added = {"lang_pred", "score", "ambiguous"}
    keep = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in added]
    names = [f.name for f in keep]
    schema = T.StructType(keep + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*model.languages, UNKNOWN], dtype=object)
        ascii_letter = np.zeros(256, dtype=bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        for batch in batches:
            n = batch.num_rows
            best, score, close = np.full(n, len(known) - 1), np.zeros(n), np.zeros(n, dtype=bool)
            for lo, hi, data, offsets in chunks(batch.column(text)):
                letters = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum(ascii_letter[data], out=letters[1:])
                lettered = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
                    lettered[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
                if model.languages:
                    found = model.decode(ngram_counts(data, offsets))
                    best[lo:hi] = np.where(lettered, found[0], len(known) - 1)
                    score[lo:hi] = np.where(lettered, found[1], 0)
                    close[lo:hi] = lettered & found[2]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(known[best].tolist(), pa.string()), pa.array(score), pa.array(close)], names=[*names, "lang_pred", "score", "ambiguous"])

    return in_arrow(docs.select(*map(field, dict.fromkeys([*names, text]))), work, schema)
