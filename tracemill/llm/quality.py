"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

`quality_features` counts what the rules look at, over whole texts.  `RULES` turn
the counts into votes: 1 good, -1 bad, 0 abstain.  `fit_quality` groups the whole
corpus by vote pattern (at most 3 ** len(RULES) groups, whatever the input) and runs
expectation-maximisation over the groups: the accuracy of every rule and the share
of good documents are estimated together, without labels.  `QualityModel.posterior`
is a column expression, so that scoring is a projection without a shuffle.

A vote for good never lowers the posterior, one for bad never raises it, and the weight of
an abstention stays within a half: the estimates are clamped to that in every round.

Defined results: null and empty texts count as no words; repeated rows count as
often as they stand; an empty table fits the prior alone; features replace columns
of the same name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_POWERS, chunks, field, in_arrow, lowered, mix, sums_by_text, whole_row, words_of

#: Bytes up to which a line's fingerprint is a polynomial.
LONG_LINE = 1000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_alpha_words", "n_letters", "n_capitals", "n_ended_lines", "n_distinct_words", "n_bangs")

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to in is that for it as was with be by on not this are or from at an but have had
le la les des et du une que dans qui pour est sur pas au par en de un ce il elle ne se son
der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an
el los las del y que una por con para no su al lo como más
""".split()


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOL = _bytes(b"#*$%&|<>")
_SPACE = _bytes(b" \t\n\v\f\r")
_CAPITAL = _bytes(bytes(range(65, 91)))
_LETTER = _bytes(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_CONTINUES = _bytes(bytes(range(128, 192)))
_ENDS = _bytes(b".!?\"':;")


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return np.unique(words_of(data, np.array([0, len(data)])).hashes())


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand there twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _distinct_by_text(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each of n texts."""
    keyed = mix(keys + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, at = np.unique(keyed, return_index=True)
    return np.bincount(of[at], minlength=n)


def count_features(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """FEATURES (rows) of the texts data[offsets[i]:offsets[i + 1]] (columns)."""
    n = len(offsets) - 1
    words = words_of(data, offsets)
    first = words.first
    of = words.text_of_word()
    hashes = words.hashes()

    def in_bytes(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    # Lines: cut at each \n and at each text's end.
    space = _SPACE[data]
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    begin.sort()
    end.sort()
    line_of = np.searchsorted(offsets, begin, side="right") - 1
    empty = np.flatnonzero(np.diff(offsets) == 0)
    if len(empty):  # empty texts share their offset with the next; their one line is empty
        full = end > begin
        begin, end, line_of = begin[full], end[full], line_of[full]
    solid = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~space, out=solid[1:])
    worded = solid[end] > solid[begin]
    begin, end, line_of = begin[worded], end[worded], line_of[worded]
    up, down = BYTE_POWERS.upto(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    line_hash = mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))
    for i in np.flatnonzero(end - begin > LONG_LINE):  # polynomials modulo 2**64 collide for some runs of 1024 bytes and more
        line_hash[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    n_lines = np.bincount(line_of, minlength=n)
    dup_lines = n_lines - _distinct_by_text(line_hash, line_of, n)
    ended = np.bincount(line_of[_ENDS[data[words.end[np.searchsorted(words.begin, end) - 1] - 1]]], minlength=n) if len(end) else np.zeros(n, dtype=np.int64)

    # Words in windows of three that stand in the text twice or more.
    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 2:
        at = np.flatnonzero(of[:-2] == of[2:])
        key = mix(hashes[at] + np.uint64(3) * mix(hashes[at + 1]) + np.uint64(7) * mix(hashes[at + 2] ^ np.uint64(0x5851F42D4C957F2D)) + of[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = at[_repeated(key)]
        covered[at] = covered[at + 1] = covered[at + 2] = True

    small = words_of(lowered(data), offsets).hashes() if len(hashes) else hashes
    lettered = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_LETTER[data], out=lettered[1:])
    return np.stack([
        np.diff(first),
        in_bytes(~space & ~_CONTINUES[data]),
        in_bytes(_SYMBOL[data]),
        n_lines,
        dup_lines,
        sums_by_text(first, covered),
        sums_by_text(first, np.isin(small, stop)),
        sums_by_text(first, lettered[words.end] > lettered[words.begin]),
        in_bytes(_LETTER[data] & ~_CONTINUES[data]),
        in_bytes(_CAPITAL[data]),
        ended,
        _distinct_by_text(small, of, n),
        in_bytes(data == 33),
    ])


def quality_features(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with FEATURES (bigint), without the text unless keep_text."""
    taken = {c.lower() for c in FEATURES}
    keep = [f for f in docs.schema.fields if f.name.lower() not in taken and (keep_text or f.name != text)]
    names = [f.name for f in keep]
    schema = T.StructType(keep + [T.StructField(c, T.LongType()) for c in FEATURES])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = _word_hashes(STOP_WORDS)
        for batch in batches:
            found = [count_features(data, offsets, stop) for _, _, data, offsets in chunks(batch.column(text))]
            counts = np.concatenate(found, axis=1) if found else np.zeros((len(FEATURES), 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *(pa.array(x, pa.int64()) for x in counts)], names=[*names, *FEATURES])

    return in_arrow(docs.select(*map(field, dict.fromkeys([*names, text]))), work, schema)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> list[tuple[str, Column, Column]]:
    """(name, votes good where, votes bad where); a rule abstains elsewhere."""
    length, mean = F.col("n_words"), _share("word_chars", "n_words")
    symbols, dups = _share("n_symbols", "n_words"), _share("n_dup_lines", "n_lines")
    repeats, stops = _share("n_repeat_words", "n_words"), _share("n_stop_words", "n_words")
    alpha, capitals = _share("n_alpha_words", "n_words"), _share("n_capitals", "n_letters")
    ended, distinct, bangs = _share("n_ended_lines", "n_lines"), _share("n_distinct_words", "n_words"), _share("n_bangs", "n_words")
    return [
        ("length", length >= 50, length < 30),
        ("word_length", mean.between(3, 10), ~mean.between(2.5, 12)),
        ("symbols", symbols <= 0.02, symbols > 0.1),
        ("duplicate_lines", dups <= 0.1, dups > 0.5),
        ("repeated_words", repeats <= 0.1, repeats > 0.35),
        ("stop_words", stops >= 0.05, stops < 0.01),
        ("alphabetic", alpha >= 0.9, alpha < 0.7),
        ("capitals", capitals <= 0.2, capitals > 0.5),
        ("line_ends", ended >= 0.3, (ended < 0.05) & (F.col("n_lines") > 3)),
        ("distinct_words", distinct >= 0.15, distinct < 0.08),
        ("exclamations", bangs <= 0.05, bangs > 0.2),
    ]


def vote_columns() -> list[Column]:
    return [F.when(good, 1).when(bad, -1).otherwise(0).alias(f"vote_{name}") for name, good, bad in rules()]


@dataclass(frozen=True)
class QualityModel:
    """log_odds: of a good document before votes; weights: added for each rule's vote -1, 0, 1; accuracies: right votes among a rule's votes."""

    log_odds: float
    weights: list[list[float]]
    accuracies: list[float]

    def posterior(self) -> Column:
        """Probability that a document with these FEATURES is good."""
        total = F.lit(self.log_odds)
        for (_, good, bad), (low, none, high) in zip(rules(), self.weights, strict=True):
            total = total + F.when(good, high).when(bad, low).otherwise(none)
        return 1 / (1 + F.exp(-total))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, smoothing: float = 1.0, right: float = 0.8) -> QualityModel:
    """votes: patterns by rules, in -1, 0, 1.  right: how often a vote is taken to be right before it is estimated.

    A rule has its own chances of each vote in either class.  It starts from the
    assumption right, and a rule never ends up as voting against its own meaning.
    """
    m = votes.shape[1]
    # Bad votes are rare and say more than good ones, which clean and poor documents share: a
    # document starts as good unless a rule votes against it, and the less so the more rules do.
    posterior = np.where((votes < 0).any(axis=1), (1 - right) ** (votes < 0).sum(axis=1), right)
    weights, accuracies, log_odds = np.zeros((m, 3)), np.full(m, right), 0.0
    for _ in range(rounds):
        good = np.array([(counts * posterior) @ (votes == v) for v in (-1, 0, 1)]).T
        bad = np.array([(counts * (1 - posterior)) @ (votes == v) for v in (-1, 0, 1)]).T
        prior = np.array([smoothing, smoothing, smoothing])
        p_good, p_bad = good + prior, bad + prior
        p_good, p_bad = p_good / p_good.sum(axis=1, keepdims=True), p_bad / p_bad.sum(axis=1, keepdims=True)
        new = np.log(p_good) - np.log(p_bad)
        new[:, 0], new[:, 2] = np.minimum(new[:, 0], 0), np.maximum(new[:, 2], 0)
        new[:, 1] = np.clip(new[:, 1], -0.5, 0.5)  # an abstention says little
        total = counts.sum()
        share = (counts @ posterior + smoothing) / (total + 2 * smoothing) if total else 0.5
        log_odds = math.log(share / (1 - share))
        made = (good[:, 2] + good[:, 0] + bad[:, 0] + bad[:, 2])
        accuracies = (good[:, 2] + bad[:, 0] + smoothing * right) / (made + smoothing)
        after = 1 / (1 + np.exp(-np.clip(log_odds + sum(new[j, votes[:, j] + 1] for j in range(m)), -50, 50)))
        moved = float(np.abs(after - posterior).max()) if len(after) else 0.0
        weights, posterior = new, after
        if moved < 1e-9:
            break
    return QualityModel(log_odds, weights.tolist(), accuracies.tolist())


def fit_quality(features: DataFrame) -> QualityModel:
    """The model of a whole corpus; what reaches the driver is a count for each vote pattern."""
    names = [name for name, _, _ in rules()]
    rows = features.select(*vote_columns()).groupBy(*[f"vote_{x}" for x in names]).count().collect()
    votes = np.array(sorted(tuple(r[f"vote_{x}"] for x in names) + (r["count"],) for r in rows), dtype=np.int64).reshape(-1, len(names) + 1)
    return expectation_maximisation(votes[:, :-1], votes[:, -1].astype(float))


def base_failed() -> Column:
    """Too short, or more than half of the words repeat."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(features: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """features with base_failed, quality (the posterior) and kept."""
    return features.withColumn("base_failed", base_failed()).withColumn("quality", model.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def filter_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with docs' own columns: one pass to fit, one to filter, no shuffle of texts."""
    model = fit_quality(quality_features(docs.select(field(text).alias("text"))))
    held = docs.select(whole_row(docs).alias("row"), field(text).alias("quality_text"))
    return judged(quality_features(held, "quality_text"), model, threshold).filter("kept").select("row.*")
