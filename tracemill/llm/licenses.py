"""License notices: an exact set-similarity join of text blocks with templates.

Templates' tokens are ordered by how often they stand in the whole corpus, rarest
first.  A block that contains a share `threshold` of a template's tokens has one of
the template's first n - ceil(threshold * n) + 1 tokens (prefix filter), has itself
at least ceil(threshold * n) distinct words (length filter), and after the first
common token enough tokens of either are left (positional filter).  What passes is
counted, so the join is exact.  Blocks are windows of `block_words` words that start
every half of that; a template of at most half of it falls whole into one of them,
wherever lines break; a longer one raises ValueError.

Named phrases are looked up beside that, word by word.

Defined results: null and empty texts have no words and no labels; repeated rows are
judged each; an empty table gives an empty result; extra columns stay, those that
clash with added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, field, in_arrow, lowered, words_of

THRESHOLD, BLOCK_WORDS = 0.9, 64

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The opening words of licenses and of their usual notices, and their labels.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[:128] = True
_SEPARATOR[48:58] = _SEPARATOR[97:123] = False


def _words(data: np.ndarray, offsets: np.ndarray):
    return words_of(lowered(data), offsets, _SEPARATOR)


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return _words(data, np.array([0, len(data)])).hashes()


class Templates:
    """Template token sets over one vocabulary: ids in the order of the global frequencies, the rarest first."""

    def __init__(self, templates: dict[str, str], frequency: dict[int, int], threshold: float):
        self.labels = sorted(templates)
        sets = [np.unique(_hashes(templates[x])) for x in self.labels]
        self.vocabulary = vocabulary(templates)
        counts = np.array([frequency.get(int(np.int64(x.astype(np.int64))), 0) for x in self.vocabulary], dtype=np.int64)
        rank = np.empty(len(counts), dtype=np.int64)
        rank[np.lexsort((self.vocabulary, counts))] = np.arange(len(counts))
        self.rank = rank
        self.sets = [np.sort(rank[np.searchsorted(self.vocabulary, s)]) for s in sets]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.prefixes = [set(s[: len(s) - n + 1].tolist()) for s, n in zip(self.sets, self.need, strict=True)]
        self.in_prefix = np.zeros(len(counts), dtype=bool)
        for p in self.prefixes:
            self.in_prefix[list(p)] = True

    def ranks_of(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's rank in the vocabulary, -1 outside of it."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, self.rank[at], -1)

    def judge(self, ranks: np.ndarray, distinct: int) -> list[tuple[int, float]]:
        """(template, containment) of the templates that a block reaches, by its words' ranks and its number of distinct words."""
        own = np.unique(ranks[ranks >= 0])
        found = []
        for t, (tokens, need, prefix) in enumerate(zip(self.sets, self.need, self.prefixes, strict=True)):
            if distinct < need:
                continue
            for i, token in enumerate(own.tolist()):
                if token in prefix:
                    left = min(len(own) - i, len(tokens) - int(np.searchsorted(tokens, token)))
                    if left >= need:
                        common = len(np.intersect1d(own, tokens, assume_unique=True))
                        if common >= need:
                            found.append((t, common / len(tokens)))
                    break
        return found


def vocabulary(templates: dict[str, str]) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(x) for x in templates.values()]))


def token_frequencies(docs: DataFrame, templates: dict[str, str], text: str = "text") -> dict[int, int]:
    """How often each template token stands in all of docs, by fingerprint; as many entries as templates have tokens."""
    known = vocabulary(templates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                hashes = _words(data, offsets).hashes()
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                total += np.bincount(at[known[at] == hashes], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int64)), pa.array(total)], names=["token", "n"])

    counted = in_arrow(docs.select(field(text)), work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def find_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without text, with n_words, places (array of label, word) and blocks (array of label, first, last, containment).

    places are where phrases stand; blocks are the text blocks that reach a template's threshold.
    """
    longest = max((len(_hashes(x)) for x in templates.values()), default=0)
    if longest > block_words // 2:
        raise ValueError(f"a template of {longest} words can fall between blocks of {block_words}: block_words has to be {2 * longest} or more")
    table = Templates(templates, token_frequencies(docs, templates, text), threshold)
    wanted = [(label, _hashes(phrase)) for phrase, label in phrases.items()]
    added = {"n_words", "places", "blocks"}
    keep = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in added]
    names = [f.name for f in keep]
    place = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))
    block = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("containment", T.DoubleType())]))
    schema = T.StructType(keep + [T.StructField("n_words", T.LongType()), T.StructField("places", place), T.StructField("blocks", block)])
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    block_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))
    step = block_words // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, places, blocks = np.zeros(n, dtype=np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
            for lo, hi, data, offsets in chunks(batch.column(text)):
                words = _words(data, offsets)
                hashes, first = words.hashes(), words.first
                counts[lo:hi] = words.counts()
                for label, phrase in wanted:
                    m = len(phrase)
                    if len(hashes) < m:
                        continue
                    hit = hashes[: len(hashes) - m + 1] == phrase[0]
                    at = np.flatnonzero(hit)
                    for k in range(1, m):
                        at = at[hashes[at + k] == phrase[k]]
                    row = np.searchsorted(first, at, side="right") - 1
                    inside = at + m <= first[row + 1]
                    for r, w in zip(row[inside].tolist(), (at - first[row])[inside].tolist(), strict=True):
                        places[lo + r].append({"label": label, "word": w})
                ranks = table.ranks_of(hashes)
                seeds = np.flatnonzero((ranks >= 0) & table.in_prefix[ranks])
                row = np.searchsorted(first, seeds, side="right") - 1
                inner = (seeds - first[row]) // step
                # A word stands in the window that starts in its half block, and in the one before.
                spots = np.unique(np.concatenate([row * (1 << 32) + inner, (row * (1 << 32) + np.maximum(inner - 1, 0))]))
                for r, w in zip((spots >> 32).tolist(), (spots & 0xFFFFFFFF).tolist(), strict=True):
                    begin = int(first[r]) + w * step
                    end = min(begin + block_words, int(first[r + 1]))
                    for t, share in table.judge(ranks[begin:end], len(np.unique(hashes[begin:end]))):
                        blocks[lo + r].append({"label": table.labels[t], "first": w * step, "last": end - int(first[r]) - 1, "containment": share})
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(counts), pa.array(places, place_type), pa.array(blocks, block_type)], names=[*names, "n_words", "places", "blocks"])

    return in_arrow(docs.select(*map(field, dict.fromkeys([*names, text]))), work, schema)
