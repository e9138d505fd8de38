"""Sampled segmentations of a piece vocabulary: forward filtering, backward sampling.

A text's segmentations into pieces form a lattice; a segmentation's weight is the
product of its pieces' chances to the power `alpha`.  A forward pass sums the
weights of all ways to every place; sampling walks back from the end and takes a
piece with its share of what reaches that place, so a segmentation is drawn exactly
by its weight.  Draws depend on the row key, the place in the text and the seed
alone: the same row gives the same pieces on any cluster.

No piece crosses from a word to the white space after it, so the lattice falls
apart into words (blanks and what follows them).  The forward pass runs once for
each distinct word that a task meets, sampling for each word in its place; both are numpy
over all words of a chunk at a time.  A word of more than LONG_WORD bytes is segmented
in parts of that many bytes, and no piece crosses from one to the next.

Characters without a piece, and the character that stands for a blank in pieces,
become byte pieces, so decoding gives back the very text.

A vocabulary of merges has ranks, not chances; by Zipf's law the piece at rank r
gets a chance in proportion to 1 / (r + 1).

Defined results: null and empty texts have no pieces and decode to empty; repeated
rows get the same pieces; a null key counts as a key; an empty table gives an empty
result; extra columns stay, but for one named `ids`, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Powers, Words, chunks, field, free_name, in_arrow, mix

#: Text that is worked on at once: the more, the fewer words are new, and the more memory a lattice takes.
SAMPLE_CHUNK = 640 << 10
#: Edges that a task keeps for the words that it has met (20 bytes each), and bytes of a word's part.
KEPT_EDGES, LONG_WORD = 2_000_000, 4096
_CHECK_POWERS = Powers(0xC2B2AE3D27D4EB4F)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[32] = True


class PieceTrie:
    """A vocabulary as a byte trie in flat arrays; the blank's character is byte 32."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.piece_bytes: list[bytes] = [b""] * n
        self.cost = np.zeros(n)  # minus the log of a chance, up to a constant
        children: dict[int, int] = {}
        ends: dict[int, int] = {}
        nodes = 1
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(re.fullmatch("<0x(..)>", text)[1], 16)
                self.byte_id[value] = i
                self.piece_bytes[i] = bytes([value])
                self.cost[i] = np.log(1e9)
                continue
            if model.is_control(i) or model.is_unknown(i):
                continue
            raw = text.replace("▁", " ").encode()
            self.piece_bytes[i] = raw
            self.cost[i] = np.log(max(0.0, -model.get_score(i)) + 1)
            at = 0
            for b in raw:
                key = at << 8 | b
                if key not in children:
                    children[key] = nodes
                    nodes += 1
                at = children[key]
            ends[at] = i
        self.end = np.full(nodes, -1, dtype=np.int64)
        self.end[list(ends)] = list(ends.values())
        # Open addressing: a key's slot, or one of the next few.
        bits = max(4, (4 * len(children)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.probes = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64), 1
        slots = (np.array(list(children), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).tolist()
        for slot, (key, value) in zip(slots, children.items(), strict=True):
            probe = 0
            while self.keys[slot] >= 0:
                slot, probe = (slot + 1) & self.mask, probe + 1
            self.keys[slot], self.values[slot] = key, value
            self.probes = max(self.probes, probe + 1)

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The states after one more byte each, -1 where no piece goes on."""
        key = states << 8 | data
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == key, self.values[slot], -1)
        left = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            hit = held == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class Lattice:
    """Edges into each place of some words, with the chance of each, given that place, to be walked back.

    Words are added as they come, and their edges kept; places and edges are numbered through.
    """

    def __init__(self, trie: PieceTrie, alpha: float):
        self.trie, self.alpha = trie, alpha
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.n_words = self.n_places = self.n_edges = 0
        self.held = {"source": np.zeros(0, np.int32), "piece": np.zeros(0, np.int32), "upto": np.zeros(0), "edge": np.zeros(0, np.int32), "many": np.zeros(0, np.int32), "begin": np.zeros(0, np.int32), "end": np.zeros(0, np.int32)}

    def _append(self, name: str, at: int, values: np.ndarray) -> None:
        old = self.held[name]
        if at + len(values) > len(old):
            self.held[name] = np.resize(old, 2 * (at + len(values))) if len(old) else np.zeros(2 * len(values), old.dtype)
            self.held[name][:at] = old[:at]
        self.held[name][at : at + len(values)] = values

    def numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each of the distinct words data[begin:end]; words that aren't known yet are added."""
        raw, lo = data.tobytes(), self.n_words
        if self.n_edges > KEPT_EDGES:
            self.clear()
            lo = 0
        known, out, new = self.words, [], []
        for i, (x, y) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            word = raw[x:y]
            number = known.get(word)
            if number is None:
                number = lo + len(new)
                known[word] = number
                new.append(i)
            out.append(number)
        if new:
            self._add(data, begin[new], end[new])
        return np.array(out, dtype=np.int64)

    def _add(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        trie = self.trie
        size = end - begin
        base = np.concatenate([[0], np.cumsum(size + 1)])  # places of a word: 0 to its size
        of = np.repeat(np.arange(len(begin)), size)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        byte = data[begin[of] + offset].astype(np.int64)
        lead = (byte & 0xC0) != 0x80
        start, length = np.flatnonzero(lead), 0
        state = np.zeros(len(start), dtype=np.int64)
        starts, lengths, pieces = [], [], []
        single = np.zeros(len(byte) + 1, dtype=bool)
        while len(start):
            state = trie.step(state, byte[start + length])
            length += 1
            piece = np.where(state >= 0, trie.end[state], -1)
            hit = piece >= 0
            starts.append(start[hit].astype(np.int32))
            lengths.append(np.full(int(hit.sum()), length, dtype=np.int32))
            pieces.append(piece[hit].astype(np.int32))
            more = (state >= 0) & (offset[start] + length < size[of[start]])
            whole = hit & np.where(more, lead[np.minimum(start + length, len(lead) - 1)], True)
            if length <= 4:
                nbytes = 1 + (byte[start] >= 0xC0) + (byte[start] >= 0xE0) + (byte[start] >= 0xF0)
                single[start[whole & (nbytes == length)]] = True
            start, state = start[more], state[more]
        # Bytes of characters without a piece of their own.
        owner = np.maximum.accumulate(np.where(lead, np.arange(len(byte)), 0))
        lone = np.flatnonzero(~single[owner])
        starts.append(lone.astype(np.int32))
        lengths.append(np.ones(len(lone), dtype=np.int32))
        pieces.append(trie.byte_id[byte[lone]].astype(np.int32))
        at, n, piece = np.concatenate(starts), np.concatenate(lengths), np.concatenate(pieces)
        del starts, lengths, pieces
        source = (base[of[at]] + offset[at]).astype(np.int32)
        target = source + n
        depth = offset[at].astype(np.int32) + n
        # Level by level; the edges into a place stand together, the longest piece first.
        order = np.lexsort((source, target, depth)).astype(np.int32)
        source, target, piece, depth = source[order], target[order], piece[order], depth[order]
        gain = -self.alpha * trie.cost[piece]
        log = np.full(base[-1], -np.inf)
        log[base[:-1]] = 0
        share = np.empty(len(source))
        new = np.r_[True, np.diff(target) != 0] if len(target) else np.zeros(0, dtype=bool)
        levels = np.flatnonzero(np.r_[True, np.diff(depth) != 0, True]) if len(depth) else np.zeros(1, dtype=np.int64)
        for lo, hi in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            value = log[source[lo:hi]] + gain[lo:hi]
            cut = np.flatnonzero(new[lo:hi])
            top = np.maximum.reduceat(value, cut)
            top = np.where(np.isfinite(top), top, 0)
            count = np.diff(np.r_[cut, hi - lo])
            weight = np.exp(value - np.repeat(top, count))
            total = np.add.reduceat(weight, cut)
            with np.errstate(divide="ignore"):
                log[target[lo + cut]] = top + np.log(total)
            share[lo:hi] = weight / np.repeat(np.where(total > 0, total, 1), count)
        # Shares are summed up for each place by itself, and its last edge takes what is left.
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(target)])
        place = np.arange(len(target)) - np.repeat(first, count)
        upto = share
        for k in range(1, int(count.max(initial=0))):
            here = np.flatnonzero(place == k)
            upto[here] += upto[here - 1]
        upto[first + count - 1] = 2.0
        edge, many = np.zeros(base[-1], dtype=np.int32), np.zeros(base[-1], dtype=np.int32)
        edge[target[first]], many[target[first]] = self.n_edges + first, count
        for name, values in (("source", source + self.n_places), ("piece", piece), ("upto", upto)):
            self._append(name, self.n_edges, values)
        for name, values in (("edge", edge), ("many", many)):
            self._append(name, self.n_places, values)
        for name, values in (("begin", base[:-1]), ("end", base[1:] - 1)):
            self._append(name, self.n_words, values + self.n_places)
        self.n_words += len(begin)
        self.n_places += int(base[-1])
        self.n_edges += len(source)

    def sample(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each of words in turn, and how many each has; seeds: one for each."""
        held = self.held
        at, row, step = held["end"][words], np.arange(len(words)), 0
        goal = held["begin"][words]
        counts = np.zeros(len(words), dtype=np.int64)
        rows, steps, pieces = [], [], []
        while len(row):
            draw = (mix(seeds[row] + np.uint64((step + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(float) * (1.0 / (1 << 53))
            edge = held["edge"][at].copy()
            open_ = np.flatnonzero(held["upto"][edge] <= draw)
            while len(open_):
                edge[open_] += 1
                open_ = open_[held["upto"][edge[open_]] <= draw[open_]]
            rows.append(row)
            steps.append(np.full(len(row), step, dtype=np.int32))
            pieces.append(held["piece"][edge])
            counts[row] += 1
            at = held["source"][edge]
            going = at != goal
            row, at, goal = row[going], at[going], goal[going]
            step += 1
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        if rows:
            row, step = np.concatenate(rows), np.concatenate(steps)
            out[np.cumsum(counts)[row] - 1 - step] = np.concatenate(pieces)
        return out, counts


def _blank_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts, each with a blank before it, as (data, word begins, ends, first word of each text); a word is blanks and what follows them."""
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    blank = _BLANK[data]
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[offsets[:-1][full]] = True
    begin = np.flatnonzero(start)
    size = np.diff(np.r_[begin, len(data)])
    if (size > LONG_WORD).any():
        # A word is walked byte by byte, so a very long one is taken in parts, cut where a character begins.
        parts = [np.arange(x + LONG_WORD, x + n, LONG_WORD) for x, n in zip(begin[size > LONG_WORD].tolist(), size[size > LONG_WORD].tolist(), strict=True)]
        cut = np.concatenate(parts)
        for _ in range(3):
            cut -= (data[cut] & 0xC0) == 0x80
        begin = np.sort(np.concatenate([begin, cut]))
    return data, begin, np.r_[begin[1:], len(data)], np.searchsorted(begin, offsets)


def sample_pieces(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """docs without text, with ids (binary, little-endian uint32): a segmentation of each text, drawn by its weight."""
    keep = [f for f in docs.schema.fields if f.name != text and f.name.lower() != "ids"]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("ids", T.BinaryType())])
    seeds_in = free_name(docs, "sample_seed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(PieceTrie(model_path), alpha)
        for batch in batches:
            row_seeds = batch.column(seeds_in).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo, hi, raw, raw_offsets in chunks(batch.column(text), SAMPLE_CHUNK):
                data, begin, end, first = _blank_words(raw, raw_offsets)
                at, word = _distinct(data, begin, end)
                word = lattice.numbers(data, begin[at], end[at])[word]
                of = np.repeat(np.arange(hi - lo), np.diff(first))
                place = np.arange(len(begin)) - first[:-1][of]
                seeds = mix(row_seeds[lo + of] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                pieces, counts = lattice.sample(word, seeds)
                ends = np.concatenate([[0], np.cumsum(counts)])[first] * 4
                packed = pieces.tobytes()
                ids = [packed[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).select(names).columns, pa.array(ids, pa.binary())], names=[*names, "ids"])

    return in_arrow(docs.select(*map(field, names), field(text), F.xxhash64(F.lit(seed), field(key)).alias(seeds_in)), work, schema)


def _distinct(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct word data[begin:end], and for each word its place among these.

    Words are told apart by 128 bits.
    """
    hashes = Words(data, begin, end, np.array([0, len(begin)]), np.array([0, len(data)])).hashes()
    up, down = _CHECK_POWERS.upto(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    check = (prefix[end] - prefix[begin]) * down[begin]
    _, at, word = np.unique(hashes, return_index=True, return_inverse=True)
    if (check[at][word] != check).any():
        _, at, word = np.unique(np.stack([hashes, check]), axis=1, return_index=True, return_inverse=True)
    return at, word


def decode_pieces(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded without ids, with the text that they stand for."""
    keep = [f for f in encoded.schema.fields if f.name not in (ids, text)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(text, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(PieceTrie(model_path).piece_bytes, dtype=object)
        for batch in batches:
            texts, lo, held = [], 0, 0
            for i, packed in enumerate(batch.column(ids).to_pylist()):
                whole = b"".join(table[np.frombuffer(packed or b"", dtype=np.uint32)])
                texts.append(whole[1:].decode("utf-8", "replace"))  # the blank before the text goes
                held += len(whole)
                if held > SAMPLE_CHUNK or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(texts)).select(names).columns, pa.array(texts, pa.string())], names=[*names, text])
                    texts, lo, held = [], i + 1, 0

    return in_arrow(encoded.select(*map(field, names), field(ids)), work, schema)
