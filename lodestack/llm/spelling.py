"""How a token that training texts do not have is spelled: its bytes and a terminator, each as the
binary decisions on its way in a Huffman tree.

Predictors are hashed contexts of the bytes before in the token (orders 1 to 4 and the whole
prefix); their counts come from every rare token of the vocabulary, once each. A context of this
kind ends at the token's start: what lies before decides whether a token is unknown
(:mod:`.lm_model`), not how it is spelled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmix
from .bitmix import LEVEL_OWN, LOGIT_OWN, Learner, mix
from .tree import Tree

#: log2 of each predictor's slots: orders 1, 2, 3, 4, whole prefix.
SLOT_BITS = (16, 18, 19, 20, 21)
N_PREDICTORS = len(SLOT_BITS)
OFFSETS = np.concatenate(([0], np.cumsum([1 << b for b in SLOT_BITS])))
#: A gate: longest known context, its level, depth in the tree (from 7 on alike).
DEPTHS = 8
GATES = (N_PREDICTORS + 1) * (len(bitmix.LEVELS) + 1) * DEPTHS
#: Passes of the mixing over each range of words, decisions at once.
EPOCHS, BATCH = 2, 4096
#: Bytes of tokens that are handled together, in learning and elsewhere.
CHUNK, PART = 1 << 18, 1 << 14


def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (bytes, 0 as terminator) of all words end to end, the word of each, and a hash
    of every predictor's context at each (predictors by symbols)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    symbols = np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8)
    owner = np.repeat(np.arange(len(words)), sizes)
    first = (np.cumsum(sizes) - sizes)[owner]
    at = np.arange(len(symbols)) - first
    wide = symbols.astype(np.uint64) + np.uint64(1)
    out = np.empty((N_PREDICTORS, len(symbols)), np.uint64)
    run = np.zeros(len(symbols), np.uint64)
    for k in range(1, N_PREDICTORS):
        past = np.zeros(len(symbols), np.uint64)
        past[k:] = wide[:-k]
        run = run | np.where(at >= k, past, np.uint64(0)) << np.uint64(9 * (k - 1))
        out[k - 1] = run
    power = np.cumprod(np.full(int(sizes.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wide * power[at], dtype=np.uint64)))
    out[-1] = total[:-1] - total[first]
    salt = (np.arange(1, N_PREDICTORS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]
    return symbols, owner, mix(out + salt)


def slots(hashes: np.ndarray, length: np.ndarray, node: np.ndarray) -> Iterator[np.ndarray]:
    """Each predictor's slots for the decisions at nodes (by hash), ``length`` of them a symbol."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    node = node * odd
    for k, bits in enumerate(SLOT_BITS):
        out = np.repeat(hashes[k] * odd, length)
        out += node
        out >>= np.uint64(64 - bits)
        yield out.view(np.int64) + OFFSETS[k]


def chunks(words: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``most`` bytes."""
    start, size = 0, 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= most or i == len(words) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def first_weights() -> np.ndarray:
    weights = np.full((N_PREDICTORS + 1, GATES), 0.15)
    weights[-1] = 0
    per = (len(bitmix.LEVELS) + 1) * DEPTHS
    for k in range(N_PREDICTORS):
        weights[k, (k + 1) * per : (k + 2) * per] = 0.6
    return weights


@dataclass
class Speller:
    """Tree of bytes, states by slot, weights by gate, map by depth."""

    tree: Tree
    states: np.ndarray
    weights: np.ndarray
    map: np.ndarray

    def decisions(self, words: list[bytes], own: np.ndarray) -> tuple[np.ndarray, ...]:
        """All decisions of the words: the word, what was decided, opinions, gate, depth."""
        symbols, owner, hashes = contexts(words)
        length, place = self.tree.ways(symbols)
        y, word = self.tree.bits.take(place), np.repeat(owner, length)
        mode = np.repeat(np.where(own, 1 << 16, 0)[owner], length) * (y.astype(np.int8) + np.int8(1))
        x = np.empty((N_PREDICTORS, len(place)), np.float32)
        gate = np.zeros(len(place), np.int16)
        for k, s in enumerate(slots(hashes, length, self.tree.hash.take(place))):
            s = self.states.take(s) + mode
            LOGIT_OWN.take(s, out=x[k], mode="clip")
            known = LEVEL_OWN.take(s)
            # the longest known context so far, and its level
            np.copyto(gate, known + np.int16((k + 1) * (len(bitmix.LEVELS) + 1)), where=known > 0)
        depth = np.minimum(self.tree.depth.take(place), DEPTHS - 1).astype(np.int64)
        return word, y, x, gate * np.int64(DEPTHS) + depth, depth

    def log10(self, words: list[bytes], own: np.ndarray) -> np.ndarray:
        """log10 probability of each word's spelling; where ``own``, without its own counts."""
        out = np.zeros(len(words))
        for a, b in chunks(words, PART):
            word, y, x, gate, depth = self.decisions(words[a:b], own[a:b])
            z = bitmix.mixed(self.weights, gate, x)
            mapped = self.map.take(depth * bitmix.MAP_BUCKETS + bitmix.bucket(z))
            p = bitmix.refined(bitmix.sigmoid(np.where(y, z, -z)), np.where(y, mapped, 1 - mapped))
            out[a:b] = np.bincount(word, np.log10(p), b - a)
        return out

    def learnt(self, batches: Iterator[list[bytes]]) -> Learner:
        """An online pass over words that the states contain, each without its own counts; a range
        of words is gone over EPOCHS times, the map is from the last."""
        learner = Learner(self.weights, DEPTHS, 0.06)
        for words in batches:
            for a, b in chunks(words, CHUNK):
                _, y, x, gate, depth = self.decisions(words[a:b], np.ones(b - a, bool))
                for epoch in range(EPOCHS):
                    for i in range(0, len(y), BATCH):
                        z = slice(i, i + BATCH)
                        learner.step(x[:, z], gate[z], depth[z], y[z], epoch == EPOCHS - 1)
        return learner


def _words(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in batch.column(0)]


def fit(words: DataFrame) -> Speller:
    """``words``: ``word`` (binary), each once. Counts and mixing come from all of them; the mixing
    is learnt in parallel and averaged."""

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            some = _words(batch)
            total += np.bincount(np.frombuffer(b"".join(some), np.uint8), minlength=256)
            total[0] += len(some)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    words = words.select("word")
    seen = words.mapInArrow(bytes_of, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    weights = [0] * 256
    for r in seen:
        weights[r["byte"]] = r["n"]
    tree = Tree(weights)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((int(OFFSETS[-1]), 2), np.uint32)
        flat, used = total.reshape(-1), False
        for batch in batches:
            some = _words(batch)
            for a, b in chunks(some, PART):
                used = True
                symbols, _, hashes = contexts(some[a:b])
                length, place = tree.ways(symbols)
                bits = tree.bits.take(place)
                for s in slots(hashes, length, tree.hash.take(place)):
                    np.add.at(flat, s * 2 + bits, np.uint32(1))
        for s, body in bitmix.slices(total) if used else ():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([body], pa.binary())], ["slice", "body"])

    states = bitmix.summed_states(words.mapInArrow(count, "slice int, body binary"), int(OFFSETS[-1]))
    start = Speller(tree, states, first_weights(), np.empty(0))
    shared = words.sparkSession.sparkContext.broadcast(start)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            learner = shared.value.learnt(map(_words, itertools.chain([first], batches)))
            yield pa.RecordBatch.from_arrays([pa.array([bitmix.packed(*learner.parts())], pa.binary())], ["body"])

    parts = bitmix.summed_parts(words.mapInArrow(learn, "body binary"))
    return Speller(tree, states, *bitmix.averaged(parts, start.weights, DEPTHS))
