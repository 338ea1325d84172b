"""Parts of logistic mixing that the token model and the spelling model share.

A slot holds how often a decision was zero and one, as a state of two bytes (scaled where a count
is beyond 255). A predictor's opinion is the state's logit; a gate chooses the weights under
which opinions are added; an adaptive map refines the sum.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import shuffles_removed

#: Slots of a table that travel together.
SLICE = 1 << 16
#: A state's level: unseen, and from so many decisions on.
LEVELS = (1, 3, 16)
MAP_BUCKETS, MAP_RANGE = 33, 8.0
#: Observations that the map counts for before it is refined.
MAP_PRIOR = 32.0

_one, _zero = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
#: By state: logit of a one, and level.
LOGIT = np.clip(np.log((_one + 0.1) / (_zero + 0.1)), -8, 8).astype(np.float32)
LEVEL = np.searchsorted(np.array(LEVELS), _one + _zero, side="right").astype(np.int8)


def _less(y: int) -> np.ndarray:
    """By state, the state without one occurrence whose decision was ``y``; scaled ones stay."""
    known = (_one < 255) & (_zero < 255) & ((_one if y else _zero) > 0)
    return np.arange(1 << 16) - np.where(known, 1 if y else 256, 0)


#: The same three times: as it is, without a zero of its own, without a one (at 65536 and 131072).
LOGIT_OWN = np.concatenate([LOGIT, LOGIT[_less(0)], LOGIT[_less(1)]])
LEVEL_OWN = np.concatenate([LEVEL, LEVEL[_less(0)], LEVEL[_less(1)]])


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def below_256(n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts ``n``, none above ``most``, scaled so that ``most`` is at most 255 (rounded up)."""
    n, big = n.astype(np.int64), np.flatnonzero(most > 255)
    n[big] = -(-n[big] * 255 // most[big].astype(np.int64))
    return n


def state(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    most = np.maximum(n0, n1)
    return (below_256(n0, most) << 8 | below_256(n1, most)).astype(np.uint16)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


def bucket(z: np.ndarray) -> np.ndarray:
    """The map's bucket for a mixed logit."""
    return ((np.clip(z, -MAP_RANGE, MAP_RANGE) + MAP_RANGE) * ((MAP_BUCKETS - 1) / (2 * MAP_RANGE)) + 0.5).astype(np.int64)


def refined(direct: np.ndarray, mapped: np.ndarray) -> np.ndarray:
    """Probability of what was decided: mean of the mixed one and the map's, kept off 0 and 1."""
    return np.clip((direct + mapped) / 2, 1e-7, 1 - 1e-7)


def mixed(weights: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum of opinions. ``weights``: predictors and bias by gates; ``at``: gate by decision."""
    z = weights[-1].take(at)
    for k in range(len(x)):
        z += weights[k].take(at) * x[k]
    return z


class Learner:
    """Weights (predictors and a bias by gates) and map (by class) learnt online."""

    def __init__(self, weights: np.ndarray, classes: int, rate: float = 0.03):
        self.weights, self.rate = weights.astype(np.float64), rate
        self.squares = np.full(weights.shape, 1.0)
        self.seen = np.zeros(weights.shape[1])
        self.tries = np.zeros((classes, MAP_BUCKETS))
        self.hits = np.zeros((classes, MAP_BUCKETS))

    def step(self, x: np.ndarray, gate: np.ndarray, cls: np.ndarray, y: np.ndarray, into_map: bool) -> None:
        """``x``: predictors by decisions; ``y``: 0 or 1."""
        z = mixed(self.weights.astype(np.float32), gate, x)
        error = y - sigmoid(z)
        gates = self.weights.shape[1]
        self.seen += np.bincount(gate, minlength=gates)
        for k in range(len(x) + 1):
            g = np.bincount(gate, error * x[k] if k < len(x) else error, gates)
            self.squares[k] += g**2
            self.weights[k] += self.rate * g / np.sqrt(self.squares[k])
        if into_map:
            at = cls * MAP_BUCKETS + bucket(z)
            self.tries += np.bincount(at, minlength=self.tries.size).reshape(self.tries.shape)
            self.hits += np.bincount(at, y, self.tries.size).reshape(self.tries.shape)

    def parts(self) -> tuple[np.ndarray, ...]:
        """What adds up over learners: weights times decisions, decisions, tries, hits."""
        return self.weights * self.seen, self.seen, self.tries, self.hits


def averaged(parts: tuple[np.ndarray, ...] | None, weights: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and map from the learners' sums; gates that none saw keep ``weights``."""
    start = np.tile(sigmoid(np.linspace(-MAP_RANGE, MAP_RANGE, MAP_BUCKETS)), (classes, 1))
    if parts is None:
        return weights.astype(np.float32), start.astype(np.float32)
    total, seen, tries, hits = parts
    mean = np.where(seen > 0, total / np.maximum(seen, 1), weights)
    return mean.astype(np.float32), ((hits + start * MAP_PRIOR) / (tries + MAP_PRIOR)).astype(np.float32)


# ---- transport


def packed(*arrays) -> bytes:
    """Numpy arrays (in planes of their items' bytes, which compress better) and other objects."""
    planes = [(a.dtype, a.shape, a.reshape(-1, 1).view(np.uint8).T.tobytes()) if isinstance(a, np.ndarray) else a for a in map(_whole, arrays)]
    raw = pickle.dumps(planes, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _whole(a):
    return np.ascontiguousarray(a) if isinstance(a, np.ndarray) else a


def unpacked(body: bytes) -> tuple:
    out = []
    for a in pickle.loads(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)):
        if isinstance(a, tuple) and len(a) == 3 and isinstance(a[0], np.dtype):
            dtype, shape, planes = a
            a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).reshape(shape)
        out.append(a)
    return tuple(out)


def slices(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A table of counts (slots by two) in slices; empty ones are left out."""
    for at in range(0, len(counts), SLICE):
        part = counts[at : at + SLICE]
        if part.any():
            yield at // SLICE, packed(np.minimum(part, 0xFFFFFFFF).astype(np.uint32))


def summed_states(parts: DataFrame, slots: int) -> np.ndarray:
    """``parts``: ``slice`` int, ``body``, from many tasks. The table's states; what reaches the
    driver is two bytes a slot."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(state(total[:, 0], total[:, 1]))], pa.binary())], ["slice", "body"])

        for b in batches:
            for s, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = unpacked(body.as_buffer().to_pybytes())[0].astype(np.int64)
                if s == at:
                    total += got
                else:
                    if at is not None:
                        yield out()
                    at, total = s, got
        if at is not None:
            yield out()

    found = np.zeros(slots, np.uint16)
    sums = parts.select("slice", "body").repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, body binary")
    for r in collected(sums):
        got = unpacked(bytes(r["body"]))[0]
        found[r["slice"] * SLICE : r["slice"] * SLICE + len(got)] = got
    return found


def summed_parts(learners: DataFrame) -> tuple[np.ndarray, ...] | None:
    """Sum of the learners' parts (column ``body``), first in 64 tasks, then here."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _sum(x.as_buffer().to_pybytes() for b in batches for x in b.column(0))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(*total)], pa.binary())], ["body"])

    return _sum(bytes(r["body"]) for r in collected(learners.select("body").repartition(64).mapInArrow(add, "body binary")))


def collected(df: DataFrame) -> list:
    """A bounded result; the shuffles behind it go at once."""
    with shuffles_removed(df.sparkSession):
        return df.select("*").collect()  # planned inside, where the setting is read


def _sum(bodies: Iterator[bytes]) -> tuple[np.ndarray, ...] | None:
    total = None
    for body in bodies:
        got = unpacked(body)
        total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
    return total
