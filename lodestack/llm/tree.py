"""A Huffman tree whose ways are laid out flat, so that arrays of symbols expand into decisions."""

from __future__ import annotations

import heapq

import numpy as np

_ODD = np.uint64(0xA0761D6478BD642F)


class Tree:
    """Leaves are numbered as ``weights``; at least two. It travels as the parent of every node."""

    def __init__(self, weights: list[float]):
        heap = [(max(c, 0.5), i) for i, c in enumerate(weights)]
        n = len(heap)
        heapq.heapify(heap)
        parent, side, at = [0] * (2 * n - 1), [0] * (2 * n - 1), n
        ways: list[float] = []
        while len(heap) > 1:
            (w0, a), (w1, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a], parent[b], side[b] = at, at, 1
            ways.append(w1 / w0)
            heapq.heappush(heap, (w0 + w1, at))
            at += 1
        logit = np.clip(np.log(np.array(ways)), -12, 12).astype(np.float32)
        self.__setstate__((np.array(parent, np.int32), np.array(side, np.int8), logit))

    def __getstate__(self):
        return self._made_of

    def __setstate__(self, state):
        self._made_of = parent, side, logit = state
        n = self.leaves = len(logit) + 1
        root, x, up = 2 * n - 2, np.arange(n), []
        while (x != root).any():  # all leaves climb together; those at the root stay
            up.append(np.where(x == root, -1, x))
            x = np.where(x == root, root, parent[x])
        climbed = np.array(up).T[:, ::-1]  # by leaf, from below the root down
        on = climbed >= 0
        here = climbed[on]
        self.length = on.sum(1)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))
        node = parent[here].astype(np.int64) - n
        depth = np.arange(len(here)) - np.repeat(self.offset[:-1], self.length)
        #: By place on a leaf's way: the decision, its depth, its node's hash and logit by weight.
        self.bits, self.depth = side[here], depth.astype(np.int8)
        self.hash, self.logit = node.astype(np.uint64) * _ODD, logit[node]
        one = np.where(self.bits == 1, np.uint64(1) << (63 - depth).astype(np.uint64), np.uint64(0))
        self.code = np.bitwise_or.reduceat(one, self.offset[:-1])

    def expand(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all decisions of all leaves in turn: the index into ``leaf``, the place."""
        length, place = self.ways(leaf)
        return np.repeat(np.arange(len(leaf)), length), place

    def ways(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of decisions of each leaf; the places of all of them in turn."""
        length = self.length[leaf]
        end = np.cumsum(length)
        return length, np.arange(end[-1] if len(end) else 0) + np.repeat(self.offset[leaf] - end + length, length)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Decisions that the ways to leaves ``a`` and ``b`` have in common."""
        x = self.code[a] ^ self.code[b]
        high = x >> np.uint64(32)
        some = high > 0
        bits = np.frexp(np.where(some, high, x).astype(np.float64))[1]
        return np.where(a == b, self.length[a], np.where(some, 32, 64) - bits)
