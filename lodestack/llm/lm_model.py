"""The token model: a text's tokens as binary decisions, predicted by contexts that reach back
over the tokens before, mixed online.

The most frequent training tokens are leaves of a Huffman tree, one more leaf stands for all
others (rare). A token is the decisions on the way to its leaf. Predictors of a decision:

0. how often training tokens went which way there;
1. the same among tokens after the same token (hashed slots);
2. the most frequent follower of the two tokens before, from a table of all pairs of tokens in
   training texts, which is dealt over shards and grows with them;
3. what followed the latest equal token in the text itself.

2 and 3 predict a token, hence every decision on its way until the actual token leaves it. A
rare token has one more decision for each of them that predicts a rare token (whether it is it),
and one for whether the text has had it; which of the text's rare tokens, their shares tell.
Texts that were learnt from are scored without their own occurrence (1 and 2). A gate chooses the
weights; weights and map start as learnt from training texts and go on adapting along each text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import bitmix
from .bitmix import LEVEL_OWN, LOGIT, LOGIT_OWN, Learner, mix
from .tree import Tree

#: log2 of the slots of predictor 1.
SLOT_BITS = 21
N_PREDICTORS = 4
#: Marks the number of a rare token (23 bits of its hash); bits of a number; bits of a context within its shard.
RARE, NUMBER_BITS, CONTEXT_BITS = 1 << 23, 24, 40
#: Levels of predictors 2 and 3; stages of the way (depths below 2, below 6, others, rare ones).
RUN_LEVELS, OWN_LEVELS, STAGES = 4, 3, 4
KNOWN_LEVELS = len(bitmix.LEVELS) + 1
CLASSES = RUN_LEVELS * OWN_LEVELS
GATES = CLASSES * KNOWN_LEVELS * STAGES
#: Logit of a predicted rare token by itself; predictor 3's logits by level.
RARE_LOGIT, OWN_LOGIT = -4.0, np.array([0.0, 1.0, 4.0], np.float32)
#: Tokens of a text after which its weights and map are updated; size of that step, decisions
#: that it is shrunk by; tokens handled together; tokens of a learner's block, decisions of its step.
SEGMENT, RATE, STEP_PRIOR, TOGETHER, LEARN_BLOCK, LEARN_STEP = 256, 0.1, 64.0, 1 << 13, 1 << 12, 1 << 14
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Code(Tree):
    """The tree. ``counts`` of the common tokens by number, ``rare`` of all others together,
    whose leaf is the last."""

    def __init__(self, counts: list[int], rare: int):
        super().__init__([*counts, rare])

    def __setstate__(self, state):
        super().__setstate__(state)
        #: By place, what slots add to the context of each, mixed; the depth and the decision in one.
        self.mixed = self.hash * _ODD
        self.way = self.depth * np.int8(2) + self.bits.astype(np.int8)

    def leaf(self, number: np.ndarray) -> np.ndarray:
        return np.where(number >= RARE, self.leaves - 1, number)


def slot(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slot of predictor 1 for a mixed context at nodes (by hash)."""
    return ((context + node) * _ODD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Tokens:
    """Texts end to end: token numbers, hashes, the text of each token and its place in it.
    ``order`` numbers distinct tokens without gaps."""

    number: np.ndarray
    hash: np.ndarray
    order: np.ndarray
    doc: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, order: np.ndarray, sizes: np.ndarray, rare_hash: np.ndarray, common: int) -> Tokens:
        """``order``: a common token's number, or ``common`` + i for the i-th rare one."""
        table = np.concatenate((mix(np.arange(1, common + 1, dtype=np.uint64)), rare_hash))
        numbers = np.concatenate((np.arange(common), RARE | (rare_hash & np.uint64(RARE - 1)).astype(np.int64)))
        order = order.astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        return cls(numbers[order], table[order], order, doc, np.arange(len(order)) - (np.cumsum(sizes) - sizes)[doc])

    def back(self, values: np.ndarray, k: int, none: int) -> np.ndarray:
        """The value ``k`` tokens before, in the same text."""
        out = np.full(len(values), none, values.dtype)
        out[k:] = np.where(self.at[k:] >= k, values[:-k], none)
        return out

    def pair_context(self, shard_bits: int) -> np.ndarray:
        """Hash of the two tokens before: the shard above CONTEXT_BITS bits."""
        h = mix(self.back(self.hash, 1, 0) + _ODD * mix(self.back(self.hash, 2, 0) + np.uint64(1)))
        return h & np.uint64((1 << (CONTEXT_BITS + shard_bits)) - 1)

    def slot_context(self) -> np.ndarray:
        """What predictor 1 hashes: the token before; rare ones alike."""
        return mix(self.back(np.where(self.number >= RARE, np.uint64(3), self.hash), 1, 1) + np.uint64(11))

    def _equal_before(self, some: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among ``some`` whose value occurs before in the same text, and where last."""
        n, bits = len(some), max(1, int(len(some)).bit_length())
        high = int(values.max(initial=0)).bit_length()
        if n and int(self.doc[some[-1]]).bit_length() + high + bits < 64:
            key = np.sort((self.doc[some] << high | values) << bits | np.arange(n))
            place, group = key & ((1 << bits) - 1), key >> bits
        else:
            place = np.lexsort((np.arange(n), values, self.doc[some]))
            new = np.concatenate(([False], (np.diff(values[place]) != 0) | (np.diff(self.doc[some][place]) != 0))) if n else np.zeros(0, bool)
            group = np.cumsum(new)
        same = group[1:] == group[:-1]
        return place[1:][same], place[:-1][same]

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """What followed the latest equal token before in the text (-1: none), and the level:
        1, or 2 where the token before it agrees too."""
        followed = np.flatnonzero(self.at > 0)
        here, there = self._equal_before(followed, self.order[followed - 1])
        here, there = followed[here], followed[there]
        two = self.back(self.order, 2, -1)
        found, level = np.full(len(self.number), -1), np.zeros(len(self.number), np.int8)
        found[here] = self.number[there]
        level[here] = 1 + (two[here] == two[there])
        return found, level

    def again(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rare tokens, of the text's rare tokens before: how many, how many equal to this
        one, how many that were repeats (0 for other tokens)."""
        out = np.zeros((3, len(self.number)), np.int64)
        rare = np.flatnonzero(self.number >= RARE)
        if len(rare):
            start = np.searchsorted(self.doc[rare], self.doc[rare])
            out[0, rare] = np.arange(len(rare)) - start
            here, there = self._equal_before(rare, self.order[rare])
            equal = np.zeros(len(rare), np.int64)
            if len(here):  # runs of one token: each repeat is one more than the one before
                first = np.concatenate(([True], there[1:] != here[:-1]))
                at = np.arange(len(here))
                equal[here] = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
            out[1, rare] = equal
            repeats = np.cumsum(equal > 0) - (equal > 0)
            out[2, rare] = repeats - repeats[start]
        return tuple(out)


def places_of(context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of contexts, in it whether a context is new, and each token's place in the
    distinct contexts."""
    order = np.argsort(context)
    c = context[order]
    new = np.ones(len(c), bool)
    np.not_equal(c[1:], c[:-1], out=new[1:])
    place = np.empty(len(c), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, new, place


def rows_of(context: np.ndarray, number: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (context, number) in the order of contexts with their training occurrences, and
    each token's place in the distinct contexts."""
    if not len(context):
        return context, number, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, new_c, place = places_of(context)
    # the numbers of a context in order, where it has more than one token
    many = np.flatnonzero(~(new_c & np.append(new_c[1:], True)))
    rows = order[many]
    order[many] = rows[np.argsort(place[rows] << NUMBER_BITS | number[rows])]
    c, t = context[order], number[order]
    first = np.flatnonzero(new_c | np.concatenate(([True], t[1:] != t[:-1])))
    return c[first], t[first], np.add.reduceat(train[order].astype(np.int64), first), place


#: The best two followers of a context and its total (scaled below 256 together).
FOLLOWERS = np.dtype([("at", "<u4"), ("first", "<u4"), ("second", "<u4"), ("n1", "u1"), ("n2", "u1"), ("total", "u1")])


def followers(context: np.ndarray, number: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From rows in the order of contexts (repeats of a row allowed): distinct contexts, their
    FOLLOWERS (``at`` unset) and totals. Rows without occurrences count for nothing. Ties: the
    smaller number."""
    some = n > 0
    context, number, n = context[some], number[some], n[some]
    if not len(n):
        return context, np.zeros(0, FOLLOWERS), n
    new = np.concatenate(([True], context[1:] != context[:-1]))
    start = np.flatnonzero(new)
    total = np.add.reduceat(n, start)
    out = np.zeros(len(start), FOLLOWERS)
    out["first"], out["n1"], out["total"] = number[start], bitmix.below_256(n[start], total), bitmix.below_256(total, total)
    # contexts of several rows: add up equal ones, then by count
    many = np.flatnonzero(~(new & np.append(new[1:], True)))
    if len(many):
        place, number, n = (np.cumsum(new) - 1)[many], number[many], n[many]
        key = place << NUMBER_BITS | number
        order = np.argsort(key)
        key, n = key[order], n[order]
        one = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, n = key[one], np.add.reduceat(n, one)
        place, lowest = key >> NUMBER_BITS, (1 << NUMBER_BITS) - 1
        # the most frequent is the greatest of these, the second the greatest of the others
        rank = n << NUMBER_BITS | (~key & lowest)
        new = np.concatenate(([True], place[1:] != place[:-1]))
        a = np.flatnonzero(new)
        at, best = place[a], np.maximum.reduceat(rank, a)
        rank[rank == best[np.cumsum(new) - 1]] = 0
        next_best = np.maximum.reduceat(rank, a)
        out["first"][at], out["n1"][at] = ~best & lowest, bitmix.below_256(best >> NUMBER_BITS, total[at])
        out["second"][at], out["n2"][at] = np.where(next_best > 0, ~next_best & lowest, 0), bitmix.below_256(next_best >> NUMBER_BITS, total[at])
    return context[start], out, total


def run_of(table: np.ndarray, place: np.ndarray, number: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From FOLLOWERS, at each token's place: the predicted number (-1: none), the logit, the
    level; for training texts without the token itself."""
    first, second, n1, n2, total = (np.ascontiguousarray(table[k]).take(place) for k in ("first", "second", "n1", "n2", "total"))
    n1, n2, total = (v.astype(np.int16) for v in (n1, n2, total))
    less = train & (total < 255) & (total > 0)
    n1, n2 = n1 - (less & (number == first)), n2 - (less & (number == second) & (n2 > 0))
    total = total - less
    swap = n1 < n2
    n = np.where(swap, n2, n1)
    told = (n > 0) & (total > 0)
    logit = LOGIT.take(np.clip(total - n, 0, 255).astype(np.int64) << 8 | np.clip(n, 0, 255))
    level = told * (np.int8(1) + (total > 1) + ((total > 1) & (n * 10 >= total * 9)))
    return np.where(told, np.where(swap, second, first).astype(np.int64), -1), logit, level.astype(np.int8)


@dataclass
class Features:
    """All that decisions of a chunk's tokens need."""

    number: np.ndarray
    train: np.ndarray
    context: np.ndarray
    run: tuple[np.ndarray, np.ndarray, np.ndarray]
    own: tuple[np.ndarray, np.ndarray]
    again: tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Decisions:
    """``length``: decisions on the way of each token asked for, which come first; ``asked``: the
    tokens (by index) of the others; ``y``: 0 or 1; ``x``: predictors by decisions."""

    length: np.ndarray
    asked: np.ndarray
    y: np.ndarray
    x: np.ndarray
    gate: np.ndarray
    cls: np.ndarray

    def each(self, values: np.ndarray) -> np.ndarray:
        """Values of tokens, by decision."""
        return np.concatenate((np.repeat(values, self.length), values[self.asked]))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of its decisions' values for each token."""
        size = len(values) - len(self.asked)
        out = np.add.reduceat(values[:size], np.cumsum(self.length) - self.length, dtype=np.float64)
        return out + np.bincount(self.asked, values[size:], len(out)) if len(self.asked) else out


def decisions(code: Code, states: np.ndarray, f: Features, some: np.ndarray) -> tuple[Decisions, np.ndarray]:
    """Decisions of the tokens ``some`` (one at least), in their order, and for those that they
    name in full what is left to add to their logs (others: not a number)."""
    number = f.number[some]
    leaf, rare = code.leaf(number), number >= RARE
    run, run_logit, run_level = (v[some] for v in f.run)
    own, own_level = (v[some] for v in f.own)
    own_logit = OWN_LOGIT[own_level]

    # rare tokens: is it the one that 2 predicts, is it the one that 3 predicts, has the text had it
    ask_run = np.flatnonzero(rare & (run >= RARE))
    hit = np.zeros(len(some), bool)
    hit[ask_run] = run[ask_run] == number[ask_run]
    ask_own = np.flatnonzero(rare & (own >= RARE) & (own != run) & ~hit)
    hit_own = own[ask_own] == number[ask_own]
    y_run = hit[ask_run]
    hit[ask_own] = hit_own
    before, equal, repeats = (v[some] for v in f.again)
    ask_again = np.flatnonzero(rare & ~hit & (before > 0))
    had, n = equal[ask_again] > 0, before[ask_again]
    left = np.where(rare & ~hit, np.nan, 0.0)
    left[ask_again[had]] = np.log10(equal[ask_again[had]] / n[had])

    # values of tokens are repeated along their ways, in small types: no index by decision
    length, place = code.ways(leaf)
    asked = np.concatenate((ask_run, ask_own, ask_again))
    size, a, b, end = (len(place) + k for k in (0, len(ask_run), len(ask_run) + len(ask_own), len(asked)))
    y, x = np.empty(end, np.int8), np.zeros((N_PREDICTORS, end), np.float32)
    way = code.way.take(place)
    np.bitwise_and(way, np.int8(1), out=y[:size])
    y[size:] = np.concatenate((y_run, hit_own, had))
    code.logit.take(place, out=x[0, :size], mode="clip")
    h = np.repeat(f.context[some] * _ODD, length)  # as slot has it, multiplied once a token
    h += code.mixed.take(place)
    h >>= np.uint64(64 - SLOT_BITS)
    s = states.take(h.view(np.int64)).astype(np.int64)
    s += np.repeat(np.where(f.train[some], 1 << 16, 0), length) * (y[:size] + np.int8(1))
    LOGIT_OWN.take(s, out=x[1, :size], mode="clip")
    depth, sign = way >> np.int8(1), y[:size] * np.int8(2) - np.int8(1)
    within = LEVEL_OWN.take(s) * np.int8(STAGES) + (depth >= 2) + (depth >= 6)
    cls = np.zeros(end, np.int8)
    for k, (told, logit, level, unit) in enumerate(((run, run_logit, run_level, OWN_LEVELS), (own, own_logit, own_level, 1))):
        alike = np.full(len(some), -1, np.int8)
        some_told = np.flatnonzero(told >= 0)
        alike[some_told] = code.shared(leaf[some_told], code.leaf(told[some_told]))
        alike = np.repeat(alike, length)
        on = (depth <= alike).view(np.int8)
        np.multiply(np.repeat(logit, length), (on - (depth == alike).view(np.int8) * np.int8(2)) * sign, out=x[2 + k, :size])
        cls[:size] += np.repeat((level * unit).astype(np.int8), length) * on

    x[0, size:b] = RARE_LOGIT
    agree = own[ask_run] == run[ask_run]
    x[2, size:a], x[3, size:a] = run_logit[ask_run], np.where(agree, own_logit[ask_run], 0)
    cls[size:a] = run_level[ask_run].astype(np.int64) * OWN_LEVELS + np.where(agree, own_level[ask_run], 0)
    x[3, a:b], cls[a:b] = own_logit[ask_own], own_level[ask_own]
    x[0, b:] = np.log((repeats[ask_again] + 0.3) / (n - repeats[ask_again] + 1.0))
    gate = cls * np.int16(KNOWN_LEVELS * STAGES)
    gate[:size] += within
    gate[size:] += STAGES - 1
    gate[b:] += ((np.searchsorted([4, 32], n, side="right") + 1) * STAGES).astype(np.int16)
    return Decisions(length, asked, y, x, gate.astype(np.int64), cls.astype(np.int64)), left


def first_weights() -> np.ndarray:
    return np.repeat(np.array([[0.6], [0.35], [0.5], [0.3], [0.0]]), GATES, 1)


@dataclass
class Mixer:
    """Tree, states of predictor 1, weights and map to start a text with."""

    code: Code
    states: np.ndarray
    weights: np.ndarray
    map: np.ndarray

    def learnt(self, f: Features, tokens: np.ndarray) -> Learner:
        """An online pass over tokens, one text after the other; the map from its second half."""
        learner = Learner(self.weights, CLASSES)
        for a in range(0, len(tokens), LEARN_BLOCK):
            d, _ = decisions(self.code, self.states, f, tokens[a : a + LEARN_BLOCK])
            for i in range(0, len(d.y), LEARN_STEP):
                z = slice(i, i + LEARN_STEP)
                learner.step(d.x[:, z], d.gate[z], d.cls[z], d.y[z], 2 * a >= len(tokens) - LEARN_BLOCK)
        return learner

    def log10(self, f: Features, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every token log10 of its probability as far as decisions tell it, and whether they
        name it in full; texts are handled together, their segments in turn."""
        out, named = np.zeros(len(f.number)), np.zeros(len(f.number), bool)
        starts = np.cumsum(sizes) - sizes
        by_size = np.argsort(-sizes, kind="stable")
        load = np.cumsum(np.minimum(sizes[by_size], SEGMENT)) // TOGETHER
        for g in range(int(load[-1]) + 1 if len(load) else 0):
            docs = by_size[load == g]  # the longest first: those that go on are always the first ones
            n = int((sizes[docs] > SEGMENT).sum())
            w = np.tile(self.weights, n)  # a text's gates lie side by side
            m = np.tile(self.map, (n, 1))
            seen = np.full(m.shape, bitmix.MAP_PRIOR)
            for r in range(0, int(sizes[docs].max(initial=0)), SEGMENT):
                live, on = (int((sizes[docs] > k).sum()) for k in (r, r + SEGMENT))
                for a, b in ((0, on), (on, live)):  # those that go on learn, those that end do not
                    if a == b:
                        continue
                    part = np.minimum(sizes[docs[a:b]] - r, SEGMENT)
                    tokens = np.arange(part.sum()) + np.repeat(starts[docs[a:b]] + r - np.cumsum(part) + part, part)
                    d, left = decisions(self.code, self.states, f, tokens)
                    doc = d.each(np.repeat(np.arange(a, b), part)) if r or on > a else None
                    gate, cls = (d.gate, d.cls) if doc is None else (doc * GATES + d.gate, doc * CLASSES + d.cls)
                    z = bitmix.mixed(w, gate, d.x) if r else bitmix.mixed(self.weights, d.gate, d.x)
                    cell = bitmix.bucket(z)
                    mapped = m.take(cls * bitmix.MAP_BUCKETS + cell) if r else self.map.take(d.cls * bitmix.MAP_BUCKETS + cell)
                    direct = bitmix.sigmoid(z)
                    # of a zero, what is left to one
                    p = bitmix.refined(*(np.abs(v - (1 - d.y).astype(np.float32)) for v in (direct, mapped)))
                    out[tokens] = d.sums(np.log(p)) / np.log(10) + np.nan_to_num(left)
                    named[tokens] = ~np.isnan(left)
                    if on > a:
                        _update(w[:, : on * GATES], m[: on * CLASSES], seen[: on * CLASSES], d, gate, cls, d.y - direct, cell)
        return out, named


def _update(w: np.ndarray, m: np.ndarray, seen: np.ndarray, d: Decisions, gate: np.ndarray, cls: np.ndarray, error: np.ndarray, cell: np.ndarray) -> None:
    """Moves the weights of texts one step by a segment's errors, and their maps' means."""
    count = np.bincount(gate, minlength=w.shape[1]) + STEP_PRIOR
    for k in range(N_PREDICTORS + 1):
        w[k] += RATE * np.bincount(gate, error * d.x[k] if k < N_PREDICTORS else error, w.shape[1]) / count
    at = cls * bitmix.MAP_BUCKETS + cell
    before = seen.copy()
    seen += np.bincount(at, minlength=seen.size).reshape(seen.shape)
    m[:] = (m * before + np.bincount(at, d.y, seen.size).reshape(seen.shape)) / seen
