"""Sharding: minimax contiguous partition (DataFrame operations only).

Equal texts form one atomic group. Groups are ordered by a 64-bit hash of the text; a
contiguous run of groups becomes a shard. The smallest shard capacity for which ``n_shards``
runs suffice is found by binary search, each capacity being checked greedily. The driver never
holds the groups: it holds a histogram of the hash range with a fixed number of bins and refines
only the bins in which some cut may fall, until the capacity is exact. The cuts are then placed
under that capacity, each as near as possible to an equal share of what remains.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, text_or_empty, utf8_len

#: Histogram bins per requested shard at the first level (a power of two is taken).
BINS_PER_SHARD = 1024
#: Bits by which a bin is split when a cut may fall into it.
REFINE_BITS = 6
#: Bytes that a row counts beside its text.
ROW_BYTES = 8


class _Leaves:
    """Consecutive hash ranges: first hash, shift, bytes, groups."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)
        self.prefix = [0]
        for _, _, size, _ in self.rows:
            self.prefix.append(self.prefix[-1] + size)
        self.total = self.prefix[-1]

    def atomic(self, i: int) -> bool:
        return self.rows[i][3] <= 1 or self.rows[i][1] == 0

    def whole(self, capacity: int, shards: int) -> list[int]:
        """Greedy ends (leaf positions) when leaves are never split: an achievable partition."""
        at, ends = 0, []
        for _ in range(shards):
            at = bisect_right(self.prefix, self.prefix[at] + capacity) - 1
            ends.append(at)
        return ends

    def split(self, capacity: int, shards: int) -> list[int]:
        """Greedy ends (bytes) when a leaf of several groups may be cut anywhere: a bound."""
        at, ends = 0, []
        for _ in range(shards):
            at = min(at + capacity, self.total)
            i = bisect_right(self.prefix, at) - 1
            if i < len(self.rows) and self.prefix[i] < at and self.atomic(i):
                at = max(self.prefix[i], ends[-1] if ends else 0)
            ends.append(at)
        return ends

    def smallest(self, shards: int, whole: bool) -> int:
        lo, hi = -(-self.total // shards), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            done = self.whole(mid, shards)[-1] == len(self.rows) if whole else self.split(mid, shards)[-1] >= self.total
            lo, hi = (lo, mid) if done else (mid + 1, hi)
        return lo

    def open_leaves(self, lo: int, hi: int, shards: int) -> set[int]:
        """Leaves of several groups in which a cut may fall for a capacity from lo to hi."""
        out: set[int] = set()
        for first, last in zip(self.whole(lo, shards), self.split(hi, shards), strict=True):
            for i in range(first, min(len(self.rows), bisect_left(self.prefix, last) + 1)):
                if not self.atomic(i):
                    out.add(i)
        return out

    def balanced(self, capacity: int, shards: int) -> list[int]:
        """Ends under the capacity, each nearest to an equal share of the rest."""
        at, ends, n = 0, [], len(self.rows)
        for left in range(shards, 0, -1):
            if left == 1:
                ends.append(n)
                break
            most = bisect_right(self.prefix, self.prefix[at] + capacity) - 1
            want = self.prefix[at] + (self.total - self.prefix[at]) / left
            near = bisect_left(self.prefix, want)
            if near > at and want - self.prefix[near - 1] < self.prefix[min(near, n)] - want:
                near -= 1
            near = max(min(near, most), min(at + 1, most))
            if not self._fits(near, capacity, left - 1):
                near = most
            at = near
            ends.append(at)
        return ends

    def _fits(self, at: int, capacity: int, shards: int) -> bool:
        for _ in range(shards):
            at = bisect_right(self.prefix, self.prefix[at] + capacity) - 1
        return at == len(self.rows)


def _histogram(groups: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
    rows = groups.groupBy(F.shiftright("h", shift).alias("b")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    return [(r["b"] << shift, shift, r["bytes"], r["n"]) for r in rows]


def plan_cuts(groups: DataFrame, n_shards: int, bins_per_shard: int = BINS_PER_SHARD) -> tuple[int, list[int | None]]:
    """Smallest feasible capacity, and for shards 1.. the first hash (None: empty shard).

    ``groups`` has one row per atomic group: ``h`` long, ``bytes`` long. What reaches the
    driver is bounded by ``n_shards * bins_per_shard`` and the bins refined around cuts.
    """
    shift = max(0, 64 - (n_shards * bins_per_shard - 1).bit_length())
    leaves = _Leaves(_histogram(groups, shift))
    if not leaves.rows:
        return 0, [None] * (n_shards - 1)
    while True:
        lo, hi = leaves.smallest(n_shards, whole=False), leaves.smallest(n_shards, whole=True)
        refine = leaves.open_leaves(lo, hi, n_shards) if lo < hi else set()
        if not refine:
            break
        rows = [r for i, r in enumerate(leaves.rows) if i not in refine]
        for s in {leaves.rows[i][1] for i in refine}:
            bins = [leaves.rows[i][0] >> s for i in refine if leaves.rows[i][1] == s]
            part = groups.where(F.shiftright("h", s).isin(bins))
            rows += _histogram(part, max(0, s - REFINE_BITS))
        leaves = _Leaves(rows)
    ends = leaves.balanced(hi, n_shards)
    return hi, [leaves.rows[e][0] if e < len(leaves.rows) else None for e in ends[:-1]]


def number_within(df: DataFrame, key: str, order: list[str | Column], out: str) -> DataFrame:
    """Gapless numbers from 0 within each ``key``, without one task per key: rows are dealt
    by range, counted per range, and the counts (one row per range and key) are broadcast."""
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ranged = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = cut(ranged, "ranged")
    runs = ranged.groupBy("__part", key).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    found = ranged.join(F.broadcast(runs), ["__part", key])
    return found.withColumn(out, F.col("__at") - F.col("__first") + F.col("__before")).drop("__part", "__at", "__first", "__before")


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``n_shards`` shards of near-equal bytes.

    Returns id, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``law`` ("bytes"), ``shard``,
    ``slot`` (gapless from 0 within the shard), ``grown_shard`` (null under this law).
    A null text counts as empty (size 8, crc32 0) and shares the empty text's group; repeated
    rows keep their own slots; a null id sorts first; an empty table gives an empty result;
    other columns are ignored. A group larger than an equal share makes its shard larger:
    equal texts are never separated.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = text_or_empty(text_col)
    base = cut(docs.select(F.col(id_col).alias("id"), (utf8_len(text) + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h")), "rows")
    groups = cut(base.groupBy("h").agg(F.sum("size").alias("bytes")), "groups")
    _, firsts = plan_cuts(groups, n_shards)
    discard(groups)
    bounds = F.array(*[F.lit(f) for f in firsts if f is not None]).cast("array<bigint>")
    number = F.size(F.filter(bounds, lambda first: first <= F.col("h")))
    placed = number_within(base.withColumn("shard", number.cast("int")), "shard", ["h", "id", "size"], "slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
