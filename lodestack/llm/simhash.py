"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link at ``max_bits`` or fewer differing bits. The 64 bits are cut into fewer
segments than errors, so that of two linked fingerprints one segment differs in at most one bit.
Each segment is indexed once per position with that bit deleted; equal signatures meet, and the
whole fingerprints are verified. A pair is reported only at the first signature it shares; a
bucket of many fingerprints reports a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, text_or_empty
from .components import connected_components

SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15
#: Buckets of more fingerprints than this report spanning links only.
PAIRWISE = 48


def text_fingerprint(text: bytes, shingle: int = 4) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        hashes = iter([digest(joined, SEED)])
        n = 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True))
    votes = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        block = np.fromiter(hashes, np.uint64, min(BLOCK, n - at)).astype(">u8")
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The fingerprint as a signed long; null or wordless text: 0."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        out = np.fromiter((text_fingerprint(x.as_buffer().to_pybytes(), shingle) if x.is_valid else 0 for x in texts.cast(pa.binary())), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return of(text)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """As few segments as leave one with at most one differing bit."""
    n = max_bits // 2 + 1
    return [(64 * i // n, 64 * (i + 1) // n) for i in range(n)]


def signatures(fp: Column, max_bits: int) -> Column:
    """64 signatures: for every bit, its segment without it, marked by the bit's number."""
    out = []
    for lo, hi in segments(max_bits):
        for w in range(lo, hi):
            mask = ((1 << hi) - (1 << lo)) & ~(1 << w)
            signed = mask - (1 << 64) if mask >> 63 else mask
            # the segment moves down to bit 0; the mark goes above its at most 32 + 1 bits
            out.append(F.shiftrightunsigned(fp.bitwiseAND(F.lit(signed)), lo).bitwiseOR(F.lit(w << 40)) if hi - lo <= 40 else F.xxhash64(F.lit(w), fp.bitwiseAND(F.lit(signed))))
    return F.array(*out)


def _first_shared(diff: np.ndarray, max_bits: int) -> np.ndarray:
    """The number of the first signature that fingerprints with this XOR share."""
    out = np.full(len(diff), -1, np.int64)
    for lo, hi in reversed(segments(max_bits)):
        part = diff & np.uint64((1 << hi) - (1 << lo))
        count = np.bitwise_count(part)
        low = np.bitwise_count((part & (~part + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        out = np.where(count == 0, lo, np.where(count == 1, low, out))
    return out


def spanning_links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components as all links among ``fps``: breadth first, each
    fingerprint compared only with those not reached yet."""
    a, b, rest = [], [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                got = rest[near]
                a.append(np.full(len(got), x, np.uint64))
                b.append(got)
                front += list(got)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _links(sig: np.ndarray, fp: np.ndarray, marks: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal signatures."""
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(sig)])))
    for s, n in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist(), strict=True):
        yield spanning_links(np.unique(fp[s : s + n]), max_bits)
    keep = np.repeat((sizes > 1) & (sizes <= PAIRWISE), sizes)
    sig, fp, marks = sig[keep], fp[keep], marks[keep]
    for k in range(1, PAIRWISE):
        at = np.flatnonzero(sig[k:] == sig[:-k])
        if not len(at):
            break
        diff = fp[at] ^ fp[at + k]
        ok = np.bitwise_count(diff) <= max_bits
        at, diff = at[ok], diff[ok]
        ok = _first_shared(diff, max_bits) == marks[at]
        yield fp[at[ok]], fp[at[ok] + k]


def _linker(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(sig, fp, marks):
            for a, b in _links(sig, fp, marks, max_bits):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = tuple(np.concatenate(x) for x in zip(held, (new[0], new[1].view(np.uint64), new[2].astype(np.int64)), strict=True))
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on
            if last:
                yield from emit(*(x[:last] for x in held))
                held = tuple(x[last:] for x in held)
        if len(held[0]):
            yield from emit(*held)

    return run


def link_fingerprints(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``fps``: distinct longs ``fp``. Returns links ``a``, ``b`` with the components of all
    pairs at ``max_bits`` or fewer differing bits."""
    sig = fps.select("fp", F.posexplode(signatures(F.col("fp"), max_bits)).alias("mark", "sig"))
    dealt = sig.select("sig", "fp", "mark").repartition("sig").sortWithinPartitions("sig", "fp")
    return dealt.mapInArrow(_linker(max_bits), "a long, b long")


def components(docs: DataFrame, max_bits: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns id, ``fingerprint`` (16 hex digits), ``component_id`` and the columns in ``keep``.

    Rows with equal fingerprints are one class and stand for one node. Null and wordless texts
    have fingerprint zero and are linked like any other. A null id is skipped as a component's
    smallest id (and is the component only where no other id is there); repeated rows share
    their component; an empty table gives an empty result; other columns, whatever their names,
    are ignored. Whole texts of any length, whose bits are counted in blocks of shingles.
    """
    bound_batches(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprint(text_or_empty(text_col), shingle).alias("fp"), *[F.col(c).alias(f"keep_{c}") for c in keep]), "fingerprints")
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    roots = cut(connected_components(link_fingerprints(classes.select("fp"), max_bits)), "roots")
    shared = classes.join(roots, classes.fp == roots.node, "left").where("n > 1 OR root IS NOT NULL").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    shared = shared.join(shared.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    out = rows.join(shared, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "id").alias("component_id"), *[F.col(f"keep_{c}").alias(c) for c in keep])


def keep_one(docs: DataFrame, max_bits: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near-duplicates, with all its columns: the one with the
    smallest id (nulls last), then the shorter text, its hash, and of rows that agree in all
    that, any one. Null and wordless texts are one component. An empty table stays empty;
    columns may have any names; texts may be of any length.

    Fingerprints are taken once; what a fingerprint's rows offer is a minimum that is combined
    before it is shuffled, so no task holds a group of copies.
    """
    bound_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = cut(docs.select(F.monotonically_increasing_id().alias("rid"), fingerprint(text_or_empty(text_col), shingle).alias("fp"), row), "fingerprints")
    key, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    best = F.min(F.struct(key.isNull().alias("none"), key.alias("id"), F.length(text).alias("n"), F.xxhash64(text).alias("h"), F.col("rid"))).alias("best")
    classes = cut(rows.groupBy("fp").agg(best), "classes")
    roots = cut(connected_components(link_fingerprints(classes.select("fp"), max_bits)), "roots")
    chosen = classes.join(roots, classes.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    return rows.join(chosen.select(F.col("best.rid").alias("rid")), "rid", "left_semi").select("row.*")
