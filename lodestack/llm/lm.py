"""LM scoring by online logistic context mixing.

A text is its tokens: lower-cased words, then one end. :mod:`.lm_model` turns tokens into binary
decisions and mixes hashed contexts that reach over the tokens before; a rare token that no
context names is chosen by its count among the rare ones, or, where training texts do not have
it, spelled by :mod:`.spelling`. The sum of the decisions' logs is the text's probability.

What is gathered grows with the input: the vocabulary, with a count for every token, and the
followers of every pair of tokens. Neither is held in one place. Texts are cut into chunks; a
chunk's distinct (pair, follower) rows go to shards by the pair's hash, a shard answers each
chunk with the best followers of its pairs, a join answers its rare tokens, and the answers meet
the chunk again. Before they travel, rows of a chunk are added up, so a hot pair has at most one
row a chunk for each of its followers. Bounded by parameters are the tree of common tokens, the
two slot tables and the spelling slots, which are broadcast, and the mixing weights, which are
learnt in parallel on the training texts of all chunks and averaged.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmix, lm_model, spelling
from .bitmix import packed, unpacked
from .common import bound_batches, cut, discard, fold_bucket, new_path, write
from .lm_model import CONTEXT_BITS, FOLLOWERS, Code, Features, Mixer, Tokens

#: Most frequent training tokens that are leaves of the tree, and how often they occur at least.
COMMON, LEAST = 1 << 16, 8
#: Tokens of a chunk (a longer text is one by itself); tokens that a shard answers for.
CHUNK, SHARD = 3 << 18, 1 << 20
#: Parts in which shards answer, one after the other, which bounds what is in a shuffle.
PARTS = 4
#: Parts in which chunks are scored, for the same reason.
SCORE_PARTS = 2
#: Bits of a rare token's hash.
RARE_BITS = 40
#: Tokens that a counting task holds, those of a batch once.
HELD = 400_000
#: The end token, as no word can be empty.
END = b""


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, lower-cased, and how many each text has (null: none)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten().view(pa.binary()), lists.value_lengths().to_numpy().astype(np.int64)
    some = pc.greater(pc.binary_length(words), 0)
    empty = ~some.to_numpy(zero_copy_only=False)  # before and after white space at a text's ends
    if empty.any():
        words, sizes = words.filter(some), sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
    return words, sizes


def _out(names: str, *columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names.split())


def _body(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes()


# ---- the vocabulary


def count_tokens(docs: DataFrame) -> DataFrame:
    """``docs``: ``train`` boolean, ``text``. Every distinct token with its occurrences in
    training texts (``c``) and in all (``n``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        ends = [0, 0]

        def flush():
            words, c, n = zip(*held, strict=True)
            every = pa.concat_arrays(words).dictionary_encode()
            at = every.indices.to_numpy()
            sums = (np.bincount(at, np.concatenate(v), len(every.dictionary)).astype(np.int64) for v in (c, n))
            held.clear()
            return pa.RecordBatch.from_arrays([every.dictionary, *map(pa.array, sums)], ["word", "c", "n"])

        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False)
            ends[0] += int(train.sum())
            ends[1] += len(train)
            words, sizes = words_of(batch.column(1))
            coded = words.dictionary_encode()
            at, distinct = coded.indices.to_numpy(), len(coded.dictionary)
            held.append((coded.dictionary, np.bincount(at[np.repeat(train, sizes)], minlength=distinct), np.bincount(at, minlength=distinct)))
            if sum(len(h[0]) for h in held) > HELD:
                yield flush()
        held.append((pa.array([END], pa.binary()), *(np.array([k]) for k in ends)))
        yield flush()

    parts = docs.select("train", "text").mapInArrow(run, "word binary, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The common tokens by number with their counts; of the rare ones, the sum of counts and how
    many occur once. ``n``, ``v``: all training tokens, distinct ones; ``every``: tokens of all
    texts."""

    words: list[bytes]
    counts: list[int]
    rare: int
    once: int
    n: int
    v: int
    every: int

    @property
    def unknown(self) -> float:
        """Probability that a rare token is an unknown one: the share of rare occurrences whose
        token no other occurrence has."""
        return (self.once + 0.5) / (self.rare + 1)


def split(table: DataFrame, common: int = COMMON, least: int = LEAST) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary's summary and the rows of its rare tokens (``c`` is 0 for unknown ones)."""
    known = table.where((F.col("c") >= least) & (F.octet_length("word") > 0))
    top = known.orderBy(F.desc("c"), "word").limit(common - 1).collect()
    rare = table.where(F.octet_length("word") > 0)
    if top:
        last = F.lit(top[-1]["c"]), F.lit(bytes(top[-1]["word"]))
        rare = rare.where((F.col("c") < last[0]) | ((F.col("c") == last[0]) & (F.col("word") > last[1])))
    a = table.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum("n").alias("every")).first()
    b = rare.agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).first()
    ends = table.where(F.octet_length("word") == 0).first()
    words = [END, *(bytes(r["word"]) for r in top)]
    counts = [ends["c"] if ends else 0, *(r["c"] for r in top)]
    return Vocabulary(words, counts, b["c"] or 0, b["once"] or 0, a["n"] or 0, a["v"] or 0, a["every"] or 0), rare


def spelled(rare: DataFrame) -> DataFrame:
    """``rare`` with ``lm``: log10 of the spelling, of tokens that can be unknown to a text that
    is scored: no training text has them, or one alone, which then does without."""
    speller = rare.sparkSession.sparkContext.broadcast(spelling.fit(rare.where("c > 0")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(1).to_numpy()
            asked = np.flatnonzero(c <= 1)
            logs = np.zeros(len(c))
            words = [_body(b.column(0)[i]) for i in asked.tolist()]
            logs[asked] = speller.value.log10(words, c[asked] == 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(logs, pa.float32())], ["word", "c", "lm"])

    return rare.select("word", "c").mapInArrow(run, "word binary, c long, lm float")


# ---- chunks


def shard_bits(tokens: int) -> int:
    return max(0, int(np.ceil(np.log2(max(tokens, 1) / SHARD))))


#: Rows of a prepared chunk: itself (kind 0, ``body``, ``rare``), its rows for a shard (kind 1:
#: ``at`` the shard, ``part`` its part, ``base`` the place of its first pair) and slots of its task (kind 2: ``at`` the slice).
_PREPARED = "kind int, part int, chunk long, at int, base long, body binary, rare array<binary>"


def _prepared(kind: int, chunk: int | None, at: int, base: int, body: bytes, rare: list[bytes]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
    return _out("kind part chunk at base body rare", *(([v], k) for v, k in zip((kind, at % PARTS if kind == 1 else 0, chunk, at, base, body, rare), kinds, strict=True)))


def _gaps(values: np.ndarray) -> np.ndarray:
    """Sorted values as differences, in four bytes each where they fit."""
    gaps = np.diff(values, prepend=np.uint64(0))
    return gaps.astype(np.uint32) if int(gaps.max(initial=0)) < 1 << 32 else gaps


def shard_rows(tokens: Tokens, train: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """A chunk's rows for each shard: the shard, the place of its first pair, the rows."""
    context, number, n, _ = lm_model.rows_of(tokens.pair_context(bits), tokens.number, train)
    place = np.cumsum(np.concatenate(([0], context[1:] != context[:-1]))) if len(context) else context
    shard = (context >> np.uint64(CONTEXT_BITS)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))).tolist() if len(shard) else []
    for a, b in zip(edges, [*edges[1:], len(shard)], strict=True):
        rest = context[a:b] & np.uint64((1 << CONTEXT_BITS) - 1)
        three = number[a:b].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        small = n[a:b].astype(np.uint8 if n[a:b].max() < 256 else np.uint32)
        yield int(shard[a]), int(place[a]), packed(_gaps(rest), np.ascontiguousarray(three), small)


def _rows(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gaps, three, n = unpacked(body)
    number = np.zeros((len(three), 4), np.uint8)
    number[:, :3] = three
    return np.cumsum(gaps, dtype=np.uint64), number.view("<u4").ravel().astype(np.int64), n.astype(np.int64)


def answered(bodies: list[bytes], bases: list[int]) -> list[bytes]:
    """A shard's answer to the rows of each chunk: FOLLOWERS of the pairs of which other chunks
    have more than the chunk itself."""
    rows = [_rows(b) for b in bodies]
    context, number, n = (np.concatenate([r[i] for r in rows]) for i in range(3))
    order = np.argsort(context)
    ranked = context[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(np.concatenate(([True], ranked[1:] != ranked[:-1]))) - 1
    known, best, total = lm_model.followers(ranked, number[order], n[order])
    distinct = ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))]
    at = np.searchsorted(distinct, known)
    every, answer = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), FOLLOWERS)
    every[at], answer[at] = total, best
    out, start = [], 0
    for (context, _, n), base in zip(rows, bases, strict=True):
        new = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        here = place[start : start + len(n)][new]
        more = np.flatnonzero(every[here] > np.add.reduceat(n, new))
        reply = answer[here[more]]
        reply["at"] = more + base
        out.append(packed(reply))
        start += len(n)
    return out


def features(order: np.ndarray, sizes: np.ndarray, train_docs: np.ndarray, rare_hash: np.ndarray, replies: np.ndarray, code: Code, bits: int) -> tuple[Features, Tokens]:
    """Features of a chunk: its own rows, where a shard does not know more, are the table's."""
    tokens = Tokens.of(order, sizes, rare_hash, code.leaves - 1)
    train = train_docs[tokens.doc]
    order, new, place = lm_model.places_of(tokens.pair_context(bits))
    table = np.zeros(int(place.max(initial=-1)) + 1, FOLLOWERS)
    # where a training token is alone with its context, none is left without it
    some = order[~(new & np.append(new[1:], True))] if len(order) else order
    some = some[train[some]]
    known, best, _ = lm_model.followers(place[some], tokens.number[some], np.ones(len(some), np.int64))
    table[known] = best
    table[replies["at"].astype(np.int64)] = replies
    return Features(tokens.number, train, tokens.slot_context(), lm_model.run_of(table, place, tokens.number, train), tokens.own(), tokens.again()), tokens


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64) >> np.uint64(64 - RARE_BITS)


class Chunks:
    """Cuts texts into chunks and their rows; counts the slots of the task's training texts."""

    def __init__(self, vocabulary: Vocabulary, code: Code, bits: int):
        self.common = pa.array(vocabulary.words[1:], pa.binary())
        self.code, self.bits = code, bits
        self.slots = np.zeros((1 << lm_model.SLOT_BITS, 2), np.uint32)
        self._clear()

    def _clear(self):
        self.docs: list[tuple] = []  # row numbers, ids, held out, words of texts
        self.words: list[pa.Array] = []
        self.size = 0

    def add(self, rids: list[int], keys: list[int | None], held: list[bool], texts: pa.Array) -> Iterator[pa.RecordBatch]:
        words, sizes = words_of(texts)
        end, a = np.cumsum(sizes), 0
        while a < len(sizes):
            size = self.size + np.cumsum(sizes[a:] + 1)
            b = min(a + int(np.searchsorted(size, CHUNK)) + 1, len(sizes))
            self.words.append(words[end[a] - sizes[a] : end[b - 1]])
            self.docs.append((rids[a:b], keys[a:b], held[a:b], sizes[a:b]))
            self.size = int(size[b - a - 1])
            if self.size >= CHUNK:
                yield from self.close()
            a = b

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        rid, key, held = (list(itertools.chain.from_iterable(d[i] for d in self.docs)) for i in range(3))
        n_words, held = np.concatenate([d[3] for d in self.docs]), np.array(held, bool)
        sizes, coded = n_words + 1, pa.concat_arrays(self.words).dictionary_encode()
        # distinct words: the common ones' numbers, then the others as they come; ends are number 0
        common = pc.index_in(coded.dictionary, value_set=self.common)
        numbers, is_rare = pc.fill_null(common, 0).to_numpy() + 1, common.is_null()
        rare = coded.dictionary.filter(is_rare).to_pylist()
        numbers[is_rare.to_numpy(zero_copy_only=False)] = len(self.common) + 1 + np.arange(len(rare))
        at = coded.indices.to_numpy()
        order = np.zeros(sizes.sum(), np.int32)
        order[np.arange(len(at)) + np.repeat(np.arange(len(sizes)), n_words)] = numbers[at]
        length = pc.binary_length(coded.dictionary).to_numpy()
        n_bytes = np.bincount(np.repeat(np.arange(len(sizes)), n_words), length[at], len(sizes)).astype(np.int64) + sizes
        rare_hash, chunk = hashes_of(rare), rid[0]
        yield _prepared(0, chunk, 0, 0, packed(key, held, sizes, n_bytes, order, rare_hash), rare)
        tokens = Tokens.of(order, sizes, rare_hash, self.code.leaves - 1)
        train = ~held[tokens.doc]
        for shard, base, body in shard_rows(tokens, train, self.bits):
            yield _prepared(1, chunk, shard, base, body, [])
        self._count(tokens, train)
        self._clear()

    def _count(self, tokens: Tokens, train: np.ndarray) -> None:
        context, flat = tokens.slot_context(), self.slots.reshape(-1)
        for a in range(0, len(train), lm_model.TOGETHER):
            some = a + np.flatnonzero(train[a : a + lm_model.TOGETHER])
            length, place = self.code.ways(self.code.leaf(tokens.number[some]))
            np.add.at(flat, lm_model.slot(np.repeat(context[some], length), self.code.hash.take(place)) * 2 + self.code.bits.take(place), np.uint32(1))

    def end(self) -> Iterator[pa.RecordBatch]:
        for at, body in bitmix.slices(self.slots):
            yield _prepared(2, None, at, 0, body, [])


def prepare(texts: DataFrame, vocabulary: Vocabulary, code: Code, bits: int) -> str:
    """Writes all chunks' rows, a folder a kind; the path."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, code))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(*shared.value, bits)
        for b in batches:
            yield from chunks.add(*(b.column(i).to_pylist() for i in range(3)), b.column(3))
        yield from chunks.close()
        yield from chunks.end()

    path = new_path(spark, "chunks")
    write(texts.mapInArrow(run, _PREPARED).write.partitionBy("kind", "part").option("compression", "zstd"), spark, path)
    return path


def _kind(spark: SparkSession, path: str, kind: int, part: int = 0) -> DataFrame:
    out = spark.read.schema(_PREPARED).parquet(path).where((F.col("kind") == kind) & (F.col("part") == part)).drop("kind", "part")
    out._lodestack_path = f"{path}/kind={kind}/part={part}"
    return out


def answers(rows: DataFrame) -> DataFrame:
    """``chunk``, ``at``, ``body``: every shard's answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, bases, bodies = None, [], [], []

        def out():
            return _out("chunk at body", (chunk, pa.int64()), ([shard] * len(chunk), pa.int32()), (answered(bodies, bases), pa.binary()))

        for b in batches:
            for s, c, base, body in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                if s != shard:
                    if chunk:
                        yield out()
                    shard, chunk, bases, bodies = s, [], [], []
                chunk.append(c)
                bases.append(base)
                bodies.append(_body(body))
        if chunk:
            yield out()

    dealt = rows.select("at", "chunk", "base", "body").repartition("at").sortWithinPartitions("at", "chunk")
    return dealt.mapInArrow(run, "chunk long, at int, body binary")


#: Rows that a task of :func:`looked_up` holds.
LOOKED_UP = 1 << 20


def looked_up(chunks: DataFrame, rare: DataFrame) -> DataFrame:
    """``chunk``, ``body``: places among a chunk's rare tokens, their counts and spellings. ``rare``:
    ``word``, ``c``, ``lm``. What a task finds for a chunk travels in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out():
            chunk, *found = (np.concatenate(v) for v in zip(*held, strict=True))
            order = np.argsort(chunk, kind="stable")
            chunk, found = chunk[order], [v[order] for v in found]
            edges = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            bodies = [packed(*(v[a:b] for v in found)) for a, b in itertools.pairwise([*edges.tolist(), len(chunk)])]
            return _out("chunk body", (chunk[edges], pa.int64()), (bodies, pa.binary()))

        for b in batches:
            if b.num_rows:
                held.append([x.to_numpy() for x in b.columns])
                size += b.num_rows
            if size >= LOOKED_UP:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    asked = chunks.select("chunk", F.posexplode("rare").alias("at", "word")).join(rare, "word")
    return asked.select("chunk", "at", "c", "lm").mapInArrow(run, "chunk long, body binary")


def assembled(chunks: DataFrame, replies: DataFrame, rare: DataFrame | None, then: Callable[..., pa.RecordBatch | None], schema: str) -> DataFrame:
    """``then`` of every chunk: its body, replies and its rare tokens' counts and spellings, in
    their order. ``rare``: ``word``, ``c``, ``lm``; without it none are asked for."""
    parts = chunks.select("chunk", F.lit(0).alias("kind"), "body").unionByName(replies.select("chunk", F.lit(1).alias("kind"), "body"))
    if rare is not None:
        parts = parts.unionByName(looked_up(chunks, rare).select("chunk", F.lit(2).alias("kind"), "body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, bodies = None, ([], [], [])

        def out() -> Iterator[pa.RecordBatch]:
            (body,), replies, found = bodies
            replies = np.concatenate([np.zeros(0, FOLLOWERS), *(unpacked(r)[0] for r in replies)])
            at, c, lm = (np.concatenate(v) for v in zip(*map(unpacked, found), strict=True)) if found else (np.zeros(0, np.int64),) * 3
            order = np.argsort(at)
            got = then(body, replies, c[order], lm[order])
            if got is not None:
                yield got

        for b in batches:
            for i, kind, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if i != chunk:
                    if chunk is not None:
                        yield from out()
                    chunk, bodies = i, ([], [], [])
                bodies[kind].append(_body(body))
        if chunk is not None:
            yield from out()

    return parts.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, schema)


def _opened(code: Code, body: bytes, replies: np.ndarray, bits: int):
    key, held, sizes, n_bytes, order, rare_hash = unpacked(body)
    return key, held, sizes, n_bytes, *features(order, sizes, ~held, rare_hash, replies, code, bits)


def fit(chunks: DataFrame, replies: DataFrame, code: Code, states: np.ndarray, bits: int) -> Mixer:
    """Weights and map, learnt on the training texts of all chunks."""
    start = Mixer(code, states, lm_model.first_weights(), np.empty(0))
    shared = chunks.sparkSession.sparkContext.broadcast(start)

    def learn(body: bytes, replies: np.ndarray, c: np.ndarray, lm: np.ndarray) -> pa.RecordBatch | None:
        *_, f, _ = _opened(shared.value.code, body, replies, bits)
        some = np.flatnonzero(f.train)
        return _out("body", ([packed(*shared.value.learnt(f, some).parts())], pa.binary())) if len(some) else None

    # the mixing does not depend on rare tokens' counts; cut, as that removes the chunks' shuffle
    learners = cut(assembled(chunks, replies, None, learn, "body binary"), "learners")
    sums = bitmix.summed_parts(learners)
    discard(learners)
    return Mixer(code, states, *bitmix.averaged(sums, start.weights, lm_model.CLASSES))


def scored(model: Mixer, v: Vocabulary, bits: int, body: bytes, replies: np.ndarray, c: np.ndarray, lm: np.ndarray) -> list[tuple]:
    """A chunk's texts: id, held out, tokens, known ones, base score, score, bytes."""
    key, held, sizes, n_bytes, f, tokens = _opened(model.code, body, replies, bits)
    logs, named = model.log10(f, sizes)
    count = np.concatenate((np.array(v.counts, np.int64), c))[tokens.order]
    rest = np.flatnonzero(~named)
    left = count[rest] - f.train[rest]
    known = np.log10((1 - v.unknown) * np.maximum(left, 1) / max(v.rare, 1))
    logs[rest] += np.where(left > 0, known, np.log10(v.unknown) + lm[tokens.order[rest] - len(v.counts)])
    base = np.log10((count + 0.5) / (v.n + 0.5 * (v.v + 1)))

    def total(x: np.ndarray) -> list:
        return np.bincount(tokens.doc, x, len(sizes)).tolist()

    return list(zip(key, held.tolist(), sizes.tolist(), map(int, total(count > 0)), total(base), total(logs), n_bytes.tolist(), strict=True))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score`` and ``bits_per_byte`` (of the tokens, each with one byte between).

    Learns from rows whose crc32(id as text) mod 5 is not 1; these are scored without their own
    occurrence. A null or empty text is its end token alone; a null id counts as the empty text
    in the fold; repeated rows each count and each get a row; ties between followers go to the
    smaller number; without training rows N and V are 0 and every token is unknown; an empty
    table gives an empty result; other columns, whatever their names, are ignored. Whole texts:
    a very long one is a chunk by itself.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = fold_bucket(5, id_col) == 1
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    table = cut(count_tokens(texts.withColumn("train", ~F.col("held_out"))), "vocabulary")
    v, rare = split(table)
    spellings = cut(spelled(rare), "spellings")
    discard(table)
    code, bits = Code(v.counts, v.rare), shard_bits(v.every)
    path = prepare(texts, v, code, bits)
    chunks, slots = _kind(spark, path, 0), _kind(spark, path, 2)
    states = bitmix.summed_states(slots.select(F.col("at").alias("slice"), "body"), 1 << lm_model.SLOT_BITS)
    discard(slots)
    replies = None
    for part in range(PARTS):
        rows = _kind(spark, path, 1, part)
        some = cut(answers(rows), "answers")
        discard(rows)
        replies = some if replies is None else replies.unionByName(some)
    shared = spark.sparkContext.broadcast((fit(chunks, replies, code, states, bits), v, bits))

    def of_chunk(*parts) -> pa.RecordBatch:
        rows = zip(*scored(*shared.value, *parts), strict=True)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        return _out("id held_out n_tokens n_known base_score score n_bytes", *((list(c), k) for c, k in zip(rows, kinds, strict=True)))

    schema = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    found = None
    for part in range(SCORE_PARTS):
        mine = F.pmod(F.xxhash64("chunk"), F.lit(SCORE_PARTS)) == part
        some = cut(assembled(chunks.where(mine), replies.where(mine), spellings, of_chunk, schema), "scored")
        found = some if found is None else found.unionByName(some)
    per_byte = -F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")
    return found.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(v.n).cast("long").alias("train_tokens"), "base_score", "score", per_byte.alias("bits_per_byte"))
