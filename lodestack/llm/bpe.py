"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Codepoint classes are looked up in an array; a finite automaton over them says where pieces
start. Each symbol is a transition function; functions compose associatively, so the automaton
is run as a scan: blocks are composed side by side, block totals are scanned, and every block
is replayed from its now known start state. The slices between boundaries feed pair merging,
cached by slice; byte offsets of the tokens are kept, so that a span of ids decodes in place.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches

#: Codepoints that are scanned together, and steps of a block of the scan.
CHUNK, BLOCK = 1 << 19, 64
#: Pieces of one generation of a worker's memory; there are two, and what is used moves on.
MEMO = 200_000
#: Pieces of at most so many bytes are merged by search, longer ones with a heap.
SHORT = 48

# Symbols; with START added, the first of a text.
LETTER, NUMBER, OTHER, SPACE, WHITE, INNER, QUOTE1, QUOTE2, START = range(9)
# States: what stands before the current codepoint.
IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_SPACE, AFTER_WHITE, AT_QUOTE1, AT_QUOTE2, ONE_MORE, ENDED = range(9)
N_STATES, N_SYMBOLS = 9, 16
# Contractions that are pieces of their own, and Unicode white space.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def codepoint_classes() -> np.ndarray:
    """Class of every codepoint, with letters and numbers as the tokenizer library has them
    (its Unicode version differs from Python's): it is asked codepoint by codepoint."""
    import tiktoken

    every = [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    text = "".join(map(chr, every))
    out = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([i]): i for i in range(256)}
    for cls, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        e = tiktoken.Encoding(name=pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={})
        out[[ord(c) for c in e.decode_bytes(e.encode_ordinary(text)).decode("utf-8")]] = cls
    out[list(WHITE_SPACE)] = WHITE
    out[0x20] = SPACE
    return out


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this codepoint."""
    if symbol == LETTER:
        if state in (AT_QUOTE1, ONE_MORE):
            return ENDED, False
        if state == AT_QUOTE2:
            return ONE_MORE, False
        return IN_LETTER, state not in (IN_LETTER, AFTER_SPACE)
    if symbol == NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, AFTER_SPACE)
    if symbol == OTHER:
        return IN_OTHER, state not in (IN_OTHER, AFTER_SPACE)
    if symbol in (QUOTE1, QUOTE2):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return (AT_QUOTE1 if symbol == QUOTE1 else AT_QUOTE2), True
    if symbol == SPACE:  # the last of its run, with a text to attach to
        return AFTER_SPACE, True
    if symbol == WHITE:
        return AFTER_WHITE, True
    return AFTER_WHITE, state not in (AFTER_SPACE, AFTER_WHITE)  # INNER


@cache
def _automaton() -> tuple[np.ndarray, ...]:
    """Next-state and boundary tables, the function of each symbol, and composition."""
    step = [[_step(sym, st) if sym < 8 else (_step(sym - 8, AFTER_WHITE)[0], True) for st in range(N_STATES)] for sym in range(N_SYMBOLS)]
    functions = [tuple(range(N_STATES))] + [tuple(s for s, _ in row) for row in step]
    known = {f: i for i, f in reversed(list(enumerate(dict.fromkeys(functions))))}
    todo = list(known)
    gens = list(known)
    while todo:
        f = todo.pop()
        for g in gens:
            if (h := tuple(g[s] for s in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    every = sorted(known, key=known.get)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.uint16)
    nxt = np.array([[s for s, _ in row] for row in step], np.uint8)
    starts = np.array([[b for _, b in row] for row in step], bool)
    of_symbol = np.array([known[f] for f in functions[1:]], np.uint16)
    apply = np.array(every, np.uint8)
    return nxt, starts, of_symbol, compose, apply, known[functions[0]]


def _start_functions(functions: np.ndarray, identity: int, compose: np.ndarray) -> np.ndarray:
    """Exclusive scan: the composition of all functions before each one."""
    n = len(functions)
    if n <= BLOCK:
        out = np.empty(n, np.uint16)
        acc = identity
        for i, f in enumerate(functions.tolist()):
            out[i] = acc
            acc = int(compose[acc, f])
        return out
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, identity, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    acc, size, flat = np.full(rows, identity, np.intp), len(compose), compose.ravel()
    before = np.empty_like(grid)
    for j in range(BLOCK):
        before[j] = acc
        acc = flat[acc * size + grid[j]].astype(np.intp)
    outer = _start_functions(acc.astype(np.uint16), identity, compose)
    return compose[outer[None, :], before].T.ravel()[:n]


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Boolean: does a piece start here? One scan over the whole array."""
    nxt, starts, of_symbol, compose, apply, identity = _automaton()
    n = len(symbols)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, INNER, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    acc, size, flat, functions = np.full(rows, identity, np.intp), len(compose), compose.ravel(), of_symbol.astype(np.intp)
    for j in range(BLOCK):
        acc = flat[acc * size + functions[grid[j]]].astype(np.intp)
    state = apply[_start_functions(acc.astype(np.uint16), identity, compose), AFTER_WHITE].astype(np.intp)
    out, flat_next, flat_starts = np.empty(grid.shape, bool), nxt.ravel(), starts.ravel()
    for j in range(BLOCK):
        at = grid[j] * np.intp(N_STATES) + state
        out[j] = flat_starts[at]
        state = flat_next[at].astype(np.intp)
    return out.T.ravel()[:n]


def symbols_of(codepoints: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols of texts laid end to end; ``firsts``: where (nonempty) texts begin."""
    sym = classes[codepoints]
    n = len(sym)
    lasts = np.append(firsts[1:], n) - 1
    white = sym >= SPACE
    inner = np.empty(n, bool)
    inner[:-1] = white[1:]
    inner[lasts] = True
    sym[white & inner] = INNER
    at = np.flatnonzero(codepoints == 39)
    if len(at):
        end = lasts[np.searchsorted(firsts, at, side="right") - 1]
        one = np.where(at + 1 <= end, codepoints[np.minimum(at + 1, n - 1)], 0)
        two = np.where(at + 2 <= end, codepoints[np.minimum(at + 2, n - 1)], 0)
        short = np.zeros(len(at), bool)
        long = np.zeros(len(at), bool)
        for c in CONTRACTIONS:
            if len(c) == 2:
                short |= one == ord(c[1])
            else:
                long |= (one == ord(c[1])) & (two == ord(c[2]))
        sym[at[short]] = QUOTE1
        sym[at[long]] = QUOTE2
    sym[firsts] += START
    return sym


class _Merges(dict):
    """Piece -> ids, merged when first asked for. When a generation is full it becomes the old
    one; pieces that are asked for again come back from there, the others go."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.old: dict[bytes, tuple[int, ...]] = {}

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        got = self.old.get(piece)
        if got is None:
            got = merge(piece, self.ranks)
        self[piece] = got
        return got


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Join the adjacent pair of least rank, leftmost first, until none has a rank."""
    if piece in ranks:
        return (ranks[piece],)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(piece) <= SHORT:
        none, get = 1 << 40, ranks.get
        pair = [get(piece[i : i + 2], none) for i in range(len(parts) - 1)]
        while pair and (best := min(pair)) < none:
            at = pair.index(best)
            parts[at : at + 2] = [joined := parts[at] + parts[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = get(joined + parts[at + 1], none)
            if at:
                pair[at - 1] = get(parts[at - 1] + joined, none)
        return tuple(map(ranks.__getitem__, parts))
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return tuple(ranks[p] for p in parts if p)


class Codec:
    """Encoder and decoder for one rank file's content."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        self.merges = _Merges(ranks)
        self.bytes_of = {i: b for b, i in ranks.items()}

    def encode(self, texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
        """For each UTF-8 text its ids and the byte offset at which each id starts."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        data = b"".join(texts)
        cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
        full = np.flatnonzero(lengths)
        begin = np.concatenate(([0], np.cumsum(lengths)))
        if len(full):
            if len(cps) == len(data):
                offset, firsts = None, begin[:-1][full]
            else:
                width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
                offset = np.cumsum(width) - width
                firsts = np.searchsorted(offset, begin[:-1][full])
            at = np.flatnonzero(piece_starts(symbols_of(cps, firsts, self.classes)))
            at = at if offset is None else offset[at]
        else:
            at = np.empty(0, np.int64)
        split = np.searchsorted(at, begin)
        bounds = np.append(at, len(data)).tolist()
        find = self.merges.__getitem__
        for k in range(len(texts)):
            i, j = int(split[k]), int(split[k + 1])
            found = [find(data[a:b]) for a, b in zip(bounds[i:j], bounds[i + 1 : j + 1], strict=True)]
            yield list(chain.from_iterable(found)), at[i:j] - begin[k]

    def token_starts(self, ids: list[int]) -> np.ndarray:
        """Byte offset of each id."""
        sizes = np.fromiter((len(self.bytes_of[i]) for i in ids), np.int64, len(ids))
        return np.cumsum(sizes) - sizes

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def chunks(texts: pa.Array) -> Iterator[list[bytes]]:
    """Whole texts, together about CHUNK bytes (a longer text alone)."""
    held, size = [], 0
    for x in texts.cast(pa.binary()):
        b = x.as_buffer().to_pybytes() if x.is_valid else b""
        if held and size + len(b) > CHUNK:
            yield held
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield held


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


_CODECS: dict[int, Codec] = {}


def shared_codec(spark: SparkSession, path: str):
    """A function for workers that gives the codec. The ranks (one vocabulary file) and the
    class table (one byte a codepoint) are broadcast; each worker builds its codec once."""
    bound_batches(spark)
    parts = spark.sparkContext.broadcast((load_ranks(path), codepoint_classes()))

    def get() -> Codec:
        key = id(parts.value)
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(*parts.value)
        return _CODECS[key]

    return get


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` (array<int>), ``id_starts`` (array<int>, byte offsets) and ``round_trip``
    (do the ids decode to the text's bytes?). Null text: empty arrays."""
    codec = shared_codec(docs.sparkSession, path or tokenizer_path())

    @F.arrow_udf("struct<ids: array<int>, id_starts: array<int>, round_trip: boolean>")
    def of(texts: pa.Array) -> pa.Array:
        c, ids, starts, same = codec(), [], [], []
        for part in chunks(texts):
            for text, (found, _) in zip(part, c.encode(part), strict=True):
                ids.append(np.array(found, np.int32))
                starts.append(c.token_starts(found).astype(np.int32))
                same.append(c.decode(found) == text)
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["ids", "id_starts", "round_trip"])

    out = docs.withColumn("__bpe", of(F.col(text_col).cast("string")))
    return out.withColumns({c: F.col("__bpe")[c] for c in ("ids", "id_starts", "round_trip")}).drop("__bpe")


def decode(docs: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids as ``out`` (binary). Null ids: empty."""
    codec = shared_codec(docs.sparkSession, path or tokenizer_path())

    @F.arrow_udf("binary")
    def of(ids: pa.Array) -> pa.Array:
        return pa.array([codec().decode(x.values.to_pylist()) if x.is_valid else b"" for x in ids], pa.binary())

    return docs.withColumn(out, of(F.col(ids_col)))


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` (of the comma-joined ids), ``decoded_sha256``.

    The ids are decoded again for the last. A null or empty text has no ids (both digests are
    those of nothing); repeated rows each get a row, a null id is kept; an empty table gives an
    empty result; other columns are ignored. A very long text is encoded whole.
    """
    codec = shared_codec(docs.sparkSession, path or tokenizer_path())

    @F.arrow_udf("struct<n: bigint, ids: string, decoded: string>")
    def of(texts: pa.Array) -> pa.Array:
        c = codec()
        n, ids, decoded = [], [], []
        for part in chunks(texts):
            for found, _ in c.encode(part):
                n.append(len(found))
                ids.append(hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(found)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), of(F.col(text_col).cast("string")).alias("x"))
    return rows.select(F.col("id").alias(id_col), F.col("x.n").alias("n_tokens"), F.col("x.ids").alias("ids_sha256"), F.col("x.decoded").alias("decoded_sha256"))
