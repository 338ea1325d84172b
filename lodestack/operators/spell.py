"""Spelling: dictionary, symmetric-delete candidates, compound correction."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import cut
from .extract import first_per

MAX_EDITS, PREFIX = 2, 7


def dictionary(texts: DataFrame, text: str) -> DataFrame:
    """``word, count`` of words of more than one letter."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(X.DICTIONARY_WORD), F.lit(0))).alias("word"))
    return words.where(F.length("word") > 1).groupBy("word").agg(F.count("*").alias("count"))


def deletes(word: Column, edits: int = MAX_EDITS, prefix: int = PREFIX) -> Column:
    """The word's first letters with up to ``edits`` letters left out."""
    level = F.array(F.left(word, F.lit(prefix)))
    out = level
    for _ in range(edits):
        level = F.array_distinct(F.flatten(F.transform(level, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>")))))
        out = F.array_union(out, level)
    return out


def met(words: DataFrame, entries: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """``token, word, count`` of entries that share a delete with the token and whose length is
    near enough: lengths are part of the key, so that long tokens of one beginning do not meet
    all entries of that beginning."""
    n = F.length("token")
    near = F.filter(F.sequence(n - edits, n + edits), lambda x: x > 0)
    a = words.select("token", F.explode(near).alias("n"), deletes(F.col("token"), edits).alias("ds")).select("token", "n", F.explode("ds").alias("d"))
    b = entries.select("word", "count", F.length("word").alias("n"), F.explode(deletes(F.col("word"), edits)).alias("d"))
    return a.join(b, ["d", "n"]).select("token", "word", "count").distinct()


def part(text: Column, start: Column, letters: Column | None = None) -> Column:
    return F.substring(text, start, F.length(text) if letters is None else letters)


def exchanged(a: Column, b: Column) -> Column:
    """Whether exchanging two neighbours once makes ``a`` to ``b``."""
    one = F.lit(1)
    there = F.sequence(one, F.greatest(F.length(a), one))
    return (F.length(a) == F.length(b)) & (a != b) & F.exists(there, lambda i: F.concat(part(a, one, i - 1), part(a, i + 1, one), part(a, i, one), part(a, i + 2)) == b)


def distance(a: Column, b: Column) -> Column:
    """:func:`osa` of up to 2 edits, else null. Two neighbours exchanged are one edit here, two by
    levenshtein: where that says more than 2, one exchange leaves parts before and behind that
    differ by one edit at most."""
    plain, one = F.levenshtein(a, b, 4), F.lit(1)

    def around(i: Column, j: Column) -> Column:
        before = (part(a, one, i - 1), part(b, one, j - 1))
        behind = (part(a, i + 2), part(b, j + 2))
        met = (j >= 1) & (part(a, i, one) == part(b, j + 1, one)) & (part(a, i + 1, one) == part(b, j, one)) & (F.length(part(b, j, F.lit(2))) == 2)
        return met & ((F.levenshtein(*before) + F.levenshtein(*behind) <= 1) | ((before[0] == before[1]) & exchanged(*behind)))

    there = F.sequence(one, F.greatest(F.length(a) - 1, one))
    more = F.exists(there, lambda i: F.exists(F.array(i - 1, i, i + 1), lambda j: around(i, j)))
    return F.when((plain == 2) & exchanged(a, b), 1).when(plain.between(0, 2), plain).when((plain > 2) & more, 2)


def verified(pairs: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """Adds ``distance`` to pairs within ``edits``; others go."""
    if edits > 2:
        raise ValueError("distances of more than 2 edits are not told apart")
    return pairs.withColumn("distance", distance(F.col("token"), F.col("word"))).where(F.col("distance") <= edits)


def nearest(words: DataFrame, entries: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """For each ``token`` the entry within ``edits`` by (distance, larger count, word): an
    equality join on deletes, verified. Returns token, word, distance."""
    pairs = verified(met(words, entries, edits), edits)
    return first_per(pairs, "token", ["distance", F.desc("count"), "word"]).select("token", "word", "distance")


def osa(a: str, b: str, most: int) -> int:
    """Edits with transpositions of neighbours; more than ``most`` counts as ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most and min(last) > most:  # an exchange reaches past one row
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


class Corrector:
    """Corrects words, joins neighbours and splits words, each where it costs fewer edits."""

    def __init__(self, counts: dict[str, int], edits: int = MAX_EDITS):
        self.counts, self.edits, self.total = counts, edits, sum(counts.values()) or 1
        self.index: dict[str, list[str]] = {}
        for w in counts:
            for d in self._cuts(w):
                self.index.setdefault(d, []).append(w)

    @classmethod
    def looked_up(cls, best: dict[str, tuple[str, int]], counts: dict[str, int], edits: int = MAX_EDITS) -> "Corrector":
        """Of answers found elsewhere: the best of every word asked, counts of the halves."""
        out = cls({}, edits)
        out.counts, out.best = counts, best.get
        return out

    def _cuts(self, word: str) -> set[str]:
        out = level = {word[:PREFIX]}
        for _ in range(self.edits):
            level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
            out = out | level
        return out

    def best(self, word: str) -> tuple[str, int] | None:
        if word in self.counts:
            return word, 0
        found = {(d, -self.counts[w], w) for c in self._cuts(word) for w in self.index.get(c, ()) if (d := osa(word, w, self.edits)) <= self.edits}
        return (min(found)[2], min(found)[0]) if found else None

    def _weight(self, word: str) -> float:
        return math.log(self.counts.get(word, 0) + 1e-3) - math.log(self.total)

    def split(self, word: str) -> tuple[str, int] | None:
        halves = [(a, b) for i in range(1, len(word)) if (a := word[:i]) in self.counts and (b := word[i:]) in self.counts]
        return (" ".join(max(halves, key=lambda p: (self._weight(p[0]) + self._weight(p[1]), p))), 1) if halves else None

    def correct(self, text: str) -> str:
        out: list[tuple[str, str, int]] = []  # original, chosen, edits
        for word in text.split():
            if not word.isalpha():
                out.append((word, word, 0))
                continue
            low = word.lower()
            got = self.best(low)
            if out and out[-1][0].isalpha() and (joined := self.best(out[-1][0].lower() + low)) and joined[1] + 1 < out[-1][2] + (got[1] if got else self.edits + 1):
                out[-1] = (out[-1][0] + word, joined[0], joined[1] + 1)
                continue
            if got is None or got[1] > 0:
                parts = self.split(low)
                if parts and (got is None or parts[1] < got[1]):
                    got = parts
            out.append((word, got[0] if got else low, got[1] if got else self.edits + 1))
        return " ".join(x for _, x, _ in out)


def corrected(text: Column, entries: DataFrame) -> Column:
    """Compound correction; a text with an acronym stays as it is. Each worker holds the whole
    dictionary; :func:`correct_texts` looks it up by a join."""
    shared = entries.sparkSession.sparkContext.broadcast({r["word"]: r["count"] for r in entries.collect()})
    made: list[Corrector] = []

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Corrector(shared.value))
        return pa.array([made[0].correct(t) if t else t for t in texts.to_pylist()], pa.string())

    return F.when(X.has_acronym(text), text).otherwise(of(text))


def asked_words(text: str, longest: int) -> tuple[set[str], set[str]]:
    """Words whose best entry a correction may ask for (single, and runs joined up to
    ``longest`` letters, beyond which no entry is near), and halves of the single ones."""
    words = [w if w.isalpha() else None for w in text.split()]
    best, halves = set(), set()
    for i, w in enumerate(words):
        run = ""
        for j in range(i, len(words)):
            if words[j] is None or (run and len(run) + len(words[j]) > longest):
                break
            run += words[j].lower()
            best.add(run)
        if w:
            low = w.lower()
            halves |= {x for k in range(1, len(low)) for x in (low[:k], low[k:])}
    return best, halves


def correct_texts(texts: DataFrame, column: str, entries: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """:func:`corrected` over a dictionary of any size: the words that texts ask for meet the
    entries by deletes, halves by equality; a text gets the answers for its own words only."""
    longest = (entries.agg(F.max(F.length("word"))).first()[0] or 0) + edits
    plain = texts.select(F.col(column).alias("t")).where(F.col("t").isNotNull() & ~X.has_acronym(F.col("t"))).distinct()

    @F.arrow_udf("array<struct<token: string, half: boolean>>")
    def asks(t: pa.Array) -> pa.Array:
        sets = [asked_words(x, longest) for x in t.to_pylist()]
        rows = [[{"token": w, "half": h} for h, part in ((False, a), (True, b)) for w in sorted(part)] for a, b in sets]
        return pa.array(rows, pa.list_(pa.struct([("token", pa.string()), ("half", pa.bool_())])))

    asked = cut(plain.select("t", F.inline(asks("t"))), "asked")
    pairs = verified(met(asked.where("NOT half").select("token").distinct(), entries, edits), edits)
    best = first_per(pairs, "token", ["distance", F.desc("count"), "word"])
    best = asked.where("NOT half").join(best, "token").groupBy("t").agg(F.collect_list(F.struct("token", "word", "distance")).alias("best"))
    halves = asked.where("half").join(entries.select(F.col("word").alias("token"), "count"), "token").groupBy("t").agg(F.collect_list(F.struct("token", "count")).alias("halves"))

    @F.arrow_udf("string")
    def of(t: pa.Array, b: pa.Array, h: pa.Array) -> pa.Array:
        out = []
        for x, near, parts in zip(t.to_pylist(), b.to_pylist(), h.to_pylist(), strict=True):
            known = {r["token"]: (r["word"], r["distance"]) for r in near or ()}
            out.append(Corrector.looked_up(known, {r["token"]: r["count"] for r in parts or ()}, edits).correct(x) if x else x)
        return pa.array(out, pa.string())

    done = plain.join(best, "t", "left").join(halves, "t", "left").select(F.col("t").alias(column), of("t", "best", "halves").alias("corrected_text"))
    joined = texts.join(done, column, "left").withColumn(column, F.coalesce("corrected_text", column))
    return joined.select(*texts.columns)
