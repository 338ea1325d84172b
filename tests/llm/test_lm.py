"""The language model against plain loops, its parts against plain versions, edge cases."""

import functools
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import bitmix, lm, lm_model, spelling
from lodestack.llm.tree import Tree

COLUMNS = "doc_id long, text string, lang string, score string, chunk long"


def frame(spark, data):
    return spark.createDataFrame([(*d, None, None, None) for d in data], COLUMNS)


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w.encode() for w in low.split(" ") if w] + [b""]


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def corpus(r, n=70):
    words = ["".join(r.choices("abcde", k=r.randint(1, 4))) for _ in range(90)]
    weights = [1 / (k + 1) for k in range(90)]
    data = [(i, " ".join(r.choices(words, weights, k=r.randint(0, 60)))) for i in range(n)]
    data += [(n + i, data[i][1]) for i in range(12)]  # copies
    data += [(200, " ".join(r.choices(words, weights, k=700))), (201, "New Words HERE here\u0085x now here " * 9), (202, None), (203, ""), (None, "a b"), (None, "a b"), (5, data[5][1])]
    return data


def logit(n0, n1):
    return max(-8.0, min(8.0, math.log((n1 + 0.1) / (n0 + 0.1))))


def level_of(n):
    return sum(n >= x for x in (1, 3, 16))


def plain_scores(data, model, speller):
    """(n_tokens, n_known, base, score) of every row, by loops over its tokens."""
    docs = [(not is_held(i), tokens_of(t)) for i, t in data]
    count = Counter(w for train, ws in docs if train for w in ws)
    total, distinct = sum(count.values()), len(count)
    common = sorted((w for w in count if w and count[w] >= lm.LEAST), key=lambda w: (-count[w], w))[: lm.COMMON - 1]
    number = {b"": 0} | {w: i + 1 for i, w in enumerate(common)}
    rare = [w for w in count if w not in number]
    z, once = sum(count[w] for w in rare), sum(count[w] == 1 for w in rare)
    unknown = (once + 0.5) / (z + 1)
    code = model.code

    def name(w):
        return number[w] if w in number else lm_model.RARE | (int(lm.hashes_of([w])[0]) & (lm_model.RARE - 1))

    @functools.cache
    def way(w):
        leaf = number.get(w, len(number))
        return [(code.offset[leaf] + d, int(code.bits[code.offset[leaf] + d])) for d in range(code.length[leaf])]

    @functools.cache
    def slot(before, place):
        h = 1 if before is None else 3 if before not in number else int(bitmix.mix(np.array([number[before] + 1], np.uint64))[0])
        context = bitmix.mix(np.array([h + 11], np.uint64))
        return int(lm_model.slot(context, code.hash[place : place + 1])[0])

    slots, pairs = defaultdict(lambda: [0, 0]), defaultdict(Counter)
    for train, ws in docs:
        for i, w in enumerate(ws if train else []):
            for place, y in way(w):
                slots[slot(ws[i - 1] if i else None, place)][y] += 1
            pairs[tuple(ws[max(0, i - 2) : i])][w] += 1

    def scaled(ns):
        return [-(-n * 255 // max(ns)) for n in ns] if max(ns) > 255 else list(ns)

    def best_of(ws, i, train):
        """Predicted word, logit, level."""
        table = pairs.get(tuple(ws[max(0, i - 2) : i]))
        if not table:
            return None, 0.0, 0
        order = sorted(table, key=lambda w: (-table[w], name(w)))
        every = sum(table.values())
        n1, n2, every = scaled([table[order[0]], table[order[1]] if len(order) > 1 else 0, every])
        if train and every < 255:
            n1 -= ws[i] == order[0]
            n2 -= len(order) > 1 and ws[i] == order[1]
            every -= 1
        told, n = (order[1], n2) if n1 < n2 else (order[0], n1)
        if n <= 0 or every <= 0:
            return None, 0.0, 0
        return told, logit(every - n, n), 1 if every < 2 else 2 if n * 10 < every * 9 else 3

    out = []
    for train, ws in docs:
        weights, table = model.weights.astype(float), model.map.astype(float)
        seen = np.full(table.shape, bitmix.MAP_PRIOR)
        score = 0.0
        for a in range(0, len(ws), lm_model.SEGMENT):
            grads, tally, cells = np.zeros(weights.shape), np.zeros(weights.shape[1]), []
            for i in range(a, min(a + lm_model.SEGMENT, len(ws))):
                w = ws[i]
                run, run_logit, run_level = best_of(ws, i, train)
                last = [j for j in range(1, i) if ws[j - 1] == ws[i - 1]] if i else []
                own = ws[last[-1]] if last else None
                own_level = 0 if not last else 1 + (i >= 2 and last[-1] >= 2 and ws[i - 2] == ws[last[-1] - 2] or (i < 2 and last[-1] < 2))
                own_logit = [0.0, 1.0, 4.0][own_level]
                asked = []  # y, opinions, run level, own level, known level, stage
                for d, (place, y) in enumerate(way(w)):
                    n = list(slots[slot(ws[i - 1] if i else None, place)])
                    n = scaled(n)
                    if train and max(n) < 255:
                        n[y] -= 1
                    x = [float(code.logit[place]), logit(*n), 0.0, 0.0]
                    levels = [0, 0]
                    for k, (told, strength, level) in enumerate(((run, run_logit, run_level), (own, own_logit, own_level))):
                        if told is not None and [b for _, b in way(told)][:d] == [b for _, b in way(w)][:d]:
                            x[2 + k], levels[k] = strength if way(told)[d][1] else -strength, level
                    asked.append((y, x, *levels, level_of(sum(n)), 0 if d < 2 else 1 if d < 6 else 2))
                extra, named = 0.0, w in number
                if not named:
                    if run is not None and run not in number:
                        agree = own == run
                        asked.append((run == w, [-4.0, 0.0, run_logit, own_logit if agree else 0.0], run_level, own_level if agree else 0, 0, 3))
                        named = run == w
                    if not named and own is not None and own not in number and own != run:
                        asked.append((own == w, [-4.0, 0.0, 0.0, own_logit], 0, own_level, 0, 3))
                        named = own == w
                    before = [u for u in ws[:i] if u not in number]
                    if not named and before:
                        repeats = sum(u in before[:j] for j, u in enumerate(before))
                        m = len(before)
                        asked.append((w in before, [math.log((repeats + 0.3) / (m - repeats + 1.0)), 0.0, 0.0, 0.0], 0, 0, 1 + (m >= 4) + (m >= 32), 3))
                        if w in before:
                            extra, named = math.log10(before.count(w) / m), True
                if not named:
                    left = count[w] - train
                    extra = math.log10((1 - unknown) * left / z) if left > 0 else math.log10(unknown) + float(speller.log10([w], np.array([count[w] == 1]))[0])
                score += extra
                for y, x, run_at, own_at, known, stage in asked:
                    cls = run_at * lm_model.OWN_LEVELS + own_at
                    gate = (cls * 4 + known) * lm_model.STAGES + stage
                    mixed = sum(weights[k, gate] * v for k, v in enumerate(x)) + weights[-1, gate]
                    p = 1 / (1 + math.exp(-max(-20, min(20, mixed))))
                    cell = int((max(-8, min(8, mixed)) + 8) * 2 + 0.5)
                    both = min(max((p + table[cls, cell]) / 2 if y else (1 - p + 1 - table[cls, cell]) / 2, 1e-7), 1 - 1e-7)
                    score += math.log10(both)
                    grads[:, gate] += (y - p) * np.array([*x, 1.0])
                    tally[gate] += 1
                    cells.append((cls, cell, y))
            weights = weights + lm_model.RATE * grads / (tally + lm_model.STEP_PRIOR)
            before, sums = seen.copy(), table * seen
            for cls, cell, y in cells:
                seen[cls, cell] += 1
                sums[cls, cell] += y
            assert (seen >= before).all()
            table = sums / seen
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        out.append((len(ws), sum(count[w] > 0 for w in ws), total, base, score))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_plain_loops(spark, monkeypatch, seed):
    data = corpus(random.Random(seed))
    monkeypatch.setattr(lm, "CHUNK", 500)  # several chunks, a long text by itself
    monkeypatch.setattr(lm, "SHARD", 400)  # several shards
    models, spellers = [], []
    fit, spell = lm.fit, spelling.fit
    monkeypatch.setattr(lm, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    monkeypatch.setattr(spelling, "fit", lambda *a: spellers.append(spell(*a)) or spellers[-1])
    got = lm.score(frame(spark, data).repartition(3)).collect()
    want = defaultdict(list)
    for (i, _), w in zip(data, plain_scores(data, models[0], spellers[0]), strict=True):
        want[i].append(w)
    assert len(got) == len(data)
    for x in got:
        assert x.held_out == is_held(x.doc_id)
        near = [w for w in want[x.doc_id] if (x.n_tokens, x.n_known, x.train_tokens) == w[:3] and abs(x.base_score - w[3]) < 1e-9 and abs(x.score - w[4]) < 2e-5 * max(1, abs(w[4]))]
        assert near, (x, want[x.doc_id])
        want[x.doc_id].remove(near[0])


def test_order_of_words_matters_and_copies_are_known(spark):
    r = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(r.choices(words, k=80)) for _ in range(150)]
    first = next(i for i in range(150) if not is_held(i))
    copy, held, other = (next(i for i in range(k, 2000) if is_held(i) == h) for k, h in ((1000, False), (1100, True), (1200, True)))
    shuffled = texts[first].split()
    r.shuffle(shuffled)
    data = [*enumerate(texts), (copy, texts[first]), (held, texts[first]), (other, " ".join(shuffled))]
    got = {x.doc_id: x.score for x in lm.score(frame(spark, data)).collect()}
    assert got[held] > got[other] + 40  # a copy's pairs are known, whether its own are left out or not
    assert got[copy] == got[first] > max(got[i] for i in range(150) if i != first) + 20


def test_held_out_beats_the_base_on_text_with_order(spark):
    r = random.Random(8)
    after = {k: r.choices(range(30), k=3) for k in range(30)}
    data = []
    for i in range(200):
        at, out = r.randrange(30), []
        for _ in range(60):
            out.append(f"t{at}")
            at = r.choice(after[at])
        data.append((i, " ".join(out)))
    held = [x for x in lm.score(frame(spark, data)).collect() if x.held_out]
    assert held and all(x.score > 0.7 * x.base_score and x.bits_per_byte > 0 for x in held)


def test_mixing_is_learnt_on_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 300)  # many chunks
    r = random.Random(9)
    words = [f"w{k}" for k in range(9)]
    data = [(i, " ".join(r.choices(words, k=30))) for i in range(300)]
    sums, models = [], []
    summed, fit = bitmix.summed_parts, lm.fit
    monkeypatch.setattr(bitmix, "summed_parts", lambda x: sums.append(summed(x)) or sums[-1])
    monkeypatch.setattr(lm, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    assert lm.score(frame(spark, data)).count() == 300
    count = Counter(w for i, t in data if not is_held(i) for w in tokens_of(t))
    leaves = [b"", *sorted((w for w in count if w), key=lambda w: (-count[w], w))]
    assert sums[-1][1].sum() == sum(count[w] * models[0].code.length[i] for i, w in enumerate(leaves))


def test_spelling_is_learnt_on_all_rare_words(spark, monkeypatch):
    words = [f"{k * 7919 % 1000:x}y".encode() for k in range(700)]
    sums, summed = [], bitmix.summed_parts
    monkeypatch.setattr(bitmix, "summed_parts", lambda x: sums.append(summed(x)) or sums[-1])
    tree = spelling.fit(spark.createDataFrame([(bytearray(w),) for w in words], "word binary")).tree
    assert sums[0][1].sum() == spelling.EPOCHS * sum(tree.length[c] for w in words for c in w + b"\0")


def test_edges(spark):
    data = [(1, None), (2, ""), (3, " \n\t"), (None, "x"), (6, "a " * 30_000), (6, "a b"), (6, "a b"), (7, "ends\u0085with odd\u001cspace")]
    got = lm.score(frame(spark, data)).collect()
    assert len(got) == len(data) and all(np.isfinite(x.score) and x.score < 0 for x in got)
    assert lm.score(frame(spark, data).limit(0)).count() == 0
    held = [(i, "one two one") for i in range(200) if is_held(i)]
    assert {(x.train_tokens, x.n_known) for x in lm.score(frame(spark, held)).collect()} == {(0, 0)}


# ---- parts


def test_tree_is_a_huffman_tree():
    r = random.Random(1)
    for n in (2, 3, 50, 400):
        weights = [r.choice([0, 1, 1, 5, 40]) * r.random() * 100 for _ in range(n)]
        tree = Tree(weights)
        heap = [max(w, 0.5) for w in weights]
        heapq.heapify(heap)
        cost = 0.0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert abs(cost - sum(max(w, 0.5) * k for w, k in zip(weights, tree.length, strict=True))) < 1e-6
        ways = ["".join(str(int(b)) for b in tree.bits[tree.offset[i] : tree.offset[i + 1]]) for i in range(n)]
        assert len(set(ways)) == n and sum(2.0 ** -len(w) for w in ways) == pytest.approx(1)
        a, b = np.array(r.choices(range(n), k=50)), np.array(r.choices(range(n), k=50))
        for x, y, k in zip(a, b, tree.shared(a, b), strict=True):
            same = [i for i in range(min(len(ways[x]), len(ways[y])) + 1) if ways[x][:i] == ways[y][:i]]
            assert k == max(same)
        owner, place = tree.expand(a)
        assert owner.tolist() == [i for i, x in enumerate(a) for _ in ways[x]]
        assert "".join(str(int(t)) for t in tree.bits[place]) == "".join(ways[x] for x in a)


def test_followers_of_shards_equal_counts():
    r = random.Random(2)
    chunks, table = [], defaultdict(Counter)
    for _ in range(5):
        context = np.array([r.randrange(40) << 7 for _ in range(300)], np.uint64)
        number = np.array([r.randrange(6) if r.random() < 0.8 else lm_model.RARE + r.randrange(4) for _ in range(300)])
        train = np.array([r.random() < 0.7 for _ in range(300)])
        for c, t, k in zip(context.tolist(), number.tolist(), train, strict=True):
            table[c][t] += int(k)
        chunks.append(lm_model.rows_of(context, number, train))
    bodies = [bitmix.packed(lm._gaps(c), np.ascontiguousarray(t.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]), n) for c, t, n, _ in chunks]
    for (c, t, n, _), reply in zip(chunks, lm.answered(bodies, [0] * 5), strict=True):
        distinct = np.unique(c)
        mine = {int(x): int(n[c == x].sum()) for x in distinct}
        got = {int(distinct[x["at"]]): x for x in bitmix.unpacked(reply)[0]}
        assert set(got) == {x for x in mine if sum(table[x].values()) > mine[x]}
        for x, f in got.items():
            order = sorted((k for k in table[x] if table[x][k]), key=lambda k: (-table[x][k], k))
            assert (f["first"], f["n1"], f["total"]) == (order[0], table[x][order[0]], sum(table[x].values()))
            if len(order) > 1:
                assert (f["second"], f["n2"]) == (order[1], table[x][order[1]])


def test_spelling_sums_to_one():
    words = [b"ab", b"abc", b"b", b"ba"] * 3
    weights = [0] * 256
    for w in words:
        for c in w + b"\0":
            weights[c] += 1
    empty = spelling.Speller(Tree(weights), np.zeros(int(spelling.OFFSETS[-1]), np.uint16), spelling.first_weights(), bitmix.averaged(None, spelling.first_weights(), spelling.DEPTHS)[1])
    p = sum(10 ** empty.log10([bytes([c])], np.array([False]))[0] for c in range(1, 256)) + 10 ** empty.log10([b""], np.array([False]))[0]
    longer = 1 - p  # words of two bytes and more
    assert 0 < longer < 1
    two = sum((10 ** empty.log10([bytes([c, d]) for d in range(1, 256)], np.zeros(255, bool))).sum() for c in (97, 98))
    assert 0 < two <= longer + 1e-6


def test_packed_arrays_come_back():
    a = (np.arange(7, dtype=np.uint64) << np.uint64(50), np.zeros((0, 3), np.uint8), np.arange(6, dtype=np.uint8).reshape(2, 3), np.zeros(3, lm_model.FOLLOWERS), [1, None], np.array([True, False]))
    b = bitmix.unpacked(bitmix.packed(*a))
    assert all(np.array_equal(x, y) and getattr(x, "dtype", 0) == getattr(y, "dtype", 0) for x, y in zip(a, b, strict=True))


def test_words_of_arrow_texts_equal_plain_words():
    r = random.Random(3)
    texts = [None, "", " ", "a", "  A b\t\n", "ends\u0085with odd\u001cspace É\0z"] + ["".join(r.choices(" \t\n\x0b\x0c\rAbÉ \x1c\u0085z", k=r.randint(0, 20))) for _ in range(500)]
    for some in (texts, texts[:1], texts[2:3], []):
        words, sizes = lm.words_of(pa.array(some, pa.string()))
        assert words.to_pylist() == [w for t in some for w in tokens_of(t)[:-1]]
        assert sizes.tolist() == [len(tokens_of(t)) - 1 for t in some]


def test_rare_tokens_of_a_chunk_travel_in_one_row_a_task(spark):
    words = [f"w{k}".encode() for k in range(900)]
    asked = [(c, [bytearray(w) for w in words[c * 100 : c * 100 + 500]]) for c in range(5)]
    chunks = spark.createDataFrame(asked, "chunk long, rare array<binary>")
    rare = spark.createDataFrame([(bytearray(w), k, float(-k)) for k, w in enumerate(words)], "word binary, c long, lm float")
    found = lm.looked_up(chunks, rare)
    got = found.collect()
    assert len(got) <= 5 * found.rdd.getNumPartitions() < 2500
    for c in range(5):
        at, n, logs = (np.concatenate(v) for v in zip(*(bitmix.unpacked(bytes(x.body)) for x in got if x.chunk == c), strict=True))
        assert sorted(at.tolist()) == list(range(500))
        assert (n == at + c * 100).all() and (logs == -n).all()
