"""Language ID, BPE, SimHash, PII, quality, LM, media: brute force, round trips, edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestack.llm import bpe, gbt, langid, lm, media, pii, quality, simhash, simhash_sql

COLUMNS = "doc_id long, text string, lang string, source string, score string, rid long, id long"
LONG = "wort é zwei drei " * 20_000


def frame(spark, data):
    return spark.createDataFrame([(*d, *([None] * (7 - len(d)))) for d in data], COLUMNS)


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "1 2 3 !"), (None, "Some words here now"), (5, LONG), (6, "Some words here now"), (6, "Some words here now"), (7, "ends\u0085with odd space\u001c")]


# ---- language ID


def test_langid_learns_and_falls_back(spark):
    r = random.Random(0)
    vocabulary = {"en": ["house", "thinking", "water", "there"], "es": ["casa", "corazón", "agua", "pensando"]}
    data = [(i, " ".join(r.choices(vocabulary[lang], k=12)), lang) for i in range(120) for lang in [["en", "es"][i % 2]]]
    got = {x.doc_id: x for x in langid.identify(frame(spark, [*data, (500, "housing thinker"), (501, None), (502, "12 -- 3"), (503, "")])).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in data)
    assert got[500].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (501, 502, 503))
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in got.values())


def letter_runs(text):
    return [w for w in "".join(c if c.isalpha() else " " for c in text).split(" ") if w]


def plain_langid(data):
    """(lang, score) of every text, from plain counts."""
    counts = [defaultdict(Counter) for _ in range(6)]  # words, then n-grams by length
    for i, text, lang in data:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for w in letter_runs(text.lower()):
                counts[0][w][lang] += 1
                padded = f"<{w}>"
                for n in range(1, 6):
                    for a in range(len(padded) - n + 1):
                        if padded[a : a + n] not in "<>":
                            counts[n][padded[a : a + n]][lang] += 1
    langs = sorted({lang for c in counts[0].values() for lang in c})

    def logs(table, key):
        out = [math.log((table[key][g] + 0.5) / (sum(c[g] for c in table.values()) + 0.5 * len(table))) for g in langs]
        return [x - sum(out) / len(out) for x in out]

    for _, text, _ in data:
        words = letter_runs((text or "").lower())
        total = [0.0] * len(langs)
        for w in words:
            if w in counts[0]:
                got = [logs(counts[0], w)]
            else:
                got = []
                for n in range(5, 0, -1):
                    padded = f"<{w}>"
                    got = [logs(counts[n], g) for a in range(len(padded) - n + 1) if (g := padded[a : a + n]) not in "<>" and g in counts[n]]
                    if got:
                        break
            for g in got:
                total = [t + x / len(got) for t, x in zip(total, g, strict=True)]
        if not words:
            yield "und", 0.0
            continue
        total = [t / math.sqrt(len(words)) for t in total]
        yield langs[total.index(max(total))], 1 / sum(math.exp(t - max(total)) for t in total)


def test_langid_against_brute_force(spark):
    r = random.Random(5)
    sounds = {"de": ["sch", "ei", "en", "ü", "t"], "fr": ["é", "eau", "x", "en", "t"], "xx": ["q", "w", "en", "kk"]}
    data = []
    for i in range(80):
        lang = r.choice(list(sounds))
        data.append((i, " ".join("".join(r.choices(sounds[lang], k=r.randint(1, 4))) for _ in range(r.randint(1, 9))), r.choice([lang, lang, None])))
    data += [(100, "zzz schx 12ei² T", None), (101, "² ½ Ⅳ ①", "de"), (102, "3x², x", None)]
    rows = langid.identify(frame(spark, data)).collect()
    want = {d[0]: w for d, w in zip(data, plain_langid(data), strict=True)}
    assert want[101][0] == "und"
    for x in rows:
        assert x.lang_pred == want[x.doc_id][0] and abs(x.score - want[x.doc_id][1]) < 1e-9, x


def test_langid_knows_every_word_of_its_documents(spark):
    data = [(i, " ".join(f"{chr(97 + i % 26)}{''.join(chr(97 + int(c)) for c in str(i * 997 + k))}" for k in range(60)), ["en", "es"][i % 2]) for i in range(400)]
    model = langid.fit(frame(spark, data), F.lit(True))
    assert set(model.find[0]) == {w for _, text, _ in data for w in text.split()}


def test_langid_edges(spark):
    assert langid.identify(frame(spark, EDGE)).count() == len(EDGE)  # no labels at all
    assert {x.lang_pred for x in langid.identify(frame(spark, EDGE)).collect()} == {"und"}
    assert langid.identify(frame(spark, EDGE).limit(0)).count() == 0


# ---- BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(bpe.tokenizer_path()), bpe.codepoint_classes())


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.tokenizer_path()), special_tokens={})


def test_bpe_equals_library(codec, reference):
    r = random.Random(5)
    alphabet = ["'", "'s", "'re", "'l", "'ve", " ", "  ", "\n", "\t", " ", "　", "a", "Z", "é", "中", "9", "٣", "!", "..", "😀", "\x00", "\x85", "\x1c", "́", "t"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 14))) for _ in range(6000)] + ["", "a" * 3000, " " * 500, "!" * 900, LONG, "<|endoftext|>"]
    for part in (texts[:3000], texts[3000:]):
        for text, (ids, starts) in zip(part, codec.encode([t.encode() for t in part]), strict=True):
            assert ids == reference.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()
            assert set(starts.tolist()) <= set(codec.token_starts(ids).tolist())


def test_bpe_frames(spark, reference):
    got = bpe.digests(frame(spark, EDGE)).collect()
    want = Counter()
    for i, t, *_ in EDGE:
        ids = reference.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    back = bpe.decode(bpe.encode(frame(spark, EDGE))).collect()
    assert all(bytes(x.decoded) == (x.text or "").encode() and len(x.ids) == len(x.id_starts) for x in back)
    assert bpe.digests(frame(spark, EDGE).limit(0)).count() == 0


# ---- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, prints, most):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_against_brute_force(spark):
    r = random.Random(2)
    base = [" ".join(r.choices("alpha beta gamma delta Eps zeta eta theta".split(), k=60)) for _ in range(12)]
    data = list(EDGE[:-1])
    for i in range(80):
        words = base[i % 12].split()
        words[r.randrange(60)] = "changed"
        data.append((100 + i, " ".join(words)))
    got = simhash.components(frame(spark, data)).collect()
    prints = [plain_fingerprint(t) for _, t, *_ in data]
    want = Counter(zip([d[0] for d in data], [f"{p:016x}" for p in prints], plain_components([d[0] for d in data], prints, 4), strict=True))
    assert Counter(map(tuple, got)) == want
    assert simhash.components(frame(spark, data).limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [d[:2] for d in data])
    assert Counter(con.execute(simhash_sql.ORACLE_SQL).fetchall()) == want


def test_sql_hash_equals_library():
    r = random.Random(1)
    texts = ["".join(r.choice("abcñ zé€") for _ in range(n)) for n in [*range(80), 500]]
    con = duckdb.connect()
    con.execute("CREATE TABLE shingle (s VARCHAR)")
    con.executemany("INSERT INTO shingle VALUES (?)", [(t,) for t in texts])
    found = con.execute(f"WITH {simhash_sql.hashed()} SELECT s, h FROM hash").fetchall()
    assert dict(found) == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}


@pytest.mark.parametrize("spread", [3, 9])
def test_simhash_links_keep_components(spark, spread):
    """Dense groups (buckets above the pairwise limit) and chains of links."""
    r = random.Random(spread)
    prints = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        bits = r.sample(range(64), spread)
        for _ in range(150):
            prints.add(centre ^ sum(1 << b for b in bits if r.random() < 0.4))
    chain = r.getrandbits(64)
    for i in range(14):
        chain ^= sum(1 << b for b in r.sample(range(64), 4))
        prints.add(chain)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"), 4).collect()
    assert all(((x.a ^ x.b) & (2**64 - 1)).bit_count() <= 4 for x in links)
    want = plain_components(signed, prints, 4)
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for x in links:
        a, b = find(x.a), find(x.b)
        root[max(a, b)] = min(a, b)
    assert [find(p) for p in signed] == want


# ---- PII


def plain_spans(x):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if c > "4" else 0) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = {
        "email": list(re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)),
        "ip": [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m)) <= 15],
    }
    return [(k, m.start(), m.end()) for k, ms in found.items() for m in ms]


def test_pii_against_brute_force(spark):
    r = random.Random(4)
    parts = ["a@b.co", "x.y+z@d-e.org.", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "0000000000000", "+1 (446) 555-8962", "+44 20", "+", "7", " ", "é", "😀", "(", "-", ".", "word", "tel ", "0255.0.00.001"]
    data = [(i, "".join(r.choices(parts, k=r.randint(0, 14)))) for i in range(500)] + [(900, "9" * 5000 + "@a.b " + "a" * 20000), (901, "+" + "1 " * 4000), (902, None), (903, ""), (None, "1.2.3.4"), (None, "1.2.3.4")]
    got = Counter()
    for x in pii.report(frame(spark, data)).collect():
        base = [s for s in x.spans.split(",") if s]
        got[(x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256)] += 1
        assert len(base) >= x.n_email + x.n_ip + x.n_card + x.n_phone
    want = Counter()
    for i, t in data:
        spans = plain_spans(t or "")
        n = Counter(k for k, _, _ in spans)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
    assert got == want
    assert pii.report(frame(spark, data).limit(0)).count() == 0


def test_pii_redacts_and_adds_looser_spans(spark):
    shapes = ["call +1 (446) 555-{:04d} now", "mail a{}@b.org please", "host 10.0.0.{} up", "card 4111 1111 1111 1111 ok {}", "bad 4111 1111 1111 1112 no {}", "id +12 {}"]
    data = [(i, shapes[i % 6].format(i % 250)) for i in range(600)] + [(1000, "card 4111.1111.1111.1111 é"), (1001, "two a@b.org and 1.2.3.4")]
    df = frame(spark, data)
    found = {x.doc_id: x for x in pii.report(df).collect()}
    assert found[1000].n_card == 0 and found[1000].spans == "card:5:24"
    out = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert out[1001] == "two [EMAIL] and [IP]" and out[1000] == "card [CARD] é" and out[4] == data[4][1]
    assert pii.redact(df).columns == df.columns


def test_pii_context_decides_between_equal_formats(spark):
    pairs = [("host 10 . 20 . 130 . 40 now", "version 10 . 20 . 130 . 40 now"), ("card 4111.1111.1111.1111", "order 4111.1111.1111.1111"), ("call 415-555-0132, thanks", "part 415-555-0132 units"), ("write to jo(at)acme(dot)net", "lamps sold (at) cost.plus items")]
    found = {x.doc_id: x.spans for x in pii.report(frame(spark, [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)])).collect()}
    assert [found[2 * i].split(":")[0] for i in range(4)] == ["ip", "card", "phone", "email"]
    assert not any(found[2 * i + 1] for i in range(4))


def test_pii_labels_are_not_the_check_of_the_kind(spark):
    some = pii.examples(spark, 1200)
    found = pii.candidates(some.select("rid", *pii._scan(some["text"]))).where("NOT base").join(some.select("rid", "planted", "y", "kept"), "rid").where("kind = planted").collect()
    assert {k for k in range(4)} == {x.kind for x in found}
    assert {(x.valid, x.y) for x in found} >= {(True, 1), (True, 0)}
    trees, thresholds = pii.fit(spark)
    x = np.array([[r[f] for f in pii.FEATURES] for r in found], float)
    chosen = trees.probability(x) >= np.array(thresholds)[x[:, 0].astype(int)]
    y = np.array([r.y for r in found])
    assert y[chosen].mean() > 0.97 and chosen[y == 1].mean() > 0.5 and {"context", "other"} <= {pii.FEATURES[f] for f in trees.feature[trees.left != np.arange(len(trees.left))]}


# ---- quality


def test_quality_separates(spark):
    r = random.Random(8)
    data, labels = [], []
    for i in range(600):
        good = i % 2
        words = [r.choice(["the", "stone", "river", "under", "bright"]) for _ in range(30)]
        data.append((i, (" ".join(words) + ".") if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, good, 0))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(frame(spark, data), lab).collect()
    held = [x for x in got if x.held_out]
    assert held and all(x.predicted == x.doc_id % 2 == (x.score >= 0.3) for x in held)
    assert quality.score(frame(spark, EDGE), lab.limit(0)).count() == len(EDGE)
    assert quality.score(frame(spark, EDGE).limit(0), lab).count() == 0


def test_flattened_trees_equal_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    t = gbt.fit(x, y, trees=30, depth=3)

    def walk(row):
        total = t.base
        for i in t.roots:
            while t.left[i] != i:
                i = t.left[i] if row[t.feature[i]] <= t.cut[i] else t.right[i]
            total += t.value[i]
        return total

    assert np.allclose(t.margin(x), [walk(row) for row in x])
    assert ((t.probability(x) > 0.5) == y).mean() > 0.9


# ---- LM


def test_lm_contract(spark):
    r = random.Random(1)
    words = ["alpha", "Beta", "gamma", "ünder", "x"]
    data = [(i, " ".join(r.choices(words, weights=(9, 5, 2, 1, 1), k=20))) for i in range(200)] + list(EDGE)
    got = lm.score(frame(spark, data)).collect()
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in data if not held(i) for w in token(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in data:
        want.setdefault(i, []).append((held(i), len(token(t)), sum(c[w] > 0 for w in token(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token(t))))
    assert len(got) == len(data)
    for x in got:
        assert x.train_tokens == n and x.score < 0 and x.bits_per_byte > 0
        assert any((x.held_out, x.n_tokens, x.n_known) == w[:3] and math.isclose(x.base_score, w[3], rel_tol=1e-9) for w in want[x.doc_id])
    assert lm.score(frame(spark, data).limit(0)).count() == 0


# ---- media


def test_media_round_trip(spark, tmp_path):
    got = media.round_trip(frame(spark, EDGE), str(tmp_path / "a")).collect()
    want = Counter()
    for i, t in EDGE:
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert Counter((x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in got) == want
    assert media.round_trip(frame(spark, EDGE).limit(0), str(tmp_path / "b")).count() == 0


def test_media_appends_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")

    def ids():
        return sorted(x.id for x in media.load(spark, path).collect())

    media.store(frame(spark, [(1, "a"), (2, "b")]), path)
    media.store(frame(spark, [(3, "c")]), path)
    assert ids() == [1, 2, 3]
    media.store(frame(spark, [(4, "d")]), path, mode="overwrite")
    assert ids() == [4] and len(list((tmp_path / "t").glob("part-*.zip"))) == 1
    media.store(frame(spark, [(5, "e")]), path)
    assert ids() == [4, 5]


def test_media_deletes_archives_of_failed_attempts(tmp_path):
    writer = media.ArchiveWriter(str(tmp_path))
    batch = pa.record_batch([pa.array([7]), pa.array([b"x"], pa.binary())], ["id", "media"])
    kept, lost = writer.write(iter([batch])), writer.write(iter([batch]))
    other = media.ArchiveWriter(str(tmp_path)).write(iter([batch]))
    writer.commit([kept, None])
    names = {p.name for p in tmp_path.glob("part-*")}
    assert names == {kept.archives[0][0], other.archives[0][0]} and lost.archives[0][0] not in names
    media.ArchiveWriter(str(tmp_path)).abort([])
    assert {p.name for p in tmp_path.glob("part-*")} == names


def test_media_form_and_feature(spark, tmp_path):
    """The stored form is a PNG of the payload's samples, the feature is computed from them."""
    for x in media.round_trip(frame(spark, EDGE[:4]), str(tmp_path / "f")).collect():
        b = (dict(EDGE[:4])[x.doc_id] or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        png = media.encode_image(p)
        rows = np.frombuffer(p, np.uint8).reshape(-1, 576)
        at, body, found = 8, b"", {}
        while at < len(png):  # chunks: length, kind, data, checksum
            n, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
            found[kind] = found.get(kind, b"") + png[at + 8 : at + 8 + n]
            assert zlib.crc32(png[at + 4 : at + 8 + n]) == int.from_bytes(png[at + 8 + n : at + 12 + n], "big")
            at += 12 + n
        assert (int.from_bytes(found[b"IHDR"][:4], "big"), int.from_bytes(found[b"IHDR"][4:8], "big"), found[b"IHDR"][8:10]) == (576, len(rows), b"\x08\x00")
        assert x.media_bytes == len(png) and x.media_sha256 == hashlib.sha256(png).hexdigest() and media.decode_image(png).tobytes() == p
        assert len(zlib.decompress(found[b"IDAT"])) == len(rows) * 577
        n, mean = len(p), sum(p) / len(p)
        dev = math.sqrt(sum((v - mean) ** 2 for v in p) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(p).values())
        step = sum(abs(v - u) for u, v in zip(p, p[1:], strict=False)) / (n - 1)
        got = dict(part.split("=") for part in x.feature.split(";"))
        assert all(abs(float(got[k]) - v) < 1e-3 for k, v in {"mean": mean, "dev": dev, "entropy": entropy, "step": step}.items())
        assert [int(h) for h in got["hist"].split(",")] == [sum(v // 32 == i for v in p) * 1000 // n for i in range(8)]


def test_media_ranges_cover_every_member_once(spark, tmp_path):
    media.store(frame(spark, [(i, f"text {i} " * 50) for i in range(200)]).coalesce(2), str(tmp_path / "c"))
    got = media.load(spark, str(tmp_path / "c"), range_bytes=3000).collect()
    assert sorted(x.id for x in got) == list(range(200)) and all(x.tries == 1 and x.error is None for x in got)


def test_media_retries_one_member(tmp_path):
    import zipfile

    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(3):
            z.writestr(zipfile.ZipInfo(f"{i}/0.png"), bytes([i]) * 50)
    fails = {"n": 0}

    def flaky(p):
        fs, name = media._open(p)

        class Broken:
            def open_input_file(self, n):
                f = fs.open_input_file(n)
                read = f.read

                class File:
                    seek, tell, seekable, size = f.seek, f.tell, f.seekable, f.size

                    def read(self, k=None):
                        got = read(k)
                        if got[:1] == b"\x01" and fails["n"] < 2:
                            fails["n"] += 1
                            return got[:-1] + b"?"
                        return got

                return File()

        return Broken(), name

    media.PAUSE = 0
    m = media.Members(str(path), opener=flaky)
    got = [m.read(i) for i in zipfile.ZipFile(path).infolist()]
    assert [(b, t) for b, t, _ in got] == [(b"\x00" * 50, 1), (b"\x01" * 50, 3), (b"\x02" * 50, 1)]
    raw = bytearray(path.read_bytes())
    raw[raw.index(b"\x01" * 50)] = 9
    path.write_bytes(raw)
    body, tries, error = media.Members(str(path)).read(zipfile.ZipFile(path).infolist()[1])
    assert body is None and tries == 3 and "damaged" in error
