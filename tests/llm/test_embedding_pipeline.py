"""NN-descent against brute force, components, and the pipeline against plain versions."""

import random
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np

from lodestack.llm import embdedup, simhash
from lodestack.llm.components import connected_components

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def plain(ids, vectors, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = [[j for j in range(len(ids)) if j != i and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]) and np.dot(vectors[i], vectors[j]) / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j]) >= threshold] for i in range(len(ids))]
    label = list(range(len(ids)))
    while True:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(ids))]
        if new == label:
            break
        label = new
    least = {}
    for i, x in enumerate(label):
        if ids[i] is not None:
            least[x] = min(ids[i], least.get(x, ids[i]))
    return sorted(((ids[i], len(links[i]), least.get(label[i])) for i in range(len(ids))), key=str)


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(3)
    vectors = [v.tolist() for v in r.normal(size=(300, 16)).astype(np.float32)]
    centre = r.normal(size=16)
    vectors += [(centre + 0.08 * r.normal(size=16)).astype(np.float32).tolist() for _ in range(90)]
    vectors += [vectors[0]] * 40 + [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    ids = [*range(len(vectors) - 1), None]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, label int, node string")
    got = embdedup.near_duplicates(df).collect()
    assert sorted(((x.vec_id, x.n_links, x.component_id) for x in got), key=str) == plain(ids, vectors)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)
    assert embdedup.near_duplicates(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", list(zip(ids, vectors, strict=True)))
    assert Counter(con.execute(embdedup.ORACLE_SQL).fetchall()) == Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in got)


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(6)
    words = {"en": "stone river under bright window people never water".split(), "fr": "pierre rivière sous fenêtre gens jamais eau maison".split()}
    data = []
    for i in range(160):
        lang = ["en", "fr"][i % 2]
        data.append((i, " ".join(r.choices(words[lang], k=40)) + (f" mail u{i}@ex.org" if i % 10 == 0 else ""), lang, f"s{i % 3}", 0, "own"))
    data += [(300, data[5][1], "fr", "s1", 0, "own"), (301, "123 456", "en", "s0", 0, "own"), (302, None, None, None, None, None)]
    docs = spark.createDataFrame(data, COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    a = corpus_pipeline.language_id(spark, docs, "")
    assert a.columns == docs.columns and {x.doc_id for x in a.collect()} == {*range(160), 300}
    b = corpus_pipeline.near_dedup(spark, a, "")
    assert b.columns == docs.columns and {x.doc_id for x in b.collect()} == set(range(160))
    c = corpus_pipeline.redact(spark, b, "")
    assert c.columns == docs.columns
    for x in c.collect():
        assert "@" not in x.text and x.n_chars == len(x.text) and ("[EMAIL]" in x.text) == (x.doc_id % 10 == 0)
    d = corpus_pipeline.mix(spark, c, "")
    assert d.columns == docs.columns and d.count() > 0
    e = corpus_pipeline.run(spark, str(tmp_path))
    assert e.count() == d.count() and e.where("NOT round_trip").count() == 0


def test_near_dedup_keeps_one_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 1, ""), (1, "a b c d e f g", "en", "s", 1, ""), (2, "a b c d e f g", "en", "s", 1, ""), (None, "q r s t u v", "en", "s", 1, "")], COLUMNS)
    assert sorted((str(x.doc_id) for x in corpus_pipeline.near_dedup(spark, docs, "").collect())) == ["1", "None"]


CLASHING = ["row", "rid", "fp", "score", "lang_pred", "found", "rounds", "copy", "key", "size", "spans", "id", "a.b"]


def test_pipeline_stages_leave_clashing_columns_alone(spark):
    text = "stone river under bright window people never water "
    schema = COLUMNS + ", " + ", ".join(f"`{c}` string" for c in CLASHING if c not in ("score",)) + (", score string" if "score" not in COLUMNS else "")
    more = len(spark.createDataFrame([], schema).columns) - 6
    rows = [(i, f"{text * 4}{i} " * (1 + 3000 * (i == 7)) if i % 3 else f"{text * 5}", "en", f"s{i % 2}", 5, "own", *[f"v{i}"] * more) for i in range(30)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        assert {x[-1] for x in got.collect()} <= {f"v{i}" for i in range(30)} and got.count()
    assert corpus_pipeline.near_dedup(spark, docs, "").count() < 30


def test_near_dedup_against_plain_groups(spark):
    r = random.Random(3)
    texts = [" ".join(r.choices([f"w{k}" for k in range(50)], k=r.randint(0, 60))) for _ in range(60)]
    texts += [t.replace("w1 ", "w2 ", 1) for t in texts[:20]] + texts[:15] + [None, ""]
    docs = spark.createDataFrame([(r.choice([i, None]) if i % 9 == 0 else i, t, "en", "s", 0, "") for i, t in enumerate(texts)], COLUMNS)
    found = {}
    for x in simhash.components(docs, keep=("text",)).collect():
        found.setdefault(x.fingerprint, []).append(x)
    prints = {f: int(f, 16) for f in found}
    groups = []
    for f in prints:
        near = [g for g in groups if any((prints[f] ^ prints[o]).bit_count() <= 4 for o in g)]
        groups = [g for g in groups if g not in near] + [[f, *[o for g in near for o in g]]]
    want = sorted((min([x.doc_id for f in g for x in found[f] if x.doc_id is not None], default=-1) for g in groups))
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want


def test_pipeline_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_links_between_groups_larger_than_a_list(spark):
    r = np.random.default_rng(8)
    axes = np.linalg.qr(r.normal(size=(128, 128)))[0]
    centres = [axes[0], 0.97 * axes[0] + np.sqrt(1 - 0.97**2) * axes[1]]
    noise = np.linalg.qr(r.normal(size=(126, 126)))[0] @ axes[2:]
    vectors = [(np.sqrt(0.99) * centres[i // 40] + np.sqrt(0.01) * noise[i]).tolist() for i in range(80)]
    vectors += r.normal(size=(60, 128)).tolist()
    ids = list(range(len(vectors)))
    got = embdedup.near_duplicates(spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>")).collect()
    assert sorted(((x.vec_id, x.n_links, x.component_id) for x in got), key=str) == plain(ids, vectors)
    assert sum(x.kept for x in got) == 61


def test_recall_counts_rows_and_all_is_compared_below_the_target(spark, monkeypatch):
    r = np.random.default_rng(9)
    hot = r.normal(size=32) + 0.02 * r.normal(size=(60, 32))
    lone = r.normal(size=(40, 32))
    x = np.concatenate([hot, lone, lone + 0.01 * r.normal(size=(40, 32))])
    classes = spark.createDataFrame([(i, bytearray(v.tobytes()), 1) for i, v in enumerate(x)], "node long, v binary, n long")
    descent = embdedup.Descent(classes, np.float64, 0.95)
    linked = spark.createDataFrame([(i, 59) for i in range(60)], "node long, partners long")
    assert abs(descent.recall(linked) - 60 / 140) < 1e-9
    monkeypatch.setattr(embdedup.Descent, "start", lambda self, k: self.best(spark.createDataFrame([], "node long, nbr long, sim double, link int, new int"), k))
    vectors, ids = x.tolist(), list(range(len(x)))
    got = embdedup.near_duplicates(spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>")).collect()
    assert sorted(((v.vec_id, v.n_links, v.component_id) for v in got), key=str) == plain(ids, vectors)


def test_tables_grow_with_the_bits():
    p = 1 - np.arccos(0.95) / np.pi
    assert embdedup.n_tables(0, 0.95) == embdedup.TABLES
    assert all(1 - (1 - p**bits) ** embdedup.n_tables(bits, 0.95) >= 0.99 for bits in range(1, 23))
