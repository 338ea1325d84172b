"""Text functions and chunking against plain versions, with the traps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.operators.chunk import ChunkConfig, chunks, windows


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def plain_clean(t):
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", t or "")
    t = re.sub(rf"(?im)^\s*({X.BOILERPLATE})\b.*$", "", t)
    t = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", t)).strip()
    return t + "." if t and t[-1] not in ".?!" else t


def test_clean(spark):
    texts = ["a\x00b  c\t d", "Page 3 of 9\nreal", "x\n\n\n\ny", "  página 2 de 3 etc\nhola!", "", None, "\x85\xa0 z ", "ALL RIGHTS RESERVED 2020\nt\r\nu", "copyright 2001 me", "ok?"]
    assert one(spark, X.clean_text, *texts) == [plain_clean(t) for t in texts]


def test_word_count_and_tokens(spark):
    texts = ["", "  ", "a b", "a\u0085b c", " x\n\ty "]
    assert one(spark, X.word_count, *texts) == [len(t.split()) for t in texts]
    many = [" ".join(["w"] * n) for n in range(1, 60)]
    assert one(spark, X.token_estimate, *many) == [max(1, round(n * 1.3)) for n in range(1, 60)]


def test_clip(spark):
    short = "One sentence  with   its spaces."
    long = " ".join([" ".join(["w"] * 99) + " end."] * 3)
    none = " ".join(["w"] * 300)
    got = one(spark, lambda c: X.clip(c, 250), short, long, none)
    assert got[0] == short and got[1] == " ".join([" ".join(["w"] * 99) + " end."] * 2) and got[2] == " ".join(["w"] * 250) + "."


def test_sentences_keep_abbreviations(spark):
    got = one(spark, X.sentences, "See art. 5 of it. Then EE.UU. said J. P. Diaz left! Yes? No.", "", "a. b. c. d.")
    assert got == [["See art. 5 of it.", "Then EE.UU. said J. P. Diaz left!", "Yes?", "No."], [], ["a. b. c. d."]]


def test_paragraphs(spark):
    assert one(spark, X.paragraphs, "a\n \nb\nc\n\n\n\nd", "", "  x  ") == [["a", "b\nc", "d"], [], ["x"]]


def test_candidates_and_queries(spark):
    assert one(spark, X.candidate_ok, "text", " ", "한글 x", "ㄱ") == [True, False, False, False]
    assert one(spark, X.clean_query, "  ¿¿Cómo   afecta la IA a la defensaaa?? \n\t ", "Café *x*#", None) == ["¿¿Cómo afecta la IA a la defensaaa??", "Café x", ""]
    assert one(spark, X.has_acronym, "the IA a", "Is A b", "ÑU x", "A1 x") == [True, False, True, True]


def plain_windows(sizes, most, overlap):
    out, start = [], 0
    while start < len(sizes):
        end, total = start, 0
        while end < len(sizes) and (end == start or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        out.append((start, end))
        if end == len(sizes):
            break
        start = max(end - overlap, start + 1)
    return out


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_windows(overlap):
    r = random.Random(overlap)
    for _ in range(500):
        sizes = [r.choice([1, 5, 12, 30, 240, 260]) for _ in range(r.randint(0, 12))]
        assert windows(sizes, 250, overlap) == plain_windows(sizes, 250, overlap)
    assert windows([240, 20, 300, 1], 250, 1) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert windows([100, 240, 200], 250, 1) == [(0, 1), (1, 2), (2, 3)]


def test_chunks(spark):
    sentence = " ".join(["w"] * 99) + " end."
    d = spark.createDataFrame([("d1", " ".join([sentence] * 5), "f", "html", "3", "en"), ("d2", "  ", "f", "csv", None, "de"), ("d3", "Short.", "f", "csv", "x", "de")], "doc_id string, texto string, fuente string, formato string, fenomeno string, idioma string")
    got = sorted(chunks(d, ChunkConfig(250, 1)).collect(), key=lambda r: r.chunk_id)
    assert [r.chunk_id for r in got] == ["d1-chunk-000", "d1-chunk-001", "d1-chunk-002", "d1-chunk-003", "d3-chunk-000"]
    assert got[0].num_tokens == 260 and got[0].formato == "html" and got[0].fenomeno == 3
    assert (got[4].formato, got[4].idioma, got[4].fenomeno, got[4].num_tokens) == ("pdf", "es", 1, 1)
