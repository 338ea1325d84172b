"""Text functions, Column to Column, all inside the JVM (but NFC, which Spark lacks)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Boilerplate lines that cleaning deletes.
BOILERPLATE = r"page \d+ of \d+|página \d+ de \d+|copyright \d+|derechos reservados|all rights reserved"
# Abbreviations that do not end a sentence.
ABBREVIATIONS = ("art", "num", "pag", "cap", "vol", "ee.uu", "p.ej", "cf", "res", "dec", "ing", "lic")
# Initials, languages, formats, punctuation kept in queries.
INITIALS = "[a-záéíóúñ]"
LANGUAGES = ("es", "en", "pt")
FORMATS = ("pdf", "html", "md")
DICTIONARY_WORD = "[a-zA-ZáéíóúñüÁÉÍÓÚÑÜâêôãçÂÊÔÃÇàÀ]+"
HANGUL = "[가-힣ㄱ-ㆎ]"
#: Marks put between sentences and paragraphs while splitting.
SENTENCE_MARK, PARAGRAPH_MARK = "\u0001", "\u0002"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Words between Unicode white space; none for a blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``, evaluated once a row: the optimizer copies a
    projected expression into every filter and expression above it, but not a generated one."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def closed(c: Column, ends: str = ".?!") -> Column:
    """With a full stop at the end unless one of ``ends`` is there; empty stays empty."""
    return F.when((c == "") | F.right(c, F.lit(1)).isin(*ends), c).otherwise(F.concat(c, F.lit(".")))


def clean_text(c: Column) -> Column:
    """Control characters and boilerplate lines go, white space is evened, the end is closed."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    t = F.regexp_replace(t, rf"(?imdU)^\s*({BOILERPLATE})\b.*$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return closed(strip(F.regexp_replace(t, r"[ \t]+", " ")))


def text_hash(c: Column) -> Column:
    """md5 of the lower-cased text with single spaces."""
    return F.md5(F.array_join(tokens(F.lower(c)), " ").cast("binary"))


def clip(c: Column, max_words: int = 250) -> Column:
    """A text of at most ``max_words`` unchanged, else cut after the last sentence that fits."""
    words = tokens(c)
    raw = F.array_join(F.slice(words, 1, max_words), " ")
    whole = F.regexp_extract(raw, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.size(words) <= max_words, c).when(whole != "", whole).otherwise(closed(raw, ".!?"))


def paragraphs(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), r"(?U)\n\s*\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Sentences of one paragraph: cut after . ! ? before white space, but not after an
    abbreviation or an initial."""
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    marked = F.regexp_replace(strip(c), r"(?U)([.!?])\s+", f"$1{SENTENCE_MARK}")
    joined = F.regexp_replace(marked, rf"(?iuU)(?<=^|[\s{SENTENCE_MARK}])((?:{names}|{INITIALS})\.+){SENTENCE_MARK}", "$1 ")
    return F.filter(F.split(joined, SENTENCE_MARK), lambda s: s != "")


def document_sentences(c: Column) -> Column:
    return F.flatten(F.transform(paragraphs(c), sentences))


def token_estimate(c: Column) -> Column:
    """1.3 tokens a word, half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(word_count(c) * F.lit(1.3)).cast("int"))


def clamp_language(c: Column) -> Column:
    return F.when(c.isin(*LANGUAGES), c).otherwise(F.lit("es"))


def clamp_format(c: Column) -> Column:
    return F.when(F.lower(c).isin(*FORMATS), F.lower(c)).otherwise(F.lit("pdf"))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def nfc(c: Column) -> Column:
    """Unicode NFC; plain ASCII never leaves the JVM."""
    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([unicodedata.normalize("NFC", t) if t is not None else None for t in texts.to_pylist()], pa.string())

    return of(c)


def clean_query(c: Column) -> Column:
    """Query text: NFC, control characters and foreign punctuation to spaces, squeezed."""
    t = nfc(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, r"[\r\n\t\x00-\x1f\x7f-\x9f]", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s.,?!¿¡\-]", " ")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def has_acronym(c: Column) -> Column:
    """Is a word of more than one character all upper case?"""
    return F.exists(tokens(c), lambda w: (F.length(w) > 1) & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"))


def candidate_ok(text: Column, language: Column | None = None) -> Column:
    """Not blank, no Hangul, and of an accepted language where one is given."""
    ok = (strip(F.coalesce(text, F.lit(""))) != "") & ~text.rlike(HANGUL)
    if language is not None:
        lang = F.lower(F.coalesce(language, F.lit("")))
        ok = ok & ((lang == "") | lang.isin("es", "en", "spanish", "english"))
    return ok


#: Frequent function words, for the built-in language rule.
FUNCTION_WORDS = {
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "del", "se", "no", "es"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by", "be", "this"),
    "pt": ("o", "os", "as", "do", "da", "que", "e", "em", "um", "uma", "por", "com", "para", "dos", "não", "na", "no"),
}


def detect_language(c: Column, head: int = 2000) -> Column:
    """Language by function words among the first ``head`` characters; es where none leads."""
    words = tokens(F.lower(F.left(F.coalesce(c, F.lit("")), F.lit(head))))
    score = {k: _hits(words, k) for k in LANGUAGES}
    return F.when((score["en"] > score["es"]) & (score["en"] >= score["pt"]), "en").when((score["pt"] > score["es"]) & (score["pt"] > score["en"]), "pt").otherwise("es")


def _hits(words: Column, language: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*FUNCTION_WORDS[language])))
