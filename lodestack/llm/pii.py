"""Personal data: candidate gradient boosting (DataFrame operations only).

High-recall generators propose overlapping spans: the four base patterns and looser forms of
them. Boosted trees over format and context features, written out as SQL expressions, score the
looser ones; thresholds calibrated per kind select which are added to the base spans. Labels are
those of generated sentences: personal data of a kind in its many forms, and the numbers that
look like it (versions, sections, orders, parts, prices), in contexts that tell and that do not.
A third of the sentences is kept from the trees and calibrates the thresholds. No label is
computed from a feature, and the corpus has no part in the model.

Positions come from the lengths of what lies between matches, summed in windows over short rows.
A text is scanned once; :func:`report` never moves it, :func:`redact` moves those that have a
candidate, once, to their spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import gbt
from .common import cut, discard, text_or_empty

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base patterns, in a form that scans in linear time with the same matches
# (possessive where nothing could be given back; a run is tried from its start only).
BASE_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
BASE_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
BASE_CARD = r"[0-9](?:[ -]?[0-9])++"
BASE_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A run that can hold a numeric match; no match of BASE_IP, BASE_CARD, BASE_PHONE or their
#: looser forms goes beyond one.
ISLAND = r"[0-9+(][0-9 .()+-]*+"
#: Looser forms: proposed, then scored.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(][Aa][Tt][\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(][Dd][Oo][Tt][\])] ?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+)++"
LOOSE_AT = r"[\[(][Aa][Tt][\])]"
LOOSE_IP = r"(?<![0-9])[0-9]{1,3}+(?: ?\. ?[0-9]{1,3}+){3}+"
LOOSE_CARD = r"(?<![0-9])[0-9]{4}+(?:[ .-]{1,2}+[0-9]{4}+){3}+"
LOOSE_PHONE = r"(?<![0-9])\(?[0-9]{3}+\)?[ .-]{1,2}+[0-9]{3}+[ .-][0-9]{4}+"
#: What an island needs for any of its forms (possessive: linear).
FOUR_DIGITS = r"(?:[0-9][^0-9]*+){4}"
#: Characters of context kept before and after a match.
BEFORE, AFTER = 32, 8
#: Words that announce a kind, words that announce something else, words that follow a quantity.
CONTEXT = {EMAIL: "e-?mail|mail|contact|write|reach", IP: "ip|host|server|address|gateway|ping", CARD: "card|visa|credit|cc|payment|charged?", PHONE: "tel|phone|call|fax|mobile|ring|dial"}
OTHER = "version|release|build|section|chapter|figure|rule|order|invoice|serial|tracking|isbn|ticket|part|item|sku|lot|code|ref|sold|price|arrive|look|meet|open|page"
COUNTED = "units|items|pcs|rows|kg|km|pages|each"
FEATURES = ("kind", "n_digits", "n_length", "n_seps", "n_distinct", "luhn", "parts", "paren", "before_alnum", "after_alnum", "context", "other", "counted")
#: Sentences generated, shape of the trees, precision that a kind's threshold must reach among
#: the sentences kept for it (one of KEPT), and how many selected ones must show it.
EXAMPLES, TREES, DEPTH, PRECISION, KEPT, SHOWN = 6000, 24, 3, 0.98, 3, 20


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<gap, m, before, after>>: every match with the text around it."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pair = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), m.alias("m"), F.right(g, F.lit(BEFORE)).alias("before")))
    pair = F.slice(pair, F.lit(1), F.size(found))
    after = F.transform(F.slice(gaps, F.lit(2), F.size(found)), lambda g: F.left(g, F.lit(AFTER)))
    return F.zip_with(pair, after, lambda p, a: F.struct(p["gap"].alias("gap"), p["m"].alias("m"), p["before"].alias("before"), a.alias("after")))


_TYPE = "array<struct<gap:bigint,m:string,before:string,after:string>>"


def _scan(text: Column) -> list[Column]:
    none = F.array().cast(_TYPE)
    return [
        F.when(F.contains(text, F.lit("@")), _matches(text, BASE_EMAIL)).otherwise(none).cast(_TYPE).alias("emails"),
        F.when(text.rlike(LOOSE_AT), _matches(text, LOOSE_EMAIL)).otherwise(none).cast(_TYPE).alias("loose_emails"),
        F.when(text.rlike("[0-9]"), _matches(text, ISLAND)).otherwise(none).cast(_TYPE).alias("islands"),
    ]


def _placed(df: DataFrame, keys: list[str], found: str) -> DataFrame:
    """Explode matches and give each its start (code points)."""
    rows = df.where(F.size(found) > 0).select(*keys, F.posexplode(found).alias("at", "x")).select(*keys, "at", "x.*")
    so_far = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("start", F.sum(F.col("gap") + F.length("m")).over(so_far) - F.length("m"))


def _luhn_sum(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _luhn(digits: Column) -> Column:
    return _luhn_sum(digits) == 0


def candidates(scanned: DataFrame) -> DataFrame:
    """``scanned``: ``rid`` and the arrays of :func:`_scan`. One row per proposed span:
    rid, kind, base (a base-pattern match), valid, start, end, features."""
    mails = []
    for found, base in (("emails", True), ("loose_emails", False)):
        m = _placed(scanned.select("rid", found), ["rid"], found)
        mails.append(m.select("rid", F.lit(EMAIL).alias("kind"), F.lit(base).alias("base"), "start", "m", "before", "after"))
    islands = _placed(scanned.select("rid", "islands"), ["rid"], "islands")
    islands = islands.where(F.col("m").rlike(FOUR_DIGITS)).select("rid", F.col("start").alias("origin"), F.col("m").alias("run"), F.col("before").alias("run_before"), F.col("after").alias("run_after"))
    forms = [(IP, True, BASE_IP), (CARD, True, BASE_CARD), (PHONE, True, BASE_PHONE), (IP, False, LOOSE_IP), (CARD, False, LOOSE_CARD), (PHONE, False, LOOSE_PHONE)]
    forms = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("base"), _matches(F.col("run"), p).cast(_TYPE).alias("found")) for k, b, p in forms])
    inside = islands.select("rid", "origin", "run_before", "run_after", F.explode(forms).alias("f")).select("rid", "origin", "run_before", "run_after", "f.*")
    inside = _placed(inside, ["rid", "origin", "run_before", "run_after", "kind", "base"], "found")
    inside = inside.withColumn("before", F.when(F.col("at") == 0, F.right(F.concat("run_before", "before"), F.lit(BEFORE))).otherwise(F.col("before")))
    inside = inside.withColumn("after", F.left(F.concat("after", "run_after"), F.lit(AFTER)))
    both = inside.select("rid", "kind", "base", (F.col("origin") + F.col("start")).alias("start"), "m", "before", "after")
    for m in mails:
        both = both.unionByName(m)
    digits = F.regexp_replace("m", "[^0-9]", "")
    c = both.withColumn("end", F.col("start") + F.length("m")).withColumn("digits", digits).withColumn("n_digits", F.length("digits"))
    parts = F.forall(F.split(F.regexp_replace("m", " ", ""), r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(999)) <= 255))
    c = c.withColumn("luhn", F.when(F.col("n_digits").between(13, 19), _luhn(F.col("digits"))).otherwise(F.lit(False)))
    c = c.withColumn("parts", F.when(F.col("kind") == IP, parts).otherwise(F.lit(False)))
    ok = F.when(F.col("kind") == EMAIL, True).when(F.col("kind") == IP, F.col("parts")).when(F.col("kind") == CARD, F.col("luhn")).otherwise(F.col("n_digits").between(9, 15))
    context = F.lit(False)
    for k, words in CONTEXT.items():
        context = context | ((F.col("kind") == k) & F.lower("before").rlike(rf"\b(?:{words})"))
    return c.select(
        "rid",
        "kind",
        "base",
        ok.alias("valid"),
        "start",
        "end",
        F.least("n_digits", F.lit(32)).alias("n_digits"),
        F.least(F.length("m"), F.lit(64)).alias("n_length"),
        F.least(F.length("m") - F.col("n_digits"), F.lit(32)).alias("n_seps"),
        F.size(F.array_distinct(F.split(F.left("digits", F.lit(32)), ""))).alias("n_distinct"),
        F.col("luhn").cast("int").alias("luhn"),
        F.col("parts").cast("int").alias("parts"),
        F.contains("m", F.lit("(")).cast("int").alias("paren"),
        F.col("before").rlike(r"[\p{L}\p{N}]$").cast("int").alias("before_alnum"),
        F.col("after").rlike(r"^[\p{L}\p{N}]").cast("int").alias("after_alnum"),
        context.cast("int").alias("context"),
        F.lower("before").rlike(rf"\b(?:{OTHER})").cast("int").alias("other"),
        F.lower("after").rlike(rf"^ ?(?:{COUNTED})").cast("int").alias("counted"),
    )


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """``n`` sentences: ``rid``, ``text``, the ``planted`` kind that it has something like, ``y``
    (1: personal data) and ``kept`` (for the thresholds). Nothing in them is random between runs."""

    def lot(salt: int, size: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(size))

    def pick(salt: int, values: list) -> Column:
        return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (lot(salt, len(values)) + 1).cast("int"))

    def digits(salt: int, size: int) -> Column:
        return F.lpad(lot(salt, 10**size).cast("string"), size, "0")

    def joined(gap: Column | str, parts: list[Column]) -> Column:
        gap = F.lit(gap) if isinstance(gap, str) else gap
        return F.concat(*[x for p in parts for x in (gap, p)][1:])

    name = F.concat(pick(1, ["ana", "jo.smith", "lee_k", "m-ruiz", "info", "team7"]), pick(2, ["", "", "3", "84"]))
    host = pick(3, ["mail", "post-box", "acme", "uni", "north"])
    end = pick(4, ["com", "org", "net", "de"])
    mail = pick(5, [F.concat(name, F.lit(a), host, F.lit(d), end) for a, d in (("(at)", "(dot)"), (" [at] ", "."), ("[AT]", "[DOT]"), (" (at) ", " (dot) "))])
    thing = pick(6, ["sold", "price", "lamps", "arrive", "page", "meet"])
    place = pick(7, ["cost", "noon", "gate", "dawn", "two"])
    no_mail = pick(8, [F.concat(thing, F.lit(" (at) "), place, F.lit("."), pick(9, ["two", "5", "plus", "late"])), F.concat(thing, F.lit(" [at] "), place, F.lit(" (dot) "), pick(10, ["next", "10", "off"]))])

    def quad(salt: int, least: int, size: int) -> Column:
        return joined(pick(salt + 9, [" . ", ". ", "."]), [(lot(salt + k, size) + least).cast("string") for k in range(4)])

    address, outline = quad(20, 1, 255), pick(40, [quad(41, 0, 12), quad(61, 1, 60), quad(81, 1, 255)])
    most = F.concat(pick(100, ["4", "51", "37", "6011"]), digits(101, 15))
    most = F.substring(most, 1, 15)
    number = F.concat(most, F.pmod(10 - _luhn_sum(F.concat(most, F.lit("0"))), F.lit(10)).cast("string"))
    card = joined(pick(102, [".", "  ", ". ", "-"]), [F.substring(number, 4 * k + 1, 4) for k in range(4)])
    a, b, c = (lot(110, 700) + 200).cast("string"), digits(111, 3), digits(112, 4)
    phone = pick(113, [F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c), joined(".", [a, b, c]), joined("-", [a, b, c]), joined(" ", [a, b, c])])

    kind, y = lot(120, 4), lot(121, 2)
    body = F.when(kind == EMAIL, F.when(y == 1, mail).otherwise(no_mail)).when(kind == IP, F.when(y == 1, address).otherwise(outline)).when(kind == CARD, card).otherwise(phone)

    def of_kind(words: dict[int, list[str]], salt: int) -> Column:
        out = F.lit("")
        for k, some in words.items():
            out = F.when(kind == k, pick(salt + k, some)).otherwise(out)
        return out

    announced = of_kind({EMAIL: ["mail", "contact", "write to", "reach me,"], IP: ["host", "server", "the ip is", "ping", "gateway"], CARD: ["card", "visa", "credit", "payment by", "charged to"], PHONE: ["call", "tel", "phone", "fax:", "mobile"]}, 130)
    other = of_kind({EMAIL: ["sold", "price", "arrive", "look", "open"], IP: ["version", "release", "section", "build", "rule"], CARD: ["order", "invoice", "serial", "tracking", "ref"], PHONE: ["part", "item", "sku", "lot", "code"]}, 140)
    plain = pick(150, ["and", "so", "the", "it was", "das ist", "y la", "then"])
    told = pick(151, [1, 1, 1, 0])  # three of four sentences say what it is
    # a number of a card's or a phone's form that nothing announces is personal
    before = F.when((y == 1) & (told == 1), announced).when(y == 1, plain).when((told == 1) | (kind >= CARD), other).otherwise(plain)
    after = F.when(y == 1, pick(152, ["", ".", " now", ", thanks", " today"])).otherwise(pick(153, ["", ".", " units", " items", " each", " now"]))
    lead = pick(154, ["", "well, ", "In the end ", "hier: "])
    text = F.concat(lead, before, F.lit(" "), body, after)
    return spark.range(n).select(F.col("id").alias("rid"), text.alias("text"), kind.cast("int").alias("planted"), y.cast("int").alias("y"), (lot(160, KEPT) == 0).alias("kept"))


def fit(spark: SparkSession, n: int = EXAMPLES) -> tuple[gbt.Trees, list[float]]:
    """Trees that tell personal data among the looser spans of generated sentences, and each
    kind's threshold (above 1: nothing of the kind is added)."""
    if n in _fitted:
        return _fitted[n]
    some = cut(examples(spark, n), "examples")
    scanned = cut(some.select("rid", *_scan(F.col("text"))), "scanned")
    found = candidates(scanned).where("NOT base")
    rows = found.join(some.drop("text"), "rid").withColumn("y", F.when(F.col("kind") == F.col("planted"), F.col("y")).otherwise(0))
    rows = rows.groupBy(*FEATURES, "y", "kept").count().orderBy(*FEATURES, "y", "kept").collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], np.float64).reshape(-1, len(FEATURES))
    y, w, kept = (np.array([r[c] for r in rows], np.float64) for c in ("y", "count", "kept"))
    learn = kept == 0
    trees = gbt.fit(x[learn], y[learn], w[learn], trees=TREES, depth=DEPTH, rate=0.3)
    p = trees.probability(x) if len(x) else np.empty(0)
    thresholds = []
    for k in range(len(KINDS)):
        mine = (x[:, 0] == k) & (kept == 1)
        chosen = [(t, w[mine & (p >= t)].sum(), (w * y)[mine & (p >= t)].sum()) for t in np.unique(p[mine]) if t >= 0.5]
        good = [t for t, every, right in chosen if every >= SHOWN and right >= PRECISION * every]
        thresholds.append(float(good[0]) if good else 2.0)
    discard(some)
    discard(scanned)
    _fitted[n] = trees, thresholds
    return trees, thresholds


#: Models by number of sentences: they depend on nothing else.
_fitted: dict[int, tuple[gbt.Trees, list[float]]] = {}


def score_column(trees: gbt.Trees) -> Column:
    """The ensemble as one expression over the feature columns."""

    def node(i: int) -> Column:
        if trees.left[i] == i:
            return F.lit(float(trees.value[i]))
        return F.when(F.col(FEATURES[trees.feature[i]]) <= float(trees.cut[i]), node(int(trees.left[i]))).otherwise(node(int(trees.right[i])))

    margin = F.lit(trees.base)
    for r in trees.roots:
        margin = margin + node(int(r))
    return 1 / (1 + F.exp(-margin))


def select(found: DataFrame, trees: gbt.Trees, thresholds: list[float]) -> DataFrame:
    """Base spans that are valid, and looser spans at their kind's threshold that overlap
    neither a base span nor an earlier looser one. rid, kind, start, end, base, score."""
    limit = F.lit(2.0)
    for k, t in enumerate(thresholds):
        limit = F.when(F.col("kind") == k, t).otherwise(limit)
    s = found.withColumn("score", score_column(trees)).where(F.when(F.col("base"), F.col("valid")).otherwise(F.col("valid") & (F.col("score") >= limit)))
    s = s.select("rid", "kind", "start", "end", "base", "score")
    order = Window.partitionBy("rid").orderBy("start", "end", "kind", "base")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    s = s.withColumn("b", F.max(F.when(F.col("base"), F.col("end"))).over(earlier)).withColumn("a", F.min(F.when(F.col("base"), F.col("start"))).over(later)).withColumn("o", F.max(F.when(~F.col("base"), F.col("end"))).over(earlier))
    clear = (F.coalesce("b", F.lit(0)) <= F.col("start")) & (F.col("a").isNull() | (F.col("a") >= F.col("end"))) & (F.coalesce("o", F.lit(0)) <= F.col("start"))
    return s.where(F.col("base") | clear).drop("a", "b", "o")


def find(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Spans of every text: the columns in ``keep`` as ``keep_<name>`` and ``spans``, an array of
    structs kind (number), start, end, base, score in the order kind, start, end. Rows stay
    apart even where all their columns repeat. Only rows with a candidate meet their spans in a
    shuffle; the others keep an empty array."""
    text = text_or_empty(text_col)
    t = docs.select(F.monotonically_increasing_id().alias("rid"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep], *_scan(text))
    some = (F.size("emails") > 0) | (F.size("loose_emails") > 0) | F.exists("islands", lambda x: x["m"].rlike(FOUR_DIGITS))
    t = cut(t.withColumn("some", some), "scanned")
    found = cut(candidates(t.where("some")), "candidates")
    chosen = select(found, *fit(docs.sparkSession))
    spans = chosen.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base", "score"))).alias("spans"))
    names = [f"`keep_{c}`" for c in keep]
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean,score:double>>")
    met = t.where("some").select("rid", *names).join(spans, "rid", "left").select(*names, F.coalesce("spans", none).alias("spans"))
    return t.where("NOT some").select(*names, none.alias("spans")).unionByName(met)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans),
    ``base_sha256`` and ``spans`` (kind:start:end, comma-joined).

    A null text counts as empty; a null id is kept; repeated rows each get a row; an empty
    table gives an empty result; other columns, whatever their names, are ignored. Equal spans of
    different kinds are all listed; of looser spans that overlap, the first one stays (ties:
    the shorter, then the kind in the order listed). Whole texts of any length, scanned in
    linear time.
    """
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    s = find(docs, text_col, keep=(id_col,))
    base = F.filter("spans", lambda x: x["base"])

    def count(k: int) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return s.select(F.col(f"keep_{id_col}").alias(id_col), *map(count, range(len(KINDS))), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one
    (the first one's kind). ``length_col``, if given, is set to the new length.

    Null texts stay null; repeated rows and columns of any name are kept; an empty table stays
    empty; texts may be of any length. Rows without a candidate stay where they are, the others
    meet their spans by their number in one shuffle.
    """
    columns = tuple(docs.columns)
    s = find(docs, text_col, keep=columns)
    text = F.col(f"keep_{text_col}")
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    merged = F.aggregate(
        ordered,
        empty,
        lambda a, x: F.when((F.size(a) > 0) & (x["start"] < F.try_element_at(a, F.lit(-1))["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], x["end"]).alias("end"), F.try_element_at(a, F.lit(-1))["kind"].alias("kind"))))).otherwise(F.concat(a, F.array(x))),
    )
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("merged", lambda x: x["end"]))
    pieces = F.zip_with("merged", F.slice(ends, F.lit(1), F.size("merged")), lambda x, e: F.concat(F.substr(text, (e + 1).cast("int"), (x["start"] - e).cast("int")), F.element_at(names, x["kind"] + 1)))
    new = F.concat(F.array_join(pieces, ""), F.substr(text, (F.element_at(ends, -1) + 1).cast("int")))
    out = s.withColumn("merged", merged).withColumn("new", F.when(F.size("merged") > 0, new).otherwise(text))
    cols = {c: F.col(f"`keep_{c}`") for c in columns} | {text_col: F.col("new")}
    if length_col:
        cols[length_col] = F.length("new").cast("long")
    return out.select(*[c.alias(n) for n, c in cols.items()])
