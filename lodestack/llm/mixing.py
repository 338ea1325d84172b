"""Mixing sources to target weights: weighted fair queueing (DataFrame operations only).

Every document, in an order shuffled by hash, gets a virtual finish time: its source's
cumulative tokens divided by the source's target. Repeats (up to ``max_repeats`` rounds over a
source) follow one another on the same clock. All items are ordered by finish time and cut off
where the total budget is spent. A hot source is split into hash bins before any window, and
the cut is found by histograms of the finish time, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty, word_count

#: Bits of the shuffle key, and bits that make a bin of a source.
KEY_BITS, BIN_BITS = 60, 12
#: Finish times are binned as multiples of 2**-36, up to 64; three levels of histogram.
FRACTION_BITS, LEVELS = 36, (30, 15, 0)


def shuffle_key(id_col: str, source_col: str, text_col: str, seed: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, source_col, text_col)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """``sizes``: one row per source (``skey``, ``source``, ``source_size``). Adds ``target``.

    Weights repeat over sources in code-point order, null last. Water filling in closed form:
    sources are ordered by the level at which their cap is met, and the level is the first
    that its own source can still take.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.lit(0)
    for i, x in enumerate(weights):
        w = F.when((F.row_number().over(by_name) - 1) % len(weights) == i, x).otherwise(w)
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(whole))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(whole)["level"])
    return s.select("skey", "source_size", "total", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def _cutoff(items: DataFrame, budget: int):
    """The first item, in finish order, that no longer fits into the budget."""
    spent, within = 0, F.lit(True)
    for shift in LEVELS:
        rows = sorted((r["b"], r["words"]) for r in items.where(within).groupBy(F.shiftright("k", shift).alias("b")).agg(F.sum("size").alias("words")).collect())
        for b, words in rows:
            if spent + words > budget:
                break
            spent += words
        else:
            return None
        within = within & (F.shiftright("k", shift) == b)
    order = Window.orderBy("vt", "key", "id_order", "round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = items.where(within).withColumn("run", F.sum("size").over(order) + spent).where(F.col("run") > budget)
    return last.orderBy("vt", "key", "id_order", "round").first()


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Decide for every row how many words the mix takes of it.

    The budget is the number of words in all rows. Returns id, ``size``, ``source_size``,
    ``target``, ``taken`` (repeats counted) and ``rounds`` (taken copies). Rows are taken whole.
    Null text: size 0, taken 0. A null source is a source of its own, last in order; a null id is
    ordinary (ties fall back to key and finish time); repeated rows are separate items; an empty
    table gives an empty result; other columns, whatever their names, are ignored; a very long
    text is one item. Reruns agree: nothing depends on row order or partitioning.
    """
    decided = _decide(docs, weights, max_repeats, seed, id_col, source_col, text_col)
    return decided.select(F.col("id").alias(id_col), "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.col("rounds")).cast("long").alias("taken"), "rounds")


def blend(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: ``docs``'s rows, each as often as :func:`mix` takes it.

    Rows are numbered once, in a table of their own, and meet their decisions by that number: no
    group of equal rows lies in one task. Null text: never taken. Columns may have any names;
    repeated rows are rows of their own; an empty table stays empty; texts may be of any length.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = cut(docs.select(F.monotonically_increasing_id().alias("rid"), row), "rows")
    parts = rows.select("rid", *[F.col("row").getField(c).alias(n) for c, n in ((id_col, "id"), (source_col, "source"), (text_col, "text"))])
    decided = _decide(parts, weights, max_repeats, seed, "id", "source", "text", ("rid",)).where("rounds > 0").select("rid", "rounds")
    return rows.join(decided, "rid").select("row", F.explode(F.sequence(F.lit(1), "rounds")).alias("copy")).select("row.*")


def _id_order(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(-(2**63)))


def _decide(docs: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: str, id_col: str, source_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    base = docs.select(
        *carry,
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("skey"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_or_empty(text_col)).alias("size"),
        shuffle_key(id_col, source_col, text_col, seed).alias("key"),
    )
    base = cut(base.withColumn("bin", F.shiftright("key", KEY_BITS - BIN_BITS)), "items")
    bins = base.groupBy("skey", "bin").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    sizes = bins.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats)
    earlier = Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.drop("source").withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words").join(targets, "skey")
    inside = Window.partitionBy("skey", "bin").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = base.withColumn("cum", F.sum("size").over(inside)).join(bins, ["skey", "bin"])
    timed = timed.withColumn("cum", F.col("cum") + F.col("before")).withColumn("id_order", _id_order(F.col("id"))).drop("before", "skey", "bin", "source")
    timed = cut(timed, "timed")

    def finish(e: int) -> Column:
        return (F.col("cum") + F.col("source_size") * e).cast("double") / F.col("target")

    some = timed.where(F.col("size") > 0)
    items = some.select("size", "key", "id_order", F.explode(F.array(*[F.struct(finish(e).alias("vt"), F.lit(e).alias("round")) for e in range(max_repeats)])).alias("x")).select("size", "key", "id_order", "x.*")
    items = items.withColumn("k", F.floor(F.least(F.col("vt"), F.lit(64.0)) * F.lit(float(1 << FRACTION_BITS))).cast("long"))
    total = (timed.agg(F.max("total").alias("t")).first() or {"t": 0})["t"] or 0
    last = _cutoff(items, total) if total else None

    def taken(e: int) -> Column:
        if last is None:
            return F.lit(1)
        vt = finish(e)
        tie = (F.col("key") < last["key"]) | ((F.col("key") == last["key"]) & ((F.col("id_order") < last["id_order"]) | ((F.col("id_order") == last["id_order"]) & (F.lit(e) < last["round"]))))
        return F.when((vt < last["vt"]) | ((vt == last["vt"]) & tie), 1).otherwise(0)

    rounds = taken(0)
    for e in range(1, max_repeats):
        rounds = rounds + taken(e)
    rounds = F.when(F.col("size") > 0, rounds).otherwise(0)
    return timed.withColumn("rounds", rounds.cast("int"))


#: DuckDB SQL for the default parameters.
ORACLE_SQL = r"""
WITH b AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
r AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
  ((sum(source_size) OVER ())::BIGINT - coalesce((sum(cap) OVER o)::BIGINT, 0))::DOUBLE / ((sum(w) OVER ())::BIGINT - coalesce((sum(w) OVER o)::BIGINT, 0)) AS lev,
  cap / w AS ratio FROM r
  WINDOW o AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(lev, ratio) AS level FROM l WHERE lev <= ratio),
t AS (SELECT source, source_size, total, least(cap::DOUBLE, level * w) AS target FROM l, v),
c AS (SELECT b.*, source_size, total, target,
  (sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
i AS (SELECT doc_id, key, size, total, e, (cum + source_size * e)::DOUBLE / target AS vt FROM c, (VALUES (0), (1), (2)) x(e) WHERE size > 0),
q AS (SELECT *, (sum(size) OVER (ORDER BY vt, key, doc_id NULLS FIRST, e ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM i),
k AS (SELECT vt, key, doc_id, e FROM q WHERE run > total ORDER BY run LIMIT 1),
g AS (SELECT c.doc_id, c.size, c.source_size, c.target, c.key, c.cum, count(k.vt) AS rounds
  FROM c LEFT JOIN (VALUES (0), (1), (2)) x(e) ON c.size > 0
  LEFT JOIN k ON ((c.cum + c.source_size * x.e)::DOUBLE / c.target, c.key, coalesce(c.doc_id, -9223372036854775808), x.e) < (k.vt, k.key, coalesce(k.doc_id, -9223372036854775808), k.e)
  GROUP BY ALL)
SELECT doc_id, size, source_size, target, (size * rounds)::BIGINT AS taken, rounds::INTEGER AS rounds FROM g
"""
