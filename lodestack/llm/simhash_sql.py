"""DuckDB SQL for the fingerprints and components of :mod:`simhash`, XXH64 in whole numbers.

Every value is a UHUGEINT below 2^64, so that a product of two fits; a shingle is hashed once.
"""

from __future__ import annotations

WORDS, BITS, SEED = 4, 4, 42
#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
MOD = f"{1 << 64}::UHUGEINT"


def num(n: int) -> str:
    return f"{n % (1 << 64)}::UHUGEINT"


def mul(a: str, n: int) -> str:
    return f"(({a}) * {num(n)} % {MOD})"


def add(*terms: str) -> str:
    return f"(({' + '.join(terms)}) % {MOD})"


def turn(x: str, r: int) -> str:
    """Rotated left; ``x`` is read twice."""
    return f"(({x}) * {num(1 << r)} % {MOD} + ({x}) // {num(1 << (64 - r))})"


def stir(acc: str, lane: str) -> str:
    return mul(turn(add(acc, mul(lane, P2)), 31), P1)


def shift(h: str, r: int) -> str:
    return f"xor({h}, ({h}) // {num(1 << r)})"


def lane(at: str, n: int) -> str:
    """``n`` bytes from byte ``at`` on, the lowest first, of the upper-case hexadecimal ``x``."""
    def digit(k: str) -> str:
        return f"(instr('0123456789ABCDEF', substr(x, 2 * ({at}) + {k}, 1)) - 1)"

    values = f"list_transform(range(0, {n}), lambda k: ({digit(f'2 * ({n} - k) - 1')} * 16 + {digit(f'2 * ({n} - k)')})::UHUGEINT)"
    return f"list_reduce({values}, lambda p, d: p * 256::UHUGEINT + d)"


def fold(first: str, values: str, step: str) -> str:
    return f"list_reduce(list_concat([{first}], {values}), lambda h, v: {step})"


def every(of: str, count: str, at: str, n: int) -> str:
    """Lanes ``of`` = 0, 1, ... of ``n`` bytes at ``at``."""
    return f"list_transform(range(0, {count}), lambda {of}: {lane(at, n)})"


def hashed() -> str:
    """CTEs from ``shingle`` (s) to ``hash`` (s, h)."""
    starts = [num(SEED + P1 + P2), num(SEED + P2), num(SEED), num(SEED - P1)]
    stripes = ", ".join(fold(s, f"list_transform(range(0, n // 32), lambda i: lanes[4 * i + {j + 1}])", stir("h", "v")) + f" AS a{j}" for j, s in enumerate(starts))
    sums = add(*[turn(f"a{j}", r) for j, r in enumerate((1, 7, 12, 18))])
    merge = [f"m{j} AS (SELECT *, {add(mul(f'xor(g{j}, {stir(num(0), f"a{j}")})', P1), num(P4))} AS g{j + 1} FROM {'acc' if j == 0 else f'm{j - 1}'})" for j in range(4)]
    eight = add(mul(turn(f"xor(h, {stir(num(0), 'v')})", 27), P1), num(P4))
    four = add(mul(turn(f"xor(h8, {mul('v4', P1)})", 23), P2), num(P3))
    single = mul(turn(f"xor(h, {mul('v', P5)})", 11), P1)
    return f"""
code AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingle)),
lane AS (SELECT s, n, {every('i', 'n // 8', '8 * i', 8)} AS lanes, CASE WHEN n % 8 >= 4 THEN {lane('8 * (n // 8)', 4)} END AS v4, {every('i', 'n % 4', '4 * (n // 4) + i', 1)} AS tail FROM code),
part AS (SELECT *, {stripes} FROM lane),
acc AS (SELECT *, {sums} AS g0 FROM part),
{', '.join(merge)},
begun AS (SELECT s, n, lanes, v4, tail, {add(f"CASE WHEN n >= 32 THEN g4 ELSE {num(SEED + P5)} END", "n::UHUGEINT")} AS h0 FROM m3),
by8 AS (SELECT *, {fold('h0', 'list_slice(lanes, 4 * (n // 32) + 1, n // 8)', eight)} AS h8 FROM begun),
by4 AS (SELECT *, CASE WHEN v4 IS NULL THEN h8 ELSE {four} END AS h4 FROM by8),
by1 AS (SELECT s, {fold('h4', 'tail', single)} AS h1 FROM by4),
f1 AS (SELECT s, {mul(shift('h1', 33), P2)} AS h2 FROM by1),
f2 AS (SELECT s, {mul(shift('h2', 29), P3)} AS h3 FROM f1),
hash AS (SELECT s, ({shift('h3', 32)})::UBIGINT AS h FROM f2)"""


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    votes = ", ".join(f"(2 * sum((h >> {b}::UBIGINT) & 1::UBIGINT) > count(*))::UHUGEINT" for b in reversed(range(64)))
    rest = ", ".join(f"lead(w, {i}) OVER o" for i in range(1, WORDS))
    return rf"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS k, len(w) AS n FROM doc),
shingle AS (SELECT r, s FROM (SELECT r, k, n, concat_ws(' ', w, {rest}) AS s FROM word WINDOW o AS (PARTITION BY r ORDER BY k)) WHERE k = 1 OR k <= n - {WORDS - 1}),
{hashed()},
vote AS (SELECT r, [{votes}] AS bits FROM shingle JOIN hash USING (s) GROUP BY r),
print AS (SELECT doc_id, coalesce(list_reduce(bits, lambda p, b: p * 2::UHUGEINT + b), 0::UHUGEINT)::UBIGINT AS f FROM doc LEFT JOIN vote USING (r)),
kind AS (SELECT f, min(doc_id) AS least FROM print GROUP BY f),
link AS (SELECT a.f AS a, b.f AS b FROM kind a JOIN kind b ON bit_count(xor(a.f, b.f)) <= {BITS}),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT reach.a AS f, min(kind.least) AS c FROM reach JOIN kind ON kind.f = reach.b GROUP BY 1)
SELECT doc_id, lpad(lower(hex(f)), 16, '0') AS fingerprint, c AS component_id FROM print JOIN least USING (f)"""


ORACLE_SQL = oracle()
