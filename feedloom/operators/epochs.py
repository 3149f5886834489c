"""Batches of an epoch: a keyed permutation of row numbers says where each row comes, without sorting or moving rows.

Row numbers 0 to n - 1 are split into two digits of base a, the least with a * a >= n, and pass through ROUNDS of a Feistel
network keyed by (seed, epoch): (l, r) becomes (r, (l + f(r)) mod a), which can be undone whatever f is, so it permutes 0
to a * a - 1. A number that lands at n or beyond is passed on again until it is below n (cycle walking), which leaves a
permutation of 0 to n - 1. Every row computes its own place from its number alone: the order depends on (seed, epoch, n)
only, not on parts, models or tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
#: Walks of a number at most; those beyond n are fewer than 2 * sqrt(n) + 1 of a * a, so more than a few are never seen.
WALKS = 64
#: The modulus 2^31 - 1 and a primitive root of it.
MODULUS, ROOT = 2147483647, 16807


def base(n: int) -> int:
    """The least a with a * a >= n."""
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def keys(seed: int, epoch: int) -> list[int]:
    """A key for each round, different for each seed and epoch."""
    out, x = [], (seed * 1_000_003 + epoch * 8191 + 12345) % MODULUS or 1
    for _ in range(ROUNDS):
        x = x * ROOT % MODULUS
        out.append(x)
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _round(r: Column, key: Column) -> Column:
    """Scrambles a digit below 2^31: two multiplications modulo a prime with a square between, all below 2^62."""
    return _let((r + key) % MODULUS, lambda x: (((x * x + x + key) % MODULUS) * ROOT + key) % MODULUS)


def permuted(number: Column, n: int, seed: int, epoch: int) -> Column:
    """The place, 0 to n - 1, of row ``number`` (0 to n - 1) in this epoch; other numbers raise, null gives null."""
    a, ks = base(n), F.array(*[F.lit(k).cast("long") for k in keys(seed, epoch)])

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / a).cast("long").alias("l"), (x % a).alias("r"))
        return F.aggregate(ks, start, lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + _round(s["r"], k)) % a).alias("r")), lambda s: s["l"] * a + s["r"])

    # the state is one long, so each walk is computed once and not copied into the next; few rows need a second
    more = lambda at: F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), at, lambda z, _: F.when(z < n, z).otherwise(once(z)))
    walked = _let(once(number.cast("long")), lambda at: F.when(at < n, at).otherwise(more(at)))
    valid = (number >= 0) & (number < n)
    return F.when(number.isNotNull(), _let(F.when(valid, walked), lambda at: F.when(at < n, at).otherwise(F.raise_error(F.lit("a row number outside the epoch")).cast("long"))))


def batched(rows: DataFrame, number: str, n: int, size: int, seed: int, epoch: int) -> DataFrame:
    """``rows`` with ``place`` in the epoch and ``batch`` (from 0, ``size`` rows each, the last may be shorter)."""
    if size < 1:
        raise ValueError("a batch holds at least one row")
    return rows.withColumn("place", permuted(F.col(number), n, seed, epoch)).withColumn("batch", F.floor(F.col("place") / size).cast("int"))


def steps(n: int, size: int) -> int:
    """Batches of an epoch; none is empty."""
    return -(-n // size)


def order_sql(source: str, n: str, seed: int, epochs: list[int]) -> str:
    """SQL, apart from Spark's expressions, for (number, epoch, place) of ``source(number)`` with ``n`` a SQL value below 2^31."""
    digit = "CAST(ceil(sqrt(n)) AS BIGINT)"

    def once(x: str, ks: list[int]) -> str:
        left, right, sql = f"{x} // a", f"{x} % a", ""
        names = [("l0", "r0")]
        sql = f"SELECT number, epoch, n, a, {left} AS l0, {right} AS r0 FROM {{}}"
        for k, key in enumerate(ks):
            l, r = names[-1]
            f = f"({r} + {key}) % {MODULUS}"
            g = f"(({f}) * ({f}) + ({f}) + {key}) % {MODULUS}"
            sql = f"SELECT *, {r} AS l{k + 1}, ({l} + (({g}) * {ROOT} + {key}) % {MODULUS}) % a AS r{k + 1} FROM ({sql})"
            names.append((f"l{k + 1}", f"r{k + 1}"))
        return f"SELECT number, epoch, n, a, {names[-1][0]} * a + {names[-1][1]} AS z FROM ({sql})"

    walks, out = [], []
    for e in epochs:
        ks = keys(seed, e)
        start = f"(SELECT number, {e} AS epoch, n, {digit} AS a FROM {source}, (SELECT {n} AS n))"
        again = once("z", ks).format(f"w{e} WHERE z >= n")
        walks.append(f"w{e} AS ({once('number', ks).format(start)} UNION ALL {again})")
        out.append(f"SELECT number, epoch, z AS place FROM w{e} WHERE z < n")
    return f"{', '.join(walks)}, ord AS ({' UNION ALL '.join(out)})"
