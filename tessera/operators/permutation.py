"""Seeded permutations of 0 .. n - 1 as column expressions, without a sort.

The numbers are written as (l, r) with l below a and r below b, where a * b is the
smallest such product that holds n.  An alternating Feistel network adds a hash of r
to l (modulo a) and a hash of l to r (modulo b), in turn; each step can be undone, so
the network is a bijection on 0 .. ab - 1 whatever the hash.  A number that leaves
0 .. n - 1 goes through again until it is back (cycle walking), which makes it a
bijection on the range.  Less than one number in sqrt(n) leaves it, and a walk outside
is shorter than ab - n, so nearly all rows take one pass of generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the network, two of each kind.
STEPS = 4
#: Passes outside the range; for n below 4096 no walk is longer, beyond it the odds are under 64^-64.
WALK = 64


def sides(n: int) -> tuple[int, int]:
    """(a, b): the two factors of the network's domain, ab - n < a."""
    a = math.isqrt(n - 1) + 1
    return a, -(-n // a)


def _once(x: Column, a: int, b: int, seed: tuple) -> Column:
    l, r = F.floor(x / F.lit(b)).cast("long"), x % F.lit(b)
    for k in range(STEPS):
        if k % 2 == 0:
            l = (l + F.pmod(F.xxhash64(r, F.lit(k), *seed), F.lit(a).cast("long"))) % F.lit(a)
        else:
            r = (r + F.pmod(F.xxhash64(l, F.lit(k), *seed), F.lit(b).cast("long"))) % F.lit(b)
    return l * F.lit(b) + r


def permuted(x: Column, n: int, *seed: Column) -> Column:
    """The place of ``x`` (0 .. n - 1, below 2^52) in the permutation of 0 .. n - 1 that the ``seed`` columns choose."""
    if n <= 1:
        return F.lit(0).cast("long")
    a, b = sides(n)
    first = _once(x.cast("long"), a, b, seed)
    if a * b == n:
        return first
    walk = F.sequence(F.lit(1), F.lit(min(a * b - n, WALK)))
    return F.when(first < n, first).otherwise(F.aggregate(
        walk, first, lambda at, _: F.when(at < n, at).otherwise(_once(at, a, b, seed))))
