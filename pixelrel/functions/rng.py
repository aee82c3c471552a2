"""Random choices keyed by hash: the same for every run, order and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: int, purpose: str, *parts: Column | str) -> Column:
    """A 32-bit key from the seed, the purpose and the row's own ids."""
    ids = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in ids], F.lit(purpose))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(k: Column) -> Column:
    return k / F.lit(float(1 << 32))


def bernoulli(k: Column, p: float) -> Column:
    return uniform(k) < p


def choice(k: Column, n: Column) -> Column:
    return F.pmod(k, n)


def bits(k: Column, at: int, n: int = 1) -> Column:
    return F.shiftright(k, at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")


def normal(k1: Column, k2: Column) -> Column:
    """A standard normal variable of two independent keys (Box and Muller)."""
    return F.sqrt(F.log((k1 + 1) / F.lit(float(1 << 32))) * -2) * F.cos(uniform(k2) * (2 * math.pi))
