"""Reproducible random draws: a hash of a seed and a key, the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, *keys: Column) -> Column:
    """A string whose order is a random permutation of the keys."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]).cast("binary"))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A double in [0, 1) for each key, from 32 bits of the same hash."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("double") / float(1 << 32)


def integer(n: Column | int, seed: int | str, *keys: Column) -> Column:
    """An integer in [0, n) for each key."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(uniform(seed, *keys) * n).cast("int")


def weighted(choices: dict[str, float], seed: int | str, *keys: Column) -> Column:
    """One of the choices for each key, in proportion to its weight."""
    u, total, upto = uniform(seed, *keys), sum(choices.values()), 0.0
    out = None
    for name, weight in choices.items():
        upto += weight / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(next(reversed(choices)))


def sql_order_key(seed: int | str, *keys: str) -> str:
    return "md5(concat_ws('/', " + ", ".join([f"'{seed}'", *[f"coalesce(({k})::VARCHAR, '')" for k in keys]]) + "))"


def sql_uniform(seed: int | str, *keys: str) -> str:
    return f"(('0x' || substr({sql_order_key(seed, *keys)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
