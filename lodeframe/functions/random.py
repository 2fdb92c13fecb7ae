"""Uniform and normal numbers from row ids, the same however the rows are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of two well-known congruential generators, and their moduli 2^31 and 2^31 - 1.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2147483648
SECOND, PRIME = 48271, 2147483647


def uniform(id: Column, salt: int = 0) -> Column:
    """In (0, 1): a linear step modulo 2^31, then two quadratic ones modulo a prime, so that salts give unrelated numbers. An id's bits from the 31st on come in after the first step, so all products stay within 64 bits."""
    id = id.cast("long")
    high, top = F.pmod(F.shiftright(id, 31), F.lit(1 << 30)), F.pmod(F.shiftright(id, 61), F.lit(8))
    s = F.pmod(F.pmod(id, F.lit(MODULUS)) * MULTIPLIER + (INCREMENT + salt * 7919), F.lit(MODULUS))
    for k in (1, 2):
        s = (s * s + s * SECOND + high * k + top * (1000003 * k) + (salt * 104729 + k)) % PRIME
    return (s + 0.5) / PRIME


def normal(id: Column, salt: int = 0) -> Column:
    """Standard normal by Box-Muller."""
    return F.sqrt(-2 * F.log(uniform(id, 2 * salt))) * F.cos(2 * math.pi * uniform(id, 2 * salt + 1))


def sql_uniform(id: str, salt: int = 0) -> str:
    """DuckDB SQL of ``uniform`` for ids from 0 to 2^31."""
    s = f"(({id}::BIGINT * {MULTIPLIER} + {INCREMENT + salt * 7919}) % {MODULUS})"
    for k in (1, 2):
        s = f"(({s} * {s} + {s} * {SECOND} + {salt * 104729 + k}) % {PRIME})"
    return f"(({s} + 0.5e0) / {PRIME}.0e0)"


def sql_normal(id: str, salt: int = 0) -> str:
    return f"(sqrt(-2 * ln({sql_uniform(id, 2 * salt)})) * cos({2 * math.pi!r} * {sql_uniform(id, 2 * salt + 1)}))"
