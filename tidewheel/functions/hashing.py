"""Seekable pseudo-random columns: the value depends on seed and position only.

Rows come out the same for any number of partitions and after any retry, and in any
engine that has MD5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hexadecimal digits of the digest that make a draw.
_DIGITS = 13
_UNIT = 2.0 ** (-4 * _DIGITS)


def hash_uniform(seed: int, pos: Column, stream: int = 0) -> Column:
    """Uniform double in [0, 1) for a position; ``stream`` gives independent draws per position."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(str(stream)), pos.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") * F.lit(_UNIT)


def hash_int(seed: int, pos: Column, k: Column | int, stream: int = 0) -> Column:
    """Uniform integer in [0, k)."""
    bound = k if isinstance(k, Column) else F.lit(k)
    return F.floor(hash_uniform(seed, pos, stream) * bound)


def hash_normal(seed: int, pos: Column, stream: int = 0) -> Column:
    """Standard normal double for a position (Box-Muller on two uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - hash_uniform(seed, pos, 2 * stream)))
    return radius * F.cos(F.lit(2.0 * math.pi) * hash_uniform(seed, pos, 2 * stream + 1))
