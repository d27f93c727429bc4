"""Random samples that do not depend on partitioning: hashes of a seed and keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_sample(seed: int, *keys: Column) -> Column:
    """Uniform on (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal_sample(seed: int, *keys: Column) -> Column:
    """Standard normal (Box and Muller)."""
    u, v = uniform_sample(2 * seed, *keys), uniform_sample(2 * seed + 1, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
