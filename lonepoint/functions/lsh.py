"""Random projections for Euclidean distance: floor((a.v + b) / w), a normal, b uniform in [0, w); K of them make a table's key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lonepoint.functions.vectors import dot
from lonepoint.params import LshParams


def projections(p: LshParams, dims: int) -> list[list[tuple[list[float], float]]]:
    """(a, b) of each hash of each table; a table's hashes don't depend on how many tables there are."""
    out = []
    for table in range(p.tables):
        rng = np.random.default_rng([p.seed, table])
        out.append([(rng.standard_normal(dims).tolist(), float(rng.uniform(0, p.width))) for _ in range(p.hashes)])
    return out


def hash_value(values: Column, a: list[float], b: float, width: float) -> Column:
    weights = [F.lit(x) for x in a]
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + w * values[i]
    return F.floor((total + F.lit(b)) / F.lit(width)).cast("long")


def table_keys(values: Column, p: LshParams, dims: int) -> Column:
    """An array with each table's key, its hash values joined by commas."""
    return F.array(*(F.concat_ws(",", *(hash_value(values, a, b, p.width).cast("string") for a, b in table)) for table in projections(p, dims)))


def table_hashes(values: Column, p: LshParams, dims: int) -> list[Column]:
    """64 bits of each table's key: narrow, and equal where the keys are."""
    return [F.xxhash64(*(hash_value(values, a, b, p.width) for a, b in table)) for table in projections(p, dims)]


__all__ = ["dot", "hash_value", "projections", "table_hashes", "table_keys"]
