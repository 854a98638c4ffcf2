"""Rankers to compare with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.operators.dataset import dice


def random_score(salt: str = "r") -> Column:
    """A repeatable score in [0, 1) from the md5 of query, document and salt."""
    return F.conv(F.substring(dice("qid", "doc_id", salt=salt), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def random_normal(salt: str = "n", mean: float = 0.0, std: float = 1.0) -> Column:
    """A repeatable normal value, by the Box-Muller transform of two such scores."""
    u, v = F.greatest(random_score(f"{salt}u"), F.lit(1e-12)), random_score(f"{salt}v")
    return F.lit(mean) + F.lit(std) * F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)
