"""Distances, pair features and pair targets over array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def squared_euclid(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclid(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


METRICS = {"euclidean": euclid, "sqeuclidean": squared_euclid, "manhattan": manhattan, "cosine": cosine_distance}


def pair_features(a: Column, b: Column, use: Sequence[str] = ("pair", "abs_diff")) -> Column:
    """Features of a pair, always in the order pair (both rows), abs_diff, sq_diff."""
    parts = []
    if "pair" in use:
        parts += [a, b]
    if "abs_diff" in use:
        parts.append(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if "sq_diff" in use:
        parts.append(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    return F.concat(*parts)


def pair_feature_names(names: Sequence[str], use: Sequence[str] = ("pair", "abs_diff")) -> list[str]:
    """Readable names of :func:`pair_features`."""
    out = []
    if "pair" in use:
        out += [f"A_{n}" for n in names] + [f"B_{n}" for n in names]
    if "abs_diff" in use:
        out += [f"|A_{n} - B_{n}|" for n in names]
    if "sq_diff" in use:
        out += [f"(A_{n} - B_{n})^2" for n in names]
    return out


def keep_positions(features: Column, positions: Sequence[int]) -> Column:
    return F.array(*[F.element_at(features, p + 1) for p in positions])


def drop_positions(features: Column, positions: Sequence[int]) -> Column:
    gone = [int(p) for p in positions]
    return F.filter(features, lambda v, i: ~i.isin(gone)) if gone else features
