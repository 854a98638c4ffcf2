"""Scorecard arithmetic: weights to points, points to probabilities, rule tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def factor(pdo: float) -> float:
    """Points that double the odds, over ln 2."""
    return pdo / math.log(2)


def offset(score0: float, odds0: float, pdo: float) -> float:
    return score0 - factor(pdo) * math.log(odds0)


def points(weight: Column, pdo: float) -> Column:
    """Whole points of a weight, rounded half to even."""
    return F.bround(F.lit(factor(pdo)) * weight, 0).cast("long")


def to_points(rules: DataFrame, pdo: float = 20.0) -> DataFrame:
    """rule, weight, support -> rule, points, support: equal rules are added, rules without points dropped."""
    each = rules.select("rule", "support", points(F.col("weight"), pdo).alias("points")).where("points <> 0")
    return each.groupBy("rule").agg(F.sum("points").cast("long").alias("points"), F.max("support").cast("long").alias("support")).where("points <> 0")


def probability(score: Column, score0: float = 600.0, odds0: float = 50.0, pdo: float = 20.0) -> Column:
    z = (score - offset(score0, odds0, pdo)) / factor(pdo)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def active(rule: Column, features: Column) -> Column:
    """Whether all tests (feat, thr, op) of a rule hold; operators are ``<=``, ``<``, ``>=``, ``==``, ``!=``, else ``>``."""

    def holds(test: Column) -> Column:
        x = F.element_at(features, test["feat"] + 1)
        return (
            F.when(test["op"] == "<=", x <= test["thr"]).when(test["op"] == "<", x < test["thr"]).when(test["op"] == ">=", x >= test["thr"]).when(test["op"] == "==", x == test["thr"]).when(test["op"] == "!=", x != test["thr"]).otherwise(x > test["thr"])
        )

    return F.forall(rule, holds)
