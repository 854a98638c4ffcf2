"""Small text functions: rule texts, number formats, logs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rename_features(rule: str, names: Sequence[str]) -> str:
    """``X_i`` -> the i-th name; positions without a name stay."""
    return re.sub(r"X_(\d+)", lambda m: names[int(m[1])] if int(m[1]) < len(names) else m[0], rule)


def rename_features_column(rule: Column, names: Sequence[str]) -> Column:
    """:func:`rename_features` for a column; higher positions first, so that X_1 leaves X_10 alone."""
    for i in reversed(range(len(names))):
        rule = F.regexp_replace(rule, rf"X_{i}(?!\d)", names[i])
    return rule


def no_leading_zero(value: Column, decimals: int = 3) -> Column:
    """Fixed decimals without the zero before the point."""
    return F.regexp_replace(F.format_string(f"%.{decimals}f", value), r"^(-?)0\.", "$1.")


def last_ndcg(log: Column, split: str) -> Column:
    """The last ``NDCG@k on <split> data: value`` in a training log; null if there is none, as for a failed run."""
    found = F.regexp_extract_all(log, F.lit(rf"NDCG@\d+ on {split} data: ([0-9.]+)"), 1)
    return F.try_element_at(found, F.lit(-1)).cast("double")


def mapped(value: Column, names: Mapping[str, str]) -> Column:
    """Values renamed; others stay."""
    out = value
    for old, new in names.items():
        out = F.when(value == old, F.lit(new)).otherwise(out)
    return out
