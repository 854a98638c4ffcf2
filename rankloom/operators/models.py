"""Rankers by name and flat settings, with one way to fit, predict, log and save them.

Settings have the names that experiment files use: sdt_depth and pdt_depth are the depths of the score's and of the distance's
trees, n_neighbors, dist_objective, feature_diff (whether pairs have differences of features), subsample. Others go to the
ranker as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import baselines, boosting, linear, pairwise, rtr, rulecard, trees
from rankloom.sources import results

NAMES = {"sdt_depth": "depth", "pdt_depth": "distance_depth", "n_neighbors": "k", "dist_objective": "objective"}
CARD = ("rounds", "rate", "patience", "sample", "valid")


def config_of(settings: dict[str, Any], mixed: bool = False, card: bool = False) -> rtr.Config:
    """A two-stage ranker's configuration from flat settings."""
    own = {NAMES.get(k, k): v for k, v in settings.items() if k != "feature_diff" and not (card and k in CARD)}
    use = ("pair", "abs_diff") if settings.get("feature_diff", True) else ("pair",)
    rules = rulecard.CardConfig(depth=own.get("distance_depth") or 2, **{k: settings[k] for k in CARD if k in settings}) if card else None
    return rtr.Config(**({"use": use, "mixed": mixed, "card": rules} | own))


Fit = Callable[[DataFrame, dict[str, Any], list[str]], Any]
Predict = Callable[[DataFrame, Any, list[str]], DataFrame]


def _two_stage(mixed: bool = False, card: bool = False, column: str = "full", **fixed: Any) -> tuple[Fit, Predict]:
    fit = lambda train, settings, keys: rtr.fit(train, config_of(fixed | settings, mixed, card), keys)
    return fit, lambda df, model, keys: model.predict(df, euclid=False).select(*df.columns, F.col(column).alias("_out"))




#: How each kind is fitted (train, settings, keys) and predicts (df, fitted, keys): ``df`` with _out.
KINDS: dict[str, tuple[Fit, Predict]] = {
    "rtr": _two_stage(),
    "mixed_rtr": _two_stage(mixed=True),
    "rtr_card": _two_stage(card=True),
    "mixed_rtr_card": _two_stage(mixed=True, card=True),
    "knn": _two_stage(depth=0, distance_depth=None, k=7),
    "knn_pdt": _two_stage(depth=0),
    "tree": (
        lambda train, s, keys: trees.grow(train, keys, s.get("sdt_depth", 3), "y", s.get("min_split", 2)),
        lambda df, model, keys: trees.apply(df, model, keys, "_out", "_leaf").drop("_leaf"),
    ),
    "random": (lambda train, s, keys: s.get("salt", "r"), lambda df, salt, keys: df.withColumn("_out", baselines.random_score(salt))),
    "lambdamart": (lambda train, s, keys: boosting.fit(train, boosting.Boost(**s), keys), lambda df, m, keys: boosting.predict(df, m, keys, "_out")),
    "mart": (lambda train, s, keys: boosting.fit(train, boosting.Boost(**({"objective": "squared"} | s)), keys), lambda df, m, keys: boosting.predict(df, m, keys, "_out")),
    "forest": (
        lambda train, s, keys: boosting.grow_forest(train, s.get("n_trees", 20), s.get("depth", 4), s.get("features", 2), keys),
        lambda df, m, keys: df.join(boosting.forest_scores(df, m, keys, "_out"), list(dict.fromkeys([*keys, "qid", "doc_id"]))).select(*df.columns, "_out"),
    ),
    "listnet": (
        lambda train, s, keys: linear.listnet(train, [s.get("rate", 0.1)], [s.get("epochs", 50)], keys),
        lambda df, m, keys: linear.listnet_scores(df, m, keys, "_out").drop("rate", "epoch"),
    ),
    "adarank": (lambda train, s, keys: linear.adarank(train, s.get("rounds", 10), s.get("k", 10), keys), lambda df, m, keys: linear.adarank_scores(df, m, keys, "_out")),
    "rankboost": (lambda train, s, keys: pairwise.rankboost(train, s.get("rounds", 20), s.get("thresholds", 10), keys), lambda df, m, keys: pairwise.rankboost_scores(df, m, keys, "_out")),
    "coordinate_ascent": (lambda train, s, keys: pairwise.coordinate_ascent(train, keys=keys, **s), lambda df, m, keys: pairwise.linear_scores(df, m, keys, "_out")),
    "least_squares": (
        lambda train, s, keys: linear.least_squares(train, s.get("ridge", 1e-10), keys),
        lambda df, m, keys: pairwise.linear_scores(df.withColumn("_f", F.col("features")).withColumn("features", F.concat("features", F.array(F.lit(1.0)))), m, keys, "_out").withColumn("features", F.col("_f")).drop("_f"),
    ),
}


@dataclass
class Model:
    """A ranker of a kind in :data:`KINDS`; with ``keys``, one for each of their values."""

    kind: str
    settings: dict[str, Any] = field(default_factory=dict)
    keys: Sequence[str] = ()
    fitted: Any = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}; there are {', '.join(sorted(KINDS))}")

    def fit(self, train: DataFrame) -> Model:
        self.fitted = KINDS[self.kind][0](train, dict(self.settings), list(self.keys))
        return self

    def predict(self, df: DataFrame, score: str = "score") -> DataFrame:
        """``df`` with a score; a row of an unknown model has none, or is left out where the ranker joins."""
        if self.fitted is None:
            raise ValueError("fit comes first")
        return KINDS[self.kind][1](df, self.fitted, list(self.keys)).select(*df.columns, F.col("_out").alias(score))

    def log(self, df: DataFrame) -> DataFrame:
        """``df`` with the kind and the settings in columns: model, conf_..."""
        return results.log_row(df.withColumn("model", F.lit(self.kind)), self.settings)

    def save(self, path: str) -> None:
        """The fitted tables as Parquet."""
        if self.fitted is None:
            raise ValueError("fit comes first")
        if isinstance(self.fitted, rtr.Ranker):
            results.save_ranker(self.fitted, path)
        elif isinstance(self.fitted, DataFrame):
            self.fitted.write.mode("overwrite").parquet(path)
        else:
            raise ValueError(f"{self.kind} has nothing to save")
