"""One interface over the session detectors: fit, predict, evaluate on count vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators import classifiers, evaluate
from emberlog.operators.clustering import ClusterModel
from emberlog.operators.features import distinct_vectors
from emberlog.operators.iforest import ForestModel
from emberlog.operators.invariants import InvariantModel
from emberlog.operators.pca import PcaModel


def _clusters(sessions: DataFrame, _: int, mode: str = "online", **options) -> ClusterModel:
    if mode == "offline":
        return ClusterModel.fit_offline(sessions.select("features"), **options)
    if mode != "online":
        raise ValueError(f"unknown mode {mode}")
    return ClusterModel.fit_online(sessions.select("session_id", "first_line", "features"), **options)


def _marked(sessions: DataFrame) -> DataFrame:
    return sessions.select("features", "label")


# Name: how it is fitted from sessions and the number of columns, and whether it needs labels.
FITS: dict[str, tuple[Callable, bool]] = {
    "pca": (lambda s, k, **o: PcaModel.fit(distinct_vectors(s.select("features")), k, **o), False),
    "invariants": (lambda s, k, **o: InvariantModel.fit(distinct_vectors(s.select("features")), k, **o), False),
    "clustering": (_clusters, False),
    "isolation_forest": (lambda s, k, **o: ForestModel.fit(s, **o), False),
    "logistic_regression": (lambda s, k, **o: classifiers.logistic_regression(_marked(s), **o), True),
    "svm": (lambda s, k, **o: classifiers.SparseSvm.fit(_marked(s), k, **o), True),
    "decision_tree": (lambda s, k, **o: classifiers.decision_tree(_marked(s), **o), True),
}


@dataclass
class Detector:
    """A detector by name; ``options`` go to its fit.

    Sessions are ``session_id, first_line, features`` and, for supervised detectors and for
    ``evaluate``, ``label``. Each distinct vector is judged once.
    """

    name: str
    options: dict = field(default_factory=dict)
    model: object = None

    def fit(self, sessions: DataFrame) -> Detector:
        fit, supervised = FITS[self.name]
        if supervised and "label" not in sessions.columns:
            raise ValueError(f"{self.name} needs labels")
        width = sessions.select(F.size("features").alias("k")).first()
        if width is None:
            raise ValueError("no sessions to fit on")
        self.model = fit(sessions, width["k"], **self.options)
        return self

    def judged(self, distinct: DataFrame) -> DataFrame:
        """Distinct vectors with ``pred``."""
        scored = self.model.score(distinct) if self.name == "pca" else self.model.predict(distinct)
        return scored.select(*distinct.columns, "pred")

    def predict(self, sessions: DataFrame) -> DataFrame:
        """Sessions with ``pred``."""
        once = self.judged(distinct_vectors(sessions.select("features"))).select("features", "pred")
        return sessions.join(once, "features").select(*sessions.columns, "pred")

    def evaluate(self, sessions: DataFrame) -> DataFrame:
        """One row: counts, precision, recall and F1."""
        labelled = sessions.groupBy("features", "label").agg(F.count(F.lit(1)).alias("weight"))
        return evaluate.evaluate(self.judged(labelled), weight="weight")
