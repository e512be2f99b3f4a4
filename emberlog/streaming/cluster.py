"""Online clustering over micro-batches, with versioned representatives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.operators.clustering import SEEDS, ClusterModel


def cluster_updater(path: str, max_dist: float = 0.3, seeds: int = SEEDS) -> Callable[[DataFrame, int], None]:
    """Batch handler: the first batch founds the clusters, later ones join or add clusters.

    Never more than ``seeds`` distinct vectors are clustered among themselves, however large a batch is.

    Version ``n`` is always built from version ``n - 1``, so a repeated batch is harmless.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        vectors = batch.select("features")
        if batch_id == 0:
            model = ClusterModel.fit_seeded(vectors, max_dist, seeds=seeds)
        else:
            model = load_clusters(batch.sparkSession, path, batch_id - 1).extended(vectors, max_dist, seeds)
        model.reps.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return update


def load_clusters(spark: SparkSession, path: str, version: int, anomaly_threshold: float = 0.3) -> ClusterModel:
    return ClusterModel(spark.read.parquet(f"{path}/version={version}"), anomaly_threshold)


def last_version(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).selectExpr("max(version) as v").first()["v"]
