"""Session and storage settings shared by every operator."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Workload knobs in one place (the reference keeps them as script constants)."""

    seed_size: int = 100              # balanced cold start, half per class
    test_fraction: float = 0.2
    mc_passes: int = 20
    dropout: float = 0.3
    hidden: int = 256
    epochs: int = 30
    lr: float = 1e-3
    salience_weight: float = 0.12
    ensemble: int = 5                 # networks of an ensemble
    forest_trees: int = 200
    forest_depth: int = 30            # the deepest that Spark grows; trees grow fully up to it


DEFAULT = EngineConfig()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Read from the session (``spark.checkpoint.dir`` or ``SparkContext.setCheckpointDir``).
    Only a local-mode session without one gets a fresh temporary folder; a cluster
    session without one is an error, because a machine-local folder does not survive
    the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="pairlab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared (HDFS/S3/ABFS) folder")


def state_path(spark: SparkSession, *parts: str) -> str:
    """A path under the checkpoint folder for tables written to cut lineage."""
    base = checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "pairlab", *parts])
