"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder the cluster names for checkpoints.

    Only a local session without that setting gets a folder of its own; anywhere
    else a machine-local path would be lost with its machine.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"Set {CHECKPOINT_DIR} to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
