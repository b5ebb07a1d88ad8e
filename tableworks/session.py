"""Session helpers: shared scratch folder, lineage cuts and recommended settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the operators are designed for. AQE splits hot join keys;
# forceOptimizeSkewedJoin lets it do so even when a later step then needs its own shuffle.
# A measured side that is small is broadcast however few keys it has: by default AQE refuses when most
# partitions are empty, and sorts all rows of a few groups in a few tasks.
# The generated code of a full outer merge join keeps all joined rows of one key until the key ends, the plain
# operator hands them on one by one.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
    "spark.sql.codegen.join.fullOuterSortMergeJoin.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to a session the caller created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting (tests, a laptop) gets a folder of its own. On a
    cluster a missing setting is an error: data kept on one machine dies with it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tableworks-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    Used where a later step must see exactly the same partitions again (range boundaries are
    sampled, so a recomputation could move them) and to cut the lineage of iterations.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def are_few(df: DataFrame, most: int = 200_000, most_bytes: int = 64 << 20) -> bool:
    """Whether ``df`` has at most ``most`` rows and ``most_bytes`` bytes as JSON; both are counted."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    rows, held = df.limit(most + 1).agg(F.count("*"), size).first()
    return rows <= most and (held or 0) <= most_bytes


def broadcast_if_few(df: DataFrame, most: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``most`` rows and ``most_bytes`` bytes as JSON, else
    as it is.

    Counts both, so it is meant for results that are pinned already.
    """
    return F.broadcast(df) if are_few(df, most, most_bytes) else df
